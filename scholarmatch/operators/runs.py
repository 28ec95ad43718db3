"""Runs, their artifacts and their traces."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmatch.functions import vocab
from scholarmatch.functions.scale import page_of, previous_value, running_total, spaced_starts

LIMITS = {
    "MAX_STEPS": 5,
    "MAX_LLM_CALLS": 15,
    "MAX_TOKENS": 150_000,
    "MAX_EXTERNAL_CALLS": 25,
    "SOURCE_RATE_LIMIT": 8,
    "MAX_WALL_TIME": 120,
}


# --- artifacts ---------------------------------------------------------------------------------
def current_artifacts(artifacts: DataFrame) -> DataFrame:
    """One row per artifact id: a later save replaces an earlier one."""
    row = F.struct("run_id", "kind", "payload", "created_at", "seq")
    newest = artifacts.groupBy("id").agg(F.max_by(row, F.struct("created_at", "seq")).alias("r"))
    return newest.select("id", "r.*")


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    """(run_id, kind, payload) of the newest artifact of each kind."""
    rows = current_artifacts(artifacts)
    return rows.groupBy("run_id", "kind").agg(F.max_by("payload", F.struct("created_at", "seq")).alias("payload"))


def run_views(artifacts: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """(run_id, one payload column per kind) of runs that have every required kind, newest payloads."""
    def newest(kind: str) -> Column:
        return F.max_by("payload", F.when(F.col("kind") == kind, F.struct("created_at", "seq"))).alias(kind)

    rows = current_artifacts(artifacts).groupBy("run_id").agg(*[newest(k) for k in (*required, *optional)])
    for kind in required:
        rows = rows.where(F.col(kind).isNotNull())
    return rows


def runs_by_json_field(artifacts: DataFrame, kind: str, field: str, value) -> DataFrame:
    """(run_id) of runs with an artifact of the kind whose field equals the value, type included; bad JSON is skipped."""
    node = F.try_variant_get(F.try_parse_json("payload"), f"$.{field}", "variant")
    as_type = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "double"
    typed = F.schema_of_variant(node)
    same_type = {
        "boolean": typed == "BOOLEAN",
        "string": typed == "STRING",
        "double": typed.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"),
    }[as_type]
    equal = F.try_variant_get(F.try_parse_json("payload"), f"$.{field}", as_type) == F.lit(
        float(value) if as_type == "double" else value
    )
    return current_artifacts(artifacts).where((F.col("kind") == kind) & same_type & equal).select("run_id").distinct()


def visible_runs(runs: DataFrame, seeded: DataFrame, session_ids: DataFrame, demo: bool = True) -> DataFrame:
    """Runs a visitor may see, newest first: the seeded ones and their own; all of them outside a demo."""
    if demo:
        allowed = seeded.select("run_id").unionByName(session_ids.select("run_id")).distinct()
        runs = runs.join(allowed, "run_id", "left_semi")
    return runs.orderBy(F.desc("created_at"), "run_id")


_POINTS = "array<struct<text:string>>"
_PROFILE = (
    "professor_id string, name struct<value:string>, institution struct<value:string>, department struct<value:string>"
)
_MATCH = (
    "research_fit string, recommendation string, evidence_sufficiency string, "
    "dimensions array<struct<key:string,summary:string>>, gaps array<string>"
)
_ANALYSIS = f"research_intersection {_POINTS}, method_match {_POINTS}, background_gaps {_POINTS}"


def run_comparison(runs: DataFrame, artifacts: DataFrame, max_texts: int | None = None) -> DataFrame:
    """Completed runs with a profile and a match, as display rows with labels and fallbacks."""
    latest = run_views(artifacts, ("professor_profile", "match"), ("deep_analysis",)).toDF("run_id", "p", "m", "d")
    rows = (
        runs.where("status = 'COMPLETED'")
        .join(latest, "run_id")
        .withColumns({"p": F.from_json("p", _PROFILE), "m": F.from_json("m", _MATCH), "d": F.from_json("d", _ANALYSIS)})
    )

    def or_else(c: Column, fallback) -> Column:
        other = F.lit(fallback) if isinstance(fallback, str) else fallback
        return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)

    def label(table: Mapping[str, str], c: str, fallback: str) -> Column:
        known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return F.coalesce(F.try_element_at(known, F.coalesce(F.col(c), F.lit(""))), F.lit(fallback))

    def joined(c: Column) -> Column:
        return F.array_join(c if max_texts is None else F.slice(c, 1, max_texts), "；")

    def texts(*cs: str) -> Column:
        none = F.array().cast("array<string>")
        listed = F.concat(*[F.coalesce(F.transform(c, lambda p: p["text"]), none) for c in cs])
        return joined(listed)

    specific = F.filter(
        F.coalesce("m.dimensions", F.array().cast("array<struct<key:string,summary:string>>")),
        lambda x: (x["key"] == "research_topic") & x["summary"].contains(vocab.OVERLAP_PHRASE[0]) & x["summary"].contains(vocab.OVERLAP_PHRASE[1][2:]),
    )
    fallback = joined(F.transform(specific, lambda x: x["summary"]))
    gaps = joined(F.coalesce("m.gaps", F.array().cast("array<string>")))
    professor = or_else(F.col("p.name.value"), F.col("p.professor_id"))
    school = or_else(F.col("p.institution.value"), vocab.UNVERIFIED_SCHOOL)
    college = or_else(F.col("p.department.value"), vocab.UNVERIFIED_COLLEGE)
    return rows.select(
        "run_id",
        or_else(F.col("name"), F.concat_ws(" · ", professor, school, college)).alias("record"),
        professor.alias("professor"),
        school.alias("school"),
        college.alias("college"),
        label(vocab.FIT_LABELS, "m.research_fit", vocab.UNKNOWN_LABELS["fit"]).alias("fit"),
        label(vocab.ADVICE_LABELS, "m.recommendation", vocab.UNKNOWN_LABELS["advice"]).alias("advice"),
        label(vocab.SUFFICIENCY_LABELS, "m.evidence_sufficiency", vocab.UNKNOWN_LABELS["sufficiency"]).alias("sufficiency"),
        or_else(
            texts("d.research_intersection", "d.method_match"), or_else(fallback, vocab.NO_ANALYSIS)
        ).alias("overlap"),
        or_else(texts("d.background_gaps"), or_else(gaps, vocab.NO_GAPS)).alias("to_add"),
        "created_at",
    )


def archive_filter(rows: DataFrame, query: str = "", school: str = "", college: str = "") -> DataFrame:
    """Comparison rows whose record, name, school or college holds the query, of a school and college."""
    hay = F.lower(F.concat_ws(" ", "record", "professor", "school", "college"))
    out = rows.where(hay.contains(query.strip().lower())) if query.strip() else rows
    out = out.where(F.col("school") == school) if school else out
    return out.where(F.col("college") == college) if college else out


def archive_page(rows: DataFrame, page: int = 1, size: int = 9) -> DataFrame:
    """One page of the archive, newest runs first; a late page reads the ranges that hold it, not all before it."""
    return page_of(rows, [F.desc("created_at"), F.col("run_id")], (page - 1) * size, page * size)


def archive_facets(rows: DataFrame, school: str = "") -> DataFrame:
    """(facet, value): verified schools, and verified colleges of the chosen school."""
    schools = rows.select(F.lit("school").alias("facet"), F.col("school").alias("value")).where(F.col("value") != vocab.UNVERIFIED_SCHOOL)
    here = rows.where(F.col("school") == school) if school else rows
    colleges = here.select(F.lit("college").alias("facet"), F.col("college").alias("value")).where(F.col("value") != vocab.UNVERIFIED_COLLEGE)
    return schools.unionByName(colleges).distinct()


def duplicate_archive(rows: DataFrame) -> DataFrame:
    """(run_id, duplicate_of): the newest other completed run on the same person, school and college.

    The two newest runs of a person answer for all of its runs, so no run meets every other.
    """
    def part(c: str) -> Column:
        folded = F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", "")
        return F.when(folded == vocab.UNVERIFIED_COLLEGE, F.lit("")).otherwise(folded)

    keyed = rows.select("run_id", "created_at", part("professor").alias("a"), part("school").alias("b"), part("college").alias("c"))
    order = Window.partitionBy("a", "b", "c").orderBy(F.desc("created_at"), "run_id")
    top = keyed.withColumn("n", F.row_number().over(order)).where("n <= 2")
    two = top.groupBy("a", "b", "c").agg(
        F.max(F.when(F.col("n") == 1, F.col("run_id"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("run_id"))).alias("second")
    )
    other = F.when(F.col("run_id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return keyed.join(two, ["a", "b", "c"]).select("run_id", other.alias("duplicate_of")).where("duplicate_of IS NOT NULL")


def is_run_id(c: Column) -> Column:
    """A UUID in any of its accepted spellings."""
    return F.regexp_replace(F.lower(c), r"urn:|uuid:|[{}-]", "").rlike("^[0-9a-f]{32}$")


def retention_audit(files: DataFrame, runs: DataFrame, now: str, days: float = 30) -> DataFrame:
    """(file, size, state, expired) of managed uploads; other files are never touched.

    ``files``: file, size, modified_at. An orphan has no run any more and expires after ``days``.
    """
    managed = files.where(F.lower("file").endswith(".pdf")).withColumn("run_id", F.regexp_replace("file", r"(?i)\.pdf$", ""))
    managed = managed.where(is_run_id(F.col("run_id")))
    known = runs.select("run_id").distinct().withColumn("_k", F.lit(True))
    rows = managed.join(known, "run_id", "left")
    orphan = F.col("_k").isNull()
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("modified_at").cast("timestamp"))) / F.lit(86_400_000_000.0)
    return rows.select(
        "file", "size", F.when(orphan, "orphan").otherwise("referenced").alias("state"), (orphan & (age >= days)).alias("expired")
    )


def retention_totals(audit: DataFrame) -> DataFrame:
    orphan = F.col("state") == "orphan"
    return audit.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(~orphan).alias("referenced"),
        F.count_if(orphan).alias("orphans"),
        F.coalesce(F.sum(F.when(orphan, F.col("size"))), F.lit(0)).alias("orphan_bytes"),
        F.count_if("expired").alias("expired"),
    )


def delete_run(runs: DataFrame, artifacts: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the run; anything but an exact UUID is refused."""
    try:
        uuid.UUID(run_id)
    except (ValueError, AttributeError, TypeError) as exc:
        raise ValueError("run_id must be a valid UUID") from exc
    return runs.where(F.col("run_id") != run_id), artifacts.where(F.col("run_id") != run_id)


# --- traces ------------------------------------------------------------------------------------
def trace_rollup(steps: DataFrame) -> DataFrame:
    """Per run: steps, tool calls, external calls, tokens, duration and failed steps."""
    tool = F.col("kind") == "tool_call"
    return steps.groupBy("run_id").agg(
        F.count("*").alias("steps"),
        F.count_if(tool).alias("tool_calls"),
        F.count_if(tool & (F.col("source") != "")).alias("external_calls"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"),
        F.sum("duration_ms").alias("duration_ms"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def trace_user_steps(steps: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(run_id, idx, label, status, detail): tool calls in the words a user understands."""
    def table(entries: Mapping[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])

    detail = F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.col("error"), F.lit(""))
    return steps.where("kind = 'tool_call'").select(
        "run_id",
        "idx",
        F.coalesce(F.try_element_at(table(vocab.TOOL_LABELS), F.col("name")), F.lit(vocab.OTHER_TOOL_LABEL)).alias("label"),
        F.coalesce(F.try_element_at(table(vocab.STATUS_LABELS), F.col("status")), F.col("status")).alias("status"),
        (detail if max_chars is None else F.substring(detail, 1, max_chars)).alias("detail"),
    )


def budget_breach(
    steps: DataFrame,
    limits: Mapping[str, float] = LIMITS,
    carried: DataFrame | None = None,
    carried_sources: DataFrame | None = None,
) -> DataFrame:
    """(run_id, reason, at_idx): the first step at which a run hits a limit, by fixed priority among equals.

    ``steps``: run_id, idx, kind, source, tokens_in, tokens_out, ts. Counters of earlier batches may be
    carried in (run_id, steps, llm_calls, tokens, external_calls, started) and (run_id, source, calls).
    """
    decides, calls = F.col("kind") == "llm_decision", (F.col("kind") == "tool_call") & (F.col("source") != "")
    counters = ("steps", "llm_calls", "tokens", "external_calls")
    totals = running_total(
        steps.select("run_id", "idx", "kind", "source", "tokens_in", "tokens_out"),
        ["run_id"],
        "idx",
        {
            "c_steps": F.when(decides, 1).otherwise(0),
            "c_llm_calls": F.when(decides, 1).otherwise(0),
            "c_tokens": F.when(decides, F.col("tokens_in") + F.col("tokens_out")).otherwise(0),
            "c_external_calls": F.when(calls, 1).otherwise(0),
        },
    )
    by_source = running_total(steps.where(calls).select("run_id", "source", "idx"), ["run_id", "source"], "idx", {"n": F.lit(1)})
    started = steps.groupBy("run_id").agg(F.min("ts").alias("first_ts"))
    if carried is not None:
        before = carried.select("run_id", *[F.col(c).alias(f"p_{c}") for c in counters], F.col("started").alias("p_started"))
        totals = totals.join(before, "run_id", "left")
        for c in counters:
            totals = totals.withColumn(f"c_{c}", F.col(f"c_{c}") + F.coalesce(f"p_{c}", F.lit(0)))
        started = started.join(before.select("run_id", "p_started"), "run_id", "left").select(
            "run_id", F.least("first_ts", "p_started").alias("first_ts")
        )
    if carried_sources is not None:
        earlier = carried_sources.select("run_id", "source", F.col("calls").alias("_p"))
        by_source = by_source.join(earlier, ["run_id", "source"], "left").withColumn("n", F.col("n") + F.coalesce("_p", F.lit(0)))

    pairs = (
        ("MAX_STEPS", "c_steps"), ("MAX_LLM_CALLS", "c_llm_calls"), ("MAX_TOKENS", "c_tokens"), ("MAX_EXTERNAL_CALLS", "c_external_calls"),
    )
    counted = totals.groupBy("run_id").agg(
        *[F.min(F.when(F.col(c) >= limits[code], F.col("idx"))).alias(code) for code, c in pairs]
    )
    rate = (
        by_source.where(F.col("n") >= limits["SOURCE_RATE_LIMIT"])
        .groupBy("run_id")
        .agg(F.min(F.struct("idx", "source")).alias("_s"))
        .select("run_id", F.col("_s.idx").alias("SOURCE_RATE_LIMIT"), F.col("_s.source").alias("_source"))
    )
    end = F.col("first_ts") + F.make_dt_interval(secs=F.lit(float(limits["MAX_WALL_TIME"])))
    wall = (
        steps.select("run_id", "idx", "ts")
        .join(started, "run_id")
        .where(F.col("ts") >= end)
        .groupBy("run_id")
        .agg(F.min("idx").alias("MAX_WALL_TIME"))
    )
    rows = counted.join(rate, "run_id", "left").join(wall, "run_id", "left")
    codes = [*(code for code, _ in pairs), "SOURCE_RATE_LIMIT", "MAX_WALL_TIME"]
    at = F.least(*[F.col(c) for c in codes])
    reason = F.coalesce(
        *[
            F.when(F.col(c) == at, F.concat(F.lit(f"{c}:"), "_source") if c == "SOURCE_RATE_LIMIT" else F.lit(c))
            for c in codes
        ]
    )
    return rows.select("run_id", reason.alias("reason"), at.alias("at_idx")).where("at_idx IS NOT NULL")


def call_caps(steps: DataFrame, caps: Mapping[str, int], intervals: Mapping[str, float]) -> DataFrame:
    """(run_id, idx, name, source, skipped, wait_s, start_at): calls past a tool's cap, and when each other one starts.

    A source takes one call per interval, in the order in which they are asked for. A call that has to wait starts
    later and so holds up the ones after it, in its own and in other runs; a skipped call reaches no source.
    """
    calls = steps.where("kind = 'tool_call'").select("run_id", "idx", "name", "source", "ts")
    numbered = running_total(calls, ["run_id", "name"], "idx", {"nth": F.lit(1)})
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    gap = F.create_map(*[F.lit(x) for pair in intervals.items() for x in (pair[0], round(float(pair[1]) * 1_000_000))])
    judged = numbered.withColumn("skipped", F.coalesce(F.col("nth") > F.try_element_at(cap, F.col("name")), F.lit(False)))
    asked = judged.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_asked", F.when(~F.col("skipped"), F.col("_us")))
    started = spaced_starts(asked, ["source"], ["_us", "run_id", "idx"], "_asked", F.try_element_at(gap, F.col("source")), "_start")
    return started.select(
        "run_id",
        "idx",
        "name",
        "source",
        "skipped",
        F.coalesce((F.col("_start") - F.col("_asked")) / 1_000_000.0, F.lit(0.0)).alias("wait_s"),
        F.timestamp_micros("_start").alias("start_at"),
    )


def source_health(outcomes: DataFrame, shown: int | None = None) -> DataFrame:
    """Per run: sources asked, answered and failed, the first failed ones, cost and one line about it.

    ``outcomes``: run_id, pos, label, status, n, reason, cost — one row per source of a run.
    """
    searched, failed = F.col("status").isin("ok", "empty"), F.col("status").isin("blocked", "error")
    used = searched & (F.col("n") > 0)
    said = F.when(
        used,
        F.concat("label", F.lit(" "), F.col("n").cast("string"), F.lit(vocab.HEALTH["papers"]), F.when(F.col("reason") != "", F.concat(F.lit("（"), "reason", F.lit("）"))).otherwise("")),
    )
    quiet = F.when(failed, F.concat("label", F.lit("（"), "reason", F.lit("）")))

    def listed(value: Column) -> Column:
        kept = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("pos", value.alias("v")))))
        return F.transform(kept, lambda x: x["v"])

    rows = outcomes.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(searched).alias("searched"),
        F.count_if(failed).alias("failed"),
        F.round(F.sum("cost"), 6).alias("cost"),
        listed(F.when(failed, F.col("label"))).alias("_f"),
        listed(said).alias("_u"),
        listed(quiet).alias("_q"),
    )
    line = F.concat(
        F.when(F.size("_u") > 0, F.array_join("_u", "、")).otherwise(vocab.HEALTH["nothing"]),
        F.when(F.size("_q") > 0, F.concat(F.lit(vocab.HEALTH["silent"]), F.array_join("_q", "、"))).otherwise(""),
    )
    return rows.select(
        "run_id",
        "total",
        "searched",
        "failed",
        F.array_join("_f" if shown is None else F.slice("_f", 1, shown), "、").alias("failed_labels"),
        ((F.col("searched") == 0) & (F.col("failed") > 0)).alias("unavailable"),
        "cost",
        line.alias("description"),
    )


def stage_chain(steps: DataFrame) -> DataFrame:
    """(run_id, idx, stage): the stages a run went through, repeats in a row once."""
    marked = steps.where("stage IS NOT NULL").select("run_id", "idx", "stage")
    before = previous_value(marked, ["run_id"], "idx", "stage", "_before")
    return before.where(F.col("_before").isNull() | (F.col("_before") != F.col("stage"))).select("run_id", "idx", "stage")
