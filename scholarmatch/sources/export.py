"""Run reports: one Markdown and one JSON document a run, without CV text or keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmatch.functions import vocab
from scholarmatch.functions.scale import shuffled


def per_run(rows: DataFrame, order: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """(run_id, out): what belongs to a run as an array of structs in order; a report is read as a whole."""
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("_v"))
    return rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["_v"]).alias(out))


def run_reports(
    runs: DataFrame, resolutions: DataFrame, fields: DataFrame, topics: DataFrame, reports: DataFrame, dimensions: DataFrame,
    gaps: DataFrame, evidence: DataFrame, headers: DataFrame, sentences: DataFrame, warnings: DataFrame,
) -> DataFrame:
    """One nested row per run: run_id, resolution, professor, match_report, evidences, draft, warnings.

    All inputs have a ``run_id``. ``runs``: recruiting. ``resolutions``: status, selected_author_id, reasons, conflicts.
    ``fields``: pos, key, value. ``topics``: pos, kind (declared, observed), topic, trend. ``reports``, ``dimensions``,
    ``gaps``: outputs of the fit operators. ``evidence``: id, source_type, title, source_url. ``headers``: subject.
    ``sentences``: idx, text. ``warnings``: pos, text. What a run does not have is an empty list or text.
    """
    out = runs.select("run_id", F.coalesce("recruiting", F.lit("UNKNOWN")).alias("recruiting"))
    named = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("id"))
    shown = evidence.select("run_id", "id", F.coalesce("source_type", F.lit("")).alias("source_type"), named.alias("title"), F.coalesce("source_url", F.lit("")).alias("source_url"))
    parts = (
        (per_run(fields, ["pos", "key"], ["key", "value"], "fields"), "fields", "array<struct<key:string,value:string>>"),
        (per_run(topics.where("kind = 'declared'"), ["pos", "topic"], ["topic"], "declared"), "declared", "array<struct<topic:string>>"),
        (per_run(topics.where("kind = 'observed'"), ["pos", "topic"], ["topic", "trend"], "observed"), "observed", "array<struct<topic:string,trend:string>>"),
        (per_run(dimensions.where("standing = 'strength'"), ["pos"], ["label"], "strengths"), "strengths", "array<struct<label:string>>"),
        (per_run(gaps, ["topic"], ["topic"], "gaps"), "gaps", "array<struct<topic:string>>"),
        (per_run(shown, ["id"], ["id", "source_type", "title", "source_url"], "evidences"), "evidences", "array<struct<id:string,source_type:string,title:string,source_url:string>>"),
        (per_run(sentences, ["idx"], ["text"], "sentences"), "sentences", "array<struct<text:string>>"),
        (per_run(warnings, ["pos"], ["text"], "warnings"), "warnings", "array<struct<text:string>>"),
    )
    for rows, name, kind in parts:
        out = out.join(shuffled(rows).select("run_id", F.col(name).cast(kind).alias(name)), "run_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    out = out.join(shuffled(resolutions).select("run_id", "status", "selected_author_id", "reasons", "conflicts"), "run_id", "left")
    out = out.join(shuffled(reports).select("run_id", "research_fit", "recommendation", "opportunity_signal", "question"), "run_id", "left")
    out = out.join(shuffled(headers).select("run_id", "subject"), "run_id", "left")
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    each = lambda c, field: F.transform(c, lambda x: x[field])
    return out.select(
        "run_id",
        F.struct(said("status").alias("status"), said("selected_author_id").alias("selected_author_id"), texts("reasons").alias("reasons"), texts("conflicts").alias("conflicts")).alias("resolution"),
        F.struct("fields", each("declared", "topic").alias("declared_interests"), F.col("observed").alias("observed_recent_topics"), "recruiting").alias("professor"),
        F.struct(
            said("research_fit").alias("research_fit"), said("recommendation").alias("recommendation"), said("opportunity_signal").alias("opportunity_signal"),
            each("strengths", "label").alias("strengths"), each("gaps", "topic").alias("gaps"), said("question").alias("question"),
        ).alias("match_report"),
        "evidences",
        F.struct(said("subject").alias("subject"), each("sentences", "text").alias("sentences")).alias("draft"),
        each("warnings", "text").alias("warnings"),
    )


def report_markdown(generated_at: str | None = None) -> Column:
    """The Markdown document of a row of ``run_reports``."""
    head, word = vocab.REPORT_HEADINGS, vocab.REPORT_LINES

    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {word[key]}："), value)

    def listed(key: str, values: Column, sep: str = "、") -> Column:
        return F.when(F.size(values) > 0, line(key, F.array_join(values, sep)))

    def if_any(key: str, value: Column) -> Column:
        return F.when(value != "", line(key, value))

    def section(key: str, *first: Column) -> Column:
        return F.array(F.lit(""), F.lit(head[key]), *first)

    seen = F.transform("professor.observed_recent_topics", lambda t: F.concat(t["topic"], F.lit("("), t["trend"], F.lit(")")))
    match, who = "match_report.", "resolution."
    cited = F.transform(
        "evidences", lambda e: F.concat(F.lit("- ["), e["source_type"], F.lit("] "), e["title"], F.lit("（"), e["source_url"], F.lit("）"))
    )
    subject = F.col("draft.subject")
    started = [F.lit(f"- {word['generated']}：{generated_at}")] if generated_at else []
    everything = F.concat(
        F.array(F.lit(head["report"]), F.lit(""), *started, line("run", F.col("run_id"))),
        section("identity", line("status", F.col(who + "status")), if_any("selected", F.col(who + "selected_author_id")), listed("reasons", F.col(who + "reasons"), ", "), listed("conflicts", F.col(who + "conflicts"), ", ")),
        section("profile"),
        F.transform("professor.fields", lambda f: F.concat(F.lit("- "), f["key"], F.lit("："), f["value"])),
        F.array(listed("declared", F.col("professor.declared_interests")), listed("observed", seen), line("recruiting", F.col("professor.recruiting"))),
        section(
            "match", line("fit", F.col(match + "research_fit")), line("advice", F.col(match + "recommendation")), line("signal", F.col(match + "opportunity_signal")),
            listed("strengths", F.col(match + "strengths")), listed("gaps", F.col(match + "gaps")), if_any("questions", F.col(match + "question")),
        ),
        section("evidence", F.when(F.size("evidences") == 0, F.lit(f"- {word['none']}"))),
        cited,
        section("draft", F.when(subject != "", F.concat(F.lit(f"{word['subject']}："), subject))),
        F.transform("draft.sentences", lambda t: F.concat(F.lit("- "), t)),
        F.when(F.size("warnings") > 0, F.concat(section("warnings"), F.transform("warnings", lambda w: F.concat(F.lit("- "), w)))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(everything, "\n")


def report_files(reports: DataFrame, generated_at: str | None = None) -> DataFrame:
    """(run_id, name, content): ``report.md`` and ``report.json`` of every run."""
    documents = F.array(
        F.struct(F.lit("report.md").alias("name"), report_markdown(generated_at).alias("content")),
        F.struct(F.lit("report.json").alias("name"), F.to_json(F.struct(*reports.columns)).alias("content")),
    )
    return reports.select("run_id", F.explode(documents).alias("d")).select("run_id", "d.name", "d.content")
