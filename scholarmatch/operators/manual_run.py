"""A run from the student's confirmed facts and a supervisor's materials to everything that is kept of it.

Match, analysis, claims and letter are checked against the facts and the evidence; what does not hold is taken out, the
letter is checked again, and the artifacts of all runs of a batch are published together (``sources.publish``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmatch.functions import vocab
from scholarmatch.functions.scale import shuffled
from scholarmatch.operators import fit, grounding
from scholarmatch.sources import export
from scholarmatch.sources.tables import settle

PAIR = fit.PAIR


def run_id() -> F.Column:
    return F.concat_ws("-", *PAIR)


def _of_run(rows: DataFrame) -> DataFrame:
    return rows.withColumn("run_id", run_id())


def manual_runs(
    requests: DataFrame, facts: DataFrame, students: DataFrame, professors: DataFrame, materials: DataFrame, evidence: DataFrame,
    claims: DataFrame, points: DataFrame, matches: DataFrame, near: DataFrame | None = None, paper_read: bool = False,
) -> dict[str, DataFrame]:
    """What each request's run ends with; every table has the ``run_id`` "student-professor".

    ``requests`` are the runs. ``professors``, ``materials``, ``matches``, ``near``: as ``fit.match_report`` takes them;
    ``students``: student_id, name. ``evidence``: professor_id, id, author_resolution_status (and what reports show).
    ``claims`` and ``points``: as ``grounding`` takes them, with a run_id; facts are named "student:fact" there.
    Results: reports, dimensions, gaps, claims, points, sentences, headers, warnings, evidence and checks (run_id,
    removed, draft_ok: whether the second check of the letter found nothing).
    """
    asked = requests.select(*PAIR).distinct()
    ids = evidence.select("id", "author_resolution_status").distinct()
    confirmed = fit.draftable(facts).select(F.concat_ws(":", "student_id", "fact_id").alias("fact_id"))
    reports = settle(_of_run(fit.match_report(asked, facts, professors, materials, matches, near)), "run-reports")
    good_claims = grounding.surviving_claims(claims, grounding.validate_claims(claims, ids))
    clean = grounding.sanitize_points(points, confirmed, ids.select("id"))
    good_points = clean.join(shuffled(points).select("point_id", "run_id"), "point_id")
    tops = materials.where("kind IN ('declared', 'observed')").select("professor_id", "pos", "topic", "evidence_id", "kind")
    papers = materials.where("kind IN ('keyword', 'text')").select("professor_id", F.col("pos").alias("seq"), F.col("topic").alias("title"), F.lit(None).cast("int").alias("year"), "evidence_id")
    letter = fit.template_draft(asked, facts, professors, tops, papers, paper_read, students=students)
    none = F.array().cast("array<string>")
    own = F.transform("refs", lambda x: F.concat_ws(":", F.col("student_id").cast("string"), x))
    draft = settle(
        letter.select(
            run_id().alias("draft_id"), "idx", "text", "sentence_type",
            F.when(F.col("sentence_type") == "STUDENT_FACT", own).otherwise(none).alias("fact_ids"),
            F.when(F.col("sentence_type") == "PROFESSOR_FACT", F.col("refs")).otherwise(none).alias("evidence_ids"),
        ),
        "run-drafts",
    )
    errors = settle(grounding.validate_draft(draft, confirmed, ids.select("id"), paper_read), "run-errors")
    kept = settle(grounding.prune_draft(draft, errors), "run-letters")
    left = grounding.validate_draft(kept, confirmed, ids.select("id"), paper_read).select(F.col("draft_id").alias("run_id")).distinct()
    removed = errors.select("draft_id", "idx").distinct().groupBy(F.col("draft_id").alias("run_id")).agg(F.count("*").alias("removed"))
    checks = (
        asked.select(run_id().alias("run_id")).join(shuffled(removed), "run_id", "left").join(shuffled(left).withColumn("_left", F.lit(True)), "run_id", "left")
        .select("run_id", F.coalesce("removed", F.lit(0)).alias("removed"), F.col("_left").isNull().alias("draft_ok"))
    )
    headers = _of_run(fit.draft_headers(asked))
    before, after = vocab.DRAFT["removed"]
    warned = headers.select("run_id", F.lit(0).alias("pos"), F.col("warning").alias("text")).unionByName(
        checks.where("removed > 0").select("run_id", F.lit(1).alias("pos"), F.concat(F.lit(before), F.col("removed").cast("string"), F.lit(after)).alias("text"))
    )
    return {
        "reports": reports,
        "dimensions": _of_run(fit.match_dimensions(reports.drop("run_id"), facts, matches, near)),
        "gaps": _of_run(fit.topic_gaps(reports.drop("run_id"), materials, matches, near)),
        "claims": good_claims,
        "points": good_points,
        "sentences": kept.withColumnRenamed("draft_id", "run_id"),
        "headers": headers,
        "warnings": warned,
        "evidence": _of_run(asked.join(shuffled(evidence), "professor_id")),
        "checks": checks,
    }


def artifact_files(found: dict[str, DataFrame], nested: DataFrame) -> DataFrame:
    """(run_id, name, content) of all that a run leaves: its report as two documents, and its artifacts as JSON.

    ``nested``: the rows of ``export.run_reports`` of the same runs.
    """
    def listed(rows: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
        packed = export.per_run(rows, order, fields, "items")
        everyone = found["checks"].select("run_id").join(shuffled(packed), "run_id", "left")
        return everyone.select("run_id", F.lit(name).alias("name"), F.coalesce(F.to_json("items"), F.lit("[]")).alias("content"))

    status = found["checks"].select(
        "run_id", F.lit("status.json").alias("name"),
        F.to_json(F.struct(F.lit("COMPLETED").alias("status"), "draft_ok", "removed")).alias("content"),
    )
    match = found["reports"].select(
        "run_id", F.lit("match.json").alias("name"), F.to_json(F.struct("research_fit", "evidence_sufficiency", "recommendation", "opportunity_signal")).alias("content")
    )
    out = export.report_files(nested).unionByName(status).unionByName(match)
    for rows, order, fields, name in (
        (found["claims"], ["claim_id"], ["claim_id", "claim_type", "status", "evidence_ids"], "claims.json"),
        (found["points"], ["section", "point_id"], ["section", "text", "fact_ids", "evidence_ids"], "analysis.json"),
        (found["sentences"], ["idx"], ["text", "sentence_type", "fact_ids", "evidence_ids"], "draft.json"),
        (found["evidence"], ["id"], ["id"], "evidence.json"),
    ):
        out = out.unionByName(listed(rows, order, fields, name))
    return out
