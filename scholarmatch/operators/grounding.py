"""Every claim, point and sentence must point to evidence that exists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmatch.functions import text, vocab
from scholarmatch.functions.scale import shuffled


def validate_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, code, evidence_id): unknown evidence, affirmed blocked fields, trends on unconfirmed authors."""
    known = shuffled(evidence).select(F.col("id").alias("evidence_id"), "author_resolution_status").dropDuplicates(["evidence_id"])
    refs = claims.select("claim_id", "claim_type", "status", F.explode("evidence_ids").alias("evidence_id"))
    looked = refs.join(known.withColumn("_known", F.lit(True)), "evidence_id", "left")
    unknown = F.col("_known").isNull()
    unsure = (
        F.col("claim_type").isin(list(vocab.TREND_CLAIM_TYPES))
        & (F.col("status") == "SUPPORTED")
        & F.col("_known")
        & ~F.col("author_resolution_status").eqNullSafe("CONFIRMED")
    )
    by_reference = looked.withColumn(
        "code", F.when(unknown, "UNKNOWN_EVIDENCE_ID").when(unsure, "AUTHOR_NOT_CONFIRMED")
    ).where(F.col("code").isNotNull())
    blocked = claims.where(F.col("claim_type").isin(list(vocab.BLOCKED_CLAIM_TYPES)) & (F.col("status") != "UNKNOWN"))
    return by_reference.select("claim_id", "code", "evidence_id").unionByName(
        blocked.select("claim_id", F.lit("AFFIRMATIVE_UNKNOWN_FIELD").alias("code"), F.lit("").alias("evidence_id"))
    )


def surviving_claims(claims: DataFrame, errors: DataFrame) -> DataFrame:
    return claims.join(shuffled(errors).select("claim_id").distinct(), "claim_id", "left_anti")


def _kept_refs(points: DataFrame, column: str, valid: DataFrame, out: str) -> DataFrame:
    """Per point its references that are valid, in order."""
    refs = points.select("point_id", F.posexplode(column).alias("pos", "ref"))
    good = refs.join(shuffled(valid).select(F.col(valid.columns[0]).alias("ref")).distinct(), "ref", "left_semi")
    return good.groupBy("point_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias(out)
    )


def sanitize_points(
    points: DataFrame, facts: DataFrame, evidence: DataFrame, rules: Mapping[str, tuple[bool, bool]] = vocab.SECTION_RULES
) -> DataFrame:
    """Points with text and with the grounding their section demands; unknown references removed.

    ``points``: point_id, section, text, fact_ids, evidence_ids. A section outside the rules has no demand.
    """
    none = F.array().cast("array<string>")
    f = _kept_refs(points, "fact_ids", facts, "_f")
    e = _kept_refs(points, "evidence_ids", evidence, "_e")
    rows = points.join(shuffled(f), "point_id", "left").join(shuffled(e), "point_id", "left")
    needs_f = F.col("section").isin([s for s, (a, _) in rules.items() if a])
    needs_e = F.col("section").isin([s for s, (_, b) in rules.items() if b])
    return rows.where(
        ~text.blank("text") & (~needs_f | F.col("_f").isNotNull()) & (~needs_e | F.col("_e").isNotNull())
    ).select(
        "point_id", "section", text.strip("text").alias("text"),
        F.coalesce("_f", none).alias("fact_ids"), F.coalesce("_e", none).alias("evidence_ids"),
    )


def sanitize_summaries(summaries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Summaries keep their valid references; without any, or without text, they are emptied."""
    shaped = summaries.withColumnRenamed("summary_id", "point_id")
    e = _kept_refs(shaped, "evidence_ids", evidence, "_e")
    rows = shaped.join(shuffled(e), "point_id", "left")
    good = ~text.blank("summary") & F.col("_e").isNotNull()
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("point_id").alias("summary_id"),
        F.when(good, F.col("summary")).otherwise("").alias("summary"),
        F.when(good, F.col("_e")).otherwise(none).alias("evidence_ids"),
    )


def _judged(sentences: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sentences with the number of references they have and the number that are valid."""
    def valid_count(column: str, valid: DataFrame, out: str) -> DataFrame:
        refs = sentences.select("draft_id", "idx", F.explode(column).alias("ref"))
        good = refs.join(shuffled(valid).select(F.col(valid.columns[0]).alias("ref")).distinct(), "ref", "left_semi")
        return good.groupBy("draft_id", "idx").agg(F.count("*").alias(out))

    return (
        shuffled(sentences).join(valid_count("fact_ids", facts, "_vf"), ["draft_id", "idx"], "left")
        .join(valid_count("evidence_ids", evidence, "_ve"), ["draft_id", "idx"], "left")
        .withColumns(
            {
                "_nf": F.size("fact_ids"),
                "_ne": F.size("evidence_ids"),
                "_vf": F.coalesce("_vf", F.lit(0)),
                "_ve": F.coalesce("_ve", F.lit(0)),
            }
        )
    )


def validate_draft(
    sentences: DataFrame,
    facts: DataFrame,
    evidence: DataFrame,
    paper_read: bool = False,
    banned: Sequence[str] = vocab.BANNED_PHRASES,
    paper_word: str = vocab.PAPER_WORD,
    read_words: Sequence[str] = vocab.READ_WORDS,
) -> DataFrame:
    """(draft_id, idx, code, detail) for flattery, claimed reading, and facts without valid references.

    ``facts`` and ``evidence`` hold the valid ids in their first column.
    """
    said = F.col("text")
    found = [F.when(said.contains(p), F.struct(F.lit("UNCONFIRMED_FLATTERY").alias("code"), F.lit(p).alias("detail"))) for p in banned]
    claims_read = said.contains(paper_word) & F.greatest(*[said.contains(w) for w in read_words], F.lit(False))

    def error(when, code: str):
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit("").alias("detail")))

    professor, student = F.col("sentence_type") == "PROFESSOR_FACT", F.col("sentence_type") == "STUDENT_FACT"
    checks = [
        *found,
        error(F.lit(not paper_read) & claims_read, "PAPER_READ_UNCONFIRMED"),
        error(professor & (F.size("evidence_ids") <= 0), "PROFESSOR_FACT_WITHOUT_EVIDENCE"),
        error(student & (F.size("fact_ids") <= 0), "STUDENT_FACT_WITHOUT_FACT"),
    ]
    # Told by the sentence alone; texts are not shuffled.
    alone = sentences.select("draft_id", "idx", F.explode(F.array_compact(F.array(*checks))).alias("e")).select("draft_id", "idx", "e.code", "e.detail")

    def broken(rows: DataFrame, column: str, valid: DataFrame, code: str) -> DataFrame:
        """The sentences with a reference that is not valid; only references are shuffled."""
        refs = rows.select("draft_id", "idx", F.explode(column).alias("ref"))
        bad = refs.join(shuffled(valid).select(F.col(valid.columns[0]).alias("ref")).distinct(), "ref", "left_anti")
        return bad.select("draft_id", "idx").distinct().select("draft_id", "idx", F.lit(code).alias("code"), F.lit("").alias("detail"))

    return (
        alone.unionByName(broken(sentences.where(professor), "evidence_ids", evidence, "UNKNOWN_EVIDENCE_ID"))
        .unionByName(broken(sentences.where(student), "fact_ids", facts, "UNCONFIRMED_STUDENT_FACT"))
    )


def draft_coverage(sentences: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, professor_fact_coverage, student_fact_coverage); 1.0 where there is nothing to cover."""
    rows = _judged(sentences, facts, evidence)
    prof_ok = F.when((F.col("_ne") > 0) & (F.col("_ve") == F.col("_ne")), 1.0).otherwise(0.0)
    stud_ok = F.when((F.col("_nf") > 0) & (F.col("_vf") == F.col("_nf")), 1.0).otherwise(0.0)
    return rows.groupBy("draft_id").agg(
        F.coalesce(F.avg(F.when(F.col("sentence_type") == "PROFESSOR_FACT", prof_ok)), F.lit(1.0)).alias("professor_fact_coverage"),
        F.coalesce(F.avg(F.when(F.col("sentence_type") == "STUDENT_FACT", stud_ok)), F.lit(1.0)).alias("student_fact_coverage"),
    )


def prune_draft(sentences: DataFrame, errors: DataFrame) -> DataFrame:
    """The sentences without any error."""
    return sentences.join(shuffled(errors).select("draft_id", "idx").distinct(), ["draft_id", "idx"], "left_anti")
