"""Topics and disciplines of people, from their dated works."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmatch.functions import text, vocab


def works_by_topic(works: DataFrame) -> DataFrame:
    """(person, topic, work_id, year, seq); works without a topic come under one label."""
    some = F.when(F.coalesce(F.size("topics"), F.lit(0)) > 0, F.col("topics")).otherwise(F.array(F.lit(vocab.UNCLASSIFIED)))
    return works.select("person", F.explode(some).alias("topic"), "work_id", "year", "seq")


def _age_weight(age: Column) -> Column:
    # in hundredths: whole numbers add up the same in any order
    return F.when(age <= 2, 60).when(age == 3, 25).otherwise(15)


def topic_trend(topic_works: DataFrame, ref_year: int) -> DataFrame:
    """(person, topic, n, status, window) from the dated works of a person's topic.

    Works collapse to one row per year before they meet, so a very busy topic stays small.
    """
    dated = topic_works.where(F.col("year").isNotNull())
    per_year = dated.groupBy("person", "topic", "year").agg(F.count("*").alias("n"))
    age = F.lit(ref_year) - F.col("year")
    sums = per_year.groupBy("person", "topic").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("years"),
        F.sum(_age_weight(age) * F.col("n")).alias("total"),
        F.sum(F.when(age <= 2, _age_weight(age) * F.col("n")).otherwise(0)).alias("recent"),
        F.min("year").alias("lo"),
        F.max("year").alias("hi"),
    )
    thin = (F.col("n") < 3) | (F.col("years") < 2)
    status = (
        F.when(thin, "INSUFFICIENT_EVIDENCE")
        .when(F.col("recent") * 10 >= F.col("total") * 6, "EMERGING")
        .when(F.col("recent") * 10 >= F.col("total") * 3, "SUSTAINED")
        .otherwise("DECLINING")
    )
    window = F.when(thin, F.lit("")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    return sums.select("person", "topic", "n", status.alias("status"), window.alias("window"))


def topic_evidence(topic_works: DataFrame) -> DataFrame:
    """(person, topic, evidence_id), one row per dated work: as rows, a busy topic has no size limit."""
    return topic_works.where(F.col("year").isNotNull()).select(
        "person", "topic", F.concat(F.lit("ev_"), F.col("work_id").cast("string")).alias("evidence_id")
    )


def dominant_topic(topic_works: DataFrame) -> DataFrame:
    """(person, topic): the most frequent one, the first seen among equals."""
    per_topic = topic_works.groupBy("person", "topic").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return per_topic.groupBy("person").agg(F.max_by("topic", F.struct("n", -F.col("first"), "topic")).alias("topic"))


def _label_order() -> Column:
    return F.create_map(*[x for i, d in enumerate(vocab.DISCIPLINES) for x in (F.lit(d), F.lit(i))])


def dominant_discipline(works: DataFrame, min_support: int = 1) -> DataFrame:
    """(person, discipline, n) of the most frequent known discipline with enough works behind it."""
    known = works.select("person", F.explode("disciplines").alias("discipline")).where(
        F.col("discipline").isin(list(vocab.DISCIPLINES))
    )
    counted = known.groupBy("person", "discipline").agg(F.count("*").alias("n"))
    best = counted.groupBy("person").agg(
        F.max(F.struct("n", -_label_order()[F.col("discipline")], "discipline")).alias("b")
    )
    return best.where(F.col("b.n") >= min_support).select(
        "person", F.col("b.discipline").alias("discipline"), F.col("b.n").alias("n")
    )


def guess_discipline(texts: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """(id, discipline or null): the discipline with most of its keywords in the text, by label order among equals."""
    hits = [
        sum((F.when(F.col("text").contains(w), 1).otherwise(0) for w in keywords.get(d, ()) if w), start=F.lit(0))
        for d in vocab.DISCIPLINES
    ]
    best = F.greatest(*hits)
    pick = F.coalesce(*[F.when((h == best) & (best > 0), F.lit(d)) for d, h in zip(vocab.DISCIPLINES, hits)])
    return texts.select("id", pick.alias("discipline"))


def openalex_discipline(field) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.OPENALEX_FIELDS.items() for x in pair])
    return F.try_element_at(table, F.lower(text.strip(F.coalesce(field, F.lit("")))))


def arxiv_discipline(category) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.ARXIV_PREFIXES.items() for x in pair])
    prefix = F.lower(F.trim(F.split(F.coalesce(category, F.lit("")), r"\.")[0]))
    return F.try_element_at(table, prefix)
