"""Evidence ledger of confirmed identities and papers, and feed coverage per target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmatch.functions import text, vocab
from scholarmatch.functions.scale import running_total


def confirmed_papers(targets: DataFrame, works: DataFrame) -> DataFrame:
    """Confirmed papers of confirmed targets, numbered per target in arrival order, with ledger ids."""
    sure = targets.where("identity_confirmed").select("target_id", "id_prefix")
    kept = works.where("user_confirmed").join(sure, "target_id")
    numbered = running_total(kept, ["target_id"], "seq", {"n": F.lit(1)})
    digest = F.substring(
        F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("source_url", F.lit(""))), 256), 1, 10
    )
    paper = F.concat_ws("_", F.lit("manual"), "id_prefix", F.col("n").cast("string"), digest)
    return numbered.withColumn("paper_id", paper)


def platform_label(platform) -> Column:
    known = F.create_map(*[F.lit(x) for pair in vocab.PLATFORM_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(platform, F.lit(""))), F.lit(vocab.MANUAL_ENTRY))


def evidence_ledger(targets: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(works, evidence, sources, missing) with deterministic ids; only what the user confirmed enters."""
    papers = confirmed_papers(targets, works)
    complete = papers.where(~text.blank("title") & ~text.blank("abstract") & ~text.blank("source_url"))
    has_paper = complete.select("target_id").distinct()
    people = targets.where("identity_confirmed").join(has_paper, "target_id", "left_semi")

    out_works = complete.select(
        "target_id", F.col("paper_id").alias("id"), "seq", "title", "year", "topics", "abstract", "source_url",
        "source_platform", "authors",
    )
    about = F.concat("name", F.lit(vocab.PROFILE_EVIDENCE))
    described = F.array_join(
        F.filter(
            F.array("name", "institution", "department", "title", F.array_join("declared_interests", "、")),
            lambda p: F.coalesce(p, F.lit("")) != "",
        ),
        "；",
    )
    homepage = F.when(~text.blank("homepage"), F.col("homepage"))
    profile = people.select(
        "target_id",
        F.concat(F.lit("ev_"), "id_prefix", F.lit("_profile")).alias("id"),
        F.lit("user_confirmed_profile").alias("source_type"),
        homepage.alias("source_url"),
        about.alias("title"),
        F.lit(None).cast("string").alias("published_date"),
        described.alias("evidence_text"),
        F.lit("CONFIRMED").alias("author_resolution_status"),
        F.when(homepage.isNotNull(), 1).otherwise(3).alias("source_tier"),
    )
    backing = complete.select(
        "target_id",
        F.concat(F.lit("ev_"), "paper_id").alias("id"),
        platform_label(F.col("source_platform")).alias("source_type"),
        "source_url",
        "title",
        F.col("year").cast("string").alias("published_date"),
        F.col("abstract").alias("evidence_text"),
        F.lit("CONFIRMED").alias("author_resolution_status"),
        F.lit(2).alias("source_tier"),
    )
    evidence = profile.unionByName(backing)
    sources = profile.select(
        "target_id",
        F.regexp_replace("id", "^ev_", "src_").alias("id"),
        "source_type",
        F.col("source_url").alias("url"),
        "title",
        F.col("evidence_text").alias("text"),
    ).unionByName(
        complete.select(
            "target_id",
            F.concat(F.lit("src_"), "paper_id").alias("id"),
            F.lit("user_confirmed_paper").alias("source_type"),
            F.col("source_url").alias("url"),
            "title",
            F.col("abstract").alias("text"),
        )
    )
    gaps = F.array_compact(F.array(*[F.when(text.blank(f), F.lit(v)) for f, v in vocab.PAPER_GAPS.items()]))
    missing = papers.select("target_id", "seq", F.explode(gaps).alias("missing"))
    return out_works, evidence, sources, missing


def source_coverage(
    targets: DataFrame,
    works: DataFrame,
    registry: Sequence[tuple] = vocab.SOURCE_REGISTRY,
    keys: Sequence[str] = (),
    language: str = "auto",
    min_support: int = 3,
    min_works: int = 3,
) -> DataFrame:
    """(target_id, source, discipline, status, n, rank): which feeds a target's search covers, and what came of it.

    A target's discipline is the stated one, else ``guessed_discipline`` if that column is given, else the
    dominant one of its works if enough of them agree.
    """
    from scholarmatch.operators.topics import dominant_discipline

    learned = dominant_discipline(
        works.select(F.col("target_id").alias("person"), F.col("seq").alias("work_id"), "disciplines"), min_support
    ).withColumnRenamed("person", "target_id")
    counts = works.groupBy("target_id", F.col("source_platform").alias("source")).agg(F.count("*").alias("n"))
    enough = works.groupBy("target_id").agg((F.count("*") >= min_works).alias("_enough"))
    stated = F.when(F.col("stated_discipline").isin(list(vocab.DISCIPLINES)), F.col("stated_discipline"))
    guessed = F.col("guessed_discipline") if "guessed_discipline" in targets.columns else F.lit(None).cast("string")
    asked = (
        targets.join(learned, "target_id", "left")
        .join(enough, "target_id", "left")
        .select(
            "target_id",
            F.coalesce(stated, guessed, F.when(F.col("_enough"), F.col("discipline")), F.lit("general")).alias("discipline"),
        )
    )

    def status(row: tuple) -> Column:
        key, disciplines, rank, lang, needs, _cost, _gap, authors, enabled = row
        covers = F.lit(True) if "*" in disciplines else F.col("discipline").isin(list(disciplines))
        verdict = F.lit("selected")
        if not enabled:
            verdict = F.lit("disabled")
        elif needs and needs not in keys:
            verdict = F.lit("no_key")
        elif language in ("zh", "en") and lang != language:
            verdict = F.lit("language")
        elif not authors:
            verdict = F.lit("title_only")
        else:
            verdict = F.when(covers, "selected").otherwise("not_covering")
        return F.struct(F.lit(key).alias("source"), verdict.alias("status"))

    ordered = sorted(registry, key=lambda r: (r[2], r[0]))
    listed = F.array(*[status(r) for r in ordered])
    chosen = F.transform(F.filter("_all", lambda x: x["status"] == "selected"), lambda x: x["source"])
    rows = (
        asked.withColumn("_all", listed)
        .withColumn("_chosen", chosen)
        .select("target_id", "discipline", "_chosen", F.explode("_all").alias("x"))
        .select("target_id", "discipline", "x.source", "x.status", F.array_position("_chosen", F.col("x.source")).alias("rank"))
    )
    outcome = F.when(F.col("status") != "selected", F.col("status")).when(F.col("n") > 0, "ok").otherwise("empty")
    return (
        rows.join(counts, ["target_id", "source"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select("target_id", "source", "discipline", outcome.alias("status"), "n", F.col("rank").cast("int").alias("rank"))
    )
