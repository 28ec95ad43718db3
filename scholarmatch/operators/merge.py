"""One row per real paper.

The merge rule is sequential: records arrive by ``seq``; a record joins the paper that already has
its DOI, else the earliest paper of the same title key whose year lies within one of its own (an
unknown year fits any), else it starts a new paper. Papers keep the year they first learn.

It does not need a sequential pass over the records, because two facts hold:

* every record of a DOI follows that DOI's first record, so only first records decide;
* deciding records with equal (title key, year) always land in the same paper, since a paper's year
  never changes once known and an unknown-year paper is always the first of its title.

So what is folded in order is one short list per title: its distinct years. Everything else is
grouping with map-side reduction, which also keeps a title or DOI shared by very many records cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmatch.functions import text
from scholarmatch.functions.scale import keep_first
from scholarmatch.sources.tables import settle

_LISTS = ("topics", "disciplines")


def work_keys(works: DataFrame) -> DataFrame:
    """Works with a title, plus doi_key and title_key."""
    return works.where(~text.blank("title")).withColumns(
        {"doi_key": text.doi_key("doi"), "title_key": text.title_key("title")}
    )


def _class_key() -> Column:
    return (
        F.when(F.col("doi_key") != "", F.concat(F.lit("d:"), "doi_key"))
        .when(
            F.col("title_key") != "",
            F.concat(F.lit("t:"), "title_key", F.lit("\x01"), F.coalesce(F.col("year").cast("string"), F.lit("?"))),
        )
        .otherwise(F.concat(F.lit("s:"), F.col("seq").cast("string")))
    )


def _first_two(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, leader, second): the two lowest seq per key; tasks forward two rows of a key at most."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    top = records.select(*keys, "seq").withColumn("n", rank).where("n <= 2")
    return top.groupBy(*keys).agg(
        F.min("seq").alias("leader"), F.max(F.when(F.col("n") == 2, F.col("seq"))).alias("second")
    )


def paper_groups(keyed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class_key, leader, second): which paper each class of equal-fated records belongs to.

    ``leader`` is the seq of the record that started the paper, ``second`` of the next one to join.
    """
    by = list(by)
    narrow = keyed.select(*by, "seq", "doi_key", "title_key", "year").withColumn("class_key", _class_key())
    classes = narrow.groupBy(*by, "class_key").agg(
        F.min("seq").alias("first_seq"),
        F.min(F.struct("seq", "title_key", "year")).alias("first"),
        F.min(F.when(F.col("year").isNotNull(), F.struct("seq", "year"))).alias("dated"),
    )
    two = _first_two(narrow, [*by, "class_key"]).select(*by, "class_key", F.col("second").alias("second_seq"))
    classes = classes.join(two, [*by, "class_key"]).select(
        *by,
        "class_key",
        "first_seq",
        "second_seq",
        "dated",
        F.col("first.title_key").alias("t"),
        F.coalesce(F.col("first.year").cast("string"), F.lit("?")).alias("y"),
    )
    classes = settle(classes, "paper-classes")  # one narrow row per class; read for the titles and for the placing

    years = (
        classes.where("t <> ''")
        .groupBy(*by, "t", "y")
        .agg(F.min("first_seq").alias("s"), F.min("dated").alias("dated"))
    )
    titles = years.groupBy(*by, "t").agg(
        F.array_sort(F.collect_list(F.struct("s", F.col("y").try_cast("int").alias("year"), "y"))).alias("list"),
        F.min("dated")["year"].alias("learned"),
    )

    def fits(g: Column, x: Column) -> Column:
        return g["year"].isNull() | x["year"].isNull() | (F.abs(g["year"] - x["year"]) <= 1)

    def step(acc: Column, x: Column) -> Column:
        first = F.size(acc) == 0
        fresh = F.struct(
            x["s"].alias("leader"),
            F.when(first, F.coalesce(x["year"], F.col("learned"))).otherwise(x["year"]).alias("year"),
        )
        return F.when(F.exists(acc, lambda g: fits(g, x)), acc).otherwise(F.concat(acc, F.array(fresh)))

    papers = F.aggregate("list", F.array().cast("array<struct<leader:bigint,year:int>>"), step)
    homes = (
        titles.withColumn("papers", papers)
        .select(*by, "t", "papers", F.explode("list").alias("x"))
        .select(
            *by,
            "t",
            F.col("x.y").alias("y"),
            F.element_at(F.filter("papers", lambda g: fits(g, F.col("x"))), 1)["leader"].alias("home"),
        )
    )
    placed = classes.join(homes, [*by, "t", "y"], "left").select(
        *by, "class_key", "first_seq", "second_seq", F.coalesce("home", "first_seq").alias("leader")
    )
    next_in = F.when(F.col("first_seq") == F.col("leader"), F.col("second_seq")).otherwise(F.col("first_seq"))
    seconds = placed.groupBy(*by, "leader").agg(F.min(next_in).alias("second"))
    return placed.join(seconds, [*by, "leader"]).select(*by, "class_key", "first_seq", "leader", "second")


def merge_links(works: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(seq, via, leader): the paper every later record was merged into and what decided it.

    One link per record, never all pairs of a group.
    """
    by = list(by)
    keyed = work_keys(works).withColumn("class_key", _class_key())
    groups = paper_groups(keyed, by)
    linked = keyed.select(*by, "seq", "class_key").join(groups, [*by, "class_key"]).where(F.col("seq") != F.col("leader"))
    via = F.when(F.col("class_key").startswith("d:") & (F.col("seq") != F.col("first_seq")), "doi").otherwise("title")
    return linked.select(*by, "seq", via.alias("via"), "leader")


def _token_order(slot: int, pos) -> Column:
    return F.struct(F.col("seq").cast("long").alias("a"), F.lit(slot).alias("b"), pos.alias("c"))


def fold_records(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge the records of each key: longest texts, most citations, first known values, united lists.

    ``records`` carry ``leader`` and ``second``: the seq of the paper's first and second record.
    """
    keys = list(keys)

    def longest(c: str, size: Column, name: str) -> Column:
        best = F.max(F.struct(size.alias("n"), (-F.col("seq")).alias("s"), F.col(c).alias("v")))
        return best["v"].alias(name)

    def first_known(c: str) -> Column:
        known = F.col(c).isNotNull() if c == "year" else F.coalesce(F.col(c), F.lit("")) != ""
        return F.min(F.when(known, F.struct("seq", c)))[c].alias(c)

    nothing = F.array().cast("array<string>")
    scalars = records.groupBy(*keys).agg(
        F.min(F.struct("seq", "id", "source_platform", "sources")).alias("_base"),
        longest("title", F.length("title"), "title"),
        longest("abstract", F.coalesce(F.length("abstract"), F.lit(0)), "abstract"),
        longest("authors", F.coalesce(F.size("authors"), F.lit(0)), "authors"),
        F.max("citation_count").alias("citation_count"),
        *[first_known(c) for c in ("year", "doi", "venue", "source_url", "institution")],
        F.count("*").alias("n_records"),
        F.max("second").alias("_second"),
    )

    def listed(c: str) -> Column:
        return F.transform(
            F.coalesce(c, nothing),
            lambda v, i: F.struct(F.lit(c).alias("kind"), v.alias("v"), _token_order(0, i).alias("o")),
        )

    lists = [listed(c) for c in (*_LISTS, "sources")]
    platform = F.when(
        F.coalesce("source_platform", F.lit("")) != "",
        F.array(F.struct(F.lit("platform").alias("kind"), F.col("source_platform").alias("v"), _token_order(2, F.lit(0)).alias("o"))),
    ).otherwise(F.array().cast("array<struct<kind:string,v:string,o:struct<a:bigint,b:int,c:int>>>"))
    tokens = records.select(
        *keys,
        F.col("leader").alias("_lead"),
        "second",
        F.explode(F.concat(*lists, platform)).alias("x"),
    ).select(*keys, "_lead", "second", "x.*")
    once = tokens.groupBy(*keys, "kind", "v").agg(
        F.min("o").alias("o"), F.max("second").alias("second"), F.max("_lead").alias("_lead")
    )
    shifted = F.when(
        (F.col("kind") == "platform") & (F.col("o.a") == F.col("_lead")) & F.col("second").isNotNull(),
        F.struct(F.col("second").cast("long").alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c")),
    ).otherwise(F.col("o"))
    placed = once.withColumn("o", shifted)
    united = (
        placed.withColumn("list", F.when(F.col("kind") == "platform", F.lit("sources")).otherwise(F.col("kind")))
        .groupBy(*keys, "list", "v")
        .agg(F.min("o").alias("o"))
        .groupBy(*keys)
        .agg(
            *[
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("o", "v")))), lambda x: x["v"]
                ).alias(c)
                for c in (*_LISTS, "sources")
            ]
        )
    )
    lone = F.coalesce("_base.sources", nothing)
    return scalars.join(united, keys, "left").select(
        *keys,
        F.col("_base.seq").alias("seq"),
        F.col("_base.id").alias("id"),
        "title",
        "year",
        "doi",
        "venue",
        F.coalesce("topics", nothing).alias("topics"),
        "citation_count",
        "abstract",
        "source_url",
        F.col("_base.source_platform").alias("source_platform"),
        "authors",
        "institution",
        F.when((F.col("n_records") == 1) & (F.size(lone) > 0), lone)
        .otherwise(F.coalesce("sources", nothing))
        .alias("sources"),
        F.coalesce("disciplines", nothing).alias("disciplines"),
        "n_records",
    )


def merge_works(works: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per real paper, its fields united over all records; per ``by`` group if given."""
    by = list(by)
    keyed = work_keys(works).withColumn("class_key", _class_key())
    groups = paper_groups(keyed, by).select(*by, "class_key", "leader", "second")
    joined = keyed.join(groups, [*by, "class_key"])
    return fold_records(joined.withColumn("_paper", F.col("leader")), [*by, "_paper"]).drop("_paper")


def works_by_doi(works: DataFrame) -> DataFrame:
    """Plain DOI deduplication with the same field rules."""
    keyed = work_keys(works).where("doi_key <> ''")
    return fold_records(keyed.join(_first_two(keyed, ["doi_key"]), "doi_key"), ["doi_key"])


def dedupe_titles(candidates: DataFrame, by: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """The first row of every exact title; rows without a title drop out."""
    return keep_first(candidates.where(F.coalesce("title", F.lit("")) != ""), [*by, "title"], order)


def title_fallback(
    candidates: DataFrame, seeds: DataFrame, primary: DataFrame, secondary: DataFrame, enough: int = 3, max_seeds: int | None = None
) -> DataFrame:
    """Targets with too few papers also get works found by the titles of their known papers.

    The secondary index is asked only for titles the primary one does not know.
    ``seeds``: target_id, pos, title. Result: candidates and finds, first row per title.
    """
    hits = candidates.groupBy("target_id").agg(F.count("*").alias("n"))
    asked = seeds.join(hits.where(F.col("n") >= enough), "target_id", "left_anti")
    first = Window.partitionBy("target_id").orderBy("pos")
    asked = (
        asked.withColumn("rank", F.row_number().over(first))
        .where(F.lit(True) if max_seeds is None else F.col("rank") <= max_seeds)
        .select("target_id", "rank", text.title_key("title").alias("title_key"))
        .where("title_key <> ''")
    )
    cols = [c for c in candidates.columns if c != "target_id"]

    def find(index: DataFrame, wanted: DataFrame, via: str, slot: int) -> DataFrame:
        # only the first work of a title can stay, so a title many works share joins as one row
        keyed = keep_first(index.withColumn("title_key", text.title_key("title")), ["title_key", "title"], "seq")
        return keyed.join(wanted, "title_key").select(
            "target_id", *cols, F.lit(via).alias("via"), F.struct(F.lit(slot).alias("a"), F.col("rank").cast("long").alias("b"), "seq").alias("_o"),
        )

    known = primary.select(text.title_key("title").alias("title_key")).distinct()
    own = candidates.select(
        "target_id", *cols, F.lit("author").alias("via"),
        F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), "seq").alias("_o"),
    )
    found = find(primary, asked, "title", 1)
    backup = find(secondary, asked.join(known, "title_key", "left_anti"), "title_secondary", 1)
    return dedupe_titles(own.unionByName(found).unionByName(backup), ["target_id"], "_o").drop("_o")
