"""A stored index of the catalog's texts, and exact top-k search that scores only who can still reach the list.

Two tables under one folder, both in folders ``part`` (of the advisor):

* ``texts``: an advisor a row, with the searched texts folded, what ties are broken by, and a hash of the content;
* ``grams``: (gram, doc, mask): which advisors hold a stretch of one to three characters, and in which of the
  weighted fields, in further folders ``shard`` (of the gram), each file sorted by gram.

Search reads the shards of its grams only. The fields in which an advisor holds all grams of a term bound what the
term can score there; the ``k`` advisors with the best bounds of a query are scored first, and from then on only those
whose bound, with the known ties, is not behind the ``k``-th score. Bounds are never too low, so nothing is missed.

An update compares content hashes, and rewrites the parts that hold a changed, new or gone advisor; the others keep
their files. Grams are written before texts, so an update that broke off is simply repeated.

A term that is null or empty is held by nobody. Advisors with equal keys are separate rows; an empty catalog or query
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarmatch.functions import vocab
from scholarmatch.functions.scale import dealt
from scholarmatch.operators.discover import KEY, completeness, score_terms, searched_values
from scholarmatch.sources.tables import drop_folder, settle

#: Folders that advisors and grams are dealt to; a part is what an update rewrites at least. A large catalog takes more.
PARTS, SHARDS = 4, 16
#: Characters of the longest gram.
BLOCK = 3
_FIELDS = tuple(vocab.FIELD_WEIGHTS)


def _texts(catalog: DataFrame, parts: int) -> DataFrame:
    values = {f"_v_{f}": searched_values(f) for f in _FIELDS}
    shaped = catalog.select(*KEY, completeness(catalog).alias("completeness"), *[v.alias(n) for n, v in values.items()])
    content = F.md5(F.to_json(F.struct(*KEY, "completeness", *values)))
    doc = F.xxhash64(*KEY)
    return shaped.select("*", content.alias("content"), doc.alias("doc"), F.pmod(doc, F.lit(parts)).cast("int").alias("part"))


def _stretches(value: Column) -> Column:
    spots = F.sequence(F.lit(1), F.length(value))
    every = F.flatten(F.transform(spots, lambda i: F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), lambda n: F.substring(value, i, n))))
    return F.when(F.length(value) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _grams(texts: DataFrame, shards: int) -> DataFrame:
    """(part, shard, gram, doc, mask): each gram of an advisor once, with the fields that hold it."""
    def of_field(field: str, bit: int) -> Column:
        grams = F.array_distinct(F.flatten(F.transform(f"_v_{field}", _stretches)))
        return F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(bit).alias("bit")))

    per_field = [of_field(f, 1 << i) for i, f in enumerate(_FIELDS)]
    # Dealt out by advisor while narrow: a file of texts is scanned by few tasks. An advisor's grams then meet in its task.
    # An inner explode is filtered by its array first, which Spark does at the scan, so that the grams were made twice.
    opened = dealt(texts, "part", "doc").select("part", "doc", F.explode_outer(F.flatten(F.array(*per_field))).alias("g")).where("g IS NOT NULL")
    merged = opened.groupBy("part", "doc", F.col("g.gram").alias("gram")).agg(F.bit_or("g.bit").alias("mask"))
    return merged.withColumn("shard", shard_of(F.col("gram"), shards))


def shard_of(gram: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(shards)).cast("int")


def _write(texts: DataFrame, path: str, shards: int) -> None:
    """Replaces the parts that ``texts`` has, and no others."""
    def put(df: DataFrame, name: str, folders: Sequence[str], order: Sequence[str]) -> None:
        # A large folder is sorted and written by several tasks of about the size AQE aims at, a file each.
        sized = df.hint("rebalance", *folders).sortWithinPartitions(*folders, *order)
        sized.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(f"{path}/{name}")

    put(_grams(texts, shards), "grams", ["part", "shard"], ["gram", "doc"])
    put(texts, "texts", ["part"], ["doc"])


def build_index(catalog: DataFrame, path: str, parts: int = PARTS, shards: int = SHARDS) -> None:
    """Writes the index of a catalog to an empty folder."""
    _write(settle(_texts(catalog, parts), "index-texts"), path, shards)


def update_index(catalog: DataFrame, path: str, parts: int = PARTS, shards: int = SHARDS) -> list[int]:
    """Brings the index to the state of ``catalog``; returns the parts that were written or emptied."""
    spark = catalog.sparkSession
    now = settle(_texts(catalog, parts), "index-texts")

    def known(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("part", "doc").agg(F.array_sort(F.collect_list("content")).alias(name))

    both = known(now, "new").join(known(_stored(spark, path, "texts"), "old"), ["part", "doc"], "full_outer")
    touched = both.where(~F.col("new").eqNullSafe(F.col("old"))).groupBy("part").agg(F.count("*").alias("n"))  # at most ``parts`` rows
    found = sorted(r["part"] for r in touched.collect())
    if not found:
        return []
    rows = now.where(F.col("part").isin(found))
    left = {r["part"] for r in rows.select("part").distinct().collect()}
    if left:
        _write(rows, path, shards)
    for part in set(found) - left:
        for name in ("grams", "texts"):
            drop_folder(spark, f"{path}/{name}/part={part}")
    return found


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    fields = ", ".join(f"_v_{f} array<string>" for f in _FIELDS)
    keys = ", ".join(f"{k} string" for k in KEY)
    shapes = {
        "texts": f"{keys}, completeness double, {fields}, content string, doc long, part int",
        "grams": "gram string, doc long, mask int, part int, shard int",
    }
    return spark.read.schema(shapes[name]).parquet(f"{path}/{name}")


def _needles(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("terms.needle").alias("needle")).where("needle <> ''").distinct()


def _asked(queries: DataFrame, shards: int) -> DataFrame:
    """(needle, gram, shard, need): the longest grams that every text with the needle holds."""
    size = F.least(F.length("needle"), F.lit(BLOCK))
    spots = F.sequence(F.lit(1), F.length("needle") - size + 1)
    grams = F.array_distinct(F.transform(spots, lambda i: F.substring(F.col("needle"), i, size)))
    wanted = _needles(queries).select("needle").distinct().withColumn("g", grams)
    opened = wanted.select("needle", F.size("g").alias("need"), F.explode("g").alias("gram"))
    return opened.withColumn("shard", shard_of(F.col("gram"), shards))


def _weight(mask: Column) -> Column:
    parts = [F.when(F.getbit(mask.cast("int"), F.lit(i)) == 1, w).otherwise(0) for i, w in enumerate(vocab.FIELD_WEIGHTS.values())]
    return sum(parts[1:], start=parts[0])


def bounds(spark: SparkSession, path: str, queries: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(query_id, doc, part, bound): advisors that may hold a term, and what they score at most."""
    asked = _asked(queries, shards)
    read = [r["shard"] for r in asked.select("shard").distinct().collect()]  # at most ``shards`` rows
    grams = _stored(spark, path, "grams").where(F.col("shard").isin(read))
    met = grams.join(asked.drop("shard"), "gram").groupBy("needle", "doc", "part").agg(
        F.bit_and("mask").alias("mask"), F.count("*").alias("n"), F.first("need").alias("need")
    )
    held = met.where((F.col("n") == F.col("need")) & (F.col("mask") != 0)).select("needle", "doc", "part", _weight(F.col("mask")).alias("w"))
    return held.join(_needles(queries), "needle").groupBy("query_id", "doc", "part").agg(F.sum("w").alias("bound"))


_ORDER = ("completeness", "university", "name", "department")


def _place(score: str) -> list[Column]:
    return [F.desc(score), F.desc("completeness"), F.col("university"), F.col("name"), F.col("department")]


def _not_behind(score: str) -> Column:
    """Whether (score, ties) of a row could stand at the place of the row ``_last`` or before it."""
    worse, even = F.lit(False), F.lit(True)
    for column, down in ((score, True), ("completeness", True), ("university", False), ("name", False), ("department", False)):
        mine, last = F.col(column), F.col(f"_last.{'score' if column == score else column}")
        worse = worse | (even & ((mine < last) if down else (mine > last)))
        even = even & mine.eqNullSafe(last)
    return ~F.coalesce(worse, F.lit(False))


def _scored(spark: SparkSession, path: str, pairs: DataFrame, queries: DataFrame) -> DataFrame:
    texts = _stored(spark, path, "texts").select("doc", "part", *_ORDER, "content", *[f"_v_{f}" for f in _FIELDS])
    asked = pairs.select("query_id", "doc", "part", "content").join(queries, "query_id")
    return texts.join(asked, ["part", "doc", "content"]).select("query_id", "doc", "content", *_ORDER, score_terms().alias("match_score"))


def ranked_pairs(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 20, min_score: int = 2, universities: Sequence[str] | None = None, shards: int = SHARDS
) -> DataFrame:
    """(query_id, doc, content, ties, match_score) of the pairs that were scored at all; the best ``k`` are among them."""
    static = _stored(spark, path, "texts").select("doc", "part", "content", *_ORDER)
    if universities:
        static = static.where(F.col("university").isin(list(universities)))
    possible = bounds(spark, path, queries, shards).where(F.col("bound") >= min_score).join(static, ["part", "doc"])
    possible = settle(possible.distinct(), "index-bounds")
    best = Window.partitionBy("query_id")
    first = possible.withColumn("_r", F.row_number().over(best.orderBy(*_place("bound"), "doc", "content"))).where(F.col("_r") <= k).drop("_r")
    first = settle(_scored(spark, path, first, queries), "index-first")
    good = first.where(F.col("match_score") >= min_score).withColumn("_r", F.row_number().over(best.orderBy(*_place("match_score"), "doc", "content")))
    last = good.where(F.col("_r") == k).select("query_id", F.struct(F.col("match_score").alias("score"), *_ORDER).alias("_last"))
    rest = possible.join(first.select("query_id", "doc", "content"), ["query_id", "doc", "content"], "left_anti")
    rest = rest.join(last, "query_id", "left").where(F.col("_last").isNull() | _not_behind("bound"))
    return first.unionByName(_scored(spark, path, rest, queries))


def rank_indexed(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 20, min_score: int = 2, universities: Sequence[str] | None = None, shards: int = SHARDS
) -> DataFrame:
    """Top ``k`` advisors per query, the rows of ``discover.rank_candidates``, from the stored index."""
    scored = ranked_pairs(spark, path, queries, k, min_score, universities, shards).where(F.col("match_score") >= min_score)
    best = Window.partitionBy("query_id").orderBy(*_place("match_score"), "content")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", *KEY, "match_score", "completeness")


def filter_indexed(spark: SparkSession, path: str, queries: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(query_id, key): advisors with any term in any field, the rows of ``discover.term_filter``, from the index."""
    static = _stored(spark, path, "texts").select("doc", "part", "content")
    possible = bounds(spark, path, queries, shards).join(static, ["part", "doc"]).distinct()
    return _scored(spark, path, possible, queries).where("match_score > 0").select("query_id", *KEY)
