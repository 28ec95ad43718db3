"""Exact deduplication over an extendible-hash index kept on shared files.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. The 64-bit hash of the
normalised text is its key. The index is addressed by the key's leading bits: a bucket that would hold more than
``bucket_rows`` keys is split and the directory doubled, until no bucket is overfull or ``max_depth`` bits are
used; what still collides is chained by SHA-256 inside the bucket, and the bytes of each chain are compared.
Everything is DataFrame expressions; a hot group is reduced map-side before any shuffle.

Defined cases: a null text counts as empty (all empty texts are one group); a null id sorts after every other id;
of rows repeated with id and text exactly one is kept; an empty table gives an empty result; other columns of the
input are ignored by ``exact_dedup`` and carried untouched by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmatch.sources.tables import settle

#: Keys a bucket may hold before it is split.
BUCKET_ROWS = 4096
#: Leading key bits the directory may use, so that it has at most 2**16 entries.
MAX_DEPTH = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, code points of the original, normalised text, 64-bit key, SHA-256."""
    base = docs.select(
        F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"), normalised(F.col(text_col)).alias("norm")
    )
    return base.select("id", "chars", "norm", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"))


def directory(keys: DataFrame, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Directory entries (prefix of ``max_depth`` bits -> local depth and bucket) for distinct 64-bit keys.

    The counts at every depth follow from those at the deepest one, so all doublings are decided in one pass: an
    entry's local depth is one more than the deepest overfull prefix it lies under. At most 2**max_depth rows.
    """
    leaves = keys.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("prefix")).agg(F.count("*").alias("n"))
    levels = leaves.select("prefix", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")).withColumn(
        "head", F.expr(f"shiftright(prefix, {max_depth} - depth)")
    )
    full = levels.groupBy("depth", "head").agg(F.sum("n").alias("held")).where(F.col("held") > bucket_rows)
    under = levels.join(full, ["depth", "head"]).groupBy("prefix").agg(F.max("depth").alias("last_full"))
    depth = F.least(F.coalesce(F.col("last_full") + 1, F.lit(0)), F.lit(max_depth))
    return leaves.join(under, "prefix", "left").select("prefix", depth.alias("depth")).withColumn(
        "bucket", F.expr(f"lpad(conv(shiftright(prefix, {max_depth} - depth), 10, 2), depth, '0')")
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH):
    """Writes the index to the shared folder: one entry per distinct text, files by ranges of (bucket, key).

    Columns: bucket, key, sha, keep_id, keep_chars, twins (rows that tie for being kept), group_size.
    """
    rows = settle(keyed(docs, id_col, text_col).drop("norm"), "dedup-rows")
    table = directory(rows.select("key").distinct(), bucket_rows, max_depth)

    # Bytes are compared inside a chain: one SHA-256 may stand for one normalised text only.
    texts = keyed(docs, id_col, text_col).groupBy("key", "sha", "norm").agg(F.count("*").alias("n"))
    chains = texts.groupBy("key", "sha").agg(F.count("*").alias("variants"), F.sum("n").alias("group_size"))
    checked = chains.select(
        "key", "sha",
        F.when(F.col("variants") > 1, F.raise_error(F.lit("two texts share one SHA-256")).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
    )
    order = F.struct("chars", F.when(F.col("id").isNull(), 0).otherwise(1).alias("known"), (-F.col("id")).alias("back"))
    same = rows.groupBy("key", "sha", "id", "chars").agg(F.count("*").alias("twins"))
    best = same.groupBy("key", "sha").agg(F.max(F.struct(order.alias("o"), F.col("id").alias("id"), F.col("twins").alias("twins"))).alias("b"))
    entries = best.join(checked, ["key", "sha"]).select(
        "key", "sha", F.col("b.id").alias("keep_id"), F.col("b.o.chars").alias("keep_chars"), F.col("b.twins").alias("twins"), "group_size"
    )
    placed = (
        entries.withColumn("prefix", F.shiftrightunsigned("key", 64 - max_depth))
        .join(F.broadcast(table), "prefix")  # at most 2**max_depth rows
        .select("bucket", "key", "sha", "keep_id", "keep_chars", "twins", "group_size")
    )
    index = settle(placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "sha"), "dedup-index")
    return rows, index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket: one row per input row.

    Of equal texts the row with the most code points in the original, then the smallest id, stays. Rows repeated
    with that id and text tie: the first of them by row number is kept.
    """
    rows, index = build_index(docs, id_col, text_col, bucket_rows, max_depth)
    found = rows.join(index, ["key", "sha"])
    wins = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    shaped = lambda df, kept: df.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "bucket"
    )
    # Rows repeated with the winner's id and text are equal in every column here: of each such set, one is kept.
    tied = found.where(wins & (F.col("twins") > 1)).groupBy("id", "keep_id", "group_size", "sha", "bucket").agg(F.count("*").alias("n"))
    copies = tied.select("*", F.explode(F.expr("sequence(1, n)")).alias("copy"))
    plain = found.where(~(wins & (F.col("twins") > 1)))
    return shaped(plain, wins).unionByName(shaped(copies, F.col("copy") == 1))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    _, index = build_index(docs, id_col, text_col, **settings)
    entry = index.select(
        F.col("key").alias("_key"), F.col("sha").alias("_sha"), F.col("keep_id").alias("_keep"), F.col("keep_chars").alias("_chars"), F.col("twins").alias("_twins")
    )
    norm, chars = normalised(F.col(text_col)), F.length(F.coalesce(F.col(text_col), F.lit("")))
    # The input row travels as one struct, so none of its names can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), chars.alias("chars"), F.xxhash64(norm).alias("_key"), F.sha2(norm, 256).alias("_sha"))
    stay = rows.join(entry, ["_key", "_sha"]).where(F.col("id").eqNullSafe(F.col("_keep")) & (F.col("chars") == F.col("_chars")))
    kept = stay.where(F.col("_twins") == 1)
    if not index.where("twins > 1").isEmpty():
        kept = kept.unionByName(stay.where(F.col("_twins") > 1).dropDuplicates(["_key", "_sha"]))
    return kept.select("row.*")
