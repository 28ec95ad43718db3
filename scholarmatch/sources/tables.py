"""Stored tables with declared schemas."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from scholarmatch.session import checkpoint_dir

_LISTS = "research_directions array<string>, research_areas array<string>, publications array<string>"
SCHEMAS = {
    "catalog": (
        f"department string, name string, title string, email string, {_LISTS}, homepage_url string, profile_text string, "
        "orcid string, openalex_id string, school_cate string, note string, sources array<string>, source_url string, "
        "retrieved_at string, content_hash string, field_sources map<string,string>, university string"
    ),
    "reviews": "department string, supervisor string, rate double, summary string, detail string, university string",
    "roster": (
        "department string, supervisor string, note string, school_cate string, in_community boolean, in_official boolean, "
        "source_url string, retrieved_at string, university string"
    ),
    "faculty": (
        f"id string, name string, college string, title string, homepage_url string, email string, {_LISTS}, "
        "profile_text string, source_url string, retrieved_at string, university string"
    ),
    "pages": (
        "url string, text string, content_hash string, etag string, robots_allowed boolean, fetched_at timestamp, "
        "expires_at timestamp, hits bigint"
    ),
    "works": (
        "seq bigint, id string, title string, year int, doi string, venue string, topics array<string>, citation_count bigint, "
        "abstract string, source_url string, source_platform string, authors array<string>, institution string, "
        "sources array<string>, disciplines array<string>, target_id string"
    ),
    "runs": "run_id string, status string, name string, created_at timestamp, updated_at timestamp",
    "artifacts": "id string, run_id string, kind string, payload string, created_at timestamp, seq bigint",
}
PARTITIONS = {"catalog": ["university"], "reviews": ["university"], "roster": ["university"], "faculty": ["university"], "artifacts": ["kind"]}


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """The declared columns and types; tables of people in ranges of (school, name), each of about the same size.

    A school with very many people fills several ranges and so several files of about one size, small schools share a
    task, and the names of a file are next to each other, so a lookup by name skips the files of all other names.
    """
    shaped = _cast(df, table)
    parts = PARTITIONS.get(table)
    if not parts:
        return shaped
    by = [*parts, next((c for c in ("name", "supervisor", "id") if c in shaped.columns), parts[0])]
    return shaped.repartitionByRange(*by).sortWithinPartitions(*by)


def write_table(df: DataFrame, path: str, table: str, mode: str = "overwrite") -> None:
    """Parquet in the declared column order and types, in folders of schools and files of name ranges."""
    parts = PARTITIONS.get(table)
    writer = _shaped(df, table).write.mode(mode)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def _marks(df: DataFrame, part: str, out: str) -> DataFrame:
    """(part, out): how many rows a partition has, and a sum over their contents; reduced before the shuffle."""
    fields = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema.fields]
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])  # a null is skipped by the hash
    halves = [F.sum(F.xxhash64(F.lit(seed), nulls, *fields).cast("decimal(38,0)")) for seed in (1, 2)]
    return df.groupBy(part).agg(F.struct(F.count("*").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(halves)]).alias(out))


def edit_table(spark: SparkSession, path: str, table: str, change: Callable[[DataFrame], DataFrame]) -> list:
    """Applies ``change`` to a stored table; returns the partitions it touched. All other partitions keep their files.

    ``change`` goes from rows to rows and looks at one partition (school, kind) at a time, as deletes, cleared sources
    and cleaned names do. One scan finds the partitions whose rows differ afterwards; only they are read again and
    replaced (dynamic partition overwrite), and those without rows left are removed.
    """
    (part,) = PARTITIONS[table]
    stored = read_table(spark, path, table)
    before = _marks(_cast(stored, table), part, "_before")  # in the declared column order, as what is compared with it
    after = _marks(_cast(change(stored), table), part, "_after").withColumnRenamed(part, "_part")
    both = before.join(after, F.col(part).eqNullSafe(F.col("_part")), "full_outer")
    differing = both.where(~F.col("_before").eqNullSafe(F.col("_after")))
    touched = [r["p"] for r in differing.select(F.coalesce(part, "_part").alias("p")).collect()]
    if not touched:
        return []
    known = [p for p in touched if p is not None]
    mine = F.col(part).isin(known) | F.col(part).isNull() if None in touched else F.col(part).isin(known)
    old = stored.where(mine)
    folders = {r["p"]: r["f"] for r in old.groupBy(F.col(part).alias("p")).agg(F.min(F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).alias("f")).collect()}
    new = settle(_cast(change(old), table), "edited")
    left = {r["p"] for r in new.select(F.col(part).alias("p")).distinct().collect()}
    if left:
        _shaped(new, table).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    for gone in set(touched) - left:
        if gone in folders:
            drop_folder(spark, folders[gone])
    return sorted(touched, key=lambda p: (p is not None, p or ""))


def _cast(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SCHEMAS[table]).fields])


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint location all executors share; it goes when the process ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark, path))
    return path


#: Scratch folders of this process, removed when it ends.
_SCRATCH: list[tuple[SparkSession, str]] = []


#: Whether Spark deletes the shuffle files of an execution when that ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back, for results several steps go on from.

    The folder goes when the process ends (``forget_scratch`` removes all of them earlier). What was shuffled to make
    the rows goes at once: nothing reads it again, and it would stay until the driver happens to collect its garbage.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    held = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, held)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store that ``path`` names, with all that is in it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def forget_scratch() -> None:
    """Delete every scratch folder, as long as its session still runs."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            continue
        drop_folder(spark, path)


atexit.register(forget_scratch)
