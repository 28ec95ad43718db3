"""The stateful pieces as Structured Streaming jobs.

Every job takes a streaming DataFrame and the folder its output and checkpoint live in, runs what is
available and stops; with ``once=False`` it keeps running and returns the query.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmatch.operators import catalog as catalog_ops
from scholarmatch.operators import runs as run_ops


def _start(writer, folder: str, once: bool):
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.trigger(availableNow=True).start() if once else writer.start()
    if once:
        query.awaitTermination()
    return query


def page_changes(fetches: DataFrame, folder: str, late: str = "1 hour", once: bool = True):
    """Fetches whose (url, content_hash) was not seen within ``late``; later rows are ignored.

    ``fetches``: url, content_hash, fetched_at.
    """
    fresh = fetches.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url", "content_hash"])
    return _start(fresh.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/data"), folder, once)


def trace_windows(steps: DataFrame, folder: str, kind: str = "tumbling", late: str = "1 hour", once: bool = True):
    """Step counts per kind in tumbling or sliding one-hour windows, or per run in 30-minute sessions."""
    timed = steps.withWatermark("ts", late)
    if kind == "session":
        grouped = timed.groupBy(F.session_window("ts", "30 minutes").alias("w"), "run_id")
        keys = ["run_id"]
    else:
        span = F.window("ts", "1 hour", "30 minutes") if kind == "sliding" else F.window("ts", "1 hour")
        grouped = timed.groupBy(span.alias("w"), "kind")
        keys = ["kind"]
    counted = grouped.agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "duration_ms"
    )
    return _start(counted.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/data"), folder, once)


# --- catalog -----------------------------------------------------------------------------------
def _versions(spark: SparkSession, folder: str, schema, before: int | None = None) -> DataFrame | None:
    """The newest stored row of every key, from the batches written before ``before``."""
    store = f"{folder}/versions"
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(schema).option("basePath", store).parquet(store)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    body = [f.name for f in schema.fields if f.name != "version"]
    newest = rows.groupBy(*catalog_ops.KEY).agg(F.max_by(F.struct(*body), "version").alias("r"))
    return newest.select("r.*")


def catalog_upsert(arrivals: DataFrame, folder: str, once: bool = True):
    """Crawler arrivals merged into the stored catalog, batch by batch.

    A batch rewrites only the keys it touches, as its own version folder; running a batch again
    replaces that folder, so a retry changes nothing.
    """
    spark = arrivals.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(*catalog_ops.KEY).distinct()
        shape = catalog_ops.catalog_upsert(None, batch)
        schema = shape.schema.add("version", "long")
        stored = _versions(spark, folder, schema, batch_id)
        known = stored.join(touched, catalog_ops.KEY, "left_semi") if stored is not None else None
        merged = catalog_ops.catalog_upsert(known, batch)
        merged.write.mode("overwrite").parquet(f"{folder}/versions/version={batch_id}")

    return _start(arrivals.writeStream.foreachBatch(merge), folder, once)


def read_catalog(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The current catalog of a ``catalog_upsert`` folder; ``schema`` is that of the catalog rows."""
    from pyspark.sql.types import StructType

    return _versions(spark, folder, StructType(list(schema.fields)).add("version", "long"))


# --- budget ------------------------------------------------------------------------------------
_COUNTERS = "run_id string, steps bigint, llm_calls bigint, tokens bigint, external_calls bigint, started timestamp_ntz"
_SOURCES = "run_id string, source string, calls bigint"
_BREACHES = "run_id string, reason string, at_idx bigint"


def budget_gate(steps: DataFrame, folder: str, limits: Mapping[str, float] = run_ops.LIMITS, once: bool = True):
    """First breach of every run, as its steps arrive.

    The running counters of each run are a small table carried from batch to batch (one folder per
    batch), added up with map-side reduction, so a run with very many steps needs no single task.
    """
    spark = steps.sparkSession

    def stored(name: str, schema: str, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{folder}/{name}/{batch_id - 1}")

    def advance(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("run_id", F.col("run_id").cast("string"))
        counters, sources = stored("counters", _COUNTERS, batch_id), stored("sources", _SOURCES, batch_id)
        done = stored("breaches", _BREACHES, batch_id)
        live = rows.join(done.select("run_id"), "run_id", "left_anti")
        hit = run_ops.budget_breach(live, limits, counters, sources)
        done.unionByName(hit.select("run_id", "reason", F.col("at_idx").cast("long").alias("at_idx"))).write.mode("overwrite").parquet(
            f"{folder}/breaches/{batch_id}"
        )
        decides = F.col("kind") == "llm_decision"
        calls = (F.col("kind") == "tool_call") & (F.col("source") != "")
        own = rows.groupBy("run_id").agg(
            F.count_if(decides).alias("steps"),
            F.count_if(decides).alias("llm_calls"),
            F.sum(F.when(decides, F.col("tokens_in") + F.col("tokens_out")).otherwise(0)).alias("tokens"),
            F.count_if(calls).alias("external_calls"),
            F.min("ts").alias("started"),
        )
        summed = counters.unionByName(own).groupBy("run_id").agg(
            *[F.sum(c).alias(c) for c in ("steps", "llm_calls", "tokens", "external_calls")], F.min("started").alias("started")
        )
        summed.write.mode("overwrite").parquet(f"{folder}/counters/{batch_id}")
        mine = rows.where(calls).groupBy("run_id", "source").agg(F.count("*").alias("calls"))
        sources.unionByName(mine).groupBy("run_id", "source").agg(F.sum("calls").alias("calls")).write.mode("overwrite").parquet(
            f"{folder}/sources/{batch_id}"
        )
        with_id = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch"))
        with_id.write.mode("overwrite").parquet(f"{folder}/last")

    return _start(steps.writeStream.foreachBatch(advance), folder, once)


def read_breaches(spark: SparkSession, folder: str) -> DataFrame:
    last = spark.read.schema("batch long").parquet(f"{folder}/last").first()["batch"]  # one row
    return spark.read.schema(_BREACHES).parquet(f"{folder}/breaches/{last}")
