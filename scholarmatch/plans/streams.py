"""The streaming jobs over the whole pages, customers and events tables."""

from pyspark.sql import functions as F

from scholarmatch.plans import documents, operations, tables
from scholarmatch.plans.tables import load
from scholarmatch.sources.tables import scratch_path
from scholarmatch.streaming import jobs


def _stream(spark, sf, name):
    # a pattern, so that the table may be one file or a folder of files
    return spark.readStream.schema(load(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _stream_fetches(spark, sf):
    p = _stream(spark, sf, "pages")
    k = F.col("page_id")
    again = F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return p.withColumn("n", F.explode(again)).select(
        "url",
        F.md5(F.when((F.col("n") == 1) & (k % 6 == 0), F.concat("html", F.lit("!"))).otherwise(F.col("html"))).alias("content_hash"),
        (start + F.make_dt_interval(F.lit(0), (k + 24 * F.col("n")).cast("int"))).alias("fetched_at"),
    )


def stream_page_changes(spark, sf):
    folder = scratch_path(spark, "page-changes")
    jobs.page_changes(_stream_fetches(spark, sf), folder)
    return spark.read.parquet(f"{folder}/data").groupBy("url", "content_hash").agg(F.count("*").alias("n"))


def stream_catalog_upsert(spark, sf):
    folder = scratch_path(spark, "catalog-stream")
    batch = tables.catalog_batches(spark, sf)
    from scholarmatch.operators import catalog as ops

    arrivals = tables.catalog_batches(spark, sf, customers=_stream(spark, sf, "customer"))
    jobs.catalog_upsert(arrivals, folder)
    out = jobs.read_catalog(spark, folder, ops.catalog_upsert(None, batch).schema)
    return out.select(*ops.KEY, "title", "email", F.array_join("sources", ",").alias("sources"), "source_url")


def _stream_steps(spark, sf):
    return operations.steps_of(_stream(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_budget_gate(spark, sf):
    folder = scratch_path(spark, "budget")
    jobs.budget_gate(operations.steps_of(_stream(spark, sf, "events")), folder, operations.LIMITS)
    return jobs.read_breaches(spark, folder)


def _windows(spark, sf, kind):
    folder = scratch_path(spark, f"windows-{kind}")
    jobs.trace_windows(_stream_steps(spark, sf), folder, kind)
    out = spark.read.parquet(f"{folder}/data")
    return out.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"),
        *[c for c in out.columns if c in ("kind", "run_id")],
        "n",
        "duration_ms",
    )


def stream_trace_windows(spark, sf):
    return _windows(spark, sf, "tumbling")


def stream_trace_sliding(spark, sf):
    return _windows(spark, sf, "sliding")


def stream_trace_sessions(spark, sf):
    return _windows(spark, sf, "session")


_NAMES = (
    "stream_page_changes stream_catalog_upsert stream_budget_gate stream_trace_windows stream_trace_sliding stream_trace_sessions"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_W = f"WITH {operations._EV}, {operations._ST}"
ORACLES = {
    "stream_page_changes": f"WITH {documents._FETCH} SELECT DISTINCT url, content_hash, 1::BIGINT AS n FROM f",
    "stream_catalog_upsert": f"WITH {tables.BATCHES}, {tables.MERGED} SELECT university, department, name, title, email, sources, source_url FROM cat",
    "stream_budget_gate": operations.ORACLES["budget_breach"].replace("SELECT run_id, arg_min(reason, idx)", "SELECT run_id::VARCHAR AS run_id, arg_min(reason, idx)"),
    "stream_trace_windows": f"""{_W}, w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, kind, count(*) AS n, sum(duration_ms) AS duration_ms FROM st GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS "end", kind, n, duration_ms FROM w WHERE s + INTERVAL '1 hour' <= (SELECT max(ts) FROM st) - INTERVAL '1 hour'""",
    "stream_trace_sliding": f"""{_W}, w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * b AS s, kind, count(*) AS n, sum(duration_ms) AS duration_ms FROM st, (VALUES (0), (1)) AS o(b) GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS "end", kind, n, duration_ms FROM w WHERE s + INTERVAL '1 hour' <= (SELECT max(ts) FROM st) - INTERVAL '1 hour'""",
    "stream_trace_sessions": f"""{_W}, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts, idx) >= INTERVAL '30 minutes', true)::INT AS fresh FROM st),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, idx) AS sid FROM g),
w AS (SELECT run_id, sid, min(ts) AS s, max(ts) + INTERVAL '30 minutes' AS e, count(*) AS n, sum(duration_ms) AS duration_ms FROM i GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(e, '%Y-%m-%d %H:%M:%S') AS "end", run_id, n, duration_ms FROM w WHERE e <= (SELECT max(ts) FROM st) - INTERVAL '1 hour'""",
}
