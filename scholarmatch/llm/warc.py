"""WARC archives of web pages and their globally ordered capture index.

Writing: each page is one record. Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the
smallest page id is a ``response``, the others are ``revisit`` records without a payload that refer to it; smaller
payloads are always written out. Records are whole text rows separated by the two line ends that close a record, so
Spark's own writer makes the (gzip) archive files on whatever file system the shared folder lies.

Reading: every archive file is parsed record by record by its Content-Length, response payloads are checked against
their digests, and the captures of a file form a run sorted by (URL key, timestamp, page id), written to shared
files. The runs are then merged: each task takes a range of keys from all runs, and a k-way loser tree merges them,
so that the tasks' results, one after the other, are the globally ordered capture history.

Defined cases: a null html is an empty payload; a null url has the empty URL key and no target line; a null page id
is written as an empty id, is never the response of others with an id, and
comes first among captures of one URL and time; rows repeated with id and payload are captures of their own
and are all responses or all revisits; an empty table gives an empty index; other columns are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmatch.sources.tables import scratch_path, settle

#: Payloads from this size on are written once.
REVISIT_BYTES = 100
#: Records in an archive file.
FILE_RECORDS = 5000
END = "\r\n"
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "file", "offset"]
_TYPES = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url_key string, captured_at string, file string, offset long"


def url_key(url: str) -> str:
    """Sort-friendly form: host labels from the right, then path and query, lower-cased host without www and port."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str, at: Column | None) -> DataFrame:
    """``record``: the text of each page's WARC record, without the line ends that close it."""
    # Where no capture time is given the page id counts seconds from a fixed day.
    stamp = F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(10**9))) if at is None else at
    base = pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]", "%0A").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    ).withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    first = base.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    found = base.join(first.drop("copies"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", name(F.col("id"))), ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.when(F.col("url") != "", F.col("url"))), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("X-Payload-Length", F.col("size").cast("string")), ("WARC-Refers-To", F.when(again, name(F.col("first")))),
        ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit(END)), F.lit("")) for key, value in head]
    return found.select(F.concat(F.lit(f"WARC/1.1{END}"), *lines, F.lit(END), block).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at: Column | None = None) -> None:
    """Archive files with at most ``FILE_RECORDS`` records each, under ``path``."""
    rows = records(pages, id_col, url_col, html_col, at)
    rows.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(stream, file: str) -> Iterator[tuple]:
    """The captures of one archive, in file order; one record in memory at a time."""
    offset = 0
    while True:
        line = stream.readline()
        if not line:
            return
        start, head = offset, {}
        offset += len(line)
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"{file}: no record at {start}")
        while (line := stream.readline()).strip():
            offset += len(line)
            key, _, value = line.decode().partition(":")
            head[key.lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{file}: the record at {start} is cut")
        offset += len(line) + size + 4
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        if head["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"]):
                raise ValueError(f"{file}: the payload at {start} is damaged")
        bare = lambda key: head[key].removeprefix("<urn:page:").removesuffix(">") if key in head else None
        yield (
            bare("warc-record-id"), int(head["x-payload-length"]), digest, head["warc-type"], bare("warc-refers-to"),
            url_key(head.get("warc-target-uri", "")), head["warc-date"], file, start,
        )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            file, held = path.as_py(), []
            with gzip.open(io.BytesIO(content.as_buffer()), "rb") as packed:
                for row in parse(io.BufferedReader(packed, 1 << 16), file.rpartition("/")[2]):
                    held.append(row)
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    kinds = [pa.int64() if n in ("payload_bytes", "offset") else pa.string() for n in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _NAMES)


def order_key(row: tuple) -> tuple:
    """URL key, timestamp, page id (shorter first, so numbers by value), place in the archives."""
    return (row[5], row[6], len(row[0]), row[0], row[7], row[8])


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers, so that each row costs one walk from a leaf to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.size = max(1, len(self.runs))
        self.heads = [self._next(i) for i in range(len(self.runs))]
        self.losers = [-1] * self.size
        self.winner = self._build(1) if self.runs else -1

    def _next(self, run: int):
        row = next(self.runs[run], None)
        return None if row is None else (order_key(row), row)

    def _less(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._build(2 * node), self._build(2 * node + 1)
        won, self.losers[node] = (left, right) if self._less(left, right) else (right, left)
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run][1]
            self.heads[run] = self._next(run)
            node = (run + self.size) // 2
            while node:
                if self._less(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key range: those of a run are put back into its order, the runs are merged."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[7], []).append(row)
    held = []
    for row in LoserTree([sorted(r, key=order_key) for r in runs.values()]):
        held.append(row)
        if len(held) == 4096:
            yield _batch(held)
            held = []
    yield _batch(held)


def read_archives(spark, path: str) -> DataFrame:
    """Sorted runs of captures, one for each archive file, written to the shared folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    captures = files.mapInArrow(_read, _TYPES)
    return settle(captures.sortWithinPartitions("file", "url_key", "captured_at", "page_id"), "warc-runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The globally ordered capture index: partitions are key ranges in order, rows in order inside each."""
    return runs.repartitionByRange("url_key", "captured_at", F.length("page_id"), "page_id").mapInArrow(_merge, _TYPES)


def capture_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at: Column | None = None) -> DataFrame:
    """Writes the archives to the shared folder, reads them back and merges the capture runs.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at, file, offset.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, at)
    merged = merge_runs(read_archives(spark, path))
    return merged.select(
        F.when(F.col("page_id") != "", F.col("page_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "url_key", "captured_at", "file", "offset",
    )
