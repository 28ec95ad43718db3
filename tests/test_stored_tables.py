"""Edits of stored tables replace the partitions they touch; files are laid out by school and name."""

import os
import time

import pytest
from pyspark.sql import functions as F

from scholarmatch.operators import catalog as ops
from scholarmatch.sources import tables
from tests.test_catalog import FIELDS, arrival


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    rows = [arrival(i, "ab"[i % 2], university=f"U{i % 5} x/y", name=f"N{i} Professor" if i % 7 == 0 else f"N{i}", title=None if i % 3 else "t") for i in range(60)]
    rows += [arrival(100, "a", university="Lone", name="L")]
    path = str(tmp_path / "catalog")
    tables.write_table(ops.catalog_upsert(None, spark.createDataFrame(rows, FIELDS)), path, "catalog")
    return path


def _rows(spark, path):
    return sorted(map(str, tables.read_table(spark, path, "catalog").drop("field_sources").collect()))


def _schools(files):
    from urllib.parse import unquote

    return {f: unquote(f.split("university=")[1].split("/part-")[0]) for f in files}


@pytest.mark.parametrize(
    "change, touched",
    [
        (lambda df: ops.clear_source(df, "a", "U2 x/y")[0], ["U2 x/y"]),
        (lambda df: ops.delete_by_rule(df, lambda c: c == "N3")[0], ["U3 x/y"]),
        (lambda df: ops.clear_source(df, "a", "Lone")[0], ["Lone"]),
        (lambda df: ops.normalize_names(df, lambda c: F.regexp_replace(c, "^N14 Professor$", "N4"))[0], ["U4 x/y"]),
        (lambda df: df.where(F.col("name") != "nobody"), []),
    ],
)
def test_only_touched_partitions_are_replaced(spark, stored, change, touched):
    want = sorted(map(str, change(tables.read_table(spark, stored, "catalog")).drop("field_sources").select(*[c for c in tables.read_table(spark, stored, "catalog").columns if c != "field_sources"]).collect()))
    old = _files(stored)
    assert tables.edit_table(spark, stored, "catalog", change) == touched
    now = _files(stored)
    kept = lambda files: {f: t for f, t in files.items() if _schools([f])[f] not in touched}
    assert kept(old) == kept(now) and (old == now) == (not touched)
    assert _rows(spark, stored) == want
    assert tables.edit_table(spark, stored, "catalog", change) == []


def test_rows_whose_values_move_between_columns_count_as_changed(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([("1", "r", None, "x", None, 1), ("2", "r", "k", None, None, 2)], "id string, run_id string, kind string, payload string, created_at timestamp, seq long")
    tables.write_table(rows, path, "artifacts")
    moved = lambda df: df.withColumns({"run_id": F.when(F.col("kind").isNull(), F.lit(None).cast("string")).otherwise(F.col("run_id")), "payload": F.when(F.col("kind").isNull(), "r").otherwise(F.col("payload"))})
    assert tables.edit_table(spark, path, "artifacts", moved) == [None]
    got = {r["id"]: (r["run_id"], r["payload"], r["kind"]) for r in tables.read_table(spark, path, "artifacts").collect()}
    assert got == {"1": (None, "r", None), "2": ("r", None, "k")}


def test_large_schools_fill_files_of_name_ranges(spark, tmp_path):
    rows = [arrival(i, "a", university="Big" if i % 3 else f"S{i}", name=f"N{i:05}") for i in range(900)]
    path = str(tmp_path / "c")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        tables.write_table(ops.catalog_upsert(None, spark.createDataFrame(rows, FIELDS)), path, "catalog")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    per_file = tables.read_table(spark, path, "catalog").where("university = 'Big'").groupBy("_metadata.file_path").agg(F.count("*").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi")).orderBy("lo").collect()
    assert len(per_file) >= 4 and max(r["n"] for r in per_file) < 300
    assert all(a["hi"] < b["lo"] for a, b in zip(per_file, per_file[1:]))


def test_settled_rows_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_before = files(), spark.conf.get(key, "false")
    rows = tables.settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"), "few")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key, "false") == set_before
    assert rows.count() == 7
