"""The stored gram index: same rows as the direct search, few scored rows, and updates that leave other parts alone."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scholarmatch.functions.scale import literal_table
from scholarmatch.operators import discover, gram_index

CAT = (
    "university string, department string, name string, title string, email string, research_directions array<string>, "
    "research_areas array<string>, publications array<string>, homepage_url string, profile_text string, orcid string, openalex_id string"
)
WORDS = ["graph", "graphs", "neural", "知识图谱", "图谱", "optics", "laser", "ai", "x", "İstanbul", "gr"]


def _catalog(spark, n=150, seed=1):
    rng = random.Random(seed)
    some = lambda most: [" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(rng.randint(0, most))]
    rows = [
        (f"U{i % 4}", rng.choice(["Graph School", "物理", None, ""]), f"N{i % 70}", rng.choice(["", "Prof"]), rng.choice(["", "a@b"]), some(3), some(2), some(2), rng.choice(["", "h"]), rng.choice([None, "", *WORDS]), "", "")
        for i in range(n)
    ]
    rows += [rows[0], rows[1], ("U9", None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, CAT)


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["graph, neural", "知识图谱", "图", "ai|x", "laser optics", "nowhere", "gr;graph;graphs", "İ"]
    return discover.prepare_queries(literal_table(spark, ("query_id", "query"), list(enumerate(texts))))


def _rows(df):
    return sorted(map(repr, df.collect()))


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("k", [1, 20])
def test_ranks_equal_the_direct_search(spark, asked, tmp_path, k):
    catalog = _catalog(spark)
    gram_index.build_index(catalog, str(tmp_path), parts=3, shards=5)
    want = discover.rank_candidates(catalog, asked, k=k)
    got = gram_index.rank_indexed(spark, str(tmp_path), asked, k=k, shards=5)
    plain = lambda df: sorted((r["query_id"], r["rank"], r["match_score"], round(r["completeness"], 6), str(r["university"]), str(r["name"])) for r in df.collect())
    assert plain(got) == plain(want)
    assert _rows(gram_index.filter_indexed(spark, str(tmp_path), asked, shards=5)) == _rows(discover.term_filter(catalog, asked).select("query_id", *discover.KEY))
    only = gram_index.rank_indexed(spark, str(tmp_path), asked, k=k, universities=["U1"], shards=5)
    assert plain(only) == plain(discover.rank_candidates(catalog, asked, k=k, universities=["U1"]))


def test_advisors_who_cannot_reach_the_list_are_not_scored(spark, tmp_path):
    rows = [("U", f"D{i:04}", f"N{i:04}", "p", "e", ["graph" if i < 30 else "other"], ["graph"] if i < 25 else [], [], "h", "graph", "", "") for i in range(400)]
    gram_index.build_index(spark.createDataFrame(rows, CAT), str(tmp_path), 2, 2)
    asked = discover.prepare_queries(literal_table(spark, ("query_id", "query"), [(1, "graph")]))
    scored = gram_index.ranked_pairs(spark, str(tmp_path), asked, k=20, min_score=1, shards=2)
    assert gram_index.bounds(spark, str(tmp_path), asked, 2).count() == 400 and scored.count() == 20
    assert gram_index.rank_indexed(spark, str(tmp_path), asked, k=20, min_score=1, shards=2).count() == 20


def test_bounds_are_never_below_the_scores(spark, asked, tmp_path):
    catalog = _catalog(spark, seed=3)
    gram_index.build_index(catalog, str(tmp_path), 2, 2)
    scored = gram_index.ranked_pairs(spark, str(tmp_path), asked, k=10_000, min_score=0, shards=2)
    low = scored.join(gram_index.bounds(spark, str(tmp_path), asked, 2), ["query_id", "doc"]).where("bound < match_score")
    assert low.count() == 0


def test_a_query_reads_the_shards_of_its_grams(spark, tmp_path):
    gram_index.build_index(_catalog(spark, 60), str(tmp_path), parts=2, shards=16)
    asked = discover.prepare_queries(literal_table(spark, ("query_id", "query"), [(1, "laser")]))
    shards = {r[0] for r in spark.createDataFrame([("las",), ("ase",), ("ser",)], "g string").select(gram_index.shard_of(F.col("g"), 16)).collect()}
    plan = gram_index.bounds(spark, str(tmp_path), asked, 16)._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters" in line and "shard" in line.split("PartitionFilters")[1] for line in plan.splitlines())
    stored = gram_index._stored(spark, str(tmp_path), "grams")
    files = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
    read = files(stored.where(F.col("shard").isin(list(shards))))
    assert 0 < len(read) < len(files(stored)) / 4 and {int(f.split("shard=")[1].split("/")[0]) for f in read} == shards


def test_an_update_writes_the_touched_parts_only(spark, asked, tmp_path):
    before = _catalog(spark)
    gram_index.build_index(before, str(tmp_path), parts=12, shards=2)
    old = _files(tmp_path)
    assert gram_index.update_index(before, str(tmp_path), parts=12, shards=2) == [] and _files(tmp_path) == old
    changed = F.when((F.col("university") == "U1") & (F.col("name") == "N5"), F.lit("a new laser text")).otherwise(F.col("profile_text"))
    after = before.withColumn("profile_text", changed).where("NOT (university = 'U2' AND name = 'N6') OR university IS NULL OR name IS NULL")
    new = spark.createDataFrame([("U7", "D", "New", "", "", ["graph laser"], [], [], "", "", "", "")], CAT)
    after = after.unionByName(new)
    touched = gram_index.update_index(after, str(tmp_path), parts=12, shards=2)
    assert 0 < len(touched) < 8
    now = _files(tmp_path)
    kept = lambda files: {f: t for f, t in files.items() if int(f.split("part=")[1].split("/")[0]) not in touched}
    assert kept(old) == kept(now) and old != now
    assert _rows(gram_index.rank_indexed(spark, str(tmp_path), asked, shards=2).drop("completeness")) == _rows(discover.rank_candidates(after, asked).drop("completeness"))
    assert gram_index.update_index(after, str(tmp_path), parts=12, shards=2) == []


def test_parts_that_lose_everybody_are_emptied(spark, asked, tmp_path):
    catalog = _catalog(spark)
    gram_index.build_index(catalog, str(tmp_path), parts=12, shards=2)
    few = catalog.where("university = 'U3' AND name = 'N7'")
    gram_index.update_index(few, str(tmp_path), parts=12, shards=2)
    assert gram_index._stored(spark, str(tmp_path), "texts").count() == few.count() and few.count() > 0
    assert _rows(gram_index.filter_indexed(spark, str(tmp_path), asked, shards=2)) == _rows(discover.term_filter(few, asked).select("query_id", *discover.KEY))


def test_empty_catalog_and_no_queries(spark, asked, tmp_path):
    catalog = _catalog(spark)
    gram_index.build_index(catalog, str(tmp_path), 2, 2)
    assert gram_index.rank_indexed(spark, str(tmp_path), asked.limit(0), shards=2).count() == 0
    gram_index.update_index(catalog.limit(0), str(tmp_path), 2, 2)
    assert gram_index.rank_indexed(spark, str(tmp_path), asked, shards=2).count() == 0


def test_a_large_folder_is_written_by_several_tasks(spark, tmp_path):
    """One school of one file: its grams are found in many tasks, and no task sorts a whole folder."""
    rows = [("U", "D", f"N{i}", "", "", [f"topic{i} of {i * 7919 % 1000}"], [], [], "", "", "", "") for i in range(400)]
    catalog = spark.createDataFrame(rows, CAT).coalesce(1)
    plan = gram_index._grams(gram_index._texts(catalog, 1), 1)._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1 and max(i for i, line in enumerate(plan) if "Generate" in line) < dealt[0]  # printed from its end
    assert not any("ENSURE_REQUIREMENTS" in line for line in plan)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, "8k")
        gram_index.build_index(catalog, str(tmp_path / "index"), parts=1, shards=1)
    finally:
        spark.conf.set(key, kept)
    assert len(list((tmp_path / "index/grams/part=0/shard=0").glob("*.parquet"))) > 1
