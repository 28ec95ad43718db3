"""Scores, similarity and top-k on hand rows and against all-pairs models."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scholarmatch.functions import text
from scholarmatch.functions.scale import literal_table
from scholarmatch.operators import dictionary, discover, nearest

CAT = (
    "university string, department string, name string, title string, email string, research_directions array<string>, "
    "research_areas array<string>, publications array<string>, homepage_url string, profile_text string, sources array<string>"
)
ROWS = [
    ("U", "计算机学院", "甲", "教授", "a@x.edu", ["知识图谱", "知识图谱与语义计算"], [], [], "h", "讲 知识图谱"),
    ("U", "History", "乙", "", "", [], ["Graph Neural nets"], ["On graphs"], "", "graph graph"),
    ("U", "History", "丙", "", "", [], [], [], "", "just mentions GRAPH"),
    ("V", "Physics", "丁", "", "", [" "], [], [], "", None),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(*r, ["official"]) for r in ROWS], CAT)


def ask(spark, *queries):
    return discover.prepare_queries(literal_table(spark, ("query_id", "query"), list(enumerate(queries))))


def test_terms_are_split_cleaned_and_case_folded(spark):
    q = ask(spark, " a，B;;a、b|%_\n c ").first()
    assert sorted(t["needle"] for t in q["terms"]) == ["a", "b", "c"]


def test_term_counts_once_per_field_and_weights_add_up(spark, catalog):
    got = {(r["name"], r["field"]): r["weight"] for r in discover.match_reasons(catalog, ask(spark, "知识图谱")).collect()}
    assert got == {("甲", "research_directions"): 3, ("甲", "profile_text"): 1}
    ranked = discover.rank_candidates(catalog, ask(spark, "graph")).collect()
    assert [(r["name"], r["match_score"]) for r in ranked] == [("乙", 6)]  # a mention in the profile alone is too little


def test_rank_order_and_school_filter(spark, catalog):
    ranked = discover.rank_candidates(catalog, ask(spark, "知识图谱, history"), min_score=2).orderBy("rank").collect()
    assert [r["name"] for r in ranked] == ["甲", "丙", "乙"] or [r["name"] for r in ranked] == ["甲", "乙", "丙"]
    assert discover.rank_candidates(catalog, ask(spark, "graph"), universities=["V"]).count() == 0


def test_compare_row_spells_out_reasons(spark, catalog):
    r = discover.compare_table(catalog, ask(spark, "知识图谱")).first()
    assert r["reason"] == "研究方向命中 知识图谱；简介正文命中 知识图谱"
    assert (r["completeness_text"], r["title"], r["homepage"]) == ("100%", "教授", "h")


def feats(s):
    import re

    out = []
    for run in re.findall("[一-龥]+", s.lower()):
        out += [run] if len(run) == 1 else [run, *(run[i : i + 2] for i in range(len(run) - 1))]
    return out + re.findall(r"[a-z][a-z0-9+#.\-]+", s.lower())


def cos(a, b):
    x, y = collections.Counter(feats(a)), collections.Counter(feats(b))
    n = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(x[k] * y[k] for k in x) / n if n else 0.0


PHRASES = ["知识图谱", "图谱知识", "图谱", "图", "图神经网络 GNN", "GNN c++ survey", "survey of gnn", "油画", "the the cat", "cat", "a b", "深度学习 deep learning", "Deep-Learning deep learning"]


def test_features_double_a_two_character_run(spark):
    got = spark.createDataFrame([(p,) for p in PHRASES], "p string").select("p", text.features("p").alias("f")).collect()
    assert {r["p"]: sorted(r["f"]) for r in got} == {p: sorted(feats(p)) for p in PHRASES}


@pytest.mark.parametrize("threshold", [0.1, 0.36, 0.8])
def test_similar_pairs_equal_all_pairs(spark, threshold):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "知识", "图谱", "eps"]
    made = [" ".join(rng.choices(words, weights=[20, 8, 4, 2, 2, 1, 1], k=rng.randint(1, 5))) for _ in range(60)]
    left, right = PHRASES + made[:30], PHRASES + made[30:]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "phrase string")
    got = {(r[0], r[1]): round(r[2], 6) for r in discover.similar_pairs(df(left), df(right), threshold).collect()}
    want = {(a, b): round(cos(a, b), 6) for a, b in itertools.product(set(left), set(right)) if cos(a, b) >= threshold - 1e-12}
    assert got == want


def test_hashed_vectors_are_unit_length_and_agree_without_collisions(spark):
    df = spark.createDataFrame(list(enumerate(["graph nets", "graph theory", ""])), "i int, t string")
    v = {r["i"]: r["embedding"] for r in discover.hashed_vectors(df, "i", "t", 4096).collect()}
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and sum(v[2]) == 0
    assert abs(sum(a * b for a, b in zip(v[0], v[1])) - cos("graph nets", "graph theory")) < 1e-9


@pytest.mark.parametrize("sizes", [(50_000, 4096), (2, 7)])
def test_contains_join_equals_all_pairs(spark, sizes):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc知", k=rng.randint(0, 9))) for _ in range(60)] + [None, None, "abc", "abc", "a\x00b\U0001f600c"]
    needles = ["a", "bc", "abc", "cabb", "zz", "", None, "a", "知", "ab", "\U0001f600"]
    values = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    terms = spark.createDataFrame(list(enumerate(needles)), "j int, t string")
    want = sorted((i, j) for i, v in enumerate(texts) for j, t in enumerate(needles) if v is not None and t and t in v)
    got = dictionary.contains_join(values, terms, "v", "t", *sizes)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    assert dictionary.contains_join(values.limit(0), terms, "v", "t").count() == dictionary.contains_join(values, terms.limit(0), "v", "t").count() == 0


def test_a_text_is_copied_once_a_shard_and_never_spread(spark):
    values = spark.createDataFrame([("abcdefgh" * 500,), ("x" * 1000,)], "v string")
    terms = spark.createDataFrame([("abc",), ("nope",)], "t string")
    plan = dictionary.contains_join(values, terms, "v", "t")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "substring" not in plan


def test_no_nested_loop_join(spark, catalog):
    plan = discover.rank_candidates(catalog, ask(spark, "graph"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_term_filter_keeps_rows_with_null_keys_and_ignores_empty_terms(spark, catalog):
    odd = catalog.withColumn("department", F.lit(None).cast("string"))
    q = ask(spark, "graph")
    assert discover.term_filter(odd, q).count() == discover.match_reasons(odd, q).select("name").distinct().count() > 0
    blank = q.withColumn("terms", F.transform("terms", lambda t: F.struct(t["pos"], F.lit("").alias("needle"), t["term"])))
    assert discover.term_filter(catalog, blank).count() == 0


def _all_pairs(q, vec, threshold, k):
    pairs = q.crossJoin(vec).select("query_id", "vec_id", discover.dense_cosine("query_vec", "embedding").alias("c")).where(F.col("c") >= threshold)
    best = Window.partitionBy("query_id").orderBy(F.round("c", 4).desc(), "vec_id")
    rows = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return sorted(map(tuple, rows.select("query_id", "vec_id", F.round("c", 4).alias("cosine"), "rank").collect()))


def test_vector_recall_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, 2.0]), (62, [0.0] * 8), (63, []), (64, [2.0, 4.0]), (65, [float("nan")] * 8), (66, [None] * 8)]
    rows += [(70 + i, rows[3][1]) for i in range(20)]  # copies of one vector
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = vec.where("vec_id < 20 OR vec_id >= 60").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    clean = vec.where("vec_id NOT IN (65, 66)")
    want = _all_pairs(q.where("query_id NOT IN (65, 66)"), clean, 0.3, 5)
    for cell_rows, block_rows in ((4096, 4096), (5, 3)):
        got = nearest.vector_recall(q, vec, 0.3, 5, cell_rows, block_rows).select("query_id", "vec_id", "cosine", "rank")
        assert sorted(map(tuple, got.collect())) == want
    assert nearest.vector_recall(q, vec.limit(0), 0.3).count() == nearest.vector_recall(q.limit(0), vec, 0.3).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        nearest.vector_recall(q, vec, 0.0)


def test_cells_that_are_too_far_apart_do_not_meet(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 12]]) for i in range(600)]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = vec.where("vec_id < 60").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    counts = {}
    got = nearest.vector_recall(q, vec, 0.9, 4, cell_rows=4, counts=counts).select("query_id", "vec_id", "cosine", "rank")
    assert sorted(map(tuple, got.collect())) == _all_pairs(q, vec, 0.9, 4)
    assert counts["met"] < counts["all"] / 3


def test_blocks_of_vectors_are_few_and_of_the_given_width(spark, monkeypatch):
    """Vectors are shuffled once for every block they meet, so blocks are large, and floats stay floats."""
    rng = random.Random(6)
    vec = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(9000)], "vec_id long, embedding array<float>")
    q = vec.where("vec_id % 300 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    monkeypatch.setattr(nearest, "SLAB_ENTRIES", 4 * 9000)
    counts = {}
    found = nearest.vector_recall(q, vec, 0.3, 3, counts=counts)
    assert counts["all"] == 1
    assert "array<float>" in str([(f.name, f.dataType.simpleString()) for f in nearest._placed(vec, "vec_id", "embedding", nearest.Cells(np.eye(1, 4), 1, 1)).schema])
    got = sorted(map(tuple, found.select("query_id", "vec_id", "cosine", "rank").collect()))
    assert got == _all_pairs(q, vec, 0.3, 3)


def test_no_two_vectors_within_the_angle_are_kept_apart():
    rng = np.random.default_rng(1)
    units = nearest.unit_rows(list(rng.normal(size=(400, 6))), 6)
    cells = nearest.Cells(units[:100], 6, 4)
    cell, angles = cells.place(units)
    boxes = {c: np.array([angles[cell == c].min(axis=0), angles[cell == c].max(axis=0)]) for c in set(cell.tolist())}
    met = set(nearest.meetings(boxes, boxes, math.acos(0.6)))
    close = np.argwhere(units @ units.T >= 0.6)
    assert all((cell[i], cell[j]) in met for i, j in close) and len(met) < len(boxes) ** 2


def test_hybrid_adds_reasons_and_rescues_near_advisors(spark, catalog):
    q = ask(spark, "graph")
    sim = catalog.select(F.lit(0).alias("query_id"), *discover.KEY).join(
        spark.createDataFrame([("乙", 0.25), ("丙", 0.25), ("丁", 0.5)], "name string, similarity double"), "name"
    )
    got = {r["name"]: (r["match_score"], r["vector_reason"]) for r in discover.hybrid_rank(catalog, q, sim).collect()}
    assert got == {"乙": (6, "surface"), "丁": (0, "surface")}


def test_embed_hook_batches_and_refuses_short_answers(spark):
    df = spark.createDataFrame([(i, "x" * 3000) for i in range(5)], "i int, t string")
    out = discover.embed_texts(df, "i", "t", lambda texts: [[float(len(t)), float(len(texts) <= 2)] for t in texts], batch=2, max_chars=2000)
    assert {tuple(r["embedding"]) for r in out.collect()} == {(2000.0, 1.0)}
    with pytest.raises(Exception, match="asked for"):
        discover.embed_texts(df, "i", "t", lambda texts: [], batch=2).collect()
