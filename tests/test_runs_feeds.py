"""Runs, traces, streams and feeds on hand rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from scholarmatch.operators import contacts, runs
from scholarmatch.sources import feeds, tables
from scholarmatch.streaming import jobs

STEP = "run_id string, idx long, kind string, name string, status string, duration_ms long, tokens_in long, tokens_out long, source string, ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def steps(spark, rows):
    return spark.createDataFrame(
        [(r, i, k, "t", "ok", 1, tok, 0, src, T0 + dt.timedelta(seconds=sec)) for r, i, k, tok, src, sec in rows], STEP
    )


def first_breach(rows, limits):
    """Walks each run and stops at the first step that reaches a limit."""
    out = {}
    for run in {r[0] for r in rows}:
        n = tok = ext = 0
        per, start = {}, None
        for _, i, kind, t, src, sec in sorted(x for x in rows if x[0] == run):
            start = sec if start is None else min(start, sec)
            if kind == "llm_decision":
                n, tok = n + 1, tok + t
            elif kind == "tool_call" and src:
                ext, per[src] = ext + 1, per.get(src, 0) + 1
            checks = [
                ("MAX_STEPS", n >= limits["MAX_STEPS"]), ("MAX_LLM_CALLS", n >= limits["MAX_LLM_CALLS"]), ("MAX_TOKENS", tok >= limits["MAX_TOKENS"]),
                ("MAX_EXTERNAL_CALLS", ext >= limits["MAX_EXTERNAL_CALLS"]),
                (f"SOURCE_RATE_LIMIT:{src}", per.get(src, 0) >= limits["SOURCE_RATE_LIMIT"]), ("MAX_WALL_TIME", sec - start >= limits["MAX_WALL_TIME"]),
            ]
            hit = [c for c, yes in checks if yes]
            if hit:
                out[run] = (hit[0], i)
                break
    return out


LIMITS = {"MAX_STEPS": 6, "MAX_LLM_CALLS": 8, "MAX_TOKENS": 60, "MAX_EXTERNAL_CALLS": 9, "SOURCE_RATE_LIMIT": 5, "MAX_WALL_TIME": 70}


def made_steps(seed):
    rng = random.Random(seed)
    runs_ = ["hot"] * 60 + [f"r{i}" for i in range(12) for _ in range(10)]
    return [
        (r, i, rng.choice(["llm_decision", "tool_call", "error"]), rng.randint(0, 15), rng.choice(["a", "b", ""]), i)
        for i, r in enumerate(rng.sample(runs_, len(runs_)))
    ]


@pytest.mark.parametrize("seed", range(3))
def test_budget_breach_equals_a_walk(spark, seed):
    rows = made_steps(seed)
    got = {r["run_id"]: (r["reason"], r["at_idx"]) for r in runs.budget_breach(steps(spark, rows), LIMITS).collect()}
    assert got == first_breach(rows, LIMITS)


def test_budget_stream_over_batches_equals_the_walk(spark, tmp_path):
    rows = made_steps(9)
    for n in range(3):
        steps(spark, rows[n * 60 : (n + 1) * 60]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(steps(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.budget_gate(source, str(tmp_path / "out"), LIMITS)
    got = {r["run_id"]: (r["reason"], r["at_idx"]) for r in jobs.read_breaches(spark, str(tmp_path / "out")).collect()}
    assert got == first_breach(rows, LIMITS)


def test_catalog_stream_is_one_upsert_and_survives_a_second_run(spark, tmp_path):
    from scholarmatch.operators import catalog as ops
    from tests.test_catalog import FIELDS, arrival

    rows = [arrival(i, s, name=f"n{i % 4}", title=t) for i, (s, t) in enumerate([("a", ""), ("b", "x"), ("c", "y"), ("a", "z"), ("d", "w"), ("b", "q"), ("a", "u"), ("c", "")])]
    for n in range(2):
        spark.createDataFrame(rows[n * 4 : n * 4 + 4], FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = ops.catalog_upsert(None, spark.createDataFrame(rows, FIELDS))
    for _ in range(2):
        source = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.catalog_upsert(source, str(tmp_path / "out"))
    got = jobs.read_catalog(spark, str(tmp_path / "out"), whole.schema).orderBy("name").collect()
    assert got == whole.orderBy("name").collect()


def test_late_and_repeated_pages_are_dropped(spark, tmp_path):
    for i, rows in enumerate([[("u", "h", 10), ("u", "h", 10), ("v", "h", 10)], [("w", "h", 20)], [("u", "h2", 5), ("u", "h3", 21)]]):
        spark.createDataFrame([(u, h, T0 + dt.timedelta(hours=n)) for u, h, n in rows], "url string, content_hash string, fetched_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("url string, content_hash string, fetched_at timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    jobs.page_changes(source, str(tmp_path / "out"))
    rows = [(r["url"], r["content_hash"]) for r in spark.read.parquet(str(tmp_path / "out/data")).collect()]
    assert sorted(rows) == [("u", "h"), ("u", "h3"), ("v", "h"), ("w", "h")]  # one copy each; the late ("u", "h2") is not there


def test_artifacts_replace_and_bad_json_is_skipped(spark):
    rows = [
        ("a1", "r1", "view", '{"k": 1}', 1, 1), ("a1", "r1", "view", '{"k": 7}', 2, 2), ("a2", "r1", "view", '{"k": "7"}', 3, 3), ("a3", "r2", "view", "{bad", 4, 4),
        ("a4", "r3", "other", '{"k": 7}', 5, 5), ("a5", "r4", "view", '[7]', 5, 6),
    ]
    a = spark.createDataFrame(rows, "id string, run_id string, kind string, payload string, created_at int, seq int")
    assert {(r["run_id"], r["kind"]): r["payload"] for r in runs.latest_artifact(a).collect()}[("r1", "view")] == '{"k": "7"}'
    assert [r[0] for r in runs.runs_by_json_field(a, "view", "k", 7).collect()] == ["r1"]
    assert [r[0] for r in runs.runs_by_json_field(a, "view", "k", "7").collect()] == ["r1"]
    assert runs.runs_by_json_field(a, "view", "k", 1).count() == 0
    with pytest.raises(ValueError):
        runs.delete_run(a, a, "r1")
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    keep = a.withColumn("run_id", F.when(F.col("run_id") == "r1", u).otherwise(F.col("run_id")))
    assert runs.delete_run(keep, keep, u)[1].count() == 3


def test_stages_collapse_only_neighbours(spark):
    rows = [("r", i, s) for i, s in enumerate(["a", "a", None, "a", "b", "a"])]
    got = runs.stage_chain(spark.createDataFrame(rows, "run_id string, idx long, stage string")).orderBy("idx").collect()
    assert [r["stage"] for r in got] == ["a", "b", "a"]


def test_retention_touches_managed_files_only(spark):
    u, v = "0f8fad5b-d9cb-469f-a165-70867728950e", "{7c9e6679-7425-40de-944b-e07fc1f90ae7}"
    f = spark.createDataFrame([(f"{u}.pdf", 5, T0), (f"{v}.PDF", 7, T0), ("mine.pdf", 1, T0), (f"{u}.txt", 1, T0)], "file string, size long, modified_at timestamp_ntz")
    a = runs.retention_audit(f, spark.createDataFrame([(u,)], "run_id string"), "2024-01-31 00:00:00", 30)
    assert {r["file"]: (r["state"], r["expired"]) for r in a.collect()} == {f"{u}.pdf": ("referenced", False), f"{v}.PDF": ("orphan", True)}
    assert tuple(runs.retention_totals(a).first()) == (2, 12, 1, 1, 7, 1)


def test_source_outage_is_not_an_empty_result(spark):
    o = spark.createDataFrame(
        [("r", 0, "A", "error", 0, "x", 0.0), ("r", 1, "B", "blocked", 0, "y", 0.1), ("q", 0, "A", "empty", 0, "", 0.0)],
        "run_id string, pos int, label string, status string, n int, reason string, cost double",
    )
    got = {r["run_id"]: (r["unavailable"], r["description"]) for r in runs.source_health(o).collect()}
    assert got == {"r": (True, "本次没有检索到论文；未返回：A（x）、B（y）"), "q": (False, "本次没有检索到论文")}


def test_contact_levels(spark):
    c = spark.createDataFrame(
        [("a", "甲", "U", "信息学院一系"), ("b", "乙", "U", "信息学院 二系"), ("c", "丙", "U", "历史系"), ("d", "丁", "V", "X"), ("e", "戊", "W", ""), ("f", "己", "V", "Y")],
        "person string, name string, institution string, department string",
    )
    P = "person string, seq int, title string, doi string, source_url string, authors array<string>"
    p = spark.createDataFrame(
        [
            ("a", 1, "T 1", None, None, ["甲", "友"]), ("a", 2, "T2", "10/X", None, ["甲", "友"]), ("c", 3, "T3", None, None, ["丙", "友"]), ("c", 4, "T4", None, None, ["友", "丙"]),
            ("d", 5, "t1", None, None, ["丁"]), ("f", 6, "T6", None, None, ["己", "丁"]),
        ],
        P,
    )
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("d", "f"), ("c", "f"), ("c", "e")], "left_id string, right_id string")
    got = {(r["left_id"], r["right_id"]): (r["level"], r["evidence"]) for r in contacts.collision_level(pairs, c, p).collect()}
    assert got[("a", "b")] == ("CAUTION", "") and got[("a", "c")] == ("CAUTION", "双方都多次合作的共同作者：友")
    assert got[("a", "d")] == ("HIGH", "共同论文：T 1") and got[("d", "f")][0] == "HIGH" and got[("c", "f")][0] == "LOW" and got[("c", "e")][0] == "UNKNOWN"
    s = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["c", "f"]), (4, ["a", "c", "d"]), (5, ["c", "e"])], "group_id int, members array<string>")
    lv = {r["group_id"]: (r["level"], r["n_high"]) for r in contacts.group_assessment(s, c, p).collect()}
    assert lv == {1: ("UNKNOWN", 0), 2: ("CAUTION", 0), 3: ("LOW", 0), 4: ("HIGH", 1), 5: ("UNKNOWN", 0)}
    # levels need to know that papers are shared, not which
    plan = contacts.group_assessment(s, c, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(o, seq" not in plan and "collect_list(struct(o, coauthor" not in plan


def conform(spark, fn, *payloads, **kw):
    raw = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False), 0) for i, p in enumerate(payloads)], "seq long, payload string, batch int")
    return fn(raw, **kw).orderBy("seq").collect()


def test_feed_oddities(spark):
    r = conform(spark, feeds.conform_openalex, {"id": "https://openalex.org/W1/", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": None}, "institutions": None}]}, {"title": None}, {"title": "Bare"})
    assert [x["id"] for x in r] == ["W1", "Bare"] and r[0]["abstract"] == "a b a" and r[0]["source_url"] == "https://openalex.org/W1" and r[1]["source_url"] is None
    r = conform(spark, feeds.conform_crossref, {"title": [" A  b "], "published-print": {"date-parts": [[None]]}, "issued": {"date-parts": [["2019", 1]]}, "author": [{"family": "L"}]}, {"title": []})
    assert [(x["title"], x["year"], x["authors"]) for x in r] == [("A b", 2019, ["L"])]
    r = conform(spark, feeds.conform_dblp, {"result": {"hits": {"hit": {"info": {"title": "T", "year": 2020, "authors": {"author": ["A", {"text": "B"}]}}}}}}, {"result": {"hits": {}}}, "<html>")
    assert [(x["id"], x["year"], x["authors"]) for x in r] == [("T", 2020, ["A", "B"])]
    r = conform(spark, feeds.conform_springer, {"title": "T", "url": [{"value": ""}, {"value": "http://u"}], "creators": []})
    assert (r[0]["source_url"], r[0]["authors"], r[0]["year"]) == ("http://u", [], None)
    doc = {"fields": {"Title": {"listValue": {"values": [{"stringValue": ""}, {"stringValue": "题"}]}}, "Creator": {"listValue": {"values": [{"stringValue": s} for s in ("Fan", "A.", "Y.", "Zhang", "Q.")]}}, "PublishYear": {"numberValue": 2021.0}}}
    r = conform(spark, feeds.conform_wanfang, doc, doc, lang="en")
    assert [(x["title"], x["authors"], x["year"]) for x in r] == [("题", ["Fan A. Y.", "Zhang Q."], 2021)]
    assert conform(spark, feeds.conform_wanfang, doc)[0]["authors"] == ["Fan", "A.", "Y.", "Zhang", "Q."]
    xml = '<entry xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://x</id><title> A\n B </title><published>2020-01-01</published><author><name>K</name></author><arxiv:primary_category term="stat.ML"/></entry>'
    r = conform(spark, feeds.conform_arxiv, xml)
    assert (r[0]["title"], r[0]["year"], r[0]["topics"], r[0]["disciplines"], r[0]["authors"]) == ("A B", 2020, ["stat.ML"], ["cs"], ["K"])


def test_tables_round_trip(spark, tmp_path):
    from scholarmatch.operators import catalog as ops
    from tests.test_catalog import FIELDS, arrival

    cat = ops.catalog_upsert(None, spark.createDataFrame([arrival(1, "a", name="x", research_directions=["d"], title="t"), arrival(2, "b", name="y")], FIELDS))
    tables.write_table(cat, str(tmp_path / "c"), "catalog")
    back = tables.read_table(spark, str(tmp_path / "c"), "catalog")
    assert {r["name"]: (r["research_directions"], r["field_sources"], r["sources"]) for r in back.collect()} == {"x": (["d"], {"title": "a", "research_directions": "a"}, ["a"]), "y": ([], {}, ["b"])}
    plan = back.where("university = 'U'").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(university" in plan


def test_words_of_abstracts_are_not_shuffled(spark):
    """The positions of a text's words are made inside its row, and each payload is parsed once."""
    from scholarmatch.plans import feeds as plans

    plan = plans.QUERIES["conform_openalex"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    lines = plan.splitlines()
    assert not any("Filter" in line and "from_json" in line for line in lines)
    got = spark.createDataFrame([("a b a",), ("",), (None,)], "text string").select(plans._spots("text")).collect()
    assert [r[0] for r in got] == [{"a": [0, 2], "b": [1]}, {"": [0]}, None]
