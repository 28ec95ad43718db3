"""Trends, profiles, fit, drafts and provenance on hand rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from scholarmatch.operators import evaluate, fit, grounding, topics

WORKS = "person string, work_id string, seq long, year int, title string, topics array<string>, disciplines array<string>"


def trend(spark, years, ref=2026):
    rows = [("p", f"w{i}", i, y, "t", ["x"], []) for i, y in enumerate(years)]
    out = topics.topic_trend(topics.works_by_topic(spark.createDataFrame(rows, WORKS)), ref).collect()
    return [(r["status"], r["window"]) for r in out]


@pytest.mark.parametrize(
    "years, want",
    [
        ([2026, 2025], ("INSUFFICIENT_EVIDENCE", "")),
        ([2026, 2026, 2026], ("INSUFFICIENT_EVIDENCE", "")),
        ([2026, 2025, 2024], ("EMERGING", "2024-2026")),
        ([2026, 2023, 2021], ("EMERGING", "2021-2026")),
        ([2025, 2020, 2020, 2019, 2018, 2018], ("SUSTAINED", "2018-2025")),
        ([2023, 2021, 2020], ("DECLINING", "2020-2023")),
        ([None, 2026, 2025, 2024], ("EMERGING", "2024-2026")),
    ],
)
def test_trend_status(spark, years, want):
    assert trend(spark, years) == [want]


def test_topics_without_any_and_ties(spark):
    rows = [("p", "a", 1, 2020, "t", [], ["general"]), ("p", "b", 2, 2021, "t", ["y", "x"], ["physics", "cs"]), ("p", "c", 3, 2022, "t", ["x", "y"], [])]
    w = spark.createDataFrame(rows, WORKS)
    by = topics.works_by_topic(w)
    assert {(r["topic"], r["work_id"]) for r in by.collect()} == {("未分类", "a"), ("y", "b"), ("x", "b"), ("x", "c"), ("y", "c")}
    assert topics.dominant_discipline(w).first()["discipline"] == "cs"
    assert topics.dominant_discipline(w, 3).count() == 0


def test_guess_needs_a_keyword_and_follows_label_order(spark):
    t = spark.createDataFrame([(1, "临床 算法"), (2, "算法 医学 临床"), (3, "无")], "id int, text string")
    got = {r["id"]: r["discipline"] for r in topics.guess_discipline(t, {"medicine": ["临床", "医学"], "cs": ["算法"]}).collect()}
    assert got == {1: "cs", 2: "medicine", 3: None}


FACTS = "student_id string, fact_id string, field string, value string, status string, user_confirmed boolean"
MATS = "professor_id string, pos int, kind string, topic string, evidence_id string"


@pytest.fixture(scope="module")
def world(spark):
    facts = spark.createDataFrame(
        [
            ("skill", "f1", "skill", "RAG", "FACT", True), ("interest", "f1", "interest", "信息检索", "FACT", True), ("none", "f1", "skill", "油画", "FACT", True),
            ("unsure", "f1", "skill", "RAG", "FACT", False), ("near", "f1", "interest", "图谱知识 graph", "FACT", True),
        ],
        FACTS,
    )
    mats = spark.createDataFrame(
        [
            ("full", 0, "declared", "信息检索", "e1"), ("full", 1, "observed", "检索增强生成", "e2"), ("full", 2, "text", "A paper", "e3"),
            ("papers", 0, "text", "知识图谱 graph", "e4"),
        ],
        MATS,
    )
    profs = spark.createDataFrame([("full", True, "陆伟"), ("papers", True, "P"), ("empty", True, "E"), ("anon", False, "A")], "professor_id string, identity_confirmed boolean, name string")
    req = spark.createDataFrame([(s, p) for s in ("skill", "interest", "none", "unsure", "near") for p in ("full", "papers", "empty", "anon")], "student_id string, professor_id string")
    return req, facts, profs, mats


def test_match_report_levels(world):
    req, facts, profs, mats = world
    hits = fit.term_matches(req, facts, mats)
    near = fit.semantic_fallback(req, facts, mats, hits)
    out = fit.match_report(req, facts, profs, mats, hits, near)
    got = {(r["student_id"], r["professor_id"]): (r["research_fit"], r["evidence_sufficiency"], r["recommendation"]) for r in out.collect()}
    assert got[("skill", "full")] == ("STRONG", "HIGH", "WORTH_CONTACTING")  # a synonym of the second topic
    assert got[("interest", "full")] == ("PARTIAL", "HIGH", "LEARN_MORE")
    assert got[("none", "full")] == ("WEAK", "HIGH", "LOW_PRIORITY")
    assert got[("near", "papers")] == ("PARTIAL", "MEDIUM", "LEARN_MORE") and got[("skill", "papers")][0] == "WEAK"
    for pair in (("unsure", "full"), ("skill", "empty"), ("skill", "anon")):
        assert got[pair] == ("UNKNOWN", "LOW", "INSUFFICIENT_EVIDENCE")
    gaps = {tuple(r) for r in fit.topic_gaps(out, mats, hits, near).collect()}
    assert ("skill", "full", "信息检索") in gaps and ("skill", "full", "检索增强生成") not in gaps
    assert {g[2] for g in gaps if g[0] == "none"} == {"信息检索", "检索增强生成"}
    assert not [g for g in gaps if g[0] == "unsure"]


def test_invariants_metric(world):
    req, facts, profs, mats = world
    one = req.where("student_id = 'interest' AND professor_id = 'full'")
    other = req.where("student_id = 'none' AND professor_id = 'full'")

    def run(r):
        hits = fit.term_matches(r, facts, mats)
        rep = fit.match_report(r, facts, profs, mats, hits)
        return rep, fit.topic_gaps(rep, mats, hits)

    got = fit.match_invariants(run(one)[0], run(one)[0], run(one)[1], run(other)[1])
    assert {r["key"]: r["value"] for r in got.collect()} == {"match.determinism": 1.0, "match.monotonic": 1.0}


def test_draft_names_newest_papers_and_sources(world):
    req, facts, profs, mats = world
    pubs = mats.sparkSession.createDataFrame(
        [("full", i, f"t{i}", y, f"v{i}") for i, y in enumerate([2019, None, 2024, 2021, 2022])], "professor_id string, seq int, title string, year int, evidence_id string"
    )
    tops = mats.where("kind IN ('declared', 'observed')")
    d = fit.template_draft(req.where("student_id = 'skill' AND professor_id = 'full'"), facts, profs, tops, pubs, paper_read=True, named_topics=3, named_papers=3).orderBy("idx").collect()
    assert [r["sentence_type"] for r in d] == ["GENERIC", "GENERIC", "STUDENT_FACT", "GENERIC", "PROFESSOR_FACT", "PROFESSOR_FACT", "PROFESSOR_FACT", "GENERIC", "GENERIC"]
    assert d[5]["text"] == "您近年发表了《t2》、《t4》、《t3》等成果。" and d[5]["refs"] == ["v2", "v4", "v3"] and d[6]["refs"] == ["v2"]


def test_draft_keeps_the_order_of_many_facts_and_names_everything(spark):
    req = spark.createDataFrame([("s", "p")], "student_id string, professor_id string")
    facts = spark.createDataFrame([("s", f"fact_{i}", "skill", f"w{i}", "FACT", True) for i in range(12)], "student_id string, fact_id string, field string, value string, status string, user_confirmed boolean")
    profs = spark.createDataFrame([("p", "Prof", True)], "professor_id string, name string, identity_confirmed boolean")
    tops = spark.createDataFrame([("p", i, f"t{i}", f"e{i}", "declared" if i < 2 else "observed") for i in range(5)], "professor_id string, pos int, topic string, evidence_id string, kind string")
    pubs = spark.createDataFrame([("p", 0, "x", 2020, "v0")], "professor_id string, seq int, title string, year int, evidence_id string")
    d = {r["idx"]: r for r in fit.template_draft(req, facts, profs, tops, pubs).collect()}
    assert d[2]["refs"] == [f"fact_{i}" for i in range(12)] and "、".join(f"w{i}" for i in range(12)) in d[2]["text"]
    assert d[4]["refs"] == ["e2", "e3", "e4", "e0", "e1"]


def test_claim_errors(spark):
    claims = spark.createDataFrame(
        [
            (1, "trend", "SUPPORTED", ["ok", "unsure", "ghost"]), (2, "team_size", "SUPPORTED", ["ok"]), (3, "recruiting", "UNKNOWN", []),
            (4, "generic", "SUPPORTED", ["unsure"]), (5, "trend", "INFERRED", ["unsure"]), (6, "generic", "SUPPORTED", [""]),
        ],
        "claim_id int, claim_type string, status string, evidence_ids array<string>",
    )
    ev = spark.createDataFrame([("ok", "CONFIRMED"), ("unsure", None)], "id string, author_resolution_status string")
    errors = grounding.validate_claims(claims, ev)
    assert sorted((r["claim_id"], r["code"]) for r in errors.collect()) == [
        (1, "AUTHOR_NOT_CONFIRMED"), (1, "UNKNOWN_EVIDENCE_ID"), (2, "AFFIRMATIVE_UNKNOWN_FIELD"), (6, "UNKNOWN_EVIDENCE_ID"),
    ]
    assert {r["claim_id"] for r in grounding.surviving_claims(claims, errors).collect()} == {3, 4, 5}
    gold = claims.select("claim_id", F.col("claim_id").isin(3, 4, 6).alias("expected_valid"))
    got = {r["key"]: r["value"] for r in evaluate.claim_scores(claims, errors, gold).collect()}
    assert got["claims.unsupported_detected"] == 3.0 and abs(got["claims.accuracy"] - 4 / 6) < 1e-9


def test_draft_checks_coverage_and_pruning(spark):
    s = spark.createDataFrame(
        [
            ("d", 0, "拜读您的论文，深感震撼", "GENERIC", [], []), ("d", 1, "x", "PROFESSOR_FACT", [], ["e1", "e2"]), ("d", 2, "x", "PROFESSOR_FACT", [], ["e1"]),
            ("d", 3, "x", "PROFESSOR_FACT", [], []), ("d", 4, "x", "STUDENT_FACT", ["f1"], []), ("d", 5, "我读过论文", "STUDENT_FACT", ["f2"], []),
            ("e", 0, "hello", "GENERIC", [], []),
        ],
        "draft_id string, idx int, text string, sentence_type string, fact_ids array<string>, evidence_ids array<string>",
    )
    facts, ev = spark.createDataFrame([("f1",)], "id string"), spark.createDataFrame([("e1",)], "id string")
    errors = grounding.validate_draft(s, facts, ev)
    assert sorted((r["idx"], r["code"]) for r in errors.collect()) == [
        (0, "PAPER_READ_UNCONFIRMED"), (0, "UNCONFIRMED_FLATTERY"), (0, "UNCONFIRMED_FLATTERY"), (1, "UNKNOWN_EVIDENCE_ID"),
        (3, "PROFESSOR_FACT_WITHOUT_EVIDENCE"), (5, "PAPER_READ_UNCONFIRMED"), (5, "UNCONFIRMED_STUDENT_FACT"),
    ]
    cov = {r["draft_id"]: (round(r[1], 3), r[2]) for r in grounding.draft_coverage(s, facts, ev).collect()}
    assert cov == {"d": (0.333, 0.5), "e": (1.0, 1.0)}
    kept = grounding.prune_draft(s, errors)
    assert sorted(r["idx"] for r in kept.where("draft_id = 'd'").collect()) == [2, 4]
    assert grounding.validate_draft(kept, facts, ev).count() == 0


def test_points_lose_bad_references_or_fall(spark):
    p = spark.createDataFrame(
        [(1, "method_match", " a ", ["f1", "fx"], ["ex", "e1"]), (2, "method_match", "b", ["fx"], ["e1"]), (3, "background_gaps", "c", [], ["e1"]), (4, "background_gaps", " ", [], ["e1"]), (5, "background_gaps", "d", [], ["ex"])],
        "point_id int, section string, text string, fact_ids array<string>, evidence_ids array<string>",
    )
    out = grounding.sanitize_points(p, spark.createDataFrame([("f1",)], "id string"), spark.createDataFrame([("e1",)], "id string"))
    assert {r["point_id"]: (r["text"], r["fact_ids"], r["evidence_ids"]) for r in out.collect()} == {1: ("a", ["f1"], ["e1"]), 3: ("c", [], ["e1"])}


def test_scores_guard_zero_and_gates_follow_direction(spark, tmp_path):
    gold = spark.createDataFrame([(1, "exclude"), (2, "exclude")], "item_id int, expected string")
    pred = spark.createDataFrame([(1, False), (2, False)], "item_id int, belongs boolean")
    r = evaluate.disambiguation_scores(pred, gold).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"]) == (2, 0.0, 0.0, 0.0)
    m = spark.createDataFrame([("up", 0.9, True, 0.9), ("down", 1.0, False, 0.0), ("free", 0.1, True, None)], "key string, value double, higher_is_better boolean, gate double")
    gated = evaluate.metric_gates(m)
    assert {r["key"]: r["passed"] for r in gated.collect()} == {"up": True, "down": False, "free": True}
    assert not evaluate.gates_passed(gated).first()[0]
    evaluate.save_baseline(m.withColumn("value", F.col("value") + F.when(F.col("key") == "up", 0.05).otherwise(-0.5)).where("key <> 'free'"), str(tmp_path / "b"))
    cmp = {r["key"]: (r["regressed"], r["new"]) for r in evaluate.compare_to_baseline(m, evaluate.load_baseline(spark, str(tmp_path / "b"))).collect()}
    assert cmp == {"up": (True, False), "down": (True, False), "free": (False, True)}


def test_profile_facts_and_ledger(spark):
    from scholarmatch.operators import ledger

    t = spark.createDataFrame(
        [("p1", True, "p1", "陆伟", "武汉大学", " ", None, ["检索"], "https://w.edu/~lu/"), ("p2", False, "p2", "X", "Y", "", "", [], None)],
        "target_id string, identity_confirmed boolean, id_prefix string, name string, institution string, department string, title string, declared_interests array<string>, homepage string",
    )
    w = spark.createDataFrame(
        [("p1", 1, "A", 2020, "abs", "http://a", "万方", True), ("p1", 2, "B", None, "abs", "http://b", "?", False), ("p1", 3, "C", 2021, "abs", "http://c", "知网", True), ("p1", 4, "D", 2021, " ", "", "知网", True), ("p2", 5, "E", 2021, "abs", "http://e", "知网", True)],
        "target_id string, seq long, title string, year int, abstract string, source_url string, source_platform string, user_confirmed boolean",
    ).withColumns({"topics": F.array(F.lit("检索")), "authors": F.array(F.lit("陆伟"))})
    works, evidence, sources, missing = ledger.evidence_ledger(t, w)
    ids = sorted(r["id"] for r in works.collect())
    assert [i.rsplit("_", 1)[0] for i in ids] == ["manual_p1_1", "manual_p1_2"]
    ev = {r["title"]: (r["source_type"], r["source_tier"]) for r in evidence.collect()}
    assert ev == {"陆伟的导师资料": ("user_confirmed_profile", 1), "A": ("万方检索", 2), "C": ("知网", 2)}
    assert sources.count() == 3 and sorted(r["missing"] for r in missing.collect()) == ["摘要", "来源链接"]
    people = t.select(F.col("target_id").alias("person"), "name", "institution", "department", "title", F.lit(None).cast("string").alias("email"), "homepage", "declared_interests")
    prof, tops, pubs = fit.assemble_profile(people, works.select(F.col("target_id").alias("person"), F.col("id").alias("work_id"), "seq", "year", "title", "topics"), 2021)
    facts = {(r["person"], r["field"]) for r in fit.asserted_fields(prof).collect()}
    assert facts == {("p1", "name"), ("p1", "institution"), ("p2", "name"), ("p2", "institution")}
    assert fit.unbacked_fields(fit.asserted_fields(prof), evidence).select("person").distinct().collect()[0][0] == "p2"
    assert prof.where("person = 'p1'").first()["latest_publication"] == "2021"


def test_coverage_prefers_stated_then_guessed_then_learned(spark):
    from scholarmatch.operators import ledger

    t = spark.createDataFrame([("a", "physics", "cs"), ("b", None, "medicine"), ("c", None, None), ("d", "nonsense", None)], "target_id string, stated_discipline string, guessed_discipline string")
    w = spark.createDataFrame([(x, i, "openalex", ["cs"]) for x in "ac" for i in range(3)] + [("d", 9, "arxiv", ["cs"])], "target_id string, seq long, source_platform string, disciplines array<string>")
    out = ledger.source_coverage(t, w)
    assert {r["target_id"]: r["discipline"] for r in out.collect()} == {"a": "physics", "b": "medicine", "c": "cs", "d": "general"}
    got = {(r["target_id"], r["source"]): (r["status"], r["n"], r["rank"]) for r in out.collect()}
    assert got[("b", "europepmc")] == ("empty", 0, 1) and got[("a", "openalex")] == ("ok", 3, 1) and got[("a", "arxiv")] == ("empty", 0, 2)
    assert got[("c", "dblp")][0] == "disabled" and got[("c", "wanfang")][0] == "no_key" and got[("c", "europepmc")][0] == "not_covering"
    zh = ledger.source_coverage(t, w, keys=("wanfang_app_key",), language="zh")
    assert {r["source"] for r in zh.where("rank > 0").collect()} == {"wanfang"}


def test_first_fitting_author_record(spark):
    from scholarmatch.operators import people

    e = spark.createDataFrame([("t", 2, "b", ["Wuhan University"]), ("t", 1, "a", ["MIT"]), ("t", 3, "c", ["wuhan university lab"]), ("u", 1, "z", ["MIT"])], "target_id string, seq int, id string, institutions array<string>")
    t = spark.createDataFrame([("t", "WUHAN University"), ("u", "Fudan")], "target_id string, institution string")
    assert [tuple(r) for r in people.pick_first_author(e, t).collect()] == [("t", "b")]


def test_letters_are_signed_with_the_name_or_as_somebody(world):
    req, facts, profs, mats = world
    tops, pubs = mats.where("kind = 'declared'"), mats.limit(0).selectExpr("professor_id", "pos AS seq", "topic AS title", "1 AS year", "evidence_id")
    names = mats.sparkSession.createDataFrame([("skill", "林一"), ("none", "  ")], "student_id string, name string")
    rows = fit.template_draft(req.where("professor_id = 'full'"), facts, profs, tops, pubs, students=names).where("idx = 1").collect()
    said = {r["student_id"]: r["text"] for r in rows}
    assert said["skill"].startswith("我是林一，") and said["none"].startswith("我是一名学生，") and said["near"].startswith("我是一名学生，")
    heads = fit.draft_headers(req).collect()
    assert len(heads) == req.count() and {r["subject"] for r in heads} == {"咨询研究与招生机会"}


def test_growing_sides_are_joined_by_shuffle(spark):
    """Facts, materials and professors look small by their files; none of them may pass through the driver."""
    import re

    from scholarmatch.plans import insight

    sf = "/root/testdata/sf0.001"
    requests, facts, professors, materials = insight._inputs(spark, sf)
    hits = fit.term_matches(requests, facts, materials, insight.SYNONYMS)
    report = fit.match_report(requests, facts, professors, materials, hits)
    letters = fit.template_draft(requests, facts, professors, materials.where("kind = 'declared'"), materials.selectExpr("professor_id", "pos AS seq", "topic AS title", "2000 AS year", "evidence_id"))
    for rows in (hits, report, letters, fit.topic_gaps(report, materials, hits), fit.match_dimensions(report, facts, hits)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not re.findall(r"Broadcast(?:HashJoin|NestedLoopJoin) \[(?:student_id|professor_id|l_orderkey)[^\n]*", plan)


def test_what_reports_share_is_made_once(spark):
    """The plans of reports and near terms start from written rows; each further copy of the joins costs the driver memory."""
    from scholarmatch.plans import insight

    sf = "/root/testdata/sf0.001"
    reports = insight.match_report(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in reports and "student_id" in reports
    near = insight.semantic_fallback(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in near and "p_partkey" not in near and "topic_key" in near


def shuffled_columns(df):
    """The columns of every exchange of the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)


def test_letters_are_made_without_shuffling_their_sentences(spark):
    requests = spark.createDataFrame([(s, p) for s in ("a", "b", "none") for p in ("x", "y", "gone", "bare")] + [("a", "x")], "student_id string, professor_id string")
    facts = spark.createDataFrame(
        [("a", "f10", "skill", "C", "FACT", True), ("a", "f2", "skill", "B", "FACT", True), ("a", "f3", "interest", "I", "FACT", True), ("b", "f1", "interest", "J", "FACT", True), ("b", "f4", "skill", "K", "FACT", False)],
        "student_id string, fact_id string, field string, value string, status string, user_confirmed boolean",
    )
    people = spark.createDataFrame([("x", True, "X"), ("y", True, "Y"), ("bare", True, "Z")], "professor_id string, identity_confirmed boolean, name string")
    tops = spark.createDataFrame([("x", 0, "T", "e1"), ("gone", 0, "G", "e9")], "professor_id string, pos int, topic string, evidence_id string")
    papers = spark.createDataFrame([("x", 1, "Old", 1999, "w1"), ("x", 2, "New", 2020, "w2"), ("y", 1, "Only", None, "w3")], "professor_id string, seq int, title string, year int, evidence_id string")
    draft = fit.template_draft(requests, facts, people, tops, papers, paper_read=True)
    assert not [c for c in shuffled_columns(draft) if "text#" in c or "refs#" in c]
    letters = {}
    for r in draft.collect():
        letters.setdefault((r["student_id"], r["professor_id"]), {})[r["idx"]] = (r["sentence_type"][0], tuple(r["refs"]))
    g, both = ("G", ()), {"a": [("S", ("f2", "f10")), ("S", ("f3",)), ("G", ())], "b": [("S", ("f1",)), ("G", ())], "none": []}
    theirs = {"x": [("P", ("e1",)), ("P", ("w2", "w1")), ("P", ("w2",))], "y": [("P", ("w3",)), ("P", ("w3",))], "gone": [("P", ("e9",))], "bare": []}
    for (s, p), letter in letters.items():
        want = ([] if p == "gone" else [g]) + [g] + both[s] + theirs[p] + [g, g]
        assert [letter[i] for i in range(len(letter))] == want, (s, p)
    assert len(letters) == 12


def test_checks_of_letters_do_not_shuffle_texts(spark):
    s = spark.createDataFrame([("d", 0, "x", "PROFESSOR_FACT", [], ["e1", None])], "draft_id string, idx int, text string, sentence_type string, fact_ids array<string>, evidence_ids array<string>")
    ids = spark.createDataFrame([("e1",)], "id string")
    errors = grounding.validate_draft(s, ids, ids)
    assert not [c for c in shuffled_columns(errors) if "text#" in c]
    assert [tuple(r) for r in errors.collect()] == [("d", 0, "UNKNOWN_EVIDENCE_ID", "")]


def test_invariants_are_counted_one_after_another(spark):
    """Repeated and null rows count as often as they stand; the plan left has no shuffle of reports."""
    def reports(*rows):
        return spark.createDataFrame(list(rows), "student_id string, professor_id string, topic_summary string")

    a, b, none = ("s", "p", "x"), ("s", "q", None), reports(("s", "p", "x")).limit(0)
    one, two = spark.range(1).selectExpr("id AS topic"), spark.range(2).selectExpr("id AS topic")

    def values(first, second, related, unrelated):
        found = fit.match_invariants(first, second, related, unrelated)
        assert not [c for c in shuffled_columns(found) if "topic" in c]
        return {r["key"].split(".")[1]: r["value"] for r in found.collect()}

    assert values(reports(a, b, b), reports(b, a, b), one, two) == {"determinism": 1.0, "monotonic": 1.0}
    assert values(reports(a, b, b), reports(a, a, b), two, two) == {"determinism": 0.0, "monotonic": 0.0}
    assert values(none, none, one.limit(0), one) == {"determinism": 1.0, "monotonic": 1.0}
    assert values(none, reports(b), one, one.limit(0)) == {"determinism": 0.0, "monotonic": 0.0}
