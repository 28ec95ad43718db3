"""Lists are whole unless a named parameter cuts them."""

from scholarmatch.operators import contacts, cv, merge, runs


def test_cv_lists_are_whole(spark):
    lines = [f"Project number {i}" for i in range(8)]
    text = "\n".join(["北京大学", "清华大学", "武汉大学", "复旦大学", "项目经历", *lines])
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [r["line"] for r in cv.section_facts(docs).orderBy("pos").collect()] == lines
    fields = [r["field"] for r in cv.cv_facts(docs).collect()]
    assert fields.count("institution") == 4 and fields.count("project") == 8
    fields = [r["field"] for r in cv.cv_facts(docs, max_schools=3, max_lines=5).collect()]
    assert fields.count("institution") == 3 and fields.count("project") == 5


def test_run_lists_are_whole(spark):
    steps = spark.createDataFrame([("r", 0, "tool_call", "x", "ok", "s" * 100, None)], "run_id string, idx int, kind string, name string, status string, summary string, error string")
    assert len(runs.trace_user_steps(steps).first()["detail"]) == 100
    asked = spark.createDataFrame([("r", i, f"S{i}", "error", 0, "x", 0.0) for i in range(5)], "run_id string, pos int, label string, status string, n int, reason string, cost double")
    assert runs.source_health(asked).first()["failed_labels"] == "S0、S1、S2、S3、S4"


def test_seeds_are_all_asked(spark):
    works = spark.createDataFrame([(i, f"Known title number {i}") for i in range(8)], "seq long, title string")
    seeds = spark.createDataFrame([("t", i, f"Known title number {i}") for i in range(8)], "target_id string, pos int, title string")
    none = works.limit(0).selectExpr("'t' AS target_id", "seq", "title")
    assert merge.title_fallback(none, seeds, works, works.limit(0)).count() == 8
    assert merge.title_fallback(none, seeds, works, works.limit(0), max_seeds=5).count() == 5


def test_contact_evidence_is_whole(spark):
    people = spark.createDataFrame([(p, p.upper(), "U", "历史系") for p in "ab"], "person string, name string, institution string, department string")
    shared = [(p, i, f"Title {i}", None, None, [f"Friend {j}" for j in range(7)]) for p in "ab" for i in range(5)]
    papers = spark.createDataFrame(shared, "person string, seq int, title string, doi string, source_url string, authors array<string>")
    pairs = spark.createDataFrame([("a", "b")], "left_id string, right_id string")
    said = contacts.collision_level(pairs, people, papers).first()["evidence"]
    assert all(f"Title {i}" in said for i in range(5)) and all(f"friend{j}" in said.replace(" ", "").lower() for j in range(7))
    short = contacts.collision_level(pairs, people, papers, shown_papers=2, shown_names=1).first()["evidence"]
    assert "Title 1" in short and "Title 2" not in short and len(short) < len(said)


def test_pairs_of_a_large_group_meet_by_tiles(spark):
    known = spark.createDataFrame([(f"p{i}",) for i in range(40)], "person string")
    groups = [(1, [f"p{i}" for i in range(25)] + ["stranger"]), (2, ["p1"]), (3, ["stranger"]), (4, ["p3", "p2", "p3"]), (5, [f"p{i}" for i in range(3, 40)])]
    df = spark.createDataFrame(groups, "group_id int, members array<string>")
    want = []
    for g, members in groups:
        own = [m for m in members if m != "stranger"]
        pairs = [(g, len(own), a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        want += pairs or ([(g, len(own), None, None)] if own else [])
    for tile in (256, 4):
        got = contacts.selected_pairs(df, known, tile=tile).select("group_id", "n_members", "left_id", "right_id").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
