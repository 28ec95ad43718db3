"""Catalog rules on hand rows, Chinese dictionaries included."""

import pytest
from pyspark.sql import functions as F

from scholarmatch.functions.scale import literal_table
from scholarmatch.operators import catalog as ops
from scholarmatch.sources import roster as roster_source

ROOTS = ("师资", "服务", "导师", "学院", "教师", "宣传", "研究", "资料")
FIELDS = (
    "seq long, source string, university string, department string, name string, note string, title string, email string, "
    "research_directions array<string>, research_areas array<string>, publications array<string>, homepage_url string, profile_text string, "
    "orcid string, openalex_id string, school_cate string, source_url string, retrieved_at string, content_hash string"
)


def arrival(seq, source, name="张三", **f):
    base = dict(
        seq=seq, source=source, university="U", department="D", name=name, note="", title="", email="", research_directions=[], research_areas=[],
        publications=[], homepage_url="", profile_text="", orcid="", openalex_id="", school_cate="", source_url="", retrieved_at="", content_hash="",
    )
    return {**base, **f}


def test_upsert_fills_gaps_only_and_notes_where_from(spark):
    rows = [
        arrival(2, "official", title="教授", email="o@u.edu", source_url="https://a"),
        arrival(1, "manual", title="讲师", source_url="manual", research_directions=[]),
        arrival(3, "community", email="c@x", research_directions=["d"], source_url="https://b"),
        arrival(4, "official", name="李四"),
    ]
    out = {r["name"]: r for r in ops.catalog_upsert(None, spark.createDataFrame(rows, FIELDS)).collect()}
    z = out["张三"]
    assert (z["title"], z["email"], z["research_directions"], z["source_url"]) == ("讲师", "o@u.edu", ["d"], "https://a")
    assert z["field_sources"] == {"title": "manual", "email": "official", "research_directions": "community"}
    assert z["sources"] == ["manual", "official", "community"] and out["李四"]["sources"] == ["official"]


def test_upsert_in_two_steps_equals_one(spark):
    rows = [arrival(i, s, name=f"n{i % 3}", title=t) for i, (s, t) in enumerate([("a", ""), ("b", "x"), ("c", "y"), ("a", "z"), ("d", ""), ("b", "q")])]
    df = lambda part: spark.createDataFrame(part, FIELDS)
    whole = ops.catalog_upsert(None, df(rows)).orderBy("name").collect()
    stepped = ops.catalog_upsert(ops.catalog_upsert(None, df(rows[:3])), df(rows[3:])).orderBy("name").collect()
    assert whole == stepped


def test_same_person_in_two_departments_stays_two(spark):
    rows = [arrival(1, "a"), {**arrival(2, "a"), "department": "E"}]
    assert ops.catalog_upsert(None, spark.createDataFrame(rows, FIELDS)).count() == 2


@pytest.mark.parametrize(
    "raw, clean, verdict",
    [
        ("董陇军副教授", "董陇军", "keep"), ("工研院胡耀武", "胡耀武", "keep"), ("薛 渊", "薛渊", "keep"), ("何鹏职称", "何鹏", "keep"),
        ("郭新闻", "郭新闻", "keep"), ("方向忠", "方向忠", "keep"), ("张学工", "张学工", "keep"), ("黄军教授", "黄军", "keep"),
        ("师资队伍", "师资队伍", "delete"), ("全部导师", "全部导师", "delete"), ("计算机学院大部分老师", "大部分", "delete"),
        ("Kok-Meng Lee", None, "foreign"), ("CYC", None, "delete"), ("", "", "delete"), ("王", "王", "delete"),
    ],
)
def test_name_verdicts(spark, raw, clean, verdict):
    df = spark.createDataFrame([("U", "D", raw)], "university string, department string, name string")
    r = ops.name_quality(df, ROOTS).first()
    assert r["verdict"] == verdict and (clean is None or r["clean_name"] == clean)


def test_cleaning_keeps_people_and_merges_twins(spark):
    rows = [
        arrival(1, "manual", name="黄军", title="教授"), arrival(2, "official", name="黄军教授", title="教授", email="h@u.edu", homepage_url="x"),
        arrival(3, "official", name="李杰老师"), arrival(4, "official", name="John Smith"),
    ]
    cat = ops.catalog_upsert(None, spark.createDataFrame(rows, FIELDS))
    out, counts = ops.normalize_names(cat, ops.clean_person_name)
    got = {r["name"]: (r["email"], r["sources"]) for r in out.collect()}
    assert got["黄军"] == ("h@u.edu", ["official", "manual"]) and "李杰" in got and len(got) == 3
    assert tuple(counts.first()) == (1, 1)


def test_roster_loading_and_official_pass(spark):
    raw = literal_table(
        spark, ("seq", "payload"),
        [
            (1, '{"data": [{"university": "U", "department": "D", "supervisor": "周裕(深圳,千人计划)", "rate": "4.5", "desc": "", "description": ""}]}'),
            (2, '[{"university": " U ", "department": "D", "supervisor": "Re: 周裕", "rate": null, "description": "ok"}, 7, {"university": "", "supervisor": "x"}]'),
            (3, '{"university": "U", "department": "E", "supervisor": "周裕", "rate": "bad"}'), (4, "not json"),
        ],
    )
    items = roster_source.unwrap_payloads(raw)
    entries = roster_source.load_roster(items)
    assert {(r["department"], r["supervisor"], r["note"]) for r in entries.collect()} == {("D", "周裕", "深圳,千人计划"), ("E", "周裕", "")}
    reviews = roster_source.load_reviews(items)
    assert sorted((r["rate"] or 0, r["detail"]) for r in reviews.collect()) == [(0, "ok"), (4.5, "")]
    crawl = spark.createDataFrame([("U", "E", "周裕", "n2"), ("U", "F", "新人", "")], "university string, department string, supervisor string, note string")
    both = ops.roster_upsert(ops.fresh_roster(entries), crawl, "official", "http://s", "t")
    rows = {r["department"]: (r["in_community"], r["in_official"], r["note"]) for r in both.collect()}
    assert rows == {"D": (True, False, "深圳,千人计划"), "E": (True, True, "n2"), "F": (False, True, "")}
    reset, marked = ops.clear_official_roster(both)
    assert reset.count() == 2 and marked.first()[0] == 2


def test_lookup_falls_back_in_order(spark):
    cat = spark.createDataFrame([("武汉大学", "A", "陆伟"), ("清华大学", "B", "陆伟"), ("北京大学", "C", "王五")], "university string, department string, name string")
    fac = spark.createDataFrame([("南京大学", "F", "赵六")], "university string, department string, name string")
    req = spark.createDataFrame(
        [(1, "陆伟", "武汉大学信息学院"), (2, "陆伟", "复旦大学"), (3, "赵六", "南京"), (4, "赵六", "北京"), (5, " 王五 ", None), (6, "", "x")],
        "request_id int, name string, university string",
    )
    got = sorted((r["request_id"], r["university"], r["origin"]) for r in ops.lookup_advisor(req, cat, fac).collect())
    assert got == [(1, "武汉大学", "catalog"), (2, "武汉大学", "homonym"), (2, "清华大学", "homonym"), (3, "南京大学", "faculty"), (5, "北京大学", "catalog")]


def test_field_report_priority_and_doubtful_mail(spark):
    rows = [
        (1, "rules", "email", "x@gmail.com"), (1, "manual", "email", " "), (1, "structured", "name", "S"), (1, "manual", "name", "M"),
        (1, "ai", "institution", "I"), (2, "manual", "email", "a@u.edu.cn"),
    ]
    rep = ops.field_report(spark.createDataFrame(rows, "entity int, source string, field string, value string"))
    got = {(r["entity"], r["field"]): (r["value"], r["status"], r["source"]) for r in rep.collect()}
    assert got[(1, "email")] == ("x@gmail.com", "INFERRED", "rules") and got[(1, "name")] == ("M", "CONFIRMED", "manual")
    assert got[(1, "institution")] == ("I", "CONFIRMED", "ai") and got[(2, "email")][1] == "CONFIRMED" and got[(2, "name")][1] == "UNKNOWN"
    assert {r["entity"]: r["missing_required"] for r in ops.field_report_summary(rep).collect()} == {1: 0, 2: 2}


def test_quality_metrics_notice_missing_people_and_residue(spark):
    cat = ops.catalog_upsert(None, spark.createDataFrame([arrival(1, "a", name="张学工", title="教授"), arrival(2, "a", name="师资队伍")], FIELDS))
    got = {r["key"]: r["value"] for r in ops.library_quality(cat, ROOTS, ("张学工", "何鹏")).collect()}
    assert got == {"library.advisors": 2.0, "library.ui_word_residue": 1.0, "library.must_survive_missing": 1.0, "library.field_fill_rate": 0.5}


def test_clear_source_drops_and_unmarks(spark):
    cat = ops.catalog_upsert(None, spark.createDataFrame([arrival(1, "official", name="a"), arrival(2, "official", name="b"), arrival(3, "manual", name="b")], FIELDS))
    kept, removed = ops.clear_source(cat, "official")
    assert [(r["name"], r["sources"]) for r in kept.collect()] == [("b", ["manual"])] and removed.first()[0] == 1
    assert ops.clear_source(cat, "official", "other")[0].count() == 2


def test_empty_table_quality(spark):
    rates = ops.field_fill_rates(ops.catalog_upsert(None, spark.createDataFrame([], FIELDS)))
    assert [r["field"] for r in rates.collect()] == ["_total"]


def test_identity_key_ignores_host_case_slash_and_query(spark):
    from scholarmatch.functions import text

    urls = ["https://U.edu/~a/", "HTTPS://u.edu/~a?x=1#y", "https://u.edu/~b", "https://u.edu"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(text.identity_key(F.col("u"))).collect()]
    assert got[0] == got[1] and len(set(got)) == 3 and all(g.startswith("prof_") and len(g) == 21 for g in got)


def test_rows_are_dealt_out_before_wide_sorts(spark):
    """A small file is scanned by one task; what it explodes to must not be sorted there."""
    from scholarmatch.plans import directory

    for name in ("catalog_upsert", "field_report"):
        plan = directory.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        dealt = max(i for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line)
        assert max(i for i, line in enumerate(lines) if "SortAggregate" in line) < dealt  # the plan is printed from its end


def test_narrow_rows_are_dealt_out_before_they_become_wide_arrivals(spark):
    """The task that scans a small file must not hold the three wide arrivals of all its rows."""
    from scholarmatch.plans import tables

    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    for given in (None, customers.where("c_custkey > 5")):
        rows = tables.catalog_batches(spark, "/root/testdata/sf0.001", customers=given)
        lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
        (explode,) = [i for i, line in enumerate(lines) if "Generate explode" in line]
        assert [i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line and i > explode]  # the plan is printed from its end
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
