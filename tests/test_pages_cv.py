"""Pages and CV texts on hand rows."""

import html
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from scholarmatch.functions import text
from scholarmatch.operators import cv, pages
from scholarmatch.plans import documents
from tests.oracle import run_pair


def one(spark, expr, value, name="v"):
    return spark.createDataFrame([(value,)], f"{name} string").select(expr).first()[0]


def test_text_drops_scripts_and_breaks_blocks(spark):
    doc = "<html><!-- x --><STYLE>a{}</STYLE><body>Hi&nbsp;there<p>a &amp;lt; b</p><div>c<br/>d</div><script>no()</script> <b>e</b></body>"
    assert one(spark, pages.html_text("v"), doc) == "Hi\xa0there\na &lt; b\nc\nd e"


@pytest.mark.parametrize("raw", ["&#65;&#x4e2d;&#20013;", "&quot;&middot;&copy;", "&amp;amp;", "&#128512;", "plain & simple", "&nosuch;"])
def test_unescape_agrees_with_the_standard_library(spark, raw):
    assert one(spark, pages.unescape(F.col("v")), raw) == html.unescape(raw)


BASES = ["https://a.edu/x/y.html?q=1#f", "http://a.edu", "https://a.edu/d/"]
HREFS = ["/p", "p", "./p", "../p", "../../p/./q", "?a=b", "#z", "", "//b.org/c", "https://c.d/e", "mailto:x@y", "p/", "..", "/a/../b", "p?x=../y"]


@pytest.mark.parametrize("base", BASES)
def test_links_resolve_like_a_browser(spark, base):
    df = spark.createDataFrame([(base, h) for h in HREFS], "b string, h string")
    got = {r["h"]: r["u"] for r in df.select("h", pages.resolve_url(F.col("b"), F.col("h")).alias("u")).collect()}
    assert {h: u for h, u in got.items() if u != urljoin(base, h)} == {}


def test_links_find_people(spark):
    doc = """<a href="/info/1.htm"> 陆 <b>伟</b> </a><a href='javascript:x'>no</a><a>none</a><a href="#t">t</a><a href=/info/2.htm>张三</a><a href="/news">新闻</a>"""
    df = spark.createDataFrame([(1, "https://u.edu/szdw/list.htm", doc)], "page_id int, url string, html string")
    rows = [(r["text"], r["href"], r["is_person"]) for r in pages.page_links(df).orderBy("pos").collect()]
    assert rows == [("陆 伟", "https://u.edu/info/1.htm", False), ("张三", "https://u.edu/info/2.htm", True), ("新闻", "https://u.edu/news", False)]


def fields(spark, doc):
    df = spark.createDataFrame([(1, doc)], "page_id int, html string")
    return {r["field"]: r["value"] for r in pages.page_structured_fields(df).collect()}


def test_structured_fields_prefer_people_and_survive_broken_json(spark):
    doc = """<script type="application/ld+json">{oops</script>
    <script type='application/ld+json'>[{"@type":["Thing"],"author":{"@graph":[{"@type":["Person","X"],"name":"陆伟","email":"mailto:l@whu.edu.cn",
    "worksFor":[{"name":""},{"name":"武汉大学"}],"knowsAbout":["a"," ","b "]}]}}]</script>
    <meta name="keywords" content="other"><meta property="og:title" content="别人 - 武汉大学">"""
    assert fields(spark, doc) == {"name": "陆伟", "email": "l@whu.edu.cn", "institution": "武汉大学", "declared_interests": "a、b"}


def test_meta_title_gives_a_short_name_only(spark):
    assert fields(spark, '<meta content="陆伟 - 武汉大学" property="og:title"/>') == {"name": "陆伟"}
    assert fields(spark, '<meta property="og:title" content="A very long headline - x">') == {}
    assert fields(spark, '<meta name="author" content=" 王五 "><meta name="author" content="x">') == {"name": "王五"}


def test_rule_fields(spark):
    body = "陆伟 副教授\n武汉大学信息管理学院\n邮箱 a.b@whu.edu.cn c@d.org\n研究方向：知识图谱\n教授" + "很" * 60
    df = spark.createDataFrame([(1, body)], "page_id int, text string")
    got = {r["field"]: r["value"] for r in pages.page_rule_fields(df).collect()}
    assert got == {"email": "a.b@whu.edu.cn", "department": "信息管理学院", "title": "副教授", "declared_interests": "知识图谱"}


@pytest.mark.parametrize(
    "card, want",
    [
        ("陈燕鸣武汉大学动力与机械学院副教授chenyanming@whu.edu.cn", ("陈燕鸣", "副教授", "chenyanming@whu.edu.cn")),
        ("程磊教授Lei.Cheng@whu.edu.cn", ("程磊", "教授", "Lei.Cheng@whu.edu.cn")),
        ("丁浩 武汉大学地球学院，副院长，教授", ("丁浩", "教授", "")),
        ("师资队伍", None),
        ("John Smith", ("JohnSmith", "", "")),
        ("x", None),
    ],
)
def test_cards(spark, card, want):
    df = spark.createDataFrame([(1, card)], "link_id int, text string")
    r = pages.card_link_fields(df, ("师资", "学院", "大学")).first()
    assert (None if r is None else (r["name"], r["title"], r["email"])) == want


def test_freshness_is_strict_and_hits_are_kept(spark):
    rows = [("u", "2024-01-01 00:00:00", "h1", 30, 2), ("u", "2024-01-02 00:00:00", "h2", 30, 1), ("v", "2024-01-01 00:00:00", "h", 30, 0)]
    f = spark.createDataFrame(rows, "url string, t string, content_hash string, ttl_days int, hits int").withColumn("fetched_at", F.to_timestamp_ntz("t"))
    got = {r["url"]: (r["fresh"], r["changed"], r["hits"]) for r in pages.page_freshness(f, "2024-01-31 00:00:00").collect()}
    assert got == {"u": (True, True, 3), "v": (False, False, 0)}


CV = """张三
邮箱 zs@pku.edu.cn 电话13800138000
北京大学 硕士
技能：python、PyTorch、机器学习
研究兴趣：信息检索
项目经历
# 检索系统：负责召回
短
• 检索系统：负责召回
获奖
奖学金一等
发表论文
A Study of Retrieval"""


def test_cv_facts_in_order_and_unconfirmed(spark):
    df = spark.createDataFrame([(1, CV)], "doc_id int, text string")
    rows = cv.cv_facts(df).collect()
    got = [(r["field"], r["value"]) for r in sorted(rows, key=lambda r: int(r["fact_id"][5:]))]
    assert got == [
        ("skill", "Python"), ("skill", "PyTorch"), ("skill", "机器学习"), ("skill", "信息检索"), ("degree", "硕士"), ("institution", "北京大学"),
        ("interest", "研究兴趣：信息检索"), ("project", "检索系统：负责召回"), ("publication", "A Study of Retrieval"),
    ]
    assert not any(r["user_confirmed"] for r in rows)


def test_redaction_kinds(spark):
    df = spark.createDataFrame([(1, CV, None), (2, "找李四13912345678901", "李四"), (3, "住在武汉市珞喻路", None)], "doc_id int, text string, who string")
    by_rule = {r["doc_id"]: (r["text"], r["kinds"]) for r in cv.pii_redact(df, surnames="张李王").collect()}
    assert "zs@pku" not in by_rule[1][0] and "138001" not in by_rule[1][0] and {"email", "phone", "name"} <= set(by_rule[1][1])
    named = {r["doc_id"]: (r["text"], r["kinds"]) for r in cv.pii_redact(df, name_col="who").collect()}
    assert named[2] == ("找[姓名已脱敏]13912345678901", ["name"]) and named[3][1] == ["address"]
    leaks = cv.pii_leak_audit(df.select(F.col("doc_id").alias("export_id"), "text")).collect()
    assert sorted((r["export_id"], r["kind"], r["n"]) for r in leaks) == [(1, "email", 1), (1, "phone", 1)]


def test_edits_replace_and_blank_rows_delete(spark):
    facts = cv.cv_facts(spark.createDataFrame([("s1", CV), ("s2", CV)], "doc_id string, text string")).withColumnRenamed("doc_id", "student_id")
    edits = spark.createDataFrame([("s1", 0, "skill", " Go "), ("s1", 1, "", "x"), ("s1", 2, "degree", " ")], "student_id string, idx int, field string, value string")
    out = cv.replace_facts(facts, edits)
    assert [(r["fact_id"], r["value"], r["user_confirmed"]) for r in out.where("student_id = 's1'").collect()] == [("fact_edit_0", "Go", True)]
    assert out.where("student_id = 's2'").count() == 9
    sure = cv.confirm_facts(facts, spark.createDataFrame([("s2", "fact_1")], "student_id string, fact_id string"))
    assert sure.where("user_confirmed").count() == 1


def test_digest_and_compact(spark):
    r = spark.sql("SELECT map('b', 'x y', 'a', repeat('z', 30)) m, 'one  two   three' t").select(text.digest_args("m"), text.compact("t", 9)).first()
    assert r[0] == "a=" + "z" * 24 + "…&b=x y" and r[1] == "one two…"


def test_references_without_semicolon_stay_where_asked(spark):
    df = spark.createDataFrame([(1, "u", "<p>a&amp&amp;b &am &lt;&#65;&copy &ampx;</p>")], "page_id long, url string, html string")
    assert pages.page_text(df).first()["text"] == "a&&b &am <A© &x;"
    assert pages.page_text(df, unclosed=False).first()["text"] == "a&amp&b &am <A&copy &ampx;"


def test_pages_that_share_an_address_have_a_record_each(spark, tmp_path):
    """Against the query's SQL, also where the address has no path, is no web address, or is missing."""
    rows = [(1, "http://u.edu/cs/a"), (2, "http://u.edu/cs/a"), (3, "http://u.edu"), (4, "ftp"), (5, None), (6, "https://v.edu?x=/y")]
    made = spark.createDataFrame([(i, u, f"<title>T</title><p>p{i} p{i}@u.edu</p>") for i, u in rows], "page_id long, url string, html string")
    made.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same, note, _ = run_pair(spark, str(tmp_path), documents.faculty_records, documents.ORACLES["faculty_records"], con)
    assert same and note == "rows=6", note
