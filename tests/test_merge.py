"""Paper merging against a plain sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from scholarmatch.functions import text
from scholarmatch.operators import merge

SCHEMA = (
    "seq long, id string, title string, year int, doi string, venue string, topics array<string>, citation_count long, "
    "abstract string, source_url string, source_platform string, authors array<string>, institution string, "
    "sources array<string>, disciplines array<string>"
)


def row(seq, title, year=None, doi=None, platform="A", sources=(), **more):
    base = dict(
        seq=seq, id=f"w{seq}", title=title, year=year, doi=doi, venue=None, topics=[], citation_count=None, abstract="",
        source_url=None, source_platform=platform, authors=[], institution="", sources=list(sources), disciplines=[],
    )
    return {**base, **more}


def model(rows):
    """Papers as lists of records: same DOI first, then the earliest paper of that title with a near year."""
    papers = []
    for r in sorted(rows, key=lambda x: x["seq"]):
        title = "".join(ch for ch in r["title"].lower() if ch.isalnum())
        if not r["title"].strip():
            continue
        by_doi = [p for p in papers if r["doi"] and r["doi"] in p["dois"]]
        by_title = [
            p for p in papers
            if title and p["title"] == title and (p["year"] is None or r["year"] is None or abs(p["year"] - r["year"]) < 2)
        ]
        home = (by_doi or by_title or [None])[0]
        if home is None:
            home = {"title": title, "year": None, "dois": set(), "members": []}
            papers.append(home)
        home["members"].append(r)
        home["dois"] |= {r["doi"]} - {None}
        home["year"] = r["year"] if home["year"] is None else home["year"]
    return papers


@pytest.mark.parametrize("seed", range(6))
def test_random_records_group_like_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    titles = ["Deep Graphs", "deep graphs!", "Intro", "intro.", "Other", "???", " "]
    rows = [
        row(i, rng.choice(titles), rng.choice([None, None, *range(2015, 2024)]), rng.choice([None, None, None, "10.1/a", "10.1/b", "10.1/c", "10.1/d"]))
        for i in range(120)
    ]
    # one title holds a third of everything
    rows += [row(1000 + i, "Intro", rng.choice([None, 2016, 2019, 2020]), rng.choice([None, f"10.2/{i}"])) for i in range(60)]
    rng.shuffle(rows)
    got = merge.merge_works(spark.createDataFrame(rows, SCHEMA).repartition(5)).select("seq", "n_records", "year").collect()
    want = {(p["members"][0]["seq"], len(p["members"]), p["year"]) for p in model(rows)}
    assert {tuple(r) for r in got} == want
    links = {(r["seq"], r["leader"]) for r in merge.merge_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert links == {(m["seq"], p["members"][0]["seq"]) for p in model(rows) for m in p["members"][1:]}


def merged(spark, *rows):
    return merge.merge_works(spark.createDataFrame(list(rows), SCHEMA)).orderBy("seq").collect()


def test_doi_spellings_are_one(spark):
    out = merged(spark, row(1, "A", doi="https://doi.org/10.1/X"), row(2, "B", doi="doi:10.1/x "), row(3, "C", doi="http://dx.doi.org/10.1/x"))
    assert [r["n_records"] for r in out] == [3]


def test_markup_width_and_punctuation_do_not_separate_titles(spark):
    out = merged(spark, row(1, "Deep <i>Graph</i> Nets: a survey"), row(2, "ｄｅｅｐ graph－nets a Survey"))
    assert len(out) == 1


def test_years_do_not_chain_and_far_years_stay_apart(spark):
    assert [r["n_records"] for r in merged(spark, row(1, "T", 2021), row(2, "T", 2022), row(3, "T", 2023))] == [2, 1]
    assert len(merged(spark, row(1, "T", 2018), row(2, "T", 2024))) == 2


def test_fields_take_the_fuller_value_and_lists_unite_in_order(spark):
    out = merged(
        spark,
        row(1, "T", None, "10.1/a", "P1", ["s0"], abstract="ab", authors=["x"], citation_count=3, topics=["t1", "t2"], venue=""),
        row(2, "T!!", 2020, None, "P2", ["s9", "s0"], abstract="abc", authors=["x", "y"], citation_count=None, topics=["t2", "t3"], venue="V"),
        row(3, "T", 2021, None, "P3", abstract="abd", authors=["q", "r"], citation_count=7, disciplines=["cs"], institution="I"),
    )[0]
    assert out["title"] == "T!!" and out["abstract"] == "abc" and out["authors"] == ["x", "y"]
    assert (out["year"], out["doi"], out["venue"], out["citation_count"], out["institution"]) == (2020, "10.1/a", "V", 7, "I")
    assert out["topics"] == ["t1", "t2", "t3"] and out["disciplines"] == ["cs"]
    # the starter's platform is noted when the second record joins, after that record's own sources
    assert out["sources"] == ["s0", "s9", "P1", "P2", "P3"]
    assert merged(spark, row(1, "Solo", platform="P1"))[0]["sources"] == ["P1"]
    assert merged(spark, row(1, "Solo", platform="P1", sources=["s"]))[0]["sources"] == ["s"]


def test_result_does_not_depend_on_partitioning(spark):
    rows = [row(i, f"t{i % 9}", 2000 + i % 7, f"10/{i % 13}" if i % 3 else None) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = set()
    for n in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = merge.merge_works(df.repartition(n).orderBy(F.rand(n))).orderBy("seq").collect()
        seen.add(str([r.asDict() for r in out]))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_title_key_folds_width(spark):
    got = spark.createDataFrame([("Ｆｕｌｌ　Width—Ａ",), (None,)], "t string").select(text.title_key("t")).collect()
    assert [r[0] for r in got] == ["fullwidtha", ""]


def test_only_wide_titles_go_to_python_and_few_at_a_time(spark):
    """ASCII titles stay in the JVM; the others are sent plainly, not in Arrow batches of up to 256 MB."""
    rows = [("Plain, Title",), ("Ｗｉｄｅ Title",), ("Größe ﬁn",), ("",), (None,), ("x" * 100_000,)]
    df = spark.createDataFrame(rows, "title string").select("title", text.title_key("title").alias("k"), text.nfkc("title").alias("n"))
    assert [(r["k"], r["n"]) for r in df.collect()] == [
        ("plaintitle", "Plain, Title"), ("widetitle", "Wide Title"), ("größefin", "Größe fin"), ("", ""), ("", None), ("x" * 100_000, "x" * 100_000)
    ]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
