"""Names, institutions, homonyms and identity on the awkward cases."""

import itertools

import pytest

from scholarmatch.operators import people as ops

ENTRIES = [
    "陆伟", "陆 伟", "陆伟明", "蒋春 Jiang Chun", "Wei Zhang", "Zhang, Wei", "W. Zhang", "W. Z.", "Zhang", "Wei Lü", "Lu, Wei",
    "WANG Xiao, LI Wei, ZHANG Bei", "LI Wei, ZHANG Bei", "Wei Zhang; Li Na", "Ouyang Nana", "Prof. Ouyang-Nana Jr", "ouyangnanax",
    "N. Ouyang", "Zhang Wei Ming", "José García", "Garcia J", "", " ", "Ｗｅｉ Ｚｈａｎｇ", "Madonna", "M.", "Jean-Paul Sartre", "J. P. Sartre", "J.-P. S.",
]
NAMES = ["陆伟", "蒋春", "Wei Zhang", "Wei Lu", "Bei Zhang", "Ouyang Nana", "Jose Garcia", "Madonna", "Jean-Paul Sartre", "Zhang Wei Ming", "Li Wei"]


def fits(name, entry):
    """All-pairs model of the name rule."""
    import re
    import unicodedata

    def fold(s):
        s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s)).lower()
        return "".join(c for c in s if not unicodedata.combining(c))

    def words(s):
        return [w for w in re.split(r"[\s\-–—.,;:·'’]+", fold(s)) if w]

    def han(s):
        return set(re.findall(r"[一-鿿]{2,}", "".join(s.split())))

    if han(name):
        return bool(han(name) & han(entry))
    parts = [p.strip() for p in re.split(r"[,;，；、|/]+", entry) if p.strip()]
    if len(parts) == 2 and max(len(words(p)) for p in parts) <= 1:
        parts = [entry]
    want = words(name)
    for person in parts:
        have = words(person)
        joined, target = "".join(have), "".join(want)
        if joined == target or (len(target) >= 8 and target in joined):
            return True
        left, ok = list(have), True
        for w in want:
            match = next((h for h in left if h == w or (len(h) == 1 and w[0] == h)), None)
            ok = ok and match is not None
            if match is not None:
                left.remove(match)
        if ok:
            return True
    return False


def test_blocking_loses_no_match(spark):
    entries = spark.createDataFrame([(e,) for e in ENTRIES], "entry string")
    names = spark.createDataFrame([(n,) for n in NAMES], "target_name string")
    got = {tuple(r) for r in ops.name_matches(entries, names).select("target_name", "entry").collect()}
    want = {(n, e) for n, e in itertools.product(NAMES, ENTRIES) if e.strip() and fits(n, e)}
    assert got == want


def test_author_match_takes_either_spelling(spark):
    works = spark.createDataFrame([(1, ["Wei Lü", "X Y"]), (2, ["陆伟明"]), (3, [])], "work_id int, authors array<string>")
    targets = spark.createDataFrame([("t", "陆伟", "Wei Lu")], "target_id string, name string, english_name string")
    assert [tuple(r) for r in ops.author_match(works, targets).collect()] == [(1, "t")]


@pytest.mark.parametrize(
    "paper, school, hit, conflict, agree",
    [
        ("Wuhan University, Dept", "武汉大学", True, False, False),
        ("武汉大学信息管理学院", "武汉大学", True, False, True),
        ("Fudan Univ", "武汉大学", False, False, False),
        ("复旦大学", "武汉大学", False, True, False),
        ("MIT", "Stanford", False, True, False),
        ("", "武汉大学", False, False, None),
        ("HUST", "华中科技大学", True, False, False),
        ("清华学院", "清华大学", False, True, True),
    ],
)
def test_institutions(spark, paper, school, hit, conflict, agree):
    c = spark.createDataFrame([("t", 1, paper)], "target_id string, work_id int, institution string")
    t = spark.createDataFrame([("t", school)], "target_id string, institution string")
    r = ops.institution_match(c, t).first()
    assert (r["hit"], r["conflict"], r["agree"]) == (hit, conflict, agree)


CAND = (
    "target_id string, work_id int, seq long, title string, authors array<string>, institution string, belongs boolean, "
    "needs_review boolean, disambig_reason string"
)


def test_fingerprint_only_acts_on_teams(spark):
    t = spark.createDataFrame([("a", "Me", "U1"), ("b", "You", "U1")], "target_id string, name string, institution string")
    rows = [
        ("a", 1, 1, "p", ["Me", "Pal"], "U1", True, False, ""),
        ("a", 2, 2, "q", ["Me", "Pal"], "U2", True, True, "x"),
        ("a", 3, 3, "r", ["Me", "Stranger"], "U2", True, True, "x"),
        ("b", 4, 4, "s", ["You", "Once"], "U2", True, True, "x"),
    ]
    out = {r["work_id"]: (r["belongs"], r["needs_review"]) for r in ops.fingerprint_prefilter(spark.createDataFrame(rows, CAND), t).collect()}
    assert out == {1: (True, False), 2: (True, True), 3: (False, False), 4: (True, True)}


def test_only_conflicting_papers_are_checked_for_coauthors(spark):
    """Rows of one work may differ, and the other rows pass by without a join on works."""
    t = spark.createDataFrame([("a", " Wei Z ", "U1"), ("b", "Bo L", "U1")], "target_id string, name string, institution string")
    rows = [
        ("a", 1, ["Wei Z", "Ann"], "U1", True, False, ""), ("a", 2, [" Ann", "Wei Z"], "U1", True, False, ""),
        ("a", 3, ["Cy"], "U2", True, True, "x"), ("a", 3, ["Ann"], "U1", True, False, ""),  # another row of the work backs it
        ("a", 4, ["Cy", "Dee"], "U2", True, True, "x"), ("a", 5, None, "U2", True, True, "x"), ("a", 6, ["Cy "], "U1", True, False, ""),
        ("a", 7, ["Dee"], "U2", None, True, "x"), ("a", 8, ["Eve"], "U2", False, True, "x"), ("b", 9, ["Ann"], "U2", True, True, "x"), ("z", 10, ["Ann"], "U2", True, True, "x"),
        ("a", 11, [None, "", "Wei Z"], "U2", True, True, "x"),
    ]
    schema = "target_id string, work_id int, authors array<string>, institution string, belongs boolean, needs_review boolean, disambig_reason string"
    found = ops.fingerprint_prefilter(spark.createDataFrame(rows, schema), t)
    got = sorted((r["work_id"], r["institution"], r["belongs"]) for r in found.collect())
    gone = {5, 11}  # Cy and Dee stand twice each, so 3, 4 are backed; b has no team, z is no target
    want = sorted((w, i, False if w in gone else b) for k, w, _, i, b, _, _ in rows if k != "z")
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "work_id#" in plan.toString()
    assert plan.children().apply(0).toString().count("Join ") == 1


def test_pick_author_prefers_name_and_school_and_may_pick_nobody(spark):
    t = spark.createDataFrame(
        [("a", "Wei Zhang", None, "U1"), ("b", "Wei Zhang", None, "U9"), ("c", "Wei Zhang", None, ""), ("d", "Nobody", None, "")],
        "target_id string, name string, english_name string, institution string",
    )
    hits = [
        (1, "x", "Zhang, Wei", 5, ["U1 Lab"]), (2, "y", "Other One", 50, ["U1"]), (3, "z", "W. Zhang", 9, ["U2"]), (4, "x", "Zhang, Wei", 99, ["U9"]),
    ]
    e = spark.createDataFrame(
        [(k, *h) for k in "abcd" for h in hits], "target_id string, seq int, id string, name string, works_count int, institutions array<string>"
    )
    out = {r["target_id"]: (r["author_id"], r["tier"]) for r in ops.pick_author(e, t).collect()}
    assert out == {"a": ("x", 1), "c": ("z", 3), "d": ("y", 4)}


def test_identity_rules(spark):
    t = spark.createDataFrame(
        [
            ("ok", "武汉大学", "", "a@whu.edu.cn", ["检索"], {"orcid": ""}),
            ("no", "武汉大学", "", "a@mail.com", [], {}),
            ("mixed", "武汉大学", "", "a@mail.com", [], {"orcid": "1"}),
            ("bare", "", "", "", [], {}),
        ],
        "target_id string, institution string, department string, email string, known_directions array<string>, scholar_ids map<string,string>",
    )
    page = spark.createDataFrame([("ok", "武汉大学信息管理学院", "", "")], "target_id string, page_institution string, page_department string, page_email string")
    papers = spark.createDataFrame([("ok", "", ["信息检索"])], "target_id string, institution string, topics array<string>")
    out = {r["target_id"]: (r["status"], r["score"]) for r in ops.assess_identity(t, page, papers).collect()}
    assert out == {"ok": ("CONFIRMED", 3), "no": ("REJECTED", -1), "mixed": ("REVIEW_REQUIRED", 0), "bare": ("REVIEW_REQUIRED", 0)}


def test_verdicts_come_before_the_coauthor_check_and_rows_are_joined_once(spark):
    t = spark.createDataFrame([("a", "Wei Z", "U1"), ("b", "Bo L", "U1")], "target_id string, name string, institution string")
    rows = [
        ("a", 1, 1, "", ["Wei Z", "Ann"], "U1", True, False, ""), ("a", 2, 2, "", ["Ann", "Wei Z"], "U1", True, False, ""),
        ("a", 3, 3, "", ["Cy"], "U2", True, True, "x"), ("a", 3, 4, "", ["Ann"], "U1", True, False, ""), ("a", 4, 5, "", ["Dee"], "U2", False, True, "x"),
        ("a", 5, 6, "", ["Eve"], "U2", True, True, "x"), ("a", 6, 7, "", None, "U2", None, True, "x"), ("b", 7, 8, "", ["Ann"], "U2", True, True, "x"), ("z", 8, 9, "", ["Ann"], "U2", True, True, "x"),
    ]
    said = [("a", 3, None, None, None), ("a", 4, True, False, "said"), ("a", 5, False, None, "no"), ("a", 6, None, False, None), ("b", 7, True, False, "said"), ("a", 99, True, True, "lost")]
    verdicts = spark.createDataFrame(said, "target_id string, work_id int, belongs boolean, needs_review boolean, reason string")
    c = spark.createDataFrame(rows, CAND)
    found = ops.apply_verdicts(c, verdicts, t)
    merged = ops.apply_verdicts(c, verdicts, t, fingerprint=False)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, ops.fingerprint_prefilter(merged, t).collect()))
    got = {r["seq"]: (r["belongs"], r["needs_review"]) for r in found.collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, True), 4: (True, False), 5: (False, False), 6: (False, True), 7: (None, False), 8: (True, False)}
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Join " not in plan.children().apply(0).toString()
