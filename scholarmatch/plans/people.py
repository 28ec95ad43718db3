"""Author, institution and identity questions over all order lines."""

from pyspark.sql import functions as F

from scholarmatch.operators import people as ops
from scholarmatch.plans import tables
from scholarmatch.plans.tables import BATCHES, PEOPLE, load


def author_match(spark, sf):
    return ops.author_match(tables.line_papers(spark, sf), tables.suppliers(spark, sf)).distinct()


def institution_match(spark, sf):
    out = ops.institution_match(tables.candidates(spark, sf), tables.suppliers(spark, sf))
    return out.select("target_id", "work_id", "hit")


def institution_conflict(spark, sf):
    out = ops.institution_match(tables.candidates(spark, sf), tables.suppliers(spark, sf))
    return out.select("target_id", "work_id", "conflict")


def institution_agree(spark, sf):
    out = ops.institution_match(tables.candidates(spark, sf), tables.suppliers(spark, sf))
    return out.select("target_id", "work_id", "agree")


def institution_filter(spark, sf):
    return ops.institution_filter(tables.candidates(spark, sf), tables.suppliers(spark, sf)).select("target_id", "work_id")


def merge_institution_counts(spark, sf):
    return ops.institution_counts(tables.candidates(spark, sf))


def _search_hits(spark, sf):
    """Author records found for a supplier: the customers who ordered from it."""
    line = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    order = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    targets = tables.suppliers(spark, sf)
    names = targets.select(F.col("target_id").alias("l_suppkey"), F.col("name").alias("target_name"))
    hits = line.join(order, "l_orderkey").join(cust, "o_custkey").join(names, "l_suppkey")
    same = F.col("o_custkey") % 50 == F.col("l_suppkey") % 50
    entities = hits.select(
        F.col("l_suppkey").alias("target_id"),
        F.col("o_custkey").alias("seq"),
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("id"),
        F.when(same, F.col("target_name")).otherwise(F.concat(F.lit("Other Person"), F.col("o_custkey").cast("string"))).alias("name"),
        (F.col("o_custkey") % 97).alias("works_count"),
        F.array(F.concat(F.lit("Univ NATION_"), F.col("c_nationkey").cast("string"), F.lit(";"))).alias("institutions"),
    )
    # a delimiter after the number keeps NATION_1 from being found in NATION_12
    school = F.when(F.col("institution") == "", F.lit("")).otherwise(F.concat("institution", F.lit(";")))
    return entities, targets.withColumn("institution", school)


def pick_author(spark, sf):
    return ops.pick_author(*_search_hits(spark, sf))


def pick_first_author(spark, sf):
    return ops.pick_first_author(*_search_hits(spark, sf))


def rule_disambiguate(spark, sf):
    out = ops.rule_disambiguate(tables.candidates(spark, sf), tables.suppliers(spark, sf))
    return out.select("target_id", "work_id", "belongs", "needs_review", "disambig_reason")


def fingerprint_prefilter(spark, sf):
    t = tables.suppliers(spark, sf)
    out = ops.fingerprint_prefilter(ops.rule_disambiguate(tables.candidates(spark, sf), t), t)
    return out.select("target_id", "work_id", "belongs", "needs_review", "disambig_reason")


#: What the coauthor check looks at or the query returns: all columns it is given are written.
_CHECKED = ("target_id", "work_id", "authors", "institution", "belongs", "needs_review", "disambig_reason")


def apply_verdicts(spark, sf):
    t, c = tables.suppliers(spark, sf), tables.candidates(spark, sf)
    verdicts = c.where("l_returnflag = 'R'").select(
        "target_id",
        "work_id",
        (F.col("l_linestatus") == "F").alias("belongs"),
        (F.col("l_linenumber") > 4).alias("needs_review"),
        F.lit("model").alias("reason"),
    ).distinct()
    out = ops.apply_verdicts(ops.rule_disambiguate(c, t).select(*_CHECKED), verdicts, t)
    return out.select("target_id", "work_id", "belongs", "needs_review", "disambig_reason")


def affiliation_expansion(spark, sf):
    t, c = tables.suppliers(spark, sf), tables.candidates(spark, sf)
    index = c.select(
        "target_id",
        "seq",
        F.concat(F.lit("Extra "), F.col("l_partkey").cast("string")).alias("title"),
        "institution",
    )
    return ops.affiliation_expansion(ops.rule_disambiguate(c, t), t, index)


def affiliation_check(spark, sf):
    return ops.affiliation_check(tables.candidates(spark, sf), tables.suppliers(spark, sf))


def assess_identity(spark, sf):
    b = tables.catalog_batches(spark, sf)
    key = F.col("custkey")
    targets = b.where("source = 'manual'").select(
        key.alias("target_id"),
        F.when(key % 9 == 0, F.lit("")).otherwise(F.col("university")).alias("institution"),
        "department",
        "email",
        F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("department"))).alias("known_directions"),
        F.create_map(F.lit("orcid"), F.when(key % 6 == 0, F.col("name")).otherwise(F.lit(""))).alias("scholar_ids"),
    )
    page = b.where("source = 'official'").select(
        key.alias("target_id"),
        F.when(key % 5 == 0, F.lit("")).when(key % 7 == 0, F.lit("Elsewhere")).otherwise(F.col("university")).alias("page_institution"),
        F.when(key % 11 == 0, F.lit("ELSE")).otherwise(F.col("department")).alias("page_department"),
        F.col("email").alias("page_email"),
    )
    papers = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("target_id"),
        F.when(F.col("o_orderkey") % 8 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 25).cast("string")))
        .alias("institution"),
        F.when(F.col("o_orderkey") % 9 == 0, F.array(F.lit("machinery"), F.lit("")))
        .otherwise(F.array(F.lower("o_orderpriority")))
        .alias("topics"),
    )
    return ops.assess_identity(targets, page, papers)


_NAMES = (
    "author_match institution_match institution_conflict institution_agree institution_filter merge_institution_counts "
    "pick_author pick_first_author rule_disambiguate fingerprint_prefilter apply_verdicts affiliation_expansion affiliation_check assess_identity"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_RULED = """
ruled AS (
  SELECT *, true AS belongs0, conflict AS review0,
         CASE WHEN conflict THEN '机构与填写学校不同（' || inst || '），可能为曾任职单位' ELSE '' END AS reason0 FROM judged
)"""
_VERD = """
verd AS (
  SELECT r.*, CASE WHEN l_returnflag = 'R' THEN l_linestatus = 'F' ELSE belongs0 END AS belongs1,
         CASE WHEN l_returnflag = 'R' THEN k > 4 ELSE review0 END AS review1, CASE WHEN l_returnflag = 'R' THEN 'model' ELSE reason0 END AS reason1 FROM ruled r
)"""


def _prefilter(source: str, b: str, n: str, r: str) -> str:
    return f"""
mates AS (
  SELECT target_id, work_id, 'Li P' || l_partkey AS a FROM {source} UNION ALL SELECT target_id, work_id, 'Mo Q' || (l_orderkey % 1000) FROM {source}
),
stable AS (SELECT target_id, a FROM mates GROUP BY ALL HAVING count(*) >= 2),
backed AS (SELECT DISTINCT target_id, work_id FROM mates JOIN stable USING (target_id, a)),
judge AS (
  SELECT s.*, s.{b} AND s.conflict AND s.target_id IN (SELECT target_id FROM stable) AND bk.work_id IS NULL AS gone
  FROM {source} s LEFT JOIN backed bk ON bk.target_id = s.target_id AND bk.work_id = s.work_id
)
SELECT target_id, work_id, {b} AND NOT gone AS belongs, {n} AND NOT gone AS needs_review,
       CASE WHEN gone THEN '机构不符且合作者无交集，疑似同名' ELSE {r} END AS disambig_reason FROM judge"""


ORACLES = {
    "author_match": f"""WITH {PEOPLE} SELECT DISTINCT c.work_id, t.target_id FROM cand c JOIN sup t ON t.fam = c.fam
AND CASE WHEN c.k = 3 THEN left(t.given, 1) = left(c.given, 1) ELSE t.given = c.given END""",
    "institution_match": f"WITH {PEOPLE} SELECT target_id, work_id, inst <> '' AND school <> '' AND contains(lower(inst), lower(school)) AS hit FROM cand",
    "institution_conflict": f"WITH {PEOPLE} SELECT target_id, work_id, conflict FROM judged",
    "institution_agree": f"WITH {PEOPLE} SELECT target_id, work_id, agree FROM judged",
    "institution_filter": f"WITH {PEOPLE} SELECT target_id, work_id FROM cand WHERE inst = '' OR contains(inst, school) OR contains(school, inst)",
    "merge_institution_counts": f"WITH {PEOPLE} SELECT target_id, inst AS institution, count(*) AS n FROM cand WHERE inst <> '' GROUP BY ALL",
    "pick_author": f"""WITH {PEOPLE},
hits AS (SELECT DISTINCT l_suppkey AS target_id, o_custkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
tiers AS (
  SELECT h.target_id, o_custkey, o_custkey % 97 AS wc, CASE
    WHEN school = '' THEN CASE WHEN o_custkey % 50 = h.target_id % 50 THEN 3 ELSE 4 END
    WHEN school = 'NATION_' || c_nationkey THEN CASE WHEN o_custkey % 50 = h.target_id % 50 THEN 1 ELSE 2 END END AS tier
  FROM hits h JOIN sup USING (target_id)
)
SELECT target_id, 'A' || arg_min(o_custkey, (tier, -wc, o_custkey)) AS author_id, min(tier) AS tier FROM tiers WHERE tier IS NOT NULL GROUP BY target_id""",
    "pick_first_author": f"""WITH {PEOPLE},
hits AS (SELECT DISTINCT l_suppkey AS target_id, o_custkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT target_id, 'A' || min(o_custkey) AS author_id FROM hits JOIN sup USING (target_id) WHERE school = '' OR school = 'NATION_' || c_nationkey GROUP BY target_id""",
    "rule_disambiguate": f"WITH {PEOPLE}, {_RULED} SELECT target_id, work_id, belongs0 AS belongs, review0 AS needs_review, reason0 AS disambig_reason FROM ruled",
    "fingerprint_prefilter": f"WITH {PEOPLE}, {_RULED}, {_prefilter('ruled', 'belongs0', 'review0', 'reason0')}",
    "apply_verdicts": f"WITH {PEOPLE}, {_RULED}, {_VERD}, {_prefilter('verd', 'belongs1', 'review1', 'reason1')}",
    "affiliation_expansion": f"""WITH {PEOPLE}, {_RULED},
alt AS (SELECT target_id, inst, row_number() OVER (PARTITION BY target_id ORDER BY count(*) DESC, min(seq), inst) AS rk FROM ruled WHERE review0 AND inst <> '' AND inst <> school GROUP BY target_id, inst),
allp AS (SELECT target_id, title, '' AS note, [0, seq] AS o FROM cand
  UNION ALL SELECT c.target_id, 'Extra ' || c.l_partkey, '曾任职单位：' || c.inst, [rk, c.seq] FROM cand c JOIN alt USING (target_id, inst))
SELECT target_id, title, arg_min(note, o) AS affiliation_note FROM allp GROUP BY target_id, title""",
    "affiliation_check": f"""WITH {PEOPLE},
s AS (SELECT target_id, count(*) AS total, count(*) FILTER (agree) AS match, count(*) FILTER (NOT agree) AS conflict, count(*) FILTER (agree IS NULL) AS unknown FROM judged GROUP BY 1),
c5 AS (SELECT target_id, title, seq, row_number() OVER (PARTITION BY target_id ORDER BY seq) AS rn FROM judged WHERE NOT agree),
tt AS (SELECT target_id, string_agg(title, '|' ORDER BY rn) AS t FROM c5 GROUP BY 1)
SELECT s.*, coalesce(t, '') AS conflicting_titles, CASE WHEN conflict > 0 AND conflict >= greatest(1, total // 3) THEN '冲突较多，很可能混进了同名作者，建议请求人工确认'
  WHEN conflict > 0 THEN '有少量机构冲突，建议人工核对这几篇' WHEN match > 0 THEN '机构基本一致' ELSE '机构信息缺失，无法判断，建议人工核对' END AS verdict
FROM s LEFT JOIN tt USING (target_id)""",
    "assess_identity": f"""WITH {BATCHES},
t AS (SELECT custkey AS target_id, CASE WHEN custkey % 9 = 0 THEN '' ELSE university END AS school, department, email,
      CASE WHEN custkey % 4 = 0 THEN '' ELSE lower(department) END AS dir, custkey % 6 = 0 AS has_id FROM batches WHERE source = 'manual'),
p AS (SELECT custkey AS target_id, CASE WHEN custkey % 5 = 0 THEN '' WHEN custkey % 7 = 0 THEN 'Elsewhere' ELSE university END AS pinst,
      CASE WHEN custkey % 11 = 0 THEN 'ELSE' ELSE department END AS pdept, email AS pemail FROM batches WHERE source = 'official'),
w AS (SELECT o_custkey AS target_id, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'NATION_' || (o_orderkey % 25) END AS wi,
      CASE WHEN o_orderkey % 9 = 0 THEN 'machinery' ELSE lower(o_orderpriority) END AS topic FROM orders),
c AS (SELECT w.target_id, bool_or(contains(wi, school) OR contains(school, wi)) FILTER (wi <> '' AND school <> '') AS wfit,
      bool_or(contains(topic, dir) OR contains(dir, topic)) FILTER (dir <> '') AS tfit FROM w JOIN t USING (target_id) GROUP BY 1),
s AS (
  SELECT t.target_id, CASE WHEN em <> '' THEN em LIKE '%.edu.cn' END AS s1,
         CASE WHEN pinst <> '' AND school <> '' THEN contains(pinst, school) OR contains(school, pinst) END AS s2,
         contains(department, pdept) OR contains(pdept, department) AS s3, wfit AS s4, tfit AS s5, CASE WHEN has_id THEN true END AS s6
  FROM (SELECT t.*, pinst, pdept, CASE WHEN email <> '' THEN email ELSE pemail END AS em FROM t LEFT JOIN p USING (target_id)) t LEFT JOIN c ON c.target_id = t.target_id
),
n AS (SELECT *, list_filter([s1, s2, s3, s4, s5, s6], lambda x: x IS NOT NULL) AS l FROM s),
m AS (SELECT *, len(list_filter(l, lambda x: x)) AS a, len(list_filter(l, lambda x: NOT x)) AS b FROM n)
SELECT target_id, CASE WHEN b > 0 AND a = 0 THEN 'REJECTED' WHEN b > 0 THEN 'REVIEW_REQUIRED' WHEN a >= 2 THEN 'CONFIRMED' ELSE 'REVIEW_REQUIRED' END AS status,
       a - b AS score, array_to_string(list_filter([
         CASE s1 WHEN true THEN 'email_domain+' WHEN false THEN 'email_domain-' END, CASE s2 WHEN true THEN 'institution+' WHEN false THEN 'institution-' END,
         CASE s3 WHEN true THEN 'department+' WHEN false THEN 'department-' END, CASE s4 WHEN true THEN 'paper_institution+' WHEN false THEN 'paper_institution-' END,
         CASE s5 WHEN true THEN 'topic_continuity+' WHEN false THEN 'topic_continuity-' END, CASE WHEN s6 THEN 'scholar_id+' END], lambda x: x IS NOT NULL), ';') AS signals
FROM m""",
}
