"""Contact collisions between the supervisors named on all orders."""

from scholarmatch.operators import contacts as ops
from scholarmatch.plans import tables
from scholarmatch.plans.tables import CONTACTS


def _all(spark, sf):
    c = tables.contacts(spark, sf)
    p = tables.contact_papers(spark, sf)
    pairs = ops.selected_pairs(tables.selections(spark, sf), c)
    return c, p, pairs


def coauthor_counts(spark, sf):
    c, p, _ = _all(spark, sf)
    return ops.coauthor_counts(p, c)


def shared_papers(spark, sf):
    _, p, pairs = _all(spark, sf)
    return ops.shared_papers(pairs, p)


def direct_coauthors(spark, sf):
    c, p, pairs = _all(spark, sf)
    return ops.direct_coauthors(pairs, ops.coauthor_counts(p, c), c)


def stable_overlap(spark, sf):
    c, p, pairs = _all(spark, sf)
    return ops.stable_overlap(pairs, ops.coauthor_counts(p, c))


def collision_level(spark, sf):
    c, p, pairs = _all(spark, sf)
    return ops.collision_level(pairs, c, p)


def group_assessment(spark, sf):
    c, p, _ = _all(spark, sf)
    return ops.group_assessment(tables.selections(spark, sf), c, p)


_NAMES = "coauthor_counts shared_papers direct_coauthors stable_overlap collision_level group_assessment".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_LEVELS = """
sh3 AS (SELECT left_id, right_id, string_agg(title, '、' ORDER BY seq) AS shared FROM shared GROUP BY ALL),
st5 AS (SELECT left_id, right_id, string_agg(coauthor, '、' ORDER BY coauthor) AS steady FROM steady GROUP BY ALL),
known AS (SELECT person, bool_or(len(mates) > 0) AS k FROM pap GROUP BY 1),
f AS (
  SELECT p.left_id, p.right_id, l.inst = r.inst AND l.college <> '' AND l.college = r.college AS same, l.college <> '' AND r.college <> '' AS depts,
         coalesce(kl.k, false) OR coalesce(kr.k, false) AS has_authors, shared, steady, d.left_id IS NOT NULL AS direct
  FROM pairs p JOIN con l ON l.person = p.left_id JOIN con r ON r.person = p.right_id
  LEFT JOIN known kl ON kl.person = p.left_id LEFT JOIN known kr ON kr.person = p.right_id
  LEFT JOIN sh3 ON sh3.left_id = p.left_id AND sh3.right_id = p.right_id LEFT JOIN st5 ON st5.left_id = p.left_id AND st5.right_id = p.right_id
  LEFT JOIN direct d ON d.left_id = p.left_id AND d.right_id = p.right_id
),
lev AS (
  SELECT left_id, right_id, CASE WHEN direct OR shared IS NOT NULL OR (same AND steady IS NOT NULL) THEN 'HIGH' WHEN same OR steady IS NOT NULL THEN 'CAUTION'
           WHEN has_authors AND depts THEN 'LOW' ELSE 'UNKNOWN' END AS level, same, direct, shared, steady FROM f
)"""
ORACLES = {
    "coauthor_counts": f"WITH {CONTACTS} SELECT counts.* FROM counts JOIN con USING (person) WHERE coauthor <> own",
    "shared_papers": f"WITH {CONTACTS} SELECT * FROM shared",
    "direct_coauthors": f"WITH {CONTACTS} SELECT * FROM direct",
    "stable_overlap": f"WITH {CONTACTS} SELECT * FROM steady",
    "collision_level": f"""WITH {CONTACTS}, {_LEVELS} SELECT left_id, right_id, level,
CASE WHEN level = 'HIGH' OR (level = 'CAUTION' AND NOT same) THEN array_to_string(list_filter(['共同论文：' || shared, CASE WHEN direct THEN '论文作者列表显示两位导师直接合著' END,
  '双方都多次合作的共同作者：' || steady], lambda x: x IS NOT NULL), '；') ELSE '' END AS evidence,
CASE WHEN level = 'HIGH' THEN '已发现直接合著或明确的共同论文，建议错开联系时间，并确保每封邮件的研究切入点不同。'
     WHEN level = 'CAUTION' AND same THEN '两位导师在同一学院；当前已核验论文中未发现直接合著，但仍建议错开发送并分别定制内容。'
     WHEN level = 'CAUTION' THEN '两位导师虽不在同一学院，但出现稳定共同合作者，建议避免在短时间内发送高度相似的邮件。'
     WHEN level = 'LOW' THEN '两位导师属于不同学院，且在当前已核验论文中暂未发现直接合著或稳定共同合作者；这不等于完全没有私下联系。'
     ELSE '学院或论文作者数据不足，暂时无法判断两位导师是否存在套磁碰撞风险。' END AS reason FROM lev""",
    "group_assessment": f"""WITH {CONTACTS}, {_LEVELS},
g AS (SELECT group_id, count(*) AS n_members FROM sel GROUP BY 1),
hp AS (SELECT group_id, count(*) FILTER (level = 'HIGH') AS n_high, bool_or(level = 'CAUTION') AS caution, bool_and(level = 'LOW') AS low FROM gp JOIN lev USING (left_id, right_id) GROUP BY 1),
rc AS (SELECT group_id, string_agg(college, '、' ORDER BY college) AS rep FROM (SELECT group_id, college FROM sel JOIN con USING (person) WHERE college <> '' GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1)
SELECT *, CASE WHEN n_members < 2 THEN '至少选择两位导师后，才能判断联系安排。'
  WHEN level = 'HIGH' THEN '所选 ' || n_members || ' 位导师中发现 ' || n_high || ' 组直接合作或共同论文线索；建议错开发送时间，并为每封邮件选择不同的研究切入点。'
  WHEN level = 'CAUTION' THEN '所选 ' || n_members || ' 位导师中，有多人归在 ' || CASE repeated_colleges WHEN '' THEN '存在共同合作线索的院系' ELSE repeated_colleges END || '；建议分批联系，并让每封邮件的研究问题保持明显不同。'
  WHEN level = 'LOW' THEN '所选 ' || n_members || ' 位导师目前分属不同学院，已核验论文中未发现明显合作线索；可以考虑分批联系，但这不等于不存在私下联系。'
  ELSE '所选 ' || n_members || ' 位导师的学院或作者数据仍不完整，暂时无法给出可靠的整体联系安排。' END AS reason
FROM (
SELECT group_id, n_members, CASE WHEN n_members < 2 THEN 'UNKNOWN' WHEN coalesce(n_high, 0) > 0 THEN 'HIGH' WHEN rep IS NOT NULL OR caution THEN 'CAUTION' WHEN low THEN 'LOW' ELSE 'UNKNOWN' END AS level,
       coalesce(n_high, 0) AS n_high, coalesce(rep, '') AS repeated_colleges FROM g LEFT JOIN hp USING (group_id) LEFT JOIN rc USING (group_id))""",
}
