"""Direction search over the whole catalog."""

from pyspark.sql import functions as F

from scholarmatch.functions.scale import literal_table
from scholarmatch.operators import discover, gram_index, nearest
from scholarmatch.plans.tables import CATALOG, catalog, load
from scholarmatch.sources.tables import scratch_path

DIRECTIONS = (
    (1, "red, ring"),
    (2, "Brand#17; large"),
    (3, "gizmo|anvil"),
    (4, "promo"),
    (5, "blue widget"),
    (6, "cold\nbolt, old"),
    (7, "economy, hot plate"),
    (8, "BRAND#3"),
)


def _queries(spark):
    return discover.prepare_queries(literal_table(spark, ("query_id", "query"), DIRECTIONS))


def term_filter(spark, sf):
    return discover.term_filter(catalog(spark, sf), _queries(spark))


def match_reasons(spark, sf):
    return discover.match_reasons(catalog(spark, sf), _queries(spark))


def rank_candidates(spark, sf):
    return discover.rank_candidates(catalog(spark, sf), _queries(spark))


def _indexed(spark, sf, *states):
    path = scratch_path(spark, "gram-index")
    gram_index.build_index(states[0], path)
    for state in states[1:]:
        gram_index.update_index(state, path)
    return path


def index_filter(spark, sf):
    return gram_index.filter_indexed(spark, _indexed(spark, sf, catalog(spark, sf)), _queries(spark))


def index_rank(spark, sf):
    return gram_index.rank_indexed(spark, _indexed(spark, sf, catalog(spark, sf)), _queries(spark))


def index_update(spark, sf):
    """The ranking from an index that was built while one school was missing and the texts of another were empty."""
    now = catalog(spark, sf)
    blank = F.when(F.col("university") == "NATION_3", F.lit("")).otherwise(F.col("profile_text"))
    before = now.where("university <> 'NATION_7'").withColumn("profile_text", blank)
    return gram_index.rank_indexed(spark, _indexed(spark, sf, before, now), _queries(spark))


def lexical_similarity(spark, sf):
    out = discover.lexical_similarity(catalog(spark, sf), _queries(spark))
    return out.withColumn("similarity", F.round("similarity", 4))


def hybrid_rank(spark, sf):
    c, q = catalog(spark, sf), _queries(spark)
    return discover.hybrid_rank(c, q, discover.lexical_similarity(c, q))


def compare_table(spark, sf):
    return discover.compare_table(catalog(spark, sf), _queries(spark))


def similar_pairs(spark, sf):
    part = load(spark, sf, "part")
    left = part.select(F.concat_ws(" ", "p_name", "p_type").alias("phrase"))
    right = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("phrase"))
    return discover.similar_pairs(left, right).withColumn("cosine", F.round("cosine", 4))


def vector_recall(spark, sf):
    vectors = load(spark, sf, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return nearest.vector_recall(asked, vectors, threshold=0.30)


def embedder_separability(spark, sf):
    """Every vector is a case: near its own label's exemplar, far from the next label's."""
    vectors = load(spark, sf, "embeddings")
    exemplars = discover.exemplar_vectors(vectors).select("label", "query_vec")
    count = exemplars.agg(F.count("*").alias("labels"))
    related = exemplars.select("label", F.col("query_vec").alias("related_vec"))
    other = exemplars.select(F.col("label").alias("other"), F.col("query_vec").alias("unrelated_vec"))
    cases = (
        vectors.select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("query_vec"), "label")
        .join(related, "label")
        .withColumn("other", (F.col("label") + 1) % count.scalar())
        .join(other, "other")
    )
    return discover.embedder_separability(cases)


QUERIES = {
    "term_filter": term_filter,
    "match_reasons": match_reasons,
    "rank_candidates": rank_candidates,
    "index_filter": index_filter,
    "index_rank": index_rank,
    "index_update": index_update,
    "lexical_similarity": lexical_similarity,
    "vector_recall": vector_recall,
    "hybrid_rank": hybrid_rank,
    "compare_table": compare_table,
    "similar_pairs": similar_pairs,
    "embedder_separability": embedder_separability,
}

_TERMS = """
terms(query_id, pos, term) AS (VALUES
  (1,0,'red'),(1,1,'ring'),(2,0,'Brand#17'),(2,1,'large'),(3,0,'gizmo'),(3,1,'anvil'),(4,0,'promo'),
  (5,0,'blue widget'),(6,0,'cold'),(6,1,'bolt'),(6,2,'old'),(7,0,'economy'),(7,1,'hot plate'),(8,0,'BRAND#3'))"""
_VALUES = """
vals AS (
  SELECT university, department, name, 0 AS fpos, 'research_directions' AS field, 3 AS weight, unnest(research_directions) AS v, generate_subscripts(research_directions, 1) AS vpos FROM catalog
  UNION ALL SELECT university, department, name, 1, 'research_areas', 3, unnest(research_areas), 1 FROM catalog
  UNION ALL SELECT university, department, name, 2, 'department', 2, department, 1 FROM catalog
  UNION ALL SELECT university, department, name, 3, 'publications', 2, unnest(publications), 1 FROM catalog
  UNION ALL SELECT university, department, name, 4, 'profile_text', 1, profile_text, 1 FROM catalog
),
reasons AS (
  SELECT query_id, university, department, name, term, field, weight, fpos, pos, min(vpos) AS vpos
  FROM vals JOIN terms ON contains(lower(v), lower(term))
  GROUP BY ALL
)"""
_SCORED = """
filled AS (
  SELECT *, ((len(research_directions) > 0)::INT + (title <> '')::INT + (email <> '')::INT + (homepage_url <> '')::INT) / 4.0 AS completeness FROM catalog
),
scores AS (
  SELECT query_id, university, department, name, sum(weight) AS match_score FROM reasons GROUP BY ALL
)"""
_RANKED = """
ranked AS (
  SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY match_score DESC, completeness DESC, university, name, department) AS rank,
         university, department, name, match_score, completeness
  FROM scores s JOIN filled USING (university, department, name) WHERE match_score >= 2
  QUALIFY rank <= 20
)"""
_LEX = r"""
qtext AS (SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS t FROM terms GROUP BY 1),
dtext AS (
  SELECT university, department, name,
         array_to_string(list_concat(research_directions, research_areas, [department], publications[1:8]), '；') AS t FROM catalog
),
qf AS (SELECT query_id, f, count(*) AS tf FROM (SELECT query_id, unnest(regexp_extract_all(lower(t), '[a-zA-Z][a-zA-Z0-9+#.\-]{1,}')) AS f FROM qtext) GROUP BY ALL),
df AS (SELECT university, department, name, f, count(*) AS tf FROM (SELECT university, department, name, unnest(regexp_extract_all(lower(t), '[a-zA-Z][a-zA-Z0-9+#.\-]{1,}')) AS f FROM dtext) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM qf GROUP BY ALL),
dn AS (SELECT university, department, name, sqrt(sum(tf * tf)) AS n FROM df GROUP BY ALL),
sims AS (
  SELECT qf.query_id, df.university, df.department, df.name, sum(qf.tf / qn.n * df.tf / dn.n) AS sim
  FROM qf JOIN df USING (f) JOIN qn USING (query_id) JOIN dn ON dn.name = df.name AND dn.university = df.university AND dn.department = df.department
  GROUP BY ALL
)"""

ORACLES = {
    "index_filter": f"WITH {CATALOG}, {_TERMS}, {_VALUES} SELECT DISTINCT query_id, university, department, name FROM reasons",
    "index_rank": f"WITH {CATALOG}, {_TERMS}, {_VALUES}, {_SCORED}, {_RANKED} SELECT * FROM ranked",
    "index_update": f"WITH {CATALOG}, {_TERMS}, {_VALUES}, {_SCORED}, {_RANKED} SELECT * FROM ranked",
    "term_filter": f"WITH {CATALOG}, {_TERMS}, {_VALUES} SELECT DISTINCT query_id, university, department, name FROM reasons",
    "match_reasons": f"WITH {CATALOG}, {_TERMS}, {_VALUES} SELECT query_id, university, department, name, term, field, weight FROM reasons",
    "rank_candidates": f"WITH {CATALOG}, {_TERMS}, {_VALUES}, {_SCORED}, {_RANKED} SELECT * FROM ranked",
    "lexical_similarity": f"WITH {CATALOG}, {_TERMS}, {_LEX} SELECT query_id, university, department, name, round(sim, 4) AS similarity FROM sims",
    "hybrid_rank": f"""WITH {CATALOG}, {_TERMS}, {_VALUES}, {_SCORED}, {_LEX},
both_sides AS (
  SELECT coalesce(s.query_id, m.query_id) AS query_id, coalesce(s.university, m.university) AS university,
         coalesce(s.department, m.department) AS department, coalesce(s.name, m.name) AS name,
         coalesce(match_score, 0) AS match_score, coalesce(sim, 0) AS sim
  FROM scores s FULL JOIN sims m ON s.query_id = m.query_id AND s.university = m.university AND s.department = m.department AND s.name = m.name
),
kept AS (
  SELECT b.*, CASE WHEN sim >= 0.36 OR (match_score >= 2 AND sim >= 0.20) THEN 'surface' ELSE '' END AS vector_reason,
         round(sim, 4) AS similarity, completeness
  FROM both_sides b JOIN filled USING (university, department, name)
  WHERE match_score >= 2 OR sim >= 0.36
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, similarity DESC, completeness DESC, university, name, department) AS rank,
       university, department, name, match_score, similarity, completeness, vector_reason
FROM kept QUALIFY rank <= 20""",
    "compare_table": f"""WITH {CATALOG}, {_TERMS}, {_VALUES}, {_SCORED}, {_RANKED},
labels(field, label) AS (VALUES ('research_directions','研究方向'),('research_areas','研究领域'),('department','院系'),('publications','代表论文'),('profile_text','简介正文')),
blocks AS (
  SELECT query_id, university, department, name, fpos, label || '命中 ' || string_agg(term, '、' ORDER BY vpos, pos) AS block
  FROM reasons JOIN labels USING (field) GROUP BY query_id, university, department, name, fpos, label
),
said AS (SELECT query_id, university, department, name, string_agg(block, '；' ORDER BY fpos) AS reason FROM blocks GROUP BY ALL)
SELECT r.query_id, r.rank, c.university, c.department, c.name, CASE WHEN title = '' THEN '未知' ELSE title END AS title,
       array_to_string(research_directions, '、') AS directions, reason,
       (round(r.completeness * 100)::INT)::VARCHAR || '%' AS completeness_text,
       CASE WHEN homepage_url = '' THEN '未采集' ELSE homepage_url END AS homepage,
       CASE WHEN email = '' THEN '未采集' ELSE email END AS email, array_to_string(sources, '、') AS sources
FROM ranked r JOIN catalog c USING (university, department, name)
JOIN said s ON s.query_id = r.query_id AND s.university = r.university AND s.department = r.department AND s.name = r.name""",
    "similar_pairs": r"""WITH l AS (SELECT DISTINCT p_name || ' ' || p_type AS p FROM part), r AS (SELECT DISTINCT p_name || ' ' || p_brand AS p FROM part),
lf AS (SELECT p, f, count(*) AS tf FROM (SELECT p, unnest(regexp_extract_all(lower(p), '[a-zA-Z][a-zA-Z0-9+#.\-]{1,}')) AS f FROM l) GROUP BY ALL),
rf AS (SELECT p, f, count(*) AS tf FROM (SELECT p, unnest(regexp_extract_all(lower(p), '[a-zA-Z][a-zA-Z0-9+#.\-]{1,}')) AS f FROM r) GROUP BY ALL),
ln AS (SELECT p, sqrt(sum(tf * tf)) AS n FROM lf GROUP BY ALL), rn AS (SELECT p, sqrt(sum(tf * tf)) AS n FROM rf GROUP BY ALL)
SELECT lf.p AS left_phrase, rf.p AS right_phrase, round(sum(lf.tf / ln.n * rf.tf / rn.n), 4) AS cosine
FROM lf JOIN rf USING (f) JOIN ln ON ln.p = lf.p JOIN rn ON rn.p = rf.p GROUP BY lf.p, rf.p
HAVING sum(lf.tf / ln.n * rf.tf / rn.n) >= 0.36""",
    "vector_recall": """WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS c FROM embeddings q, embeddings e)
SELECT query_id, vec_id, round(c, 4) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 4) DESC, vec_id) AS rank
FROM s WHERE c >= 0.30 QUALIFY rank <= 20""",
    "embedder_separability": """WITH p AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
c AS (SELECT e.vec_id AS case_id, list_cosine_similarity(e.embedding::DOUBLE[], p.v) AS near, list_cosine_similarity(e.embedding::DOUBLE[], o.v) AS far
      FROM embeddings e JOIN p ON p.label = e.label JOIN p o ON o.label = (e.label + 1) % (SELECT count(*) FROM p))
SELECT case_id, round(near, 4) AS near, round(far, 4) AS far, round(near - far, 4) AS margin, near - far > 0.05 AS ok FROM c""",
}
