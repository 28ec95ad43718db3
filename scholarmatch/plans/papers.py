"""Paper records of all documents: keys, merging, ledger, feed coverage."""

from pyspark.sql import functions as F

from scholarmatch.operators import ledger, merge
from scholarmatch.plans import tables
from scholarmatch.plans.tables import WORKS, load

_LISTS = ("topics", "authors", "sources", "disciplines")


def _flat(df):
    for c in _LISTS:
        if c in df.columns:
            df = df.withColumn(c, F.array_join(c, "|"))
    return df


def work_keys(spark, sf):
    return merge.work_keys(tables.works(spark, sf)).select("seq", "doi_key", "title_key", "year")


def merge_works(spark, sf):
    out = _flat(merge.merge_works(tables.works(spark, sf)))
    return out.withColumn("abstract", F.md5("abstract"))


def merge_candidate_links(spark, sf):
    return merge.merge_links(tables.works(spark, sf))


def works_by_doi(spark, sf):
    return _flat(merge.works_by_doi(tables.works(spark, sf))).withColumn("abstract", F.md5("abstract"))


def dedupe_titles(spark, sf):
    return merge.dedupe_titles(tables.works(spark, sf)).select("seq", "title")


def title_fallback(spark, sf):
    w = tables.works(spark, sf).withColumn("target_id", F.concat(F.lit("T"), F.floor(F.col("seq") / 4).cast("string")))
    slim = w.select("seq", "title", "year", "lang", "target_id")
    found = slim.where("lang = 'en'").drop("lang")
    seeds = slim.select("target_id", F.col("seq").alias("pos"), "title")
    primary = slim.where("lang IN ('en', 'de')").drop("lang", "target_id")
    secondary = slim.where("lang IN ('fr', 'es')").drop("lang", "target_id")
    return merge.title_fallback(found, seeds, primary, secondary).select("target_id", "seq", "title", "via")


def _coverage_inputs(spark, sf):
    registry_key = F.element_at(
        F.array(*[F.lit(k) for k in ("openalex", "dblp", "europepmc", "arxiv", "crossref", "wanfang", "scopus")]),
        (F.col("seq") % 7 + 1).cast("int"),
    )
    w = tables.works(spark, sf).withColumn("source_platform", registry_key)
    w = w.select("target_id", "seq", "source_platform", "disciplines")
    targets = w.select("target_id").distinct().withColumn(
        "stated_discipline",
        F.when(F.substring("target_id", 2, 10).cast("long") % 5 == 0, F.lit("medicine")),
    )
    return targets, w


def source_coverage(spark, sf):
    targets, w = _coverage_inputs(spark, sf)
    return ledger.source_coverage(targets, w, keys=("scopus_api_key",))


def _ledger_inputs(spark, sf):
    w = tables.works(spark, sf)
    good = load(spark, sf, "labels").groupBy(F.col("doc_id").alias("seq")).agg((F.max("quality") == 1).alias("user_confirmed"))
    w = w.join(good, "seq", "left").withColumn("user_confirmed", F.coalesce("user_confirmed", F.lit(False)))
    number = F.substring("target_id", 2, 10).cast("long")
    targets = w.select("target_id").distinct().select(
        "target_id",
        F.lower("target_id").alias("id_prefix"),
        (number % 5 != 0).alias("identity_confirmed"),
        F.concat(F.lit("Prof "), "target_id").alias("name"),
        F.lit("Uni").alias("institution"),
        F.when(number % 2 == 0, F.lit("Dept")).alias("department"),
        F.lit("").alias("title"),
        F.array(F.lit("a"), F.lit("b")).alias("declared_interests"),
        F.when(number % 3 == 0, F.concat(F.lit("https://u.example/"), "target_id")).alias("homepage"),
    )
    return targets, w


def ledger_works(spark, sf):
    out = ledger.evidence_ledger(*_ledger_inputs(spark, sf))[0]
    return _flat(out).withColumn("abstract", F.md5("abstract"))


def ledger_evidence(spark, sf):
    out = ledger.evidence_ledger(*_ledger_inputs(spark, sf))[1]
    return out.withColumn("evidence_text", F.md5("evidence_text"))


def ledger_sources(spark, sf):
    return ledger.evidence_ledger(*_ledger_inputs(spark, sf))[2].withColumn("text", F.md5("text"))


def ledger_missing(spark, sf):
    return ledger.evidence_ledger(*_ledger_inputs(spark, sf))[3]


_NAMES = (
    "work_keys merge_works merge_candidate_links works_by_doi dedupe_titles title_fallback source_coverage "
    "ledger_works ledger_evidence ledger_sources ledger_missing"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

# Titles fold one distinct year after another; papers are numbered by the record that started them.
_GROUPS = """
firsts AS (SELECT *, row_number() OVER (PARTITION BY doi_key ORDER BY seq) AS nth FROM keyed),
deciders AS (SELECT * FROM firsts WHERE doi_key = '' OR nth = 1),
homes AS (
  SELECT k.seq, k.year, k.doi_key, k.title_key, CASE WHEN k.doi_key = '' THEN k.title_key ELSE d.title_key END AS home_title,
         CASE WHEN k.doi_key = '' THEN k.year ELSE d.year END AS home_year, CASE WHEN k.doi_key = '' THEN k.seq ELSE d.seq END AS decider
  FROM keyed k LEFT JOIN deciders d ON k.doi_key <> '' AND d.doi_key = k.doi_key
),
learned AS (SELECT home_title, arg_min(year, seq) AS y FROM homes WHERE year IS NOT NULL GROUP BY 1),
steps AS (
  SELECT title_key, year, min(seq) AS s, row_number() OVER (PARTITION BY title_key ORDER BY min(seq)) AS n
  FROM deciders WHERE title_key <> '' GROUP BY title_key, year
),
fold(title_key, n, papers) AS (
  SELECT s.title_key, 1::BIGINT, [{'leader': s.s, 'year': coalesce(s.year, l.y)}]
  FROM steps s LEFT JOIN learned l ON l.home_title = s.title_key WHERE s.n = 1
  UNION ALL
  SELECT f.title_key, f.n + 1,
         CASE WHEN s.year IS NULL OR len(list_filter(f.papers, lambda g: g.year IS NULL OR abs(g.year - s.year) <= 1)) > 0 THEN f.papers
              ELSE list_append(f.papers, {'leader': s.s, 'year': s.year}) END
  FROM fold f JOIN steps s ON s.title_key = f.title_key AND s.n = f.n + 1
),
final AS (SELECT title_key, arg_max(papers, n) AS papers FROM fold GROUP BY 1),
grouped AS (
  SELECT h.seq, CASE WHEN h.home_title = '' THEN h.decider
    ELSE list_filter(f.papers, lambda g: g.year IS NULL OR h.home_year IS NULL OR abs(g.year - h.home_year) <= 1)[1].leader END AS leader, h.decider, h.doi_key
  FROM homes h LEFT JOIN final f ON f.title_key = h.home_title
)"""


def _fold(key: str) -> str:
    return f"""
rec AS (SELECT k.*, g.{key} AS grp, row_number() OVER (PARTITION BY g.{key} ORDER BY k.seq) AS r FROM keyed k JOIN grp_of g USING (seq)),
size_of AS (SELECT grp, max(r) AS n_records, max(seq) FILTER (r = 2) AS second FROM rec GROUP BY 1),
toks AS (
  SELECT grp, 'topics' AS list, unnest(topics) AS v, [seq, 0, generate_subscripts(topics, 1)] AS o FROM rec
  UNION ALL SELECT grp, 'disciplines', unnest(disciplines), [seq, 0, generate_subscripts(disciplines, 1)] FROM rec
  UNION ALL SELECT grp, 'sources', unnest(sources), [seq, 0, generate_subscripts(sources, 1)] FROM rec
  UNION ALL SELECT grp, 'sources', source_platform, CASE WHEN r = 1 AND second IS NOT NULL THEN [second, 1, 0] ELSE [seq, 2, 0] END FROM rec JOIN size_of USING (grp)
),
once AS (SELECT grp, list, v, min(o) AS o FROM toks GROUP BY ALL),
united AS (
  SELECT grp, string_agg(v, '|' ORDER BY o) FILTER (list = 'topics') AS topics, string_agg(v, '|' ORDER BY o) FILTER (list = 'disciplines') AS disciplines,
         string_agg(v, '|' ORDER BY o) FILTER (list = 'sources') AS sources FROM once GROUP BY grp
),
folded AS (
  SELECT grp, min(seq) AS seq, arg_min(id, seq) AS id, arg_max(title, (len(title), -seq)) AS title, arg_min(year, seq) FILTER (year IS NOT NULL) AS year,
         arg_min(doi, seq) FILTER (doi <> '') AS doi, arg_min(venue, seq) FILTER (venue <> '') AS venue, max(citation_count) AS citation_count,
         md5(arg_max(abstract, (len(abstract), -seq))) AS abstract, arg_min(source_url, seq) FILTER (source_url <> '') AS source_url,
         arg_min(source_platform, seq) AS source_platform, array_to_string(arg_max(authors, (len(authors), -seq)), '|') AS authors,
         arg_min(institution, seq) FILTER (institution <> '') AS institution, arg_min(array_to_string(sources, '|'), seq) AS lone, count(*) AS n_records
  FROM rec GROUP BY grp
),
merged_rows AS (
  SELECT f.grp, f.seq, id, title, year, doi, venue, coalesce(u.topics, '') AS topics, citation_count, abstract, source_url, source_platform, authors, institution,
         CASE WHEN f.n_records = 1 AND lone <> '' THEN lone ELSE coalesce(u.sources, '') END AS sources, coalesce(u.disciplines, '') AS disciplines, f.n_records
  FROM folded f LEFT JOIN united u USING (grp)
)"""


_LEDGER = """
good AS (SELECT doc_id AS seq, max(quality) = 1 AS ok FROM labels GROUP BY 1),
tg AS (
  SELECT DISTINCT target_id, lower(target_id) AS id_prefix, substr(target_id, 2)::BIGINT AS num FROM works
),
conf AS (
  SELECT w.*, id_prefix, row_number() OVER (PARTITION BY w.target_id ORDER BY seq) AS n
  FROM works w JOIN good USING (seq) JOIN tg ON tg.target_id = w.target_id WHERE ok AND num % 5 <> 0
),
pap AS (
  SELECT *, 'manual_' || id_prefix || '_' || n || '_' || left(sha256(coalesce(title, '') || chr(10) || coalesce(source_url, '')), 10) AS paper_id,
         trim(title) <> '' AND trim(abstract) <> '' AND trim(coalesce(source_url, '')) <> '' AS complete FROM conf
),
full_p AS (SELECT * FROM pap WHERE complete),
ppl AS (SELECT * FROM tg WHERE num % 5 <> 0 AND target_id IN (SELECT target_id FROM full_p)),
prof AS (
  SELECT target_id, 'ev_' || id_prefix || '_profile' AS id, 'user_confirmed_profile' AS source_type,
         CASE WHEN num % 3 = 0 THEN 'https://u.example/' || target_id END AS source_url, 'Prof ' || target_id || '的导师资料' AS title, NULL::VARCHAR AS published_date,
         'Prof ' || target_id || '；Uni；' || CASE WHEN num % 2 = 0 THEN 'Dept；' ELSE '' END || 'a、b' AS evidence_text, 'CONFIRMED' AS author_resolution_status,
         CASE WHEN num % 3 = 0 THEN 1 ELSE 3 END AS source_tier FROM ppl
)"""

_REG = """
reg(source, covers, rank0, authors, state) AS (VALUES ('openalex','*',10,true,''),('dblp','cs',5,true,'disabled'),('europepmc','medicine',5,true,''),
  ('arxiv','physics cs chemistry engineering economics',15,true,''),('crossref','*',30,false,'title_only'),('wanfang','*',5,true,'no_key'),('scopus','*',8,true,''),
  ('springer_meta','*',35,false,'no_key'),('springer_open_access','*',36,false,'no_key'),('aminer','*',20,true,'disabled')),
lab(discipline, pos) AS (VALUES ('cs',0),('medicine',1),('physics',2),('chemistry',3),('engineering',4),('economics',5),('humanities',6),('agriculture',7)),
dc AS (SELECT target_id, d, count(*) AS n FROM (SELECT target_id, unnest(disciplines) AS d FROM works) GROUP BY ALL),
dom AS (SELECT target_id, arg_min(d, (-n, pos)) AS d, max(n) AS n FROM dc JOIN lab ON lab.discipline = d GROUP BY 1),
tot AS (SELECT target_id, count(*) AS n FROM works GROUP BY 1),
tgt AS (SELECT tot.target_id, CASE WHEN substr(tot.target_id, 2)::BIGINT % 5 = 0 THEN 'medicine' WHEN tot.n >= 3 AND dom.n >= 3 THEN dom.d ELSE 'general' END AS discipline
        FROM tot LEFT JOIN dom USING (target_id)),
cnt AS (SELECT target_id, ['openalex','dblp','europepmc','arxiv','crossref','wanfang','scopus'][seq % 7 + 1] AS source, count(*) AS n FROM works GROUP BY ALL),
st AS (SELECT target_id, source, discipline, rank0, CASE WHEN state <> '' THEN state WHEN covers = '*' OR list_contains(string_split(covers, ' '), discipline) THEN 'selected' ELSE 'not_covering' END AS status
       FROM tgt, reg)"""

ORACLES = {
    "work_keys": f"WITH {WORKS} SELECT seq, doi_key, title_key, year FROM keyed",
    "merge_works": f"WITH RECURSIVE {WORKS}, {_GROUPS}, grp_of AS (SELECT seq, leader FROM grouped), {_fold('leader')} SELECT * EXCLUDE (grp) FROM merged_rows",
    "merge_candidate_links": f"""WITH RECURSIVE {WORKS}, {_GROUPS}
SELECT seq, CASE WHEN doi_key <> '' AND seq <> decider THEN 'doi' ELSE 'title' END AS via, leader FROM grouped WHERE seq <> leader""",
    "works_by_doi": f"WITH {WORKS}, grp_of AS (SELECT seq, doi_key AS dk FROM keyed WHERE doi_key <> ''), {_fold('dk')} SELECT grp AS doi_key, * EXCLUDE (grp) FROM merged_rows",
    "dedupe_titles": f"WITH {WORKS} SELECT min(seq) AS seq, title FROM works WHERE title <> '' GROUP BY title",
    "title_fallback": f"""WITH {WORKS},
w4 AS (SELECT k.seq, k.title, k.title_key, k.lang, 'T' || (k.seq // 4) AS target_id FROM keyed k),
few AS (SELECT target_id FROM w4 GROUP BY 1 HAVING count(*) FILTER (lang = 'en') < 3),
sd AS (SELECT target_id, title_key, row_number() OVER (PARTITION BY target_id ORDER BY seq) AS rk FROM w4 WHERE target_id IN (SELECT target_id FROM few)),
allc AS (
  SELECT target_id, seq, title, 'author' AS via, [0, 0, seq] AS o FROM w4 WHERE lang = 'en'
  UNION ALL SELECT sd.target_id, p.seq, p.title, 'title', [1, rk, p.seq] FROM sd JOIN w4 p USING (title_key) WHERE p.lang IN ('en', 'de') AND title_key <> ''
  UNION ALL SELECT sd.target_id, p.seq, p.title, 'title_secondary', [1, rk, p.seq] FROM sd JOIN w4 p USING (title_key)
    WHERE p.lang IN ('fr', 'es') AND title_key <> '' AND title_key NOT IN (SELECT title_key FROM w4 WHERE lang IN ('en', 'de'))
)
SELECT target_id, arg_min(seq, o) AS seq, title, arg_min(via, o) AS via FROM allc GROUP BY target_id, title""",
    "source_coverage": f"""WITH {WORKS}, {_REG},
rk AS (SELECT *, CASE WHEN status = 'selected' THEN row_number() OVER (PARTITION BY target_id, status = 'selected' ORDER BY rank0, source) ELSE 0 END AS rank FROM st)
SELECT target_id, source, discipline, CASE WHEN status <> 'selected' THEN status WHEN coalesce(cnt.n, 0) > 0 THEN 'ok' ELSE 'empty' END AS status, coalesce(cnt.n, 0) AS n, rank
FROM rk LEFT JOIN cnt USING (target_id, source)""",
    "ledger_works": f"""WITH {WORKS}, {_LEDGER} SELECT target_id, paper_id AS id, seq, title, year, array_to_string(topics, '|') AS topics, md5(abstract) AS abstract, source_url,
source_platform, array_to_string(authors, '|') AS authors FROM full_p""",
    "ledger_evidence": f"""WITH {WORKS}, {_LEDGER} SELECT * REPLACE (md5(evidence_text) AS evidence_text) FROM prof
UNION ALL SELECT target_id, 'ev_' || paper_id, '人工录入', source_url, title, year::VARCHAR, md5(abstract), 'CONFIRMED', 2 FROM full_p""",
    "ledger_sources": f"""WITH {WORKS}, {_LEDGER} SELECT target_id, 'src_' || substr(id, 4) AS id, source_type, source_url AS url, title, md5(evidence_text) AS text FROM prof
UNION ALL SELECT target_id, 'src_' || paper_id, 'user_confirmed_paper', source_url, title, md5(abstract) FROM full_p""",
    "ledger_missing": f"""WITH {WORKS}, {_LEDGER} SELECT target_id, seq, m AS missing FROM (SELECT target_id, seq, unnest([CASE WHEN trim(title) = '' THEN '标题' END,
CASE WHEN trim(abstract) = '' THEN '摘要' END, CASE WHEN trim(coalesce(source_url, '')) = '' THEN '来源链接' END]) AS m FROM pap) WHERE m IS NOT NULL""",
}
