"""Driver tables as the model tables the operators expect, once for Spark and once as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmatch.functions.scale import dealt


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- catalog of advisors: one per part ---------------------------------------------------------
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = part.join(F.broadcast(nation), F.col("p_partkey") % 25 == F.col("n_nationkey"))  # 25 nations
    key = F.col("p_partkey")
    blank = F.lit("")
    return joined.select(
        F.col("n_name").alias("university"),
        F.col("p_type").alias("department"),
        F.concat(F.lit("Advisor "), key.cast("string")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, blank).otherwise("Professor").alias("title"),
        F.when(F.col("p_size") % 3 == 0, blank)
        .otherwise(F.concat(F.lit("a"), key.cast("string"), F.when(key % 2 == 0, F.lit("@uni.edu.cn")).otherwise("@mail.com")))
        .alias("email"),
        F.split("p_name", " ").alias("research_directions"),
        F.array("p_brand").alias("research_areas"),
        F.array(F.concat_ws(" ", "p_name", "p_type")).alias("publications"),
        F.when(F.col("p_size") % 5 == 0, blank)
        .otherwise(F.concat(F.lit("https://www.example.edu/faculty/"), key.cast("string")))
        .alias("homepage_url"),
        F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("profile_text"),
        F.when(key % 4 == 0, F.concat(F.lit("0000-"), key.cast("string"))).otherwise(blank).alias("orcid"),
        F.when(key % 6 == 0, F.concat(F.lit("A"), key.cast("string"))).otherwise(blank).alias("openalex_id"),
        F.when(key % 2 == 0, F.array(F.lit("official")))
        .otherwise(F.array(F.lit("community"), F.lit("official")))
        .alias("sources"),
        key.alias("advisor_id"),
    )


CATALOG = """
catalog AS (
  SELECT n_name AS university, p_type AS department, 'Advisor ' || p_partkey AS name,
         CASE WHEN p_size % 2 = 0 THEN '' ELSE 'Professor' END AS title,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE 'a' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '@uni.edu.cn' ELSE '@mail.com' END END AS email,
         string_split(p_name, ' ') AS research_directions, [p_brand] AS research_areas,
         [p_name || ' ' || p_type] AS publications,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE 'https://www.example.edu/faculty/' || p_partkey END AS homepage_url,
         lower(p_type || ' ' || p_brand) AS profile_text,
         CASE WHEN p_partkey % 4 = 0 THEN '0000-' || p_partkey ELSE '' END AS orcid,
         CASE WHEN p_partkey % 6 = 0 THEN 'A' || p_partkey ELSE '' END AS openalex_id,
         CASE WHEN p_partkey % 2 = 0 THEN ['official'] ELSE ['community', 'official'] END AS sources,
         p_partkey AS advisor_id
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey
)"""


# --- roster dump: customers of nations, every fifth row twice ----------------------------------
def roster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    n = F.broadcast(load(spark, sf_dir, "nation"))  # 25 nations
    key = F.col("c_custkey")
    copies = F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    base = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("k", F.explode(copies))
    return base.select(
        (key * 2 + F.col("k")).alias("seq"),
        F.col("n_regionkey").cast("string").alias("school_cate"),
        F.col("n_name").alias("university"),
        F.col("c_mktsegment").alias("department"),
        F.concat(
            F.when(key % 11 == 0, F.lit("Re: ")).otherwise(F.lit("")),
            F.col("c_name"),
            F.when(key % 7 == 0, F.concat(F.lit("("), F.col("c_mktsegment"), F.lit(")"))).otherwise(F.lit("")),
        ).alias("supervisor"),
        F.when(key % 13 != 0, F.col("c_acctbal")).alias("rate"),
        F.when(key % 3 == 0, F.concat(F.lit("said "), F.col("k").cast("string"))).otherwise(F.lit("")).alias("desc"),
        F.when(key % 4 == 0, F.concat(F.lit(" detail "), key.cast("string"))).otherwise(F.lit("")).alias("description"),
    )


def roster_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as landed JSON texts, each in one of three wrappings."""
    r = roster_rows(spark, sf_dir)
    body = F.to_json(F.struct("school_cate", "university", "department", "supervisor", "rate", "desc", "description"))
    wrap = F.col("seq") % 3
    return r.select(
        "seq",
        F.when(wrap == 0, body)
        .when(wrap == 1, F.concat(F.lit("["), body, F.lit(', "stray"]')))
        .otherwise(F.concat(F.lit('{"comments": ['), body, F.lit("]}")))
        .alias("payload"),
    )


ROSTER = """
roster_raw AS (
  SELECT c_custkey AS key, c_custkey * 2 + k AS seq, n_regionkey::VARCHAR AS school_cate, n_name AS university,
         c_mktsegment AS department, c_name AS supervisor,
         CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE '' END AS note,
         CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS rate,
         CASE WHEN c_custkey % 3 = 0 THEN 'said ' || k ELSE '' END AS summary,
         CASE WHEN c_custkey % 4 = 0 THEN 'detail ' || c_custkey ELSE '' END AS detail
  FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (0), (1)) AS copies(k)
  WHERE k = 0 OR c_custkey % 5 = 0
),
entries AS (
  SELECT university, department, supervisor, arg_min(note, seq) AS note, arg_min(school_cate, seq) AS school_cate
  FROM roster_raw GROUP BY ALL
),
revs AS (
  SELECT university, department, supervisor, rate, summary, detail FROM roster_raw
  WHERE rate IS NOT NULL OR summary <> '' OR detail <> ''
)"""


# --- three arrivals per customer for the catalog -----------------------------------------------
def catalog_batches(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    c = customers if customers is not None else load(spark, sf_dir, "customer")
    # Three wide arrivals come of a narrow row; the task that scans a small file must not make, sort and send all of them.
    c = dealt(c, "c_custkey")
    n = F.broadcast(load(spark, sf_dir, "nation"))  # 25 nations
    key, k = F.col("c_custkey"), F.col("k")
    s = key.cast("string")
    blank = F.lit("")
    none = F.array().cast("array<string>")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    )
    half = F.floor(key / 2).cast("string")
    return rows.select(
        (key * 3 + k).alias("seq"),
        key.alias("custkey"),
        F.element_at(F.array(F.lit("manual"), F.lit("official"), F.lit("community")), k + 1).alias("source"),
        F.col("n_name").alias("university"),
        F.col("c_mktsegment").alias("department"),
        F.concat(
            F.lit("Name"), half, F.when((k == 1) & (key % 4 == 0), F.lit(" Professor")).otherwise(blank)
        ).alias("name"),
        F.when((key + k) % 3 == 0, blank).otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("title"),
        F.when((key + k) % 2 == 0, blank)
        .otherwise(F.concat(F.lit("e"), s, F.when(key % 3 == 0, F.lit("@x.edu.cn")).otherwise("@mail.com")))
        .alias("email"),
        F.when((key + k) % 4 == 0, none)
        .otherwise(F.array(F.lower("c_mktsegment"), F.concat(F.lit("k"), k.cast("string"))))
        .alias("research_directions"),
        F.when(k == 0, none).otherwise(F.array(F.concat(F.lit("area"), (key % 7).cast("string")))).alias("research_areas"),
        F.when((key * k) % 5 == 1, F.array(F.concat(F.lit("pub"), s))).otherwise(none).alias("publications"),
        F.when((key + 2 * k) % 5 == 0, F.concat(F.lit("https://www.uni.example/~"), s)).otherwise(blank).alias("homepage_url"),
        F.when(k == 2, F.lit("  ")).otherwise(F.concat(F.lit("profile "), s)).alias("profile_text"),
        F.when((k == 1) & (key % 6 == 0), F.concat(F.lit("0000-"), s)).otherwise(blank).alias("orcid"),
        F.when((k == 2) & (key % 7 == 0), F.concat(F.lit("A"), s)).otherwise(blank).alias("openalex_id"),
        F.when(k == 2, F.col("n_regionkey").cast("string")).otherwise(blank).alias("school_cate"),
        F.when((k == 0) & (key % 9 == 0), F.lit("note")).otherwise(blank).alias("note"),
        F.when(k == 0, F.lit("manual"))
        .when((k == 1) & (key % 2 == 0), F.concat(F.lit("https://site.example/"), s))
        .when(k == 1, blank)
        .otherwise(F.concat(F.lit("http://c.example/"), s))
        .alias("source_url"),
        F.when(k == 0, blank).otherwise(F.concat(F.lit("2024-01-0"), (k + 1).cast("string"))).alias("retrieved_at"),
        F.when(k == 0, blank).otherwise(F.md5(F.concat(s, k.cast("string")))).alias("content_hash"),
    )


BATCHES = """
batches AS (
  SELECT c_custkey * 3 + k AS seq, c_custkey AS custkey, ['manual', 'official', 'community'][k + 1] AS source,
         n_name AS university, c_mktsegment AS department,
         'Name' || (c_custkey // 2) || CASE WHEN k = 1 AND c_custkey % 4 = 0 THEN ' Professor' ELSE '' END AS name,
         CASE WHEN (c_custkey + k) % 3 = 0 THEN '' ELSE 'T' || k END AS title,
         CASE WHEN (c_custkey + k) % 2 = 0 THEN '' ELSE 'e' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '@x.edu.cn' ELSE '@mail.com' END END AS email,
         CASE WHEN (c_custkey + k) % 4 = 0 THEN '' ELSE lower(c_mktsegment) || '|k' || k END AS research_directions,
         CASE WHEN k = 0 THEN '' ELSE 'area' || (c_custkey % 7) END AS research_areas,
         CASE WHEN (c_custkey * k) % 5 = 1 THEN 'pub' || c_custkey ELSE '' END AS publications,
         CASE WHEN (c_custkey + 2 * k) % 5 = 0 THEN 'https://www.uni.example/~' || c_custkey ELSE '' END AS homepage_url,
         CASE WHEN k = 2 THEN '  ' ELSE 'profile ' || c_custkey END AS profile_text,
         CASE WHEN k = 1 AND c_custkey % 6 = 0 THEN '0000-' || c_custkey ELSE '' END AS orcid,
         CASE WHEN k = 2 AND c_custkey % 7 = 0 THEN 'A' || c_custkey ELSE '' END AS openalex_id,
         CASE WHEN k = 2 THEN n_regionkey::VARCHAR ELSE '' END AS school_cate,
         CASE WHEN k = 0 AND c_custkey % 9 = 0 THEN 'note' ELSE '' END AS note,
         CASE WHEN k = 0 THEN 'manual' WHEN k = 1 AND c_custkey % 2 = 0 THEN 'https://site.example/' || c_custkey
              WHEN k = 1 THEN '' ELSE 'http://c.example/' || c_custkey END AS source_url,
         CASE WHEN k = 0 THEN '' ELSE '2024-01-0' || (k + 1) END AS retrieved_at,
         CASE WHEN k = 0 THEN '' ELSE md5(c_custkey::VARCHAR || k::VARCHAR) END AS content_hash
  FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (0), (1), (2)) AS arrivals(k)
)"""


def _first_by_seq(field: str) -> str:
    return f"coalesce(arg_min({field}, seq) FILTER (trim({field}) <> ''), '') AS {field}"


_FIELDS = (
    "title", "email", "research_directions", "research_areas", "publications", "homepage_url",
    "profile_text", "orcid", "openalex_id", "school_cate", "note",
)
_ORIGIN = " || ".join(
    f"coalesce('{f}=' || (arg_min(source, seq) FILTER (trim({f}) <> '')) || ';', '')" for f in sorted(_FIELDS)
)
MERGED = f"""
merged AS (
  SELECT university, department, name, {', '.join(_first_by_seq(f) for f in _FIELDS)},
         coalesce(arg_min(source_url, seq) FILTER (source_url LIKE 'http%'), arg_min(source_url, seq) FILTER (source_url <> ''), '') AS source_url,
         {_first_by_seq('retrieved_at')}, {_first_by_seq('content_hash')},
         {_ORIGIN} AS field_sources, min(seq) AS first_seq
  FROM batches GROUP BY university, department, name
),
source_rows AS (
  SELECT university, department, name, source, min(seq) AS s FROM batches GROUP BY ALL
),
source_lists AS (
  SELECT university, department, name, string_agg(source, ',' ORDER BY s) AS sources, list(source ORDER BY s) AS source_list FROM source_rows GROUP BY ALL
),
cat AS (SELECT * FROM merged JOIN source_lists USING (university, department, name))"""


# --- paper records: one per document -----------------------------------------------------------
def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    key = F.col("doc_id")
    s = key.cast("string")
    digest = F.md5(F.col("text"))
    doi = F.concat(F.lit("10.1/"), F.substring(digest, 1, 12))
    spelled = (
        F.when(key % 5 == 0, doi)
        .when(key % 5 == 1, F.concat(F.lit("https://doi.org/"), doi))
        .when(key % 5 == 2, F.concat(F.lit("DOI:"), F.upper(doi)))
        .when(key % 5 == 3, F.concat(F.lit("http://dx.doi.org/"), doi))
        .otherwise(F.concat(F.lit(" http://doi.org/"), doi))
    )
    blank = F.lit("")
    return d.select(
        key.alias("seq"),
        F.concat(F.lit("w"), s).alias("id"),
        F.split("text", "\n", 2)[0].alias("title"),
        F.when(key % 17 != 0, (2015 + key % 10).cast("int")).alias("year"),
        F.when(digest < "8", spelled).alias("doi"),
        F.when(key % 2 == 0, blank).otherwise(F.concat(F.lit("venue "), (key % 9).cast("string"))).alias("venue"),
        F.array(F.col("lang"), F.col("source")).alias("topics"),
        F.when(key % 7 != 0, F.col("n_chars") % 100).alias("citation_count"),
        F.col("text").alias("abstract"),
        F.when(key % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://x.example/"), s)).alias("source_url"),
        F.col("source").alias("source_platform"),
        F.when(key % 3 == 0, F.array(F.concat(F.lit("Ann "), s)))
        .otherwise(F.array(F.concat(F.lit("Bo "), s), F.lit("Cy Same")))
        .alias("authors"),
        F.when(key % 3 == 0, blank).otherwise(F.concat(F.lit("Inst "), (key % 5).cast("string"))).alias("institution"),
        F.when(key % 4 == 0, F.array(F.lit("mirror"), F.col("source"))).otherwise(F.array().cast("array<string>")).alias("sources"),
        F.when(F.col("lang") == "en", F.array(F.lit("cs")))
        .when(F.col("lang") == "de", F.array(F.lit("medicine"), F.lit("cs")))
        .when(F.col("lang") == "fr", F.array(F.lit("physics")))
        .otherwise(F.array().cast("array<string>"))
        .alias("disciplines"),
        F.concat(F.lit("T"), F.floor(key / 20).cast("string")).alias("target_id"),
        F.col("lang"),
    )


_NOISE = r"[\s\-–—_.,;:!?，。；：！？、·''\"“”‘’()（）\[\]【】<>《》/\\|+&]+"
WORKS = rf"""
works AS (
  SELECT doc_id AS seq, 'w' || doc_id AS id, string_split(text, chr(10))[1] AS title,
         CASE WHEN doc_id % 17 <> 0 THEN 2015 + doc_id % 10 END AS year,
         CASE WHEN md5(text) < '8' THEN '10.1/' || left(md5(text), 12) ELSE '' END AS doi_key,
         CASE WHEN md5(text) < '8' THEN CASE doc_id % 5 WHEN 0 THEN '10.1/' || left(md5(text), 12) WHEN 1 THEN 'https://doi.org/10.1/' || left(md5(text), 12)
              WHEN 2 THEN 'DOI:' || upper('10.1/' || left(md5(text), 12)) WHEN 3 THEN 'http://dx.doi.org/10.1/' || left(md5(text), 12)
              ELSE ' http://doi.org/10.1/' || left(md5(text), 12) END END AS doi,
         CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'venue ' || (doc_id % 9) END AS venue, [lang, source] AS topics,
         CASE WHEN doc_id % 7 <> 0 THEN n_chars % 100 END AS citation_count, text AS abstract,
         CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'https://x.example/' || doc_id END AS source_url, source AS source_platform,
         CASE WHEN doc_id % 3 = 0 THEN ['Ann ' || doc_id] ELSE ['Bo ' || doc_id, 'Cy Same'] END AS authors,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Inst ' || (doc_id % 5) END AS institution,
         CASE WHEN doc_id % 4 = 0 THEN ['mirror', source] ELSE []::VARCHAR[] END AS sources,
         CASE lang WHEN 'en' THEN ['cs'] WHEN 'de' THEN ['medicine', 'cs'] WHEN 'fr' THEN ['physics'] ELSE []::VARCHAR[] END AS disciplines,
         'T' || (doc_id // 20) AS target_id, lang
  FROM documents
),
keyed AS (
  SELECT *, regexp_replace(lower(regexp_replace(title, '<[^>]+>', '', 'g')), '{_NOISE}', '', 'g') AS title_key
  FROM works WHERE trim(title) <> ''
)"""


# --- authored papers: one per order line, the supplier among its authors -----------------------
GIVEN = ("Wei", "Wang", "Bo", "Bai", "Lin", "Lan", "Jun", "Jia")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search targets: two suppliers share a family name, given names may share an initial."""
    s = load(spark, sf_dir, "supplier")
    n = F.broadcast(load(spark, sf_dir, "nation"))  # 25 nations
    key = F.col("s_suppkey")
    given = F.element_at(F.array(*[F.lit(g) for g in GIVEN]), (key % 8 + 1).cast("int"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("target_id"),
        given.alias("given"),
        F.concat(F.lit("Zhang"), F.lpad(F.floor(key / 2).cast("string"), 9, "0")).alias("family"),
        F.concat(given, F.lit(" Zhang"), F.lpad(F.floor(key / 2).cast("string"), 9, "0")).alias("name"),
        F.lit(None).cast("string").alias("english_name"),
        F.when(key % 10 == 9, F.lit("")).otherwise(F.col("n_name")).alias("institution"),
        F.col("s_nationkey").alias("nation"),
    )


def line_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, seq, title, authors in several spellings, institution) per order line."""
    line = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    who = suppliers(spark, sf_dir).select(F.col("target_id").alias("l_suppkey"), "given", "family", "name", "nation")
    j = line.join(who, "l_suppkey")
    k, mate = F.col("l_linenumber"), F.concat(F.lit("Li P"), F.col("l_partkey").cast("string"))
    spelled = (
        F.when(k == 2, F.concat("family", F.lit(", "), "given"))
        .when(k == 3, F.concat(F.substring("given", 1, 1), F.lit(". "), "family"))
        .when(k == 4, F.concat(F.lit("Ｚhang"), F.substring("family", 6, 12), F.lit(" "), "given"))
        .otherwise(F.col("name"))
    )
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("work_id"),
        ((F.col("l_orderkey") * 8 + k) * 1000000 + (F.col("l_partkey") * 31 + F.col("l_suppkey")) % 1000000).alias("seq"),
        F.col("l_suppkey").alias("target_id"),
        F.concat(F.lit("Paper "), F.floor(F.col("l_orderkey") / 2).cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("title"),
        F.when(k == 7, F.array(F.concat(spelled, F.lit(", "), mate, F.lit(", Mo Q1"))))
        .otherwise(F.array(spelled, mate, F.concat(F.lit("Mo Q"), (F.col("l_orderkey") % 1000).cast("string"))))
        .alias("authors"),
        F.array(F.col("name"), mate, F.concat(F.lit("Mo Q"), (F.col("l_orderkey") % 1000).cast("string"))).alias("plain_authors"),
        F.when(k == 6, F.lit(""))
        .when(k == 5, F.concat(F.lit("NATION_"), ((F.col("nation") + 1) % 25).cast("string")))
        .when(k == 4, F.concat(F.lit("Institute of NATION_"), F.col("nation").cast("string")))
        .otherwise(F.concat(F.lit("NATION_"), F.col("nation").cast("string")))
        .alias("institution"),
        "l_returnflag",
        "l_linestatus",
        "l_linenumber",
        "l_partkey",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same papers as search hits of their own supplier, not yet judged."""
    return line_papers(spark, sf_dir).select(
        "target_id", "work_id", "seq", "title", F.col("plain_authors").alias("authors"), "institution",
        F.lit(True).alias("belongs"), F.lit(False).alias("needs_review"), F.lit("").alias("disambig_reason"),
        "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey",
    )


PEOPLE = """
sup AS (
  SELECT s_suppkey AS target_id, ['Wei','Wang','Bo','Bai','Lin','Lan','Jun','Jia'][s_suppkey % 8 + 1] AS given, s_suppkey // 2 AS fam,
         ['Wei','Wang','Bo','Bai','Lin','Lan','Jun','Jia'][s_suppkey % 8 + 1] || ' Zhang' || lpad((s_suppkey // 2)::VARCHAR, 9, '0') AS name,
         CASE WHEN s_suppkey % 10 = 9 THEN '' ELSE n_name END AS school, s_nationkey AS nation
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
cand AS (
  SELECT sup.*, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS work_id,
         (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 31 + l_suppkey) % 1000000 AS seq,
         'Paper ' || (l_orderkey // 2) || '-' || l_suppkey AS title, l_linenumber AS k, l_partkey, l_orderkey, l_returnflag, l_linestatus,
         CASE l_linenumber WHEN 6 THEN '' WHEN 5 THEN 'NATION_' || ((nation + 1) % 25) WHEN 4 THEN 'Institute of NATION_' || nation ELSE 'NATION_' || nation END AS inst
  FROM lineitem JOIN sup ON l_suppkey = target_id
),
judged AS (
  SELECT *, school <> '' AND inst <> '' AND NOT contains(inst, school) AND NOT contains(school, inst) AS conflict,
         CASE WHEN school <> '' AND inst <> '' THEN contains(inst, school) OR contains(school, inst) END AS agree FROM cand
)"""


# --- contact records: customers with their orders as papers -------------------------------------
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    n = F.broadcast(load(spark, sf_dir, "nation"))  # 25 nations
    key = F.col("c_custkey")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("person"),
        F.col("c_name").alias("name"),
        F.concat(F.lit(" "), F.col("n_name")).alias("institution"),
        F.when(key % 12 == 0, F.lit(""))
        .otherwise(F.concat(F.col("c_mktsegment"), F.lit("学院 "), (key % 3).cast("string"), F.lit("系")))
        .alias("department"),
    )


def contact_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def customer(who):
        return F.concat(F.lit("Customer#"), F.lpad(who.cast("string"), 9, "0"))

    mate = F.when(k % 2 == 0, F.concat(F.lit("Agent "), F.floor(c / 10).cast("string"))).otherwise(
        F.concat(F.lit("Solo "), k.cast("string"))
    )
    direct = F.when(k % 11 == 0, F.array(customer(c + 1))).otherwise(F.array().cast("array<string>"))
    return o.select(
        c.alias("person"),
        k.alias("seq"),
        F.when(k % 3 == 0, F.concat(F.lit("Shared, "), F.floor(k / 30).cast("string")))
        .otherwise(F.concat(F.lit("Own "), k.cast("string")))
        .alias("title"),
        F.when(k % 5 == 0, F.concat(F.lit("10.5/"), F.floor(k / 40).cast("string"))).alias("doi"),
        F.lit("").alias("source_url"),
        F.when(c % 15 == 0, F.array().cast("array<string>"))
        .otherwise(F.concat(F.array(customer(c), mate), direct))
        .alias("authors"),
    )


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lists of supervisors somebody means to write to, one per order."""
    o = load(spark, sf_dir, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return o.select(
        k.alias("group_id"),
        F.array_distinct(F.array(c, c + 1, c + k % 40)).alias("members"),
    )


CONTACTS = """
con AS (
  SELECT c_custkey AS person, lower(c_name) AS own, regexp_replace(lower(n_name), '\\s+', '', 'g') AS inst,
         CASE WHEN c_custkey % 12 = 0 THEN '' ELSE c_mktsegment || '学院' END AS college
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
pap AS (
  SELECT o_custkey AS person, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'Shared, ' || (o_orderkey // 30) ELSE 'Own ' || o_orderkey END AS title,
         CASE WHEN o_orderkey % 3 = 0 THEN 'shared' || (o_orderkey // 30) ELSE 'own' || o_orderkey END AS tkey,
         CASE WHEN o_orderkey % 5 = 0 THEN '10.5/' || (o_orderkey // 40) END AS dkey,
         CASE WHEN o_custkey % 15 = 0 THEN [] ELSE list_concat([CASE WHEN o_orderkey % 2 = 0 THEN 'agent' || (o_custkey // 10) ELSE 'solo' || o_orderkey END],
              CASE WHEN o_orderkey % 11 = 0 THEN ['customer#' || lpad((o_custkey + 1)::VARCHAR, 9, '0')] ELSE [] END) END AS mates
  FROM orders
),
keys AS (SELECT person, seq, title, tkey AS key FROM pap UNION ALL SELECT person, seq, title, dkey FROM pap WHERE dkey IS NOT NULL),
counts AS (SELECT person, m AS coauthor, count(*) AS n FROM (SELECT person, unnest(mates) AS m FROM pap) GROUP BY ALL),
sel AS (
  SELECT o_orderkey AS group_id, m.person, min(m.pos) AS pos FROM orders,
    LATERAL (VALUES (o_custkey, 1), (o_custkey + 1, 2), (o_custkey + o_orderkey % 40, 3)) AS m(person, pos)
  WHERE m.person IN (SELECT person FROM con) GROUP BY ALL
),
gp AS (SELECT a.group_id, a.person AS left_id, b.person AS right_id FROM sel a JOIN sel b ON a.group_id = b.group_id AND a.pos < b.pos),
pairs AS (SELECT DISTINCT left_id, right_id FROM gp),
shared AS (
  SELECT DISTINCT left_id, right_id, l.seq, l.title FROM pairs JOIN keys l ON l.person = left_id JOIN keys r ON r.person = right_id AND r.key = l.key
),
direct AS (
  SELECT left_id, right_id FROM pairs JOIN con l ON l.person = left_id JOIN con r ON r.person = right_id
  WHERE EXISTS (SELECT 1 FROM counts c WHERE c.person = left_id AND c.coauthor = r.own) OR EXISTS (SELECT 1 FROM counts c WHERE c.person = right_id AND c.coauthor = l.own)
),
steady AS (
  SELECT left_id, right_id, a.coauthor FROM pairs JOIN counts a ON a.person = left_id AND a.n >= 2 JOIN counts b ON b.person = right_id AND b.n >= 2 AND b.coauthor = a.coauthor
)"""
