"""Roster and catalog queries over all customers."""

from pyspark.sql import functions as F

from scholarmatch.operators import catalog as ops
from scholarmatch.operators import discover
from scholarmatch.plans import tables
from scholarmatch.plans.tables import BATCHES, CATALOG, MERGED, ROSTER, load
from scholarmatch.sources import roster as roster_source
from scholarmatch.sources import tables as stored_tables
from scholarmatch.sources.tables import scratch_path

STAMP, SITE = "2024-03-01", "https://faculty.example.edu"
ROOTS, SUFFIXES, ALLOWED = ("11", "77", "404"), ("Professor",), r"^Name[0-9]{1,9}$"
MUST_SURVIVE = ("Name1", "Name2", "Name3 ", "Nobody", "Name11")


def _items(spark, sf):
    return roster_source.unwrap_payloads(tables.roster_payloads(spark, sf))


def _entries(spark, sf):
    return roster_source.load_roster(_items(spark, sf))


def _reviews(spark, sf):
    return roster_source.load_reviews(_items(spark, sf))


def _catalog(spark, sf):
    return ops.catalog_upsert(None, tables.catalog_batches(spark, sf))


def _official(spark, sf):
    """Supervisors the crawl saw: customers with an urgent order pending."""
    seen = (
        load(spark, sf, "orders")
        .where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
        .select(F.col("o_custkey").alias("c_custkey"))
        .distinct()
    )
    n = F.broadcast(load(spark, sf, "nation"))  # 25 nations
    c = load(spark, sf, "customer").join(seen, "c_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("n_name").alias("university"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("NEW")).alias("department"),
        F.col("c_name").alias("supervisor"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("crawl note")).otherwise(F.lit("")).alias("note"),
    )


def _roster(spark, sf):
    base = ops.fresh_roster(_entries(spark, sf))
    return ops.roster_upsert(base, _official(spark, sf), "official", SITE, STAMP)


def _flat(df):
    out = df
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            out = out.withColumn(f.name, F.array_join(f.name, ",")) if f.name == "sources" else out.withColumn(
                f.name, F.array_join(f.name, "|")
            )
        if f.dataType.typeName() == "map":
            entries = F.array_sort(F.map_entries(f.name))
            out = out.withColumn(
                f.name,
                F.concat(F.lit(""), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")),
            )
    return out


def load_roster(spark, sf):
    return _entries(spark, sf)


def load_reviews(spark, sf):
    return _reviews(spark, sf)


def catalog_upsert(spark, sf):
    return _flat(_catalog(spark, sf))


def roster_upsert(spark, sf):
    return _roster(spark, sf)


def roster_reload(spark, sf):
    return ops.roster_upsert(_roster(spark, sf), _entries(spark, sf), "community")


def clear_source(spark, sf):
    kept, _ = ops.clear_source(_catalog(spark, sf), "official")
    return _flat(kept).select("university", "department", "name", "sources")


def clear_source_count(spark, sf):
    return ops.clear_source(_catalog(spark, sf), "official")[1]


def clear_roster_official(spark, sf):
    return ops.clear_official_roster(_roster(spark, sf))[0]


def _clean(c):
    return F.regexp_replace(c, " Professor$", "")


def normalize_names(spark, sf):
    out, _ = ops.normalize_names(_catalog(spark, sf), _clean)
    return _flat(out).select("university", "department", "name", "title", "email", "homepage_url", "orcid", "sources")


def normalize_names_counts(spark, sf):
    return ops.normalize_names(_catalog(spark, sf), _clean)[1]


def _reject(c):
    return ops.name_verdict(c, ROOTS, SUFFIXES, ALLOWED)["verdict"] == "delete"


def delete_by_rule(spark, sf):
    return ops.delete_by_rule(_catalog(spark, sf), _reject)[0].select(*ops.KEY)


def delete_by_rule_count(spark, sf):
    return ops.delete_by_rule(_catalog(spark, sf), _reject)[1]


def delete_by_rule_samples(spark, sf):
    return ops.delete_by_rule(_catalog(spark, sf), _reject)[2]


def _edited(spark, sf, change):
    """The catalog after an edit of its stored table."""
    path = scratch_path(spark, "catalog")
    stored_tables.write_table(_catalog(spark, sf), path, "catalog")
    stored_tables.edit_table(spark, path, "catalog", change)
    return stored_tables.read_table(spark, path, "catalog")


def stored_clear_source(spark, sf):
    kept = _edited(spark, sf, lambda rows: ops.clear_source(rows, "official", "NATION_6")[0])
    return _flat(kept).select("university", "department", "name", "sources")


def stored_normalize_names(spark, sf):
    kept = _edited(spark, sf, lambda rows: ops.normalize_names(rows, _clean)[0])
    return _flat(kept).select("university", "department", "name", "title", "email", "homepage_url", "orcid", "sources")


def stored_delete_by_rule(spark, sf):
    return _edited(spark, sf, lambda rows: ops.delete_by_rule(rows, _reject)[0]).select(*ops.KEY)


def delete_keys(spark, sf):
    """Rows of customers with a finished urgent order are taken out by key."""
    o = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    gone = tables.catalog_batches(spark, sf).join(o.select(F.col("o_custkey").alias("custkey")), "custkey", "left_semi")
    return ops.delete_keys(_catalog(spark, sf), gone).select(*ops.KEY)


def lookup_advisor(spark, sf):
    o = load(spark, sf, "orders")
    requests = o.select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("Supplier"), (F.col("o_custkey") % 100).cast("string")))
        .otherwise(F.concat(F.lit("Name"), F.floor(F.col("o_custkey") / 2).cast("string")))
        .alias("name"),
        F.when(F.col("o_orderkey") % 6 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 30).cast("string")))
        .alias("university"),
    )
    n = F.broadcast(load(spark, sf, "nation"))
    faculty = load(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("university"),
        F.lit("FACULTY").alias("department"),
        F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string")).alias("name"),
    )
    cat = _catalog(spark, sf).select("university", "department", "name")
    return ops.lookup_advisor(requests, cat, faculty)


def lookup_identity_key(spark, sf):
    pages = load(spark, sf, "pages")
    cat = pages.select(
        F.lit("U").alias("university"),
        F.lit("D").alias("department"),
        F.concat(F.lit("Person "), F.col("page_id").cast("string")).alias("name"),
        F.col("url").alias("homepage_url"),
    )
    from scholarmatch.functions import text

    messy = F.concat(
        F.regexp_replace(F.regexp_extract("url", r"^([^?#]*)", 1), r"/+$", ""), F.lit("/?session=1#frag")
    )
    requests = pages.select(F.col("page_id").alias("request_id"), text.identity_key(messy).alias("identity_key"))
    return ops.lookup_identity_key(requests, cat).select("request_id", "identity_key", "name")


def browse(spark, sf):
    return _flat(ops.browse(_catalog(spark, sf), "NATION_3")).select("university", "department", "name", "title")


def browse_reviews(spark, sf):
    people = _entries(spark, sf).where("university = 'NATION_3'").select("university", F.col("supervisor").alias("name"))
    return ops.reviews_for(_reviews(spark, sf), people)


def browse_roster_names(spark, sf):
    return ops.roster_names(_roster(spark, sf), "NATION_3")


def facet_counts(spark, sf):
    return ops.facet_counts(_entries(spark, sf))


def facet_departments(spark, sf):
    return ops.facet_counts(_entries(spark, sf), "department", "NATION_3")


def field_fill_rates(spark, sf):
    return ops.field_fill_rates(_catalog(spark, sf)).withColumn("rate", F.round("rate", 6))


def source_breakdown(spark, sf):
    return ops.source_breakdown(_catalog(spark, sf))


def completeness(spark, sf):
    c = tables.catalog(spark, sf)
    return c.select(
        *ops.KEY,
        discover.completeness(c).alias("completeness"),
        F.array_join(discover.missing_fields(c), ",").alias("missing"),
    )


def roster_stats(spark, sf):
    return ops.roster_stats(_roster(spark, sf), _reviews(spark, sf))


def roster_summary(spark, sf):
    return ops.roster_summary(_entries(spark, sf))


def top_universities(spark, sf):
    return ops.top_universities(_entries(spark, sf), 10)


def library_quality(spark, sf):
    out = ops.library_quality(_catalog(spark, sf), ROOTS, MUST_SURVIVE, SUFFIXES, ALLOWED)
    return out.withColumn("value", F.round("value", 6))


def name_quality(spark, sf):
    return ops.name_quality(_catalog(spark, sf), ROOTS, SUFFIXES, ALLOWED)


def _field_candidates(spark, sf):
    b = tables.catalog_batches(spark, sf)
    label = F.create_map(
        F.lit("manual"), F.lit("manual"), F.lit("official"), F.lit("structured"), F.lit("community"), F.lit("rules")
    )
    values = {
        "name": F.when(F.col("source") == "community", F.lit("")).otherwise(F.col("name")),
        "institution": F.when(F.col("source") == "manual", F.lit(" ")).otherwise(F.col("university")),
        "department": F.when(F.col("custkey") % 8 == 0, F.lit("")).otherwise(F.col("department")),
        "title": F.col("title"),
        "email": F.col("email"),
        "declared_interests": F.array_join("research_directions", "、"),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items()])
    return b.select(F.col("custkey").alias("entity"), label[F.col("source")].alias("source"), F.explode(listed).alias("x")).select(
        "entity", "source", "x.field", "x.value"
    )


def field_report(spark, sf):
    return ops.field_report(_field_candidates(spark, sf))


def field_report_summary(spark, sf):
    return ops.field_report_summary(field_report(spark, sf))


_NAMES = (
    "load_roster load_reviews catalog_upsert roster_upsert roster_reload clear_source clear_source_count "
    "stored_clear_source stored_normalize_names stored_delete_by_rule clear_roster_official normalize_names normalize_names_counts delete_by_rule delete_by_rule_count "
    "delete_by_rule_samples delete_keys lookup_advisor lookup_identity_key browse browse_reviews browse_roster_names "
    "facet_counts facet_departments field_fill_rates source_breakdown completeness roster_stats roster_summary "
    "top_universities library_quality name_quality field_report field_report_summary"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_CAT = f"{BATCHES}, {MERGED}"
_OFFICIAL = f"""
crawled AS (
  SELECT n_name AS university, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NEW' END AS department, c_name AS supervisor,
         CASE WHEN c_custkey % 3 = 0 THEN 'crawl note' ELSE '' END AS note
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
),
ros AS (
  SELECT coalesce(e.university, c.university) AS university, coalesce(e.department, c.department) AS department,
         coalesce(e.supervisor, c.supervisor) AS supervisor,
         CASE WHEN coalesce(e.note, '') = '' THEN coalesce(c.note, '') ELSE e.note END AS note, coalesce(e.school_cate, '') AS school_cate,
         e.supervisor IS NOT NULL AS in_community, c.supervisor IS NOT NULL AS in_official,
         CASE WHEN c.supervisor IS NOT NULL THEN '{SITE}' ELSE '' END AS source_url,
         CASE WHEN c.supervisor IS NOT NULL THEN '{STAMP}' ELSE '' END AS retrieved_at
  FROM entries e FULL JOIN crawled c ON e.university = c.university AND e.department = c.department AND e.supervisor = c.supervisor
)"""
_VERDICT = """
judged AS (
  SELECT university, department, name,
         CASE WHEN ends_with(r, 'Professor') THEN left(r, len(r) - 9) ELSE r END AS clean_name, r
  FROM (SELECT *, replace(name, ' ', '') AS r FROM cat)
),
verdicts AS (
  SELECT university, department, name, clean_name,
         CASE WHEN contains(clean_name, '11') THEN '11' WHEN contains(clean_name, '77') THEN '77' WHEN contains(clean_name, '404') THEN '404' ELSE '' END AS matched_root
  FROM judged
),
named AS (
  SELECT *, CASE WHEN matched_root <> '' OR NOT regexp_full_match(clean_name, 'Name[0-9]{1,9}') THEN 'delete' ELSE 'keep' END AS verdict FROM verdicts
)"""
_NORM = """
rich AS (
  SELECT *, regexp_replace(name, ' Professor$', '') AS clean,
    (title <> '')::INT + (email <> '')::INT + (homepage_url <> '')::INT + (trim(profile_text) <> '')::INT + (orcid <> '')::INT + (openalex_id <> '')::INT
    + (research_directions <> '')::INT + (research_areas <> '')::INT + (publications <> '')::INT AS r
  FROM cat
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY university, department, clean ORDER BY r DESC, name = clean DESC, name DESC) AS n FROM rich
)"""
_FIELD_ROWS = """
cand AS (
  SELECT custkey AS entity, CASE source WHEN 'manual' THEN 0 WHEN 'official' THEN 1 ELSE 3 END AS p,
         CASE source WHEN 'manual' THEN 'manual' WHEN 'official' THEN 'structured' ELSE 'rules' END AS source,
         unnest(['name','institution','department','title','email','declared_interests']) AS field,
         unnest([CASE WHEN source = 'community' THEN '' ELSE name END, CASE WHEN source = 'manual' THEN ' ' ELSE university END,
                 CASE WHEN custkey % 8 = 0 THEN '' ELSE department END, title, email, replace(research_directions, '|', '、')]) AS value
  FROM batches
),
best AS (SELECT entity, field, arg_min(value, p) FILTER (trim(value) <> '') AS value, arg_min(source, p) FILTER (trim(value) <> '') AS source FROM cand GROUP BY ALL),
report AS (
  SELECT entity, field, coalesce(value, '') AS value,
         CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN field = 'email' AND value LIKE '%@mail.com' THEN 'INFERRED' ELSE 'CONFIRMED' END AS status,
         coalesce(source, 'none') AS source,
         CASE WHEN field = 'email' AND value LIKE '%@mail.com' THEN 'not a school mail domain' ELSE '' END AS note
  FROM best
)"""

ORACLES = {
    "load_roster": f"WITH {ROSTER} SELECT * FROM entries",
    "load_reviews": f"WITH {ROSTER} SELECT * FROM revs",
    "catalog_upsert": f"WITH {_CAT} SELECT * EXCLUDE (first_seq, source_list) FROM cat",
    "roster_upsert": f"WITH {ROSTER}, {_OFFICIAL} SELECT * FROM ros",
    "roster_reload": f"""WITH {ROSTER}, {_OFFICIAL} SELECT * FROM ros WHERE in_official
UNION ALL SELECT university, department, supervisor, note, school_cate, true, false, '', '' FROM entries e
WHERE NOT EXISTS (SELECT 1 FROM ros r WHERE r.in_official AND r.university = e.university AND r.department = e.department AND r.supervisor = e.supervisor)""",
    "stored_normalize_names": f"""WITH {_CAT}, {_NORM},
toks AS (SELECT university, department, clean, s, min((CASE WHEN n = 1 THEN '' ELSE name END) || '/' || i) AS pos
         FROM (SELECT university, department, clean, n, name, unnest(source_list) AS s, generate_subscripts(source_list, 1) AS i FROM ordered) GROUP BY ALL),
united AS (SELECT university, department, clean, string_agg(s, ',' ORDER BY pos) AS sources FROM toks GROUP BY ALL)
SELECT o.university, o.department, o.clean AS name, title, email, homepage_url, orcid, u.sources
FROM ordered o JOIN united u ON u.university = o.university AND u.department = o.department AND u.clean = o.clean WHERE n = 1""",
    "stored_delete_by_rule": f"WITH {_CAT}, {_VERDICT} SELECT university, department, name FROM named WHERE verdict = 'keep'",
    "stored_clear_source": f"""WITH {_CAT} SELECT university, department, name, CASE WHEN university = 'NATION_6' THEN array_to_string(list_filter(source_list, lambda s: s <> 'official'), ',') ELSE sources END AS sources
FROM cat WHERE NOT (university = 'NATION_6' AND sources = 'official')""",
    "clear_source": f"""WITH {_CAT} SELECT university, department, name, array_to_string(list_filter(source_list, lambda s: s <> 'official'), ',') AS sources
FROM cat WHERE sources <> 'official'""",
    "clear_source_count": f"WITH {_CAT} SELECT count(*) FILTER (sources = 'official') AS removed FROM cat",
    "clear_roster_official": f"""WITH {ROSTER}, {_OFFICIAL} SELECT university, department, supervisor, note, school_cate, in_community,
false AS in_official, '' AS source_url, '' AS retrieved_at FROM ros WHERE in_community""",
    "normalize_names": f"""WITH {_CAT}, {_NORM},
toks AS (SELECT university, department, clean, s, min((CASE WHEN n = 1 THEN '' ELSE name END) || '/' || i) AS pos
         FROM (SELECT university, department, clean, n, name, unnest(source_list) AS s, generate_subscripts(source_list, 1) AS i FROM ordered) GROUP BY ALL),
united AS (SELECT university, department, clean, string_agg(s, ',' ORDER BY pos) AS sources FROM toks GROUP BY ALL)
SELECT o.university, o.department, o.clean AS name, title, email, homepage_url, orcid, u.sources
FROM ordered o JOIN united u ON u.university = o.university AND u.department = o.department AND u.clean = o.clean WHERE n = 1""",
    "normalize_names_counts": f"""WITH {_CAT}, {_NORM}, g AS (SELECT count(*) AS n, bool_or(name = clean) AS has FROM rich GROUP BY university, department, clean)
SELECT sum((NOT has)::INT) AS renamed, sum(n - 1) AS merged FROM g""",
    "delete_by_rule": f"WITH {_CAT}, {_VERDICT} SELECT university, department, name FROM named WHERE verdict = 'keep'",
    "delete_by_rule_count": f"WITH {_CAT}, {_VERDICT} SELECT count(*) AS removed FROM named WHERE verdict = 'delete'",
    "delete_by_rule_samples": f"""WITH {_CAT}, {_VERDICT} SELECT university, department, name, sources FROM named JOIN cat USING (university, department, name)
WHERE verdict = 'delete' ORDER BY university, department, name LIMIT 20""",
    "delete_keys": f"""WITH {_CAT} SELECT university, department, name FROM cat WHERE (university, department, name) NOT IN (
SELECT (university, department, name) FROM batches WHERE custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'))""",
    "lookup_advisor": f"""WITH {_CAT},
fac AS (SELECT n_name AS university, 'FACULTY' AS department, 'Supplier' || s_suppkey AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
req AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 10 = 0 THEN 'Supplier' || (o_custkey % 100) ELSE 'Name' || (o_custkey // 2) END AS asked,
        CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'NATION_' || (o_orderkey % 30) END AS school FROM orders),
hits AS (SELECT request_id, university, department, name, school = '' OR contains(university, school) OR contains(school, university) AS ok FROM req JOIN cat ON name = asked),
flagged AS (SELECT *, bool_or(ok) OVER (PARTITION BY request_id) AS any_ok FROM hits)
SELECT request_id, university, department, name, CASE WHEN ok THEN 'catalog' ELSE 'homonym' END AS origin FROM flagged WHERE ok OR NOT any_ok
UNION ALL SELECT request_id, university, department, name, 'faculty' FROM req JOIN fac ON name = asked
WHERE (school = '' OR contains(university, school) OR contains(school, university)) AND NOT EXISTS (SELECT 1 FROM cat WHERE cat.name = asked)""",
    "lookup_identity_key": r"""WITH k AS (
  SELECT page_id, url, 'Person ' || page_id AS name, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS host,
         regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
keyed AS (SELECT *, 'prof_' || left(sha256('homepage:' || host || CASE WHEN path = '' THEN '/' ELSE path END), 16) AS identity_key FROM k),
once AS (SELECT identity_key, arg_min(name, (url, name)) AS name FROM keyed GROUP BY 1)
SELECT page_id AS request_id, identity_key, once.name FROM keyed JOIN once USING (identity_key)""",
    "browse": f"WITH {_CAT} SELECT university, department, name, title FROM cat WHERE university = 'NATION_3'",
    "browse_reviews": f"WITH {ROSTER} SELECT * FROM revs WHERE university = 'NATION_3'",
    "browse_roster_names": f"WITH {ROSTER}, {_OFFICIAL} SELECT DISTINCT supervisor FROM ros WHERE university = 'NATION_3'",
    "facet_counts": f"WITH {ROSTER} SELECT university AS value, count(*) AS n FROM entries GROUP BY 1",
    "facet_departments": f"WITH {ROSTER} SELECT department AS value, count(*) AS n FROM entries WHERE university = 'NATION_3' GROUP BY 1",
    "field_fill_rates": f"WITH {_CAT} SELECT field, round(rate, 6) AS rate FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, avg((trim({f}) <> '')::INT) AS rate FROM cat"
        for f in ("name", "university", "department", "title", "email", "research_directions", "research_areas", "publications",
                  "homepage_url", "profile_text", "orcid", "openalex_id", "school_cate", "note")
    ) + " UNION ALL SELECT '_total', count(*)::DOUBLE FROM cat)",
    "source_breakdown": f"WITH {_CAT} SELECT source, count(*) AS n FROM source_rows GROUP BY 1",
    "completeness": f"""WITH {CATALOG} SELECT university, department, name,
((len(research_directions) > 0)::INT + (title <> '')::INT + (email <> '')::INT + (homepage_url <> '')::INT) / 4.0 AS completeness,
array_to_string(list_filter([CASE WHEN title = '' THEN 'title' END, CASE WHEN email = '' THEN 'email' END,
  CASE WHEN len(research_directions) = 0 THEN 'research_directions' END, CASE WHEN homepage_url = '' THEN 'homepage_url' END,
  CASE WHEN orcid = '' AND openalex_id = '' THEN 'orcid' END], lambda x: x IS NOT NULL), ',') AS missing FROM catalog""",
    "roster_stats": f"""WITH {ROSTER}, {_OFFICIAL} SELECT count(*) AS advisors, (SELECT count(*) FROM revs) AS reviews,
count(*) FILTER (in_community) AS from_community, count(*) FILTER (in_official) AS from_official, count(*) FILTER (in_community AND in_official) AS from_both FROM ros""",
    "roster_summary": f"WITH {ROSTER} SELECT count(*) AS entries, count(DISTINCT university) AS universities, count(DISTINCT (university, department)) AS departments FROM entries",
    "top_universities": f"WITH {ROSTER} SELECT university, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, university LIMIT 10",
    "library_quality": f"""WITH {_CAT}, {_VERDICT}
SELECT 'library.advisors' AS key, count(*)::DOUBLE AS value, true AS higher_is_better, NULL::DOUBLE AS gate FROM cat
UNION ALL SELECT 'library.ui_word_residue', count(*)::DOUBLE, false, 0 FROM named WHERE verdict = 'delete'
UNION ALL SELECT 'library.must_survive_missing', count(*)::DOUBLE, false, 0 FROM (VALUES ('Name1'),('Name2'),('Name3 '),('Nobody'),('Name11')) AS m(n) WHERE n NOT IN (SELECT name FROM cat)
UNION ALL SELECT 'library.field_fill_rate', round(avg((title <> '' OR email <> '' OR research_directions <> '')::INT), 6), true, NULL FROM cat""",
    "name_quality": f"WITH {_CAT}, {_VERDICT} SELECT university, department, name, clean_name, verdict, matched_root FROM named",
    "field_report": f"WITH {BATCHES}, {_FIELD_ROWS} SELECT * FROM report",
    "field_report_summary": f"""WITH {BATCHES}, {_FIELD_ROWS} SELECT entity, count(*) FILTER (status <> 'UNKNOWN') AS known, count(*) AS total,
coalesce(string_agg(field, ',' ORDER BY field) FILTER (status = 'UNKNOWN'), '') AS unknown_fields,
count(*) FILTER (status = 'UNKNOWN' AND field IN ('name', 'institution')) AS missing_required FROM report GROUP BY entity""",
}
