"""The eight feeds, with payloads made from all documents in each feed's shape."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarmatch.sources import feeds, tables as store
from scholarmatch.plans import tables as model
from scholarmatch.plans.tables import load


def _docs(spark, sf):
    d = load(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("seq"), "text", "lang", "source", "n_chars",
        F.split("text", "\n", 2)[0].alias("title"), k.cast("string").alias("s"),
        F.concat(F.lit("10.7/"), F.col("source"), F.lit("."), k.cast("string")).alias("doi"),
    )


def _flat(df):
    for c in ("topics", "authors", "disciplines"):
        df = df.withColumn(c, F.array_join(c, "|"))
    return df.withColumn("abstract", F.md5("abstract")).select(*feeds.WORK)


def _st(**c):
    return F.struct(*[v.alias(k) for k, v in c.items()])


def _named(v):
    return F.struct(v.alias("display_name"))


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def _spots(texts: pd.Series) -> pd.Series:
    """Word -> positions, as the feed ships abstracts; made inside the row, so no word is shuffled."""
    def of(text):
        if text is None:
            return None
        at = {}
        for i, word in enumerate(text.split(" ")):
            at.setdefault(word, []).append(i)
        return at

    return texts.map(of)


def conform_openalex(spark, sf):
    d, k = _docs(spark, sf).withColumn("spots", _spots("text")), F.col("seq")
    field = F.element_at(F.array(F.lit("Computer Science"), F.lit(" Medicine "), F.lit("Unknown"), F.lit("Energy")), (k % 4 + 1).cast("int"))
    inst = F.when(k % 5 == 0, F.array().cast("array<struct<display_name:string>>")).otherwise(
        F.array(_named(F.lit("U1")), _named(F.concat(F.lit("U"), (k % 3).cast("string"))), _named(F.lit("U4")), _named(F.lit("U5")))
    )
    body = _st(
        id=F.concat(F.lit("https://openalex.org/W"), "s"),
        doi=F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/"), "doi")),
        title=F.when(k % 50 != 0, F.col("title")),
        publication_year=F.when(k % 4 != 0, (2000 + k % 20)),
        cited_by_count=F.col("n_chars"),
        abstract_inverted_index=F.when(k % 6 != 0, F.col("spots")),
        authorships=F.array(
            _st(author=_named(F.concat(F.lit("Ann "), "s")), institutions=inst),
            _st(author=_named(F.lit("")), institutions=inst),
        ),
        primary_location=_st(source=_named(F.col("source"))),
        primary_topic=_st(display_name=F.col("lang"), subfield=_named(F.when(k % 2 == 0, F.lit("sub"))), field=_named(field)),
    )
    return _flat(feeds.conform_openalex(d.select("seq", F.to_json(body).alias("payload"))))


def conform_crossref(spark, sf):
    d, k = _docs(spark, sf), F.col("seq")

    def date(v):
        return F.when(v.isNotNull(), F.struct(F.array(F.array(v)).alias("date-parts")))

    body = F.struct(
        F.when(k % 4 != 0, F.concat(F.lit(" "), "doi")).alias("DOI"),
        F.when(k % 9 == 0, F.array(F.lit("  "))).otherwise(F.array(F.concat(F.lit(" "), "title"))).alias("title"),
        F.when(k % 2 == 0, F.array(F.col("source"))).alias("container-title"),
        F.array(
            _st(given=F.lit("Bo"), family=F.concat(F.lit(" L"), "s"), name=F.lit(None).cast("string")),
            _st(given=F.lit(None).cast("string"), family=F.lit(None).cast("string"), name=F.lit("The  Group")),
            _st(given=F.lit(None).cast("string"), family=F.lit(None).cast("string"), name=F.lit(" ")),
        ).alias("author"),
        date(F.when(k % 3 == 0, F.lit("n/a"))).alias("published-print"),
        date(F.when(k % 5 == 0, F.lit("0")).when(k % 2 == 0, (1990 + k % 30).cast("string"))).alias("published-online"),
        date(F.when(k % 7 != 0, F.lit("2001"))).alias("issued"),
        F.col("n_chars").alias("is-referenced-by-count"),
        F.when(k % 2 == 1, F.col("text")).alias("abstract"),
    )
    return _flat(feeds.conform_crossref(d.select("seq", F.to_json(body).alias("payload"))))


def conform_dblp(spark, sf):
    d, k = _docs(spark, sf), F.col("seq")
    one = F.when(k % 3 == 0, F.to_json(F.struct(F.concat(F.lit("Ann "), "s").alias("text")))).when(
        k % 3 == 1, F.concat(F.lit('[{"text": "Ann '), "s", F.lit('"}, "Plain Name", {"text": " "}]'))
    ).otherwise(F.lit('"Solo"'))
    info = F.concat(
        F.lit('{"info": '),
        F.regexp_replace(
            F.to_json(
                _st(
                    title=F.when(k % 40 == 0, F.lit(" ")).otherwise(F.col("title")),
                    year=F.when(k % 5 == 0, F.lit("19x")).otherwise((1995 + k % 25).cast("string")),
                    doi=F.when(k % 4 == 0, F.col("doi")),
                    key=F.when(k % 2 == 0, F.concat(F.lit("conf/"), "s")),
                    venue=F.col("source"),
                    ee=F.when(k % 3 == 0, F.lit("https://ee.example/x")),
                    url=F.lit("https://dblp.example/x"),
                    authors=F.lit("@@"),
                )
            ),
            '"@@"', "@@",
        ),
        F.lit("}"),
    )
    info = F.replace(info, F.lit("@@"), F.concat(F.lit('{"author": '), one, F.lit("}")))
    body = F.concat(F.lit('{"result": {"hits": {"hit": '), F.when(k % 2 == 0, info).otherwise(F.concat(F.lit("["), info, F.lit("]"))), F.lit("}}}"))
    return _flat(feeds.conform_dblp(d.select("seq", F.when(k % 60 == 59, F.lit("<html>challenge</html>")).otherwise(body).alias("payload"))))


def conform_europepmc(spark, sf):
    d, k = _docs(spark, sf), F.col("seq")
    none = F.lit(None).cast("string")
    body = _st(
        id=F.concat(F.lit("I"), "s"),
        pmid=F.when(k % 3 == 0, F.concat(F.lit("P"), "s")),
        doi=F.when(k % 4 == 0, F.col("doi")),
        title=F.when(k % 30 == 0, F.lit("")).otherwise(F.col("title")),
        source=F.when(k % 5 == 0, F.lit("PPR")),
        pubYear=F.when(k % 6 == 0, none).otherwise((1980 + k % 40).cast("string")),
        abstractText=F.col("text"),
        citedByCount=k % 11,
        journalInfo=_st(journal=_st(title=F.when(k % 2 == 0, F.col("source")))),
        authorList=_st(
            author=F.array(
                _st(fullName=F.concat(F.lit("Li "), "s"), lastName=F.lit("Li"), affiliation=F.lit(" ")),
                _st(fullName=none, lastName=F.lit("Wu"), affiliation=F.when(k % 2 == 0, F.concat(F.lit("Lab  "), "lang"))),
            )
        ),
    )
    return _flat(feeds.conform_europepmc(d.select("seq", F.to_json(body).alias("payload"))))


def conform_arxiv(spark, sf):
    d, k = _docs(spark, sf), F.col("seq")

    def esc(c):
        safe = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
        return F.replace(F.replace(safe, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def tag(name, c):
        return F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))

    category = F.element_at(F.array(F.lit("cs.CL"), F.lit("math.AG"), F.lit("q-bio"), F.lit("zzz.Q")), (k % 4 + 1).cast("int"))
    body = F.concat(
        F.lit('<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'),
        tag("id", F.concat(F.lit("http://arxiv.org/abs/"), "s")),
        tag("title", F.when(k % 25 == 0, F.lit("  ")).otherwise(esc(F.col("title")))),
        tag("published", F.when(k % 7 == 0, F.lit("soon")).otherwise(F.concat((2005 + k % 15).cast("string"), F.lit("-01-01T00:00:00Z")))),
        tag("summary", esc(F.col("text"))),
        tag("author", tag("name", F.concat(F.lit("Kim "), "s"))),
        F.when(k % 2 == 0, tag("author", tag("name", F.lit("Ola Nordmann")))).otherwise(F.lit("")),
        tag("arxiv:doi", F.when(k % 5 == 0, F.col("doi"))),
        tag("arxiv:journal_ref", F.when(k % 3 == 0, F.concat(F.lit("J "), "source"))),
        F.when(k % 6 == 5, F.lit("")).otherwise(F.concat(F.lit('<arxiv:primary_category term="'), category, F.lit('"/>'))),
        F.lit("</entry>"),
    )
    return _flat(feeds.conform_arxiv(d.select("seq", body.alias("payload"))))


def conform_scopus(spark, sf):
    d, k = _docs(spark, sf), F.col("seq")
    body = F.struct(
        F.when(k % 20 == 0, F.lit(" ")).otherwise(F.col("title")).alias("dc:title"),
        F.when(k % 3 == 0, F.col("doi")).alias("prism:doi"),
        F.when(k % 2 == 0, F.concat(F.lit("2-s2.0-"), "s")).alias("eid"),
        F.concat(F.lit("https://api.example/"), "s").alias("prism:url"),
        F.when(k % 4 == 0, F.lit("many")).otherwise((k % 50).cast("string")).alias("citedby-count"),
        F.when(k % 5 != 0, F.concat((1999 + k % 20).cast("string"), F.lit("-05-01"))).alias("prism:coverDate"),
        F.when(k % 2 == 0, F.lit("2010 May")).otherwise(F.lit("May 2010")).alias("prism:coverDisplayDate"),
        F.col("source").alias("prism:publicationName"),
        F.when(k % 3 != 1, F.concat(F.lit("Roe "), "s")).alias("dc:creator"),
        F.when(k % 2 == 1, F.col("lang")).alias("affilname"),
    )
    return _flat(feeds.conform_scopus(d.select("seq", F.to_json(body).alias("payload"))))


def conform_springer(spark, sf):
    d, k = _docs(spark, sf), F.col("seq")
    none = F.lit(None).cast("string")
    body = _st(
        title=F.when(k % 20 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "title")),
        doi=F.when(k % 3 == 0, F.col("doi")),
        publicationDate=F.when(k % 4 == 0, F.lit("n.d.")).otherwise(F.concat((1999 + k % 20).cast("string"), F.lit("-05"))),
        publicationName=F.when(k % 2 == 0, F.col("source")),
        creators=F.array(_st(creator=F.concat(F.lit("Roe, "), "s")), _st(creator=none), _st(creator=F.lit("Doe, J"))),
        url=F.when(k % 5 != 0, F.array(_st(value=none), _st(value=F.concat(F.lit("http://link.example/"), "s")))),
    )
    return _flat(feeds.conform_springer(d.select("seq", F.to_json(body).alias("payload"))))


def _wanfang(spark, sf):
    d, k = _docs(spark, sf), F.col("seq")

    def text(c):
        return F.struct(c.alias("stringValue"))

    def many(*cs):
        return F.struct(F.struct(F.array(*[F.struct(c.alias("stringValue")) for c in cs]).alias("values")).alias("listValue"))

    body = _st(
        fields=_st(
            Title=F.when(k % 20 != 0, many(F.lit(""), F.col("title"))),
            Creator=many(F.concat(F.lit("Fan"), "s"), F.lit("A."), F.lit("Y."), F.lit("Zhang"), F.lit("Q.")),
            PublishYear=F.struct((2000 + k % 20).cast("double").alias("numberValue")),
            Abstract=text(F.col("text")),
            Keywords=F.when(k % 3 == 0, many(F.col("lang"), F.col("source"))),
            DOI=F.when(k % 4 == 0, text(F.col("doi"))),
            Id=F.when(k % 5 != 0, text(F.concat(F.lit("wf"), "s"))),
            PeriodicalTitle=text(F.when(k % 2 == 0, F.col("source")).otherwise(F.lit(""))),
            OrganizationNorm=many(F.lit(""), F.lit("Org")),
        )
    )
    return d.select("seq", F.floor(k / 100).alias("batch"), F.to_json(body).alias("payload"))


def conform_wanfang(spark, sf):
    return _flat(feeds.conform_wanfang(_wanfang(spark, sf), "en"))


def catalog_io(spark, sf):
    """The catalog written with its declared schema and read back."""
    path = store.scratch_path(spark, "catalog")
    from scholarmatch.operators import catalog as ops

    merged = ops.catalog_upsert(None, model.catalog_batches(spark, sf))
    store.write_table(merged, path, "catalog")
    back = store.read_table(spark, path, "catalog")
    return back.select(
        "university", "department", "name", F.array_join("sources", ",").alias("sources"), F.size("field_sources").alias("n_origins"), "title", "source_url"
    )


def _filled(df, table):
    """``df`` with the declared columns it lacks as nulls."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(store.SCHEMAS[table]).fields
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in df.columns})


def tables_io(spark, sf):
    """Every declared table but the catalog, written in its layout and read back: rows and different keys."""
    school = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("university"))
    supplier = load(spark, sf, "supplier").join(F.broadcast(school), F.col("s_nationkey") == F.col("k"))  # 25 nations
    customer = load(spark, sf, "customer").join(F.broadcast(school), F.col("c_nationkey") == F.col("k"))
    tables = {
        "roster": (supplier.select("university", F.col("s_name").alias("supervisor"), F.lit(True).alias("in_official")), "supervisor"),
        "reviews": (customer.select("university", F.col("c_name").alias("supervisor"), F.col("c_acctbal").cast("double").alias("rate")), "supervisor"),
        "faculty": (supplier.select("university", F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")), "id"),
        "pages": (load(spark, sf, "pages").select("url", F.col("html").alias("text"), F.sha2("html", 256).alias("content_hash")), "content_hash"),
        "works": (load(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), F.array("p_type").alias("topics")), "title"),
        "runs": (load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("status")), "run_id"),
        "artifacts": (load(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("payload")), "payload"),
    }
    out = None
    for table, (df, key) in tables.items():
        path = store.scratch_path(spark, table)
        store.write_table(_filled(df, table), path, table)
        row = store.read_table(spark, path, table).agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys")).select(F.lit(table).alias("table_name"), "n", "n_keys")
        out = row if out is None else out.unionByName(row)
    return out


_NAMES = (
    "conform_openalex conform_crossref conform_dblp conform_europepmc conform_arxiv conform_scopus conform_springer conform_wanfang catalog_io tables_io"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_D = r"""
d AS (SELECT doc_id AS k, text, lang, source, n_chars, string_split(text, chr(10))[1] AS t0, '10.7/' || source || '.' || doc_id AS doi0 FROM documents),
e AS (SELECT *, trim(regexp_replace(t0, '\s+', ' ', 'g')) AS t, trim(regexp_replace(text, '\s+', ' ', 'g')) AS tx FROM d)"""


def _sel(id, title, year, doi, venue, topics, cites, abstract, url, platform, authors, inst, disc, where):
    return f"""WITH {_D} SELECT k AS seq, {id} AS id, {title} AS title, {year} AS year, {doi} AS doi, {venue} AS venue, {topics} AS topics, {cites} AS citation_count,
md5({abstract}) AS abstract, {url} AS source_url, '{platform}' AS source_platform, {authors} AS authors, {inst} AS institution, {disc} AS disciplines FROM e WHERE {where}"""


def _doi_case(n, other):
    return f"CASE WHEN k % {n} = 0 THEN 'https://doi.org/' || doi0 ELSE {other} END"


ORACLES = {
    "conform_openalex": _sel(
        "'W' || k", "t0", "CASE WHEN k % 4 <> 0 THEN 2000 + k % 20 END", "CASE WHEN k % 3 = 0 THEN doi0 END", "source",
        "lang || CASE WHEN k % 2 = 0 THEN '|sub' ELSE '' END || '|' || ['Computer Science', ' Medicine ', 'Unknown', 'Energy'][k % 4 + 1]", "n_chars",
        "CASE WHEN k % 6 <> 0 THEN text ELSE '' END", _doi_case(3, "'https://openalex.org/W' || k"), "OpenAlex", "'Ann ' || k",
        "CASE WHEN k % 5 = 0 THEN '' WHEN k % 3 = 1 THEN 'U1 / U4 / U5' ELSE 'U1 / U' || (k % 3) || ' / U4 / U5' END", "['cs', 'medicine', '', 'engineering'][k % 4 + 1]", "k % 50 <> 0 AND t0 <> ''",
    ),
    "conform_crossref": _sel(
        "CASE WHEN k % 4 <> 0 THEN doi0 ELSE t END", "t",
        "CASE WHEN k % 5 = 0 THEN CASE WHEN k % 7 <> 0 THEN 2001 END WHEN k % 2 = 0 THEN 1990 + k % 30 WHEN k % 7 <> 0 THEN 2001 END",
        "CASE WHEN k % 4 <> 0 THEN doi0 END", "CASE WHEN k % 2 = 0 THEN source END", "''", "n_chars", "CASE WHEN k % 2 = 1 THEN tx ELSE '' END",
        "CASE WHEN k % 4 <> 0 THEN 'https://doi.org/' || doi0 END", "Crossref", "'Bo L' || k || '|The Group'", "''", "''", "k % 9 <> 0 AND t <> ''",
    ),
    "conform_dblp": _sel(
        "CASE WHEN k % 2 = 0 THEN 'conf/' || k ELSE t END", "t", "CASE WHEN k % 5 <> 0 THEN 1995 + k % 25 END", "CASE WHEN k % 4 = 0 THEN doi0 END", "source", "''", "NULL::BIGINT", "''",
        _doi_case(4, "CASE WHEN k % 3 = 0 THEN 'https://ee.example/x' ELSE 'https://dblp.example/x' END"), "DBLP",
        "CASE k % 3 WHEN 0 THEN 'Ann ' || k WHEN 1 THEN 'Ann ' || k || '|Plain Name' ELSE 'Solo' END", "''", "'cs'", "k % 40 <> 0 AND k % 60 <> 59 AND t <> ''",
    ),
    "conform_europepmc": _sel(
        "CASE WHEN k % 4 = 0 THEN doi0 WHEN k % 3 = 0 THEN 'P' || k ELSE 'I' || k END", "t", "CASE WHEN k % 6 <> 0 THEN 1980 + k % 40 END", "CASE WHEN k % 4 = 0 THEN doi0 END",
        "CASE WHEN k % 2 = 0 THEN source END", "''", "k % 11", "tx",
        _doi_case(4, "'https://europepmc.org/article/' || CASE WHEN k % 5 = 0 THEN 'PPR' ELSE 'MED' END || '/' || CASE WHEN k % 3 = 0 THEN 'P' || k ELSE 'I' || k END"), "Europe PMC",
        "'Li ' || k || '|Wu'", "CASE WHEN k % 2 = 0 THEN 'Lab ' || lang ELSE '' END", "'medicine'", "k % 30 <> 0 AND t <> ''",
    ),
    "conform_arxiv": _sel(
        "'http://arxiv.org/abs/' || k", "t", "CASE WHEN k % 7 <> 0 THEN 2005 + k % 15 END", "CASE WHEN k % 5 = 0 THEN doi0 END", "CASE WHEN k % 3 = 0 THEN 'J ' || source ELSE 'arXiv 预印本' END",
        "CASE WHEN k % 6 = 5 THEN '' ELSE ['cs.CL', 'math.AG', 'q-bio', 'zzz.Q'][k % 4 + 1] END", "NULL::BIGINT", "tx", _doi_case(5, "'http://arxiv.org/abs/' || k"), "arXiv",
        "'Kim ' || k || CASE WHEN k % 2 = 0 THEN '|Ola Nordmann' ELSE '' END", "''", "CASE WHEN k % 6 = 5 THEN '' ELSE ['cs', 'physics', 'medicine', ''][k % 4 + 1] END", "k % 25 <> 0 AND t <> ''",
    ),
    "conform_scopus": _sel(
        "CASE WHEN k % 2 = 0 THEN '2-s2.0-' || k WHEN k % 3 = 0 THEN doi0 ELSE trim(t0) END", "trim(t0)", "CASE WHEN k % 5 <> 0 THEN 1999 + k % 20 WHEN k % 2 = 0 THEN 2010 END",
        "CASE WHEN k % 3 = 0 THEN doi0 END", "source", "''", "CASE WHEN k % 4 <> 0 THEN k % 50 END", "''", _doi_case(3, "'https://api.example/' || k"), "Scopus",
        "CASE WHEN k % 3 <> 1 THEN 'Roe ' || k ELSE '' END", "CASE WHEN k % 2 = 1 THEN lang ELSE '' END", "''", "k % 20 <> 0 AND trim(t0) <> ''",
    ),
    "conform_springer": _sel(
        "CASE WHEN k % 3 = 0 THEN doi0 ELSE trim(t0) END", "trim(t0)", "CASE WHEN k % 4 <> 0 THEN 1999 + k % 20 END", "CASE WHEN k % 3 = 0 THEN doi0 END",
        "CASE WHEN k % 2 = 0 THEN source END", "''", "NULL::BIGINT", "''", _doi_case(3, "CASE WHEN k % 5 <> 0 THEN 'http://link.example/' || k END"), "Springer Nature",
        "'Roe, ' || k || '|Doe, J'", "''", "''", "k % 20 <> 0 AND trim(t0) <> ''",
    ),
    "conform_wanfang": _sel(
        "CASE WHEN k % 5 <> 0 THEN 'wf' || k ELSE t0 END", "t0", "2000 + k % 20", "CASE WHEN k % 4 = 0 THEN doi0 END", "CASE WHEN k % 2 = 0 THEN source END",
        "CASE WHEN k % 3 = 0 THEN lang || '|' || source ELSE '' END", "NULL::BIGINT", "text", _doi_case(4, "CASE WHEN k % 5 <> 0 THEN 'https://d.wanfangdata.com.cn/periodical/wf' || k END"), "万方",
        "'Fan' || k || ' A. Y.|Zhang Q.'", "'Org'", "''", "k % 20 <> 0 AND t0 <> '' QUALIFY row_number() OVER (PARTITION BY k // 100, t0 ORDER BY k) = 1",
    ),
    "tables_io": """SELECT 'roster' AS table_name, count(*) AS n, count(DISTINCT s_name) AS n_keys FROM supplier
UNION ALL SELECT 'reviews', count(*), count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'faculty', count(*), count(DISTINCT s_suppkey) FROM supplier
UNION ALL SELECT 'pages', count(*), count(DISTINCT sha256(html)) FROM pages
UNION ALL SELECT 'works', count(*), count(DISTINCT p_name) FROM part
UNION ALL SELECT 'runs', count(*), count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'artifacts', count(*), count(DISTINCT props) FROM events""",
    "catalog_io": f"WITH {model.BATCHES}, {model.MERGED} SELECT university, department, name, sources, length(field_sources) - length(replace(field_sources, ';', '')) AS n_origins, title, source_url FROM cat",
}
