"""Bibliographic feeds of eight shapes -> one works table.

Every function takes landed records as (seq, payload text) and returns the columns of ``WORK``;
records without a title drop out. Parsing is declared as a schema, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmatch.functions import text, vocab
from scholarmatch.functions.scale import keep_first
from scholarmatch.operators.topics import arxiv_discipline, openalex_discipline

WORK = (
    "seq", "id", "title", "year", "doi", "venue", "topics", "citation_count", "abstract", "source_url",
    "source_platform", "authors", "institution", "disciplines",
)
_DOI_URL = "https://doi.org/"


def _none() -> Column:
    return F.array().cast("array<string>")


def _some(c: Column) -> Column:
    """Null instead of a blank."""
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def _or(*cs: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[_some(c) for c in cs])


def _named(values: Column) -> Column:
    return F.filter(F.coalesce(values, _none()), lambda v: F.coalesce(v, F.lit("")) != "")


def _digits(c: Column) -> Column:
    """A whole number written in digits only, else null."""
    return F.when(F.coalesce(c, F.lit("")).rlike("^[0-9]+$"), c).try_cast("int")


def _doi_url(doi: Column) -> Column:
    return F.when(doi.isNotNull(), F.concat(F.lit(_DOI_URL), doi))


def _works(rows: DataFrame, platform: str, **c: Column) -> DataFrame:
    made = {
        "year": F.lit(None).cast("int"),
        "venue": F.lit(None).cast("string"),
        "topics": _none(),
        "citation_count": F.lit(None).cast("long"),
        "abstract": F.lit(""),
        "institution": F.lit(""),
        "disciplines": _none(),
        "source_platform": F.lit(platform),
        "seq": F.col("seq"),
        **c,
    }
    return rows.select(*[made[n].alias(n) for n in WORK], *[x for x in rows.columns if x in ("pos", "batch")]).where(
        F.coalesce("title", F.lit("")) != ""
    )


_OPENALEX = (
    "id string, doi string, title string, publication_year int, cited_by_count bigint, "
    "abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>, "
    "primary_location struct<source:struct<display_name:string>>, "
    "primary_topic struct<display_name:string,subfield:struct<display_name:string>,field:struct<display_name:string>>"
)


def conform_openalex(raw: DataFrame, max_schools: int | None = None) -> DataFrame:
    """Bulk works; the abstract is put back together from its word positions."""
    # one-element array: the filter on titles is not moved before the parsing, which would parse each payload twice
    w = raw.select("seq", F.explode_outer(F.array(F.from_json("payload", _OPENALEX))).alias("w")).select("seq", "w.*")
    short = F.regexp_extract(F.regexp_replace(F.coalesce("id", F.lit("")), "/+$", ""), r"([^/]*)$", 1)
    doi = _some(F.trim(F.regexp_replace(F.coalesce("doi", F.lit("")), "https?://doi\\.org/", "")))
    placed = F.flatten(
        F.transform(
            F.map_entries("abstract_inverted_index"),
            lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w"))),
        )
    )
    abstract = F.array_join(F.transform(F.sort_array(placed), lambda x: x["w"]), " ")  # natively; array_sort calls a function per comparison
    schools = F.array_distinct(
        _named(F.flatten(F.transform("authorships", lambda a: F.coalesce(F.transform(a["institutions"], lambda i: i["display_name"]), _none()))))
    )
    topic = F.col("primary_topic")
    field = openalex_discipline(topic["field"]["display_name"])
    return _works(
        w,
        "OpenAlex",
        id=_or(short, doi, F.col("title")),
        title=F.coalesce("title", F.lit("")),
        year=F.col("publication_year"),
        doi=doi,
        venue=F.col("primary_location.source.display_name"),
        topics=_named(F.array(topic["display_name"], topic["subfield"]["display_name"], topic["field"]["display_name"])),
        citation_count=F.col("cited_by_count"),
        abstract=F.coalesce(abstract, F.lit("")),
        source_url=F.coalesce(_doi_url(doi), F.when(short != "", F.concat(F.lit("https://openalex.org/"), short))),
        authors=_named(F.transform("authorships", lambda a: a["author"]["display_name"])),
        institution=F.array_join(schools if max_schools is None else F.slice(schools, 1, max_schools), " / "),
        disciplines=F.array_compact(F.array(field)),
    )


_DATE = "struct<`date-parts`:array<array<string>>>"
_CROSSREF = (
    "DOI string, title array<string>, `container-title` array<string>, abstract string, `is-referenced-by-count` bigint, "
    "author array<struct<given:string,family:string,name:string>>, "
    f"`published-print` {_DATE}, `published-online` {_DATE}, published {_DATE}, issued {_DATE}"
)


def conform_crossref(raw: DataFrame) -> DataFrame:
    """DOI metadata; the year is the first usable of four dates."""
    w = raw.select("seq", F.from_json("payload", _CROSSREF).alias("w")).select("seq", "w.*")

    def year(key: str) -> Column:
        part = F.try_element_at(F.try_element_at(F.col(f"`{key}`")["date-parts"], F.lit(1)), F.lit(1)).try_cast("int")
        return F.when(part != 0, part)

    def person(a: Column) -> Column:
        both = text.squeeze(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit(""))))
        return F.when(both != "", both).otherwise(text.squeeze(a["name"]))

    doi = _some(text.squeeze("DOI"))
    title = text.squeeze(F.try_element_at("title", F.lit(1)))
    return _works(
        w,
        "Crossref",
        id=F.coalesce(doi, title),
        title=title,
        year=F.coalesce(*[year(k) for k in ("published-print", "published-online", "published", "issued")]),
        doi=doi,
        venue=_some(text.squeeze(F.try_element_at("container-title", F.lit(1)))),
        citation_count=F.col("is-referenced-by-count"),
        abstract=text.squeeze("abstract"),
        source_url=_doi_url(doi),
        authors=_named(F.transform("author", person)),
    )


def _one_or_many(v: Column, path: str) -> Column:
    """The elements of a JSON value that may stand alone or in a list."""
    node = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(node)
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>")).when(
        node.isNotNull() & ~F.is_variant_null(node), F.array(node)
    )


def conform_dblp(raw: DataFrame) -> DataFrame:
    """Search results whose hits and authors may be one object or a list."""
    v = raw.select("seq", F.try_parse_json("payload").alias("v"))
    hits = v.select("seq", F.posexplode(_one_or_many(F.col("v"), "$.result.hits.hit")).alias("pos", "h"))

    def info(name: str) -> Column:
        return F.try_variant_get("h", f"$.info.{name}", "string")

    def person(a: Column) -> Column:
        named = F.schema_of_variant(a).startswith("OBJECT")
        return text.squeeze(F.when(named, F.try_variant_get(a, "$.text", "string")).otherwise(F.try_variant_get(a, "$", "string")))

    title = text.squeeze(info("title"))
    doi = info("doi")
    return _works(
        hits,
        "DBLP",
        id=_or(info("key"), title),
        title=title,
        year=_digits(info("year")),
        doi=doi,
        venue=_some(text.squeeze(info("venue"))),
        source_url=F.coalesce(_doi_url(_some(doi)), _or(info("ee"), info("url"))),
        authors=_named(F.transform(_one_or_many(F.col("h"), "$.info.authors.author"), person)),
        disciplines=F.array(F.lit("cs")),
    )


_EUROPEPMC = (
    "id string, pmid string, doi string, title string, source string, pubYear string, abstractText string, citedByCount bigint, "
    "journalInfo struct<journal:struct<title:string>>, "
    "authorList struct<author:array<struct<fullName:string,lastName:string,affiliation:string>>>"
)


def conform_europepmc(raw: DataFrame) -> DataFrame:
    """Biomedical records; the first stated affiliation stands for the paper."""
    w = raw.select("seq", F.from_json("payload", _EUROPEPMC).alias("w")).select("seq", "w.*")
    title, doi = text.squeeze("title"), _some(text.squeeze("doi"))
    pmid = _or(text.squeeze("pmid"), text.squeeze("id"))
    people = F.col("authorList.author")
    stated = _named(F.transform(people, lambda a: text.squeeze(a["affiliation"])))
    article = F.concat(F.lit("https://europepmc.org/article/"), F.coalesce("source", F.lit("MED")), F.lit("/"), pmid)
    return _works(
        w,
        "Europe PMC",
        id=F.coalesce(doi, pmid, title),
        title=title,
        year=_digits(F.col("pubYear")),
        doi=doi,
        venue=_some(text.squeeze("journalInfo.journal.title")),
        citation_count=F.col("citedByCount"),
        abstract=text.squeeze("abstractText"),
        source_url=F.coalesce(_doi_url(doi), article),
        authors=_named(F.transform(people, lambda a: text.squeeze(_or(a["fullName"], a["lastName"])))),
        institution=F.coalesce(F.try_element_at(stated, F.lit(1)), F.lit("")),
        disciplines=F.array(F.lit("medicine")),
    )


_ARXIV = (
    "id string, title string, published string, summary string, doi string, journal_ref string, "
    "author array<struct<name:string>>, primary_category struct<_term:string>"
)


def conform_arxiv(raw: DataFrame) -> DataFrame:
    """Atom entries; the category gives topic and discipline."""
    w = raw.select("seq", F.from_xml("payload", _ARXIV, {"ignoreNamespace": "true"}).alias("w")).select("seq", "w.*")
    title, url, doi = text.squeeze("title"), _some(text.squeeze("id")), _some(text.squeeze("doi"))
    category = _some(F.col("primary_category._term"))
    return _works(
        w,
        "arXiv",
        id=F.coalesce(url, title),
        title=title,
        year=_digits(F.substring(text.squeeze("published"), 1, 4)),
        doi=doi,
        venue=_or(text.squeeze("journal_ref"), F.lit(vocab.ARXIV_VENUE)),
        topics=F.array_compact(F.array(category)),
        abstract=text.squeeze("summary"),
        source_url=F.coalesce(_doi_url(doi), url),
        authors=_named(F.transform("author", lambda a: text.squeeze(a["name"]))),
        disciplines=F.array_compact(F.array(arxiv_discipline(category))),
    )


_SCOPUS = (
    "`dc:title` string, `prism:doi` string, eid string, `prism:url` string, `citedby-count` string, `prism:coverDate` string, "
    "`prism:coverDisplayDate` string, `prism:publicationName` string, `dc:creator` string, affilname string"
)


def conform_scopus(raw: DataFrame) -> DataFrame:
    """Index entries with a single named creator."""
    w = raw.select("seq", F.from_json("payload", _SCOPUS).alias("w")).select("seq", "w.*")

    def clean(c: str) -> Column:
        return _some(text.strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))))

    doi, title = clean("prism:doi"), clean("dc:title")
    date = _or(F.col("`prism:coverDate`"), F.col("`prism:coverDisplayDate`"))
    return _works(
        w,
        "Scopus",
        id=F.coalesce(clean("eid"), doi, title),
        title=title,
        year=_digits(F.substring(date, 1, 4)),
        doi=doi,
        venue=_some(F.col("`prism:publicationName`")),
        citation_count=_digits(F.col("`citedby-count`")).cast("long"),
        source_url=F.coalesce(_doi_url(doi), clean("prism:url")),
        authors=F.array_compact(F.array(_some(F.col("`dc:creator`")))),
        institution=F.coalesce("affilname", F.lit("")),
    )


_SPRINGER = (
    "title string, doi string, publicationDate string, publicationName string, "
    "creators array<struct<creator:string>>, url array<struct<value:string>>"
)


def conform_springer(raw: DataFrame) -> DataFrame:
    """Publisher metadata; the first link stands in where there is no DOI."""
    w = raw.select("seq", F.from_json("payload", _SPRINGER).alias("w")).select("seq", "w.*")
    doi, title = _some(text.strip(F.coalesce("doi", F.lit("")))), text.strip(F.coalesce("title", F.lit("")))
    links = _named(F.transform("url", lambda u: u["value"]))
    return _works(
        w,
        "Springer Nature",
        id=F.coalesce(doi, title),
        title=title,
        year=_digits(F.substring("publicationDate", 1, 4)),
        doi=doi,
        venue=_some(F.col("publicationName")),
        source_url=F.coalesce(_doi_url(doi), F.try_element_at(links, F.lit(1))),
        authors=_named(F.transform("creators", lambda c: c["creator"])),
    )


_LEAF = "stringValue:string,numberValue:double"
_LIST = f"struct<{_LEAF},listValue:struct<values:array<struct<{_LEAF}>>>>"
_VALUE = f"struct<{_LEAF},listValue:struct<values:array<{_LIST}>>>"
_WANFANG_FIELDS = ("Title", "Creator", "PublishYear", "Abstract", "Keywords", "DOI", "Id", "PeriodicalTitle", "OrganizationNorm")
_WANFANG = "fields struct<" + ",".join(f"{f}:{_VALUE}" for f in _WANFANG_FIELDS) + ">"


def _texts(v: Column) -> Column:
    """All texts of a typed value: a string, a number, or a list of such values."""
    def leaf(x: Column) -> Column:
        return F.coalesce(x["stringValue"], x["numberValue"].cast("long").cast("string"))

    def one(x: Column) -> Column:
        return F.when(leaf(x).isNotNull(), F.array(leaf(x))).otherwise(
            F.coalesce(F.transform(x["listValue"]["values"], leaf), _none())
        )

    many = F.flatten(F.transform(v["listValue"]["values"], one))
    return F.array_compact(F.when(leaf(v).isNotNull(), F.array(leaf(v))).otherwise(F.coalesce(many, _none())))


def group_authors(tokens: Column) -> Column:
    """Flat surname and initial tokens back as authors: initials end with a dot and follow their surname."""
    def add(acc: Column, t: Column) -> Column:
        joins = (F.size(acc) > 0) & t.endswith(".")
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        last = F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), t)
        return F.when(joins, F.concat(head, F.array(last))).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(tokens, _none(), add)


def conform_wanfang(raw: DataFrame, lang: str = "zh") -> DataFrame:
    """Typed-value records of one answer ``batch`` each; a title counts once per batch."""
    w = raw.select("seq", "batch", F.from_json("payload", _WANFANG).alias("w")).select("seq", "batch", "w.fields.*")

    def first(f: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(_texts(F.col(f)), lambda t: t != ""), F.lit(1)), F.lit(""))

    doi, ident, title = _some(first("DOI")), first("Id"), first("Title")
    people = _texts(F.col("Creator"))
    out = _works(
        w,
        "万方",
        id=_or(ident, title),
        title=title,
        year=_digits(first("PublishYear")),
        doi=doi,
        venue=_some(first("PeriodicalTitle")),
        topics=_texts(F.col("Keywords")),
        abstract=first("Abstract"),
        source_url=F.coalesce(
            _doi_url(doi), F.when(ident != "", F.concat(F.lit("https://d.wanfangdata.com.cn/periodical/"), ident))
        ),
        authors=group_authors(people) if lang == "en" else people,
        institution=first("OrganizationNorm"),
    )
    return keep_first(out, ["batch", "title"], "seq").select(*WORK)
