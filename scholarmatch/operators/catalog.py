"""The supervisor catalog: upsert, cleaning, lookup and quality figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarmatch.functions import text, vocab
from scholarmatch.functions.scale import keep_first, literal_table

KEY = ["university", "department", "name"]
ROSTER_KEY = ["university", "department", "supervisor"]
_PLAIN = ("retrieved_at", "content_hash")


def catalog_upsert(catalog: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Merge arrivals into the catalog: every field keeps its first non-empty value and that value's source.

    ``incoming`` carries ``seq`` (arrival) and ``source``; catalog rows count as arrived before all of it.
    Repeats of a key collapse per source list first, so a hot key never travels whole.
    """
    rows = incoming
    if "sources" not in rows.columns:
        rows = rows.withColumn("sources", F.array().cast("array<string>"))
    if "field_sources" not in rows.columns:
        rows = rows.withColumn("field_sources", F.lit(None).cast("map<string,string>"))
    wide = F.when(F.size("sources") > 0, F.array_distinct(F.concat("sources", F.array("source")))).otherwise(
        F.array("source")
    )
    rows = rows.withColumn("sources", wide)
    if catalog is not None:
        old = catalog.withColumn("seq", F.lit(-1).cast("long")).withColumn("source", F.lit(None).cast("string"))
        rows = old.select(*rows.columns).unionByName(rows)

    # Dealt out while still narrow: a small file is scanned by few tasks, whose sort would hold every field of all its rows.
    rows = rows.repartition("seq", *KEY)
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def carried(field: str) -> Column:
        origin = F.coalesce(F.col("field_sources")[field], F.col("source"))
        return F.struct(F.col("seq").alias("s"), F.col(field).alias("v"), origin.alias("o"))

    def first(field: str, condition: Column, name: str) -> Column:
        return F.min_by(carried(field), F.when(condition, F.col("seq"))).alias(name)

    filled = {f: ~text.is_empty(f, kinds[f]) for f in (*vocab.ENRICHABLE_FIELDS, *_PLAIN, "source_url")}
    names = {f: f"f_{f}" for f in filled}
    per_source = rows.groupBy(*KEY, "sources").agg(
        F.min("seq").alias("_s"),
        *[first(f, filled[f], names[f]) for f in filled],
        first("source_url", F.col("source_url").rlike("^https?://"), "f_web"),
    )
    slots = [*names.values(), "f_web"]
    merged = per_source.groupBy(*KEY).agg(
        *[F.min_by(n, F.col(f"{n}.s")).alias(n) for n in slots],
        F.array_sort(F.collect_list(F.struct("_s", "sources"))).alias("_src"),
    )
    origins = F.map_from_entries(
        F.array_compact(
            F.array(
                *[
                    F.when(F.col(f"{names[f]}.o").isNotNull(), F.struct(F.lit(f).alias("k"), F.col(f"{names[f]}.o").alias("v")))
                    for f in vocab.ENRICHABLE_FIELDS
                ]
            )
        )
    )

    def value(field: str) -> Column:
        empty = F.array().cast(kinds[field]) if isinstance(kinds[field], T.ArrayType) else F.lit("")
        return F.coalesce(F.col(f"{names[field]}.v"), empty).alias(field)

    return merged.select(
        *KEY,
        *[value(f) for f in vocab.ENRICHABLE_FIELDS],
        F.array_distinct(F.flatten(F.transform("_src", lambda x: x["sources"]))).alias("sources"),
        F.coalesce("f_web.v", F.col(f"{names['source_url']}.v"), F.lit("")).alias("source_url"),
        *[value(f) for f in _PLAIN],
        origins.alias("field_sources"),
    )


def roster_upsert(
    roster: DataFrame, incoming: DataFrame, kind: str, source_url: str = "", retrieved_at: str = ""
) -> DataFrame:
    """Official rows set their flag and stamp and fill a blank note; a community reload replaces community rows.

    Of several official notes for one person the first that is not blank counts, by ``seq``, the arrival order
    (rows without that column: by the note itself).
    """
    if kind == "official":
        arrival = F.col("seq") if "seq" in incoming.columns else F.lit(0)
        ordered = incoming.select(*ROSTER_KEY, F.col("note").alias("_note"), arrival.alias("_seq"))
        new = keep_first(ordered, ROSTER_KEY, F.struct(text.blank("_note").alias("blank"), F.col("_seq"), F.col("_note"))).drop("_seq")
        both = roster.join(new.withColumn("_new", F.lit(True)), ROSTER_KEY, "full_outer")
        hit = F.col("_new").isNotNull()
        return both.select(
            *ROSTER_KEY,
            F.when(F.coalesce("note", F.lit("")) == "", F.coalesce("_note", F.lit(""))).otherwise(F.col("note")).alias("note"),
            F.coalesce("school_cate", F.lit("")).alias("school_cate"),
            F.coalesce("in_community", F.lit(False)).alias("in_community"),
            (F.coalesce("in_official", F.lit(False)) | hit).alias("in_official"),
            F.when(hit, F.lit(source_url)).otherwise(F.col("source_url")).alias("source_url"),
            F.when(hit, F.lit(retrieved_at)).otherwise(F.col("retrieved_at")).alias("retrieved_at"),
        )
    kept = roster.where("in_official")
    fresh = incoming.join(kept.select(*ROSTER_KEY), ROSTER_KEY, "left_anti")
    return kept.unionByName(fresh_roster(fresh).select(*kept.columns))


def fresh_roster(entries: DataFrame) -> DataFrame:
    """Community entries as a new roster table."""
    return entries.select(
        *ROSTER_KEY,
        "note",
        "school_cate",
        F.lit(True).alias("in_community"),
        F.lit(False).alias("in_official"),
        F.lit("").alias("source_url"),
        F.lit("").alias("retrieved_at"),
    )


def clear_source(catalog: DataFrame, source: str, university: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop rows only ``source`` knew, take its mark off the others; (catalog, removed count)."""
    here = F.lit(True) if not university else F.col("university") == university
    alone = here & (F.size("sources") == 1) & (F.element_at("sources", 1) == source)
    kept = catalog.where(~alone).withColumn(
        "sources", F.when(here, F.array_remove("sources", source)).otherwise(F.col("sources"))
    )
    return kept, catalog.agg(F.count_if(alone).alias("removed"))


def clear_official_roster(roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reset the official marks before a new crawl; rows only the crawl knew go; (roster, marked count)."""
    kept = roster.where(~(F.col("in_official") & ~F.col("in_community")))
    reset = kept.withColumns({"in_official": F.lit(False), "source_url": F.lit(""), "retrieved_at": F.lit("")})
    return reset, roster.agg(F.count_if("in_official").alias("marked"))


def richness(catalog: DataFrame) -> Column:
    """How many of the nine descriptive fields an advisor row has."""
    fields = (
        "title", "email", "homepage_url", "profile_text", "orcid", "openalex_id",
        "research_directions", "research_areas", "publications",
    )
    return sum(
        (F.when(text.is_empty(f, catalog.schema[f].dataType), 0).otherwise(1) for f in fields), start=F.lit(0)
    )


def normalize_names(catalog: DataFrame, clean: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Clean every name; rows that then coincide in a department become the richest one, sources united."""
    cleaned = catalog.withColumn("_clean", clean(F.col("name")))
    cleaned = cleaned.withColumn("_clean", F.when(text.blank("_clean"), F.col("name")).otherwise(F.col("_clean")))
    ranked = cleaned.select(
        "university",
        "department",
        "_clean",
        "name",
        "sources",
        F.struct(richness(catalog).alias("r"), (F.col("name") == F.col("_clean")).alias("c")).alias("_rank"),
        F.struct(*catalog.columns).alias("_row"),
    )
    per_source = ranked.groupBy("university", "department", "_clean", "sources").agg(
        F.max_by(F.struct("_rank", "_row"), F.struct("_rank", "name")).alias("_best"),
        F.max("_rank").alias("_top"),
        F.min("name").alias("_first"),
        F.count("*").alias("_n"),
        F.bool_or(F.col("name") == F.col("_clean")).alias("_has"),
    )
    groups = per_source.groupBy("university", "department", "_clean").agg(
        F.max_by("_best", F.struct("_top", F.col("_best._row.name"))).alias("_best"),
        F.array_sort(F.collect_list(F.struct("_first", "sources"))).alias("_src"),
        F.sum("_n").alias("_n"),
        F.bool_or("_has").alias("_has"),
    )
    united = F.array_distinct(
        F.concat("_best._row.sources", F.flatten(F.transform("_src", lambda x: x["sources"])))
    )
    out = groups.select(
        *[
            F.col("_clean").alias(c) if c == "name" else united.alias(c) if c == "sources" else F.col(f"_best._row.{c}").alias(c)
            for c in catalog.columns
        ]
    )
    counts = groups.agg(
        F.sum(F.when(~F.col("_has"), 1).otherwise(0)).alias("renamed"), F.sum(F.col("_n") - 1).alias("merged")
    )
    return out, counts


def delete_by_rule(
    catalog: DataFrame, reject: Callable[[Column], Column], samples: int = 20
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept catalog, removed count, a few removed rows with their sources)."""
    bad = F.coalesce(reject(F.col("name")), F.lit(False))
    shown = (
        catalog.where(bad)
        .select(*KEY, F.array_join("sources", ",").alias("sources"))
        .orderBy(*KEY)
        .limit(samples)
    )
    return catalog.where(~bad), catalog.agg(F.count_if(bad).alias("removed")), shown


def delete_keys(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    return catalog.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def lookup_advisor(requests: DataFrame, catalog: DataFrame, faculty: DataFrame | None = None) -> DataFrame:
    """Advisors of a requested name: those of the school, all homonyms if none is, the faculty table if there are none.

    ``requests``: request_id, name, university (may be blank). No request-wide window: the three
    cases are three joins, so a common name spreads with its matches.
    """
    asked = requests.select(
        "request_id",
        text.strip("name").alias("_name"),
        text.strip(F.coalesce("university", F.lit(""))).alias("_school"),
    ).where(F.col("_name") != "")
    school_fits = (F.col("_school") == "") | text.contains_either(F.col("university"), F.col("_school"))
    named = catalog.join(asked, F.col("name") == F.col("_name"))
    exact = named.where(school_fits)
    served = exact.select("request_id").distinct()
    homonyms = catalog.join(asked.join(served, "request_id", "left_anti"), F.col("name") == F.col("_name"))
    cols = ["request_id", *catalog.columns]
    out = exact.select(*cols, F.lit("catalog").alias("origin")).unionByName(
        homonyms.select(*cols, F.lit("homonym").alias("origin"))
    )
    if faculty is None:
        return out
    unknown = asked.join(catalog.select(F.col("name").alias("_name")).distinct(), "_name", "left_anti")
    shaped = faculty
    for f in catalog.schema.fields:
        if f.name not in shaped.columns:
            shaped = shaped.withColumn(f.name, F.lit(None).cast(f.dataType))
    rescued = shaped.select(*catalog.columns).join(unknown, F.col("name") == F.col("_name")).where(school_fits)
    return out.unionByName(rescued.select(*cols, F.lit("faculty").alias("origin")))


def lookup_identity_key(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog row whose homepage gives exactly the requested identity key."""
    keyed = (
        catalog.where(~text.blank("homepage_url"))
        .withColumn("identity_key", text.identity_key(F.col("homepage_url")))
    )
    once = keep_first(keyed, ["identity_key"], F.struct("homepage_url", *KEY))
    return requests.join(once, "identity_key")


def browse(catalog: DataFrame, university: str, department: str | None = None) -> DataFrame:
    """Rows of a school (and department), by department and name."""
    rows = catalog.where(F.col("university") == university.strip())
    if department:
        rows = rows.where(F.col("department") == department.strip())
    name = "name" if "name" in catalog.columns else "supervisor"
    return rows.orderBy("department", name)


def reviews_for(reviews: DataFrame, advisors: DataFrame) -> DataFrame:
    """Reviews of the given advisors (university, name)."""
    wanted = advisors.select("university", F.col("name").alias("supervisor")).distinct()
    return reviews.join(wanted, ["university", "supervisor"])


def roster_names(roster: DataFrame, university: str, department: str | None = None) -> DataFrame:
    return browse(roster, university, department).select("supervisor").distinct().orderBy("supervisor")


def facet_counts(df: DataFrame, level: str = "university", university: str | None = None) -> DataFrame:
    """Values of a facet with row counts, most frequent first; blank departments left out."""
    rows = df if not university else df.where(F.col("university") == university)
    if level == "department":
        rows = rows.where(~text.blank("department"))
    return rows.groupBy(F.col(level).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def field_fill_rates(catalog: DataFrame) -> DataFrame:
    """(field, rate): share of non-empty values, plus the row count as ``_total``."""
    fields = ["name", "university", "department", *vocab.ENRICHABLE_FIELDS]
    rates = [
        F.avg(F.when(text.is_empty(f, catalog.schema[f].dataType), 0.0).otherwise(1.0)).alias(f) for f in fields
    ]
    one = catalog.agg(*rates, F.count("*").cast("double").alias("_total"))
    pairs = ", ".join(f"'{f}', `{f}`" for f in [*fields, "_total"])
    return one.selectExpr(f"stack({len(fields) + 1}, {pairs}) AS (field, rate)").where("rate IS NOT NULL")


def source_breakdown(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def roster_stats(roster: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: advisors, reviews, rows from the community, from the crawl, from both."""
    r = roster.select(
        F.lit(1).alias("a"), F.lit(0).alias("v"), F.col("in_community").alias("c"), F.col("in_official").alias("o")
    )
    v = reviews.select(F.lit(0).alias("a"), F.lit(1).alias("v"), F.lit(False).alias("c"), F.lit(False).alias("o"))
    return r.unionByName(v).agg(
        F.sum("a").alias("advisors"),
        F.sum("v").alias("reviews"),
        F.count_if("c").alias("from_community"),
        F.count_if("o").alias("from_official"),
        F.count_if(F.col("c") & F.col("o")).alias("from_both"),
    )


def roster_summary(roster: DataFrame) -> DataFrame:
    """One row: entries, distinct schools, distinct departments of schools."""
    per = roster.groupBy("university", "department").agg(F.count("*").alias("n"))
    return per.groupBy("university").agg(F.sum("n").alias("n"), F.count("*").alias("d")).agg(
        F.sum("n").alias("entries"), F.count("*").alias("universities"), F.sum("d").alias("departments")
    )


def top_universities(roster: DataFrame, n: int = 10) -> DataFrame:
    return facet_counts(roster).limit(n).withColumnRenamed("value", "university")


# --- names -------------------------------------------------------------------------------------
def foreign_name(c: Column) -> Column:
    """A name in Latin letters that is not only an acronym."""
    s = text.strip(c)
    return s.rlike(r"^[A-Za-z][A-Za-z.\-' ]{1,40}$") & s.rlike("[A-Za-z]{2,}") & s.rlike("[a-z]")


def drop_title(c: Column, suffixes: Sequence[str] = vocab.TITLE_SUFFIXES) -> Column:
    """The name without the first listed title it ends with, if two characters remain."""
    out = None
    for s in suffixes:
        fits = c.endswith(s) & (F.length(c) - len(s) >= 2)
        cut = F.substring(c, F.lit(1), F.length(c) - len(s))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(c) if out is not None else c


def clean_person_name(c: Column, suffixes: Sequence[str] = vocab.TITLE_SUFFIXES, foreign: bool = True) -> Column:
    """Name without blanks, glued title and glued unit; Latin names keep their single blanks."""
    units = "|".join(vocab.UNIT_SUFFIXES)
    bare = drop_title(F.regexp_replace(c, r"\s+", ""), suffixes)
    rest = F.regexp_replace(bare, rf"^[一-龥A-Za-z]{{0,8}}?(?:{units})", "")
    local = F.when(F.length(rest) >= 2, rest).otherwise(bare)
    return F.when(foreign_name(c), F.regexp_replace(text.strip(c), r"\s+", " ")).otherwise(local) if foreign else local


def name_verdict(
    name: Column,
    roots: Sequence[str],
    suffixes: Sequence[str] = vocab.TITLE_SUFFIXES,
    allowed: str = r"^[一-龥]{2,4}$",
) -> Column:
    """struct(clean_name, verdict, matched_root); verdict is keep, foreign or delete.

    ``roots`` are the interface words that never occur in a name; a title is taken off before they are looked for.
    """
    raw = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", "")
    bare = drop_title(raw, suffixes)
    clean = clean_person_name(raw, suffixes)
    listed = F.array(*[F.lit(r) for r in roots]) if roots else F.array().cast("array<string>")
    hit = F.filter(listed, lambda r: bare.contains(r) | clean.contains(r))
    root = F.when(F.size(hit) > 0, F.element_at(hit, 1)).otherwise("")
    foreign = foreign_name(raw)
    verdict = (
        F.when(raw == "", "delete")
        .when(foreign, "foreign")
        .when((root != "") | ~clean.rlike(allowed), "delete")
        .otherwise("keep")
    )
    return F.struct(
        clean.alias("clean_name"), verdict.alias("verdict"), F.when(foreign, F.lit("")).otherwise(root).alias("matched_root")
    )


def name_quality(
    catalog: DataFrame,
    roots: Sequence[str],
    suffixes: Sequence[str] = vocab.TITLE_SUFFIXES,
    allowed: str = r"^[一-龥]{2,4}$",
    keep_list: DataFrame | None = None,
) -> DataFrame:
    """(key, clean_name, verdict, matched_root); names on an external keep list are never deleted."""
    judged = catalog.select(*KEY, name_verdict(F.col("name"), roots, suffixes, allowed).alias("j")).select(*KEY, "j.*")
    if keep_list is None:
        return judged
    kept = keep_list.select("name").distinct().withColumn("_ok", F.lit(True))
    return judged.join(kept, "name", "left").select(
        *KEY, "clean_name", F.when(F.col("_ok"), F.lit("keep")).otherwise(F.col("verdict")).alias("verdict"), "matched_root"
    )


def library_quality(
    catalog: DataFrame,
    roots: Sequence[str],
    must_survive: Sequence[str],
    suffixes: Sequence[str] = vocab.TITLE_SUFFIXES,
    allowed: str = r"^[一-龥]{2,4}$",
) -> DataFrame:
    """Metric rows: size, interface words left, people missing, rows with any of title, mail, directions."""
    bad = name_verdict(F.col("name"), roots, suffixes, allowed)["verdict"] == "delete"
    any_field = (
        ~text.is_empty_json("title") | ~text.is_empty_json("email")
        | ~text.is_empty("research_directions", catalog.schema["research_directions"].dataType)
    )
    sums = catalog.agg(
        F.count("*").cast("double").alias("advisors"),
        F.count_if(bad).cast("double").alias("residue"),
        F.avg(F.when(any_field, 1.0).otherwise(0.0)).alias("fill"),
    )
    spark = catalog.sparkSession
    expected = literal_table(spark, ("name",), [(n,) for n in must_survive])
    missing = expected.join(catalog.select("name"), "name", "left_anti").agg(F.count("*").cast("double").alias("missing"))
    known = sums.selectExpr(
        "stack(3, 'library.advisors', advisors, true, CAST(NULL AS DOUBLE),"
        " 'library.ui_word_residue', residue, false, CAST(0 AS DOUBLE),"
        " 'library.field_fill_rate', fill, true, CAST(NULL AS DOUBLE))"
        " AS (key, value, higher_is_better, gate)"
    )
    lost = missing.select(
        F.lit("library.must_survive_missing").alias("key"),
        F.col("missing").alias("value"),
        F.lit(False).alias("higher_is_better"),
        F.lit(0.0).alias("gate"),
    )
    return known.unionByName(lost)


# --- field report ------------------------------------------------------------------------------
def field_report(candidates: DataFrame, fields: Sequence[str] = vocab.REPORT_FIELDS,
                 priority: Sequence[str] = vocab.REPORT_SOURCES) -> DataFrame:
    """(entity, field, value, status, source, note): first non-empty value by source priority, gaps as UNKNOWN."""
    order = F.create_map(*[x for i, s in enumerate(priority) for x in (F.lit(s), F.lit(i))])
    ranked = candidates.where(F.col("field").isin(list(fields))).withColumn("_p", F.try_element_at(order, F.col("source")))
    # dealt out while still narrow, as in ``catalog_upsert``
    best = ranked.repartition("entity", "field").groupBy("entity").agg(
        *[
            F.min_by(
                F.struct(text.strip("value").alias("value"), "source"),
                F.when((F.col("field") == f) & ~text.blank("value"), F.col("_p")),
            ).alias(f)
            for f in fields
        ]
    )
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("b")) for f in fields])
    rows = best.select("entity", F.explode(listed).alias("x")).select("entity", "x.field", "x.b.value", "x.b.source")
    known = F.col("value").isNotNull()
    doubtful = known & (F.col("field") == "email") & ~text.school_email("value")
    return rows.select(
        "entity",
        "field",
        F.coalesce("value", F.lit("")).alias("value"),
        F.when(~known, "UNKNOWN").when(doubtful, "INFERRED").otherwise("CONFIRMED").alias("status"),
        F.coalesce("source", F.lit("none")).alias("source"),
        F.when(doubtful, "not a school mail domain").otherwise("").alias("note"),
    )


def field_report_summary(report: DataFrame, required: Sequence[str] = ("name", "institution")) -> DataFrame:
    """Per entity: known and total fields, the unknown ones and the required ones still missing."""
    unknown = F.col("status") == "UNKNOWN"
    gaps = F.array_join(F.array_sort(F.collect_list(F.when(unknown, F.col("field")))), ",")
    return report.groupBy("entity").agg(
        F.count_if(~unknown).alias("known"),
        F.count("*").alias("total"),
        gaps.alias("unknown_fields"),
        F.count_if(unknown & F.col("field").isin(list(required))).alias("missing_required"),
    )
