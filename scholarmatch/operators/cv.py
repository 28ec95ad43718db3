"""CV texts: redaction, leak audit, facts and the user's edits. Everything stays inside its row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmatch.functions import text, vocab
from scholarmatch.functions.scale import struct_array
from scholarmatch.operators.pages import _LINE_END

_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
#: What every text with a match holds, where that is much cheaper to look for than the pattern.
_MARKS = {_MAIL: "@"}


def _possible(value: str, pattern: str) -> Column:
    return F.col(value).contains(_MARKS[pattern]) if pattern in _MARKS else F.lit(True)


def pii_redact(docs: DataFrame, surnames: str | None = None, name_col: str | None = None) -> DataFrame:
    """(doc_id, text, kinds): mails, mobile numbers, names and addresses masked, in this order.

    A known name is masked as it stands; otherwise a character of ``surnames`` and one or two more. One of the two
    is needed: without any no name could be masked.
    """
    if name_col is None and not surnames:
        raise ValueError("names are masked by a list of surnames or by a column of known names; give one")
    steps: list[tuple[str, str]] = [("email", _MAIL), ("phone", vocab.PHONE_PATTERN)]
    if name_col is None:
        steps.append(("name", rf"(?<![一-龥])[{surnames}][一-龥]{{1,2}}"))
    out = docs.select("doc_id", F.col("text").alias("_t"), *([F.col(name_col).alias("_n")] if name_col else []))
    found = []

    def mask(df: DataFrame, kind: str, pattern: str) -> DataFrame:
        masked = F.regexp_replace("_t", pattern, vocab.REDACTED[kind].replace("[", r"\[").replace("]", r"\]"))
        df = df.withColumn("_m", F.when(_possible("_t", pattern), masked).otherwise(F.col("_t")))
        return df.withColumn(f"_{kind}", F.col("_m") != F.col("_t")).drop("_t").withColumnRenamed("_m", "_t")

    for kind, pattern in steps:
        out, _ = mask(out, kind, pattern), found.append(kind)
    if name_col:
        here = (F.coalesce("_n", F.lit("")) != "") & F.col("_t").contains(F.col("_n"))
        out = out.withColumn("_name", F.coalesce(here, F.lit(False)))
        out = out.withColumn(
            "_t", F.when(F.col("_name"), F.replace("_t", F.col("_n"), F.lit(vocab.REDACTED["name"]))).otherwise(F.col("_t"))
        )
        found.append("name")
    out = mask(out, "address", vocab.ADDRESS_PATTERN)
    found.append("address")
    kinds = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in found]))
    return out.select("doc_id", F.col("_t").alias("text"), kinds.alias("kinds"))


def pii_kind_counts(redacted: DataFrame) -> DataFrame:
    return redacted.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


LEAK_PATTERNS = {"email": _MAIL, "phone": vocab.PHONE_PATTERN, "key": r"sk-[A-Za-z0-9]|LLM_API_KEY"}


def pii_leak_audit(exports: DataFrame, patterns: Mapping[str, str] = LEAK_PATTERNS) -> DataFrame:
    """(export_id, kind, n) of personal data or keys in texts that must hold none."""
    counted = struct_array(
        ("kind", "n"), [(k, F.when(_possible("text", p), F.size(F.regexp_extract_all("text", F.lit(f"({p})"), 1))).otherwise(0)) for k, p in patterns.items()]
    )
    rows = exports.select("export_id", F.explode(counted).alias("x")).select("export_id", "x.*")
    return rows.where(F.col("n") > 0).groupBy("export_id", "kind").agg(F.sum("n").alias("n"))


def _lines(c: str = "text") -> Column:
    return F.split(F.col(c), _LINE_END)


def _cleaned_lines() -> Column:
    """Non-empty lines without list marks."""
    return F.filter(
        F.transform(_lines(), lambda x: text.strip(F.regexp_replace(text.strip(x), r"^[#•·\-— ]+", ""))), lambda x: x != ""
    )


def _section(headings: Sequence[str], boundaries: Sequence[str], at_most: int | None) -> Column:
    """First distinct lines of ``_clean`` under the headings, up to the next known heading."""
    def holds(line: Column, words: Sequence[str]) -> Column:
        return F.greatest(*[line.contains(w) for w in words], F.lit(False))

    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("got"))

    def step(acc: Column, line: Column) -> Column:
        opens = holds(line, headings)
        closes = ~opens & acc["on"] & holds(line, boundaries)
        takes = (
            acc["on"] & ~opens & ~closes & (F.length(line) >= 4)
            & (F.lit(True) if at_most is None else F.size(acc["got"]) < at_most) & ~F.array_contains(acc["got"], line)
        )
        return F.struct(
            F.when(opens, F.lit(True)).when(closes, F.lit(False)).otherwise(acc["on"]).alias("on"),
            F.when(takes, F.concat(acc["got"], F.array(line))).otherwise(acc["got"]).alias("got"),
        )

    return F.aggregate("_clean", start, step, lambda acc: acc["got"])


def section_facts(
    docs: DataFrame,
    headings: Mapping[str, Sequence[str]] = vocab.SECTION_HEADINGS,
    boundaries: Sequence[str] = vocab.SECTION_BOUNDARIES,
    at_most: int | None = None,
) -> DataFrame:
    """(doc_id, section, pos, line): lines listed under project and publication headings."""
    stops = [*boundaries, *[w for ws in headings.values() for w in ws]]
    listed = struct_array(("section", "lines"), [(k, _section(ws, stops, at_most)) for k, ws in headings.items()])
    rows = docs.select("doc_id", _cleaned_lines().alias("_clean")).select("doc_id", F.explode(listed).alias("s"))
    return rows.select("doc_id", "s.section", F.posexplode("s.lines").alias("pos", "line"))


def cv_facts(
    docs: DataFrame,
    skills: Sequence[str] = vocab.SKILLS,
    degrees: Sequence[str] = vocab.DEGREES,
    institution: str = vocab.INSTITUTION_PATTERN,
    interest_keys: Sequence[str] = vocab.INTEREST_KEYS,
    headings: Mapping[str, Sequence[str]] = vocab.SECTION_HEADINGS,
    boundaries: Sequence[str] = vocab.SECTION_BOUNDARIES,
    max_schools: int | None = None,
    max_lines: int | None = None,
) -> DataFrame:
    """(doc_id, fact_id, field, value, status, user_confirmed): candidate facts, none of them confirmed."""
    low = F.lower("text")
    stops = [*boundaries, *[w for ws in headings.values() for w in ws]]

    def as_facts(field: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    def present(words: Sequence[str], hay: Column, fold: bool) -> Column:
        return F.array_compact(F.array(*[F.when(hay.contains(w.lower() if fold else w), F.lit(w)) for w in words]))

    schools = F.regexp_extract_all("text", F.lit(f"({institution})"), 1)
    schools = schools if max_schools is None else F.slice(schools, 1, max_schools)
    keyed = F.filter(_lines(), lambda x: F.greatest(*[x.contains(k) for k in interest_keys], F.lit(False)))
    interests = F.filter(
        F.transform(keyed, lambda x: text.strip(F.regexp_replace(text.strip(x), r"^[：: ]+|[：: ]+$", ""))), lambda v: v != ""
    )
    parts = [
        as_facts("skill", present(skills, low, True)),
        as_facts("degree", present(degrees, F.col("text"), False)),
        as_facts("institution", schools),
        as_facts("interest", interests),
        *[as_facts(k, _section(ws, stops, max_lines)) for k, ws in headings.items()],
    ]
    read = docs.select("doc_id", "text", _cleaned_lines().alias("_clean"))
    rows = read.select("doc_id", F.posexplode(F.concat(*parts)).alias("pos", "x"))
    return rows.select(
        "doc_id",
        F.concat(F.lit("fact_"), F.col("pos").cast("string")).alias("fact_id"),
        "x.field",
        "x.value",
        F.lit("FACT").alias("status"),
        F.lit(False).alias("user_confirmed"),
    )


def fact_edits(edits: DataFrame) -> DataFrame:
    """The user's edited rows as confirmed facts; a row without field or value means deletion.

    ``edits``: student_id, idx, field, value. They replace the facts of that student.
    """
    field, value = text.strip(F.coalesce("field", F.lit(""))), text.strip(F.coalesce("value", F.lit("")))
    return edits.where((field != "") & (value != "")).select(
        "student_id",
        F.concat(F.lit("fact_edit_"), F.col("idx").cast("string")).alias("fact_id"),
        field.alias("field"),
        value.alias("value"),
        F.lit("FACT").alias("status"),
        F.lit(True).alias("user_confirmed"),
    )


def replace_facts(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """Facts of students without edits, and the edits of the others."""
    untouched = facts.join(edits.select("student_id").distinct(), "student_id", "left_anti")
    return untouched.select("student_id", "fact_id", "field", "value", "status", "user_confirmed").unionByName(fact_edits(edits))


def confirm_facts(facts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Exactly the listed (student_id, fact_id) are confirmed."""
    listed = confirmed.select("student_id", "fact_id").distinct().withColumn("_c", F.lit(True))
    rows = facts.drop("user_confirmed").join(listed, ["student_id", "fact_id"], "left")
    return rows.withColumn("user_confirmed", F.coalesce("_c", F.lit(False))).drop("_c")


def extraction_conform(extracted: DataFrame) -> DataFrame:
    """(doc_id, fact_id, field, value) from an outside extraction.

    ``extracted``: doc_id, facts array<struct<field,value>>, projects array<struct<name,description>>,
    publications array<struct<title,venue,year>>. Allowed fields only, trimmed, each value once.
    """
    def item(field: Column, value: Column, index: Column) -> Column:
        return F.struct(field.alias("field"), value.alias("value"), index.alias("i"))

    def glue(sep: str, *parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep)

    def clean(c: Column) -> Column:
        return text.strip(F.coalesce(c, F.lit("")))

    stated = F.transform("facts", lambda f, i: item(clean(f["field"]), clean(f["value"]), i))
    done = F.transform("projects", lambda p: item(F.lit("project"), glue("：", clean(p["name"]), clean(p["description"])), F.lit(-1)))

    def published(p: Column) -> Column:
        details = glue("，", clean(p["venue"]), clean(p["year"]))
        said = F.when(details != "", F.concat(clean(p["title"]), F.lit("（"), details, F.lit("）"))).otherwise(clean(p["title"]))
        return item(F.lit("publication"), said, F.lit(-1))

    everything = F.filter(
        F.concat(stated, done, F.transform("publications", published)),
        lambda x: x["field"].isin(list(vocab.FACT_FIELDS)) & (x["value"] != ""),
    )
    shaped = extracted.select("doc_id", everything.alias("_all"))
    keys = F.transform("_all", lambda x: F.struct(x["field"], x["value"]))
    first = F.filter("_all", lambda x, i: F.array_position(keys, F.struct(x["field"], x["value"])) == i + 1)
    rows = shaped.select("doc_id", F.posexplode(first).alias("pos", "x"))
    number = F.when(F.col("x.i") >= 0, F.col("x.i")).otherwise(F.col("pos"))
    return rows.select(
        "doc_id", F.concat(F.lit("fact_llm_"), number.cast("string")).alias("fact_id"), "x.field", "x.value"
    )
