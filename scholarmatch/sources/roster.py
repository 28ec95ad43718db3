"""Community roster dumps: one deduplicated roster, all reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmatch.functions import text
from scholarmatch.functions.scale import keep_first

_NOTE = r"[（(]([^）)]*)[）)]"
_PREFIX = r"(?i)^\s*(?:re|回复|答复)\s*[:：]\s*"
_ITEM = (
    "school_cate string, university string, department string, supervisor string, "
    "rate string, desc string, description string"
)


def unwrap_payloads(raw: DataFrame, payload: str = "payload", seq: str = "seq") -> DataFrame:
    """JSON texts (a list, one object, or an object around a list) -> one row per entry object."""
    v = text.strip(payload)

    def inside(key: str) -> Column:
        found = F.get_json_object(v, f"$.{key}")
        return F.when(found.startswith("["), found)

    listed = F.when(v.startswith("["), v).otherwise(
        F.coalesce(*[inside(k) for k in ("data", "items", "results", "comments")], F.concat(F.lit("["), v, F.lit("]")))
    )
    items = F.filter(F.from_json(listed, "array<string>"), lambda i: F.ltrim(i).startswith("{"))
    rows = raw.select(F.col(seq).alias("seq"), F.posexplode(items).alias("pos", "item"))
    return rows.select("seq", "pos", F.from_json("item", _ITEM).alias("i")).select("seq", "pos", "i.*")


def split_note(supervisor) -> tuple[Column, Column]:
    """Name without brackets and reply prefix, and the bracket remarks."""
    raw = text.strip(F.coalesce(F.col(supervisor), F.lit("")))
    notes = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(_NOTE), 1), text.strip), lambda n: n != "")
    name = text.strip(F.regexp_replace(text.strip(F.regexp_replace(raw, _NOTE, "")), _PREFIX, ""))
    return F.when(name != "", name).otherwise(raw), F.array_join(notes, "；")


def _conform(items: DataFrame) -> DataFrame:
    name, note = split_note("supervisor")

    def clean(c: str) -> Column:
        return text.strip(F.coalesce(F.col(c), F.lit("")))

    return items.select(
        F.struct("seq", "pos").alias("arrival"),
        clean("university").alias("university"),
        clean("department").alias("department"),
        name.alias("supervisor"),
        note.alias("note"),
        clean("school_cate").alias("school_cate"),
        F.col("rate").try_cast("double").alias("rate"),
        clean("desc").alias("summary"),
        clean("description").alias("detail"),
    ).where((F.col("university") != "") & (F.col("supervisor") != ""))


def load_roster(items: DataFrame) -> DataFrame:
    """One entry per (university, department, supervisor), the first to arrive."""
    rows = _conform(items).select("arrival", "university", "department", "supervisor", "note", "school_cate")
    return keep_first(rows, ["university", "department", "supervisor"], "arrival").drop("arrival")


def load_reviews(items: DataFrame, existing: DataFrame | None = None, replace: bool = True) -> DataFrame:
    """Every review that says anything; appended to ``existing`` unless it is to be replaced."""
    rows = _conform(items).where(
        (F.col("detail") != "") | (F.col("summary") != "") | F.col("rate").isNotNull()
    )
    fresh = rows.select("university", "department", "supervisor", "rate", "summary", "detail")
    return fresh if replace or existing is None else existing.select(*fresh.columns).unionByName(fresh)
