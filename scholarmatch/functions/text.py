"""Text expressions. All run inside the JVM except the two Unicode foldings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarmatch.functions import vocab

BLANKS = r"[\s\u00a0\u3000]"
#: every character that counts as a blank at the ends of a text
_SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CJK_RUN = r"[一-鿿]{2,}"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def strip(value) -> Column:
    """Trim every kind of blank, also the ideographic and the no-break space."""
    return F.btrim(_col(value), F.lit(_SPACES))


def squeeze(value) -> Column:
    """Blanks collapsed to one space, ends trimmed, null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(value).cast("string"), F.lit("")), rf"{BLANKS}+", " "))


def blank(value) -> Column:
    return F.coalesce(strip(_col(value).cast("string")), F.lit("")) == ""


def is_empty(value, dtype: T.DataType | None = None) -> Column:
    """Null, a blank string or an empty collection."""
    c = _col(value)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) <= 0, F.lit(True))
    return blank(c)


def is_empty_json(value) -> Column:
    """Also empty: the JSON texts of an empty list, empty map and null."""
    return F.coalesce(strip(_col(value)), F.lit("")).isin("", "[]", "{}", "null")


def present(value) -> Column:
    """The value, or null where it is blank."""
    c = _col(value)
    return F.when(~blank(c), c)


@F.udf(T.StringType(), useArrow=False)
def _nfkc(value: str | None) -> str | None:
    return None if value is None else unicodedata.normalize("NFKC", value)


def nfkc(value) -> Column:
    """Width folding. Texts of ASCII only stay in the JVM, as it leaves them as they are.

    Not by Arrow: its batches are of 10,000 rows or 256 MB, which Python holds several times over where texts are long;
    rows sent plainly come a hundred at a time.
    """
    c = _col(value)
    wide = c.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _nfkc(F.when(wide, c))).otherwise(c)


@F.pandas_udf(T.StringType())
def fold_accents(values: pd.Series) -> pd.Series:
    """Width and accent folding; Spark has no Unicode normalisation of its own."""
    def fold(text):
        if text is None or text.isascii():
            return text
        wide = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
        return "".join(c for c in wide if not unicodedata.combining(c))

    return values.map(fold)


def doi_key(value) -> Column:
    """Bare lower-case DOI, '' when there is none."""
    lowered = F.lower(strip(F.coalesce(_col(value), F.lit(""))))
    prefixes = "|".join(p.replace(".", r"\.").replace("/", r"\/") for p in vocab.DOI_PREFIXES)
    return strip(F.regexp_replace(lowered, f"^(?:{prefixes})", ""))


def title_key(value, unicode: bool = True) -> Column:
    """Width-folded, tag-free, lower-case title without punctuation and blanks."""
    c = F.coalesce(_col(value), F.lit(""))
    folded = nfkc(c) if unicode else c
    bare = F.lower(F.regexp_replace(folded, r"<[^>]+>", ""))
    return F.regexp_replace(bare, vocab.TITLE_NOISE, "")


def person_key(value) -> Column:
    """Accent-folded name without separators, lower case."""
    return F.lower(F.regexp_replace(fold_accents(F.coalesce(_col(value), F.lit(""))), vocab.NAME_SEPARATORS, ""))


def name_tokens(folded: Column) -> Column:
    """Tokens of an already folded, lower-case name."""
    return F.filter(F.split(folded, vocab.NAME_SEPARATORS), lambda t: t != "")


def cjk_runs(value) -> Column:
    """Runs of two or more Han characters; blanks inside a name do not split it."""
    return F.regexp_extract_all(
        F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"\s+", ""), F.lit(f"({CJK_RUN})"), 1
    )


def has_cjk(value) -> Column:
    return F.coalesce(_col(value), F.lit("")).rlike(r"[一-鿿]")


def split_terms(value) -> Column:
    """Distinct trimmed terms of a free-text query, in order."""
    parts = F.split(F.coalesce(_col(value), F.lit("")), r"[,，;；、|\n\r]+")
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda t: t != ""))


def safe_terms(terms) -> Column:
    """Terms without pattern wildcards."""
    cleaned = F.transform(_col(terms), lambda t: strip(F.regexp_replace(t, r"[%_\\]", "")))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


def normal_name(value) -> Column:
    """Comparison form of names and paper keys in contact records."""
    return F.lower(F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"[\s·・,，;；]+", ""))


def parent_college(value) -> Column:
    """Department cut after its first college marker."""
    compact = F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"\s+", "")
    cut = F.regexp_extract(compact, r"^(.*?学院)", 1)
    return F.when(cut != "", cut).otherwise(compact)


def school_email(value) -> Column:
    """True when the mail domain ends like a school's."""
    suffixes = "|".join(s.replace(".", r"\.") for s in vocab.SCHOOL_MAIL_SUFFIXES)
    return F.coalesce(F.lower(strip(_col(value))).rlike(rf"@[^@]*(?:{suffixes})$"), F.lit(False))


def contains_either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def homepage_key(url) -> Column:
    """Scheme, host and path of a homepage: lower-case host, no trailing slash, no query."""
    c = strip(url)
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path))


def identity_key(homepage, institution=None, department=None, name=None) -> Column:
    """Stable person key: the homepage when known, else school, department and name."""
    fallback = F.concat(
        F.lit("fallback:"),
        F.concat_ws(
            "|",
            *[
                F.lower(strip(F.coalesce(v if v is not None else F.lit(""), F.lit(""))))
                for v in (institution, department, name)
            ],
        ),
    )
    seed = F.when(
        F.coalesce(homepage, F.lit("")) != "", F.concat(F.lit("homepage:"), homepage_key(homepage))
    ).otherwise(fallback)
    return F.concat(F.lit("prof_"), F.substring(F.sha2(seed, 256), 1, 16))


def features(value) -> Column:
    """Surface features for lexical similarity: Han runs with their bigrams, Latin words."""
    text = F.lower(F.coalesce(_col(value), F.lit("")))
    runs = F.regexp_extract_all(text, F.lit(r"([一-龥]+)"), 1)
    grams = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
                F.concat(
                    F.array(r),
                    F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2)),
                )
            ),
        )
    )
    words = F.regexp_extract_all(text, F.lit(r"([a-zA-Z][a-zA-Z0-9+#.\-]{1,})"), 1)
    return F.concat(grams, words)


def compact(value, limit: int = 72) -> Column:
    """One-line text cut to ``limit`` characters with an ellipsis."""
    text = squeeze(value)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    )


def digest_args(args) -> Column:
    """Sorted key=value digest of a string map, values cut to 24 and the whole to 80 characters."""
    def cut(v: Column, limit: int) -> Column:
        return F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit), F.lit("…"))).otherwise(v)

    entries = F.array_sort(F.map_entries(_col(args)))
    parts = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), cut(squeeze(e["value"]), 24)))
    return F.coalesce(cut(F.array_join(parts, "&"), 80), F.lit(""))
