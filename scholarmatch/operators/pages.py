"""Web pages as tables: text, structured fields, links, people records, freshness."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Sequence
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarmatch.functions import text, vocab
from scholarmatch.functions.scale import previous_value, struct_array

_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


@F.pandas_udf(T.StringType())
def _resolved(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _reference(found: re.Match) -> str:
    whole = found[0]
    return html.unescape(whole) if whole[1] == "#" or whole[1:] in html5 else whole


@F.pandas_udf(T.StringType())
def _resolved_closed(values: pd.Series) -> pd.Series:
    return values.map(lambda t: _CLOSED.sub(_reference, t), na_action="ignore")


def unescape(c: Column, unclosed: bool = True) -> Column:
    """All character references of the HTML standard, resolved in one pass from the left; texts without any stay in the JVM.

    Old names count without their semicolon too, as in browsers, unless ``unclosed`` is False.
    """
    resolve = _resolved if unclosed else _resolved_closed
    return F.when(c.contains("&"), resolve(F.when(c.contains("&"), c))).otherwise(c)


def html_text(source, unclosed: bool = True) -> Column:
    """Readable text: scripts, styles and comments dropped, a line per block element, blanks squeezed."""
    c = F.col(source) if isinstance(source, str) else source
    blocks = "|".join(vocab.BLOCK_TAGS)
    bare = F.regexp_replace(c, r"(?s)<!--.*?-->|<![^>]*>", "")
    bare = F.regexp_replace(bare, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, rf"(?i)<(?:{blocks})(?:\s[^>]*)?/?>", "\n")
    bare = F.regexp_replace(bare, r"</?[a-zA-Z][^>]*>", "")
    squeezed = F.regexp_replace(unescape(bare, unclosed), r"[ \t]+", " ")
    return text.strip(F.regexp_replace(squeezed, r"\n\s*\n+", "\n"))


def page_text(pages: DataFrame, unclosed: bool = True) -> DataFrame:
    """(page_id, url, title, text, n_chars, content_hash); ``unclosed`` as for ``unescape``."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return pages.select("page_id", "url", title.alias("title"), html_text("html", unclosed).alias("text")).select(
        "page_id",
        "url",
        "title",
        "text",
        F.length("text").alias("n_chars"),
        F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"),
    )


# --- structured fields -------------------------------------------------------------------------
_PERSON = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


@F.pandas_udf(_PERSON)
def _people_in(blocks: pd.Series) -> pd.Series:
    """Person nodes at any depth of a page's JSON-LD blocks (nesting depth is open, SQL's is not)."""
    def leaves(value, keys):
        """Nodes in document order; ``keys`` are the object members to go into."""
        todo = [value]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += reversed(node)
                continue
            yield node
            if isinstance(node, dict):
                todo += [node[k] for k in reversed(keys) if k in node]

    def words(v) -> str:
        parts = v if isinstance(v, list) else [v]
        return "、".join(filter(None, (str(x).strip() for x in parts if x is not None)))

    def first(v) -> str:
        texts = (str(x).strip() for x in leaves(v, ("name", "@value", "value")) if x is not None and not isinstance(x, dict))
        return next(filter(None, texts), "")

    def persons(data):
        for node in leaves(data, ("@graph", "author", "mainEntity")):
            kinds = node.get("@type") if isinstance(node, dict) else None
            if kinds == "Person" or (isinstance(kinds, list) and "Person" in kinds):
                yield node

    def fields(person: dict) -> dict[str, str]:
        home = person.get("affiliation") or person.get("worksFor")
        return {
            "name": words(person.get("name")),
            "title": words(person.get("jobTitle")),
            "email": words(person.get("email")).replace("mailto:", ""),
            "institution": first(home),
            "department": first(home.get("department")) if isinstance(home, dict) else "",
            "declared_interests": words(person.get("knowsAbout")),
        }

    def page(texts) -> list[dict[str, str]]:
        out = []
        for raw in texts if texts is not None else ():
            try:
                data = json.loads(raw.strip())
            except ValueError:
                continue
            out.extend(map(fields, persons(data)))
        return out

    return blocks.map(page)


def title_name(title: Column) -> Column:
    """The part of a page title before the first kind of separator, if two to six characters long."""
    def head(sep: str) -> Column:
        part = text.strip(F.substring_index(title, sep, 1))
        return F.when(title.contains(sep) & F.length(part).between(2, 6), part)

    return F.coalesce(*[head(s) for s in ("-", "|", "_", "—", "–")], F.lit(""))


def page_structured_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field, value, origin): JSON-LD people first, then meta tags; first non-empty value wins."""
    ld = F.regexp_extract_all(
        "html", F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1
    )
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<meta\s+([^>]+?)/?>"), 1)

    def attr(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"""(?i)(?<![a-z:-]){name}\s*=\s*["']([^"']*)["']""", 1)

    metas = F.filter(
        F.transform(
            tags,
            lambda t: F.struct(
                F.lower(F.coalesce(F.when(attr(t, "name") != "", attr(t, "name")), attr(t, "property"))).alias("k"),
                text.strip(attr(t, "content")).alias("v"),
            ),
        ),
        lambda m: (m["k"] != "") & (m["v"] != ""),
    )
    read = pages.select("page_id", ld.alias("_ld"), metas.alias("_meta")).withColumn("_people", _people_in("_ld"))

    def meta(*names: str) -> Column:
        def one(n: str) -> Column:
            return F.try_element_at(F.filter("_meta", lambda m: m["k"] == n), F.lit(1))["v"]

        return F.coalesce(*[one(n) for n in names])

    def person(field: str) -> Column:
        found = F.filter(F.transform("_people", lambda p: p[field]), lambda v: F.coalesce(v, F.lit("")) != "")
        return F.try_element_at(found, F.lit(1))

    author = meta("author")
    from_title = title_name(F.coalesce(meta("og:title", "title"), F.lit("")))
    by_meta = {
        "name": F.coalesce(author, F.when(from_title != "", from_title)),
        "declared_interests": meta("keywords"),
    }
    listed = struct_array(
        ("field", "value", "origin"),
        [
            (
                f,
                F.coalesce(person(f), by_meta.get(f, F.lit(None).cast("string"))),
                F.when(person(f).isNotNull(), F.lit("json-ld")).otherwise(F.lit("meta")),
            )
            for f in ("name", "title", "email", "institution", "department", "declared_interests")
        ],
    )
    return read.select("page_id", F.explode(listed).alias("x")).where(F.col("x.value").isNotNull()).select("page_id", "x.*")


def page_rule_fields(
    pages_text: DataFrame,
    title_words: Sequence[str] = vocab.PAGE_TITLE_WORDS,
    markers: Sequence[str] = vocab.INTEREST_MARKERS,
    department: str = vocab.DEPARTMENT_PATTERN,
) -> DataFrame:
    """(page_id, field, value) read from plain text: first mail, department, title line, interests line."""
    lines = F.filter(F.transform(F.split("text", _LINE_END), text.strip), lambda x: x != "")
    shaped = pages_text.select("page_id", "text", lines.alias("_lines"))
    words = sorted(title_words, key=len, reverse=True)

    def any_word(line: Column) -> Column:
        return F.greatest(*[line.contains(w) for w in words], F.lit(False))

    titled = F.try_element_at(F.filter("_lines", lambda x: (F.length(x) <= 40) & any_word(x)), F.lit(1))
    title = F.coalesce(*[F.when(titled.contains(w), F.lit(w)) for w in words], F.lit(""))

    def after_marker(line: Column) -> Column:
        return F.coalesce(
            *[
                F.when(
                    line.startswith(m),
                    text.strip(F.regexp_replace(F.substring(line, F.lit(len(m) + 1), F.length(line)), r"^[：: 　]+", "")),
                )
                for m in markers
            ],
            F.lit(""),
        )

    interests = F.try_element_at(F.filter(F.transform("_lines", after_marker), lambda v: v != ""), F.lit(1))
    dept = F.regexp_extract("text", f"({department})", 1)
    bare = F.regexp_replace(dept, r"^.{2,}?(?:大学|学校)", "")
    listed = struct_array(
        ("field", "value"),
        (
            ("email", F.regexp_extract("text", f"({text.EMAIL})", 1)),
            ("department", F.when(bare != "", bare).otherwise(dept)),
            ("title", title),
            ("declared_interests", F.coalesce(interests, F.lit(""))),
        ),
    )
    return shaped.select("page_id", F.explode(listed).alias("x")).where(F.col("x.value") != "").select("page_id", "x.*")


# --- links and people --------------------------------------------------------------------------
def resolve_url(base: Column, href: Column) -> Column:
    """``href`` as a browser on ``base`` would follow it."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    def tidy(p: Column) -> Column:
        parts = F.split(F.regexp_extract(p, r"^([^?#]*)", 1), "/")
        tail = F.regexp_extract(p, r"^[^?#]*(.*)$", 1)
        last = F.element_at(parts, -1)
        kept = F.aggregate(
            F.slice(parts, 2, F.size(parts)),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        closing = F.when(last.isin(".", ".."), F.lit("/")).otherwise("")
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, closing).otherwise(""), tail)

    dotted = F.regexp_extract(href, r"^([^?#]*)", 1).rlike(r"(^|/)\.\.?(/|$)")
    rooted = F.when(dotted, tidy(href)).otherwise(href)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, rooted))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("#"), F.concat(root, path, query, href))
        .otherwise(F.concat(root, tidy(F.concat(folder, href))))
    )


def page_links(
    pages: DataFrame, hints: Sequence[str] = vocab.DETAIL_HINTS, name_pattern: str = r"^[一-龥·]{2,4}$"
) -> DataFrame:
    """(page_id, pos, text, href, is_person): anchors with text and target; short names on detail pages are people."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)(<a(?:\s[^>]*)?>.*?</a\s*>)"), 1)
    rows = pages.select("page_id", "url", F.posexplode(anchors).alias("pos", "a"))
    opening = F.regexp_extract("a", r"(?is)^(<a(?:\s[^>]*)?>)", 1)
    quoted = F.regexp_extract(opening, r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    single = F.regexp_extract(opening, r"""(?is)\shref\s*=\s*'([^']*)'""", 1)
    plain = F.regexp_extract(opening, r"""(?is)\shref\s*=\s*([^\s"'>]+)""", 1)
    raw = F.when(quoted != "", quoted).when(single != "", single).otherwise(plain)
    said = F.trim(F.regexp_replace(unescape(F.regexp_replace("a", r"(?s)<[^>]*>", "")), r"\s+", " "))
    shaped = rows.select("page_id", "url", "pos", text.strip(unescape(raw)).alias("h"), said.alias("text")).where(
        (F.col("h") != "") & (F.col("text") != "") & ~F.col("h").rlike("^(?:javascript:|mailto:|#)")
    )
    absolute = resolve_url(F.col("url"), F.col("h"))
    hinted = F.greatest(*[F.col("href").contains(x) for x in hints], F.lit(False))
    return shaped.withColumn("href", absolute).select(
        "page_id", "pos", "text", "href", (F.col("text").rlike(name_pattern) & hinted).alias("is_person")
    )


def card_link_fields(
    links: DataFrame,
    roots: Sequence[str],
    titles: Sequence[str] = vocab.TITLE_SUFFIXES,
    starts: Sequence[str] = vocab.CARD_REST_STARTS,
) -> DataFrame:
    """(link_id, name, title, email) of links whose text is a whole contact card run together.

    Mail and the first listed title are taken out; three, then two characters are a name if what
    follows begins like an institution, else the part before the first punctuation may be one.
    """
    from scholarmatch.operators.catalog import foreign_name

    raw = F.regexp_replace("text", r"\s+", "")

    def without(value: Column, part: Column) -> Column:
        return F.when(part != "", F.replace(value, part, F.lit(""))).otherwise(value)

    def one(df: DataFrame, **columns: Column) -> DataFrame:
        # a generator of one row: what it yields is computed once, not copied into every later use
        made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("x")
        return df.select("link_id", made).select("link_id", "x.*")

    shaped = one(links, _all=raw, email=F.regexp_extract(raw, f"({text.EMAIL})", 1)).where(F.length("_all") >= 2)
    shaped = one(shaped, email=F.col("email"), _t=without(F.col("_all"), F.col("email")))
    listed = F.array(*[F.lit(w) for w in titles])
    title = F.coalesce(F.try_element_at(F.filter(listed, lambda w: F.col("_t").contains(w)), F.lit(1)), F.lit(""))
    shaped = one(shaped, email=F.col("email"), title=title, _t=F.col("_t"))
    shaped = one(shaped, email=F.col("email"), title=F.col("title"), _t=without(F.col("_t"), F.col("title")))
    root_pattern = "|".join(roots) if roots else None

    def named(c: Column) -> Column:
        shape = c.rlike(r"^[一-龥]{2,4}$")
        return shape & ~c.rlike(root_pattern) if root_pattern else shape

    def cut(n: int) -> Column:
        head, rest = F.substring("_t", 1, n), F.substring(F.col("_t"), F.lit(n + 1), F.length("_t"))
        return F.when((F.length("_t") > n) & named(head) & rest.rlike("^(?:" + "|".join(starts) + ")"), head)

    lone = F.split("_t", r"[，,、。；;：:(（]")[0]
    name = F.coalesce(cut(3), cut(2), F.when(named(lone) | foreign_name(lone), lone))
    return shaped.withColumn("name", name).where(F.col("name").isNotNull()).select("link_id", "name", "title", "email")


def faculty_records(people: DataFrame, pages_text: DataFrame, profile_chars: int | None = None) -> DataFrame:
    """Faculty rows for known people pages. ``people``: university, college, name, href and, if known, page_id.

    People meet their page by ``page_id`` where they have it, as pages can share an address; else by the address, a row
    for every page there. Who lacks one of the four has a null id.
    """
    key = "page_id" if "page_id" in people.columns else "href"
    joined = people.join(pages_text.select(F.col("page_id" if key == "page_id" else "url").alias(key), "text"), key)
    end = F.lit("\n")
    ident = F.substring(F.sha2(F.concat("university", end, "college", end, "name", end, "href"), 256), 1, 16)
    body = F.col("text") if profile_chars is None else F.substring("text", 1, profile_chars)
    return joined.select(
        ident.alias("id"),
        "name",
        "university",
        "college",
        F.col("href").alias("homepage_url"),
        F.regexp_extract("text", f"({text.EMAIL})", 1).alias("email"),
        body.alias("profile_text"),
        F.col("href").alias("source_url"),
    )


# --- freshness ---------------------------------------------------------------------------------
def page_freshness(fetches: DataFrame, now: str) -> DataFrame:
    """(url, fetched_at, expires_at, fresh, changed, hits) of the latest fetch of each url.

    ``fetches``: url, fetched_at, content_hash, ttl_days, hits. Fresh means it expires after ``now``. Of fetches at
    one instant the one with the highest content hash, then the longest ttl, is the latest.
    """
    latest = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("content_hash"), F.desc("ttl_days"))
    two = fetches.withColumn("_r", F.row_number().over(latest)).where("_r <= 2")
    sums = fetches.groupBy("url").agg(F.sum("hits").alias("hits"))

    def of(rank: int, c: str) -> Column:
        return F.max(F.when(F.col("_r") == rank, F.col(c)))

    rows = two.groupBy("url").agg(
        of(1, "fetched_at").alias("fetched_at"),
        of(1, "ttl_days").alias("ttl_days"),
        of(1, "content_hash").alias("_h"),
        of(2, "content_hash").alias("_p"),
    )
    expires = F.col("fetched_at") + F.make_dt_interval(F.col("ttl_days").cast("int"))
    return rows.join(sums, "url").select(
        "url",
        "fetched_at",
        expires.alias("expires_at"),
        (expires > F.lit(now).cast("timestamp_ntz")).alias("fresh"),
        F.coalesce(F.col("_h") != F.col("_p"), F.lit(False)).alias("changed"),
        "hits",
    )


def page_changes(fetches: DataFrame) -> DataFrame:
    """Every fetch with whether its content differs from the fetch before it; null for the first one.

    Fetches of one instant follow one another by content hash.
    """
    before = previous_value(fetches, ["url"], ["fetched_at", "content_hash"], "content_hash", "previous_hash")
    return before.select(
        "url", "fetched_at", "content_hash", (F.col("content_hash") != F.col("previous_hash")).alias("changed")
    )
