"""Secret scan by corpus-wide ownership frequency.

Three patterns propose base spans (``assign``, ``access``, ``hex``); opaque tokens (long, letters and digits mixed,
not part of a base span) are proposed besides. The hash of every proposed value is counted over the whole corpus by
distinct repositories and owners. A value seen at ``shared_owners`` owners or more is a widely copied example; one
that a single owner has and that looks random is live-looking, and an opaque token of that kind becomes a span of
kind ``live``. Base spans are always returned; ``verdicts`` says what the corpus makes of each.

The scan of the texts is one pass without a shuffle; only its small result, the matches, is shuffled. Positions are
code points, ends exclusive: the stretches between matches (``split``) and the matches (``regexp_extract_all``)
give them as running sums. Values are pre-aggregated by (hash, owner, repository) before they are counted.

Defined cases: a null text counts as empty; a null owner or repository is one of its own; repeated rows are scanned
one by one; a document without matches has zero counts, the hash of the empty list and an empty span list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmatch.sources.tables import settle

#: Base kinds in their order. For runs of one class, asking for the least length finds what filtering all runs finds.
KINDS = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: What opaque tokens are made of, the least length, and the marks of a placeholder.
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|your[_-]|0000000|1234567"
#: Least length of an assigned value.
ASSIGNED = 6
#: Different characters that a random-looking value has at least.
VARIETY = 10
#: Owners from which a value counts as widely copied.
SHARED_OWNERS = 3


def _found(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` with the lengths of the stretches before them; null where there is none."""
    pieces = F.split(text, pattern, -1)
    parts = F.struct(F.transform(pieces, F.length).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("texts"))
    return F.when(text.rlike(pattern), parts)


def matches(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """One row per document with the matches of every kind; no text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [_found(text, p).alias(k) for k, p in {**KINDS, "opaque": OPAQUE}.items()]
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), *found
    )


def spans(scanned: DataFrame) -> DataFrame:
    """rid, owner, repo, kind, nr, start, end, value: base spans that hold, and opaque tokens outside of them."""
    parts = []
    for nr, kind in enumerate([*KINDS, "opaque"]):
        rows = scanned.where(F.col(kind).isNotNull()).select("rid", "owner", "repo", F.col(kind).alias("m"))
        opened = rows.select("rid", "owner", "repo", "m.gaps", F.posexplode("m.texts").alias("i", "text"))
        parts.append(opened.select("rid", "owner", "repo", F.lit(kind).alias("kind"), F.lit(nr).alias("nr"), "i", F.element_at("gaps", F.col("i") + 1).alias("gap"), "text"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    running = Window.partitionBy("rid", "nr").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("text")).over(running)
    value = F.when(F.col("kind") == "assign", F.regexp_extract("text", KINDS["assign"], 2)).otherwise(F.col("text"))
    placed = rows.select("rid", "owner", "repo", "kind", "nr", end.alias("end"), F.length("text").alias("size"), value.alias("value"))
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    held = placed.where(F.when(F.col("kind") == "assign", F.length("value") >= ASSIGNED).otherwise(True))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    held = held.where((F.col("kind") != "opaque") | mixed)
    base = F.col("kind") != "opaque"
    by_start = Window.partitionBy("rid").orderBy("start", "nr")
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    seen = held.withColumn("reach", reach).withColumn("following", following)
    apart = (F.coalesce(F.col("reach"), F.lit(0)) <= F.col("start")) & (F.col("following").isNull() | (F.col("following") >= F.col("end")))
    return seen.where(base | apart).drop("reach", "following", "size")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos, n_spans over the whole corpus."""
    pairs = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_spans"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, verdicts: one row per input row.

    ``owner`` is the source and ``repo`` the source with the language, if not given.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if repo is None else repo
    scanned = settle(matches(docs, id_col, text_col, owner, repo), "secret-matches")
    found = settle(spans(scanned).withColumn("hash", F.xxhash64("value")), "secret-spans")
    counted = found.join(ownership(found), "hash")
    random_looking = (F.size(F.array_distinct(F.split("value", ""))) >= VARIETY) & ~F.col("value").rlike(PLACEHOLDER)
    verdict = (
        F.when(F.col("n_owners") >= shared_owners, "shared").when((F.col("n_owners") == 1) & random_looking, "live").otherwise("unclear")
    )
    judged = counted.withColumn("verdict", verdict).where((F.col("kind") != "opaque") | (F.col("verdict") == "live"))
    judged = judged.withColumn("kind", F.when(F.col("kind") == "opaque", "live").otherwise(F.col("kind")))
    item = F.concat_ws(":", "kind", "start", "end")
    listed = judged.groupBy("rid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.struct("start", "nr", item.alias("item"), "verdict"))).alias("all"),
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "shared").alias("n_shared"),
    )
    join = lambda kept, field: F.concat_ws(",", F.transform(kept, lambda x: x[field]))
    shaped = listed.select(
        "rid", *[f"n_{k}" for k in KINDS], join(F.filter("all", lambda x: x["nr"] < len(KINDS)), "item").alias("base"), join(F.col("all"), "item").alias("spans"),
        "n_live", "n_shared", join(F.col("all"), "verdict").alias("verdicts"),
    )
    rows = scanned.select("rid", "doc_id").join(shaped, "rid", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "doc_id", *[number(f"n_{k}") for k in KINDS], F.sha2(blank("base"), 256).alias("base_sha256"), blank("spans").alias("spans"),
        number("n_live"), number("n_shared"), blank("verdicts").alias("verdicts"),
    )
