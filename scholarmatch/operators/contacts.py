"""Contact collisions: do two supervisors someone means to write to work together?

Only pairs somebody selected are judged. Each step joins the pairs with the papers or coauthors of
the person that has fewer of them and then looks the rest up on (other person, value), so a very
productive person costs no more than their partners do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmatch.functions import text, vocab
from scholarmatch.sources.tables import settle


#: Members of a selection that meet each other, or those of another tile, together.
TILE = 256


def selected_pairs(selections: DataFrame, contacts: DataFrame, tile: int = TILE) -> DataFrame:
    """(group_id, n_members, left_id, right_id) from each selection's member list, known people only.

    A selection is cut into tiles of ``tile`` members, and every two tiles meet by themselves: no row and no task
    holds the pairs of a large group. Groups of fewer than two known members keep one row without a pair.
    """
    place = F.posexplode("members")
    listed = selections.select("group_id", place.alias("pos", "person")).join(contacts.select("person"), "person", "left_semi")
    members = settle(listed.withColumn("_t", F.floor(F.col("pos") / tile).cast("int")), "members")
    groups = members.groupBy("group_id").agg(F.count("*").cast("int").alias("n_members"), F.max("_t").alias("_last"))
    dealt = members.join(groups.select("group_id", "_last"), "group_id")
    left = dealt.select("group_id", F.col("pos").alias("_i"), F.col("person").alias("left_id"), F.col("_t").alias("_a"), F.explode(F.sequence("_t", "_last")).alias("_b"))
    right = dealt.select("group_id", F.col("pos").alias("_j"), F.col("person").alias("right_id"), F.explode(F.sequence(F.lit(0), "_t")).alias("_a"), F.col("_t").alias("_b"))
    pairs = left.join(right, ["group_id", "_a", "_b"]).where("_i < _j").select("group_id", "left_id", "right_id")
    return groups.drop("_last").join(pairs, "group_id", "left")


def paper_keys(papers: DataFrame) -> DataFrame:
    """(person, seq, title, key): normalised title, DOI and link of every paper."""
    keys = F.array_distinct(F.filter(F.array(*[text.normal_name(c) for c in ("title", "doi", "source_url")]), lambda k: k != ""))
    return papers.select("person", "seq", "title", F.explode(keys).alias("key"))


def coauthor_counts(papers: DataFrame, contacts: DataFrame) -> DataFrame:
    """(person, coauthor, n): in how many of a person's papers a coauthor appears."""
    own = contacts.select("person", text.normal_name("name").alias("_own"))
    names = F.array_distinct(F.transform("authors", text.normal_name))
    listed = papers.select("person", F.explode(names).alias("coauthor")).where(F.col("coauthor") != "")
    counted = listed.groupBy("person", "coauthor").agg(F.count("*").alias("n"))
    return counted.join(own, "person").where(F.col("coauthor") != F.col("_own")).select("person", "coauthor", "n")


def _meet(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(left_id, right_id, value) for values both people of a pair have, from the shorter list."""
    values = settle(values, "contact-values")  # counted, listed and looked up
    sizes = values.groupBy("person").agg(F.count("*").alias("n"))
    sized = pairs.join(sizes.select(F.col("person").alias("left_id"), F.col("n").alias("nl")), "left_id").join(
        sizes.select(F.col("person").alias("right_id"), F.col("n").alias("nr")), "right_id"
    )
    small_left = F.col("nl") <= F.col("nr")
    oriented = sized.select(
        "left_id",
        "right_id",
        F.when(small_left, F.col("left_id")).otherwise(F.col("right_id")).alias("person"),
        F.when(small_left, F.col("right_id")).otherwise(F.col("left_id")).alias("other"),
    )
    held = values.select(F.col("person").alias("other"), value)
    return oriented.join(values.select("person", value), "person").join(held, ["other", value]).select(
        "left_id", "right_id", value
    )


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("left_id IS NOT NULL").select("left_id", "right_id").distinct()


def _common_keys(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(left_id, right_id, key) of paper keys both people of a pair have."""
    return _meet(_distinct_pairs(pairs), keyed.select("person", "key").distinct(), "key")


def shared_papers(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    """(left_id, right_id, seq, title): the left person's papers that carry a key of the right person's."""
    keyed = paper_keys(papers)
    common = _common_keys(pairs, keyed)
    titled = keyed.select(F.col("person").alias("left_id"), "key", "seq", "title")
    return common.join(titled, ["left_id", "key"]).select("left_id", "right_id", "seq", "title").distinct()


def direct_coauthors(pairs: DataFrame, counts: DataFrame, contacts: DataFrame) -> DataFrame:
    """(left_id, right_id) where either name stands among the other's coauthors."""
    names = contacts.select("person", text.normal_name("name").alias("coauthor"))
    p = _distinct_pairs(pairs)
    ways = []
    for me, other in (("left_id", "right_id"), ("right_id", "left_id")):
        asked = p.join(names.withColumnRenamed("person", other), other).withColumnRenamed(me, "person")
        hit = asked.join(counts.select("person", "coauthor"), ["person", "coauthor"], "left_semi")
        ways.append(hit.withColumnRenamed("person", me).select("left_id", "right_id"))
    return ways[0].unionByName(ways[1]).distinct()


def stable_overlap(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(left_id, right_id, coauthor) of coauthors both people published with at least twice."""
    steady = counts.where(F.col("n") >= 2).select("person", "coauthor")
    return _meet(_distinct_pairs(pairs), steady, "coauthor")


def _listed(rows: DataFrame, value: str, order: str, shown: int | None, out: str) -> DataFrame:
    """All values of a pair in order, or the first ``shown``."""
    if shown is not None:
        rank = F.row_number().over(Window.partitionBy("left_id", "right_id").orderBy(order))
        rows = rows.withColumn("_r", rank).where(F.col("_r") <= shown).drop("_r")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy("left_id", "right_id").agg(F.array_join(F.transform(ordered, lambda x: x["v"]), "、").alias(out))


def collision_level(
    pairs: DataFrame, contacts: DataFrame, papers: DataFrame, shown_papers: int | None = None, shown_names: int | None = None
) -> DataFrame:
    """(left_id, right_id, level, reason, evidence) for every distinct selected pair.

    The evidence names all shared papers and steady coauthors, or the first ``shown_papers`` and ``shown_names``.
    """
    counts = settle(coauthor_counts(papers, contacts), "coauthors")
    p = settle(_distinct_pairs(pairs), "selected-pairs")
    shared = _listed(shared_papers(p, papers), "title", "seq", shown_papers, "shared")
    steady = _listed(stable_overlap(p, counts), "coauthor", "coauthor", shown_names, "steady")
    return _judged(p, contacts, papers, counts, shared, steady)


def _judged(p: DataFrame, contacts: DataFrame, papers: DataFrame, counts: DataFrame, shared: DataFrame, steady: DataFrame) -> DataFrame:
    """The levels of distinct pairs; ``shared`` and ``steady`` hold the pairs with common papers and steady coauthors, each named as text."""
    direct = direct_coauthors(p, counts, contacts).withColumn("direct", F.lit(True))
    has_authors = papers.groupBy("person").agg(F.bool_or(F.size("authors") > 0).alias("known"))
    facts = contacts.join(has_authors, "person", "left").select(
        "person",
        text.normal_name("institution").alias("inst"),
        text.normal_name(text.parent_college("department")).alias("college"),
        (F.coalesce("department", F.lit("")) != "").alias("has_dept"),
        F.coalesce("known", F.lit(False)).alias("known"),
    )

    def side(prefix: str, key: str) -> DataFrame:
        return facts.select(F.col("person").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in ("inst", "college", "has_dept", "known")])

    rows = (
        p.join(side("l", "left_id"), "left_id")
        .join(side("r", "right_id"), "right_id")
        .join(shared, ["left_id", "right_id"], "left")
        .join(direct, ["left_id", "right_id"], "left")
        .join(steady, ["left_id", "right_id"], "left")
    )
    same = (
        (F.col("l_inst") != "")
        & (F.col("l_inst") == F.col("r_inst"))
        & (F.col("l_college") != "")
        & (F.col("l_college") == F.col("r_college"))
    )
    has_shared, has_steady = F.col("shared").isNotNull(), F.col("steady").isNotNull()
    together = F.coalesce("direct", F.lit(False))
    high = together | has_shared | (same & has_steady)
    level = (
        F.when(high, "HIGH")
        .when(same | has_steady, "CAUTION")
        .when((F.col("l_known") | F.col("r_known")) & F.col("l_has_dept") & F.col("r_has_dept"), "LOW")
        .otherwise("UNKNOWN")
    )
    said = F.concat_ws(
        "；",
        F.concat(F.lit(vocab.SHARED_EVIDENCE), "shared"),
        F.when(together, F.lit(vocab.DIRECT_EVIDENCE)),
        F.concat(F.lit(vocab.STEADY_EVIDENCE), "steady"),
    )
    quiet = ~high & (same | ~has_steady)
    why = vocab.PAIR_REASONS
    reason = (
        F.when(high, why["high"])
        .when(same, why["college"])
        .when(has_steady, why["steady"])
        .when(F.col("level") == "LOW", why["low"])
        .otherwise(why["unknown"])
    )
    return rows.withColumn("level", level).select(
        "left_id", "right_id", "level", reason.alias("reason"), F.when(quiet, F.lit("")).otherwise(said).alias("evidence")
    )


def group_assessment(selections: DataFrame, contacts: DataFrame, papers: DataFrame, named_colleges: int | None = None) -> DataFrame:
    """(group_id, n_members, level, n_high, repeated_colleges, reason) of each selection.

    The reason names all repeated colleges, or the first ``named_colleges``.
    """
    pairs = settle(selected_pairs(selections, contacts), "group-pairs")
    # only levels are asked for: what is shared has to be found, but is neither looked up nor listed
    counts = settle(coauthor_counts(papers, contacts), "coauthors")
    p = settle(_distinct_pairs(pairs), "selected-pairs")
    met = {"shared": _common_keys(p, paper_keys(papers)), "steady": stable_overlap(p, counts)}
    flags = {out: rows.select("left_id", "right_id").distinct().withColumn(out, F.lit("")) for out, rows in met.items()}
    judged = _judged(p, contacts, papers, counts, **flags)
    per_pair = pairs.join(judged, ["left_id", "right_id"], "left")
    sums = per_pair.groupBy("group_id").agg(
        F.max("n_members").alias("n_members"),
        F.count_if(F.col("level") == "HIGH").alias("n_high"),
        F.bool_or(F.col("level") == "CAUTION").alias("caution"),
        F.bool_and(F.col("level") == "LOW").alias("low"),
    )
    colleges = (
        selections.select("group_id", F.explode("members").alias("person"))
        .join(contacts.select("person", text.parent_college("department").alias("college")), "person")
        .where(F.col("college") != "")
        .groupBy("group_id", "college")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= 2)
        .groupBy("group_id")
        .agg(F.array_sort(F.collect_list("college")).alias("repeated"))
    )
    rows = sums.join(colleges, "group_id", "left")
    level = (
        F.when(F.col("n_members") < 2, "UNKNOWN")
        .when(F.col("n_high") > 0, "HIGH")
        .when(F.col("repeated").isNotNull() | F.coalesce("caution", F.lit(False)), "CAUTION")
        .when(F.coalesce("low", F.lit(False)), "LOW")
        .otherwise("UNKNOWN")
    )
    why, members = vocab.GROUP_REASONS, F.col("n_members").cast("string")
    shown = F.col("repeated") if named_colleges is None else F.slice("repeated", 1, named_colleges)
    colleges_said = F.coalesce(F.array_join(shown, "、"), F.lit(why["college"]))

    def filled(key: str, *values: Column) -> Column:
        pieces = [F.lit(p) for p in why[key]]
        return F.concat(pieces[0], *[x for pair in zip(values, pieces[1:]) for x in pair])

    reason = (
        F.when(F.col("n_members") < 2, why["few"])
        .when(F.col("level") == "HIGH", filled("high", members, F.col("n_high").cast("string")))
        .when(F.col("level") == "CAUTION", filled("caution", members, colleges_said))
        .when(F.col("level") == "LOW", filled("low", members))
        .otherwise(filled("unknown", members))
    )
    rows = rows.withColumn("level", level)
    return rows.select(
        "group_id",
        "n_members",
        "level",
        "n_high",
        F.coalesce(F.array_join("repeated", "、"), F.lit("")).alias("repeated_colleges"),
        reason.alias("reason"),
    )
