"""Whose paper is it: author names, institutions, homonyms and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmatch.functions import text, vocab
from scholarmatch.functions.scale import dealt, keep_first
from scholarmatch.sources.tables import settle

# --- author names ------------------------------------------------------------------------------


def _people(entry: Column) -> Column:
    """Single people of an author entry; 'Zhang, Wei' is one person, a longer list is several."""
    parts = F.filter(F.transform(F.split(entry, vocab.AUTHOR_SEPARATORS), text.strip), lambda p: p != "")
    short = F.forall(
        parts,
        lambda p: F.size(F.filter(F.split(p, vocab.NAME_SEPARATORS), lambda t: t != "")) <= 1,
    )
    return F.when((F.size(parts) == 2) & short, F.array(text.strip(entry))).otherwise(parts)


def _latin_keys_of_target(tokens: Column, joined: Column) -> Column:
    """Every block key under which a matching author must be found.

    Two designated tokens (the two longest) each occur in full or as an initial; a joined name is
    found whole. A long joined name inside a longer one is found by its rarest stretch instead.
    """
    by_length = F.array_sort(
        F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))
    )
    a, b = F.element_at(by_length, 1)["t"], F.try_element_at(by_length, F.lit(2))["t"]

    def forms(t: Column) -> Column:
        return F.array_distinct(F.array(t, F.substring(t, 1, 1)))

    def pair_key(x: Column, y: Column) -> Column:
        return F.concat(F.lit("2:"), F.least(x, y), F.lit(" "), F.greatest(x, y))

    pairs = F.flatten(F.transform(forms(a), lambda x: F.transform(forms(b), lambda y: pair_key(x, y))))
    single = F.transform(forms(a), lambda x: F.concat(F.lit("1:"), x))
    whole = F.array(F.concat(F.lit("n:"), joined))
    return F.array_distinct(F.concat(F.when(F.size(tokens) >= 2, pairs).otherwise(single), whole))


def _grams(joined: Column) -> Column:
    """The eight-character stretches of a joined name that is at least that long."""
    return F.when(
        F.length(joined) >= 8,
        F.transform(F.sequence(F.lit(1), F.length(joined) - 7), lambda i: F.concat(F.lit("g:"), F.substring(joined, i, 8))),
    ).otherwise(F.array().cast("array<string>"))


def _rarest_gram(targets: DataFrame) -> DataFrame:
    """(target_name, key): of a name's stretches the one fewest targets share, so that a usual given name is no block."""
    grams = targets.select("target_name", F.explode(F.array_distinct(_grams(F.col("t_joined")))).alias("key"))
    shared = grams.groupBy("key").agg(F.count("*").alias("n"))
    return grams.join(shared, "key").groupBy("target_name").agg(F.min(F.struct("n", "key")).alias("g")).select(
        "target_name", F.col("g.key").alias("key")
    )


def _latin_keys_of_author(tokens: Column, joined: Column) -> Column:
    indexed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    pairs = F.flatten(
        F.transform(
            indexed,
            lambda x: F.transform(
                F.filter(indexed, lambda y: y["i"] > x["i"]),
                lambda y: F.concat(F.lit("2:"), F.least(x["t"], y["t"]), F.lit(" "), F.greatest(x["t"], y["t"])),
            ),
        )
    )
    single = F.transform(tokens, lambda t: F.concat(F.lit("1:"), t))
    whole = F.array(F.concat(F.lit("n:"), joined))
    return F.array_distinct(F.concat(pairs, single, whole, _grams(joined)))


def _tokens_fit(wanted: Column, given: Column) -> Column:
    """Every wanted token takes the first left-over given token that equals it or is its initial."""
    start = F.struct(F.lit(True).alias("ok"), given.alias("rest"))

    def take(acc: Column, t: Column) -> Column:
        flags = F.transform(acc["rest"], lambda g: (g == t) | ((F.length(g) == 1) & t.startswith(g)))
        at = F.array_position(flags, F.lit(True))
        rest = F.when(
            at > 0,
            F.transform(
                F.filter(
                    F.transform(acc["rest"], lambda g, i: F.struct(g.alias("g"), i.alias("i"))),
                    lambda x: x["i"] + 1 != at,
                ),
                lambda x: x["g"],
            ),
        ).otherwise(acc["rest"])
        return F.struct((acc["ok"] & (at > 0)).alias("ok"), rest.alias("rest"))

    return F.aggregate(wanted, start, take, lambda acc: acc["ok"])


def name_matches(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(entry, target_name) for distinct author entries and distinct target names that fit.

    Both sides meet on block keys, never all against all, and are then checked exactly: Han names
    by an equal run, Latin names token by token inside a single person.
    """
    shaped = names.select("target_name").distinct().withColumn("t_runs", text.cjk_runs("target_name"))
    han_targets = shaped.where(F.size("t_runs") > 0).select("target_name", F.explode("t_runs").alias("run"))
    distinct = entries.select("entry").where(~text.blank("entry")).distinct()
    han_entries = distinct.select("entry", F.explode(F.array_distinct(text.cjk_runs("entry"))).alias("run"))
    han = han_entries.join(han_targets, "run").select("entry", "target_name")

    def folded(df: DataFrame, source: str, prefix: str) -> DataFrame:
        # one trip through the Unicode folding per name
        low = df.withColumn("_low", F.lower(text.fold_accents(source)))
        return low.withColumns(
            {
                f"{prefix}_tokens": text.name_tokens(F.col("_low")),
                f"{prefix}_joined": F.regexp_replace("_low", vocab.NAME_SEPARATORS, ""),
            }
        ).drop("_low")

    latin_targets = folded(shaped.where(F.size("t_runs") == 0).drop("t_runs"), "target_name", "t").where(
        F.size("t_tokens") > 0
    )
    # the same person stands in many entries: people are matched once, then found in their entries
    listed = distinct.select("entry", F.explode(F.array_distinct(_people(F.col("entry")))).alias("person"))
    single = folded(listed.select("person").distinct(), "person", "a")
    left = single.withColumn("key", F.explode(_latin_keys_of_author(F.col("a_tokens"), F.col("a_joined"))))
    keyed = latin_targets.withColumn("key", F.explode(_latin_keys_of_target(F.col("t_tokens"), F.col("t_joined"))))
    inside = latin_targets.join(_rarest_gram(latin_targets), "target_name")
    right = keyed.unionByName(inside)
    fits = (
        F.when(F.col("key").startswith("n:"), F.lit(True))
        .when(F.col("key").startswith("g:"), F.col("a_joined").contains(F.col("t_joined")))
        .otherwise(_tokens_fit(F.col("t_tokens"), F.col("a_tokens")))
    )
    found = left.join(right, "key").where(fits).select("person", "target_name").distinct()
    latin = listed.join(found, "person").select("entry", "target_name")
    return han.unionByName(latin).distinct()


def author_match(works: DataFrame, targets: DataFrame) -> DataFrame:
    """(work_id, target_id) of works with the target among their authors; unsure means no match."""
    listed = works.select("work_id", F.explode(F.array_distinct("authors")).alias("entry"))
    named = targets.select("target_id", F.explode(F.array_compact(F.array("name", "english_name"))).alias("target_name"))
    named = named.where(~text.blank("target_name"))
    matches = name_matches(listed, named)
    return (
        listed.join(matches, "entry").join(named, "target_name").select("work_id", "target_id").distinct()
    )


# --- institutions ------------------------------------------------------------------------------
def _aliases() -> Column:
    return F.array(
        *[
            F.struct(F.lit(han).alias("han"), F.lit(alias).alias("alias"))
            for han, aliases in vocab.UNIVERSITY_ALIASES.items()
            for alias in aliases
        ]
    )


def institution_hit(candidate: Column, target: Column) -> Column:
    """True when the candidate text holds the target school or one of its foreign names."""
    hay = F.lower(F.coalesce(candidate, F.lit("")))
    want = text.strip(F.coalesce(target, F.lit("")))
    by_alias = F.exists(
        _aliases(), lambda a: (F.length(a["alias"]) >= 4) & want.contains(a["han"]) & hay.contains(a["alias"])
    )
    direct = hay.contains(F.lower(want))
    return (hay != "") & (want != "") & (direct | (text.has_cjk(want) & by_alias))


def institution_conflict(paper: Column, target: Column) -> Column:
    """True only when both are given, comparable by script, not aliases, and neither holds the other."""
    a = text.strip(F.coalesce(paper, F.lit("")))
    b = text.strip(F.coalesce(target, F.lit("")))
    han_a, han_b = text.has_cjk(a), text.has_cjk(b)
    alias = F.exists(
        _aliases(),
        lambda x: (a.contains(x["han"]) & F.lower(b).contains(x["alias"]))
        | (b.contains(x["han"]) & F.lower(a).contains(x["alias"])),
    )
    # the cheapest test that settles most papers comes first
    return (
        F.when((a == "") | (b == "") | text.contains_either(a, b), False)
        .when(han_a != han_b, False)
        .when(han_a & alias, False)
        .otherwise(True)
    )


def institutions_agree(left: Column, right: Column) -> Column:
    """True, False, or null when a side is blank; generic words are ignored in a second look."""
    a = text.strip(F.coalesce(left, F.lit("")))
    b = text.strip(F.coalesce(right, F.lit("")))
    words = "|".join(vocab.INSTITUTION_WORDS)
    core_a, core_b = F.regexp_replace(a, words, ""), F.regexp_replace(b, words, "")
    return F.when((a != "") & (b != ""),
        text.contains_either(a, b) | ((core_a != "") & (core_b != "") & text.contains_either(core_a, core_b)),
    )


def _with_target(candidates: DataFrame, targets: DataFrame, *cols: str) -> DataFrame:
    wanted = [F.col(c).alias(f"target_{c}") for c in cols]
    return candidates.join(targets.select("target_id", *wanted), "target_id")


def institution_match(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, work_id, hit, conflict, agree) for the papers of each target."""
    pairs = _with_target(candidates, targets, "institution")
    paper, school = F.col("institution"), F.col("target_institution")
    return pairs.select(
        "target_id",
        "work_id",
        institution_hit(paper, school).alias("hit"),
        institution_conflict(paper, school).alias("conflict"),
        institutions_agree(paper, school).alias("agree"),
    )


def institution_filter(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Papers without an institution or with one that holds, or is held by, the target's."""
    pairs = _with_target(candidates, targets, "institution")
    inst = text.strip(F.coalesce("institution", F.lit("")))
    return pairs.where((inst == "") | text.contains_either(inst, F.col("target_institution"))).select(*candidates.columns)


def institution_counts(candidates: DataFrame) -> DataFrame:
    """(target_id, institution, n) of the institutions on a target's papers, most frequent first."""
    inst = text.strip(F.coalesce("institution", F.lit("")))
    return (
        candidates.select("target_id", inst.alias("institution"))
        .where(F.col("institution") != "")
        .groupBy("target_id", "institution")
        .agg(F.count("*").alias("n"))
        .orderBy("target_id", F.desc("n"), "institution")
    )


def pick_author(entities: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, author_id, tier): the author record that most likely is the target.

    ``entities`` are search hits (target_id, seq, id, name, works_count, institutions). With a school
    given: name and school fit (1), school alone (2), else nobody; without one: name (3), else any (4).
    """
    # A shuffle of short keys is put together to few partitions; their rows, wide by now, would be sorted in one task each.
    once = keep_first(dealt(entities, "target_id", "id", "seq"), ["target_id", "id"], "seq")
    named = targets.select("target_id", F.explode(F.array_compact(F.array("name", "english_name"))).alias("target_name"))
    matches = name_matches(once.select(F.col("name").alias("entry")), named)
    fits = (
        once.select("target_id", "id", F.col("name").alias("entry"))
        .join(named, "target_id")
        .join(matches, ["entry", "target_name"], "left_semi")
        .select("target_id", "id")
        .distinct()
        .withColumn("name_fits", F.lit(True))
    )
    rows = _with_target(once, targets, "institution").join(fits, ["target_id", "id"], "left")
    school = F.col("target_institution")
    here = F.exists("institutions", lambda i: institution_hit(i, school))
    by_name = F.coalesce("name_fits", F.lit(False))
    tier = F.when(text.blank(school), F.when(by_name, 3).otherwise(4)).otherwise(
        F.when(here & by_name, 1).when(here, 2)
    )
    ranked = rows.withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = ranked.groupBy("target_id").agg(
        F.max(F.struct((-F.col("tier")).alias("t"), "works_count", (-F.col("seq")).alias("s"), "id")).alias("b")
    )
    return best.select("target_id", F.col("b.id").alias("author_id"), (-F.col("b.t")).alias("tier"))


def pick_first_author(entities: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, author_id): the first search hit whose institution holds, or is held by, the target's; any hit without a school."""
    rows = _with_target(entities, targets, "institution")
    school = F.lower(F.coalesce("target_institution", F.lit("")))
    own = F.lower(F.coalesce(F.try_element_at("institutions", F.lit(1)), F.lit("")))
    fits = (school == "") | text.contains_either(own, school)
    return rows.where(fits).groupBy("target_id").agg(F.min_by("id", "seq").alias("author_id"))


# --- homonyms ----------------------------------------------------------------------------------
def rule_disambiguate(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Papers from another institution are marked for review, never excluded."""
    pairs = _with_target(candidates, targets, "institution")
    clash = institution_conflict(F.col("institution"), F.col("target_institution"))
    before, after = vocab.OTHER_SCHOOL_REASON
    return pairs.withColumns(
        {
            "belongs": F.col("belongs") | clash,
            "needs_review": F.col("needs_review") | clash,
            "disambig_reason": F.when(clash, F.concat(F.lit(before), "institution", F.lit(after))).otherwise(
                F.col("disambig_reason")
            ),
        }
    ).select(*candidates.columns)


def fingerprint_prefilter(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Where a target has steady coauthors, conflicting papers without any of them are someone else's.

    Only belonging papers in conflict can change, so only they and the rows of their (target, work) are shuffled for
    the coauthor check; all other rows pass through as they are.
    """
    pairs = _in_conflict(candidates, targets)
    pairs = pairs.withColumn("_asked", F.coalesce(F.col("belongs") & F.col("_clash"), F.lit(False)))
    # a work's rows may differ in authors and institution: any of them may back it
    rivals = pairs.join(pairs.where("_asked").select(*_WORK).distinct(), _WORK, "left_semi")
    return _coauthor_check(pairs, rivals, candidates.columns)


_WORK = ["target_id", "work_id"]


def _in_conflict(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with their target's name and whether the institutions are in conflict."""
    pairs = _with_target(candidates, targets, "name", "institution")
    clash = institution_conflict(F.col("institution"), F.col("target_institution"))
    return pairs.select(*candidates.columns, text.strip("target_name").alias("_own"), clash.alias("_clash"))


def _coauthor_check(pairs: DataFrame, rivals: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of all ``pairs``; those ``_asked`` about are someone else's if no row of ``rivals`` backs their work."""
    asked = pairs.where("_asked")

    def others(rows: DataFrame) -> DataFrame:
        listed = rows.select(*_WORK, "_own", F.explode("authors").alias("a")).withColumn("a", text.strip("a"))
        return listed.where((F.col("a") != "") & (F.col("a") != F.col("_own"))).select(*_WORK, "a")

    steady = (
        others(pairs).groupBy("target_id", "a").agg(F.count("*").alias("n")).where(F.col("n") >= 2).select("target_id", "a")
    )
    backed = others(rivals).join(steady, ["target_id", "a"], "left_semi").select(*_WORK).distinct()
    teams = steady.select("target_id").distinct()
    judged = asked.join(backed.withColumn("_backed", F.lit(True)), _WORK, "left").join(teams.withColumn("_team", F.lit(True)), "target_id", "left")
    out = F.coalesce("_team", F.lit(False)) & ~F.coalesce("_backed", F.lit(False))
    decided = judged.select(
        *[
            F.when(out, F.lit(False)).otherwise(F.col(c)).alias(c)
            if c in ("belongs", "needs_review")
            else F.when(out, F.lit(vocab.HOMONYM_REASON)).otherwise(F.col(c)).alias(c)
            if c == "disambig_reason"
            else F.col(c)
            for c in columns
        ]
    )
    return pairs.where(~F.col("_asked")).select(*columns).unionByName(decided)


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame, targets: DataFrame, fingerprint: bool = True) -> DataFrame:
    """Outside verdicts replace the rule columns where there are any; then the coauthor check.

    The rows are joined once, with their target and then with the verdicts, and written with whether they and whether
    any row of their work are asked about: the steps of the check read only what they need, and what was shuffled
    for the joins is gone by then.
    """
    v = verdicts.select(
        "target_id",
        "work_id",
        F.col("belongs").alias("_b"),
        F.col("needs_review").alias("_n"),
        F.col("reason").alias("_r"),
    )
    rows = _in_conflict(candidates, targets) if fingerprint else candidates
    merged = rows.join(v, _WORK, "left").withColumns(
        {
            "belongs": F.coalesce("_b", "belongs"),
            "needs_review": F.coalesce("_n", "needs_review"),
            "disambig_reason": F.coalesce("_r", "disambig_reason"),
        }
    )
    if not fingerprint:
        return merged.select(*candidates.columns)
    asked = F.coalesce(F.col("belongs") & F.col("_clash"), F.lit(False))
    flagged = merged.withColumn("_asked", asked).withColumn("_rival", F.max("_asked").over(Window.partitionBy(*_WORK)))
    pairs = settle(flagged.select(*candidates.columns, "_own", "_asked", "_rival"), "judged-papers")
    return _coauthor_check(pairs, pairs.where("_rival"), candidates.columns)


def affiliation_expansion(candidates: DataFrame, targets: DataFrame, index: DataFrame, top: int | None = None) -> DataFrame:
    """Adds the target's papers at the other institutions under review, the ``top`` most frequent if given.

    ``index``: target_id (whose author search it answers), seq, title, institution.
    """
    inst = text.strip(F.coalesce("institution", F.lit("")))
    pairs = _with_target(candidates, targets, "institution").where("needs_review").withColumn("_inst", inst)
    other = pairs.where(
        (F.col("_inst") != "") & (F.col("_inst") != text.strip(F.coalesce("target_institution", F.lit(""))))
    )
    counted = other.groupBy("target_id", "_inst").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    order = Window.partitionBy("target_id").orderBy(F.desc("n"), "s", "_inst")
    asked = counted.withColumn("rank", F.row_number().over(order)).where(F.lit(True) if top is None else F.col("rank") <= top)
    extra = index.join(
        asked.select("target_id", F.col("_inst").alias("institution"), "rank"), ["target_id", "institution"]
    ).select(
        "target_id",
        "title",
        F.concat(F.lit(vocab.FORMER_UNIT_NOTE), "institution").alias("affiliation_note"),
        F.struct(F.col("rank").cast("long").alias("a"), F.col("seq").cast("long").alias("b")).alias("_o"),
    )
    own = candidates.select(
        "target_id",
        "title",
        F.lit("").alias("affiliation_note"),
        F.struct(F.lit(0).cast("long").alias("a"), F.col("seq").cast("long").alias("b")).alias("_o"),
    )
    rows = own.unionByName(extra).where(F.coalesce("title", F.lit("")) != "")
    return keep_first(rows, ["target_id", "title"], "_o").drop("_o")


def affiliation_check(candidates: DataFrame, targets: DataFrame, shown: int | None = None) -> DataFrame:
    """Per target: papers that agree, clash or cannot be judged, clashing titles (the first ``shown`` if given), and a verdict."""
    pairs = _with_target(candidates, targets, "institution").withColumn(
        "agree", institutions_agree(F.col("institution"), F.col("target_institution"))
    )
    sums = pairs.groupBy("target_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("agree")).alias("match"),
        F.count_if(~F.col("agree")).alias("conflict"),
        F.count_if(F.col("agree").isNull()).alias("unknown"),
    )
    order = Window.partitionBy("target_id").orderBy("seq")
    clashing = (
        pairs.where(~F.col("agree") & (F.coalesce("title", F.lit("")) != ""))
        .select("target_id", "seq", "title")
        .withColumn("n", F.row_number().over(order))
        .where(F.lit(True) if shown is None else F.col("n") <= shown)
        .groupBy("target_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]), "|").alias("conflicting_titles"))
    )
    many = (F.col("conflict") > 0) & (F.col("conflict") >= F.greatest(F.lit(1), F.floor(F.col("total") / 3)))
    said = vocab.AFFILIATION_VERDICTS
    verdict = (
        F.when(many, said[0]).when(F.col("conflict") > 0, said[1]).when(F.col("match") > 0, said[2]).otherwise(said[3])
    )
    return sums.join(clashing, "target_id", "left").withColumns(
        {"conflicting_titles": F.coalesce("conflicting_titles", F.lit("")), "verdict": verdict}
    )


def assess_identity(targets: DataFrame, page_fields: DataFrame, papers: DataFrame) -> DataFrame:
    """(target_id, status, score, signals): six clues, each true, false or not available.

    ``targets``: institution, department, email, known_directions, scholar_ids; ``page_fields``:
    page_institution, page_department, page_email; ``papers``: target_id, institution, topics.
    """
    anchors = targets.select("target_id", F.col("institution").alias("_school"), F.col("known_directions").alias("_dirs"))
    inst = text.strip(F.coalesce("institution", F.lit("")))
    topic_fits = F.exists(
        F.coalesce("topics", F.array().cast("array<string>")),
        lambda t: (t != "") & F.exists(F.filter("_dirs", lambda d: d != ""), lambda d: text.contains_either(t, d)),
    )
    clues = papers.join(anchors, "target_id").groupBy("target_id").agg(
        F.bool_or(F.when(inst != "", F.coalesce(institutions_agree(inst, F.col("_school")), F.lit(False)))).alias("_paper_fits"),
        F.bool_or(F.when(F.exists("topics", lambda t: ~text.blank(t)), topic_fits)).alias("_topic_fits"),
    )
    t = targets.join(page_fields, "target_id", "left").join(clues, "target_id", "left")

    def clean(c: str) -> Column:
        return text.strip(F.coalesce(F.col(c), F.lit("")))

    email = F.when(clean("email") != "", clean("email")).otherwise(clean("page_email"))
    dept, page_dept = clean("department"), clean("page_department")
    has_dirs = F.exists(F.coalesce("known_directions", F.array().cast("array<string>")), lambda d: ~text.blank(d))
    ids = F.exists(F.map_values(F.coalesce("scholar_ids", F.create_map().cast("map<string,string>"))), lambda v: ~text.blank(v))
    signals = {
        "email_domain": F.when(email != "", text.school_email(email)),
        "institution": institutions_agree(clean("page_institution"), clean("institution")),
        "department": F.when((dept != "") & (page_dept != ""), text.contains_either(dept, page_dept)),
        "paper_institution": F.when(clean("institution") != "", F.col("_paper_fits")),
        "topic_continuity": F.when(has_dirs, F.col("_topic_fits")),
        "scholar_id": F.when(ids, F.lit(True)),
    }
    listed = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("matched")) for k, v in signals.items()]),
        lambda s: s["matched"].isNotNull(),
    )
    shaped = t.select("target_id", listed.alias("s"))
    support = F.size(F.filter("s", lambda x: x["matched"]))
    against = F.size(F.filter("s", lambda x: ~x["matched"]))
    status = (
        F.when((against > 0) & (support == 0), "REJECTED")
        .when(against > 0, "REVIEW_REQUIRED")
        .when(support >= 2, "CONFIRMED")
        .otherwise("REVIEW_REQUIRED")
    )
    return shaped.select(
        "target_id",
        status.alias("status"),
        (support - against).alias("score"),
        F.array_join(
            F.transform("s", lambda x: F.concat(x["key"], F.when(x["matched"], F.lit("+")).otherwise("-"))), ";"
        ).alias("signals"),
    )
