"""Direction search: which advisors fit a list of research terms, and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmatch.functions import text, vocab
from scholarmatch.functions.scale import dealt
from scholarmatch.operators.dictionary import contains_pairs

KEY = ("university", "department", "name")


def searched_values(field: str) -> Column:
    """The texts of one catalog field as an array."""
    c = F.col(field)
    if field in ("department", "profile_text"):
        c = F.array(c)
    return F.transform(
        F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: v.isNotNull()), F.lower
    )


def _folded(catalog: DataFrame) -> DataFrame:
    """The catalog with its searched texts folded once per row, not once per query and term.

    Dealt out first: a small file is scanned by one task, which would fold, match and score all rows.
    """
    return dealt(catalog, *KEY).withColumns({f"_v_{f}": searched_values(f) for f in vocab.FIELD_WEIGHTS})


def prepare_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query) free text -> (query_id, terms): safe terms, one per lower-case form."""
    terms = queries.select("query_id", F.posexplode(text.safe_terms(text.split_terms("query"))).alias("pos", "term"))
    once = terms.groupBy("query_id", F.lower("term").alias("needle")).agg(
        F.max_by("term", "pos").alias("term"), F.min("pos").alias("pos")
    )
    packed = F.array_sort(F.collect_list(F.struct("pos", "needle", "term")))
    return once.groupBy("query_id").agg(packed.alias("terms"))


def _matched(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """Catalog rows next to each query with at least one term somewhere in their texts, each pair once."""
    texts = F.flatten(F.array(*[F.col(f"_v_{f}") for f in vocab.FIELD_WEIGHTS]))
    shaped = _folded(catalog).withColumn("_hay", F.array_join(texts, "\n")).withColumn("_vid", F.xxhash64("_hay"))
    asked = queries.select("query_id", F.explode("terms.needle").alias("_term"))
    found = contains_pairs(shaped.select("_vid", F.col("_hay").alias("_text")), asked.select("_term"))
    pairs = found.join(asked, "_term").select("_vid", "query_id").distinct()
    held = F.exists("terms", lambda t: (t["needle"] != "") & F.col("_hay").contains(t["needle"]))
    return shaped.join(pairs, "_vid").join(queries, "query_id").where(held).drop("_vid")


def term_filter(catalog: DataFrame, queries: DataFrame, universities: Sequence[str] | None = None) -> DataFrame:
    """(query_id, key): advisors with any term in any of the five text fields, no cap."""
    if universities:
        catalog = catalog.where(F.col("university").isin([u.strip() for u in universities if u.strip()]))
    return _matched(catalog, queries).select("query_id", *KEY)


def _hit(field: str, needle: Column) -> Column:
    return F.exists(f"_v_{field}", lambda v: v.contains(needle))


def score_terms() -> Column:
    """The weights of all fields of a folded row that each term of its query is found in."""
    return F.aggregate(
        "terms",
        F.lit(0),
        lambda acc, t: acc
        + sum(
            (F.when(_hit(f, t["needle"]), F.lit(w)).otherwise(F.lit(0)) for f, w in vocab.FIELD_WEIGHTS.items()),
            start=F.lit(0),
        ),
    )


def _reason_array() -> Column:
    """Every (term, field) hit with its weight, in display order."""
    def of_term(t: Column) -> Column:
        return F.array(
            *[
                F.when(
                    _hit(f, t["needle"]),
                    F.struct(
                        F.lit(i).alias("field_pos"),
                        F.array_position(
                            F.transform(f"_v_{f}", lambda v: v.contains(t["needle"])), F.lit(True)
                        ).alias("value_pos"),
                        t["pos"].alias("term_pos"),
                        t["term"].alias("term"),
                        F.lit(f).alias("field"),
                        F.lit(w).alias("weight"),
                    ),
                )
                for i, (f, w) in enumerate(vocab.FIELD_WEIGHTS.items())
            ]
        )

    return F.array_sort(F.array_compact(F.flatten(F.transform("terms", of_term))))


def match_reasons(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, term, field, weight), each term once per field."""
    return (
        _matched(catalog, queries)
        .select("query_id", *KEY, F.explode(_reason_array()).alias("r"))
        .select("query_id", *KEY, "r.term", "r.field", "r.weight")
    )


def completeness(catalog: DataFrame) -> Column:
    parts = []
    for f in vocab.COMPLETENESS_FIELDS:
        empty = text.is_empty(f, catalog.schema[f].dataType)
        parts.append(F.when(empty, 0.0).otherwise(1.0))
    return sum(parts[1:], start=parts[0]) / F.lit(float(len(parts)))


def missing_fields(catalog: DataFrame) -> Column:
    """Names of the fields an advisor row still lacks; either person id counts as the id."""
    def gap(name: str) -> Column:
        return F.when(text.is_empty(name, catalog.schema[name].dataType), F.lit(name))

    ids = F.when(text.blank("orcid") & text.blank("openalex_id"), F.lit("orcid"))
    return F.array_compact(
        F.array(gap("title"), gap("email"), gap("research_directions"), gap("homepage_url"), ids)
    )


def _top(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(
        F.desc("match_score"), F.desc("similarity"), F.desc("completeness"), "university", "name", "department"
    )
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rank_candidates(
    catalog: DataFrame,
    queries: DataFrame,
    k: int = 20,
    min_score: int = 2,
    universities: Sequence[str] | None = None,
) -> DataFrame:
    """Top ``k`` advisors per query by keyword score, then completeness, school and name."""
    if universities:
        catalog = catalog.where(F.col("university").isin(list(universities)))
    scored = (
        _matched(catalog, queries)
        .select("query_id", *KEY, score_terms().alias("match_score"), completeness(catalog).alias("completeness"))
        .where(F.col("match_score") >= min_score)
        .withColumn("similarity", F.lit(0.0))
    )
    return _top(scored, k).select("query_id", "rank", *KEY, "match_score", "completeness")


def advisor_text(papers: int | None = None) -> Column:
    """The text an advisor is compared by: directions, areas, department, papers (all, or the first ``papers``)."""
    published = F.coalesce("publications", F.array().cast("array<string>"))
    parts = F.concat(
        F.coalesce("research_directions", F.array().cast("array<string>")),
        F.coalesce("research_areas", F.array().cast("array<string>")),
        F.array(F.coalesce("department", F.lit(""))),
        published if papers is None else F.slice(published, 1, papers),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), "；")


def lexical_features(df: DataFrame, keys: Sequence[str], value) -> DataFrame:
    """(keys, feature, weight): term frequencies scaled to unit length, computed inside the row."""
    counted = df.select(*keys, text.features(value).alias("_f")).select(
        *keys,
        F.transform(
            F.array_distinct("_f"),
            lambda f: F.struct(
                f.alias("feature"),
                (F.size("_f") - F.size(F.array_remove(F.col("_f"), f))).cast("double").alias("tf"),
            ),
        ).alias("_v"),
    )
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x["tf"] * x["tf"]))
    return (
        counted.withColumn("_n", norm)
        .select(*keys, "_n", F.explode_outer("_v").alias("x"))  # an inner one is filtered by its array first, which is made twice then
        .where("x IS NOT NULL")
        .select(*keys, F.col("x.feature").alias("feature"), (F.col("x.tf") / F.col("_n")).alias("weight"))
    )


def lexical_similarity(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, similarity) for every advisor that shares a feature with the query."""
    asked = lexical_features(
        queries.select("query_id", F.array_join("terms.term", " ").alias("_q")), ["query_id"], "_q"
    ).withColumnRenamed("weight", "_wq")
    told = lexical_features(dealt(catalog, *KEY).select(*KEY, advisor_text().alias("_d")), list(KEY), "_d")
    shared = told.join(asked, "feature")
    return shared.groupBy("query_id", *KEY).agg(
        F.sum(F.col("weight") * F.col("_wq")).alias("similarity")
    )


def hybrid_rank(
    catalog: DataFrame,
    queries: DataFrame,
    similarity: DataFrame,
    k: int = 20,
    min_score: int = 2,
    reason_at: float = vocab.LEXICAL_REASON,
    recall_at: float = vocab.LEXICAL_RECALL,
    kind: str = "surface",
) -> DataFrame:
    """Keyword rank first; a near vector adds a reason and may bring in advisors without a keyword."""
    keyword = _matched(catalog, queries).select("query_id", *KEY, score_terms().alias("match_score"))
    filled = catalog.select(*KEY, completeness(catalog).alias("completeness"))
    both = keyword.join(similarity, ["query_id", *KEY], "full_outer").select(
        "query_id",
        *KEY,
        F.coalesce("match_score", F.lit(0)).alias("match_score"),
        F.coalesce("similarity", F.lit(0.0)).alias("_sim"),
    )
    hit = F.col("match_score") >= min_score
    near = (F.col("_sim") >= recall_at) | (hit & (F.col("_sim") >= reason_at))
    kept = (
        both.withColumn("vector_reason", F.when(near, F.lit(kind)).otherwise(F.lit("")))
        .where(hit | near)
        .withColumn("similarity", F.round("_sim", 4))
        .join(filled, list(KEY))
    )
    return _top(kept, k).select(
        "query_id", "rank", *KEY, "match_score", "similarity", "completeness", "vector_reason"
    )


def compare_table(catalog: DataFrame, queries: DataFrame, k: int = 20, min_score: int = 2) -> DataFrame:
    """The ranked advisors as flat display rows with the reasons spelled out."""
    ranked = rank_candidates(catalog, queries, k, min_score)
    texts = _folded(catalog)
    same = [texts[c].eqNullSafe(ranked[c]) for c in KEY]
    top = texts.join(ranked, same).drop(*[ranked[c] for c in KEY])
    rows = top.join(queries, "query_id").withColumn("_r", _reason_array())

    def label_block(i: int, field: str) -> Column:
        mine = F.filter("_r", lambda r: r["field_pos"] == i)
        said = F.array_join(F.array_distinct(F.transform(mine, lambda r: r["term"])), "、")
        return F.when(F.size(mine) > 0, F.concat(F.lit(vocab.FIELD_LABELS[field] + vocab.REASON_VERB), said))

    reason = F.array_join(
        F.array_compact(F.array(*[label_block(i, f) for i, f in enumerate(vocab.FIELD_WEIGHTS)])), "；"
    )

    def or_else(c: Column, fallback: str) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit(fallback)).otherwise(c)

    none = vocab.NOT_STATED
    return rows.select(
        "query_id",
        "rank",
        *KEY,
        or_else(F.col("title"), none["title"]).alias("title"),
        or_else(F.array_join("research_directions", "、"), none["collected"]).alias("directions"),
        or_else(reason, none["reason"]).alias("reason"),
        F.concat(F.round(F.col("completeness") * 100).cast("int"), F.lit("%")).alias("completeness_text"),
        or_else(F.col("homepage_url"), none["collected"]).alias("homepage"),
        or_else(F.col("email"), none["collected"]).alias("email"),
        or_else(F.array_join("sources", "、"), none["sources"]).alias("sources"),
    )


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = vocab.LEXICAL_RECALL) -> DataFrame:
    """(left_phrase, right_phrase, cosine) of all distinct phrases at least ``threshold`` alike.

    Two unit vectors that reach the threshold share a feature among the rarest ones that carry all
    but ``threshold`` of either length; only those prefixes are joined, then the cosine is computed
    exactly. Common features therefore never pair whole groups with each other.
    """
    def phrases(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("phrase").alias(f"{side}_phrase")).where(~text.blank("phrase")).distinct()

    parts = {}
    for side, df in (("left", left), ("right", right)):
        p = phrases(df, side)
        parts[side] = lexical_features(p, [f"{side}_phrase"], f"{side}_phrase")
    freq = (
        parts["left"].select("feature").unionByName(parts["right"].select("feature")).groupBy("feature").count()
    )

    vectors, prefixes = {}, {}
    for side, feats in parts.items():
        vec = (
            feats.join(freq, "feature")
            .groupBy(f"{side}_phrase")
            .agg(F.array_sort(F.collect_list(F.struct("count", "feature", "weight"))).alias(f"{side}_vec"))
        )
        n = F.size(f"{side}_vec")
        tail = F.aggregate(
            F.slice(F.col(f"{side}_vec"), F.col("_i") + 1, n), F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]
        )
        vectors[side] = vec
        prefixes[side] = (
            vec.select(f"{side}_phrase", f"{side}_vec", F.posexplode(f"{side}_vec").alias("_i", "_x"))
            .where(tail >= F.lit(threshold * threshold - 1e-9))
            .select(f"{side}_phrase", f"{side}_vec", F.col("_x.feature").alias("feature"))
        )
    weights = F.map_from_entries(
        F.transform("right_vec", lambda x: F.struct(x["feature"].alias("k"), x["weight"].alias("v")))
    )
    pairs = prefixes["left"].join(prefixes["right"], "feature")
    scored = pairs.select(
        "left_phrase",
        "right_phrase",
        F.aggregate(
            "left_vec",
            F.lit(0.0),
            lambda a, x: a + x["weight"] * F.coalesce(F.try_element_at(weights, x["feature"]), F.lit(0.0)),
        ).alias("cosine"),
    )
    return (
        scored.where(F.col("cosine") >= threshold - 1e-12)
        .groupBy("left_phrase", "right_phrase")
        .agg(F.max("cosine").alias("cosine"))
    )


def exemplar_vectors(vectors: DataFrame) -> DataFrame:
    """One query vector per label: the one with the lowest id."""
    return vectors.groupBy("label").agg(
        F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("query_vec")
    )


def dense_cosine(a, b) -> Column:
    """Cosine of two dense arrays; 0 where a side is empty or the lengths differ."""
    ca, cb = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    whole = F.sqrt(dot(ca, ca)) * F.sqrt(dot(cb, cb))
    usable = (F.size(ca) == F.size(cb)) & (F.size(ca) > 0) & (whole > 0)
    return F.when(usable, dot(ca, cb) / whole).otherwise(0.0)


def embedder_separability(cases: DataFrame, margin: float = 0.05) -> DataFrame:
    """(case_id, near, far, margin, ok) for rows holding a query, a related and an unrelated vector."""
    near, far = dense_cosine("query_vec", "related_vec"), dense_cosine("query_vec", "unrelated_vec")
    return cases.select(
        "case_id",
        F.round(near, 4).alias("near"),
        F.round(far, 4).alias("far"),
        F.round(near - far, 4).alias("margin"),
        (near - far > margin).alias("ok"),
    )


def embed_texts(df: DataFrame, id_col: str, text_col: str, embed, batch: int = 32, max_chars: int | None = None) -> DataFrame:
    """Vectors from a caller's ``embed(list[str]) -> list[list[float]]``, in fixed-size requests.

    Whole texts are sent unless the caller's model takes ``max_chars`` at most.

    A request that returns another number of vectors than texts fails the task.
    """
    import pandas as pd

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                out = embed([str(t or "")[:max_chars] for t in part[text_col]])
                if len(out) != len(part):
                    raise ValueError(f"asked for {len(part)} vectors, got {len(out)}")
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": [list(map(float, v)) for v in out]})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 512) -> DataFrame:
    """Fixed-width form of the lexical vector: features counted into hashed buckets, unit length."""
    import hashlib
    import math

    import pandas as pd

    kind = df.schema[id_col].dataType.simpleString()
    shaped = df.select(id_col, text.features(text_col).alias("features"))

    def run(batches):
        for pdf in batches:
            out = []
            for feats in pdf["features"]:
                vec = [0.0] * dim
                for f in feats:
                    digest = hashlib.blake2b(f.encode("utf-8"), digest_size=8).digest()
                    vec[int.from_bytes(digest, "big") % dim] += 1.0
                norm = math.sqrt(sum(v * v for v in vec))
                out.append([v / norm for v in vec] if norm else vec)
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": out})

    return shaped.mapInPandas(run, f"{id_col} {kind}, embedding array<double>")
