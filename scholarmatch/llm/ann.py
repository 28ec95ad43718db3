"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Equal vectors are one entry that keeps its ``k + 1`` smallest ids (no answer can need more). Entries get one more
coordinate that makes all norms equal, so that the largest inner product is the smallest distance. Centroids are
fitted on a bounded sample and halved until the lists are balanced. Every entry goes to its nearest list and, near a
boundary, to further ones: those within ``REPLICA_RATIO`` of the nearest distance, unless a list already chosen lies
nearer to that centroid than the entry does. A query walks an in-memory neighbour graph of the centroids, best first,
and takes every list whose distance is within a ratio of the nearest; that ratio is calibrated on the sample for
``TARGET`` recall, and nothing else limits the number of lists. Neighbouring lists share a bin, so that a query's
best of all its lists in a bin is merged where the lists are; bins and queries meet in one shuffle, and a bin or a
group of queries that is too large for one task is dealt out in parts.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have another length than
most, take no part (a query of that kind has no rows); a null id takes no part; rows repeated with id and vector are
one candidate and one query; ties go to the smaller id; with fewer than ``k`` candidates all are returned.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmatch.sources.tables import settle

#: Entries that a list should hold, and lists at most; the sample has so many entries per list.
LIST_ROWS = 256
MAX_LISTS = 4096
SAMPLE_PER_LIST = 16
#: A list's share of the sample above which it is halved, as a multiple of the mean.
BALANCE = 2.0
#: Boundary entries go to lists up to this multiple of the nearest distance, and to so many in all.
REPLICA_RATIO = 1.02
REPLICAS = 2
#: Neighbours of a centroid in the graph.
DEGREE = 24
#: Recall that the ratio is calibrated for on the sample, and queries used for that.
TARGET = 0.97
CALIBRATE = 256
#: Entries of a bin of lists; entries and queries of one bin that meet in one task.
BIN_ROWS = 8192
PART = 2 * BIN_ROWS


#: Scores or distances held at once: when queries meet a bin, and whenever rows meet all centroids or the sample.
BLOCK = 1 << 20


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _blocks(rows: int, width: int) -> Iterator[slice]:
    """The rows in stretches whose table against ``width`` others has about ``BLOCK`` cells."""
    step = max(1, BLOCK // max(1, width))
    return (slice(start, start + step) for start in range(0, rows, step))


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Each row's nearest center."""
    near = [np.argmin(_distances(rows[part], centers), axis=1) for part in _blocks(len(rows), len(centers))]
    return np.concatenate(near) if near else np.zeros(0, np.int64)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, so that every vector is as long as the longest."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors * vectors).sum(1), 0))
    return np.hstack([vectors, rest[:, None]])


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced starts; lists with more than their share are halved along their widest spread."""
    if len(sample) <= lists:
        return np.unique(sample, axis=0)
    centers = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(rounds):
        near = _nearest(sample, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        held = np.bincount(near, minlength=len(centers))
        centers = sums[held > 0] / held[held > 0, None]
    near = _nearest(sample, centers)
    groups = [sample[near == i] for i in range(len(centers))]
    most, done = BALANCE * len(sample) / lists, []
    while groups:
        g = groups.pop()
        if len(g) <= most or len(g) < 2:
            if len(g):
                done.append(g.mean(0))
            continue
        axis = g - g.mean(0)
        side = axis @ axis[np.argmax((axis * axis).sum(1))]
        order = np.argsort(side, kind="stable")
        groups += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
    return np.unique(np.array(done), axis=0)


class Router:
    """Centroids with their neighbour graph: walks to lists, and places entries."""

    def __init__(self, centers: np.ndarray, longest: float, ratio: float = 1.0):
        self.centers, self.longest, self.ratio = centers, longest, ratio
        near = np.vstack([np.argsort(_distances(centers[part], centers), axis=1, kind="stable")[:, : DEGREE + 1] for part in _blocks(len(centers), len(centers))])
        links: list[set[int]] = [set(map(int, row)) - {i} for i, row in enumerate(near)]
        for i, row in enumerate(links):  # both ways, and a ring so that every list can be reached
            for j in list(row):
                links[j].add(i)
            links[i] |= {(i + 1) % len(links), (i - 1) % len(links)} - {i}
        self.links = [np.array(sorted(x), int) for x in links]
        self.entries = np.unique(np.linspace(0, len(centers) - 1, min(8, len(centers))).astype(int))

    def walk(self, query: np.ndarray) -> list[int]:
        """Lists within the ratio of the nearest distance, found best first over the graph."""
        far = lambda ids: np.sqrt(((self.centers[ids] - query) ** 2).sum(1))
        seen = np.zeros(len(self.centers), bool)
        seen[self.entries] = True
        ahead = [(float(d), int(i)) for d, i in zip(far(self.entries), self.entries)]
        heapq.heapify(ahead)
        best, found, slack = ahead[0][0], [], DEGREE
        while ahead:
            d, i = heapq.heappop(ahead)
            if d > best * self.ratio:
                slack -= 1  # some more steps, in case a nearer list lies behind
                if slack < 0:
                    break
            best = min(best, d)
            found.append((d, i))
            new = self.links[i][~seen[self.links[i]]]
            if len(new):
                seen[new] = True
                for e, j in zip(far(new), new):
                    heapq.heappush(ahead, (float(e), int(j)))
        return [i for d, i in found if d <= best * self.ratio]

    def place(self, entries: np.ndarray) -> list[list[int]]:
        """Each entry's lists: the nearest, and those beyond a boundary that no chosen list already covers."""
        placed = []
        for part in _blocks(len(entries), len(self.centers)):
            far = _distances(entries[part], self.centers)
            near = np.argsort(far, axis=1, kind="stable")[:, : REPLICAS * 4]
            for row, order in zip(far, near):
                chosen = [int(order[0])]
                for j in map(int, order[1:]):
                    if len(chosen) >= REPLICAS or row[j] > REPLICA_RATIO * row[order[0]]:
                        break
                    if all(self.apart(j, c) > row[j] for c in chosen):
                        chosen.append(j)
                placed.append(chosen)
        return placed

    def apart(self, i: int, j: int) -> float:
        """The distance of two centroids."""
        gap = self.centers[i] - self.centers[j]
        return float(np.sqrt(gap @ gap))


def calibrated(centers: np.ndarray, sample: np.ndarray, longest: float, k: int) -> tuple[Router, np.ndarray]:
    """The router with the smallest ratio that finds ``TARGET`` of the sample's own neighbours in the sample, and how
    many of the sample each list holds."""
    router = Router(centers, longest)
    step = max(1, len(sample) // CALIBRATE)
    asked = np.arange(0, len(sample), step)
    placed = router.place(lifted(sample, longest))
    needed = []
    for part in _blocks(len(asked), len(sample)):
        mine = asked[part]
        scores = sample[mine] @ sample.T
        scores[np.arange(len(mine)), mine] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        far = _distances(np.hstack([sample[mine], np.zeros((len(mine), 1))]), centers)
        far /= np.maximum(far.min(axis=1, keepdims=True), 1e-12)
        needed += [min(far[q, c] for c in placed[n]) for q, row in enumerate(best) for n in row]
    needed = np.sort(needed)
    at = min(len(needed) - 1, int(np.ceil(TARGET * len(needed)))) if len(needed) else 0
    router.ratio = float(needed[at]) * (1 + 1e-9) if len(needed) else 1.0
    return router, np.bincount([c for row in placed for c in row], minlength=len(centers))


def bins(centers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bin for each list: lists in the order of the centroids along their widest spread, filled up to ``BIN_ROWS``."""
    middle = centers - centers.mean(0)
    axis = np.linalg.svd(middle, full_matrices=False)[2][0] if len(centers) > 1 else np.ones(centers.shape[1])
    order = np.argsort(middle @ axis, kind="stable")
    out = np.empty(len(centers), np.int32)
    out[order] = np.cumsum(sizes[order]) // BIN_ROWS
    return out


def clean(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>): the rows that take part, all of the most common length."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("size").desc()).first()
    return rows.where(F.size("vec") == (sizes["size"] if sizes else 0))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """rep (smallest id), vec, ids: one row per different vector with its k + 1 smallest ids."""
    order = Window.partitionBy("vec").orderBy("id")
    first = rows.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "vec", "ids")


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _sample(rows: pa.Table) -> np.ndarray:
    """The vectors of (vec, rep), a row each, by rep."""
    order = np.argsort(rows["rep"].to_numpy(), kind="stable")
    flat = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(order), -1)[order] if len(order) else np.zeros((0, 0))


def _meet(k: int):
    def meet(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Each query's best k + 1 ids in its lists of this part of a bin, all ties of entries considered."""
        asked_ids, found_ids, found_scores = [], [], []
        if len(held) and len(queries):
            vectors, asked = _stack(held["vec"]), _stack(queries["vec"])
            ids = [np.asarray(i) for i in held["ids"]]
            names, lists = np.unique(np.concatenate([np.asarray(x) for x in held["lists"]]), return_inverse=True)
            owner = np.repeat(np.arange(len(held)), held["lists"].map(len))
            inside = np.zeros((len(held), len(names)), bool)
            inside[owner, lists] = True
            wants = np.zeros((len(asked), len(names)), np.float32)
            for q, row in enumerate(queries["lists"]):
                row = np.asarray(row)
                wants[q, np.searchsorted(names, row[np.isin(row, names)])] = 1
            step = max(1, BLOCK // len(vectors))
            for start in range(0, len(asked), step):
                block = asked[start : start + step]
                scores = block @ vectors.T
                scores[wants[start : start + step] @ inside.T.astype(np.float32) == 0] = -np.inf
                for q, row, rep in zip(block, scores, queries["q"].iloc[start : start + step]):
                    cut = np.partition(row, -k - 1)[-k - 1] if len(row) > k + 1 else -np.inf
                    kept = np.flatnonzero(row >= cut - 1e-9 * max(1.0, abs(cut)) if np.isfinite(cut) else np.isfinite(row))
                    exact = np.repeat((vectors[kept] * q).sum(axis=1), [len(ids[n]) for n in kept])
                    flat = np.concatenate([ids[n] for n in kept]) if len(kept) else np.zeros(0, np.int64)
                    best = np.lexsort((flat, -exact))[: k + 1]
                    asked_ids.append(np.full(len(best), rep))
                    found_ids.append(flat[best])
                    found_scores.append(exact[best])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pd.DataFrame({"q": join(asked_ids, "int64"), "vec_id": join(found_ids, "int64"), "score": join(found_scores, "float64")})

    return meet


def search(table: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows found for each row with ``asked``."""
    spark = table.sparkSession
    rows = clean(table.withColumn("_asked", asked), id_col, vec_col)
    found = settle(entries(rows, k), "ann-entries")
    facts = found.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(MAX_LISTS, facts["n"] // LIST_ROWS))
    # A share of the entries by the hash of the vector: about SAMPLE_PER_LIST * lists of them, 65,536 at most expected.
    share = min(1.0, max(1024, SAMPLE_PER_LIST * lists) / facts["n"])
    drawn = found.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vec", "rep")
    # as Arrow, 8 bytes a number; a list of Python's numbers has four times as much
    sample = _sample(drawn.toArrow())
    if not len(sample):  # a handful of entries, none of them drawn
        sample = _sample(found.select("vec", "rep").limit(1024).toArrow())
    longest = float(np.sqrt(facts["square"])) * (1 + 1e-12)
    router, held = calibrated(fit_centroids(lifted(sample, longest), lists), sample, longest, k)
    shared = spark.sparkContext.broadcast((router, bins(router.centers, held * (facts["n"] / len(sample)))))

    def by_bin(pdf: pd.DataFrame, chosen: list[list[int]], of: np.ndarray) -> pd.DataFrame:
        """One row for each bin of a row's lists, with its lists there."""
        grouped = [defaultdict(list) for _ in chosen]
        for row, mine in zip(grouped, chosen):
            for c in mine:
                row[int(of[c])].append(c)
        out = pdf.loc[pdf.index.repeat([len(g) for g in grouped])].copy()
        out["bin"] = np.array([b for g in grouped for b in g], np.int32)
        out["lists"] = [x for g in grouped for x in g.values()]
        return out

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, of = shared.value
        for pdf in batches:
            if len(pdf):
                yield by_bin(pdf, mine.place(lifted(_stack(pdf["vec"]), longest)), of)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, of = shared.value
        for pdf in batches:
            if len(pdf):
                yield by_bin(pdf, [mine.walk(v) for v in np.hstack([_stack(pdf["vec"]), np.zeros((len(pdf), 1))])], of)

    question = settle(clean(table.where(asked), id_col, vec_col).select("id", "vec").distinct(), "ann-queries")
    asked_entries = question.groupBy("vec").agg(F.min("id").alias("q"))
    postings = settle(found.select("rep", "vec", "ids").mapInPandas(place, "rep long, vec array<double>, ids array<long>, bin int, lists array<int>"), "ann-postings")
    routed = settle(asked_entries.select("q", "vec").mapInPandas(route, "q long, vec array<double>, bin int, lists array<int>"), "ann-routed")
    # Parts of large bins and of large groups of queries: every pair of parts of a bin meets in a task of its own.
    parts = lambda df, name: df.groupBy("bin").agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    sizes = F.broadcast(parts(postings, "np").join(parts(routed, "nq"), "bin"))  # no more bins than lists
    left = postings.join(sizes, "bin").withColumn("p", F.pmod(F.xxhash64("rep"), F.col("np")).cast("int")).withColumn("g", F.explode(F.expr("sequence(0, nq - 1)")))
    right = routed.join(sizes, "bin").withColumn("g", F.pmod(F.xxhash64("q"), F.col("nq")).cast("int")).withColumn("p", F.explode(F.expr("sequence(0, np - 1)")))
    keys = ["bin", "p", "g"]
    met = left.select(*keys, "vec", "ids", "lists").groupBy(*keys).cogroup(right.select(*keys, "q", "vec", "lists").groupBy(*keys)).applyInPandas(
        _meet(k), "q long, vec_id long, score double"
    )
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    best = met.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    names = question.join(asked_entries.withColumnRenamed("vec", "_vec"), F.col("vec") == F.col("_vec")).select(F.col("id").alias("query_id"), "q")
    own = names.join(best, "q").where(F.col("query_id") != F.col("vec_id"))
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = own.withColumn("rank", F.row_number().over(final).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
