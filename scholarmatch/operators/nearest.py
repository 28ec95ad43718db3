"""Exact nearest vectors above a threshold, without meeting all pairs.

The angle between vectors is a metric, so for every pivot x and all q, v: angle(q, v) >= |angle(q, x) - angle(v, x)|.
Vectors and queries are dealt to cells by their nearest pivot and, within it, by rings of their angle to it. A cell is
known by its box, the least and the largest angle of its members to every pivot. Two cells meet only if no pivot keeps
their boxes further apart than the threshold's angle. What meets is compared exactly, a matrix product per two blocks.

The number of cells follows the number of vectors up to ``PIVOTS`` times ``RINGS``; boxes and cell pairs are therefore
of bounded size and are compared on the driver. A cell with many members (copies of one vector included) is split by a
hash into blocks of about ``BLOCK_ROWS``, so no task holds a whole cell.

Vectors are sent once for every block they meet, so what is shuffled follows the number of blocks. Cells and blocks are
as large as a task can hold, and vectors travel in the width they are given in; products and angles are of doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarmatch.functions import scale
from scholarmatch.sources.tables import settle

#: Pivots and rings at most, members that a cell has on average until then, rows of a block, and vectors that pivots come from.
PIVOTS, RINGS, CELL_ROWS, BLOCK_ROWS, SAMPLE = 64, 16, 16384, 16384, 4096
#: Entries of a block's matrix of vectors and of a slab of its matrix of cosines, at most.
BLOCK_ENTRIES, SLAB_ENTRIES = 2**21, 2**22
#: Angle that rounding may take away.
SLACK = 1e-5


def unit_rows(column, length: int) -> np.ndarray:
    """Rows scaled to length one; zeros for what is null, of another length or not finite."""
    out = np.zeros((len(column), length))
    for i, v in enumerate(column):
        if v is not None and len(v) == length:
            out[i] = np.array(v, dtype="float64")
    out = np.where(np.isfinite(out).all(axis=1, keepdims=True), out, 0.0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


class Cells:
    """Pivots spread over a sample, farthest first, and the borders of the rings around them."""

    def __init__(self, sample: np.ndarray, pivots: int, rings: int):
        chosen, gap = [0], _angles(sample, sample[:1])[:, 0]
        while len(chosen) < min(pivots, len(sample)) and gap.max() > SLACK:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _angles(sample, sample[chosen[-1:]])[:, 0])
        self.pivots = sample[chosen]
        self.borders = np.quantile(gap, np.linspace(0, 1, rings + 1)[1:-1])
        self.length = sample.shape[1]

    def place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its angles to all pivots."""
        angles = _angles(units, self.pivots)
        own = angles.argmin(axis=1)
        ring = np.searchsorted(self.borders, angles[np.arange(len(own)), own])
        return own * (len(self.borders) + 1) + ring, angles


def meetings(asked: dict[int, np.ndarray], told: dict[int, np.ndarray], most: float) -> list[tuple[int, int]]:
    """Pairs of cells whose boxes (least angles, then largest) may hold vectors within the angle ``most``."""
    names = list(told)
    if not names:
        return []
    low, high = (np.array([told[n][k] for n in names]) for k in (0, 1))
    found = []
    for cell, (least, largest) in asked.items():
        apart = np.maximum(low - largest, least - high).max(axis=1)
        found += [(cell, names[i]) for i in np.flatnonzero(apart <= most + SLACK)]
    return found


def _placed(df: DataFrame, id_col: str, vec_col: str, cells: Cells) -> DataFrame:
    """(id, vec, cell, angles): usable vectors; those of another length than the pivots' have a cell of that length, below zero."""
    entry = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{entry}>").alias("vec")).where(F.size("vec") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vectors], np.int64)
            usable = np.zeros(len(vectors), bool)
            cell, angles = -sizes, np.zeros((len(vectors), len(cells.pivots)), np.float32)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                units = unit_rows([None if None in vectors[i] else vectors[i] for i in at], int(size))
                usable[at] = units.any(axis=1)
                if size == cells.length:
                    cell[at], angles[at] = cells.place(units)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * angles.shape[1], pa.int32()), pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), flat], ["id", "vec", "cell", "angles"]).filter(pa.array(usable))

    kind = rows.schema["id"].dataType.simpleString()
    return settle(rows.mapInArrow(run, f"id {kind}, vec array<{entry}>, cell int, angles array<float>"), "cells")


def _boxes(placed: DataFrame, pivots: int) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Of each cell the box and the number of members; cells are of bounded number."""
    sides = [F.array(*[f(F.get("angles", i)) for i in range(pivots)]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    rows = placed.groupBy("cell").agg(F.count("*").alias("n"), *sides).collect()
    return {r["cell"]: np.array([r["low"], r["high"]], float) for r in rows}, {r["cell"]: r["n"] for r in rows}


def vector_recall(
    queries: DataFrame, vectors: DataFrame, threshold: float, k: int = 20, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, counts: dict | None = None
) -> DataFrame:
    """(query_id, vec_id, cosine, rank): per query vector the ``k`` nearest at or above the threshold, which is above 0.

    A vector that is null, zero, not finite or of another length than the query is never near it. ``counts``, if
    given, gets the numbers of cell pairs there are ("all") and that meet ("met").
    """
    if threshold <= 0:
        raise ValueError("the threshold has to be above 0")
    spark, kinds = queries.sparkSession, {"query_id": queries.schema["query_id"].dataType, "vec_id": vectors.schema["vec_id"].dataType}
    shape = f"query_id {kinds['query_id'].simpleString()}, vec_id {kinds['vec_id'].simpleString()}, cosine double"
    told = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") > 0)
    length = told.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    ranked = spark.createDataFrame([], f"{shape}, rank int")
    if length is None:
        return ranked
    taken = told.where(F.size("v") == length["d"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    sample = unit_rows([None if None in r["v"] else r["v"] for r in taken], length["d"])
    sample = sample[sample.any(axis=1)]
    if not len(sample):
        sample = np.eye(1, length["d"])
    most = max(1, BLOCK_ENTRIES // length["d"])  # of long vectors a task holds fewer
    cell_rows, block_rows = min(cell_rows, most), min(block_rows, most)
    wide = math.ceil(math.sqrt(length["count"] / cell_rows))
    cells = Cells(sample, min(PIVOTS, wide), min(RINGS, wide))
    right, left = _placed(vectors, "vec_id", "embedding", cells), _placed(queries, "query_id", "query_vec", cells)
    (asked, n_left), (known, n_right) = _boxes(left, len(cells.pivots)), _boxes(right, len(cells.pivots))
    inside = lambda boxes: {c: b for c, b in boxes.items() if c >= 0}
    met = meetings(inside(asked), inside(known), math.acos(min(1.0, threshold)))
    if counts is not None:
        counts.update(all=len(inside(asked)) * len(inside(known)), met=len(met))
    met += [(c, c) for c in asked if c < 0 and c in known]  # of another length: by length alone
    if not met:
        return ranked
    parts = lambda n: -(-n // block_rows)
    table = pd.DataFrame([(a, b, parts(n_left[a]), parts(n_right[b])) for a, b in met], columns=["_a", "_b", "_na", "_nb"])
    pairs = spark.createDataFrame(table, "_a int, _b int, _na int, _nb int")

    def dealt(rows: DataFrame, own: str, parts_own: str, other: str, parts_other: str, names: list[str]) -> DataFrame:
        spread = rows.select("id", "vec", F.col("cell").alias(own)).join(F.broadcast(pairs), own)  # of bounded size
        mine = F.pmod(F.xxhash64("id"), F.col(parts_own)).cast("int").alias(f"{own}s")
        return spread.select(
            F.col("id").alias(names[0]), F.col("vec").alias(names[1]), own, other, mine, F.explode(F.sequence(F.lit(0), F.col(parts_other) - 1)).alias(f"{other}s")
        )

    key = ["_a", "_as", "_b", "_bs"]
    visiting = dealt(left, "_a", "_na", "_b", "_nb", ["query_id", "query_vec"])
    visited = dealt(right, "_b", "_nb", "_a", "_na", ["vec_id", "embedding"])
    cap, slab_entries = k, SLAB_ENTRIES

    def score(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})
        if mine.empty or theirs.empty:
            return none
        mine, theirs = mine.sort_values("query_id"), theirs.sort_values("vec_id")
        size = len(mine["query_vec"].iloc[0])
        left, right = unit_rows(mine["query_vec"], size), unit_rows(theirs["embedding"], size).T
        ids, qids, found = theirs["vec_id"].to_numpy(object), mine["query_id"].to_numpy(object), []
        slab = max(1, slab_entries // len(theirs))
        for start in range(0, len(left), slab):
            for qid, row in zip(qids[start : start + slab], left[start : start + slab] @ right):
                near = np.flatnonzero(row >= threshold - 1e-11)
                cos = np.round(row[near], 12)
                near, cos = near[cos >= threshold], cos[cos >= threshold]
                best = np.argsort(-np.round(cos, 4), kind="stable")[:cap]
                found.append((np.full(len(best), qid, object), ids[near[best]], cos[best]))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pd.DataFrame({"query_id": pd.Series(columns[0], dtype=object), "vec_id": pd.Series(columns[1], dtype=object), "cosine": columns[2]})

    # few bytes are much work here: the number of partitions is given, so that AQE does not put blocks together by size
    visiting, visited = scale.dealt(visiting, *key), scale.dealt(visited, *key)
    scored = visiting.groupBy(*key).cogroup(visited.groupBy(*key)).applyInPandas(score, shape)
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return scored.withColumn("cosine", F.round("cosine", 4)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
