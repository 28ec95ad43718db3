"""Language identification by rank-order profiles.

A language's profile is the list of its ``PROFILE`` most frequent letter n-grams (1 to 3 letters, words padded with
one blank) over all texts it is learned from. A document's own most frequent n-grams are ranked the same way; its
out-of-place distance to a profile adds, for each of them, how far its rank is from the rank there, or ``PROFILE``
where it is missing. The nearest profile names the language, ties going to the name that sorts first; the score is
one minus the distance over the largest possible one.

Counting is distributed (partial counts in bounded pieces, then one aggregate by language and n-gram); the profiles
have at most ``PROFILE`` rows per language and at most ``MAX_LANGUAGES`` languages, which is checked, and are sent to
the tasks that predict.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is any text if nothing was learned;
rows with a null language teach nothing; repeated rows count each; texts are read in pieces, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile.
PROFILE = 400
#: Language codes in use number about 8000.
MAX_LANGUAGES = 10_000
#: Characters handled at once, and distinct n-grams held before partial counts are handed on.
PIECE = 1 << 18
HELD = 1 << 20
_BLANK = 32
UNKNOWN = "und"
#: Score below which a text is in none of the learned languages: nearly all of its n-grams are missing from the nearest profile.
REJECT = 0.1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for start in range(0, 0x110000, 0x1000):
        table[start : start + 0x1000] = [chr(c).isalpha() for c in range(start, start + 0x1000)]
    return table


def merge_counts(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with the sums of their counts."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(all_codes, kind="stable")
    all_codes, all_counts = all_codes[order], all_counts[order]
    first = np.flatnonzero(np.r_[True, all_codes[1:] != all_codes[:-1]]) if len(all_codes) else np.zeros(0, np.int64)
    return all_codes[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as packed code points, with their counts; empty if it has no letter."""
    letters, codes, counts = _letters(), [], []
    tail = np.array([_BLANK], np.int64)
    for start in range(0, len(text), PIECE):
        raw = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        new = np.where(letters[raw], raw, _BLANK)
        if start + PIECE >= len(text):
            new = np.append(new, _BLANK)
        before = np.concatenate([tail[-1:], new[:-1]])
        new = new[(new != _BLANK) | (before != _BLANK)]
        run = np.concatenate([tail, new])
        n, size = len(new), len(run)
        two = (run[:-1] << 21) | run[1:]
        grams = [new[new != _BLANK], two[max(0, size - 1 - n) :]]
        if size > 2:
            three = (two[:-1] << 21) | run[2:]
            grams.append(three[run[1:-1] != _BLANK][-n:] if n else three[:0])
        found, times = np.unique(np.concatenate(grams), return_counts=True)
        codes.append(found)
        counts.append(times)
        tail = run[-2:]
    if not codes:
        return merge_counts([], [])
    found, times = (codes[0], counts[0]) if len(codes) == 1 else merge_counts(codes, counts)
    return (found, times) if len(found) and found[0] != _BLANK and (found < (1 << 21)).any() else merge_counts([], [])


def top(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def gram_table(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """lang, code, n: how often each language has each n-gram, over all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (codes, counts) in held.items():
                c, n = merge_counts(codes, counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1)):
                codes, counts = gram_counts(t.as_py())
                mine = held.setdefault(name.as_py(), ([], []))
                mine[0].append(codes)
                mine[1].append(counts)
                size += len(codes)
                if size >= HELD:
                    for key, (c, n) in held.items():
                        merged = merge_counts(c, n)
                        held[key] = ([merged[0]], [merged[1]])
                    size = sum(len(c[0]) for c, _ in held.values())
                    if size >= HELD // 2:
                        yield from flush()
                        size = 0
        yield from flush()

    rows = docs.select(text.alias("text"), lang.alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, text: Column, lang: Column, size: int = PROFILE) -> DataFrame:
    """lang, rank, code: each language's most frequent n-grams."""
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    return gram_table(docs, text, lang).withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < size).select("lang", "rank", "code")


class Profiles:
    """Rank table of all languages over the n-grams that any profile holds."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[2] for r in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, np.int32)
        if rows:
            at = {name: i for i, name in enumerate(self.langs)}
            self.ranks[[at[r[0]] for r in rows], np.searchsorted(self.codes, [r[2] for r in rows])] = [r[1] for r in rows]

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text or "")
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        mine = top(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        known = self.codes[at] == mine
        there, own = self.ranks[:, at[known]], np.flatnonzero(known)
        distance = np.where(there < 0, self.size, np.abs(there - own)).sum(axis=1) + (len(mine) - len(own)) * self.size
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (len(mine) * self.size))


def held_out(id_col: str) -> Column:
    """Rows kept from learning: the remainder of the id's CRC-32 by four is two (a null id counts as empty)."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4) == 2


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    table = profiles(docs, F.col(text_col), F.col(lang_col), size)
    rows = [tuple(r) for r in table.limit(MAX_LANGUAGES * size + 1).collect()]
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles(rows, size)


def predictor(docs: DataFrame, model: Profiles):
    """A pandas-free Arrow function from texts to (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            names, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"]
            )

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows not held out, one row per input row."""
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predictor(docs, model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose text is near enough to a language, all columns kept.

    A text goes if it has no letter, or if its distance to the nearest profile leaves a score under ``reject``. Where
    nothing could be learned, every text with a letter stays.
    """
    model = learn(docs, text_col, lang_col)
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = columns.index(text_col)

    def stays(text: str | None) -> bool:
        if not shared.value.langs:
            return len(gram_counts(text or "")[0]) > 0
        lang, score = shared.value.predict(text)
        return lang != UNKNOWN and score >= reject

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([stays(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
