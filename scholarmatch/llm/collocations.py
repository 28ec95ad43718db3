"""Phrase collocations by top-order marginalisation.

Every word is the head of one window: itself and the next LENGTH - 1 words of its piece as columns, padded with the
empty string. Only these longest windows are counted. A window begins with one phrase of every length, so Spark's
ROLLUP over (lang, w1, ..., wLENGTH) sums the counts of all shorter phrases as successively shorter prefixes: no
phrase length is exploded by itself, and the sum over a language is its number of words.

A window may be cut (padded from there on) at a word, a neighbouring pair or three words in a row that are too rare for
any candidate: no phrase across the cut reaches LEAST, all others keep their counts. A first pass counts 32-bit hashes
of (lang, word) and (lang, word, next word), a second one those of three words whose pairs both reached LEAST; what
reaches LEAST goes into a bit table of fixed size that is sent to the tasks. A collision
only leaves a window longer than it had to be; with a full table nothing is cut and the result is the same. All
passes count in bounded pieces before they shuffle, so a frequent pair or phrase costs a row a piece.

Scores, cuts and containment are joins of the phrases that reached LEAST (a table, never collected), in decimals of
38 digits: exact up to counts of 10^11.

Defined cases: a null text counts as empty and a null language as ``und``; repeated rows count each; texts are whole,
one larger than CHUNK is read in pieces that end at a piece's end; a language without candidates, like an empty table,
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmatch.sources.tables import settle

#: Words of the longest phrase, fewest occurrences of a candidate, and phrases that a language's report has.
LENGTH, LEAST, TOP = 5, 100, 2000
#: Bytes of text that are cut into words at once, and pairs that a task counts before it hands them on.
CHUNK, HELD = 1 << 19, 1 << 19
#: Bits of the table of frequent pairs, whatever the size of the corpus (16 MB).
BITS = 27
_SEPARATORS = r"[.,;:!?\x0A-\x0D]"
_BREAK = re.compile(_SEPARATORS)
_ALONE, _THREE = np.uint64(0xA5A5A5A55A5A5A5A), np.uint64(0x3C3C3C3CC3C3C3C3)
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def portions(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and languages of about CHUNK bytes a time; a larger text is cut after separators."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, size in enumerate(sizes.tolist()):
        if held + size > CHUNK and k > start:
            yield texts.slice(start, k - start), langs.slice(start, k - start)
            start, held = k, 0
        held += size
        if size > CHUNK:
            text, at = texts[k].as_py(), 0
            while at < len(text):
                found = _BREAK.search(text, at + CHUNK)
                end = found.end() if found else len(text)
                yield pa.array([text[at:end]], pa.string()), langs.slice(k, 1)
                at = end
            start, held = k + 1, 0
    if start < len(sizes):
        yield texts.slice(start), langs.slice(start)


def _hashes(texts: pa.Array) -> np.ndarray:
    return pd.util.hash_array(texts.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(texts) else np.zeros(0, np.uint64)


def _keys(first: np.ndarray, langs: np.ndarray, second: np.ndarray | np.uint64) -> np.ndarray:
    mixed = (first * _ODD[0] + langs) * _ODD[1] ^ second
    return (((mixed ^ (mixed >> np.uint64(29))) * _ODD[2]) >> np.uint64(32)).astype(np.uint32)


class Words:
    """The words of some texts in order: numbers into ``distinct``, their pieces, and numbers into ``langs``."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        pieces = pc.split_pattern_regex(pc.ascii_lower(texts), _SEPARATORS + "+")
        words = pc.split_pattern_regex(pieces.values, r"[ \t]+")
        flat = words.values
        real = pc.not_equal(flat, "")
        kept = real.to_numpy(zero_copy_only=False)
        coded, named = flat.filter(real).dictionary_encode(), langs.dictionary_encode()
        self.distinct, self.langs = coded.dictionary, named.dictionary
        self.numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        in_text, in_piece = np.diff(pieces.offsets.to_numpy()), np.diff(words.offsets.to_numpy())
        self.piece = np.repeat(np.arange(len(in_piece), dtype=np.int32), in_piece)[kept]
        of_text = named.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        self.lang = np.repeat(of_text, in_text)[self.piece] if len(in_piece) else self.piece
        self._words, self._langs = _hashes(self.distinct), _hashes(self.langs)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word but the last: whether the next one is of its piece, and the pair's key."""
        hashed = self._words[self.numbers]
        return self.piece[1:] == self.piece[:-1], _keys(hashed[:-1], self._langs[self.lang[:-1]], hashed[1:])

    def triples(self, pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of the three words that begin at each of ``at``."""
        return _keys(pairs[at].astype(np.uint64), self._langs[self.lang[at]], self._words[self.numbers[at + 2]] ^ _THREE)

    def singles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each language's distinct words the key and the count, and for each word its place among them."""
        codes = self.lang.astype(np.int64) * max(1, len(self.distinct)) + self.numbers
        found, place, times = np.unique(codes, return_inverse=True, return_counts=True)
        lang, word = np.divmod(found, max(1, len(self.distinct)))
        return _keys(self._words[word], self._langs[lang], _ALONE), times, place


def known(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit in the table."""
    at = keys & np.uint32(len(table) * 64 - 1)
    return ((table[at >> np.uint32(6)] >> (at & np.uint32(63)).astype(np.uint64)) & np.uint64(1)).astype(bool)


def steps(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are frequent, from which one the next word can be reached, and the keys of all pairs."""
    together, pairs = words.pairs()
    alone, _, place = words.singles()
    frequent = known(table, alone)[place]
    goes_on = np.zeros(len(words.numbers), bool)
    goes_on[:-1] = together & known(table, pairs) & frequent[:-1] & frequent[1:]
    return frequent, goes_on, pairs


def _frequent(texts: DataFrame, keys_of: Callable[[Words], list[tuple[np.ndarray, np.ndarray]]], least: int, bits: int) -> np.ndarray:
    """The bit table of keys that reach ``least``; ``keys_of`` gives distinct keys and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, times = [], []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate(found), np.concatenate(times)
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            return keys[first], np.add.reduceat(n, first) if len(first) else n

        def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int32)), pa.array(n, pa.int64())], ["key", "n"])

        for batch in batches:
            for some, langs in portions(batch.column(0), batch.column(1)):
                words = Words(some, langs)
                if not len(words.numbers):
                    continue
                for keys, n in keys_of(words):
                    found.append(keys)
                    times.append(n)
                if sum(map(len, found)) > HELD:
                    keys, n = merged()
                    found, times = [keys], [n]
                    if len(keys) > HELD // 2:
                        yield rows(keys, n)
                        found, times = [], []
        if found:
            yield rows(*merged())

    counted = texts.mapInArrow(count, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    slot = F.col("key").bitwiseAND((1 << bits) - 1)
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), key & 63)")
    rows = counted.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("set")).toArrow()  # at most 2^(bits - 6) rows
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["at"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    return table


def frequent_keys(texts: DataFrame, least: int = LEAST, bits: int = BITS) -> np.ndarray:
    """The bit table of words, neighbouring pairs and three words in a row that reach ``least``. ``texts``: text, lang."""

    def short(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        together, pairs = words.pairs()
        alone, times, _ = words.singles()
        return [np.unique(pairs[together], return_counts=True), (alone, times)]

    first = _frequent(texts, short, least, bits)
    shared = texts.sparkSession.sparkContext.broadcast(first)

    def long(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        _, goes_on, pairs = steps(words, shared.value)
        return [np.unique(words.triples(pairs, np.flatnonzero(goes_on[:-1] & goes_on[1:])), return_counts=True)]

    return first | _frequent(texts, long, least, bits)


def window_counts(texts: DataFrame, table: np.ndarray, length: int = LENGTH) -> DataFrame:
    """lang, w1 .. wLENGTH, c: padded longest windows, cut at what is not in the table; counted per piece."""
    shared = texts.sparkSession.sparkContext.broadcast(table)
    names = [f"w{k}" for k in range(1, length + 1)]

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, langs in portions(batch.column(0), batch.column(1)):
                words = Words(some, langs)
                if not len(words.numbers):
                    continue
                frequent, goes_on, pairs = steps(words, shared.value)
                three = np.zeros(len(goes_on), bool)
                begins = np.flatnonzero(goes_on[:-1] & goes_on[1:])
                three[begins] = known(shared.value, words.triples(pairs, begins))
                columns = [words.lang, np.where(frequent, words.numbers, np.int32(-1))]
                size = len(words.numbers)
                alive = np.ones(size, bool)
                for k in range(1, length):  # lead by k: the word k places on, while all words up to it go together
                    alive[max(0, size - k) :] = False
                    alive[: max(0, size - k)] &= goes_on[k - 1 : size - 1]
                    if k > 1:
                        alive[: max(0, size - k)] &= three[k - 2 : size - 2]
                    ahead = np.full(size, -1, np.int32)
                    ahead[: max(0, size - k)] = words.numbers[k:]
                    columns.append(np.where(alive, ahead, np.int32(-1)))
                order = np.lexsort(columns[::-1])
                sorted_columns = [c[order] for c in columns]
                first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)]))
                times = np.diff(np.append(first, len(order)))
                padded = pa.concat_arrays([words.distinct, pa.array([""], words.distinct.type)])
                texts_of = [padded.take(pa.array(np.where(c[first] < 0, len(words.distinct), c[first]))) for c in sorted_columns[1:]]
                yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(sorted_columns[0][first])), *texts_of, pa.array(times, pa.int64())], ["lang", *names, "c"])

    shape = "lang string, " + ", ".join(f"{n} string" for n in names) + ", c long"
    return texts.mapInArrow(lead, shape)


def phrase_counts(windows: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """lang, k, words, f: phrases of k words with ``least`` occurrences or more; k is 0 for all words of a language."""
    names = [f"w{k}" for k in range(1, length + 1)]
    whole = windows.groupBy("lang", *names).agg(F.sum("c").alias("c"))
    rolled = whole.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id("lang", *names).alias("level"))
    level = {(1 << (length - k)) - 1: k for k in range(length + 1)}  # the rolled-up columns are the last bits
    k = F.create_map(*[F.lit(x).cast("long") if i % 2 == 0 else F.lit(x) for pair in level.items() for i, x in enumerate(pair)])[F.col("level")]
    phrases = rolled.where(F.col("lang").isNotNull()).withColumn("k", k)
    last = F.get(F.array(*names), F.col("k") - 1)
    phrases = phrases.where((F.col("k") == 0) | ((F.col("f") >= least) & (last != "")))
    return phrases.select("lang", "k", F.slice(F.array(*names), F.lit(1), F.col("k")).alias("words"), "f")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def score_phrases(counts: DataFrame) -> DataFrame:
    """lang, k, words, phrase, a, l, r, n, score: every candidate at its lowest-scoring cut."""
    sizes = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where("k > 0").select("lang", _joined(F.col("words")).alias("part"), "f")
    cuts = counts.where("k > 1").select("lang", "k", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({
        "left": _joined(F.slice("words", F.lit(1), F.col("cut"))), "right": _joined(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")))
    })
    cuts = cuts.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"])
    cuts = cuts.join(parts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"]).join(sizes, "lang")
    exact = lambda c: F.col(c).cast("decimal(17,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), exact("l") * exact("r"))
    scored = cuts.withColumn("score", score)
    lowest = scored.groupBy("lang", "k", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return lowest.select("lang", "k", "words", _joined(F.col("words")).alias("phrase"), "a", "m.l", "m.r", "n", "m.score")


def drop_contained(scored: DataFrame, length: int = LENGTH, inside: int = 100) -> DataFrame:
    """Without the candidates that a longer one contains and reaches in ``inside`` percent of their occurrences."""
    spots = [(size, start) for size in range(2, length) for start in range(1, length)]
    held = F.filter(
        F.array(*[F.when(F.col("k") >= F.lit(size + start - 1), F.struct(F.lit(size).alias("size"), _joined(F.slice("words", start, size)).alias("phrase"))) for size, start in spots]),
        lambda x: x.isNotNull() & (x["size"] < F.col("k")),
    )
    longer = scored.where("k > 2").select("lang", "a", F.explode(held).alias("h")).select("lang", F.col("h.phrase").alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    joined = scored.join(longer, ["lang", "phrase"], "left")
    return joined.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * inside)).drop("most")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, length: int = LENGTH, bits: int = BITS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``length`` words."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    counts = settle(phrase_counts(window_counts(texts, frequent_keys(texts, least, bits), length), length, least), "phrase-counts")
    kept = drop_contained(settle(score_phrases(counts), "phrase-scores"), length)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
