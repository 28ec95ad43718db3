"""Quality rules by line sequence labelling.

A linear-chain conditional random field labels the lines of a document as content or boilerplate. A line shows itself
by what it is made of (FEATURES, each in a few bands: its length, the shares of symbols, capitals, digits and marks,
how much of it repeats itself or the document, how it begins and ends); neighbouring labels weigh on each other.
Viterbi decoding finds the best sequence of a whole document, and the share of the document's words that stand in
content lines decides whether it stays. Lines without a word belong to no sequence.

The field is trained here, on documents that are labelled as a whole: all lines of a good one count as content, all
lines of a bad one as boilerplate, so a kind of line that both have gets no weight. It maximises the conditional
likelihood (forward-backward, full-batch gradient steps). Training reads a bounded sample: the TRAIN_DOCS first labels
by the hash of their id, in the shares of qualities that they have, cut into pieces of SEGMENT lines, of which the
TRAIN_SEGMENTS first by hash are taken; one task fits them. Documents whose CRC-32 remainder by four is two are held out, so that accuracy can be measured on them.

Everything else is one pass without a shuffle over whole texts; a task holds the batch and, of one document at a
time, one number per word and its distinct words.

Defined cases: a null text counts as empty; a text without words has no line, a content share of 0 and fails the base
rules; rows with repeated or null ids are judged one by one; labels other than 0 and 1 or without a document teach
nothing; without labelled documents of both qualities every line is content. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels, lines of a piece and pieces that the field is fitted to.
TRAIN_DOCS, SEGMENT, TRAIN_SEGMENTS = 4000, 64, 8192
#: Gradient steps, their size, and the weight of the squared parameters against one document.
STEPS, RATE, RIDGE = 150, 0.2, 0.002
#: Share of words in content lines from which a document stays.
CONTENT_SHARE = 0.5
#: Base rules: fewest words, and most words in repeated three-word windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words that are numbered at once.
PIECE = 1 << 17

#: Upper borders of the bands of each feature.
FEATURES = {
    "words": (1, 2, 4, 8, 16, 64),
    "word_length": (2, 3, 4, 6, 9, 15),
    "symbols": (0, 0.01, 0.03, 0.1, 0.2),
    "capitals": (0, 0.02, 0.05, 0.15, 0.4, 0.7),
    "digits": (0, 0.02, 0.05, 0.15, 0.4),
    "marks": (0, 0.01, 0.03, 0.06, 0.12, 0.2),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
    "repeated": (0, 0.1, 0.3, 0.6, 0.9),
    "earlier": (0,),
    "ending": (0, 1),
    "beginning": (0, 1),
}
_OFFSETS = np.cumsum([0, *[len(b) + 1 for b in FEATURES.values()]])
N_FEATURES = int(_OFFSETS[-1])

SYMBOLS = b"#*$%&|<>"
_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
_POINT = ((_BYTES & 0xC0) != 0x80) & ~_BLANK
_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SYMBOL = np.isin(_BYTES, list(SYMBOLS))
_LETTER = _CAPITAL | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0xC0)
_MARK = _POINT & (_BYTES < 128) & ~_LETTER & ~_DIGIT & ~_SYMBOL
_END = np.select([np.isin(_BYTES, list(b".?")), np.isin(_BYTES, list(b"!"))], [0, 1], 2)
_BEGIN = np.select([_CAPITAL | (_BYTES >= 0xC0), (_BYTES >= 97) & (_BYTES <= 122)], [0, 1], 2)


class _Numbers(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def repeated_words(numbers: np.ndarray, distinct: int) -> np.ndarray:
    """Which words stand in a three-word window that the text has twice or more."""
    marks = np.zeros(len(numbers), bool)
    if len(numbers) < 4:
        return marks
    words = numbers.astype(np.int64)
    pairs = words[:-1] * distinct + words[1:]
    if distinct >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * distinct + words[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if same.any():
        hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        for k in range(3):
            marks[hit + k] = True
    return marks


class Page:
    """The counts of a text and the feature bands of its lines with words."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.n_words = self.word_chars = self.n_symbols = self.n_dup_lines = self.n_repeat_words = 0
        self.lines, self.words = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.codes = np.zeros((0, len(FEATURES)), np.uint8)
        data = np.frombuffer(raw, np.uint8)
        self.n_symbols = int(_SYMBOL[data].sum())
        blank = _BLANK[data]
        begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])[: len(data)])
        self.n_words = len(begins)
        if self.n_words:
            self._read(raw, data, blank, begins)

    def _read(self, raw: bytes, data: np.ndarray, blank: np.ndarray, begins: np.ndarray) -> None:
        ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
        starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        line_of = np.searchsorted(starts, begins, side="right") - 1
        first = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]]))
        last = np.concatenate([first[1:], [len(begins)]]) - 1
        self.lines, self.words = line_of[first], last - first + 1
        own = np.repeat(np.arange(len(first)), self.words)

        numbers, seen = np.empty(len(begins), np.int32), _Numbers()
        for k in range(0, len(begins), PIECE):
            some = raw[begins[k] : ends[min(k + PIECE, len(begins)) - 1] + 1].split()
            numbers[k : k + len(some)] = np.fromiter(map(seen.__getitem__, some), np.int32, len(some))
        marks = repeated_words(numbers, len(seen))
        self.n_repeat_words = int(marks.sum())

        earlier, known = np.zeros(len(first), bool), set()
        if len(first) > 1:
            stops = np.concatenate([starts[1:] - 1, [len(raw)]])
            for i, (a, b) in enumerate(zip(starts[self.lines].tolist(), stops[self.lines].tolist())):
                line = raw[a:b]
                earlier[i] = line in known
                known.add(line)
        self.n_dup_lines = int(earlier.sum())

        span = begins[first]  # blanks between lines count nowhere
        count = lambda kind: np.add.reduceat(kind[data], span, dtype=np.int64)
        points, letters = count(_POINT), np.maximum(count(_LETTER), 1)
        self.word_chars = int(points.sum())
        pairs = np.unique(own * np.int64(len(seen)) + numbers)
        distinct = np.bincount(pairs // len(seen), minlength=len(first))
        repeated = np.bincount(own, weights=marks, minlength=len(first))
        values = (
            self.words, points / self.words, count(_SYMBOL) / points, count(_CAPITAL) / letters, count(_DIGIT) / points, count(_MARK) / points,
            distinct / self.words, repeated / self.words, earlier, _END[data[ends[last]]], _BEGIN[data[span]],
        )
        self.codes = np.stack([np.searchsorted(b, v, side="left") for b, v in zip(FEATURES.values(), values)], axis=1).astype(np.uint8)

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


class Field:
    """Weights of the features for boilerplate (content has none) and of a label after a label."""

    def __init__(self, weights: np.ndarray | None = None, after: np.ndarray | None = None):
        self.weights = np.zeros(N_FEATURES) if weights is None else weights
        self.after = np.zeros((2, 2)) if after is None else after

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.weights[codes + _OFFSETS[:-1]].sum(axis=-1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best labels by Viterbi: whether each line is boilerplate; ties go to content."""
        (stay, turn), (back, hold) = self.after.tolist()
        content, boiler, came = 0.0, 0.0, []
        for k, score in enumerate(self.scores(codes).tolist()):
            if k == 0:
                boiler = score
                continue
            from_boiler, kept_boiler = boiler + back > content + stay, boiler + hold > content + turn
            came.append((from_boiler, kept_boiler))
            content, boiler = (boiler + back if from_boiler else content + stay), (boiler + hold if kept_boiler else content + turn) + score
        labels = np.zeros(len(codes), bool)
        at = bool(len(codes)) and boiler > content
        for k in range(len(codes) - 1, -1, -1):
            labels[k] = at
            if k:
                at = came[k - 1][at]
        return labels


class Sequences:
    """Training sequences side by side, the longest first; all lines of one have its label (1: boilerplate)."""

    def __init__(self, codes: list[np.ndarray], labels: np.ndarray):
        order = np.argsort([-len(c) for c in codes], kind="stable")
        self.lengths = np.array([len(codes[k]) for k in order])
        self.truth = np.asarray(labels)[order].astype(int)
        self.places = np.concatenate([codes[k] for k in order]) + _OFFSETS[:-1]
        self.own = np.repeat(np.arange(len(order)), self.lengths)
        self.at = np.arange(len(self.own)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.longer = [int(np.searchsorted(-self.lengths, -t, side="left")) for t in range(int(self.lengths[0]))]  # than t lines


def likelihood(field: Field, given: Sequences) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the sequences and its gradients, by the forward and the backward recursion."""
    longest, width = len(given.longer), len(given.lengths)
    lines = field.weights[given.places].sum(axis=1)
    score = np.zeros((longest, width, 2))
    score[given.at, given.own, 1] = lines
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    forward[0] = score[0]
    for t in range(1, longest):
        n = given.longer[t]
        step = forward[t - 1, :n, :, None] + field.after
        forward[t, :n] = np.logaddexp(step[:, 0], step[:, 1]) + score[t, :n]
    for t in range(longest - 2, -1, -1):
        n = given.longer[t + 1]
        step = field.after + (backward[t + 1, :n] + score[t + 1, :n])[:, None, :]
        backward[t, :n] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    ends = forward[given.lengths - 1, np.arange(width)]
    whole = np.logaddexp(ends[:, 0], ends[:, 1])
    chance = np.exp((forward + backward)[given.at, given.own, 1] - whole[given.own])
    truth = given.truth[given.own]
    d_weights = np.bincount(given.places.ravel(), weights=np.repeat(truth - chance, len(FEATURES)), minlength=N_FEATURES)
    d_after = np.diag(np.bincount(given.truth, weights=given.lengths - 1, minlength=2))
    value = (truth * lines).sum() + (d_after * field.after).sum() - whole.sum()
    for t in range(1, longest):
        n = given.longer[t]
        both = forward[t - 1, :n, :, None] + field.after + (backward[t, :n] + score[t, :n])[:, None, :] - whole[:n, None, None]
        d_after = d_after - np.exp(both).sum(axis=0)
    return float(value), d_weights, d_after


def fit(codes: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Field:
    """The field that explains the sequences best, by gradient steps whose size adapts to each parameter."""
    if len(set(map(bool, labels))) < 2:
        return Field()
    given, parameters = Sequences(codes, labels), np.zeros(N_FEATURES + 4)
    split = lambda: Field(parameters[:N_FEATURES], parameters[N_FEATURES:].reshape(2, 2))
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        _, d_weights, d_after = likelihood(split(), given)
        slope = np.concatenate([d_weights, d_after.ravel()]) / len(codes) - ridge * parameters
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        parameters = parameters + rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return split()


def held_out(id_col: str | Column) -> Column:
    """Documents that teach nothing: the remainder of the id's CRC-32 by four is two (a null id counts as empty)."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 4) == 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> Field:
    """The field fitted to a bounded sample of the labelled documents that are not held out."""
    rated = labels.select(F.col(id_col).alias("_id"), F.col(quality_col).cast("int").alias("_quality")).where(~held_out("_id"))
    chosen = rated.where(F.col("_quality").isin(0, 1)).orderBy(F.xxhash64("_id"), "_id", "_quality").limit(TRAIN_DOCS)
    sample = F.broadcast(chosen)
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")).join(sample, F.col("_own") == F.col("_id"))
    keyed = texts.select("_quality", F.xxhash64("_own", "_text").alias("_key"), "_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for quality, key, text in zip(*[c.to_pylist() for c in batch.columns]):
                codes = Page(text).codes
                rows += [((key + 0x9E3779B97F4A7C15 * (k + 1)) % (1 << 63), quality, codes[k : k + SEGMENT].tobytes()) for k in range(0, len(codes), SEGMENT)]
            keys, qualities, pieces = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(qualities, pa.int32()), pa.array(pieces, pa.binary())], ["key", "quality", "codes"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, good = [], []
        for batch in batches:
            pieces += [np.frombuffer(c, np.uint8).reshape(-1, len(FEATURES)) for c in batch.column(1).to_pylist()]
            good += batch.column(0).to_pylist()
        field = fit(pieces, np.array(good) == 0) if pieces else Field()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((field.weights, field.after))], pa.binary())], ["field"])

    segments = keyed.mapInArrow(cut, "key long, quality int, codes binary").orderBy("key", "quality", "codes").limit(TRAIN_SEGMENTS)
    found = segments.select("quality", "codes").coalesce(1).mapInArrow(train, "field binary").first()
    return Field(*pickle.loads(found["field"])) if found else Field()


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, content_words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = ["doc_id", *counts, "base_failed", "kept", "n_lines", "content_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1):
                page = Page(text.as_py())
                content = int(page.words[~field.decode(page.codes)].sum())
                kept = not page.base_failed and content >= content_share * page.n_words
                for column, value in zip(found, [*[getattr(page, c) for c in counts], page.base_failed, kept, len(page.lines), content]):
                    column.append(value)
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(found, kinds)]], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = ", ".join([f"doc_id {kind}", *[f"{c} long" for c in counts], "base_failed boolean, kept boolean, n_lines long, content_words long"])
    return rows.mapInArrow(run, shape)


def label_lines(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (from 0), boilerplate, text: every line with a word, as it stands."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                page = Page(text)
                if len(page.lines):
                    lines, own = text.split("\n"), batch.column(0).take(pa.array([k] * len(page.lines), pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(page.lines, pa.int64()), pa.array(field.decode(page.codes)), pa.array([lines[i] for i in page.lines], pa.string())],
                        ["doc_id", "line", "boilerplate", "text"],
                    )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line long, boilerplate boolean, text string")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """Every document judged by a field that is learned from the labelled ones."""
    return judge(docs, learn(docs, labels, id_col, text_col, quality_col), id_col, text_col)
