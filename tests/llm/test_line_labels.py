"""Line labelling: base counts, gradients and decoding against plain models, held-out verdicts, odd rows."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarmatch.llm import line_labels as ll
from scholarmatch.llm.queries import op11_line_quality

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = list(zip(words, words[1:], words[2:]))
    times, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked |= {i, i + 1, i + 2}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(marked)


def counts_of(page):
    return page.n_words, page.word_chars, page.n_symbols, page.n_dup_lines, page.n_repeat_words


ODD = [
    None, "", " \n\t\r\x0b\x0c", "\n\n", "a", "a b c a b c", "x x x x x", "eins zwei\n\neins zwei\n eins zwei\n", "é ü ß 漢字 \U0001f600|<>", "a\rb\x0bc\n#*$%&",
    "\n".join(["same line here now"] * 5), "w " * 3000, "last\n", "\nfirst", "a b c\nd e f\na b c\n",
]


def test_counts_equal_a_plain_model():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("ab \n\t|#é.", k=rng.randrange(80))) for _ in range(400)]
    for text in texts:
        assert counts_of(ll.Page(text)) == plain_counts(text), repr(text)


def test_counts_of_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(ll, "PIECE", 7)
    rng = random.Random(2)
    text = "\n".join(" ".join(rng.choices(["aa", "b", "ç", "dd"], k=rng.randrange(1, 20))) for _ in range(60))
    assert counts_of(ll.Page(text)) == plain_counts(text)


def test_many_distinct_words_do_not_mix_windows_up():
    numbers = np.array([0, 1, 2, 5, 0, 1, 2, 7, 8])
    small, large = ll.repeated_words(numbers, 9), ll.repeated_words(numbers, 1 << 22)
    assert small.tolist() == large.tolist() == [True, True, True, False, True, True, True, False, False]


def _field(seed):
    rng = np.random.default_rng(seed)
    return ll.Field(rng.normal(size=ll.N_FEATURES), rng.normal(size=(2, 2)))


def _codes(rng, n):
    return np.array([[rng.randrange(len(b) + 1) for b in ll.FEATURES.values()] for _ in range(n)], np.uint8).reshape(n, len(ll.FEATURES))


def _path(field, codes, labels):
    scores = field.scores(codes)
    return sum(s * l for s, l in zip(scores, labels)) + sum(field.after[a, b] for a, b in zip(labels, labels[1:]))


def test_decoding_finds_the_best_of_all_sequences():
    rng = random.Random(3)
    for seed in range(30):
        field, codes = _field(seed), _codes(rng, rng.randrange(0, 9))
        found = field.decode(codes).astype(int).tolist()
        best = max((_path(field, codes, p) for p in itertools.product((0, 1), repeat=len(codes))), default=0)
        assert len(found) == len(codes) and abs(_path(field, codes, found) - best) < 1e-9
    assert not ll.Field().decode(_codes(rng, 5)).any()  # ties go to content


def test_likelihood_and_gradients_equal_sums_over_all_sequences():
    rng = random.Random(4)
    field, codes, labels = _field(9), [_codes(rng, n) for n in (1, 4, 2, 6)], np.array([1, 0, 0, 1])

    def plain(f):
        total = 0.0
        for c, label in zip(codes, labels):
            every = [_path(f, c, p) for p in itertools.product((0, 1), repeat=len(c))]
            total += _path(f, c, [label] * len(c)) - np.log(np.exp(every).sum())
        return total

    given = ll.Sequences(codes, labels)
    value, d_weights, d_after = ll.likelihood(field, given)
    assert abs(value - plain(field)) < 1e-9
    for k in (0, 5, 20, ll.N_FEATURES - 1):
        moved = ll.Field(field.weights.copy(), field.after)
        moved.weights[k] += 1e-6
        assert abs((plain(moved) - value) / 1e-6 - d_weights[k]) < 1e-4
    for a, b in itertools.product((0, 1), repeat=2):
        moved = ll.Field(field.weights, field.after.copy())
        moved.after[a, b] += 1e-6
        assert abs((plain(moved) - value) / 1e-6 - d_after[a, b]) < 1e-4


def test_verdicts_on_held_out_documents(spark):
    rows = op11_line_quality(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rated = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = rows.join(docs, "doc_id").join(rated, "doc_id", "left").collect()
    assert len(found) == docs.count()
    right = Counter()
    for r in found:
        counts = plain_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r.base_failed and r.kept)
        if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.quality is not None and not r.base_failed:
            right[r.quality, r.kept == (r.quality == 1)] += 1
    assert right[1, True] > 50 and right[1, False] == 0 and right[0, False] <= right[0, True] // 9


def test_a_short_good_line_does_not_save_a_bad_document(spark):
    docs, rated = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    field = ll.learn(docs, rated)
    junk = " ".join(f"wo{i}th$$$ the&&& ofan***" for i in range(60))
    page = ll.Page("A short and plain line of words.\n" + junk)
    assert field.decode(page.codes).tolist()[-1] and not field.decode(ll.Page("The thing is as it was here. " * 3).codes).any()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, i % 3, "x", "y") for i, t in enumerate(ODD)] + [(None, "a b", 1, "x", "y"), (4, "a", 1, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string, _quality string")


def test_odd_rows_without_and_with_odd_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (5, None), (6, 7), (999, 0)], "doc_id long, quality int")
    for rated in (empty, some):
        got = ll.quality_rules(odd, rated).collect()
        assert Counter((r.doc_id, r.n_words, r.n_repeat_words) for r in got) == Counter(
            (r.doc_id, plain_counts(r.text)[0], plain_counts(r.text)[4]) for r in odd.collect()
        )
    assert all(r.kept == (not r.base_failed) for r in ll.quality_rules(odd, empty).collect())
    assert ll.quality_rules(odd.limit(0), some).collect() == []


def test_lines_come_with_their_labels(spark, odd):
    lines = ll.label_lines(odd, ll.Field()).collect()
    want = Counter((r.doc_id, i, line) for r in odd.collect() for i, line in enumerate((r.text or "").split("\n")) if re.search(WORD, line))
    assert Counter((r.doc_id, r.line, r.text) for r in lines) == want and not any(r.boilerplate for r in lines)


def test_training_reads_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(ll, "TRAIN_SEGMENTS", 40)
    monkeypatch.setattr(ll, "TRAIN_DOCS", 60)
    docs, rated = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    once, again = ll.learn(docs, rated), ll.learn(docs.repartition(7), rated.orderBy(F.rand(3)))
    assert np.allclose(once.weights, again.weights) and once.weights.any()
