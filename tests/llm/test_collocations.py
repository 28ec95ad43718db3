"""Phrase collocations against a plain model and the SQL; full and crowded bit tables; odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from scholarmatch.llm import collocations as co
from scholarmatch.llm.queries import ORACLES, QUERIES
from tests.oracle import duck, run_pair

SHAPE = "doc_id long, text string, lang string, rank int, phrase string, w1 string, c int, k int"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, least, top=2000, length=5):
    sizes, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, length + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in held.items():
            cuts = [(1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in held.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, sizes[lang], -score))
    return sorted(out)


def texts(seed=1):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "ß", "É", "c", "d|", "漢"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(60))), rng.choice(["x", "y", None, "und"])) for _ in range(120)]
    return rows + [(None, "x"), ("", None), (" \t ", "x"), ("one two three four five six", "z"), ("a b a b a b a b a b", "z")] + [("same old words again here now.", "x")] * 12


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", "w", 2, 3) for i, (t, lang) in enumerate(rows)], SHAPE)


def got(df, least, **more):
    return sorted(map(tuple, co.collocations(df, least=least, **more).collect()))


@pytest.mark.parametrize("bits", [27, 6])
def test_equals_a_plain_model_with_an_empty_and_a_full_table(spark, bits):
    rows = texts()
    for least in (2, 6):
        assert got(frame(spark, rows).repartition(3), least, bits=bits) == plain(rows, least)


def test_pieces_and_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(co, "CHUNK", 50)
    monkeypatch.setattr(co, "HELD", 20)
    rows = texts(2)
    assert got(frame(spark, rows).coalesce(1), 4) == plain(rows, 4)


def test_top_and_ties(spark):
    rows = [("b a. d c. f e. a b", "x")] * 5
    assert got(frame(spark, rows), 5, top=2) == plain(rows, 5, top=2) != plain(rows, 5)


def test_overlapping_occurrences_count_each(spark):
    found = {r[2]: r[3] for r in got(frame(spark, [("ha ha ha ha", "x")] * 3), 3)}
    assert found["ha ha"] == 9 and found["ha ha ha ha"] == 3


def test_products_beyond_64_bits_are_exact(spark):
    shape = "lang string, k int, words array<string>, f long"
    big = 10**11
    counts = spark.createDataFrame([("x", 0, [], big), ("x", 1, ["a"], big - 7), ("x", 1, ["b"], big // 3), ("x", 2, ["a", "b"], big // 3 - 1)], shape)
    row = co.score_phrases(counts).first()
    assert row.score == 1000 * (big // 3 - 1) * big // ((big - 7) * (big // 3))


def test_empty_table(spark):
    df = co.collocations(frame(spark, []))
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and df.collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, note, _ = run_pair(spark, sf, QUERIES["op13_collocations"], ORACLES["op13_collocations"], duck(sf))
    assert ok, note
