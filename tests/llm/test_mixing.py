"""Mixing by the real target weights, against a plain earliest-deadline-first model."""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from fractions import Fraction

from scholarmatch.llm import mixing


def plain_places(rows, weights, block_rows=mixing.BLOCK_ROWS):
    """(doc_id, source) -> (slot, offset) for distinct rows; ``weights``: source -> Fraction, adding up to one."""
    by = {}
    for doc, source in rows:
        by.setdefault(source, []).append(doc)
    for docs in by.values():
        docs.sort(key=lambda d: (hashlib.md5(str("" if d is None else d).encode()).hexdigest(), d is not None, d or 0))
    names = sorted(by, key=lambda s: (s is not None, s or ""))
    out, waiting, ready, t = {}, [(0, i, 0) for i in range(len(names))], [], 0
    while waiting or ready:
        t = t if ready else max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) // weights[names[i]]), i, j))
        _, i, j = heapq.heappop(ready)
        docs = by[names[i]]
        for n, d in enumerate(docs[j * block_rows : (j + 1) * block_rows]):
            out[d, names[i]] = (t, n)
        if (j + 1) * block_rows < len(docs):
            heapq.heappush(waiting, (int((j + 1) // weights[names[i]]), i, j + 1))
        t += 1
    return out


def _within_one_block(rows, weights):
    """At any time every source with blocks left is less than one block from its target weight."""
    slots = sorted({(r.slot, r.source) for r in rows}, key=lambda x: x[0])
    assert len({t for t, _ in slots}) == len(slots)
    left, used = Counter(s for _, s in slots), Counter()
    for t, source in slots:
        for s in weights:
            if left[s]:
                assert abs(used[s] - weights[s] * t) < 1, (s, t)
        used[source] += 1
        left[source] -= 1


def test_deviation_from_the_real_weights_does_not_grow(spark):
    targets = {"a": 0.4, "b": 0.13, "c": 0.13, "d": 0.13, "e": 0.13, "f": 0.08}
    total = sum(map(Fraction, targets.values()))
    weights = {s: Fraction(w) / total for s, w in targets.items()}
    docs = spark.createDataFrame([(i, "aaaabcdef"[i % 9]) for i in range(9000)], "doc_id long, source string")
    rows = mixing.mix_schedule(docs, targets, block_rows=2).collect()
    assert len(rows) == 9000 and all(r.release <= r.slot < r.deadline for r in rows)
    assert all(abs(r.weight - float(weights[r.source])) < 1e-12 for r in rows)
    _within_one_block(rows, weights)
    assert {(r.doc_id, r.source): (r.slot, r.offset) for r in rows} == plain_places([(r.doc_id, r.source) for r in rows], weights, 2)


def test_any_number_of_sources(spark):
    docs = spark.range(1300).selectExpr("id AS doc_id", "concat('s', id % 600) AS source")
    rows = mixing.mix_schedule(docs, block_rows=1).collect()
    assert len(rows) == 1300 and len({r.slot for r in rows}) == 1300
    assert all(r.release <= r.slot < r.deadline for r in rows)
