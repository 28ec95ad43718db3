"""The whole pipeline against a plain model of its stages, and each stage's contract."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from scholarmatch.llm import mixing
from tests.llm.test_mixing import plain_places
from tests.llm.test_operators import _plain_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(COLUMNS)
    first = docs.orderBy("doc_id").first()
    more = [
        (900_001, None, None, None, None), (900_002, "", "en", "src0", 0), (900_003, "12 34 !!", "en", "src0", 8), (900_004, first.text + " ", "en", None, None),
        (900_006, "漢字仮名交文 漢字", None, "src0", 9), (900_005, first.text + "\n\n", "en", "src1", None), (900_005, first.text + "\n\n", "en", "src1", None),
    ]
    path = str(tmp_path_factory.mktemp("docs"))
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    return path


def _model(rows):
    # No learned text has a letter of the one that is in no known language; all others are near enough to theirs.
    rows = [r for r in rows if any(c.isalpha() for c in r.text or "") and "漢" not in r.text]
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r.text), []).append(r)
    kept = [min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values()]
    classes = _plain_classes([(r.doc_id, r.text) for r in kept])
    return [r for r in kept if (r.doc_id, r.doc_id) in {(doc, name) for doc, name, _ in classes}]


def test_pipeline_equals_a_plain_model(spark, folder):
    want = _model(spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in want)
    texts = {r.doc_id: r.text for r in want}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for r in got:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.text == texts[r.doc_id] and list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert np.array(ids).size == len(ids)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_mixing_keeps_every_document(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, folder)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, docs.collect()))


def test_rows_of_the_pipeline_carry_the_mix(spark, folder):
    kept = _model(spark.read.parquet(f"{folder}/documents.parquet").collect())
    counts = Counter(r.source for r in kept)
    weights = {s: Fraction(math.pow(n, mixing.TEMPERATURE)) for s, n in counts.items()}
    whole = sum(weights.values())
    want = plain_places([(r.doc_id, r.source) for r in kept], {s: w / whole for s, w in weights.items()})
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.source): (r.mix_slot, r.mix_offset) for r in got} == want
