"""Small tests of the training-data operators: plain models, and the defined cases of odd rows."""

from __future__ import annotations

import codecs
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholarmatch.llm import ann, bpe, exact_dedup, langid, lm_score, minhash, mixing, pii, secret_scan, warc
from scholarmatch.llm.graph import components

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use themselves.
CLASH = ("key", "sha", "t", "row", "id", "_key", "_h", "_id", "_t", "score", "rank", "bucket", "class", "word", "rid", "hash", "list", "vec", "record")


def _rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "Und", "größe", "été", "x1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), ("en", "de", None)[i % 3], ("a", "a", "b", None)[i % 4], None) for i in range(60)]
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows += [
        (100, None, None, None, None), (101, "", "en", "a", 0), (102, " \t\n", None, "b", 3), (103, long, "en", "a", None), (104, long + " tail", "en", "b", None),
        (105, "x" * 120_000, "en", "a", None), (106, "same text here for all of us", "en", "a", 1), (106, "same text here for all of us", "en", "a", 1),
        (107, "same  text here for all of us", "en", "b", 1), (None, "same text here for all of us", "de", None, None), (108, "12 34 !!", "en", "a", None),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    for n, name in enumerate(CLASH):
        df = df.withColumn(name, F.lit(n))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- exact dedup -------------------------------------------------------------------------------
def test_exact_dedup_equals_a_plain_model(odd):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text)].append((i, text))
    want = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        twins = 0
        for i, text in sorted(members, key=lambda m: (m[0] is None, m[0] or 0)):
            wins = (i, text) == best and not twins
            twins += wins
            want.append((i, best[0], len(members), wins, _sha(norm)))
    for bucket_rows in (4096, 1):
        got = exact_dedup.exact_dedup(odd, bucket_rows=bucket_rows).drop("bucket").collect()
        assert Counter(map(tuple, got)) == Counter(want)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(w[0] for w in want if w[3])


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    table = exact_dedup.directory(keys, bucket_rows=40, max_depth=12)
    held = keys.withColumn("prefix", F.shiftrightunsigned("key", 52)).join(table, "prefix").groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in held) == 5000 and max(r["count"] for r in held) <= 40 and all(len(r.bucket) == r.depth for r in held)
    hot = spark.range(100).select(F.lit(77).cast("long").alias("key"))
    assert {r.depth for r in exact_dedup.directory(hot, 40, 12).collect()} == {12}


# --- mixing ------------------------------------------------------------------------------------
def test_mix_keeps_every_window_and_row(spark):
    docs = spark.createDataFrame([(i, "abc"[min(2, i % 5)]) for i in range(900)], "doc_id long, source string")
    share = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = mixing.mix_schedule(docs, share, block_rows=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(900))
    blocks = {(r.source, r.block): r for r in rows}
    assert all(r.release <= r.slot < r.deadline for r in blocks.values())
    assert len({r.slot for r in blocks.values()}) == len(blocks)
    used = Counter()
    last = min(max(r.slot for r in blocks.values() if r.source == s) for s in "abc")
    at = {r.slot: r.source for r in blocks.values()}
    for t in range(last):
        used[at[t]] += 1
        assert all(abs(used[s] - share[s] * (t + 1)) < 1 for s in "abc")


def test_mix_of_odd_rows_and_empty(odd, empty):
    mixed = mixing.mix_rows(odd)
    assert mixed.columns == odd.columns and mixed.count() == odd.count()
    assert mixing.mix_schedule(odd).count() == odd.count()
    assert mixing.mix_schedule(empty).count() == 0 and mixing.mix_rows(empty).columns == empty.columns


def test_mix_rows_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(500)], "doc_id long, source string")
    place = {r.doc_id: (r.slot, r.offset) for r in mixing.mix_schedule(docs, block_rows=4).collect()}
    order = [place[r.doc_id] for r in mixing.mix_rows(docs, block_rows=4).collect()]
    assert order == sorted(order)


# --- secrets -----------------------------------------------------------------------------------
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
}


def _secrets(text):
    found = []
    for nr, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            if {"assign": lambda: len(m.group(2)) >= 6, "access": lambda: len(m.group()) >= 20, "hex": lambda: len(m.group()) >= 24}[kind]():
                found.append((m.start(), nr, f"{kind}:{m.start()}:{m.end()}"))
    return [f[2] for f in sorted(found)]


def test_secret_spans_equal_plain_patterns(spark, odd, empty):
    rng = random.Random(3)
    parts = ["password", "TOKEN", "api_key", "apikey", ":", "=", " ", '"', "abc", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "deadbeefdeadbeefdeadbeef", "é😀", "secret", "x"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(25))) for i in range(400)}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", 0) for i, t in texts.items()], SCHEMA)
    for r in secret_scan.secret_scan(docs).collect():
        base = _secrets(texts[r.doc_id])
        assert [s for s in r.spans.split(",") if s and not s.startswith("live")] == base and r.base_sha256 == _sha(",".join(base))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in PATTERNS)
    assert Counter(r.doc_id for r in secret_scan.secret_scan(odd).collect()) == Counter(r.doc_id for r in odd.collect())
    assert secret_scan.secret_scan(empty).count() == 0


def test_ownership_separates_copied_examples(spark):
    live, shared, bare = "q7Zk29xWm4Lp81Tv", "Copied1234abcdefXYZ", "9fKq27zXw81LmPv04TtB"
    rows = [(i, f"token = '{shared}'", "en", f"o{i}", 0) for i in range(5)] + [(10, f"token: {live}", "en", "o1", 0), (11, f"see {bare} there", "en", "o1", 0)]
    got = {r.doc_id: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].verdicts == "shared" and got[10].verdicts == "live" and got[11].spans == f"live:4:{4 + len(bare)}"


# --- personal data -----------------------------------------------------------------------------
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _personal(text):
    found = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]():
                found.append((kind, *m.span()))
    return found


def test_pii_base_equals_plain_patterns():
    rng = random.Random(1)
    for letters in ("a1.@-+ (9", "12.0 -+", "a@.b"):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
            assert [s[:3] for s in pii.find(text) if s[0] in PII] == _personal(text), text


def test_pii_checksums_context_and_long_runs():
    kinds = lambda text: {s[0] for s in pii.find(text)}
    assert kinds("IBAN DE89370400440532013000 ok") == {"iban"} and not kinds("DE88370400440532013000 ok")
    assert kinds("4111111111111111") == {"card"} and not kinds("4111111111111112")
    assert "cards" in kinds("4111111111111111 4111111111111111")
    assert "ssn" in kinds("social security 123-45-6789") and "ssn" not in kinds("part 123-45-6789")
    assert "ssn" in kinds("123-45-6789 (SSN)")
    assert [s[:3] for s in pii.find("ES91 2100 0418 4502 0005 1332 BIC")] == [("iban", 0, 29)]
    assert [s[:3] for s in pii.find("GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00")] == [("iban", 0, 27), ("iban", 28, 55)]
    assert not kinds("AB12 CDEF GHIJ KLMN OPQR ST UVWX")
    assert pii.redact("mail a.b@c.org now") == "mail <email> now"
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@a." * 50_000):
        pii.find(text)  # linear


def test_pii_rows(odd, empty):
    got = pii.scan_pii(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert {r.base_sha256 for r in got if r.doc_id in (100, 101)} == {_sha("")}
    assert pii.scan_pii(empty).count() == 0


# --- language ----------------------------------------------------------------------------------
def test_gram_counts_equal_a_plain_model(monkeypatch):
    def plain(text):
        found = Counter()
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = f" {w} "
            found.update(w)
            found.update(padded[i : i + 2] for i in range(len(padded) - 1))
            found.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return dict(found)

    def named(code):
        text = ""
        while code:
            text, code = chr(code & (2**21 - 1)) + text, code >> 21
        return text

    rng = random.Random(1)
    for piece in (1 << 18, 1, 3):
        monkeypatch.setattr(langid, "PIECE", piece)
        for _ in range(200):
            text = "".join(rng.choice("ab éß1. ") for _ in range(rng.randrange(30)))
            codes, counts = langid.gram_counts(text)
            assert {named(c): n for c, n in zip(codes.tolist(), counts.tolist())} == plain(text), text


def test_language_of_held_out_documents(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (100, 101, 102, 108)} == {"und"}
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and not {100, 101, 102, 108} & {r.doc_id for r in kept.collect()}
    foreign = odd.where("doc_id = 1").withColumn("doc_id", F.lit(777).cast("long")).withColumns({"text": F.lit("漢字仮名交文 漢字"), "lang": F.lit(None).cast("string")})
    assert 777 not in {r.doc_id for r in langid.keep_identified(odd.unionByName(foreign)).collect()}
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))  # without anything learned, texts with letters stay
    letters = {r.doc_id for r in odd.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in langid.keep_identified(nothing).collect()} == letters
    assert langid.keep_identified(docs).count() == docs.count()


# --- tokens ------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    with open(TOKENIZER, encoding="utf-8") as file:
        return Tokenizer.from_file(TOKENIZER), bpe.Model(file.read())


def test_ids_and_text_equal_the_library(tokenizer):
    library, model = tokenizer
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßñAΣİ'1 \n\t!.,<|>\x1c\x85中😀") for _ in range(rng.randrange(80))) for _ in range(2000)]
    texts += ["a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "", "it's we'LL", "a" * 9000, "the" * 4000, "é" * 4000]
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)))
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        n, ids, decoded = bpe.digest(model, text)
        assert (n, ids) == (len(want.ids), hashlib.sha256(np.array(want.ids, "<u4").tobytes()).hexdigest()), text[:60]
        assert decoded == _sha(library.decode(want.ids, skip_special_tokens=False))


def test_stream_holds_a_bounded_window_and_equals_whole_merges(tokenizer):
    _, model = tokenizer
    rng = random.Random(4)
    assert 0 < model.lookahead < 5000
    raw = "".join(rng.choice(["the", "ing", "er", "th", "in", "tion", "s"]) for _ in range(3000)).encode()
    read = 0

    def symbols():
        nonlocal read
        for i, b in enumerate(raw):
            read = i + 1
            yield model.last[b] if i == len(raw) - 1 else model.inner[b]

    out, given, most = [], 0, 0
    for token in model.stream(symbols()):
        given += model.width(token)
        most = max(most, read - given) if read < len(raw) else most
        out.append(token)
    assert out == model.merged([model.last[b] if i == len(raw) - 1 else model.inner[b] for i, b in enumerate(raw)])
    assert most <= 2 * model.lookahead + 1


def test_decoder_gives_text_as_characters_complete(tokenizer):
    _, model = tokenizer
    ids = [i for g in model.encode("größe 中 naïve") for i in g]
    whole = bpe.Decoder(model, plain=True)
    text = "".join(whole.feed([i]) for i in ids) + whole.finish()
    assert text.split() == ["größe", "中", "naïve"]
    assert codecs.encode(text, "utf-8") and json.dumps(text)


def test_token_rows(odd, empty):
    got = bpe.encode_rows(odd, TOKENIZER).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert {r.n_tokens for r in got if r.doc_id in (100, 101, 102)} == {0}
    rows = bpe.token_rows(odd, TOKENIZER)
    assert rows.columns == [*odd.columns, "token_ids", "n_tokens", "decoded_sha256"]
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in rows.collect()} == {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in got}
    assert bpe.encode_rows(empty, TOKENIZER).count() == 0 and bpe.token_rows(empty, TOKENIZER).count() == 0


# --- language model ----------------------------------------------------------------------------
def test_gradients_are_the_slopes_of_the_loss():
    texts = ["the cat sat on the mat", "a dog ate the cat", "the the the dog"]
    counts = Counter(w for t in texts for w in lm_score.tokens(t))
    v = lm_score.Vocabulary(counts.most_common(), 3, sum(counts.values()) + 3, len(counts) + 1)
    network = lm_score.Network({k: x.astype(np.float64) for k, x in lm_score.start(v).items()}, v)
    inputs, fresh, targets, real, _ = next(lm_score.lanes([v.ids(lm_score.tokens(t)) for t in texts], v))
    state = np.zeros((inputs.shape[1], lm_score.HIDDEN))
    used = np.flatnonzero(real.ravel())

    def loss():
        states, _ = network.run(state, inputs, fresh)
        return -network.score(states.reshape(-1, lm_score.HIDDEN)[used], targets.ravel()[used]).mean()

    states, trace = network.run(state, inputs, fresh, True)
    _, grads = network.gradients(states, trace, inputs, fresh, targets, real)
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep = network.p[name][at]
        network.p[name][at] = keep + 1e-4
        up = loss()
        network.p[name][at] = keep - 1e-4
        down = loss()
        network.p[name][at] = keep
        assert math.isclose(g[at], (up - down) / 2e-4, rel_tol=1e-4, abs_tol=1e-7), name


def test_windows_carry_the_state(monkeypatch):
    counts = Counter({b"a": 50, b"b": 40, b"c": 30})
    v = lm_score.Vocabulary(counts.most_common(), 5, 125, 4)
    network = lm_score.Network(lm_score.start(v), v)
    rng = random.Random(1)
    texts = [v.ids([rng.choice([b"a", b"b", b"c", b"zz"]) for _ in range(n)]) for n in (0, 1, 5, 33, 200)]
    want = None
    for steps, lanes in ((16, 512), (1, 2), (500, 1)):
        monkeypatch.setattr(lm_score, "STEPS", steps)
        monkeypatch.setattr(lm_score, "LANES", lanes)
        got = lm_score.score_texts(network, texts)
        want = got if want is None else want
        assert np.allclose(got, want, atol=1e-4)


def test_scores_beat_the_base_on_held_out_documents(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "LOOKUP", 3000)
    extra = spark.createDataFrame([(None, "a b zzz"), (5000, None), (5001, ""), (5001, ""), (5002, "\x0b\x0c qqq \xa0 é")], "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(extra)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", t)] + ["<end>"]
    counts = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = {i: (out(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in rows}
    got = lm_score.score_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_an_empty_table(empty):
    assert lm_score.score_documents(empty).count() == 0


# --- nearest neighbours ------------------------------------------------------------------------
def test_search_equals_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(80)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    good = {i: np.array(v) for i, v in rows}
    rows += [(300, None), (320, [0.0] * 6), (340, [float("nan")] * 6), (360, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (380, [float("inf")] * 6), (400, [1.0]), (None, [1.0] * 6), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("id", F.lit(2))
    good = {i: np.array(np.array(v, np.float32), np.float64) for i, v in good.items()}
    found = defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in good if i % 20 == 0}
    hit = total = 0
    for q, got in found.items():
        want = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q)[:20]
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(math.isclose(s, float((good[q] * good[i]).sum()), rel_tol=1e-12, abs_tol=1e-12) for _, i, s in got)
        hit += len({w[1] for w in want} & {g[1] for g in got})
        total += 20
    assert hit / total >= 0.9
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert ann.search(few, F.col("vec_id") % 20 == 0).count() == 4
    assert ann.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_centroids_are_fitted_in_blocks(monkeypatch):
    """No table of the whole sample against all lists, or all queries, is held; the blocks change nothing."""
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(3000, 8))
    longest = float(np.sqrt((sample * sample).sum(1).max()))

    def fitted():
        return ann.calibrated(ann.fit_centroids(ann.lifted(sample, longest), 64), sample, longest, 20)

    whole, held = fitted()
    monkeypatch.setattr(ann, "BLOCK", 1 << 13)
    sizes, plain = [], ann._distances
    monkeypatch.setattr(ann, "_distances", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    again, held_again = fitted()
    assert max(sizes) <= ann.BLOCK
    assert np.allclose(whole.centers, again.centers) and math.isclose(whole.ratio, again.ratio) and (held == held_again).all()


def test_recall_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = defaultdict(set)
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    recalls = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        recalls.append(len(got[ids[q]] & set(ids[np.lexsort((ids, -scores))[:20]].tolist())) / 20)
    assert np.mean(recalls) >= 0.9


# --- archives ----------------------------------------------------------------------------------
def test_archives_round_trip_in_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    body = "é" * 60 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(i, f"http://www.Host{i % 3}.org/p{i % 5}?q={i}", body if i % 4 == 0 else f"page {i}" * 30) for i in range(1, 60)]
    rows += [(100, None, None), (101, "http://[bad", ""), (102, "http://h.org/a\r\nX: y", "short"), (103, "http://h.org/", "short"), (None, "http://h.org/", body), (104, "http://h.org/", body), (104, "http://h.org/", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("size", F.lit(2))
    parts = warc.capture_index(pages).withColumn("part", F.spark_partition_id()).collect()
    smallest = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            smallest[html] = min(i, smallest.get(html, i))
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        first = smallest.get(html) if len(raw) >= 100 else None
        again = first is not None and first != i
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in parts) == want
    order = [(r.url_key, r.captured_at, len(str(r.page_id or "")), str(r.page_id or "")) for r in parts]
    assert order == sorted(order) and [r.part for r in parts] == sorted(r.part for r in parts)
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(2)
    row = lambda n: (str(n), 0, "", "", None, f"k{n % 7}", "t", "f", n)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((row(rng.randrange(100)) for _ in range(rng.randrange(20))), key=warc.order_key) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted((r for run in runs for r in run), key=warc.order_key)


def test_damaged_archives_are_refused():
    import io

    with pytest.raises(ValueError):
        list(warc.parse(io.BufferedReader(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")), "f"))


# --- near duplicates ---------------------------------------------------------------------------
def _plain_classes(rows):
    low = lambda raw: raw.encode().lower().split()
    sets = []
    for _, text in rows:
        w = low(text)
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(k for s in sets for k in s)
    n = len(rows)
    idf = {k: 1 + minhash.IDF * math.log((n + 1) / (d + 1)) / math.log(n + 1) for k, d in df.items()}
    up = list(range(n))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(n):
        for j in range(i):
            same = rows[i][1] == rows[j][1]
            if not same and sets[i] and sets[j]:
                keys = set(sets[i]) | set(sets[j])
                least = sum(min(sets[i][k], sets[j][k]) * idf[k] for k in keys)
                same = least / sum(max(sets[i][k], sets[j][k]) * idf[k] for k in keys) >= minhash.THRESHOLD
            if same:
                up[max(root(i), root(j))] = min(root(i), root(j))
    classes = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        classes[root(i)].append(doc)
    return Counter((doc, min((m for m in c if m is not None), default=None), len(c)) for c in classes.values() for doc in c)


def test_near_duplicates_equal_all_pairs(spark, odd, empty):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) + str(rng.randrange(40)) for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(base[i % 12])
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(words), "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    plain = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == _plain_classes(plain)
    kept = minhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in minhash.near_duplicates(odd).collect() if r.kept}
    assert minhash.near_duplicates(empty).count() == 0


def test_large_components_are_compared_part_by_part(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(60):
        mine = list(words)
        for _ in range(i % 5):
            mine[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(mine), "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect())
    monkeypatch.setattr(minhash, "TASK_BYTES", 20_000)
    assert Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()) == whole


def test_words_are_hashed_alike_wherever_they_are_cut(monkeypatch):
    text = b" ".join(b"w%d" % (i % 90) for i in range(3000))
    want = minhash.document_words([text, b"", b"one two"])
    monkeypatch.setattr(minhash, "PIECE", 64)
    minhash._tables.cache_clear()
    got = minhash.document_words([text, b"", b"one two"])
    minhash._tables.cache_clear()
    assert (got[1] == want[1]).all() and (got[0] == want[0]).all()


def test_components(spark):
    links = [(f"a{i:03}", f"a{i + 1:03}") for i in range(40)] + [("b0", f"b{i}") for i in range(1, 30)] + [("c1", "c2"), ("c2", "c1")]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {n: {"a": "a000", "b": "b0", "c": "c1"}[n[0]] for link in links for n in link}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
