"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is the weighted set of its five-word shingles (words between ASCII white space, A-Z in lower case; all
words together if there are fewer than five). The weight is the shingle's count in the document times its inverse
document frequency over all documents, scaled to [1, 1 + IDF] so that a large group of copies does not make its own
shingles worthless. Two documents are near-duplicates if the weighted Jaccard similarity, the sum of minima over the
sum of maxima, is ``THRESHOLD`` or more; a class is a connected component of such links.

1. Texts are dealt into chunks; each chunk hands the hashes it holds, with the number of its documents having them,
   to the owners of hash ranges, which add them up and answer with the hashes that two or more documents have. A
   frequent shingle is one entry per chunk, however many documents hold it.
2. A document whose shared shingles carry less than ``THRESHOLD`` of its weight can have no partner and is done.
   The others draw consistent weighted samples, ``ROWS`` of which make each of the ``BANDS`` band keys.
3. Texts with a common band key are linked to the smallest of them; the components of these links hold every
   candidate pair. Inside a component the exact similarities decide: documents are compared with leaders, and pairs of
   others only where the triangle inequality leaves the question open and they are not in one class already.
   Components too large for a task are cut into parts of which every two meet in a task.

Nothing is dropped: banding misses a pair at the threshold with probability (1 - THRESHOLD**ROWS)**BANDS, 3e-5.

Defined cases: a null text counts as empty; equal texts are one class, empty ones too; a text of white space only
has no shingles and no partners but its equals; null ids sort last when a class is named; repeated rows are in the
class of their text; other columns are not read by ``near_duplicates`` and untouched by ``drop_near_copies``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmatch.llm.graph import components
from scholarmatch.sources.tables import settle

SHINGLE = 5
THRESHOLD = 0.8
#: How much the rarest shingle outweighs one that every document has.
IDF = 0.25
BANDS = 20
ROWS = 4
#: Bytes of text in a chunk, shingles of a hash range, bytes of vectors that one task compares.
CHUNK_BYTES = 4 << 20
RANGE_SHINGLES = 1 << 21
TASK_BYTES = 24 << 20
#: Bytes hashed at once.
PIECE = 1 << 18
_LOW = 40  # bits of a hash kept beside its range

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """Random constants from a fixed seed, and quantiles of the Gamma(2, 1) distribution and of its logarithm."""
    rng = np.random.default_rng(20240229)
    draw = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)
    byte = draw(256)
    byte[ord("A") : ord("Z") + 1] = byte[ord("a") : ord("z") + 1]
    base = draw(1)[0]
    inverse = _U(pow(int(base), -1, 2**64))
    powers, inverses = np.full(PIECE + 1, base), np.full(PIECE + 1, inverse)
    powers[0] = inverses[0] = 1
    grid = np.concatenate([np.logspace(-5, 0, 4000), np.linspace(1, 30, 40000)[1:]])
    quantile = np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + grid) * np.exp(-grid), grid)
    return {
        "byte": byte, "powers": np.multiply.accumulate(powers), "inverses": np.multiply.accumulate(inverses), "places": draw(SHINGLE + 1),
        "seeds": draw(BANDS * ROWS), "gamma": quantile.astype(np.float32), "log_gamma": np.log(quantile).astype(np.float32),
    }


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in at most ``PIECE`` bytes: differences of one running polynomial."""
    tables = _tables()
    inside = np.r_[False, ~_WHITE[data], False]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    running = np.r_[_U(0), np.cumsum(tables["byte"][data] * tables["powers"][: len(data)], dtype=np.uint64)]
    return starts, mixed((running[ends] - running[starts]) * tables["inverses"][starts] + (ends - starts).astype(np.uint64))


def _long_word(raw: bytes) -> np.uint64:
    """Hash of a word longer than a piece: the pieces' hashes chained."""
    total = _U(len(raw))
    for at in range(0, len(raw), PIECE):
        total = mixed(np.array([total * _U(3) + word_hashes(np.frombuffer(raw[at : at + PIECE], np.uint8))[1][0]]))[0]
    return total


def document_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, with the numbers of their texts."""
    hashes, owners = [], []
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if held:
            data = np.frombuffer(b" ".join(p for _, p in held), np.uint8)
            firsts = np.r_[0, np.cumsum([len(p) + 1 for _, p in held])[:-1]]
            starts, found = word_hashes(data)
            hashes.append(found)
            owners.append(np.array([n for n, _ in held], np.int64)[np.searchsorted(firsts, starts, side="right") - 1])
            held.clear()

    for n, raw in enumerate(texts):
        parts = [raw]
        if len(raw) >= PIECE:  # cut between words
            parts, at = [], 0
            while at < len(raw):
                end = min(len(raw), at + PIECE - 1)
                while end < len(raw) and not _WHITE[raw[end]]:
                    end -= 1
                    if end <= at:  # one word fills the piece
                        end = at
                        while end < len(raw) and not _WHITE[raw[end]]:
                            end += 1
                        break
                parts.append(raw[at:end])
                at = end + 1
        for part in parts:
            if len(part) >= PIECE:
                flush()
                size = 0
                hashes.append(np.array([_long_word(part)], np.uint64))
                owners.append(np.array([n]))
                continue
            if size + len(part) + 1 > PIECE:
                flush()
                size = 0
            held.append((n, part))
            size += len(part) + 1
    flush()
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(texts: list[bytes], ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) in the order of the shingles, with counts. A shingle is its range and 40 more bits."""
    words, owner = document_words(texts)
    places = _tables()["places"]
    n = len(words)
    if n >= SHINGLE:
        total = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            total += words[k : n - SHINGLE + 1 + k] * places[k]
        whole = owner[: n - SHINGLE + 1] == owner[SHINGLE - 1 :]
        found, text = total[whole], owner[: n - SHINGLE + 1][whole]
    else:
        found, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.bincount(owner, minlength=len(texts))
    few = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(few):
        firsts = np.searchsorted(owner, few)
        alone = places[SHINGLE] * sizes[few].astype(np.uint64)
        for k in range(SHINGLE - 1):
            has = sizes[few] > k
            alone[has] += words[firsts[has] + k] * places[k]
        found, text = np.r_[found, alone], np.r_[text, few]
    found = mixed(found)
    # The upper half picks the range by multiplication, the lower 40 bits stay.
    keys = (((found >> _U(_LOW)) * _U(ranges)) >> _U(64 - _LOW) << _U(_LOW)) | (found & _U(2**_LOW - 1))
    order = np.argsort(keys, kind="stable")
    keys, text = keys[order], text[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], text[first], np.diff(np.r_[first, len(keys)])


def pack(keys: np.ndarray) -> bytes:
    """The lower 40 bits of each key, five bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(raw: bytes, part: int) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel() | (_U(part) << _U(_LOW))


def _texts(table: pa.Table) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in table.column("text")]


def samples(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Band keys of a weighted set: for each hash function the element with the least value, and its level."""
    tables = _tables()
    count = BANDS * ROWS
    best, who, level = np.full(count, np.inf, np.float32), np.zeros(count, np.uint64), np.zeros(count, np.float32)
    logs = np.log(weights).astype(np.float32)
    for at in range(0, len(keys), 512):
        u = mixed(keys[at : at + 512, None] ^ tables["seeds"])
        r, c = tables["gamma"][u & _U(0xFFFF)], tables["log_gamma"][(u >> _U(16)) & _U(0xFFFF)]
        b = ((u >> _U(32)) & _U(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(logs[at : at + 512, None] / r + b)
        value = c - r * (t - b + 1)
        low = np.argmin(value, axis=0)
        mine = value[low, np.arange(count)]
        better = mine < best
        best[better], level[better] = mine[better], t[low, np.arange(count)][better]
        who[better] = keys[at : at + 512][low][better]
    drawn = mixed(who + (level.astype(np.int64).astype(np.uint64) << _U(1)) * _U(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
    band = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        band = mixed(band * _U(31) + drawn[:, k])
    return band.view(np.int64)


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def verified(vectors: list[tuple[np.ndarray, np.ndarray, float]], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links that span the exact components of the similarity graph of (keys, weights, total weight)."""
    n = len(vectors)
    sizes = np.array([len(v[0]) for v in vectors])
    bounds = np.r_[0, np.cumsum(sizes)]
    _, place = np.unique(np.concatenate([v[0] for v in vectors]), return_inverse=True)
    weight = np.concatenate([v[1] for v in vectors]).astype(np.float64)
    total = np.array([v[2] for v in vectors])
    row = np.zeros(place.max() + 1 if len(place) else 1)
    forest, links = Forest(n), []

    def similar(a: int) -> np.ndarray:
        own = slice(bounds[a], bounds[a + 1])
        row[place[own]] = weight[own]
        shared = np.add.reduceat(np.minimum(row[place], weight), bounds[:-1])
        row[place[own]] = 0
        return shared / (total[a] + total - shared)

    def link(a: int, near: np.ndarray) -> None:
        for b in np.flatnonzero(near >= threshold):
            if forest.join(a, int(b)):
                links.append((a, int(b)))

    leaders, far, open_ = [], [], np.ones(n, bool)
    for a in range(n):
        if open_[a]:
            near = similar(a)
            near[a] = 1.0
            link(a, near)
            leaders.append(a)
            far.append(1 - near)
            open_[near >= threshold] = False
    # Pairs of members that are no leaders are open only across classes.
    led = np.zeros(n, bool)
    led[leaders] = True
    roots = np.array([forest.root(i) for i in range(n)])
    if len(set(roots.tolist())) > 1 and not led.all():
        far = np.array(far)
        members = np.bincount(roots, minlength=n)
        for a in sorted(np.flatnonzero(~led), key=lambda i: members[roots[i]]):
            closest = np.argsort(far[:, a], kind="stable")[:8]
            apart = np.abs(far[closest] - far[closest, a][:, None]).max(axis=0)
            mine = forest.root(int(a))
            rest = np.flatnonzero((apart <= 1 - threshold + 1e-9) & ~led)
            if any(forest.root(int(b)) != mine for b in rest):
                link(int(a), similar(int(a)))
    return links


_SIGNED = "doc string, t string, bands array<long>, keys binary, weights binary, total double"


def signed(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id as text, MD5 of the text and, if it can have a partner, bands and shared shingles."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    n, size = facts["n"], facts["bytes"] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    ranges = max(1, min(2**23, math.ceil(size / 6 / RANGE_SHINGLES)))
    dealt = docs.select(
        F.col(id_col).cast("string").alias("doc"), F.md5(text).alias("t"), text.alias("text"),
        F.pmod(F.xxhash64(text, F.col(id_col).cast("string")), F.lit(chunks)).cast("int").alias("chunk"),
    )

    def held(table: pa.Table) -> pa.Table:
        keys, _, _ = shingles(_texts(table), ranges)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        times, keys = np.diff(np.r_[first, len(keys)]), keys[first]
        parts = (keys >> _U(_LOW)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(keys)]
        chunk = table.column("chunk")[0].as_py()
        spans = list(zip(cuts, ends))
        return pa.table({
            "part": pa.array([int(parts[a]) for a, _ in spans], pa.int32()), "chunk": pa.array([chunk] * len(spans), pa.int32()),
            "keys": pa.array([pack(keys[a:b]) for a, b in spans], pa.binary()),
            "times": pa.array([times[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
        })

    def shared(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        chunk = table.column("chunk").to_pylist()
        lists = [unpack(k, part) for k in table.column("keys").to_pylist()]
        times = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("times").to_pylist()]).astype(np.int64)
        whose = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        keys = np.concatenate(lists)
        order = np.argsort(keys, kind="stable")
        keys, whose, times = keys[order], whose[order], times[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        df = np.repeat(np.add.reduceat(times, first), np.diff(np.r_[first, len(keys)]))
        more = np.flatnonzero(df > 1)
        keys, whose, df = keys[more], whose[more], df[more]
        order = np.argsort(whose, kind="stable")
        keys, whose, df = keys[order], whose[order], df[order]
        bounds = np.searchsorted(whose, np.arange(len(lists) + 1))
        spans = [(c, bounds[i], bounds[i + 1]) for i, c in enumerate(chunk) if bounds[i + 1] > bounds[i]]
        return pa.table({
            "chunk": pa.array([c for c, _, _ in spans], pa.int32()), "part": pa.array([part] * len(spans), pa.int32()),
            "keys": pa.array([pack(keys[a:b]) for _, a, b in spans], pa.binary()),
            "df": pa.array([df[a:b].astype("<i8").tobytes() for _, a, b in spans], pa.binary()),
        })

    scale = IDF / math.log(n + 1) if n else 0.0

    def sign(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, text, tf = shingles(_texts(table), ranges)
        df = np.ones(len(keys), np.int64)
        if answers.num_rows:
            answers = answers.sort_by("part")
            known = np.concatenate([unpack(k, p) for k, p in zip(answers.column("keys").to_pylist(), answers.column("part").to_pylist())])
            counts = np.concatenate([np.frombuffer(x, "<i8") for x in answers.column("df").to_pylist()])
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            df = np.where(known[at] == keys, counts[at], 1)
        weight = tf * (1 + scale * np.log((n + 1) / (df + 1)))
        many = df > 1
        total = np.bincount(text, weight, table.num_rows)
        partly = np.bincount(text[many], weight[many], table.num_rows)
        order = np.argsort(text, kind="stable")
        keys, weight, many = keys[order], weight[order], many[order]
        bounds = np.searchsorted(text[order], np.arange(table.num_rows + 1))
        names, done = table.column("t").to_pylist(), set()
        out: dict[str, list] = {"bands": [], "keys": [], "weights": [], "total": []}
        for i, name in enumerate(names):
            row = slice(bounds[i], bounds[i + 1])
            if bounds[i] == bounds[i + 1] or partly[i] < threshold * total[i] * (1 - 1e-9) or name in done:
                values = (None, None, None, None)
            else:
                done.add(name)
                some = many[row]
                values = (samples(keys[row], weight[row]), keys[row][some].tobytes(), weight[row][some].astype("<f4").tobytes(), float(total[i]))
            for column, value in zip(out.values(), values):
                column.append(value)
        return pa.table({
            "doc": table.column("doc"), "t": table.column("t"), "bands": pa.array(out["bands"], pa.list_(pa.int64())),
            "keys": pa.array(out["keys"], pa.binary()), "weights": pa.array(out["weights"], pa.binary()), "total": pa.array(out["total"], pa.float64()),
        })

    counted = dealt.groupBy("chunk").applyInArrow(held, "part int, chunk int, keys binary, times binary")
    answers = counted.groupBy("part").applyInArrow(shared, "chunk int, part int, keys binary, df binary")
    found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sign, _SIGNED)
    return settle(found, "near-signed")


def classes(rows: DataFrame, threshold: float) -> DataFrame:
    """t, class: texts that are in a class with other texts."""
    # The vectors stay in the written table until it is known which are compared with which.
    texts = rows.where("bands IS NOT NULL")
    banded = texts.select("t", "bands").dropDuplicates(["t"]).select("t", F.posexplode("bands").alias("band", "key"))
    least = banded.groupBy("band", "key").agg(F.min("t").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    candidates = banded.join(least, ["band", "key"]).where("a != t").select("a", F.col("t").alias("b"))
    size = F.octet_length("keys") + F.octet_length("weights") + 100
    measured = texts.groupBy("t").agg(F.max(size).alias("size"))
    groups = settle(components(candidates).withColumnRenamed("node", "t").join(measured, "t"), "near-groups")
    sizes = groups.groupBy("root").agg(F.sum("size").alias("size"))
    parts = F.ceil(F.col("size") / TASK_BYTES).cast("int")
    sized = groups.select("t", "root").join(sizes.select("root", parts.alias("parts")), "root")
    bins = max(1, math.ceil((groups.agg(F.sum("size")).first()[0] or 0) / (TASK_BYTES / 4)))
    # A component of one part shares a task with others; of a larger one every two parts meet.
    alone = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    own = F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, own).alias("p"), F.greatest(x, own).alias("q")))
    placed = texts.select("t", "keys", "weights", "total").join(sized, "t").dropDuplicates(["t"])
    spread = placed.withColumn("pq", F.explode(F.when(F.col("parts") == 1, alone).otherwise(pairs)))
    tasked = spread.select(
        "root", "t", "keys", "weights", "total", F.when(F.col("parts") == 1, F.lit("")).otherwise(F.concat_ws(":", "root", "pq.p", "pq.q")).alias("pair"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.lit(-1)).alias("bin"),
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("t", "ascending")])
        roots, names = table.column("root").to_pylist(), table.column("t").to_pylist()
        keys, weights, total = (table.column(c).to_pylist() for c in ("keys", "weights", "total"))
        a, b, at = [], [], 0
        while at < len(roots):
            end = at
            while end < len(roots) and roots[end] == roots[at]:
                end += 1
            vectors = [(np.frombuffer(keys[i], "<u8"), np.frombuffer(weights[i], "<f4"), total[i]) for i in range(at, end)]
            for x, y in verified(vectors, threshold):
                a.append(names[at + x])
                b.append(names[at + y])
            at = end
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    links = tasked.groupBy("bin", "pair").applyInArrow(compare, "a string, b string")
    return components(links).select(F.col("node").alias("t"), F.col("root").alias("class"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, kept: one row per input row. A class is named by its smallest id, which is kept.

    Of rows repeated with that id, those with the text whose MD5 is smallest are kept.
    """
    kind = docs.schema[id_col].dataType
    rows = signed(docs, threshold, id_col, text_col)
    named = rows.select(F.col("doc").cast(kind).alias("doc_id"), "t").join(classes(rows, threshold), "t", "left").withColumn("class", F.coalesce("class", "t"))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("t").alias("t"))
    best = named.groupBy("class").agg(F.min(first).alias("first"), F.count("*").alias("class_size"))
    return named.join(best, "class").select(
        "doc_id", F.col("first.id").alias("class_id"), "class_size", (F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t"))).alias("kept"), "t"
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which no near-copy is kept before them, with all their columns."""
    gone = near_duplicates(docs, threshold, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left_anti").select("row.*")
