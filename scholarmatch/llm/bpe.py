"""BPE encoding and decoding as streaming transducers with bounded memory.

The encoder reads a word's symbols as they come and keeps a window of them. A token is emitted once it is stable,
that is when it ends at least ``lookahead`` symbols before the window's end; the window then starts after it. The
lookahead follows from the merge list alone. What a continuation can change starts at the right end and moves left
only through merges: a merge (u, v) moves it over u, and only if an earlier merge moved it to the left edge of v,
over a token that v begins with. The longest such chain, in the order of the merges and weighted by the lengths of
its u, bounds how far a change can reach; the longest token is added for the token cut by the window's end. As no
merge crosses the boundary of a final token, the rest of the word goes on as if it began there.

The decoder is a state machine over ids: it holds the unfinished bytes of a character and gives text as soon as it
is complete. A tokenizer file without a decoder section joins the tokens' surfaces with blanks, as its own library
does; ``plain=True`` turns surfaces back into bytes and word ends into blanks.

Defined cases: a null text counts as empty and has no ids; texts of any length are read piece by piece; repeated
rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Words whose tokens a worker remembers; the memory is emptied when full.
REMEMBERED = 1 << 18
#: Longest word that is remembered.
SHORT = 40
#: Ids that the decoder takes at once.
STEP = 1 << 14
#: White space of the normalizer and the splitter.
_WHITE = "\t-\r \x85\xa0  -     　"
_NEVER = (1 << 40, -1)
_GAPS = regex.compile(f"[{_WHITE}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], size: dict[str, int]) -> int:
    """Symbols after a token's end from which no continuation can change it (see the module's text)."""
    reach: dict[str, int] = {}  # of the changes that have moved to the left edge of a token with this beginning
    left: dict[str, str] = {}
    longest = max(size.values(), default=1)
    most = 0
    for u, v in merges:
        head, far = v, 0
        while head is not None:
            far = max(far, reach.get(head, 0))
            head = left.get(head)
        far += size[u]
        reach[u] = max(reach.get(u, 0), far)
        most = max(most, far)
        left.setdefault(u + v, u)
    return most + longest


class Model:
    """Vocabulary, merges, splitter and special tokens of one tokenizer file, from its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[u], self.vocab[v]): (n, self.vocab[u + v]) for n, (u, v) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        surface = lambda s: len(s.removesuffix(self.end)) if self.end else len(s)
        self.lookahead = sufficient_lookahead(pairs, {s: max(1, surface(s)) for s in self.vocab})
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split.replace(r"\s", _WHITE))
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The tokens of a whole window: always the first of the lowest-ranked pairs is merged."""
        rank, n = self.rank, len(symbols)
        if n < 24:
            symbols = list(symbols)
            found = [rank.get(p, _NEVER) for p in zip(symbols, symbols[1:])]  # what each pair would become
            while found:
                best = min(found)
                if best is _NEVER:
                    break
                i = found.index(best)
                symbols[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = rank.get((symbols[i - 1], symbols[i]), _NEVER)
                if i < len(found):
                    found[i] = rank.get((symbols[i], symbols[i + 1]), _NEVER)
            return symbols
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rank[p][:1], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            k = after[i] if token[i] is not None else n
            if k >= n or (token[i], token[k]) != pair:
                continue
            token[i], token[k] = rank[pair][1], None
            after[i] = after[k]
            if after[k] < n:
                before[after[k]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (token[a], token[b]) in rank:
                    heapq.heappush(heap, (rank[token[a], token[b]][0], a, (token[a], token[b])))
        return [t for t in token if t is not None]

    def stream(self, symbols: Iterable[int], window: int = 0) -> Iterator[int]:
        """Tokens of one word, emitted once stable; at most ``window`` plus the lookahead symbols are held."""
        room = max(window, self.lookahead) + self.lookahead
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) > room:
                used, stable = 0, len(held) - self.lookahead
                for t in self.merged(held):
                    size = self.width(t)
                    if used + size > stable:
                        break
                    yield t
                    used += size
                del held[:used]
        yield from self.merged(held)

    def width(self, token: int) -> int:
        s = self.pieces[token]
        return len(s.removesuffix(self.end)) if self.end else len(s)

    def word(self, word: str) -> tuple[int, ...]:
        """The tokens of one word of the splitter."""
        if (found := self.known.get(word)) is not None:
            return found
        raw = word.encode()
        inner, size = self.inner, len(raw)
        symbols = (self.last[b] if i == size - 1 else inner[b] for i, b in enumerate(raw))
        # A word that fits the window is its own window.
        found = tuple(self.merged(list(symbols)) if size <= self.lookahead else self.stream(symbols))
        if len(word) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def normal(self, text: str) -> str:
        """Composed characters, single blanks, lower case letter by letter."""
        text = _GAPS.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()

    def encode(self, text: str) -> Iterator[tuple[int, ...]]:
        """Groups of ids, one for each word or special token."""
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
            if part in self.special:
                yield (self.special[part],)
            elif part:
                known = self.known
                for m in self.split.findall(self.normal(part)):
                    yield known.get(m) or self.word(m)


class Decoder:
    """Incremental state machine from ids to text. ``plain`` gives the bytes' text, else surfaces and blanks."""

    def __init__(self, model: Model, plain: bool = False):
        self.model, self.plain = model, plain
        self.open = False  # a surface has been given, the next one comes after a blank
        self.chars = codecs.getincrementaldecoder("utf-8")("replace")  # holds the bytes of an unfinished character

    def feed(self, ids: Iterable[int]) -> str:
        pieces = self.model.pieces
        if not self.plain:
            text = " ".join([pieces[i] for i in ids])
            joined = (" " if self.open and text else "") + text
            self.open = self.open or bool(text)
            return joined
        out = []
        for i in ids:
            s = pieces[i]
            if s in self.model.special:
                out += [self.chars.decode(b"", True), s]
                self.chars.reset()
                continue
            ends = bool(self.model.end) and s.endswith(self.model.end)
            raw = bytes(self.model.bytes_of[c] for c in (s[: -len(self.model.end)] if ends else s))
            out.append(self.chars.decode(raw + b" " * ends))
        return "".join(out)

    def finish(self) -> str:
        return self.chars.decode(b"", True) if self.plain else ""


@lru_cache(maxsize=2)
def load(text: str) -> Model:
    return Model(text)


def digest(model: Model, text: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids and of the decoded text, in steps of bounded size."""
    ids_sum, text_sum, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(model), 0
    held: list[int] = []

    def flush() -> None:
        nonlocal n
        n += len(held)
        ids_sum.update(np.array(held, "<u4").tobytes())
        text_sum.update(decoder.feed(held).encode())
        held.clear()

    for group in model.encode(text):
        held.extend(group)
        if len(held) >= STEP:
            flush()
    flush()
    text_sum.update(decoder.finish().encode())
    return n, ids_sum.hexdigest(), text_sum.hexdigest()


def encode_rows(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per input row. ``tokenizer`` is the file's path.

    The file is read on the driver and sent along (its size does not depend on the data); texts stay where they are.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            found = [digest(model, t.as_py() or "") for t in batch.column(1)]
            n, ids, texts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_rows(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>), ``n_tokens`` and ``decoded_sha256``, the digest of the ids decoded again."""
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    at = docs.columns.index(text_col)
    schema = StructType([
        *docs.schema.fields, StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("decoded_sha256", StringType())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            ids = [np.fromiter((i for g in model.encode(t.as_py() or "") for i in g), np.int32) for t in batch.column(at)]
            sums = []
            for row in ids:
                decoder, text_sum = Decoder(model), hashlib.sha256()
                for k in range(0, len(row), STEP):
                    text_sum.update(decoder.feed(row[k : k + STEP].tolist()).encode())
                text_sum.update(decoder.finish().encode())
                sums.append(text_sum.hexdigest())
            added = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(r) for r in ids], pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "token_ids", "n_tokens", "decoded_sha256"])

    return docs.mapInArrow(run, schema)
