"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent
pairs, decoding by a table of the tokens' bytes."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from covary.llm._common import col, map_batches

# The pattern of the byte-level pre-tokenizer, and the code
# points that count as white space in it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RARE_WS = WS.replace(" ", "").replace("\n", "")

#: Units whose ids a Python worker keeps; beyond it the cache starts anew.
CACHE_UNITS = 500_000
#: Units longer than this are not kept.
LONG_UNIT = 256
#: Pre-tokens up to this many bytes are merged side by side, longer ones alone.
WIDE = 64

_MODELS: dict = {}


def byte_characters() -> dict[str, int]:
    """The printable stand-in character of each byte in a vocabulary file:
    printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTree:
    """One sequence under merges. Leaf i holds ``rank * size + i`` for the
    pair that starts at symbol i, an inner node the smaller child, so the root
    is the leftmost of the lowest-ranked pairs. A merge changes three leaves;
    each is carried to the root in logarithmic time."""

    def __init__(self, symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]):
        self.sym, self.ranks = symbols, ranks
        n = len(symbols)
        self.size = size = 1 << max(0, n - 1).bit_length()
        self.none = none = len(ranks) * size + size
        self.prev, self.next = list(range(-1, n - 1)), [*range(1, n), -1]
        self.tree = tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = self._key(i, i + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def _key(self, i: int, j: int) -> int:
        hit = self.ranks.get((self.sym[i], self.sym[j]))
        return self.none if hit is None else hit[0] * self.size + i

    def _put(self, i: int, key: int) -> None:
        tree, k = self.tree, self.size + i
        tree[k] = key
        while k > 1:
            low = min(tree[k], tree[k ^ 1])
            k >>= 1
            if tree[k] == low:
                return
            tree[k] = low

    def run(self) -> list[int]:
        sym, prev, nxt = self.sym, self.prev, self.next
        while len(sym) > 1 and self.tree[1] < self.none:
            i = self.tree[1] % self.size
            j = nxt[i]
            sym[i] = self.ranks[sym[i], sym[j]][1]
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            self._put(j, self.none)
            self._put(i, self._key(i, nxt[i]) if nxt[i] >= 0 else self.none)
            if prev[i] >= 0:
                self._put(prev[i], self._key(prev[i], i))
        out, i = [], 0
        while i >= 0:
            out.append(sym[i])
            i = nxt[i]
        return out


class PairRanks:
    """Rank and merged id of many pairs at once (by binary search)."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        codes = np.array([(a << 32) | b for a, b in ranks], dtype=np.int64)
        values = np.array(list(ranks.values()), dtype=np.int64).reshape(-1, 2)
        order = np.argsort(codes)
        self.codes, self.rank = codes[order], values[order, 0]
        self.merged = np.empty(len(ranks), dtype=np.int64)
        self.merged[values[:, 0]] = values[:, 1]
        self.none = len(ranks)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not self.none:
            return np.zeros(len(a), dtype=np.int64)
        code = (a << 32) | b
        at = np.minimum(np.searchsorted(self.codes, code), self.none - 1)
        return np.where(self.codes[at] == code, self.rank[at], self.none)


def merge_rows(sym: np.ndarray, length: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """:class:`MergeTree` for many short sequences at once, a tree per row of
    ``sym`` (rows padded with -1 to a power of two). Returns the symbols, -1
    where one was merged away."""
    rows, size = sym.shape
    none = pairs.none * size + size
    at = np.arange(size)
    nxt = np.where(at[None, :] + 1 < length[:, None], at[None, :] + 1, -1)
    prev = np.broadcast_to(at - 1, (rows, size)).copy()
    tree = np.full((rows, 2 * size), none, dtype=np.int64)
    r, c = np.nonzero(nxt >= 0)
    rank = pairs(sym[r, c], sym[r, c + 1])
    tree[r, size + c] = np.where(rank < pairs.none, rank * size + c, none)
    k = size
    while k > 1:
        tree[:, k // 2:k] = np.minimum(tree[:, k:2 * k:2], tree[:, k + 1:2 * k:2])
        k //= 2

    def put(r, i, key):
        k = size + i
        tree[r, k] = key
        while size > 1 and k[0] > 1:  # all leaves have the same depth
            low = np.minimum(tree[r, k], tree[r, k ^ 1])
            k = k >> 1
            tree[r, k] = low

    def key(r, i, j):
        rank = pairs(sym[r, i], sym[r, np.maximum(j, 0)])
        return np.where((j >= 0) & (rank < pairs.none), rank * size + i, none)

    act = np.flatnonzero(tree[:, 1] < none)
    while len(act):
        root = tree[act, 1]
        i = root % size
        j = nxt[act, i]
        sym[act, i] = pairs.merged[root // size]
        sym[act, j] = -1
        after = nxt[act, j]
        nxt[act, i] = after
        w = after >= 0
        prev[act[w], after[w]] = i[w]
        put(act, j, np.full(len(act), none))
        put(act, i, key(act, i, after))
        p = prev[act, i]
        w = p >= 0
        if w.any():
            put(act[w], p[w], key(act[w], p[w], i[w]))
        act = act[tree[act, 1] < none]
    return sym


class ByteBPE:
    """A byte-level BPE vocabulary read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = byte_characters()
        as_bytes = lambda t: bytes(chars[c] for c in t)
        vocab = model["vocab"]
        self.ids = {as_bytes(t): i for t, i in vocab.items()}
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.pairs = PairRanks(self.ranks)
        self.table = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in self.ids.items():
            self.table[i] = t
        for t, i in self.special.items():
            self.table[i] = t.encode()
        self.words = regex.compile(PATTERN)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                ) if self.special else None
        self.units_at = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")

    def units(self, text: str) -> list[str]:
        """The text cut where white space begins. No pre-token crosses such a
        cut, so each unit encodes alone and the same wherever it stands."""
        if "  " in text or "\n " in text or any(w in text for w in RARE_WS):
            return self.units_at.findall(text)
        first, *rest = text.split(" ")
        return [first] * bool(first) + [" " + w for w in rest]

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """``(is special, string)``: special strings are tokens of their own."""
        if not any(m in text for m in self.special):
            return [(False, text)]
        return [(i % 2 == 1, p) for i, p in enumerate(self.marks.split(text)) if p]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian uint32."""
        out = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) < 2 or len(w) > WIDE:
                ids = MergeTree(self.byte_id[list(w)].tolist(), self.ranks).run() if w else []
                out[k] = np.array(ids, dtype="<u4").tobytes()
            else:
                by_size.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        for size, at in by_size.items():
            for lo in range(0, len(at), 8192):
                some = at[lo:lo + 8192]
                length = np.array([len(words[k]) for k in some])
                flat = np.frombuffer(b"".join([words[k].ljust(size, b"\0") for k in some]), np.uint8)
                sym = self.byte_id[flat.reshape(len(some), size)]
                sym[np.arange(size)[None, :] >= length[:, None]] = -1
                sym = merge_rows(sym, length, self.pairs)
                keep = sym >= 0
                ids = sym[keep].astype("<u4").tobytes()
                cut = np.concatenate(([0], 4 * np.cumsum(keep.sum(axis=1)))).tolist()
                for k, a, b in zip(some, cut, cut[1:]):
                    out[k] = ids[a:b]
        return out

    def pretokens(self, unit: str) -> list[str]:
        """The pre-tokens of a unit. Letters after at most one space are one,
        and so is the punctuation that ends them."""
        word = unit.rstrip(PUNCTUATION)
        if word[word[:1] == " ":].isalpha():
            return [unit] if len(word) == len(unit) else [word, unit[len(word):]]
        return self.words.findall(unit)

    def unit_ids(self, units: list[str], memo: dict[str, bytes]) -> None:
        """Fill ``memo`` with the ids (little-endian uint32) of new units."""
        words = [self.pretokens(u) for u in units]
        todo = list({w for ws in words for w in ws})
        ids = dict(zip(todo, self.merge([w.encode("utf-8", "replace") for w in todo])))
        for u, ws in zip(units, words):
            memo[u] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def encode(self, texts: list[str], memo: dict[str, bytes] | None = None) -> list[bytes]:
        """The ids of whole texts as little-endian uint32."""
        memo = {} if memo is None else memo
        cut = [[(s, p if s else self.units(p)) for s, p in self.parts(t)] for t in texts]
        every = [p for parts in cut for s, p in parts if not s]
        new = set().union(*[set(p).difference(memo) for p in every])
        self.unit_ids(list(new), memo)
        known = memo.__getitem__
        out = [b"".join([np.uint32(self.special[p]).tobytes() if s else b"".join(map(known, p))
                         for s, p in parts]) for parts in cut]
        forget(memo, new, CACHE_UNITS)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8 (damaged sequences replaced)."""
        table = self.table
        raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.decode("utf-8", "replace").encode()


def forget(memo: dict, new: set | list, most: int) -> None:
    """Keep a cache within bounds after a call. What came first stays, as the
    frequent words do; of what the call added only what still fits. A call of
    mostly unknown words (texts of another kind) starts the cache anew."""
    if len(memo) > most:
        if 2 * len(new) > len(memo):
            memo.clear()
            return
        for u in new:
            del memo[u]
    else:
        for u in new:
            if len(u) > LONG_UNIT:
                del memo[u]


def model(path: str) -> tuple[ByteBPE, dict[str, bytes]]:
    """The vocabulary and the unit cache of this Python worker."""
    if path not in _MODELS:
        _MODELS[path] = (ByteBPE(path), {})
    return _MODELS[path]


def blocks(texts: list[str], most: int = 4_000_000):
    """Slices of ``texts`` of about ``most`` characters, so that what a batch
    of very long texts needs stays bounded by the longest of them."""
    lo = size = 0
    for hi, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[lo:hi + 1]
            lo, size = hi + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def texts_of(batch: pa.RecordBatch, at: int) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   ids: bool = False, decoded: bool = False) -> DataFrame:
    """Encode every text, then decode its ids: ``id_col, n_tokens,
    ids_sha256, decoded_sha256``; with ``ids`` also the ``ids``, with
    ``decoded`` also the ``decoded`` text.

    Special strings of the vocabulary in a text become its special tokens.
    Null and empty texts have no tokens. One row per input row, ids null or
    repeated or not, empty for an empty table; other columns are not read.
    A worker keeps the ids of at most ``CACHE_UNITS`` units (runs of white
    space with what follows); texts are never cut.
    """
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
              StructField("decoded_sha256", StringType())]
    fields += [StructField("ids", ArrayType(IntegerType()))] * ids + [StructField("decoded", StringType())] * decoded

    def make():
        bpe, memo = model(path)

        def run(batch):
            n, ids_sha, text_sha, all_ids, all_texts = [], [], [], [], []
            for some in blocks(texts_of(batch, 1)):
                for code in bpe.encode(some, memo):
                    text = bpe.decode(code)
                    n.append(len(code) // 4)
                    ids_sha.append(hashlib.sha256(code).hexdigest())
                    text_sha.append(hashlib.sha256(text).hexdigest())
                    if ids:
                        all_ids.append(np.frombuffer(code, "<u4").astype(np.int32))
                    if decoded:
                        all_texts.append(text.decode())
            return [n, ids_sha, text_sha] + [all_ids] * ids + [all_texts] * decoded
        return run

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    out = map_batches(rows, make, StructType(fields))
    return out.select(F.col("id").alias(id_col), *[f.name for f in fields])
