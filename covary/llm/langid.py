"""Language identification: unigram pieces, marginalised over segmentations."""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from covary.llm._common import col, map_batches, saved, ship
from covary.llm.bpe import blocks, texts_of

#: Bytes of a piece that fit a packed integer; longer ones are looked up by
#: their first so many bytes.
PACKED = 8
#: Words up to so many bytes are scored side by side with all of their length;
#: longer ones in segments, with the forward state carried on and rescaled.
SHORT = 32
SEGMENT = 512
RESCALE = 16
#: Labelled documents the fit reads: about this many of each language, chosen
#: by a hash of id and text (all of them if there are fewer).
SAMPLE_PER_LANGUAGE = 4000
ROUNDS = 3
#: Weight of the pooled piece distribution in that of a language, in pieces.
POOLED = 200.0
CACHE_BYTES = 48 << 20

LETTERS = re.compile(r"[^\W\d_]+")
#: The same without numbers that are no digits, such as one half.
ONLY_LETTERS = regex.compile(r"\p{L}+")

_SCORERS: dict = {}


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4 (a null id is not)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trainable(id_col: Column) -> Column:
    """Rows that may be learned from: an id, and not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def words_of(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else ONLY_LETTERS.findall(w))]


def as_bytes(word: str) -> bytes:
    """A word as UTF-8 after a space."""
    return b" " + word.encode("utf-8", "replace")


class Pieces:
    """All pieces of a public rank file and every single byte, by length;
    those of up to ``PACKED`` bytes as packed integers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            found = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        found = {p for p in found if p} | {bytes([b]) for b in range(256)}
        self.pieces = sorted(found, key=lambda p: (len(p), p))
        self.n = len(self.pieces)
        self.longest = len(self.pieces[-1])
        self.keys, self.first, at = {}, {}, 0
        for size in range(1, PACKED + 1):
            same = [p for p in self.pieces if len(p) == size]
            self.keys[size] = np.array([int.from_bytes(p, "big") for p in same], dtype=np.uint64)
            self.first[size], at = at, at + len(same)
        self.long = {p: at + k for k, p in enumerate(self.pieces[at:])}
        self.heads = np.unique(np.array([int.from_bytes(p[:PACKED], "big") for p in self.long], dtype=np.uint64))
        self.long_sizes = sorted({len(p) for p in self.long})

    def ids(self, words: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: ``(start, size)`` to the piece each word
        has there, ``n`` where it is none."""
        return self.ids_at(np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1))

    def ids_at(self, bytes_: np.ndarray, starts: int | None = None) -> dict[tuple[int, int], np.ndarray]:
        """The same for rows of bytes and the first ``starts`` places only."""
        n = bytes_.shape[1]
        starts = n if starts is None else min(starts, n)
        raw = bytes_.astype(np.uint64)
        out, packed = {}, raw
        for size in range(1, min(PACKED, n) + 1):
            if size > 1:
                packed = (packed[:, :n - size + 1] << np.uint64(8)) | raw[:, size - 1:]
            keys = self.keys[size]
            if not len(keys):
                continue
            some = packed[:, :starts]
            at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
            got = np.where(keys[at] == some, at + self.first[size], self.n)
            for start in range(got.shape[1]):
                out[start, size] = got[:, start]
        if n > PACKED and len(self.heads):
            some = packed[:, :starts]
            at = np.minimum(np.searchsorted(self.heads, some), len(self.heads) - 1)
            for row, start in zip(*(x.tolist() for x in np.nonzero(self.heads[at] == some))):
                rest = bytes_[row, start:start + self.longest].tobytes()
                for size in self.long_sizes:
                    if size > len(rest):
                        break
                    piece = self.long.get(rest[:size])
                    if piece is not None:
                        if (start, size) not in out:
                            out[start, size] = np.full(len(raw), self.n)
                        out[start, size][row] = piece
        return out

    def forward(self, ids: dict, n: int, p: np.ndarray) -> list[np.ndarray]:
        """Probability of every prefix, summed over its segmentations. ``p``
        has a row per piece and a last row of zeros."""
        some = next(iter(ids.values()))
        alpha = [np.ones((len(some), *p.shape[1:]))]
        for end in range(1, n + 1):
            alpha.append(sum(alpha[end - size] * p[ids[end - size, size]]
                             for size in range(1, min(self.longest, end) + 1) if (end - size, size) in ids))
        return alpha

    def expected(self, words: list[bytes], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words of one length (weighted)."""
        n, ids = len(words[0]), self.ids(words)
        alpha = self.forward(ids, n, p)
        beta = [None] * n + [np.ones(len(words))]
        for start in range(n - 1, -1, -1):
            beta[start] = sum(beta[start + size] * p[ids[start, size]]
                              for size in range(1, min(self.longest, n - start) + 1) if (start, size) in ids)
        out = np.zeros(self.n + 1)
        for (start, size), at in ids.items():
            out += np.bincount(at, alpha[start] * p[at] * beta[start + size] * weight / alpha[n], self.n + 1)
        return out[:-1]

    def places(self, words: list[bytes], backward: bool = False):
        """For words of any lengths, padded to the longest: ``(start, [(size,
        piece of each word)])`` for every start, segment by segment."""
        n = max(map(len, words))
        rows = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(len(words), n)
        cuts = list(range(0, n, SEGMENT))
        for lo in reversed(cuts) if backward else cuts:
            count = min(SEGMENT, n - lo)
            by: dict[int, list] = {}
            for (start, size), at in self.ids_at(rows[:, lo:lo + count + self.longest - 1], count).items():
                by.setdefault(start, []).append((size, at))
            for start in reversed(range(count)) if backward else range(count):
                yield lo + start, by[start]

    def log_forward(self, words: list[bytes], p: np.ndarray, keep: bool = False):
        """Log-probability of whole words of any lengths: the forward sums with
        a window of states carried along and rescaled. With ``keep`` also the
        state and the scale at every place."""
        size_of = np.array([len(w) for w in words])
        shape = (len(words), *p.shape[1:])
        window, scale, out = {0: np.ones(shape)}, np.zeros(shape), np.empty(shape)
        states, scales = [], []
        n = int(size_of.max())
        for start, pieces in self.places(words):
            a = window.pop(start)
            if keep:
                states.append(a)
                scales.append(scale.copy())
            done = size_of == start
            out[done] = np.log(a[done]) + scale[done]
            for size, at in pieces:
                if start + size <= n:
                    window[start + size] = window.get(start + size, 0.0) + a * p[at]
            if start % RESCALE == 0:
                most = np.max(list(window.values()), axis=0)
                window = {k: v / most for k, v in window.items()}
                scale = scale + np.log(most)
        done = size_of == n
        out[done] = np.log(window[n][done]) + scale[done]
        return (out, states, scales) if keep else out

    def log_expected(self, words: list[bytes], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """:meth:`expected` for words of any lengths, one language."""
        whole, states, scales = self.log_forward(words, p, keep=True)
        size_of, out = np.array([len(w) for w in words]), np.zeros(self.n + 1)
        window: dict[int, np.ndarray] = {int(size_of.max()): (size_of == size_of.max()).astype(float)}
        scale = np.zeros(len(words))
        for start, pieces in self.places(words, backward=True):
            total = np.zeros(len(words))
            share = np.exp(scales[start] + scale - whole) * states[start] * weight
            for size, at in pieces:
                if start + size in window:
                    part = p[at] * window[start + size]
                    total += part
                    out += np.bincount(at, part * share, self.n + 1)
            window[start] = np.where(size_of == start, 1.0, np.where(size_of > start, total, 0.0))
            window.pop(start + self.longest, None)
            if start % RESCALE == 0:
                most = np.max(list(window.values()), axis=0)
                most[most == 0] = 1.0
                window = {k: v / most for k, v in window.items()}
                scale = scale + np.log(most)
        return out[:-1]


def long_groups(words: list[bytes], most: int = 2_000_000) -> list[list[int]]:
    """Words beyond ``SHORT`` bytes in groups of about the same length, of
    about ``most`` bytes."""
    at = sorted((k for k, w in enumerate(words) if len(w) > SHORT), key=lambda k: len(words[k]))
    out: list[list[int]] = []
    for k in at:
        if out and len(words[k]) <= 1.25 * len(words[out[-1][0]]) and len(words[k]) * (len(out[-1]) + 1) <= most:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def by_length(words: list[bytes]) -> dict[int, list[int]]:
    """Words of up to ``SHORT`` bytes by their length."""
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) <= SHORT:
            out.setdefault(len(w), []).append(k)
    return out


class Scorer:
    """Log-probabilities of words under every language, kept by word."""

    def __init__(self, path: str, p: np.ndarray, prior: np.ndarray):
        self.pieces = Pieces(path)
        self.p = np.vstack([p, np.zeros((1, p.shape[1]))])
        self.prior = np.log(prior)
        self.most = max(1000, CACHE_BYTES // (8 * p.shape[1] + 160))
        self.at: dict[str, int] = {}
        self.logs = np.empty((0, p.shape[1]))

    def learn(self, words: list[str]) -> None:
        flat = [as_bytes(w) for w in words]
        logs = np.empty((len(flat), self.p.shape[1]))
        for n, some in by_length(flat).items():
            for lo in range(0, len(some), 16384):
                at = some[lo:lo + 16384]
                group = [flat[k] for k in at]
                logs[at] = np.log(self.pieces.forward(self.pieces.ids(group), n, self.p)[n])
        for at in long_groups(flat):
            logs[at] = self.pieces.log_forward([flat[k] for k in at], self.p)
        base = len(self.logs)
        self.logs = np.vstack([self.logs, logs])
        self.at.update(zip(words, range(base, base + len(words))))

    def __call__(self, texts: list[str]) -> list[tuple[int, float]]:
        """Index and posterior probability of the best language; -1 without
        letters."""
        words = [words_of(t) for t in texts]
        new = set().union(*[set(w).difference(self.at) for w in words])
        if len(self.at) + len(new) > self.most:
            self.at, self.logs = {}, self.logs[:0]
            new = set().union(*words)
        if new:
            self.learn(list(new))
        out = []
        for ws in words:
            if not ws:
                out.append((-1, 0.0))
                continue
            total = self.prior + self.logs[list(map(self.at.__getitem__, ws))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((best, float(1.0 / np.exp(total - total[best]).sum())))
        return out


def scorer(key: str, data, path: str) -> Scorer:
    """The scorer of a broadcast model, built once in a Python worker."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(path, *data.value)
    return _SCORERS[key]


def fit(docs: DataFrame, path: str, id_col: str, text_col: str, lang_col: str,
        per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities (pieces x languages) and priors.

    Word counts of the sampled documents are gathered once; every round sums
    expected piece counts over them (forward and backward over all
    segmentations). What reaches the driver is a number per piece of the fixed
    vocabulary and language.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.filter(trainable(col(id_col)) & col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(col(lang_col).cast("string")).count().collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return [], np.empty((0, 0)), np.empty(0)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))])
    lang = col(lang_col).cast("string")
    draw = F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(1 << 24)) / float(1 << 24)
    sample = known.filter(draw < share[lang]).select(lang.alias("lang"), col(text_col).cast("string").alias("text"))

    def count(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(g, Counter()).update(words_of(text or ""))
        for g, c in seen.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(c)), pa.array(list(c.keys())),
                                                  pa.array(list(c.values()), type=pa.int64())], names=["lang", "word", "n"])

    words = saved(sample.mapInArrow(count, "lang string, word string, n long")
                  .groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    size = Pieces(path).n
    p = np.full((size, len(langs)), 1.0 / size)

    for _ in range(rounds):
        data = spark.sparkContext.broadcast(p)

        def expect(batches, data=data):
            pieces, p = Pieces(path), np.vstack([data.value, np.zeros((1, len(langs)))])
            total = np.zeros((len(langs), size))
            for batch in batches:
                rows: dict[str, tuple[list, list]] = {}
                for g, w, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    rows.setdefault(g, ([], []))[0].append(as_bytes(w))
                    rows[g][1].append(n)
                for g, (flat, weight) in rows.items():
                    k, weight = langs.index(g), np.array(weight, dtype=float)
                    for some in by_length(flat).values():
                        total[k] += pieces.expected([flat[i] for i in some], weight[some], p[:, k])
                    for some in long_groups(flat):
                        total[k] += pieces.log_expected([flat[i] for i in some], weight[some], p[:, k])
            k, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)),
                                              pa.array(total[k, at])], names=["k", "piece", "n"])

        counts = np.zeros((size, len(langs)))
        for r in words.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(
                F.sum("n").alias("n")).collect():  # pieces x languages at most
            counts[r[1], r[0]] = r[2]
        pooled = counts.sum(axis=1) + 0.01
        pooled /= pooled.sum()
        p = (counts + POOLED * pooled[:, None]) / (counts.sum(axis=0) + POOLED)
    prior = np.array([sizes[g] for g in langs], dtype=float)
    return langs, p, prior / prior.sum()


def languages(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per input row: ``id_col, held_out, lang_pred, score``.

    The model is learned from rows with a label whose id is not held out (see
    :func:`held_out`); the label is no input of a prediction. ``lang_pred`` is
    a learned label, ``score`` its posterior probability. Null texts, and
    texts without letters, give ``und`` and 0, as does every text if nothing
    can be learned. Null ids are neither held out nor learned from; repeated
    rows are judged alike; an empty table gives an empty result; other columns
    are not read. Whole texts are scored.
    """
    langs, p, prior = fit(docs, path, id_col, text_col, lang_col, per_language)
    rows = docs.select(col(id_col).alias("id"), held_out(col(id_col)).alias("held_out"),
                       col(text_col).cast("string").alias("text"))
    if not langs:
        return rows.select(F.col("id").alias(id_col), "held_out", F.lit("und").alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    data, key = docs.sparkSession.sparkContext.broadcast((p, prior)), uuid.uuid4().hex

    def make():
        score = scorer(key, data, path)

        def run(batch):
            names, scores = [], []
            for some in blocks(texts_of(batch, 2)):
                for k, s in score(some):
                    names.append("und" if k < 0 else langs[k])
                    scores.append(s)
            return [names, scores]
        return run

    fields = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_batches(rows, make, fields).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
