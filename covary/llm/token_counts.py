"""Token counts by dynamic programming over prefixes."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from covary.llm._common import col, map_batches
from covary.llm.bpe import ByteBPE, blocks, forget, texts_of

#: Bounds of a Python worker's caches; beyond them they start anew.
CACHE_UNITS = 300_000
CACHE_PREFIXES = 700_000
CACHE_PAIRS = 1_000_000

_COUNTERS: dict = {}


class PrefixCounter:
    """Exact BPE token counts of every prefix of a pre-token.

    A sequence of tokens is what BPE yields for its bytes if and only if BPE
    yields each adjacent pair for the pair's bytes. So the last token of a
    prefix is the one vocabulary entry that ends there and stands that test
    against the last token of the prefix before it; its count is one more
    than that prefix's.
    """

    def __init__(self, path: str):
        self.bpe = bpe = ByteBPE(path)
        self.made = {m: (r, a, b) for (a, b), (r, m) in bpe.ranks.items()}  # token: rank, halves
        # every tail of a token: its id if it is one itself, else -1
        self.tails = {t[k:]: -1 for t in bpe.ids for k in range(len(t))} | bpe.ids
        self.edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.stands: dict[int, bool] = {}
        self.state: dict[bytes, int] = {}  # prefix: count << 32 | last token
        self.counts: dict[str, int] = {}

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of ``token`` while it is built,
        each with the rank of the merge that consumes it."""
        out = self.edges.get((token, right))
        if out is None:
            out, at, until = [], token, len(self.bpe.ranks)
            while True:
                out.append((at, until))
                if at not in self.made:
                    break
                until, a, b = self.made[at]
                at = b if right else a
            self.edges[token, right] = out  # two lists per token at most
        return out

    def pair_stands(self, left: int, right: int) -> bool:
        """Whether no merge joins the two while both are built: a merge across
        the border happens if its rank comes before the merges that consume
        its halves (of equal ranks, the one on the left comes first)."""
        code = left << 32 | right
        known = self.stands.get(code)
        if known is None:
            known = True
            for a, a_until in self._edge(left, True):
                for b, b_until in self._edge(right, False):
                    hit = self.bpe.ranks.get((a, b))
                    if hit is not None and hit[0] < a_until and hit[0] <= b_until:
                        known = False
            if len(self.stands) >= CACHE_PAIRS:
                self.stands.clear()
            self.stands[code] = known
        return known

    def prefixes(self, word: bytes) -> list[int]:
        """The token count of every prefix, the empty one first."""
        tails, n = self.tails.get, len(word)
        last, count = [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - 1, -1, -1):
                token = tails(word[start:end])
                if token is None:
                    break  # no token ends like this, nor any longer one
                if token >= 0 and (not start or self.pair_stands(last[start], token)):
                    last[end], count[end] = token, count[start] + 1
                    break
        return count

    def word_count(self, word: bytes) -> int:
        """The tokens of a pre-token. The prefixes of short ones are kept, so
        that a word goes on from the longest prefix that was seen before."""
        n, state = len(word), self.state
        if n > 64:
            return self.prefixes(word)[-1]
        if len(state) > CACHE_PREFIXES:
            state.clear()
        known = n
        while known and word[:known] not in state:
            known -= 1
        tails, stands = self.tails.get, self.stands.get
        for end in range(known + 1, n + 1):
            for start in range(end - 1, -1, -1):
                token = tails(word[start:end])
                if token is None:
                    break
                if token < 0:
                    continue
                if not start:
                    state[word[:end]] = 1 << 32 | token
                    break
                before = state[word[:start]]
                last = before & 0xFFFFFFFF
                known = stands(last << 32 | token)
                if self.pair_stands(last, token) if known is None else known:
                    state[word[:end]] = (before >> 32) + 1 << 32 | token
                    break
        return state[word] >> 32

    def unit_counts(self, units: list[str]) -> list[int]:
        counts = self.counts
        new = set(units).difference(counts)
        for u in new:
            counts[u] = self.unit_count(u)
        out = list(map(counts.__getitem__, units))
        forget(counts, new, CACHE_UNITS)
        return out

    def unit_count(self, unit: str) -> int:
        return sum([self.word_count(w.encode("utf-8", "replace")) for w in self.bpe.pretokens(unit)])

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """The counts of one text at every unit border, and by way of the counter
    at every prefix in between: questions touch one unit, not the text."""

    def __init__(self, counter: PrefixCounter, text: str):
        bpe, self.counter = counter.bpe, counter
        self.special: set[int] = set()
        self.units: list[str] = []
        counts: list[int] = []
        for special, part in bpe.parts(text):
            if special:
                self.special.add(len(self.units))
            units = [part] if special else bpe.units(part)
            self.units += units
            counts += [1] if special else counter.unit_counts(units)
        self.chars = [0, *accumulate(map(len, self.units))]
        self.tokens = [0, *accumulate(counts)]

    @property
    def total(self) -> int:
        return self.tokens[-1]

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        k = bisect_right(self.chars, max(0, chars)) - 1
        if k >= len(self.units):
            return self.total
        head = self.units[k][:max(0, chars) - self.chars[k]]
        # a cut special string is ordinary text, and joins what stands before it
        if k in self.special and head:
            j = k
            while j and j - 1 not in self.special and not self.units[j][:1].isspace():
                j -= 1
            joined = "".join(self.units[j:k]) + head
            return self.tokens[j] + sum(self.counter.unit_counts(self.counter.bpe.units(joined)))
        return self.tokens[k] + self.counter.unit_count(head)

    def fit(self, budget: int) -> int:
        """The most characters whose tokens do not exceed ``budget``."""
        if self.total <= budget:
            return self.chars[-1]
        k = bisect_right(self.tokens, budget) - 1  # the first unit that ends beyond the budget
        unit, at, left, c = self.units[k], self.chars[k], budget - self.tokens[k], self.counter
        if k in self.special:
            return max([n for n in range(len(unit)) if self.count(at + n) <= budget], default=0) + at
        blank = len(unit) - len(unit.lstrip())
        best, done = _within(c.prefixes(unit[:blank].encode()), unit[:blank], left), 0
        for word in c.bpe.pretokens(unit):
            n = c.word_count(word.encode("utf-8", "replace"))
            if n > left:
                if word.startswith("'") and len(word) <= 3:  # a cut contraction is none
                    inside = max(m for m in range(len(word)) if self.count(at + done + m) <= budget)
                else:
                    inside = _within(c.prefixes(word.encode("utf-8", "replace")), word, left)
                if done + inside > blank:
                    best = max(best, done + inside)
                break
            left, done = left - n, done + len(word)
            if done > blank:
                best = max(best, done)
        return at + best


def _within(counts: list[int], word: str, budget: int) -> int:
    """The most characters of ``word`` within a budget, given the counts of
    its prefixes in bytes."""
    best = size = 0
    for k, ch in enumerate(word, 1):
        size += len(ch.encode("utf-8", "replace"))
        if counts[size] <= budget:
            best = k
    return best


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_tokens, over_limit,
    fit_chars`` (the longest prefix, in characters, with at most ``limit``
    tokens).

    Special strings of the vocabulary in a text count as one token. Null and
    empty texts count zero; null and repeated ids are kept as they are; an
    empty table gives an empty result; other columns are not read. Whole
    texts are counted, whatever their length.
    """
    fields = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType()),
                         StructField("over_limit", BooleanType()), StructField("fit_chars", LongType())])

    def make():
        c = counter(path)

        def run(batch):
            out = []
            for some in blocks(texts_of(batch, 1)):
                for text in some:
                    t = c.table(text)
                    out.append((len(text.encode("utf-8", "replace")), t.total, t.total > limit, t.fit(limit)))
            return list(zip(*out)) if out else [[], [], [], []]
        return run

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, fields).select(F.col("id").alias(id_col), *fields.names)
