"""Toxicity: a learned lexicon, matched through a Levenshtein automaton, with
scores of the context of each hit."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from covary.llm._common import col, fresh, map_batches, saved, ship
from covary.llm.bpe import blocks
from covary.llm.langid import held_out, trainable

#: Labelled documents the fit reads, chosen by a hash of the id.
SAMPLE = 30_000
#: Terms of the lexicon, and what makes a term: its log-odds, and the share of
#: chance finds among terms in about as many documents that stand out as much.
TERMS = 2000
LOG_ODDS = 2.5
CHANCE = 0.2
#: Lengths of stems (a stem stands for all words that begin with it).
STEMS = range(4, 9)
#: Terms from these lengths on also match with one edit, and with two.
ONE_EDIT, TWO_EDITS = 4, 8
#: What a misspelled hit is thought to be worth before any is seen, and how
#: many documents that belief counts for.
MISSPELLED = 0.6
BELIEF = 2.0
#: Coefficients of the features before any document is seen: weights are
#: log-odds and features fifths of them, so the strongest hit counts in full.
BELIEVED = (0.0, 5.0)
#: Beyond this sum more hits make no difference.
MOST_WEIGHT = 30.0
THRESHOLD = 0.3
#: A text without a hit scores at most this share of the threshold: however
#: many of the labels are 1, only what is in a text can make it toxic.
NO_HIT = 0.8
#: Characters on each side of a hit that make its context.
CONTEXT = 60
#: What being in quotation marks, near a verb of reporting and near somebody
#: addressed multiplies the weight of a hit with, before any label is seen; the
#: price of a factor twice or half as large, in nats; and the half powers of
#: two by which the labels may change it.
CONTEXTS = (0.4, 0.6, 1.4)
DOUBT = 2.0
HALVES = range(-8, 5)
TURNS = 20
CACHE_WORDS = 400_000
#: Words longer than this are not kept.
LONGEST_WORD = 64
MOST_STATES = 100_000

WORD = re.compile(r"\w+")
QUOTE = re.compile(r"[\"“”„«»‹›‘]|(?<!\w)'|'(?!\w)")
REPORT = re.compile(r"\b(?:said|says|wrote|writes|called|quote[sd]?|quoting|reported|claimed|sagte|sagt|schrieb|nannte|"
                    r"zitiert|dit|écrit|appelé|cite|dijo|dice|escribió|llamó|cita)\b")
ADDRESS = re.compile(r"\b(?:you|your|youre|u|du|dich|dir|dein|deine|ihr|euch|tu|toi|te|vous|votre|tú|ti|usted|ustedes|eres)\b")

_MATCHERS: dict = {}


class Lexicon:
    """A trie of terms intersected with Levenshtein automata, as one lazily
    built deterministic automaton. Its states are sets of (trie node, edits so
    far); every letter may be edited, the first one too."""

    def __init__(self, terms: list[tuple[str, bool, int]]):
        """``terms``: text, whether it is a stem, edits allowed."""
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[dict[int, int]] = [{}]  # node: term -> edits allowed
        self.stem: list[dict[int, int]] = [{}]
        self.most = [0]
        self.size = [len(t) for t, _, _ in terms]
        for k, (text, is_stem, edits) in enumerate(terms):
            node = 0
            for c in text:
                self.most[node] = max(self.most[node], edits)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append({})
                    self.stem.append({})
                    self.most.append(0)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], edits)
            (self.stem if is_stem else self.whole)[node][k] = edits
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, int, int] | None] = []
        self.sticks: list[tuple[int, int, int] | None] = []
        self.start = self.state({0: 0})

    def state(self, least: dict[int, int]) -> int:
        todo = list(least.items())
        while todo:  # a letter of the term that the word lacks
            node, e = todo.pop()
            if e < self.most[node]:
                for child in self.children[node].values():
                    if e + 1 < least.get(child, 9) and e + 1 <= self.most[child]:
                        least[child] = e + 1
                        todo.append((child, e + 1))
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            for table, out in ((self.whole, self.ends), (self.stem, self.sticks)):
                hits = [(e, -self.size[k], k) for node, e in key for k, most in table[node].items() if e <= most]
                out.append(min(hits) if hits else None)
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, e in self.sets[state]:
            child = self.children[node].get(c)
            moves = [] if child is None else [(child, e)]
            if e < self.most[node]:
                moves += [(node, e + 1), *((x, e + 1) for x in self.children[node].values())]
            for x, cost in moves:
                if cost <= self.most[x] and cost < least.get(x, 9):
                    least[x] = cost
        out = self.steps[state][c] = self.state(least) if least else -1
        return out

    def match(self, word: str) -> tuple[int, int, int] | None:
        """(edits, -length, term) of the best term, fewest edits first and
        then the longest, or None."""
        if len(self.sets) > MOST_STATES:
            self.reset()
        state, best = self.start, None
        for c in word:
            nxt = self.steps[state].get(c)
            state = self.step(state, c) if nxt is None else nxt
            if state < 0:
                return best
            hit = self.sticks[state]
            if hit is not None and (best is None or hit < best):
                best = hit
        hit = self.ends[state]
        return hit if best is None or (hit is not None and hit < best) else best


def context_marks(text: str, start: int, end: int) -> int:
    """The contexts of a hit as bits: 1 in quotation marks, 2 near a verb of
    reporting, 4 near somebody addressed."""
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    return ((QUOTE.search(before) is not None and QUOTE.search(after) is not None)
            + 2 * (REPORT.search(before) is not None or REPORT.search(after) is not None)
            + 4 * (ADDRESS.search(before) is not None or ADDRESS.search(after) is not None))


def factors(contexts: tuple[float, ...]) -> list[float]:
    """The factor of each combination of :func:`context_marks`."""
    return [math.prod(c for k, c in enumerate(contexts) if marks >> k & 1) for marks in range(1 << len(contexts))]


def edits_of(text: str) -> int:
    """Edits with which a term of this length still matches."""
    return (len(text) >= ONE_EDIT) + (len(text) >= TWO_EDITS)


class Matcher:
    """Hits of a lexicon in whole texts. Terms are (text, is stem, weight of
    an exact hit, weight of a misspelled one); ``forms`` has the weights of
    misspelled words that are known, and those of no weight are no hits;
    ``contexts`` what the contexts of a hit do to its weight."""

    def __init__(self, terms: list[tuple[str, bool, float, float]], forms: dict[str, float] | None = None,
                 contexts: tuple[float, ...] = CONTEXTS):
        self.lexicon = Lexicon([(t, s, edits_of(t)) for t, s, _, _ in terms])
        self.factors = factors(contexts)
        self.weights = [w[2:] for w in terms]
        self.forms = forms or {}
        self.known: dict[str, tuple[int, int, int] | None] = {}

    def weight(self, word: str, hit: tuple[int, int, int]) -> float:
        weight = self.weights[hit[2]][hit[0] > 0]
        return self.forms.get(word, weight) if hit[0] else weight

    def match(self, word: str) -> tuple[int, int, int] | None:
        hit = self.lexicon.match(word)
        return hit if hit is not None and self.weight(word, hit) > 0 else None

    def hit(self, word: str) -> tuple[int, int, int] | None:
        if len(word) > LONGEST_WORD:
            return self.match(word)
        if word not in self.known:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = self.match(word)
        return self.known[word]

    def spans(self, text: str) -> list[tuple[int, int, int, int, bool, float]]:
        """Hits: start, end, term, edits, quoted, weight of the context."""
        return [(*x[1:5], x[5] & 3 > 0, self.factors[x[5]]) for x in self.found(text)]

    def found(self, text: str) -> list[tuple[str, int, int, int, int, int]]:
        """The hits: word, start, end, term, edits, marks of the context."""
        low = text.lower()
        if len(low) != len(text):  # a letter that grows in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = {w: h for w in set(WORD.findall(low)) if (h := self.hit(w)) is not None}
        if not found:
            return []
        out = []
        for m in WORD.finditer(low):
            h = found.get(m.group())
            if h is not None:
                out.append((m.group(), m.start(), m.end(), h[2], h[0], context_marks(low, m.start(), m.end())))
        return out

    def by_context(self, found: list) -> list[float]:
        """The sum and then the largest of the weights of the hits in each
        combination of contexts."""
        n = len(self.factors)
        out = [0.0] * (2 * n)
        for x in found:
            w = self.weight(x[0], (x[4], 0, x[3]))
            out[x[5]] += w
            out[n + x[5]] = max(out[n + x[5]], w)
        return out

    def features(self, found: list) -> list[float]:
        """The weights of the hits, each as its context says: their sum, and
        the largest, as one hit can be enough."""
        each = [self.factors[x[5]] * self.weight(x[0], (x[4], 0, x[3])) for x in found]
        return [min(sum(each), MOST_WEIGHT) / 5, min(max(each, default=0.0), MOST_WEIGHT) / 5]


def matcher(key: str, data) -> Matcher:
    """The matcher of a broadcast model, built once in a Python worker."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(*data.value)
    return _MATCHERS[key]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """``(text, toxic)`` of about ``most`` labelled rows at most, near copies
    left out (one row per smallest five-word shingle)."""
    known = labels.filter(trainable(col(id_col)) & col(label_col).isNotNull()).groupBy(
        col(id_col).alias("k")).agg(F.max(col(label_col).cast("int")).alias("toxic"))
    known = saved(known, "tox-labels")
    share = min(1.0, most / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 24)) < share * (1 << 24))
    rows = docs.select(col(id_col).alias("k"), col(text_col).cast("string").alias("text")).join(
        F.broadcast(drawn), "k").filter("text IS NOT NULL").select("text", "toxic")  # bounded by ``most``

    def make():
        import xxhash

        def run(batch):
            out = []
            for text in batch.column(0).to_pylist():
                w = text.split()
                out.append(min(xxhash.xxh64_intdigest(" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))) >> 1)
            return [out]
        return run

    keyed = map_batches(rows, make, StructType([StructField("shingle", LongType())]))
    return saved(keyed.groupBy("shingle").agg(F.max_by("text", F.xxhash64("text")).alias("text"),
                                              F.max("toxic").alias("toxic")).select("text", "toxic"), "tox-sample")


def tail(a: int, n: int, p: float) -> float:
    """Chance of ``a`` or more out of ``n``."""
    if p >= 1:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1)
                    + a * math.log(p) + (n - a) * math.log1p(-p))
    total = 0.0
    for k in range(a, n + 1):
        total += term
        term *= (n - k) / (k + 1) * p / (1 - p)
        if term < 1e-12 * total:
            break
    return min(1.0, total)


def chances(sizes: dict[tuple[bool, int], int], share: dict[bool, float],
            found: list[tuple[bool, int, int, int, int]]) -> dict[tuple[bool, int, int], float]:
    """The false discovery rate (Benjamini-Hochberg) of ``found`` (is stem,
    band, documents, toxic ones, number of such terms), each among the terms
    of its band. ``sizes``: the terms of a band, ``share``: toxic documents
    among those of all terms."""
    out, bands = {}, {}
    for stem, band, n, a, terms in found:
        bands.setdefault((stem, band), []).append((tail(a, n, share[stem]), n, a, terms))
    for (stem, band), rows in bands.items():
        rows.sort()
        at = list(accumulate(r[3] for r in rows))
        least = 1.0
        for (p, n, a, _), rank in zip(reversed(rows), reversed(at)):
            least = min(least, p * sizes[stem, band] / rank)
            out[stem, n, a] = least
    return out


def learn_lexicon(sample: DataFrame, most: int = TERMS) -> list[tuple[str, bool, float, float]]:
    """Terms (text, is stem, weight): words and stems that are in far more
    toxic documents than chance would have it, whatever the size of the
    sample; weights shrink by the rate of chance finds. A stem whose documents nearly
    all share a longer term gives way to that, and a term that a remaining
    shorter stem stands for is left out."""
    def count(batches):
        tox: Counter = Counter()
        clean: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                terms = {w for w in words if 3 <= len(w) <= 40}
                terms |= {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                (tox if y else clean).update(terms)
        for some in (tox, clean):
            keys = list(some)
            for lo in range(0, len(keys), 50_000):
                k = keys[lo:lo + 50_000]
                n = pa.array([some[x] for x in k], type=pa.int64())
                zero = pa.array([0] * len(k), type=pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(k), n if some is tox else zero, zero if some is tox else n],
                                                 names=["term", "a", "b"])

    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    t, c = totals.get(1, 0), totals.get(0, 0)
    if not t or not c:
        return []
    ship(sample.sparkSession)
    n, p = F.col("a") + F.col("b"), t / (t + c)
    ln = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    weight = F.log((F.col("a") + 0.5) / (t + 1)) - F.log((F.col("b") + 0.5) / (c + 1))
    stem, total = F.col("term").endswith("*").alias("stem"), F.sum("n").alias("total")
    band = F.floor(2 * F.log2("n")).cast("int").alias("band")
    counted = saved(sample.mapInArrow(count, "term string, a long, b long").groupBy("term")
                    .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a + b >= 2")
                    .withColumn("n", n), "tox-terms")
    bands = counted.groupBy(stem, band).agg(F.count("*").alias("terms"), F.sum("a").alias("a"), total).collect()
    share = {s: sum(r.a for r in bands if r.stem == s) / sum(r.total for r in bands if r.stem == s)
             for s in {r.stem for r in bands}}
    telling = (counted.select("term", "a", "b", "n", stem, band, weight.alias("w"),
                              (2 * (ln(F.col("a"), n * p) + ln(F.col("b"), n * (1 - p)))).alias("g"))
               .filter((F.col("a") >= 2) & (F.col("w") >= LOG_ODDS)))
    alike = telling.groupBy("stem", "band", "n", "a").count().collect()  # few: a pair of counts each
    chance = chances({(r.stem, r.band): r.terms for r in bands}, share, [tuple(r) for r in alike])
    low = [(s, n, a) for (s, n, a), q in chance.items() if q <= CHANCE]
    rows = [] if not low else telling.join(F.broadcast(sample.sparkSession.createDataFrame(
        low, "stem boolean, n long, a long")), ["stem", "n", "a"]).orderBy(
        F.desc("g"), "term").limit(4 * most).collect()  # a lexicon of bounded size
    found: dict[str, tuple[bool, float, float]] = {}
    for r in rows:
        found[r.term] = (r.stem, r.w * (1 - chance[r.stem, r.n, r.a]), r.g)
    # of a stem and a longer term that is as telling the longer one is the term
    for term, (_, _, g) in list(found.items()):
        text = term.rstrip("*")
        for k in STEMS:
            stem = text[:k] + "*"
            if stem != term and k <= len(text) and stem in found and g >= 0.97 * found[stem][2]:
                del found[stem]
    out = []
    for term, (stem, w, g) in found.items():
        text = term.rstrip("*")
        shorter = [found[text[:k] + "*"] for k in STEMS if k < len(text) and text[:k] + "*" in found]
        if not any(s[1] >= w - 1.0 for s in shorter):
            out.append((text, stem, float(w), MISSPELLED * float(w)))
    return out[:most]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50,
             believed: tuple[float, ...] | None = None) -> np.ndarray:
    """Bias and non-negative coefficients of a logistic regression, the
    coefficients drawn towards ``believed`` (zeros by default)."""
    prior = np.concatenate(([0.0], believed or np.zeros(x.shape[1])))
    z = np.hstack([np.ones((len(x), 1)), x])
    on = np.ones(z.shape[1], dtype=bool)
    while True:
        beta = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            ridge = np.where(np.arange(len(beta)) > 0, penalty, 1e-6)
            grad = z.T @ (p - y) + ridge * (beta - prior)
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.zeros(len(beta))
            step[on] = np.linalg.solve(hess[np.ix_(on, on)], grad[on])
            step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            beta -= step
            if np.abs(step).max() < 1e-8:
                break
        low = on & (beta < 0)
        low[0] = False
        if not low.any():
            return beta
        on &= ~low


def learned_contexts(weights: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], np.ndarray]:
    """The factors of the contexts, and bias and coefficients of the features,
    from what :meth:`Matcher.by_context` gives for each document.

    They are fitted in turns, coefficients by :func:`logistic` and each factor
    as that step of a half power of two from ``CONTEXTS`` that makes the
    labels likeliest after the price of ``DOUBT`` for leaving what was
    believed; so no turn makes the fit worse, and a context that no label says
    anything about keeps its factor.
    """
    n = weights.shape[1] // 2
    sums, tops = weights[:, :n], weights[:, n:]

    def features(contexts) -> np.ndarray:
        by = np.array(factors(contexts))
        return np.minimum(np.stack([(sums * by).sum(axis=1), (tops * by).max(axis=1)], axis=1), MOST_WEIGHT) / 5

    def cost(contexts, beta) -> float:
        z = beta[0] + features(contexts) @ beta[1:]
        doubt = sum(math.log2(c / before) ** 2 for c, before in zip(contexts, CONTEXTS))
        return float((np.logaddexp(0, z) - y * z).sum()) + DOUBT * doubt

    contexts, best = CONTEXTS, logistic(features(CONTEXTS), y, believed=BELIEVED)
    for _ in range(TURNS):
        before = contexts
        for k in range(len(contexts)):
            steps = [(*contexts[:k], CONTEXTS[k] * 2 ** (s / 2), *contexts[k + 1:]) for s in HALVES]
            contexts = min(steps, key=lambda c: (cost(c, best), abs(math.log2(c[k] / CONTEXTS[k]))))
        if contexts == before:
            break
        best = logistic(features(contexts), y, believed=BELIEVED)
    return contexts, best


class Model:
    """A lexicon with its weights, those of known misspelled words, bias and
    coefficients of the features, and the factors of the contexts."""

    def __init__(self, terms: list[tuple[str, bool, float, float]], forms: dict[str, float], beta: list[float],
                 contexts: tuple[float, ...] = CONTEXTS):
        self.terms, self.forms, self.beta, self.contexts = terms, forms, beta, contexts


def weighed(terms: list, base: float, exact: dict[int, tuple[float, float]], votes: dict[int, tuple[float, float]],
            seen: list[tuple[str, int, float, float]]) -> tuple[list[tuple[str, bool, float, float]], dict[str, float]]:
    """The terms with the log-odds of the hits they really got (a word counts
    for its longest term), drawn towards what was believed before, and the
    weights of the misspelled words that were ``seen`` (word, term, toxic and
    clean documents), drawn towards that of their term; a weight below zero
    becomes zero. ``votes`` are those of the misspelled words of a term."""
    def weight(before: float, a: float, b: float) -> float:
        q = 1 / (1 + math.exp(-(base + before)))
        p = (a + BELIEF * q) / (a + b + BELIEF)
        return max(0.0, math.log(p / (1 - p)) - base)

    out = []
    for k, (text, stem, before, _) in enumerate(terms):
        w = weight(before, *exact.get(k, (0, 0)))
        out.append((text, stem, w, weight(MISSPELLED * w, *votes.get(k, (0, 0)))))
    return out, {word: weight(out[k][3], a, b) for word, k, a, b in seen}


def hit_counts(sample: DataFrame, terms: list) -> DataFrame:
    """``term, form, a, b``: toxic and clean documents with a term (no form),
    and with each misspelled word that matches it."""
    data, key = sample.sparkSession.sparkContext.broadcast((terms,)), uuid.uuid4().hex
    ship(sample.sparkSession)

    def count(batches):
        m = matcher(key, data)
        seen: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = {(w, h) for w in set(WORD.findall(text.lower())) if (h := m.hit(w)) is not None}
                seen.update({(h[2], w if h[0] else None, y > 0) for w, h in hits})
        rows = [(k, w, n * y, n * (not y)) for (k, w, y), n in seen.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            names=["term", "form", "a", "b"])

    return saved(sample.mapInArrow(count, "term int, form string, a long, b long").groupBy("term", "form").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")), "tox-hits")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", most: int = SAMPLE) -> Model:
    """Learn lexicon, weights, contexts and coefficients from labelled rows
    that are not held out. Sixteen numbers for each of about ``most`` documents
    at most reach the driver, and the misspelled words that are in two of them or more. (A
    word in one of them only is as good as new, and so are its chances: the
    words of a term vote on those, each the less the more documents it is in.)"""
    sample = _sample(docs, labels, id_col, text_col, label_col, most)
    terms = learn_lexicon(sample)
    share = sample.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    if share is None:
        return Model([], {}, [-30.0, 0.0, 0.0])
    share = min(0.99, max(0.01, share))
    hits, n = hit_counts(sample, terms), F.col("a") + F.col("b")
    exact = {r.term: (r.a, r.b) for r in hits.filter("form IS NULL").collect()}
    wrong = hits.filter("form IS NOT NULL")
    votes = {r.term: (r.a, r.b) for r in wrong.groupBy("term").agg(
        F.sum(F.col("a") / (n * n)).alias("a"), F.sum(F.col("b") / (n * n)).alias("b")).collect()}
    seen = [(r.form, r.term, r.a, r.b) for r in wrong.filter(n > 1).collect()]
    terms, forms = weighed(terms, math.log(share / (1 - share)), exact, votes, seen)
    data, key = sample.sparkSession.sparkContext.broadcast((terms, forms)), uuid.uuid4().hex

    def make():
        m = matcher(key, data)
        return lambda batch: [[m.by_context(m.found(t)) for t in batch.column(0).to_pylist()]]

    rows = map_batches(sample, make, StructType([StructField("x", ArrayType(DoubleType()))])).select("x", "toxic").collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] > 0 for r in rows], dtype=float)
    contexts, beta = learned_contexts(x, y)
    return Model(terms, forms, beta.tolist(), contexts)


def scored(docs: DataFrame, model: Model, text_col: str, score: str, predicted: str,
           threshold: float = THRESHOLD, hits: str | None = None) -> DataFrame:
    """Append score and prediction to every row (and the matched terms)."""
    data, key = docs.sparkSession.sparkContext.broadcast((model.terms, model.forms, model.contexts)), uuid.uuid4().hex
    beta, terms, at = model.beta, model.terms if hits else [], docs.columns.index(text_col)
    most = NO_HIT * threshold
    bias = min(beta[0], math.log(most / (1 - most))) if 0 < most < 1 else beta[0]
    fields = [StructField(score, DoubleType()), StructField(predicted, IntegerType())]
    if hits:
        fields.append(StructField(hits, ArrayType(StringType())))

    def make():
        m = matcher(key, data)

        def run(batch):
            scores, found = [], []
            for some in blocks([t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]):
                for text in some:
                    hit = m.found(text)
                    z = bias + sum(b * x for b, x in zip(beta[1:], m.features(hit)))
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                    if terms:
                        found.append(sorted({terms[h[3]][0] for h in hit}))
                    else:
                        found.append([])
            return [scores, [int(s >= threshold) for s in scores]] + [found] * (len(fields) > 2)
        return run

    return map_batches(docs, make, StructType(fields))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted, terms``.

    ``score`` is the probability of the label 1, ``predicted`` whether it
    reaches ``threshold``, ``terms`` what was matched. Null, empty and
    wordless texts have no hits and get the base score, as every text does if
    no term can be learned: about the share of 1 among the labels, but never
    more than ``NO_HIT`` times the threshold (0.24), and about 0 without
    labels. So no text without a hit is predicted 1, whatever the labels. Labels of repeated ids count once,
    1 if any says so; null ids and null labels are not learned from; repeated
    rows are judged alike; an empty table gives an empty result; other columns
    are not read. Whole texts are scored.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(col(id_col).alias("id"), held_out(col(id_col)).alias("held_out"),
                       col(text_col).cast("string").alias("text"))
    out = scored(rows, model, "text", "score", "predicted", threshold, "terms")
    return out.select(F.col("id").alias(id_col), "held_out", "score", "predicted", "terms")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, all columns as they are. Null,
    empty and wordless texts, and all texts without a hit, stay (see
    :func:`toxicity`); nothing goes where nothing can be learned; an empty
    table stays empty; rows that repeat are judged alike."""
    model = fit(docs, labels, id_col, text_col, label_col)
    score = fresh("toxic_score", docs.columns)
    predicted = fresh("toxic_predicted", docs.columns)
    out = scored(docs, model, text_col, score, predicted, threshold)
    return out.filter(F.col(predicted) == 0).select(*[col(c) for c in docs.columns])
