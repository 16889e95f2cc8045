"""Language pieces: the whole vocabulary, long words, and the prediction
itself against plain sums."""

import base64
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from covary.llm import langid

#: A small vocabulary file: single bytes are added by the reader.
TOKENS = [b"ab", b"abc", b" the", b"bcd", "漢".encode(), "字漢".encode(), b" internationalisation", b"alisation",
          b"nternational", b" abcabcabcabcabcabcabcabcabcabcabc", b"cab"]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    path = tmp_path_factory.mktemp("vocab") / "small.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(TOKENS)))
    return str(path)


def log_sum(word, logs):
    """Log-probability of a word over all segmentations, place by place."""
    alpha = [0.0]
    for end in range(1, len(word) + 1):
        parts = [alpha[end - k] + logs[word[end - k:end]] for k in range(1, min(34, end) + 1) if word[end - k:end] in logs]
        most = max(parts)
        alpha.append(most + math.log(sum(math.exp(x - most) for x in parts)))
    return alpha


def test_every_piece_of_the_vocabulary_counts(vocab):
    pieces = langid.Pieces(vocab("byte_bpe_multi_50k.tiktoken"))
    with open(vocab("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    assert set(tokens) <= set(pieces.pieces) and pieces.longest == max(map(len, tokens)) > 8
    rng = random.Random(1)
    for token in rng.sample([t for t in tokens if len(t) > 8], 300) + rng.sample(tokens, 300):
        word = b"xq" + token + b"z"
        assert pieces.pieces[pieces.ids([word])[2, len(token)][0]] == token


def words(n=120):
    rng = random.Random(3)
    out = [" ".join([""] + [""]).encode()]
    alphabet = ["a", "b", "c", "d", "abc", "cab", "漢", "字", "nternational", "alisation", "é"]
    out += [(" " + "".join(rng.choices(alphabet, k=rng.choice([1, 3, 8, 20, 60, 200])))).encode() for _ in range(n)]
    return out[1:] + [b" internationalisation", b" " + b"abc" * 11, b" " + b"abcab" * 900, b" " + b"z" * 3000]


def test_long_words_are_summed_whole(small):
    """No word is cut, and no character either."""
    pieces, rng = langid.Pieces(small), np.random.default_rng(2)
    p = rng.random((pieces.n, 2)) + 1e-3
    p /= p.sum(axis=0)
    logs = [{t: math.log(p[i, k]) for i, t in enumerate(pieces.pieces)} for k in (0, 1)]
    full, every = np.vstack([p, np.zeros((1, 2))]), words()
    got = pieces.log_forward(every, full)
    for w, row in zip(every, got):
        for k in (0, 1):
            assert row[k] == pytest.approx(log_sum(w, logs[k])[-1], rel=1e-10, abs=1e-10), w[:40]
    short = [w for w in every if len(w) == 4]
    assert np.log(pieces.forward(pieces.ids(short), 4, full)[4]) == pytest.approx(pieces.log_forward(short, full))


def test_expected_pieces_of_long_words(small):
    pieces, rng = langid.Pieces(small), np.random.default_rng(5)
    p = rng.random(pieces.n) + 1e-3
    p /= p.sum()
    logs = {t: math.log(x) for t, x in zip(pieces.pieces, p)}
    full, every = np.append(p, 0.0), words(40)
    weight = rng.integers(1, 5, len(every)).astype(float)
    want = Counter()
    for w, n in zip(every, weight):
        ahead = log_sum(w, logs)
        back = log_sum(w[::-1], {t[::-1]: x for t, x in logs.items()})[::-1]
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + 34) + 1):
                if w[a:b] in logs:
                    want[w[a:b]] += n * math.exp(ahead[a] + logs[w[a:b]] + back[b] - ahead[-1])
    got = dict(zip(pieces.pieces, pieces.log_expected(every, weight, full)))
    for t in pieces.pieces:
        assert got[t] == pytest.approx(want[t], rel=1e-8, abs=1e-9), t
    same = [w for w in every if len(w) == 4]
    ones = np.ones(len(same))
    assert pieces.expected(same, ones, full) == pytest.approx(pieces.log_expected(same, ones, full))


def brute(docs, path, rounds=langid.ROUNDS):
    """The whole method in plain sums: counts by expectation and maximisation,
    posterior by Bayes."""
    with open(path, "rb") as f:
        tokens = sorted({base64.b64decode(x.split()[0]) for x in f if x.strip()} | {bytes([b]) for b in range(256)})
    import zlib
    found = lambda t: [(" " + w).encode() for w in regex.findall(r"\p{L}+", (t or "").lower())]
    counts, sizes = defaultdict(Counter), Counter()
    for i, text, lang in docs:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sizes[lang] += 1
            counts[lang].update(found(text))
    langs = sorted(sizes)
    p = {g: dict.fromkeys(tokens, 1 / len(tokens)) for g in langs}
    for _ in range(rounds):
        seen = {g: Counter() for g in langs}
        for g in langs:
            logs = {t: math.log(x) for t, x in p[g].items()}
            for w, n in counts[g].items():
                ahead = log_sum(w, logs)
                back = log_sum(w[::-1], {t[::-1]: x for t, x in logs.items()})[::-1]
                for a in range(len(w)):
                    for b in range(a + 1, min(len(w), a + 34) + 1):
                        if w[a:b] in logs:
                            seen[g][w[a:b]] += n * math.exp(ahead[a] + logs[w[a:b]] + back[b] - ahead[-1])
        pooled = {t: sum(seen[g][t] for g in langs) + 0.01 for t in tokens}
        total = sum(pooled.values())
        p = {g: {t: (seen[g][t] + langid.POOLED * pooled[t] / total) / (sum(seen[g].values()) + langid.POOLED) for t in tokens}
             for g in langs}
    out = {}
    logs = {g: {t: math.log(x) for t, x in p[g].items()} for g in langs}
    for i, text, _ in docs:
        ws = found(text)
        z = {g: math.log(sizes[g] / sum(sizes.values())) + sum(log_sum(w, logs[g])[-1] for w in ws) for g in langs}
        best = max(langs, key=lambda g: z[g])
        out[i] = (best, 1 / sum(math.exp(x - z[best]) for x in z.values())) if ws else ("und", 0.0)
    return out


def test_prediction_equals_plain_sums(spark, small):
    rng = random.Random(9)
    kinds = {"en": ["the", "abc", "internationalisation", "cabcab"], "zh": ["漢字" * 30, "字漢字", "漢"],
             "xx": ["dddd", "bcdbcd", "z" * 70, "éé"]}
    docs = [(i, " ".join(rng.choices(kinds[g], k=rng.randint(1, 6))) + rng.choice(["", " 12", " ½?"]), g if i % 7 else None)
            for i, g in enumerate(rng.choices(list(kinds), k=60))]
    # numbers that are no letters, among them those that count as alphanumeric
    docs += [(100, None, "en"), (101, "", "zh"), (102, "½ ² ① Ⅷ 12", "en"), (103, "½abc²", None),
             (104, "!!! 7", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(df, small).collect()}
    want = brute(docs, small)
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9), i
    assert {got[i] for i in (100, 101, 102, 104)} == {("und", 0.0)} and got[103][0] != "und"
