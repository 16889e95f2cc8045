"""Toxicity: misspelled terms, and small tables."""

import random
from math import comb

import pytest

import corpus_pipeline as cp
from covary.llm import toxicity
from tests.conftest import SF001
from tests.llm.test_filters import distance


def test_every_letter_may_be_edited():
    rng = random.Random(3)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(12)]
    lex = toxicity.Lexicon([(t, False, toxicity.edits_of(t)) for t in terms])
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        near = [distance(w, t) for t in terms if distance(w, t) <= toxicity.edits_of(t)]
        hit = lex.match(w)
        assert (hit[0] if hit else None) == (min(near) if near else None), (w, terms)


def test_edits_by_length_and_known_forms():
    m = toxicity.Matcher([(t, False, 4.0, 2.0) for t in ("scum", "idiot", "stupid", "moron", "disgusting", "ass")], {"oron": 0.0})
    for word in ("scvm", "5cum", "1diot", "ttupid", "noron", "xmoron", "disgutsing", "idsgusting"):
        assert m.hit(word) is not None, word
    for word in ("oron", "xcvm", "mroom", "as", "asss", "disgtsuign"):
        assert m.hit(word) is None, word


def planted(spark, rng):
    """Labelled rows where 'oron' is an ordinary word and abuse is spelt
    exactly, and rows with other spellings."""
    plain = ["".join(rng.choice("dehlt") for _ in range(7)) for _ in range(300)]
    text = lambda *more: " ".join(rng.sample([*rng.choices(plain, k=30), *more], 30 + len(more)))
    rows = [(k, text("oron", rng.choice(("scum", "moron", "stupid"))), 1) if k % 8 == 0 else (k, text("oron"), 0)
            for k in range(1600)]
    other = ["5cum", "scvm", "noron", "mor0n", "ttupid", "xstupid", "oron", "plain"]
    rows += [(2000 + k, text(w), None) for k, w in enumerate(other)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([r[::2] for r in rows if r[2] is not None], "doc_id long, toxic int"), other


def test_only_a_misspelled_word_is_enough(spark):
    docs, labels, other = planted(spark, random.Random(4))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert [got[2000 + k].predicted for k in range(len(other))] == [1, 1, 1, 1, 1, 1, 0, 0]
    assert all(r.predicted == (r.doc_id % 8 == 0) for k, r in got.items() if k < 2000)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_rate_of_chance_finds():
    want = sum(comb(9, k) * 0.2 ** k * 0.8 ** (9 - k) for k in range(4, 10))
    assert toxicity.tail(4, 9, 0.2) == pytest.approx(want) and toxicity.tail(0, 5, 0.3) == pytest.approx(1)
    q = toxicity.chances({(False, 4): 100}, {False: 0.1}, [(False, 4, 4, 4, 5), (False, 4, 4, 3, 5), (False, 4, 4, 2, 1)])
    assert q[False, 4, 4] == pytest.approx(100 * 1e-4 / 5)
    assert q[False, 4, 3] == pytest.approx(100 * toxicity.tail(3, 4, 0.1) / 10)
    assert q[False, 4, 4] < toxicity.CHANCE and q[False, 4, 2] > toxicity.CHANCE


def test_the_stage_catches_labelled_rows_of_a_small_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    kept = {r.doc_id for r in cp.toxic(spark, docs, SF001).collect()}
    gone = [labels.get(r.doc_id) for r in docs.select("doc_id").collect() if r.doc_id not in kept]
    assert gone.count(1) >= 5 and gone.count(0) == 0


def test_labels_that_are_mostly_toxic_empty_no_corpus(spark):
    """Half, nearly all or all labels 1 and no telling word: every text stays;
    with a telling word those that hold it go."""
    texts = [f"plain words number {i} of a text" for i in range(40)] + ["", None]
    for share in (2, 10, 1000):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        labels = spark.createDataFrame([(i, 0, int(i % share > 0)) for i in range(40)], "doc_id long, quality int, toxic int")
        assert toxicity.drop_toxic(docs, labels).count() == 42
        assert {r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {0}
    rows = [(i, f"words {i} with a grumblesnatch in them" if i % 10 else f"words {i} with nothing") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, ""), (901, None), (902, "unlike all others")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 10 > 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, _ in rows if i % 10 == 0} | {900, 901, 902}


def test_contexts_are_learned_from_the_labels(spark):
    """Where quoted abuse is labelled clean, held-out quotations stay and the
    same words as abuse go; where it is labelled toxic, both go."""
    rng = random.Random(9)
    plain = ["".join(rng.choice("dehlt") for _ in range(7)) for _ in range(300)]
    filler = lambda n: " ".join(rng.choices(plain, k=n))
    rows = []
    for k in range(2400):
        word = rng.choice(("scum", "moron", "stupid"))
        middle = (f'they wrote "{word}" there', f"{word}", "nothing")[(k % 24 > 0) + (k % 24 > 2)]
        rows.append((k, f"{filler(12)} {middle} {filler(12)}", middle))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = lambda got: [r for r in got if r.held_out]
    for quoted_too in (False, True):
        truth = {k: int(m != "nothing" and (quoted_too or "wrote" not in m)) for k, _, m in rows}
        labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
        model = toxicity.fit(docs, labels)
        assert model.contexts[2] == toxicity.CONTEXTS[2]  # nobody is addressed
        if not quoted_too:
            assert model.contexts[0] * model.contexts[1] < 0.4 * 0.6
        got = held(toxicity.toxicity(docs, labels).collect())
        assert len(got) > 400 and sum(r.predicted == truth[r.doc_id] for r in got) >= 0.99 * len(got)


def test_contexts_without_evidence_stay_as_believed():
    import numpy as np
    none = np.zeros((50, 16))
    contexts, beta = toxicity.learned_contexts(none, np.arange(50) % 5 == 0)
    assert contexts == toxicity.CONTEXTS and 1 / (1 + np.exp(-beta[0])) == pytest.approx(0.2, abs=0.01)
    # one hit each: as it is, in quotation marks, or none
    weights = np.zeros((1200, 16))
    weights[:100, [0, 8]] = weights[100:200, [1, 9]] = 1.5
    for quoted in (2, 50):
        y = np.arange(1200) % 50 == 0
        y[:100], y[100:200] = np.arange(100) % 2 == 0, np.arange(100) % quoted == 0
        contexts, _ = toxicity.learned_contexts(weights, y)
        assert (contexts[0] > 0.5) if quoted == 2 else (contexts[0] < 0.3)
        assert contexts[1:] == toxicity.CONTEXTS[1:]
    assert toxicity.factors((0.5, 3.0, 7.0)) == [1, 0.5, 3, 1.5, 7, 3.5, 21, 10.5]
