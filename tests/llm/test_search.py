"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from covary.llm import search
from tests.llm.conftest import AWKWARD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    tf = [(d, Counter(words(t))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    n_docs, n_terms = len(tf), sum(n for *_, n in tf)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in tf:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m))
                    for w in words(text) if w in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(n, seed):
    """Words of very uneven frequency, very short and very long texts, ties
    and copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "漢字", "x1", "THE", "the"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 10, 40, 400])))) for i in range(n)]
    docs += [(5000 + i, "w3 w9 the") for i in range(40)]                     # equal scores
    docs += [(6000, "w0 " * 700 + "w1"), (6001, None), (6002, "  !! "), (None, "w5 w5 w7"), (None, "w5 w5 w7"), (7, "w8 w8")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 12)))) for i in range(60)]
    return docs, items + [(None, "w5 w7"), (900, None), (901, ""), (902, "nowhere unseen"), (0, "w0"), (0, "w0 w0 W0")]


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x", 2) for r in docs], "doc_id long, text string, shard string, term int").repartition(5)
    i = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, row int")
    return sorted(map(tuple, search.ranked(d, i, **options).collect()), key=repr)


def test_top_ten_equal_brute_force(spark, monkeypatch):
    docs, items = corpus(900, 1)
    assert run(spark, docs, items) == brute(docs, items)


def test_other_k(spark):
    docs, items = corpus(200, 2)
    assert run(spark, docs, items, k=1) == brute(docs, items, 1)


def test_full_index_and_several_passes(spark, monkeypatch):
    docs, items = corpus(400, 3)
    monkeypatch.setattr(search, "FILTER_BYTES", 0)
    monkeypatch.setattr(search, "QUERY_BYTES", 1500)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark, empty, awkward):
    assert run(spark, [], [(1, "w0")]) == [] and run(spark, [(1, "w0")], []) == []
    assert search.ranked(empty, empty, item_col="doc_id").count() == 0
    docs = [(r[0], r[1]) for r in AWKWARD]
    items = spark.createDataFrame([(1, "fox LONG dog"), (2, "漢字")], "item_id long, text string")
    got = sorted(map(tuple, search.ranked(awkward, items).collect()), key=repr)
    assert got == brute(docs, [(1, "fox LONG dog"), (2, "漢字")])


@pytest.fixture
def shard():
    docs, _ = corpus(1500, 4)
    s = search.Shard(len(docs), 40_000)
    for i, (_, text) in enumerate(docs):
        w = [x.encode() for x in words(text)]
        if w:
            s.add(i, len(w), Counter(w))
    return s


def unpacked(shard):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType
    ddl = ("shard string, term binary, df long, blocks array<int>, starts array<int>, maxima array<int>, places binary, "
           "counts binary, big_at array<int>, big_tf array<int>")
    schema = to_arrow_schema(StructType(list(StructType.fromDDL(ddl).fields) + [
        StructField("ids", ArrayType(LongType())), StructField("norms", ArrayType(LongType()))]), prefers_large_types=False)
    rows = pa.Table.from_batches(list(search._rows("0-0", shard, schema, step=7))).to_pylist()
    return np.array(rows[0]["norms"]), {r["term"]: (r, search.Postings(r)) for r in rows[1:]}


def test_shards_merge_and_pack(shard):
    """Lists of every block unpack to what went in, big counts too."""
    norms, lists = unpacked(shard)
    want = {}
    for i, n, at in zip(range(len(shard.ids)), shard.counts, np.cumsum(shard.counts)):
        for t, c in zip(shard.term[at - n:at], shard.tf[at - n:at]):
            want.setdefault(t, {})[i] = c
    for name, t in shard.known.items():
        row, p = lists[name]
        assert row["df"] == len(want[t])
        got = {}
        for i, b in enumerate(p.blocks):
            at, gain = p.unpack(i, norms)
            assert gain.max() == p.maxima[i]
            got |= dict(zip((at + b * search.BLOCK).tolist(), gain.tolist()))
        assert got == {i: search.impact(c, int(norms[i])) for i, c in want[t].items()}
    assert any(c > 255 for c in shard.tf)


def test_blocks_are_rejected_before_unpacking(shard, monkeypatch):
    norms, lists = unpacked(shard)
    opened = []
    real = search.Postings.unpack
    monkeypatch.setattr(search.Postings, "unpack", lambda self, i, n: opened.append(1) or real(self, i, n))
    asked = [(lists[t.encode()][1], w) for t, w in (("w40", 900), ("w0", 2), ("w1", 3))]
    got = search.best(asked, norms, 10)
    every = sum(len(p.blocks) for p, _ in asked)
    total = np.zeros(len(norms), dtype=np.int64)
    for p, w in asked:
        for i, b in enumerate(p.blocks):
            at, gain = real(p, i, norms)
            total[at + b * search.BLOCK] += gain * w
    want = sorted(((int(s), i) for i, s in enumerate(total) if s > 0), key=lambda x: (-x[0], x[1]))[:10]
    assert got == want and len(opened) < every
