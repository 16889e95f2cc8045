"""Merkle manifest against a plain recursive build."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from covary.llm import merkle
from covary.llm.queries import LOWER, UPPER, op12_merkle_manifest
from tests.conftest import SF001

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows, fanout=16):
    def grow(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: grow([leaf_of(r) for r in by[s]]) for s in names}
    top = grow([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for j, r in enumerate(by[s]):
            segments = []
            for tree, k in ((trees[s], j), (top, i)):
                for level in tree[:-1]:
                    a = k // fanout * fanout
                    segments.append(("".join(level[a:k]), "".join(level[k + 1:a + fanout])))
                    k //= fanout
            node = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf_of((*r[:4], r[4].translate(str.maketrans(UPPER, LOWER))))
            for b, a in segments:
                node = sha(b + node + a)
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[s][-1][0], root, sha("".join(b + a for b, a in segments)), node, node == root))
    return sorted(out, key=repr)


def run(spark, rows, fanout=16):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", leaf string, rank int")
    tampered = merkle.leaf_digest([*[F.col(c) for c in FIELDS[:-1]], F.translate("text", UPPER, LOWER)])
    probe = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered)
    return sorted(map(tuple, merkle.verified(docs, FIELDS, probe, fanout=fanout).collect()), key=repr)


def rows_of(n, seed=3):
    rng = random.Random(seed)
    texts = ["", None, "Plain text", "lower only", "ß Ä 漢字 Z", "A" * 50_000]
    # a hot source, sources of one row, of 16 and of 17, a null one and one called like the mark of null
    names = ["hot"] * 4 + [None, "-", "ä", "Z", "a"]
    rows = [(i, rng.choice(names), rng.choice(["en", None]), rng.choice([None, 1, -5]), rng.choice(texts)) for i in range(n)]
    rows += [(1000 + i, "sixteen", "en", i, "T") for i in range(16)] + [(2000 + i, "seventeen", "en", i, "t") for i in range(17)]
    return rows + [(3000, "one", None, None, None), (None, "hot", "en", 1, "no id"), (None, "hot", "en", 1, "no id"), rows[0], rows[0]]


def test_proofs_equal_brute_force(spark):
    rows = rows_of(400)
    assert run(spark, rows) == brute(rows)


def test_other_fanout_and_many_groups(spark):
    rows = [(i, f"s{i % 23}", "en", i, f"Text {i}") for i in range(150)]
    assert run(spark, rows, fanout=3) == brute(rows, fanout=3)


def test_small_and_empty(spark):
    assert run(spark, []) == []
    one = [(7, "only", "en", 2, "Hi")]
    assert run(spark, one) == brute(one)
    alone = [(i, f"s{i}", None, None, None) for i in range(3)]     # every source a lone leaf
    assert run(spark, alone) == brute(alone)


def test_asked_leaves_only_and_records(spark):
    rows = rows_of(300, seed=5)
    m = merkle.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS)
    want = {r[0]: r for r in brute(rows)}
    some = merkle.proofs(m, m.leaves.filter("doc in (5, 77, 2003)")).withColumn(
        "folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted(r.doc for r in some) == [5, 77, 2003]
    assert all(r.folded == m.root == want[r.doc][3] and r.leaf == want[r.doc][1] for r in some)
    # every record is addressed by its content
    for records in m.records.values():
        assert all(r.digest == sha("".join(r.children)) and len(r.children) <= 16 for r in records.collect())
    # a leaf beyond the tree is not found
    ghost = m.leaves.filter("doc = 5").withColumn("rank", F.lit(10 ** 6).cast("long"))
    assert merkle.proofs(m, ghost).count() == 0


def test_query_on_given_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*FIELDS).collect()]
    assert sorted(map(tuple, op12_merkle_manifest(spark, SF001).collect()), key=repr) == brute(rows)
