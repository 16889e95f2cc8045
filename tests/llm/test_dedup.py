"""Exact groups, SimHash groups, repeated strings: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from covary.llm import components, exact_dedup, simhash, suffix_dedup
from tests.conftest import SF001, SF01
from tests.llm.conftest import AWKWARD


def brute_groups(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for k, (i, t) in enumerate(rows):
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        best = min(groups[norm])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda n: F.unhex(F.substring(F.md5(n), 1, 2))],
                         ids=["md5", "colliding"])
def test_exact_groups(spark, hashed):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(r[0], r[1]) for r in AWKWARD]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), hashed=hashed).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_groups(rows)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_exact_stage_keeps_columns_and_one_row(awkward, empty):
    out = exact_dedup.drop_exact_copies(awkward)
    assert out.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.h) for r in out.collect()) == [
        (False, 2, "fp"), (False, 5, "uid"), (False, 6, "n"), (False, 7, "u"), (False, 8, "k"), (True, 0, "id")]
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0


def slow_print(text, words=4):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def find_roots(prints, radius=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= radius):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_near_groups(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").filter("doc_id < 400 OR doc_id % 7 = 0")
    rows = sorted((r.doc_id, r.text) for r in docs.collect()) + [(-1, None), (10_000, ""), (10_001, "A b\tc")]
    got = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [slow_print(t) for _, t in rows]
    assert [got[i].fingerprint for i, _ in rows] == [f"{p:016x}" for p in prints]
    roots = find_roots(prints)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(i, least.get(r, i))
    assert [got[i].component_id for i, _ in rows] == [least[r] for r in roots]
    assert sum(r.kept for r in got.values()) == len(least)


def test_near_groups_awkward(awkward, empty):
    got = simhash.near_groups(awkward).collect()
    assert len(got) == awkward.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {3} and len(zero) == 3
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    out = simhash.drop_near_copies(awkward)
    assert out.columns == awkward.columns and out.filter("doc_id = 1").count() == 1
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_tiles_find_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2500, dtype=np.uint64)
    flip = lambda x, k: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    near = np.array([flip(x, int(rng.integers(1, 8))) for x in base], dtype=np.uint64)
    a = np.unique(np.concatenate([base, near]))
    u, v = simhash.tile_links(a, a, 4)
    links = {(int(x), int(y)) for i, x in enumerate(a) for y in a[i + 1:][np.bitwise_count(a[i + 1:] ^ x) <= 4]}
    want, got = {}, {}
    for pairs, out in ((links, want), (set(zip(u.tolist(), v.tolist())), got)):
        root = {int(x): int(x) for x in a}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for x, y in pairs:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        out |= {x: find(x) for x in root}
    assert want == got and len(u) < len(a)


def test_dense_tile_yields_a_forest():
    a = np.unique(np.array([sum(1 << b for b in c) for c in __import__("itertools").combinations(range(24), 2)],
                           dtype=np.uint64))
    u, v = simhash.tile_links(a, a, 4)
    assert len(u) == len(a) - 1 and set(u.tolist()) == {int(a[0])} and len(set(v.tolist())) == len(v)


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)]
    edges += [(rng.randint(2000, 2600), rng.randint(2000, 2600)) for _ in range(300)] + [(5, 5), (None, 3), (1, 2)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for x, y in edges:
        if x is not None and y is not None and x != y:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                mark[p:p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if mark[k] and not (k and mark[k - 1]))
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows(spark):
    rng = random.Random(7)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(180))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + k, f"{rng.random()} {shared} {rng.random()} tail {k}") for k in range(60)]
    rows += [(2000, "ab" * 300), (2001, "z" * 100), (2002, "z" * 99), (2003, "é" * 200), (2004, None), (2005, ""),
             (2006, "\0" * 250), (2007, "ab" * 160)]
    return sorted(rows)


@pytest.mark.parametrize("segments", [2000, 2])
def test_repeats(spark, monkeypatch, segments):
    monkeypatch.setattr(suffix_dedup, "SEGMENTS", segments)
    rows = repeat_rows(spark)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(rows, 100)


def test_repeats_awkward(awkward, empty):
    got = suffix_dedup.remove_repeats(awkward, length=40, kept_text=True).collect()
    assert len(got) == awkward.count()
    one = sorted(r.n_removed for r in got if r.doc_id == 1)
    assert one == [0, len(AWKWARD[0][1])]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_prefix_classes_by_interval_expansion():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([2, 3, 4, 7])
        texts = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        got, want = {}, {}
        for c, k, p in zip(*(x.tolist() for x in suffix_dedup.prefix_classes(texts, length))):
            got.setdefault(c, []).append((k, p))
        for k, t in enumerate(texts):
            for p in range(len(t) - length + 1):
                want.setdefault(t[p:p + length], []).append((k, p))
        assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def test_prefix_lengths():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc") for _ in range(60)) for _ in range(4)]
    flat = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 4, k) for k, t in enumerate(texts)])
    order = suffix_dedup.suffix_order(flat, 20)
    lcp = suffix_dedup.prefix_lengths(flat, order, 5)
    for r in range(1, len(order)):
        a, b = flat[order[r - 1]:].tolist(), flat[order[r]:].tolist()
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[r] == (same if same < 5 else -1)


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(2)
    w = bytes(rng.choice(b"abcd") for _ in range(100))
    keys = set()
    for _ in range(20):
        t = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 200))) + w + b"tail" * rng.randint(0, 9)
        at = t.index(w)
        h, p, n = suffix_dedup.anchors(np.frombuffer(t, np.uint8), 100)
        keys.add(int(h[(p <= at) & (at < p + n)][0]))
    assert len(keys) == 1


def test_links_over_many_tiles_and_groups(spark, monkeypatch):
    """Cells of many small tiles, dealt to groups, give the same components as
    brute force over all pairs."""
    import numpy as np
    monkeypatch.setattr(simhash, "TILE", 4)
    monkeypatch.setattr(simhash, "GROUP", 2)
    rng = random.Random(12)
    prints = {(1 << 63) - 1, 0, (1 << 64) - 1}
    for _ in range(60):
        centre = sum(1 << k for k in rng.sample(range(64), 32))
        prints |= {centre} | {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 9))) for _ in range(6)}
    prints = sorted(prints)
    rows = [(int(np.uint64(x).view(np.int64)),) for x in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(rows * 2, "fp long")).collect()
    at = {x[0]: k for k, x in enumerate(rows)}

    def roots(pairs):
        root = list(range(len(prints)))
        def top(k):
            while root[k] != k:
                k = root[k]
            return k
        for a, b in pairs:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        return [top(k) for k in range(len(prints))]

    want = roots((i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4)
    assert roots((at[r.a], at[r.b]) for r in links) == want
    assert 1 < len(set(want)) < len(prints)


def test_names_with_dots(spark):
    rows = [(1, "a b c d e", 1), (2, "a b  c d e", 2), (3, None, 3), (4, "", 4)]
    docs = spark.createDataFrame(rows, "`doc.id` long, `the.text` string, row_uid int")
    for drop in (exact_dedup.drop_exact_copies, simhash.drop_near_copies):
        out = drop(docs, "doc.id", "the.text")
        assert out.columns == docs.columns
        assert sorted(tuple(r) for r in out.collect()) == ([rows[1], rows[2]] if drop is exact_dedup.drop_exact_copies
                                                           else [rows[0], rows[2]])
