"""URL rules, decontamination, language and toxicity."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from covary.llm import decontaminate, langid, toxicity, url_rules
from tests.conftest import SF001, SF01
from tests.llm.conftest import AWKWARD

PAGES = [
    (1, "http://A.example.org/es/1?x#y", "", 0),
    (2, "https://shop.example.net/p", '<link rel="canonical" href="http://a.example.org/es/1?x">', 0),
    (3, "https://other.example.net/q#frag", "<LINK href='/r' rel=canonical>", 0),
    (4, "https://other.example.net/r", '<meta http-equiv="refresh" content="0; url=https://shop.example.net/p">', 0),
    (5, "http://x.com/fr/a", '<link rel="canonical" href="https://shop.example.net/p">', 0),
    (6, "http://lone.example.net/", None, 0), (7, None, None, 0), (8, "no scheme", "<link rel=canonical href=/x>", 0),
    (9, "http://example.org", "", 0), (10, "http://notexample.org/es/", "", 0), (11, "http://example.org/en/12", "", 0),
    (11, "http://example.org/en/12", "", 0), (12, "http://b.com/de/x", "", 0), (13, "", "", 0),
    (14, "http://c.net/a", '<link rel="canonical" href="http://t.com/de/target">', 0), (15, "http://c.net/a#z", "", 0),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, own int")


def test_url_rules(spark):
    got = {r.page_id: tuple(r)[1:] for r in url_rules.url_verdicts(pages(spark)).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[5] == ("x.com", "/fr/a", "com/fr/", "allow")
    assert got[9] == ("example.org", "", None, "allow")
    assert got[10][2:] == ("org/", "allow") and got[11][2:] == ("example.org/en/1", "block")
    assert got[12][2:] == ("com/de/", "block")
    assert got[7] == got[13] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    # 2, 3, 4 are aliases of the blocked 1, but also of the explicitly allowed 5
    assert {got[k][3] for k in (2, 3, 4)} == {"allow"}
    assert got[14][3] == got[15][3] == "block"  # the target is no page; its rule counts


def test_url_block_reaches_aliases(spark):
    rows = [r for r in PAGES if r[0] != 5]
    got = {r.page_id: r.verdict for r in url_rules.url_verdicts(pages(spark, rows)).collect()}
    assert {got[k] for k in (1, 2, 3, 4)} == {"block"} and got[6] == "allow"
    logs = spark.createDataFrame([("http://lone.example.net/", "http://b.com/de/x"), (None, "x")], "source string, target string")
    got = {r.page_id: r.verdict for r in url_rules.url_verdicts(pages(spark, rows), redirects=logs).collect()}
    assert got[6] == "block"
    assert url_rules.url_verdicts(pages(spark, [])).count() == 0


def test_very_long_urls_and_html(spark):
    """Links far inside long pages connect, long urls are judged whole, and
    unclosed tags find nothing."""
    filler = "<p>some text</p>" * 40_000
    link = '<link rel="canonical" href="http://b.com/de/x">'
    rows = [(1, "http://far.net/a", filler + link + filler, 0), (2, "http://far.net/" + "p/" * 100_000, filler, 0),
            (3, "http://b.com/de/" + "q" * 200_000, None, 0), (4, "http://open.net/", "<link " * 2_000, 0),
            (5, "http://" + "h" * 100_000 + ".org/" + "s" * 100_000, "", 0)]
    got = {r.page_id: r for r in url_rules.url_verdicts(pages(spark, rows)).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
    assert len(got[2].path) == 200_001 and len(got[3].path) == 200_004 and got[5].rule == "org/" and got[1].rule is None


def test_url_sql_twin_on_links(spark):
    import duckdb
    from covary.llm.queries import ORACLE_SQL
    con = duckdb.connect()
    rows = [r for r in PAGES if r[0] != 11] + [(11, "http://example.org/en/12", "", 0)]
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in rows])
    want = sorted(con.sql(ORACLE_SQL["op9_url_filters"]).fetchall())
    assert sorted(tuple(r) for r in url_rules.url_verdicts(pages(spark, rows)).collect()) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(rows, bench):
    wins = {}
    for i, t in bench:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k:k + 13]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, items = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    items |= wins[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [32 << 20, 4000], ids=["one automaton", "many blocks"])
def test_contamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", most)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text")
    items = [tuple(r) for r in bench.collect()] + [(500, "quick BROWN fox"), (501, "the lazy"), (502, None), (503, "!?"),
                                                   (504, "the lazy"), (504, "the lazy"), (None, "dog"), (505, "ßäü")]
    rows = [tuple(r) for r in docs.collect()] + [r[:2] for r in AWKWARD]
    rows += [(2000, "say: " + items[0][1].upper() + " end"), (2001, items[1][1] + " " + items[1][1])]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == brute_hits(rows, [x for x in items if x[0] is not None])
    text = dict(rows)
    for r in got:
        assert sum(len(WORD.findall(lower(text[r.doc_id][a:b]))) for a, b in r.hit_spans) == r.n_hit


def test_contamination_edges(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "quick brown fox jumps")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.drop_contaminated(awkward, bench)
    assert out.columns == awkward.columns and {r.doc_id for r in out.collect()} == {3, 4, 5, 6, 7, 8, None}
    assert decontaminate.drop_contaminated(awkward, none).count() == awkward.count()
    assert decontaminate.contamination(empty, bench).count() == 0


def test_forward_sums_all_segmentations(vocab):
    import numpy as np
    p = langid.Pieces(vocab("byte_bpe_multi_50k.tiktoken"))
    prob = np.append(np.random.default_rng(1).random(p.n), 0.0)
    at = {b: k for k, b in enumerate(p.pieces)}
    for word in (b" the", b"abc", b" den", b" \xc3\xa9t"):
        total, n, uses = 0.0, len(word), np.zeros(p.n)
        for cuts in itertools.product((0, 1), repeat=n - 1):
            ends = [0, *[k + 1 for k, c in enumerate(cuts) if c], n]
            parts = [word[a:b] for a, b in zip(ends, ends[1:])]
            if all(x in at for x in parts):
                q = np.prod([prob[at[x]] for x in parts])
                total += q
                for x in parts:
                    uses[at[x]] += q
        ids = p.ids([word])
        assert p.forward(ids, n, prob)[n][0] == pytest.approx(total)
        assert p.expected([word], np.ones(1), prob) == pytest.approx(uses / total)


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language(spark, vocab, awkward, empty):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    path = vocab("byte_bpe_multi_50k.tiktoken")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.languages(docs, path).collect()
    assert len(got) == len(truth) and all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    out = langid.languages(awkward, path).collect()
    assert len(out) == awkward.count()
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (3, 4, 5)} == {("und", 0.0)}
    assert langid.languages(empty, path).count() == 0
    none = awkward.withColumn("lang", awkward.lang.substr(100, 1).cast("string")).filter("doc_id = 1").replace("", None, "lang")
    assert {r.lang_pred for r in langid.languages(none, path).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(2)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(12)]
    for edits in (0, 1, 2):
        lex = toxicity.Lexicon([(t, False, edits) for t in terms])
        for _ in range(800):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
            best = min(distance(w, t) for t in terms)
            hit = lex.match(w)
            assert (hit[0] if hit else None) == (best if best <= edits else None), (w, terms)


def test_stems_and_context():
    lex = toxicity.Lexicon([("abcdef", True, 1), ("xyz", False, 0)])
    assert lex.match("abcdefghi")[0] == 0 and lex.match("abxdefghi")[0] == 1 and lex.match("abxxefghi") is None
    assert lex.match("xyz") and lex.match("xyzz") is None
    m = toxicity.Matcher([("moron", False, 4.0, 2.0)])
    plain, quoted = m.spans("You are a m0ron, really"), m.spans('She said "moron" is a word')
    assert plain[0][3] == 1 and not plain[0][4] and quoted[0][4]
    assert plain[0][5] > 1 > quoted[0][5]
    assert m.spans("İİ moron")[0][:2] == (3, 8)


def test_toxicity(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hit >= 0.9 * sum(truth[r.doc_id] for r in held) and hit >= 0.9 * sum(r.predicted for r in held)
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(awkward, odd).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(empty, odd).count() == 0
    none = odd.filter("doc_id = 99")
    kept = toxicity.drop_toxic(awkward, none)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
