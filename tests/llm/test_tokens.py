"""BPE, token counts and record files against the tokenizer library."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from covary.llm import bpe, records, token_counts
from tests.conftest import SF001
from tests.llm.conftest import AWKWARD

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ALPHABET = list("aab  \n\t'srtdelmv.,!?123éßüÉẞİ　\x85\xa0\x1c​漢字🙂 ̈") + [
    "<|endoftext|>", "<|endof", "'re", "'ll", "the ", "THE ", "ing", " " * 5, "a" * 20, "_", "²"]


def texts(n=3000, seed=1):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["", " ", "a" * 3000, "ab" * 500, " " * 300, "=-" * 400, "<|endoftext|>" * 3, "\x1c\x1d a"]


@pytest.fixture(scope="module")
def library(vocab):
    from tokenizers import Tokenizer
    return lambda name: Tokenizer.from_file(vocab(name))


def test_encoding_is_the_librarys(vocab, library):
    own, lib = bpe.ByteBPE(vocab("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    some = texts()
    for text, code in zip(some, own.encode(some)):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(code, "<u4").tolist() == ids, repr(text)
        assert own.decode(code).decode() == lib.decode(ids, skip_special_tokens=False)
    odd = np.array([0xE6, 0x97, 300, 17], dtype="<u4")
    assert own.decode(odd.tobytes()).decode() == lib.decode(odd.tolist(), skip_special_tokens=False)


def test_both_trees_merge_alike(vocab):
    own, rng = bpe.ByteBPE(vocab("byte_bpe_50k.json")), random.Random(6)
    words = [bytes(rng.choice(b"aabcdeinrst") for _ in range(rng.randint(2, 64))) for _ in range(400)]
    assert own.merge(words) == [np.array(bpe.MergeTree(own.byte_id[list(w)].tolist(), own.ranks).run(), "<u4").tobytes()
                                for w in words]


def test_cache_overflow_changes_nothing(vocab, monkeypatch):
    own, some = bpe.ByteBPE(vocab("byte_bpe_50k.json")), texts(300)
    want = own.encode(some)
    monkeypatch.setattr(bpe, "CACHE_UNITS", 5)
    memo = {}
    assert [own.encode([t], memo)[0] for t in some] == want


def test_counts_at_every_prefix(vocab, library):
    c, lib = token_counts.PrefixCounter(vocab("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for text in texts(300, seed=2)[:320]:
        if len(text) > 60:
            continue
        table = c.table(text)
        true = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert [table.count(k) for k in range(len(text) + 1)] == true, repr(text)
        for budget in range(5):
            assert table.fit(budget) == max(k for k, n in enumerate(true) if n <= budget)
        for w in c.bpe.words.findall(text):
            b = w.encode()
            assert c.prefixes(b)[-1] == c.word_count(b)


def test_round_trip_and_counts(spark, awkward, empty, vocab, library):
    path, lib = vocab("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [r[:2] for r in AWKWARD]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, counts = [], []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
        counts.append((i, len((t or "").encode()), len(ids), len(ids) > 1024))
    got = bpe.bpe_round_trip(df, path, ids=True, decoded=True).collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted(want, key=repr)
    got = token_counts.token_counts(df, path).collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted(counts, key=repr)
    assert bpe.bpe_round_trip(empty, path).count() == 0 and token_counts.token_counts(empty, path).count() == 0


def slow_crc(data):
    x = 0xFFFFFFFF
    for y in data:
        x ^= y
        for _ in range(8):
            x = x >> 1 ^ (records.CASTAGNOLI if x & 1 else 0)
    x ^= 0xFFFFFFFF
    return ((x >> 15 | x << 17) + records.MASK) & 0xFFFFFFFF


def test_checksums():
    rng = random.Random(1)
    items = [rng.randbytes(n) for n in (4, 5, 8, 1023, 1024, 1025, 2048, 5000)] + [b"123456789"]
    assert records.masked_crcs(items).tolist() == [slow_crc(x) for x in items]
    plain = (records.masked_crcs([b"123456789"])[0].item() - records.MASK) & 0xFFFFFFFF
    assert (plain >> 17 | plain << 15) & 0xFFFFFFFF == 0xE3069283  # the published check value


def test_damage_is_found():
    import io
    whole = b"".join(records.frame([b"12345678", b"abcdefghij" * 200]))
    assert [p for ps in records.unframe(io.BytesIO(whole)) for p in ps] == [b"12345678", b"abcdefghij" * 200]
    for at in (0, 9, 14, 30, len(whole) - 1):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(records.DamagedRecord):
            list(records.unframe(io.BytesIO(bytes(bad))))
    with pytest.raises(records.DamagedRecord):
        list(records.unframe(io.BytesIO(whole[:-3])))


def test_library_ids_by_piece(vocab, library):
    own, lib = records.LibraryIds(vocab("word_bpe_49k.json")), library("word_bpe_49k.json")
    some = texts(seed=9)
    for text, code in zip(some, own(some)):
        assert np.frombuffer(code, own.type).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_record_files(spark, empty, vocab, library):
    path, lib = vocab("word_bpe_49k.json"), library("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(900, None), (901, ""), (902, "x " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, start = [], 0
    for i, t in sorted(rows):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in records.record_round_trip(df, path).collect()) == want
    folder = records.scratch_path(spark, "records-test")
    index = records.write_records(df, folder, path, shards=4)
    some = {r.id: r.ids for r in records.read_at(index.filter("id % 9 = 0").orderBy("length"), path).collect()}
    assert some == {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows if i % 9 == 0}
    assert records.record_round_trip(empty, path).count() == 0


def test_record_files_awkward(awkward, vocab):
    got = records.record_round_trip(awkward, vocab("word_bpe_49k.json")).collect()
    assert len(got) == awkward.count()
    first = next(r for r in got if r.start == 0)
    assert first.doc_id is None  # null ids come first
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}


def test_random_reads_of_null_and_repeated_ids(spark, awkward, vocab, library):
    path, lib = vocab("word_bpe_49k.json"), library("word_bpe_49k.json")
    index = records.write_records(awkward, records.scratch_path(spark, "records-odd"), path, shards=3)
    want = sorted(((r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in awkward.collect()), key=repr)
    got = sorted(((r.id, r.ids) for r in records.read_at(index, path).collect()), key=repr)
    assert got == want and sum(i is None for i, _ in got) == 1 and sum(i == 1 for i, _ in got) == 2
    twice = records.read_at(index.unionByName(index).filter("id IS NULL OR id = 1"), path).collect()
    assert len(twice) == 6
    assert records.read_at(index.filter("id = -5"), path).count() == 0
