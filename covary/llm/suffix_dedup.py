"""Removal of repeated strings: common prefixes of suffixes, derived by
breadth-first interval expansion on a Burrows-Wheeler transform.

Which strings of ``length`` bytes also start earlier is decided by
:func:`prefix_classes` on blocks of text. To bring equal strings into one
block, every string is represented by its anchor, the 32-byte gram in it whose
hash is smallest: equal strings have equal anchors at equal places. Strings in
a row that share an anchor form one segment. Only anchors that occur more than
once can matter; byte-identical segments collapse to the earliest before any
text is sorted, and the rest of an anchor's segments are compared in a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from covary.llm._common import attach, col, map_batches, saved, ship

#: Bytes of an anchor.
GRAM = 32
#: Positions handled at once, and anchors gathered before they are grouped.
STRETCH = 1 << 20
FLUSH = 600_000
#: Bytes of segments in one transform.
BLOCK = 2_000_000
#: Different segments an anchor may have in one block. An anchor with more is
#: re-keyed by whole strings, so that only equal ones meet.
SEGMENTS = 2000

_POSITION = (1 << 22) - 1


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram of 32 bytes, by doubling."""
    with np.errstate(over="ignore"):
        h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        step, factor = 1, 0xD6E8FEB86659FD93
        while step < GRAM:
            h = h[:-step] * np.uint64(factor) + h[step:]
            factor = factor * factor % (1 << 64)
            step *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: hash of the anchor, first start, number of starts.
    Texts shorter than ``length`` have none."""
    out = []
    span = length - GRAM + 1  # grams in a string
    for lo in range(0, max(0, len(b) - length + 1), STRETCH):
        h = gram_hashes(b[lo:lo + STRETCH + length - 1])
        low = (h & ~np.uint64(_POSITION)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[:width - span], low[span - width:])
        at = low & np.uint64(_POSITION)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        out.append((h[at[first]], first + lo, np.diff(np.append(first, len(at)))))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` symbols (or
    more), by prefix doubling."""
    n = len(text)
    rank, size = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if size >= depth or new[-1] == n - 1:
            return order
        tail = np.full(n, -1, dtype=np.int64)
        tail[:n - size] = rank[size:]
        rank = rank * (n + 1) + tail + 1
        order = np.argsort(rank, kind="stable")
        size *= 2


def prefix_lengths(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it in ``order``,
    -1 where it is ``most`` or longer.

    Level by level, for length 0, 1, 2, ... the intervals of the strings of
    that length are extended backward by every symbol of the transform. Where
    an extended interval ends and no shorter prefix has been found, the common
    prefix is the present length, and the interval goes on to the next level;
    where one has been found the interval is done (Beller et al., 2013).
    """
    n = len(text)
    before = text[order - 1]  # the transform
    step = np.empty(n, dtype=np.int64)  # the row of the suffix that is one symbol longer
    step[np.argsort(before, kind="stable")] = np.arange(n)
    head = text[order]
    found = np.full(n + 1, -1, dtype=np.int64)
    found[0] = found[n] = 0
    label = np.full(n, -1, dtype=np.int64)
    lo, hi = np.array([0]), np.array([n])
    for level in range(most):
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        to = step[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which]]
        label[to] = which
        to = np.sort(to)
        cut = np.flatnonzero((np.diff(to) != 1) | (np.diff(label[to]) != 0) | (np.diff(head[to]) != 0))
        lo, hi = to[np.concatenate(([0], cut + 1))], to[np.append(cut, len(to) - 1)] + 1
        new = found[hi] < 0
        found[hi[new]] = level
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
    return found[:n]


def prefix_classes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All starts of ``length``-byte strings that occur more than once in
    ``texts``: class, number of the text, place in it."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
    flat[ends - 1] = np.arange(len(texts))  # every text has an end of its own
    order = suffix_order(flat, length)
    lcp = prefix_lengths(flat, order, length)
    same = lcp < 0
    first = np.flatnonzero(~same)
    cls = np.cumsum(~same) - 1
    many = np.diff(np.append(first, len(order))) > 1
    on = many[cls]
    at = order[on]
    k = np.searchsorted(ends, at, side="right")
    return cls[on], k, at - (ends - sizes)[k]


def later_starts(segments: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """For segments (document, first start, bytes): runs (document, first
    start, number) of the strings that also start earlier in another one."""
    if len(segments) < 2:
        return []
    cls, k, place = prefix_classes([s for _, _, s in segments], length)
    doc = np.array([d for d, _, _ in segments], dtype=np.int64)[k]
    start = np.array([p for _, p, _ in segments], dtype=np.int64)[k] + place
    order = np.lexsort((start, doc, cls))
    cls, doc, start = cls[order], doc[order], start[order]
    later = np.append(False, cls[1:] == cls[:-1])[:len(cls)]
    doc, start = doc[later], start[later]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(start) != 1))[:len(doc)])
    number = np.diff(np.append(first, len(doc)))
    return list(zip(doc[first].tolist(), start[first].tolist(), number.tolist()))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(uid, id, text)`` where a smaller uid stands before a larger one. An
    integer id that is never null nor repeated is its own uid; otherwise the
    rows are sorted by id (null last) and text and numbered."""
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    if docs.select(col(id_col)).dtypes[0][1] in ("bigint", "int", "smallint", "tinyint"):
        row = (rows.groupBy("id").count().agg(F.max("count"), F.max(F.col("id").isNull().cast("int"))).first())
        if (row[0] or 0) < 2 and not row[1]:
            return rows.select(F.col("id").cast("long").alias("uid"), "id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    return saved(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text")
                 .select(F.monotonically_increasing_id().alias("uid"), "id", "text"), "repeats-docs")


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """``(uid, h, p, n)``: the segments whose anchor occurs more than once.

    A task finds the anchors of its own documents that repeat; of each anchor
    only the first occurrence in a stretch of about ``FLUSH`` anchors is
    looked up among all others, so a frequent anchor is a few rows per task.
    """
    ship(docs.sparkSession)

    def run(batches):
        held, count = [], 0

        def flush():
            h, uid, p, n = (np.concatenate(x) for x in zip(*held))
            _, first, where, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            c = np.zeros(len(h), dtype=np.int32)
            c[first] = np.minimum(times, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(uid), pa.array(p.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(c)], names=["h", "uid", "p", "n", "c"])

        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = np.frombuffer(text.as_buffer(), np.uint8)
                if len(b) < length:
                    continue
                h, p, n = anchors(b, length)
                held.append((h, np.full(len(h), uid, dtype=np.int64), p, n))
                count += len(h)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    found = docs.select("uid", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "h long, uid long, p int, n int, c int")
    # c: 0 a known repeat, 1 the only one of its task, 2 the first of several
    apart = Window.partitionBy("h", F.when(F.col("c") == 0, F.col("uid")))
    return (found.withColumn("m", F.count(F.lit(1)).over(apart)).filter("c <> 1 OR m > 1")
            .select("uid", "h", "p", "n"))


def _later_by_block(segments: DataFrame, length: int) -> DataFrame:
    """``(uid, p, n)``: runs of strings of the segments ``(h, uid, p, s)`` that
    start earlier in another segment of their anchor ``h``."""
    def run(batches):
        held: list[tuple[int, int, bytes]] = []
        group, key, size = [], None, 0

        def emit():
            rows = later_starts(held, length)
            return pa.RecordBatch.from_arrays([pa.array(list(x), type=t) for x, t in zip(
                zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.int32(), pa.int32()))], names=["uid", "p", "n"])

        for batch in batches:
            for h, uid, p, s in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if h != key:
                    held += group
                    group, key = [], h
                    if size >= BLOCK:
                        yield emit()
                        held, size = [], 0
                group.append((uid, p, s))
                size += len(s)
        held += group
        if held:
            yield emit()

    dealt = segments.select("h", "uid", "p", "s").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "uid long, p int, n int")


def _later_by_string(segments: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments: their strings meet under
    a 128-bit hash of their own, combined before the shuffle."""
    rows = saved(segments.select("uid", F.explode(F.transform(
        F.sequence(F.lit(0), F.octet_length("s") - length),
        lambda k: F.struct((F.col("p") + k).alias("p"), F.unhex(F.md5(F.substring("s", k + 1, F.lit(length)))).alias("w"))))
        .alias("x")).select("uid", "x.p", "x.w"), "repeats-strings")
    first = saved(rows.groupBy("w").agg(F.min(F.struct("uid", "p")).alias("f"), F.count(F.lit(1)).alias("k"))
                  .filter("k > 1"), "repeats-first")
    both = attach(rows, first, ["w"], "k", rows.count()).filter("f IS NOT NULL AND (f.uid <> uid OR f.p <> p)")
    return both.select("uid", "p", F.lit(1).alias("n"))


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """For ``docs`` (``uid, text``): the documents with segments that repeat,
    as ``uid, text, runs``, runs being ``(p, n)``: the n strings from byte p
    on start earlier too."""
    found = _segments(docs, length).groupBy("uid").agg(F.collect_list(F.struct("p", "n", "h")).alias("segs"))
    # a document's segments are as long as its text
    held = saved(docs.select("uid", "text").join(found, "uid"), "repeats-held")
    raw = F.col("text").cast("binary")
    digests = held.select("uid", F.explode(F.transform("segs", lambda r: F.struct(
        r.p.alias("p"), r.n.alias("n"), r.h.alias("h"),
        F.unhex(F.md5(F.substring(raw, r.p + 1, r.n + (length - 1)))).alias("m")))).alias("x")).select("uid", "x.*")
    # the earliest of byte-identical segments; it is combined before the shuffle
    first = saved(digests.groupBy("h", "m").agg(F.min(F.struct("uid", "p", "n")).alias("f"))
                  .select("h", "f.uid", "f.p", "f.n"), "repeats-earliest")
    many = first.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    mine = first.join(many, "h", "left").groupBy("uid").agg(
        F.collect_list(F.struct("p", "n", "h", F.coalesce("c", F.lit(1)).alias("c"))).alias("firsts"))
    split = held.join(mine, "uid", "left").withColumn(
        "firsts", F.coalesce("firsts", F.array().cast("array<struct<p:int,n:int,h:bigint,c:bigint>>")))
    # start and number in one integer: sets of integers are compared by hash
    packed = lambda r: F.shiftleft(r.p.cast("long"), 32) + r.n
    runs = saved(split.select("uid", F.array_except(
        F.transform("segs", packed), F.transform("firsts", packed)).alias("whole"),
        F.transform(F.filter("firsts", lambda r: r.c > 1), lambda r: F.struct(
            r.h.alias("h"), r.c.alias("c"), r.p.alias("p"),
            F.substring(raw, r.p + 1, r.n + (length - 1)).alias("s"))).alias("open")), "repeats-runs")
    segments = runs.select("uid", F.explode("open").alias("x")).select("uid", "x.*")
    later = _later_by_block(segments.filter(F.col("c") <= SEGMENTS), length)
    crowded = segments.filter(F.col("c") > SEGMENTS)
    if not crowded.isEmpty():
        later = later.unionByName(_later_by_string(crowded, length))
    every = (runs.select("uid", F.explode("whole").alias("x"))
             .select("uid", F.shiftright("x", 32).cast("int").alias("p"),
                     F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n"))
             .unionByName(later).groupBy("uid").agg(F.collect_list(F.struct("p", "n")).alias("runs")))
    return held.select("uid", "text").join(every, "uid", "left")


def cut(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """Bytes removed, spans removed and the rest of a text."""
    spans: list[list[int]] = []
    for p, n in sorted(runs):
        end = p + n - 1 + length
        if spans and p <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([p, end])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return sum(b - a for a, b in spans), len(spans), b"".join(kept)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                   kept_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans,
    kept_sha256``; with ``kept_text`` also the remaining ``text`` (a character
    that was cut in half is replaced).

    A byte goes if any ``length``-byte string that covers it also starts
    earlier: in a document with a smaller id, or earlier in the same one.
    Strings overlap, never cross documents, and are judged on the input. Null
    texts count as empty; texts shorter than ``length`` keep everything. Rows
    that repeat an id count as documents in the order of their texts' hashes,
    and rows with a null id come after all others. An empty table gives an
    empty result; other columns are not read.
    """
    rows = _numbered(docs, id_col, text_col)
    fields = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
                         StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]
                        + [StructField("kept", StringType())] * kept_text)
    held = saved(repeats(rows, length), "repeats-done") if kept_text else repeats(rows, length)

    def make():
        def run(batch):
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text.encode("utf-8", "replace")
                n, k, rest = cut(text, [(r["p"], r["n"]) for r in runs or ()], length)
                out.append((len(text), n, k, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace"))
                           [:len(fields)])
            return list(zip(*out)) if out else [[]] * len(fields)
        return run

    done = saved(map_batches(held.select("uid", "text", "runs"), make, fields).drop("text", "runs"), "repeats-cut")
    plain = [F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")]
    base = rows.select("uid", F.col("id").alias(id_col), *plain, *([F.col("text").alias("whole")] * kept_text))
    none = F.lit(0).cast("long")
    out = base.join(done.withColumnRenamed("n_bytes", "n_"), "uid", "left")
    return out.select(id_col, "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
                      F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
                      *([F.coalesce("kept", "whole").alias("text")] * kept_text))
