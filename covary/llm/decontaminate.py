"""Benchmark decontamination: one Aho-Corasick scan of every text."""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType)

from covary.llm._common import col, fresh, map_batches, saved, ship

#: Words of a window, and the share of hit words that contaminates (1 / 20).
WINDOW = 13
SHARE = 20
#: Bytes of windows in one automaton; more benchmark takes further scans.
AUTOMATON_BYTES = 32 << 20

# A-Z in lower case; every other ASCII character but digits and a-z a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))

_BUILT: dict = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """The windows of an item: ``size`` words in a row, or all of fewer."""
    if not words:
        return []
    return [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


def offsets(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in the original text, in characters."""
    import re
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


class Scanner:
    """An automaton over windows. A text is scanned in its normalised form,
    words joined and enclosed by single spaces, so that matches are whole
    words; an end position maps back to the word it ends with."""

    def __init__(self, windows: list[tuple[bytes, list]]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for window, items in windows:
            text = (b" " + window + b" ").decode("latin-1")
            self.automaton.add_word(text, (window.count(b" ") + 1, items))
        if windows:
            self.automaton.make_automaton()
        self.any = bool(windows)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans ``[first, last]`` that windows cover, and their items."""
        spans, items = [], set()
        if self.any and words:
            text = (b" " + b" ".join(words) + b" ").decode("latin-1")
            ends = None
            for at, (n, found) in self.automaton.iter(text):
                ends = ends or list(accumulate((len(w) + 1 for w in words)))
                last = bisect_right(ends, at - 1)  # the word before the closing space
                spans.append((last - n + 1, last))
                items.update(found)
        return merged(spans), items


def built(key, data) -> Scanner:
    """The automaton of a broadcast, built once in a Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Scanner(data.value)
    return _BUILT[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      size: int = WINDOW, nameless: bool = False) -> DataFrame:
    """``window`` (bytes), ``items`` (sorted ids as strings) and ``block``:
    the distinct windows, dealt to as many blocks as ``AUTOMATON_BYTES`` asks
    for. Items without words have none. Null ids are passed over, unless
    ``nameless``: then their windows count, without an id in ``items``."""
    ship(benchmark.sparkSession)

    def run(batches):
        for batch in batches:
            rows = {(w, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for w in windows_of(words_of(t), size)}
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], type=pa.binary()),
                                              pa.array([i for _, i in rows], type=pa.string())], names=["window", "item"])

    rows = (benchmark if nameless else benchmark.filter(col(id_col).isNotNull())).select(
        col(id_col).cast("string").alias("item"), col(text_col).cast("string").alias("text"))
    found = saved(rows.mapInArrow(run, "window binary, item string").groupBy("window").agg(
        F.sort_array(F.collect_set("item")).alias("items")), "bench-windows")
    total = found.agg(F.sum(F.length("window") + F.aggregate(
        "items", F.lit(0), lambda a, x: a + F.length(x) + 8))).first()[0] or 0
    blocks = -(-int(total) // AUTOMATON_BYTES) or 1
    return found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int"))


def scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, names: list[str], item_col: str = "item_id",
            item_text: str = "text", size: int = WINDOW, share: int = SHARE, nameless: bool = False) -> DataFrame:
    """Append ``names`` to every row: words, hit words, items, their hash, the
    verdict, and the hit spans as character offsets of the original text.

    One scan serves a benchmark of up to ``AUTOMATON_BYTES`` of windows. A
    larger one is dealt to blocks of about that size: the rows are numbered
    once, each block is a job of its own, with one automaton in a worker at a
    time, that leaves what it found as a small table, and the verdict is given
    over all of these.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item_col, item_text, size, nameless)
    blocks = sorted(r[0] for r in windows.select("block").distinct().collect()) or [0]  # one row per block
    fields = StructType([StructField(n, t) for n, t in zip(names, (
        LongType(), LongType(), LongType(), StringType(), BooleanType(), ArrayType(ArrayType(IntegerType()))))])

    def sent(block: int):
        rows = [(bytes(r.window), list(r["items"])) for r in windows.filter(F.col("block") == block).collect()]
        return spark.sparkContext.broadcast(rows), uuid.uuid4().hex

    def verdict(text: str | None, words: list[bytes], spans: list[tuple[int, int]], items: set) -> tuple:
        hit = sum(b - a + 1 for a, b in spans)
        chars = offsets(text) if spans else []
        return (len(words), hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                hit > 0 and share * hit >= len(words), [[chars[a][0], chars[b][1]] for a, b in spans])

    if len(blocks) == 1:
        at, (data, key) = docs.columns.index(text_col), sent(blocks[0])

        def at_once():
            scanner = built(key, data)

            def run(batch):
                out = []
                for text in batch.column(at).to_pylist():
                    words = words_of(text)
                    out.append(verdict(text, words, *scanner.scan(words)))
                return list(zip(*out)) if out else [[]] * len(fields)
            return run

        return map_batches(docs, at_once, fields)

    uid, key_col, spans_col, items_col = (
        fresh(x, [*docs.columns, *names]) for x in ("scan_uid", "found_uid", "found_spans", "found_items"))
    rows = saved(docs.withColumn(uid, F.monotonically_increasing_id()), "bench-docs")
    some = StructType([StructField("spans", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))])
    found = None
    for block in blocks:
        data, key = sent(block)

        def one_block(data=data, key=key):
            scanner = built(key, data)

            def run(batch):
                out = [scanner.scan(words_of(t)) for t in batch.column(1).to_pylist()]
                return [[[x for s in spans for x in s] for spans, _ in out], [sorted(items) for _, items in out]]
            return run

        part = map_batches(rows.select(col(uid).alias("uid"), col(text_col).alias("text")), one_block, some)
        part = saved(part.filter(F.size("spans") > 0).select("uid", "spans", "items"), "bench-found")
        data.unpersist()
        found = part if found is None else found.unionByName(part)
    # at most one row of each block, and no more spans than words
    found = found.groupBy(F.col("uid").alias(key_col)).agg(
        F.flatten(F.collect_list("spans")).alias(spans_col), F.flatten(F.collect_list("items")).alias(items_col))
    joined = rows.join(found, col(uid) == col(key_col), "left")
    at, spans_at, items_at = (joined.columns.index(c) for c in (text_col, spans_col, items_col))

    def together():
        def run(batch):
            out = []
            for text, flat, items in zip(*(batch.column(k).to_pylist() for k in (at, spans_at, items_at))):
                flat = flat or []
                out.append(verdict(text, words_of(text), merged(list(zip(flat[::2], flat[1::2]))), set(items or ())))
            return list(zip(*out)) if out else [[]] * len(fields)
        return run

    return map_batches(joined, together, fields).select(*[col(c) for c in (*docs.columns, *names)])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", size: int = WINDOW,
                  share: int = SHARE, nameless: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_hit, n_items, items_sha256,
    contaminated, hit_spans``.

    A word is hit if it lies inside an occurrence of a window of the
    benchmark; a row is contaminated if any word is hit and at least 1 in
    ``share`` words are. Null and wordless texts have no words and are clean,
    as is everything against an empty benchmark. Null and repeated ids are
    kept as they are, windows shared by items count for each, repeated items
    count once; an empty table gives an empty result; other columns are not
    read. Benchmark rows with a null id are passed over, unless ``nameless``:
    then their windows hit, and only the items leave them out. ``hit_spans`` are character offsets of the original text.
    """
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]
    rows = docs.select(col(id_col).alias("row_id"), col(text_col).cast("string").alias("row_text"))
    out = scanned(rows, benchmark, "row_text", names, item_col, item_text, size, share, nameless)
    return out.select(F.col("row_id").alias(id_col), *names)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The clean rows of ``docs``, all columns as they are. Benchmark rows
    with a null id count, unless ``nameless`` is false."""
    names = [fresh("contamination_" + x, docs.columns) for x in ("words", "hit", "items", "sha", "flag", "spans")]
    out = scanned(docs, benchmark, text_col, names, **{"nameless": True} | options)
    return out.filter(~F.col(names[4])).select(*[col(c) for c in docs.columns])
