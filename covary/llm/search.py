"""Ranked lexical search over sharded inverted lists (Block-Max MaxScore).

Every task turns the documents it reads into shards: per term a list of
postings, cut into blocks of neighbouring documents, with the largest impact
of each block beside the packed postings. A query splits a shard's lists by
their largest scores into essential ones, without which no document can enter
the heap, and the rest; block maxima then reject candidates before a block of
the rest is unpacked. The heaps of the shards are merged by Spark.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from covary.llm._common import col, saved, ship
from covary.llm.decontaminate import words_of

#: Neighbouring documents of a block; a place inside it is one byte.
BLOCK = 128
#: A shard ends with the document that brings it to so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 4_000_000, 65_536
#: Bytes of terms that are sent along to keep all other terms out of the index.
FILTER_BYTES = 32 << 20
#: Bytes of query terms that one pass over the index answers.
QUERY_BYTES = 8 << 20

_SENT: dict = {}


def _value(key, data):
    """What a broadcast holds, prepared once in a Python worker."""
    if key not in _SENT:
        _SENT.clear()
        _SENT[key] = data.value
    return _SENT[key]


def lengths(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and the terms of all documents."""
    def run(batches):
        for batch in batches:
            n = [len(words_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(1 for x in n if x)], type=pa.int64()),
                                              pa.array([sum(n)], type=pa.int64())], names=["docs", "terms"])

    ship(docs.sparkSession)
    row = docs.select(col(text_col).cast("string").alias("t")).mapInArrow(run, "docs long, terms long").agg(
        F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return int(row["docs"] or 0), int(row["terms"] or 0)


def norm(n, docs: int, terms: int):
    """A document's length norm, in hundredths."""
    return 100 - 75 + (75 * n * docs) // max(1, terms)


def impact(tf, m):
    """What one occurrence count adds per unit of a term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Shard:
    """Postings of some documents, packed when the shard is full."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms
        self.ids, self.lens, self.counts = [], [], array("l")
        self.term, self.tf, self.known = array("i"), array("i"), {}

    def add(self, doc, n: int, found: Counter) -> None:
        self.ids.append(doc)
        self.lens.append(n)
        self.counts.append(len(found))
        known = self.known
        self.term.extend([known.setdefault(w, len(known)) for w in found])
        self.tf.extend(found.values())

    @property
    def full(self) -> bool:
        return len(self.term) >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def packed(self):
        """Ids and norms in ascending order of id, and per term: name, number
        of postings, blocks, where they start, their maxima, the places (one
        byte each), the counts less one (a byte, 255 and above listed apart)."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        ids = [self.ids[i] for i in order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        m = norm(np.array(self.lens, dtype=np.int64), self.docs, self.terms)
        doc = np.repeat(np.arange(len(order)), np.frombuffer(self.counts, dtype=np.int64))
        term, tf = np.frombuffer(self.term, dtype=np.int32), np.frombuffer(self.tf, dtype=np.int32).astype(np.int64)
        gain, at = impact(tf, m[doc]), place[doc]
        by = np.lexsort((at, term))
        term, tf, gain, at = term[by], tf[by], gain[by], at[by]
        block = at // BLOCK
        first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)]) if len(term) else np.zeros(0, np.int64)
        maxima = np.maximum.reduceat(gain, first) if len(first) else first
        lists = np.searchsorted(term, np.arange(len(self.known) + 1))       # postings of each term
        blocks = np.searchsorted(first, lists)                              # blocks of each term
        big = np.flatnonzero(tf > 255)
        return ids, m[order], {
            "term": list(self.known), "lists": lists, "blocks": blocks, "block": block[first].astype(np.int32),
            "start": (first - np.repeat(lists[:-1], np.diff(blocks))).astype(np.int32), "max": maxima.astype(np.int32),
            "at": (at % BLOCK).astype(np.uint8), "tf": np.minimum(tf - 1, 255).astype(np.uint8),
            "bigs": np.searchsorted(big, lists), "big_at": (big - lists[term[big]]).astype(np.int32), "big_tf": tf[big].astype(np.int32)}


def _spread(values: np.ndarray, bounds: np.ndarray, lo: int, hi: int, kind) -> pa.Array:
    """``values`` as one list (or byte string) for each of the terms lo..hi."""
    offsets = pa.array((bounds[lo:hi + 1] - bounds[lo]).astype(np.int32), type=pa.int32())
    part = values[bounds[lo]:bounds[hi]]
    if kind == "bytes":
        return pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets.buffers()[1], pa.py_buffer(part.tobytes())])
    return pa.ListArray.from_arrays(offsets, pa.array(part, type=pa.int32()))


def _rows(name: str, shard: Shard, schema: pa.Schema, step: int = 20_000):
    ids, norms, p = shard.packed()
    none = lambda n, f: pa.nulls(n, type=f.type)
    head = {"shard": [name], "ids": [ids], "norms": [norms.tolist()]}
    yield pa.RecordBatch.from_arrays([pa.array(head[f.name], type=f.type) if f.name in head else none(1, f)
                                      for f in schema], schema=schema)
    for lo in range(0, len(p["term"]), step):
        hi = min(lo + step, len(p["term"]))
        cols = {"shard": pa.array([name] * (hi - lo)), "term": pa.array(p["term"][lo:hi], type=pa.binary()),
                "df": pa.array(np.diff(p["lists"][lo:hi + 1]), type=pa.int64()),
                "blocks": _spread(p["block"], p["blocks"], lo, hi, "list"),
                "starts": _spread(p["start"], p["blocks"], lo, hi, "list"),
                "maxima": _spread(p["max"], p["blocks"], lo, hi, "list"),
                "places": _spread(p["at"], p["lists"], lo, hi, "bytes"),
                "counts": _spread(p["tf"], p["lists"], lo, hi, "bytes"),
                "big_at": _spread(p["big_at"], p["bigs"], lo, hi, "list"),
                "big_tf": _spread(p["big_tf"], p["bigs"], lo, hi, "list")}
        yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else none(hi - lo, f)
                                          for f in schema], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                terms: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """The index as a table of the shared folder, and the two counts that its
    norms rest on (:func:`lengths`).

    A shard has one row with its ids and norms (``term`` null) and one per
    term. With ``terms`` (a column ``term``) the index may leave out all
    others; it does while their bytes stay below ``FILTER_BYTES``, and holds
    every term otherwise. Null texts and texts without a term are in no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    n_docs, n_terms = lengths(rows)
    sent, key = None, uuid.uuid4().hex
    if terms is not None:
        names = terms.select("term").distinct()
        size = names.agg(F.sum(F.length("term") + 50)).first()[0] or 0
        if size <= FILTER_BYTES:
            sent = spark.sparkContext.broadcast(frozenset(bytes(r.term) for r in names.collect()))
    id_type = rows.schema["id"].dataType
    out = StructType([StructField("ids", ArrayType(id_type)), StructField("norms", ArrayType(LongType()))])
    ddl = ("shard string, term binary, df long, blocks array<int>, starts array<int>, maxima array<int>, "
           "places binary, counts binary, big_at array<int>, big_tf array<int>")
    out = StructType(list(StructType.fromDDL(ddl).fields) + list(out.fields))
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out, prefers_large_types=False)

    def run(batches):
        only = _value(key, sent) if sent is not None else None
        task, k, shard = TaskContext.get().partitionId(), 0, Shard(n_docs, n_terms)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                shard.add(doc, len(words), Counter(words if only is None else [w for w in words if w in only]))
                if shard.full:
                    yield from _rows(f"{task}-{k}", shard, schema)
                    k, shard = k + 1, Shard(n_docs, n_terms)
        if shard.ids:
            yield from _rows(f"{task}-{k}", shard, schema)

    return saved(rows.mapInArrow(run, out), "search-index"), n_docs, n_terms


class Postings:
    """One term's list in one shard."""

    __slots__ = ("blocks", "starts", "maxima", "places", "counts", "big_at", "big_tf", "top", "row")

    def __init__(self, row: dict):
        as_ints = lambda x: np.asarray(x, dtype=np.int64)
        self.blocks, self.maxima = as_ints(row["blocks"]), as_ints(row["maxima"])
        self.starts = np.append(as_ints(row["starts"]), len(row["places"]))
        self.places, self.counts = row["places"], row["counts"]
        self.big_at, self.big_tf = as_ints(row["big_at"]), as_ints(row["big_tf"])
        self.top = int(self.maxima.max())
        self.row = None

    def where(self, n_blocks: int) -> np.ndarray:
        """Index of each block of the shard in this list, -1 where it has none."""
        if self.row is None:
            self.row = np.full(n_blocks, -1, dtype=np.int64)
            self.row[self.blocks] = np.arange(len(self.blocks))
        return self.row

    def unpack(self, i: int, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of block ``i`` of the list."""
        a, b = self.starts[i], self.starts[i + 1]
        at = np.frombuffer(self.places, dtype=np.uint8, count=b - a, offset=a).astype(np.int64)
        tf = np.frombuffer(self.counts, dtype=np.uint8, count=b - a, offset=a).astype(np.int64) + 1
        if len(self.big_at):
            lo, hi = np.searchsorted(self.big_at, (a, b))
            tf[self.big_at[lo:hi] - a] = self.big_tf[lo:hi]
        return at, impact(tf, norms[at + self.blocks[i] * BLOCK])


def best(lists: list[tuple[Postings, int]], norms: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` highest (score, place) with a score above 0, of equal scores
    the lower places; ``lists`` are postings and weights."""
    n_blocks = -(-len(norms) // BLOCK)
    lists = sorted(((p, w) for p, w in lists if w > 0), key=lambda x: x[0].top * x[1])
    if not lists:
        return []
    reach = np.cumsum([p.top * w for p, w in lists])        # what the lists up to i can give at most
    rows = [p.where(n_blocks) for p, _ in lists]
    bound = np.zeros((len(lists), n_blocks), dtype=np.int64)
    for i, (p, w) in enumerate(lists):
        bound[i, p.blocks] = p.maxima * w
    below = np.cumsum(bound, axis=0)                          # the same per block
    heap: list[tuple[int, int]] = []
    theta = essential = 0
    for b in np.flatnonzero(below[-1] > 0):
        if below[-1, b] <= theta or not (bound[essential:, b] > 0).any():
            continue
        score, seen = np.zeros(BLOCK, dtype=np.int64), np.zeros(BLOCK, dtype=bool)
        for i in range(len(lists) - 1, essential - 1, -1):
            if rows[i][b] >= 0:
                at, gain = lists[i][0].unpack(rows[i][b], norms)
                score[at] += gain * lists[i][1]
                seen[at] = True
        for i in range(essential - 1, -1, -1):
            seen &= score + below[i, b] > theta               # rejected without unpacking
            if not seen.any():
                break
            if rows[i][b] >= 0:
                at, gain = lists[i][0].unpack(rows[i][b], norms)
                score[at] += gain * lists[i][1]
        found = np.flatnonzero(seen & (score > theta))
        if not len(found):
            continue
        # places ascend, so a later document of equal score never displaces one
        heap = sorted(heap + [(int(score[x]), int(b) * BLOCK + int(x)) for x in found], key=lambda s: (-s[0], s[1]))[:k]
        if len(heap) == k and heap[-1][0] > theta:
            theta = heap[-1][0]
            essential = int(np.searchsorted(reach, theta, side="right"))
            if essential == len(lists):
                break
    return heap


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, item, term, n``: the terms of each row, counted."""
    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            rows, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for row, item, text in zip(rows, ids, texts):
                for term, n in Counter(words_of(text)).items():
                    for c, v in zip(out, (row, item, term, n)):
                        c.append(v)
            types = (pa.int64(), batch.schema.field(1).type, pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)],
                                             names=["row", "item", "term", "n"])

    ship(items.sparkSession)
    rows = items.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("item"),
                        col(text_col).cast("string").alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    return saved(rows.mapInArrow(run, f"row long, item {kind}, term binary, n long"), "search-terms")


def _searcher(sent, key: str, k: int):
    """All queries of a pass against the shard that a group of rows is."""
    def run(table):
        asked = _value(key, sent)
        ids, norms, by = None, None, {}
        for row in table.to_pylist():
            if row["term"] is None:
                ids, norms = row["ids"], np.array(row["norms"], dtype=np.int64)
            else:
                by[row["term"]] = Postings(row)
        out = ([], [], [])
        for number, terms in asked.items():
            for score, at in best([(by[t], w) for t, w in terms if t in by], norms, k):
                for c, v in zip(out, (number, ids[at], score)):
                    c.append(v)
        kinds = (pa.int64(), table.schema.field("ids").type.value_type, pa.int64())
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds)], names=["row", "doc", "score"])
    return run


def search(index: DataFrame, n_docs: int, asked: DataFrame, k: int = 10) -> DataFrame:
    """``row, item, rank, doc, score``: the ``k`` best documents of the index
    for each row of ``asked`` (from :func:`query_terms`)."""
    spark = index.sparkSession
    lists = index.filter(F.col("term").isNotNull())
    known = asked.select("term").distinct()
    df = lists.groupBy("term").agg(F.sum("df").alias("df")).join(known, "term", "left_semi")
    # in doubles, as the formula is meant
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (F.col("df") * 2 + 1).cast("double")))
    weighted = saved(asked.join(df, "term").withColumn("w", weight.cast("long")), "search-weights")
    size = weighted.agg(F.sum(F.length("term") + 60)).first()[0] or 0
    passes = -(-int(size) // QUERY_BYTES) or 1
    heads = index.filter(F.col("term").isNull())
    doc_type = index.schema["ids"].dataType.elementType.simpleString()
    found = None
    for turn in range(passes):
        mine = weighted.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == turn)
        queries = defaultdict(list)
        for r in mine.select("row", "term", "n", "w").collect():   # QUERY_BYTES at most, about
            queries[r["row"]].append((bytes(r["term"]), r["n"] * r["w"]))
        sent, key = spark.sparkContext.broadcast(dict(queries)), uuid.uuid4().hex

        needed = lists.join(mine.select("term").distinct(), "term", "left_semi").select(*index.columns)
        heap = heads.unionByName(needed).groupBy("shard").applyInArrow(_searcher(sent, key, k), f"row long, doc {doc_type}, score long")
        found = heap if found is None else found.unionByName(heap)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.groupBy(F.col("row").alias("r")).agg(F.first("item").alias("item"))
    return top.join(names, F.col("row") == F.col("r")).select("row", "item", "rank", "doc", "score")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """One row per item and hit: ``item_col, rank, id_col, score``, the ``k``
    highest scores above 0 of each item, equal ones by ascending id.

    Every row of ``docs`` is a document of its own, so repeated ids and texts
    all take places; a null id comes after all others of its score. Every row
    of ``items`` is a query of its own, a null id too. Null texts, texts
    without a term, terms that no document holds, empty tables: no rows.
    Columns not named are not read.
    """
    asked = query_terms(items, item_col, item_text)
    index, n_docs, _ = build_index(docs, id_col, text_col, asked)
    return search(index, n_docs, asked, k).select(
        F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
