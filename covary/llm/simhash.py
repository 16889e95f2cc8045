"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from covary.llm._common import attach, col, fresh, map_batches, saved, ship
from covary.llm.components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fingerprints of a tile (64 KB); a comparison holds one block of BLOCK x BLOCK.
TILE = 8192
BLOCK = 2048
#: Below this size groups of equal population counts are not split further.
SPLIT = 1024
#: Tiles of a cell that meet those of another in one group of rows.
GROUP = 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of ``words`` words: bit i is 1 if it is set in
    over half of the shingles' XXH64. No words give 0."""
    import xxhash
    parts = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not parts:
        return 0
    if len(parts) <= words:
        digests = xxhash.xxh64_digest(b" ".join(parts), seed)
    else:
        flat = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        dig = xxhash.xxh64_digest
        digests = b"".join([dig(flat[s:e], seed) for s, e in
                            zip(starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist())])
    raw = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(raw), 65536):
        counts += np.unpackbits(raw[k:k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str, out: str, words: int = 4, seed: int = 42) -> DataFrame:
    """Append the fingerprint as a signed 64-bit integer."""
    at = docs.columns.index(text_col)

    def make():
        def run(batch: pa.RecordBatch):
            prints = [fingerprint(t.as_py(), words, seed) for t in batch.column(at)]
            return [np.array(prints, dtype=np.uint64).view(np.int64)]
        return run

    return map_batches(docs, make, StructType([StructField(out, LongType())]))


def _counts(x: np.ndarray, width: int) -> np.ndarray:
    """Population counts of the parts of ``width`` bits, one row per value."""
    parts = x[:, None].view({32: np.uint32, 16: np.uint16, 8: np.uint8}[width])
    return np.bitwise_count(parts).astype(np.int16)


def _split(x: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """``x`` in groups of equal population counts, with those counts."""
    keys = _counts(x, width)
    order = np.lexsort(keys.T)
    x, keys = x[order], keys[order]
    cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    return keys[np.concatenate(([0], cut))], np.split(x, cut), cut


def _near(a: np.ndarray, b: np.ndarray, radius: int, width: int = 16):
    """Blocks ``(rows, cols, a, b)`` of pairs within ``radius`` bits. Large
    tiles are split by the population counts of ever smaller parts; the sum
    of their differences is a lower bound of the distance, so groups farther
    apart than the radius are skipped."""
    if width >= 8 and len(a) > SPLIT and len(b) > SPLIT:
        ka, ga, _ = _split(a, width)
        kb, gb, _ = _split(b, width)
        gap = np.abs(ka[:, None, :] - kb[None, :, :]).sum(axis=2)
        if gap.size * 64 < len(a) * len(b):
            for i, j in zip(*np.nonzero(gap <= radius)):
                yield from _near(ga[i], gb[j], radius, width // 2)
            return
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            x, y = a[i:i + BLOCK], b[j:j + BLOCK]
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if len(r):
                yield r, c, x, y


def _forest(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (smallest member, member) of the components of the pairs:
    at most one per node, however many pairs there are."""
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        nxt = root.copy()
        np.minimum.at(nxt, root[left], low)
        np.minimum.at(nxt, root[right], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[moved]], nodes[moved]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever is linked between two tiles of sorted,
    distinct fingerprints (one tile with itself when they are the same)."""
    heads, members = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for r, c, x, y in _near(a, b, radius):
        both = np.union1d(x[np.unique(r)], y[np.unique(c)])
        u, v = _forest(both, np.searchsorted(both, x[r]), np.searchsorted(both, y[c]))
        heads.append(u)
        members.append(v)
    u, v = np.concatenate(heads), np.concatenate(members)
    if not len(u):
        return u, v
    both = np.union1d(u, v)
    return _forest(both, np.searchsorted(both, u), np.searchsorted(both, v))


def fingerprint_links(prints: DataFrame, print_col: str = "fp", radius: int = 4) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints linked by
    chains of pairs within ``radius`` bits.

    Fingerprints are dealt to cells by the population counts of their two
    halves (at most 33 x 33 cells) and packed into tiles of about ``TILE``
    values. Two cells meet only if the counts differ by ``radius`` at most in
    sum, a lower bound of the distance; every tile of the one is then
    compared with every tile of the other, exactly. A pair of tiles yields a
    spanning forest of its links, never all pairs. Tiles of a cell meet others
    ``GROUP`` by ``GROUP``, so that a cell with most of the tiles is spread
    over as many keys as it has pairs of groups.
    """
    ship(prints.sparkSession)
    fp = F.col(print_col)
    cells = saved(prints.select(fp.alias("fp")).distinct().select(
        "fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("u"),
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("v")), "simhash-cells")
    parts = saved(cells.groupBy("u", "v").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")),
                  "simhash-parts")  # 1,089 rows at most
    tiles = saved(cells.join(F.broadcast(parts), ["u", "v"])
                  .withColumn("k", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
                  .groupBy("u", "v", "k").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "simhash-tiles")
    # each unordered pair of cells once: the offset (0, 0) or a positive one
    near = [(x, y) for x in range(0, radius + 1) for y in range(-radius, radius + 1)
            if x + abs(y) <= radius and (x, y) >= (0, 0)]
    shift = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in near]))
    groups = F.broadcast(parts.select(F.col("u").alias("ou"), F.col("v").alias("ov"),
                                      F.expr(f"(tiles - 1) div {GROUP}").alias("last")))

    def met(sign: int, mine: str, other: str, names: list[str]) -> DataFrame:
        """Each tile once per cell that it meets and group of that cell's tiles."""
        rows = tiles.select("u", "v", "k", "fps", shift.alias("to"))
        at = (F.col("u") + sign * F.col("to.x") == F.col("ou")) & (F.col("v") + sign * F.col("to.y") == F.col("ov"))
        rows = rows.join(groups, at).select(
            "u", "v", "to", "ou", "ov", F.expr(f"k div {GROUP}").alias(mine), "k", "fps",
            F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias(other))
        cell = ("u", "v") if sign > 0 else ("ou", "ov")
        return rows.select(F.col(cell[0]).alias("cu"), F.col(cell[1]).alias("cv"), F.col("to.x").alias("x"),
                           F.col("to.y").alias("y"), F.col(mine), F.col(other),
                           F.col("k").alias(names[0]), F.col("fps").alias(names[1])).filter(
            "x <> 0 OR y <> 0 OR ga <= gb")

    pairs = met(1, "ga", "gb", ["ka", "fa"]).join(met(-1, "gb", "ga", ["kb", "fb"]), ["cu", "cv", "x", "y", "ga", "gb"])
    pairs = pairs.filter("x <> 0 OR y <> 0 OR ka <= kb").select("fa", "fb")

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = (np.sort(z.values.to_numpy(zero_copy_only=False).view(np.uint64)) for z in (x, y))
                u, v = tile_links(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                radius: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (16 hex digits),
    ``component_id, component_size, kept``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id``
    is the smallest id in the component. Null and wordless texts have
    fingerprint zero and link like any other; equal texts, and rows that
    repeat an id, have equal fingerprints and so share a component. Null ids
    never become a component id unless the component holds no other.
    ``kept`` marks one row per component: the one whose id is the component's,
    the first read among repeated rows. An empty table gives an empty result;
    other columns are not read.
    """
    rows = saved(with_fingerprint(docs.select(col(id_col).alias("id"), col(text_col).alias("text")),
                                  "text", "fp", words, seed)
                 .select("id", "fp", F.monotonically_increasing_id().alias("uid")), "simhash-rows")
    return _grouped(rows, radius).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"), F.col("size").alias("component_size"),
        (F.col("best.uid") == F.col("uid")).alias("kept"))


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """Saved ``rows`` (id, fp, uid) with ``size`` and ``best`` (the row that
    stays) of their component."""
    links = connected_components(fingerprint_links(rows, "fp", radius)).select(
        F.col("node").alias("fp"), "root")
    first = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "uid"))
    prints = (rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
              .join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    prints = saved(prints, "simhash-prints")
    total = rows.count()
    roots = saved(prints.groupBy("root").agg(
        F.min("first").alias("best"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("m")), "simhash-roots")
    classes = saved(attach(prints.select("fp", "n", "root"), roots, ["root"], "m", total)
                    .select("fp", "n", "best", "size"), "simhash-classes")
    return attach(rows, classes, ["fp"], "n", total)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                     radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that :func:`near_groups` keeps, all columns as
    they are. Of rows that repeat both id and fingerprint one stays, of ties
    the smallest id, a null id last; null and wordless texts share fingerprint
    zero; an empty table stays empty. Fingerprints are computed once, into a
    scratch table that numbers its rows."""
    uid, fp, key = (fresh(x, docs.columns) for x in ("row_uid", "row_fp", "kept_uid"))
    rows = saved(with_fingerprint(docs, text_col, fp, words).withColumn(uid, F.monotonically_increasing_id()),
                 "simhash-docs")
    kept = _grouped(rows.select(col(id_col).alias("id"), col(fp).alias("fp"), col(uid).alias("uid")), radius).filter(
        "best.uid = uid").select(F.col("uid").alias(key))
    return rows.join(kept, col(uid) == col(key), "left_semi").select(*[col(c) for c in docs.columns])
