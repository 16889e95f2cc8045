"""Merkle manifest of a dataset: a content-addressed tree of row digests.

Rows are leaves; per group (a source) the leaves in order are hashed by runs
of ``FANOUT`` until one node remains, and the groups' nodes likewise give one
root. The manifest stores *records*, digest -> children, and a proof is found
by descending them from the root by the digits of a row's rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.llm._common import col, saved

FANOUT = 16
#: Levels that any number of rows (a long) fits in.
MOST_LEVELS = 15


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text:
    no two rows run together to the same input."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the framed values, in their order."""
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


@dataclass
class Manifest:
    """``leaves`` (doc, leaf, probe, tree, rank), ``starts`` (one row per
    group: tree, depth, digest, path, subroot), ``records`` (digest ->
    children, by height above the leaves), ``depth`` of the deepest group,
    ``root`` (None without rows)."""

    leaves: DataFrame
    starts: DataFrame
    records: dict[int, DataFrame]
    depth: int
    root: str | None
    fanout: int


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``rank`` (0-based, in ``order`` inside ``group``), and one
    row per group with its count ``n``.

    Rows are dealt by range and sorted, so that a group of any size lies in
    neighbouring partitions; what comes before a partition's share of a group
    is a sum over the shares, of which there are at most groups + partitions.
    Equal rows are ranked as they come.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    at = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by)
               .withColumn("__at", F.monotonically_increasing_id()), name)
    at = at.withColumn("__part", F.shiftright("__at", 33))
    shares = at.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shares = saved(shares.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), name + "-shares")
    s = shares.select(*[F.col(c).alias("__g_" + c) for c in group], F.col("__part").alias("__p"), "__first", "__before")
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col("__g_" + c))
    ranked = at.join(s, same).select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("rank"))
    return ranked, shares.groupBy(*group).agg(F.sum("__n").alias("n"))


def levels(n: Column, fanout: int = FANOUT) -> Column:
    """How often runs of ``fanout`` are hashed until one of ``n`` nodes remains."""
    return sum((F.when(n > F.lit(fanout ** k), 1).otherwise(0) for k in range(MOST_LEVELS)), F.lit(0))


def grown(nodes: DataFrame, depth: int, fanout: int, name: str) -> tuple[DataFrame, dict[int, DataFrame]]:
    """From ``nodes`` (tree, rank, n, digest) the roots (tree, digest) and the
    records of each height; trees of one node are their own root."""
    roots, records = nodes.filter("n = 1").select("tree", "digest"), {}
    for height in range(1, depth + 1):
        run = F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        up = (nodes.filter("n > 1")
              .groupBy("tree", F.expr(f"rank div {fanout}").alias("up"),
                       F.expr(f"(n + {fanout - 1}) div {fanout}").alias("m"))
              .agg(run.alias("children")))
        up = saved(up.select("tree", F.col("up").alias("rank"), F.col("m").alias("n"),
                             F.sha2(F.array_join("children", ""), 256).alias("digest"), "children"), f"{name}-{height}")
        # content-addressed: equal runs of repeated rows are one record
        records[height] = saved(up.groupBy("digest").agg(F.first("children").alias("children")), f"{name}-records-{height}")
        nodes = up.select("tree", "rank", "n", "digest")
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", "digest"))
    return roots, records


START = "tree long, depth int, digest string, path array<struct<before:string,after:string>>"


def descend(starts: DataFrame, records: dict[int, DataFrame], asked: DataFrame, depth: int,
            fanout: int = FANOUT) -> DataFrame:
    """Follow the digits of each asked rank from the start of its tree.

    ``starts``: tree, depth, digest, path and what else is to be carried (by
    other names than these and those of ``asked``);
    ``asked``: tree, rank and what else. At each height the records of the
    nodes reached are opened, the child that the digit names is taken and its
    siblings go to the path, so nodes that several ranks share are opened
    once. Returns rank, digest, path (from the root down) and all that was
    carried; ranks beyond their tree are not found.
    """
    rest = [c for c in starts.columns if c not in ("tree", "depth", "digest", "path")]
    extra = [c for c in asked.columns if c not in ("tree", "rank")]
    frontier = None
    for height in range(depth, 0, -1):
        here = starts.filter(F.col("depth") == height).select(
            "tree", F.lit(0).cast("long").alias("prefix"), "digest", "path", *rest)
        frontier = here if frontier is None else frontier.unionByName(here)
        last = height == 1
        level = asked if last else asked.select(
            "tree", F.expr(f"rank div {fanout ** (height - 1)}L").alias("rank")).distinct()
        level = level.select(F.col("tree").alias("__tree"), F.expr(f"rank div {fanout}").alias("__up"), "rank",
                             *(extra if last else []))
        digit = F.pmod("rank", F.lit(fanout)).cast("int")
        siblings = F.struct(F.array_join(F.slice("children", F.lit(1), digit), "").alias("before"),
                            F.array_join(F.slice("children", digit + 2, F.lit(fanout)), "").alias("after"))
        frontier = (frontier.join(records[height], "digest")
                    .join(level, (F.col("tree") == F.col("__tree")) & (F.col("prefix") == F.col("__up")))
                    .filter(digit < F.size("children"))
                    .select("tree", F.col("rank").alias("prefix"), F.get("children", digit).alias("digest"),
                            F.concat("path", F.array(siblings)).alias("path"), *rest, *(extra if last else [])))
    alone = (starts.filter("depth = 0").join(asked.filter("rank = 0"), "tree")
             .select("tree", F.col("rank").alias("prefix"), "digest", "path", *rest, *extra))
    found = alone if frontier is None else frontier.unionByName(alone)
    return found.withColumnRenamed("prefix", "rank")


def manifest(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "source",
             probe: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """Hash every row and build the trees.

    ``fields`` are framed in that order. Leaves ascend by ``id_col`` (null
    first; rows that share an id by their digest) inside a group; groups
    ascend by the bytes of their name, null first. ``probe`` is a digest to
    be tested against the manifest later, null where the row's own leaf is to
    be. An empty table has no root, and no proofs. Columns not named are not
    read.
    """
    rows = docs.select(col(group_col).alias("g"), col(id_col).alias("doc"),
                       leaf_digest([col(c) for c in fields]).alias("leaf"),
                       (probe if probe is not None else F.lit(None)).cast("string").alias("probe"))
    ranked, groups = numbered(rows, ["g"], ["doc", "leaf"], "merkle-leaves")
    trees, _ = numbered(groups, [], ["g"], "merkle-groups")
    trees = saved(trees.select("g", "n", F.col("rank").alias("tree"), levels(F.col("n"), fanout).alias("depth")),
                  "merkle-trees")
    t = trees.select(F.col("g").alias("__g"), "n", "tree")
    leaves = saved(ranked.join(t, F.col("g").eqNullSafe(F.col("__g"))).select(
        "doc", "leaf", "probe", "tree", "rank", "n"), "merkle-ranked")
    size = trees.agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("trees")).first()
    depth, count, top = size["depth"] or 0, size["trees"], 0
    while fanout ** top < count:
        top += 1
    subroots, records = grown(leaves.select("tree", "rank", "n", F.col("leaf").alias("digest")), depth, fanout, "merkle")
    subroots = saved(subroots, "merkle-subroots")

    # the groups' own tree, descended in the same way
    zero = F.lit(0).cast("long")
    roots, above = grown(subroots.select(zero.alias("tree"), F.col("tree").alias("rank"),
                                         F.lit(count).cast("long").alias("n"), "digest"), top, fanout, "merkle-top")
    root = roots.select("digest").first()
    root = root["digest"] if root else None
    start = docs.sparkSession.createDataFrame([(0, top, root, [])] if root else [], START)
    reached = descend(start, above, trees.select(zero.alias("tree"), F.col("tree").alias("rank"),
                                                F.col("depth").alias("levels")), top, fanout)
    starts = saved(reached.select(F.col("rank").alias("tree"), F.col("levels").alias("depth"), "digest", "path",
                                  F.col("digest").alias("subroot")), "merkle-starts")
    return Manifest(leaves.drop("n"), starts, records, depth, root, fanout)


def proofs(of: Manifest, asked: DataFrame | None = None) -> DataFrame:
    """``doc, leaf, subroot, root, proof, probe`` of the asked leaves (rows of
    ``of.leaves``; all of them by default).

    ``proof`` holds, from the leaf's run up to the root, the siblings to the
    left (``before``) and to the right (``after``) as joined digests. The
    leaf is the one the manifest holds at that place.
    """
    asked = (of.leaves if asked is None else asked).select("tree", "rank", "doc", "probe")
    found = descend(of.starts, of.records, asked, of.depth, of.fanout)
    return found.select("doc", F.col("digest").alias("leaf"), "subroot", F.lit(of.root).cast("string").alias("root"),
                        F.reverse("path").alias("proof"), "probe")


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def verified(docs: DataFrame, fields: Sequence[str], probe: Column | None = None, id_col: str = "doc_id",
             group_col: str = "source", fanout: int = FANOUT) -> DataFrame:
    """One row per input row: ``id_col, leaf, subroot, root, proof_sha256,
    folded_root, verified`` -- does the ``probe`` (else the row's own leaf)
    lead to the root? See :func:`manifest` for nulls, repeats and order; an
    empty table gives an empty result."""
    found = proofs(manifest(docs, fields, id_col, group_col, probe, fanout))
    found = found.withColumn("folded_root", folded(F.coalesce("probe", "leaf"), F.col("proof")))
    return found.select(F.col("doc").alias(id_col), "leaf", "subroot", "root",
                        siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
