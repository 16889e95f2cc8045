"""Exact deduplication: 128-bit content hash, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.llm._common import HOT_SHARE, attach, col, fresh, saved

#: Deleted before texts are compared: space and the controls 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _collided(docs: DataFrame, groups: DataFrame, text: str, hashed, total: int) -> DataFrame:
    """Hashes under which different normalised texts meet (as a rule none).

    Only groups of two and more are compared. Their texts meet on (hash,
    salt): a hot group is spread over as many salts as it holds
    ``total / HOT_SHARE`` rows. Each piece is reduced to its smallest and
    largest text before the pieces of a group meet: equal bytes everywhere if
    and only if those two are equal.
    """
    limit = max(1000, total // HOT_SHARE)
    dup = groups.filter("n > 1").select("h", F.ceil(F.col("n") / limit).cast("long").alias("salts"))
    norm = normalised(col(text))
    rows = docs.select(hashed(norm).alias("h"), norm.alias("t"))
    hot = dup.filter("salts > 1")
    salt = F.lit(0).cast("long")
    if not hot.isEmpty():
        # at most HOT_SHARE rows
        rows = rows.join(F.broadcast(hot), "h", "left")
        salt = F.when(F.col("salts").isNull(), salt).otherwise(
            F.pmod(F.monotonically_increasing_id(), F.col("salts")))
    rows = rows.select("h", "t", salt.alias("s"))
    keys = dup.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("s"))
    parts = rows.join(keys, ["h", "s"], "left_semi").groupBy("h", "s").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"))
    return parts.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(
        "lo <> hi").select("h")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hashed=content_hash) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256,
    code_points``.

    Texts are equal when the same bytes remain after blanks are deleted. Of
    equal texts the row with the most code points stays, then the one with
    the smallest id, then (repeated rows) the first one read; a null id comes
    after all others. Null texts count as empty, and all empty texts are
    equal. Rows group on a 128-bit hash; :func:`_collided` compares the bytes
    inside groups, and should two texts share a hash, those groups are formed
    on the bytes themselves. An empty table gives an empty result. Columns
    other than the two named ones are not read.
    """
    norm = normalised(col(text_col))
    slim = saved(docs.select(
        col(id_col).alias("id"), F.coalesce(F.char_length(col(text_col)), F.lit(0)).alias("cp"),
        hashed(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("uid"), F.lit(0).cast("long").alias("sub")), "exact-rows")
    best = F.min(F.struct((-F.col("cp")).alias("cp"), F.col("id").isNull().alias("x"), "id", "uid"))

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h", "sub").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))

    groups = saved(grouped(slim), "exact-groups")
    total = slim.count()
    bad = saved(_collided(docs, groups, text_col, hashed, total), "exact-collided")
    if not bad.isEmpty():
        full = saved(docs.select(
            col(id_col).alias("id"), F.coalesce(F.char_length(col(text_col)), F.lit(0)).alias("cp"),
            hashed(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256"), norm.alias("t"),
            F.monotonically_increasing_id().alias("uid")).join(bad, "h", "left_semi"), "exact-full")
        subs = full.groupBy("h", "t").agg((F.min("uid") + 1).alias("sub"))
        slim = saved(slim.join(bad, "h", "left_anti").unionByName(
            full.join(subs, ["h", "t"]).select(*slim.columns)), "exact-rows")
        groups = saved(grouped(slim), "exact-groups")
    out = attach(slim, groups, ["h", "sub"], "n", total)
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"),
                      F.col("n").alias("group_size"), (F.col("best.uid") == F.col("uid")).alias("kept"),
                      "text_sha256", F.col("cp").cast("long").alias("code_points"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, all columns as
    they are. Of rows that repeat both id and text one stays; null texts
    count as empty, of which one row stays; of ties the smallest id stays, a
    null id last; an empty table stays empty."""
    names = ["row_id", "row_sha", "row_cp"]
    names = [fresh(x, [*docs.columns, "code_points"]) for x in names]
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(
        col(id_col).alias("k_id"), F.col("text_sha256").alias("k_sha"), F.col("code_points").alias("k_cp"))
    keys = [fresh(x, [*docs.columns, *names]) for x in kept.columns]
    kept = kept.toDF(*keys)
    rows = docs.withColumns(dict(zip(names, [
        col(id_col), F.sha2(normalised(col(text_col)), 256),
        F.coalesce(F.char_length(col(text_col)), F.lit(0))])))
    same = [F.col(n).eqNullSafe(F.col(k)) for n, k in zip(names, keys)]
    return (rows.join(kept, same[0] & same[1] & same[2], "left_semi")
            .dropDuplicates(names).select(*[col(c) for c in docs.columns]))
