"""Typed readers and writers.

All readers take one path or a list of paths and issue ONE scan (a list of
shards is read by a single file scan, not a chain of unions), with an
explicit schema so no inference job runs over the data. Paths may use any
Hadoop file system URI.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PathLike = str | Sequence[str]


def _paths(paths: PathLike) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_table(spark: SparkSession, paths: PathLike, fmt: str = "parquet",
               schema: StructType | str | None = None,
               options: dict | None = None) -> DataFrame:
    """Scan one table from one or more files of one format."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.load(_paths(paths))


def read_events(spark: SparkSession, paths: PathLike,
                schema: StructType | str | None = None, fmt: str = "json",
                corrupt_column: str | None = None,
                options: dict | None = None) -> DataFrame:
    """Event facts from JSON lines, CSV with header, or Parquet shards.

    JSON is read in PERMISSIVE mode: a line that does not parse yields a row
    of nulls, and its text lands in ``corrupt_column`` when that column is
    named (it must then be part of ``schema``).
    """
    opts = dict(options or {})
    if fmt == "json":
        opts.setdefault("mode", "PERMISSIVE")
        if corrupt_column:
            opts["columnNameOfCorruptRecord"] = corrupt_column
    elif fmt == "csv":
        opts.setdefault("header", "true")
        opts.setdefault("mode", "PERMISSIVE")
    return read_table(spark, paths, fmt, schema, opts)


def read_indicator(spark: SparkSession, paths: PathLike,
                   schema: StructType | str | None = None, fmt: str = "csv",
                   columns: Sequence[str] | None = None,
                   options: dict | None = None) -> DataFrame:
    """A small indicator table (period or area -> value).

    ``columns`` renames all columns by position, as one assigns names to a
    sheet without a usable header.
    """
    opts = dict(options or {})
    if fmt == "csv":
        opts.setdefault("header", "true")
    df = read_table(spark, paths, fmt, schema, opts)
    return df.toDF(*columns) if columns else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                mode: str = "overwrite",
                partition_by: Sequence[str] | None = None,
                options: dict | None = None) -> None:
    """Write a result; CSV gets a header row and no index column."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def union_all(frames: Iterable[DataFrame], allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name over any number of frames.

    Matching by name (not position) keeps shards whose column order differs
    correct. For shards of one table prefer a single multi-path read.
    """
    frames = list(frames)
    if not frames:
        raise ValueError("union_all needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def parse_json_column(column: str | Column, schema: StructType | str,
                      mode: str = "PERMISSIVE") -> Column:
    """Decode a JSON text column into a struct; malformed text gives null fields."""
    col = F.col(column) if isinstance(column, str) else column
    return F.from_json(col, schema, {"mode": mode})
