"""Reading text shards that hold broken lines: good rows go to one output,
broken ones to a quarantine, and the counts are reconciled."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from covary.sources.readers import PathLike, read_table

_LINE = "__line"


@dataclass
class Ingested:
    """``good`` (the schema's columns), ``quarantine`` (``line``, ``file``) and
    the counts that were observed while both were written."""

    good: DataFrame
    quarantine: DataFrame
    rows: int
    bad: int


def ingest(spark: SparkSession, paths: PathLike, schema: StructType | str, out: str,
           fmt: str = "json", options: dict | None = None) -> Ingested:
    """Read JSON lines or CSV once with a typed schema and write them to
    ``out``, one scan, good rows and broken lines in folders of their own.

    A line is broken when it does not parse, or a value does not fit its type
    (so also a value of a column that nobody reads later: all columns are
    parsed). Broken lines keep their text and the file they came from. The
    number of rows is observed by the write itself and must equal what the
    two outputs hold; a difference raises. An empty input gives two empty
    tables. Paths may use any Hadoop file system; a retried task writes its
    part anew, so the outputs hold every line once.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE, "columnPruning": "false"} | (
        {"header": "true"} if fmt == "csv" else {}) | (options or {})
    read = read_table(spark, paths, fmt, StructType([*kind.fields, StructField(_LINE, StringType())]), opts)
    seen = Observation(f"ingest-{uuid.uuid4().hex}")
    rows = read.select("*", F.col("_metadata.file_path").alias("__file"), F.col(_LINE).isNotNull().alias("quarantined"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("quarantined").alias("bad"))
    rows.write.mode("errorifexists").partitionBy("quarantined").parquet(out)
    counts = seen.get
    table = spark.read.schema(StructType([*rows.schema.fields])).parquet(out)
    good = table.filter(~F.col("quarantined")).select(*[F.col(f"`{f.name}`") for f in kind.fields])
    bad = table.filter("quarantined").select(F.col(_LINE).alias("line"), F.col("__file").alias("file"))
    found = bad.count()
    if counts["bad"] != found or counts["rows"] != good.count() + found:
        raise RuntimeError(f"{counts} were read, but {out} holds {found} broken lines")
    return Ingested(good, bad, counts["rows"], counts["bad"])
