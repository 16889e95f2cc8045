"""Helpers shared by the operators: scratch tables in the cluster's shared
folder, code for the Python workers, and joins that survive hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from covary.session import ensure_checkpoint_dir

#: A key is hot when it holds more than 1 / HOT_SHARE of all rows, so at most
#: HOT_SHARE keys are hot whatever the data: the proven bound of a broadcast.
HOT_SHARE = 10_000

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the cluster."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="covary-code-"), "covary_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, dirs, names in os.walk(os.path.join(root, "covary")):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, deleted when the
    application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(target)
    return store.makeQualified(target).toString()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed
    once, lineage cut, and any executor can read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores added until it clashes with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Sequence]],
                fields: StructType) -> DataFrame:
    """Append columns computed per Arrow batch. ``make()`` runs once per task
    and returns ``batch -> list of columns`` in the order of ``fields``; the
    input columns pass through unchanged."""
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    added = list(to_arrow_schema(fields, prefers_large_types=False))
    out = StructType(list(df.schema.fields) + list(fields.fields))
    if any("." in c or "`" in c for c in df.columns):  # mapInArrow names its columns without quotes
        df = df.toDF(*[f"c{k}" for k in range(len(df.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            new = [pa.array(v, type=f.type) for v, f in zip(fn(batch), added, strict=True)]
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + new,
                schema=pa.schema(list(batch.schema) + [pa.field(f.name, f.type) for f in added]))

    return df.mapInArrow(run, out)


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """Left join of ``rows`` to one-row-per-key ``stats`` (with ``n`` = rows of
    the key) that no hot key can stall: the at most ``HOT_SHARE`` keys with
    more than ``total / HOT_SHARE`` rows come by broadcast, all others by a
    shuffled join. Both frames are read more than once: pass saved ones."""
    limit = max(1000, total // HOT_SHARE)
    hot = stats.filter(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(stats, list(keys), "left")
    mark = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), list(keys), "left")
    done = mark.filter(F.col("__hot")).drop("__hot")
    rest = mark.filter(F.col("__hot").isNull()).select(*rows.columns)
    return done.unionByName(rest.join(stats.filter(F.col(n) <= limit), list(keys), "left"))
