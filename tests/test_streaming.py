"""Incremental counts over arriving shards equal the batch counts."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from covary.operators import period_counts
from covary.sources import write_table
from covary.streaming import run_available, stream_events, streaming_counts
from tests.conftest import SF001


def test_incremental_counts_match_batch(spark):
    orders = spark.read.parquet(f"{SF001}/orders.parquet").select(
        "o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("string").alias("o_orderdate"))
    folder = tempfile.mkdtemp(prefix="covary-shards-")
    schema = "o_orderkey long, o_orderpriority string, o_orderdate string"
    name = f"counts_{uuid.uuid4().hex[:8]}"

    def counts():
        ev = stream_events(spark, os.path.join(folder, "*"), schema, "json")
        keyed = ev.select("o_orderpriority", F.substring("o_orderdate", 1, 4).alias("year"))
        run_available(streaming_counts(keyed, ["o_orderpriority", "year"]), name, mode="complete", fmt="memory")
        return {(r.o_orderpriority, r.year): r.n for r in spark.table(name).collect()}

    write_table(orders.filter("o_orderdate < '1998'"), os.path.join(folder, "shard0"), "json")
    first = counts()
    write_table(orders.filter("o_orderdate >= '1998'"), os.path.join(folder, "shard1"), "json")
    second = counts()
    batch = period_counts(orders.select("o_orderpriority", F.substring("o_orderdate", 1, 4).alias("year")),
                          ["o_orderpriority", "year"])
    want = {(r.o_orderpriority, r.year): r.n for r in batch.collect()}
    assert second == want
    assert sum(first.values()) < sum(second.values()) == orders.count()
