"""Benchmark rows without an id."""

import hashlib

from covary.llm import decontaminate
from covary.llm.queries import op10_decontamination


def test_items_without_an_id_still_hit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two three"), (3, "four five")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta"), (7, "one two"), (None, "one two")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: tuple(r)[2:6] for r in op10_decontamination(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, 0, sha(""), True), 2: (2, 1, sha("7"), True), 3: (0, 0, sha(""), False)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]
