import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomset.llm import common


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "text": ["a" * 5, None, "b" * 30, "", "c" * 4, "d" * 4, "e" * 4]})
    parts = list(common.small([batch, batch.slice(0, 0)], size=10))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5], [6]] or sum((p.column(0).to_pylist() for p in parts), []) == list(range(7))
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 10 for p in parts)


def test_components(spark):
    rows = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 100), (None, 5), (7, 3), (7, 3), (200, 300), (300, 250)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)} | {200: 200, 250: 200, 300: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_join_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    roots_of = lambda df: sorted((r.node, r.root) for r in df.collect())
    roots, seen = common.components(frame(pairs[:30])), pairs[:30]
    for more in (pairs[30:60], [], pairs[60:] + [(500, 501), (500, 501), (501, 400), (400, 3), (7, 7)]):
        before = dict(roots_of(roots))
        roots, moved = common.joined(roots, frame(more))
        seen = seen + more
        assert roots_of(roots) == roots_of(common.components(frame(seen)))
        to, after = dict(roots_of(moved.toDF("node", "root"))), dict(roots_of(roots))
        assert all(after[n] == to.get(r, r) for n, r in before.items())


def test_shared_tables(spark):
    held, path = common.write_shared(spark.range(5).withColumn("x", F.lit("y")))
    assert held.count() == 5 and held.columns == ["id", "x"]
    common.drop_shared(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_id_hash(spark):
    rows = spark.createDataFrame([(0,), (-5,), (None,), (123456789012,)], "i long").select("i", common.id_crc(F.col("i")).alias("c")).collect()
    assert all(r.c == common.id_crc_py(r.i) for r in rows)
