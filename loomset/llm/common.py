"""What the operators of this package share: table access, tables in the shared folder, row keys, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and about the bytes, of one Arrow batch on the way to a Python worker: texts may be long, so batches stay small by both.
ARROW_ROWS, ARROW_BYTES = 256, 1 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker's batch, whatever the length of the texts (a longer one stands alone). The same for all operators of
    this package, so it doesn't matter which of several lazy plans runs first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (local runs and tests), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="loomset-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def write_shared(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """Writes a table into the shared folder and reads it back: lineage ends here, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomset-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame) -> DataFrame:
    return write_shared(df)[0]


def drop_shared(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Deletes the tables that this process wrote into the shared folder. Results read from them must be stored by then."""
    while _written:
        spark, path = _written.pop()
        try:
            drop_shared(spark, path)
        except Exception:  # the session has ended; the folder belongs to the cluster
            return


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null texts count as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def small(batches: Iterable[pa.RecordBatch], name: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices with about `size` bytes of text at most (a longer text stands alone): what a task makes of a slice stays small
    whatever the length of its texts."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
        start = held = 0
        for at, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def id_crc_py(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `links`; root is the smallest node reachable.

    Alternating large-star and small-star contraction (Kiveris et al. 2014): a logarithmic number of rounds in
    practice, each a pre-aggregated minimum by node and an equi-join; no neighbour list is ever gathered. Every round is a
    table in the shared folder, and the one before it is deleted. Null ends and loops are dropped.
    """
    spark = links.sparkSession
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges, path = write_shared(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after, new_path = write_shared(small)
        drop_shared(spark, path)
        digest, edges, path = _digest(after), after, new_path
        if digest == before:
            break
        before = digest
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(roots: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components' roots, moved) once `links` (a, b) are added to `roots` (node, root), as components() gives them; moved has the old roots (root) whose
    components have a smaller one (to). Only links between different components are contracted."""
    ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    moved = kept(components(between))
    new = moved.join(roots, "node", "left_anti")
    moved = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return kept(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(new)), moved
