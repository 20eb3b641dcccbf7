"""Helpers shared by the text operators: Arrow batch mapping and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingscope.llm import memos

#: Rows and bytes that a task turns into Python objects at once; a single row may be longer. They bound a worker's memory
#: whatever the size of an Arrow batch.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and ``most`` bytes, or of one row."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, rows)
        while part.num_rows > 1 and part.nbytes > most:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def map_slices(df: DataFrame, fn: Callable[[list[list]], list[Iterable]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Run ``fn`` over slices of at most ``rows`` rows and ``SLICE_BYTES`` bytes. ``fn`` gets one list per input column and
    returns one list per output column; output rows need not match input rows in number."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema, owner = to_arrow_schema(_parse_datatype_string(schema)), fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memos.for_task(owner):
            for batch in batches:
                for part in slices(batch, rows):
                    out = fn([c.to_pylist() for c in part.columns])
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow_schema)], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir. Without it there is none: a folder of one
    machine would lose data silently."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


#: Tables that ``written`` has made inside ``stage_tables``, and whether such a block is open.
_tables: list[str] = []
_in_stage = False


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _in_stage:
        _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """A block in which a stage calls operators. Deletes the intermediate tables of the block before: when a stage begins,
    what the stage before gave back has been written, so nothing needs them any more."""
    global _in_stage
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _in_stage = True
    try:
        yield
    finally:
        _in_stage = False


def components(edges: DataFrame, name: str = "components", max_rounds: int = 50) -> DataFrame:
    """Connected components of an undirected edge table (a long, b long).

    Returns (node, component), component being the smallest node reachable. Alternating large-star and
    small-star rounds: every round rewires each node to its neighbourhood's minimum, so the rounds
    grow with the logarithm of the diameter. A hub's edges are aggregated with map-side combine
    (``min``) and joined, never collected. Each round is written to the shared folder; the driver
    sees only a count and a checksum."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, name)
    before = None
    for _ in range(max_rounds):
        # large-star: connect each larger neighbour to the minimum of the node's neighbourhood
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: connect smaller neighbours (and the node) to the smallest of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = written(small, name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(roots)


#: Most rows of one number that are broadcast (some 50 MB in a task); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, name: str) -> DataFrame:
    """A narrow table for a join, written once; with the hint to broadcast it if it has ``BROADCAST_ROWS`` rows at most."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is not among ``ids`` (one column)."""
    gone = if_small(ids.toDF("_gone").where("_gone is not null").distinct(), "ids")
    return df.join(gone, df[id_col] == F.col("_gone"), "left_anti")
