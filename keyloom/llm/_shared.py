"""Helpers shared by the corpus operators: shared-folder tables, components, prefix sums, batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one where that is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    This cuts lineage with files every executor can read, so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


_caches: dict = {}


def claim(name: str, forget=None) -> None:
    """A worker process serves many tasks: what other operators have remembered in it is dropped when one of another name begins."""
    for other in [n for n in _caches if n != name]:
        _caches.pop(other)()
    if forget:
        _caches[name] = forget


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start..start+length-1 of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long) as (node, root), root the smallest node; nodes without an edge are left out.

    Alternating large-star and small-star rounds of aggregates and joins; each round is written to the shared folder.
    Self-loops and repeated edges are allowed; an empty input gives an empty result."""
    now = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", F.col("v").alias("root"))
            ).distinct()
        seen = tuple(mark)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Whole texts go to Python in Arrow batches; keep these small, since one text can be large. Results are lazy, so the
    session keeps these two settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
