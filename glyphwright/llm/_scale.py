"""Shared pieces: durable intermediate tables and global prefix sums."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from ..shipping import map_arrow

#: Bytes up to which a side whose size has been counted may be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without it: then a folder of this machine serves.
    """
    sc = spark.sparkContext
    place = sc.getCheckpointDir()
    if place:
        return place
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = os.path.join(tempfile.gettempdir(), f"glyphwright-{os.getpid()}")
    sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; partitions and their order stay."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str):
    """The column of that very name, whatever signs are in it."""
    return df["`" + name.replace("`", "``") + "`"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def range_sorted(df: DataFrame, *order) -> DataFrame:
    """Globally sorted by range partitions, checkpointed so that partitions can be numbered."""
    n = partitions(df.sparkSession)
    return checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order))


def _segments(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """True where a row's segment differs from the row before; the first row is True."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.r_[True, codes[1:] != codes[:-1]] if len(codes) else np.zeros(0, bool)


def running_sums(ordered: DataFrame, value: str, out: str, segment: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including each row, over the global order of
    ``ordered`` (from :func:`range_sorted`), restarting with each ``segment``.

    Two narrow passes: each partition reports one summary row, the driver turns those into what is
    carried into each partition, and the second pass adds its carry. Nothing is shuffled, and the
    driver holds as many rows as there are partitions, however many segments there are.
    ``value`` must be a non-null bigint.
    """
    seg_type = ordered.schema[segment].dataType.simpleString() if segment else "string"
    wanted = [value] + ([segment] if segment else [])

    def summary(batches):
        first, last, head, tail, single, rows = None, None, 0, 0, True, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(0).to_numpy(zero_copy_only=False)
            if segment:
                s = b.column(1)
                cuts = np.flatnonzero(_segments(s))
                sums = np.add.reduceat(v, cuts)
                names = [s[int(i)].as_py() for i in (cuts[0], cuts[-1])]
            else:
                cuts, sums, names = np.zeros(1, int), np.array([v.sum()]), [None, None]
            if not rows:
                first, last, head, tail = names[0], names[1], int(sums[0]), int(sums[-1])
                single = len(cuts) == 1
            else:
                joined = names[0] == last
                if single and joined:
                    head += int(sums[0])
                if joined and len(cuts) == 1:
                    tail += int(sums[-1])
                else:
                    tail = int(sums[-1])
                single = single and joined and len(cuts) == 1
                last = names[1]
            rows += b.num_rows
        if rows:
            pid = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid], pa.int32()), pa.array([first], kind), pa.array([last], kind), pa.array([tail], pa.int64()), pa.array([single])],
                names=["p", "first", "last", "tail", "single"],
            )

    kind = to_arrow_type(ordered.schema[segment].dataType) if segment else pa.string()
    rows = map_arrow(ordered.select(*wanted), summary, f"p int, first {seg_type}, last {seg_type}, tail bigint, single boolean").collect()
    carry: dict[int, tuple] = {}
    open_segment, total, started = None, 0, False
    for r in sorted(rows, key=lambda r: r.p):
        same = started and r.first == open_segment
        carry[r.p] = (r.first, total if same else 0)
        total = (total if same and r.single else 0) + r.tail
        open_segment, started = r.last, True

    def add(batches):
        pid = TaskContext.get().partitionId()
        name, base = carry.get(pid, (None, 0))
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(v)
            if segment:
                s = b.column(segment)
                cuts = np.flatnonzero(_segments(s))
                before = np.where(cuts > 0, run[cuts - 1], 0)
                base = base if s[0].as_py() == name else 0
                starts = np.repeat(before, np.diff(np.r_[cuts, len(v)]))
                run = run - starts
                end = int(cuts[1]) if len(cuts) > 1 else len(v)
                run[:end] += base
                name, base = s[len(v) - 1].as_py(), int(run[-1])
            else:
                run += base
                base = int(run[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run, pa.int64())], names=[*b.schema.names, out])

    schema = StructType([*ordered.schema.fields, StructField(out, LongType())])
    return map_arrow(ordered, add, schema)


def connected(edges: DataFrame) -> DataFrame:
    """Components of the graph with edges (``a``, ``b``): rows (``node``, ``root``) for every node
    that isn't the smallest of its component, ``root`` being the smallest.

    Alternates large-star and small-star steps until a round changes nothing, which it must come to, in
    a number of rounds that grows with the logarithm of the longest path. Each round is written to the
    shared folder, so lineage stays short and a lost executor costs one round at most.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        e = stored(small.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
