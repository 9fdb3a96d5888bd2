"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

#: ASCII white space as the contracts name it: blank and the code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z so that word splitting is the same as with A-Z alone.

    Only U+0130 and U+212A turn into ASCII letters under Unicode rules; they are swapped for another letter first.
    Other letters may change too, so use it where the letters themselves are not returned.
    """
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("é")), F.lit("K"), F.lit("é")))


def text_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that tell documents apart, also where ids repeat or are null. Equal rows share a key."""
    return [F.col(id_col).alias("k_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()).alias("k_text")]


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["k_text"].eqNullSafe(b["k_text"]) & a["k_id"].eqNullSafe(b["k_id"])


def map_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None]) -> DataFrame:
    """Apply fn to every Arrow batch. A batch's size is bounded by Spark in rows and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without gaps, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A reliably stored frame and the number of its rows."""
    kept = cut_lineage(df)
    return kept, kept.count()


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast only a side whose counted rows stay under the bound; else Spark joins by shuffle and splits skew."""
    return F.broadcast(df) if rows <= most else df


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new name below the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, and later readers take only their columns."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them must be stored or checkpointed itself."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.stored_path)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find shuffles of plans that a stored table has replaced; their files would stay until the
    driver's next full collection. It also gives the driver's free heap back, which plans of many tasks let grow to its
    limit, so loops over stored frames call it in every round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for the nodes that have any.

    Labels move to neighbours and then jump to their label's label, so stars end after two rounds and chains after a
    logarithmic number. Every round is stored; hubs are aggregated before the shuffle.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = cut_lineage(pairs.union(pairs.select("y", "x")).distinct())
    labels = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label")))
    while True:
        sent = both.join(labels.select(F.col("node").alias("x"), "label"), "x").groupBy(F.col("y").alias("node")).agg(F.min("label").alias("heard"))
        heard = labels.join(sent, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("near"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        after = cut_lineage(heard.join(jump, heard["near"] == jump["at"]).select("node", "old", F.least("near", "far").alias("label")))
        labels = after.select("node", "label")
        release(edges.sparkSession)
        if after.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def sliced(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold `most` bytes together, or one row where a row alone holds more."""
    ends = raw_bytes(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
