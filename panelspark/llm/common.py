"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes, which bounds a worker's memory (one longer text is a slice by itself).
SLICE_BYTES = 1 << 20
#: Spark sends rows to a worker in batches of about so many bytes, which bounds the buffers on both sides.
BATCH_BYTES = 4 << 20
#: Bytes that a task holds of a table it writes.
ROW_GROUP = 16 << 20
BATCH_SETTING, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's batches bounded by BATCH_BYTES unless the session has set a bound itself."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == SPARKS_OWN:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def shared_folder(spark) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only on one machine (as in tests), where it is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the cluster's shared folder and go on from there, so that lost executors cost no recomputation."""
    place = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts (or lists of numbers) hold about `limit` bytes (or numbers)."""
    kind = batch.schema.field(column).type
    size = pc.list_value_length if pa.types.is_list(kind) else pc.binary_length
    sizes = pc.fill_null(size(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_docs(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, can't clash with an operator's own."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def carried(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, text, and the columns `keep` as one struct `rest`, whose field names can't clash with an operator's."""
    rest = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("int")
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
