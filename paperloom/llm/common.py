"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds in one piece; longer batches are cut.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names. Only a local session may do
    without one, and then uses a temporary folder; elsewhere executors would each write to their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{tempfile.gettempdir()}/paperloom-checkpoints").rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage.

    The files outlive lost executors; they go with the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def text_keys(*names: str) -> list[Column]:
    """Two 64-bit hashes of the text, which name it together."""
    keys = [F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))]
    return [k.alias(n) for k, n in zip(keys, names)] if names else keys


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, nulls as empty, and the n + 1 offsets of its values."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(array) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *held: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``; at a partition's end the caches ``held`` are emptied and unused memory
    goes back to the system, as Python workers live on from stage to stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in held:
                cache.clear()
            swept()

    return wrapped


def swept() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: it keeps what it keeps
        pass


def mapped(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", held: tuple[dict, ...] = ()) -> DataFrame:
    """``mapInArrow`` over slices of the named columns, one output batch a slice; see ``tidy`` for ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                out = fn(piece)
                if out is not None:
                    yield out

    return df.select(*columns).mapInArrow(tidy(run, *held), schema)


def sampled_labels(labels: DataFrame, label: str, fold: int, folds: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled documents (doc_id, label 0/1) outside the held-out fold.

    A document with several labels takes the largest. The choice is by a hash of doc_id, so
    it is the same for any partitioning.
    """
    return (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (bucket_of("doc_id", folds) != fold))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
