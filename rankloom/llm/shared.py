"""Helpers shared by the training-data operators."""

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.operators.sizing import fits, spread
from rankloom.workspace import materialize

__all__ = [
    "fits", "materialize", "spread", "table", "texts", "fold_hash", "bounded_rows", "slices", "short_batches", "frugal", "give_back",
]

SLICE_ROWS = 256
SLICE_BYTES = 2 << 20
#: rows of an Arrow batch of whole texts
BATCH_ROWS = 1024
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text) of every row, whatever further columns there are, on at least as many partitions as cores."""
    return spread(docs.select("doc_id", "text", *more), "doc_id")


def fold_hash(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_rows(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """At most about ``bound`` rows with the smallest hashes of ``key``; all rows while they fit."""
    total = df.count()
    if total <= bound:
        return df
    share = int(bound / total * (1 << 31))
    return df.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 31)) < share)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches so that a slice holds few texts, and give the texts as UTF-8 (null: empty).

    A slice ends at SLICE_ROWS rows or once its texts exceed SLICE_BYTES, so one very long text
    forms a slice with few neighbours.
    """
    for batch in batches:
        column = batch.column("text").cast(pa.large_binary())
        start, size, out = 0, 0, []
        for i in range(len(column)):
            out.append(column[i].as_py() or b"")
            size += len(out[-1])
            if size > SLICE_BYTES or len(out) >= SLICE_ROWS:
                yield batch.slice(start, len(out)), out
                start, size, out = i + 1, 0, []
        if out:
            yield batch.slice(start, len(out)), out


def short_batches(docs: DataFrame) -> DataFrame:
    """``docs``, of which Python workers from now on get at most BATCH_ROWS rows at once.

    The limit is a setting of the session; a smaller one of the caller's stays. With Spark's 10,000
    rows a batch of whole texts takes tens of MB in the executor's JVM, beside its heap, and again in
    each of the workers, and an executor keeps much of that for the stages that follow.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_ROWS)) <= BATCH_ROWS:
        conf.set(_BATCH_ROWS, BATCH_ROWS)
    return docs


def frugal(work: Callable) -> Callable:
    """``work`` for mapInArrow or an Arrow function over batches that gives freed memory back to the system when a task ends.

    Workers are kept between tasks, and an allocator that keeps what a stage with large arrays has
    freed takes it from the stages that follow on the same executor.
    """
    def run(batches):
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)
