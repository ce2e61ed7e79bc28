"""Shared pieces: staged tables, whole-batch word splitting, gathering of variable-length runs."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.session import work_dir

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 4_000_000
BATCH_BYTES = 16_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here and nothing is computed twice.

    The shuffle files of the write have no further use and go at once.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under its own names, so that others can't clash; null text is empty.

    Batches that go to Python are bounded by bytes from here on, as a count of rows says nothing about long texts.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def one_row_per_id(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text); of rows repeated under one id the one with the least text stays."""
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    return next(f"{stem}{k}" for k in range(len(df.columns) + 1) if f"{stem}{k}" not in df.columns)


def keyed(rows: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``rows`` with a row key, and whether it is more than the id: written down where ids repeat or are null."""
    if rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return rows.withColumn(name, F.col("doc_id")), False
    return staged(rows.withColumn(name, F.monotonically_increasing_id()), "rows"), True


def bucket_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batch: pa.RecordBatch, text_at: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each (one row at least)."""
    sizes = np.cumsum(pc.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between runs of ASCII white space: row offsets, word codes, distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.values.dictionary_encode()
    offsets, codes, words = lists.offsets.to_numpy(), coded.indices.to_numpy(), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        offsets, codes = np.concatenate([[0], np.cumsum(keep)])[offsets], codes[keep]
    return offsets.astype(np.int64), codes, words


def kept_in_worker(key: tuple, make):
    """An object that a worker process keeps from task to task.

    Functions of this package travel with the plan, so their own globals end with the task.
    """
    home = sys.modules.setdefault("docengine_worker", types.ModuleType("docengine_worker"))
    if key not in vars(home):
        vars(home)[key] = make()
    return vars(home)[key]


def give_back(forget: bool = False) -> None:
    """Memory that this worker has freed goes back to the system; with ``forget`` what operators keep in it goes too."""
    home = sys.modules.get("docengine_worker")
    if forget and home and any(not key.startswith("__") for key in map(str, vars(home))):
        del sys.modules["docengine_worker"], home
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[c]:starts[c]+lengths[c]]`` of all codes, one after another, and each run's length."""
    size = lengths[codes]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[codes] - (ends - size), size)], size


def runs_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty runs give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
