"""Shared helpers: blocks of texts in Arrow batches, vectorised hashes, staged tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import shared_dir

#: UTF-8 bytes of text that one block holds (a longer text is a block of its own).
BLOCK = 1 << 21
#: The six separators of words: space and 0x09 to 0x0D.
SEPARATORS = [9, 10, 11, 12, 13, 32]
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_IS_WORD = np.ones(256, bool)
_IS_WORD[SEPARATORS] = False


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    # Python workers that start in another folder find this package as the driver does
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Removes the folders that were staged meanwhile, but for lasting ones."""
    folders: list[str] = []
    token = _scratch.set(folders)
    try:
        yield
    finally:
        _scratch.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staging_dir(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new folder below the shared one; ``scratch`` removes it unless it is lasting."""
    path = shared_dir(spark, name)
    if not lasting and (folders := _scratch.get()) is not None:
        folders.append(path)
    return path


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write to the shared folder and read again: short lineage that survives lost executors."""
    path = staging_dir(df.sparkSession, name, lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _at_least(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


def sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that move a part to its start."""
    power, inverse = _powers(_at_least(len(values)))
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return total, inverse


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values, by its start."""
    if len(values) < k:
        return np.empty(0, U)
    total, inverse = sums(values)
    return mix((total[k:] - total[:-k]) * inverse[: len(values) - k + 1])


class Block:
    """Some rows of a batch: their texts' bytes one after another, and where each starts."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lower(self) -> np.ndarray:
        """The bytes with A-Z lower-cased."""
        return np.where((self.data >= 65) & (self.data <= 90), self.data + np.uint8(32), self.data)

    def words(self, data: np.ndarray | None = None) -> Words:
        return Words(self.data if data is None else data, self.offsets)


class Words:
    """Words of a block: start and end byte, hash, row, and number within the row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        parts, at = [], 0
        while at < len(data):  # only a block of one long text has several parts
            stop = min(at + 2 * BLOCK, len(data))
            if stop < len(data):
                near = np.flatnonzero(~_IS_WORD[data[stop - BLOCK : stop]])
                if len(near):
                    stop += int(near[-1]) + 1 - BLOCK
                else:
                    after = np.flatnonzero(~_IS_WORD[data[stop:]])
                    stop = stop + int(after[0]) if len(after) else len(data)
            parts.append(self._part(data[at:stop], np.clip(offsets - at, 0, stop - at), at))
            at = stop
        empty = np.empty(0, np.int64)
        self.start, self.end, self.hash = (
            (np.concatenate([p[i] for p in parts]) for i in range(3))
            if parts else (empty, empty, np.empty(0, U))
        )
        self.row = np.searchsorted(offsets[1:], self.start, side="right")
        self.count = np.bincount(self.row, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.count) - self.count
        self.number = np.arange(len(self.row)) - self.first[self.row]

    @staticmethod
    def _part(data, offsets, at):
        inside = _IS_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        total, inverse = sums(_BYTE[data])
        value = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))
        return start + at, end + at, value

    def __len__(self) -> int:
        return len(self.row)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word indexes) and hashes of all runs of k words within one row."""
        value = rolling(self.hash, k)
        start = np.flatnonzero(self.row[: len(value)] == self.row[k - 1 :]) if len(value) else (
            np.empty(0, np.int64))
        return start, value[start]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK
           ) -> Iterator[Block]:
    """Cut batches into blocks of bounded size; a null text counts as empty."""
    for batch in batches:
        column = batch.column(text)
        if column.null_count:
            column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, where, what = column.buffers()
        offsets = np.frombuffer(where, np.int64 if wide else np.int32)
        offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(what, np.uint8) if what is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(column):
            stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            stop = min(max(stop, at + 1), len(column))
            yield Block(
                batch.slice(at, stop - at),
                data[offsets[at] : offsets[stop]],
                offsets[at : stop + 1] - offsets[at],
            )
            at = stop


def byte_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums(_BYTE[data])


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list for each count, taken from the values in order."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each; a null list is empty."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), counts)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each different text once: its key (t1, t2), how many rows hold it, and its first doc_id.

    Copies meet in a map-side aggregation, so a text that a third of all rows hold
    is one row for each task before the shuffle. A null text counts as empty and a
    null doc_id as smaller than all others. The key is two 64-bit hashes.
    """
    return keyed(docs).groupBy("t1", "t2").agg(
        F.max("text").alias("text"),
        F.count(F.lit(1)).alias("copies"),
        F.min("order_id").alias("first_id"),
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the text's key (t1, t2) and an order without nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        text.alias("text"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("order_id"),
    )
