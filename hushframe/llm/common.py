"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.storage import materialize, new_path, shared_dir

__all__ = ["as_bytes", "crc_mod", "cut", "forget", "interned", "materialize", "mix64", "new_path", "pack", "release", "small_batches", "shared_dir", "table", "unpack"]

#: Text handled by Python at once inside a worker, in bytes.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(docs: DataFrame, **named) -> DataFrame:
    """The whole row in a struct ``doc`` beside the columns ``named``, so that no name of the input can clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(c.alias(n) for n, c in named.items()))


def unpack(packed: DataFrame, *results: str) -> DataFrame:
    """The input's columns and then ``results``; an input column with the name of a result gives way to it."""
    taken = {r.lower() for r in results}
    return packed.select(*(F.col(f"doc.`{c}`").alias(c) for c in packed.schema["doc"].dataType.names if c.lower() not in taken), *results)


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def cut(batch, texts, limit: int = SLICE_BYTES):
    """Slices of ``batch`` (or of an array) of about ``limit`` bytes of ``texts``."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [x or b"" for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hands Python at most ``rows`` texts at once (the session's setting, if it is larger): a batch is held whole, on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Gives memory that is free back to the system: idle Python workers stay for a while, beside those at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no plan refers to any more: its cleaner follows the driver's garbage collector, which may not run for long."""
    for last in (False, True):
        spark.sparkContext._jvm.System.gc()
        if not last:
            time.sleep(0.5)  # what is let go now holds plans that the next round finds


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Interner:
    """Numbers the distinct words of a slice and keeps one 64-bit hash for each."""

    def __init__(self, digest):
        self.ids: dict[bytes, int] = {}
        self.digest = digest

    def __call__(self, words: list[bytes]) -> list[int]:
        ids = self.ids
        return [ids.setdefault(w, len(ids)) for w in words]

    def hashes(self) -> np.ndarray:
        digest = self.digest
        return np.fromiter((digest(w) for w in self.ids), np.uint64, len(self.ids))


def interned(docs: list[list[bytes]], digest) -> tuple[np.ndarray, np.ndarray, Interner]:
    """Word numbers of all documents in a row, where each document starts, and the numbering."""
    names = Interner(digest)
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=starts[1:])
    ids = np.fromiter((i for d in docs for i in names(d)), np.int64, int(starts[-1]))
    return ids, starts, names
