"""What the operators share: scratch tables on shared storage, keys for documents, and word blocks."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import zipfile
from collections import defaultdict
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clear, new_root, remove, shared_folder  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only; every other character stays, so code point offsets stay too."""
    return F.translate(text, UPPER, LOWER)


_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch: texts may be long, and a task holds a batch on both sides of its Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application, so that it needn't be installed there, and bounds the
    session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spillway-")) / "spillway.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables in the shared folder that cut lineage; a lost executor costs a read, never a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_root(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it back. Its shuffles' files go when it is written, not when the driver's memory is
        next collected."""
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Frees the disk of tables that nothing reads any more."""
        for name in names:
            remove(self.spark, self.path(name))


def pick(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator reads, under names of its own: other columns can't clash with what it adds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in more))


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with marks added until docs has no such column: for what is joined to docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Rows to drop are broadcast up to this size, so that the texts that stay aren't shuffled; beyond, a shuffled anti-join.
#: A row of an id and a digest takes so much memory in a broadcast.
ANTI_BYTES, ANTI_ROW = 32 << 20, 128


def without(spark: SparkSession, docs: DataFrame, gone: DataFrame, same) -> DataFrame:
    """docs without the rows for which ``same()`` holds with a row of gone (narrow keys)."""
    gone = Scratch(spark, "gone").save(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() * ANTI_ROW <= ANTI_BYTES else gone, same(), "left_anti")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same on every machine and run."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds); wraps on overflow."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. np.unique puts them into a hash table first, which takes many times as long on large arrays."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours; shorter input gives none."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mix(hashes[:count] + np.uint64(n))
        for k in range(1, n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count])
    return out


class Vocabulary:
    """Distinct words of a block in order of appearance; word ids index ``words``."""

    def __init__(self):
        self.index: dict = defaultdict(count().__next__)

    def ids(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int32, count=len(words))

    @property
    def words(self) -> list:
        return list(self.index)


def give_back() -> None:
    """Returns what a task of this Python worker has freed to the system: an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches, limit: int, keys: int = 1):
    """Regroups the Arrow batches of one task into (ids, texts) of about ``limit`` bytes of UTF-8 text.

    Takes the first ``keys`` columns as id (a tuple where there are several) and the next as text; null texts stay None.
    A text longer than the limit is a block of its own.
    """
    ids, texts, size = [], [], 0
    for batch in batches:
        key_lists = [batch.column(k).to_pylist() for k in range(keys)]
        for key, text in zip(key_lists[0] if keys == 1 else zip(*key_lists, strict=True), batch.column(keys).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(key)
            texts.append(text)
            size += len(text or b"")
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
    give_back()


def ceil_div(a: int, b: int) -> int:
    return max(1, math.ceil(a / b))
