"""Words, hashes and Arrow batches shared by the operators that read whole texts.

Arrow batches are bounded by bytes, so very long texts come in few.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfeat.session import scratch_path

#: Distinct words a worker remembers; beyond that it starts anew, so its memory is bounded.
REMEMBERED_WORDS = 100_000

#: White space between words in every contract: space and \x09 to \x0D, which is what ``bytes.split`` cuts at.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_ascii(text: bytes) -> bytes:
    """A-Z in lower case, every other byte as it is."""
    return text.translate(_LOWER)


def crc_mod5(column: str):
    """crc32 of a number written as text, modulo 5: the split into folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def texts_of(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``text`` as UTF-8 bytes, null as none."""
    return docs.select(*keep, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``_row``, a number of each row, and all its columns as one struct ``doc``, so that no name can clash; written once, so
    that every scan finds the same numbers."""
    path = scratch_path(docs.sparkSession, name)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    docs.select(F.monotonically_increasing_id().alias("_row"), whole.alias("doc")).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have yet."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bytes of an Arrow batch that a function gets at once.
PIECE_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most that many bytes from now on: they are held by both the JVM and Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE_BYTES))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, large ones cut by rows."""
    for batch in batches:
        step = max(1, batch.num_rows // (batch.nbytes // PIECE_BYTES + 1))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def give_back() -> None:
    """Return freed memory to the system: workers that wait for their next task keep what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def by_batch(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """``mapInArrow`` for a function from one batch to columns."""
    bound_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield to_batch(fn(batch), arrow)
        give_back()

    return df.mapInArrow(run, schema)


def bytes_of(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as none."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def keep_rows(docs: DataFrame, fn: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a function of a batch says yes to."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(fn(batch), pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def by_partition(df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` for a function from all batches of a task to columns."""
    bound_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(pieces(batches)):
            yield to_batch(columns, arrow)
        give_back()

    return df.mapInArrow(run, schema)


def to_batch(columns: dict[str, list], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


class WordHashes(dict):
    """64-bit hashes of words, computed once for each word that a worker remembers."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words, by position; empty when there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = mixed(total + hashes[i:i + n] * _MULTIPLIERS[i % len(_MULTIPLIERS)])
    return total
