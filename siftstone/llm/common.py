"""Helpers that several operators share: joins with heavy keys, word splitting, Arrow access."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import Workspace, drop_dir, materialise, shared_dir

__all__ = ["WORD_BYTES", "Workspace", "as_bytes", "as_texts", "drop_dir", "extended", "hot_join", "materialise", "shared_dir", "short_batches", "table", "tidy", "words_of"]

# Word bytes of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased:
# digits, a-z and every byte of a non-ASCII character. All others become one blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def hot_join(left: DataFrame, right: DataFrame, on: str, weight: str, least: int = 4096, most: int = 20_000) -> DataFrame:
    """Inner join of left to the one row of right for each key, where some keys hold a large share of left.

    weight says how many rows of left a key of right stands for. The up to ``most`` heaviest keys with ``least`` rows
    or more are broadcast, so their rows stay where they are; all other keys, each at most a 1/most part of left, meet
    in a shuffle. left is read twice if there are heavy keys: it should be a stored table.
    """
    heavy = materialise(right.filter(F.col(weight) >= least).orderBy(F.desc(weight), on).limit(most), "heavy")
    if heavy.isEmpty():
        return left.join(right, on)
    rest = left.join(F.broadcast(heavy.select(on)), on, "left_anti").join(right, on)
    return left.join(F.broadcast(heavy), on).unionByName(rest)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Strings of a column; null gives ''."""
    return [x or "" for x in column.to_pylist()]


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
# What workers remember from task to task, by operator.
LASTING: dict[str, Callable[[], None]] = {}


def tidy(run: Run, keeps: str = "") -> Run:
    """run in a worker that forgets what other operators remembered, and afterwards gives free memory back to the
    system: workers live on after their tasks and serve one operator after another."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in LASTING.items():
            if name != keeps:
                forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
                trim(0)

    return wrapped


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def short_batches(spark: SparkSession, rows: int = 2000, size: str = "1m", read_rows: int = 512) -> None:
    """Smaller batches for whole texts, in a session that has not set their sizes itself: both sides of a Python
    worker's pipe hold an Arrow batch at a time (rows, and size in bytes, as texts differ in length), and a scan holds
    read_rows of each column. Results do not depend on them."""
    for key, usual, own in ((BATCH_ROWS, "10000", rows), (BATCH_BYTES, "67108864b", size), (READ_ROWS, "4096", read_rows)):
        if spark.conf.get(key) == usual:
            spark.conf.set(key, str(own))


def extended(df: DataFrame, columns: list[str], ddl: str) -> StructType:
    """Schema of some columns of df followed by new ones."""
    return StructType([*df.select(*columns).schema.fields, *StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
