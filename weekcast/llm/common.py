"""Helpers that the operators share: table reading, scratch folder, Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that end a word: tab, line feed, vertical tab, form feed, carriage return, space.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
#: Bytes of text that one vectorised step takes at a time (a longer single text is one step).
STEP_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="weekcast-llm-")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared scratch folder and read back: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made below `scratch_dir`, through the file system that Spark uses."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows with about `limit` bytes of `text` each; empty ones are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(text_buffer(batch.column(text))[1]))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes end to end, and n+1 offsets into them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if not pa.types.is_large_string(column.type) or column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(offsets) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; null is empty."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for every i; empty rows give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind != "b" else np.int64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 for every i, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def words_of(raw: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+`; bytes.split() without arguments cuts at exactly those six bytes."""
    return raw.split()
