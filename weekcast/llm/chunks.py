"""Documents stored in chunks, and rows of compressed numbers that chunks and buckets send each other.

A chunk is a run of whole documents of one input partition. Operators that need something about every
distinct word or gram of the corpus let each chunk ask for its own distinct ones once: a row per chunk and
bucket, however often they occur in the chunk. Chunks are written before they are used, so that every pass
sees the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weekcast.llm.common import slices, stored, text_buffer

#: Bytes of text in a chunk (a longer single text is one chunk).
CHUNK_BYTES = 16 << 20
#: Buckets for each shuffle partition.
PARTS_PER_PARTITION = 4

#: zstd level of texts: they are written once and shuffled several times.
TEXT_LEVEL = 6

ROW = "chunk long, step long, ids array<long>, a binary, b binary, c binary, d binary, carried binary"
NAMES = ["chunk", "step", "ids", "a", "b", "c", "d", "carried"]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as zstd-compressed byte planes: high bytes that hardly change cost next to nothing."""
    return zstandard.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T.tobytes(), 1)


def unpack(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def row_of(chunk: int, step: int, ids: list | None, *blobs: bytes, carried: bytes | None = None) -> pa.RecordBatch:
    blobs = [*blobs, *[None] * (4 - len(blobs)), carried]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([step], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *[pa.array([b], pa.binary()) for b in blobs]], NAMES)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def by_key(rows: Iterator[dict], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Neighbouring rows with one key, together."""
    now, held = None, []
    for row in rows:
        if held and row[key] != now:
            yield now, held
            held = []
        now = row[key]
        held.append(row)
    if held:
        yield now, held


def dealt(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of one chunk (or bucket) together, in the order of their steps; in `parts` tasks, if given."""
    return (rows.repartition(parts, "chunk") if parts else rows.repartition("chunk")).sortWithinPartitions("chunk", "step")


def parts_of(df: DataFrame) -> int:
    return PARTS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def carry(columns: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, columns.schema) as out:
        out.write_batch(columns)
    return zstandard.compress(sink.getvalue().to_pybytes(), 1)


def carried_of(row: dict) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.decompress(row["carried"])).read_next_batch()


def stored_chunks(docs: DataFrame, extra: Sequence[str] = (), spell: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """Documents (doc_id long, text) in chunks: step rows with ids, sizes (a), compressed text (b) and the
    `extra` columns (carried). `spell` makes the texts to be stored of a step's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, step, held = TaskContext.get().partitionId() << 20, 0, 0
        for part in slices(batches, "text"):
            data, offsets = text_buffer(spell(part.column("text")) if spell else part.column("text"))
            if step and held + len(data) > CHUNK_BYTES:
                chunk, step, held = chunk + 1, 0, 0
            yield row_of(chunk, step, part.column("doc_id").to_pylist(), pack(np.diff(offsets)), zstandard.compress(data.tobytes(), TEXT_LEVEL), carried=carry(part.select(list(extra))) if extra else None)
            step, held = step + 1, held + len(data)

    return stored(docs.mapInArrow(run, ROW), "chunks")


def text_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A step row's bytes and offsets."""
    return np.frombuffer(zstandard.decompress(row["b"]), np.uint8), np.concatenate([[0], np.cumsum(unpack(row["a"], np.int64))])


def summed(rows: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, slots: int = 16) -> np.ndarray:
    """The sum of the vectors that `fold` makes of each partition, by way of `slots` tasks; the driver gets
    one vector of `size` numbers from each of those, however many partitions there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots], pa.int64()), pa.array([fold(batches).astype(float).tobytes()], pa.binary())], ["slot", "sums"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(size), 0
        for batch in batches:
            met += batch.num_rows
            for blob in batch.column("sums"):
                total += np.frombuffer(blob.as_py())
        if met:  # a task without rows sends nothing
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    slotted = rows.mapInArrow(add, "slot long, sums binary").repartition(slots, "slot").sortWithinPartitions("slot", "sums").mapInArrow(meet, "sums binary")
    return sum((np.frombuffer(r.sums) for r in slotted.collect()), np.zeros(size))
