"""Packing: documents become pieces of at most one window, pieces fill windows best-fit decreasing.

A document's ids, with the end id behind them, are first cut into full windows; the rest is one shorter
piece. Pieces are dealt by a hash into groups of about `group_rows`; a group's pieces arrive sorted from
long to short, and a segment tree over remaining capacities 0..window finds the tightest open window that
still takes the piece. Placing is online, so a task holds only the open windows' ids and no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import slices, stored
from weekcast.llm.tokens import lower_word_encoder

WINDOW = 4096
END_ID = 2
#: Pieces in a packing group, on average; a group leaves a few windows unfilled.
GROUP_ROWS = 2000
#: Windows that one group can number.
GROUP_WINDOWS = 1 << 40
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the least capacity that suffices."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)  # per node: is a window open below it
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]
        self.window = window
        self.opened = 0

    def _mark(self, leaf: int, value: int) -> None:
        node, tree = leaf + self.size, self.any
        tree[node] = value
        while node > 1:
            node >>= 1
            new = tree[2 * node] | tree[2 * node + 1]
            if tree[node] == new:
                return
            tree[node] = new

    def tightest(self, need: int) -> int:
        """The least capacity of at least `need` at which a window is open; -1 if there is none."""
        node, tree = need + self.size, self.any
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.size

    def place(self, length: int) -> tuple[int, int]:
        """(window number, offset in it) for a piece of `length`."""
        capacity = self.tightest(length)
        if capacity < 0:
            capacity, number = self.window, self.opened
            self.opened += 1
        else:
            number = self.windows[capacity].pop()
            if not self.windows[capacity]:
                self._mark(capacity, 0)
        left = capacity - length
        if left:
            self.windows[left].append(number)
            if len(self.windows[left]) == 1:
                self._mark(left, 1)
        return number, self.window - capacity


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document cut into full windows and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = lower_word_encoder(tokenizer)
        for part in slices(batches, "text"):
            rows: list[tuple] = []
            for row, ids in enumerate(encoder.encode(part.column("text").fill_null("").to_pylist())):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                total = len(ids) + 1
                for start in range(0, total, window):
                    length = min(window, total - start)
                    rows.append((row, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), total))
            column = [np.array(c, np.int64) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(column[0])), *map(pa.array, column[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of one id, the end id. Rows that repeat an id are packed each for
    itself; a null id stays null. Equal lengths are placed in the order of id, start and crc. Empty input
    gives no rows; other columns are not read. A sequence id is group * 2**40 + the window's number there.
    """
    cut = stored(pieces(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), tokenizer, window, end_id), "pieces")
    groups = max(1, -(-cut.count() // group_rows))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    dealt = dealt.repartition("part").sortWithinPartitions("part", F.desc("length"), "doc_id", "start", "ids_crc32")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, OpenWindows(window)
        for batch in batches:
            placed = []
            for group, length in zip(batch.column("part").to_pylist(), batch.column("length").to_pylist()):
                if group != now:
                    now, windows = group, OpenWindows(window)
                number, offset = windows.place(length)
                placed.append((group * GROUP_WINDOWS + number, offset))
            both = np.array(placed, np.int64).reshape(-1, 2)
            kept = batch.drop_columns(["part"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(both[:, 0]), pa.array(both[:, 1])], [*kept.schema.names, "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
