"""Byte-level BPE over a distinct-word table.

1. Each task splits its texts into words and gives every distinct word of its chunk a number.
2. The words of all chunks are dealt by hash into buckets; a bucket's task encodes each distinct word once
   and answers every chunk that asked for it.
3. Chunk by chunk the ids come back to the positions of their words, and a table from id to piece joins the
   ids to bytes again.

Only the distinct words of a chunk, the ids for them and the compressed word numbers are shuffled, never a
row per word position. Steps 1 and 3 read the texts' word numbers in two passes over `docs`; a checksum of
the chunk's words travels on both ways, and a chunk whose passes differ (an input whose rows come in another
order each time it is read) raises instead of giving wrong ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import slices
from weekcast.llm.tokens import BYTE_WORD, PLAIN, byte_letters, load_tokenizer, spread, word_ids

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Distinct words after which a task closes its chunk; bounds the tables of steps 1 and 3.
CHUNK_WORDS = 400_000
#: Word buckets for each shuffle partition.
BUCKETS_PER_PARTITION = 4
CHUNKS_PER_TASK = 1 << 20


class Splitter:
    """The words of a text, cut as the vocabulary's own split rule cuts it; special tokens are words."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)

    def _split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return BYTE_WORD.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        for special in self.specials:
            if special in text:
                out: list[str] = []
                for i, between in enumerate(text.split(special)):
                    out += [special] * (i > 0) + self.words(between)
                return out
        return self._split(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        model, special = self.tokenizer.model, {s: [self.tokenizer.token_to_id(s)] for s in self.specials}
        return [special[w] if w in special else word_ids(model, w) for w in words]


@lru_cache(maxsize=2)
def splitter_of(path: str) -> Splitter:
    """One splitter for all tasks that a worker process runs."""
    return Splitter(path)


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.tobytes(), 1)


def _unpacked(blob: bytes, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _numbered(batches: Iterator[pa.RecordBatch], splitter: Splitter) -> Iterator[tuple[int, object, object]]:
    """(chunk, rows, (counts, numbers)) for each step of texts, and (chunk, None, words) at the end of each chunk."""
    chunk, table, rows_open = None, {}, False
    for part in slices(batches, "text"):
        if chunk is None:
            chunk = part.column("at")[0].as_py() * CHUNKS_PER_TASK
        split = [splitter.words(t) for t in part.column("text").fill_null("").to_pylist()]
        code, words = pd.factorize(np.array([w for s in split for w in s], dtype=object))
        number = np.fromiter((table.setdefault(w, len(table)) for w in words), np.uint32, len(words))
        yield chunk, part.column("doc_id"), (np.fromiter(map(len, split), np.int64, len(split)), number[code] if len(words) else np.empty(0, np.uint32))
        rows_open = True
        if len(table) >= CHUNK_WORDS:
            yield chunk, None, list(table)
            chunk, table, rows_open = chunk + 1, {}, False
    if rows_open:
        yield chunk, None, list(table)


def _checksum(words: list[str]) -> int:
    return zlib.crc32("\x00".join(words).encode())


def encode_decode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER, buckets: int | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of each row: ids as little-endian unsigned 32-bit numbers end to end, and the
    text that they decode to.

    Null text counts as empty and has no ids. Rows that repeat an id each come back; a null id stays null.
    Empty input gives no rows; other columns are not read. Special tokens in a text become their ids.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.spark_partition_id().alias("at"))
    buckets = buckets or BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows, found in _numbered(batches, splitter_of(tokenizer)):
            if rows is not None or not found:
                continue
            raws = [w.encode() for w in found]
            bucket = np.fromiter((zlib.crc32(r) % buckets for r in raws), np.int64, len(raws))
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True])
            checksum, blobs = _checksum(found), []
            for a, b in zip(edges[:-1], edges[1:]):
                mine = order[a:b]
                blobs.append((int(bucket[mine[0]]), chunk, _packed(mine.astype(np.uint32)), zstandard.compress(b"\x00".join(raws[i].replace(b"\x00", b"\xff") for i in mine), 1), checksum))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blobs), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["bucket", "chunk", "numbers", "words", "checksum"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, table, now = splitter_of(tokenizer), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    table, now = {}, row["bucket"]
                # 0xff never occurs in UTF-8; it stands for the byte that separates words
                words = [w.replace(b"\xff", b"\x00").decode() for w in zstandard.decompress(row["words"]).split(b"\x00")]
                missing = [w for w in words if w not in table]
                table.update(zip(missing, splitter.encode(missing)))
                ids = [table[w] for w in words]
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.array([i for one in ids for i in one], np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([0], pa.int64()), pa.array([row["checksum"]]), pa.array([row["numbers"]], pa.binary()), pa.array([_packed(lengths)], pa.binary()), pa.array([_packed(flat)], pa.binary()), pa.nulls(1, id_list)], names)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: list[tuple] = []
        for chunk, rows, found in _numbered(batches, splitter_of(tokenizer)):
            if rows is not None:
                counts, numbers = found
                steps.append((_packed(numbers), _packed(counts), rows.to_pylist()))
                continue
            for step, (numbers, counts, ids) in enumerate(steps):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([step + 1], pa.int64()), pa.array([_checksum(found)]), pa.array([numbers], pa.binary()), pa.array([counts], pa.binary()), pa.nulls(1, pa.binary()), pa.array([ids], id_list)], names)
            steps = []

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_tokenizer(tokenizer).get_vocab(with_added_tokens=True)
        letters = byte_letters()
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            pieces[i] = bytes(letters[c] for c in token)
        piece_length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece_start = np.cumsum(piece_length) - piece_length
        piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        now, checksum, answers, table = None, None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != now:
                    now, checksum, answers, table = row["chunk"], row["checksum"], [], None
                if row["checksum"] != checksum:
                    raise ValueError("two readings of the documents differ; store them before encoding")
                if not row["step"]:
                    answers.append((_unpacked(row["numbers"]), _unpacked(row["counts"]), _unpacked(row["ids"])))
                    continue
                if table is None:  # the chunk's answers are complete: they sort before its texts
                    table = _table(answers)
                    answers = []
                start, length, flat = table
                numbers, counts = _unpacked(row["numbers"]), _unpacked(row["counts"], np.int64)
                if len(numbers) and (not len(start) or numbers.max() >= len(start)):
                    raise ValueError("two readings of the documents differ; store them before encoding")
                ids = flat[spread(start[numbers], length[numbers])]
                upto = np.concatenate([[0], np.cumsum(length[numbers])])[np.concatenate([[0], np.cumsum(counts)])]
                raw = piece_bytes[spread(piece_start[ids], piece_length[ids])]
                bytes_upto = np.concatenate([[0], np.cumsum(piece_length[ids])])[upto]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["rows"], id_list.value_type),
                    pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(upto[:-1], upto[1:])], pa.binary()),
                    pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bytes_upto[:-1], bytes_upto[1:])], pa.string()),
                ], ["doc_id", "ids", "decoded"])

    names = ["chunk", "step", "checksum", "numbers", "counts", "ids", "rows"]
    kind = own.schema["doc_id"].dataType
    id_list = pa.list_({"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind.simpleString()])
    part = f"chunk long, step long, checksum long, numbers binary, counts binary, ids binary, rows array<{kind.simpleString()}>"
    asked = own.mapInArrow(ask, "bucket long, chunk long, numbers binary, words binary, checksum long")
    answered = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, part)
    both = answered.unionByName(own.mapInArrow(positions, part))
    return both.repartition("chunk").sortWithinPartitions("chunk", "step").mapInArrow(join, f"doc_id {kind.simpleString()}, ids binary, decoded string")


def _table(answers: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, ids): where each word number's ids lie in the flat id array."""
    if not answers:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
    numbers, lengths, flat = (np.concatenate(x) for x in zip(*answers))
    start, length = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    start[numbers] = np.cumsum(lengths.astype(np.int64)) - lengths
    length[numbers] = lengths
    return start, length, flat
