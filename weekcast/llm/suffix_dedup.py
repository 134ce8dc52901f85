"""Removal of repeated byte strings, decided on sharded suffix arrays.

A string of `length` bytes is repeated if it also starts in a document with a smaller id. Every window of
that length is owned by its least-hashed gram (the leftmost on a tie), so equal windows have equal owners
and a run of neighbouring windows with one owner forms a short context.

1. Documents are stored in chunks. A chunk asks for each distinct gram of its own once; a bucket of grams
   answers which ones other documents have too.
2. For those a chunk sends each distinct context once, with the least id that has it, to the shard of its
   gram. The shard builds suffix arrays of its contexts by induced sorting; windows next to each other in
   suffix order whose permuted common prefix covers a whole window are equal, and the least id of each such
   group goes back to the chunks that asked.
   Documents that copy a whole text with a smaller id are told by a digest and ask nothing.
3. A chunk marks the bytes of the windows whose least id is smaller than the document's own.

A chunk sends a gram or a context once however often it has it, so a passage in a third of all documents
costs one row per chunk. A gram with more than HOT occurrences sends its windows one by one to shards chosen
by the whole window, so that no shard gathers the many different surroundings of one common passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.chunks import ROW, by_key, carried_of, dealt, pack, parts_of, row_of, rows_of, stored_chunks, text_of, unpack
from weekcast.llm.suffix_array import lanes, permuted_lcp, suffix_array
from weekcast.llm.tokens import spread

LENGTH = 50
GRAM = 20
#: Windows that are hashed at a time.
BLOCK = 1 << 16
#: Occurrences of a gram beyond which its windows are sent one by one.
HOT = 1024
#: Bytes of contexts in one suffix array, about.
ARRAY_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max

def owned_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end, gram position, gram key) of each run of windows with one owner, never across rows."""
    parts = []
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        some = data[at : at + BLOCK + length - 1]
        windows = len(some) - length + 1
        key = _gram_keys(some)
        # sliding minimum over the grams of a window, by doubling; the position makes the leftmost of equals least
        low, have, width = key & np.uint64(0xFFFFFFFF00000000) | np.arange(len(key), dtype=np.uint64), 1, length - GRAM + 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[step:], low[: len(low) - step])
            have += step
        owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.ones(windows, bool)
        for end in offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, at + len(some), "left")]:
            inside[max(0, end - at - length + 1) : max(0, min(windows, end - at))] = False
        head = np.r_[True, (owner[1:] != owner[:-1]) | ~inside[:-1]] & inside
        first = np.flatnonzero(head)
        last = np.flatnonzero(inside & np.r_[head[1:] | ~inside[1:], True])
        parts.append((first + at, last + at + 1, owner[first] + at, key[owner[first]] * np.uint64(0x9E3779B97F4A7C15)))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _gram_keys(data: np.ndarray) -> np.ndarray:
    """A 64-bit key of the GRAM bytes from each position on."""
    eight, n = lanes(data), len(data) - GRAM + 1
    key = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, GRAM, 8):
        key ^= key >> np.uint64(29)
        key += eight[min(at, GRAM - 8) : min(at, GRAM - 8) + n]
        key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0x94D049BB133111EB)
    return key


def _ask_grams(buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(chunk: int, found: list) -> Iterator[pa.RecordBatch]:
            key, doc = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            if not len(head):
                return
            count = np.minimum(np.diff(np.r_[head, len(key)]), 1 << 30)
            several = doc[head] != doc[np.r_[head[1:] - 1, len(key) - 1]]
            mine, key = (count * 2 + several).astype(np.uint32), key[head]
            bucket = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                yield row_of(int(bucket[a]), chunk, None, pack(np.diff(key[a:b], prepend=np.uint64(0))), pack(mine[a:b]))

        chunk, found, docs = None, [], 0
        for row in rows_of(batches):
            if found and row["chunk"] != chunk:
                yield from flush(chunk, found)
                found, docs = [], 0
            chunk = row["chunk"]
            data, offsets = text_of(row)
            first, _, _, key = owned_runs(data, offsets, length)
            found.append((key, docs + np.searchsorted(offsets, first, "right")))
            docs += len(offsets)
        if found:
            yield from flush(chunk, found)

    return run


def _answer_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket (its number in `chunk`, the asking chunk in `step`) to the shared grams of each chunk."""
    for _, rows in by_key(rows_of(batches), "chunk"):
        keys = [np.cumsum(unpack(r["a"], np.uint64), dtype=np.uint64) for r in rows]
        key, mine = np.concatenate(keys), np.concatenate([unpack(r["b"], np.uint32) for r in rows]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        size = np.diff(np.r_[head, len(key)])
        shared = (size > 1) | (np.add.reduceat(mine[order] & 1, head) > 0)
        hot = np.add.reduceat(mine[order] >> 1, head) > HOT
        state = np.empty(len(key), np.uint8)
        state[order] = np.repeat(shared * (1 + hot), size)
        at = 0
        for row, own in zip(rows, keys):
            answer = state[at : at + len(own)]
            at += len(own)
            if answer.any():
                yield row_of(row["step"], -1, None, pack(np.diff(own[answer > 0], prepend=np.uint64(0))), pack(answer[answer > 0]))


class _Contexts:
    """The distinct contexts of one chunk and their numbers."""

    def __init__(self, answers: list[dict], length: int):
        self.length, self.number = length, {}
        self.key = np.concatenate([np.empty(0, np.uint64), *[np.cumsum(unpack(r["a"], np.uint64), dtype=np.uint64) for r in answers]])
        self.state = np.concatenate([np.empty(0, np.uint8), *[unpack(r["b"], np.uint8) for r in answers]])
        order = np.argsort(self.key)
        self.key, self.state = self.key[order], self.state[order]

    def find(self, data: np.ndarray, offsets: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, first window, windows, gram offset or 255, key) of each shared context, in text order;
        rows in `left_out` have none."""
        first, end, gram, key = owned_runs(data, offsets, self.length)
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        state = np.where(self.key[at] == key, self.state[at], 0) if len(self.key) else np.zeros(len(key), np.uint8)
        keep = state > 0
        keep &= ~left_out[np.searchsorted(offsets, first, "right") - 1]
        first, end, gram, key, hot = first[keep], end[keep], gram[keep], key[keep], state[keep] == 2
        # the windows of a hot gram are contexts of their own
        many = np.where(hot, end - first, 1)
        hot, gram, key = np.repeat(hot, many), np.repeat(gram, many), np.repeat(key, many)
        start = spread(first, many)
        windows = np.where(hot, 1, np.repeat(end - first, many))
        raw, number = data.tobytes(), self.number
        spans = zip(start.tolist(), (start + windows + self.length - 1).tolist())
        found = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in spans), np.int64, len(start))
        return found, start, windows, np.where(hot, 255, gram - start), key


def _steps(rows: list[dict], length: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, tuple, _Contexts]]:
    """(row, offsets, which documents are copies, shared contexts of the others, all contexts) of each step."""
    contexts = _Contexts([r for r in rows if r["step"] == -1], length)
    places = np.array([p for r in rows if r["step"] == -2 for p in r["ids"]], np.int64)
    for row in rows:
        if row["step"] >= 0:
            data, offsets = text_of(row)
            copied = np.zeros(len(offsets) - 1, bool)
            copied[places[places >> 32 == row["step"]] & 0xFFFFFFFF] = True
            yield row, offsets, copied, contexts.find(data, offsets, copied), contexts


def _copies(chunks: DataFrame, length: int) -> DataFrame:
    """Where documents stand whose whole text a document with a smaller id has: rows of step -2, the place
    (step << 32 | row) in `ids`. All their windows go, and none of their contexts needs to be sent."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, offsets = text_of(row)
            whole = np.flatnonzero(np.diff(offsets) >= length)
            digests = [hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest() for i in whole]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(whole), row["chunk"])), pa.array(whole + (row["step"] << 32)), pa.array(_ids(row)[whole]), pa.array(digests, pa.binary())], ["chunk", "place", "id", "digest"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, place in zip(*(batch.column(c).to_pylist() for c in ("chunk", "place"))):
                yield row_of(chunk, -2, [place])

    known = chunks.mapInArrow(spell, "chunk long, place long, id long, digest binary")
    least = known.groupBy("digest").agg(F.min("id").alias("least"))
    return known.join(least.hint("merge"), "digest").where(F.col("id") > F.col("least")).select("chunk", "place").mapInArrow(tell, ROW)


def _ids(row: dict) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)


def _ask_contexts(shards: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in by_key(rows_of(batches), "chunk"):
            parts, contexts = [], None
            for row, offsets, _, (number, start, _, gram, key), contexts in _steps(rows, length):
                parts.append((number, _ids(row)[np.searchsorted(offsets, start, "right") - 1], gram, key))
            if contexts is None or not contexts.number:
                continue
            number, ids, gram, key = (np.concatenate(x) for x in zip(*parts))
            least = np.full(len(contexts.number), NO_ID)
            np.minimum.at(least, number, ids)
            _, seen = np.unique(number, return_index=True)  # numbers run from 0 without gaps
            gram, key = gram[seen].astype(np.uint8), key[seen]
            raws = list(contexts.number)
            for i in np.flatnonzero(gram == 255):
                key[i] = xxhash.xxh64_intdigest(raws[i])
            shard = ((key >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0, True])
            for a, b in zip(edges[:-1], edges[1:]):
                mine = order[a:b]
                some = [raws[i] for i in mine]
                sizes = np.fromiter(map(len, some), np.uint8, len(some))
                yield row_of(int(shard[mine[0]]), chunk, None, pack(mine.astype(np.uint32)), pack(np.stack([sizes, gram[mine]], 1).reshape(-1).view(np.uint16)), zstandard.compress(b"".join(some), 3), pack(least[mine]))

    return run


def equal_window_minima(contexts: list[bytes], least: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each context the least of `least` over all contexts that hold an equal window."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    n, total = len(contexts), int(sizes.sum()) + len(contexts)
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    owner = np.repeat(np.arange(n), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    text = data.astype(np.int64) + n
    text[ends] = np.arange(n)[::-1]  # separators are smaller than all bytes and differ; the last is 0
    order = suffix_array(text)
    whole = (ends[owner] - np.arange(total) >= length)[order]
    common = permuted_lcp(data, order, length)[order]
    ranked = order[whole]
    # equal windows are neighbours; a suffix shorter than a window ends a group, whatever follows its separator
    head = np.flatnonzero((~np.r_[False, whole[:-1]] | (common < length))[whole])
    minima = np.full(total, NO_ID)
    if len(head):
        minima[ranked] = np.repeat(np.minimum.reduceat(least[owner[ranked]], head), np.diff(np.r_[head, len(ranked)]))
    return [minima[e - s : e - length + 1] for e, s in zip(ends.tolist(), sizes.tolist())]


def _answer_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(rows_of(batches), "chunk"):
            number, asked, groups = {}, [], {}
            least = []
            for row in rows:
                sizes, gram = unpack(row["b"], np.uint16).view(np.uint8).reshape(-1, 2).T
                raw, ends, mine = zstandard.decompress(row["c"]), np.cumsum(sizes, dtype=np.int64), []
                for end, size, offset, low in zip(ends.tolist(), sizes.tolist(), gram.tolist(), unpack(row["d"], np.int64).tolist()):
                    one = raw[end - size : end]
                    i = number.setdefault(one, len(number))
                    mine.append(i)
                    if i == len(least):
                        least.append(low)
                        if offset != 255:
                            groups.setdefault(one[offset : offset + GRAM], []).append(i)
                    elif low < least[i]:
                        least[i] = low
                asked.append(mine)
            raws, least = list(number), np.array(least, np.int64)
            minima: dict[int, np.ndarray] = {}
            block: list[int] = []
            size = 0
            for members in [g for g in groups.values() if len(g) > 1] + [[]]:
                if block and (not members or size > ARRAY_BYTES):
                    minima.update(zip(block, equal_window_minima([raws[i] for i in block], least[block], length)))
                    block, size = [], 0
                block += members
                size += sum(len(raws[i]) for i in members)
            for row, mine in zip(rows, asked):
                # a context that shares its gram with no other has one least id, which stands for all its windows
                values = [minima[i] if i in minima else least[i : i + 1] for i in mine]
                yield row_of(row["step"], -1, None, row["a"], pack(np.fromiter(map(len, values), np.uint8, len(values))), pack(np.concatenate(values)))

    return run


def _mark(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Step rows with the shared contexts of each step: (number, first window, windows) in c, copies in d."""
        for chunk, rows in by_key(rows_of(batches), "chunk"):
            for row, _, copied, (number, start, windows, _, _), _ in _steps(rows, length):
                yield row_of(chunk, row["step"], row["ids"], row["a"], row["b"], pack(np.stack([number, start, windows], 1).reshape(-1)), pack(copied.view(np.uint8)), carried=row["carried"])

    return run


def _remove(length: int, extra: Sequence[str], as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(rows_of(batches), "chunk"):
            answers = [(unpack(r["a"], np.uint32), unpack(r["b"], np.uint8).astype(np.int64), unpack(r["c"], np.int64)) for r in rows if r["step"] < 0]
            if answers:
                number, many, flat = (np.concatenate(x) for x in zip(*answers))
                at, held = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
                at[number], held[number] = np.cumsum(many) - many, many
            for row in rows:
                if row["step"] < 0:
                    continue
                data, offsets = text_of(row)
                number, start, windows = unpack(row["c"], np.int64).reshape(-1, 3).T
                cover = np.zeros(len(data) + 1, np.int64)
                if len(number):
                    window = spread(start, windows)
                    single = np.repeat(held[number] == 1, windows)
                    low = flat[np.where(single, np.repeat(at[number], windows), spread(at[number], windows))]
                    window = window[low < _ids(row)[np.searchsorted(offsets, window, "right") - 1]]
                    np.add.at(cover, window, 1)
                    np.add.at(cover, window + length, -1)
                gone = np.cumsum(cover)[: len(data)] > 0
                gone |= np.repeat(unpack(row["d"], np.uint8) > 0, np.diff(offsets))
                kept = _kept(row["ids"], data, offsets, gone, as_text)
                carried = carried_of(row) if extra else None
                yield pa.RecordBatch.from_arrays([*kept.columns, *(carried.column(c) for c in extra)], [*kept.schema.names, *extra])

    return run


def _kept(ids: list, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, as_text: bool) -> pa.RecordBatch:
    starts, ends, kept = [], [], []
    for a, b in zip(offsets[:-1], offsets[1:]):
        edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
        starts.append(edge[::2].tolist())
        ends.append(edge[1::2].tolist())
        kept.append(data[a:b][~gone[a:b]].tobytes())
    longs = pa.list_(pa.int64())
    columns = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(offsets)), "span_starts": pa.array(starts, longs), "span_ends": pa.array(ends, longs), "kept": pa.array(kept, pa.binary())}
    if as_text:
        letter = np.cumsum((data & 0xC0) != 0x80)  # number of the character that each byte belongs to
        whole = np.bincount(letter, weights=gone)[letter] == 0 if len(data) else gone
        columns["kept_text"] = pa.array([data[a:b][whole[a:b]].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, extra: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, span_starts, span_ends, kept) and the `extra` columns of each row of `docs`.

    The spans are the maximal removed byte runs of the UTF-8 text, [start, end), `kept` the other bytes; with
    `as_text`, `kept_text` holds the characters of which every byte is kept.
    Strings are compared on the input, in whole texts, and never across rows. Null text counts as empty; a
    null id counts as larger than all others, so its repeats go and it removes nothing. Rows with one id are
    not smaller than each other: they keep what only they share. Texts under `length` bytes stay whole. Empty
    input gives no rows; other columns are not read, and `extra` ones must not have a result's name. `length` must lie between 20 and 140.
    """
    if not GRAM <= length <= 140:
        raise ValueError("length must lie between 20 and 140")
    parts = parts_of(docs)
    chunks = stored_chunks(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *extra), extra)
    shared = dealt(chunks.mapInArrow(_ask_grams(parts, length), ROW)).mapInArrow(_answer_grams, ROW)
    whole = dealt(chunks.unionByName(shared).unionByName(_copies(chunks, length)))
    minima = dealt(whole.mapInArrow(_ask_contexts(parts, length), ROW)).mapInArrow(_answer_contexts(length), ROW)
    marked = dealt(whole.mapInArrow(_mark(length), ROW).unionByName(minima))
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    text = ", kept_text string" if as_text else ""
    return marked.mapInArrow(_remove(length, extra, as_text), f"doc_id long, n_bytes long, span_starts array<long>, span_ends array<long>, kept binary{text}{kinds}")
