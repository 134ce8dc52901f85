"""Removal of repeated passages of words by suffix automata of reference shards.

A passage of `length` words is repeated if it also starts in a document with a smaller id. Each window of that
many words is owned by its least-hashed gram of GRAM words (the leftmost on a tie): equal windows have equal
owners, and a run of neighbouring windows with one owner is a context.

1. Documents are stored in chunks, as words and single spaces. A chunk asks for each distinct gram of its own
   once; the gram's bucket answers which ones several documents have.
2. Contexts of those are references. A chunk sends each distinct one once, with the least id that has it, to the
   shard of its gram. A shard builds a suffix automaton of its references, whose states know the least id of
   every substring, and streams all contexts through it: where the matching statistic reaches `length`, the
   least id of that window goes back to the chunks that hold it.
3. A chunk covers the windows whose least id is smaller than the document's own; maximal covered runs go.

Automata aren't broadcast to all tasks, since they grow with the repeated text of the corpus: each meets just the
contexts of its own grams, which a shuffle by shard brings to it. Automata are built over parts of a shard of
about AUTOMATON_WORDS words. A gram that occurs more than HOT times sends its windows one by one, to shards and
parts by a hash of the whole window, so that no shard gathers all surroundings of a common passage; those that
one document alone has are no references.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.chunks import ROW, by_key, dealt, pack, row_of, rows_of, stored_chunks, text_of, unpack
from weekcast.llm.common import STEP_BYTES, spread, stored, texts, words_of
from weekcast.llm.suffix_automaton import SuffixAutomaton

#: Words of a passage, and of a gram.
LENGTH = 50
GRAM = 20
#: Occurrences of a gram from which its windows travel one by one.
HOT = 1024
#: Words in an automaton (a gram's contexts stay in one, however many).
AUTOMATON_WORDS = 50_000
#: Bytes of stored text for each bucket and shard.
BUCKET_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max
BASE = np.uint64(0x9E3779B97F4A7C15)
SHARED, COMMON = 1, 2


def _mixed(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)


def _spaced(column: pa.Array) -> pa.Array:
    """Each text as its words, with one space behind each."""
    return pa.array([b" ".join([*words_of(raw), b""]) for raw in texts(column)], pa.binary()).cast(pa.string())


class Words:
    """The words of a step: the byte at which each starts and its space stands, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.end = np.flatnonzero(data == 32)
        self.start = np.r_[0, self.end[:-1] + 1] if len(self.end) else self.end
        self.row = np.searchsorted(self.end, offsets)

    def keys(self) -> np.ndarray:
        """A 64-bit key of each word."""
        if not len(self.end):
            return np.empty(0, np.uint64)
        size = self.end - self.start + 1
        place = np.arange(len(self.data)) - np.repeat(self.start, size)
        return _mixed(np.add.reduceat((self.data.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place], self.start))

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, end, key of the owner) of each run of windows with one owner, never across rows."""
        key, windows = self.keys(), len(self.end) - length + 1
        if windows < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        power, have, gram = _powers(GRAM), 0, np.zeros(len(key) - GRAM + 1, np.uint64)
        block, size = key, 1  # keys of runs of 1, 2, 4 ... words; those in GRAM's binary digits are strung together
        while size <= GRAM:
            if GRAM & size:
                gram += block[have : have + len(gram)] * power[have]
                have += size
            block, size = block[: len(block) - size] + block[size:] * power[size], size * 2
        gram = _mixed(gram)
        # sliding minimum over the grams of a window by doubling; the position makes the leftmost of equals least
        low, have, width = gram & np.uint64(0xFFFFFFFF00000000) | np.arange(len(gram), dtype=np.uint64), 1, length - GRAM + 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[step:], low[: len(low) - step])
            have += step
        owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.ones(windows, bool)
        for end in self.row[1:-1]:
            inside[max(0, end - length + 1) : max(0, min(windows, end))] = False
        head = np.r_[True, (owner[1:] != owner[:-1]) | ~inside[:-1]] & inside
        first, last = np.flatnonzero(head), np.flatnonzero(inside & np.r_[head[1:] | ~inside[1:], True])
        return first, last + 1, _mixed(gram[owner[first]] + BASE)  # a least key's own bits are small: mixed again to deal by

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.row, word, "right") - 1


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _edges(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1], True]).tolist()
    return zip(edges[:-1], edges[1:])


def _ask_grams(buckets: int, length: int):
    def flush(chunk: int, found: list) -> Iterator[pa.RecordBatch]:
        key, doc = (np.concatenate(x) for x in zip(*found))
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.minimum(np.diff(np.r_[head, len(key)]), 1 << 30)
        several = doc[head] != doc[np.r_[head[1:], len(key)] - 1]
        mine, key = (count * 2 + several).astype(np.uint32), key[head]
        bucket = _bucket(key, buckets)
        for a, b in _edges(bucket):
            yield row_of(int(bucket[a]), chunk, None, pack(np.diff(key[a:b], prepend=np.uint64(0))), pack(mine[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, found, docs = None, [], 0
        for row in rows_of(batches):
            if found and row["chunk"] != chunk:
                yield from flush(chunk, found)
                found, docs = [], 0
            chunk, words = row["chunk"], Words(*text_of(row))
            first, _, key = words.runs(length)
            found.append((key, docs + words.row_of(first)))
            docs += len(words.row)
        if found:
            yield from flush(chunk, found)

    return run


def _answer_grams(hot: int):
    """A bucket's rows (the bucket in `chunk`, the asking chunk in `step`) to the shared grams of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(rows_of(batches), "chunk"):
            keys = [np.cumsum(unpack(r["a"], np.uint64), dtype=np.uint64) for r in rows]
            key, mine = np.concatenate(keys), np.concatenate([unpack(r["b"], np.uint32) for r in rows]).astype(np.int64)
            distinct, at = np.unique(key, return_inverse=True)
            askers = np.bincount(at, minlength=len(distinct))
            count, several = np.bincount(at, mine >> 1), np.bincount(at, mine & 1) > 0
            state = np.where((askers > 1) | several, np.where(count > hot, COMMON, SHARED), 0).astype(np.uint8)[at]
            for row, own, answer in zip(rows, keys, np.split(state, np.cumsum([len(k) for k in keys])[:-1])):
                if answer.any():
                    yield row_of(row["step"], -2, None, pack(np.diff(own[answer > 0], prepend=np.uint64(0))), pack(answer[answer > 0]))

    return run


class _Contexts:
    """The distinct contexts of a chunk's shared grams, and their numbers."""

    def __init__(self, rows: list[dict], length: int):
        answers = [r for r in rows if r["step"] == -2]
        self.length, self.number = length, {}
        key = np.concatenate([np.empty(0, np.uint64), *[np.cumsum(unpack(r["a"], np.uint64), dtype=np.uint64) for r in answers]])
        state = np.concatenate([np.empty(0, np.uint8), *[unpack(r["b"], np.uint8) for r in answers]])
        order = np.argsort(key)
        self.key, self.state = key[order], state[order]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, first window, windows, owner's key, whether common) of each context in text order."""
        first, end, key = words.runs(self.length)
        if not len(self.key) or not len(key):
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        state = np.where(self.key[at] == key, self.state[at], 0)
        keep = state > 0
        first, end, key, common = first[keep], end[keep], key[keep], state[keep] == COMMON
        many = np.where(common, end - first, 1)  # windows of a common gram are contexts of their own
        common, key = np.repeat(common, many), np.repeat(key, many)
        start = spread(first, many)
        windows = np.where(common, 1, np.repeat(end - first, many))
        raw, number = words.data.tobytes(), self.number
        spans = zip(words.start[start].tolist(), words.end[start + windows + self.length - 2].tolist())
        return np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in spans), np.int64, len(start)), start, windows, key, common


def _ids(row: dict) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)


def _send_contexts(shards: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in by_key(rows_of(batches), "chunk"):
            contexts, parts, docs = _Contexts(rows, length), [], 0
            for row in rows:
                if row["step"] < 0:
                    continue
                words = Words(*text_of(row))
                number, start, _, key, common = contexts.find(words)
                doc = words.row_of(start)
                parts.append((number, _ids(row)[doc], key, common, doc + docs))
                docs += len(words.row)
            if not contexts.number:
                continue
            number, ids, key, common, doc = (np.concatenate(x) for x in zip(*parts))
            n, raws = len(contexts.number), list(contexts.number)
            _, seen = np.unique(number, return_index=True)  # numbers run from 0 without gaps
            least, low, high = np.full(n, NO_ID), np.full(n, NO_ID), np.zeros(n, np.int64)
            np.minimum.at(least, number, ids)
            np.minimum.at(low, number, doc)
            np.maximum.at(high, number, doc)
            key, common = key[seen], common[seen]
            for i in np.flatnonzero(common):
                key[i] = xxhash.xxh64_intdigest(raws[i])
            flags = (common * 2 + (high > low)).astype(np.uint8)
            shard = _bucket(key, shards)
            order = np.argsort(shard, kind="stable")
            for a, b in _edges(shard[order]):
                mine = order[a:b]
                some = [raws[i] for i in mine]
                sizes = np.fromiter(map(len, some), np.int64, len(some))
                about = np.stack([mine.astype(np.int64), sizes, flags[mine].astype(np.int64), (key[mine] & np.uint64(0xFFFF)).astype(np.int64)], 1)
                yield row_of(int(shard[mine[0]]), chunk, None, pack(about.ravel()), pack(least[mine]), zstandard.compress(b"".join(some), 3))

    return run


def window_minima(contexts: list[bytes], least: list[int], length: int = LENGTH) -> list[list[int]]:
    """For each window of each context the least of `least` over all contexts that hold an equal window."""
    symbols: dict[bytes, int] = {}
    spelt = [[symbols.setdefault(w, len(symbols)) for w in c.split()] for c in contexts]
    automaton = SuffixAutomaton(NO_ID)
    for i in sorted(range(len(contexts)), key=least.__getitem__):
        automaton.add(spelt[i], least[i])
    automaton.close()
    out = []
    for words in spelt:
        have, low = automaton.match(words, length)
        out.append([x if n >= length else NO_ID for n, x in zip(have[length - 1 :], low[length - 1 :])])
    return out


def _answer_contexts(length: int, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(rows_of(batches), "chunk"):
            number: dict[bytes, int] = {}
            least, reference, part, asked = [], [], [], []
            for row in rows:
                about = unpack(row["a"], np.int64).reshape(-1, 4)
                raw, ends, mine = zstandard.decompress(row["c"]), np.cumsum(about[:, 1]), []
                for end, (_, size, flags, own_part), low in zip(ends.tolist(), about.tolist(), unpack(row["b"], np.int64).tolist()):
                    one = raw[end - size : end]
                    i = number.setdefault(one, len(number))
                    mine.append(i)
                    if i == len(least):
                        least.append(low)
                        part.append(own_part)
                        # a window that travels alone is a reference once two documents have it
                        reference.append(flags != 2)
                    else:
                        least[i] = min(least[i], low)
                        reference[i] = True
                asked.append((about[:, 0], mine))
            raws = list(number)
            minima: list[list[int]] = [[low] for low in least]
            block, words = [], 0
            chosen = sorted((i for i in range(len(raws)) if reference[i]), key=part.__getitem__)
            for k, i in enumerate(chosen):
                block.append(i)
                words += raws[i].count(b" ") + 1
                if k + 1 == len(chosen) or words >= block_words and part[chosen[k + 1]] != part[i]:
                    for j, found in zip(block, window_minima([raws[j] for j in block], [least[j] for j in block], length)):
                        minima[j] = found
                    block, words = [], 0
            for row, (numbers, mine) in zip(rows, asked):
                values = [minima[i] for i in mine]
                yield row_of(row["step"], -1, None, pack(numbers), pack(np.fromiter(map(len, values), np.int64, len(values))), pack(np.array([x for v in values for x in v], np.int64)))

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(rows_of(batches), "chunk"):
            contexts = _Contexts(rows, length)
            answers = [[unpack(r[c], np.int64) for c in "abc"] for r in rows if r["step"] == -1]
            number, many, low = (np.concatenate(x) for x in zip(*answers)) if answers else [np.empty(0, np.int64)] * 3
            at = np.empty(len(number), np.int64)
            at[number] = np.cumsum(many) - many
            for row in rows:
                if row["step"] >= 0:
                    words = Words(*text_of(row))
                    found, start, windows, _, _ = contexts.find(words)
                    window = spread(start, windows)
                    gone = window[low[spread(at[found], windows)] < _ids(row)[words.row_of(window)]]
                    cover = np.zeros(len(words.end) + 1, np.int64)
                    np.add.at(cover, gone, 1)
                    np.add.at(cover, gone + length, -1)
                    yield _kept(row["ids"], words, np.cumsum(cover)[:-1] > 0)

    return run


def _kept(ids: list, words: Words, gone: np.ndarray) -> pa.RecordBatch:
    stays = np.repeat(~gone, words.end - words.start + 1)
    upto = np.concatenate([[0], np.cumsum(stays)])
    edge = np.r_[0, words.end + 1][words.row]  # first byte of each row
    raw = words.data[stays].tobytes()
    starts, ends, kept = [], [], []
    for a, b, w, x in zip(edge[:-1], edge[1:], words.row[:-1], words.row[1:]):
        change = np.flatnonzero(np.diff(np.r_[False, gone[w:x], False]))
        starts.append(change[::2].tolist())
        ends.append(change[1::2].tolist())
        kept.append(raw[upto[a] : max(upto[a], upto[b] - 1)].decode())
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(words.row), pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.string())], ["doc_id", "n_words", "span_starts", "span_ends", "kept"])


def remove_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, hot: int = HOT, block_words: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc_id, n_words, span_starts, span_ends, kept) of each row of `docs`.

    Words are runs of characters other than the six ASCII spaces, compared as they are. The spans are the maximal
    removed runs of words, [start, end); `kept` are the other words, joined by single spaces. Windows are compared
    on the input, in whole texts, never across rows. Null text counts as empty; a null id counts as larger than
    all others, so its repeats go and it removes nothing. Rows with one id aren't smaller than each other: they
    keep what only they share. Texts of fewer than `length` words stay whole. Empty input gives no rows; other
    columns are not read. Ids must be integers, `length` at least GRAM.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    chunks = stored_chunks(own, spell=_spaced)
    # as many buckets as the text needs, and tasks enough that few chunks meet in one
    steps, last = chunks.agg(F.count(F.lit(1)), F.count_distinct("chunk")).first()
    parts, tasks = max(1, -(-steps * STEP_BYTES // BUCKET_BYTES)), max(1, 2 * last)
    shared = stored(dealt(chunks.mapInArrow(_ask_grams(parts, length), ROW), parts).mapInArrow(_answer_grams(hot), ROW), "shared")
    whole = chunks.unionByName(shared)
    sent = dealt(whole, tasks).mapInArrow(_send_contexts(parts, length), ROW)
    minima = dealt(sent, parts).mapInArrow(_answer_contexts(length, block_words), ROW)
    return dealt(whole.unionByName(minima), tasks).mapInArrow(_remove(length), "doc_id long, n_words long, span_starts array<long>, span_ends array<long>, kept string")
