"""Language-model scores of whole texts, from corpus counts and a self-attention model over subword ids.

Chunks ask for each of their distinct words once; the task of a word bucket sums the training counts of a
word over all chunks, cuts the word into subword ids, and answers. Counts of all subword ids, and of all pairs
of neighbours within words, come out of the same pass; a chunk gets the shares of the pairs it has. The attention model learns from the whole of every training document, in rounds: each
partition trains a copy on its own windows and the copies are averaged. Scoring runs over overlapping windows
of whole texts and scores every id once.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.attention_lm import CLASSES, PAIR_PRIOR, WINDOW, Parameters, Scorer, Trainer, Vocabulary, vocabulary
from weekcast.llm.chunks import ROW, by_key, dealt, pack, parts_of, row_of, rows_of, stored_chunks, summed, text_of, unpack
from weekcast.llm.common import stored
from weekcast.llm.tokens import LETTER_OF, load_tokenizer, spread, word_ids

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_TOKEN = "<|endoftext|>"
#: Held-out documents: crc32 of the id as text, modulo MODULUS, is REMAINDER.
MODULUS, REMAINDER = 7, 2
ROUNDS = 2
#: Distinct words in each of the two generations whose ids a task keeps while it cuts training documents.
KEPT_WORDS = 100_000
#: Windows that are cut, shuffled and learnt from at a time.
WINDOWS = 1 << 14
#: Numbers that describe the company an id keeps, for its class.
SKETCH = 12
SLOTS = 4
#: Wanted pairs that a task holds to send each only once to a chunk.
HELD_PAIRS = 1 << 22


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    return load_tokenizer(path)


def subwords(path: str, word: bytes) -> list[int]:
    """Ids of one lower-cased word behind a space; any byte has an id, so every word has some."""
    return word_ids(_tokenizer(path).model, " " + word.decode())


def trains(ids: list, modulus: int, remainder: int) -> np.ndarray:
    """Which rows may be learnt from; a null id counts as empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % modulus != remainder for i in ids), bool, len(ids))


class _Words:
    """The distinct words of a chunk and their numbers; number 0, the empty word, stands for the end."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count(1).__next__, {b"": 0})  # a new word takes the next number

    def read(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all rows, each closed by an end; row bounds)."""
        data, offsets = text_of(row)
        raw = data.tobytes().lower()  # bytes: A-Z only
        own, parts, bounds = self.number.__getitem__, [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            words = raw[a:b].split()
            words.append(b"")
            parts.append(np.fromiter(map(own, words), np.int64, len(words)))
            bounds.append(bounds[-1] + len(words))
        return np.concatenate(parts), np.array(bounds)


def _ask(buckets: int, modulus: int, remainder: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(chunk: int, words: _Words, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            raws = list(words.number)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raws), np.int64, len(raws))
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True])
            for a, b in zip(edges[:-1], edges[1:]):
                mine = order[a:b]
                yield row_of(int(bucket[mine[0]]), chunk, None, pack(mine.astype(np.uint32)), zstandard.compress(b"\n".join(raws[i] for i in mine), 1), pack(counts[mine]))

        now, words, counts = None, _Words(), np.zeros(1, np.int64)
        for row in rows_of(batches):
            if row["chunk"] != now:
                if now is not None:
                    yield from flush(now, words, counts)
                now, words, counts = row["chunk"], _Words(), np.zeros(1, np.int64)
            number, bounds = words.read(row)
            learnt = np.repeat(trains(row["ids"], modulus, remainder), np.diff(bounds))
            more = np.bincount(number[learnt], minlength=len(words.number))
            more[: len(counts)] += counts
            counts = more
        if now is not None:
            yield from flush(now, words, counts)

    return run


def _inside(flat: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ids have a next one in their word, and the pairs, last * size + id, of both."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.flatnonzero(word[:-1] == word[1:])
    return inside, flat[inside].astype(np.int64) * size + flat[inside + 1]


def _answer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each chunk (number, count, id lengths, ids); and a row of chunk -1 with what the bucket holds."""
        size = _tokenizer(path).get_vocab_size(with_added_tokens=True)
        for bucket, rows in by_key(rows_of(batches), "chunk"):
            table: dict[bytes, int] = {}
            asked = [np.array([table.setdefault(w, len(table)) for w in zstandard.decompress(r["b"]).split(b"\n")]) for r in rows]
            counts = np.zeros(len(table), np.int64)
            for own, r in zip(asked, rows):
                counts[own] += unpack(r["c"], np.int64)  # a chunk asks for a word once
            ids = [subwords(path, w) if w else [] for w in table]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.array([i for one in ids for i in one], np.uint32)
            start = np.cumsum(lengths) - lengths
            for own, r in zip(asked, rows):
                yield row_of(r["step"], -1, None, r["a"], pack(counts[own]), pack(lengths[own].astype(np.uint32)), pack(flat[spread(start[own], lengths[own])]))
            total = np.bincount(flat, weights=np.repeat(counts, lengths), minlength=size).astype(np.int64)
            if b"" in table:
                total[_tokenizer(path).token_to_id(END_TOKEN)] = counts[table[b""]]
            hit = np.flatnonzero(total)
            inside, pairs = _inside(flat, lengths, size)
            pair, where = np.unique(pairs, return_inverse=True)  # those that were never learnt have a share, too
            often = np.bincount(where, weights=np.repeat(counts, lengths)[inside], minlength=len(pair)).astype(np.int64)
            yield row_of(-1, bucket, [int((counts > 0).sum()), int(counts.sum())], pack(hit), pack(total[hit]), pack(pair), pack(often))

    return run


class _Ids:
    """Ids of the words met, in two generations of at most KEPT_WORDS between two rows: a full young one becomes the
    old one, so that words that go on occurring are kept."""

    def __init__(self, path: str):
        self.path = path
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def turn(self) -> None:
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}

    def of(self, word: bytes) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = array("I", subwords(self.path, word)).tobytes()
            self.young[word] = ids
        return ids


def _streams(path: str, modulus: int, remainder: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids (a) of all training documents, each between two ends, and how many each has (b)."""
        end = _tokenizer(path).token_to_id(END_TOKEN)
        cache = _Ids(path)
        for row in rows_of(batches):
            learn = trains(row["ids"], modulus, remainder)
            if not learn.any():
                continue
            cache.turn()
            words = _Words()
            number, bounds = words.read(row)
            length = np.diff(bounds)
            number, bounds = number[np.repeat(learn, length)], np.concatenate([[0], np.cumsum(length[learn])])
            used = np.bincount(number, minlength=len(words.number)) > 0
            used[0] = False  # the end
            found = [cache.of(w) if u else b"" for w, u in zip(words.number, used.tolist())]
            found[0] = np.array([end], np.uint32).tobytes()
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat = np.frombuffer(b"".join(found), np.uint32)
            ids = flat[spread((np.cumsum(size) - size)[number], size[number])]
            upto = np.concatenate([[0], np.cumsum(size[number])])[bounds]
            yield row_of(row["chunk"], row["step"], None, pack(np.insert(ids, upto[:-1], end)), pack(np.diff(upto) + 1))

    return run


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """All windows of the documents of a row: WINDOW + 1 ids each, the last also the first of the next window,
    -1 behind a document's last."""
    for row in rows_of(batches):
        ids, length = unpack(row["a"], np.uint32).astype(np.int32), unpack(row["b"], np.int64)
        many = -(-(length - 1) // WINDOW)
        stop = np.repeat(np.cumsum(length), many)
        first = spread(np.zeros(len(many), np.int64), many) * WINDOW + np.repeat(np.cumsum(length) - length, many)
        for at in range(0, len(first), WINDOWS):
            place = first[at : at + WINDOWS, None] + np.arange(WINDOW + 1)
            yield np.where(place < stop[at : at + WINDOWS, None], ids[np.minimum(place, len(ids) - 1)], -1)


def _sketch(size: int):
    signs = np.random.default_rng(11).choice([-1.0, 1.0], (size + 1, SKETCH)).astype(np.float32)
    signs[size] = 0  # the place of -1
    columns = np.ascontiguousarray(signs.T)

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((size, SKETCH))
        for windows in _windows_of(batches):
            place = np.where(windows < 0, size, windows)
            for k, own in enumerate(columns):
                mine = own[place]
                around = mine.sum(axis=1, keepdims=True) - mine
                total[:, k] += np.bincount(place.ravel(), weights=around.ravel(), minlength=size + 1)[:size]
        return total.ravel()

    return fold


def _counted(held: DataFrame) -> DataFrame:
    """All pairs of neighbouring ids within words, and their counts."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(row["c"], np.int64)), pa.array(unpack(row["d"], np.int64))], ["pair", "n"])

    return held.mapInArrow(spell, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _shares(counted: DataFrame, words: Vocabulary) -> DataFrame:
    """(pair, share): p(id | its class, last id) of every pair, from its count and all counts of the last id with
    the class, smoothed by PAIR_PRIOR times the class's own shares."""
    size, class_of, within = len(words.class_of), words.class_of, words.within

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            pair = part.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pair // size * CLASSES + class_of[pair % size]), pa.array(PAIR_PRIOR * within[pair % size])], ["pair", "n", "slot", "prior"])

    # a slot has at most as many rows as its class has ids
    placed = counted.mapInArrow(place, "pair long, n long, slot long, prior double")
    return placed.select("pair", ((F.col("n") + F.col("prior")) / (F.sum("n").over(Window.partitionBy("slot")) + PAIR_PRIOR)).alias("share"))


def _wanted(answers: DataFrame, size: int) -> DataFrame:
    """(part, pair): the pairs that the words of a chunk have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, found in held.items():
                pair = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), chunk)), pa.array(pair)], ["part", "pair"])
            held.clear()

        held, many = defaultdict(list), 0
        for row in rows_of(batches):
            pair = np.unique(_inside(unpack(row["d"], np.uint32), unpack(row["c"], np.uint32), size)[1])
            held[row["chunk"]].append(pair)
            many += len(pair)
            if many > HELD_PAIRS:
                yield from flush()
                many = 0
        yield from flush()

    return answers.mapInArrow(run, "part long, pair long").distinct()


def _told(wanted: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows of step -2 that tell each chunk its pairs (a) and their shares (b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            chunk, pair, share = (part.column(c).to_numpy() for c in ("part", "pair", "share"))
            edges = np.flatnonzero(np.r_[True, np.diff(chunk) != 0, True]) if len(chunk) else []
            for a, b in zip(edges[:-1], edges[1:]):
                yield row_of(int(chunk[a]), -2, None, pack(pair[a:b]), pack(share[a:b]))

    return wanted.join(shares, "pair").select("part", "pair", "share").sortWithinPartitions("part").mapInArrow(run, ROW)


class _Pairs:
    """p(id | its class, last id) for the pairs that a chunk has been told."""

    def __init__(self, told: list[dict], words: Vocabulary, end: int):
        self.end, self.own = end, words.within
        pair, share = (np.concatenate([np.empty(0, kind), *(unpack(r[c], kind) for r in told)]) for c, kind in (("a", np.int64), ("b", np.float64)))
        order = np.argsort(pair)
        self.pair, self.share = pair[order], share[order]

    def within(self, last: np.ndarray, goals: np.ndarray) -> np.ndarray:
        out = self.own[goals]  # nothing is counted behind the end: a word's first id has its class's own share
        some = np.flatnonzero(last != self.end)
        key = last[some].astype(np.int64) * len(self.own) + goals[some]
        at = np.searchsorted(self.pair, key)
        if len(key) and (at.max() == len(self.pair) or (self.pair[at] != key).any()):
            raise RuntimeError("a chunk was not told all of its pairs")
        out[some] = self.share[at]
        return out


def _word_logs(pairs: Scorer | _Pairs, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each word the sum of log p(id | its class, the id before it in the word): the same wherever the
    word stands, as pairs are only counted within words."""
    flat = ids[spread(start, length)]
    first = np.cumsum(length) - length
    last = np.roll(flat, 1)
    last[first[length > 0]] = pairs.end  # nothing is counted behind the end
    return np.add.reduceat(np.append(np.log(pairs.within(last, flat)), 0.0), np.minimum(first, len(flat))) * (length > 0)


def _fit(windows: DataFrame, counts: np.ndarray, starts_word: np.ndarray, end: int) -> tuple[Parameters, Vocabulary]:
    size = len(counts)
    sketch = summed(windows, _sketch(size), size * SKETCH, SLOTS).reshape(size, SKETCH)
    share = counts / max(1, counts.sum())
    sketch = sketch - np.abs(sketch).sum(axis=1, keepdims=True) * (share @ sketch) / max(1e-9, np.abs(share @ sketch).sum())  # what all ids have in common tells no class
    words = vocabulary(counts, sketch, starts_word, end, np.empty(0, np.int64), np.empty(0, np.int64))  # pairs stay in tables
    p = Parameters.initial(words.class_log)
    length = len(p.flat()) + 1
    for _ in range(ROUNDS):

        def fold(batches: Iterator[pa.RecordBatch], p=p) -> np.ndarray:
            trainer, seen = Trainer(p, words), 0
            for own in _windows_of(batches):
                trainer.learn(own[np.random.default_rng(len(own)).permutation(len(own))])
                seen += len(own)
            return seen * np.append(trainer.parameters().flat(), 1.0)

        total = summed(windows, fold, length, SLOTS)
        if total[-1]:
            p = Parameters.shaped(total[:-1] / total[-1])
    return p, words


def lm_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", modulus: int = MODULUS, remainder: int = REMAINDER, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    Documents whose id's crc32 modulo `modulus` is `remainder` are never learnt from. Tokens are words, A-Z
    lowered, and one end. Null text counts as empty: one token, the end. `score` is the model's log10
    probability of the subword ids of all words and the end. Rows that repeat an id count and are scored each
    for itself; a null id is treated as the empty text. With nothing to learn from, all ids share their mass
    evenly by class. Empty input gives no rows; other columns are not read.
    """
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    chunks = stored_chunks(own)
    asked = dealt(chunks.mapInArrow(_ask(parts_of(docs), modulus, remainder), ROW))
    answers = stored(asked.mapInArrow(_answer(tokenizer), ROW), "answers")
    held = answers.where(F.col("chunk") == -1)
    distinct, total = held.agg(F.sum(F.col("ids")[0]), F.sum(F.col("ids")[1])).first()
    distinct, total = distinct or 0, total or 0

    library = _tokenizer(tokenizer)
    size, end = library.get_vocab_size(with_added_tokens=True), library.token_to_id(END_TOKEN)

    def id_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size)
        for row in rows_of(batches):
            out[unpack(row["a"], np.int64)] += unpack(row["b"], np.int64)
        return out

    counts = summed(held, id_counts, size, SLOTS)
    space = LETTER_OF[0x20]
    starts_word = np.array([(library.id_to_token(i) or "").startswith(space) for i in range(size)])
    windows = stored(chunks.mapInArrow(_streams(tokenizer, modulus, remainder), ROW), "streams")
    p, words = _fit(windows, counts, starts_word, end)
    told = _told(_wanted(answers.where(F.col("chunk") >= 0), size), _shares(_counted(held), words))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(p, words, end)
        for _, rows in by_key(rows_of(batches), "chunk"):
            answer = [(unpack(r["a"], np.uint32), unpack(r["b"], np.int64), unpack(r["c"], np.uint32).astype(np.int64), unpack(r["d"], np.uint32).astype(np.int64)) for r in rows if r["step"] == -1]
            number, count, lengths, flat = (np.concatenate(x) for x in zip(*answer))
            known, start, length = np.empty(len(number), np.int64), np.empty(len(number), np.int64), np.empty(len(number), np.int64)
            known[number], start[number], length[number] = count, np.cumsum(lengths) - lengths, lengths
            log_count, table = np.log10(known + 1.0), _Words()
            word_log = _word_logs(_Pairs([r for r in rows if r["step"] == -2], words, end), flat, start, length)
            end_log = float(np.log(words.within[end]))
            for row in rows:
                if row["step"] < 0:
                    continue
                word, bounds = table.read(row)
                ids = flat[spread(start[word], length[word])]
                upto = np.concatenate([[0], np.cumsum(length[word])])[bounds]
                # inputs: an end, then the row's ids; goals: the ids, then an end
                place = np.arange(len(bounds) - 1) + upto[:-1]
                x, goals = np.insert(ids, upto[:-1], end), np.insert(ids, upto[1:], end)
                begin = np.repeat(place, np.diff(upto) + 1)
                logs = np.add.reduceat(scorer.class_scores(x, goals, begin), place) + np.add.reduceat(word_log[word], bounds[:-1]) + end_log
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()),
                    pa.array(np.diff(bounds)),
                    pa.array(np.add.reduceat((known[word] > 0).astype(np.int64), bounds[:-1])),
                    pa.array(np.add.reduceat(log_count[word], bounds[:-1])),
                    pa.array(logs / np.log(10)),
                ], ["doc_id", "n_tokens", "n_known", "log_counts", "score"])

    whole = dealt(chunks.unionByName(answers.where(F.col("chunk") >= 0)).unionByName(told))
    rows = whole.mapInArrow(score, "doc_id long, n_tokens long, n_known long, log_counts double, score double")
    mass = F.log10(F.lit(float(total + distinct + 1)))
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n_tokens") * mass).alias("base_score"), "score")
