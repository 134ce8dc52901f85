"""Quality rules: plain repetition and length rules, then a hashed n-gram likelihood ratio.

Two multinomials over hashed byte n-grams are counted in Spark: one over the raw corpus (all documents)
and one over the trusted target (the documents of `trusted`). A document's score is the mean over its
n-grams of log(p_target / p_raw), so length does not matter; every document is held against one fixed
threshold. The counts are two vectors of `buckets` numbers however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import SPACES, row_sums, slices, text_buffer, texts

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"
#: Bytes in an n-gram, and numbers in a count vector.
GRAM = 4
BUCKETS = 1 << 16
#: A document with a lower mean log ratio (natural logarithm, per n-gram) is rejected.
THRESHOLD = -0.22
#: Share of the raw corpus in the smoothed target: an n-gram that the target never shows costs log(0.2) at most.
RAW_SHARE = 0.2

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each byte, and whether it ends in the same document."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, bool)
    code = np.zeros(n, np.uint32)
    for i in range(GRAM):
        code |= data[i : i + n].astype(np.uint32) << np.uint32(8 * i)
    code *= np.uint32(2654435761)  # Knuth's multiplicative hash; the high bits are well mixed
    code >>= np.uint32(15)
    inside = np.ones(n, bool)
    for end in offsets[1:-1]:
        inside[max(0, end - GRAM + 1) : end] = False
    return (code % np.uint32(buckets)).astype(np.int64), inside


def repeat_words(words: list[bytes], doc: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a `width`-word window that its own document holds twice or more.

    Windows are compared exactly: codes of pairs, then of fours, then with the last word and the document."""
    n = len(words)
    out = np.zeros(n, bool)
    if n < width:
        return out
    one, names = pd.factorize(np.array(words, dtype=object))
    code, count, have = one.astype(np.int64), len(names), 1
    while have < width:
        add = min(have, width - have)
        other = code if add == have else one.astype(np.int64)
        if add != have:
            add = 1
        size = n - have - add + 1
        code, names = pd.factorize(code[:size] * np.int64(count if add == have else len(one) + 1) + other[have : have + size])
        code, count, have = code.astype(np.int64), len(names), have + add
    starts = n - width + 1
    whole = doc[:starts] == doc[width - 1 :]
    key = np.where(whole, code * np.int64(int(doc[-1]) + 1) + doc[:starts], -1 - np.arange(starts))
    again = pd.Series(key).duplicated(keep=False).to_numpy() & whole
    for i in range(width):
        out[i : i + starts] |= again
    return out


def base_columns(batch: pa.RecordBatch, column: str = "text", window: int = 5) -> dict[str, np.ndarray]:
    """The rule columns of each row of a batch."""
    raws = texts(batch.column(column))
    split = [r.split() for r in raws]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    flat = [w for ws in split for w in ws]
    repeated = row_sums(repeat_words(flat, np.repeat(np.arange(len(raws)), counts), window).astype(np.int64), bounds)
    symbols = np.fromiter((len(r) - len(r.translate(None, SYMBOLS)) for r in raws), np.int64, len(raws))
    chars = np.fromiter((len(r.decode()) - len(r) + len(r.translate(None, SPACES)) for r in raws), np.int64, len(raws))
    return {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": np.fromiter(map(dup_lines, raws), np.int64, len(raws)),
        "n_repeat_words": repeated,
        "base_failed": (counts < 10) | (100 * repeated > 20 * counts),
    }


def dup_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def gram_counts(docs: DataFrame, column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each hashed n-gram occurs in all rows of `docs`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, column):
            code, inside = grams(*text_buffer(part.column(column)), buckets)
            total += np.bincount(code[inside], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    return docs.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratio(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) per bucket, the target smoothed by the raw corpus; the driver gets at most 2 * `buckets` rows."""
    counted = raw.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1))).collect()
    n = np.ones((2, buckets))  # add one: no bucket is without mass
    for row in counted:
        n[row.side, row.bucket] += row.n
    p = n / n.sum(axis=1, keepdims=True)
    # with no trusted text at all there is nothing to compare with: every ratio is 0
    return np.log((1 - RAW_SHARE) * p[1] / p[0] + RAW_SHARE) if any(row.side for row in counted) else np.zeros(buckets)


def mean_ratio(part: pa.RecordBatch, column: str, weights: np.ndarray) -> np.ndarray:
    """Mean log ratio of each row's n-grams; 0 for a text shorter than one n-gram."""
    data, offsets = text_buffer(part.column(column))
    code, inside = grams(data, offsets, len(weights))
    value = np.zeros(len(data))
    value[: len(code)] = np.where(inside, weights[code], 0.0)
    sums = np.array([value[a:b].sum() for a, b in zip(offsets[:-1], offsets[1:])])  # per row: the same at any batch size
    return sums / np.maximum(1, np.diff(offsets) - GRAM + 1)


def fitted_weights(docs: DataFrame, trusted: DataFrame, buckets: int) -> np.ndarray:
    """The log ratios of all documents (doc_id, text) against those whose ids `trusted` holds."""
    raw = gram_counts(docs, buckets=buckets)
    # the label table grows with the documents: a shuffle join at every size, never a broadcast of its ids
    target = gram_counts(docs.join(trusted.distinct().hint("merge"), "doc_id", "left_semi"), buckets=buckets)
    return log_ratio(raw, target, buckets)


def verdicts(part: pa.RecordBatch, weights: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Rule columns, verdict and ratio of each row of a batch."""
    columns = base_columns(part)
    llr = mean_ratio(part, "text", weights)
    return {**columns, "kept": ~columns["base_failed"] & (llr >= threshold), "llr": llr}


def quality_rules(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Rule columns, mean log ratio and verdict of every row of `docs`.

    `trusted` holds the ids (column `id_column`) of the trusted target; ids it repeats count once, ids unknown
    to `docs` and null ids count nothing. Null text counts as empty: no words, ratio 0, base_failed. Repeated
    rows are scored each for itself. Empty `docs` give an empty result. Other columns of `docs` are not read,
    so their names cannot clash. kept = not base_failed and llr >= threshold.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    weights = fitted_weights(own, trusted.select(F.col(id_column).alias("doc_id")), buckets)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            columns = verdicts(part, weights, threshold)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns.values())], ["doc_id", *columns])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(score, f"doc_id {kind}, {BASE_SCHEMA}, kept boolean, llr double")


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of `docs` (with doc_id and text) that `quality_rules` keeps, with all their columns."""
    weights = fitted_weights(docs.select("doc_id", "text"), trusted.select("doc_id"), buckets)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield part.filter(pa.array(verdicts(part, weights, threshold)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
