"""Quality classifier by co-training a text view and a page-metadata view.

Every document becomes two feature vectors, written once: hashed byte trigrams of the text, and metadata
(language, source, length, layout). Each view is a logistic model. After a first fit on labelled rows the
views exchange pseudo-labels over rounds: a view learns from the unlabelled rows that the other is sure of.
Each view is then calibrated on labelled rows that no fit has seen, and the mean of the calibrated logits
scores all documents. A fitting step is one Spark job over all rows that sums gradients and curvatures; only
those sums, of fixed size, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.llm.chunks import summed
from weekcast.llm.common import crc_mod, row_sums, slices, stored, text_buffer, texts

TEXT_DIMENSIONS = 128
LANG_SLOTS, SOURCE_SLOTS = 8, 16
LAYOUT = 12
META_DIMENSIONS = LANG_SLOTS + SOURCE_SLOTS + LAYOUT
#: Trigrams at which a text's own shares weigh half.
SHORT = 64
#: Newton steps of the first fit and of each round, and rounds of exchange.
FIRST_STEPS, ROUND_STEPS, ROUNDS = 6, 2, 3
#: A view is sure from this probability on, and a pseudo-label counts this much of a label.
SURE, PSEUDO_WEIGHT = 0.95, 0.2
#: Ridge penalty of both views.
PENALTY = 1.0
KEEP_AT = 0.35
#: Labelled rows whose id hash modulo 5 is 0 calibrate and are never trained on.
CALIBRATE = 5


def text_features(part: pa.RecordBatch, dimensions: int = TEXT_DIMENSIONS) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams; a short text is drawn towards no evidence."""
    data, offsets = text_buffer(part.column("text"))
    rows = len(offsets) - 1
    out = np.zeros((rows, dimensions))
    if len(data) > 2:
        wide = data.astype(np.uint32)
        code = (wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(2654435761)
        code = (code >> np.uint32(20)) % np.uint32(dimensions)
        row = np.repeat(np.arange(rows), np.diff(offsets))
        inside = row[:-2] == row[2:]
        out = np.bincount(row[:-2][inside] * dimensions + code[inside], minlength=rows * dimensions).reshape(rows, dimensions).astype(float)
    return np.sqrt(out / (SHORT + out.sum(axis=1, keepdims=True)))


#: Kind of each byte: 1 upper case, 2 digit, 3 symbol, 4 sentence mark, 5 line feed, 6 other white space, 7 not ASCII.
KIND = np.zeros(256, np.uint8)
for _kind, _bytes in ((1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b"#$%&*+-/<=>@[\\]^_`{|}~\"'()"), (4, b".,;:!?"), (5, b"\n"), (6, b" \t\r\x0b\x0c")):
    KIND[list(_bytes)] = _kind
KIND[128:] = 7


def meta_features(part: pa.RecordBatch) -> np.ndarray:
    """Language and source in hashed slots, length and layout."""
    data, offsets = text_buffer(part.column("text"))
    rows, size = len(offsets) - 1, np.maximum(1, np.diff(offsets))
    out = np.zeros((rows, META_DIMENSIONS))
    for column, start, slots in (("lang", 0, LANG_SLOTS), ("source", LANG_SLOTS, SOURCE_SLOTS)):
        slot = part.column(column + "_slot").to_numpy(zero_copy_only=False)
        out[np.arange(rows), start + slot % slots] = 1.0
    at = LANG_SLOTS + SOURCE_SLOTS
    kind = KIND[data]
    for k in range(1, 8):
        out[:, at + k - 1] = np.sqrt(row_sums((kind == k).astype(np.int64), offsets) / size)
    split = [raw.split() for raw in texts(part.column("text"))]
    words = np.maximum(1, np.fromiter(map(len, split), np.int64, rows))
    out[:, at + 7] = np.fromiter((len(set(w)) for w in split), np.int64, rows) / np.sqrt(words)  # vocabulary for the length
    out[:, at + 7] = np.log1p(out[:, at + 7])
    out[:, at + 8] = np.fromiter((sum(a == b for a, b in zip(w, w[1:])) for w in split), np.int64, rows) / words
    out[:, at + 9] = np.log1p(words) / 10
    chars = part.column("n_chars").fill_null(0).to_numpy(zero_copy_only=False)
    out[:, at + 10] = np.log1p(np.maximum(0, chars)) / 10
    out[:, at + 11] = size / words / 20
    return out


@dataclass
class Views:
    """Weights of both views (bias last) and of their calibration (slope, shift)."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float] = (1.0, 0.0)
    meta_scale: tuple[float, float] = (1.0, 0.0)

    def logits(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return text @ self.text[:-1] + self.text[-1], meta @ self.meta[:-1] + self.meta[-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-30, 30)))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(b"".join(batch.column("text_view").to_pylist()), np.float16).reshape(-1, TEXT_DIMENSIONS).astype(float)
    meta = np.frombuffer(b"".join(batch.column("meta_view").to_pylist()), np.float16).reshape(-1, META_DIMENSIONS).astype(float)
    return text, meta


def _newton_sums(x: np.ndarray, w: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    p = _sigmoid(x @ w)
    return np.vstack([x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x])


def _over_batches(partial, size: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += partial(batch.slice(at, 4096))
        return total

    return fold


def _step(rows: DataFrame, views: Views, teachers: Views | None) -> Views:
    """One Newton step of both views; `teachers` label the unlabelled rows that they are sure of."""
    sizes = [(len(w) + 1) * len(w) for w in (views.text, views.meta)]

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        text, meta = _arrays(batch)
        quality = batch.column("quality").fill_null(-1).to_numpy(zero_copy_only=False)
        usable = (quality >= 0) & ~batch.column("calibrate").to_numpy(zero_copy_only=False)
        sums = []
        taught = teachers.logits(text, meta)[::-1] if teachers else None  # each view hears the other
        for k, (x, w) in enumerate(((text, views.text), (meta, views.meta))):
            y, weight = np.where(usable, quality, 0).astype(float), usable.astype(float)
            if taught is not None:
                p = _sigmoid(taught[k])
                sure = (quality < 0) & ((p >= SURE) | (p <= 1 - SURE))
                y, weight = np.where(sure, p >= SURE, y), np.where(sure, PSEUDO_WEIGHT, weight)
            sums.append(_newton_sums(x, w, y, weight).ravel())
        return np.concatenate(sums)

    total = summed(rows, _over_batches(partial, sum(sizes)), sum(sizes))
    out = []
    for w, block in zip((views.text, views.meta), (total[: sizes[0]], total[sizes[0] :])):
        block = block.reshape(len(w) + 1, len(w))
        ridge = PENALTY * np.r_[np.ones(len(w) - 1), 1e-6]
        step = np.linalg.solve(block[1:] + np.diag(ridge) + 1e-9 * np.eye(len(w)), block[0] + ridge * w)
        out.append(w - step * min(1.0, 10.0 / max(1e-12, np.abs(step).max())))
    return Views(*out)


def _calibrated(rows: DataFrame, views: Views, steps: int = 8) -> Views:
    """Platt scaling of each view on the calibration rows, held softly at the identity."""
    scales = [np.array([1.0, 0.0]), np.array([1.0, 0.0])]
    held = rows.where("calibrate and quality is not null")
    for _ in range(steps):

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            quality = batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
            logits = views.logits(*_arrays(batch))
            return np.concatenate([_newton_sums(z[:, None], s, quality, np.ones(len(z))).ravel() for z, s in zip(logits, scales)])

        total = summed(held, _over_batches(partial, 12), 12)
        moved = 0.0
        for k in range(2):
            block = total[6 * k : 6 * k + 6].reshape(3, 2)
            step = np.linalg.solve(block[1:] + np.eye(2), block[0] + scales[k] - [1.0, 0.0])
            scales[k] = scales[k] - step.clip(-2, 2)
            moved = max(moved, np.abs(step).max())
        if moved < 1e-3:
            break
    return Views(views.text, views.meta, tuple(scales[0]), tuple(scales[1]))


SLOT_RANGE = 1 << 20


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("\0"))), F.lit(SLOT_RANGE)).alias(f"{column}_slot")


def _inputs(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), "text", _slot("lang"), _slot("source"), F.col("n_chars").cast("long").alias("n_chars"))


def _vectors(docs: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """Both views of every document with its label, written once."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            blobs = [[row.tobytes() for row in view.astype(np.float16)] for view in (text_features(part), meta_features(part))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(b, pa.binary()) for b in blobs)], ["doc_id", "text_view", "meta_view"])

    kind = docs.schema[id_column].dataType.simpleString()
    known = labels.select(F.col(id_column).alias("doc_id"), "quality").dropna().groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    vectors = _inputs(docs, id_column).mapInArrow(features, f"doc_id {kind}, text_view binary, meta_view binary")
    # the label table grows with the documents: a shuffle join at every size
    return stored(vectors.join(known.hint("merge"), "doc_id", "left").withColumn("calibrate", crc_mod("doc_id", CALIBRATE) == 0), "vectors")


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Views:
    """Both views, co-trained and calibrated on the vectors of all documents."""
    seen = {r.quality: r["count"] for r in rows.where("not calibrate").groupBy("quality").count().collect()}
    views = Views(np.r_[np.zeros(TEXT_DIMENSIONS), 1.0], np.r_[np.zeros(META_DIMENSIONS), 1.0])
    if not seen.get(0) or not seen.get(1):
        return views
    for _ in range(FIRST_STEPS):
        views = _step(rows, views, None)
    for _ in range(rounds):
        teachers = views
        for _ in range(ROUND_STEPS):
            views = _step(rows, views, teachers)
    return _calibrated(rows, views)


def _scores(views: Views, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    logits = [s[0] * z + s[1] for z, s in zip(views.logits(text, meta), (views.text_scale, views.meta_scale))]
    return _sigmoid((logits[0] + logits[1]) / 2), _sigmoid(logits[0]), _sigmoid(logits[1])


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, score, text_score, meta_score, kept) of every row of `docs`; kept from a score of KEEP_AT on.

    Reads the columns text, lang, source and n_chars of `docs` and (id, quality) of `labels`; a document
    labelled twice counts as good if either says so; null labels and ids are left out. Null text counts as
    empty, null metadata takes a slot of its own. Without labelled rows of both kinds nothing can be learnt:
    every document scores alike and is kept. Rows that repeat an id are scored each for itself. Empty input
    gives no rows. Other columns are not read.
    """
    rows = _vectors(docs, labels, id_column)
    views = fit(rows, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, text, meta = _scores(views, *_arrays(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (both, text, meta, both >= KEEP_AT))], ["doc_id", "score", "text_score", "meta_score", "kept"])

    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double, text_score double, meta_score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, n_chars) that `classify` keeps, with all their columns.

    The fitted views score each row again where it stands, so no text is shuffled to meet its score."""
    views = fit(_vectors(docs, labels, "doc_id"), rounds)
    slots = ["lang_slot", "source_slot"]
    whole = docs.select(*docs.columns, *map(_slot, ("lang", "source")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            # rounded as the written vectors are
            both, _, _ = _scores(views, *(v.astype(np.float16).astype(float) for v in (text_features(part), meta_features(part))))
            yield part.filter(pa.array(both >= KEEP_AT)).drop_columns(slots)

    return whole.mapInArrow(keep, docs.schema)
