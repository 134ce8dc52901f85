import numpy as np
import pyarrow as pa
import pytest

from weekcast.llm.common import read_table
from weekcast.llm.cotraining import META_DIMENSIONS, TEXT_DIMENSIONS, classify, keep_good, meta_features, text_features


def test_finds_what_labels_call_bad(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = classify(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.5 * len(bad)
    assert got.count() == docs.count()
    kept = {r.doc_id for r in got.where("kept").collect()}
    stay = keep_good(docs, labels)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == kept


def test_odd_rows(spark, docs_of):
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_view string, quality int"
    docs = spark.createDataFrame([(1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, "a b " * 9000, "de", "s", -5, "x", 1), (3, "a b", "de", "s", 3, "x", 1), (None, "c", None, "t", 1, "x", 0)], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    rows = classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "3", "None"]
    assert all(r.kept and 0 <= r.score <= 1 for r in rows)  # one kind of label only: nothing to learn
    assert keep_good(docs, labels).count() == 5
    assert classify(docs.where("false"), labels).collect() == []


def brute_text(text):
    raw = (text or "").encode()
    out = np.zeros(TEXT_DIMENSIONS)
    for i in range(len(raw) - 2):
        code = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % (1 << 32)
        out[(code >> 20) % TEXT_DIMENSIONS] += 1
    return np.sqrt(out / (64 + out.sum()))


def test_features_equal_brute_force():
    texts = [None, "", "ab", "abc", "Übung macht\nden Meister!! 12 %%", "The the THE the"]
    part = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([3] * 6, pa.int64()), pa.array([5] * 6, pa.int64()), pa.array([None, 0, 2, 3, 30, 15], pa.int64())], ["text", "lang_slot", "source_slot", "n_chars"])
    assert np.allclose(text_features(part), [brute_text(t) for t in texts])
    meta = meta_features(part)
    assert meta.shape == (6, META_DIMENSIONS) and np.isfinite(meta).all()
    upper = sum(c.isascii() and c.isupper() for c in texts[5]) / len(texts[5])
    assert meta[5, 24] == pytest.approx(np.sqrt(upper))
