import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weekcast.llm.common import crc_mod, read_table
from weekcast.llm.toxicity import PATTERNS, SYMBOLS, Lexicon, Transducer, begins, cover, fit, fit_weights, grammar, negation, pattern_sums, reported, target, toxicity


def batch(*texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])


def patterns(text):
    row = pattern_sums(batch(text), Lexicon({"moron": 1.0, "vequ*": 1.0}), grammar())[0]
    return {p: v for p, v in zip(PATTERNS, row) if v}


def test_clause_patterns():
    assert patterns("what a moron.") == {"I": 1}
    assert patterns("You MORON!") == {"J": 1}
    assert patterns("moron, you are") == {"I": 1, "A": 1}
    assert patterns("he is not a moron") == {"i": 1}
    assert patterns("not here today and then again a moron") == {"I": 1}
    assert patterns("she said he is a moron") == {"q": 1}
    assert patterns("she said so. moron") == {"I": 1}
    assert patterns("I will kill you") == {"H": 1}
    assert patterns("you I will kill") == {"G": 1}
    assert patterns("vequela veque") == {"I": 2}
    assert patterns("nothing. to\nsee") == {} and patterns("") == {} and patterns(None) == {}


def test_composition_equals_running_one_after_the_other():
    rng = np.random.default_rng(0)
    parts, whole = (negation(), reported(), target()), grammar()
    for _ in range(300):
        word = "".join(rng.choice(list(SYMBOLS), 12))
        states, at, out, expect = [0, 0, 0], 0, "", ""
        for c in word:
            at, one = whole.step(at, c)
            out += one
            for k, part in enumerate(parts):
                states[k], c = part.step(states[k], c)
            expect += c
        assert out == expect


def test_transducer_passes_through():
    assert Transducer({}).step(0, "I") == (0, "I")


def test_cover_is_not_fooled_by_copies():
    copies = [{"moron", "zusammen", "haus"}] * 50
    others = [{"moron", f"w{i}"} for i in range(20)] + [{"idiot", f"v{i}"} for i in range(10)]
    found = copies + others
    weight = {x: 1.0 for f in found for x in f}
    assert cover(found, weight, 3) == ["moron", "idiot"]


def test_fit_leans_on_the_prior_without_rows():
    w = fit_weights(np.zeros((0, len(PATTERNS))), np.zeros(0))
    assert w[PATTERNS.index("J")] == pytest.approx(3.0)


def test_held_out_accuracy(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    held = crc_mod("doc_id", 4) == 2
    rows = toxicity(docs, labels, is_training=~held).join(labels, "doc_id").where(held).collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.5 * sum(r.toxic for r in rows) and hit >= 0.8 * sum(r.predicted for r in rows)


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "you I will kill"), (3, "you I will kill"), (None, "fine words"), (4, "you I will kill " * 20000)])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = {(r.doc_id, i): r for i, r in enumerate(toxicity(docs, labels).collect())}
    assert len(rows) == 6
    by = {}
    for (i, _), r in rows.items():
        by.setdefault(i, set()).add((round(r.score, 9), r.predicted))
    assert len(by[3]) == 1 and all(p == 1 for _, p in by[3] | by[4]) and all(0 <= s <= 1 for v in by.values() for s, _ in v)
    assert toxicity(docs_of([]), labels).collect() == []
    none = toxicity(docs, labels.where(F.lit(False))).collect()
    assert {r.predicted for r in none if r.doc_id == 3} == {1}


def test_beginnings():
    assert begins("abcdefg") == ["abcdefg", "abcd*", "abcde*", "abcdef*"] and begins("abc") == ["abc"]


def test_stems_with_many_endings_are_learnt_where_they_come_again(spark, docs_of):
    letters = "abcdefghijklmnopqrstuvwxyz"
    ending = (a + b + c for a in letters for b in letters for c in letters)  # each met once
    filler = lambda i: " ".join(f"{letters[i % 26]}{letters[k]}{letters[i // 26]}ne" for k in range(9))
    toxic = [filler(i) + "".join(f" vorgal{next(ending)}" for _ in range(4)) for i in range(60)]
    clean = [filler(i) + f" vorgal{next(ending)}" for i in range(60, 180)]
    docs = docs_of(toxic + clean)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(180)], "doc_id long, toxic int")
    rows = toxicity(docs, labels, is_training=F.col("doc_id") % 4 != 2).collect()
    assert all(r.predicted == (r.doc_id < 60) for r in rows if r.doc_id % 4 == 2)


def test_marked_lexemes_count_from_their_number_of_matches_on():
    lexicon = Lexicon({"vequ*+": 1.0, "zorn++": 2.0})
    sums = pattern_sums(batch("vequela", "vequela veque", "vequela.", "zorn zorn", "zorn zorn. zorn"), lexicon, grammar())
    assert sums[:, PATTERNS.index("I")].tolist() == [0, 2, 0, 0, 3] and sums.sum() == 5


def test_an_id_enters_the_fit_once(spark, docs_of):
    texts = [(i, f"moron number {i}") for i in range(20)] + [(i, f"nothing to see {i}") for i in range(20, 60)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    once, often = fit(docs_of(texts), labels), fit(docs_of(texts + [texts[3], texts[30]] * 500), labels)
    assert often.weights == pytest.approx(once.weights, abs=1e-9) and often.lexicon.insults == once.lexicon.insults
