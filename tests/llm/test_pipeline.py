"""The pipeline against a brute-force run of every stage on what the stage before kept."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from llm.test_simhash import brute_components, brute_fingerprint
from llm.test_suffix_dedup import brute as brute_repeats
from weekcast.llm.common import read_table, stored
from weekcast.llm.cotraining import classify
from weekcast.llm.packing import TOKENIZER
from weekcast.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"


def test_every_stage_works_on_what_is_left(spark):
    docs = read_table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    labels = read_table(spark, SF, "labels")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), name))
    rows = [{r.doc_id: r for r in d.collect()} for d in kept[:5]]
    for d in kept[1:5]:
        assert d.columns == docs.columns

    rules = quality_rules(docs, labels.where("quality = 1")).where("kept").collect()
    assert set(rows[1]) == {r.doc_id for r in rules}
    assert set(rows[2]) == {r.doc_id for r in classify(kept[1], labels).where("kept").collect()}
    for before, after in zip(rows[:3], rows[1:4]):
        assert all(after[i] == before[i] for i in after)

    ids = sorted(rows[2])
    roots = brute_components([brute_fingerprint(rows[2][i].text) for i in ids])
    assert set(rows[3]) == {ids[k] for k in set(roots)}

    order = sorted(rows[3])
    for i, (_, starts, ends, _) in zip(order, brute_repeats([(i, rows[3][i].text) for i in order])):
        raw = (rows[3][i].text or "").encode()
        gone = np.zeros(len(raw), bool)
        for a, b in zip(starts, ends):
            gone[a:b] = True
        text, at = "", 0
        for c in rows[3][i].text or "":
            size = len(c.encode())
            text += "" if gone[at : at + size].any() else c
            at += size
        assert rows[4][i].text == text and rows[4][i].n_chars == len(text)
    assert set(rows[4]) == set(rows[3])

    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = kept[5].collect()
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert total == {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows[4].items()}
    assert sum(r.length for r in pieces) == sum(total.values())

    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, pieces))


def test_rows_without_an_id_and_repeated_rows(spark):
    good = "This is a perfectly plain sentence with quite enough different words for any rule here."
    rows = [(1, good), (1, good), (None, good), (2, good + " More words follow after that one, again quite plain ones, to make another text."), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "2", "3", "None"]
