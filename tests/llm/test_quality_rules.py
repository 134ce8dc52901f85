import re

import numpy as np

from weekcast.llm.quality_rules import BUCKETS, GRAM, RAW_SHARE, THRESHOLD, gram_counts, grams, log_ratio, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def brute_ratio(texts, target):
    def count(some):
        n = np.ones(BUCKETS)
        for t in some:
            data = np.frombuffer((t or "").encode(), np.uint8)
            code, inside = grams(data, np.array([0, len(data)]), BUCKETS)
            for c in code[inside]:
                n[c] += 1
        return n / n.sum()

    weights = np.log((1 - RAW_SHARE) * count(target) / count(texts) + RAW_SHARE)
    out = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        code, _ = grams(data, np.array([0, len(data)]), BUCKETS)
        out.append(weights[code].sum() / max(1, len(data) - GRAM + 1))
    return out


EDGE = [None, "", " \t\n", "a b c d e " * 4, "ein Wort\x0bzwei\x0cdrei\rvier", "x y  z é\x1fè " * 3, "l 1\nl 1\n\n\nl 1\n \n ", "#$%&|<>* " * 20,
        "one two three four five six seven eight nine ten", "a a a a a a", "z" * 30000 + " " + "word " * 3000]


def test_matches_brute_force(spark, docs_of, documents):
    texts = EDGE + [r.text for r in documents.limit(80).collect()]
    trusted = spark.createDataFrame([(i,) for i in range(8, 60)] + [(9,), (10**9,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in quality_rules(docs_of(texts).repartition(3), trusted).collect()}
    assert len(got) == len(texts)
    ratio = brute_ratio(texts, texts[8:60])
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t), i
        assert abs(r.llr - ratio[i]) < 1e-9
        assert r.kept == (not r.base_failed and r.llr >= THRESHOLD)


def test_repeated_rows_and_no_trusted_text(spark, docs_of):
    text = "ten words are here so that the rule lets it pass now"
    none = spark.createDataFrame([], "doc_id long")
    rows = quality_rules(docs_of([(1, text), (1, text), (None, text)]), none).collect()
    assert [r.kept for r in rows] == [True] * 3 and {r.llr for r in rows} == {0.0}


def test_empty_table(spark, docs_of):
    frame = quality_rules(docs_of([]), spark.createDataFrame([], "doc_id long"))
    assert frame.collect() == []


def test_counts_are_exact(spark, documents):
    n = gram_counts(documents).agg({"n": "sum"}).first()[0]
    assert n == sum(max(0, len((r.text or "").encode()) - GRAM + 1) for r in documents.collect())
    assert np.isfinite(log_ratio(gram_counts(documents), gram_counts(documents))).all()
