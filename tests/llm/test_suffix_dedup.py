import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekcast.llm import suffix_array as module
from weekcast.llm import suffix_dedup
from weekcast.llm.suffix_array import permuted_lcp, suffix_array
from weekcast.llm.suffix_dedup import equal_window_minima, owned_runs, remove_repeats


def brute(rows, length=50):
    """Kept bytes and removed spans of each (id, text)."""
    least = {}
    raws = [(t or "").encode() for _, t in rows]
    ids = [float("inf") if i is None else i for i, _ in rows]
    for i, raw in zip(ids, raws):
        for a in range(len(raw) - length + 1):
            w = raw[a : a + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, raw in zip(ids, raws):
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            if least[raw[a : a + length]] < i:
                gone[a : a + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
        out.append((len(raw), edge[::2], edge[1::2], np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return out


def check(frame, rows):
    got = sorted((str(r.doc_id), r.n_bytes, r.span_starts, r.span_ends, bytes(r.kept)) for r in remove_repeats(frame).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, brute(rows)))


def test_whole_table(documents):
    check(documents, [(r.doc_id, r.text) for r in documents.collect()])


def test_edge_cases(docs_of):
    rnd = random.Random(2)
    words = ["der", "the", "ñandú", "ök", "x", "zz9", "\n", "\x00", "🙂"]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = [(5, None), (6, ""), (None, passage), (3, "y" * 49), (4, "y" * 50), (9, "y" * 51), (8, "a" * 300), (2, "a" * 120), (7, "ab" * 90), (1, "ba" * 60)]
    for i in range(20, 60):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(30))) for _ in range(3)]
        rows.append((i, parts[0] + passage[rnd.randrange(40) :][: rnd.randrange(200)] + parts[1] + passage + parts[2]))
    rows += [(25, rows[15][1]), (25, "q" + passage), (None, rows[20][1])]
    rnd.shuffle(rows)
    check(docs_of(rows).repartition(4), rows)


def test_hot_grams_take_single_windows(docs_of):
    rnd = random.Random(4)
    passage = "one passage that more than a thousand documents share, with a long enough body to cover windows"
    rows = [(i, f"{rnd.random()} {passage[rnd.randrange(4):]} {rnd.random()}") for i in range(suffix_dedup.HOT + 200)]
    check(docs_of(rows).repartition(5), rows)


def test_empty(docs_of):
    assert remove_repeats(docs_of([])).collect() == []
    assert [bytes(r.kept) for r in remove_repeats(docs_of([None, ""])).collect()] == [b"", b""]


@given(st.lists(st.integers(1, 4), max_size=60), st.sampled_from([1, 4, 64]))
@settings(max_examples=200, deadline=None)
def test_suffix_array_orders_all_suffixes(symbols, run):
    text, before = np.array(symbols + [0]), module.RUN
    module.RUN = run
    try:
        order = suffix_array(text).tolist()
    finally:
        module.RUN = before
    assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@given(st.binary(max_size=80))
@settings(max_examples=100, deadline=None)
def test_permuted_lcp(raw):
    data = np.frombuffer(raw + b"\0", np.uint8)
    text = np.append(data[:-1].astype(int) + 1, 0)
    order = suffix_array(text)
    got = permuted_lcp(data, order, 20)
    for a, b in zip(order[:-1], order[1:]):
        n = 0
        while a + n < len(data) and b + n < len(data) and data[a + n] == data[b + n] and n < 20:
            n += 1
        assert got[b] == n


def test_minima_of_equal_windows():
    rnd = random.Random(0)
    contexts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(20, 30))).encode() for _ in range(300)]
    least = np.array([rnd.randrange(1000) for _ in contexts])
    table = {}
    for c, low in zip(contexts, least):
        for a in range(len(c) - 19):
            table[c[a : a + 20]] = min(low, table.get(c[a : a + 20], low))
    for c, got in zip(contexts, equal_window_minima(contexts, least, 20)):
        assert got.tolist() == [table[c[a : a + 20]] for a in range(len(c) - 19)]


@pytest.mark.parametrize("block", [60, 1 << 19])
def test_runs_cover_each_window_once(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 300, 40)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = rng.integers(97, 100, offsets[-1]).astype(np.uint8)
    first, end, gram, _ = owned_runs(data, offsets)
    windows = sorted(w for a, b in zip(first, end) for w in range(a, b))
    assert windows == [w for a, b in zip(offsets[:-1], offsets[1:]) for w in range(a, b - 49)]
    assert all(a <= g + 30 and b - 1 <= g and g <= a + 30 for a, b, g in zip(first, end, gram))
