import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from weekcast.llm import attention_lm as lm
from weekcast.llm import lm_scoring
from weekcast.llm.attention_lm import Parameters, Scorer, loss_and_gradient, train, vocabulary
from weekcast.llm.chunks import pack, row_of
from weekcast.llm.lm_scoring import TOKENIZER, _word_logs, lm_scores, subwords

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(rows):
    tokens = [WORD.findall(lower(t)) + [None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for ws in tokens]


def check(frame, rows):
    got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_scores(frame).collect()))
    assert got == sorted((str(i), *b[:3], round(b[3], 6)) for (i, _), b in zip(rows, brute_base(rows)))


def test_base_scores_of_the_whole_table(documents):
    check(documents, [(r.doc_id, r.text) for r in documents.collect()])


def test_edge_cases(docs_of):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A a Ä ä"), (3, "A a Ä ä"), (None, "a b"), (7, "x" * 40000), (8, "a\x0bb\x0cc\x1fd é"), (9, "word " * 5000)]
    check(docs_of(rows).repartition(3), rows)
    out = lm_scores(docs_of(rows)).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_empty_and_all_held_out(docs_of):
    assert lm_scores(docs_of([])).collect() == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    out = lm_scores(docs_of([(i, "some words") for i in held])).collect()
    assert len(out) == 3 and {r.train_tokens for r in out} == {0} and all(math.isfinite(r.score) for r in out)


def test_attention_helps_held_out_text(spark):
    from weekcast.llm.common import read_table

    rows = lm_scores(read_table(spark, "/root/testdata/sf0.01", "documents")).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    # per word and end, on documents never learnt from: far better than subwords spread evenly, near word counts
    per_token = sum(r.score for r in held) / sum(r.n_tokens for r in held)
    assert -5.0 < per_token < -3.0


def small_model(seed=0, size=200):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, size).astype(float)
    pairs = np.unique(rng.integers(0, size * size, 500))
    words = vocabulary(counts, rng.normal(size=(size, 4)), np.arange(size) % 3 == 0, size - 1, pairs, rng.integers(1, 9, len(pairs)))
    p = Parameters.initial(words.class_log)
    for name in ("out", "direct", "distance"):
        setattr(p, name, rng.normal(size=getattr(p, name).shape))
    return p, words


def scores(p, words, ids, goals, starts):
    scorer = Scorer(p, words, len(words.class_of) - 1)
    return scorer.class_scores(ids, goals, starts) + np.log(scorer.within(ids, goals))


def plain_scores(p, words, stream, at, goal):
    """log p(goal) behind stream[at], by the definition, with the context that the window of `at` gives."""
    first = max(0, at // lm.STRIDE * lm.STRIDE - lm.CONTEXT)
    ids = stream[first : at + 1]
    e = p.embed[words.kind_of[ids]]
    s = (e @ p.key) @ (e[-1] @ p.query) / np.sqrt(lm.WIDTH) + p.distance[np.arange(len(ids))[::-1]]
    a = np.exp(s - s.max())
    z = (a / a.sum()) @ (e @ p.value) @ p.out + e[-1] @ p.direct + p.bias
    soft = np.exp(z - z.max()) * (np.bincount(words.class_of, minlength=lm.CLASSES) > 0)
    last, size = int(stream[at]), len(words.class_of)
    count = {int(k): int(c) for k, c in zip(words.pairs, words.pair_counts)}
    mine = [i for i in range(size) if words.class_of[i] == words.class_of[goal]]
    total = sum(count.get(last * size + i, 0) for i in mine)
    within = (count.get(last * size + int(goal), 0) + lm.PAIR_PRIOR * words.within[goal]) / (total + lm.PAIR_PRIOR)
    return math.log(soft[words.class_of[goal]] / soft.sum() * within)


def test_scores_equal_the_definition():
    p, words = small_model()
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 200, n) for n in (1, 5, 40, 100, 16, 17)]
    ids = np.concatenate(texts)
    starts = np.repeat(np.cumsum([0] + [len(t) for t in texts[:-1]]), [len(t) for t in texts])
    goals = rng.integers(0, 200, len(ids))
    got = scores(p, words, ids, goals, starts)
    for i in range(len(ids)):
        # a text's own stream, padded so that windows fall as they do in the joined one
        own = ids[starts[i] :]
        shift = starts[i] % lm.STRIDE
        first = max(starts[i], i // lm.STRIDE * lm.STRIDE - lm.CONTEXT)
        e_ids = ids[first : i + 1]
        expect = plain_scores(p, words, e_ids, len(e_ids) - 1, goals[i]) if len(e_ids) <= lm.STRIDE else _long(p, words, e_ids, goals[i])
        assert got[i] == pytest.approx(expect, abs=1e-3), (i, own[:3], shift)


def _long(p, words, ids, goal):
    before, lm.STRIDE = lm.STRIDE, 10**6  # one window over the whole context
    try:
        return plain_scores(p, words, ids, len(ids) - 1, goal)
    finally:
        lm.STRIDE = before


def test_probabilities_sum_to_one():
    p, words = small_model(3)
    size = len(words.class_of)
    ids = np.array([5, 17, 60])
    for at in range(3):
        logs = [scores(p, words, ids[: at + 1], np.append(ids[1 : at + 1], g), np.zeros(at + 1, int))[at] for g in range(size)]
        assert sum(map(math.exp, logs)) == pytest.approx(1.0, abs=1e-4)


def test_gradient_by_differences():
    p, words = small_model(2)
    rng = np.random.default_rng(5)
    windows = rng.integers(0, 200, (3, 12))
    kinds, goals = words.kind_of[windows[:, :-1]], words.class_of[windows[:, 1:]].copy()
    goals[0, 5:] = -1
    _, g = loss_and_gradient(p, kinds, goals)
    flat, exact = p.flat(), g.flat()
    for i in np.r_[rng.choice(np.flatnonzero(exact), 60), np.arange(len(flat) - 10, len(flat))]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        numeric = (loss_and_gradient(Parameters.shaped(up), kinds, goals)[0] - loss_and_gradient(Parameters.shaped(down), kinds, goals)[0]) / 2e-5
        assert numeric == pytest.approx(exact[i], abs=1e-5)


def test_training_learns_a_pattern():
    _, words = small_model(4)
    start = Parameters.initial(words.class_log)
    windows = np.tile(np.arange(33) * 7 % 199, (2000, 1))
    kinds, goals = words.kind_of[windows[:1, :-1]], words.class_of[windows[:1, 1:]]
    assert loss_and_gradient(train(start, windows, words), kinds, goals)[0] < 0.2 * loss_and_gradient(start, kinds, goals)[0]


def test_word_logs_sum_the_pairs_of_a_word():
    p, words = small_model(6)
    scorer = Scorer(p, words, len(words.class_of) - 1)
    words.class_of[:3], words.class_of[100:] = 0, 1  # ids under 3 start words, those from 100 on go on
    words.pairs, words.pair_counts = np.array([0 * 200 + 150, 150 * 200 + 160, 160 * 200 + 150]), np.array([3, 5, 2])
    scorer = Scorer(p, words, 199)
    ids, length = np.array([0, 150, 160, 1, 2, 160, 150]), np.array([3, 1, 0, 3])
    got = _word_logs(scorer, ids, np.cumsum(length) - length, length)
    log = lambda last, goal: float(np.log(scorer.within(np.array([last]), np.array([goal])))[0])
    expect = [log(199, 0) + log(0, 150) + log(150, 160), log(199, 1), 0.0, log(199, 2) + log(2, 160) + log(160, 150)]
    assert got == pytest.approx(expect)


def test_every_word_has_ids():
    assert all(subwords(TOKENIZER, w.encode()) for w in ("a", "é", "漢", "\x00", "🙂", "x" * 1000))


def test_the_model_learns_from_every_id_of_every_training_document():
    texts = {i: " ".join(f"w{i}x{k}" for k in range(i * i % 900)) for i in range(60)}
    blobs = [t.encode() for t in texts.values()]
    row = row_of(0, 0, list(texts), pack(np.array([len(b) for b in blobs])), zstandard.compress(b"".join(blobs)))
    windows = np.concatenate(list(lm_scoring._windows_of(lm_scoring._streams(TOKENIZER, 7, 2)(iter([row])))))
    assert windows.shape[1] == lm.WINDOW + 1 and (windows[:, :2] >= 0).all()
    end = lm_scoring._tokenizer(TOKENIZER).token_to_id(lm_scoring.END_TOKEN)
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 40 < len(learnt) < 60
    # the goals of all windows are the ids of all texts, each closed by an end
    expect = [x for i in learnt for w in [*texts[i].split(), None] for x in (subwords(TOKENIZER, w.encode()) if w else [end])]
    assert windows[:, 1:][windows[:, 1:] >= 0].tolist() == expect


def test_words_that_go_on_occurring_are_cut_once(monkeypatch):
    cut, plain = [], subwords
    monkeypatch.setattr(lm_scoring, "KEPT_WORDS", 3)
    monkeypatch.setattr(lm_scoring, "subwords", lambda path, word: cut.append(word) or plain(path, word))
    learnt = [i for i in range(30) if zlib.crc32(str(i).encode()) % 7 != 2][:9]
    texts = [f"common w{i}a w{i}b w{i}c".encode() for i in learnt]
    rows = [row_of(0, k, [i], pack(np.array([len(t)])), zstandard.compress(t)) for k, (i, t) in enumerate(zip(learnt, texts))]
    assert len(list(lm_scoring._streams(TOKENIZER, 7, 2)(iter(rows)))) == 9
    assert cut.count(b"common") == 1 and len(cut) == 1 + 3 * 9


def test_shares_of_pairs_equal_the_counted_ones_whatever_their_number(spark):
    rng = np.random.default_rng(8)
    size, many = 1000, 1 << 19  # twice as many as were kept once
    pairs, n = np.sort(rng.choice(size * size, many, replace=False)), rng.integers(0, 5, many)
    words = vocabulary(rng.integers(1, 50, size).astype(float), rng.normal(size=(size, 4)), np.arange(size) % 3 == 0, size - 1, pairs, n)
    counted = spark.createDataFrame(pa.table({"pair": pairs, "n": n}))
    told = [r.asDict() for r in lm_scoring._told(counted.selectExpr("pair % 2 AS part", "pair"), lm_scoring._shares(counted, words)).collect()]
    for part in (0, 1):
        mine = pairs[(pairs % 2 == part) & (pairs // size != size - 1)]
        got = lm_scoring._Pairs([r for r in told if r["chunk"] == part], words, size - 1).within(mine // size, mine % size)
        assert got == pytest.approx(Scorer(Parameters.initial(words.class_log), words, size - 1).within(mine // size, mine % size))


def plain_loss_and_gradient(p, kinds, goals):
    """By the definition: each id's query, key and value, shifted softmax, every weight divided."""
    loss, out, (n, length) = 0.0, Parameters.shaped(np.zeros_like(p.flat())), kinds.shape
    for row, goal in zip(kinds, goals):
        e = p.embed[row]
        q, k, v = e @ p.query / np.sqrt(lm.WIDTH), e @ p.key, e @ p.value
        for t in np.flatnonzero(goal >= 0):
            gap = t - np.arange(t + 1)
            s = k[: t + 1] @ q[t] + p.distance[gap]
            a = np.exp(s - s.max())
            a /= a.sum()
            h = a @ v[: t + 1]
            z = h @ p.out + e[t] @ p.direct + p.bias
            soft = np.exp(z - z.max())
            soft /= soft.sum()
            loss -= np.log(soft[goal[t]])
            dz = soft - (np.arange(lm.CLASSES) == goal[t])
            dh, da = p.out @ dz, v[: t + 1] @ (p.out @ dz)
            ds = a * (da - a @ da)
            dq, dk, dv = ds @ k[: t + 1], np.outer(ds, q[t]), np.outer(a, dh)
            out.out += np.outer(h, dz)
            out.direct += np.outer(e[t], dz)
            out.bias += dz
            out.query += np.outer(e[t], dq) / np.sqrt(lm.WIDTH)
            out.key += e[: t + 1].T @ dk
            out.value += e[: t + 1].T @ dv
            np.add.at(out.distance, gap, ds)
            np.add.at(out.embed, row[: t + 1], dk @ p.key.T + dv @ p.value.T)
            out.embed[row[t]] += p.direct @ dz + p.query @ dq / np.sqrt(lm.WIDTH)
    return loss, out


@pytest.mark.parametrize("size", [1, 40])  # 40: exponents in the hundreds, which have to be shifted
def test_gradient_equals_the_definition(size):
    p, words = small_model(7)
    for name in ("query", "out"):
        setattr(p, name, getattr(p, name) * size)
    windows = np.random.default_rng(8).integers(0, 200, (4, lm.WINDOW + 1))
    kinds, goals = words.kind_of[windows[:, :-1]], words.class_of[windows[:, 1:]].copy()
    goals[1, 9:], goals[2] = -1, -1
    expect, exact = plain_loss_and_gradient(p, kinds, goals)
    for kind in (float, np.float32):
        loss, g = loss_and_gradient(Parameters.shaped(p.flat().astype(kind)), kinds, goals)
        near = 1e-9 if kind is float else 2e-3
        assert loss == pytest.approx(expect, rel=near)
        assert np.abs(g.flat() - exact.flat()).max() < near * np.abs(exact.flat()).max()


def test_shifted_exponents_give_the_same_numbers(monkeypatch):
    p, words = small_model(9)
    windows = np.random.default_rng(1).integers(0, 200, (5, 20))
    kinds, goals = words.kind_of[windows[:, :-1]], words.class_of[windows[:, 1:]]
    loss, g = loss_and_gradient(p, kinds, goals)
    monkeypatch.setattr(lm, "SAFE", 0.0)
    shifted, h = loss_and_gradient(p, kinds, goals)
    assert shifted == pytest.approx(loss) and h.flat() == pytest.approx(g.flat(), abs=1e-9)


def test_query_and_key_meet_in_one_table():
    p, words = small_model(10)
    scorer = Scorer(p, words, len(words.class_of) - 1)
    rows = [x for x in vars(scorer).values() if isinstance(x, np.ndarray) and x.shape[:1] == words.class_of.shape and x is not scorer.given_last]
    assert sum(x.shape[1] for x in rows) == lm.WIDTH + lm.WIDTH + 1 + lm.CLASSES  # no third row of WIDTH for each id
