import hashlib
import random
import re

import pytest

from weekcast.llm import chunks
from weekcast.llm.substring_dedup import NO_ID, remove_passages, window_minima
from weekcast.llm.suffix_automaton import SuffixAutomaton


def brute(rows, length=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - length + 1):
            s = tuple(w[k : k + length])
            least[s] = min(least.get(s, NO_ID), NO_ID if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < (NO_ID if i is None else i):
                gone |= set(range(k, k + length))
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def result(df, **options):
    rows = remove_passages(df, **options).collect()
    for r in rows:
        assert all(a < b for a, b in zip(r.span_starts, r.span_ends)) and all(b < a for b, a in zip(r.span_ends, r.span_starts[1:]))
    return sorted((str(r.doc_id), r.n_words, sum(r.span_ends) - sum(r.span_starts), r.kept) for r in rows)


def texts(n, seed, common=0):
    """Documents of a small vocabulary that share passages, whole or in part; some begin with one `common` passage."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 4)
    shared = [[word() for _ in range(rng.randint(30, 160))] for _ in range(6)]
    out = []
    for _ in range(n):
        words = list(shared[0]) if rng.random() < common else []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(1, len(p))] if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 70))]
        out.append("".join(w + rng.choice([" ", "\n", "\t ", "\r\n", "\x0b"]) for w in words))
    return out


@pytest.mark.parametrize(("length", "options"), [(50, {}), (20, {}), (27, {"hot": 2, "block_words": 100})])
def test_shared_passages(docs_of, length, options):
    rows = [(int(i), t) for i, t in zip(random.Random(3).sample(range(-500, 500), 90), texts(90, length, 0.4))]
    assert result(docs_of(rows).repartition(5), length=length, **options) == brute(rows, length)


def test_many_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 2000)
    rows = list(enumerate(texts(60, 11, 0.5)))
    assert result(docs_of(rows).coalesce(1), length=30, hot=5) == brute(rows, 30)


def test_edge_rows(docs_of):
    long = " ".join(f"w{i % 977}" for i in range(200000))
    one = " ".join(f"x{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \n"), (4, one), (5, one), (5, one), (6, one + " tail"), (7, "é漢🙂 " + one.replace(" ", " ")), (None, one), (None, "n " * 60), (8, long), (9, long[: len(long) // 2]), (10, "a" * 3_000_000), (11, one.upper()), (12, ("y z " * 200)), (13, ("z y " * 30))]
    assert result(docs_of(rows).repartition(4)) == brute(rows)


def test_empty_table(docs_of):
    assert result(docs_of([(1, "a")])) == [("1", 1, 0, "a")] and result(docs_of([(1, "a")]).where("false")) == []


def test_automaton_against_all_substrings():
    rng = random.Random(2)
    for _ in range(30):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(6)]
        ids = sorted(rng.choices(range(5), k=6))
        automaton = SuffixAutomaton(99)
        for own, s in zip(ids, sequences):
            automaton.add(s, own)
        automaton.close()
        least = {}
        for own, s in zip(ids, sequences):
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    least.setdefault(tuple(s[a:b]), own)
        stream, width = [rng.randrange(4) for _ in range(40)], rng.randint(1, 6)
        have, low = automaton.match(stream, width)
        for end in range(1, len(stream) + 1):
            longest = max(n for n in range(width + 1) if not n or tuple(stream[max(0, end - n) : end]) in least and n <= end)
            assert have[end - 1] == longest
            assert low[end - 1] == (least[tuple(stream[end - longest : end])] if longest else 99)


def test_window_minima():
    a, b = [f"w{i}".encode() for i in range(60)], [f"v{i}".encode() for i in range(20)]
    found = window_minima([b" ".join(a), b" ".join(a[5:] + b)], [4, 2])
    assert found == [[4] * 5 + [2] * 6, [2] * (75 - 49)]


def test_query_columns(spark):
    from weekcast.llm.queries import op13_substring_dedup

    rows = op13_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    kept = {r.doc_id: r for r in rows}
    assert len(kept) == len(rows) and all(len(r.kept_sha256) == 64 and 0 <= r.n_removed <= r.n_words for r in rows)
    assert all(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.n_removed == r.n_words)
