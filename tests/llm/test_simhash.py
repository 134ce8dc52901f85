import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from weekcast.llm.components import connected_components
from weekcast.llm.simhash import links, local_roots, near_rows, simhash_groups

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, max_bits=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= max_bits:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_matches_brute_force(docs_of, documents):
    texts = [None, "", " \n", "one", "One  two", "ONE two\tthree", "É é A", "w " * 5000] + [r.text for r in documents.collect()]
    prints = [brute_fingerprint(t) for t in texts]
    expect = brute_components(prints)
    got = {r.doc_id: r for r in simhash_groups(docs_of(texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, p in enumerate(prints):
        assert got[i].fingerprint == f"{p:016x}"
        assert got[i].component_id == expect[i]


def test_null_and_repeated_ids(docs_of):
    rows = simhash_groups(docs_of([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "other words here")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]


def test_empty(docs_of):
    assert simhash_groups(docs_of([])).collect() == []


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_connect_exactly_what_is_near(spark, max_bits):
    rnd = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):  # clusters and chains round random points, top bit included
        p = rnd.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            for _ in range(rnd.choice([1, 2, 3])):
                p ^= 1 << rnd.randrange(64)
    prints = sorted(prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    roots = {r.node % (1 << 64): r.root for r in connected_components(links(frame, max_bits)).collect()}
    expect = brute_components(prints, max_bits)
    groups = {}
    for p, e in zip(prints, expect):
        groups.setdefault(e, set()).add(roots.get(p, signed(p)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_runs_take_the_neighbour_path():
    rnd = random.Random(1)
    fp = np.array(sorted({rnd.getrandbits(64) if rnd.random() < 0.3 else 1 << rnd.randrange(64) | 1 << rnd.randrange(64) | 1 for _ in range(900)}), np.uint64)
    run = np.zeros(len(fp), np.int64)
    left, right = near_rows(run, fp, 2)
    assert (np.bitwise_count(fp[left] ^ fp[right]) <= 2).all()
    assert local_roots(len(fp), left, right).tolist() == brute_components([int(x) for x in fp])


def test_chain_of_components(spark):
    chain = [(i + 1, i) for i in range(300)] + [(500, 501), (501, 500), (900, 900), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}
