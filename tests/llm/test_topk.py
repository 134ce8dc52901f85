import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekcast.llm.common import read_table
from weekcast.llm.topk import Best, search_run, top_k


def brute(rows, k, every):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in good:
        if i % every or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i)[:k]
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored)]
    return sorted(out)


def result(frame):
    return sorted(tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect())


def test_whole_table(spark):
    vectors = read_table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert result(top_k(vectors, F.col("vec_id") % 25 == 0, query_block=8)) == brute(rows, 10, 25)


def test_ties_nulls_and_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randrange(-2, 3)) for _ in range(20)]) for i in range(200)]
    rows += [(3, rows[3][1]), (0, rows[0][1]), (None, rows[1][1]), (201, None), (202, [float("nan")] * 20), (203, [None] * 20), (204, [float("-inf")] * 20), (210, []), (220, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, block string")
    assert result(top_k(frame, F.col("vec_id") % 10 == 0)) == brute(rows, 10, 10)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), 3.0 * i, -(2.0**20)]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(top_k(frame, F.col("vec_id") % 7 == 0)) == brute(rows, 10, 7)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).collect() == []
    assert result(top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") % 2 == 0)) == [(0, 1, 1, 1024 * 2048)]


def test_pruning_changes_nothing():
    rng = np.random.default_rng(0)
    queries, run = (np.floor(100 * rng.normal(size=(n, 64))) for n in (5, 4000))
    best = [Best(10) for _ in range(5)]
    for at in range(0, 4000, 500):
        search_run(queries, np.arange(5) - 10, run[at : at + 500], np.arange(at, at + 500), best)
    for q in range(5):
        score = run @ queries[q]
        order = np.lexsort((np.arange(4000), -score))[:10]
        assert best[q].id.tolist() == order.tolist() and [int(s) for s in best[q].score] == score[order].astype(int).tolist()


def test_one_query_a_block_and_small_runs(spark, monkeypatch):
    """Many blocks and groups of runs are one plan, and the result is the same."""
    from weekcast.llm import topk

    for name, value in (("CANDIDATE_RUN", 7), ("RUN_NUMBERS", 40), ("TASK_RUNS", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (1, 3, 1000):
        assert result(top_k(frame, F.col("vec_id") % 9 == 0, query_block=block)) == brute(rows, 10, 9)


def test_scores_beyond_doubles_are_bounded_and_exact(spark):
    rng = np.random.default_rng(5)
    run = np.floor(rng.normal(size=(3000, 40)) * 2.0**26)
    queries = np.floor(rng.normal(size=(4, 40)) * 2.0**26)
    run[100:200] = run[:100]  # ties
    best = [Best(10) for _ in queries]
    for at in range(0, 3000, 500):
        search_run(queries, np.arange(4) - 10, run[at : at + 500], np.arange(at, at + 500), best)
    whole = [[int(x) for x in c] for c in run]
    for q in range(4):
        scored = sorted((-sum(int(a) * b for a, b in zip(queries[q], c)), i) for i, c in enumerate(whole))[:10]
        assert [(-int(s), int(i)) for s, i in zip(best[q].score, best[q].id)] == scored
