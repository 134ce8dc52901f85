"""Exact top-k inner-product search by columnar branch and bound.

Queries are packed into blocks, candidates into runs; a row holds one. Every run is sent to each block, and a block
to each group of runs, by one shuffle: a task gets a block, then its runs one by one. It turns a run into a vertical
layout, one row per dimension, and adds up scores dimension block by dimension block. After each block the
remaining mass |q_rest| * |c_rest| bounds what a candidate can still gain; candidates that cannot reach the
query's k-th best score so far are compacted away. Each task returns at most k rows per query. Nothing but two
counts passes the driver, and the plan is the same for any number of blocks.

Where sums may pass the integers that doubles hold, bounds are widened by the rounding that doubles can have, and
what survives them is scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import stored

SCALE = 1024
QUERY_BLOCK = 2048
#: Candidates that a task lays out at a time, numbers in a run at most, runs that a task takes, dimensions per block.
CANDIDATE_RUN = 2048
RUN_NUMBERS = 1 << 21
TASK_RUNS = 4
DIMENSIONS = 16
#: Integer sums below this are exact in double precision.
EXACT = float(1 << 52)


def quantised(vectors: list, width: int | None = None) -> np.ndarray:
    """floor(1024 * x) of each component, as doubles that hold integers; shorter vectors end in zeros."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(vectors), max(width, int(lengths.max(initial=0)))))
    for i, v in enumerate(vectors):
        out[i, : lengths[i]] = v
    return np.floor(SCALE * out)


class Best:
    """The k best (score, id) of one query."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.empty(0, object), np.empty(0, np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    def floor(self):
        return self.score[-1] if len(self.score) == self.k else None


def search_run(queries: np.ndarray, query_ids: np.ndarray, run: np.ndarray, ids: np.ndarray, best: list[Best], dimensions: int = DIMENSIONS) -> None:
    """Offer one run of candidates (rows of `run`) to every query's `best`."""
    width = max(queries.shape[1], run.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    run = np.pad(run, ((0, 0), (0, width - run.shape[1])))
    # what a double's sum may be off by; nothing while all sums are exact
    largest = np.abs(queries).max(initial=0) * np.abs(run).max(initial=0) * max(1, width)
    exact = largest < EXACT
    layout = np.ascontiguousarray(run.T)
    edges = list(range(0, width, dimensions)) + [width] if width else [0, 0]
    energy = lambda m: np.sqrt(np.cumsum((m**2)[:, ::-1], axis=1)[:, ::-1])  # noqa: E731  norm of the components from each one on
    candidate_rest = np.hstack([energy(run), np.zeros((len(run), 1))])
    query_rest = np.hstack([energy(queries), np.zeros((len(queries), 1))])
    first = queries[:, : edges[1]] @ layout[: edges[1]]
    for q, own in enumerate(query_ids):
        alive = np.flatnonzero(ids != own)
        score = first[q, alive]
        floor = best[q].floor()
        off = 0.0 if exact else 1e-9 * float(query_rest[q, 0]) * float(candidate_rest[:, 0].max(initial=0))
        for at, end in [*zip(edges[1:-1], edges[2:]), (width, width)]:
            if floor is not None:
                # the slack covers rounding in the norms; a tie may still win by its id
                gain = query_rest[q, at] * candidate_rest[alive, at]
                able = score + gain * (1 + 1e-9) + 1e-6 + off >= float(floor)
                alive, score = alive[able], score[able]
            if at < end and len(alive):
                score = score + queries[q, at:end] @ layout[at:end, alive]
        if len(alive) > best[q].k:  # only what can be among the k best is sorted
            bar = np.partition(score, len(score) - best[q].k)[len(score) - best[q].k]
            alive, score = alive[score >= bar - 2 * off], score[score >= bar - 2 * off]
        if not exact:
            whole = [int(x) for x in queries[q]]
            score = np.array([sum(x * int(y) for x, y in zip(whole, run[c])) for c in alive], dtype=object)
        best[q].offer(score.astype(object), ids[alive])


def usable(vectors: DataFrame) -> DataFrame:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, vec_id, embedding) as runs: their ids and their quantised components, row by row."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
        for a, b in zip(edges[:-1], edges[1:]):
            at = a
            while at < b:
                widest = max(1, int(pc.max(pc.list_value_length(batch.column("embedding").slice(at, min(b - at, CANDIDATE_RUN)))).as_py()))
                many = int(min(b - at, CANDIDATE_RUN, max(1, RUN_NUMBERS // widest)))
                part = batch.slice(at, many)
                table = quantised(part.column("embedding").to_pylist())
                packed = zstandard.compress(table.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([int(block[a])]), pa.array([number]), pa.array([part.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([packed], pa.binary())], ["block", "run", "ids", "packed"])
                number, at = number + 1, at + many


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(zstandard.decompress(row["packed"])).reshape(len(ids), -1)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of a block's queries, then those of candidates; a block of queries has numbers from 0 on."""
        now, asked, queries, query_ids, best = None, [], None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            number = np.repeat(np.arange(len(best)), [len(b.id) for b in best])
            if len(number):
                score = [int(s) for b in best for s in b.score]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), now[0])), pa.array(number), pa.array(query_ids[number]), pa.array(np.concatenate([b.id for b in best])), pa.array(score, pa.int64())], ["block", "number", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["block"], row["group"]) != now:
                    yield from close()
                    now, asked, best = (row["block"], row["group"]), [], []
                if row["kind"] == 0:
                    asked.append(_unpack(row))
                    continue
                if not asked:
                    continue  # no query's hash chose this block
                if not best:
                    width = max(q.shape[1] for _, q in asked)
                    queries = np.concatenate([np.pad(q, ((0, 0), (0, width - q.shape[1]))) for _, q in asked])
                    query_ids = np.concatenate([ids for ids, _ in asked])
                    best = [Best(k) for _ in query_ids]
                ids, candidates = _unpack(row)
                search_run(queries, query_ids, candidates, ids, best)
        yield from close()

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    `is_query` is a condition on `vec_id`. Rows with a null id, a null vector or a null, NaN or infinite
    component take no part; vectors of unequal length count as filled up with zeros. All rows with the query's
    id count as its own and are no candidates of it; a query row repeated with the same vector gives one
    result. Repeated candidate rows each take a rank. Fewer than k candidates give fewer rows; no queries none.
    A score beyond a signed 64-bit integer raises. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding")))
    asked = stored(rows.where(is_query).dropDuplicates(["vec_id", "embedding"]), "queries")
    packed = "block long, run long, ids binary, packed binary"
    runs = stored(rows.select(F.lit(0).cast("long").alias("block"), "vec_id", "embedding").mapInArrow(_pack, packed), "runs")
    many, every = asked.count(), runs.count()
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(1, -(-many * 5 // (query_block * 4)))  # room for uneven hashing
    groups = max(1, -(-every // TASK_RUNS))
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks))).repartition("block").sortWithinPartitions("block", "vec_id", "embedding")
    queries = stored(blocked.select("block", "vec_id", "embedding").mapInArrow(_pack, packed), "blocks")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("group", all_of(groups)).withColumn("kind", F.lit(0))
    right = runs.drop("block").withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups))).withColumn("block", all_of(blocks)).withColumn("kind", F.lit(1))
    met = left.unionByName(right).repartition("block", "group").sortWithinPartitions("block", "group", "kind", "run")
    found = met.mapInArrow(_search(k), "block long, number long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
