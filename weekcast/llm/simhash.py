"""SimHash near-duplicates: 64-bit fingerprints linked through a segment-popcount embedding.

A fingerprint maps to the vector of bit counts of its sixteen 4-bit segments. Flipping one bit moves one
count by one, so the Manhattan distance of two vectors is a lower bound of the fingerprints' Hamming
distance. The vectors are points of an integer grid: two points within distance 2 have a grid cell within
distance 1 of both, so every fingerprint is dealt to the cells around its point, cells are grouped, and
only fingerprints that meet in a cell are compared bit by bit. Within a cell the verified links are thinned
to a spanning forest, so that a dense group yields as many links as members and not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import slices, stored, texts
from weekcast.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Runs up to this length are compared member by member, longer ones through one-bit neighbours.
DIRECT_RUN = 64
#: Keys that one pass over a long run holds at a time.
PASS_KEYS = 2_000_000


def fingerprint(raw: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text: a bit is set if more than half of the shingle hashes have it."""
    words = raw.lower().split()  # on bytes: A-Z only, and the six separators of the contract
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    line = b" ".join(words)
    width = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), 1 << 17):
        joined = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 17)].tolist(), ends[at : at + (1 << 17)].tolist())])
        counts += np.unpackbits(np.frombuffer(joined, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([fingerprint(raw, shingle_words) for raw in texts(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the sixteen 4-bit segments, each in the 4 bits it came from."""
    even, odd = (x.bitwiseAND(F.lit(0x5555555555555555)) for x in (fp, F.shiftrightunsigned(fp, 1)))
    # bitwise half adder: a plain sum of the two halves would overflow a signed long
    twos = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))
    return twos.bitwiseAND(F.lit(0x3333333333333333)) + F.shiftrightunsigned(twos, 2).bitwiseAND(F.lit(0x3333333333333333))


def cells(distinct: DataFrame, radius: int) -> DataFrame:
    """(cell, fp): every grid cell within Manhattan distance `radius` (0 or 1) of the fingerprint's point."""
    point = distinct.withColumn("point", segment_counts(F.col("fp")))
    if radius == 0:
        return point.select(F.col("point").alias("cell"), "fp")
    near = [F.array(F.col("point"))]
    for segment in range(16):
        count = F.shiftrightunsigned("point", 4 * segment).bitwiseAND(F.lit(15))
        # the top segment's unit is the sign bit's nibble: 1 << 60 still fits a long
        near.append(F.when(count > 0, F.array(F.col("point") - F.lit(1 << (4 * segment)))).otherwise(F.array().cast("array<bigint>")))
        near.append(F.when(count < 4, F.array(F.col("point") + F.lit(1 << (4 * segment)))).otherwise(F.array().cast("array<bigint>")))
    return point.select(F.explode(F.concat(*near)).alias("cell"), "fp")


def near_rows(run: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers in the same run whose fingerprints differ in at most `max_bits` bits.

    Enough pairs to join everything that is linked: short runs give all of them, long runs (at two bits or
    fewer) link every row to the first that shares a one-bit neighbour with it, which means two bits at most.
    """
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.repeat(np.diff(np.r_[first, len(run)]), np.diff(np.r_[first, len(run)]))
    left, right = [], []
    long = (size > DIRECT_RUN) & (max_bits == 2)
    rows = np.flatnonzero(~long)
    step = 1
    while len(rows):
        rows = rows[rows + step < len(run)]
        rows = rows[run[rows] == run[rows + step]]
        hit = rows[np.bitwise_count(fp[rows] ^ fp[rows + step]) <= max_bits]
        left.append(hit)
        right.append(hit + step)
        step += 1
    for at in first[long[first]] if len(first) else []:
        members = np.arange(at, at + size[at])
        flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)]
        passes = max(1, len(members) * 65 // PASS_KEYS)
        for turn in range(passes):
            keys, owners = [], []
            for flip in flips:
                key = fp[members] ^ flip
                mine = key % np.uint64(passes) == np.uint64(turn)
                keys.append(key[mine])
                owners.append(members[mine])
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            head = np.r_[True, key[1:] != key[:-1]]
            left.append(owner[head][np.cumsum(head) - 1][~head])
            right.append(owner[~head])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each of n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): verified links between fingerprints, a spanning forest for each grid cell.

    Fingerprints at most `max_bits` (0, 1 or 2) apart end up connected, others never are."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def settle(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            same = np.zeros(len(cell), bool)
            again = cell[1:] == cell[:-1]
            same[1:] |= again
            same[:-1] |= again
            cell, fp = cell[same], fp[same]
            left, right = near_rows(cell, fp, max_bits) if len(cell) else (np.empty(0, np.int64),) * 2
            root = local_roots(len(cell), left, right)
            child = np.flatnonzero(root != np.arange(len(cell)))
            pairs = np.unique(np.stack([fp[child], fp[root[child]]], axis=1), axis=0) if len(child) else np.empty((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held_cell = np.concatenate([held_cell, batch.column("cell").to_numpy()])
            held_fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(held_cell, held_cell[-1]))  # the last run may go on in the next batch
            if cut:
                yield settle(held_cell[:cut], held_fp[:cut])
                held_cell, held_fp = held_cell[cut:], held_fp[cut:]
        if len(held_cell):
            yield settle(held_cell, held_fp)

    dealt = cells(distinct, (max_bits + 1) // 2).repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(verify, "u long, v long").distinct()


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`.

    Null text counts as empty; a text without words has fingerprint zero and is linked like any other. Rows
    with equal fingerprints are always linked; rows that repeat an id each come back, with the id's component.
    A null id keeps its row but is never a component id, unless its whole component has no other. Empty input
    gives an empty result; other columns are not read. `component_id` is the smallest id reachable over links.
    """
    own = stored(fingerprints(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), shingle_words), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct.select("fp"), max_bits))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    label = member.join(least, "root").select("fp", "component_id")
    return own.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of `docs` (with doc_id and text) that stand for their group: the smallest id of each.

    Of rows that repeat an id the one with the smallest text stays. A row without an id cannot be named by a
    group and stays."""
    groups = simhash_groups(docs.where(F.col("doc_id").isNotNull()), shingle_words=shingle_words, max_bits=max_bits)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # both sides grow with the documents: a shuffle join at every size
    stay = docs.join(first.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    once = Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    single = stay.withColumn("__place", F.row_number().over(once)).where("__place = 1").drop("__place")
    return single.unionByName(docs.where(F.col("doc_id").isNull()))
