"""Merkle manifest of a dataset: a hash tree per language, and one over the trees' roots.

Leaves stand in the order of their ids without being sorted by them. Ids are kept as compressed bitmaps, one
for every tree and container of 4,096 consecutive ids. A task writes the bitmaps of its own rows; those of one
container are merged where its rows arrive, and a directory of popcounts gives each id its rank there. The rows
before a container come from directories of row counts, four levels of prefix sums with at most 8,192 entries
below one, however the ids are spread.

A coordinate (tree, position) is a slot: arrays of 4096 slots, keyed by (tree, position >> 12), are filled as rows
come and reduced by twelve levels at once, which gives the slots of the next tier. Proofs are put together from
the top tier down, so that no join meets more than 4096 rows of one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import stored

#: Bits of an id within its container, and of a container's number within each level of the directory above it.
CONTAINER_BITS = 12
DIRECTORY_BITS = 13
#: Levels of a tree that one slot array reduces.
BLOCK_LEVELS = 12
#: The container of null ids, below those of all integers.
NULL_CONTAINER = -(1 << 51) - 1
#: Columns that make a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each `-` if null, else its UTF-8 byte count, `:` and the value as text."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def _hash(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


# -- coordinates ------------------------------------------------------------------------------------------


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each batch as bitmaps by container; rows that an id has beyond its first, as (bit, rows)."""
    for batch in batches:
        table = batch.to_pandas()
        out = []
        for (tree, bucket), part in table.groupby(["tree", "bucket"], sort=False):
            rows = part.groupby("bit")["copies"].sum()
            bits = np.zeros(1 << CONTAINER_BITS, np.uint8)
            bits[rows.index.to_numpy()] = 1
            more = rows[rows > 1] - 1
            out.append((tree, bucket, zstandard.compress(np.packbits(bits, bitorder="little").tobytes(), 1), more.index.tolist(), more.tolist()))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "bucket", "bitmap", "bits", "extra"])


class _Container:
    """A merged bitmap with its directory: ids before each byte, and rows beyond the first of each id."""

    def __init__(self):
        self.bytes, self.more, self.directory = np.zeros(1 << CONTAINER_BITS - 3, np.uint8), {}, None
        self.given: dict[int, int] = {}

    def merge(self, bitmap: bytes, bits: list, extra: list) -> None:
        other = np.frombuffer(zstandard.decompress(bitmap), np.uint8)
        both = np.flatnonzero(np.unpackbits(self.bytes & other, bitorder="little"))
        for bit, rows in [*zip(bits, extra), *((int(b), 1) for b in both)]:
            self.more[bit] = self.more.get(bit, 0) + rows
        self.bytes |= other

    def close(self) -> None:
        counts = np.bitwise_count(self.bytes).astype(np.int64)
        self.directory = np.cumsum(counts) - counts
        tied = sorted(self.more)
        self.tied, self.tied_rows = np.array(tied, np.int64), np.concatenate([[0], np.cumsum([self.more[b] for b in tied])]).astype(np.int64)
        self.rows = int(counts.sum() + self.tied_rows[-1])

    def rank(self, bits: np.ndarray) -> np.ndarray:
        """Rows of smaller ids in the container."""
        below = np.bitwise_count(self.bytes[bits >> 3] & ((1 << (bits & 7)) - 1).astype(np.uint8)).astype(np.int64)
        return self.directory[bits >> 3] + below + self.tied_rows[np.searchsorted(self.tied, bits)]

    def places(self, bits: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The first place of each row; rows of one id take theirs in the order in which they come."""
        at = self.rank(bits)
        for i in np.flatnonzero(np.isin(bits, self.tied)) if len(self.tied) else ():
            bit = int(bits[i])
            before = self.given.get(bit, 0)
            self.given[bit] = before + int(copies[i])
            at[i] += before
        return at


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of a container, then its rows: each row with its place in the container; the first with `held`,
    the rows of the container."""
    now, box, told = None, _Container(), False
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("bucket").to_pylist()))
        edges = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1] or kind[i] != kind[i - 1]] + [len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            if keys[a] != now:
                now, box, told = keys[a], _Container(), False
            part = batch.slice(a, b - a)
            if kind[a] == 0:
                for row in part.select(["bitmap", "bits", "extra"]).to_pylist():
                    box.merge(row["bitmap"], row["bits"], row["extra"])
                continue
            if box.directory is None:
                box.close()
            place = box.places(part.column("bit").to_numpy(), part.column("copies").to_numpy())
            held = pa.array([None if told else box.rows] + [None] * (b - a - 1), pa.int64())
            told = True
            names = ["tree", "bucket", "bit", "leaf", "tampered", "copies"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(place), held], [*names, "place", "held"])


def _before(containers: DataFrame) -> DataFrame:
    """(tree, bucket, before, total): rows of the tree in smaller containers, and all its rows."""
    levels, level = [], containers.withColumnRenamed("bucket", "k")
    for _ in range(3):
        levels.append(level)
        level = level.groupBy("tree", F.shiftright("k", DIRECTORY_BITS).alias("k")).agg(F.sum("n").alias("n"))
    top = Window.partitionBy("tree")
    out = level.select("tree", F.col("k").alias("up"), (F.sum("n").over(top.orderBy("k")) - F.col("n")).alias("before"), F.sum("n").over(top).alias("total"))
    for level in reversed(levels):
        own = Window.partitionBy("tree", "up").orderBy("k")
        inner = level.withColumn("up", F.shiftright("k", DIRECTORY_BITS)).withColumn("inner", F.sum("n").over(own) - F.col("n"))
        out = inner.join(out, ["tree", "up"]).select("tree", F.col("k").alias("up"), (F.col("before") + F.col("inner")).alias("before"), "total")
    return out.withColumnRenamed("up", "bucket")


def _coordinates(leaves: DataFrame) -> DataFrame:
    """(tree, pos, digest, total, doc_id, tampered): a row for each leaf, equal rows included."""
    # equal rows become one with a count before anything gathers the rows of an id
    rows = leaves.groupBy("tree", "bucket", "bit", "leaf").agg(F.count(F.lit(1)).alias("copies"), F.first("tampered").alias("tampered"))
    rows = stored(rows, "rows")
    maps = rows.select("tree", "bucket", "bit", "copies").mapInArrow(_bitmaps, "tree string, bucket long, bitmap binary, bits array<long>, extra array<long>")
    both = maps.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # rows of one id come in the order of their digests
    dealt = both.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "kind", "leaf")
    ranked = stored(dealt.mapInArrow(_rank, "tree string, bucket long, bit long, leaf binary, tampered binary, copies long, place long, held long"), "ranked")
    containers = ranked.where(F.col("held").isNotNull()).select("tree", "bucket", F.col("held").alias("n"))
    placed = ranked.join(_before(containers), ["tree", "bucket"])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    doc_id = F.when(F.col("bucket") != NULL_CONTAINER, F.shiftleft("bucket", CONTAINER_BITS) + F.col("bit"))
    return placed.withColumn("copy", copy).select("tree", (F.col("before") + F.col("place") + F.col("copy")).alias("pos"), F.col("leaf").alias("digest"), "total", doc_id.alias("doc_id"), "tampered")


# -- tiers --------------------------------------------------------------------------------------------------


def reduce_block(nodes: list[bytes], total: int, levels: int = BLOCK_LEVELS) -> tuple[bytes, list[str], list[bytes]]:
    """(root, sides, siblings) of one slot array of a tree with `total` slots: for each slot, a letter a level
    (L or R: the sibling's side, -: none) and the siblings end to end."""
    n, level = len(nodes), nodes
    sides, found = [[] for _ in range(n)], [[] for _ in range(n)]
    for up in range(min(levels, (total - 1).bit_length())):
        for i in range(n):
            at = i >> up
            if at & 1:
                sides[i].append("L")
                found[i].append(level[at - 1])
            elif at + 1 < len(level):
                sides[i].append("R")
                found[i].append(level[at + 1])
            else:
                sides[i].append("-")
        level = [_hash(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], ["".join(s) for s in sides], [b"".join(f) for f in found]


def _reduce(names: list[str], levels: int):
    slot = (1 << levels) - 1

    def close(array: list, total: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if any(x is None for x in array):
            raise ValueError("a slot is empty")
        root, sides, siblings = reduce_block(array, total, levels)
        for part in rows:
            slots = [p & slot for p in part.column("pos").to_pylist()]
            more = [pa.array([sides[s] for s in slots], pa.string()), pa.array([siblings[s] for s in slots], pa.binary()), pa.array([root if not s else None for s in slots], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *more], [*names, "sides", "siblings", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, array, total, held = None, [], 0, []
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            keys = list(zip(batch.column("tree").to_pylist(), (pos >> levels).tolist()))
            edges = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                if keys[a] != now:
                    if held:
                        yield from close(array, total, held)
                    now, held, total = keys[a], [], part.column("total")[0].as_py()
                    array = [None] * min(1 << levels, total - (now[1] << levels))
                for p, digest in zip(pos[a:b], part.column("digest").to_pylist()):
                    array[p & slot] = digest
                held.append(part)
        if held:
            yield from close(array, total, held)

    return run


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tiers from `nodes` (tree, pos, digest, total, ...) up to one node a tree; each has the node's sides and
    siblings in its slot array, and the array's `top` at its first slot."""
    tiers, size = [], None
    while size is None or size > 1 << levels:
        keyed = nodes.withColumn("block", F.shiftright("pos", levels))
        dealt = keyed.repartition("tree", "block").sortWithinPartitions("tree", "block").drop("block")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
        tier = stored(dealt.mapInArrow(_reduce(nodes.columns, levels), f"{kinds}, sides string, siblings binary, top binary"), "tier")
        tiers.append(tier)
        size = tier.agg(F.max("total")).first()[0] or 0
        tops = tier.where(F.col("top").isNotNull())
        nodes = tops.select("tree", F.shiftright("pos", levels).alias("pos"), F.col("top").alias("digest"), F.shiftright(F.col("total") + ((1 << levels) - 1), levels).alias("total"))
    return tiers


def _roots(tiers: list[DataFrame]) -> DataFrame:
    return tiers[-1].where(F.col("top").isNotNull()).select("tree", F.col("top").alias("subroot"))


def _descend(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The first tier with whole proofs: its own, those of the tiers above it, then `above` (tree, sides,
    siblings and other columns) of its tree."""
    rest = [c for c in above.columns if c not in ("tree", "sides", "siblings")]
    upper = above.withColumnsRenamed({"sides": "_sides", "siblings": "_siblings"})
    on = ["tree"]
    for tier in reversed(tiers):
        own = tier.drop("top").withColumn("_pos", F.shiftright("pos", levels))
        joined = own.join(upper, on)
        whole = joined.withColumns({"sides": F.concat("sides", "_sides"), "siblings": F.concat("siblings", "_siblings")})
        out = whole.drop("_pos", "_sides", "_siblings")
        upper = whole.select("tree", F.col("pos").alias("_pos"), F.col("sides").alias("_sides"), F.col("siblings").alias("_siblings"), *rest)
        on = ["tree", "_pos"]
    return out


def _in_order(trees: DataFrame) -> DataFrame:
    """(name, pos, total, subroot) of the trees, by name in bytes: ranges of names, each sorted in its task."""
    ranged = trees.withColumnRenamed("tree", "name").repartitionByRange("name").sortWithinPartitions("name")
    at = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "trees")
    part = F.shiftright("at", 33)
    counts = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    every = Window.partitionBy(F.lit(0))
    first = counts.select("part", (F.sum("n").over(every.orderBy("part")) - F.col("n")).alias("first"), F.sum("n").over(every).alias("total"))
    return at.withColumn("part", part).join(first, "part").select("name", (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"), "total", "subroot")


def fold(leaf: bytes, sides: str, siblings: bytes) -> bytes:
    """The root that a leaf and its proof give."""
    at = 0
    for side in sides:
        if side == "-":
            leaf = _hash(leaf)
            continue
        other = siblings[at : at + 32]
        at += 32
        leaf = _hash(other, leaf) if side == "L" else _hash(leaf, other)
    return leaf


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("digest", "tampered", "sides", "siblings")))
        folded = pa.array([fold(leaf if other is None else other, sides, siblings) for leaf, other, sides, siblings in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, folded], [*batch.schema.names, "folded"])


def manifest(docs: DataFrame, tampered: Sequence[Column] | None = None, is_tampered: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, lang, pos, leaf, subroot, root, sides, siblings, folded) of each row of `docs`, digests as binary.

    A leaf is the digest of doc_id, source, lang, n_chars and text (see `leaf_digest`). Leaves of one language
    stand by doc_id; every two neighbours become their digest (a last one alone its own), until one, the subroot,
    is left; subroots by language (null first, then by bytes) give the root alike. `siblings` are the digests
    next to the leaf's path from the leaf up, `sides` has a letter for each level (L or R for the sibling's side,
    - for none). `folded` is the root recomputed from the leaf, or, where `is_tampered`, from the digest of the
    columns `tampered`, and the siblings.

    A slot array reduces `levels` levels. Null ids come first in their language; rows with one id stand by their leaf digests, and equal rows each have
    a place. doc_id must be an integer. Empty input gives no rows; other columns are not read.
    """
    own = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("binary") if is_tampered is None else F.when(is_tampered, leaf_digest(tampered))
    doc_id = F.col("doc_id").cast("long")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        F.coalesce(F.shiftright(doc_id, CONTAINER_BITS), F.lit(NULL_CONTAINER)).alias("bucket"),
        F.coalesce(doc_id.bitwiseAND(F.lit((1 << CONTAINER_BITS) - 1)), F.lit(0)).cast("long").alias("bit"),
        leaf_digest(own).alias("leaf"), other.alias("tampered"))
    tiers = _climb(_coordinates(leaves), levels)
    trees = _in_order(_roots(tiers)).select(F.lit("").alias("tree"), "pos", F.col("subroot").alias("digest"), "total", "name")
    upper = _climb(trees, levels)
    root = _roots(upper).first()  # one digest
    last = F.lit(bytes(root.subroot) if root else None).cast("binary")
    start = upper[0].sparkSession.createDataFrame([("", "", b"")], "tree string, sides string, siblings binary")
    above = _descend(upper, start, levels).select(F.col("name").alias("tree"), "sides", "siblings", F.col("digest").alias("subroot"))
    rows = _descend(tiers, above, levels).withColumn("root", last)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    done = rows.mapInArrow(_fold_rows, f"{kinds}, folded binary")
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return done.select("doc_id", lang.alias("lang"), "pos", F.col("digest").alias("leaf"), "subroot", "root", "sides", "siblings", "folded")
