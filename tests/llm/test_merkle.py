import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from weekcast.llm.merkle import fold, leaf_digest, manifest, reduce_block

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, total long, leaf string, sides int"
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spell(row, more=0):
    i, source, lang, n, text = row
    values = [i, source, lang, None if n is None else n + more, text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, at):
    return [((at >> k) & 1, level[(at >> k) ^ 1] if (at >> k) ^ 1 < len(level) else None) for k, level in enumerate(tree[:-1])]


def brute(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of each row, sorted."""
    if not rows:
        return []
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {l: sorted((r for r in rows if r[2] == l), key=lambda r: (r[0] is not None, r[0] or 0, spell(r))) for l in langs}
    trees = {l: levels([spell(r) for r in own[l]]) for l in langs}
    top = levels([trees[l][-1][0] for l in langs])
    out = []
    for k, l in enumerate(langs):
        for at, row in enumerate(own[l]):
            steps = path(trees[l], at) + path(top, k)
            h = spell(row, 1 if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 else 0)
            for odd, sibling in steps:
                h = H(h) if sibling is None else H(sibling, h) if odd else H(h, sibling)
            out.append((row[0], spell(row), trees[l][-1][0], top[-1][0], H("".join(s for _, s in steps if s)), h))
    return sorted(out, key=str)


def result(spark, rows, partitions=3, **options):
    changed = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars").cast("decimal(20,0)") + 1, F.col("text")]
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(partitions)
    found = manifest(df, changed, seventh, **options).collect()
    text = lambda b: bytes(b).hex()
    return sorted(((r.doc_id, text(r.leaf), text(r.subroot), text(r.root), H(text(r.siblings)), text(r.folded)) for r in found), key=str)


def test_edge_rows(spark):
    rows = [(i, f"s{i % 3}", ["en", "de", None, "", "é"][i % 5], i, "word " * (i % 7)) for i in range(60)]
    rows += [(70, None, None, None, None), (71, "", "en", None, ""), (-5, "a", "en", -1, "ü" * 3), (1 << 62, "a", "en", 2**63 - 1, "x"), (-(1 << 63), "a", "de", 0, "x"), (75, "s", "en", 1, "long " * 400000)]
    assert result(spark, rows) == brute(rows)


def test_repeated_ids_and_rows(spark):
    rows = [(3, "s", "en", 1, f"t{i}") for i in range(9)] + [(3, "s", "en", 1, "t0")] * 4 + [(1, "s", "en", 1, "a")] * 3 + [(None, "s", "en", 1, "n")] * 2 + [(None, None, "en", None, "m"), (9, "s", "en", 2, "z")]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_few_leaves(spark, n):
    rows = [(i * 40000, "s", "en", 1, str(i)) for i in range(n)]
    assert result(spark, rows) == brute(rows)


def test_empty(spark):
    assert result(spark, []) == []


def test_many_tiers(spark):
    rows = [(i * 7919 % 100003, "s", "en" if i % 3 else "de", i, str(i)) for i in range(150)] + [(i, "s", f"l{i}", 1, "x") for i in range(40)]
    assert result(spark, rows, levels=2) == brute(rows)


def test_block_and_fold():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    root, sides, siblings = reduce_block(leaves, 11)
    assert root.hex() == levels([x.hex() for x in leaves])[-1][0]
    assert all(fold(x, s, b) == root for x, s, b in zip(leaves, sides, siblings))
    assert fold(leaves[0], sides[1], siblings[1]) != root


def test_leaf_spelling(spark):
    row = spark.sql("select 12L as a, cast(null as string) as b, 'é' as c").select(leaf_digest([F.col("a"), F.col("b"), F.col("c")]).alias("d")).first()
    assert bytes(row.d).hex() == H("2:12-2:é")
