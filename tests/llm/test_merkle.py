"""The Merkle manifest against plain trees, its traversal, and odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else None)
        i //= 2
    return out


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 13, 16])
def test_traversal_gives_every_path_in_turn(count):
    leaves = [h(str(i)) for i in range(count)]
    levels = plain_levels(leaves)
    walk = merkle.traverse(leaves, len(levels) - 1)
    assert next(walk) == [levels[-1][0]]
    assert list(walk) == [plain_path(levels, i) for i in range(count)]


def test_traversal_holds_few_nodes():
    leaves = [h(str(i)) for i in range(1024)]
    most = 0
    stacks = []
    real = merkle.Treehash.step

    def step(self):
        nonlocal most
        real(self)
        stacks.append(len(self.stack))
        most = max(most, len(self.stack))

    merkle.Treehash.step = step
    try:
        assert len(list(merkle.traverse(leaves, 10))) == 1025
    finally:
        merkle.Treehash.step = real
    # No stack holds more than one node a height, and an instance takes two steps a leaf.
    assert most <= 12 and len(stacks) <= 2 * 10 * 1024 + 4096


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_against_plain_trees(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "a", "a", "b", "é", "", "-"]), f"t{rng.randrange(60)}") for _ in range(90)] + [(7, "a", "same")] * 9
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("subroot", F.lit("clash")).withColumn("i", F.lit("clash"))
    leaves = df.withColumn("leaf", merkle.digest_of("doc_id", "text"))
    out = merkle.verify(merkle.manifest(leaves, bits=bits), leaf=F.col("leaf")).withColumn("proof", merkle.siblings_digest(F.col("path"))).collect()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for key, lang, text in rows:
        groups.setdefault(lang, []).append((key is not None, key or 0, h(field(key) + field(text)), key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names])
    want = []
    for place, g in enumerate(names):
        for i, (_, _, leaf, key) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = plain_path(trees[g], i) + plain_path(top, place)
            want.append((str(key), str(g), leaf, trees[g][-1][0], top[-1][0], h("".join(s for s in path if s)), top[-1][0], True))
    got = [(str(r.doc_id), str(r.lang), r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in out]
    assert sorted(got) == sorted(want) and {r.i for r in out} == {"clash"}


def test_changed_leaf_is_not_verified(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    held = F.when(F.col("doc_id") == 5, F.sha2(F.lit("other"), 256)).otherwise(F.col("leaf"))
    out = {r.doc_id: r.verified for r in merkle.verify(merkle.manifest(df, bits=2), leaf=held).collect()}
    assert out == {i: i != 5 for i in range(20)}


def test_manifest_of_no_rows_and_of_one(spark):
    df = spark.createDataFrame([(1, None, "x" * 64)], "doc_id long, lang string, leaf string")
    one = merkle.manifest(df).first()
    assert (one.subroot, one.root, one.path) == ("x" * 64, "x" * 64, [])
    assert merkle.manifest(df.limit(0)).count() == 0


def test_digest_of_nulls_and_bytes(spark):
    row = spark.createDataFrame([(None, "é:1")], "a long, b string").select(merkle.digest_of("a", "b").alias("d")).first()
    assert row.d == h("-4:é:1")
