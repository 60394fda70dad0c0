"""Operator 13: a Merkle manifest of a dataset, with every row's authentication path.

Rows are leaves, ordered within their group by a key; while a tree has several nodes, every two
consecutive ones (at the end, maybe one) become their hash.  The groups' roots, in
order of the groups' names, are the leaves of one tree above them.

1. Leaves are sorted by range over the whole table and written with their place; a place less the first one of the
   partition, plus the rows of the group in partitions before, is a leaf's number.  So no group is sorted or numbered in one task.
2. `2 ** bits` aligned leaves form a block.  Within a block authentication paths come leaf by leaf by the classic Merkle traversal:
   for each height one treehash instance, of a stack of at most that height, gets two steps per leaf and has the
   height's next node ready when it is due.  What a block keeps of the tree is the path and these stacks.
3. The blocks' roots are the leaves of the same work one story up, until a tree has one block; then
   each block's path is appended to those of its leaves, and that of a group's root to those of its rows.

Digests are lower-case hexadecimal SHA-256, of texts put together.  A path is an array of (side, sibling): L or R
where the sibling stands, and a null side and sibling where a node has none and is hashed alone.

Defined results: a null group is a group of its own, before all others; rows of a null key come first in their group; rows of one key are ordered by their
leaf, and equal rows are several leaves; a lone leaf is its tree's root; a group or key of any type is ordered as its kind is,
groups as text by bytes; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept

#: Rows of a table up to which it is broadcast to a join.
FEW = 50_000

_STEP = "array<struct<side: string, sibling: string>>"
_ARROW_STEP = pa.list_(pa.struct([("side", pa.string()), ("sibling", pa.string())]))


def digest_of(*columns: str | Column) -> Column:
    """The hash of columns put together: `-` for a null, else the count of UTF-8 bytes, a colon, and the value as text."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    step = lambda node, s: F.when(s["side"] == "L", F.concat(s["sibling"], node)).when(s["side"] == "R", F.concat(node, s["sibling"])).otherwise(node)
    return F.aggregate(path, leaf, lambda node, s: F.sha2(step(node, s), 256))


def _parent(left: str | None, right: str | None) -> str | None:
    """The hash above two nodes, of which the right one or both may lie behind the end."""
    return None if left is None else hashlib.sha256((left + (right or "")).encode()).hexdigest()


class Treehash:
    """Works out one node of a height above consecutive leaves, a step at a time, with a stack of at most height + 1 nodes."""

    def __init__(self, leaves: Sequence[str], first: int, height: int):
        self.leaves, self.next, self.height, self.stack = leaves, first, height, []

    @property
    def done(self) -> bool:
        return len(self.stack) == 1 and self.stack[0][0] == self.height

    def step(self) -> None:
        if self.done:
            return
        if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            height, right = self.stack.pop()
            self.stack[-1] = (height + 1, _parent(self.stack[-1][1], right))
        else:
            self.stack.append((0, self.leaves[self.next] if self.next < len(self.leaves) else None))
            self.next += 1


def traverse(leaves: Sequence[str], height: int) -> Iterator[list[str | None]]:
    """Yields the root of a tree of a height and then, leaf by leaf, the siblings from the leaf up (None: there is none)."""
    whole, first = Treehash(leaves, 0, height), {}
    while not whole.done:
        whole.step()
        if whole.stack:
            at, node = whole.stack[-1]
            place = (whole.next >> at) - 1
            if place < 2:
                first.setdefault((at, place), node)
    yield [whole.stack[0][1]]
    path = [first[h, 1] for h in range(height)]
    ready: list[Treehash] = []
    for h in range(height):
        ready.append(Treehash(leaves, 0, h))
        ready[h].stack = [(h, first[h, 0])]
    for leaf in range(len(leaves)):
        yield list(path)
        for h in range(height):
            if (leaf + 1) % (1 << h):
                break
            path[h] = ready[h].stack[0][1]
            ready[h] = Treehash(leaves, (leaf + 1 + (1 << h)) ^ (1 << h), h)
        for instance in ready:
            instance.step()
            instance.step()


def _block(bits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        leaves, total = table["d"].to_pylist(), table["n"][0].as_py()
        height = bits if total > 1 << bits else (total - 1).bit_length()
        walk = traverse(leaves, height)
        top = next(walk)[0]
        paths = [
            [{"side": None if s is None else "L" if i >> h & 1 else "R", "sibling": s} for h, s in enumerate(path)] for i, path in enumerate(walk)
        ]
        return table.append_column("path", pa.array(paths, _ARROW_STEP)).append_column("top", pa.array([top] * len(leaves), pa.string()))

    return run


def _joined(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    right = F.broadcast(right) if right.count() <= FEW else right.hint("merge")
    return left.join(right, on, "left")


def _climb(leaves: DataFrame, most: int, bits: int) -> DataFrame:
    """Adds path and top to leaves (g, i, n, d, ...): the i-th of the n leaves of tree g, trees having up to `most`."""
    size = 1 << bits
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in leaves.schema)}, path {_STEP}, top string"
    low = leaves.withColumn("b", F.expr(f"i >> {bits}")).groupBy("g", "b").applyInArrow(_block(bits), schema.replace(", path ", ", b bigint, path "))
    low = kept(low, "merkle-paths")
    if most <= size:
        return low.drop("b")
    roots = low.where((F.col("n") > size) & (F.col("i") % size == 0))
    above = _climb(roots.select("g", F.col("b").alias("i"), F.expr(f"(n + {size - 1}) >> {bits}").alias("n"), F.col("top").alias("d")), -(-most // size), bits)
    above = above.select(F.col("g").alias("_g"), F.col("i").alias("_b"), F.col("path").alias("_path"), F.col("top").alias("_top"))
    both = _joined(low, above, (F.col("g") == F.col("_g")) & (F.col("b") == F.col("_b")))
    both = both.withColumns({"path": F.concat("path", F.coalesce("_path", F.array().cast(_STEP))), "top": F.coalesce("_top", "top")})
    return both.drop("b", "_g", "_b", "_path", "_top")


def _numbered(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Leaves (g, k, d, ...) with i and n, their number in order of k and d within g and the leaves of g; and the largest n."""
    # Equal leaves may stand in any order, so they are dealt out by their place in the input.
    placed = leaves.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange("g", "k", "d", "_at").sortWithinPartitions("g", "k", "d", "_at")
    placed = kept(placed.withColumn("_at", F.monotonically_increasing_id()), "merkle-leaves")
    pieces = placed.groupBy("g", F.expr("_at >> 33").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    pieces = kept(pieces, "merkle-pieces")
    # One row per partition of a group, so this window holds as many rows as there are partitions.
    before = F.expr("coalesce(sum(_n) OVER (PARTITION BY g ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    starts = pieces.select(F.col("g").alias("_g"), F.col("_p").alias("_q"), (before - F.col("_first")).alias("_shift"), F.expr("sum(_n) OVER (PARTITION BY g)").alias("n"))
    most = starts.agg(F.max("n")).first()[0] or 0
    both = _joined(placed, starts, (F.col("g") == F.col("_g")) & (F.expr("_at >> 33") == F.col("_q")))
    return both.withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_g", "_q", "_shift"), most


def manifest(leaves: DataFrame, *, key_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf", bits: int = 10) -> DataFrame:
    """The columns of leaves, and (subroot, root, path) of each row; columns of these names are replaced."""
    names = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    group = F.col(group_col).cast("string")
    # A null group sorts before all others, whose names start with a later sign.
    inner = leaves.select(F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("g"), F.col(key_col).alias("k"), F.col(leaf_col).alias("d"), F.struct(*names).alias("row"))
    numbered, most = _numbered(inner)
    rows = _climb(numbered, most, bits).withColumnRenamed("top", "subroot")
    subroots = rows.where("i = 0").select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("subroot").alias("d"))
    tree, most = _numbered(subroots)
    upper = _climb(tree, most, bits).select(F.col("k").alias("_k"), F.col("path").alias("_path"), F.col("top").alias("root"))
    out = _joined(rows, upper, F.col("g") == F.col("_k"))
    return out.select("row.*", "subroot", "root", F.concat("path", "_path").alias("path"))


def verify(manifested: DataFrame, *, leaf: Column, path_col: str = "path", root_col: str = "root") -> DataFrame:
    """Adds folded_root, which `leaf` and the row's path lead to, and verified, whether that is the root."""
    out = manifested.withColumn("folded_root", fold(leaf, F.col(path_col)))
    return out.withColumn("verified", F.col("folded_root") == F.col(root_col))


def siblings_digest(path: Column) -> Column:
    """The hash of a path's siblings, from the leaf up."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: s["sibling"])), 256)
