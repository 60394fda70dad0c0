"""Operator 12: exact top-k search by inner product in M-trees, best first.

A vector's components are turned into whole numbers, floor(`scale` * x).  One more component makes all
candidates equally long, and a query's is zero there; then the nearer of two candidates by
Euclidean distance is the one of the larger inner product, and metric bounds apply.

1. Routing objects of the root are chosen from a bounded sample (`sample` rows, `fan` objects): each the one farthest from those before.
   Every row goes to the nearest of them; their number is fixed, so that of their covering radii is too.
2. The rows of a routing object are dealt into blocks of about `block` rows by a hash, so a region may hold any share of all rows.
   Each block becomes an M-tree of pages: inner entries hold a routing object, its covering radius, its distance from the parent's object and
   its child; leaf entries their row and its distance from the parent's.  At once the block's own queries search it, which gives each a bar for its k-th score.
3. Queries, packed in chunks, go to the blocks of all regions that their bars don't rule out by covering radius, and search each tree
   best first: the node of the least possible distance is opened next, entries that stored distances rule out by the triangle inequality are not compared at all, and
   the search ends when no node can hold a better row.  Bounds are computed with room for rounding; scores are exact.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; shorter vectors are filled up with zeros, also
empty ones; scores beyond a long's range count as its end; ties go to the smaller id; a query with fewer candidates than k
has them all; rows that share an id count as one: that id's best row stands for it.  Blocks have fewer rows where vectors are longer.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept, partitions, small_batches, trimmed

#: Entries of a page.
PAGE = 64
#: Components in a block of rows or a chunk of queries.
ROOM = 1 << 20
#: Relative room for rounding in squared distances.
ROUNDING = 1e-11
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Space:
    """How the rows of one search are measured: size components, in units of 2**exponent, and the squared length of all candidates."""

    size: int
    exponent: int
    length2: float
    scale: int = 1024

    @property
    def exact(self) -> bool:
        """Whether inner products are whole numbers below 2**53, whatever the order of their sums."""
        return self.exponent < 400 and self.size * math.ldexp(1.0, 2 * self.exponent) < 2.0**53

    def measured(self, v: np.ndarray) -> np.ndarray:
        """The whole numbers of rows, in units of 2**exponent."""
        small = np.abs(v) < 2.0**60
        step = self.scale.bit_length() - 1
        whole = np.ldexp(np.floor(np.where(small, v, 0) * self.scale), -self.exponent)
        return np.where(small, whole, np.ldexp(v, step - self.exponent))

    def lifted(self, u: np.ndarray) -> np.ndarray:
        """Rows with the component that makes them equally long."""
        return np.column_stack((u, np.sqrt(np.maximum(self.length2 - np.einsum("ij,ij->i", u, u), 0))))

    def products(self, rows: np.ndarray, v: np.ndarray, u: np.ndarray, query: np.ndarray, query_u: np.ndarray) -> np.ndarray:
        """Exact inner products of v[rows] (u: the same, measured) with a query, within a long's range."""
        if self.exact:
            return np.rint(np.ldexp(u[rows, : self.size] @ query_u, 2 * self.exponent)).astype(np.int64)
        whole = lambda x: [int(c) * self.scale if abs(c) >= 2.0**53 else math.floor(c * self.scale) for c in x]
        asked = whole(query.tolist())
        return np.array([max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(asked, whole(x), strict=True)))) for x in v[rows].tolist()], np.int64)


def padded(vectors: pa.ListArray | pa.ChunkedArray, size: int) -> np.ndarray:
    """A matrix of the vectors, filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = np.zeros((len(vectors), size))
    out[np.arange(size) < vectors.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _distance(a: np.ndarray, b: np.ndarray, length2: float) -> np.ndarray:
    return np.sqrt(np.maximum(2 * length2 - 2 * (a @ b), 0))


class Tree:
    """An M-tree over lifted rows: nodes are ranges of entries, and leaves ranges of rows."""

    FIELDS = ("order", "begin", "end", "leaf", "object", "child", "radius", "parent", "row_parent")

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)

    @classmethod
    def built(cls, rows: np.ndarray, length2: float, page: int = PAGE) -> Tree:
        order: list[np.ndarray] = []
        held, row_parent = 0, np.zeros(len(rows))
        nodes: list[list] = []
        entries: list[tuple[int, int, float, float]] = []

        def grow(index: np.ndarray, centre: int) -> int:
            nonlocal held
            number = len(nodes)
            nodes.append([0, 0, True])
            far = _distance(rows[index], rows[centre], length2)
            if len(index) <= page:
                order.append(index)
                row_parent[held : held + len(index)] = far
                nodes[number] = [held, held + len(index), True]
                held += len(index)
                return number
            fan = min(page, max(2, math.ceil(2 * len(index) / page)))
            picks = index[np.linspace(0, len(index) - 1, fan).astype(int)]
            nearest = np.argmax(rows[index] @ rows[picks].T, axis=1)
            groups = [(p, index[nearest == i]) for i, p in enumerate(picks) if (nearest == i).any()]
            if max(len(g) for _, g in groups) > 0.9 * len(index):
                groups = [(g[len(g) // 2], g) for g in np.array_split(index[np.argsort(far, kind="stable")], fan)]
            made = []
            for pick, group in groups:
                radius = float(_distance(rows[group], rows[pick], length2).max())
                made.append((int(pick), grow(group, pick), radius, float(_distance(rows[pick][None], rows[centre], length2)[0])))
            nodes[number] = [len(entries), len(entries) + len(made), False]
            entries.extend(made)
            return number

        if len(rows):
            grow(np.arange(len(rows)), 0)
        order_of = np.concatenate(order) if order else np.zeros(0, int)
        place = np.empty(len(rows), np.int64)
        place[order_of] = np.arange(len(rows))
        begin, end, leaf = (np.array([n[i] for n in nodes], np.int64) for i in range(3))
        columns = list(zip(*entries, strict=True)) or [(), (), (), ()]
        return cls(
            order=order_of, begin=begin, end=end, leaf=leaf.astype(bool), object=place[np.array(columns[0], np.int64)], child=np.array(columns[1], np.int64),
            radius=np.array(columns[2], float), parent=np.array(columns[3], float), row_parent=row_parent,
        )

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def loaded(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as found:
            return cls(**{f: found[f] for f in cls.FIELDS})


class Block:
    """A tree with its rows, in the tree's order."""

    def __init__(self, space: Space, ids: np.ndarray, v: np.ndarray, tree: Tree):
        self.space, self.ids, self.v, self.tree = space, ids, v, tree
        self.u = space.lifted(space.measured(v))
        self.twins = len(ids) - len(np.unique(ids))
        #: Rows and routing objects compared by searches so far.
        self.compared = 0

    def search(self, query_id: int, query: np.ndarray, k: int, bar: int = -LONG - 1) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the rows that may be among the k best, best first, of no score under bar."""
        space, tree = self.space, self.tree
        spare = k + self.twins
        query_u = space.measured(query[None])[0]
        asked2 = float(query_u @ query_u)
        base = asked2 + space.length2
        room = 4 * math.sqrt(ROUNDING * base)

        def reach(score: int) -> float:
            return math.sqrt(max(base - 2 * math.ldexp(float(score), -2 * space.exponent), 0)) + room if score > -LONG - 1 else math.inf

        lifted = np.append(query_u, 0.0)
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        limit = reach(bar)
        heap = []
        if len(tree.begin):
            # The root's object is the row that came first.
            heap.append((0.0, 0, math.sqrt(max(base - 2 * float(self.u[tree.order.argmin()] @ lifted), 0))))
        while heap:
            least, node, far = heapq.heappop(heap)
            if least > limit:
                break
            a, b = int(tree.begin[node]), int(tree.end[node])
            if tree.leaf[node]:
                rows = slice(a, b)
                if limit < math.inf:
                    near = np.abs(far - tree.row_parent[a:b]) <= limit
                    if not near.all():
                        rows = a + np.flatnonzero(near)
                        if not len(rows):
                            continue
                got, own = space.products(rows, self.v, self.u, query, query_u), self.ids[rows]
                self.compared += len(got)
                fit = (got >= bar) & (own != query_id)
                if fit.any():
                    scores, ids = np.concatenate((scores, got[fit])), np.concatenate((ids, own[fit]))
                    best = np.lexsort((ids, np.invert(scores)))[:spare]
                    scores, ids = scores[best], ids[best]
                    if len(scores) == spare and scores[-1] > bar:
                        bar = int(scores[-1])
                        limit = reach(bar)
                continue
            entries = np.arange(a, b)
            if limit < math.inf:
                entries = entries[np.abs(far - tree.parent[a:b]) - tree.radius[a:b] <= limit]
            away = np.sqrt(np.maximum(base - 2 * (self.u[tree.object[entries]] @ lifted), 0))
            self.compared += len(entries)
            for entry, d in zip(entries.tolist(), away.tolist(), strict=True):
                low = max(d - float(tree.radius[entry]), least, 0.0)
                if low <= limit:
                    heapq.heappush(heap, (low, int(tree.child[entry]), d))
        return scores, ids


def routing_objects(rows: np.ndarray, count: int, length2: float) -> np.ndarray:
    """Of lifted rows, the first and then each time the one farthest from those taken, up to count different ones."""
    taken = [0]
    far = _distance(rows, rows[0], length2)
    while len(taken) < min(count, len(rows)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, _distance(rows, rows[taken[-1]], length2))
    return rows[taken]


def _distinct_bar(scores: np.ndarray, ids: np.ndarray, k: int) -> int:
    """The k-th score over different ids, best first, or a long's least where there are fewer."""
    _, first = np.unique(ids, return_index=True)
    found = np.sort(scores[first])[::-1]
    return int(found[k - 1]) if len(found) >= k else -LONG - 1


_FOUND = "query_id long, vec_id long, score long"


def top_products(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, block: int = 4096, fan: int = 64, sample: int = 4096, scale: int = 1024
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k other rows of the largest inner products with each row for which is_query holds.

    scale is a power of two.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    rows = rows.groupBy("vec_id", "v").agg(F.max("q").alias("q"))
    rows = kept(rows, "vectors")
    largest = F.array_max(F.transform("v", F.abs))
    n, nq, size, most = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v")), F.max(largest)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not nq:
        return spark.createDataFrame([], schema)
    space = Space(max(size, 1), max(math.frexp(most or 0.0)[1] + scale.bit_length(), 1), 0.0, scale)

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = space.measured(padded(batch["v"], space.size))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.einsum("ij,ij->i", u, u).max(initial=0))])], ["x"])

    length2 = rows.select("v").mapInArrow(trimmed(longest), "x double").agg(F.max("x")).first()[0]
    space = Space(space.size, space.exponent, length2 * (1 + 1e-12), scale)
    part = min(block, max(1, ROOM // space.size))

    share = min(1.0, sample / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("v").limit(min(2 * sample, max(1, 4 * ROOM // space.size))).collect()
    objects = routing_objects(space.lifted(space.measured(padded(pa.array([r[0] for r in drawn], pa.list_(pa.float64())), space.size))), fan, space.length2) if drawn else np.zeros((1, space.size + 1))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = space.lifted(space.measured(padded(batch["v"], space.size)))
                # Distances from objects that are no rows (where the sample is empty) are plain ones as well.
                away = np.sqrt(np.maximum(np.einsum("ij,ij->i", u, u)[:, None] + np.einsum("ij,ij->i", objects, objects) - 2 * u @ objects.T, 0))
                region = away.argmin(1)
                yield batch.append_column("region", pa.array(region, pa.int32())).append_column("away", pa.array(away[np.arange(len(u)), region]))

    assigned = kept(rows.mapInArrow(trimmed(routed), "vec_id long, v array<double>, q boolean, region int, away double"), "routed")
    # One row per routing object.
    regions = {r.region: (r.n, r.radius) for r in assigned.groupBy("region").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    parts = {r: max(1, math.ceil(count / part)) for r, (count, _) in regions.items()}
    offset, total = {}, 0
    for r in sorted(parts):
        offset[r], total = total, total + parts[r]
    dealt = F.create_map(*(F.lit(x) for r in sorted(parts) for x in (r, offset[r])))
    width = F.create_map(*(F.lit(x) for r in sorted(parts) for x in (r, parts[r])))
    numbered = assigned.withColumn("b", (dealt[F.col("region")] + F.pmod(F.xxhash64("vec_id", "v"), width[F.col("region")])).cast("int"))

    def planted(table: pa.Table) -> pa.Table:
        ids, own = table["vec_id"].to_numpy(), table["q"].to_numpy(zero_copy_only=False)
        data = padded(table["v"], space.size)
        tree = Tree.built(space.lifted(space.measured(data)), space.length2)
        ids, own, data = ids[tree.order], own[tree.order], data[tree.order]
        here = Block(space, ids, data, tree)
        asked, bars, found = np.flatnonzero(own), [], []
        for i in asked.tolist():
            scores, near = here.search(int(ids[i]), data[i], k)
            bars.append(_distinct_bar(scores, near, k))
            found.append([{"vec_id": int(x), "score": int(s)} for s, x in zip(scores, near, strict=True)])
        return pa.table({
            "b": pa.array([table["b"][0].as_py()], pa.int32()), "ids": [ids.tobytes()], "rows": [data.tobytes()], "tree": [tree.dumped()],
            "queries": pa.array([[{"query_id": int(ids[i]), "v": data[i].tobytes(), "bar": x, "found": f} for i, x, f in zip(asked.tolist(), bars, found, strict=True)]], _QUERIES),
        })

    def packed(table: pa.Table) -> pa.Table:
        ids, bars, data = table["query_id"].to_numpy(), table["bar"].to_numpy(), np.frombuffer(b"".join(table["v"].to_pylist())).reshape(-1, space.size)
        u = space.measured(data)
        asked2 = np.einsum("ij,ij->i", u, u)
        base = asked2 + space.length2
        reach = np.sqrt(np.maximum(base - 2 * np.ldexp(bars.astype(float), -2 * space.exponent), 0)) + 4 * np.sqrt(ROUNDING * base)
        reach[bars == -LONG - 1] = np.inf
        away = np.sqrt(np.maximum(asked2[:, None] + np.einsum("ij,ij->i", objects, objects) - 2 * np.column_stack((u, np.zeros(len(u)))) @ objects.T, 0))
        opened = [b for r, (_, radius) in regions.items() if (away[:, r] - radius <= reach).any() for b in range(offset[r], offset[r] + parts[r])]
        return pa.table({
            "query_ids": [ids.tobytes()], "asked": [data.tobytes()], "bars": [bars.tobytes()], "homes": [table["home"].to_numpy().astype(np.int32).tobytes()], "opened": pa.array([opened], pa.list_(pa.int32())),
        })

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                here = Block(space, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"]).reshape(-1, space.size), Tree.loaded(row["tree"]))
                asked = np.frombuffer(row["asked"]).reshape(-1, space.size)
                bars, homes = np.frombuffer(row["bars"], np.int64), np.frombuffer(row["homes"], np.int32)
                out = [[], [], []]
                for i, query_id in enumerate(np.frombuffer(row["query_ids"], np.int64).tolist()):
                    if homes[i] != row["b"]:
                        scores, near = here.search(query_id, asked[i], k, int(bars[i]))
                        out[0].append(np.full(len(near), query_id))
                        out[1].append(near)
                        out[2].append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    with small_batches(spark, 4):
        blocks = kept(numbered.drop("region", "away").groupBy("b").applyInArrow(planted, f"b int, ids binary, rows binary, tree binary, queries {_QUERIES_SQL}"), "metric-blocks")
        queries = blocks.select(F.col("b").alias("home"), F.explode("queries").alias("x")).select("home", "x.query_id", "x.v", "x.bar", "x.found")
        chunk = F.pmod(F.xxhash64("query_id", "v"), F.lit(max(1, math.ceil(nq / min(1024, part)))))
        chunks = queries.drop("found").groupBy(chunk.alias("c")).applyInArrow(packed, "query_ids binary, asked binary, bars binary, homes binary, opened array<int>")
        chunks = chunks.select("query_ids", "asked", "bars", "homes", F.explode("opened").alias("b"))
        spread = partitions(spark)
        met = chunks.repartition(spread, "b").join(blocks.select("b", "ids", "rows", "tree").repartition(spread, "b").hint("merge"), "b")
        others = kept(met.mapInArrow(trimmed(searched), _FOUND), "metric-found")
    own = queries.select("query_id", F.explode("found").alias("x")).select("query_id", "x.vec_id", "x.score")
    merged = own.union(others).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_QUERIES = pa.list_(pa.struct([("query_id", pa.int64()), ("v", pa.binary()), ("bar", pa.int64()), ("found", pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())])))]))
_QUERIES_SQL = "array<struct<query_id: bigint, v: binary, bar: bigint, found: array<struct<vec_id: bigint, score: bigint>>>>"
