"""Operator 6: nearest neighbours by cosine over randomly rotated one-bit codes.

Every vector is scaled to length 1, its offset from a centre is rotated at random, and only
the signs of the result are kept, packed into words, with two correction
scalars: the offset's length and the inner product of the rotated unit offset with its code.
A query's rotated components are rounded to `LEVELS` bits, so that its inner product with a code is a
weighted count of the bits that the code has in common with each bit plane.  From these
counts the inner product of the query with the offset is estimated without bias; the estimate's error is bounded
by a known multiple of a standard deviation, plus all that rounding can add.  Within each block of vectors
a query's best estimates are computed exactly, and then all vectors whose upper bound reaches the k-th of
those; of the blocks' best the engine keeps k rows for a query before it shuffles them.

The centre is fitted on a bounded sample (`sample`); every vector is indexed.
Queries and vectors meet in blocks of at most about `block` rows each, by a key of
both block numbers, so no task holds more than two blocks.

Defined results: vectors that are null, zero or hold null or non-finite components take
no part, nor do rows with a null id, nor vectors whose length isn't the most usual
one; components of any finite size are fine, as vectors are scaled by a power of two first; ties go to the
smaller id; a query with fewer candidates than k has them all;
rows that share an id count as one: that id's best row stands for it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many standard deviations the error bounds of the estimates span, and the bits of a rounded query component.
ERROR_WIDTH, LEVELS = 2.2, 6
#: Vectors with the best estimates, whose cosines set the bar for all others.
FIRST = 32
#: Candidates beyond k, by a fast sum, whose cosines are then taken in the order of components.
SPARE = 8


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A random rotation: the orthogonal factor of a matrix of normal variates."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors, each times the power of two that brings its largest component between a half and one; cosines stay the same."""
    _, exponent = np.frexp(np.abs(vectors).max(1, keepdims=True, initial=0))
    half = -exponent // 2
    return np.ldexp(np.ldexp(vectors, half), -exponent - half)


def units(vectors: np.ndarray) -> np.ndarray:
    own = scaled(vectors)
    return own / np.linalg.norm(own, axis=1, keepdims=True)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into whole 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def codes(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated offsets, the offsets' lengths, and unit offsets' products with their codes."""
    offset = (units(vectors) - centre) @ turn
    length = np.linalg.norm(offset, axis=1)
    along = np.abs(offset).sum(1) / math.sqrt(vectors.shape[1]) / np.where(length > 0, length, 1)
    return _words(offset > 0), length, np.where(length > 0, along, 1.0)


def estimates(queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, packed: np.ndarray, length: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (query, vector) from the codes, and half the width of their error bounds."""
    size = queries.shape[1]
    unit = units(queries)
    turned = unit @ turn
    low = turned.min(1, keepdims=True)
    step = np.maximum(turned.max(1, keepdims=True) - low, 1e-300) / ((1 << LEVELS) - 1)
    rounded = np.rint((turned - low) / step).astype(np.int64)
    lost = np.linalg.norm(turned - (low + step * rounded), axis=1, keepdims=True)
    ones = np.bitwise_count(packed).sum(1, dtype=np.int64)
    common = np.zeros((len(queries), len(packed)), np.int32)
    for level in range(LEVELS):
        plane = _words(rounded >> level & 1)
        for w in range(packed.shape[1]):
            common += np.bitwise_count(plane[:, w, None] & packed[None, :, w]).astype(np.int32) << level
    # The rounded query's sum over the code's ones, less that over its zeros.
    signed = 2 * (low * ones + step * common) - (low * size + step * rounded.sum(1, keepdims=True))
    scale = length / along / math.sqrt(size)
    slack = length * np.sqrt(np.maximum(1 - along**2, 0) / np.maximum(along, 1e-9) ** 2 / max(size - 1, 1))
    return signed * scale + (unit @ centre)[:, None], ERROR_WIDTH * slack * np.linalg.norm(turned, axis=1)[:, None] + lost * length / along


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of scaled vectors, with sums taken in the order of the components."""
    dot, left, right = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for i in range(x.shape[1]):
        dot += x[:, i] * y[:, i]
        left += x[:, i] * x[:, i]
        right += y[:, i] * y[:, i]
    return dot / np.sqrt(left * right)


def _usable(column: str) -> Column:
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block: int = 4096, sample: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other vectors of each row for which is_query holds."""
    rows = vectors.where(F.col(id_col).isNotNull() & _usable(vector_col)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    counts = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if counts is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size, n, nq = counts
    rows = rows.where(F.size("v") == size)
    share = min(1.0, sample / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("v").limit(2 * sample).collect()
    some = np.array([r[0] for r in drawn])
    centre = units(some).mean(0) if drawn else np.zeros(size)
    turn = rotation(size)

    def index(frames):
        for frame in frames:
            if len(frame):
                packed, length, along = codes(np.stack(frame["v"].to_numpy()), centre, turn)
                yield frame.assign(code=[p.tobytes() for p in packed], length=length, along=along)[["vec_id", "v", "code", "length", "along", "b"]]

    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(nq / block))
    spread = F.xxhash64("vec_id", F.hash("v"))
    indexed = rows.select("vec_id", "v", F.pmod(spread, F.lit(blocks)).cast("int").alias("b")).mapInPandas(
        index, "vec_id long, v array<double>, code binary, length double, along double, b int"
    )
    indexed = indexed.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.where("q").select("vec_id", "v", F.pmod(spread, F.lit(query_blocks)).cast("int").alias("a"))
    queries = queries.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left, right):
        import pandas as pd

        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, found = right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy())
            _, once = np.unique(np.column_stack((ids, found.view(np.int64))), axis=0, return_index=True)
            right, ids, found = right.iloc[once], ids[once], scaled(found[once])
            spare = k + len(ids) - len(np.unique(ids))  # rows of one id don't crowd out others
            packed = np.stack([np.frombuffer(c, np.uint64) for c in right["code"]])
            unit = found / np.linalg.norm(found, axis=1, keepdims=True)
            query_ids, asked = left["vec_id"].to_numpy(), scaled(np.stack(left["v"].to_numpy()))
            for at in range(0, len(asked), 256):
                part, part_ids = asked[at : at + 256], query_ids[at : at + 256]
                guess, slack = estimates(part, centre, turn, packed, right["length"].to_numpy(), right["along"].to_numpy())
                other = part_ids[:, None] != ids
                unit_part = part / np.linalg.norm(part, axis=1, keepdims=True)
                bar = np.full(len(part), -np.inf)
                if len(ids) > spare + FIRST:
                    lead = np.argpartition(np.where(other, guess, -np.inf), -spare - FIRST, axis=1)[:, -spare - FIRST :]
                    seen = np.einsum("qd,qnd->qn", unit_part, unit[lead])
                    seen[~np.take_along_axis(other, lead, 1)] = -np.inf
                    bar = np.partition(seen, -spare, axis=1)[:, -spare] - 1e-9
                hit, cand = np.nonzero(other & (guess + slack >= bar[:, None]))
                near = np.concatenate([np.einsum("ij,ij->i", unit_part[hit[a : a + 65536]], unit[cand[a : a + 65536]]) for a in range(0, len(hit), 65536)] or [np.zeros(0)])
                order = np.lexsort((-near, hit))
                hit, cand = hit[order], cand[order]
                begin = np.searchsorted(hit, np.arange(len(part)))
                few = np.arange(len(hit)) - begin[hit] < spare + SPARE
                hit, cand = hit[few], cand[few]
                exact = cosine(part[hit], found[cand])
                order = np.lexsort((ids[cand], -exact, hit))
                hit, cand, exact = hit[order], cand[order], exact[order]
                begin = np.searchsorted(hit, np.arange(len(part)))
                best = np.arange(len(hit)) - begin[hit] < spare
                out["query_id"].append(part_ids[hit[best]])
                out["vec_id"].append(ids[cand[best]])
                out["score"].append(exact[best])
        return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in out.items()})

    met = queries.groupBy("a", "b").cogroup(indexed.groupBy("a", "b")).applyInPandas(search, "query_id long, vec_id long, score double")
    merged = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
