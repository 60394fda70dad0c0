"""Operator 1: size-aware heavy-light join of documents by n-gram Jaccard similarity.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` over their sets of
distinct word shingles.  The join is exact and has these steps.

1. One scan hashes every text's set, gives texts with equal sets one *class*
   (a 64-bit key of the set), and counts all shingles of all documents in a
   sketch of fixed size, so that the global order of shingles puts frequent ones last.
2. A second scan writes postings.  With threshold t, two sets that link share
   one of their first ``n - ceil(t n) + 1`` shingles in that order, and two of their
   first ``n - ceil(t n) + 2``.  *Small* sets (up to a boundary) enumerate all
   2-subsets of the latter; *large* sets post single shingles to inverted
   lists, which small sets near the boundary also enter.  The boundary is the
   one of least cost under the corpus' histogram of set sizes.
3. Each list is scanned once.  Short lists give all pairs that pass the size
   and position filters; long ones give pairs with one pivot, the set in which the key
   stands first, and keep their entries for step 5.  Lists of very frequent keys are salted and their pivots joined.
4. Every class is compared with the partner it shares most keys with: first by counts of
   hashes per range, which bound the overlap, then exactly.  The links are resolved to groups.
5. Whatever pairs remain between *different* groups, of short and of long lists
   alike, are compared too, and the groups are resolved again.  So a link
   is only left out if its ends are known to be in one group already.

Defined results: a text that is null, empty or without words has an empty set,
``n_shingles`` 0 and links with nothing; a text with fewer words than the width
has its whole sequence as its only shingle; repeated rows come out repeated,
in one group; rows that share an id count as one document, joined by the links of
all their texts; a null id stays null and never names a group, and a class that has
no other id takes no part; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import bound_batches, components, dropped, give_back, kept, partitions, trimmed

#: Counters of the shingle sketch (a fixed size) and the counters a row carries.
SKETCH_BITS = 20
CHUNK = 1 << 14
#: Lists up to this length give all their pairs at once.
SHORT_LIST = 24
#: Entries of a frequent key that go to one salt.
SALT_ENTRIES = 4096
#: Postings that one reducing group holds in memory.
GROUP_POSTINGS = 600_000

#: Classes whose texts are fetched by broadcasting their ids; more are fetched by a merge join.
FEW_IDS = 200_000

_SCAN = "doc_id long, n long, ck long, bins binary, chunk int, at binary, counts binary"
_FOUND = "kind int, key long, a long, b long, n int, pos int, shared int"


def need(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n with anything it links with."""
    return -(-percent * n // 100)


def class_key(hashes: np.ndarray) -> int:
    """A 64-bit key of a set of hashes."""
    if not len(hashes):
        return 0
    total = int(np.add.reduce(tx.mix(hashes), dtype=np.uint64)) ^ (len(hashes) * 0x9E3779B97F4A7C15 % (1 << 64))
    return int(tx.mix(np.array([total], np.uint64)).view(np.int64)[0])


def bins_of(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of 2**k equal ranges, about half as many ranges as hashes."""
    k = max(3, int(len(hashes)).bit_length() - 2)
    return np.minimum(np.bincount((hashes >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """No two sets with these bins share more: a range shares the lesser count at most (255 may stand for any more)."""
    if len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = y.reshape(len(x), -1)
        full = (y == 255).any(1)
        y = np.where(full, 255, np.minimum(y.sum(1, dtype=np.int64), 255))
    low = np.minimum(x, y)
    return 1 << 62 if (low == 255).any() else int(low.sum(dtype=np.int64))


def _likely(percent: int):
    """Keeps the pairs whose bins allow the overlap that they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                over = -(-percent * (na + nb) // (100 + percent))
                keep.append(overlap_bound(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) >= over)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    return run


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            n, ck, bins = [], [], []
            for _, part in tx.slices(batch.column(1).to_pylist()):
                sets = tx.sets_of_shingles(part, width)
                n += [len(s) for s in sets]
                ck += [class_key(s) for s in sets]
                bins += [bins_of(s).tobytes() for s in sets]
                if sets and (all_hashes := np.concatenate(sets)).size:
                    counts += np.bincount(all_hashes >> np.uint64(64 - SKETCH_BITS), minlength=len(counts)).astype(np.uint32)
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ck, pa.int64(), mask=np.array(n) == 0) if size else pa.array([], pa.int64()),
                 pa.array(bins, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary())],
                names=["doc_id", "n", "ck", "bins", "chunk", "at", "counts"],
            )
        for k in range(len(counts) // CHUNK):
            part = counts[k * CHUNK : (k + 1) * CHUNK]
            at = np.flatnonzero(part).astype(np.uint16)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())],
                    names=["doc_id", "n", "ck", "bins", "chunk", "at", "counts"],
                )

    return run


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per chunk, holding one array for each chunk and no rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, at, counts in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
            total = sums.setdefault(chunk, np.zeros(CHUNK, np.uint64))
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.uint32 if len(counts) == 2 * len(at) else np.uint64)
    for chunk, total in sums.items():
        at = np.flatnonzero(total).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], names=["chunk", "at", "counts"]
        )


def _levels(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each counter, the frequency level (0 unless clearly frequent) and the salts of its keys."""
    parts = rows.select("chunk", "at", "counts", F.pmod(F.xxhash64("at", "counts"), F.lit(16)).alias("salt"))
    schema = "chunk int, at binary, counts binary"
    some = parts.repartition(partitions(rows.sparkSession), "chunk", "salt").select("chunk", "at", "counts").mapInArrow(_add_sketches, schema)
    counts = np.zeros(1 << SKETCH_BITS, np.uint64)
    for chunk, at, sums in some.repartition(partitions(rows.sparkSession), "chunk").mapInArrow(_add_sketches, schema).collect():
        counts[chunk * CHUNK + np.frombuffer(at, np.uint16).astype(np.int64)] = np.frombuffer(sums, np.uint64)
    mean = float(np.median(counts))
    floor = mean + 6 * math.sqrt(mean) + 32
    over = np.maximum(counts / floor, 1)
    return np.where(counts > floor, 1 + np.floor(np.log2(over)), 0).clip(0, 31).astype(np.uint8), np.ceil(np.maximum(counts - mean, 1) / SALT_ENTRIES).clip(1, 2**31).astype(np.int64)


def boundary(sizes: dict[int, int], percent: int, list_length: float) -> int:
    """The largest size of a small set, for the least number of postings and list entries scanned."""
    small = lambda n: math.comb(min(n, n - need(n, percent) + 2), 2)
    large = lambda n: (n - need(n, percent) + 1) * (1 + list_length)
    best = {}
    for b in range(1, 65):
        near = need(b + 1, percent)
        best[b] = sum(c * (small(n) + (large(n) if n >= near else 0) if n <= b else large(n)) for n, c in sizes.items())
    return min(best, key=lambda b: (best[b], b))


def _postings(width: int, percent: int, level: np.ndarray, salts: np.ndarray, limit: int, groups: int):
    """Packed postings: one row for each batch and group, with the arrays of its entries."""
    near = need(limit + 1, percent)

    def entries(part: list[bytes]):
        sets = tx.sets_of_shingles(part, width)
        sizes = np.array([len(s) for s in sets])
        cks = np.array([class_key(s) for s in sets], np.int64)
        _, one = np.unique(cks, return_index=True)  # one text of each class
        one = one[sizes[one] > 0]
        if not len(one):
            return None
        sizes, cks = sizes[one], cks[one]
        hashes = np.concatenate([sets[i] for i in one])
        doc = np.repeat(np.arange(len(one)), sizes)
        at = (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        token = (level[at].astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6))
        order = np.lexsort((token, doc))
        token, at = token[order], at[order]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        pos = np.arange(len(token)) - np.repeat(begin[:-1], sizes)
        first = (pos < np.repeat(sizes - need(sizes, percent) + 1, sizes)) & np.repeat(sizes >= near, sizes)
        keys, docs, where, kinds, salted = [token[first]], [doc[first]], [pos[first]], [np.repeat(np.where(sizes > limit, 1, 2), sizes)[first]], [salts[at[first]]]
        for n in range(2, limit + 1):
            own = np.flatnonzero(sizes == n)
            if len(own):
                i, j = np.triu_indices(min(n, n - need(n, percent) + 2), 1)
                low, high = begin[own][:, None] + i, begin[own][:, None] + j
                keys.append((tx.mix(token[low]) * np.uint64(0xA0761D6478BD642F) + token[high]).ravel())
                docs.append(np.repeat(own, len(i)))
                where.append(np.tile(i, len(own)))
                kinds.append(np.zeros(len(own) * len(i), np.int64))
                salted.append(np.minimum(salts[at[low]], salts[at[high]]).ravel())
        keys, docs, where, kinds, salted = (np.concatenate(x) for x in (keys, docs, where, kinds, salted))
        keys = tx.mix(keys ^ np.where(kinds == 0, np.uint64(0x5851F42D4C957F2D), np.uint64(0)))
        ck = cks[docs]
        salt = (tx.mix(ck.view(np.uint64)) >> np.uint64(20)).astype(np.int64) % salted
        group = (tx.mix(keys + salt.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        return group, keys, ck, sizes[docs].astype(np.int32), where.astype(np.int32), (kinds + 4 * (salted > 1)).astype(np.int8)

    def flush(held):
        group, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
        bounds = np.append(cuts, len(order))
        columns = [c[order] for c in columns]
        return pa.RecordBatch.from_arrays(
            [pa.array(group[order][cuts], pa.int32())] + [pa.array([c[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for c in columns],
            names=["g", "keys", "ck", "n", "pos", "kind"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for _, part in tx.slices(batch.column(0).to_pylist()):
                if (got := entries(part)) is not None and len(got[0]):
                    held.append(got)
                    total += len(got[0])
                if total > 1_500_000:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    return run


def _scan_lists(percent: int):
    """Pairs and long lists of one group of postings."""

    def run(frame):
        import pandas as pd

        give_back()
        key, ck, n, pos, kind = (np.concatenate([np.frombuffer(x, t) for x in frame[c]]) for c, t in (("keys", np.uint64), ("ck", np.int64), ("n", np.int32), ("pos", np.int32), ("kind", np.int8)))
        order = np.lexsort((ck, pos, key))  # a list's pivot has the fewest rarer shingles, as an original has beside its edited copies
        key, ck, n, pos, kind = key[order], ck[order], n[order], pos[order], kind[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (ck[1:] != ck[:-1])))
        key, ck, n, pos, kind = key[fresh], ck[fresh], n[fresh], pos[fresh], kind[fresh]
        salted, kind = kind >= 4, kind & 3
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))

        def passes(i, j):
            over = -(-percent * (n[i].astype(np.int64) + n[j]) // (100 + percent))
            return (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= over) & (np.minimum(n[i], n[j]) >= over) & ((kind[i] != 2) | (kind[j] != 2))

        left, right = [], []
        for m in np.unique(size[(size > 1) & (size <= SHORT_LIST)]):
            i, j = np.triu_indices(int(m), 1)
            at = start[size == m][:, None]
            i, j = (at + i).ravel(), (at + j).ravel()
            ok = passes(i, j)
            left.append(i[ok])
            right.append(j[ok])
        large = np.add.reduceat(kind != 2, start) > 0
        spans = (size > SHORT_LIST) & large
        own = np.repeat(spans, size)
        head = np.repeat(start, size)
        i, j = head[own], np.flatnonzero(own)
        star = (i != j) & passes(i, j)
        left, right = np.concatenate([*left, i[star]]).astype(np.int64), np.concatenate([*right, j[star]]).astype(np.int64)
        pairs = pd.DataFrame({"a": np.minimum(ck[left], ck[right]), "b": np.maximum(ck[left], ck[right])}).groupby(["a", "b"], sort=False).size().reset_index(name="shared")
        parts = [pairs.assign(kind=0, key=None, n=None, pos=None)]
        stay = own | salted  # the large sets of a key may all be in its other salts
        parts.append(pd.DataFrame({"kind": 1 + kind[stay].astype(np.int32), "key": key[stay].view(np.int64), "a": ck[stay], "b": None, "n": n[stay], "pos": pos[stay], "shared": None}))
        heads = start[salted[start]]
        parts.append(pd.DataFrame({"kind": 9, "key": key[heads].view(np.int64), "a": ck[heads], "b": None, "n": n[heads], "pos": pos[heads], "shared": None}))
        columns = ["kind", "key", "a", "b", "n", "pos", "shared"]
        whole = pd.concat([p[columns].astype("Int64") for p in parts if len(p)] or [parts[0][columns].astype("Int64")])
        return whole

    return run


def _verify(width: int, percent: int):
    def linked(rows: list[dict]) -> list[bool]:
        out = []
        sets = []
        for _, part in tx.slices([t for r in rows for t in (r["ta"], r["tb"])]):
            sets += tx.sets_of_shingles(part, width)
        for row, a, b in zip(rows, sets[::2], sets[1::2], strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both) and class_key(a) == row["a"] and class_key(b) == row["b"])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                mask = pa.array(linked(part.to_pylist()), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; see the module for the method and the defined results."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scan = kept(docs.mapInArrow(trimmed(_scan(width)), _SCAN), "sets")
    rows = scan.where("chunk IS NULL").select("doc_id", "n", "ck")
    classes = kept(
        scan.where("n > 0").groupBy("ck").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.any_value("bins").alias("bins")).where("rep IS NOT NULL"), "classes"
    )
    level, salts = _levels(scan.where("chunk IS NOT NULL").select("chunk", "at", "counts"))
    sizes = {r["n"]: r["count"] for r in classes.where("n <= 64").groupBy("n").count().collect()}
    limit = boundary(sizes, percent, 2.0)
    total = classes.agg(F.sum("n")).first()[0] or 0
    groups = max(partitions(spark), math.ceil(total * (102 - percent) / 100 / GROUP_POSTINGS))
    packed = docs.select("text").mapInArrow(trimmed(_postings(width, percent, level, salts, limit, groups)), "g int, keys binary, ck binary, n binary, pos binary, kind binary")
    found = kept(packed.groupBy("g").applyInPandas(_scan_lists(percent), _FOUND), "found")

    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    heads = found.where("kind = 9").select("key", "a", "pos")
    chosen = heads.groupBy("key").agg(F.min_by("a", F.struct("pos", "a")).alias("b"))
    joined = heads.join(chosen, "key").where("a <> b").select("a", "b").distinct()
    # Each class with the one it shares most keys with, and the pivots of one salted list.
    both = pairs.union(pairs.select("b", "a", "shared"))
    best = both.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).union(joined.select("a", "b"))
    first = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def links(candidates: DataFrame, name: str) -> DataFrame:
        """The pairs of ids of those candidates that link."""
        side = lambda x: classes.select(F.col("ck").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins{x}"))
        likely = candidates.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "binsa", "binsb").mapInArrow(trimmed(_likely(percent)), "a long, b long")
        rep = lambda x: classes.select(F.col("ck").alias(x), F.col("rep").alias(f"r{x}"))
        likely = kept(likely.join(rep("a"), "a").join(rep("b"), "b").select("a", "b", "ra", "rb"), "likely")
        ids = likely.select(F.col("ra").alias("id")).union(likely.select(F.col("rb").alias("id"))).distinct()
        ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids.hint("merge")
        texts = kept(docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), "texts")
        text = lambda x: texts.select(F.col("doc_id").alias(f"r{x}"), F.col("text").alias(f"t{x}"))
        full = likely.join(text("a"), "ra").join(text("b"), "rb").select("ra", "rb", "a", "b", "ta", "tb")
        found = kept(full.mapInArrow(trimmed(_verify(width, percent)), "a long, b long").distinct(), name)
        dropped(likely, texts)
        return found

    sure = links(first, "links")
    group = kept(components(sure), "groups")
    known = classes.join(group.select(F.col("id").alias("rep"), "component"), "rep", "left").select("ck", F.coalesce("component", "rep").alias("c"))
    ends = lambda df: df.join(known.select(F.col("ck").alias("a"), F.col("c").alias("ca")), "a").join(known.select(F.col("ck").alias("b"), F.col("c").alias("cb")), "b").where("ca <> cb")
    rest = ends(pairs.select("a", "b")).select("a", "b")
    lists = found.where("kind BETWEEN 1 AND 3").join(known.select(F.col("ck").alias("a"), "c"), "a")
    mixed = lists.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("kind").alias("kind")).where("low < high AND kind < 3").select("key")
    lists = kept(lists.join(mixed, "key", "left_semi").select("key", "kind", "a", "n", "pos", "c"), "lists")
    far = lists.alias("x").join(lists.alias("y"), F.expr(
        f"x.key = y.key AND x.c < y.c AND NOT (x.kind = 3 AND y.kind = 3) AND least(x.n - x.pos, y.n - y.pos) >= ceil({percent} * (x.n + y.n) / {100 + percent})"
    )).select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b"))
    rest_of_all = kept(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(far).distinct(), "rest")
    dropped(found, lists)
    if not rest_of_all.isEmpty():
        more = links(rest_of_all, "links")
        if not more.isEmpty():
            group = kept(components(sure.union(more)), "groups")
    named = classes.join(group.select(F.col("id").alias("rep"), "component"), "rep", "left").select("ck", F.coalesce("component", "rep").alias("component_id"))
    full = rows.where("n > 0").join(named.hint("merge"), "ck", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
