"""Operator 8: passages that repeat across documents, found by chaining shared k-mer seeds.

1. Each text gives seeds: of every `window` neighbouring k-mers of words the one of least hash, so any
   run of window + k - 1 words that two texts share holds a common seed.
2. A seed's first occurrence, by document id and place, stands for all others: each other
   document's occurrence is matched with it, and with that of the document before it among the seed's holders, so matches grow with the texts and not with
   pairs of documents.  Seeds that are frequent within one batch send only their first
   occurrence there on, and the others are matched by a join, which splits hot seeds.
3. The matches of a document with one source are chained in order of both texts: a chain scores
   `k` for each match and pays for the words skipped in either text.  The best
   predecessor of a match is found by prefix maxima in a Fenwick tree over the source's places.
4. Chains are aligned: along each diagonal by words, between diagonals at the cut with the most
   equal words, and outwards while that gains.  Alignments of `min_words` words and more
   and the identity asked for are passages.
5. Earlier documents may hold a passage's seeds singly, so that its first occurrence as a whole is nobody's
   first.  So runs of `min_words` words that lie in no passage yet are taken as seeds themselves, at every
   place: each is matched with its first occurrence, chained and aligned.  Hence every run of
   `min_words` words that an earlier document holds word for word is in a passage.  For edited
   passages that isn't certain: of a seed's later holders only neighbours are compared with each other, and none of frequent seeds, so two edited
   copies may be missed where the documents between them hold many of their seeds singly, too.

Words are those of `text.words`.  Defined results: null, empty and short texts have no
passages; rows with a null id take no part; rows that share an id count as one document,
whose texts aren't compared with each other; repeats within a document aren't told; extra columns are not read.
Offsets are numbers of words, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import bound_batches, dropped, kept, partitions

#: Occurrences of a seed in one batch from which only the first is sent on, and seeds a reducing group holds.
FREQUENT, GROUP_SEEDS = 48, 600_000
#: What a chain pays for each word skipped in either text, and the most that an alignment's end loses.
GAP_COST, DROP = 0.1, 8
#: Words to which the regions fetched for aligning are rounded, so that chains share them.
REGION = 64
_EMITTED = "g int, keys binary, docs binary, pos binary, flags binary, seed long, doc long, at int"


def seeds(hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the seeds of one text's words."""
    if len(hashes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs, _ = tx.shingle_hashes(hashes, np.array([0, len(hashes)]), k)
    span = min(window, len(runs))
    least = np.lib.stride_tricks.sliding_window_view(runs, span).min(1)
    edge = np.zeros(span - 1, np.uint64)
    most = np.lib.stride_tricks.sliding_window_view(np.concatenate((edge, least, edge)), span).max(1)
    at = np.flatnonzero(runs == most)
    return at, runs[at]


def whole_runs(hashes: np.ndarray, shared: list[int], k: int, window: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the runs of min_words words that another text may hold word for word: all seeds that such a text must share are shared."""
    if len(hashes) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = min(k, min_words)
    runs, _ = tx.shingle_hashes(hashes, np.array([0, len(hashes)]), k)
    inside = min_words - k - window + 2
    if inside < 1:
        at = np.arange(len(hashes) - min_words + 1)
    else:
        places = np.array(shared, np.int64)
        good = np.isin(np.lib.stride_tricks.sliding_window_view(runs, window).min(1), runs[places[places < len(runs)]])
        total = np.concatenate(([0], np.cumsum(good)))
        at = np.flatnonzero(total[inside:] - total[:-inside] == inside)
    value = np.zeros(len(at), np.uint64)
    for step in (*range(0, min_words - k, k), min_words - k):
        value = tx.mix(value + runs[at + step])
    return at, value


def _emit(k: int, window: int, groups: int, min_words: int = 0):
    """Packed seeds by group, and rows of the occurrences that a batch holds back; with min_words those of whole runs, for rows (doc, text, shared, spans)."""
    names = ["g", "keys", "docs", "pos", "flags", "seed", "doc", "at"]

    def flush(held):
        key, doc, pos, told = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pos, doc, key))
        key, doc, pos, told = key[order], doc[order], pos[order], told[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        often = np.repeat(size >= FREQUENT, size)
        back = often.copy()
        back[start] = False
        sent, back = ~back, back & ~told
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(int(back.sum()), pa.int32())] + [pa.nulls(int(back.sum()), pa.binary())] * 4 + [pa.array(key[back].view(np.int64)), pa.array(doc[back]), pa.array(pos[back])], names=names
        )
        key, doc, pos, flag = key[sent], doc[sent], pos[sent], (often[sent] + 2 * told[sent]).astype(np.int8)
        group = (tx.mix(key) % np.uint64(groups)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
        bounds = np.append(cuts, len(order))
        packed = [pa.array([c[order[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for c in (key, doc, pos, flag)]
        yield pa.RecordBatch.from_arrays([pa.array(group[order][cuts]), *packed] + [pa.nulls(len(cuts), t) for t in (pa.int64(), pa.int64(), pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            shared, spans = (batch.column(c).to_pylist() for c in (2, 3)) if min_words else (None, None)
            for at, part in tx.slices(batch.column(1).to_pylist()):
                hashes, first, _, _ = tx.words(part)
                for t in range(len(part)):
                    own = hashes[first[t] : first[t + 1]]
                    place, value = whole_runs(own, shared[at + t], k, window, min_words) if min_words else seeds(own, k, window)
                    if len(place):
                        told = np.zeros(len(place), bool)
                        for span in (spans[at + t] or []) if min_words else []:
                            told |= (place >= span["start"]) & (place + min_words <= span["end"])
                        held.append((value, np.full(len(place), ids[at + t], np.int64), place.astype(np.int32), told))
                        total += len(place)
                if total > 1_000_000:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return run


def _match(frame, previous: bool = False):
    """Matches (doc, src, x, y) of one group of seeds, rows (seed, src, y) for seeds that were held back, and rows (doc, x) of the first holder's other places.

    With previous, occurrences are also matched with the first place in the document before theirs among the seed's holders.
    """
    import pandas as pd

    key, doc, pos, flag = (np.concatenate([np.frombuffer(v, t) for v in frame[c]]) for c, t in (("keys", np.uint64), ("docs", np.int64), ("pos", np.int32), ("flags", np.int8)))
    order = np.lexsort((pos, doc, key))
    key, doc, pos, flag = key[order], doc[order], pos[order], flag[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    head = np.repeat(start, size)
    own = doc == doc[head]
    other = ~own & (flag < 2)
    often = np.maximum.reduceat(flag & 1, start) > 0
    told = start[often]
    again = own & (np.arange(len(key)) != head) & np.repeat(often | (np.add.reduceat(~own, start) > 0), size)
    pairs = pd.DataFrame({"seed": None, "doc": doc[other], "src": doc[head][other], "x": pos[other], "y": pos[head][other]})
    if previous:
        holder = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
        before = np.repeat(np.concatenate(([0], holder[:-1])), np.diff(np.append(holder, len(key))))
        # Seeds that many documents of a batch hold are left to their first holder, which sends the others there.
        more = other & (before != head) & np.repeat(~often, size)
        nearer = pd.DataFrame({"seed": None, "doc": doc[more], "src": doc[before][more], "x": pos[more], "y": pos[before][more]})
        pairs = pd.concat([pairs, nearer]) if len(nearer) else pairs
    heads = pd.DataFrame({"seed": key[told].view(np.int64), "doc": None, "src": doc[told], "x": None, "y": pos[told]})
    places = pd.DataFrame({"seed": None, "doc": doc[again], "src": None, "x": pos[again], "y": None})
    return pd.concat([p.astype("Int64") for p in (pairs, heads, places) if len(p)] or [pairs.astype("Int64")])


def chains(x: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray]:
    """Chains of matches, best first, each as indices in order; every match is in one chain at most."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    if len(x) > 1 and (np.diff(x) > 0).all() and (np.diff(y) > 0).all():
        # All matches are in order, so only steps that cost more than a match brings divide them.
        far = np.flatnonzero(GAP_COST * (np.diff(x) + np.diff(y)) >= k) + 1
        return sorted((order[c] for c in np.split(np.arange(len(x)), far)), key=len, reverse=True)
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max())
    tree: list[tuple[float, int]] = [(-math.inf, -1)] * (size + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    xs, ys, rs = x.tolist(), y.tolist(), ranks.tolist()
    at = 0
    while at < len(xs):
        last = at
        while last < len(xs) and xs[last] == xs[at]:  # matches of one place don't follow each other
            best, r = (-math.inf, -1), rs[last] - 1
            while r > 0:
                best = max(best, tree[r])
                r &= r - 1
            gained = best[0] - GAP_COST * (xs[last] + ys[last])
            score[last] = k + max(gained, 0.0)
            before[last] = best[1] if gained > 0 else -1
            last += 1
        for m in range(at, last):
            entry, r = (score[m] + GAP_COST * (xs[m] + ys[m]), m), rs[m]
            while r <= size:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        at = last
    used, out = [False] * len(xs), []
    for end in sorted(range(len(xs)), key=lambda m: (-score[m], m)):
        chain, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = before[m]
        if chain:
            out.append(order[chain[::-1]])
    return out


def _reach(equal: np.ndarray) -> int:
    """How many places of an end to take: up to where equal words less unequal ones are most, before they fall too low."""
    if not len(equal):
        return 0
    total = np.cumsum(np.where(equal, 1, -1))
    low = np.flatnonzero(total < np.maximum.accumulate(total) - DROP)
    total = total[: low[0]] if len(low) else total
    best = int(total.argmax())
    return best + 1 if total[best] > 0 else 0


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[int, int, int, int, int]:
    """(a start, a end, b start, b end, equal words) of the alignment of words a and b along the matches (x, y) of a chain."""
    diagonal = y - x
    turns = np.flatnonzero(np.diff(diagonal)) + 1
    firsts, lasts = np.concatenate(([0], turns)), np.append(turns, len(x)) - 1
    d = diagonal[firsts].tolist()
    left, right = x[firsts].tolist(), (x[lasts] + k).tolist()
    n = min(left[0], left[0] + d[0])
    back = _reach((a[left[0] - n : left[0]] == b[left[0] + d[0] - n : left[0] + d[0]])[::-1])
    n = min(len(a) - right[-1], len(b) - right[-1] - d[-1])
    ahead = _reach(a[right[-1] : right[-1] + n] == b[right[-1] + d[-1] : right[-1] + d[-1] + n])
    start, end, equal = left[0] - back, right[-1] + ahead, 0
    here = start
    for run in range(len(d)):
        if run == len(d) - 1:
            equal += int((a[here:end] == b[here + d[run] : end + d[run]]).sum())
            break
        # The next diagonal begins somewhere between this one's last match and its own first.
        low, high = right[run], max(right[run], left[run + 1])
        stop = min(high, len(b) - d[run], len(a))
        old = np.zeros(high - low, bool)
        if stop > low:
            old[: stop - low] = a[low:stop] == b[low + d[run] : stop + d[run]]
        shift = max(0, d[run] - d[run + 1])  # words of b aren't used twice
        new = a[low:high] == b[low + d[run + 1] : high + d[run + 1]] if low + d[run + 1] >= 0 else np.zeros(high - low, bool)
        gain = np.concatenate(([0], np.cumsum(old))) + np.concatenate((np.cumsum(new[::-1])[::-1], [0]))
        cut = low + int(gain[: max(1, high - low + 1 - shift)].argmax())
        equal += int((a[here:cut] == b[here + d[run] : cut + d[run]]).sum())
        here = min(cut + shift, end)
    return start, end, start + d[0], end + d[-1], equal


def _chain_rows(k: int, least: int):
    """Chains of sorted rows (doc, src, x, y), as rows with the chain's matches; rows of one pair may span batches."""
    names = ["doc", "src", "xs", "ys", "a0", "a1", "b0", "b1"]

    def of(doc: int, src: int, x: np.ndarray, y: np.ndarray) -> list[tuple]:
        out = []
        for c in chains(x, y, k):
            cx, cy = x[c], y[c]
            if cx[-1] - cx[0] + k >= least:
                out.append((doc, src, cx.astype(np.int32).tobytes(), cy.astype(np.int32).tobytes(), int(cx[0]), int(cx[-1]) + k, int(cy[0]), int(cy[-1]) + k))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int32()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def groups(part: list[np.ndarray], cuts: np.ndarray) -> list[tuple]:
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows += of(int(part[0][a]), int(part[1][a]), part[2][a:b], part[3][a:b])
            return rows

        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                part = [np.concatenate(p) for p in zip(rest, part, strict=True)]
            if not len(part[0]):
                continue
            change = np.flatnonzero((np.diff(part[0]) != 0) | (np.diff(part[1]) != 0)) + 1
            cuts = np.concatenate(([0], change)).astype(np.int64)
            yield batch_of(groups(part, cuts))
            rest = [p[cuts[-1] :] for p in part]
        if rest is not None and len(rest[0]):
            yield batch_of(groups(rest, np.array([0, len(rest[0])])))

    return run


def _region_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words of regions, for rows (doc, text, [regions])."""
    for batch in batches:
        ids, texts, asked = (batch.column(i).to_pylist() for i in range(3))
        for at, part in tx.slices(texts):
            hashes, first, _, _ = tx.words(part)
            rows = []
            for t in range(len(part)):
                own = (hashes[first[t] : first[t + 1]] >> np.uint64(32)).astype(np.uint32)
                rows += [(ids[at + t], r["lo"], r["hi"], own[r["lo"] : r["hi"]].tobytes()) for r in asked[at + t]]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["doc", "lo", "hi", "words"])


def _align_rows(k: int, min_words: int, identity: float):
    names = ["doc_id", "start", "end", "src_doc_id", "src_start", "src_end", "n_equal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, src, xs, ys, alo, blo, aw, bw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(aw, np.uint32), np.frombuffer(bw, np.uint32)
                x, y = np.frombuffer(xs, np.int32).astype(np.int64) - alo, np.frombuffer(ys, np.int32).astype(np.int64) - blo
                if x[-1] + k > len(a) or y[-1] + k > len(b):
                    continue  # another text of the same id
                a0, a1, b0, b1, equal = align(a, b, x, y, k)
                if a1 - a0 >= min_words and equal >= identity * max(a1 - a0, b1 - b0):
                    rows.append((doc, a0 + alo, a1 + alo, src, b0 + blo, b1 + blo, equal))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, identity: float = 0.75, k: int = 8, window: int = 12) -> DataFrame:
    """(doc_id, start, end, src_doc_id, src_start, src_end, n_equal) of passages that an earlier document holds too."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(partitions(spark), math.ceil(size / 6 * 2 / (window + 1) / GROUP_SEEDS))
    emitted = kept(docs.mapInArrow(_emit(k, window, groups), _EMITTED), "seeds")
    found, matches = _stars(emitted, previous=True)
    # What may be missing of a passage at both ends of its chain.
    passages = kept(_passages(docs, matches, k, max(k, min_words - 2 * (window + k)), min_words, identity), "passages")

    places = matches.select("doc", "x").union(matches.select("src", "y")).union(found.where("seed IS NULL AND src IS NULL").select("doc", "x"))
    places = places.union(emitted.where("g IS NULL").select("doc", "at")).distinct().groupBy("doc").agg(F.collect_list("x").alias("shared"))
    # A passage doesn't tell which text of an id it is in.
    single = docs.groupBy("doc").count().where("count > 1").select("doc")
    spans = passages.select(F.col("doc_id").alias("doc"), "start", "end").join(single, "doc", "left_anti").groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    asked = places.join(spans, "doc", "left")
    runs = docs.join(asked.hint("merge"), "doc").select("doc", "text", "shared", "spans")
    whole = kept(runs.mapInArrow(_emit(k, window, groups, min_words), _EMITTED), "runs")
    dropped(emitted, found)
    found, matches = _stars(whole)
    more = kept(_passages(docs, matches, min_words, min_words, min_words, identity), "passages")
    dropped(whole, found)
    return passages.union(more).distinct()


def _stars(emitted: DataFrame, previous: bool = False) -> tuple[DataFrame, DataFrame]:
    """What _match finds, and the matches of each seed's occurrences with its first one (and with those of the holder before)."""
    packed = emitted.where("g IS NOT NULL").select("g", "keys", "docs", "pos", "flags")
    found = kept(packed.groupBy("g").applyInPandas(lambda frame: _match(frame, previous), "seed long, doc long, src long, x int, y int"), "matches")
    back = emitted.where("g IS NULL").select("seed", "doc", F.col("at").alias("x"))
    heads = found.where("seed IS NOT NULL").select("seed", "src", "y")
    late = back.join(heads.hint("merge"), "seed").where("doc <> src").select("doc", "src", "x", "y")
    return found, found.where("seed IS NULL AND src IS NOT NULL").select("doc", "src", "x", "y").union(late)


def _passages(docs: DataFrame, matches: DataFrame, k: int, least: int, min_words: int, identity: float) -> DataFrame:
    """Passages along the chains of matches of k words."""
    spark = docs.sparkSession
    ordered = matches.repartition(partitions(spark), "doc", "src").sortWithinPartitions("doc", "src", "x", "y")
    chained = kept(ordered.mapInArrow(_chain_rows(k, least), "doc long, src long, xs binary, ys binary, a0 int, a1 int, b0 int, b1 int"), "chains")

    margin = REGION // 2
    low = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - margin) / REGION) * REGION).cast("int")
    high = lambda c: (F.ceil((F.col(c) + margin) / REGION) * REGION).cast("int")
    chained = chained.withColumns({"alo": low("a0"), "ahi": high("a1"), "blo": low("b0"), "bhi": high("b1")})
    regions = chained.select("doc", F.col("alo").alias("lo"), F.col("ahi").alias("hi")).union(chained.select("src", "blo", "bhi")).distinct()
    asked = regions.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("regions"))
    parts = kept(docs.join(asked.hint("merge"), "doc").select("doc", "text", "regions").mapInArrow(_region_words, "doc long, lo int, hi int, words binary"), "regions")
    side = lambda d, lo, hi, w: parts.select(F.col("doc").alias(d), F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("words").alias(w))
    full = chained.join(side("doc", "alo", "ahi", "aw").hint("merge"), ["doc", "alo", "ahi"]).join(side("src", "blo", "bhi", "bw").hint("merge"), ["src", "blo", "bhi"])
    aligned = full.select("doc", "src", "xs", "ys", "alo", "blo", "aw", "bw").mapInArrow(
        _align_rows(k, min_words, identity), "doc_id long, start long, end long, src_doc_id long, src_start long, src_end long, n_equal long"
    )
    return aligned.distinct()
