"""Operator 11: maximal runs of words in texts, by branching tandem repeats of suffix trees, and texts with each run cut to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at least `min_length` words and
`min_exponent` periods, that no neighbouring word extends keeping the period.

Texts are read whole, many short ones or one long one at a time.  The words of a text get numbers of its own, so that
no stretch of one text equals one of another.

1. Suffixes are sorted by doubling prefixes.  Only groups that may still hold a run are sorted on: every word of a run, and every stretch of one period in it,
   occurs at least as often as the run has whole periods, so groups of fewer suffixes stay as they are, bundles of leaves.
2. Longest common prefixes of neighbours, read from the groups of each doubling, give the suffix tree's inner nodes: stretches
   of sorted suffixes with a depth, and the largest child of each.
3. For each node of depth d, the leaf lists of all children but the largest are gone through (so a leaf is met at most a logarithmic number
   of times): a leaf i whose partner i + d (or i - d) is below the node too begins (or ends) a tandem repeat of period d, branching where the word after it ends the period.
4. Branching repeats of too few periods, or of a period that is a multiple of a run's around them, go; each other one is rotated to the left, word by word, as far as it goes, which
   merges all rotations of one run.

Defined results: a null text, or one without words, has no words and no runs, and collapses to an empty text; words are compared as
they are, capital letters included; work is near-linear in the words of a text whatever its runs, and memory is that of one
text (or `BATCH` words) times a small factor.  Columns named n_words, runs or collapsed are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, trimmed

#: Words that are worked on at once, where a text isn't longer by itself; and pairs of leaves and nodes.
BATCH, PAIRS = 1 << 18, 1 << 21

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
_ARROW_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than 0x20 and 0x09 to 0x0D, which are the white space of bytes."""
    return text.split()


def numbers(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, different in different texts, and each text's first word."""
    fresh = count()
    codes: list[int] = []
    first = [0]
    for words in texts:
        codes.extend(map(defaultdict(fresh.__next__).__getitem__, words))
        first.append(len(codes))
    return np.array(codes, np.int64), np.array(first, np.int64)


def sorted_suffixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in groups of common prefixes, and the longest common prefix of each with the one before.

    Prefixes of fewer than `least` (at least 2) occurrences are told from others, but not sorted further: within such a group the common prefix is given as
    -1, and suffixes whose first word is as rare don't appear at all.
    """
    total = len(codes)
    often = np.bincount(codes, minlength=1) >= least
    order = np.flatnonzero(often[codes]) if total else np.zeros(0, np.int64)
    order = order[np.argsort(codes[order], kind="stable")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = codes[order[1:]] != codes[order[:-1]]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    # Rare words stand for themselves only, and so does the end.
    rank = np.arange(total, 2 * total + 1)
    rank[order] = begin
    split = np.where(fresh, 0, -1)
    active = np.arange(len(order))
    levels, length = [(order.astype(np.int32), begin.astype(np.int32))], 1
    while len(active):
        here = order[active]
        key = rank[here] * (2 * total + 1) + rank[np.minimum(here + length, total)]
        turn = np.argsort(key, kind="stable")
        here, key = here[turn], key[turn]
        order[active] = here
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        split[active[new & (split[active] < 0)]] = length
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(active)))
        rank[here] = np.repeat(active[start], sizes)
        stay = np.repeat(sizes >= least, sizes)
        active, length = active[stay], 2 * length
        if len(active):
            levels.append((order[active].astype(np.int32), rank[order[active]].astype(np.int32)))
    # A common prefix is at least as long as the one of the step that split two suffixes; what is left is read from the steps before, longest first.
    more = np.flatnonzero(split > 1)
    known = split[more]
    left, right = order[more - 1] + known, order[more] + known
    table = np.full(total + 1, -1, np.int32)
    for level in range(len(levels) - 1, -1, -1):
        where, group = levels.pop()
        table[:] = -1
        table[where] = group
        may = np.flatnonzero(known > 1 << level)
        same = may[(table[left[may]] >= 0) & (table[left[may]] == table[right[may]])]
        left[same] += 1 << level
        right[same] += 1 << level
    common = split
    common[more] = left - order[more - 1]
    return order, common


def inner_nodes(common: np.ndarray, least: int) -> np.ndarray:
    """(depth, first, last, first and last of the largest child) of the suffix tree's inner nodes of at least `least` leaves.

    A node without a child of that many has an empty range before its first leaf as the largest one.
    """
    bounds = np.flatnonzero(common >= 0)
    out: list[tuple[int, int, int, int, int]] = []
    depths, firsts, lows, highs = [0], [0], [0], [-1]
    before = 0
    for at, depth in zip([*bounds[1:].tolist(), len(common)], [*common[bounds[1:]].tolist(), 0], strict=True):
        first = before
        low, high = first, first - 1
        while depth < depths[-1]:
            own, first, low, high = depths.pop(), firsts.pop(), lows.pop(), highs.pop()
            if at - first >= least:
                out.append((own, first, at - 1, low, high))
                low, high = first, at - 1
            else:
                low, high = first, first - 1
            if depth <= depths[-1] and high - low > highs[-1] - lows[-1]:
                lows[-1], highs[-1] = low, high
        if depth > depths[-1]:
            depths.append(depth)
            firsts.append(first)
            lows.append(low)
            highs.append(high)
        before = at
    return np.array(out, np.int64).reshape(-1, 5)


def branching_repeats(codes: np.ndarray, order: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandem repeats at nodes, from the leaf lists of all children but the largest."""
    total = len(codes)
    slot = np.full(total + 1, -1, np.int64)
    slot[order] = np.arange(len(order))
    after = np.append(codes, -1)
    depth, first, last, low, high = nodes.T
    begins = np.stack((first, high + 1), 1).ravel()
    sizes = np.stack((low - first, last - high), 1).ravel()
    owner = np.repeat(np.arange(len(nodes)), 2)
    done = np.concatenate(([0], np.cumsum(sizes)))
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, "right")) - 1)
        part = sizes[a:b]
        leaf = order[np.arange(done[b] - done[a]) + np.repeat(begins[a:b] - (done[a:b] - done[a]), part)]
        node = np.repeat(owner[a:b], part)
        for begin, partner in ((leaf, leaf + depth[node]), (leaf - depth[node], leaf - depth[node])):
            ok = (begin >= 0) & (partner < total)
            below = slot[np.where(ok, partner, total)]
            ok &= (below >= first[node]) & (below <= last[node])
            i, q = begin[ok], depth[node[ok]]
            branching = after[i + q] != after[np.minimum(i + 2 * q, total)]
            starts.append(i[branching])
            periods.append(q[branching])
        a = b
    return np.concatenate(starts), np.concatenate(periods)


def _rotated(codes: np.ndarray, start: int, period: int) -> int:
    """The first word of the run whose last tandem repeat begins at start."""
    step = 16
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(codes[low:start] != codes[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 2 * step
    return 0


def runs_of(codes: np.ndarray, first: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows (text, start in the text, length, period) of all texts' runs, in this order of columns by text, start and period."""
    least = max(2, min_exponent)
    order, common = sorted_suffixes(codes, least)
    nodes = inner_nodes(common, least)
    if len(nodes):
        # A run of the node's depth has to fit into its text.
        text = np.searchsorted(first, order[nodes[:, 1]], "right") - 1
        nodes = nodes[nodes[:, 0] * min_exponent <= first[text + 1] - first[text]]
    if not len(nodes):
        return np.zeros((0, 4), np.int64)
    start, period = branching_repeats(codes, order, nodes)
    need = np.maximum(min_length, min_exponent * period) - 2 * period
    ok = start >= need
    ok[ok] = codes[(start - need)[ok]] == codes[(start - need + period)[ok]]
    back = np.maximum(start - 1, 0)
    ok &= (need <= 0) | (codes[back] == codes[back + period])
    start, period = start[ok], period[ok]
    ends: dict[int, list[tuple[int, int]]] = {}
    found = set()
    for k in np.lexsort((period, start + 2 * period)).tolist():
        i, q = int(start[k]), int(period[k])
        known = ends.setdefault(i + 2 * q, [])
        # A repeat of whole periods of a run that covers it is that run again.
        if any(q % p == 0 and s <= i for p, s in known):
            continue
        s = _rotated(codes, i, q)
        known.append((q, s))
        if i + 2 * q - s >= max(min_length, min_exponent * q):
            text = int(np.searchsorted(first, s, "right")) - 1
            found.add((text, s - int(first[text]), i + 2 * q - s, q))
    rows = np.array(sorted(found), np.int64).reshape(-1, 4)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed(words: Sequence[bytes], runs: np.ndarray) -> bytes:
    """The words, one space between them, without those that a run (start, length, period) holds after its first period."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def _batched(texts: Sequence[bytes | None]) -> Iterator[list[list[bytes]]]:
    held, total = [], 0
    for text in texts:
        words = words_of(text or b"")
        if held and total + len(words) > BATCH:
            yield held
            held, total = [], 0
        held.append(words)
        total += len(words)
    if held:
        yield held


def collapse_runs(docs: DataFrame, *, text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """docs with n_words, runs (of start, length and period in words, by start and period) and collapsed, the text with each run cut to its first period."""
    bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    raw = docs.select(*others, F.col(text_col).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, short = [], [], []
            for texts in _batched(batch["_text"].to_pylist()):
                codes, first = numbers(texts)
                rows = runs_of(codes, first, min_length, min_exponent)
                bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
                for words, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
                    sizes.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in rows[a:b, 1:].tolist()])
                    short.append(collapsed(words, rows[a:b, 1:]))
            new = [pa.array(sizes, pa.int64()), pa.array(found, _ARROW_RUN), pa.array(short, pa.binary()).cast(pa.string())]
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_text"]
            yield pa.RecordBatch.from_arrays(kept + new, [*others, "n_words", "runs", "collapsed"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in raw.schema if f.name != "_text")
    return raw.mapInArrow(trimmed(run), f"{schema}n_words bigint, runs {RUN}, collapsed string")


def strongest(runs: Column) -> Column:
    """Of runs, the one of the most periods, exactly; then of the smallest start, then of the smallest period; null if there are none."""
    more = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    better = lambda a, b: F.when(a.isNull() | (more(b, a) > 0), b).when(more(b, a) < 0, a).when((b["start"] < a["start"]) | (b["start"] == a["start"]) & (b["period"] < a["period"]), b).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
