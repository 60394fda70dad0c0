"""Operator 10: unigram segmentation into the pieces of a SentencePiece model, and back.

A text is segmented so that the sum of its pieces' log scores is largest:
Viterbi over positions, with the pieces that start at a position found by
walking a double-array trie.  A character that is no piece by itself may stand
alone at the lowest score less a penalty, and is then written as byte pieces.

Spaces become U+2581 and one is put before the text, as in the model's own rules
(no other normalising).  Where no piece has U+2581 after another character
and none but a byte piece holds a line feed, which is checked on loading, the best
segmentation of a text is that of its units side by side: units start at each
run of spaces and stand around each line feed.  Units are segmented many at a time, and
their results are held by each task in a store of bounded size.

Scores: a unigram model's are used as they stand.  A merge model (BPE) stores minus
the rank of the merge instead; rank r then scores as the log of Zipf's law, -log((r + 1) * H).

Defined results: null texts have null ids and no pieces; empty texts have no ids.
Of segmentations with equal sums the one whose last piece starts first is taken.
Decoding gives back every text but for U+2581 itself, which comes back as a space.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, trimmed

MARK = "▁"
#: Fixed values of the model file: piece kinds and the kind of model whose scores are merge ranks.
UNKNOWN, CONTROL, UNUSED, BYTE, BPE_MODEL = 2, 3, 5, 6, 2
#: How much lower than the lowest piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: Log scores are rounded to this fraction, so that sums are exact and ties are ties in any order of adding.
SCORE_STEPS = 1 << 20
#: Units whose segmentation a task holds before it starts afresh, and the longest one handled in an array.
HELD_UNITS, LONG_UNIT = 250_000, 128

_UNIT = re.compile(r" *[^ \n]+|\n| +")


@dataclass(frozen=True)
class Pieces:
    """Pieces by id: their bytes (a byte piece's is the byte it stands for), log scores and kinds."""

    raw: tuple[bytes, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def load_pieces(path: str) -> Pieces:
    """The pieces of a SentencePiece model file."""
    with open(path, "rb") as file:
        model = file.read()
    raw, scores, kinds, merges = [], [], [], False
    for number, value in _fields(model):
        if number == 1:
            entry = dict(_fields(value))
            text, kind = entry[1].decode(), entry.get(3, 1)
            raw.append(bytes([int(text[1:-1], 16)]) if kind == BYTE else text.encode())
            scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
            kinds.append(kind)
        elif number == 2:
            merges = dict(_fields(value)).get(3) == BPE_MODEL
    if merges:
        ranks = np.maximum(-np.array(scores), 0)
        ordinary = np.array([k not in (UNKNOWN, CONTROL, BYTE) for k in kinds])
        total = np.log((1 / (ranks[ordinary] + 1)).sum())
        scores = (-np.log(ranks + 1) - total).tolist()
    return Pieces(tuple(raw), tuple(scores), tuple(kinds))


class DoubleArray:
    """A trie over byte strings: from state s byte c leads to t = base[s] + c, if check[t] == s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        root: dict = {}
        for key, value in keys:
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        self.longest = max((len(k) for k, _ in keys), default=0)
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], low, waiting = -2, 256, [(0, root)]
        for state, node in waiting:
            value[state] = node.pop(-1, -1)
            if not node:
                continue
            children = sorted(node)
            while check[low] != -1:
                low += 1
            slot = low
            while True:
                while slot + 512 > len(base):
                    base += [0] * len(base)
                    check += [-1] * len(check)
                    value += [-1] * len(value)
                start = slot - children[0]
                if check[slot] == -1 and all(check[start + c] == -1 for c in children):
                    break
                slot += 1
            base[state] = start
            for c in children:
                check[start + c] = state
                waiting.append((start + c, node[c]))
        self.base, self.check, self.value = (np.array(x, np.int64) for x in (base, check, value))


class Segmenter:
    """Encodes and decodes with the pieces given."""

    def __init__(self, pieces: Pieces):
        usable = [i for i, k in enumerate(pieces.kinds) if k not in (UNKNOWN, CONTROL, UNUSED, BYTE) and pieces.raw[i]]
        self.trie = DoubleArray([(pieces.raw[i], i) for i in usable])
        self.scores = np.round(np.array(pieces.scores) * SCORE_STEPS) / SCORE_STEPS
        self.unknown = float(self.scores[usable].min() if usable else 0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, k in enumerate(pieces.kinds) if k == UNKNOWN), 0)
        at = {pieces.raw[i][0]: i for i, k in enumerate(pieces.kinds) if k == BYTE}
        self.bytes = np.array([at.get(b, self.unknown_id) for b in range(256)])
        mark = MARK.encode()
        self.shown = [b"" if k in (CONTROL, UNKNOWN) else (r if k == BYTE else r.replace(mark, b" ")) for r, k in zip(pieces.raw, pieces.kinds, strict=True)]
        texts = [pieces.raw[i].decode() for i in usable]
        self.by_unit = not any(re.search(f"[^{MARK}]{MARK}", t) or "\n" in t for t in texts)
        self._forget()

    def _forget(self) -> None:
        self.held: dict[str, int] = {}
        self.pool, self.bounds = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def _pooled(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pool) > 1:
            self.pool, self.bounds = [np.concatenate(self.pool)], [np.concatenate(self.bounds)]
        return self.pool[0], self.bounds[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text's pieces."""
        if not self.by_unit:
            return [self._one((" " + t).replace(" ", MARK).encode()) if t else np.zeros(0, np.int32) for t in texts]
        units = [_UNIT.findall(" " + t) if t else [] for t in texts]
        if len(self.held) > HELD_UNITS:
            self._forget()
        new = list(dict.fromkeys(u for us in units for u in us if u not in self.held))
        if new:
            ids, ends = self._segment([u.replace(" ", MARK).encode("utf-8", "replace") for u in new])
            self.held.update(zip(new, range(len(self.held), len(self.held) + len(new)), strict=True))
            self.bounds.append(ends + self._pooled()[1][-1])
            self.pool.append(ids)
        pool, bounds = self._pooled()
        out = []
        for us in units:
            at = np.fromiter(map(self.held.__getitem__, us), np.int64, len(us))
            begin, size = bounds[at], bounds[at + 1] - bounds[at]
            stops = np.cumsum(size)
            out.append(pool[np.repeat(begin - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)])
        return out

    def _segment(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in turn, and where each one's end."""
        sizes = np.array([len(u) for u in units])
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
        order = np.argsort(sizes, kind="stable")
        order, long = order[sizes[order] <= LONG_UNIT], order[sizes[order] > LONG_UNIT]
        for i in long:
            found[i] = self._one(units[i])
        rows, places, ids = [], [], []
        for at in range(0, len(order), 16384):
            part = order[at : at + 16384]
            r, p, k = self._many([units[i] for i in part], sizes[part])
            rows.append(part[r])
            places.append(p)
            ids.append(k)
        if long.size:
            rows.append(np.repeat(long, [len(found[i]) for i in long]))
            places.append(np.concatenate([np.arange(len(found[i])) for i in long]))
            ids.append(np.concatenate([found[i] for i in long]))
        row, place, flat = (np.concatenate(x) for x in (rows, places, ids))
        ranked = np.lexsort((place, row))
        return flat[ranked].astype(np.int32), np.cumsum(np.bincount(row, minlength=len(units)))

    def _many(self, units: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, id) of the pieces of units of much the same size, all worked on at each step."""
        count, width = len(units), int(sizes.max())
        raw = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(count, width).astype(np.int64)
        opens = ((raw & 0xC0) != 0x80) & (np.arange(width) < sizes[:, None])
        ends = np.cumsum(opens[:, ::-1], 1)[:, ::-1]  # characters from here on
        best = np.full((count, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((count, width + 1), np.int32)
        piece = np.full((count, width + 1), -1, np.int32)
        trie = self.trie
        for s in range(width):
            rows = np.flatnonzero(opens[:, s])
            if not len(rows):
                continue
            alone = np.zeros(count, bool)
            act, state = rows, np.zeros(len(rows), np.int64)
            for e in range(s, min(width, s + trie.longest)):
                to = trie.base[state] + raw[act, e]
                ok = (trie.check[to] == state) & (e < sizes[act])
                act, state = act[ok], to[ok]
                if not len(act):
                    break
                value = trie.value[state]
                has = value >= 0
                r, v = act[has], value[has]
                score = best[r, s] + self.scores[v]
                more = score > best[r, e + 1]
                up = r[more]
                best[up, e + 1], back[up, e + 1], piece[up, e + 1] = score[more], s, v[more]
                one = (ends[r, s] - (ends[r, e + 1] if e + 1 < width else 0)) == 1
                whole = one if e + 1 == width else one & ((raw[r, e + 1] & 0xC0) != 0x80)
                alone[r[whole]] = True
            lone = rows[~alone[rows]]
            if len(lone):
                step = np.ones(len(lone), np.int64)
                for more in (1, 2, 3):
                    inside = s + more < sizes[lone]
                    step += (step == more) & inside & ((raw[lone, np.minimum(s + more, width - 1)] & 0xC0) == 0x80)
                score = best[lone, s] + self.unknown
                better = score > best[lone, s + step]
                lone, to = lone[better], s + step[better]
                best[lone, to], back[lone, to], piece[lone, to] = score[better], s, -1
        rows, place = np.arange(count), sizes.astype(np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            start, ids = back[rows, place].astype(np.int64), piece[rows, place]
            known = ids >= 0
            out.append((rows[known], start[known], ids[known]))
            for step in range(4):
                byte = ~known & (start + step < place)
                out.append((rows[byte], start[byte] + step, self.bytes[raw[rows[byte], start[byte] + step]]))
            on = start > 0
            rows, place = rows[on], start[on]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]

    def _one(self, unit: bytes) -> np.ndarray:
        """The ids of one unit of any length."""
        if not hasattr(self, "lists"):
            self.lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist())
        base, check, value, scores = self.lists
        size = len(unit)
        best, back, piece = [float("-inf")] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        for s in range(size):
            if unit[s] & 0xC0 == 0x80:
                continue
            width = 1
            while s + width < size and unit[s + width] & 0xC0 == 0x80:
                width += 1
            state, alone, here = 0, False, best[s]
            for e in range(s, size):
                to = base[state] + unit[e]
                if check[to] != state:
                    break
                state = to
                if (v := value[state]) >= 0:
                    alone |= e + 1 == s + width
                    if here + scores[v] > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = here + scores[v], s, v
            if not alone and here + self.unknown > best[s + width]:
                best[s + width], back[s + width], piece[s + width] = here + self.unknown, s, -1
        out: list[int] = []
        at = size
        while at > 0:
            start = back[at]
            out += [piece[at]] if piece[at] >= 0 else [int(self.bytes[b]) for b in reversed(unit[start:at])]
            at = start
        return np.array(out[::-1], np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of pieces, without the space put before it; bytes that are no UTF-8, and ids of no piece, come out as U+FFFD."""
        shown, missing = self.shown, "\ufffd".encode()
        return b"".join(shown[i] if 0 <= i < len(shown) else missing for i in ids).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def segmenter(pieces: Pieces) -> Segmenter:
    return Segmenter(pieces)


def _added(rows: DataFrame, model_path: str, source: str, ids_col: str | None, text_col: str | None) -> DataFrame:
    """rows with the ids of column `source`, with the text of ids, or with both, in one pass."""
    bound_batches(rows.sparkSession)
    pieces = rows.sparkSession.sparkContext.broadcast(load_pieces(model_path))  # a vocabulary: its size doesn't depend on the rows
    new = [c for c in (ids_col, text_col) if c]
    kept = [c for c in rows.columns if c == source or c not in new]
    place = kept.index(source)
    out = [c for c in kept if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(pieces.value)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    given, columns = part.column(place).to_pylist(), []
                    if ids_col:
                        ids = own.encode_batch([t or "" for t in given])
                        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                        missing = np.array([t is None for t in given] + [False])
                        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=missing), pa.array(flat, pa.int32())))
                        given = [None if t is None else x.tolist() for t, x in zip(given, ids, strict=True)]
                    if text_col:
                        columns.append(pa.array([None if x is None else own.decode([i for i in x if i is not None]) for x in given], pa.string()))
                    yield pa.RecordBatch.from_arrays([*(c for c, n in zip(part.columns, kept, strict=True) if n in out), *columns], names=[*out, *new])
        finally:
            own._forget()

    kinds = {ids_col: "array<int>", text_col: "string"}
    schema = rows.select(*out, *(F.lit(None).cast(kinds[c]).alias(c) for c in new)).schema
    return rows.select(*kept).mapInArrow(trimmed(run), schema)


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of piece ids (array<int>) added, or put in place of a column of that name."""
    return _added(docs, model_path, text_col, ids_col, None)


def decode(rows: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their piece ids added, or put in place of a column of that name."""
    return _added(rows, model_path, ids_col, None, text_col)


def encode_and_decode(docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with piece ids and with the text that they decode to, in one pass."""
    return _added(docs, model_path, text_col, ids_col, decoded_col)
