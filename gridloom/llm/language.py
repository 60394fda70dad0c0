"""Operator 5: language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's lower-cased UTF-8 bytes, every run of white space as one space, forwards
and backwards across words, labels each byte with probabilities of the learned languages, and a document's
probabilities are the mean over all its bytes.  Long texts are read in pieces: `STEP` bytes
are labelled at a time, and `EDGE` more on either side are read to build up the state.  Many pieces take each step
together, as what numpy needs for a call is much of the work.

It is trained here, in numpy, by backpropagation through time, on every byte of every labelled document
that is not held out, and for every language any of them has:

1. A start is fitted on spans of bytes drawn at random from the texts of a few documents: those with the least
   hashes of their ids, about `sample_docs` of them but LEAST_DOCS of each language where there are so many, and
   `sample_spans` spans from each, of up to the length that is read at once when labelling.
2. The documents are dealt into PARTS parts by a hash of their ids.  For each part in turn, tasks add up the gradients of
   all bytes of all its texts, in pieces of LESSON bytes, Spark adds up the tasks', and the weights move by one step of Adam.  So what comes to the
   driver is as large as the network, and the weights don't depend on how rows are dealt to tasks, but for rounding.

Defined results: `und` with score 0 where the text is null or has no letter, or where
nothing was learned; a null id is never held out; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, trimmed

#: Bytes that are labelled at once, bytes read on either side of them, and both together.
STEP, EDGE = 224, 16
SPAN = STEP + 2 * EDGE
#: Pieces of texts that are read side by side.
ABREAST = 1280
#: Parts of the labelled documents, each a step of learning, and how far a step moves a weight.
PARTS, RATE = 4, 0.003
#: Documents of a language from which the start is fitted at least, where there are so many.
LEAST_DOCS = 50
#: Pieces whose gradients are worked out side by side, and bytes of a piece.
TAUGHT, LESSON = 2048, 128
#: Steps back whose errors are summed by byte together, while they are in the processor's cache.
STRIDE = 16
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
UNDETERMINED = "und"


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Network:
    """Weights: byte inputs, recurrent weights and biases of both directions, and the output layer."""

    languages: tuple[str, ...]
    inputs: np.ndarray  # 2, 256, 3 * width
    recurrent: np.ndarray  # 2, width, 3 * width
    bias: np.ndarray  # 2, width: of the candidate's recurrent part
    output: np.ndarray  # 2 * width, languages
    offset: np.ndarray  # languages


#: The fields of a network that are learned.
WEIGHTS = ("inputs", "recurrent", "bias", "output", "offset")


def _padded(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, span), padded to the longest span, and the spans' sizes."""
    sizes = np.array([len(s) for s in spans])
    longest = int(sizes.max())
    return np.ascontiguousarray(np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in spans), np.uint8).reshape(len(spans), longest).T), sizes


def _by_gate(weights: np.ndarray) -> np.ndarray:
    """Weights (way, row, 3 * width) as (gate, way, row, width)."""
    return np.ascontiguousarray(weights.reshape(2, weights.shape[1], 3, -1).transpose(2, 0, 1, 3))


class Room(dict):
    """Memory that calls use again, by name: fresh memory costs a page fault for every few of the numbers in it."""

    def floats(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or self[name].size < size:
            self[name] = np.empty(size, np.float32)
        return self[name][:size].reshape(shape)


def _states(net: Network, raw: np.ndarray, sizes: np.ndarray, room: Room, learning: bool = False) -> np.ndarray:
    """Hidden states (way, step, span, width), where backwards the first step is at the last byte; what learning needs stays in room.

    Both ways take their steps together, and each gate is one block of memory.  Gates come from exponentials,
    1 / (1 + e^-v) and 2 / (1 + e^-2v) - 1, which numpy works out faster than tanh.  Where nothing is learned
    from the gates, what they weigh is divided by 1 + e^-v instead.
    """
    (length, count), width, shortest = raw.shape, net.recurrent.shape[1], int(sizes.min())
    scale = np.array([-1, -1, -2], np.float32)[:, None, None, None]
    table, turn = scale * _by_gate(net.inputs), scale * _by_gate(net.recurrent)
    table, bias = table.reshape(3, -1, width), np.repeat(-2 * net.bias[:, None], count, 1)
    read = np.add(np.stack((raw, raw[::-1]), 1), 256 * np.arange(2)[:, None], dtype=np.intp)
    out, x, own = room.floats("states", 2, length, count, width), room.floats("x", 3, 2, count, width), room.floats("own", 3, 2, count, width)
    block = room.floats("block", 4, 2, length if learning else 1, count, width)
    h, weigh = np.zeros_like(own[0]), np.multiply if learning else np.divide
    with np.errstate(over="ignore"):
        for s in range(length):
            now = block[:, :, s if learning else 0]
            gate, c, pull = now[:2], now[2], now[3]
            for k in range(3):
                np.take(table[k], read[s], 0, out=x[k], mode="clip")
            np.matmul(h, turn, out=own)
            np.add(x[:2], own[:2], out=gate)
            np.exp(gate, out=gate)
            gate += 1
            if learning:
                np.divide(1, gate, out=gate)
            last = own[2]
            last += bias
            weigh(last, gate[1], out=pull)
            np.add(pull, x[2], out=c)
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            np.subtract(h, c, out=last)
            weigh(last, gate[0], out=last)
            h = np.add(last, c, out=out[:, s])
            # Backwards, what fills up a span comes before it.
            if length - 1 - s >= shortest:
                h[1, sizes <= length - 1 - s] = 0
    return out


def _probabilities(net: Network, raw: np.ndarray, sizes: np.ndarray, room: Room | None = None, learning: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (time, language, span), and the states they come from."""
    room = Room() if room is None else room
    states = _states(net, raw, sizes, room, learning)
    (_, length, count, width), langs = states.shape, len(net.languages)
    p, back, one = room.floats("p", length, langs, count), room.floats("back", length, langs, count), room.floats("one", length, 1, count)
    np.matmul(net.output[:width].T, states[0].transpose(0, 2, 1), out=p)
    p += np.matmul(net.output[width:].T, states[1, ::-1].transpose(0, 2, 1), out=back)
    p += net.offset[:, None]
    p -= np.max(p, 1, keepdims=True, out=one)
    np.exp(p, out=p)
    p /= np.sum(p, 1, keepdims=True, out=one)
    return p, states


def _gradients(net: Network, raw: np.ndarray, sizes: np.ndarray, label: np.ndarray, room: Room | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy over all positions, by backpropagation through time."""
    room = Room() if room is None else room
    wrong, states = _probabilities(net, raw, sizes, room, True)
    (length, count), width, shortest = raw.shape, net.recurrent.shape[1], int(sizes.min())
    block = room.floats("block", 4, 2, length, count, width)
    wrong -= np.eye(len(net.languages), dtype=np.float32)[label].T
    wrong *= ((np.arange(length)[:, None] < sizes) / np.float32(sizes.sum()))[:, None]
    offset = wrong.sum((0, 2))
    # From errors of labels, both ways in their order of steps, to those of states.
    errors, own = (wrong, wrong[::-1]), np.ascontiguousarray(net.output.reshape(2, width, -1).transpose(0, 2, 1))
    ends = [(errors[way] @ states[way]).sum(0).T for way in (0, 1)]
    # The second gate's errors are carried as twice what they are.
    half = np.array([1, 0.5, 1], np.float32)[:, None, None, None]
    back = np.ascontiguousarray((half * _by_gate(net.recurrent)).transpose(0, 1, 3, 2))
    left, more, carry = room.floats("left", 2, count, width), room.floats("more", 2, count, width), np.zeros((2, count, width), np.float32)
    ones, recurrent, inputs = np.ones(length * count, np.float32), np.zeros_like(back), np.zeros((3, 2, 256, width), np.float32)
    rows = lambda block: block.reshape(-1, width)
    # Errors take the place of what they come from: dz, dc * r for the recurrent part, dc, and dr.
    for s in reversed(range(length)):
        z, r, c, pull = block[:, :, s]
        for way in (0, 1):
            np.matmul(errors[way][s].T, own[way], out=more[way])
        carry += more
        if length - 1 - s >= shortest:
            carry[1, sizes <= length - 1 - s] = 0
        np.multiply(carry, z, out=more)
        np.subtract(carry, more, out=left)
        carry, more = more, carry
        # The state less the candidate is the gate times what the state before was off it.
        np.subtract(states[:, s], c, out=z)
        z *= left
        np.multiply(c, c, out=more)
        np.subtract(1, more, out=more)
        np.multiply(more, left, out=c)
        r *= c
        np.subtract(r, c, out=left)
        pull *= left
        for error, turn in ((z, back[0]), (pull, back[1]), (r, back[2])):
            np.matmul(error, turn, out=more)
            carry += more
        if s % STRIDE == 0:
            steps, first = slice(s, min(s + STRIDE, length)), max(s, 1)
            for way, read in enumerate((raw, raw[::-1])):
                order, runs = np.argsort(read[steps], axis=None, kind="stable"), np.cumsum(np.bincount(read[steps].ravel(), minlength=256))
                into = room.floats("sorted", 3, len(order), width)
                for k, (own_input, own_state) in enumerate(((block[0], block[0]), (block[3], block[3]), (block[2], block[1]))):
                    np.take(rows(own_input[way, steps]), order, 0, out=into[k], mode="clip")
                    recurrent[k, way] += rows(states[way, first - 1 : steps.stop - 1]).T @ rows(own_state[way, first : steps.stop])
                for value, (a, b) in enumerate(zip([0, *runs[:-1]], runs, strict=True)):
                    if a < b:
                        inputs[:, way, value] += ones[: b - a] @ into[:, a:b]
    bias = np.stack([ones @ rows(errors) for errors in block[1]])
    flat = lambda g: (half * g).transpose(1, 2, 0, 3).reshape(2, -1, 3 * width)
    return {"output": np.concatenate(ends), "offset": offset, "inputs": flat(inputs), "recurrent": flat(recurrent), "bias": bias}


def fit(spans: list[bytes], labels: list[str], languages: tuple[str, ...] | None = None, *, width: int = 8, steps: int = 240, batch: int = 96, rate: float = 0.03, seed: int = 7) -> Network:
    """A network trained on spans of bytes, each with a language, by Adam over random batches of spans of like length.  languages: all there are, if the spans may lack some."""
    rng = np.random.default_rng(seed)
    languages = languages or tuple(sorted(set(labels)))
    index = {k: i for i, k in enumerate(languages)}
    small = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    net = Network(languages, small(2, 256, 3 * width), small(2, width, 3 * width), small(2, width), small(2 * width, len(languages)), np.zeros(len(languages), np.float32))
    if len(languages) < 2 or not spans:
        return net
    order = np.argsort([len(s) for s in spans], kind="stable")
    first = {k: np.zeros_like(getattr(net, k)) for k in ("inputs", "recurrent", "bias", "output", "offset")}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    spots, room = max(1, len(spans) - batch), Room()
    for step in range(1, steps + 1):
        at = int(rng.integers(0, spots))
        pick = order[at : at + batch]
        raw, sizes = _padded([spans[i] for i in pick])
        grads = _gradients(net, raw, sizes, np.array([index[labels[i]] for i in pick]), room)
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            move = rate * min(1, 2 * (1 - step / (steps + 1))) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
            getattr(net, k)[...] -= move.astype(np.float32)
    return net


def readable(text: str | None) -> bytes:
    """What the network reads of a text: nothing if it is null or has no letter."""
    if text is None or not any(map(str.isalpha, text)):
        return b""
    raw = text.lower().encode("utf-8", "replace").translate(_SPACES)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw.strip()


def pooled(net: Network, texts: list[bytes], room: Room | None = None) -> np.ndarray:
    """The mean of the labels of all bytes of each text (text, language); a text without bytes has zeros."""
    sums, room = np.zeros((len(texts), len(net.languages))), Room() if room is None else room
    pieces = ((i, max(0, a - EDGE), a, min(a + STEP, len(t))) for i, t in enumerate(texts) for a in range(0, len(t), STEP))
    while some := list(islice(pieces, 16 * ABREAST)):
        read = [texts[i][low : end + EDGE] for i, low, _, end in some]
        order, spots = np.argsort([len(r) for r in read], kind="stable"), np.array(some, np.int64)
        for at in range(0, len(order), ABREAST):
            part = order[at : at + ABREAST]
            raw, sizes = _padded([read[i] for i in part])
            p, _ = _probabilities(net, raw, sizes, room)
            own, low, begin, end = spots[part].T
            place = np.arange(len(raw), dtype=np.int16)[:, None]
            p *= ((place >= (begin - low).astype(np.int16)) & (place < (end - low).astype(np.int16)))[:, None]
            np.add.at(sums, own, p.sum(0).T)
    return sums / np.maximum([len(t) for t in texts], 1)[:, None]


def labels_of(net: Network, texts: list[str | None], room: Room | None = None) -> list[tuple[str, float]]:
    """Each text's language and its pooled probability."""
    raw = [readable(t) if net.languages else b"" for t in texts]
    best = pooled(net, raw, room) if net.languages else None
    return [(net.languages[int(best[i].argmax())], round(min(1.0, float(best[i].max())), 6)) if r else (UNDETERMINED, 0.0) for i, r in enumerate(raw)]


def _added(net: Network, labelled: DataFrame) -> tuple[int, dict[str, np.ndarray]]:
    """How many bytes the texts of (id, text, lang) have, and the gradients of their mean cross entropy."""
    index = {k: i for i, k in enumerate(net.languages)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, held, room = 0, np.zeros(sum(getattr(net, k).size for k in WEIGHTS)), [], Room()

        def teach() -> None:
            nonlocal total
            held.sort(key=lambda one: len(one[0]))
            for at in range(0, len(held), TAUGHT):
                part = held[at : at + TAUGHT]
                raw, sizes = _padded([piece for piece, _ in part])
                grads = _gradients(net, raw, sizes, np.array([lang for _, lang in part]), room)
                sums[:] += np.concatenate([grads[k].ravel() for k in WEIGHTS]) * float(sizes.sum())
                total += int(sizes.sum())
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = readable(text)
                for a in range(0, len(own), LESSON):
                    held.append((own[a : a + LESSON], index[lang]))
                    if len(held) == 8 * TAUGHT:
                        teach()
        if held:
            teach()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["n", "g"])

    tasks = labelled.mapInArrow(trimmed(add), "n long, g array<double>").where("n > 0")
    # The number of bytes is one more place of the sums.
    rows = tasks.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "g")).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return 0, {}
    n, *flat = (r["v"] for r in sorted(rows, key=lambda r: r["at"]))
    parts = np.split(np.array(flat) / n, np.cumsum([getattr(net, k).size for k in WEIGHTS])[:-1])
    return int(n), {k: g.reshape(getattr(net, k).shape) for k, g in zip(WEIGHTS, parts, strict=True)}


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 2000, sample_spans: int = 8) -> Network:
    """A network of the languages in lang_col, from all documents that are not held out; see the module for the start."""
    bound_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    labelled = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in labelled.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").count().collect()}
    share = min(1.0, sample_docs / max(sum(counts.values()), 1))
    hashed = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    rare = {k: LEAST_DOCS / c for k, c in counts.items() if LEAST_DOCS / c > share}
    chosen = hashed < int(share * 1_000_003) + 1
    for lang, own in rare.items():
        chosen |= (F.col("lang") == lang) & (hashed < int(min(1.0, own) * 1_000_003) + 1)
    rows = labelled.where(chosen).limit(2 * (sample_docs + LEAST_DOCS * len(rare)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, langs = [], []
            for key, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own := readable(text):
                    rng = np.random.default_rng(np.frombuffer(key.encode(), np.uint8))
                    sizes = rng.integers(EDGE, SPAN + 1, sample_spans)
                    starts = (rng.random(sample_spans) * np.maximum(len(own) - sizes + 1, 1)).astype(np.int64)
                    spans += [own[a : a + n] for a, n in zip(starts, sizes, strict=True)]
                    langs += [lang] * sample_spans
            yield pa.RecordBatch.from_arrays([pa.array(spans, pa.binary()), pa.array(langs, pa.string())], names=["span", "lang"])

    drawn = sorted((bytes(r["span"]), r["lang"]) for r in rows.mapInArrow(draw, "span binary, lang string").collect())
    net = fit([s for s, _ in drawn], [k for _, k in drawn], tuple(sorted({*counts, *(k for _, k in drawn)})))
    if len(net.languages) < 2:
        return net
    first = {k: np.zeros(getattr(net, k).shape) for k in WEIGHTS}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    known, step = F.col("lang").isin(*net.languages), 0
    for part in range(PARTS):
        n, grads = _added(net, labelled.where(known & (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS)) == part)))
        if not n:
            continue
        step += 1
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            getattr(net, k)[...] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def label(docs: DataFrame, net: Network, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with each text's language and score added, or put in place of columns of those names."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*(c for c in docs.columns if c not in (lang_col, score_col)))
    names, place = [*rows.columns, lang_col, score_col], rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = Room()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = labels_of(net, part.column(place).to_pylist(), room)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=names)

    schema = rows.withColumn(lang_col, F.lit(None).cast("string")).withColumn(score_col, F.lit(None).cast("double")).schema
    return rows.mapInArrow(trimmed(run), schema)


def identify(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return label(rows, net).select("doc_id", "held_out", "lang_pred", "score")
