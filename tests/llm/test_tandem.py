"""Runs of words against plain searches over all periods, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import tandem


def plain_runs(words, min_length=6, min_exponent=4):
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        s = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                s = i if s is None else s
            elif s is not None:
                length = i - s + q
                smallest = not any(all(words[k] == words[k + p] for k in range(s, s + length - p)) for p in range(1, q))
                if length >= max(min_length, min_exponent * q) and smallest:
                    out.append((s, length, q))
                s = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 12)[: rng.randint(1, 12 * len(unit))]
        out.append(words)
    return out + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 64, list("ab") * 20, (list("aab") * 5 + list("aac")) * 6]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least,exponent", [(6, 4), (1, 2), (3, 3)])
def test_runs_against_all_periods(seed, least, exponent, monkeypatch):
    monkeypatch.setattr(tandem, "PAIRS", 50)
    own = texts(seed)
    codes, first = tandem.numbers([[w.encode() for w in t] for t in own])
    rows = tandem.runs_of(codes, first, least, exponent)
    got = [[tuple(r[1:]) for r in rows.tolist() if r[0] == k] for k in range(len(own))]
    assert got == [plain_runs(t, least, exponent) for t in own]


@pytest.mark.parametrize("least", [2, 3, 4])
def test_suffixes_and_nodes_match_a_plain_tree(least):
    rng = random.Random(least)
    for _ in range(30):
        word = [rng.randrange(3) for _ in range(rng.randrange(60))]
        codes = np.array(word, np.int64)
        order, common = tandem.sorted_suffixes(codes, least)
        nodes = {(d, frozenset(order[a : b + 1].tolist())) for d, a, b, _, _ in tandem.inner_nodes(common, least).tolist()}
        want = {}
        for i in range(len(word)):
            for n in range(1, len(word) - i + 1):
                want.setdefault(tuple(word[i : i + n]), set()).add(i)
        branching = {}
        for prefix, leaves in want.items():
            if len(leaves) >= max(2, least) and len({word[i + len(prefix)] if i + len(prefix) < len(word) else -1 for i in leaves}) > 1:
                branching[len(prefix), frozenset(leaves)] = True
        assert {x for x in nodes if len(x[1]) > 1} == set(branching)


def test_long_periodic_text_is_near_linear():
    codes = np.tile(np.arange(7), 30_000)
    assert tandem.runs_of(codes, np.array([0, len(codes)])).tolist() == [[0, 0, len(codes), 7]]
    codes = np.zeros(100_000, np.int64)
    assert tandem.runs_of(codes, np.array([0, len(codes)])).tolist() == [[0, 0, len(codes), 1]]


def test_collapse_on_frames(spark):
    rows = [(1, "x " + "a b\t" * 6 + "c"), (2, None), (3, ""), (4, " \n"), (5, "no run here"), (5, "no run here"), (6, "é é " * 6), (7, "A a " * 3), (None, "z " * 9), (8, "w" * 100_000 + " " + "q " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("extra", F.lit(1))
    out = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.extra) for r in tandem.collapse_runs(df).collect()]
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = plain_runs(words) if len(words) < 1000 else [(1, 50_000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone), 1))
    assert sorted(out, key=str) == sorted(want, key=str)
    assert tandem.collapse_runs(df.limit(0)).count() == 0


def test_strongest_run(spark):
    cases = [([], None), ([(0, 8, 2), (9, 9, 2)], (9, 9, 2)), ([(5, 8, 2), (3, 4, 1), (3, 8, 2)], (3, 4, 1))]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], f"k int, runs {tandem.RUN}")
    got = {r.k: None if r.best is None else tuple(r.best) for r in df.select("k", tandem.strongest(F.col("runs")).alias("best")).collect()}
    assert got == {k: w for k, (_, w) in enumerate(cases)}
