"""Medians and modes by passes of counts against plain ones, with little room for values."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridloom.functions import selection
from gridloom.operators.tiles import coarsen
from gridloom.plans.grid import GridMapping
from gridloom.sources.frame import GridFrame


def groups(seed):
    rng = random.Random(seed)
    return {
        0: [rng.gauss(0, 1) for _ in range(501)], 1: [rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(400)], 2: [7.5], 3: [math.nan, math.nan], 4: [-1e308, 1e308, 0.0, 5e-324] * 20,
        5: [10.0 ** rng.randint(-300, 300) for _ in range(333)], 6: [3.0] * 300, 7: [1.0, 2.0] * 150,
    }


@pytest.mark.parametrize("few", [5, 1000])
def test_medians(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "PARTS", 256)
    passes = []
    settled = selection.settled
    monkeypatch.setattr(selection, "settled", lambda df: (passes.append(1), settled(df))[1])
    own = groups(few)
    df = spark.createDataFrame([(g, v) for g, vs in own.items() for v in vs], "g int, v double")
    got = {r.g: r.v for r in selection.medians(df, ["g"], "v", few).collect()}
    for g, vs in own.items():
        vs = [v for v in vs if not math.isnan(v)]
        assert (got.get(g) is None) if not vs else got[g] == pytest.approx(statistics.median(v / 2 for v in vs) * 2, rel=1e-12)
    assert len(passes) <= 12
    assert selection.medians(df.limit(0), ["g"], "v").count() == 0


def test_modes(spark):
    rng = random.Random(3)
    own = {g: [rng.randrange(6) for _ in range(50)] for g in range(20)} | {99: [None, None], 98: [-(2**63), 5]}
    df = spark.createDataFrame([(g, v) for g, vs in own.items() for v in vs], "g int, v long")
    got = {r.g: r.v for r in selection.modes(df, ["g"], "v").collect()}
    assert got == {g: min(vs, key=lambda v: (-vs.count(v), v)) for g, vs in own.items() if g != 99}


@pytest.mark.parametrize("name", ["median", "mode"])
def test_large_windows_are_reduced_alike(spark, monkeypatch, name):
    rng = random.Random(9)
    rows = [(j, i, rng.choice([math.nan, 1.0, 2.5, 4.0, 4.0]), rng.randrange(9)) for j in range(12) for i in range(12)]
    frame = GridFrame.from_dataframe(spark.createDataFrame(rows, "j long, i long, v double, q int"), GridMapping.regular((12, 12), (0, 0), 1, "EPSG:3857"))
    frame = frame.select("q") if name == "mode" else frame
    plain = coarsen(frame, 5, 4, name).orderBy("j", "i")
    want, types = [str(tuple(r)) for r in plain.collect()], [t.removesuffix("int").replace("big", "") for _, t in plain.dtypes]
    monkeypatch.setattr(selection, "LARGE", 10)
    slow = coarsen(frame, 5, 4, name).orderBy("j", "i")
    assert [str(tuple(r)) for r in slow.collect()] == want and types and slow.columns == plain.columns
