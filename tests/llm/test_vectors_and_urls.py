"""Vector search, URL rules, groups of links, the pipeline, and the queries' SQL."""

import glob
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import nearest, queries, url_rules
from gridloom.llm.store import components


def test_codes_bound_inner_products():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2000, 48))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    centre, turn = unit.mean(0), nearest.rotation(48)
    np.testing.assert_allclose(turn @ turn.T, np.eye(48), atol=1e-12)
    guess, slack = nearest.estimates(v[:50], centre, turn, *nearest.codes(v, centre, turn))
    exact = unit[:50] @ unit.T
    assert (np.abs(guess - exact) <= slack).mean() > 0.95
    assert abs((guess - exact).mean()) < 0.01


@pytest.mark.parametrize("block", [64, 4096])
def test_nearest_recall_and_scores(spark, block):
    rng = np.random.default_rng(1)
    v = np.concatenate((rng.normal(size=(500, 32)), np.repeat(rng.normal(size=(1, 32)), 60, 0)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = nearest.nearest(df, F.col("vec_id") % 10 == 0, block=block).toPandas()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == [1, 2, 3, 4, 5] and q not in part["vec_id"].tolist()
        cos = unit @ unit[q]
        np.testing.assert_allclose(part["score"], cos[part["vec_id"]], atol=1e-12)
        order = [i for i in sorted(range(len(v)), key=lambda i: (-round(cos[i], 10), i)) if i != q][:5]
        hits += len(set(order) & set(part["vec_id"]))
        if q >= 500:
            assert part["vec_id"].tolist() == order
    assert hits >= 0.9 * len(got)


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 0.0]), (7, [None, 1.0]), (8, [1.0, 0.1]), (9, [1.0, 2.0, 3.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("q", F.lit("clash"))
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 8), (0, 2, 1)]
    assert nearest.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_large_ids_and_extreme_components(spark):
    rows = [(0, [1.0, 0.0]), (2**53, [3.0, 1.0]), (2**53 + 1, [3.0, 1.0]), (5, [1e100, 1e100]), (6, [1e200, 1e-200]), (7, [1e-200, 0.0]), (8, [-5e-324, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.nearest(df, F.col("vec_id").isin(0, 6, 7), k=6).orderBy("query_id", "rank").collect()
    want = [(7, 1.0), (2**53, 3 / 10**0.5), (2**53 + 1, 3 / 10**0.5), (5, 0.5**0.5), (8, -(0.5**0.5))]
    for query, twin in ((0, 6), (6, 0), (7, 0)):
        got = [(r.vec_id, r.score) for r in found if r.query_id == query]
        others = sorted([(twin, 1.0), ({0: 7, 6: 7, 7: 6}[query], 1.0)])
        assert {i for i, _ in got[:2]} == {i for i, _ in others} and [i for i, _ in got[2:]] == [i for i, _ in want[1:]]
        np.testing.assert_allclose([x for _, x in got], [x for _, x in others + want[1:]], rtol=1e-12)


URLS = ["http://Sub.Example.ORG/en/17?x", "https://example.org/es/3", "http://badexample.org/es/", "ftp://a.com/fr/", "http://a.com/de/9#t", "http://a.com/de", "http://org/", "http://a.org?/", "nohost", None, "", "x://", "http://a.org:80/", "a://b.com/fr/c://d.com/de/"]


def plain_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_fixed_url_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    labelled = spark.createDataFrame([], "url string, block boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.filter_urls(pages, labelled, queries.URL_RULES).collect()}
    assert got == {i: (h, p, r, v or "allow") for i, (h, p, r, v) in enumerate(map(plain_rule, URLS))}
    assert url_rules.filter_urls(pages.limit(0), labelled, queries.URL_RULES).count() == 0


def test_mined_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    hosts, parts = [f"h{i}.net" for i in range(6)], ["news", "shop", "win", "cash"]
    rows = []
    for _ in range(1500):
        host, own = rng.choice(hosts), rng.sample(parts, 2)
        bad = (host == "h1.net" and "win" in own) or "cash" in own and rng.random() < 0.8
        rows.append((f"http://{host}/{own[0]}/{own[1]}/{rng.randrange(99)}", bool(bad or rng.random() < 0.05)))
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    found, members = url_rules.mine(labelled, support=0.02)
    stands = {r.token: r["item"] for r in members.collect()}
    rules = [(set(r["items"]), r.confidence) for r in found.collect()]
    tokens = [({stands[t] for t in r.t if t in stands}, r.block) for r in labelled.select(url_rules.tokens_of(F.col("url")).alias("t"), "block").collect()]
    assert rules
    for items, confidence in rules:
        seen = [b for t, b in tokens if items <= t]
        assert abs(sum(seen) / len(seen) - confidence) < 1e-9 and confidence >= 0.6 and sum(seen) >= 0.02 * len(rows)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[:300])] + [(900, None), (901, "plain")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, labelled, (), support=0.02).collect()}
    want = {i: "block" if any(items <= tokens[i][0] for items, _ in rules) else "allow" for i in range(300)} | {900: "allow", 901: "allow"}
    assert got == want and "block" in want.values()


def test_mined_rules_are_those_of_all_token_sets(spark):
    rng = random.Random(7)
    rows = []
    for i in range(160):
        bad = rng.random() < 0.5
        tail = "/".join(["a", "b", "c", "d"][: rng.randint(1, 4)]) if i % 3 else "x/y/z"
        rows.append((f"http://{'w' if bad and rng.random() < 0.7 else 'v'}.net/{tail}/{'q' if bad else rng.choice('qr')}?k={i}&{'sure' if bad and i % 5 == 0 else 'm'}=1", bad))
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    baskets = [(frozenset(r.t), r.block) for r in labelled.select(url_rules.tokens_of(F.col("url")).alias("t"), "block").collect()]
    seen = {}
    for t, b in baskets:
        for n in range(1, 2 ** len(t)):
            s = frozenset(x for k, x in enumerate(sorted(t)) if n >> k & 1)
            both = seen.setdefault(s, [0, 0])
            both[0] += 1
            both[1] += b
    good = {s: b / n for s, (n, b) in seen.items() if b >= 20 and b / n >= 0.6}
    want = {s: c for s, c in good.items() if not any(good.get(s - {x}, -1) >= c for x in s if len(s) > 1)}
    found, members = url_rules.mine(labelled)
    stands = {}
    for r in members.collect():
        stands.setdefault(r["item"], []).append(r.token)
    got = {}
    for r in found.collect():
        for choice in itertools.product(*(stands[i] for i in r["items"])):
            got[frozenset(choice)] = r.confidence
    assert len(want) >= 5 and {s: round(c, 9) for s, c in got.items()} == {s: round(c, 9) for s, c in want.items()}


def test_long_shared_paths_are_mined_in_bounded_work(spark):
    path = "/".join(f"part{k}x" for k in range(30))
    rows = [(f"http://bad.net/{path}/{i}?{'&'.join(f'key{k}=1' for k in range(20))}", i % 5 != 0) for i in range(60)] + [(f"http://good.net/{path}/{i}", False) for i in range(30)] + [(f"http://good.net/home/{i}", False) for i in range(60)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    pages = spark.createDataFrame([(1, "http://bad.net/new"), (2, "http://other.org/?key7=2"), (3, "http://good.net/home"), (4, f"http://good.net/{path}")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.confidence) for r in url_rules.filter_urls(pages, labelled, ()).collect()}
    assert got == {1: ("block", 0.8), 2: ("block", 0.8), 3: ("allow", None), 4: ("allow", None)}


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 150), (150, 200)]
    rng.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 150, 150: 150}


def small_corpus(spark, folder):
    rng = random.Random(4)
    vocabulary = {"aa": ["kar", "tol", "min", "zak", "kost", "rup"], "bb": ["öu", "eli", "çan", "wia", "éo", "sà"]}
    line = lambda k, n: " ".join("".join(rng.choice(vocabulary[k]) for _ in range(3)) for _ in range(n))
    docs = []
    for i in range(120):
        k = "aa" if i % 3 else "bb"
        docs.append((i, "\n".join(line(k, 30) for _ in range(4)), k, "s", 0))
    item = line("aa", 25)
    base = docs[10][1]
    near = base.replace(base.split()[5], "tolminzak").replace(base.split()[70], "karkarkar")
    docs += [(200, base, "aa", "s", 0), (201, "12 34 56", "aa", "s", 0), (202, line("aa", 30) + "\n" + item + " " + line("aa", 30), "aa", "s", 0), (203, None, None, "s", 0), (204, near, "aa", "s", 0), (205, "", "aa", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline_stages_take_effect(spark, tmp_path):
    from gridloom.llm.queries import TOKENIZERS

    docs = small_corpus(spark, tmp_path)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and os.path.isdir(TOKENIZERS)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == set(range(120))  # the copy, the near copy, the leak and the texts without a language are gone
    for i, text, lang, source, _ in docs[:120]:
        assert (rows[i].text, rows[i].lang, rows[i].source, rows[i].n_chars) == (text, lang, source, len(text))
        assert rows[i].n_pieces == len(rows[i].ids) > 0
    each = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        each = stage(spark, each, str(tmp_path))
        left.append((name, {r.doc_id for r in each.collect()}))
        assert each.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    everyone = set(range(120)) | {200, 202, 204}
    assert left[0][1] == everyone and left[1][1] == everyone - {200, 204} and left[3][1] == set(range(120))
    near = spark.createDataFrame([d for d in docs if d[0] in (10, 204, 200, 11)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, near, "").collect()} == {10, 11}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(f"SELECT {", ".join(f"\"{c}\"" for c in got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
