"""Operator 3: secrets by fixed patterns and by a battery of randomness tests, DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three patterns.  The method
adds spans of other long tokens that are random in their inferred encoding:

* candidates are runs of 20 and more characters of the base64 alphabets; the
  encoding is the least alphabet that holds all of a run's characters;
* the battery tests a candidate's values in that alphabet for uniformity (chi-squared, with
  its exact moments), for the number of runs above and below the alphabet's middle, and for
  serial correlation; a candidate that any test rejects at level alpha / 3 is no secret;
* against the hypothesis that a candidate is text, with the letter and digit frequencies
  counted over all documents, the likelihood ratio R of a uniform choice gives the p-value
  min(1, 1 / R).  False discoveries are controlled for each class of lengths by itself
  (powers of two), with the step-up rule of Benjamini and Hochberg at rate q over all candidates
  of the class; p-values are held as counts per quarter of a decade, so the rule needs no ranking.

Defined results: null texts count as empty and have no spans; repeated rows come out
repeated; null ids stay null; extra columns are not read.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept

#: Fixed values of the contract: kinds, patterns, the group whose length counts, and the least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = (*(b[0] for b in BASE), "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Encodings as (pattern, alphabet), least first.  "-" and "_" stand for "+" and "/".
ENCODINGS = (
    (r"^[0-9]+$", "0123456789"),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Quarters of a decade of p-values that are told apart.
DECADES = 1200
#: Matches of a text whose offsets are summed one after the other.
BLOCK = 256


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, group: int, least: int, extra: str = "") -> str:
    """SQL: array of (s, e, ...) of a pattern's matches in `text` whose group has the least length.

    Texts between matches and the matches themselves, in turn, give the offsets.  They are summed in
    blocks, and then within each block, so the time grows in proportion to the matches of a text.
    """
    p = _quoted(pattern)
    kind = "array<struct<s:bigint,e:bigint,f:string,g:string>>"
    parts = f"arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {group}))"
    blocks, block = f"sequence(0, (size(v) - 1) div {BLOCK})", f"slice(v, CAST(b * {BLOCK} + 1 AS int), {BLOCK})"
    starts = f"""aggregate({blocks}, array(0L), (a, b) -> concat(a, array(element_at(a, -1)
        + aggregate({block}, 0L, (n, z) -> n + length(z.`0`) + coalesce(length(z.`1`), 0)))))"""
    spans = f"""flatten(transform({blocks}, b -> aggregate({block}, named_struct('at', at[CAST(b AS int)], 'out', CAST(array() AS {kind})),
        (a, z) -> named_struct('at', a.at + length(z.`0`) + coalesce(length(z.`1`), 0), 'out', CASE WHEN z.`1` IS NULL THEN a.out ELSE
            concat(a.out, array(named_struct('s', a.at + length(z.`0`), 'e', a.at + length(z.`0`) + length(z.`1`), 'f', z.`1`, 'g', z.`2`))) END), a -> a.out)))"""
    # A lambda over an array of one holds what is used more than once.
    found = f"transform(array({parts}), v -> transform(array({starts}), at -> {spans})[0])[0]"
    return f"CASE WHEN text RLIKE {p} THEN transform(filter({found}, m -> length(m.g) >= {least}), m -> named_struct('s', m.s, 'e', m.e{extra})) ELSE array() END"


def _battery() -> str:
    """SQL: squared test statistics of a candidate's values `v` in an alphabet of k, as array(chi, runs, serial)."""
    n, k = "CAST(size(v) AS double)", "CAST(k AS double)"
    squares = "aggregate(array_distinct(v), 0D, (a, x) -> a + pow(size(filter(v, y -> y = x)), 2))"
    chi = f"pow(({k} / {n} * {squares} - {n} - ({k} - 1)) / sqrt(2 * ({k} - 1) * ({n} - 1) / {n}), 2)"
    high = "CAST(size(filter(v, y -> y >= k / 2)) AS double)"
    runs = "(1 + size(filter(sequence(1, size(v) - 1), i -> (v[i] >= k / 2) <> (v[i - 1] >= k / 2))))"
    runs_z = f"""aggregate(array(2 * {high} * ({n} - {high})), 0D, (a, x) -> CASE WHEN x * (x - {n}) > 0
        THEN pow(({runs} - 1 - x / {n}) / sqrt(x * (x - {n}) / ({n} * {n} * ({n} - 1))), 2) ELSE 1e6D END)"""
    serial = f"""aggregate(array(aggregate(v, 0D, (a, x) -> a + x) / {n}), 0D, (b, mean) ->
        aggregate(array(aggregate(v, 0D, (a, x) -> a + (x - mean) * (x - mean))), 0D, (c, den) -> CASE WHEN den > 0
            THEN pow((aggregate(sequence(1, size(v) - 1), 0D, (a, i) -> a + (v[i] - mean) * (v[i - 1] - mean)) / den + 1 / ({n} - 1)) * sqrt({n}), 2) ELSE 1e6D END))"""
    return f"array({chi}, {runs_z}, {serial})"


def _thresholds(counts: list, q: float) -> dict[int, int]:
    """For each class of lengths the least whole quarter of a decade that the step-up rule accepts."""
    by: dict[int, dict[int, int]] = {}
    for r in counts:
        by.setdefault(r["len"], {})[r["p"]] = r["count"]
    out = {}
    for length, bins in by.items():
        total, passed = sum(bins.values()), 0
        for p in sorted(bins, reverse=True):
            passed += bins[p]
            if 10 ** (-p / 4) <= q * passed / total:
                out[length] = p
    return out


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.01, q: float = 0.05) -> DataFrame:
    """(doc_id, base, added) for every row: arrays of (s, k, e), k being the kind's place in KINDS, by start and kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = "concat(" + ", ".join(f"transform({_matches(pattern, group, least)}, m -> named_struct('s', m.s, 'k', {k}, 'e', m.e))" for k, (_, pattern, group, least) in enumerate(BASE)) + ")"
    alphabet = "CASE " + " ".join(f"WHEN m.f RLIKE '{p}' THEN '{a}'" for p, a in ENCODINGS[:-1]) + f" ELSE '{ENCODINGS[-1][1]}' END"
    tokens = f"transform({_matches(CANDIDATE, 0, 20, ', ' + _quoted('f') + ', m.f')}, m -> named_struct('s', m.s, 'e', m.e, 'f', translate(m.f, '-_', '+/'), 'abc', {alphabet.replace('m.f', 'm.f')}))"
    low = F.lower("text")
    counts = F.array(*(F.length("text") - F.length(F.replace(low, F.lit(c), F.lit(""))) + F.length(low) - F.length("text") for c in SYMBOLS))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    scan = kept(rows.select("doc_id", F.expr(base).alias("base"), F.expr(tokens).alias("tokens"), counts.alias("counts")), "secrets")

    sums = scan.agg(*(F.sum(F.col("counts")[i]).alias(str(i)) for i in range(len(SYMBOLS)))).first()
    total = sum(x or 0 for x in sums) + len(SYMBOLS)
    # A letter's case is as good as given; other symbols of base64 count as one in a thousand each.
    logs = {c: math.log(((n or 0) + 1) / total) for c, n in zip(SYMBOLS, sums, strict=True)} | {"+": math.log(0.001), "/": math.log(0.001)}
    table = "array(" + ", ".join(f"{logs[c]}D" for c in SYMBOLS + "+/") + ")"
    cases = "CASE WHEN length(m.abc) = 64 AND m.f RLIKE '[a-z]' AND m.f RLIKE '[A-Z]' THEN length(m.abc) - 26 ELSE length(m.abc) END"
    ratio = f"""aggregate(split(lower(m.f), ''), 0D, (a, c) -> CASE WHEN c = '' THEN a
        ELSE a - ln({cases}) - element_at({table}, instr('{SYMBOLS}+/', c)) END)"""
    values = "transform(filter(split(m.f, ''), c -> c <> ''), c -> instr(m.abc, c) - 1)"
    battery = f"element_at(transform(array(named_struct('v', {values}, 'k', length(m.abc))), z -> {_battery().replace('v[', 'z.v[').replace('(v)', '(z.v)').replace('(v,', '(z.v,').replace('CAST(k', 'CAST(z.k').replace('k / 2', 'z.k / 2')}), 1)"
    limit = {0.01: 8.615}.get(alpha) or _squared_normal(alpha / 3)
    judged = scan.select("doc_id", "base", F.expr(f"""transform(tokens, m -> named_struct('s', m.s, 'e', m.e,
        'len', CAST(floor(log2(length(m.f))) AS int), 'p', CAST(least(greatest(floor(4 * ({ratio}) / ln(10D)), 0), {DECADES}) AS int),
        'random', forall({battery}, t -> t < {limit}D)))""").alias("tokens"))
    judged = kept(judged, "judged")
    bars = _thresholds(judged.select(F.explode("tokens").alias("t")).groupBy("t.len", "t.p").count().collect(), q)
    accepted = " OR ".join(f"(t.len = {n} AND t.p >= {p})" for n, p in sorted(bars.items())) or "false"
    added = f"""transform(filter(tokens, t -> t.random AND ({accepted}) AND NOT exists(base, b -> b.s < t.e AND t.s < b.e)),
        t -> named_struct('s', t.s, 'k', {len(BASE)}, 'e', t.e))"""
    return judged.select("doc_id", F.array_sort("base").alias("base"), F.expr(f"array_sort({added})").alias("added"))


def _squared_normal(level: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - level / 2) ** 2


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["s"].cast("string"), s["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from scan_secrets' rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", *map(count, range(len(BASE))), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
