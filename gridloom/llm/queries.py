"""The queries of this subpackage's operators over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, line_dedup, merkle, metric_tree, nearest, passages, secret_scan, tandem, unigram, url_rules
from .ngram_join import ngram_jaccard_join

#: Where the public vocabulary files are; a parameter of the queries that read one.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
r(id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, CAST(min(r.c) AS BIGINT) AS component_id
FROM w JOIN r ON r.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
v AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM benchmark),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) > 0),
t AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM v WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM t GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM s JOIN t USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / n_item AS containment FROM p JOIN n USING (item_id) WHERE n_shared >= ceil(0.75 * n_item)
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def _matches_sql(pattern: str, group: int) -> str:
    """DuckDB: (rid, s, f, g) of a pattern's matches, with offsets from the texts between them."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, m.s AS s, m.s + length(m.f) AS e, m.f AS f, m.g AS g FROM (
      SELECT rid, unnest(list_transform(range(1, len(f) + 1), lambda i: {{'f': f[i], 'g': g[i],
        's': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT)}})) AS m
      FROM (SELECT rid, string_split_regex(text, {p}) AS p, regexp_extract_all(text, {p}, 0) AS f, regexp_extract_all(text, {p}, {group}) AS g FROM d) WHERE len(f) > 0)"""


def _secrets_sql() -> str:
    kinds = " UNION ALL ".join(f"SELECT rid, {k} AS k, s, e FROM ({_matches_sql(pattern, group)}) WHERE length(g) >= {least}" for k, (_, pattern, group, least) in enumerate(secret_scan.BASE))
    names = "CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(secret_scan.KINDS)) + " END"
    alphabet = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{a}'" for p, a in secret_scan.ENCODINGS[:-1]) + f" ELSE '{secret_scan.ENCODINGS[-1][1]}' END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({kinds}),
c AS (SELECT c, sum(length(l) - length(replace(l, c, ''))) AS n FROM (SELECT lower(text) AS l FROM d), (SELECT unnest(string_split('{secret_scan.SYMBOLS}', '')) AS c) GROUP BY c),
lg AS (SELECT c, ln((n + 1) / (sum(n) OVER () + {len(secret_scan.SYMBOLS)})) AS lg FROM c UNION ALL SELECT unnest(['+', '/']), ln(0.001)),
t AS (SELECT row_number() OVER () AS tid, rid, s, e, t, {alphabet} AS abc FROM (SELECT *, translate(f, '-_', '+/') AS t FROM ({_matches_sql(secret_scan.CANDIDATE, 0)}))),
r AS (
  SELECT tid, sum(-ln(CASE WHEN length(abc) = 64 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]') THEN length(abc) - 26 ELSE length(abc) END) - lg) AS ratio
  FROM (SELECT *, unnest(string_split(lower(t), '')) AS c FROM t) JOIN lg USING (c) GROUP BY tid),
v AS (SELECT *, CAST(len(v) AS DOUBLE) AS n, CAST(list_sum(v) AS DOUBLE) / len(v) AS mean FROM (SELECT *, list_transform(string_split(t, ''), lambda x: instr(abc, x) - 1) AS v, CAST(length(abc) AS DOUBLE) AS k FROM t)),
b AS (
  SELECT *, list_sum(list_transform(list_distinct(v), lambda x: pow(len(list_filter(v, lambda y: y = x)), 2))) AS sq,
    2.0 * len(list_filter(v, lambda y: y >= k / 2)) * (n - len(list_filter(v, lambda y: y >= k / 2))) AS x,
    len(list_filter(range(2, len(v) + 1), lambda i: (v[i] >= k / 2) <> (v[i - 1] >= k / 2))) AS turns,
    list_sum(list_transform(v, lambda y: (y - mean) * (y - mean))) AS den,
    list_sum(list_transform(range(2, len(v) + 1), lambda i: (v[i] - mean) * (v[i - 1] - mean))) AS num FROM v),
j AS (
  SELECT rid, s, e, CAST(floor(log2(length(t))) AS INTEGER) AS len, CAST(least(greatest(floor(4 * ratio / ln(10)), 0), {secret_scan.DECADES}) AS INTEGER) AS p,
    pow((k / n * sq - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n), 2) < 8.615 AND x * (x - n) > 0 AND den > 0
    AND CASE WHEN x * (x - n) > 0 THEN pow((turns - x / n) / sqrt(x * (x - n) / (n * n * (n - 1))), 2) < 8.615 END
    AND CASE WHEN den > 0 THEN pow((num / den + 1 / (n - 1)) * sqrt(n), 2) < 8.615 END AS random
  FROM b JOIN r USING (tid)),
bars AS (SELECT len, min(p) AS bar FROM (SELECT len, p, count(*) OVER (PARTITION BY len ORDER BY p DESC) AS over, count(*) OVER (PARTITION BY len) AS total FROM j) WHERE pow(10, -p / 4.0) <= 0.05 * over / total GROUP BY len),
added AS (
  SELECT rid, {len(secret_scan.BASE)} AS k, s, e FROM j JOIN bars USING (len) WHERE random AND p >= bar
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = j.rid AND base.s < j.e AND j.s < base.e)),
a AS (SELECT rid, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY rid),
n AS (
  SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS base FROM base GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(n.base, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM d LEFT JOIN n USING (rid) LEFT JOIN a USING (rid)
"""


OP3_SQL = _secrets_sql()


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    return line_dedup.dedup_lines(docs)


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, pos, line, list_filter(list_distinct(string_split(line, ' ')), lambda x: x <> '') AS ws FROM l),
f AS (
  SELECT line, any_value(ws) AS ws, min((doc_id, pos)) AS o, row_number() OVER () AS k FROM w WHERE len(ws) > 0 GROUP BY line),
d AS (SELECT x, count(*) AS df FROM (SELECT unnest(ws) AS x FROM f) GROUP BY x),
r AS (SELECT k, o, len(ws) AS n, x, row_number() OVER (PARTITION BY k ORDER BY df, x) AS i FROM (SELECT k, o, ws, unnest(ws) AS x FROM f) JOIN d USING (x)),
c AS (
  SELECT DISTINCT a.k AS ka, b.k AS kb FROM r a JOIN r b ON a.x = b.x AND a.o > b.o
  WHERE a.i <= a.n - ceil(0.75 * a.n) + 1 AND b.i <= b.n - ceil(0.75 * b.n) + 1 AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
g AS (
  SELECT DISTINCT ka FROM c JOIN f a ON a.k = ka JOIN f b ON b.k = kb
  WHERE 100 * len(list_intersect(a.ws, b.ws)) >= 75 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))),
stay AS (
  SELECT doc_id, pos, line FROM w LEFT JOIN (SELECT o FROM f WHERE k NOT IN (SELECT ka FROM g)) h ON h.o = (w.doc_id, w.pos) WHERE len(ws) = 0 OR h.o IS NOT NULL)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(s.line, chr(10) ORDER BY s.pos), '') END AS text, CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS n_lines
FROM documents d LEFT JOIN stay s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Fixed values of the query's contract: (verdict, host, path).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose id its path names after the language: bad if of low quality or toxic."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    named = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint)").alias("doc_id")).where("doc_id IS NOT NULL")
    labelled = named.join(labels.where("quality IS NOT NULL OR toxic IS NOT NULL"), "doc_id").select("url", F.expr("coalesce(quality = 0, false) OR coalesce(toxic = 1, false)").alias("block"))
    return url_rules.filter_urls(pages, labelled, URL_RULES)


def _urls_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    fits = " UNION ALL ".join(
        f"SELECT rid, '{h}{p}' AS rule, '{v}' AS verdict FROM p WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for v, h, p in URL_RULES
    )
    return f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, url, {host} AS host, {path} AS path FROM pages),
fit AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM ({fits}) GROUP BY rid),
u AS (SELECT DISTINCT url, host, path, string_split(host, '.') AS parts FROM p WHERE contains(url, '://')),
t AS (
  SELECT url, list_sort(list_distinct(list_concat(['scheme:' || regexp_extract(url, '(?s)^(.*?)://', 1)],
    list_transform(range(1, len(parts) + 1), lambda i: 'host:' || array_to_string(parts[i:], '.')),
    list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda s: s <> ''), lambda s: 'path:' || s),
    list_transform(regexp_extract_all(regexp_extract(url, '\\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda s: 'query:' || s)))) AS t FROM u),
l AS (
  SELECT p.url, coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS block FROM p JOIN labels ON doc_id = try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT)
  WHERE quality IS NOT NULL OR toxic IS NOT NULL),
n AS (SELECT count(*) AS total, CASE WHEN count(*) FILTER (block) >= 20 THEN ceil(greatest(0.002, 20 / count(*)) * count(*)) END AS least FROM l),
s AS (SELECT list_filter(t, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items, block FROM (SELECT t, block, unnest(range(1, 1 << len(t))) AS mask FROM l JOIN t USING (url))),
f AS (SELECT items, count(*) FILTER (block) / count(*) AS confidence FROM s GROUP BY items HAVING count(*) FILTER (block) >= (SELECT least FROM n) AND count(*) FILTER (block) / count(*) >= 0.6),
r AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE len(g.items) = len(f.items) - 1 AND list_has_all(f.items, g.items) AND g.confidence >= f.confidence)),
h AS (SELECT url, max(confidence) AS confidence FROM t JOIN r ON list_has_all(t.t, r.items) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN confidence END AS confidence
FROM p LEFT JOIN fit USING (rid) LEFT JOIN h USING (url)
"""


OP7_SQL = _urls_sql()


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def _licenses_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    templates = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in licenses.TEMPLATES.items())
    word = r"'[0-9A-Za-z\x{80}-\x{10FFFF}]+'"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    runs = lambda key: f"w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g, lead(s + fl, 4) OVER o AS e4"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents WHERE text IS NOT NULL),
f AS (SELECT id, string_split_regex(text, {word}) AS p, regexp_extract_all(text, {word}) AS f FROM d),
w AS (SELECT id, n, {lower.format('w')} AS w, sum(pl) OVER o + coalesce(sum(fl) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, fl FROM (
    SELECT id, n, w, length(w) AS fl, length(p) AS pl FROM (SELECT id, unnest(range(len(f))) AS n, unnest(f) AS w, unnest(p[1:len(f)]) AS p FROM f)) WINDOW o AS (PARTITION BY id ORDER BY n)),
g AS (SELECT * FROM (SELECT id, n, s, {runs('id')} FROM w WINDOW o AS (PARTITION BY id ORDER BY n)) WHERE g IS NOT NULL),
tw AS (SELECT name AS id, unnest(range(len(f))) AS n, {lower.format('unnest(f)')} AS w, 0 AS s, 0 AS fl FROM (SELECT name, regexp_extract_all(t, {word}) AS f FROM (VALUES {templates}) v(name, t))),
tg AS (SELECT DISTINCT id AS name, g FROM (SELECT id, {runs('id')} FROM tw WINDOW o AS (PARTITION BY id ORDER BY n)) WHERE g IS NOT NULL),
tn AS (SELECT name, count(*) AS total, CAST(floor(log2(count(*))) AS INTEGER) AS part FROM tg GROUP BY name),
tc AS (SELECT name, total, max(total) OVER (PARTITION BY part) AS block FROM tn),
m AS (SELECT id, name, total, n, s, e4, tg.g, unnest([n // block - 1, n // block]) AS win FROM g JOIN tg USING (g) JOIN tc USING (name)),
h AS (SELECT id, name, win, count(DISTINCT g) / total AS share, min(n) AS a, max(n) AS z, min(s) AS s, max(e4) AS e FROM m WHERE win >= 0 GROUP BY id, name, win, total HAVING count(DISTINCT g) >= 0.75 * total),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY id, name ORDER BY a, z) AS grp FROM (
    SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY id, name ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM h))
SELECT doc_id, string_split(name, '#')[1] AS license, name AS template, CAST(max(share) AS DOUBLE) AS share, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS end
FROM i JOIN d USING (id) GROUP BY id, doc_id, name, grp
"""


OP9_SQL = _licenses_sql()


def op10_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Every document's piece ids, and whether decoding them gives the text back."""
    model = f"{tokenizers}/piece_bpe_32k.model"
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = unigram.encode_and_decode(docs, model)
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids", F.expr(f"decoded <=> replace(text, '{unigram.MARK}', ' ')").alias("round_trip"))


#: DuckDB: the unsigned CRC-32 of a row's doc_id as decimal digits.
CRC_SQL = """list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x:
      list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, x)), 4294967295)"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which a tenth, told by their ids, are made periodic from some word on first."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")))
    docs = docs.withColumns({"n": F.size("w"), "g": F.expr("h div 10")}).withColumn("a", F.expr("CASE WHEN n > 0 THEN cast(g % n AS int) END"))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    again = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) AS int))), 1, n - a)")
    planted = docs.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", F.concat(F.expr("slice(w, 1, a)"), again))).otherwise(F.col("text")).alias("text"))
    out = tandem.collapse_runs(planted).withColumn("best", tandem.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11_SQL = f"""
WITH crc AS (
  SELECT row_number() OVER () AS id, doc_id, xor({CRC_SQL}, 4294967295) AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) END AS a FROM crc),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT id, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM p),
x AS (SELECT id, n, unnest(range(n)) AS i, unnest(w) AS w FROM d),
e AS (SELECT b.id, b.i, c.i - b.i AS q FROM x b JOIN x c ON b.id = c.id AND b.w = c.w AND c.i > b.i AND 4 * (c.i - b.i) <= b.n),
s AS (SELECT id, q, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island, i FROM e),
t AS (SELECT id, q, min(i) AS s, count(*) + q AS length FROM s GROUP BY id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.id = t.id AND o.q < t.q AND o.s <= t.s AND o.s + o.length >= t.s + t.length)),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(length AS DOUBLE) / q DESC, s, q) AS place FROM r),
lines AS (SELECT id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY id),
gone AS (SELECT DISTINCT id, unnest(range(s + q, s + length)) AS i FROM r),
stay AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS short FROM x ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(short, '')) AS collapsed_sha256
FROM d LEFT JOIN lines USING (id) LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (id) LEFT JOIN stay USING (id)
"""


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(max(list_inner_product(q.e, c.e)) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and what its path says of a copy whose n_chars may be changed."""
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaves = docs.select("doc_id", "lang", merkle.digest_of(*fields).alias("leaf"), merkle.digest_of(*(changed if c == "n_chars" else c for c in fields)).alias("held"))
    out = merkle.verify(merkle.manifest(leaves), leaf=F.col("held"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda n: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field(n)} || {field('text')})"
    return f"""
WITH RECURSIVE crc AS (SELECT *, xor({CRC_SQL}, 4294967295) AS h FROM documents),
held AS (SELECT *, CASE WHEN h % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m FROM crc),
leaf AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, {leaf('m')} AS held FROM held),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(coalesce(lang, ''))) - 1 AS g FROM leaf),
tree AS (
  SELECT g, 0 AS lvl, i, leaf AS d, n FROM placed
  UNION ALL
  SELECT g, lvl + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, i // 2, n),
sub AS (SELECT g, lvl AS height, d AS subroot FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, g AS i, subroot AS d, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
nodes AS (SELECT g, lvl, i, d FROM tree UNION ALL SELECT -1, lvl, i, d FROM top),
steps AS (
  SELECT g, i, lvl AS z, g AS tg, lvl AS tl, xor(i >> lvl, 1) AS ti, (i >> lvl) & 1 AS odd FROM placed JOIN sub USING (g), range(60) r(lvl) WHERE lvl < height
  UNION ALL
  SELECT g, placed.i, height + lvl, -1, lvl, xor(g >> lvl, 1), (g >> lvl) & 1 FROM placed JOIN sub USING (g), range(60) r(lvl) WHERE lvl < (SELECT max(lvl) FROM top)),
paths AS (
  SELECT steps.g, steps.i, list({{'odd': odd = 1, 'd': coalesce(nodes.d, '')}} ORDER BY z) AS p
  FROM steps LEFT JOIN nodes ON nodes.g = tg AND nodes.lvl = tl AND nodes.i = ti GROUP BY steps.g, steps.i),
fold AS (
  SELECT placed.g, placed.i, 0 AS z, held AS d, p FROM placed LEFT JOIN paths USING (g, i)
  UNION ALL
  SELECT g, i, z + 1, sha256(CASE WHEN p[z + 1].odd THEN p[z + 1].d || d ELSE d || p[z + 1].d END), p FROM fold WHERE z < coalesce(len(p), 0)),
ends AS (SELECT g, i, d, p FROM fold WHERE z = coalesce(len(p), 0))
SELECT doc_id, leaf, subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(p, lambda x: x.d), ''), '')) AS proof_sha256,
  d AS folded_root, d = (SELECT d FROM top WHERE n = 1) AS verified
FROM placed JOIN sub USING (g) JOIN ends USING (g, i)
"""


OP13_SQL = _merkle_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_decontaminate": op2_decontaminate,
    "op3_secret_scan": op3_secret_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_nearest": op6_nearest,
    "op7_url_filter": op7_url_filter,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_license_scan": op9_license_scan,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_top_products": op12_top_products,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_secret_scan": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_nearest": OP6_SQL,
    "op7_url_filter": OP7_SQL,
    "op9_license_scan": OP9_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_top_products": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
