"""Operator 7: URL filtering by association rules over URL tokens, beneath fixed host and path rules.

Labelled URLs become baskets of tokens (the scheme, the host and each of its parent
domains, path segments with their digits masked, query keys) and of their label.  FP-growth finds
frequent baskets; rules whose consequent is the label "block" are kept where
their support and confidence reach the bounds, and where no rule with one token fewer
is as confident.

What such a rule can't hold never reaches FP-growth, whose work grows with 2 to the power of the tokens that occur together:
tokens with too few blocked URLs; all but one of the tokens that occur in the same labelled URLs, which stand
for each other as one item; and items that occur in blocked URLs only or in all URLs, which are rules by
themselves at most.  (A rule with two tokens of one item, or with such an item and another, has one with a token less that is as
confident.)  So no rule is lost, and a site whose URLs share a long path or many keys adds one item.  Items are told alike by
how many and which URLs they occur in, the latter by 128 bits of hash.

Rules are matched by an inverted index: each stands under its
rarest item, a URL meets the rules of its own items only, and a rule fires if the URL has a token of each of
its items.  A URL on which a rule fires is blocked.

Fixed rules come first: a rule (host, path) fits its host and all subdomains where the URL's
path starts with the rule's; the longest rule wins, and its verdict stands.

Defined results: a URL that is null or has no "://" has an empty host and path and no tokens, so no
rule fires and it is allowed; without labels, or with one-sided ones, nothing is mined; repeated
rows come out repeated; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to which the index is broadcast; a larger one is joined by its tokens.
FEW_RULES = 20_000
BLOCK = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL; none if it has no "://"."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(F.regexp_replace(path, r"\d+", "0"), "/"), lambda s: s != "")
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    found = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^(?s)(.*?)://", 1))),
        domains, F.transform(segments, lambda s: F.concat(F.lit("path:"), s)), F.transform(keys, lambda s: F.concat(F.lit("query:"), s)),
    )
    return F.when(url.contains("://"), F.array_distinct(found)).otherwise(F.expr("CAST(array() AS array<string>)"))


RULES = "items array<string>, anchor string, confidence double, support double"


def mine(labelled: DataFrame, *, url_col: str = "url", block_col: str = "block", support: float = 0.002, least_rows: int = 20, confidence: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """The pruned rules (items, anchor, confidence, support) from URLs with a boolean label, and the tokens (token, item) that items stand for.

    A rule's tokens and label stand together in the share `support` of the labelled URLs, and in `least_rows`, at least.
    """
    from .store import kept

    spark = labelled.sparkSession
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(block_col).isNotNull()).select(tokens_of(F.col(url_col)).alias("tokens"), F.col(block_col).alias("block"))
    rows = kept(rows.withColumn("id", F.monotonically_increasing_id()), "baskets")
    total, blocked = rows.agg(F.count("*"), F.count_if("block")).first()
    none = spark.createDataFrame([], RULES), spark.createDataFrame([], "token string, item string")
    if blocked < least_rows:
        return none
    share = max(support, least_rows / total)
    least = math.ceil(share * total)
    single = rows.select("id", "block", F.explode("tokens").alias("token"))
    counted = single.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("block").alias("n_block"), F.expr("bit_xor(xxhash64(id))").alias("a"), F.expr("bit_xor(xxhash64(id, 1))").alias("b")
    ).where(F.col("n_block") >= least)
    alike = counted.groupBy("n", "n_block", "a", "b").agg(F.min("token").alias("item"), F.collect_list("token").alias("members"))
    alike = kept(alike.select("item", "n", "n_block", "members"), "items")
    tokens = alike.select(F.explode("members").alias("token"), "item")
    simple = (F.col("n") == F.col("n_block")) | (F.col("n") == total)
    direct = alike.where(simple & (F.col("n_block") >= confidence * F.col("n"))).select(
        F.array("item").alias("items"), F.col("item").alias("anchor"), (F.col("n_block") / F.col("n")).alias("confidence"), (F.col("n_block") / total).alias("support")
    )
    mixed = alike.where(~simple).select(F.explode("members").alias("token"), "item")
    few = mixed.count()
    if not few:
        return direct, tokens
    held = single.join(F.broadcast(mixed) if few <= FEW_RULES else mixed, "token").groupBy("id").agg(F.collect_set("item").alias("own"))
    label = F.when(F.col("block"), F.array(F.lit(BLOCK))).otherwise(F.array(F.lit("=allow")))
    baskets = kept(rows.join(held, "id", "left").select(F.concat(F.coalesce("own", F.expr("CAST(array() AS array<string>)")), label).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == BLOCK).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    named = rules.select("*", F.xxhash64("items").alias("rule"))
    anchors = named.select("rule", F.explode("items").alias("item")).join(alike, "item").groupBy("rule").agg(F.min_by("item", F.struct("n", "item")).alias("anchor"))
    parts = named.select("rule", "items", "confidence", F.explode(F.filter(F.transform("items", lambda x: F.array_except("items", F.array(x))), lambda s: F.size(s) > 0)).alias("less"))
    shorter = named.select(F.col("items").alias("less"), F.col("confidence").alias("other"))
    needless = parts.join(shorter, "less").where("other >= confidence").select("rule").distinct()
    pruned = named.join(needless, "rule", "left_anti").join(anchors, "rule").select("items", "anchor", "confidence", "support")
    return pruned.union(direct), tokens


def fired(urls: DataFrame, rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """(url, confidence) of those distinct urls on which a rule fires, with the highest confidence."""
    few = lambda df: F.broadcast(df) if df.count() <= FEW_RULES else df
    own = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(few(tokens), "token").groupBy("url").agg(F.collect_set("item").alias("own"))
    met = own.select("url", "own", F.explode("own").alias("item")).join(few(rules), F.col("item") == F.col("anchor"))
    return met.where(F.size(F.array_except("items", "own")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of rules (verdict, host, path) that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        out = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, labelled: DataFrame, fixed: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", support: float = 0.002, confidence: float = 0.6) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) for every row of pages; labelled: (url, block boolean)."""
    from .store import kept

    rules, tokens = mine(labelled, support=support, confidence=confidence)
    rules = kept(rules, "rules")
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("fit", fixed_rule(F.col("host"), F.col("path"), fixed))
    if rules.isEmpty():
        judged = base.withColumn("confidence", F.lit(None).cast("double"))
    else:
        open_urls = base.where("fit IS NULL AND url IS NOT NULL").select("url").distinct()
        no_url = base.where("url IS NULL").withColumn("confidence", F.lit(None).cast("double"))
        judged = base.where("url IS NOT NULL").join(fired(open_urls, rules, tokens).hint("merge"), "url", "left").select(*base.columns, "confidence").union(no_url)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fit").isNull(), F.col("confidence")).alias("confidence"))
