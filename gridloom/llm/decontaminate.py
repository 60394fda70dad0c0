"""Operator 2: benchmark decontamination by a size-partitioned MinHash containment search, DataFrame functions only.

An item is contained in a text if the text holds the share `share` of the item's distinct
word shingles.  Items are short and texts may be long, so their resemblance
says little; the search therefore sketches both sides by the least values of one
hash, with sketch sizes that depend on the item's size.  An item of q shingles keeps its m = q - ceil(share q) + 1
least hash values: of any m of its shingles a text that contains it holds one at
least, so a collision is certain.  Items are partitioned by size (powers of two), and a partition has the least number
of shingles that a text needs to contain one of its items.  The hash range is cut into buckets; a
bucket's need is the least number of the partitions whose sketches have values in it.  A text's sketch are those of its own
values that lie in buckets whose need its number of shingles reaches: values beyond the partitions' thresholds, of
empty buckets, or of partitions of larger items only are never looked up.  What remains meets the items' sketches
by value and partition, and candidates are verified by their shingles themselves, as strings.

Words are split at white space after lower-casing.  Defined results: null and empty texts
contain nothing; null or empty items are contained in nothing; a text or item of fewer
words than the width has its whole sequence as its only shingle, so a shorter item is found only in a text that
equals it; repeated rows and rows that share an id are found each; null ids stay null; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of item sketches, and texts to verify, up to which they are broadcast; more are joined by shuffles.
FEW_SKETCHES, FEW_TEXTS = 500_000, 200_000
#: Most buckets of the hash range, as powers of two; there are about sixteen for each sketch value, up to these.
BUCKET_BITS = 16


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _windows(text: Column, width: int, of) -> Column:
    """of(...) applied to each run of `width` words; the array of words is made once a row."""

    def each(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own) - (width - 1), F.lit(1)))
        return F.when(F.size(own) > 0, F.transform(starts, lambda i: of(F.slice(own, i, width))))

    return F.element_at(F.transform(F.array(words(text)), each), 1)


def shingle_values(text: Column, width: int) -> Column:
    """Hash values of a text's shingles, or null if it has none."""
    return _windows(text, width, lambda run: F.xxhash64(run))


def shingles(text: Column, width: int) -> Column:
    """A text's distinct shingles as strings, or null if it has none."""
    return F.array_distinct(_windows(text, width, lambda run: F.array_join(run, " ")))


def sketched(sized: DataFrame, share: float) -> DataFrame:
    """(item_id, need, sketch) of items (item_id, sorted values): the partition's need, and the item's least values."""
    size = F.size("values")
    m = size - F.ceil(size * F.lit(share)).cast("int") + 1
    # A text's shingles are counted with repeats, so it has as many as the least item of the partition asks for.
    need = F.ceil(F.pow(F.lit(2), F.floor(F.log2(size))) * F.lit(share)).cast("int")
    return sized.select("item_id", need.alias("need"), F.slice("values", 1, m).alias("sketch"))


def _bucket(value: Column, bits: int) -> Column:
    """The number of a value's bucket among 2**bits equal ones."""
    return (F.shiftright(value, 64 - bits) + F.lit(1 << bits - 1)).cast("int")


def bucket_needs(index: DataFrame, bits: int) -> list[int]:
    """For each bucket of index (value, need) the least need, or a number that no text reaches where it is empty."""
    out = [2**31 - 1] * (1 << bits)
    # At most as many rows as there are buckets.
    for r in index.groupBy(_bucket(F.col("value"), bits).alias("b")).agg(F.min("need").alias("need")).collect():
        out[r["b"]] = r["need"]
    return out


def looked_up(texts: DataFrame, needs: list[int], top: int) -> DataFrame:
    """(doc_id, text_key, n, value): of texts (doc_id, text_key, values) the values up to top in buckets whose need the text reaches, and its number of shingles."""
    bits = len(needs).bit_length() - 1
    # A constant, which the optimizer makes once.
    table = F.split(F.lit(",".join(map(str, needs))), ",").cast("array<int>")
    n = F.size("values")
    # Most values are past the largest one of all sketches, which is quickly told.
    some = F.filter("values", lambda v: (v <= F.lit(top)) & (F.get(table, _bucket(v, bits)) <= n))
    # The outer form keeps the engine from making the values once more to see if there are any.
    return texts.select("doc_id", "text_key", n.alias("n"), F.explode_outer(some).alias("value"))


def contained(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, share: float = 0.75) -> DataFrame:
    """(doc_id, text_key, item_id, n_shared, n_item, containment) of every text that contains an item.

    text_key is a hash of the text, which tells apart rows that share an id.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    sized = items.select("item_id", F.array_sort(F.array_distinct(shingle_values(F.col("item_text"), width))).alias("values")).where(F.size("values") > 0)
    sketches = sketched(sized, share)
    found = "doc_id {}, text_key long, item_id {}, n_shared long, n_item long, containment double".format(docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    index = sketches.select("item_id", "need", F.explode("sketch").alias("value"))
    count = index.count()
    if not count:
        return docs.sparkSession.createDataFrame([], found)
    few = count <= FEW_SKETCHES
    needs = bucket_needs(index, min(BUCKET_BITS, max(1, (16 * count - 1).bit_length())))
    top = index.agg(F.max("value")).first()[0]
    own = looked_up(docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), shingle_values(F.col("text"), width).alias("values")), needs, top)
    met = own.join(F.broadcast(index) if few else index, "value").where("n >= need").select("doc_id", "text_key", "item_id").distinct()
    from .store import kept

    pairs = kept(met, "contained")
    keys = pairs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    keys = F.broadcast(keys) if keys.count() <= FEW_TEXTS else keys.hint("merge")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    texts = keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    held = texts.select("doc_id", "text_key", F.explode_outer(shingles(F.col("text"), width)).alias("shingle"))
    wanted = items.select("item_id", shingles(F.col("item_text"), width).alias("all"))
    wanted = wanted.select("item_id", F.size("all").alias("n_item"), F.explode("all").alias("shingle"))
    own_pairs = pairs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("item_id").alias("i"))
    shared = held.join(F.broadcast(wanted) if few else wanted, "shingle").groupBy("doc_id", "text_key", "item_id").agg(F.count("*").alias("n_shared"), F.max("n_item").cast("long").alias("n_item"))
    exact = shared.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(share)))
    exact = exact.join(own_pairs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi")
    return exact.select("doc_id", "text_key", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text contains an item."""
    from .store import kept

    leaks = kept(contained(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_leak_id"), F.col("text_key").alias("_leak_key")).distinct(), "leaks")
    leaks = F.broadcast(leaks) if leaks.count() <= FEW_TEXTS else leaks.hint("merge")
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col("_leak_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_leak_key")), "left_anti")
