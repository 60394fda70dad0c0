"""Operator 4: removal of near-duplicate lines by an exact set-similarity join, DataFrame functions only.

A line's tokens are its distinct words, split at spaces.  A line of `min_words` tokens and
more is removed if an earlier line, by document and then by place, resembles it:
100 * |A & B| >= percent * |A | B|.  Which earlier lines are removed themselves doesn't
matter, so the result doesn't depend on any order of work.

1. Equal lines are grouped; all but the first of a group go at once.
2. Words of all documents are counted in a table of fixed size.  A line's tokens are ordered
   by rarity (frequency class, then hash).  Any order gives the same result; a poor one makes more pairs to compare.
3. Of the rarer half of a line's tokens, six triples of the three of least hash and the three of largest are keys.
   Lines with a key in common are compared with the first of them only.
   Lines found similar are resolved and leave; this is repeated with the first of the others
   while it resolves many.  So groups of near copies, however large, give few pairs of
   their members: what follows asks for partners of unresolved lines only.  Where keys have so many
   lines that these could make more pairs than there are lines at all, step 4 is then done with one in SHARE ** 2 earlier lines
   only, say, and with one in SHARE, before it is done with all: a line with many partners resembles one of the few, and leaves with few pairs made.
4. A similar pair has its first common token among the first n - ceil(t n) + 1 of the longer line and the
   first n - ceil(2 t n / (1 + t)) + 1 of the shorter.  These prefixes are joined by token and class of lengths; pairs
   must pass the length filter, the position filter and bounds by parity bits of both token sets.
   The join runs over ranges of tokens in turn, which bounds what is on disk at once.
5. Candidates of both steps are verified by their words.

Documents come in order of their id; rows that share an id are documents in the order of their texts, and
rows without an id come after all others, in the order of a hash of their text.  Rows equal in id and
text are one document.

Defined results: null texts stay null; lines of fewer tokens always stay, blank ones among them; extra
columns are kept as they are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import dropped, kept

#: Word counters (a fixed size), and numbers of lines up to which a side is broadcast.
COUNTERS, FEW_ROWS = 1 << 18, 500_000
#: Documents, about, whose words are counted; None for all.
COUNTED: int | None = None
#: Lines that no text has more of: a text has less than this number of bytes.
MOST_PLACES = 1 << 31
#: Words of parity bits of a line, each for a range of tokens in their order.
WORDS = 4
#: The share of lines compared with a first one that must be resolved for another round, and bounds of the ranges of tokens, in parts of PARTS.
WORTH, PARTS, TURNS = 0.1, 16, ((0, 8), (8, 16))
#: The factor between a class of line lengths and the next.
STEP = 4 / 3
#: The keys of a line: which of the three tokens of least hash and the three of largest.
TRIPLES = ((0, 1, 2), (3, 4, 5), (0, 1, 3), (0, 3, 4), (1, 2, 4), (1, 4, 5))
KEYS = len(TRIPLES)
#: Lines of a key from which one in SHARE earlier lines is compared before all are; from its square on, one in its square before that, and so on.
SHARE = 64


def _words(line: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(line, " ")), "")


def _owned(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, str]:
    """(docs with the number `_own` of each document in their order, the places in a document, the type of numbers)."""
    number, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    # Rows without a text count too: so the texts aren't read here.
    by_id = docs.groupBy(number.alias("id")).agg(F.count("*").alias("c"))
    ids = by_id.agg(F.min("id"), F.max("id"), F.count_if(F.col("id").isNull()), F.max(F.when(F.col("id").isNotNull(), F.col("c"))))
    low, high, nulls, copies = ids.first()
    copies = copies or 1
    span, places = max(abs(low or 0), abs(high or 0)) + 1, MOST_PLACES
    if not nulls and (span + 1) * copies * places >= 1 << 62:
        places = (docs.agg(F.max(F.octet_length(text))).first()[0] or 0) + 1
    kind = "bigint" if not nulls and (span + 1) * copies * places < 1 << 62 else "decimal(38,0)"
    if copies > 1:
        hashed = F.when(number.isNull(), F.xxhash64(text))
        docs = docs.withColumn("_copy", F.dense_rank().over(Window.partitionBy(number, hashed).orderBy(text)) - 1)
    else:
        docs = docs.withColumn("_copy", F.lit(0))
    own = number.cast(kind) * F.lit(copies).cast(kind) + F.col("_copy")
    last = F.lit(str(span * copies)).cast(kind) + F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1))
    return docs.withColumn("_own", F.coalesce(own, last).cast(kind)).drop("_copy"), places, kind


def _levels(docs: DataFrame) -> str:
    """The frequency class of each word counter, as text: the logarithm of its count."""
    some = docs if COUNTED is None else docs.where(F.pmod(F.xxhash64("own"), F.lit(max(1, docs.count() // COUNTED))) == 0)
    words = some.select(F.explode_outer(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(COUNTERS - 1)).alias("c")).count()
    levels = [0] * COUNTERS
    for row in counts.groupBy(F.expr("CAST(log2(count) AS int)").alias("level")).agg(F.collect_list(F.col("c").cast("int")).alias("cs")).collect():
        for c in row["cs"]:
            levels[c] = min(row["level"], 31)
    return ",".join(map(str, levels))


def _cuts(levels: list[int]) -> list[int]:
    """Places in the order of tokens that part the occurrences of words, about, into WORDS equal shares."""
    weights = [0.0] * 32
    for level in levels:
        weights[level] += 1 << level
    # The lowest class also has the counters of no word, of which there may be any number.
    weights[0] = min(weights[0], 1 + sum(level > 0 for level in levels))
    cuts, share, level, below = [], sum(weights) / WORDS, 0, 0.0
    for w in range(1, WORDS):
        while below + weights[level] < w * share:
            below, level = below + weights[level], level + 1
        cuts.append((level << 58) + int((w * share - below) / weights[level] * ((1 << 58) - 1)))
    return cuts


def _lines(docs: DataFrame, kind: str, places: int) -> DataFrame:
    """(ord, line) of all lines of (own, text).  The outer form keeps the engine from splitting once more to see if there are any."""
    lines = docs.select("own", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(F.expr(f"CAST(own * CAST({places} AS {kind}) + pos AS {kind})").alias("ord"), "line")


def _tokens(first: DataFrame, docs: DataFrame, percent: int, min_words: int) -> DataFrame:
    """(ord, n, s0 to s3, e0, e1, k, m): each line's number of tokens, parity bits, ends of its tokens of the first range and of the first two, prefix of tokens in order of rarity, and keys of three tokens each."""
    empty = F.xxhash64(F.lit(""))
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))), empty)
    levels = _levels(docs)
    table = f"CAST(split('{levels}', ',') AS array<bigint>)"
    cuts = _cuts([int(level) for level in levels.split(",")])
    # The cuts are sorted among the keys, which gives their places; what lies between them is a line's tokens of a range.
    # A level that can't be null makes the keys numbers that are sorted as such.
    keys = F.expr(f"""sort_array(concat(transform(h, v -> shiftleft(coalesce({table}[v & {COUNTERS - 1}L], 0L), 58) | shiftrightunsigned(v, 6)), array({", ".join(f"{c}L" for c in cuts)})))""")
    keyed = first.select("ord", hashes.alias("h")).select("ord", keys.alias("k"))
    keyed = keyed.select("ord", "k", F.lit(0).alias("p0"), *(F.expr(f"CAST(array_position(k, {c}L) AS int) + {cuts[:w].count(c)}").alias(f"p{w + 1}") for w, c in enumerate(cuts)), (F.size("k") + 1).alias(f"p{WORDS}"))
    keyed = keyed.select("ord", *(F.expr(f"slice(k, p{w} + 1, p{w + 1} - p{w} - 1)").alias(f"g{w}") for w in range(WORDS)))
    parity = [F.expr(f"aggregate(g{w}, 0L, (a, v) -> a ^ shiftleft(1L, CAST(v & 63 AS int)))").alias(f"s{w}") for w in range(WORDS)]
    keyed = keyed.select("ord", F.concat(*(f"g{w}" for w in range(WORDS))).alias("k"), *parity, F.size("g0").alias("e0"), (F.size("g0") + F.size("g1")).alias("e1"))
    keyed = keyed.withColumn("h", F.expr("sort_array(transform(slice(k, 1, CAST((size(k) + 1) div 2 AS int)), v -> v & 288230376151711743L))"))
    at = [F.get("h", F.lit(i)) for i in range(3)] + [F.get("h", F.size("h") - i) for i in (1, 2, 3)]
    ends = F.when((F.size("h") >= 3) & (F.size("k") >= min_words), F.array(*(F.xxhash64(*(at[i] for i in triple)) for triple in TRIPLES)))
    n = F.size("k")
    prefix = F.slice("k", 1, n - F.expr(f"CAST(({percent} * size(k) + 99) div 100 AS int)") + 1)
    return keyed.select("ord", n.alias("n"), *(f"s{w}" for w in range(WORDS)), "e0", "e1", F.when(n >= min_words, prefix).alias("k"), ends.alias("m"))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows.hint("merge")


def _resolved(tokens: DataFrame, docs: DataFrame, kind: str, places: int, percent: int) -> DataFrame:
    """(ord): lines found similar to the first line with one of their keys."""
    # The outer form keeps the engine from working out the keys once more to see if there are any.
    keys = tokens.select("ord", F.explode_outer("m").alias("key")).where("key IS NOT NULL")
    shared = kept(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    longest = shared.agg(F.max("c")).first()[0] or 0
    alive = kept(keys.join(_few(shared.select("key")), "key", "left_semi"), "alive")
    words = _words_of(alive.select("ord"), docs, kind, places)
    gone = None
    while True:
        later = kept(alive.join(alive.groupBy("key").agg(F.min("ord").alias("y")).hint("merge"), "key").where("ord > y"), "alive")
        pairs = kept(later.select(F.col("ord").alias("x"), "y").distinct(), "pairs")
        found = _similar(pairs, words, percent)
        gone = found if gone is None else gone.union(found)
        if found.count() < max(1, WORTH * pairs.select("x").distinct().count()):
            break
        alive = kept(later.select("key", "ord").join(_few(found), "ord", "left_anti"), "alive")
    dropped(words)
    shares, lines = [1], tokens.count()
    while shares[-1] * SHARE <= longest:
        shares.append(shares[-1] * SHARE)
    for share in shares[:0:-1]:
        # Two lines of a group have up to KEYS keys in common.  Groups with fewer pairs than there are lines can do without.
        if shared.where(f"c >= {share}").agg(F.sum(F.expr("CAST(c AS double) * c"))).first()[0] > 2 * KEYS * lines:
            gone = gone.union(_joined(tokens, gone, docs, kind, places, percent, share))
    return gone


def _class(n: str) -> str:
    """The class of a line's length, as SQL: each class's lengths grow by a factor of STEP."""
    return f"CAST(floor(ln({n}) / {math.log(STEP)!r}) AS int)"


def _prefix_pairs(tokens: DataFrame, percent: int, turn: tuple[int, int], share: int = 1) -> DataFrame:
    """(x, y): lines, the later first, that pass all filters at a token of the range; the later one is open.  tokens: (ord, n, s0 to s3, e0, e1, k, open).

    The earlier one is of a share of all lines, by a hash of their numbers.
    """
    size = {"x": f"n - CAST(({percent} * n + 99) div 100 AS int) + 1", "y": f"n - CAST((2 * {percent} * n + {99 + percent}) div {100 + percent} AS int) + 1"}
    # Rows are joined in their numbers n and left, the range of their token and their mark open as one: what is moved and sorted is most of the work.
    n, left, is_open = (lambda side: f"shiftright({side}.m, 33)"), (lambda side: f"(shiftright({side}.m, 1) & 1073741823L)"), (lambda side: f"({side}.m & 1L) = 1L")
    # An overlap o is enough where (100 + percent) * o >= percent * (x.n + y.n).
    both = f"({n('x')} + {n('y')})"
    enough = lambda o: f"{100 + percent} * {o} >= {percent} * {both}"
    # The words of the two ranges of commonest tokens are joined as one, the parity of both: rows are narrower and the bound still holds.
    bits = [*(f"s{w}" for w in range(WORDS - 2)), "sl"]
    differ = "(" + " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in bits) + ")"
    # At a pair's first common token all tokens before it differ, and so do those of which the bits of later ranges tell.
    before = f"({both} - {left('x')} - {left('y')})"
    later = "CASE shiftright(x.m, 31) & 3L WHEN 0L THEN bit_count(x.s1 ^ y.s1) + bit_count(x.sl ^ y.sl) WHEN 1L THEN bit_count(x.sl ^ y.sl) ELSE 0 END"
    passes = " AND ".join((
        "x.key = y.key", f"{n('y')} <= {n('x')}", enough(left("x")), enough(left("y")), enough(n("y")),
        f"{100 + percent} * ({both} - {differ}) >= {2 * percent} * {both}",
        f"{100 + percent} * ({both} - {before} - {later}) >= {2 * percent} * {both}",
        "x.ord <> y.ord", f"({n('y')} < {n('x')} OR y.ord < x.ord)", f"CASE WHEN x.ord > y.ord THEN {is_open('x')} ELSE {is_open('y')} END",
    ))

    def rows(side: str, lines: DataFrame) -> DataFrame:
        lines = lines.withColumn("sl", F.expr(f"s{WORDS - 2} ^ s{WORDS - 1}"))
        keys = lines.select("ord", "n", "open", "e0", "e1", *bits, F.posexplode_outer(F.expr(f"slice(k, 1, {size[side]})")).alias("i", "key"))
        keys = keys.where(f"pmod(key, {PARTS}) >= {turn[0]} AND pmod(key, {PARTS}) < {turn[1]}")
        # The longer line is at its own class of lengths, the shorter one at all that hold a length its rest from the token on can be enough for.
        longest = f"({100 + percent} * (n - i)) div {percent} - n"
        at = F.expr(_class("n")) if side == "x" else F.explode(F.expr(f"sequence({_class('n')}, greatest({_class('n')}, {_class(longest)}))"))
        keys = keys.withColumn("at", at).withColumn("key", F.expr("key ^ shiftleft(CAST(at AS bigint), 48)"))
        return keys.select("key", "ord", F.expr("shiftleft(CAST(n AS bigint), 33) | shiftleft(CAST(IF(i < e0, 0, IF(i < e1, 1, 2)) AS bigint), 31) | shiftleft(CAST(n - i AS bigint), 1) | IF(open, 1L, 0L)").alias("m"), *bits).alias(side)

    if share == 1:
        pairs = rows("x", tokens).join(rows("y", tokens).hint("merge"), F.expr(passes)).select("x.ord", "y.ord")
    else:
        late, early = tokens.where("open"), tokens.where(f"pmod(xxhash64(ord), {share}) = 0")
        longer = rows("x", late).join(rows("y", early).hint("shuffle_hash"), F.expr(f"{passes} AND y.ord < x.ord")).select("x.ord", "y.ord")
        shorter = rows("y", late).join(rows("x", early).hint("shuffle_hash"), F.expr(f"{passes} AND x.ord < y.ord")).select("x.ord", "y.ord")
        pairs = longer.union(shorter)
    return kept(pairs.toDF("i", "j").select(F.greatest("i", "j").alias("x"), F.least("i", "j").alias("y")).distinct(), "pairs")


def _words_of(ords: DataFrame, docs: DataFrame, kind: str, places: int) -> DataFrame:
    """(ord, words) of the lines with these numbers."""
    at = F.expr(f"CAST(pmod(ord, CAST({places} AS {kind})) AS int)")
    ends = kept(ords.distinct().groupBy(_owner("ord", kind, places).alias("own")).agg(F.collect_list(at).alias("at")), "ends")
    few = (ends.agg(F.sum(F.size("at"))).first()[0] or 0) <= FEW_ROWS
    some = docs.join(F.broadcast(ends) if few else ends.hint("merge"), "own").withColumn("lines", F.split("text", "\n"))
    # Two uses of a text's lines keep the engine from splitting the text once for each line.
    some = some.select("own", F.explode(F.expr("transform(at, p -> named_struct('pos', p, 'line', IF(p < size(lines), lines[p], NULL)))")).alias("one"))
    lines = some.select(F.expr(f"CAST(own * CAST({places} AS {kind}) + one.pos AS {kind})").alias("ord"), F.col("one.line").alias("line"))
    words = kept(lines.select("ord", _words(F.col("line")).alias("words")), "words")
    dropped(ends)
    return words


def _similar(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """(ord): the later lines of those pairs (x, y) whose words are similar."""
    both = F.size(F.array_intersect("wx", "wy"))
    full = pairs.join(words.select(F.col("ord").alias("x"), F.col("words").alias("wx")), "x").join(words.select(F.col("ord").alias("y"), F.col("words").alias("wy")), "y")
    return kept(full.where(100 * both >= percent * (F.size("wx") + F.size("wy") - both)).select(F.col("x").alias("ord")).distinct(), "similar")


def _joined(tokens: DataFrame, gone: DataFrame, docs: DataFrame, kind: str, places: int, percent: int, share: int = 1) -> DataFrame:
    """(ord): lines not gone that are similar to an earlier one, of a share of all lines, by the join of prefixes."""
    marked = tokens.join(_few(gone.withColumn("hit", F.lit(True))), "ord", "left").withColumn("open", F.col("hit").isNull())
    parts = [_prefix_pairs(marked, percent, turn, share) for turn in TURNS]
    pairs = kept(reduce(DataFrame.union, parts).distinct(), "pairs")
    words = _words_of(pairs.select(F.explode(F.array("x", "y")).alias("ord")), docs, kind, places)
    found = _similar(pairs, words, percent)
    dropped(pairs, words, *parts)
    return found


def _owner(order: str, kind: str, places: int) -> Column:
    at = f"({order} - pmod({order}, CAST({places} AS {kind})))"
    return F.expr(f"{at} div {places}" if kind == "bigint" else f"CAST({at} / {places} AS {kind})")


def kept_places(owned: DataFrame, text_col: str, places: int, kind: str, percent: int, min_words: int) -> DataFrame:
    """(own, stay): for each document with any the places of its lines that stay, of lines with `min_words` tokens and more."""
    docs = owned.select(F.col("_own").alias("own"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    lines = _lines(docs, kind, places).where(F.octet_length("line") >= 2 * min_words - 1)
    first = lines.groupBy("line").agg(F.min("ord").alias("ord"))
    tokens = kept(_tokens(first, docs, percent, min_words), "tokens")
    gone = _resolved(tokens, docs, kind, places, percent)
    gone = gone.union(_joined(tokens, gone, docs, kind, places, percent))
    stay = tokens.where("k IS NOT NULL").select("ord").join(_few(gone), "ord", "left_anti")
    stay = stay.select(_owner("ord", kind, places).alias("own"), F.expr(f"CAST(pmod(ord, CAST({places} AS {kind})) AS int)").alias("pos"))
    return stay.groupBy("own").agg(F.sort_array(F.collect_list("pos")).alias("stay"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, min_words: int = 1) -> DataFrame:
    """docs with each text's lines that stay, in their order."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    id_col, text_col = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    owned, places, kind = _owned(plain, id_col, text_col)
    stay = kept_places(owned, text_col, places, kind, percent, min_words)
    stay = stay.select(F.col("own").alias("_own"), F.col("stay").alias("_stay"))
    full = owned.join(stay.hint("shuffle_hash"), "_own", "left").withColumn("_lines", F.split(F.col(text_col).cast("string"), "\n"))
    few_words = (lambda line: F.trim(line) == "") if min_words == 1 else (lambda line: F.size(_words(line)) < min_words)
    short = F.array_compact(F.transform("_lines", lambda line, at: F.when(few_words(line), at)))
    full = full.withColumn("_places", F.sort_array(F.concat(short, F.coalesce("_stay", F.array().cast("array<int>")))))
    text = F.array_join(F.transform("_places", lambda at: F.col("_lines")[at]), "\n")
    return full.withColumn(text_col, F.when(F.col(text_col).isNotNull(), text)).select(*plain.columns).toDF(*docs.columns)
