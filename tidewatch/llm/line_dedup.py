"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, ordered by rarity: how often the word's hash class occurs in all texts, in
CLASSES classes, so that the table every task reads has one size whatever the corpus. Lines are similar at a Jaccard
similarity of 4/5 or more. Similar lines share a token among the first n - ceil(4n/5) + 1 of each (prefix filter); at
the first one they share, enough tokens must be left (positional filter), and their sizes must be near (length
filter). A pair's
first tokens, which are stored, must then not differ too often, and what is left is verified on the words themselves. A line goes if an earlier one, by doc_id and place, is
similar to it.

Equal lines are one row from the start. A key with up to ROOM lines gives its pairs; one with more is handled so that
the work never grows with the square of its lines:

1. each of its lines is compared with the HEADS earliest and the HEADS most central lines of about its own length
   (central: few rarer tokens before the key), so a group of near copies goes at once;
2. if at most WIDE of its lines are left, these are compared with its earlier lines;
3. else each line goes on under the key and one more of its next tokens: similar lines share l tokens among the first
   n - ceil(4n/5) + l. After DEEP tokens step 2 is taken whatever the number.

Comparing is done in the join: sizes, places and 64 bits that stand for the tokens; only what passes is a pair.

Whole documents go the same way through one_of_each(): a document is one line, and its tokens are its shingles.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.shared import documents, drop, free, let, near, stored, text_of, words_of

CLASSES, ROOM, WIDE, HEADS, DEEP = 1 << 20, 256, 1024, 8, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = " \t\n\x0b\x0c\r"
LEVEL = 1 << 56  # a token is its class's level times this, plus 56 bits of its hash
ALONE = 5  # the level from which a class occurs twice or more, see level_of(): a token of a lower one is in no second line


def units(line: Column, shingle: int = 0) -> Column:
    """What a line's tokens stand for: its words, or its shingles of so many words, in which A to Z count as a to z.

    A text of fewer words is one shingle, and so is an empty one.
    """
    if not shingle:
        return words_of(line)
    words = words_of(F.translate(line, UPPER, UPPER.lower()))

    def joined(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0)))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(shingle)), " "))

    return let(words, joined)


def hashed(line: Column, shingle: int) -> Column:
    """A 64-bit hash of each shingle's hashes of words."""
    words = words_of(F.translate(line, UPPER, UPPER.lower()))

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(h, i + 1, F.lit(shingle))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def level_of(times: Column) -> Column:
    return F.least(F.lit(127), 1 + F.floor(3 * F.log2(1 + times))).cast("int")


def rarity(lines: DataFrame, classes: int = CLASSES, shingle: int = 0) -> bytes:
    """A byte for each hash class of the words (or shingles) of all lines: 1 + 3 log2(1 + times), so the driver gets as many bytes as there are classes."""
    units_of = hashed(F.col("line"), shingle) if shingle else words_of(F.col("line"))
    each = lines.select(F.explode(units_of).alias("u"))
    code = F.col("u") if shingle else F.xxhash64("u")
    times = each.groupBy(code.bitwiseAND(F.lit(classes - 1)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    dense = lines.sparkSession.range(classes).select(F.col("id").alias("c")).join(times, "c", "left")
    pair = F.struct("c", level_of(F.coalesce("n", F.lit(0))).alias("level"))
    runs = dense.groupBy(F.shiftright("c", 10).alias("run")).agg(F.sort_array(F.collect_list(pair)).alias("l"))
    rows = runs.select("run", F.array_join(F.transform("l", lambda x: F.char(x["level"])), "").alias("levels")).collect()
    return "".join(r["levels"] for r in sorted(rows, key=lambda r: r["run"])).encode("ascii")


def distinct_hashes(line: Column, shingle: int = 0) -> Column:
    """A hash of 64 bits for each distinct word or shingle of the line, each word hashed once."""
    return F.array_distinct(hashed(line, shingle) if shingle else F.transform(words_of(line), lambda w: F.xxhash64(w)))


def ranked(hashes: Column, levels: bytes) -> Column:
    """Distinct hashes as sorted numbers, rarest first: the class's level, then 56 bits of the hash."""
    table = F.lit(bytearray(levels))

    def code(h: Column) -> Column:
        at = h.bitwiseOR(F.lit(-len(levels))).cast("int")  # counted from the table's end, which takes no addition
        level = F.ascii(F.substr(table, at, F.lit(1)).cast("string")).cast("long")
        return h.bitwiseAND(F.lit(LEVEL - 1)).bitwiseOR(F.call_function("shiftleft", level, F.lit(56)))

    return F.sort_array(F.transform(hashes, code))


def tokens(line: Column, levels: bytes, shingle: int = 0) -> Column:
    """The line's distinct words or shingles as sorted numbers, each looked up once."""
    return ranked(distinct_hashes(line, shingle), levels)


def signature(tokens: Column) -> Column:
    """64 bits, each set if an odd number of tokens falls on it: sets that differ in d tokens differ in d bits at most."""
    one = F.lit(1).cast("long")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63)).cast("int"))))


#: Ids count from one below the smallest for null, which so comes first; a number of 38 digits holds id, 31 bits of tie and place.
NO_ID, ID_UNIT, TIE_UNIT = -(1 << 63) - 1, 1 << 62, 1 << 31


def placed(docs: DataFrame, doc_id: str, text: str, whole: bool = False) -> DataFrame:
    """A row per line with a word, or per text if whole: doc_id, tie (a hash of the whole text), at (from 0), line, and place, a number that orders lines by these three."""
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    t, own = text_of(text), F.col(f"`{doc_id}`").cast("long")
    tie = F.xxhash64(t)
    begin = F.coalesce(own.cast("decimal(20,0)"), number(NO_ID)) * number(ID_UNIT) + tie.bitwiseAND(F.lit(TIE_UNIT - 1)) * F.lit(TIE_UNIT)
    lines = F.array(t) if whole else F.split(t, "\n", -1)
    rows = docs.select(own.alias("doc_id"), tie.alias("tie"), begin.cast("decimal(38,0)").alias("begin"), lines.alias("lines"))
    # outer, as Spark would else split each text once more, to see whether it has lines; each has one at least
    each = rows.select("doc_id", "tie", "begin", F.posexplode_outer("lines").alias("at", "line"))
    if not whole:
        each = each.filter(F.length(F.btrim("line", F.lit(BLANK))) > 0)
    return each.select("doc_id", "tie", "at", "line", (F.col("begin") + F.col("at")).cast("decimal(38,0)").alias("place"))


def need(n: Column, m: Column) -> Column:
    """Tokens that sets of n and m share at least at a similarity of 4/5: 9 * shared >= 4 * (n + m)."""
    return F.floor((4 * (n + m) + 8) / 9)


def reach(n: Column) -> Column:
    """How many of n tokens the prefix filter looks at: n - ceil(4n/5) + 1."""
    return F.floor(n / 5).cast("int") + 1


def may_be(x: str, y: str, level: int) -> Column:
    """Length and positional filter, and that of the 64 bits, for sets x and y (n, i, bits) whose level-th common token stands at i.

    All in whole numbers, as this is asked for every two sets that meet: shared >= need is 9 * shared >= 4 * (n + m), and
    bits that differ are odd in number if n + m is, so they are n + m - 2 * need at most if 9 times them are at most n + m.
    """
    n, i, m, j = (F.col(f"{x}.n"), F.col(f"{x}.i"), F.col(f"{y}.n"), F.col(f"{y}.i"))
    near_size = F.least(n, m) * 5 >= F.greatest(n, m) * 4
    enough_left = 9 * (F.least(n - i, m - j) + (level - 1)) >= 4 * (n + m)
    return near_size & enough_left & (9 * F.bit_count(F.col(f"{x}.bits").bitwiseXOR(F.col(f"{y}.bits"))) <= n + m)


POST = ("key", "id", "n", "i", "bits")


def calm_pairs(posts: DataFrame, level: int) -> DataFrame:
    """Pairs (a, b, and how many tokens they share at least if they are similar) of the sets that meet at keys of few sets and pass the filters.

    x is the smaller set of a pair. It shares 8/9 of its n tokens at least, so one beyond its first n - ceil(8n/9) + level
    is not where the positional filter lets a pair pass, and x is left out there before it meets others.
    """
    there = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in POST])  # always so; Spark asks for it on both sides, and not in the same place
    dealt = posts.select(*POST).filter(there).repartition("key")
    # tied to where a row is, or Spark would leave rows out before they are dealt, and deal them to x and y apart
    x, y = dealt.filter(F.when(F.spark_partition_id() >= 0, F.col("i") < F.floor(F.col("n") / 9) + level)).alias("x"), dealt.alias("y")
    once = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & once & may_be("x", "y", level))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), need(F.col("x.n"), F.col("y.n")).alias("least"))


def span(n: Column) -> Column:
    """Sizes that differ by a tenth or so have the same span."""
    return F.floor(F.log(n) * 10).cast("int")


def top(rows: DataFrame, count: int, *order: str) -> DataFrame:
    """The first rows of each key and span, at most so many; Spark drops the others before it shuffles."""
    place = F.row_number().over(Window.partitionBy("key", "span").orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= count).drop("place")


def head_pairs(busy: DataFrame, level: int, heads: int) -> DataFrame:
    """Of crowded keys, each set with the earliest and the most central ones of its span; busy has POST and first."""
    own = busy.select(*POST, "first", span(F.col("n")).alias("span"))
    head = top(own, heads, "first", "id").unionByName(top(own, heads, "i", "first", "id"))
    x, h = own.alias("x"), near(head).alias("h")
    same = (F.col("x.key") == F.col("h.key")) & (F.col("x.span") == F.col("h.span")) & (F.col("x.id") != F.col("h.id"))
    return x.join(h, same & may_be("x", "h", level)).select(F.col("h.id").alias("a"), F.col("x.id").alias("b"), need(F.col("x.n"), F.col("h.n")).alias("least"))


def open_pairs(rows: DataFrame, level: int) -> DataFrame:
    """Each set that no earlier one is known to be similar to (open), with the earlier ones of its key."""
    x, y = rows.filter("open").alias("x"), rows.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("y.first") < F.col("x.first")) & may_be("x", "y", level))
    return met.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), need(F.col("x.n"), F.col("y.n")).alias("least"))


def sieved(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose stored tokens do not differ too often already.

    Up to the lesser of the last ones that are stored, all tokens of both sets are known. Where they differ there, the
    whole sets do, and similar sets of n and m differ in n + m - 2 * least tokens at most.
    """
    x, y = (sets.select(F.col("id").alias(k), F.col("n").alias(n), F.col("prefix").alias(p)) for k, n, p in (("a", "n", "p"), ("b", "m", "q")))
    last = lambda p, n: F.when(F.col(n) > F.size(p), F.element_at(p, -1)).otherwise(F.lit((1 << 63) - 1))
    known = lambda p, cut: F.size(F.filter(p, lambda t: t <= cut))
    differ = let(F.least(last("p", "n"), last("q", "m")), lambda cut: known("p", cut) + known("q", cut)) - 2 * F.size(F.array_intersect("p", "q"))
    return pairs.join(x, "a").join(y, "b").filter(differ <= F.col("n") + F.col("m") - 2 * F.col("least")).select("a", "b", "least")


def agreeing(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """late of each pair (late, early, least) that shares enough words (or shingles); a late line may come more than once."""
    x, y = ([F.col("id").alias(k), F.col("line").alias(v)] for k, v in (("late", "x"), ("early", "y")))
    shared = F.size(F.array_intersect(units(F.col("x"), shingle), units(F.col("y"), shingle)))
    return pairs.join(texts.select(*x), "late").join(texts.select(*y), "early").filter(shared >= F.col("least")).select("late")


def members(pairs: DataFrame) -> DataFrame:
    """id of each line that is in a pair."""
    return near(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())


def verified(pairs: DataFrame, lines: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """id of the later line of each pair that shares enough words (or shingles), stored.

    Pairs are sieved by the tokens that are stored, and only texts that are still in a pair move. As one similar
    earlier line is enough, each line is first held against its earliest partner; all other pairs are verified for the
    lines that this does not settle.
    """
    few = stored(sets.select("id", "n", "prefix").join(members(pairs), "id", "left_semi"))
    likely = stored(sieved(pairs, few))
    drop(few)
    texts = stored(lines.select("id", "first", "line").join(members(likely), "id", "left_semi"))
    x = texts.select(F.col("id").alias("a"), F.col("first").alias("fx"))
    y = texts.select(F.col("id").alias("b"), F.col("first").alias("fy"))
    after = F.col("fx") < F.col("fy")
    later, earlier = F.when(after, F.col("b")).otherwise(F.col("a")), F.when(after, F.col("a")).otherwise(F.col("b"))
    turned = stored(likely.join(x, "a").join(y, "b").select(later.alias("late"), earlier.alias("early"), "least", F.least("fx", "fy").alias("since")))
    head = turned.groupBy("late").agg(F.min(F.struct("since", "early", "least")).alias("e")).select("late", "e.since", "e.early", "e.least")
    heads = stored(head)
    found = stored(agreeing(heads, texts, shingle))
    rest = turned.join(found, "late", "left_anti").join(heads.select("late", "early"), ["late", "early"], "left_anti")
    out = stored(found.unionByName(agreeing(rest, texts, shingle).distinct()).select(F.col("late").alias("id")))
    for done in (likely, texts, turned, heads, found):
        drop(done)
    return out


def crowded(posts: DataFrame, room: int) -> DataFrame:
    """The keys with more than room sets, counted before they move."""
    return near(stored(posts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > room).select("key")))


def extended(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """The sets of crowded keys under their key and each of the tokens that may come next, at the given level."""
    own = rows.select(*POST, "first").join(sets.select("id", "prefix"), "id")
    rest = F.slice("prefix", F.col("i") + 2, F.greatest(reach(F.col("n")) + (level - 2) - F.col("i"), F.lit(0)))
    each = own.select("id", "n", "bits", "first", "key", F.col("i").alias("last"), F.posexplode(rest).alias("j", "token"))
    return each.select(F.xxhash64("key", "token").alias("key"), "id", "n", (F.col("last") + 1 + F.col("j")).alias("i"), "bits", "first")


def late_lines(lines: DataFrame, levels: bytes, room: int, wide: int, heads: int, shingle: int) -> DataFrame:
    """id of each of the distinct lines (id, line, first) that is similar to an earlier one."""
    n = F.size("h")
    bits = F.lit(0).cast("long") if shingle else signature(F.col("h"))  # a text has so many shingles that 64 bits tell nothing
    with_hashes = lines.select("id", "first", distinct_hashes(F.col("line"), shingle).alias("h"))
    prefix = F.slice(ranked(F.col("h"), levels), F.lit(1), reach(n) + DEEP - 1)
    sets = stored(with_hashes.select("id", "first", n.alias("n"), bits.alias("bits"), prefix.alias("prefix")))
    posts = sets.select("id", "n", "bits", F.posexplode(F.slice("prefix", F.lit(1), reach(F.col("n")))).alias("i", "key")).select(*POST)
    posts = posts.filter(F.col("key") >= ALONE * LEVEL)
    # a key is in no more lines than its class in all texts, so rarer classes need no count
    enough = min(127, 1 + int(3 * math.log2(1 + room)))
    hot = crowded(posts.filter(F.col("key") >= enough * LEVEL), room)
    busy = stored(posts.join(hot, "key", "left_semi").join(sets.select("id", "first"), "id").select(*POST, "first"))
    pairs = stored(calm_pairs(posts.join(hot, "key", "left_anti"), 1).unionByName(head_pairs(busy, 1, heads)).distinct())
    late = verified(pairs, lines, sets, shingle)
    level = 1
    while not busy.isEmpty():
        known = late.select("id", F.lit(False).alias("open"))
        rows = stored(busy.join(known, "id", "left").select(*POST, "first", F.coalesce("open", F.lit(True)).alias("open")))
        left = stored(rows.groupBy("key").agg(F.count_if("open").alias("left")).filter("left > 0"))
        few = left if level == DEEP else left.filter(F.col("left") <= wide)
        pairs = open_pairs(rows.join(near(few.select("key")), "key", "left_semi"), level)
        busy = rows.join(near(left.join(few, "key", "left_anti").select("key")), "key", "left_semi")
        if level < DEEP and not busy.isEmpty():
            posts = stored(extended(busy, sets, level + 1))
            hot = crowded(posts, room)
            busy = stored(posts.join(hot, "key", "left_semi"))
            pairs = pairs.unionByName(calm_pairs(posts.join(hot, "key", "left_anti"), level + 1)).unionByName(head_pairs(busy, level + 1, heads))
        else:
            busy = busy.filter("false")
        pairs = stored(pairs.distinct())
        if not pairs.isEmpty():
            late = stored(late.unionByName(verified(pairs, lines, sets, shingle)).distinct())
        level += 1
    drop(sets)
    return late


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", room: int = ROOM, wide: int = WIDE, heads: int = HEADS, shingle: int = 0) -> DataFrame:
    """Of each document that loses lines: doc_id, tie (a hash of its text), removed (places of lines from 0, sorted).

    Order is by doc_id (null first), then the hash of the text, then place, so equal rows lose the same lines. Lines
    without a word are no one's copy and stay. With shingle, each text is one line and its tokens are shingles of so
    many words; empty texts are then equal to each other. Null texts count as empty, an empty table gives no rows,
    other columns are ignored whatever their names. Equal lines are found by their texts and similar ones verified on
    their words; a line's own copies are found again by 128 bits of hash.
    """
    marks = lambda line: (F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"))
    all_lines = placed(docs, doc_id, text, shingle > 0)
    grouped = all_lines.groupBy("line").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"))
    lines = stored(grouped.select(F.monotonically_increasing_id().alias("id"), "first", "copies", "line"))
    levels = rarity(lines, shingle=shingle)
    late = late_lines(lines, levels, room, wide, heads, shingle).withColumn("late", F.lit(True))
    verdict = lines.select("id", "first", "copies", *marks(F.col("line"))).join(late, "id", "left").withColumn("late", F.coalesce("late", F.lit(False)))
    dirty = stored(verdict.filter("late OR copies > 1").select("k1", "k2", "first", "late"))
    drop(lines)
    gone = all_lines.select("doc_id", "tie", "at", "place", *marks(F.col("line"))).join(dirty, ["k1", "k2"]).filter(F.col("late") | (F.col("place") != F.col("first")))
    return gone.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set("at")).alias("removed"))


def marked(docs: DataFrame, columns: list, doc_id: str, text: str, how: dict, name: str) -> DataFrame:
    """columns of docs, with the places of the lines that go (empty if none) under the given name. No column of docs may have it."""
    gone = removals(docs, doc_id, text, **how).select(F.struct("doc_id", "tie").alias("whose"), "removed")
    held = docs.select(F.struct(*columns).alias("row"), F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("tie")).alias("own"))
    same = F.col("own.doc_id").eqNullSafe(F.col("whose.doc_id")) & (F.col("own.tie") == F.col("whose.tie"))
    return held.join(gone, same, "left").select("row.*", F.coalesce("removed", F.array().cast("array<int>")).alias(name))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, **how) -> DataFrame:
    """docs without those whose shingles of so many words are similar, at 4/5 or more, to those of an earlier one.

    Of rows that are the same in id and text, one stays. Empty and null texts are equal to each other; a null doc_id
    comes first, then ties go by a hash of the text. Very long texts are compared whole. Columns stay as they are.
    """
    gone = free(docs, "gone")
    kept = marked(docs, [F.col(f"`{c}`") for c in docs.columns], doc_id, text, {"shingle": words} | how, gone).filter(F.size(gone) == 0)
    place = free(docs, "place")
    same = Window.partitionBy(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(text_of(text))).orderBy(F.lit(0))
    return kept.withColumn(place, F.row_number().over(same)).filter(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the lines that removals() names; rows that lose none stay as they are, null texts too. Columns keep their names and order."""
    gone = free(docs, "gone")
    out = marked(docs, [F.col(f"`{c}`") for c in docs.columns], doc_id, text, how, gone)

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    kept = F.when(F.size(gone) == 0, F.col(f"`{text}`")).otherwise(let(F.split(text_of(text), "\n", -1), rest))
    return out.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (places of the removed lines from 0)."""
    lines = F.size(F.split(text_of("text"), "\n", -1)).cast("long").alias("n_lines")
    out = marked(documents(spark, sf_dir), [F.col("doc_id"), lines], "doc_id", "text", {}, "removed")
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")
