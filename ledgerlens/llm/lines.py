"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its words. Lines of equal sets form a class, named by its first line. The words of a
class are put in one order over the whole corpus, rarest first (frequencies come from ``2**BITS`` counters over
all words; ties go by hash). Two sets reach similarity 4/5 only if they share a word among the first
n - ceil(4n/5) + 1 of each, so classes meet on those prefix words; a word that the corpus holds once is
shared by nobody and left out. A pair has to pass the length filter, the positional filter (at their
first shared word, that and the words after it bound the overlap) and a parity map of 128 bits: the bits in which two maps differ
are no more than the words in which the sets differ. What passes is verified on the words themselves.

The query gives each class the number of its links and its earliest match. The links of a large group of near copies
are counted without listing them: the group has a centre, the words that over half of its classes hold. Sets reach
4/5 if and only if they differ in no more words than a ninth of their sizes together, and two sets differ in no more words than
they both differ from the centre. With ``a`` = 9 x (words in which a class differs from the centre) - its size, all
pairs with a sum of ``a`` of 0 or less are links, so a running count over ``a`` gives each class its number of them. All other
pairs, inside a group or not, are met on prefix words and verified one by one, so no link is lost, whichever
centre a group has. Lists of frequent words are dealt to a grid of parts.

Removal (``dedup_lines``) asks only whether a line has an earlier match and takes a shorter way: each class meets the
earliest class of each of its prefix words first and the one before it (a window), and only classes that match none
of these are joined with all earlier ones.

A line goes if an earlier line (by document id, then place) has the same set or one of similarity 4/5 or
more. Whether that earlier line goes too plays no part, so the result depends on no processing order.

Defined results: blank lines are never matched and stay; a null text has no lines and stays null; an empty table
gives an empty result; lines and words of any length are taken whole; repeated rows are copies, and the later of
them loses its lines (rows that agree in id and text share the fate of the first); null ids sort first; other
columns are ignored, whatever their names (``dedup_lines`` returns them as they are).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, row_key

#: Counters of words: their codes (under a megabyte) are sent to the tasks, at any size of the corpus.
BITS = 18
#: Place of a word's counter code in its sort key; code from which a word is frequent (4,096 occurrences); parts of a list of a frequent word.
CODE, OFTEN, PARTS = 56, 49, 64
#: Where all classes are joined, lists of frequent words are dealt to a grid of SIDE x SIDE parts.
SIDE = 8
#: Blocks of words, joined one after the other.
PASSES = 2
#: Classes near one hub from which on their links are counted by a centre.
GROUP = 64
#: Bits of a class number that can name a hub.
HUB = 45
#: Columns that tell the set of a line: 128 bits of hashes, and its size.
_SET = ["s", "t", "n"]
#: Lines to verify, up to which their places are broadcast; beyond it they are joined by a shuffle.
BROADCAST_CLASSES = 200_000


def plain(text: str) -> Column:
    """A text with each white-space character other than the line break as a blank; null counts as empty."""
    whole, odd = F.coalesce(F.col(text), F.lit("")), "\t\x0b\f\r"
    # Most texts hold none of these; asking takes a fraction of the time of replacing.
    held = reduce(Column.__or__, [F.contains(whole, F.lit(c)) for c in odd])
    return F.when(held, reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), odd, whole)).otherwise(whole)


def distinct_words(line: Column) -> Column:
    """The different words of a plain line. Splitting by one character takes a third of the time of a regular expression."""
    return F.array_remove(F.array_distinct(F.split(line, " ")), "")


def word_codes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row with a number for each counter of words, as text: 1 where one word of the corpus falls once, four steps an octave, 0 for no word."""
    words = docs.select(F.explode(F.split(F.replace(plain(text_col), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(_slot(F.xxhash64("w")).alias("slot")).agg(F.count("*").alias("n"))
    coded = counts.select("slot", F.least(F.lit(127), 1 + F.floor(4 * F.log2("n"))).cast("tinyint").alias("code"))
    every = docs.sparkSession.range(1 << BITS).select(F.col("id").cast("int").alias("slot")).join(coded, "slot", "left").select("slot", F.coalesce("code", F.lit(0).cast("tinyint")).alias("code"))
    side = 1 << (BITS // 2)
    rows = every.groupBy(F.floor(F.col("slot") / side).alias("block")).agg(F.array_sort(F.collect_list(F.struct("slot", "code"))).alias("x")).select("block", F.col("x.code").alias("codes"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("block", "codes"))).alias("x")).select(F.array_join(F.flatten("x.codes").cast("array<string>"), ",").alias("codes"))


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _prefix_length(n: Column) -> Column:
    """Words of a set of n in which a set of similarity 4/5 has to share one; smaller sets have no partner but their equals."""
    return F.when(n > 3, n - F.floor((4 * n + 4) / 5).cast("int") + 1).otherwise(0)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a line with words: its place, set hashes, set size, parity map and prefix (sort keys of the words that another line may hold)."""
    # A folded constant: lambdas may hold no subquery, and a joined column would be copied into each row.
    codes = F.split(F.lit(word_codes(docs, text_col).first()["codes"]), ",").cast("array<tinyint>")
    # Keys come before the lines are dealt out, else each line would carry and hash the whole text again.
    texts = docs.select(*row_key(id_col, text_col), plain(text_col).alias("t"))
    lines = texts.select("k_id", "k_text", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line")).where(F.trim("line") != "")
    # Numbers are told apart, and sorted where none can be null, as primitive values.
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    code = lambda h: F.coalesce(F.get(codes, _slot(h)), F.lit(0).cast("tinyint")).cast("long")
    keys = F.sort_array(F.transform(hashes, lambda h: F.shiftleft(code(h), CODE).bitwiseOR(F.shiftrightunsigned(h, 64 - CODE))))
    keyed = lines.select("k_id", "k_text", "line_no", keys.alias("w"))
    n = F.size("w")
    # Parity of the low six bits over all words, and over those with the seventh bit; their difference is the other half.
    bit = lambda k, one: F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda one: F.aggregate("w", F.lit(0).cast("long"), lambda m, k: m.bitwiseXOR(bit(k, one(k))))
    shared = F.filter(F.slice("w", F.lit(1), _prefix_length(n)), lambda k: k >= F.lit(2 << CODE))
    facts = keyed.select(
        "k_id", "k_text", "line_no", F.xxhash64("w").alias("s"), F.xxhash64(F.lit(1), "w").alias("t"), n.alias("n"),
        parity(lambda k: F.lit(1).cast("long")).alias("low"), parity(lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1).cast("long"))).alias("m2"), shared.alias("prefix"),
    )
    return facts.select("k_id", "k_text", "line_no", "s", "t", "n", F.col("low").bitwiseXOR(F.col("m2")).alias("m"), "m2", "prefix")


#: What two classes that share a prefix word must fulfil to reach 4/5 if it is their first; q holds a set's size, then the word's place.
_POSSIBLE = """
    5L * (x.q >> 32) >= 4L * (y.q >> 32) AND 5L * (y.q >> 32) >= 4L * (x.q >> 32)
    AND 9L * least((x.q >> 32) - (x.q & 2147483647L), (y.q >> 32) - (y.q & 2147483647L)) >= 4L * ((x.q >> 32) + (y.q >> 32))
    AND 9L * (bit_count(x.m ^ y.m) + bit_count(x.m2 ^ y.m2)) <= (x.q >> 32) + (y.q >> 32)
"""


#: Where a pair is met: at the first shared word of a stretch of them; in one group only if the centre has not decided it. Not in more words than their maps
#: share, and those that fall on one bit in a map, do both differ from the centre; each makes them differ in two words less than ``a`` says.
_OPEN = """
    NOT (x.p <=> y.p AND x.p IS NOT NULL)
    AND CASE WHEN x.g = y.g THEN x.a + y.a > 0 AND x.a + y.a <= 18L * (bit_count(x.b & y.b) + bit_count(x.b2 & y.b2)
        + least((x.a + (x.q >> 32)) DIV 9 - bit_count(x.b) - bit_count(x.b2), (y.a + (y.q >> 32)) DIV 9 - bit_count(y.b) - bit_count(y.b2))) ELSE true END
"""


def _postings(classes: DataFrame, block: int, *more: str) -> DataFrame:
    """A narrow row for each class and prefix word of a block: sort key, size and place, class number, document id, parity map. More may name p, the word before."""
    skipped = _prefix_length(F.col("n")) - F.size("prefix")
    each = classes.select("c", F.col("first.k_id").alias("k"), "n", "m", "m2", "prefix", skipped.alias("skipped"), *[x for x in more if x != "p"], F.posexplode("prefix").alias("i", "w")).withColumn("p", F.get("prefix", F.col("i") - 1))
    q = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("skipped") + F.col("i")).cast("long"))
    return each.where(F.pmod("w", F.lit(PASSES)) == block).select("w", q.alias("q"), "c", "k", "m", "m2", *more)


def _class_table(table: DataFrame) -> DataFrame:
    """One row a class: its number, first line, lines, size, parity map and prefix."""
    grouped = table.groupBy(*_SET).agg(F.min(F.struct("k_id", "k_text", "line_no")).alias("first"), F.count("*").alias("copies"), F.first("prefix").alias("prefix"), F.first("m").alias("m"), F.first("m2").alias("m2"))
    return cut(grouped.withColumn("c", F.monotonically_increasing_id()))


def _by_pass(make, classes: DataFrame) -> DataFrame:
    """Pairs (earlier, later) of first lines of the pairs of class numbers that ``make`` gives for each block of words."""
    # Words are taken in PASSES blocks, so that the shuffle of one block is gone before the next.
    met = [cut(make(i).distinct()) for i in range(PASSES)]
    # Classes meet by number; their first lines tell which is the earlier one.
    of = lambda z: classes.select(F.col("c").alias(z), F.col("first").alias(f"f{z}"))
    pairs = reduce(DataFrame.unionByName, met).distinct().join(of("a"), "a").join(of("b"), "b")
    out = cut(pairs.select(F.least("fa", "fb").alias("earlier"), F.greatest("fa", "fb").alias("later")).distinct())
    release(*met)
    return out


def _often() -> Column:
    return F.col("w") >= F.lit(OFTEN << CODE)


def _small(df: DataFrame) -> DataFrame:
    """A table that ``cut`` wrote, to be broadcast if it has no more than BROADCAST_CLASSES rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df


def _centred(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Classes of large groups: class number, first line, group, ``a`` (9 x the words in which it differs from the group's centre - its size), and a map of 128 bits of these words."""
    posts = classes.where(F.size("prefix") > 0).select("c", "n", "m", "m2", "copies", F.explode("prefix").alias("w"))
    # The hub of a prefix word is the class with most copies that holds it; packed in one number, so that the aggregation needs no sort.
    most = F.max(F.when(F.col("c") < F.lit(1 << HUB), F.shiftleft(F.least("copies", F.lit(1 << 17)), HUB).bitwiseOR(F.col("c"))))
    hubs = cut(posts.groupBy("w").agg(F.count("*").alias("size"), most.alias("hub")).where(F.col("size") >= GROUP).select("w", F.col("hub").bitwiseAND(F.lit((1 << HUB) - 1)).alias("g")))
    facts = cut(classes.select(F.col("c").alias("g"), F.struct("n", "m", "m2").alias("hub")).join(_small(hubs), "g").select("w", "g", "hub"))
    bits = F.bit_count(F.col("m").bitwiseXOR(F.col("hub.m"))) + F.bit_count(F.col("m2").bitwiseXOR(F.col("hub.m2")))
    near = cut(posts.join(_small(facts), "w").where(9 * bits <= F.col("n") + F.col("hub.n")).select("c", "g", bits.alias("bits")).distinct())
    large = cut(near.groupBy("g").count().where(F.col("count") >= GROUP))
    # Each class joins, of the hubs near it, the one with most classes near it.
    named = near.join(_small(large), "g").groupBy("c").agg(F.min(F.struct(-F.col("count"), "bits", "g")).alias("x"))
    members = cut(classes.select("c", "first").join(_small(cut(named.select("c", "x.g"))), "c"))
    words = cut(members.join(_words_of(members.select(F.col("first").alias("e")), docs, id_col, text_col), F.col("first") == F.col("e")).select("c", "first", "g", "ws"))
    held = words.select("g", F.explode("ws").alias("word")).groupBy("g", "word").agg(F.count("*").alias("votes"))
    over = held.join(words.groupBy("g").agg(F.count("*").alias("of")), "g").where("2 * votes > of")
    centres = cut(over.groupBy("g").agg(F.array_sort(F.collect_list("word")).alias("centre")))
    # Groups of one centre are one group.
    whole = centres.join(centres.groupBy("centre").agg(F.min("g").alias("name")), "centre")
    differ = words.join(whole, "g").select("c", "first", F.col("name").alias("g"), F.size("ws").alias("n"), F.transform(F.concat(F.array_except("ws", "centre"), F.array_except("centre", "ws")), lambda w: F.xxhash64(w)).alias("d"))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    upper = lambda h: h.bitwiseAND(F.lit(64)) != 0
    held = lambda keep: F.aggregate(F.filter("d", keep), F.lit(0).cast("long"), lambda b, h: b.bitwiseOR(bit(h)))
    return cut(differ.select("c", "first", "g", (9 * F.size("d") - F.col("n")).alias("a"), held(lambda h: ~upper(h)).alias("b"), held(upper).alias("b2")))


def _sure_links(centred: DataFrame) -> DataFrame:
    """(first, n, by): for each class its links in its group whose sum of ``a`` is 0 or less, and the earliest of them that is earlier."""
    levels = centred.groupBy("g", "a").agg(F.count("*").alias("n"), F.min("first").alias("by"))
    asked = levels.select("g", (-F.col("a")).alias("v"), F.col("a"), F.lit(0).cast("long").alias("n"), F.when(F.lit(False), F.col("by")).alias("by"))
    rows = asked.unionByName(levels.select("g", F.col("a").alias("v"), F.lit(None).cast("int").alias("a"), "n", "by"))
    # A group has a row or two for each value of a, which lines of up to n words bound by 10 n, however many classes it has.
    upto = Window.partitionBy("g").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select("g", "a", F.sum("n").over(upto).alias("n"), F.min("by").over(upto).alias("by")).where("a IS NOT NULL")
    own = F.when(F.col("a") <= 0, 1).otherwise(0)
    return centred.join(sums, ["g", "a"]).select("first", (F.col("n") - own).alias("n"), F.when(F.col("by") < F.col("first"), F.col("by")).alias("by")).where("n > 0")


def class_links(table: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, links): each class with its first line and size; number of links and earliest match (first line) of each class with links."""
    classes = _class_table(table)
    centred = _centred(classes, docs, id_col, text_col)
    placed = classes.join(_small(centred).select("c", "g", "a", "b", "b2"), "c", "left")

    def all_pairs(block: int) -> DataFrame:
        # Words that are not frequent: both sides read one shuffle. Frequent words: a pair meets in the one part of its row and column.
        posts = _postings(placed, block, "p", "g", "a", "b", "b2")
        rare = posts.where(~_often())
        part, each = F.pmod(F.xxhash64("m"), F.lit(SIDE)), F.sequence(F.lit(0), F.lit(SIDE - 1))
        row, column = (posts.where(_often()).withColumn("cell", F.explode(F.transform(each, at))) for at in (lambda i: part * SIDE + i, lambda i: i * SIDE + part))
        met = [x.alias("x").join(y.alias("y"), on).where("x.c < y.c").where(_POSSIBLE).where(_OPEN) for x, y, on in ((rare, rare, ["w"]), (row, column, ["w", "cell"]))]
        return met[0].select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).unionByName(met[1].select(F.col("x.c").alias("a"), F.col("y.c").alias("b")))

    pairs = _verified(_by_pass(all_pairs, classes), docs, id_col, text_col)
    one = F.lit(1).cast("long").alias("n")
    ends = F.explode(F.array(F.struct(F.col("later").alias("first"), one, F.col("earlier").alias("by")), F.struct(F.col("earlier").alias("first"), one, F.lit(None).alias("by")))).alias("e")
    links = pairs.select(ends).select("e.*").unionByName(_sure_links(centred)).groupBy("first").agg(F.sum("n").alias("n_links"), F.min("by").alias("by"))
    return classes, cut(links)


def similar_classes(table: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): each class with its first line and size, and verified pairs (earlier, later) of first lines, one or more for each class that has an earlier match."""
    classes = _class_table(table)
    often = _often()
    by_pass = lambda make: _by_pass(make, classes)

    def hub_pairs(block: int) -> DataFrame:
        # Lists of frequent words are dealt to many parts, each with an earliest class of its own.
        posts = _postings(classes, block).withColumn("part", F.when(often, F.pmod(F.xxhash64("m"), F.lit(PARTS))).otherwise(F.lit(0)))
        one, order = F.struct("c", "q", "m", "m2"), Window.partitionBy("w", "part").orderBy("k", "m", "q")
        hubs = F.array(F.first(one).over(order), F.lag(one).over(order))
        met = posts.select(one.alias("y"), hubs.alias("hubs")).select("y", F.explode(F.array_distinct(F.filter("hubs", lambda h: h.isNotNull()))).alias("x"))
        return met.where("x.c <> y.c").where(_POSSIBLE).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"))

    near = by_pass(hub_pairs)
    good = cut(_verified(near, docs, id_col, text_col))
    done = good.select(F.col("later").alias("first"), F.lit(False).alias("open")).distinct()
    # Written once, as all blocks read it.
    still = cut(classes.join(done, "first", "left").select("c", F.struct("first.k_id").alias("first"), "n", "m", "m2", "prefix", F.col("open").isNull().alias("open")))

    def open_pairs(block: int) -> DataFrame:
        # Both sides read one shuffle: whether y is open is asked in the join, not before it.
        posts = _postings(still, block, "open")
        met = posts.alias("x").join(posts.alias("y"), "w").where("CASE WHEN y.open THEN x.k <= y.k AND x.c <> y.c ELSE false END").where(_POSSIBLE)
        return met.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"))

    rest = by_pass(open_pairs)
    release(still)
    return classes, good.unionByName(_verified(rest.join(near, ["earlier", "later"], "left_anti"), docs, id_col, text_col))


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (earlier, later) whose words, read again from their lines, reach the similarity."""
    words = _words_of(pairs.select(F.explode(F.array("earlier", "later")).alias("e")).distinct(), docs, id_col, text_col)
    of = lambda name, z: words.select(F.col("e").alias(name), F.col("ws").alias(z))
    joined = pairs.join(of("earlier", "xw"), "earlier").join(of("later", "yw"), "later")
    return joined.withColumn("both", F.size(F.array_intersect("xw", "yw"))).where("5L * both >= 4L * (size(xw) + size(yw) - both)").select("earlier", "later").distinct()


def _words_of(lines: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(e, ws): the different words of the lines e, each given once, read again from their texts."""
    wanted = lines.groupBy("e.k_id", "e.k_text").agg(F.collect_list("e.line_no").alias("nos"))
    wanted = cut(wanted.withColumn("many", F.size("nos")))
    few = (wanted.agg(F.sum("many")).first()[0] or 0) <= BROADCAST_CLASSES
    # Lines of a text are split once, however many of them are asked for.
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("t"))
    found = texts.join(F.broadcast(wanted) if few else wanted, ["k_id", "k_text"])
    asked = found.select("k_id", "k_text", "nos", F.split(plain("t"), "\n", -1).alias("ls")).select("k_id", "k_text", F.explode(F.transform("nos", lambda i: F.struct(i.alias("line_no"), F.get("ls", i).alias("line")))).alias("x"))
    # Repeated rows give a line many times; one is enough.
    return asked.groupBy(F.struct("k_id", "k_text", "x.line_no").alias("e")).agg(F.first("x.line").alias("line")).select("e", distinct_words(F.col("line")).alias("ws"))


def _marked(table: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines that an earlier line matches, with the earliest such line that the pairs name."""
    matched = pairs.groupBy(F.col("later").alias("first")).agg(F.min("earlier").alias("by"))
    marked = classes.select(*_SET, "first", "copies").join(matched, "first", "left").where("copies > 1 OR by IS NOT NULL").select(*_SET, "first", "by")
    hit = table.select("k_id", "k_text", "line_no", *_SET).join(marked, _SET)
    own = F.struct("k_id", "k_text", "line_no")
    return hit.where(F.col("by").isNotNull() | (own != F.col("first"))).select("k_id", "k_text", "line_no", F.coalesce("by", "first").alias("match"))


def removable_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, removed): the line table, and of it the lines that an earlier line matches, with such a line."""
    table = cut(line_table(docs, id_col, text_col))
    classes, pairs = similar_classes(table, docs, id_col, text_col)
    return table, _marked(table, classes, cut(pairs))


def linked_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a line with words: its class (named by its first line), the lines of the class, its links and its earliest match.

    ``n_links`` counts the other classes of similarity 4/5 or more; ``match`` is the earliest line of the same
    set or of a linked class, and null where no earlier line matches.
    """
    table = cut(line_table(docs, id_col, text_col))
    classes, links = class_links(table, docs, id_col, text_col)
    known = classes.select(*_SET, "first", "copies").join(links, "first", "left").select(*_SET, "first", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "by")
    own = F.struct("k_id", "k_text", "line_no")
    # A line has a class in any case; by comes before first, as pairs name the earlier class first.
    match = F.coalesce("by", F.when(own != F.col("first"), F.col("first")))
    return table.select("k_id", "k_text", "line_no", *_SET).join(known, _SET).select("k_id", "k_text", "line_no", F.col("first").alias("class"), "copies", "n_links", match.alias("match"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with removed lines gone from their texts."""
    _, hit = removable_lines(docs, id_col, text_col)
    gone = hit.groupBy("k_id", "k_text").agg(F.collect_set("line_no").alias("_gone"))
    keyed = docs.select("*", *[c.alias(f"_{n}") for c, n in zip(row_key(id_col, text_col), ("k_id", "k_text"), strict=True)])
    joined = keyed.join(gone, (F.col("_k_id") == F.col("k_id")) & (F.col("_k_text") == F.col("k_text")), "left")
    text = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda l, i: ~F.array_contains("_gone", i)), "\n")
    return joined.select(*[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op10_line_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its lines, the lines removed, the documents that hold their earliest matches, and the class, copies and links of each line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_join(docs)


def line_join(docs: DataFrame) -> DataFrame:
    gone = F.col("match").isNotNull()
    per = linked_lines(docs).groupBy("k_id", "k_text").agg(
        # Repeated rows give a line many times.
        F.count("*").alias("n_lines"), F.count_if(gone).alias("n_removed"), F.sort_array(F.collect_list(F.when(gone, F.col("line_no")))).alias("removed_lines"),
        F.array_sort(F.collect_set("match.k_id")).alias("matched_docs"), F.array_sort(F.collect_set(F.struct("line_no", "class", "copies", "n_links"))).alias("classes"),
    )
    keyed = docs.select("doc_id", *row_key())
    return keyed.join(per, ["k_id", "k_text"], "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), F.coalesce("matched_docs", F.array().cast("array<bigint>")).alias("matched_docs"),
        F.coalesce("classes", F.filter(F.array(F.struct(F.lit(0).alias("line_no"), F.struct(F.lit(0).cast("long").alias("k_id"), F.lit(0).cast("long").alias("k_text"), F.lit(0).alias("line_no")).alias("class"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))), lambda x: F.lit(False))).alias("classes"),
    )
