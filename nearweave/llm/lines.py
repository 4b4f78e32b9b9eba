"""Line dedup as an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. A line goes if an earlier line (smaller doc_id, or same document and smaller line
number) has a Jaccard similarity of at least 4/5 with it, whether or not that one stays. Steps:

1. Word counts over the corpus, in 2 ** BITS hash buckets, give every word a rarity, and words one order from rare to
   common (equal rarities: by hash). The order only steers the work, any order gives the same result.
2. Lines with equal sets form a class, for which its first line stands; the others have an earlier equal line and go.
3. Prefix filter: two sets with that similarity share a word among their rarest n - ceil(4n/5) + 1. A row for each of
   these words is dealt by word, and by a salt as well where the word may occur in more than FREQUENT rows. Lines of up to
   three words have no partners but equal ones; words of buckets with one occurrence meet nothing and aren't dealt.
   Words of a large corpus are dealt in turns, so that the shuffled rows of one turn are deleted before the next one's.
4. In a word's group of up to GROUP rows every row meets the shorter ones, behind the length filter, the positional filter
   and a bitmap filter: the parities of a set's word hashes in 64 places (128 for long sets) differ in no more places than the
   sets do.
5. Rows of larger or salted groups meet the group's first row. Then all lines with words of such groups are dealt again by two
   words, the group's and a later one of the prefix, which is longer by one word for that; similar sets share both. Those
   without an earlier match so far meet the earlier ones. These rows grow with the number of large groups, up to the square
   of a prefix for each line, so they are never held at once: as many turns as they ask for deal a fixed number a line each.
6. Pairs that pass are verified on the full sets, which are built anew for lines in pairs only; first the nearest partner
   of each line by its bitmap, then all others of the lines that had no match.

Defined results: lines are what line feeds separate; words are runs of anything but blanks and the controls from tab to
carriage return; lines without words take no part and stay; a null text has no lines and stays null; an empty text has
one line without words; rows with one doc_id hold equal places, which are not earlier than each other (where their texts
differ, a place may be judged by either text); a null doc_id
comes before all others; an empty table gives an empty table; other columns are ignored, or carried by ``rewrite``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables
from .common import FILTERED, LOWEST, constant, id_filter, lowest_id, may_hold, partitions, zeros

SEPARATOR = r"[ \t\x0B\f\r]+"
#: Buckets of words, as a power of two.
BITS = 20
#: Rows of a word's group in which all meet; more cost about as much as dealing a row again by two words.
GROUP = 2048
#: Rows of one word that are dealt together, at most (by the bucket's count).
FREQUENT = 1_000_000
#: Lines of a corpus whose words are dealt in several turns, one after the other: disk holds the shuffled rows of one only.
MANY, TURNS = 1_000_000, 4
#: Rows that one turn deals by two words, for each line of the corpus.
PAIRED = 2
#: Sets of more words have a bitmap of 128 places, others one of 64.
LONG = 64
#: A word is its rarity (a third of a power of two) on top of these bits of its hash.
KEPT = 56


def _words(line: Column) -> Column:
    """Words of a line, the empty string among them where it begins or ends with a separator."""
    other = line.contains("\t") | line.contains("\x0b") | line.contains("\f") | line.contains("\r")
    return F.when(other, F.split(line, SEPARATOR)).otherwise(F.split(line, " "))


def _hashes(line: Column) -> Column:
    """Distinct word hashes of a line."""
    return F.array_except(F.transform(_words(line), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def _lines(docs: DataFrame) -> DataFrame:
    """d, ln, line of lines that aren't blank."""
    lines = docs.select(lowest_id().alias("d"), F.posexplode(F.split(F.col("text"), "\n")).alias("ln", "line"))
    return lines.filter(F.trim("line") != "")


def _counted(docs: DataFrame) -> DataFrame:
    """k and a 1 for every word, with its bucket; whole texts are cut at once, as lines don't matter here."""
    words = docs.select(F.explode(_words(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))).alias("w"))
    return words.select(F.shiftrightunsigned(F.xxhash64("w"), 64 - BITS).alias("k"), F.lit(1).cast("long").alias("c"))


def _rarities(docs: DataFrame) -> Column:
    """For each bucket, what turns its bits on top of a hash into the bucket's rarity, floor(3 * log2(count)), by xor; a byte each."""
    every = _counted(docs).union(zeros(docs, BITS)).groupBy("k").agg(F.sum("c").alias("c"))
    rarity = F.least(F.floor(3 * F.log2(F.greatest("c", F.lit(1)))), F.lit(126)).cast("long")
    turn = F.shiftright("k", BITS + KEPT - 64).bitwiseXOR(rarity)
    return constant(every, F.when(turn > 127, turn - 256).otherwise(turn).cast("byte"), BITS)


def _salted() -> int:
    """Rarity from which words may be salted."""
    return 3 * (FREQUENT.bit_length() - 1)


def _parts(word: Column) -> Column:
    """Salted parts of a word's rows."""
    rarity = F.shiftright(word, KEPT)
    return F.when(rarity >= _salted(), F.ceil(F.pow(F.lit(2.0), (rarity + 1) / 3) / FREQUENT).cast("int")).otherwise(1)


def _bits(upper: bool) -> Column:
    """Parities of the words of a set in 64 places, or in the upper 64 of 128; the lower ones of these are the difference of both."""
    places = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    place = F.array(*[F.lit(0).cast("long")] * 64, *places) if upper else F.array(*places)
    last = F.lit(len(places) * (1 + upper) - 1).cast("long")
    return F.aggregate("a", F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(F.get(place, h.bitwiseAND(last).cast("int"))))


def _sets(docs: DataFrame) -> DataFrame:
    """Lines: d, ln, digest c of the set, n, bitmaps b0 and b1 (which are digests, too), prefix from rare to common."""
    rarity = lambda h: F.shiftleft(F.get("r", F.shiftrightunsigned(h, 64 - BITS).cast("int")).cast("long"), KEPT)
    # No element is ever null, but only what says so to Spark is sorted as plain numbers.
    placed = lambda h: F.coalesce(h.bitwiseXOR(rarity(h)), h)
    # The array r stands in one place only, so that it becomes a constant there and never a part of rows.
    lines = _lines(docs).withColumn("r", _rarities(docs)).select("d", "ln", F.sort_array(F.transform(_hashes(F.col("line")), placed)).alias("a"))
    n = F.size("a")
    prefix = F.slice("a", 1, F.when(n > 3, n - F.ceil(n * 4 / 5).cast("int") + 2).otherwise(0))
    upper = F.when(n > LONG, _bits(True)).otherwise(F.lit(0).cast("long"))
    return lines.select("d", "ln", F.xxhash64("a").alias("c"), n.alias("n"), _bits(False).alias("b0"), upper.alias("b1"), prefix.alias("prefix"))


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with d and ln that ids hold, and few others: a filter of fixed size stands before anything is shuffled.

    Where there are more ids than it tells apart, a join leaves the others out.
    """
    passed = rows.filter(may_hold(id_filter(ids, "d", "ln"), "d", "ln"))
    return passed.join(ids, ["d", "ln"], "left_semi") if ids.count() > FILTERED else passed


def _earlier(d: Column, ln: Column, e: Column, em: Column) -> Column:
    return (e < d) | (e == d) & (em < ln)


def _after() -> Column:
    """x stands after y."""
    return _earlier(*(F.col(c) for c in ("x.d", "x.ln", "y.d", "y.ln")))


def _similar(shared: int) -> Column:
    """The filters on a pair of rows of x and y that share ``shared`` words up to their places p: length, position, bitmap."""
    n, m, p, q = (F.col(x) for x in ("x.n", "y.n", "x.p", "y.p"))
    length = 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    position = 9 * (F.least(n - p, m - q) + shared) >= 4 * (n + m)
    return length & position & (9 * _far() <= n + m)


def _far() -> Column:
    """Places in which the bitmaps of x and y differ: of 128, if both have these, or else of 64."""
    folded, upper = (F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}")) for b in ("b0", "b1"))
    known = F.when(F.least("x.n", "y.n") > LONG, upper).otherwise(F.lit(0).cast("long"))
    return F.bit_count(known) + F.bit_count(folded.bitwiseXOR(known))


def _met(rows: DataFrame, turn: int = 0, turns: int = 1) -> DataFrame:
    """Of the words that one of several turns deals: pairs of a line (d, ln) and an earlier one (e, em) with far; and in rows of their own the words w of large groups.

    In a small group the longer line meets the shorter ones that have the word among their rarest m - ceil(8m/9) + 1, as two
    sets with that similarity share 8/9 of the shorter one. In a large group every row meets the first document's.
    """
    words = rows.select("d", "ln", "n", "b0", "b1", F.size("prefix").alias("held"), F.posexplode("prefix").alias("p", "w"))
    words = words.filter((F.col("p") < F.col("held") - 1) & (F.col("w") >= F.lit(1 << KEPT)) & (F.pmod("w", F.lit(turns)) == turn))
    parts, p = _parts(F.col("w")), F.col("p") + 1
    salted = F.xxhash64("w", F.pmod(F.xxhash64("d", "ln"), parts))
    # One long as the key, so that rows are sorted by radix; rows of salted groups have negative places.
    words = words.select(F.when(parts > 1, salted).otherwise(F.col("w")).alias("k"), "d", "ln", "n", F.when(parts > 1, -p).otherwise(p).alias("p"), "b0", "b1").filter("k is not null")
    group = Window.partitionBy("k")
    dealt = words.repartition(partitions(rows), "k")
    # Only one side needs to know its group.
    other = dealt.withColumns({"g": F.count("*").over(group), "f": F.min("d").over(group)})
    other = other.withColumn("large", (F.col("g") > GROUP) | (F.col("p") < 0)).filter((F.col("g") > 1) | F.col("large"))
    other = other.withColumn("w", F.when(F.col("large") & (F.col("p") > 0), F.col("k"))).withColumn("p", F.abs("p"))
    index = F.col("n") - F.ceil(F.col("n") * 8 / 9).cast("int") + 1
    other = other.filter(F.when(F.col("large"), F.col("d") == F.col("f")).otherwise(F.col("p") <= index))
    dealt = dealt.withColumn("p", F.abs("p"))
    large, longer = F.col("y.large"), (F.col("x.n") > F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & _after()
    same = (F.col("x.d") == F.col("y.d")) & (F.col("x.ln") == F.col("y.ln"))
    told, fits = same & F.col("y.w").isNotNull(), F.when(large, _after()).otherwise(longer & ~same) & _similar(1)
    met = dealt.alias("x").join(other.alias("y"), (F.col("x.k") == F.col("y.k")) & (told | fits))
    places = lambda x, y: F.struct(f"{x}.d", f"{x}.ln", F.col(f"{y}.d").alias("e"), F.col(f"{y}.ln").alias("em"))
    later = F.when(_after(), places("x", "y")).otherwise(places("y", "x"))
    return met.select(F.when(~told, later).alias("o"), _far().alias("far"), F.when(told, F.col("y.w")).alias("w")).select("o.*", "far", "w")


def _marked(rows: DataFrame, words: DataFrame, gone: DataFrame) -> DataFrame:
    """Lines with words of large groups in the prefix: what rows hold, the places of these words, and whether the line is open, that is not gone."""
    hit = id_filter(gone, "d", "ln")
    # Words taken for large ones by mistake (by all lines alike) are only dealt in more rows; those of salted groups always are.
    large = lambda w: (w >= F.lit(1 << KEPT)) & ((w >= F.lit(_salted() << KEPT)) | may_hold(F.col("r"), w))
    at = F.filter(F.transform("prefix", lambda w, i: F.when((i < F.size("prefix") - 1) & large(w), i)), lambda i: i.isNotNull())
    # As in _sets, r becomes a constant; no filter on the places may be pushed below them, where it would stand twice.
    lines = rows.withColumn("r", id_filter(words, "w")).select(*rows.columns, at.alias("at"))
    lines = lines.select(*rows.columns, F.explode(F.filter(F.array("at"), lambda x: F.size(x) > 0)).alias("at"))
    # Only lines that pass a filter of fixed size are joined.
    known = lines.filter(may_hold(hit, "d", "ln")).join(gone.withColumn("gone", F.lit(True)), ["d", "ln"], "left")
    return lines.filter(~may_hold(hit, "d", "ln")).withColumn("open", F.lit(True)).unionByName(known.withColumn("open", F.col("gone").isNull()).drop("gone"))


def _met_by_two(marked: DataFrame, turn: int = 0, turns: int = 1) -> DataFrame:
    """Pairs of an open line (d, ln) and an earlier one (e, em) with far, dealt by each large word and a later one of the prefix, of one of several turns."""
    words = marked.select("d", "ln", "n", "b0", "b1", "open", "prefix", F.explode("at").alias("i"))
    words = words.select("d", "ln", "n", "b0", "b1", "open", "i", F.get("prefix", "i").alias("w"), F.posexplode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("j", "v"))
    words, p = words.filter(F.pmod(F.shiftright("w", 1) + F.shiftright("v", 1), F.lit(turns)) == turn), F.col("i") + F.col("j") + 2
    # Both sides of the join read one shuffle: lines that aren't open have negative places, and the test for it names both sides.
    words = words.select(F.xxhash64("w", "v").alias("k"), "d", "ln", "n", F.when(F.col("open"), p).otherwise(-p).alias("p"), "b0", "b1").filter("k is not null")
    dealt = words.repartition(partitions(marked), "k")
    other = dealt.withColumn("g", F.count("*").over(Window.partitionBy("k"))).filter("g > 1").withColumn("p", F.abs("p"))
    met = dealt.alias("x").join(other.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.least("x.p", "y.n") > 0) & _after() & _similar(2))
    return met.select("x.d", "x.ln", F.col("y.d").alias("e"), F.col("y.ln").alias("em"), _far().alias("far")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """d, ln of lines that have a pair (d, ln) with an earlier (e, em) of at least that similarity."""
    both = pairs.join(sets.withColumnRenamed("h", "hx"), ["d", "ln"]).join(sets.select(F.col("d").alias("e"), F.col("ln").alias("em"), F.col("h").alias("hy")), ["e", "em"])
    common = F.size(F.array_intersect("hx", "hy"))
    return both.filter(9 * common >= 4 * (F.size("hx") + F.size("hy"))).select("d", "ln").distinct()


def _matched(tables: Tables, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """d, ln of lines with a verified pair: the nearest partner of each line first, then all of the lines it doesn't settle."""
    named = tables.settle(pairs.select(F.inline(F.array(F.struct("d", "ln"), F.struct(F.col("e").alias("d"), F.col("em").alias("ln"))))).distinct())
    sets = tables.settle(_of(_lines(docs), named).select("d", "ln", _hashes(F.col("line")).alias("h")))
    nearest = tables.settle(pairs.groupBy("d", "ln").agg(F.min(F.struct("far", "e", "em")).alias("s")).select("d", "ln", "s.e", "s.em"))
    first = tables.settle(_verified(nearest, sets))
    open_lines = tables.settle(nearest.select("d", "ln").join(first, ["d", "ln"], "left_anti"))
    rest = _of(pairs, open_lines).select("d", "ln", "e", "em").distinct()
    out = tables.settle(first.union(_verified(rest, sets)).distinct())
    tables.drop(named, sets, nearest, first, open_lines)
    return out


def _gone(tables: Tables, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """d, ln of all lines with words; d, ln of those that stay."""
    held = tables.settle(_sets(docs))
    every = held.filter("n > 0")
    firsts = tables.settle(every.groupBy("c", "b0", "b1").agg(F.min(F.struct("d", "ln")).alias("s")).select("s.*").distinct())
    rows = tables.settle(_of(every.filter("n > 3").select("d", "ln", "n", "b0", "b1", "prefix"), firsts))
    every = tables.settle(every.select("d", "ln"))
    tables.drop(held)
    turns = TURNS if rows.count() > MANY else 1
    found = functools.reduce(DataFrame.union, [tables.settle(_met(rows, turn, turns)) for turn in range(turns)])
    gone = _matched(tables, docs, found.filter("e is not null").select("d", "ln", "e", "em", "far"))
    marked = tables.settle(_marked(rows, tables.settle(found.filter("w is not null").select("w").distinct()), gone))
    later = F.aggregate("at", F.lit(0).cast("long"), lambda s, i: s + F.size("prefix") - 1 - i)
    dealt, lines = marked.agg(F.coalesce(F.sum(later), F.lit(0)), F.lit(PAIRED) * F.greatest(F.lit(MANY), F.lit(rows.count()))).first()
    tables.drop(rows)
    if dealt:
        turns = -(-dealt // lines)
        more = functools.reduce(DataFrame.union, [tables.settle(_met_by_two(marked, turn, turns)) for turn in range(turns)])
        tables.drop(marked)
        gone = gone if more.isEmpty() else gone.union(_matched(tables, docs, more))
    return every, firsts.join(gone, ["d", "ln"], "left_anti")


def _removed(docs: DataFrame) -> DataFrame:
    """d and the numbers of the lines that go, in a table that stays."""
    with Tables(docs.sparkSession) as tables:
        lines, kept = _gone(tables, docs)
        return tables.keep(lines.join(kept, ["d", "ln"], "left_anti").groupBy("d").agg(F.collect_set("ln").alias("lns")))


def _with_removed(docs: DataFrame) -> DataFrame:
    """Every row as ``row``, its text, and the numbers of its removed lines (null: none).

    Only documents that pass a filter of fixed size on the ids with removed lines are joined; all others go straight on.
    """
    gone = _removed(docs)
    rows = docs.select(lowest_id().alias("d"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    bits = id_filter(gone, "d")
    touched = rows.filter(may_hold(bits, "d")).join(gone, "d", "left")
    return touched.unionByName(rows.filter(~may_hold(bits, "d")).withColumn("lns", F.lit(None).cast("array<int>")))


def _kept_lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("lns", i.cast("int")))


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (kept lines joined by line feeds; a null text has 0 lines and a null)."""
    kept = F.when(F.col("lns").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(), "\n"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return _with_removed(docs).select(
        F.when(F.col("d") != LOWEST, F.col("d")).alias("doc_id"),
        lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("lns"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


def rewrite(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, each text without the lines that go."""
    kept = F.when(F.col("lns").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(), "\n"))
    return _with_removed(docs).select(*[kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def oracle_sql() -> str:
    """All pairs of classes; for small tables."""
    return """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
words AS (
  SELECT doc_id, ln, list_sort(list_distinct(list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda w: w <> ''))) AS a FROM lines),
classes AS (SELECT a, min((doc_id, ln)) AS f FROM words WHERE len(a) > 0 GROUP BY a),
tokens AS (SELECT a, f, len(a) AS n, unnest(a) AS w FROM classes),
pairs AS (
  SELECT x.a, x.f, count(*) AS common, x.n AS n, y.n AS m
  FROM tokens x JOIN tokens y ON x.w = y.w AND y.f < x.f AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  GROUP BY x.a, x.f, y.f, x.n, y.n),
later AS (SELECT DISTINCT a FROM pairs WHERE 9 * common >= 4 * (n + m)),
gone AS (
  SELECT doc_id, ln FROM words JOIN classes USING (a) LEFT JOIN (SELECT a, true AS hit FROM later) USING (a)
  WHERE (doc_id, ln) > f OR hit)
SELECT d.doc_id, count(line) AS n_lines, count(gone.ln) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY lines.ln) FILTER (WHERE gone.ln IS NULL), '')) END AS kept_sha256
FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.ln = lines.ln
GROUP BY d.doc_id, d.text"""
