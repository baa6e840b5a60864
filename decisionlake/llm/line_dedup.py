"""Near-duplicate lines by an exact set-similarity join. DataFrame functions only.

A line is the set of its words; a line goes if an earlier line, of the same document or another, has a Jaccard likeness of at
least ``threshold``. "Earlier" is the order of (doc_id, hash of the text, line number); lines without a word stay.

1. Words are counted over the whole table into a fixed number of buckets. The bucket's magnitude, then the word's hash, is a
   total order of words from rare to frequent: any total order keeps the join exact, a rare start keeps it cheap.
2. Each line becomes its words' keys in that order, its prefix (of which two similar lines share a word) and a bitmap. This
   table is written once; it holds no whole sets.
3. Lines with equal sets meet by aggregation alone; only the first line of each set goes on.
4. Groups first: where several sets share one of the words their prefix ends with (near copies differ in their rarest
   ones, and share these), each is compared with the group's earliest member, which settles most members of a large group of near copies; of what is left, large groups do so again, up to
   ``ROUNDS`` times, each with its next earliest member. A round costs one pair a member and word, whatever the group's size.
5. The sets that are still open meet all earlier sets in one equi-join on prefix words. The length, positional and
   bitmap filters, all of them exact bounds, are part of the join, so only likely pairs leave it.
6. Every remaining pair is verified on the whole sets of words, told apart by 64-bit hashes.

No step collects a group, emits all pairs of one or drops a candidate. Small sides are broadcast only below ``SMALL_ROWS``,
after a count; the same join runs shuffled beyond that.

Defined results: a null text has no lines and stays null; blank lines stay; a text that loses all its lines becomes
empty; rows that repeat both id and text are one document and get the same result; null ids come first; an empty
table gives an empty result; :func:`dedup_lines` keeps all other columns.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlake.functions.content import bind, once
from decisionlake.session import cut

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
THRESHOLD = 0.8
BUCKETS = 1 << 17                         # of the word counts: one byte each in the plan, whatever the vocabulary
SMALL_ROWS = 500_000                      # rows of (id, hash, line) that may be broadcast, about 15 MB
HOT = 4                                   # sets that share such a word before they are compared with the earliest first
ROUNDS = 3                                # of that, at most
LARGE = 128                               # open sets in a group for another round
HOT_WORDS = 3                             # of how many of a prefix's last words
AT = ["d", "th", "line_no"]               # a line's place
NO_ID = -(1 << 63)


def _plain(text: Column) -> Column:
    """A text whose words are parted by blanks and line feeds alone; lines and their numbers stay."""
    odd = F.contains(text, F.lit("\t"))
    for c in BLANKS[3:]:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(text, BLANKS.replace("\n", ""), " " * 5)).otherwise(text)


def _hashes(line: Column) -> Column:
    """The distinct words of a plain line as 64-bit hashes; between two blanks there is no word."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), _plain(F.col("text")).alias("text"))


def _lines(documents: DataFrame) -> DataFrame:
    return documents.select("d", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def word_levels(documents: DataFrame) -> bytes:
    """The magnitude of each bucket's count, four steps for each doubling, as one byte a bucket."""
    import numpy as np
    found = documents.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w != ''").select(
        F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).groupBy("b").count()
    found = found.toPandas()                                # BUCKETS rows at most, whatever the corpus
    levels = np.zeros(BUCKETS, np.uint8)
    levels[found["b"].to_numpy(np.int64)] = np.minimum(127, 4 * np.log2(found["count"].to_numpy(np.float64) + 1))
    return levels.tobytes()


def _keys(line: Column, levels: bytes) -> Column:
    """The distinct words of a line as numbers, rare ones first: magnitude in the highest byte, then 56 bits of the hash."""
    known = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<tinyint>")      # folded into one constant

    def key(h: Column) -> Column:
        level = F.coalesce(F.get(known, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("tinyint"))
        return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    return F.sort_array(F.transform(_hashes(line), key))


class Bounds:
    """The exact integer bounds of a Jaccard threshold num / den."""

    def __init__(self, threshold: float):
        t = Fraction(str(threshold))
        self.num, self.den = t.numerator, t.denominator

    def reached(self, common: Column, both: Column) -> Column:
        """Whether two sets with ``both`` words together may or do reach the threshold with ``common`` common words."""
        return common * (self.num + self.den) >= both * self.num


def _bitmap(keys: Column, low: Column) -> tuple[Column, Column]:
    """Each word flips one bit: of 64 in a short line (second number 0), of 128 in a long one."""
    none = F.lit(0).cast("long")

    def flip(one):
        return F.aggregate(keys, none, lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", one(k), k.bitwiseAND(F.lit(63)).cast("int"))))
    return flip(lambda k: F.lit(1).cast("long")), F.when(low, none).otherwise(flip(lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(1))))


def _keyed(documents: DataFrame, levels: bytes, bounds: Bounds) -> DataFrame:
    """One row a line: place, set id (sid, sid2, n), prefix words and bitmap."""
    rows = once(_lines(documents), "keys", _keys(F.col("line"), levels)).withColumn("n", F.size("keys")).where("n > 0")
    every, second = _bitmap(F.col("keys"), F.col("n") <= 64)
    rows = rows.select(*AT, "keys", "n", every.alias("every"), second.alias("bm2"))
    length = F.expr(f"n - (n * {bounds.num} + {bounds.den - 1}) div {bounds.den} + 1").cast("int")
    prefix = F.transform(F.slice("keys", F.lit(1), length), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return rows.select(*AT, F.xxhash64("keys").alias("sid"), F.hash("keys").alias("sid2"), "n",
                       prefix.alias("prefix"), F.col("every").bitwiseXOR(F.col("bm2")).alias("bm1"), "bm2")


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows are few enough; it must be cheap to count."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _in_groups(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows in groups of ``least`` rows or more. Numbers alone are counted, so no row of another group is sorted or carried."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least).drop("rows")
    return rows.join(_small(cut(counted)), keys)


def _likely(a: str, b: str, bounds: Bounds, positional: bool) -> Column:
    """Whether two sets can reach the threshold, by their sizes, the word they share, and their bitmaps."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n = lambda side: F.abs(F.shiftright(c(side, "size"), 32)) if positional else c(side, "n").cast("long")
    pos = lambda side: c(side, "size").bitwiseAND(F.lit(0xFFFFFFFF))
    na, nb = n(a), n(b)
    ok = (na * bounds.den >= nb * bounds.num) & (nb * bounds.den >= na * bounds.num)
    if positional:
        ok = ok & bounds.reached(F.least(na - pos(a), nb - pos(b)), na + nb)
    x1, x2 = c(a, "bm1").bitwiseXOR(c(b, "bm1")), c(a, "bm2").bitwiseXOR(c(b, "bm2"))
    both_long = (na > 64) & (nb > 64)
    differ = F.when(both_long, F.bit_count(x1) + F.bit_count(x2)).otherwise(F.bit_count(x1.bitwiseXOR(x2)))
    return ok & bounds.reached(na + nb - differ, 2 * (na + nb))


def _before(b: str, a: str) -> Column:
    """Whether the place on side ``b`` is earlier; column by column, since a structure would be built for every pair."""
    earlier = F.lit(False)
    for x in reversed(AT):
        x_b, x_a = F.col(f"{b}.{x}"), F.col(f"{a}.{x}")
        earlier = (x_b < x_a) | ((x_b == x_a) & earlier)
    return earlier


def _pairs(joined: DataFrame) -> DataFrame:
    return cut(joined.select(*[F.col(f"a.{x}").alias(x) for x in AT], *[F.col(f"b.{x}").alias(f"b_{x}") for x in AT]).distinct())


def _verified(documents: DataFrame, pairs: DataFrame, bounds: Bounds) -> DataFrame:
    """The places of pairs (later, earlier) whose words reach the threshold."""
    earlier = pairs.select(*[F.col(f"b_{x}").alias(x) for x in AT])
    places = cut(pairs.select(*AT).union(earlier).distinct())
    owners = cut(places.select("d", "th").distinct())
    lines = _lines(documents.join(_small(owners), ["d", "th"], "left_semi")).join(_small(places), AT, "left_semi")
    sets = lines.select(*AT, _hashes(F.col("line")).alias("words"))
    # the same columns on both sides, so they share one exchange
    is_at = lambda side, mark: reduce(and_, [F.col(f"p.{mark}{x}") == F.col(f"{side}.{x}") for x in AT])
    both = pairs.alias("p").join(sets.alias("a"), is_at("a", "")).join(sets.alias("b"), is_at("b", "b_"))
    both = both.select(*[F.col(f"p.{x}") for x in AT], F.col("a.words").alias("wa"), F.col("b.words").alias("wb"))
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(bounds.reached(common.cast("long"), F.size("wa").cast("long") + F.size("wb").cast("long"))).select(*AT).distinct()


def _postings(sets: DataFrame) -> DataFrame:
    """One row a set and prefix word. ``size`` holds, from the high end, n (below zero for a settled set) and the word's position: few
    columns make small shuffles."""
    rows = sets.select(*AT, "n", "bm1", "bm2", F.posexplode("prefix").alias("pos", "w"))
    return rows.select(*AT, "bm1", "bm2", "w", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("size"))


def later_matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(d, th, line_no) of every line of ``docs`` (doc_id, text) that goes."""
    bounds, documents = Bounds(threshold), _documents(docs)
    keyed = cut(_keyed(documents, word_levels(documents), bounds))

    place = F.struct(*AT)
    repeated = _in_groups(keyed.select("sid", "sid2", *AT), ["sid", "sid2"], 2)
    again = cut(repeated.groupBy("sid", "sid2").agg(F.min(place).alias("first")))
    marked = keyed.join(_small(again), ["sid", "sid2"], "left")
    copies = marked.where(F.col("first").isNotNull() & (place != F.col("first"))).select(*AT)
    sets = marked.where(F.col("first").isNull() | (place == F.col("first"))).select(*AT, "n", "prefix", "bm1", "bm2")

    # groups first: their earliest members settle most of the others
    size_class = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    shared = sets.select(*AT, "n", "bm1", "bm2", size_class.alias("c"), F.explode(F.slice("prefix", F.greatest(F.lit(1), F.size("prefix") - (HOT_WORDS - 1)), F.lit(HOT_WORDS))).alias("w"))
    settled = led = large = None
    for turn in range(ROUNDS):
        fresh = shared
        if turn:
            large = cut(shared.join(_small(groups.where(F.col("members") >= LARGE).select("w", "c")), ["w", "c"])) if large is None else large
            fresh = large.join(_small(settled), AT, "left_anti").join(_small(led), AT, "left_anti")
        # members and least ids are numbers, which combine in the tasks; only rows with a group's least id are sorted for its leader
        groups = fresh.groupBy("w", "c").agg(F.count(F.lit(1)).alias("members"), F.min("d").alias("d"))
        groups = cut(groups.where(F.col("members") >= (LARGE if turn else HOT)))
        first = fresh.join(_small(groups.drop("members")), ["w", "c", "d"])
        leaders = cut(first.groupBy("w", "c").agg(F.min(F.struct(*AT, "n", "bm1", "bm2")).alias("l")).select("w", "c", "l.*"))
        if turn and leaders.isEmpty():
            break
        led = cut(leaders.select(*AT).distinct() if led is None else led.unionByName(leaders.select(*AT)).distinct())
        pairs = _pairs(fresh.alias("a").join(_small(leaders).alias("b"), ["w", "c"]).where(_before("b", "a") & _likely("a", "b", bounds, False)))
        more = _verified(documents, pairs, bounds)
        settled = cut(more if settled is None else settled.unionByName(more).distinct())

    # all that is open against all that is earlier; both sides read the same columns and no condition is on one side alone, so one
    # exchange serves both: a size below zero marks a settled set
    open_sets = sets.join(_small(settled).withColumn("settled", F.lit(True)), AT, "left")
    signed = F.when(F.col("settled"), -F.col("n")).otherwise(F.col("n"))
    postings = _postings(open_sets.withColumn("n", signed))
    met = postings.alias("a").join(postings.alias("b"), F.col("a.w") == F.col("b.w")).where(
        F.when((F.col("a.size") > 0) & _before("b", "a"), _likely("a", "b", bounds, True)).otherwise(F.lit(False)))
    found = _verified(documents, _pairs(met), bounds)
    return copies.unionByName(settled).unionByName(found)


def _removed(docs: DataFrame, threshold: float) -> DataFrame:
    gone = later_matches(docs, threshold)
    return cut(gone.groupBy("d", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
               .withColumnsRenamed({"d": "gone_d", "th": "gone_th"}))


def _with_removed(rows: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (own_id, own_th, ...) with the lines that go from each."""
    own = (F.col("own_id") == F.col("gone_d")) & (F.col("own_th") == F.col("gone_th"))
    return rows.join(_removed(docs, threshold), own, "left")


def _own() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("own_id"), F.xxhash64("text").alias("own_th")]


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every document; ``removed`` lists line numbers, from 0."""
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    rows = docs.select("doc_id", *_own(), n.cast("long").alias("n_lines"))
    return _with_removed(rows, docs.select("doc_id", "text"), threshold).select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the lines that go; all columns stay."""
    def rebuilt(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    rows = docs.select(F.struct("*").alias("row"), *_own())        # no column of docs can clash
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(bind(F.split("row.text", "\n"), rebuilt))
    return _with_removed(rows, docs.select("doc_id", "text"), threshold).select(F.col("row").withField("text", text).alias("row")).select("row.*")
