"""Quality rules whose cutoffs are chosen by risk control. DataFrame functions only.

Each rule compares one figure of a text with a cutoff from a fixed list. Labelled documents (``quality`` 1 is clean) are the
holdout: for every stratum, rule and cutoff the number k of clean documents it would reject, out of n, is tested
against the hypothesis that the rule's false rejections exceed its risk. The p-value is the exact binomial tail
P(Bin(n, risk) <= k). A cutoff counts as safe if p is at most ``delta`` divided by the number of all tests (Bonferroni, over
strata, rules and cutoffs), so with probability 1 - ``delta`` every safe cutoff keeps its promise, whichever is picked.
The risk of a stratum, ``alpha``, is divided over the rules: all rules together reject at most that share of its
clean documents. Of the safe cutoffs the one with the best balance of bad documents caught and clean ones lost is taken;
none, if it does not pay or nothing is safe. A stratum without enough labels therefore rejects nothing beyond the base rules.

Texts are read once, into a small table of figures; labels meet figures, not texts. Cutoffs are a few rows a stratum.

Defined results: a null text has no words and fails the base rules; null languages form a stratum of their own; a
document labelled several times counts once, as clean only if all its labels say so; null labels are ignored;
labels without a document are ignored; repeated documents are judged each on its own; with no labels at all only the
base rules reject; other columns are ignored by :func:`judge` and kept by :func:`keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlake.functions.content import bind, once
from decisionlake.session import cut

# --- fixed values: base figures and rules -----------------------------------------------------
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


@dataclass(frozen=True)
class Rule:
    """Rejects where ``over / under`` reaches the cutoff. ``cutoffs`` ascend, from strict to loose."""
    name: str
    over: str
    under: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)),
    Rule("capitals", "n_capitals", "word_chars", (0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0.1, 0.15, 0.2, 0.3, 0.4)),
    Rule("long_words", "word_chars", "n_words", (6.5, 7.0, 8.0, 10.0, 15.0)),
)
ALPHA = 0.1                               # clean documents of a stratum that all rules together may reject
DELTA = 0.05                              # chance that any promise is broken
LOSS = 10.0                               # a lost share of clean documents weighs as much as this many shares of bad ones caught


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array if it has none."""
    inner = F.trim(text, F.lit(BLANKS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(word_list: Column) -> Column:
    """Words inside three-word windows that occur twice or more, in O(n log n) for a text of n words."""
    def covered(windows: Column) -> Column:
        at = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        # in order of hash, a window is repeated if a neighbour has its hash
        return bind(F.sort_array(at), lambda s: bind(
            F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))),
                       lambda a, b: F.struct(a["at"].alias("at"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("next"))),
            lambda p: bind(F.sort_array(F.array_compact(F.zip_with(
                p, F.concat(F.array(F.lit(False)), F.transform(p, lambda x: x["next"])),
                lambda x, before: F.when(x["next"] | before, x["at"])))), _cover)))

    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    windows = bind(hashes, lambda h: F.zip_with(
        F.zip_with(F.slice(h, 1, F.size(h) - 2), F.slice(h, 2, F.size(h) - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(h, 3, F.size(h) - 2), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c)))
    found = bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(word_list) < 4, F.lit(0)).otherwise(found).cast("long")


def _cover(starts: Column) -> Column:
    """Words that windows of three starting at these ascending places cover."""
    steps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
                       lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def figures(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, stratum, figures) of every row of ``docs`` (doc_id, text, lang), with the columns ``keep``."""
    kept = [F.struct(*[F.col(c) for c in keep]).alias("carried")] if keep else []
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("stratum"), *kept)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    rows = once(rows, "words", words(F.col("text")))
    return rows.select(
        "doc_id", "stratum", *(["carried"] if keep else []),
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("text"), BLANKS).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        (F.length("text") - _without(F.col("text"), CAPITALS)).cast("long").alias("n_capitals"),
    ).withColumns({"n_dup_lines": F.col("lines.dup"), "n_lines": F.col("lines.all")}).drop("lines").withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _level(rule: Rule) -> Column:
    """How many of a rule's cutoffs a document reaches (0: none)."""
    ratio = F.when(F.col(rule.under) > 0, F.col(rule.over) / F.col(rule.under)).otherwise(F.lit(0.0))
    return sum((F.when(ratio >= c, 1).otherwise(0) for c in rule.cutoffs), F.lit(0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact, summed in logarithms. 1 where k is beyond the mean, which no test here can pass."""
    import math
    odds, none = math.log(p / (1 - p)), math.log1p(-p)
    start = F.struct((n * F.lit(none)).alias("term"), (n * F.lit(none)).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        return bind(acc["term"] + F.log((n - i + 1) / i) + F.lit(odds), lambda t: F.struct(
            t.alias("term"), (F.greatest(acc["total"], t) + F.log1p(F.exp(-F.abs(acc["total"] - t)))).alias("total")))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, add, lambda acc: acc["total"])))


def calibrate(found: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA,
              delta: float = DELTA, loss: float = LOSS) -> DataFrame:
    """(stratum, rule, cutoff, level, n_clean, false_rejections, p_value, n_bad, caught): the chosen cutoffs.

    ``found`` are the figures; only documents that pass the base rules are tested.
    """
    truth = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = found.where("NOT base_failed").select("doc_id", "stratum", *FIGURES).join(truth, "doc_id")
    levels = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), _level(r).alias("level")) for r in rules]))
    counts = (held.select("stratum", (F.col("quality") >= 1).alias("clean"), levels.alias("x")).groupBy("stratum", "x.rule", "x.level")
              .agg(F.count_if("clean").alias("clean"), F.count_if(~F.col("clean")).alias("bad")))
    cutoffs = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("level"), F.lit(c).alias("cutoff"), F.lit(r.name).alias("rule"))
                                  for r in rules for i, c in enumerate(r.cutoffs)])).alias("c")
    # a few rows a stratum from here on
    totals = counts.groupBy("stratum", "rule").agg(F.sum("clean").alias("n_clean"), F.sum("bad").alias("n_bad"))
    strata = totals.select("stratum").distinct()
    tests = strata.select("stratum", cutoffs).select("stratum", "c.*").join(totals, ["stratum", "rule"])
    reach = (tests.select("stratum", "rule", F.col("level").alias("cut_level"))
             .join(counts, ["stratum", "rule"]).where("level >= cut_level").groupBy("stratum", "rule", "cut_level")
             .agg(F.sum("clean").alias("false_rejections"), F.sum("bad").alias("caught")).withColumnRenamed("cut_level", "level"))
    tests = (tests.join(reach, ["stratum", "rule", "level"], "left")
             .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("false_rejections", "caught")})
             .withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy())))
    tests = tests.withColumn("p_value", binomial_tail(F.col("false_rejections"), F.col("n_clean"), alpha / len(rules)))
    gain = F.col("caught") / F.greatest("n_bad", F.lit(1)) - loss * F.col("false_rejections") / F.greatest("n_clean", F.lit(1))
    best = (tests.where(F.col("p_value") <= delta / F.col("tests")).withColumn("gain", gain).where("gain > 0")
            .groupBy("stratum", "rule").agg(F.max_by(F.struct(*[c for c in tests.columns if c not in ("stratum", "rule")]), F.struct("gain", "cutoff")).alias("b")))
    return best.select("stratum", "rule", "b.cutoff", "b.level", "b.n_clean", "b.false_rejections", "b.p_value", "b.n_bad", "b.caught")


def _judged(found: DataFrame, labels: DataFrame, **options) -> DataFrame:
    rules = options.get("rules", RULES)
    chosen = calibrate(found, labels, **options)
    chosen = cut(chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"__{r.name}") for r in rules]))
    ratio = {r.name: F.col(r.over) / F.col(r.under) for r in rules}
    broken = F.array_compact(F.array(*[F.when((F.col(r.under) > 0) & (ratio[r.name] >= F.col(f"__{r.name}")), F.lit(r.name)) for r in rules]))
    joined = found.join(chosen, "stratum", "left").withColumn("rejected_by", broken)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(*[f"__{r.name}" for r in rules])


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, stratum, figures, base_failed, rejected_by, kept) of every document."""
    return _judged(cut(figures(docs)), labels, **options)


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns; rows that share an id are judged each by its own text."""
    digest = F.xxhash64("text")
    found = cut(figures(docs.select("doc_id", "text", "lang", digest.alias("digest")), ["digest"]))
    gone = _judged(found, labels, **options).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("carried.digest").alias("gone_digest")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), digest.alias("own_digest"))      # no column of docs can clash
    return rows.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_digest") == F.col("gone_digest")), "left_anti").select("row.*")
