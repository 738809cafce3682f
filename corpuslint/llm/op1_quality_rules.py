"""Quality rules: weak supervision instead of all-must-pass filtering (DataFrame functions only).

Each rule votes good (1), bad (-1) or abstains (0). Documents with the same votes
are counted together - at most 3^rules patterns, whatever the corpus size - and
expectation-maximisation over those counts estimates each rule's accuracy on good
and on bad texts and the share of good texts. A document's verdict is the
posterior probability of being good given its votes.

Defined cases: a null text has no words and fails the base rules; an empty text
likewise; repeated rows give one row each; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
ROUNDS = 30


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text. Windows compare by a 64-bit hash of their five words, inside one text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("w", words(F.col("text")))
    d = d.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda x: x == "|")).alias("n_bars"),
        F.regexp_count(text, F.lit(r"[A-Z]")).alias("n_upper"),
        F.size(F.filter("w", lambda x: F.substring(x, -1, 1).isin(".", "!", "?"))).alias("n_sentences"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "").alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    d = d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_bars", "n_upper", "n_sentences",
                 F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.when(F.col("n_words") >= WINDOW, F.transform(
                     F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
                     lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).alias("win"))
    # only a text in which some window occurs twice has its windows sorted together with their places
    d = d.withColumn("s", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform(
        "win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("win")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    d = d.withColumn("p", F.sort_array(F.transform(F.filter(
        "s", lambda x, k: same(x, F.get("s", k - 1)) | same(x, F.get("s", k + 1))), lambda x: x["i"]))).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                          lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstain. A text without words gets bad votes only from the length rule."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good & (c("n_words") > 0), 1).otherwise(0)

    return {
        "length": rule(c("n_words") < 15, c("n_words") >= 40),
        "symbols": rule(c("n_symbols") * 20 > chars, c("n_symbols") * 200 <= chars),
        "dup_lines": rule((c("n_dup_lines") * 10 > c("n_lines") * 3), (c("n_dup_lines") == 0) & (c("n_lines") > 1)),
        "repeats": rule(c("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT, c("n_repeat_words") * 100 <= n * 5),
        "word_length": rule((chars > n * 14) | (c("word_chars") < n * 2), (chars <= n * 10) & (chars >= n * 3)),
        "bars": rule(c("n_bars") * 20 > n, (c("n_bars") == 0) & (c("n_words") >= 40)),
        "upper": rule(c("n_upper") * 2 > chars, c("n_upper") * 5 <= chars),
        "sentences": rule((c("n_sentences") == 0) & (c("n_words") >= 60), (c("n_sentences") * 40 >= n) & (c("n_sentences") * 2 <= n)),
    }


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def fit(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> DataFrame:
    """EM over the vote patterns: (the votes, `quality`), one row per pattern.

    The patterns - at most 3^rules rows - stand in one row as an array, and the
    rounds are one `aggregate` expression whose state is the posterior of each
    pattern. A rule's accuracy is kept between a coin's and 0.995, and its vote
    says nothing where it abstains.
    """
    names = [f"v_{r}" for r in rules]
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("v"), F.col("n").cast("double").alias("n")))).alias("p"))
    held = lambda a, b: F.least(F.lit(0.995), F.greatest(F.lit(0.505), (a + 4.0) / (b + 5.0)))

    def accuracy(q: Column, vote: int) -> Column:
        weight = (lambda p, x: p["n"] * x) if vote == 1 else (lambda p, x: p["n"] * (1.0 - x))
        return F.transform(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda j: held(
            _total(F.zip_with("p", q, lambda p, x: F.when(F.get(p["v"], j) == vote, weight(p, x)).otherwise(0.0))),
            _total(F.zip_with("p", q, lambda p, x: F.when(F.get(p["v"], j) != 0, weight(p, x)).otherwise(0.0)))))

    def model(q: Column) -> Column:
        share = (_total(F.zip_with("p", q, lambda p, x: p["n"] * x)) + 1.0) / (_total(F.transform("p", lambda p: p["n"])) + 2.0)
        return F.struct(F.least(F.lit(0.99), F.greatest(F.lit(0.01), share)).alias("share"), accuracy(q, 1).alias("good"), accuracy(q, -1).alias("bad"))

    def odds(m: Column) -> Column:
        """What a good and a bad vote of each rule add to the log odds."""
        return F.struct(F.log(m["share"] / (1.0 - m["share"])).alias("start"),
                        F.zip_with(m["good"], m["bad"], lambda g, b: F.log(g / (1.0 - b))).alias("up"),
                        F.zip_with(m["good"], m["bad"], lambda g, b: F.log((1.0 - g) / b)).alias("down"))

    def posteriors(o: Column) -> Column:
        return F.transform("p", lambda p: 1.0 / (1.0 + F.exp(-(o["start"] + _total(F.transform(
            p["v"], lambda v, j: F.when(v == 1, F.get(o["up"], j)).when(v == -1, F.get(o["down"], j)).otherwise(0.0)))))))

    first = posteriors(F.struct(F.lit(math.log(4.0)).alias("start"), *[
        F.array_repeat(F.lit(x), len(rules)).alias(k) for k, x in (("up", math.log(4.0)), ("down", -math.log(4.0)))]))
    after = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda q, _: _let(_let(model(q), odds), posteriors))
    rows = one.select("p", after.alias("q")).select(F.explode(F.arrays_zip("p", "q")).alias("x"))
    return rows.select(*[F.get(F.col("x.p.v"), j).alias(n) for j, n in enumerate(names)], F.col("x.q").alias("quality"))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: counts, votes, `quality` (posterior), `base_failed`, `kept`."""
    scratch = Scratch(docs.sparkSession, "quality")
    rule_votes = votes()
    rules = list(rule_votes)
    f = scratch.keep(features(docs).withColumns({f"v_{k}": v.cast("int") for k, v in rule_votes.items()}))
    patterns = scratch.keep(f.groupBy(*[f"v_{r}" for r in rules]).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    verdicts = F.broadcast(scratch.keep(fit(patterns, rules)))  # at most 3^rules rows
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return (f.join(verdicts, [f"v_{r}" for r in rules]).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def query(spark, sf_dir):
    from corpuslint.llm.common import documents

    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
