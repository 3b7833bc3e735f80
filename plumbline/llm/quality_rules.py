"""Quality rules under weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over
the counts of vote patterns (at most 3 ** rules rows) estimates how often each rule gives each
vote on good and on bad documents, with no labels; the posterior probability that a document is
good replaces the test that all rules pass.

A word is a run of other characters than space and U+0009 to U+000D. Repeated words are those
inside a five-word window that occurs twice or more in the text; windows are compared by a 64-bit
hash (two different windows of one text agree with a chance of 2 ** -64 a pair).

Defined cases: null text has no words and fails the base test; texts are taken whole; repeated
rows count as often as they occur and keep their rows; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANK = " \t\n\x0b\f\r"
BLANKS = "[\\x20\\x09-\\x0D]"
WINDOW = 5
#: Rounds of expectation-maximisation.
ROUNDS = 30
#: What is believed of votes beforehand: the chance of good, none and bad on good and on bad
#: documents, weighing as much as this share of the documents, and one count of each vote.
BELIEF_GOOD = {1: 0.5, 0: 0.49, -1: 0.01}
BELIEF_BAD = {1: 0.2, 0: 0.5, -1: 0.3}
BELIEF_SHARE = 0.01
START_GOOD = 0.8
KEEP_AT = 0.5
RULES = ("symbols", "lines", "repeats", "word_length", "capitals", "variety", "sentences", "function_words", "length")
#: Common short words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in that is was for with on are be this from by at or as it not an "
    "der die das und ist nicht von mit auf ein eine im den zu sich "
    "le la les de des et un une est que qui dans pour sur pas "
    "el los las en por con para su del se lo"
).split()


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each document; a row for each row of ``docs``."""
    text = common.text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.filter(F.split("text", BLANKS + "+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "").alias("lines"))
    windows = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id",
        "words",
        windows.alias("windows"),
        F.size("words").cast("bigint").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(BLANKS))).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count("text", F.lit("\\p{L}")).cast("bigint").alias("n_letters"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        F.size(F.filter("words", lambda w: w.isin(*FUNCTION_WORDS))).cast("bigint").alias("n_function"),
        F.regexp_count("text", F.lit(f"[.!?](?={BLANKS}|\\z)")).cast("bigint").alias("n_ends"),
    )
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(_covered(F.col("windows"))).cast("bigint").alias("n_repeat_words"),
        "n_upper",
        "n_letters",
        "n_distinct",
        "n_function",
        "n_ends",
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda i, d: F.coalesce(F.get(s, i).h == F.get(s, i + d).h, F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, -1) | same(i, 1))
        return F.sort_array(F.transform(at, lambda i: F.get(s, i).i))

    # places in order: each adds the words up to the next place, a window at most
    def total(at: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        end = F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a.n + F.least(i - a.last, F.lit(WINDOW))).alias("n")))
        return end.n

    return _let(_let(placed, repeated), total)


def votes(rows: DataFrame) -> DataFrame:
    """``rows`` of ``features`` with ``votes``: array<int> in the order of ``RULES``."""
    n = F.col("n_words").cast("double")

    def rule(bad: Column, good: Column | None = None) -> Column:
        vote = F.when(bad, -1)
        return (vote if good is None else vote.when(good, 1)).otherwise(0)

    length = F.try_divide(F.col("word_chars"), n)
    return rows.withColumn(
        "votes",
        F.array(
            rule(F.col("n_symbols") > 0.1 * n),
            rule((F.col("n_lines") >= 4) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines"))),
            rule(F.col("n_repeat_words") > 0.2 * n),
            rule((length < 3.5) | (length > 7.5), length.between(4.2, 6)),
            rule(F.col("n_upper") > 0.3 * F.col("n_letters")),
            rule((n >= 50) & (F.col("n_distinct") < 0.3 * n)),
            rule((F.col("n_ends") > 0.4 * n) | ((n >= 50) & (F.col("n_ends") == 0)), F.col("n_ends").between(0.02 * n, 0.2 * n)),
            rule((n >= 30) & (F.col("n_function") < 0.05 * n), F.col("n_function") >= 0.12 * n),
            rule(n < 10),
        ),
    )


def _posterior(votes_: Column, state: Column) -> Column:
    """Probability that a document with these votes is good; abstaining is no evidence."""
    terms = F.aggregate(
        F.sequence(F.lit(0), F.lit(len(RULES) - 1)),
        state.bias,
        lambda a, j: a + F.when(F.get(votes_, j) == 1, F.get(state.yes, j)).when(F.get(votes_, j) == -1, F.get(state.no, j)).otherwise(F.lit(0.0)),
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms))


def _round(patterns: Column, state: Column) -> Column:
    """One round: posteriors of all patterns, then the votes' log likelihood ratios."""
    scored = F.transform(patterns, lambda p: F.struct(p.votes.alias("votes"), p.n.alias("n"), (p.n * _posterior(p.votes, state)).alias("good")))

    def estimate(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x.n)
        good = F.aggregate(s, F.lit(0.0), lambda a, x: a + x.good)

        def ratio(vote: int) -> Column:
            def one(j: Column) -> Column:
                hit = lambda value: F.aggregate(s, F.lit(0.0), lambda a, x: a + F.when(F.get(x.votes, j) == vote, value(x)).otherwise(F.lit(0.0)))
                on_good, on_all = hit(lambda x: x.good), hit(lambda x: x.n)
                belief = total * BELIEF_SHARE
                share_good = (on_good + belief * BELIEF_GOOD[vote] + 1) / (good + belief + 3)
                share_bad = (on_all - on_good + belief * BELIEF_BAD[vote] + 1) / (total - good + belief + 3)
                return F.log(share_good) - F.log(share_bad)

            return F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), one)

        return F.struct(F.log((good + 1) / (total - good + 1)).alias("bias"), ratio(1).alias("yes"), ratio(-1).alias("no"))

    return _let(scored, estimate)


def posteriors(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(votes, posterior)`` of each vote pattern in ``rows``: at most 3 ** rules rows."""
    counts = rows.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = counts.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    weights = lambda v: F.array(*(F.lit(math.log(BELIEF_GOOD[v] / BELIEF_BAD[v])) for _ in RULES))
    start = F.struct(F.lit(math.log(START_GOOD / (1 - START_GOOD))).alias("bias"), weights(1).alias("yes"), weights(-1).alias("no"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: _round(F.col("patterns"), s))
    one = one.select("patterns", state.alias("state"))
    return one.select(F.explode(F.transform("patterns", lambda p: F.struct(p.votes.alias("votes"), _posterior(p.votes, F.col("state")).alias("posterior")))).alias("p")).select("p.votes", "p.posterior")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``posterior`` and ``kept``: a row for each row of ``docs``."""
    rows = common.stored(votes(features(docs, id_col, text_col)))
    rows = rows.join(F.broadcast(posteriors(rows)), "votes")  # at most 3 ** 9 patterns
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= KEEP_AT)).alias("kept"),
        F.round("posterior", 6).alias("posterior"),
    )
