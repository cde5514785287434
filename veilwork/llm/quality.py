"""Quality rules: text statistics and a learned decision list, all as Spark expressions.

``text_stats`` adds the statistics of a whole text.  ``learn_rules`` grows and
prunes threshold conjunctions by sequential covering on the statistics of
labelled documents, and ``verdict`` turns the list into one ordered
``CASE WHEN`` expression.  No Python runs on the executors; the learner sees
at most ``train_rows`` rows of numbers on the driver.

Null and empty texts have zero words, zero counts and fail the base rule.
Repeated rows are judged one by one, each the same.  Without labels the list
is empty and every document passes it.  Other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.shared import WORD, table, whole

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "capital_share")


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of five words that occur at least twice in the array (the first included).

    The window digests are sorted together with their places; a window that
    equals a neighbour is repeated.  Each repeated window covers five words
    less those that the repeated window before it covers already.
    """
    last = F.size(hashes) - WINDOW + 1
    windows = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(last, F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
    )

    def covered(digests: Column) -> Column:
        placed = F.sort_array(F.transform(digests, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.transform(F.array(placed), lambda s: _covered_by(s))[0]

    # arrays of one element bind a value to a name, so that it is computed once
    return F.transform(
        F.array(windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0))
    )[0]


def _covered_by(placed: Column) -> Column:
    twice = F.filter(
        placed,
        lambda s, k: (s["h"] == F.get(placed, k - 1)["h"]).eqNullSafe(True)
        | (s["h"] == F.get(placed, k + 1)["h"]).eqNullSafe(True),
    )
    places = F.sort_array(F.transform(twice, lambda s: s["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        places,
        start,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the learner's ratios.

    Columns of these names that the input has already are replaced.
    """
    body = whole(text)
    first = docs.withColumns({"__body": body, "__hashes": F.transform(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))})
    lines = F.filter(F.split("__body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = first.withColumns(
        {
            "n_words": F.size("__hashes").cast("long"),
            "word_chars": (F.length("__body") - F.regexp_count("__body", F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
            "n_symbols": F.regexp_count("__body", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
            "n_repeat_words": repeated_words(F.col("__hashes")).cast("long"),
            "__capitals": F.regexp_count("__body", F.lit("[A-Z]")),
            "__lines": F.size(F.split("__body", "\n", -1)),
        }
    )
    some = lambda c: F.greatest(c, F.lit(1))
    chars, words = some(F.col("word_chars")), some(F.col("n_words"))
    return counted.withColumns(
        {
            "mean_word": F.col("word_chars") / words,
            "symbol_share": F.col("n_symbols") / chars,
            "dup_line_share": F.col("n_dup_lines") / some(F.col("__lines")),
            "repeat_share": F.col("n_repeat_words") / words,
            "capital_share": F.col("__capitals") / chars,
        }
    ).drop("__body", "__hashes", "__capitals", "__lines")


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, 'le' or 'gt', threshold)``; documents it covers are dropped."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def column(self) -> Column:
        tests = [F.col(f) <= t if side == "le" else F.col(f) > t for f, side, t in self.conditions]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


def _covers(conditions, x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for f, side, t in conditions:
        column = x[:, FEATURES.index(f)]
        inside &= column <= t if side == "le" else column > t
    return inside


def _grow(x: np.ndarray, bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list:
    """Add the condition with the best information gain until no good document is covered."""
    conditions: list = []
    inside = np.ones(len(x), bool)
    while len(conditions) < most:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for k, f in enumerate(FEATURES):
            for t in cuts[f]:
                low = x[:, k] <= t
                for side, test in (("le", low), ("gt", ~low)):
                    now = inside & test
                    p = int((now & bad).sum())
                    if p:
                        gain = p * (np.log2(p / int(now.sum())) - base)
                        if gain > best[0]:
                            best = (gain, (f, side, float(t)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= _covers([best[1]], x)
    return conditions


def _prune(conditions: list, x: np.ndarray, bad: np.ndarray) -> list:
    """Cut the tail of the conjunction as long as the held-back rows are served at least as well."""

    def worth(c) -> float:
        inside = _covers(c, x)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
        conditions = conditions[:-1]
    return conditions


def learn_list(
    rows: list, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 5, cuts: int = 24
) -> list[Rule]:
    """Sequential covering over ``(features..., bad)`` rows; every third row is held back for pruning."""
    if not rows:
        return []
    data = np.array([[float(v) for v in r] for r in rows])
    x, bad = data[:, :-1], data[:, -1] > 0
    held = np.arange(len(x)) % 3 == 2
    at = {f: np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, cuts))) for k, f in enumerate(FEATURES)}
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules and (left & bad & ~held).sum() >= min_covered:
        grow, keep = left & ~held, left & held
        conditions = _grow(x[grow], bad[grow], at, max_conditions)
        if not conditions:
            break
        conditions = _prune(conditions, x[keep], bad[keep])
        inside = left & _covers(conditions, x)
        n, p = int(inside.sum()), int((inside & bad).sum())
        if n < min_covered or p / n < min_precision:
            break
        rules.append(Rule(tuple(conditions), p / n, n))
        left &= ~inside
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, **options) -> list[Rule]:
    """Learn from at most ``train_rows`` labelled documents (those with the smallest digest of their id).

    ``quality`` 0 is bad, 1 is good; other values and null ids are not used.
    Several labels of one document count as bad if any of them is 0.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = (
        known.groupBy("doc_id").agg(F.min("quality").alias("__quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    # the sample has at most train_rows rows of two numbers: bounded, so it may be broadcast
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = text_stats(labelled).orderBy(F.xxhash64("doc_id"), *FEATURES).select(*FEATURES, (1 - F.col("__quality")).alias("bad")).limit(train_rows).collect()
    return learn_list(rows, **options)


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule of the list, tried in order, covers the row."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return text_stats(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its statistics, the base rule and the learned verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
