"""Pairs of texts and lists: alignment, error rates, n-gram overlap, comparison tables."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import let
from ..functions.text import words

COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("substitutions", "deletions", "insertions", "hits")])


def nest_words(segments: DataFrame, word_rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Segments with their words in order as an array; without words an empty one. Blank segments go."""
    kept = [c for c in word_rows.columns if c not in keys]
    lists = word_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in kept if c != order]))).alias("words"))
    return segments.where(F.trim("text") != "").join(lists, keys, "left").withColumn("words", F.coalesce("words", F.array()))


def align_segments(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Reference and hypothesis by position; n_left, n_right and reason (unequal counts) per key."""
    number = lambda df, name: df.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("pos"), F.col("text").alias(name))
    both = number(left, "reference").join(number(right, "hypothesis"), [key, "pos"], "full_outer")
    own = Window.partitionBy(key)
    both = both.withColumns({"n_left": F.count("reference").over(own), "n_right": F.count("hypothesis").over(own)})
    return both.withColumn("reason", F.when(F.col("n_left") != F.col("n_right"), "unequal_counts"))


def _coded(a, b) -> tuple[np.ndarray, np.ndarray]:
    number: dict[str, int] = {}
    return tuple(np.fromiter((number.setdefault(x, len(number)) for x in s), np.int64, len(s)) for s in (a, b))


def _edits(a, b) -> tuple[int, int, int, int]:
    """Least edits of two token lists: substitutions, deletions, insertions, hits; a pair is preferred to a deletion, that to an insertion.

    One row of the edit table is held, and beside each cell the counts of the way back from it: they are those of the cell
    that the way goes to next. Cells reached by insertions take them from the last other cell of their row."""
    a, b = _coded(a, b)
    steps = np.arange(len(b) + 1, dtype=np.int32)
    cost, s, d = steps.copy(), np.zeros(len(b) + 1, np.int32), np.zeros(len(b) + 1, np.int32)
    for i, x in enumerate(a, 1):
        other = (b != x).astype(np.int32)
        pair, gap = cost[:-1] + other, cost + 1
        now = gap.copy()
        np.minimum(now[1:], pair, out=now[1:])
        now = np.minimum.accumulate(now - steps) + steps
        by_pair = np.append(False, pair == now[1:])
        own = by_pair | (gap == now)
        s = np.where(by_pair, np.append(0, s[:-1] + other), s)
        d = np.where(by_pair, np.append(0, d[:-1]), d + 1)
        last = np.maximum.accumulate(np.where(own, steps, 0))
        cost, s, d = now, s[last], d[last]
    s, d, total = int(s[-1]), int(d[-1]), int(cost[-1])
    return s, d, total - s - d, len(a) - s - d


@F.pandas_udf(COUNTS)
def edit_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Least-edit counts of two token arrays; among equal totals substitutions come before gaps."""
    return pd.DataFrame([_edits(list(a), list(b)) for a, b in zip(reference, hypothesis)], columns=["substitutions", "deletions", "insertions", "hits"])


@F.pandas_udf(T.LongType())
def common_length(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays."""

    def one(a, b):
        a, b = _coded(a, b)
        row = np.zeros(len(b) + 1, np.int64)
        for x in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
        return int(row[-1])

    return pd.Series([one(list(a), list(b)) for a, b in zip(reference, hypothesis)], dtype="int64")


@F.pandas_udf(T.DoubleType())
def exact_meteor(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """METEOR by exact matches: F mean at alpha 0.9, less half the cube of chunks by matches. Each word of the hypothesis takes
    the place after its forerunner's where that fits, else the first free one."""

    def one(a, b):
        free, at = {}, []
        for i, x in enumerate(a):
            free.setdefault(x, []).append(i)
        last = -2
        for y in b:
            places = free.get(y)
            if places:
                last = places.pop(places.index(last + 1) if last + 1 in places else 0)
                at.append(last)
            else:
                at.append(None)
                last = -2
        m = sum(i is not None for i in at)
        if not m:
            return 0.0
        chunks = sum(i is not None and (k == 0 or at[k - 1] is None or i != at[k - 1] + 1) for k, i in enumerate(at))
        p, r = m / len(b), m / len(a)
        return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / m) ** 3)

    return pd.Series([one(list(a), list(b)) for a, b in zip(reference, hypothesis)], dtype=float)


def error_rates(pairs: DataFrame) -> DataFrame:
    """Word error counts and rate of columns reference and hypothesis, already normalised."""
    e = edit_counts(words(F.col("reference")), words(F.col("hypothesis")))
    n = F.size(words(F.col("reference"))).cast("long")
    rows = pairs.withColumn("_e", e).select("*", "_e.*", n.alias("n_reference")).drop("_e")
    return rows.withColumn("wer", F.try_divide(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("n_reference")))


def wer_report(rates: DataFrame, key: str) -> DataFrame:
    """Per key: rate by hits (insertions don't count) and the standard one."""
    n = F.sum("n_reference")
    return rates.groupBy(key).agg((1 - F.try_divide(F.sum("hits"), n)).alias("wer_hits"), F.try_divide(F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions")), n).alias("wer"))


def grams(c: str, n: int) -> Column:
    """n-grams of the lower-case ASCII words and numbers; none where the text has under n."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    places = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1)))
    return found if n == 1 else let(found, lambda t: F.transform(places(t), lambda i: F.array_join(F.slice(t, i, n), " ")))


@F.pandas_udf(T.LongType())
def shared(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Size of the common multiset of two arrays."""
    return pd.Series([(Counter(a) & Counter(b)).total() for a, b in zip(reference, hypothesis)], dtype="int64")


def rouge_n(pairs: DataFrame, key: list[str], n: int = 1) -> DataFrame:
    """Precision, recall and F1 of shared n-grams (a multiset) of reference and hypothesis; 0 where a side has none. Each pair is worked out in its row."""
    some = lambda c: F.coalesce(grams(c, n), F.array().cast("array<string>"))
    rows = pairs.select(*key, some("reference").alias("_a"), some("hypothesis").alias("_b")).withColumn("_n", shared("_a", "_b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(*key, zero(F.try_divide("_n", F.size("_b"))).alias("precision"), zero(F.try_divide("_n", F.size("_a"))).alias("recall"), zero(F.try_divide(2 * F.col("_n"), F.size("_a") + F.size("_b"))).alias("f1"))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """pairs with precision, recall and F1 of the longest common subsequence of words; 0 where a side has none."""
    a, b = grams("reference", 1), grams("hypothesis", 1)
    rows = pairs.withColumns({"_a": a, "_b": b}).withColumn("_n", common_length("_a", "_b"))
    share = lambda x: F.coalesce(F.try_divide("_n", F.size(x)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("_n"), F.size("_a") + F.size("_b")), F.lit(0.0))
    return rows.withColumns({"precision": share("_b"), "recall": share("_a"), "f1": f1}).drop("_a", "_b", "_n")


def meteor(pairs: DataFrame) -> DataFrame:
    """pairs with meteor, by exact matches of words."""
    return pairs.withColumn("meteor", exact_meteor(grams("reference", 1), grams("hypothesis", 1)))


def worst(rates: DataFrame, n: int = 5) -> DataFrame:
    """The n pairs of the largest word error rate."""
    return rates.where("wer is not null").orderBy(F.desc("wer"), *[c for c in rates.columns if c != "wer"][:2]).limit(n)


def metric_means(rows: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric per model."""
    return rows.groupBy(model).agg(*[F.avg(m).alias(m) for m in metrics])


def usable_pairs(rows: DataFrame, limit: int, order: str = "id") -> DataFrame:
    """The first rows that have an article and highlights."""
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return rows.where(some("article") & some("highlights")).orderBy(order).limit(limit)


def comparison_table(rows: DataFrame, model: str, metric: str, value: str, metrics: list[str], by: str | None = None) -> DataFrame:
    """One row per model, a column per metric (its mean, four places), by falling `by` where that is given."""
    wide = rows.groupBy(model).pivot(metric, metrics).agg(F.avg(value))
    wide = wide.select(model, *[F.round(m, 4).alias(m) for m in metrics])
    return wide.orderBy(F.desc(by), model) if by else wide
