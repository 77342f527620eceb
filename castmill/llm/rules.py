"""Quality rules with risk-controlled thresholds.

Per document: counts of words, symbols, repeated lines and repeated words. Each rule is a ratio with
larger values worse. For each stratum (language) and rule, the distinct texts among labelled good documents
are the holdout. Cutoffs on a fixed grid are tested in fixed sequence from the loosest on: a cutoff is valid
while the exact binomial test rejects a false-rejection rate of ALPHA divided by the number of rules, and
the first one that isn't ends the sequence. The grid thus needs no correction of its own, since rejections
only grow along it; the level DELTA is divided by strata and rules (Bonferroni). All valid cutoffs hold at
once with probability 1 - DELTA, so any of them may be chosen: the one with most labelled bad rejected less
good ones, the loosest of equals. A rule without a valid or useful cutoff rejects nothing in its stratum.

Null and empty texts have no words and fail the base rules. Null languages are a stratum of their own.
Several labels of one document: the largest counts. Ties lie within a cutoff (only larger values
fail). Repeated rows and rows without an id each get a row; an empty table gives an empty result. Strata
without labels keep whatever the base rules keep. Other columns aren't read.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, table
from .parts import slices

SYMBOLS, ALPHA, DELTA, GRID = "#*$%&|<>", 0.08, 0.05, 50
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Rules: name, numerator, denominator, scale to 0..1.
RULES = [("symbols", "n_symbols", "n_words", 1.0), ("dup_lines", "n_dup_lines", "n_words", 10.0), ("repeats", "n_repeat_words", "n_words", 1.0), ("long_words", "word_chars", "n_words", 0.05)]


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    words = text.encode().split()
    n = len(words)
    chars = sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words))
    symbols, repeat = sum(map(text.count, SYMBOLS)), 0
    if n >= 4:
        index: dict[bytes, int] = {}
        w = np.fromiter((index.setdefault(x, len(index)) for x in words), np.int64, n)
        pair = np.unique(w[:-1] * len(index) + w[1:], return_inverse=True)[1].astype(np.int64)
        _, inverse, count = np.unique(pair[:-1] * len(index) + w[2:], return_inverse=True, return_counts=True)
        twice, cover = count[inverse] > 1, np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= twice
        repeat = int(cover.sum())
    return n, chars, symbols, dup, repeat


def _stats(batches):
    for b in slices(batches):
        cols = list(zip(*map(text_stats, b.column(2).to_pylist()))) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", "stratum", "text_key", *STATS])


def log_beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log of the regularised incomplete beta function I_x(a, b), by its continued fraction, where x is below its mean."""
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = a * np.log(x) + b * np.log1p(-x) - np.log(a) + gamma(a + b) - gamma(a) - gamma(b)
    tiny, c = 1e-300, np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, 10_000):
        was = value.copy()
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            value = value * d * c
        if np.all(np.abs(value - was) <= 1e-12 * np.abs(value)):
            break
    return front + np.log(value)


def _log_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log P(Binomial(n, p) <= k), or 0 where k is above the mean and so can't reject."""
    out = np.zeros(len(k))
    low = (k <= n * p) & (n > 0)
    if low.any():
        out[low] = log_beta_share(n[low] - k[low], k[low] + 1.0, 1 - p[low])
    return out


@F.pandas_udf(T.DoubleType())
def log_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(_log_tail(*(x.to_numpy(float) for x in (k, n, p))))


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid: int = GRID) -> DataFrame:
    """stratum, rule, cutoff, from the rule values of labelled documents (good: boolean), a row each."""
    values = labelled.select("stratum", "good", F.explode(F.create_map(*[x for r, *_ in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "value"))
    # A value in bin b fails every grid cutoff c / grid with c < b.
    bins = values.groupBy("stratum", "rule", F.least(F.ceil(F.col("value") * grid), F.lit(grid + 1)).cast("int").alias("bin"))
    bins = bins.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    steps = bins.groupBy("stratum", "rule").agg(F.sum("good").alias("n")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(grid)))).withColumn("bin", F.col("step"))
    merged = steps.withColumns({"good": F.lit(0).cast("long"), "bad": F.lit(0).cast("long")}).unionByName(bins, allowMissingColumns=True)
    own = Window.partitionBy("stratum", "rule").orderBy("bin")  # at most 2 * grid + 3 rows
    above = lambda c: F.coalesce(F.sum(c).over(own.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    fails = merged.select("*", above("good").alias("k"), above("bad").alias("hit")).where("step is not null")
    n_strata = bins.agg(F.count_distinct("stratum")).first()[0] or 1  # one number
    level = math.log(delta / (n_strata * len(RULES)))
    tested = fails.withColumn("passed", log_tail("k", "n", F.lit(alpha / len(RULES))) <= level)
    looser = Window.partitionBy("stratum", "rule").orderBy(F.desc("step"))
    valid = tested.withColumn("so_far", F.min("passed").over(looser.rowsBetween(Window.unboundedPreceding, 0))).where("so_far and hit > k")
    best = valid.groupBy("stratum", "rule").agg(F.max(F.struct(F.col("hit") - F.col("k"), F.col("step"))).alias("b"))
    return best.select("stratum", "rule", (F.col("b.step") / grid).alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, the counts, the rule values, base_failed, kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    stats = rows.mapInArrow(_stats, f"doc_id {kind}, stratum string, text_key long, {', '.join(f'{c} long' for c in STATS)}")
    stats = durable(stats.withColumns({r: F.coalesce(F.try_divide(a, F.col(b)) * s, F.lit(0.0)) for r, a, b, s in RULES}))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    # Copies of a text are one trial.
    trials = stats.join(known, "doc_id").groupBy("stratum", "text_key").agg(F.bool_or("good").alias("good"), *[F.first(r).alias(r) for r, *_ in RULES])
    limits = cutoffs(trials, alpha, delta)
    wide = limits.groupBy("stratum").pivot("rule", [r for r, *_ in RULES]).agg(F.first("cutoff"))
    wide = wide.select("stratum", *[F.col(r).alias(f"cut_{r}") for r, *_ in RULES])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r, *_ in RULES]
    out = stats.join(wide, "stratum", "left").withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & ~(over[0] | over[1] | over[2] | over[3])).drop("text_key", *[f"cut_{r}" for r, *_ in RULES])


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *STATS, "base_failed", "kept")
