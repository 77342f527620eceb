"""Evaluation and audio metrics as aggregates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import written


def ranked(rows: DataFrame, c: str, key: str | None = None) -> DataFrame:
    """rows with rank_<c>, the average-tie rank of c (within key), without a sort of all rows, or of a key's, in one task.

    rows are written once and read twice. Distinct values are counted and dealt in ranges; a rank is the rows of the ranges
    before, those before it in its range, and half of its own. Null values have no rank."""
    own = [key] if key else []
    rows = written(rows)
    counts = rows.where(F.col(c).isNotNull()).groupBy(*own, c).agg(F.count("*").alias("_n"))
    dealt = written(counts.repartitionByRange(*own, c).withColumn("_p", F.spark_partition_id()))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy(*own, "_p").agg(F.sum("_n").alias("_all"))
    base = sums.select(*own, "_p", before(Window.partitionBy(*own).orderBy("_p"), "_all").alias("_base"))  # a row a range and key
    below = before(Window.partitionBy(*own, "_p").orderBy(c), "_n")
    rank = dealt.withColumn("_below", below).join(base, [*own, "_p"]).select(*own, c, (F.col("_base") + F.col("_below") + (F.col("_n") + 1) / 2).alias(f"rank_{c}"))
    return rows.join(rank, [*own, c], "left")


def classification_metrics(rows: DataFrame) -> DataFrame:
    """accuracy, f1 and auc of columns label and prob."""
    return ranked(rows, "prob").agg(*classification_of("label", "prob", "rank_prob"))


def classification_of(label: str, prob: str, rank: str) -> list[Column]:
    """Aggregates accuracy, f1 and auc (by the ranks of prob)."""
    p, y = F.col(prob) >= 0.5, F.col(label) == 1
    n = lambda c: F.sum(c.cast("long"))
    pos, neg = n(y), n(~y)
    auc = F.try_divide(F.sum(F.when(y, F.col(rank))) - pos * (pos + 1) / 2, pos * neg)
    return [F.try_divide(n(p == y), F.count(label)).alias("accuracy"), F.try_divide(2 * n(p & y), n(p) + n(y)).alias("f1"), auc.alias("auc")]


def spearman_mse(rows: DataFrame, a: str, b: str) -> DataFrame:
    r = ranked(ranked(rows, a), b)
    return r.agg(F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"), F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("mse"))


def ndcg_at_k(rows: DataFrame, key: str, true: str, pred: str, k: int = 10) -> DataFrame:
    """Linear gain, log2 discount, tied predictions averaged, in one pass over the rows.

    Each row counts for its prediction and for its true value; equal values of a key are one row with their number and
    mean, of which the k first are enough."""
    one = lambda kind, by: F.struct(F.lit(kind).alias("_kind"), F.col(by).cast("double").alias("_value"), F.col(true).cast("double").alias("_gain"))
    each = rows.select(key, F.inline(F.array(one("_dcg", pred), one("_ideal", true))))
    ties = each.groupBy(key, "_kind", "_value").agg(F.count("*").alias("_n"), F.avg("_gain").alias("_mean"))
    w = Window.partitionBy(key, "_kind").orderBy(F.desc_nulls_last("_value"))
    top = ties.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= k)
    top = top.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = F.when(F.col("_before") < k, F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("_n"), F.lit(k).cast("long")))).otherwise(F.array().cast("array<long>"))
    discount = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    sums = top.groupBy(key).agg(*[F.sum(F.when(F.col("_kind") == c, F.col("_mean") * discount)).alias(c) for c in ("_dcg", "_ideal")])
    return sums.select(key, F.try_divide("_dcg", "_ideal").alias("ndcg"))


def audio_levels(frames: DataFrame, key: str = "recording_id", clip: float = 0.99) -> DataFrame:
    """rms_db, snr_db and clipping share of samples in frames (arrays of float)."""
    x = F.transform("samples", lambda v: v.cast("double"))
    sq = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    rows = frames.select(key, sq.alias("sq"), F.size("samples").alias("n"), F.size(F.filter(x, lambda v: F.abs(v) >= clip)).alias("hot")).withColumn("rms", F.sqrt(F.col("sq") / F.col("n")))
    low = rows.groupBy(key).agg(F.percentile("rms", F.lit(0.1)).alias("low"), F.max("rms").alias("top"))
    quiet = F.col("rms") <= F.col("low")
    met = rows.join(low, key).groupBy(key).agg(
        F.sqrt(F.sum("sq") / F.sum("n")).alias("rms"), (F.sum("hot") / F.sum("n")).alias("clipping_ratio"), F.first("top").alias("top"),
        F.greatest(F.avg(F.when(quiet, F.pow("rms", F.lit(2)))), F.lit(1e-10)).alias("noise"), F.avg(F.when(~quiet, F.pow("rms", F.lit(2)))).alias("signal"),
    )
    snr = F.when((F.col("top") < 1e-10) | F.col("signal").isNull(), -60.0).otherwise(F.greatest(F.lit(-60.0), F.least(F.lit(100.0), 10 * F.log10(F.col("signal") / F.col("noise")))))
    return met.select(key, F.when(F.col("rms") < 1e-10, -100.0).otherwise(20 * F.log10("rms")).alias("rms_db"), snr.alias("snr_db"), "clipping_ratio")
