"""Interval algebra over spans with a recording key, as windows and aggregates."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(spans: DataFrame, gap: float = 0.3, key: str = "recording_id") -> DataFrame:
    """Islands of spans whose start less the running end is under gap."""
    w = Window.partitionBy(key).orderBy("start", "end")
    last = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") - last < gap, 0).otherwise(1)
    marked = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def complement(islands: DataFrame, recordings: DataFrame, key: str = "recording_id") -> DataFrame:
    """Gaps before, between and after islands within 0..total_dur; a recording without islands is one gap."""
    ends = recordings.select(key, F.col("total_dur").alias("start"), F.col("total_dur").alias("end"))
    w = Window.partitionBy(key).orderBy("start", "end")
    every = islands.select(key, "start", "end").unionByName(ends)
    gaps = every.select(key, F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("start"), F.col("start").alias("end"))
    return gaps.where("end > start")


def nonspeech_spans(spans: DataFrame, recordings: DataFrame, min_dur: float = 0.8, pad: float = 0.1, gap: float = 0.3, key: str = "recording_id") -> DataFrame:
    gaps = complement(merge_intervals(spans, gap, key), recordings, key)
    cut = gaps.select(key, (F.col("start") + pad).alias("start"), (F.col("end") - pad).alias("end"))
    return cut.where((F.col("end") - F.col("start")) >= min_dur).select(key, F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def words_in_span(words: DataFrame, spans: DataFrame, key: str = "recording_id", bucket: float = 60.0, longest: float = 604_800.0) -> DataFrame:
    """Open overlap of words with spans (span_start, span_end). Both sides are dealt to time buckets; a pair counts in the first bucket it shares.

    Words and spans that end before they start, or last over `longest` seconds, are invalid and meet nothing."""
    deal = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    left = words.where(F.col("end") - F.col("start") >= 0).where(F.col("end") - F.col("start") <= longest).withColumn("_b", deal("start", "end"))
    right = spans.where(F.col("span_end") - F.col("span_start") >= 0).where(F.col("span_end") - F.col("span_start") <= longest).withColumn("_b", deal("span_start", "span_end"))
    both = left.join(right, [key, "_b"]).where("start < span_end and end > span_start")
    return both.where(F.col("_b") == F.floor(F.greatest("start", "span_start") / bucket)).drop("_b")


def rebase_words(words: DataFrame, spans: DataFrame, key: str = "recording_id") -> DataFrame:
    """Words of each span in its own time; words of positive length less than half visible go."""
    return rebased(words_in_span(words, spans, key))


def rebased(met: DataFrame) -> DataFrame:
    """Words that met their spans (span_start, span_end), cut to them and in their time."""
    a, b = F.greatest("start", "span_start"), F.least("end", "span_end")
    met = met.where((F.col("end") <= F.col("start")) | ((b - a) / (F.col("end") - F.col("start")) >= 0.5))
    return met.withColumns({"start": F.round(a - F.col("span_start"), 3), "end": F.round(b - F.col("span_start"), 3)})


def composition_offsets(items: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("offset", F.coalesce(F.sum(duration).over(w), F.lit(0.0)))
