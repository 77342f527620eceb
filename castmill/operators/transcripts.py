"""Transcript rows: segments, sanitizing, scenes, rankings, caption groups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip01, cosine, let, running_sum
from ..functions.text import ends_sentence, est_seconds, lines, starts_upper, word_count, words
from .folds import window_numbers


def timed_lines(docs: DataFrame, min_words: int = 4) -> DataFrame:
    """doc_id, segments: an array of (pos, text, start, end), the lines of each text, timed by their word counts.

    A text's lines are timed within its row, so nothing is shuffled for them."""
    rows = docs.select("doc_id", lines("text", min_words).alias("_l")).withColumn("_s", F.transform("_l", lambda t: est_seconds(word_count(t))))
    rows = rows.withColumn("_e", running_sum(F.col("_s")))
    each = lambda t, i: F.struct(i.alias("pos"), t.alias("text"), (F.get("_e", i) - F.get("_s", i)).alias("start"), F.get("_e", i).alias("end"))
    return rows.select("doc_id", F.transform("_l", each).alias("segments"))


def document_lines(docs: DataFrame, min_words: int = 4) -> DataFrame:
    """doc_id, sentences: an array of (pos, text), the lines of each text, one row a doc_id.

    Where no doc_id repeats, which the ids alone tell, lines stay in their document's row; else those of one id are brought together."""
    rows = docs.select("doc_id", F.transform(lines("text", min_words), lambda t, i: F.struct(i.cast("long").alias("pos"), t.alias("text"))).alias("sentences"))
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("sentences"))).alias("sentences"))


def exploded(rows: DataFrame, columns: list, array, present: str) -> DataFrame:
    """columns beside the fields of each struct of array. The outer form keeps a test for rows, and with it all that makes the array, out of the filters."""
    return rows.select(*columns, F.inline_outer(array)).where(F.col(present).isNotNull())


def segments(docs: DataFrame, min_words: int = 4) -> DataFrame:
    """doc_id, pos, text, start, end: lines of each text, timed by their word counts."""
    return exploded(timed_lines(docs, min_words), ["doc_id"], "segments", "pos")


def sanitize(segs: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Every row with its reject reason, null for kept ones. Passes in order, each on what the one before kept."""
    ok = F.when((F.trim("text") == "") | (F.col("end") - F.col("start") < 0.01), "empty_or_zero_duration")
    # What is asked of the text is asked here, so that it needn't be shuffled where it isn't wanted.
    rows = segs.withColumns({"reason": ok, "_loop": F.col("text").rlike(r"(?iu)(.{1,4})\1{3,}")})
    order = Window.partitionBy(key, "live").orderBy("id")
    rows = rows.withColumn("live", F.col("reason").isNull()).withColumn("new", F.coalesce((F.col("start") != F.lag("start").over(order)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(order))
    run = Window.partitionBy(key, "live", "run")
    twin = F.col("live") & (F.count("*").over(run) >= 5) & (F.row_number().over(run.orderBy("id")) > 1)
    rows = rows.withColumn("reason", F.when(twin, "duplicate_timestamp_run").otherwise(F.col("reason")))
    loop = F.col("reason").isNull() & F.col("_loop")
    rows = rows.withColumn("reason", F.when(loop, "char_repetition_loop").otherwise(F.col("reason"))).drop("live", "new", "run", "_loop")
    # Anchors depend on the windows before them, but a gap of a second closes any window: so only runs without such a gap are folded.
    live = rows.where("reason is null")
    by = Window.partitionBy(key).orderBy("id")
    gap = F.coalesce((F.col("start") - F.lag("start").over(by) >= 1).cast("int"), F.lit(0))
    live = live.select(key, "id", "start", gap.alias("gap")).withColumn("run", F.sum("gap").over(by))
    live = live.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("id", "start"))).alias("s")).where(F.size("s") > 8)
    live = live.withColumn("w", window_numbers(F.col("s.start")))
    each = live.select(key, "run", F.inline(F.arrays_zip("s", "w"))).select(key, "run", "s.id", F.col("w").alias("window"))
    own = Window.partitionBy(key, "run", "window")
    dense = each.withColumns({"n": F.count("*").over(own), "first": F.min("id").over(own)}).where("n > 8 and id > first").select(key, "id", F.lit("density_explosion").alias("dense"))
    return rows.join(dense, [key, "id"], "left").withColumn("reason", F.coalesce("reason", "dense")).drop("dense")


def score_against_summary(rows: DataFrame, vector: str, summary: str) -> DataFrame:
    """relevancy: cosine of each line to its summary vector, within 0..1, four places."""
    return rows.withColumn("relevancy", F.round(clip01(cosine(F.col(vector), F.col(summary))), 4))


def rank_relevant(rows: DataFrame, key: str, order: str, k: int = 5) -> DataFrame:
    """Up to k lines by relevancy."""
    return top_k(rows, key, "relevancy", order, k)


def rank_viral(rows: DataFrame, key: str, order: str, k: int = 5) -> DataFrame:
    """Up to k lines that the detector calls viral, by viral_score."""
    return top_k(rows.where("viral_label = 1"), key, "viral_score", order, k)


def rank_three(rows: DataFrame, key: str, order: str, k: int = 5, alpha: float = 0.5) -> DataFrame:
    """key, list, rank, order, score: k lines each by relevancy, virality, and both combined; texts don't travel."""
    rows = rows.select(key, order, "relevancy", "virality", F.round(alpha * F.col("relevancy") + (1 - alpha) * F.col("virality"), 5).alias("combined"))
    pairs = F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("score")) for c in ("relevancy", "virality", "combined")])
    each = rows.select(key, order, F.inline(pairs)).withColumn("_key", F.struct(key, "list"))
    return top_k(each, "_key", "score", order, k).select(key, "list", F.col("rank").cast("long").alias("rank"), order, "score")


def adjacent_similarity(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("sim", cosine(F.col(vector), F.lead(vector).over(w)))


def scene_groups(rows: DataFrame, key: str, order: str, guard: bool = True) -> DataFrame:
    """scene: breaks after rows whose sim is under mean - std / 2 and, with the guard, at sentence bounds."""
    own, w = Window.partitionBy(key), Window.partitionBy(key).orderBy(order)
    low = F.col("sim") < F.avg("sim").over(own) - 0.5 * F.stddev_pop("sim").over(own)
    cut = low & ends_sentence("text") & starts_upper(F.lead("text").over(w)) if guard else low
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    return rows.withColumn("scene", F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_cut")


def build_scenes(rows: DataFrame, key: str, order: str, least: float = 10.0) -> DataFrame:
    """One row per scene of at least `least` seconds, texts joined in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), " ")
    scenes = rows.groupBy(key, "scene").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_lines"), text.alias("text"))
    return scenes.where(F.col("end") - F.col("start") >= least)


def top_k(rows: DataFrame, key: str, score: str, order: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, k))


def even_word_times(rows: DataFrame) -> DataFrame:
    """Words of a segment in equal slices of its time."""
    rows = rows.withColumn("_w", words("text")).withColumn("_n", F.size("_w"))
    each = rows.select("*", F.posexplode_outer("_w").alias("word_pos", "word")).where(F.col("word_pos").isNotNull())
    step = (F.col("end") - F.col("start")) / F.col("_n")
    return each.withColumns({"word_start": F.col("start") + F.col("word_pos") * step, "word_end": F.col("start") + (F.col("word_pos") + 1) * step}).drop("_w", "_n")


def even_words(text, start, end, each) -> Column:
    """The words of a segment as an array of each(word, word_pos, start, end), in equal slices of its time: even_word_times within a row."""
    slices = lambda w: let((end - start) / F.size(w), lambda step: F.transform(w, lambda x, k: each(x, k, start + k * step, start + (k + 1) * step)))
    return let(words(text), lambda w: F.when(F.size(w) > 0, slices(w)))


def caption_groups(rows: DataFrame, size: int = 3) -> DataFrame:
    return rows.withColumn("caption", F.floor(F.col("word_pos") / size))


def even_captions(rows: DataFrame, keys: list[str], size: int = 3) -> DataFrame:
    """keys, caption, start, end, n_words: groups of `size` words of each segment whose words have even times, worked out within the segment."""
    n = F.col("_n")
    step = (F.col("end") - F.col("start")) / n
    after = lambda c: F.least((c + 1) * size, n)
    each = lambda c: F.struct(c.cast("long").alias("caption"), (F.col("start") + c * size * step).alias("start"), (F.col("start") + after(c) * step).alias("end"), (after(c) - c * size).cast("long").alias("n_words"))
    found = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), each))
    return exploded(rows.withColumn("_n", word_count("text")), keys, found, "caption")
