"""Clips: manifests, composition times, music beds, sidecars, totals."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import est_seconds, safe_clip_name, word_count
from ..sources.files import stem
from .captions import build_cues, cues_within, render_srt, srt_of
from .intervals import composition_offsets, rebased, words_in_span

VOLUME = 0.35
#: Seconds of the finest buckets, and of the longest span that is told from one without end.
FINEST, LONGEST = 0.125, 1e9


def clip_file_name(rank, start, text) -> Column:
    return F.concat(F.format_string("clip_%02d_%.1fs_", rank, start), safe_clip_name(text), F.lit(".mp4"))


def blooper_file_name(index, start, end) -> Column:
    return F.format_string("blooper_%03d_%.1f-%.1f.mp4", index, start, end)


def exportable(lines: DataFrame) -> DataFrame:
    """Lines with both times."""
    return lines.where("start is not null and end is not null")


def present_rows(lines: DataFrame) -> DataFrame:
    """Scores to four places, times to three, the label as a flag."""
    rounded = {c: F.round(c, n) for c, n in (("relevance", 4), ("viral_score", 4), ("viral_prob", 4), ("start", 3), ("end", 3)) if c in lines.columns}
    return lines.withColumns(rounded | {"viral_label": F.col("viral_label").cast("boolean")})


def clip_seconds(start="start", end="end", text="text") -> Column:
    """Length of a clip, or an estimate by its words where it has no valid times."""
    timed = F.coalesce(F.col(end) > F.col(start), F.lit(False))
    return F.when(timed, F.col(end) - F.col(start)).otherwise(est_seconds(word_count(text)))


def timeline_totals(clips: DataFrame, bloopers: DataFrame, key: str) -> DataFrame:
    """key, clip_s, blooper_s, timeline_s (the longer), untimed (clips without valid times)."""
    a = clips.groupBy(key).agg(F.sum(clip_seconds()).alias("clip_s"), F.count_if(~F.coalesce(F.col("end") > F.col("start"), F.lit(False))).alias("untimed"))
    b = bloopers.groupBy(key).agg(F.sum("duration").alias("blooper_s"))
    both = a.join(b, key, "full_outer").fillna(0.0, ["clip_s", "blooper_s"]).fillna(0, ["untimed"])
    return both.select(key, "clip_s", "blooper_s", F.greatest("clip_s", "blooper_s").alias("timeline_s"), "untimed")


def run_totals(bloopers: DataFrame, recordings: DataFrame, key: str) -> DataFrame:
    """One row a recording, also one without bloopers: its duration and their number."""
    n = bloopers.groupBy(key).agg(F.count("*").alias("n"))
    return recordings.join(n, key, "left").select(key, F.round("total_dur", 3).alias("duration_s"), F.coalesce("n", F.lit(0)).alias("count"))


def merge_items(items: DataFrame, key: str) -> DataFrame:
    """Marked items (kind, mark, pos): a merge holds one kind, that of the latest mark; in order of pos, numbered from 0."""
    latest = items.groupBy(key).agg(F.max_by("kind", "mark").alias("kind"))
    return items.join(latest, [key, "kind"]).withColumn("item", F.row_number().over(Window.partitionBy(key).orderBy("pos", "mark")) - 1)


def clips_with_beds(clips: DataFrame, beds: DataFrame, keys: list[str]) -> DataFrame:
    """clips with their bed's volume, null without a bed."""
    return clips.join(beds.select(*keys, F.coalesce("volume", F.lit(VOLUME)).alias("volume")), keys, "left")


def bed_schedule(clips: DataFrame, beds: DataFrame, key: str, order: str) -> DataFrame:
    """Half-open times of each clip's bed on the composition; clips without a bed have none."""
    placed = composition_offsets(clips.withColumn("_s", F.col("end") - F.col("start")), key, order, "_s")
    met = placed.join(beds.select(key, order, F.coalesce("volume", F.lit(VOLUME)).alias("volume")), [key, order])
    return met.select(key, order, F.col("offset").alias("bed_start"), (F.col("offset") + F.col("_s")).alias("bed_end"), "volume")


def active_at(times: DataFrame, spans: DataFrame, key: str, closed: bool = True) -> DataFrame:
    """For each time the first span (by pos) that holds it, null for none; closed spans hold their end too. into: time within the span, modulo bed_dur where there is one.

    A span lies in the two or three buckets it touches of the level whose buckets are as long as it, by powers of two; a time
    looks into one bucket of each level that its key's spans have. So spans of any length meet only times near them, and no
    key's rows meet as a whole. Spans that end before they start hold nothing."""
    size = lambda level: FINEST * F.pow(F.lit(2.0), level)
    bucket = lambda c, level: F.floor(c / size(level))
    value = [c for c in spans.columns if c != key]
    length = F.least(F.col("end"), F.col("start") + LONGEST) - F.col("start")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(FINEST)) / FINEST)).cast("int"))
    dealt = spans.where(F.col("end") >= F.col("start")).withColumn("_level", level)
    levels = dealt.select(key, "_level").distinct()
    dealt = dealt.withColumn("_b", F.explode(F.sequence(bucket(F.col("start"), F.col("_level")), bucket(F.least(F.col("end"), F.col("start") + LONGEST), F.col("_level")))))
    asked = times.where("t is not null").select(key, "t").distinct().join(levels, key).withColumn("_b", bucket(F.col("t"), F.col("_level")))
    after = F.col("t") <= F.col("end") if closed else F.col("t") < F.col("end")
    met = asked.join(dealt, [key, "_level", "_b"]).where((F.col("start") <= F.col("t")) & after)
    first = met.groupBy(key, "t").agg(F.min_by(F.struct(*value), "pos").alias("_s")).select(key, "t", *[F.col(f"_s.{c}").alias(c) for c in value])
    into = F.col("t") - F.col("start")
    if "bed_dur" in value:
        into = F.pmod(into, F.greatest("bed_dur", F.lit(0.01)))
    return times.join(first, [key, "t"], "left").withColumn("into", into)


def clips_with_sidecars(clips: DataFrame, sidecars: DataFrame, key: str = "path") -> DataFrame:
    """clips with the subtitle document of their path, null for none."""
    return clips.join(sidecars.select(key, "srt"), key, "left")


def sidecar_counts(clips: DataFrame, source: str) -> DataFrame:
    return clips.groupBy(source).agg(F.count("*").alias("count"), F.count("srt").alias("srt_count"))


def drop_words_of_dropped(words: DataFrame, rejects: DataFrame, keys: list[str]) -> DataFrame:
    """Words whose segment was rejected go."""
    return words.join(rejects.select(*keys).distinct(), keys, "left_anti")


def union_rejects(*passes: DataFrame) -> DataFrame:
    """Rejects of several passes, each with its reason."""
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def offset_chunk_times(local: DataFrame, chunks: DataFrame, keys: list[str], rate: int = 16_000, least: int = 160) -> DataFrame:
    """Segments of chunks in the recording's time; chunks under `least` samples go. Times to three places, text stripped."""
    samples = F.floor(F.col("chunk_end") * rate) - F.floor(F.col("chunk_start") * rate)
    rows = local.join(chunks.where(samples >= least), keys)
    at = lambda c: F.round(F.col("chunk_start") + F.col(c), 3)
    return rows.withColumns({"start": at("start"), "end": at("end"), "text": F.trim("text")}).drop("chunk_start", "chunk_end")


def remap_to_composition(words: DataFrame, clips: DataFrame, key: str, order: str) -> DataFrame:
    """Words that overlap a clip, in the time of all clips one after the other."""
    placed = composition_offsets(clips.withColumn("_s", F.col("end") - F.col("start")), key, order, "_s")
    spans = placed.select(key, order, F.col("start").alias("span_start"), F.col("end").alias("span_end"), "offset")
    met = words_in_span(words, spans, key)
    return met.withColumns({c: F.round(F.col("offset") + F.col(c) - F.col("span_start"), 6) for c in ("start", "end")}).drop("span_start", "span_end", "offset")


def words_met(words, start, end, longest: float = 604_800.0) -> Column:
    """Those of an array of words (start, end, ..) that overlap a span, by start, end and word: words_in_span within a row."""
    valid = lambda a, b: (b - a >= 0) & (b - a <= longest)
    return F.array_sort(F.filter(words, lambda w: valid(w["start"], w["end"]) & valid(start, end) & (w["start"] < end) & (w["end"] > start)))


def words_rebased(met, start, end) -> Column:
    """Of an array of words that met a span those at least half visible (or without length), cut to it and in its time, in order: rebased within a row."""
    a, b = lambda w: F.greatest(w["start"], start), lambda w: F.least(w["end"], end)
    seen = F.filter(met, lambda w: (w["end"] <= w["start"]) | ((b(w) - a(w)) / (w["end"] - w["start"]) >= 0.5))
    cut = lambda w: F.struct(F.round(a(w) - start, 3).alias("start"), F.round(b(w) - start, 3).alias("end"), w["word"].alias("word"), w["probability"].alias("probability"))
    return F.array_sort(F.transform(seen, cut))


def clip_manifest(clips: DataFrame, words: DataFrame | Column, key: str, order: str, source: str | None = None, category: str = "combined") -> DataFrame:
    """One nested row a clip of positive length: rank, times, duration, file, name, category, volume, words and srt.

    words (key, start, end, word, and probability where there is one) meet the clips once: those that overlap a clip stand in
    it in the recording's time, and its cues are packed from them in the clip's own time; srt is null without cues. name is
    the one asked for (column name), else the stem of the source's path, else the key; category and volume are the clip's
    own (columns category, music_volume) or the default. Where all words that may meet a clip stand in its own row, words is a
    column of clips instead, an array of (start, end, word, probability): then only the ranks are shuffled for, with the
    columns that make the words."""
    own = lambda c, default: F.coalesce(F.col(c), default) if c in clips.columns else default
    base = stem(source) if source else F.col(key).cast("string")
    spans = clips.where(F.col("end") > F.col("start")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    if isinstance(words, Column):
        columns = spans.columns
        met = spans.withColumn("_met", words_met(words, F.col("start"), F.col("end")))
        made = cues_within(met.withColumn("_seen", words_rebased("_met", F.col("start"), F.col("end"))), [*columns, "_met"], "_seen")
        listed = F.transform("_met", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["word"].alias("word")))
        rows = made.select(*columns, listed.alias("words"), srt_of(F.col("cues")).alias("srt"))
    else:
        given = F.col("probability") if "probability" in words.columns else F.lit(None).cast("double")
        ids = spans.select(key, F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.struct(key, order).alias("_clip"))
        met = words_in_span(words.select(key, "start", "end", "word", given.alias("probability")), ids, key)
        nested = met.groupBy("_clip").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word"))).alias("words"))
        cues = build_cues(rebased(met).select("_clip", F.struct("start", "end", "word").alias("_o"), "word", "start", "end", "probability"), "_clip", "_o")
        parts = nested.join(render_srt(cues, "_clip").withColumnRenamed("document", "srt"), "_clip", "left")
        rows = spans.withColumn("_clip", F.struct(key, order)).join(parts, "_clip", "left")
    named = F.coalesce(F.nullif(F.trim(own("name", F.lit(""))), F.lit("")), base)
    return rows.select(
        key, order, "rank", "start", "end", F.round(F.col("end") - F.col("start"), 2).alias("duration"), clip_file_name(F.col("rank"), F.col("start"), F.col("text")).alias("file"),
        named.alias("name"), own("category", F.lit(category)).alias("category"), own("music_volume", F.lit(VOLUME)).alias("volume"),
        F.coalesce("words", F.array().cast("array<struct<start:double,end:double,word:string>>")).alias("words"), "srt",
    )


def merge_manifest(clips: DataFrame, key: str, order: str, source: str = "source") -> DataFrame:
    """One row a merge: name, number of spans, total seconds, and the spans in order with their offsets."""
    spans = composition_offsets(clips.where(F.col("end") > F.col("start")).withColumn("_s", F.col("end") - F.col("start")), key, order, "_s")
    rows = spans.groupBy(key).agg(F.concat(F.first(source), F.lit("_merged")).alias("name"), F.count("*").alias("clip_count"), F.round(F.sum("_s"), 3).alias("total"), F.array_sort(F.collect_list(F.struct(order, "start", "end", "offset"))).alias("spans"))
    return rows
