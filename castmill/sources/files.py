"""Readers and writers of transcripts, rankings, media listings and sound. A reader names its schema, so nothing is inferred."""

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "id bigint, start double, end double, text string"
CLIP = "start double, end double, duration double, text string, relevancy_score double, viral_label int, viral_score double, combined_score double"

# Media kinds by extension.
VIDEO = ["mp4", "mov", "mkv", "avi", "webm"]
AUDIO = ["wav", "mp3", "m4a", "aac", "flac", "ogg"]


def stem(path: str | Column, suffix: str = "") -> Column:
    """File name without folder, extension and suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), f"{suffix}$", "")


def read_split(spark: SparkSession, path: str, name: str, score: str = "viral_score") -> DataFrame:
    return spark.read.parquet(f"{path}/split={name}").withColumn(score, F.col(score).cast("float"))


def write_splits(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").parquet(path)


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, article string, highlights string").csv(path, header=True, multiLine=True, quote='"', escape='"')


def _json_rows(spark: SparkSession, path: str, schema: str, suffix: str) -> DataFrame:
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(stem("_metadata.file_name", suffix).alias("transcript_id"), "*")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One array of segments a file; the file's name is the transcript."""
    return _json_rows(spark, path, SEGMENT, "_transcript_segments")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One array of words a file; a file without words is an error, raised when rows are read."""
    words = T.ArrayType(T.StructType([T.StructField(*f) for f in (("segment_id", T.LongType()), ("word", T.StringType()), ("start", T.DoubleType()), ("end", T.DoubleType()), ("probability", T.DoubleType()))]))
    files = spark.read.text(path, wholetext=True).select(stem("_metadata.file_name", "_transcript_words").alias("transcript_id"), F.from_json("value", words).alias("_w"))
    none = F.raise_error(F.concat(F.col("transcript_id"), F.lit(" contains no words")))
    return files.select("transcript_id", F.inline(F.when(F.size("_w") > 0, F.col("_w")).otherwise(none.cast(words))))


def read_vad(spark: SparkSession, path: str) -> DataFrame:
    """One row a speech span: recording_id, start, end."""
    docs = spark.read.schema("speech_segments array<struct<start:double,end:double>>").json(path, multiLine=True)
    return docs.select(stem("_metadata.file_name").alias("recording_id"), F.inline("speech_segments"))


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """One row a clip and list; rank from 1 in the list's order. Empty lists have no rows."""
    clips = ",".join(x.strip().replace(" ", ":") for x in CLIP.split(","))
    fields = ",".join(f"by_{k}:array<struct<{clips}>>" for k in ("combined", "relevancy", "virality"))
    docs = spark.read.schema(f"global_summary string, rankings struct<{fields}>").json(path, multiLine=True).withColumn("source_id", stem("_metadata.file_name"))
    parts = [docs.select("source_id", F.lit(k).alias("list"), F.posexplode(f"rankings.by_{k}").alias("pos", "clip")) for k in ("combined", "relevancy", "virality")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("source_id", "list", (F.col("pos") + 1).alias("rank"), "clip.*")


def read_reference_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(stem("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def discover_media(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind (video or audio), reason (null for kept files). Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin(VIDEO), "video").when(ext.isin(AUDIO), "audio")
    return found.withColumn("kind", kind).withColumn("reason", F.when(F.col("kind").isNull(), F.concat(F.lit("unsupported_extension:"), ext)))


def read_pcm(spark: SparkSession, path: str, frame_ms: int = 30, rate: int = 16000) -> DataFrame:
    """Mono frames of 16-bit WAV files: recording_id, frame_no, samples, reason. A file of another kind is one row with a reason; a short last frame goes."""
    size = rate * frame_ms // 1000

    def frames(batches):
        for b in batches:
            for name, content in zip(b["recording_id"], b["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        fault = None if w.getframerate() == rate and w.getsampwidth() == 2 else f"format:{w.getframerate()}x{w.getsampwidth() * 8}"
                        channels, raw = w.getnchannels(), b"" if fault else w.readframes(w.getnframes())
                except (wave.Error, EOFError):
                    fault, raw = "not_wav", b""
                if fault:
                    yield pd.DataFrame({"recording_id": [name], "frame_no": [None], "samples": [None], "reason": [fault]})
                    continue
                x = (np.frombuffer(raw, "<i2").reshape(-1, channels).mean(1) / 32768).astype(np.float32)
                n = len(x) // size
                yield pd.DataFrame({"recording_id": [name] * n, "frame_no": range(n), "samples": list(x[: n * size].reshape(n, size)), "reason": [None] * n})

    files = spark.read.format("binaryFile").load(path).select(stem("path").alias("recording_id"), "content")
    return files.mapInPandas(frames, "recording_id string, frame_no long, samples array<float>, reason string")


@F.pandas_udf(T.BinaryType())
def encode_wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Samples clipped to -1..1 as a mono 16-bit WAV file."""

    def one(x, r):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(int(r))
            w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    return pd.Series([one(x, r) for x, r in zip(samples, rate)])


def write_json_docs(df: DataFrame, key: str, order: str, path: str) -> None:
    """One nested document a key: its rows in order, under `rows`."""
    others = [c for c in df.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *others)))
    df.groupBy(key).agg(F.transform(rows, lambda r: r.dropFields("_o")).alias("rows")).write.json(path)


# Columns of title snapshots and their short names.
TITLE_COLUMNS = {"video_id": "video_id", "video_title": "title", "video_category_id": "category", "video_trending_country": "country", "video_view_count": "views", "video_like_count": "likes", "video_comment_count": "comments", "channel_subscriber_count": "subscribers", "video_published_at": "published"}


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """The nine named columns of title snapshots, as text under short names; no other column is read."""
    return spark.read.parquet(path).select(*[F.col(c).cast("string").alias(n) for c, n in TITLE_COLUMNS.items()])


def _ordered(*columns: str, order: str | None = None):
    """Aggregate: rows of a key as structs of these columns, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order or columns[0]).alias("_o"), *columns)))
    return F.transform(rows, lambda r: r.dropFields("_o"))


def json_documents(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """key and the nested fields of one document each.

    segments and words: their rows in time order; vad: speech segments, their seconds and share of total_dur; rankings:
    summary, scenes and the three lists (rows have list, rank and a clip's columns); bloopers: count and rows;
    report: the rows as they are, nested already."""
    by = rows.groupBy(key)
    if kind == "segments":
        return by.agg(_ordered("id", "start", "end", "text").alias("segments"))
    if kind == "words":
        rounded = rows.withColumn("probability", F.round("probability", 4))
        return rounded.groupBy(key).agg(_ordered("word", "start", "end", "probability", order="start").alias("words"))
    if kind == "vad":
        total = F.round(F.sum(F.col("end") - F.col("start")), 3)
        ratio = F.when(F.max("total_dur") > 0, F.round(F.sum(F.col("end") - F.col("start")) / F.max("total_dur"), 4)).otherwise(0.0)
        return by.agg(_ordered("start", "end").alias("speech_segments"), total.alias("total_speech_duration_seconds"), ratio.alias("speech_ratio"))
    if kind == "rankings":
        clip = [c for c in rows.columns if c not in (key, "list", "rank", "global_summary", "total_scenes")]
        lists = {n: F.array_sort(F.collect_list(F.when(F.col("list") == n, F.struct("rank", *clip)))) for n in ("relevancy", "virality", "combined")}
        each = [F.transform(v, lambda r: r.dropFields("rank")).alias(f"by_{n}") for n, v in lists.items()]
        return by.agg(F.first("global_summary").alias("global_summary"), F.first("total_scenes").alias("total_scenes"), F.struct(*each).alias("rankings"))
    if kind == "bloopers":
        return by.agg(F.count("*").alias("count"), _ordered("index", "start", "end", "duration", "lip_motion", "label").alias("bloopers"))
    if kind == "report":
        return rows
    raise ValueError(f"no such document: {kind}")


def write_documents(rows: DataFrame, kind: str, key: str, path: str) -> None:
    """The documents as JSON, one a line."""
    json_documents(rows, kind, key).write.mode("overwrite").json(path)
