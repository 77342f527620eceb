"""Audio frames: flatness, loudness, levelling, mixing, speech from frame scores, bloopers."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import EMOTIONS
from .intervals import merge_intervals, nonspeech_spans


@F.pandas_udf(T.DoubleType())
def _flatness(samples: pd.Series) -> pd.Series:
    def one(x):
        spectrum = np.maximum(np.abs(np.fft.rfft(np.asarray(x, float)[:2048], n=2048)), 1e-10)
        return float(np.clip(np.exp(np.log(spectrum).mean()) / spectrum.mean(), 0, 1))

    return pd.Series([one(x) for x in samples], dtype=float)


def spectral_flatness(frames: DataFrame, key: str = "recording_id", order: str = "frame_no", size: int = 2048) -> DataFrame:
    """Geometric by arithmetic mean of the spectrum of a recording's first samples; only the frames that hold them are gathered."""
    before = F.coalesce(F.sum(F.size("samples")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = frames.withColumn("_before", before).where(F.col("_before") < size)
    lists = head.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "samples"))).alias("_f"))
    return lists.select(key, _flatness(F.flatten(F.transform("_f", lambda f: F.transform(f["samples"], lambda v: v.cast("double"))))).alias("spectral_flatness"))


def audio_metrics(levels: DataFrame, flatness: DataFrame, meta: DataFrame, key: str = "recording_id") -> DataFrame:
    """One row a recording: levels and flatness, rounded as in reports, with rate, channels and seconds."""
    rows = levels.join(flatness, key).join(meta, key)
    places = {"snr_db": 2, "rms_db": 2, "spectral_flatness": 4, "clipping_ratio": 6, "duration_seconds": 3}
    return rows.select(key, *[F.round(c, n).alias(c) for c, n in places.items()], "sample_rate", "num_channels")


def _k_response(rate: int) -> np.ndarray:
    """A second of the impulse response of the two filters of BS.1770 at any rate, from their analogue parameters."""
    x = np.zeros(rate)
    x[0] = 1.0
    for gain, q, f, high in ((3.99984385397, 0.7071752369554193, 1681.9744509555319, False), (0.0, 0.5003270373253953, 38.13547087613982, True)):
        k = np.tan(np.pi * f / rate)
        top, mid = 10 ** (gain / 20), 10 ** (gain / 20 * 0.499666774155)
        a0 = 1 + k / q + k * k
        b = (1.0, -2.0, 1.0) if high else ((top + mid * k / q + k * k) / a0, 2 * (k * k - top) / a0, (top - mid * k / q + k * k) / a0)
        a = (2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)
        y, x1, x2, y1, y2 = np.empty(rate), 0.0, 0.0, 0.0, 0.0
        for i, v in enumerate(x.tolist()):
            out = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
            x2, x1, y2, y1 = x1, v, y1, out
            y[i] = out
        x = y
    return x


def _k_weighted(x: np.ndarray, rate: int) -> np.ndarray:
    """x through the filters, block by block in the frequency domain; what the response does after a second is under 1e-9."""
    h, step = _k_response(rate), 4 * rate
    size = 1 << (step + rate).bit_length()
    spectrum, out = np.fft.rfft(h, size), np.zeros(len(x) + size)
    for i in range(0, len(x), step):
        out[i : i + size] += np.fft.irfft(np.fft.rfft(x[i : i + step], size) * spectrum, size)
    return out[: len(x)]


def loudness_blocks(frames: DataFrame, rate: int, key: str = "recording_id", order: str = "frame_no", seconds: float = 30.0) -> DataFrame:
    """key, power: mean square of K-weighted blocks of 400 ms, a quarter apart.

    The response of the filters is a second long, so a stretch of a recording needs only the second before it, and the
    rest of its last block behind it. Frames go to each stretch of about `seconds` that needs them, and a task filters one."""
    kind = frames.schema[key].dataType.simpleString()
    size, hop = int(0.4 * rate), int(0.1 * rate)
    stretch = max(1, round(seconds * rate / hop)) * hop

    def blocks(rows):
        rows = rows.sort_by("_at")
        first, k = rows["_at"][0].as_py(), rows["_k"][0].as_py()
        x = rows["samples"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        sq = np.concatenate(([0.0], np.cumsum(_k_weighted(x, rate) ** 2)))
        at = np.arange(k * stretch, min((k + 1) * stretch, first + len(x) - size + 1), hop) - first
        return pa.table({key: rows[key].take(np.zeros(len(at), np.int64)), "power": (sq[at + size] - sq[at]) / size})

    # Places come from sizes alone, so that no recording's samples are sorted in one task.
    sizes = frames.select(key, order, F.size("samples").cast("long").alias("_n"))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(w), F.lit(0))).where("_n > 0")
    rows = frames.select(key, order, "samples").join(places, [key, order])
    needed = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - size) / stretch)), F.floor((F.col("_at") + F.col("_n") + rate) / stretch))
    return rows.withColumn("_k", F.explode(needed)).select(key, "_at", "_k", "samples").groupBy(key, "_k").applyInArrow(blocks, f"{key} {kind}, power double")


def integrated_loudness(blocks: DataFrame, key: str = "recording_id") -> DataFrame:
    """Gated loudness: blocks of -70 LUFS or more, then those within 10 LU of their mean; null where none is left."""
    lufs = lambda c: F.lit(-0.691) + 10 * F.log10(c)
    loud = blocks.where(F.col("power") > 0).where(lufs(F.col("power")) > -70)
    mean = loud.groupBy(key).agg(F.avg("power").alias("_mean"))
    kept = loud.join(mean, key).where(lufs(F.col("power")) > lufs(F.col("_mean")) - 10).groupBy(key).agg(lufs(F.avg("power")).alias("lufs"))
    return blocks.select(key).distinct().join(kept, key, "left")


def gain_envelope(frames: DataFrame, key: str = "recording_id", order: str = "frame_no", half: int = 7, most: float = 10.0, peak: float = 0.95) -> DataFrame:
    """frames with gain: peak by the frame's largest sample, at most `most`, smoothed by a Gaussian over 2 half + 1 frames."""
    top = F.aggregate("samples", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double"))))
    raw = F.least(F.coalesce(F.try_divide(F.lit(peak), top), F.lit(most)), F.lit(most))
    rows = frames.withColumn("_raw", raw)
    w = Window.partitionBy(key).orderBy(order)
    total, weight = F.lit(0.0), F.lit(0.0)
    for d in range(-half, half + 1):
        g = float(np.exp(-0.5 * (2.5 * d / max(1, half)) ** 2))
        near = F.lead("_raw", d).over(w) if d > 0 else F.lag("_raw", -d).over(w) if d else F.col("_raw")
        total, weight = total + F.coalesce(near * g, F.lit(0.0)), weight + F.when(near.isNotNull(), g).otherwise(0.0)
    return rows.withColumn("gain", total / weight).drop("_raw")


def apply_gain(samples, gain) -> Column:
    return F.transform(samples, lambda v: v.cast("double") * gain)


def peak_normalize(frames: DataFrame, key: str = "recording_id", level: float = 0.9) -> DataFrame:
    """Samples by the recording's largest, to `level`."""
    top = frames.groupBy(key).agg(F.max(F.aggregate("samples", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double"))))).alias("_top"))
    return frames.join(top, key).withColumn("samples", F.transform("samples", lambda v: v.cast("double") / (F.col("_top") + 1e-9) * level)).drop("_top")


def mix_bed(speech: DataFrame, bed: DataFrame, key: str = "recording_id", order: str = "frame_no", volume: float = 0.35) -> DataFrame:
    """Frames of speech with volume times the bed, which starts anew when it ends. A recording without a bed stays as it is."""
    n = bed.groupBy(key).agg(F.count("*").alias("_n"))
    rows = speech.join(n, key, "left").withColumn("_at", F.expr(f"try_mod({order}, _n)"))
    rows = rows.join(bed.select(key, F.col(order).alias("_at"), F.col("samples").alias("_bed")), [key, "_at"], "left")
    mixed = F.transform("samples", lambda v, i: v.cast("double") + F.coalesce(F.get("_bed", i).cast("double"), F.lit(0.0)) * volume)
    return rows.withColumn("samples", mixed).drop("_at", "_n", "_bed")


def frames_to_speech(frames: DataFrame, key: str = "recording_id", threshold: float = 0.5, min_speech: float = 0.25, min_silence: float = 0.5, pad: float = 0.03, most: float = 3600.0) -> DataFrame:
    """Spans of speech from frames (start, end, prob): gaps under min_silence join, spans under min_speech go, the rest is padded and cut at `most`."""
    loud = frames.where(F.col("prob") >= threshold).select(key, "start", "end")
    kept = merge_intervals(loud, min_silence, key).where(F.col("end") - F.col("start") >= min_speech)
    padded = kept.select(key, F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    pieces = padded.withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil((F.col("end") - F.col("start")) / most).cast("int") - 1)))
    return pieces.select(key, F.round(F.col("start") + F.col("_k") * most, 3).alias("start"), F.round(F.least("end", F.col("start") + (F.col("_k") + 1) * most), 3).alias("end"))


def samples_to_seconds(spans: DataFrame, rate: int, key: str = "recording_id") -> DataFrame:
    """Spans in samples as seconds, three places, in order within a recording."""
    rows = spans.withColumns({c: F.round(F.col(c) / rate, 3) for c in ("start", "end")})
    return rows.repartition(key).sortWithinPartitions(key, "start", "end")


def sample_times(spans: DataFrame, per_second: float = 5.0, most: int = 40) -> DataFrame:
    """Times to look at each span: evenly from its start to its end, two at least."""
    n = F.greatest(F.lit(2), F.least(F.lit(most), F.floor((F.col("end") - F.col("start")) * per_second).cast("int")))
    each = spans.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    return each.withColumn("t", F.col("start") + F.col("_k") * (F.col("end") - F.col("start")) / (F.col("_n") - 1)).drop("_n", "_k")


def lip_motion(crops: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """keys, lip_motion: mean change from crop to crop; null for under two."""
    before = F.lag("roi").over(Window.partitionBy(*keys).orderBy(order))
    change = F.aggregate(F.zip_with("roi", before, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size("roi")
    return crops.withColumn("_c", F.when(before.isNotNull(), change)).groupBy(*keys).agg(F.avg("_c").alias("lip_motion"))


def lip_label(motion, threshold: float = 0.04) -> Column:
    return F.when(motion.isNull(), "no_face").when(motion > threshold, "lips_moving").otherwise("silent")


def detect_bloopers(spans: DataFrame, recordings: DataFrame, crops: DataFrame | None = None, key: str = "recording_id", min_dur: float = 0.8, pad: float = 0.1, gap: float = 0.3) -> DataFrame:
    """Non-speech spans with index, duration and lip label; crops (key, start, t, roi) are those of a span's mouth."""
    rows = nonspeech_spans(spans, recordings, min_dur, pad, gap, key)
    rows = rows.withColumns({"index": F.row_number().over(Window.partitionBy(key).orderBy("start", "end")) - 1, "duration": F.round(F.col("end") - F.col("start"), 3)})
    rows = rows.join(lip_motion(crops, [key, "start"]), [key, "start"], "left") if crops is not None else rows.withColumn("lip_motion", F.lit(None).cast("double"))
    return rows.withColumn("label", lip_label(F.col("lip_motion")))


def processing_report(metrics: DataFrame, decisions: DataFrame, gains: DataFrame, vad: DataFrame, key: str = "recording_id") -> DataFrame:
    """One nested row a recording; a part that a recording lacks is null."""
    part = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    out = part(metrics, "metrics")
    for df, name in ((decisions, "denoise"), (gains, "normalization"), (vad, "vad_summary")):
        out = out.join(part(df, name), key, "left")
    return out


def emotion_va(scores: DataFrame, key: str, label: str = "label", p: str = "p", order: str | None = None) -> DataFrame:
    """key, valence, arousal (sums of p times the point of its emotion; unknown ones stand at 0, 0), dominant (of the largest p, the first by order), scores (a map of p, three places)."""
    points = scores.sparkSession.createDataFrame([(e, *va) for e, va in EMOTIONS.items()], "_label string, _v double, _a double")
    name, share = F.lower(label), F.col(p).cast("double")
    rows = scores.select(key, name.alias("_label"), share.alias("_p"), F.col(order or label).alias("_o")).join(F.broadcast(points), "_label", "left").fillna(0.0, ["_v", "_a"])
    each = F.array_sort(F.collect_list(F.struct((-F.col("_p")).alias("k"), F.col("_o").alias("o"), F.col("_label").alias("label"), F.round("_p", 3).alias("p"))))  # an emotion a row
    found = rows.groupBy(key).agg(F.sum(F.col("_p") * F.col("_v")).alias("valence"), F.sum(F.col("_p") * F.col("_a")).alias("arousal"), each.alias("_e"))
    return found.select(key, "valence", "arousal", F.col("_e")[0]["label"].alias("dominant"), F.map_from_entries(F.transform("_e", lambda e: F.struct(e["label"], e["p"]))).alias("scores"))


def denoise_frames(frames: DataFrame, transform=None) -> DataFrame:
    """frames through transform (pandas frames to pandas frames of one schema), with executed; without one they pass as they are."""
    if transform is None:
        return frames.withColumn("executed", F.lit(False))
    return frames.mapInPandas(transform, frames.schema).withColumn("executed", F.lit(True))
