"""Live spans and snapshots: sessions of speech, dense seconds, and titles kept up by batch."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.titles import COUNTS


def stream_merge_speech(spans: DataFrame, gap_s: float = 0.3, late: str = "10 minutes", key: str = "recording_id") -> DataFrame:
    """Islands of spans (ts, dur_s) whose start less the running end is under gap_s; closed by the watermark.

    A row exactly at a session's end would join it, so the gap is one microsecond less."""
    gap = F.make_interval(secs=F.greatest(F.col("dur_s") + F.lit(gap_s - 1e-6), F.lit(1e-6)).cast("decimal(18,6)"))
    session = F.session_window("ts", gap)
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("dur_s").cast("decimal(18,6)"))
    rows = spans.withColumn("end_ts", end).withWatermark("ts", late)
    return rows.groupBy(key, session.alias("session")).agg(F.min("ts").alias("start"), F.max("end_ts").alias("end"), F.count("*").alias("n")).drop("session")


def stream_density_alert(segments: DataFrame, most: int = 8, window: str = "1 second", slide: str | None = None, late: str = "10 minutes", key: str = "recording_id") -> DataFrame:
    """Windows with more than `most` segments."""
    own = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = segments.withWatermark("ts", late).groupBy(key, own.alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


TEXTS = ("title", "category", "published")


class TitleState(StatefulProcessor):
    """Keeps one row a country of the video it is keyed by; each batch hands on the whole row of the videos it touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join([*[f"{c} string, {c}_unknown boolean, {c}_views double, {c}_country string" for c in TEXTS], *[f"{c} double" for c in COUNTS]])
        self.known = handle.getMapState("known", "country string", fields)

    def handleInputRows(self, key, rows, timer):
        for frame in rows:
            for r in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                country = (r["country"] or "",)
                old = self.known.getValue(country) if self.known.containsKey(country) else None
                self.known.updateValue(country, self._newer(old, r))
        yield pd.DataFrame([self._title(key[0])])

    def _newer(self, old, r) -> tuple:
        """A country's row with one snapshot more; of equal orders the larger text counts."""
        at, out = (r["views"] is None, r["views"] or 0.0, r["country"] or ""), []
        for k, c in enumerate(TEXTS):
            had = old[4 * k : 4 * k + 4] if old is not None else (None,) * 4
            if r[c] is not None and (had[0] is None or (*at, r[c]) > (had[1], had[2] or 0.0, had[3] or "", had[0])):
                had = (r[c], at[0], r["views"], r["country"])
            out += had
        for k, c in enumerate(COUNTS):
            known = [x for x in (old[4 * len(TEXTS) + k] if old is not None else None, r[c]) if x is not None]
            out.append(max(known, default=None))
        return tuple(out)

    def _title(self, video) -> dict:
        rows = [(c[0], v) for c, v in self.known.iterator()]
        out = {"video_id": video, "country_count": sum(c != "" for c, _ in rows)}
        for k, c in enumerate(TEXTS):
            some = [v[4 * k : 4 * k + 4] for _, v in rows if v[4 * k] is not None]
            out[c] = max(some, key=lambda t: (t[1], t[2] or 0.0, t[3] or "", t[0]))[0] if some else None
        for k, c in enumerate(COUNTS):
            out[c] = max((v[4 * len(TEXTS) + k] for _, v in rows if v[4 * len(TEXTS) + k] is not None), default=None)
        return out

    def close(self) -> None:
        pass


TITLE = "video_id {}, " + ", ".join(f"{c} string" for c in TEXTS) + ", " + ", ".join(f"{c} double" for c in COUNTS) + ", country_count long"


def stream_titles(snapshots: DataFrame, ts: str = "ts", event_id: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Titles as snapshots (with event_id and ts) arrive: for each batch the whole row of each video it touched. Needs RocksDB as state store.

    Replays of an event within the watermark go; state is keyed by video, so a batch reads and writes its own videos alone."""
    kind = snapshots.schema["video_id"].dataType.simpleString()
    once = snapshots.where("video_id is not null").withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id])
    rows = once.select("video_id", "country", *TEXTS, *[F.col(c).cast("double").alias(c) for c in COUNTS])
    return rows.groupBy("video_id").transformWithStateInPandas(statefulProcessor=TitleState(), outputStructType=TITLE.format(kind), outputMode="Update", timeMode="None")


def stream_dedup_titles(snapshots: DataFrame, path: str, checkpoint: str, **options):
    """Keep titles under path: each batch writes the videos it touched to a folder of its own, also when it is run again."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream_titles(snapshots, **options).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stored_titles(spark: SparkSession, path: str) -> DataFrame:
    """Of each video the row of its latest batch."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("video_id").agg(F.max_by(F.struct(*columns), "batch").alias("t")).select("t.*")
