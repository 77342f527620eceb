import json

import numpy as np
from pyspark.sql import functions as F

from castmill.operators import pairs, titles
from castmill.plans.queries import snapshots
from castmill.sources import files
from castmill.streaming import live


def test_json_readers(spark, tmp_path):
    (tmp_path / "a_transcript_segments.json").write_text(json.dumps([{"id": 0, "start": 0, "end": 1.5, "text": "hi"}]))
    assert [tuple(r) for r in files.read_segments(spark, f"{tmp_path}/a_*.json").collect()] == [("a", 0, 0.0, 1.5, "hi")]
    (tmp_path / "v.json").write_text(json.dumps({"speech_segments": [{"start": 1, "end": 2}, {"start": 3, "end": 4}]}))
    assert [tuple(r) for r in files.read_vad(spark, f"{tmp_path}/v.json").orderBy("start").collect()] == [("v", 1.0, 2.0), ("v", 3.0, 4.0)]
    clip = {"start": 0.0, "end": 1.0, "text": "x", "combined_score": 0.5}
    (tmp_path / "r.json").write_text(json.dumps({"rankings": {"by_combined": [clip, clip], "by_relevancy": [], "by_virality": [clip]}}))
    assert sorted((r["list"], r["rank"]) for r in files.read_rankings(spark, f"{tmp_path}/r.json").collect()) == [("combined", 1), ("combined", 2), ("virality", 1)]
    (tmp_path / "s.csv").write_text('id,article,highlights\n1,"two\nlines, ""quoted""",short\n')
    assert files.read_summary_csv(spark, f"{tmp_path}/s.csv").first()["article"] == 'two\nlines, "quoted"'


def test_media(spark, tmp_path):
    for n in ("a.MP4", "b.wav", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    found = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["reason"]) for r in files.discover_media(spark, str(tmp_path)).collect()}
    assert found == {"a.MP4": ("video", None), "b.wav": ("audio", None), "c.txt": (None, "unsupported_extension:txt")}


def test_wav_round_trip(spark, tmp_path):
    x = (0.5 * np.sin(np.arange(1000) / 7)).astype(float)
    df = spark.createDataFrame([(x.tolist(), 16000)], "x array<double>, rate int").select(files.encode_wav("x", "rate").alias("w"))
    (tmp_path / "t.wav").write_bytes(bytes(df.first()["w"]))
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    rows = files.read_pcm(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert [(r["recording_id"], r["reason"]) for r in rows if r["reason"]] == [("bad", "not_wav")]
    got = np.concatenate([r["samples"] for r in rows if not r["reason"]])
    assert len(got) == 960 and np.abs(got - x[:960]).max() < 1e-4


def test_errors(spark):
    df = spark.createDataFrame([("k", "the cat sat on the mat", "the cat sit on mat"), ("m", "a b", "a b c"), ("n", "", "")], "k string, reference string, hypothesis string")
    rates = pairs.error_rates(df)
    got = {r["k"]: (r["substitutions"], r["deletions"], r["insertions"], r["hits"], r["wer"]) for r in rates.collect()}
    assert got == {"k": (1, 1, 0, 4, 1 / 3), "m": (0, 0, 1, 2, 0.5), "n": (0, 0, 0, 0, None)}
    assert {r["k"]: r["wer_hits"] for r in pairs.wer_report(rates, "k").collect()}["m"] == 0


def _stream(spark, df, path, parts=2):
    df.repartition(parts).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams(spark, sf_dir, tmp_path):
    rows = [(1, 0.0, 1.0), (1, 1.2, 1.0), (1, 2.5, 1.0), (2, 0.0, 1.0), (9, 9999.0, 1.0), (9, 99999.0, 1.0)]
    spans = spark.createDataFrame(rows, "recording_id int, s double, dur_s double").select("recording_id", F.timestamp_seconds("s").alias("ts"), "dur_s")
    own = _stream(spark, spans, f"{tmp_path}/in", 1)
    live.stream_merge_speech(own).writeStream.format("memory").queryName("merged").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["recording_id"], r["start"].timestamp(), r["n"]) for r in spark.table("merged").where("recording_id < 9").collect())
    assert [(k, n) for k, _, n in got] == [(1, 2), (1, 1), (2, 1)]
    many = spark.createDataFrame([(1, 0.05 * i) for i in range(9)] + [(2, 0.1 * i) for i in range(8)] + [(9, 99999.0)], "recording_id int, s double").select("recording_id", F.timestamp_seconds("s").alias("ts"))
    live.stream_density_alert(_stream(spark, many, f"{tmp_path}/in2", 1)).writeStream.format("memory").queryName("dense").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert [(r["recording_id"], r["n"]) for r in spark.table("dense").collect()] == [(1, 9)]


def test_stream_titles_equal_batch(spark, tmp_path):
    """Three loads with restarts between them, the second with replays of the first: every title as all rows at once give it, and a batch writes its own videos alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shots = titles.cast_counts(snapshots(spark, "/root/testdata/sf0.001")).withColumn("n", F.xxhash64("video_id", "country", "views", "likes", "comments", "subscribers", "published"))
    shots = shots.dropDuplicates(["n"]).withColumns({"event_id": F.col("n"), "ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.abs(F.col("n") % 600))}).cache()
    cols = ["video_id", "title", "category", "published", "views", "likes", "comments", "subscribers", "country_count"]
    parts = [shots.where("video_id <= 80"), shots.where("video_id <= 80 and n % 3 = 0").union(shots.where("video_id between 81 and 140")), shots.where("video_id > 120")]
    seen = None
    for k, part in enumerate(parts):
        stream = _stream(spark, part.drop("n"), f"{tmp_path}/in", 2)
        live.stream_dedup_titles(stream, f"{tmp_path}/out", f"{tmp_path}/c").start().awaitTermination()
        seen = part if seen is None else seen.union(part)
        found, want = live.stored_titles(spark, f"{tmp_path}/out"), titles.dedup_titles(seen.drop("n"))
        assert sorted(map(str, found.select(cols).collect())) == sorted(map(str, want.select(cols).collect())), k
    rows = spark.read.parquet(f"{tmp_path}/out")  # batches without rows, which only move the watermark, have numbers too
    last = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    assert last.agg(F.min("video_id")).first()[0] > 120
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
