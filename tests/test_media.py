"""Scenes, cues, captions, clips and sound against hand-made rows and plain definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from castmill.functions import numeric as N
from castmill.functions import text as T
from castmill.operators import captions, clips, scenes, sound, summaries


def split_by_hand(rows, most):
    """By the rule itself: cut at the weakest boundary, the grammatical first, and go on in both parts."""
    starts, ends, loose, sims = zip(*rows)

    def go(a, b):
        if b == a or ends[b] - starts[a] <= most:
            return [(a, b)]
        i = min(range(a, b), key=lambda i: (loose[i], sims[i], i))
        return go(a, i) + go(i + 1, b)

    return go(0, len(rows) - 1)


def test_long_scenes(spark):
    draw, rows, want = random.Random(5), [], {}
    for k in range(120):
        at, own = 0.0, []
        for _ in range(draw.randint(1, 14)):
            d = float(draw.randint(1, 30))
            own.append((at, at + d, draw.random() < 0.5, draw.choice([0.1, 0.2, 0.3, 0.4])))
            at += d
        rows += [(k, i, s, e, "Some. " if not own[i][2] else "some", sim) for i, (s, e, _, sim) in enumerate(own)]
        # A boundary is grammatical where the line ends a sentence and the next starts with a capital.
        texts = ["Some." if not o[2] else "some" for o in own]
        own = [(s, e, not (texts[i].endswith(".") and i + 1 < len(texts) and texts[i + 1][0].isupper()), sim) for i, (s, e, _, sim) in enumerate(own)]
        want[k] = split_by_hand(own, 60)
    df = spark.createDataFrame(rows, "doc int, pos int, start double, end double, text string, sim double").withColumn("scene", F.lit(0).cast("long"))
    found = scenes.split_long_scenes(df, "doc", "pos").groupBy("doc", "scene").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    got = {}
    for r in found:
        got.setdefault(r["doc"], []).append((r["a"], r["b"]))
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize(("loose", "most", "want"), [((1, 1, 1), 60, [2, 2]), ((1, 1, 1), 59, [1, 1, 1, 1]), ((0, 1, 1), 60, [1, 1, 2])])
def test_scene_goldens(loose, most, want):
    rows = [(30.0 * i, 30.0 * i + 30, (*loose, 1)[i], (0.9, 0.2, 0.5, 0)[i]) for i in range(4)]
    part = scenes.parts_of.func(*[__import__("pandas").Series([[r[k] for r in rows]]) for k in range(4)], __import__("pandas").Series([float(most)]))[0]
    assert [part.count(p) for p in sorted(set(part))] == want


def cues_by_hand(words):
    out, buf = [], []

    def flush(after=None):
        if buf:
            end = max(buf[-1][2], buf[0][1] + 1)
            if after is not None:
                end = max(min(end, after), buf[0][1] + 0.05)
            out.append((round(buf[0][1], 6), round(end, 6), " ".join(w[0] for w in buf), any(w[3] is not None and w[3] < 0.6 for w in buf)))
            buf.clear()

    for i, w in enumerate(words):
        wide = len(" ".join([*(b[0] for b in buf), w[0]])) > 84
        if buf and (wide or w[2] - buf[0][1] > 7):
            flush(w[1])
        buf.append(w)
        after = words[i + 1][1] if i + 1 < len(words) else None
        if w[0][-1] in ".!?" or (after is not None and after - w[2] >= 0.4):
            flush(after)
    flush()
    return out


def test_cues(spark):
    draw, texts = random.Random(4), [[("Hello", 0.0, 0.4, None), ("world.", 0.4, 0.9, None), ("Next", 2.0, 2.3, 0.5), ("bit", 2.9, 3.2, None)]]
    for _ in range(40):
        at, own = 0.0, []
        for _ in range(draw.randint(1, 60)):
            at += draw.choice([0, 0, 0, 0.125, 0.5])
            d = draw.choice([0.125, 0.25, 0.75])
            own.append(("w" * draw.randint(1, 12) + draw.choice(["", "", "", "", "."]), at, at + d, draw.choice([None, 0.9, 0.5])))
            at += d
        texts.append(own)
    rows = [(k, i, *w) for k, own in enumerate(texts) for i, w in enumerate(own)]
    found = captions.build_cues(spark.createDataFrame(rows, "clip int, pos int, word string, start double, end double, probability double"), "clip", "pos")
    got = {}
    for r in found.orderBy("clip", "cue").collect():
        got.setdefault(r["clip"], []).append((round(r["start"], 6), round(r["end"], 6), r["text"].replace("\n", " "), r["low_confidence"]))
        assert all(len(line) <= 42 for line in r["text"].split("\n"))
    assert got == {k: cues_by_hand(own) for k, own in enumerate(texts)}
    assert got[0] == [(0.0, 1.0, "Hello world.", False), (2.0, 2.9, "Next", True), (2.9, 3.9, "bit", False)]
    srt = captions.render_srt(found.where("clip = 0"), "clip").first()["document"]
    assert srt.startswith("1\n00:00:00,000 --> 00:00:01,000\nHello world.\n\n2\n00:00:02,000") and srt.endswith("bit\n")


def test_karaoke(spark):
    words = spark.createDataFrame([(1, i, w, 10 + i / 2, 10.5 + i / 2, 10.0) for i, w in enumerate("abcd")], "clip int, pos int, word string, start double, end double, clip_start double")
    events = captions.karaoke_events(words, "clip", "pos")
    got = [(r["start"], r["end"], r["line"]) for r in events.orderBy("event").collect()]
    on, off = "{\\rActive}", "{\\rInactive}"
    assert got == [(0.0, 0.5, f"{on}A {off}B {off}C"), (0.5, 1.0, f"{off}A {on}B {off}C"), (1.0, 1.5, f"{off}A {off}B {on}C"), (1.5, 2.0, f"{on}D")]
    tall = captions.render_ass(events, "clip").first()["document"].split("\n")
    assert "PlayResY: 1920" in tall and tall[-2].startswith("Dialogue: 0,0:00:01.50,0:00:02.00,Inactive,,0,0,0,,") and "Style: Active,Arial,85," in captions.ass_header() and "Arial,60," in captions.ass_header(False)
    assert captions.karaoke_events(words, "clip", "pos", emoji="🔥").first()["line"].startswith(f"{on}🔥\\N") and captions.karaoke_events(words, "clip", "pos", False).select("group").distinct().count() == 1


def test_chunks_never_split_a_sentence(spark):
    rows = spark.createDataFrame([(1, i, " ".join(["w"] * n)) for i, n in enumerate([3, 4, 4, 25, 2, 8, 1])], "doc int, pos int, text string")
    got = [(r["pos"], r["chunk"], r["n_tokens"]) for r in summaries.pack_chunks(rows, "doc", "pos", 10).orderBy("chunk", "pos", "piece").collect()]
    assert got == [(0, 0, 3), (1, 0, 4), (2, 1, 4), (3, 2, 10), (3, 3, 10), (3, 4, 5), (4, 5, 2), (5, 5, 8), (6, 6, 1)]
    whole = [(r["pos"], r["chunk"]) for r in summaries.pack_chunks(rows, "doc", "pos", 10, split=False).orderBy("pos").collect()]
    assert whole == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4)]


def test_summary_takes_the_central_sentences(spark):
    lines = ["the cat sat on the mat", "the cat ate the mat and sat", "a cat and a mat", "zebra quartz vision", "the mat of the cat"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 0, "alone here")], "doc int, pos int, text string")
    found = {r["doc"]: (r["summary"], r["chosen"]) for r in summaries.summarize_extractive(rows, "doc", "pos", 12, most=2).collect()}
    assert len(found[1][1]) == 2 and 3 not in found[1][1] and found[2] == ("alone here", [0])
    named = summaries.summarize_extractive(rows, "doc", "pos", 100, per_chunk=1, most=1, titles=spark.createDataFrame([(1, "zebra quartz vision " * 9)], "doc int, title string"))
    assert {r["doc"]: r["chosen"] for r in named.collect()} == {1: [3], 2: [0]}
    score = {r["pos"]: r["score"] for r in summaries.centroid_scores(rows.where("doc = 1"), "doc", "pos").collect()}
    terms = [t.split() for t in lines]
    idf = {w: np.log(6 / (1 + sum(w in t for t in terms))) + 1 for t in terms for w in t}
    v = [{w: t.count(w) * idf[w] for w in t} for t in terms]
    c = {w: sum(x.get(w, 0) for x in v) for w in idf}
    norm = lambda x: np.sqrt(sum(a * a for a in x.values()))
    assert all(abs(score[i] - sum(a * c[w] for w, a in x.items()) / norm(x) / norm(c)) < 1e-9 for i, x in enumerate(v))


def frames_of(spark, signals, size):
    rows = [(k, i // size, x[i : i + size].tolist()) for k, x in signals.items() for i in range(0, len(x), size)]
    return spark.createDataFrame(rows, "recording_id string, frame_no int, samples array<double>")


def test_loudness_of_a_tone(spark):
    """A 997 Hz sine of amplitude 1 has -3.01 LUFS; half of it 6.02 less; silence has none, and doesn't count beside a tone."""
    rate = 8000
    tone = np.sin(2 * np.pi * 997 * np.arange(3 * rate) / rate)
    found = sound.integrated_loudness(sound.loudness_blocks(frames_of(spark, {"one": tone, "half": tone / 2, "none": tone * 0, "part": np.concatenate((tone, 0 * tone))}, 800), rate))
    got = {r["recording_id"]: r["lufs"] for r in found.collect()}
    assert abs(got["one"] + 3.01) < 0.05 and abs(got["half"] + 9.03) < 0.05 and got["none"] is None and abs(got["part"] - got["one"]) < 0.3


def test_flatness_and_metrics(spark):
    rng, t = np.random.default_rng(1), np.arange(4000)
    frames = frames_of(spark, {"tone": 0.5 * np.sin(2 * np.pi * 440 * t / 16000), "noise": rng.normal(size=4000), "zero": np.zeros(100)}, 480)
    got = {r["recording_id"]: r["spectral_flatness"] for r in sound.spectral_flatness(frames).collect()}
    spectrum = np.abs(np.fft.rfft(0.5 * np.sin(2 * np.pi * 440 * t[:2048] / 16000), 2048)).clip(1e-10)
    assert abs(got["tone"] - np.exp(np.log(spectrum).mean()) / spectrum.mean()) < 1e-9 and got["tone"] < 0.5 < got["noise"] and abs(got["zero"] - 1) < 1e-9
    levels = spark.createDataFrame([("tone", -9.0309, 12.3456, 0.1234567)], "recording_id string, rms_db double, snr_db double, clipping_ratio double")
    meta = spark.createDataFrame([("tone", 16000, 1, 0.25)], "recording_id string, sample_rate int, num_channels int, duration_seconds double")
    row = sound.audio_metrics(levels, sound.spectral_flatness(frames), meta).first()
    assert (row["snr_db"], row["rms_db"], row["clipping_ratio"], row["duration_seconds"]) == (12.35, -9.03, 0.123457, 0.25)
    report = sound.processing_report(levels, levels.select("recording_id", F.lit("mild").alias("strength")), levels.limit(0), levels.limit(0)).first()
    assert report["denoise"]["strength"] == "mild" and report["normalization"] is None and report["metrics"]["snr_db"] == 12.3456


def test_levelling_and_mixing(spark):
    frames = frames_of(spark, {"a": np.array([0.1, 0.2, 0.5, -0.5, 0.0, 0.0])}, 2)
    rows = sound.gain_envelope(frames, half=0).orderBy("frame_no").collect()
    assert [round(r["gain"], 6) for r in rows] == [4.75, 1.9, 10.0]
    smooth = sound.gain_envelope(frames).orderBy("frame_no").collect()
    assert all(1.9 <= r["gain"] <= 10 for r in smooth)
    mixed = sound.mix_bed(frames, frames.where("frame_no = 0"), volume=0.5).orderBy("frame_no").collect()
    assert np.allclose([r["samples"] for r in mixed], [[0.15, 0.3], [0.55, -0.4], [0.05, 0.1]])
    top = sound.peak_normalize(frames).select(F.max(F.array_max("samples"))).first()[0]
    assert abs(top - 0.9) < 1e-6
    passed = sound.denoise_frames(frames)
    halved = sound.denoise_frames(frames, lambda batches: (b.assign(samples=b["samples"].map(lambda x: [v / 2 for v in x])) for b in batches))
    assert not passed.first()["executed"] and halved.where("executed").orderBy("frame_no").first()["samples"] == [0.05, 0.1]


def test_speech_and_lips(spark):
    frames = spark.createDataFrame([("r", i / 10, i / 10 + 0.1, p) for i, p in enumerate([0.9] * 5 + [0.1] * 3 + [0.8] * 4 + [0.0] * 9 + [0.7])], "recording_id string, start double, end double, prob double")
    assert [tuple(r) for r in sound.frames_to_speech(frames).collect()] == [("r", 0.0, 1.23)]
    spans = spark.createDataFrame([("r", 0.0, 1.0), ("r", 5.0, 5.1), ("r", 10.0, 100.0)], "recording_id string, start double, end double")
    times = [(r["start"], r["t"]) for r in sound.sample_times(spans).collect()]
    assert [t for s, t in times if s == 0] == [0.0, 0.25, 0.5, 0.75, 1.0] and [t for s, t in times if s == 5] == [5.0, 5.1] and len([t for s, t in times if s == 10]) == 40
    crops = spark.createDataFrame([("r", 0.1, 0.0, [0.0, 0.0]), ("r", 0.1, 0.2, [0.5, 0.1]), ("r", 0.1, 0.4, [0.5, 0.1]), ("r", 3.1, 0.0, [0.2, 0.2])], "recording_id string, start double, t double, roi array<double>")
    speech = spark.createDataFrame([("r", 1.0, 2.0), ("r", 2.2, 3.0), ("r", 5.0, 6.0)], "recording_id string, start double, end double")
    found = sound.detect_bloopers(speech, spark.createDataFrame([("r", 8.0)], "recording_id string, total_dur double"), crops).orderBy("index").collect()
    assert [(r["start"], r["end"], r["duration"], r["lip_motion"], r["label"]) for r in found] == [(0.1, 0.9, 0.8, 0.15, "lips_moving"), (3.1, 4.9, 1.8, None, "no_face"), (6.1, 7.9, 1.8, None, "no_face")]
    back = sound.samples_to_seconds(spark.createDataFrame([("r", 48000, 64000), ("r", 16000, 48000)], "recording_id string, start int, end int"), 16000).collect()
    assert [tuple(r) for r in back] == [("r", 1.0, 3.0), ("r", 3.0, 4.0)]


def test_decisions(spark):
    cases = [(25, 0.1, "none"), (20, 0.1, "none"), (15, 0.1, "mild"), (10, 0.1, "mild"), (5, 0.1, "strong"), (25, 0.3, "mild"), (25, 0.8, "strong"), (15, 0.3, "strong"), (15, 0.8, "strong")]
    df = spark.createDataFrame([(float(a), b, 0.02, c) for a, b, c in cases], "snr double, flat double, clip double, want string")
    rows = df.select("want", N.denoise_decision(F.col("snr"), F.col("flat"), F.col("clip")).alias("d"), N.denoise_decision(F.col("snr"), F.col("flat"), F.col("clip"), True).alias("forced")).collect()
    assert all(r["d"]["strength"] == r["want"] and r["d"]["should_denoise"] == (r["want"] != "none") and "CLIPPING" in r["d"]["reason"] and r["forced"]["strength"] == "strong" for r in rows)
    gains = spark.createDataFrame([(-33.0, 0.2), (-33.0, 0.5), (float("-inf"), 0.1), (float("nan"), 0.1)], "level double, peak double").select(N.gain_plan(F.col("level"), F.col("peak")).alias("g")).collect()
    assert [(r["g"]["applied"], r["g"]["limited"], round(r["g"]["gain_db"], 4)) for r in gains] == [(True, False, 10.0), (True, True, round(20 * np.log10(0.99 / 0.5), 4)), (False, False, 0.0), (False, False, 0.0)]


def test_prompts_and_vectors(spark):
    points = spark.createDataFrame([(-0.69, 0.8), (0.0, 0.0), (0.15, 0.3), (0.5, 0.5), (0.5, -0.1)], "v double, a double").select(N.music_prompt(F.col("v"), F.col("a")).alias("p")).collect()
    p = [r["p"] for r in points]
    assert p[0].startswith("dark, tense, suspenseful, dissonant instrumental background music, minor key, energetic and driving, around 120 BPM") and p[1].startswith("calm") and "modal, moderate" in p[1]
    assert "major key" in p[2] and "120 BPM" in p[3] and "60 BPM" in p[4]
    v = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0, 0.0],), ([],)], "x array<double>").select(N.argmax(F.col("x")).alias("m"), N.l2_normalize(F.col("x")).alias("u")).collect()
    assert [r["m"] for r in v] == [1, 0, None] and abs(sum(a * a for a in v[0]["u"]) - 1) < 1e-12 and v[1]["u"] == [0.0] * 3


def test_text_helpers(spark):
    row = spark.createDataFrame([("one two three", " a<n>b ", "x 🔥 y ⚽", "none")], "t string, m string, e string, p string")
    got = row.select(T.wrap_text("t", 7), T.normalize_markers("m"), T.extract_emoji("e", "-"), T.extract_emoji("p", "-"), T.truncate_tokens("t", 2)).first()
    assert tuple(got) == ("one two\nthree", "a b", "🔥⚽", "-", "one two")
    parts = spark.createDataFrame([(1, 2, "b "), (1, 1, "a"), (1, 3, " ")], "k int, o int, t string").groupBy("k").agg(T.join_text("o", "t").alias("x"))
    assert parts.first()["x"] == "a b"
    names = spark.createDataFrame([(3, 12.5, "A b?!")], "r int, s double, t string").select(clips.clip_file_name(F.col("r"), F.col("s"), F.col("t")), clips.blooper_file_name(F.col("r"), F.col("s"), F.lit(14.0)))
    assert tuple(names.first()) == ("clip_03_12.5s_A_b.mp4", "blooper_003_12.5-14.0.mp4")


def test_long_spans_meet_nothing(spark):
    """A corrupt end time doesn't explode into buckets."""
    from castmill.operators import intervals

    words = spark.createDataFrame([(1, 0.0, 1.0), (1, 5.0, 1e15)], "recording_id int, start double, end double")
    spans = spark.createDataFrame([(1, 0.5, 10.0), (1, 0.0, 1e16)], "recording_id int, span_start double, span_end double")
    assert [tuple(r)[1:] for r in intervals.words_in_span(words, spans).collect()] == [(0.0, 1.0, 0.5, 10.0)]


def test_caption_emoji(spark):
    """The class of captions is wider than the flag of titles."""
    row = spark.createDataFrame([("⏰ a ⌚ 🀄 b 🆗 é", "\u2603\u27c0 𐀀")], "a string, b string").select(T.extract_emoji("a", "-"), T.extract_emoji("b", "-")).first()
    assert tuple(row) == ("⏰⌚🀄🆗", "\u2603𐀀")


def test_emotion_points(spark):
    """Unknown emotions stand at 0, 0; of equal shares the first counts; three places in the map."""
    rows = [(1, 0, "Joy", 0.4), (1, 1, "anger", 0.4), (1, 2, "calm", 0.2), (2, 0, "fear", 1 / 3), (2, 1, "neutral", 2 / 3)]
    df = spark.createDataFrame(rows, "k int, i int, label string, p double")
    got = {r["k"]: r for r in sound.emotion_va(df, "k", order="i").collect()}
    assert abs(got[1]["valence"] - 0.08) < 1e-12 and abs(got[1]["arousal"] - 0.56) < 1e-12 and got[1]["dominant"] == "joy" and got[1]["scores"] == {"joy": 0.4, "anger": 0.4, "calm": 0.2}
    assert got[2]["dominant"] == "neutral" and got[2]["scores"] == {"fear": 0.333, "neutral": 0.667}


def test_manifest_by_hand(spark):
    """Words of a clip in the recording's time, captions in its own; a clip without words has none, one of no length goes."""
    clips_ = spark.createDataFrame([(1, 0, 10.0, 12.0, "Hello there!", "relevancy", 0.5, None), (1, 1, 50.0, 51.0, "?", None, None, " own "), (1, 2, 5.0, 5.0, "gone", None, None, None)], "rec int, pos int, start double, end double, text string, category string, music_volume double, name string").withColumn("path", F.lit("/a/b.c/talk.one.mp4"))
    words = spark.createDataFrame([(1, 9.0, 10.25, "Well"), (1, 10.25, 11.0, "hello"), (1, 11.0, 11.5, "there."), (1, 11.75, 13.0, "Bye"), (2, 10.0, 11.0, "other")], "rec int, start double, end double, word string")
    a, b = clips.clip_manifest(clips_, words, "rec", "pos", source="path").orderBy("pos").collect()
    assert [tuple(w) for w in a["words"]] == [(9.0, 10.25, "Well"), (10.25, 11.0, "hello"), (11.0, 11.5, "there."), (11.75, 13.0, "Bye")]
    assert a["srt"] == "1\n00:00:00,250 --> 00:00:01,500\nhello there.\n" and (a["name"], a["category"], a["volume"], a["rank"], a["duration"]) == ("talk.one", "relevancy", 0.5, 1, 2.0)
    assert (b["words"], b["srt"], b["name"], b["category"], b["volume"], b["file"]) == ([], None, "own", "combined", 0.35, "clip_02_50.0s_clip.mp4")


def test_word_files_must_have_words(spark, tmp_path):
    from castmill.sources import files

    (tmp_path / "a_transcript_words.json").write_text('[{"segment_id": 1, "word": "hi", "start": 0, "end": 0.5, "probability": 0.9}]')
    assert [tuple(r) for r in files.read_words(spark, str(tmp_path)).collect()] == [("a", 1, "hi", 0.0, 0.5, 0.9)]
    (tmp_path / "b_transcript_words.json").write_text("[]")
    with pytest.raises(Exception, match="b contains no words"):
        files.read_words(spark, str(tmp_path)).collect()


def test_split_coverage(spark):
    from castmill.operators import titles

    every = spark.createDataFrame([(i,) for i in range(5)], "video_id int")
    split = spark.createDataFrame([(0, "train"), (1, "val"), (1, "test"), (2, "test"), (9, "val")], "video_id int, split string")
    assert tuple(titles.split_coverage(split, every).first()) == (5, 4, 1, 2, 1)
