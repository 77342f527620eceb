"""Operators that once gathered, multiplied or grew by the square: large single keys, against plain definitions."""

import random
import resource
import time
from bisect import bisect_right

import numpy as np
from pyspark.sql import functions as F

from castmill.operators import captions, clips, pairs, sound, summaries, transcripts


def test_active_at_by_definition(spark):
    """Spans of all lengths, empty, backwards and endless ones, closed and half open, by a loop over all."""
    draw = random.Random(3)
    spans = [(k, i, a, a + draw.choice([0.0, 0.125, 1.0, 7.5, 300.0, -2.0, 5e9])) for k in "ab" for i in range(150) for a in [draw.choice([0.0, 1.5]) + draw.randint(-4000, 4000) / 4]]
    times = [(k, draw.randint(-4400, 4400) / 4) for k in "abc" for _ in range(150)] + [("a", None), ("b", 1e9), ("a", 3.0), ("a", 3.0)]
    sdf = spark.createDataFrame(spans, "k string, pos int, start double, end double")
    tdf = spark.createDataFrame(times, "k string, t double")
    for closed in (True, False):
        hit = lambda k, t: min((p for q, p, a, b in spans if q == k and t is not None and a <= t and (t <= b if closed else t < b)), default=None)
        got = sorted(((r["k"], r["t"], r["pos"]) for r in clips.active_at(tdf, sdf, "k", closed).collect()), key=str)
        assert got == sorted(((k, t, hit(k, t)) for k, t in times), key=str)


def test_active_at_on_one_recording(spark):
    """100,000 spans and as many times of one recording."""
    n = 100_000
    rows = spark.range(n).select((F.col("id") % 1).alias("k"), F.col("id").alias("pos"), (F.col("id") / 8).alias("start"), (F.col("id") / 8 + 0.5).alias("end"))
    times = spark.range(n).select((F.col("id") % 1).alias("k"), (F.col("id") / 8 + 0.0625).alias("t"))
    began = time.time()
    found = clips.active_at(times, rows, "k")
    got = found.agg(F.count("pos"), F.sum(F.abs(F.col("pos") - F.greatest(F.lit(0), F.ceil((F.col("t") - 0.5) * 8))))).first()
    assert tuple(got) == (n, 0) and time.time() - began < 60
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in found._jdf.queryExecution().toString()


def table_edits(a, b):
    """The way back over the whole table."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j - 1] + (x != y), rows[-1][j] + 1, row[-1] + 1))
        rows.append(row)
    i, j, s, d, n = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            s, i, j = s + (a[i - 1] != b[j - 1]), i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            n, j = n + 1, j - 1
    return s, d, n, len(a) - s - d


def test_edit_counts_equal_the_table():
    draw = random.Random(11)
    for _ in range(400):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(0, 14))] for _ in range(2))
        assert pairs._edits(a, b) == table_edits(a, b)


def test_edit_counts_of_long_texts():
    """Two texts of 20,000 words: a table would have 4e8 cells."""
    words = [str(random.Random(1).randrange(50)) for _ in range(50)] * 400
    other = words[100:9000] + ["x"] + words[9001:]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    s, d, n, hits = pairs._edits(words, other)
    assert (s, d, n) == (1, 100, 0) and hits == len(words) - 101
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_loudness_by_stretches(spark):
    """Blocks of a recording cut in stretches, against one filter over all of it; frames of odd sizes, an empty one, and a recording too short for a block."""
    rate, draw = 8000, np.random.default_rng(5)
    x = draw.normal(0, 0.2, 147_317)
    cuts = [0, 1, 700, 700, 5000, 5003, 20_000, 91_111, len(x)]
    rows = [("a", i, x[p:q].tolist()) for i, (p, q) in enumerate(zip(cuts, cuts[1:]))] + [("b", 0, [0.1] * 3199), ("c", 0, [0.1] * 3200)]
    frames = spark.createDataFrame(rows, "recording_id string, frame_no int, samples array<double>")
    found = sound.loudness_blocks(frames, rate, seconds=2.0)
    got = sorted((r["recording_id"], r["power"]) for r in found.collect())
    sq = np.concatenate(([0.0], np.cumsum(sound._k_weighted(x, rate) ** 2)))
    at = np.arange(0, len(sq) - 3200, 800)
    want = sorted(((sq[at + 3200] - sq[at]) / 3200).tolist())
    assert [k for k, _ in got] == ["a"] * len(want) + ["c"] and np.allclose([p for k, p in got if k == "a"], want, rtol=1e-9)


def test_a_transcript_of_a_million_words(spark):
    """Cues, density windows and a summary of one transcript without a pause or a sentence end, in less than a minute each."""
    n = 1_000_000
    words = spark.range(n).select(F.lit(1).alias("clip"), F.col("id").alias("pos"), F.lit("word").alias("word"), (F.col("id") / 8).alias("start"), (F.col("id") / 8 + 0.125).alias("end"), F.lit(0.9).alias("probability"))
    began = time.time()
    cues = captions.build_cues(words, "clip", "pos").agg(F.count("*"), F.max("cue")).first()
    assert tuple(cues) == (n // 17 + 1, n // 17 + 1) and time.time() - began < 60  # 17 words of 4 letters fit 84 characters
    began = time.time()
    rows = spark.range(n).select(F.lit("t").alias("transcript_id"), "id", (F.col("id") / 16).alias("start"), (F.col("id") / 16 + 0.05).alias("end"), F.lit("some words").alias("text"))
    kept = transcripts.sanitize(rows).where("reason is null").count()
    assert kept == n // 16 and time.time() - began < 60
    began = time.time()
    lines = spark.range(n // 10).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), F.concat(F.lit("ten plain words of one line number "), F.col("id").cast("string"), F.lit(" go on")).alias("text"))
    assert len(summaries.summarize_extractive(lines, "doc", "pos").first()["chosen"]) == 3 and time.time() - began < 60


def test_the_density_windows_by_a_loop(spark):
    draw = random.Random(8)
    starts = sorted(draw.randint(0, 400) / 16 for _ in range(300))
    df = spark.createDataFrame([("t", i, s, s + 0.5, f"word{i}") for i, s in enumerate(starts)], "transcript_id string, id long, start double, end double, text string")
    got = {r["id"] for r in transcripts.sanitize(df).where("reason = 'density_explosion'").collect()}
    live = [i for i, s in enumerate(starts) if starts.count(s) < 5 or starts.index(s) == i]
    want, k = set(), 0
    while k < len(live):
        stop = bisect_right([starts[i] for i in live], np.nextafter(starts[live[k]] + 1, 0))
        want |= set(live[k + 1 : stop]) if stop - k > 8 else set()
        k = stop
    assert got == want and want
