"""Both classifiers against scores worked out by their formulas, and co-training where it helps and where it mustn't teach."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from castmill.llm import pipeline, quality, queries, secrets, toxicity
from castmill.llm.common import durable, scratch
from castmill.llm.copies import near_copies

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def tables(spark):
    return (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))


def test_quality_scores_by_formula(spark):
    """Every document's probabilities: weights of the features that it has, calibrated, both views less the prior."""
    docs, labels = tables(spark)
    m = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_quality"](spark, SMALL).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        text = r["text"] or ""
        tokens, low = re.findall(r"\w+|[^\w\s]+", text), re.findall(r"\w+|[^\w\s]+", text.lower())
        n, step = max(1, len(tokens)), lambda x: int(min(max(x, 0), 1) * 10)
        kinds = {f"\tupper{step(sum(t.isupper() for t in tokens) / n)}", f"\tmarks{step(sum(not t[0].isalnum() for t in tokens) / n)}"}
        wide = len({t for t in low if len(t) > 2 and not t[0].isalnum()})
        kinds |= {f"\tunique{step(len(set(low)) / n)}", f"\twide{wide.bit_length()}"}
        words = sum(m["models"][0][m["vocab"][t]] for t in set(low) | kinds if t in m["vocab"]) + m["models"][0][-1]
        size = int(r["n_chars"] or 0).bit_length()
        lang, source = f"lang={r['lang']}", f"source={r['source']}"
        pages = {zlib.crc32("&".join(p).encode()) % 1024 for p in ([lang], [source], [f"chars={size}"], [lang, f"chars={size}"], [lang, source], [source, f"chars={size}"], [lang, source, f"chars={size}"])}
        page = sum(m["models"][1][p] for p in pages) + m["models"][1][-1]
        odds = [a * x + b for x, (a, b) in zip((words, page), m["plates"])]
        want = [sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(sum(odds) - m["prior"])]
        have = got[r["doc_id"]]
        assert all(abs(a - b) < 2e-6 for a, b in zip(want, (have["p_text"], have["p_page"], have["p_quality"]))) and have["kept"] == (have["p_quality"] >= 0.5)


def test_toxicity_scores_by_formula(spark):
    """Expected severity is the sum over the thresholds of the chance to pass them."""
    docs, labels = tables(spark)
    m = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_toxicity"](spark, SMALL).collect()}
    assert len(got) == docs.count() and len(m["theta"]) == 2 and m["theta"][0] < m["theta"][1]
    for r in docs.collect():
        words = set(re.findall(r"\w+", (r["text"] or "").lower()))
        own = set(words)
        for size in (5, 7):
            stems = [w[:size] for w in words if len(w) > size]
            for s in set(stems):
                own |= {f"{s}*{1 << k}" for k in range(1, 40) if 1 << k <= stems.count(s)}
        x = sum(m["w"][m["vocab"][t]] for t in own if t in m["vocab"])
        chances = [sigmoid(x - t) for t in m["theta"]]
        have = got[r["doc_id"]]
        assert abs(have["severity"] - sum(chances)) < 2e-6 and abs(have["p_toxic"] - chances[0]) < 2e-6 and have["toxic"] == (have["p_toxic"] >= 0.5)


def made(n=4000, labelled=160):
    """Half of the documents tell their class by source, all of them by one word among 30 that tell nothing."""
    draw, rows, labels = random.Random(4), [], []
    for i in range(n):
        k, by_page = i % 2, draw.random() < 0.5
        words = [f"{'good' if k else 'bad'}{draw.randrange(20)}"] + [f"w{draw.randrange(300)}" for _ in range(30)]
        rows.append((i, " ".join(words), "en", f"site{k}" if by_page else "none", 100))
        if i < labelled:
            labels.append((i, k))
    return rows, labels


def accuracy(spark, rows, labels, rounds):
    docs = spark.createDataFrame(rows, DOCS)
    found = quality.classify_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), rounds=rounds)
    right = lambda c: F.avg(((F.col(c) >= 0.5) == (F.col("doc_id") % 2 == 1)).cast("double"))
    return found.where(F.col("doc_id") >= len(labels)).agg(right("p_text"), right("p_page"), right("p_quality")).first()


def test_exchange_helps(spark):
    """The page view is sure of half of the documents and teaches the text view their words; both together then know most."""
    rows, labels = made()
    before, after = accuracy(spark, rows, labels, 0), accuracy(spark, rows, labels, 3)
    print("accuracy of text, page, both without and with exchange:", [round(x, 3) for x in (*before, *after)])
    assert after[0] > before[0] + 0.2 and after[2] > before[2] + 0.1 and after[2] > max(before) + 0.1 and after[2] > 0.95


def test_one_sided_views_teach_nothing(spark):
    """A view that is never sure of both classes has no cutoffs."""
    odds = spark.createDataFrame([(1.4 + i / 1000,) for i in range(900)], "o double")
    assert quality._cutoffs(odds, "o", 0.1, 0.8) is None
    both = odds.union(spark.createDataFrame([(-3.0,), (3.5,), (4.0,)] * 50, "o double"))
    low, high = quality._cutoffs(both, "o", 0.1, 0.8)
    assert low <= -quality.SURE and high >= quality.SURE
    assert quality._cutoffs(odds.limit(0), "o", 0.1, 0.8) is None


def test_scratch_goes(spark, tmp_path):
    """Tables made inside go at the end but for the one that is kept; also when an error leaves."""
    with scratch(spark) as keep:
        a, b = durable(spark.range(3)), durable(spark.range(4))
        with scratch(spark) as inner:
            c = inner(durable(spark.range(5)))
        keep(b)
    from pathlib import Path

    paths = [Path(x.written_at.removeprefix("file:")) for x in (a, b, c)]
    assert [p.exists() for p in paths] == [False, True, False] and b.count() == 4
    with pytest.raises(ValueError), scratch(spark):
        d = durable(spark.range(1))
        raise ValueError
    assert not Path(d.written_at.removeprefix("file:")).exists()


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_copies(docs).collect() == [] and secrets.redact(docs).collect() == []
    assert quality.keep_good(docs, labels).collect() == [] and toxicity.keep_clean(docs, labels).collect() == []
    d = "/root/testdata/sf0.001"
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, d).collect() == []


def test_very_long_texts(spark):
    """A text of 2 million characters through the classifiers and every stage."""
    text = "Plain words of a long text, one after the other. " * 40_000
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, "x" * 1_000_000, "en", None, None)], DOCS)
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, SMALL)
        assert {r[0] for r in found.select("doc_id").collect()} <= {1, 2, 3} and found.columns == docs.columns, name
    kept = pipeline.keep_one_of_group(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 3]
    assert pipeline.pack_sequences(spark, docs, SMALL).agg(F.sum("length")).first()[0] > 1_000_000
