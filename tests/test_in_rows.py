"""Work that stays within a row: values that are bound once, and plans without a shuffle."""

import math
import random
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import functions as F

from castmill.functions import numeric as N
from castmill.operators import clips, pairs, summaries, transcripts
from castmill.plans import media, queries, titles


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_softmax_and_normalize_by_definition(spark):
    """A vector of 5,000: its sums are worked out once, not for each element."""
    x = [i % 17 / 7 for i in range(5000)]
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: i % 17 / 7).alias("x")).repartition(1)
    got = df.select(N.softmax(F.col("x")).alias("s"), N.l2_normalize(F.col("x")).alias("u")).first()
    total, size = sum(math.exp(v - max(x)) for v in x), math.sqrt(sum(v * v for v in x))
    assert all(math.isclose(a, math.exp(v - max(x)) / total, rel_tol=1e-9) for a, v in zip(got["s"], x))
    assert all(math.isclose(a, v / size, rel_tol=1e-9, abs_tol=1e-12) for a, v in zip(got["u"], x))


def test_running_sums(spark):
    """Under, at and over the length of a block; empty and null arrays."""
    lists = [[float(random.Random(n).randrange(9)) for _ in range(n)] for n in (0, 1, 511, 512, 513, 2000)]
    rows = spark.createDataFrame([*enumerate(lists), (9, None)], "i int, x array<double>").repartition(1)
    got = {r["i"]: r["s"] for r in rows.select("i", N.running_sum(F.col("x")).alias("s")).collect()}
    assert got == {**{i: list(accumulate(x)) for i, x in enumerate(lists)}, 9: None}


def test_lines_and_captions_are_not_shuffled(spark, sf_dir):
    """They were, with their texts, for the times of the lines and the ends of each caption."""
    for name in ("timed_segments", "captions"):
        assert "Exchange" not in plan(queries.QUERIES[name](spark, sf_dir))


def test_clips_are_rendered_within_their_lines(spark, sf_dir):
    for name in ("karaoke", "ass_documents"):
        assert "Exchange" not in plan(media.QUERIES[name](spark, sf_dir))


def test_cues_of_documents_are_not_shuffled(spark, sf_dir):
    assert "Exchange" not in plan(media.QUERIES["cues"](spark, sf_dir))


def test_a_manifest_of_words_in_the_clips_rows(spark):
    """The same rows as from joined words: late, early, empty and backward words, a clip without words and one without length."""
    rows = [("a", 0, 1.0, 4.0, "x y"), ("a", 1, 4.0, 9.0, "z"), ("a", 2, 9.0, 9.0, "none"), ("b", 0, 0.5, 2.0, "no words")]
    words = [("a", 0.5, 1.4, "in", 0.9), ("a", 1.4, 2.0, "two.", 0.5), ("a", 2.0, 2.0, "nil", 0.9), ("a", 3.9, 4.5, "late", 0.9), ("a", 8.0, 7.0, "back", 0.9)]
    found = spark.createDataFrame(rows, "k string, pos int, start double, end double, text string")
    table = spark.createDataFrame(words, "k string, start double, end double, word string, probability double")
    nested = table.groupBy("k").agg(F.collect_list(F.struct("start", "end", "word", "probability")).alias("own"))
    held = found.join(nested, "k", "left").withColumn("own", F.coalesce("own", F.array().cast(nested.schema["own"].dataType)))
    one = clips.clip_manifest(found, table, "k", "pos").orderBy("k", "pos").collect()
    assert clips.clip_manifest(held, F.col("own"), "k", "pos").orderBy("k", "pos").collect() == one and len(one) == 3 and one[0]["srt"]


def test_the_manifest_query_shuffles_once(spark, sf_dir):
    """For the ranks of the clips; it shuffled words, twice over."""
    assert plan(media.QUERIES["clip_manifest"](spark, sf_dir)).count("Exchange") == 1


def test_pairs_are_compared_in_their_rows(spark):
    df = spark.createDataFrame([(1, "a b a b", "a b b a b"), (2, None, "x"), (3, "", "")], "k int, reference string, hypothesis string")
    found = pairs.rouge_n(df, ["k"], 2)
    assert "Exchange" not in plan(found)
    assert [tuple(r) for r in found.orderBy("k").collect()] == [(1, 3 / 4, 1.0, 6 / 7), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)]


def test_faulty_lines_are_made_in_one_pass_and_texts_stay_behind(spark, sf_dir):
    """It read the documents five times and shuffled the texts."""
    assert media.injected(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    exchanges = [line for line in plan(media.sanitized(spark, sf_dir)).splitlines() if "Sort [" in line]
    assert exchanges and not any("text" in line for line in exchanges)


def test_mean_vectors(spark):
    df = spark.createDataFrame([([[1.0, 2.0], None, [3.0, None], [5.0]],)], "v array<array<float>>")
    assert df.select(N.mean_vector(F.col("v")).alias("m")).first()["m"] == [3.0, 2.0]


def test_components_of_vectors_are_not_rows(spark, sf_dir):
    """The mean of a document's lines once took a row for each component."""
    assert "posexplode" not in plan(titles.scored_lines(spark, sf_dir))


def test_summaries_shuffle_no_text(spark):
    """One row a document, no exchange; repeated ids are brought together, rows without an id have no summary."""
    assert "Exchange" not in plan(media.summaries(spark, "/root/testdata/sf0.001"))
    text = "the cat sat on a mat. the cat ate a mat. zebra quartz vision here. a cat and a mat."
    docs = spark.createDataFrame([(1, text), (2, "one cat on one mat. two cats on a mat."), (2, "a zebra in a zoo."), (None, text), (3, None), (4, "ж ж ж ж")], "doc_id long, text string")
    rows = transcripts.segments(docs.where("doc_id is not null")).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")
    want = {r["doc_id"]: (r["summary"], r["chosen"]) for r in summaries.summarize_extractive(rows, "doc_id", "pos", 8).collect()}
    got = summaries.summarize_within(transcripts.document_lines(docs), "doc_id", "pos", 8).collect()
    assert sorted(want) == [1, 2] and len(got) == 2 and {r["doc_id"]: (r["summary"], r["chosen"]) for r in got} == want


def test_summaries_by_definition(spark):
    """Random sentences, some of one order, some without terms or text, with titles, in more than one block of rows, by loops over all."""
    draw = random.Random(5)
    rows = [(k, draw.randint(0, 9), draw.choice([None, "-- ж --"]) if draw.random() < 0.1 else " ".join(draw.choice(["a", "b", "Cat", "İstanbul", "x-1", "zoo"]) for _ in range(draw.randint(1, 6)))) for k in range(600) for _ in range(draw.randint(1, 14))]
    named = [(k, draw.choice(["zoo zoo b", "other", None])) for k in range(0, 600, 3) for _ in range(draw.randint(1, 2))]

    def best(sentences, titles, k):
        terms = lambda t: re.findall("[a-z0-9]+", t.lower()) if t else []
        own = {}
        for pos, t in sentences:
            own.setdefault(pos, Counter()).update(terms(t))
        every = Counter(x for t in [*[t for _, t in sentences], *titles] for x in terms(t))
        idf = {t: math.log((1 + len(sentences)) / (1 + sum(t in c for c in own.values()))) + 1 for c in own.values() for t in c}
        size = lambda v: math.sqrt(sum(x * x for x in v))
        score = {p: sum(n * idf[t] ** 2 * every[t] for t, n in c.items()) / size(n * idf[t] for t, n in c.items()) / size(every[t] * w for t, w in idf.items()) for p, c in own.items() if c}
        return set(sorted(score, key=lambda p: (-round(score[p], 9), p))[:k])

    want = {}
    for key in range(600):
        sentences = sorted(((p, t) for k, p, t in rows if k == key), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        own, chunks, held = [t for k, t in named if k == key], [], 11
        for p, t in sentences:
            n = len((t or "").split())
            chunks, held = ([*chunks, [(p, t)]], n) if held + n > 10 else ([*chunks[:-1], [*chunks[-1], (p, t)]], held + n)
        some = [x for x in sentences if any(x[0] in best(c, own, 2) for c in chunks)]
        last = best(some, own, 3)
        if last:
            want[key] = [p for p, _ in some if p in last]
    df = spark.createDataFrame(rows, "doc int, pos int, text string")
    found = summaries.summarize_extractive(df, "doc", "pos", 10, titles=spark.createDataFrame(named, "doc int, title string"))
    assert {r["doc"]: r["chosen"] for r in found.collect()} == want
