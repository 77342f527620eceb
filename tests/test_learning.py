"""Title models, text pair measures, rankings and splits."""

import random

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from castmill.operators import clips, highlight, learning, metrics, pairs, summaries, titles
from castmill.plans import queries
from castmill.sources import files, stages


def made_titles(spark, n=600):
    draw, rows = random.Random(2), []
    for i in range(n):
        hot = draw.random() < 0.5
        words = [draw.choice(["wow", "insane", "best"] if hot else ["lecture", "minutes", "report"]), *[draw.choice("abcdefgh") * 3 for _ in range(4)]]
        score = min(1.0, max(0.0, (0.8 if hot else 0.2) + draw.gauss(0, 0.05)))
        rows.append((i, " ".join(words) + ("!" if hot and draw.random() < 0.5 else ""), 1 + i % 3, score, 1 if score > 0.7 else 0 if score < 0.3 else None))
    return spark.createDataFrame(rows, "video_id int, title string, country_count int, viral_score double, viral_label int")


def test_detector_reranker_and_comparison(spark, tmp_path):
    rows = made_titles(spark).repartition(4).cache()
    train, test = rows.where("video_id % 4 > 0"), rows.where("video_id % 4 = 0")
    found = learning.score_detector(learning.train_detector(train), test)
    right = found.join(test.select("video_id", F.col("viral_label").alias("y")), "video_id").where("y is not null").agg(F.avg(F.expr("double(viral_label = y)"))).first()[0]
    assert right > 0.95 and found.where("viral_prob between 0 and 1").count() == test.count()
    model = learning.train_reranker(train)
    learning.save_model(model, f"{tmp_path}/m")
    a, b = ({r["video_id"]: r["predicted_score"] for r in learning.score_reranker(m, test).collect()} for m in (model, learning.load_model(f"{tmp_path}/m")))
    true = {r["video_id"]: r["viral_score"] for r in test.collect()}
    assert a == b and np.corrcoef([a[i] for i in true], list(true.values()))[0, 1] > 0.9
    table = learning.compare_models(train, test, {
        "logistic": LogisticRegression(labelCol="viral_label", regParam=0.01), "forest": RandomForestClassifier(labelCol="viral_label", numTrees=5, seed=1),
        "linear": LinearRegression(labelCol="viral_score", regParam=0.1), "trees": GBTRegressor(labelCol="viral_score", maxIter=3, seed=1),
    }).collect()
    assert [r["model"] for r in table][0] in ("logistic", "forest") and len(table) == 4 and all(r["seconds"] > 0 for r in table) and all(r["auc"] > 0.6 if r["mse"] is None else r["mse"] < 0.05 for r in table)


def test_evaluation_equals_the_single_measures(spark):
    """All models in one long table give what each measure gives of one model's rows alone."""
    draw, rows = random.Random(6), []
    for name in ("a", "b"):
        rows += [(name, float(draw.random() < 0.4), draw.choice([0.1, 0.3, 0.5, 0.8]), None, None) for _ in range(60)]
    for name in ("c", "d"):
        rows += [(name, None, None, draw.choice([0.0, 0.2, 0.9]), draw.choice([0.1, 0.5, 0.7])) for _ in range(50)]
    df = spark.createDataFrame(rows, "model string, label double, prob double, target double, pred double")
    got = {r["model"]: r for r in learning.evaluate(df, 10).collect()}
    for name in "ab":
        want = metrics.classification_metrics(df.where(F.col("model") == name)).first()
        assert all(abs(got[name][c] - want[c]) < 1e-12 for c in ("accuracy", "f1", "auc")) and got[name]["ndcg"] is None
    for name in "cd":
        own = df.where(F.col("model") == name)
        want, gain = metrics.spearman_mse(own, "target", "pred").first(), metrics.ndcg_at_k(own, "model", "target", "pred", 10).first()["ndcg"]
        assert all(abs(a - b) < 1e-12 for a, b in ((got[name]["spearman"], want["spearman"]), (got[name]["mse"], want["mse"]), (got[name]["ndcg"], gain))) and got[name]["auc"] is None


def test_embedding_of_lines(spark):
    rows = learning.embed_text(spark.createDataFrame([(1, "a cat sat"), (2, "a cat sat"), (3, "zebra"), (4, "")], "id int, text string")).collect()
    v = {r["id"]: np.array(r["vec"]) for r in rows}
    assert np.allclose(v[1], v[2]) and abs(np.linalg.norm(v[1]) - 1) < 1e-9 and abs(v[1] @ v[3]) < 1e-9 and not v[4].any()


def test_batch_scorer(spark):
    """The loader runs once a task, batches are whole, texts are cut to their first words."""

    def load():
        state = {"loads": 1}
        return lambda texts: [(min(1.0, len(t) / 100), int(len(t) > 5), float(state["loads"] + len(t.split()))) for t in texts]

    score = learning.batch_scorer(load, max_tokens=3)
    rows = spark.createDataFrame([(1, "a b c d e"), (2, "x"), (3, None)], "id int, text string").select("id", score("text").alias("s")).select("id", "s.*").collect()
    assert {r["id"]: (r["viral_label"], r["viral_score"]) for r in rows} == {1: (0, 4.0), 2: (0, 2.0), 3: (0, 1.0)}


def test_common_subsequence_and_meteor(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice("abcd") for _ in range(draw.randint(0, 9))), " ".join(draw.choice("abcd") for _ in range(draw.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, "the cat sat on the mat", "on the mat sat the cat"), (98, "the cat sat", "the cat sat")], "k int, reference string, hypothesis string")

    def lcs(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return int(t[-1, -1])

    got = {r["k"]: r["recall"] for r in pairs.rouge_l(df).collect()}
    assert all(abs(got[k] - (lcs(a.split(), b.split()) / len(a.split()) if a else 0.0)) < 1e-12 for k, a, b in rows)
    m = {r["k"]: r["meteor"] for r in pairs.meteor(df).collect()}
    assert abs(m[98] - (1 - 0.5 / 27)) < 1e-12 and abs(m[99] - (1 - 0.5 * (3 / 6) ** 3)) < 1e-12
    rates = pairs.error_rates(df)
    assert [r["k"] for r in pairs.worst(rates, 3).collect()] == [r["k"] for r in sorted([r for r in rates.collect() if r["wer"] is not None], key=lambda r: (-r["wer"], r["k"]))[:3]]


def test_ranks_within_a_hot_key(spark):
    """Average ranks of one key with nearly all rows, ties and nulls."""
    draw = random.Random(3)
    rows = [("hot" if i % 20 else "cold", None if i % 37 == 0 else float(draw.randint(0, 300))) for i in range(3000)]
    found = metrics.ranked(spark.createDataFrame(rows, "k string, v double"), "v", "k").distinct().collect()
    want = {}
    for k in ("hot", "cold"):
        vs = sorted(v for key, v in rows if key == k and v is not None)
        for v in set(vs):
            want[k, v] = vs.index(v) + (vs.count(v) + 1) / 2
    assert {(r["k"], r["v"]): r["rank_v"] for r in found if r["v"] is not None} == want and all(r["rank_v"] is None for r in found if r["v"] is None)


def test_splits_are_disjoint(spark):
    rows = titles.stratified_split(queries.labelled(spark, "/root/testdata/sf0.001")).cache()
    assert titles.split_overlaps(rows).isEmpty() and rows.count() == queries.labelled(spark, "/root/testdata/sf0.001").count()
    small = spark.createDataFrame([(i, "one" if i == 0 else "many") for i in range(100)], "video_id int, category string")
    assert {r["split"]: r["count"] for r in titles.stratified_split(small).groupBy("split").count().collect()} == {"train": 80, "val": 10, "test": 10}


def test_remaining_sources(spark, tmp_path):
    cols = list(files.TITLE_COLUMNS)
    spark.createDataFrame([tuple(range(9)) + ("extra",)], ", ".join(f"{c} int" for c in cols) + ", other string").write.parquet(f"{tmp_path}/t")
    assert files.read_titles(spark, f"{tmp_path}/t").columns == list(files.TITLE_COLUMNS.values()) and files.read_titles(spark, f"{tmp_path}/t").first()["views"] == "4"
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "doc string, pos int, text string")
    split = rows.withColumn("split", F.when(F.col("doc") == "a", "train").otherwise("test"))
    files.write_splits(split, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/split=train").count() == 1
    (tmp_path / "w_words.json").write_text('[{"word": "hi", "start": 0, "end": 1, "probability": 0.5}]')
    assert files.read_words(spark, f"{tmp_path}/w_words.json").count() == 1
    (tmp_path / "ref.txt").write_text("two\nlines")
    assert files.read_reference_text(spark, f"{tmp_path}/ref.txt").count() == 1


def test_pairs_and_tables(spark):
    rows = spark.createDataFrame([(3, "a", "h"), (1, " ", "h"), (2, "b", None), (4, "c", "h")], "id int, article string, highlights string")
    assert [r["id"] for r in pairs.usable_pairs(rows, 1).collect()] == [3]
    long = spark.createDataFrame([("m", "f1", 0.25), ("n", "f1", 0.75), ("m", "auc", 0.5)], "model string, metric string, value double")
    assert [r["model"] for r in pairs.comparison_table(long, "model", "metric", "value", ["f1", "auc"], "f1").collect()] == ["n", "m"]


def test_documents(spark, tmp_path):
    """Each kind of document; rankings and speech segments come back by their readers."""
    segs = spark.createDataFrame([("d", 1, 2.0, 3.0, "b"), ("d", 0, 0.0, 1.0, "a")], "doc string, id int, start double, end double, text string")
    assert [s["text"] for s in files.json_documents(segs, "segments", "doc").first()["segments"]] == ["a", "b"]
    words = spark.createDataFrame([("d", "w", 0.0, 1.0, 0.123456)], "doc string, word string, start double, end double, probability double")
    assert files.json_documents(words, "words", "doc").first()["words"][0]["probability"] == 0.1235
    vad = files.json_documents(segs.withColumn("total_dur", F.lit(8.0)), "vad", "doc")
    row = vad.first()
    assert (row["total_speech_duration_seconds"], row["speech_ratio"], len(row["speech_segments"])) == (2.0, 0.25, 2)
    clips = spark.createDataFrame([("d", "virality", 2, 1.0, 2.0, "x", 0.5, "s", 4), ("d", "virality", 1, 3.0, 4.0, "y", 0.7, "s", 4), ("d", "combined", 1, 3.0, 4.0, "y", 0.6, "s", 4)], "doc string, list string, rank int, start double, end double, text string, combined_score double, global_summary string, total_scenes int")
    files.write_documents(clips, "rankings", "doc", f"{tmp_path}/r")
    back = files.read_rankings(spark, f"{tmp_path}/r/*.json").collect()
    assert sorted((r["list"], r["rank"], r["text"]) for r in back) == [("combined", 1, "y"), ("virality", 1, "y"), ("virality", 2, "x")]
    found = spark.createDataFrame([("d", 0, 1.0, 2.0, 1.0, None, "no_face")], "doc string, index int, start double, end double, duration double, lip_motion double, label string")
    assert files.json_documents(found, "bloopers", "doc").first()["count"] == 1 and files.json_documents(found, "report", "doc") is found


def test_highlight_with_models(spark):
    """Summary, embedding, detector and reranker in one go; the viral list holds only what the detector calls viral."""
    train = made_titles(spark, 300)
    rows = [(d, i, t) for d in (1, 2) for i, t in enumerate(["wow insane best aaa bbb", "lecture minutes report aaa", "best wow best ccc ddd", "report report lecture eee"])]
    lines = spark.createDataFrame(rows, "doc int, pos int, text string")
    found = highlight.highlight(lines, "doc", "pos", learning.train_detector(train), learning.train_reranker(train), k=3).collect()
    viral = {(r["doc"], r["pos"]) for r in found if r["list"] == "viral"}
    assert viral == {(d, p) for d in (1, 2) for p in (0, 2)} and sum(r["list"] == "relevant" for r in found) == 6 and {r["line_count"] for r in found} == {4}
    assert all(r["viral_score"] is not None and 0 <= r["relevancy"] <= 1 for r in found)


def test_requests_are_checked(spark):
    df = spark.createDataFrame([("transcript", "x" * 40, 0.0, 1.0), ("transcript", "x" * 39, 0.0, 1.0), ("transcript", "  ", 0.0, 1.0), ("mood", "sad", 0.0, 1.0), ("mood", "sad!", 0.0, 1.0), ("clip", "", 2.0, 2.0), ("clip", "", 1.0, 2.0)], "kind string, text string, start double, end double")
    assert [r["reason"] for r in highlight.validate_requests(df).collect()] == [None, "short_transcript", "empty_text", "short_mood_text", None, "empty_span", None]


def test_edit_counts_by_the_whole_table():
    """Totals are least, and the counts fit both lengths, for random token lists."""
    draw = random.Random(9)
    for _ in range(200):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(0, 12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        s, d, n, hits = pairs._edits(a, b)
        assert s + d + n == row[-1] and hits + s + d == len(a) and hits + s + n == len(b)


def test_rejects_of_passes(spark):
    one = spark.createDataFrame([(1, "empty")], "id int, reason string")
    assert clips.union_rejects(one, one.select("reason", "id"), one).count() == 3


def test_highlight_holds_no_vectors(spark, monkeypatch):
    """Vectors are neither written nor shuffled, and relevancies are those of dense vectors of one encoder; lines without words have 1, as before."""
    draw, frames = random.Random(4), []
    rows = [(k, i, "- - ! ?" if draw.random() < 0.1 else " ".join(draw.choice(["wow", "lecture", "best", "Report", "zoo", "hé", "42"]) for _ in range(draw.randint(4, 9)))) for k in range(40) for i in range(draw.randint(1, 9))]
    lines = spark.createDataFrame([*rows, (99, 0, "- - - -")], "doc int, pos int, text string")
    monkeypatch.setattr(highlight, "written", lambda df: frames.append(df) or stages.written(df))
    train = made_titles(spark)
    models = learning.train_detector(train), learning.train_reranker(train)
    got = {(r["doc"], r["pos"]): r for r in highlight.highlight(lines, "doc", "pos", *models, k=100).where("list = 'relevant'").collect()}
    assert len(frames) == 2 and not any("double>" in t or "vector" in t for f in frames for _, t in f.dtypes)
    shuffled = [x for x in frames[1]._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert len(shuffled) == 1 and frames[1].schema["relevancy"].dataType.simpleString() == "double"
    every = lines.select("doc", "pos", "text").union(summaries.summarize_extractive(lines, "doc", "pos").select("doc", F.lit(-1), "summary"))
    v = {(r["doc"], r["pos"]): np.array(r["vec"]) for r in learning.embed_text(every).collect()}
    near = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) if a.any() and b.any() else 1.0
    want = {(k, i): near(v[k, i], v[k, -1]) for k, i, _ in rows if (k, -1) in v}
    assert set(got) == set(want) and all(abs(got[x]["relevancy"] - min(1.0, want[x])) < 1e-4 for x in want)
    assert all(got[k, i]["line_count"] == sum(a == k for a, _, _ in rows) for k, i in got)
    hot = learning.score_detector(models[0], lines.withColumnRenamed("text", "title")).collect()
    assert all(abs(got[r["doc"], r["pos"]]["viral_prob"] - r["viral_prob"]) < 1e-12 for r in hot if (r["doc"], r["pos"]) in got)
