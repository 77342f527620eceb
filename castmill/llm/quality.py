"""Quality classifier by co-training of two views.

The text view has the words of the text and what kinds of tokens it is made of; the page view has metadata
alone: language, source and size. Each view is a logistic model, first fitted on at most MAX_LABELLED
labelled documents. Then, over ROUNDS rounds, every other document of the corpus is scored by both
views; of each view the SHARE it is surest of (at least SURE log odds) get its verdict as pseudo-label, by
cutoffs on a histogram of all scores, and teach the other view; a view that isn't so sure of rows of both classes
teaches nothing in that round. So pseudo-labelled rows grow with the input:
they are dealt over tasks of about ROWS_A_TASK rows, each task fits on the labelled sample and its own rows,
and the fits are averaged by rows. Both views are then calibrated on a labelled holdout (every fourth
labelled row); as the views are taken to be independent given the class, the calibrated log odds are added
and the prior taken off once. Every document is scored on its whole text.

Null texts are empty; null metadata is a value of its own. Null labels are left out; of several labels
of a document the largest counts. Repeated rows and rows without an id each get a row, by their own text.
Without labels of both classes every score is 0.5, and documents at 0.5 or more are kept. An empty table
gives an empty result. Other columns aren't read; `keep_good` hands all columns through.
"""

from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, scratch, table
from .models import TOKEN, Features, Sparse, fit_logistic, fit_platt, sample_rows, sigmoid
from .parts import slices

MAX_LABELLED, ROUNDS, SHARE, SURE, VOCABULARY = 4096, 3, 0.1, 2.0, 20_000
PAGE, ROWS_A_TASK, BIN = 1024, 20_000, 0.1
COLUMNS = ["text", "lang", "source", "n_chars"]


def steps(x: float, n: int = 10) -> int:
    return int(min(max(x, 0), 1) * n)


def text_view(text: str) -> set[str]:
    """Words; how many tokens are upper case, marks, or repeats, in steps."""
    found = TOKEN.findall(text)
    n, low = max(1, len(found)), TOKEN.findall(text.lower())
    own = set(low)
    upper = sum(map(str.isupper, found)) / n
    marks = sum(not t[0].isalnum() for t in found) / n
    wide = sum(len(t) > 2 for t in own if not t[0].isalnum())
    own.update((f"\tupper{steps(upper)}", f"\tmarks{steps(marks)}", f"\tunique{steps(len(own) / n)}", f"\twide{wide.bit_length()}"))
    return own


def page_view(lang, source, n_chars) -> list[int]:
    """Hashed metadata: language, source, size, and these two and three together."""
    size = int(n_chars or 0).bit_length()
    raw = [f"lang={lang}", f"source={source}", f"chars={size}", f"lang={lang}&chars={size}", f"lang={lang}&source={source}", f"source={source}&chars={size}", f"lang={lang}&source={source}&chars={size}"]
    return sorted({crc32(x.encode()) % PAGE for x in raw})


def _numbers(text: str, vocab: dict[str, int]) -> list[int]:
    return sorted(vocab[t] for t in text_view(text) if t in vocab)


def _views(batches, vocab: dict[str, int], sample: set):
    for b in slices(batches):
        words, pages = [], []
        for doc_id, text, lang, source, n_chars in zip(*[c.to_pylist() for c in b.columns]):
            if doc_id in sample:
                continue
            words.append(_numbers(text or "", vocab)), pages.append(page_view(lang, source, n_chars))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array(pages, pa.list_(pa.int32()))], ["words", "page"])


def _dots(column: pa.Array, w: np.ndarray) -> np.ndarray:
    """Score of each row of feature numbers."""
    return Sparse([r.values.to_numpy() for r in column], len(w) - 1).dot(w[:-1]) + w[-1]


def _scores(batches, models: list[np.ndarray], plates: list[np.ndarray]):
    for b in slices(batches):
        odds = [p[0] * _dots(c, w) + p[1] for c, w, p in zip(b.columns, models, plates)]
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, odds)], ["words", "page", "o_words", "o_page"])


def _fit_share(batches, rows: list, y: np.ndarray, start: np.ndarray):
    """Fit on the labelled rows and the pseudo-labelled ones of this task; each weight times the latter's number."""
    more, z = [], []
    for b in slices(batches):
        more += [r.values.to_numpy().astype(np.int32) for r in b.column(0)]
        z += b.column(1).to_pylist()
    if more:
        w = fit_logistic(Sparse([*rows, *more], len(start) - 1), np.concatenate((y, z)), start=start, steps=60)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at] * len(more))], ["at", "w"])


def _cutoffs(scored: DataFrame, name: str, share: float, good: float) -> tuple[float, float] | None:
    """Log odds below the one and from the other on belong to the surest share of all rows, bad and good in proportion, and to SURE at least.

    None where the view is so sure of rows of one class alone, or of none: it would teach that class whatever it sees."""
    bins = scored.groupBy(F.floor(F.col(name) / BIN).alias("bin")).count().orderBy("bin").collect()  # as many rows as scores have bins
    if not bins:
        return None
    at, n = np.array([r["bin"] for r in bins], float), np.cumsum([r["count"] for r in bins])
    low = at[np.searchsorted(n, n[-1] * share * (1 - good))] + 1
    high = at[min(len(at) - 1, np.searchsorted(n, n[-1] * (1 - share * good)))]
    low, high = min(low * BIN, -SURE), max(high * BIN, SURE)
    return (low, high) if (at[0] + 1) * BIN <= low and at[-1] * BIN >= high else None


def _calibrate(views: list, widths: list[int], models: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
    """Slope and intercept of each view's log odds on the holdout."""
    if not held.any():
        return [np.array([1.0, 0.0]) for _ in views]
    return [fit_platt((Sparse([r for r, h in zip(v, held) if h], n).dot(w[:-1]) + w[-1]), y[held]) for v, n, w in zip(views, widths, models)]


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, rounds: int = ROUNDS) -> dict | None:
    rows = sample_rows(docs, labels, "quality", most, COLUMNS)
    y = np.array([int(r["y"] > 0) for r in rows])
    if not (y == 1).any() or not (y == 0).any():
        return None
    words = Features(text_view(r["text"] or "") for r in rows)
    df = words.counts(np.ones(len(rows), bool))
    common = np.flatnonzero(df >= 3)
    vocab, own = words.keep(common[np.argsort(-df[common], kind="stable")][:VOCABULARY])
    views, widths = [own, [np.array(page_view(r["lang"], r["source"], r["n_chars"])) for r in rows]], [max(1, len(vocab)), PAGE]
    held = np.arange(len(rows)) % 4 == 3
    if not all((y[m] == k).any() for m in (held, ~held) for k in (0, 1)):
        held[:] = False
    train = [[r for r, h in zip(v, held) if not h] for v in views]
    models = [fit_logistic(Sparse(v, w), y[~held]) for v, w in zip(train, widths)]
    plates = _calibrate(views, widths, models, y, held)

    with scratch(docs.sparkSession):
        # The ids of the sample, at most `most`, go with the function; so no text is shuffled.
        pool = docs.select("doc_id", *COLUMNS).mapInArrow(partial(_views, vocab=vocab, sample={r["doc_id"] for r in rows}), "words array<int>, page array<int>")
        pool = durable(pool) if rounds else pool
        for _ in range(rounds):
            with scratch(docs.sparkSession):
                scored = durable(pool.mapInArrow(partial(_scores, models=models, plates=plates), "words array<int>, page array<int>, o_words double, o_page double"))
                taught = list(models)
                for k, (feature, teacher) in enumerate((("words", "o_page"), ("page", "o_words"))):
                    cut = _cutoffs(scored, teacher, SHARE, y.mean())
                    if cut is None:
                        continue
                    sure = scored.where((F.col(teacher) < cut[0]) | (F.col(teacher) >= cut[1])).select(feature, (F.col(teacher) > 0).cast("int").alias("y"))
                    n = sure.count()
                    own = sure.repartition(1 + n // ROWS_A_TASK).mapInArrow(partial(_fit_share, rows=train[k], y=y[~held], start=models[k]), "at int, w double")
                    taught[k] = np.zeros_like(models[k])
                    for r in own.groupBy("at").agg(F.sum("w").alias("w")).collect():  # at most a row a feature
                        taught[k][r["at"]] = r["w"] / n
                models = taught
            plates = _calibrate(views, widths, models, y, held)
    prior = y[held].mean() if held.any() else y.mean()
    return {"vocab": vocab, "models": models, "plates": plates, "prior": float(np.log(prior / (1 - prior)))}


def _probabilities(model: dict | None, text, lang, source, n_chars) -> tuple[float, float, float]:
    if model is None:
        return 0.5, 0.5, 0.5
    views = _numbers(text or "", model["vocab"]), page_view(lang, source, n_chars)
    odds = [p[0] * (w[v].sum() + w[-1]) + p[1] for p, w, v in zip(model["plates"], model["models"], views)]
    return tuple(round(float(sigmoid(z)), 6) for z in (*odds, sum(odds) - model["prior"]))


def _score(batches, model: dict | None):
    for b in slices(batches):
        found = [_probabilities(model, *r) for r in zip(*[c.to_pylist() for c in b.columns[1:]])]
        cols = list(zip(*found)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64()) for c in cols]], ["doc_id", "p_text", "p_page", "p_quality"])


def classify_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, p_text, p_page, p_quality, kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *COLUMNS)
    return rows.mapInArrow(partial(_score, model=fit(docs, labels, rounds=rounds)), f"doc_id {kind}, p_text double, p_page double, p_quality double").withColumn("kept", F.col("p_quality") >= 0.5)


def _keep(batches, model: dict | None):
    for b in slices(batches):
        rows = zip(*[b.column(c).to_pylist() for c in COLUMNS])
        yield b.filter(pa.array([_probabilities(model, *r)[2] >= 0.5 for r in rows], pa.bool_()))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps; each row is judged by itself."""
    return docs.mapInArrow(partial(_keep, model=fit(docs, labels)), docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
