"""Toxicity by cumulative-link ordinal regression.

The model is P(grade >= k) = sigmoid(w x - theta_k), k = 1..K, with one weight vector for all ordered
thresholds. Features are distinct words and stems of several distinct words; the vocabulary is learned:
features that are over LIFT log odds more common in labelled toxic documents than in others. It is fitted
on at most MAX_LABELLED labelled documents; every document is scored on its whole text. The result is the
expected severity and whether P(grade >= 1) is at least 0.5.

Grades are the labels themselves where these go beyond 1. Where labels are 0 and 1 alone, toxic documents
get a second grade by how much of their text is toxic: the share of tokens among the marked words is above
that of the median toxic document. The words that grade a document are learned on the other half of the
sample (by row), so no document's grade depends on features that its own label chose.

Null and empty texts have no features. Null labels are left out. Without labels of both classes nothing
is toxic. Repeated rows and rows without an id each get a row, by their own text; an empty table gives an
empty result. Other columns aren't read; `keep_clean` hands all columns through.
"""

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .models import Features, Sparse, adam, sample_rows, sigmoid, stem_steps
from .parts import slices

WORD = re.compile(r"\w+")
MAX_LABELLED, LIFT, LEAST, L2 = 8192, 1.5, 3, 5e-5


def features(text: str) -> set[str]:
    """Distinct lower-case words, and stems that several of them share."""
    words = set(WORD.findall(text.lower()))
    return words | stem_steps(words)


def marked(found: Features, toxic: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Features more common in the toxic rows among some than in the others."""
    up, down = found.counts(toxic & some), found.counts(~toxic & some)
    odds = np.log((up + 0.5) / ((toxic & some).sum() + 1)) - np.log((down + 0.5) / ((~toxic & some).sum() + 1))
    return np.flatnonzero((up >= LEAST) & (odds > LIFT))


def grades(found: Features, texts_: list[str], label: np.ndarray) -> np.ndarray:
    """The labels; binary ones get a second grade from the words of the other half of the sample."""
    if label.max() > 1:
        return label
    half, share = np.arange(len(label)) % 2 == 0, np.zeros(len(label))
    for own in (half, ~half):
        words = {found.names[i] for i in marked(found, label > 0, ~own)}
        for i in np.flatnonzero(own & (label > 0)):
            tokens = WORD.findall(texts_[i].lower())
            share[i] = sum(t in words for t in tokens) / max(1, len(tokens))
    return np.where(label > 0, 1 + (share > np.median(share[label > 0])), 0)


def fit_grades(x: Sparse, grade: np.ndarray, l2: float = L2, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model."""
    levels, width = range(1, grade.max() + 1), x.width

    def split(p):  # thresholds stay ordered: each is the one before plus a positive step
        return p[:width], np.cumsum(np.append(p[width], np.exp(p[width + 1 :])))

    def grad(p):
        w, theta = split(p)
        s = sigmoid(x.dot(w)[None, :] - theta[:, None])
        s = np.vstack([np.ones(x.n), s, np.zeros(x.n)])
        d, at = s * (1 - s), np.arange(x.n)
        like = np.maximum(s[grade, at] - s[grade + 1, at], 1e-9)
        g = -(d[grade, at] - d[grade + 1, at]) / like / x.n
        t = np.array([(np.where(grade == k, d[k], 0) - np.where(grade == k - 1, d[k], 0)) / like / x.n for k in levels]).sum(1)
        step = [t.sum(), *[t[j:].sum() * np.exp(p[width + j]) for j in range(1, len(levels))]]
        return np.concatenate([x.back(g) + l2 * w, step])

    return split(adam(grad, np.concatenate([np.zeros(width), [1.0], np.zeros(len(levels) - 1)]), steps))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict | None:
    rows = sample_rows(docs, labels, "toxic", most, ["text"])
    label = np.array([max(0, r["y"]) for r in rows], np.int64)
    if not (label > 0).any() or not (label == 0).any():
        return None
    whole = [r["text"] or "" for r in rows]
    found = Features(map(features, whole))
    vocab, x = found.keep(marked(found, label > 0, np.ones(len(label), bool)))
    w, theta = fit_grades(Sparse(x, max(1, len(vocab))), grades(found, whole, label))
    return {"vocab": vocab, "w": w, "theta": theta}


def _levels(model: dict | None, text: str) -> np.ndarray:
    """P(grade >= k) for each k."""
    if model is None:
        return np.zeros(1)
    vocab = model["vocab"]
    return sigmoid(model["w"][[vocab[t] for t in features(text) if t in vocab]].sum() - model["theta"])


def _score(batches, model: dict | None):
    for b in slices(batches):
        at = [_levels(model, t) for t in b.column(1).to_pylist()]
        sums, first = [round(float(a.sum()), 6) for a in at], [round(float(a[0]), 6) for a in at]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.float64()), pa.array(first, pa.float64())], ["doc_id", "severity", "p_toxic"])


def grade_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, toxic."""
    model, rows = fit(docs, labels), texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_score, model=model), f"doc_id {kind}, severity double, p_toxic double").withColumn("toxic", F.col("p_toxic") >= 0.5)


def _keep(batches, model: dict | None):
    for b in slices(batches):
        yield b.filter(pa.array([bool(round(float(_levels(model, t or "")[0]), 6) < 0.5) for t in b.column("text").to_pylist()], pa.bool_()))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't call toxic; each row is judged by itself."""
    return docs.mapInArrow(partial(_keep, model=fit(docs, labels)), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
