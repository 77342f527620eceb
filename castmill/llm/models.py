"""Features and fitting that both classifiers share: a bounded labelled sample, sparse presence features, logistic fits."""

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")
SAMPLE_CHARS = 16 << 20


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, columns: list[str], most_chars: int = SAMPLE_CHARS) -> list:
    """The fitting sample: labelled documents in order of their id's hash, at most `most` of them and most_chars characters.

    Both bounds are parameters. Ids are chosen first, so only the chosen texts travel, each whole. Rows are
    doc_id, y (the label, the largest of several), then the columns; one row per id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    own = docs.select("doc_id", *columns)
    # At most `most` ids are broadcast and summed up in order.
    first = known.join(own.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    first = first.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    first = first.select("doc_id", "y", so_far.alias("so_far")).where(F.col("so_far") <= most_chars).drop("so_far")
    rows = own.join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), *[F.first(c).alias(c) for c in columns])
    return rows.orderBy("doc_id").collect()


class Features:
    """Sets of features as numbers; a feature's name is held once."""

    def __init__(self, sets: Iterable[set[str]]):
        number: dict[str, int] = {}
        self.rows = [np.fromiter((number.setdefault(t, len(number)) for t in s), np.int32) for s in sets]
        self.names = list(number)

    def keep(self, chosen: np.ndarray) -> tuple[dict[str, int], list[np.ndarray]]:
        """Names and rows of the chosen features alone, numbered anew."""
        to = np.full(len(self.names), -1, np.int64)
        to[chosen] = np.arange(len(chosen))
        rows = [np.sort(to[r][to[r] >= 0]) for r in self.rows]
        return {self.names[i]: k for k, i in enumerate(chosen.tolist())}, rows

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """In how many of the masked rows each feature stands."""
        some = [r for r, m in zip(self.rows, mask) if m]
        return np.bincount(np.concatenate([np.empty(0, np.int32), *some]), minlength=len(self.names))


class Sparse:
    """Rows of feature numbers, all with value 1."""

    def __init__(self, rows: list, width: int):
        self.width, self.n = width, len(rows)
        self.col = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def adam(grad, x: np.ndarray, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit_logistic(x: Sparse, y: np.ndarray, l2: float = 1e-3, start: np.ndarray | None = None, steps: int = 200) -> np.ndarray:
    """Weights and, last, the intercept; from start where there is one."""

    def grad(w):
        g = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / max(1, len(y))
        return np.append(x.back(g) + l2 * w[:-1], g.sum())

    return adam(grad, np.zeros(x.width + 1) if start is None else start, steps)


def fit_platt(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept of calibrated log odds; smoothed targets, so separable scores stay finite."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t = np.where(y > 0, up, down)

    def grad(p):
        g = sigmoid(p[0] * score + p[1]) - t
        return np.array([(g * score).mean(), g.mean()])

    return adam(grad, np.array([1.0, 0.0]))


def stem_steps(words: set[str], sizes: tuple[int, ...] = (5, 7)) -> set[str]:
    """For each stem (first letters) of two or more distinct words: that there are so many, by doubling steps."""
    out = set()
    for size in sizes:
        for stem, n in Counter(w[:size] for w in words if len(w) > size).items():
            if n > 1:
                out.update(f"{stem}*{1 << k}" for k in range(1, n.bit_length()))
    return out
