"""Hard negatives by a BOND vertical scan: blocks of vectors stored by dimension, candidates dropped as dimensions are read.

Every STEP dimensions, in falling order of the anchor's magnitudes, the partial inner products of the rows still in the
bitmap grow, and what the dimensions left can add lies between two sums of their smallest and largest values in the block.
Rows whose interval can't reach the places asked for leave the bitmap; those that stay to the last dimension have exact
scores. A first scan finds each anchor's best rows of its own label (a row must reach the least score that as many others
surely have), a second one for each positive the best rows of other labels whose score lies in its window (a row must touch
some window, and reach what as many others surely have in it). Anchors come in tiles, blocks in groups; a task holds one tile
and one block at a time and keeps each list's best so far, which the next block's rows must reach. So each anchor meets each
row, in blocks; what leaves a task is a few rows an anchor.

Components are floor(256 x), held within +-2^24 so that sums fit a long; missing ones of a shorter vector count 0.
Rows without id, label or vector, or with a component that is null or not finite, take no part. Of rows that share an id
one counts, that of the smallest label, then vector. Ties of score go by the smaller id. Without other rows of an anchor's
label, or none in a window, there are no rows for it; an empty table gives an empty result. Other columns aren't read.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

BEST, LOW, HIGH = 5, 80, 100
ROWS, ANCHORS, GROUPS, STEP, LIMIT = 2048, 256, 64, 8, 1 << 24


def numbered(rows: DataFrame, id_col: str = "vec_id", label: str | Column = "label", vector: str = "embedding") -> DataFrame:
    """id, label, x: usable rows with whole-number components, one an id."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * 256), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    own = rows.select(F.col(id_col).alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), x.alias("v"), whole.alias("x"))
    odd = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return own.where("id is not null and label is not null and v is not null").where(~odd).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")


def _columnar(rows: pa.Table, width: int) -> pa.Table:
    """One row a block: its values by dimension, and the least and largest of each dimension."""
    ids = rows["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x = np.zeros((len(ids), width), np.int32)
    for k, v in enumerate(rows["x"].to_pylist()):
        x[k, : len(v)] = v
    x = np.ascontiguousarray(x[order].T)
    least, most = (x.min(1), x.max(1)) if width else (x.reshape(0), x.reshape(0))
    one = lambda a, kind: pa.array([a], pa.list_(kind))
    return pa.table({"block": rows["block"].slice(0, 1), "ids": one(ids[order], pa.int64()), "labels": one(rows["label"].to_numpy()[order], pa.int64()), "x": one(x.reshape(-1), pa.int32()), "least": one(least, pa.int32()), "most": one(most, pa.int32())})


def blocks_of(rows: DataFrame, width: int, n: int, size: int = ROWS) -> DataFrame:
    """Blocks of about `size` rows each, dealt by hash of the id."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // size)))))
    return durable(dealt.groupBy("block").applyInArrow(lambda rows: _columnar(rows, width), "block long, ids array<long>, labels array<long>, x array<int>, least array<int>, most array<int>"))


def _kth(x: np.ndarray, k: int):
    """The k-th largest of x; below everything where x has fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


class _List:
    """The k best (score, id) so far, of scores from floor to top."""

    def __init__(self, k: int, floor=-np.inf, top=np.inf):
        self.k, self.floor, self.top, self.score, self.id = k, floor, top, np.empty(0, np.int64), np.empty(0, np.int64)

    def needed(self, low: np.ndarray, high: np.ndarray):
        """The least score that can still enter, if scores lie between low and high."""
        sure = low[(low >= self.floor) & (high <= self.top)]
        return max(self.floor, _kth(self.score, self.k), _kth(sure, self.k))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        ok = (score >= self.needed(score, score)) & (score <= self.top)
        score, ids = np.concatenate((self.score, score[ok])), np.concatenate((self.id, ids[ok]))
        best = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[best], ids[best]


def _scan(q: np.ndarray, x: np.ndarray, least: np.ndarray, most: np.ndarray, may: np.ndarray, lists: list[_List]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block whose rows may enter some list, and their exact scores."""
    order = np.argsort(-np.abs(q), kind="stable")
    left = np.sort(np.stack((q * least, q * most)), axis=0)[:, order]
    left = np.concatenate((np.cumsum(left[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), left.dtype)), axis=1)  # what dimensions from here on can add
    at, score = np.flatnonzero(may), np.zeros(int(may.sum()), x.dtype)
    for k in range(0, len(q), STEP):
        dims = order[k : k + STEP]
        score = score + q[dims] @ x[dims][:, at]
        low, high = left[:, min(k + STEP, len(q))]
        low, high = score + low, score + high
        alive = np.zeros(len(at), bool)
        for one in lists:
            alive |= (high >= one.needed(low, high)) & (low <= one.top)
        at, score = at[alive], score[alive]
        if not len(at):
            break
    return at, score


def _tile(batches, width: int, same: bool, k: int, low: int, high: int):
    """Best rows of each list of a tile's anchors, over a run of blocks that meet it."""
    tile, lists = None, []

    def out():
        rows = [(a, p, i, s) for a, own in lists for p, one in own for s, i in zip(one.score.tolist(), one.id.tolist())]
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "positive_score", "id", "score"])

    for b in batches:
        for r in range(len(b)):
            row = {c: b.column(c)[r] for c in b.schema.names}
            if tile != (now := (row["tile"].as_py(), row["group"].as_py())):
                if tile:
                    yield out()
                tile, lists = now, []
                anchors, own_label = row["anchors"].values.to_numpy(), row["anchor_labels"].values.to_numpy()
                q_all = row["anchor_x"].values.to_numpy().reshape(-1, width).astype(np.int64)
                for a, scores in zip(anchors.tolist(), row["scores"].as_py()):
                    lists.append((a, [(None, _List(k))] if same else [(p, _List(k, -(-low * p // 100), high * p // 100)) for p in sorted(set(scores))]))
            ids, labels = row["ids"].values.to_numpy(), row["labels"].values.to_numpy()
            x = row["x"].values.to_numpy().reshape(width, len(ids))
            least, most = row["least"].values.to_numpy().astype(np.int64), row["most"].values.to_numpy().astype(np.int64)
            top = int(max([0, *np.abs(least), *np.abs(most)])) * int(np.abs(q_all).max(initial=0)) * width
            kind = np.float64 if top < 1 << 52 else np.int64  # either is exact; the first is faster
            x, least, most = x.astype(kind), least.astype(kind), most.astype(kind)
            for q, label, (a, own) in zip(q_all.astype(kind), own_label.tolist(), lists):
                if not own:
                    continue
                may = (labels == label) & (ids != a) if same else labels != label
                at, score = _scan(q, x, least, most, may, [one for _, one in own])
                for _, one in own:
                    one.add(score.astype(np.int64), ids[at])
    if tile:
        yield out()


def _met(blocks: DataFrame, anchors: DataFrame, n_anchors: int, n_blocks: int, width: int, same: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """anchor_id, positive_score, id, score: the k best rows of each list; anchors are id, label, x (of the width), scores."""
    tiles, groups = max(1, -(-n_anchors // ANCHORS)), min(n_blocks, GROUPS)
    dealt = anchors.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles))).groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("id", "label", "x", "scores"))).alias("a"))
    dealt = dealt.select("tile", F.col("a.id").alias("anchors"), F.col("a.label").alias("anchor_labels"), F.flatten("a.x").alias("anchor_x"), F.col("a.scores").alias("scores"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.withColumn("group", F.pmod("block", F.lit(groups))).withColumn("tile", every(tiles))
    both = left.join(dealt.withColumn("group", every(groups)), ["tile", "group"])
    found = both.select("tile", "group", "ids", "labels", "x", "least", "most", "anchors", "anchor_labels", "anchor_x", "scores")
    found = found.mapInArrow(partial(_tile, width=width, same=same, k=k, low=low, high=high), "anchor_id long, positive_score long, id long, score long")
    own = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "id")  # at most k rows of each group of blocks
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, k_positive: int = BEST, k_negative: int = BEST, low: int = LOW, high: int = HIGH) -> DataFrame:
    """rows are id, label, x (see `numbered`). anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives are an anchor's k_positive best other rows of its label; negatives of a positive the k_negative best rows of
    other labels whose score is from low to high per cent of the positive's."""
    rows = durable(rows)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    padded = F.concat("x", F.array_repeat(F.lit(0), F.lit(width) - F.size("x")))
    anchors = durable(rows.where(is_anchor).select("id", "label", padded.alias("x")))
    n_anchors, n_blocks = anchors.count(), max(1, -(-n // ROWS))
    blocks = blocks_of(rows, width, n)
    met = _met(blocks, anchors.withColumn("scores", F.array().cast("array<long>")), n_anchors, n_blocks, width, True, k_positive)
    positives = durable(met.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = anchors.join(positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores")), "id")
    found = _met(blocks, asked, n_anchors, n_blocks, width, False, k_negative, low, high)
    found = found.select("anchor_id", "positive_score", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    return positives.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(numbered(table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)


ORACLE_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
