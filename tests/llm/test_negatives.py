import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from castmill.llm import negatives


def brute(rows, anchor, k=5, low=80, high=100):
    """rows of id, label, whole-number vector."""
    out = set()
    for a, label, q in rows:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for i, l, v in rows if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:k]:
            inside = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out |= {(a, i, r, s[1], -p, -s[0]) for r, s in enumerate(inside[:k], 1)}
    return out


def found(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_by_brute_force(spark, monkeypatch, seed):
    """Several blocks, groups and tiles; negative scores, ties by the hundred, copies of one vector, shorter vectors."""
    for name, value in (("ROWS", 40), ("ANCHORS", 7), ("GROUPS", 3), ("STEP", 3)):
        monkeypatch.setattr(negatives, name, value)
    draw = random.Random(seed)
    rows = [(i, draw.randrange(3), [draw.gauss(0.3, 1) for _ in range(11)]) for i in range(250)]
    rows += [(i, draw.randrange(3), [1.0] * 11) for i in range(250, 400)] + [(i, 1, [0.5] * draw.randrange(4)) for i in range(400, 420)]
    whole = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, id string, score int")
    got = found(negatives.hard_negatives(negatives.numbered(df), F.col("id") % 10 == 0))
    assert got == brute(whole, lambda i: i % 10 == 0) and len(got) > 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.5]), (2, 2, [1.0, 1.25]), (3, None, [9.0, 9.0]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [nan, 1.0]), (7, 1, [inf, 1.0]), (None, 1, [1.0, 1.0]), (2, 2, [1.0, 1.25]), (8, 2, []), (9, 2, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = found(negatives.hard_negatives(negatives.numbered(df), F.col("id") % 100 == 0))
    assert got == {(0, 1, 1, 2, 256 * 256 + 512 * 384, 256 * 256 + 512 * 320)}
    big = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30]), (2, 2, [6e4])], "vec_id long, label int, embedding array<double>")
    assert found(negatives.hard_negatives(negatives.numbered(big), F.col("id") == 0)) == {(0, 1, 1, 2, 1 << 48, (1 << 24) * 256 * 60000)}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert found(negatives.hard_negatives(negatives.numbered(df), F.col("id") % 100 == 0)) == set()
    alone = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert found(negatives.hard_negatives(negatives.numbered(alone), F.col("id") % 100 == 0)) == set()


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.1"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = c.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({negatives.ORACLE_SQL})").fetchall()
    assert found(negatives.op12_negatives(spark, d)) == set(want) and len(want) > 100
