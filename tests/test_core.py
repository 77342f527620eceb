import duckdb
import pytest

from castmill.operators import intervals, metrics, titles, transcripts
from castmill.plans import media, queries
from castmill.plans import pairs as pair_queries
from castmill.plans import titles as title_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sf_dir():
    """The smallest tables; the driver compares the same pairs on larger ones."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


SQL = queries.ORACLE_SQL | pair_queries.ORACLE_SQL | title_queries.ORACLE_SQL | media.ORACLE_SQL
QUERIES = queries.QUERIES | pair_queries.QUERIES | title_queries.QUERIES | media.QUERIES


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    cols = sorted(found.columns)
    got = [tuple(r) for r in found.select(cols).collect()]
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert len(got) == len(want) and sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize(
    ("speech", "total", "args", "want"),
    [
        ([(1.0, 2.0), (2.2, 3.0), (5.0, 6.0)], 8.0, {}, [(0.1, 0.9), (3.1, 4.9), (6.1, 7.9)]),
        ([], 8.0, {}, [(0.1, 7.9)]),
        ([(0.0, 5.0), (1.0, 2.0), (5.1, 8.0)], 8.0, {"min_dur": 0.0}, []),
        ([(1.0, 2.0), (2.5, 3.0)], 3.0, {"min_dur": 0.0, "gap": 0.5}, [(0.1, 0.9), (2.1, 2.4)]),
    ],
)
def test_nonspeech(spark, speech, total, args, want):
    spans = spark.createDataFrame([(1, a, b) for a, b in speech], "recording_id int, start double, end double")
    found = intervals.nonspeech_spans(spans, spark.createDataFrame([(1, total)], "recording_id int, total_dur double"), **args)
    assert sorted((r["start"], r["end"]) for r in found.collect()) == want


def test_sanitize(spark):
    rows = [(0, 0.0, 0.0, "hi"), (1, 0.0, 1.0, "  "), *[(i, 5.0, 6.0, "real words") for i in range(2, 7)], (7, 7.0, 8.0, "hahahaha"), (8, 10.0, 10.05, "a word")]
    rows += [(9 + i, 10.1 + i / 10, 10.15 + i / 10, "a word") for i in range(8)] + [(17, 11.0, 12.0, "fine words")]
    found = transcripts.sanitize(spark.createDataFrame([("t", *r) for r in rows], "transcript_id string, id long, start double, end double, text string"))
    got = {r["id"]: r["reason"] for r in found.collect()}
    want = {0: "empty_or_zero_duration", 1: "empty_or_zero_duration", 2: None, **dict.fromkeys(range(3, 7), "duplicate_timestamp_run"), 7: "char_repetition_loop", 8: None, **dict.fromkeys(range(9, 17), "density_explosion"), 17: None}
    assert got == want


def test_rebase(spark):
    words = spark.createDataFrame([(1, 9.0, 10.5), (1, 9.5, 10.5), (1, 12.0, 12.0), (1, 19.9, 20.3), (1, 20.0, 21.0)], "recording_id int, start double, end double")
    found = intervals.rebase_words(words, spark.createDataFrame([(1, 10.0, 20.0)], "recording_id int, span_start double, span_end double"))
    assert sorted((r["start"], r["end"]) for r in found.collect()) == [(0.0, 0.5), (2.0, 2.0)]


def test_percentile_and_dedup(spark):
    rows = [("a", x) for x in (0.1, 0.2, 0.2, 0.3, 0.3)] + [("b", 0.5)]
    df = spark.createDataFrame([(c, 10.0, x * 10, 0.0) for c, x in rows], "category string, views double, likes double, comments double")
    got = sorted((r["category"], round(r["viral_score"], 6), r["viral_label"]) for r in titles.viral_labels(df).collect())
    assert [g[1] for g in got] == [0.2, 0.5, 0.5, 0.9, 0.9, 1.0] and [g[2] for g in got] == [0, None, None, 1, 1, 1]


def test_ndcg(spark):
    df = spark.createDataFrame([(1, 0.9, 0.2), (1, 0.5, 0.9), (1, 0.1, 0.5)], "k int, t double, p double")
    assert abs(metrics.ndcg_at_k(df, "k", "t", "p").first()["ndcg"] - 0.800569809515689) < 1e-12
