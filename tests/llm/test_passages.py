import hashlib
import random

import pytest

from castmill.llm import passages, queries


def brute(rows, window):
    """doc_id, words, words removed, kept text, by a dictionary of all windows."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1 if i is not None else 0):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


@pytest.mark.parametrize(("crowd", "long"), [(2000, 10_000), (1, 10_000), (2000, 5)])
def test_by_brute_force(spark, monkeypatch, crowd, long):
    """Copies, near copies, shared passages in other surroundings, runs of one word, marks and spaces; all three ways of counting."""
    monkeypatch.setattr(passages, "CROWD", crowd)
    monkeypatch.setattr(passages, "LONG", long)
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcé") for _ in range(draw.randint(1, 3)))
    text = lambda n: [word() for _ in range(n)]
    passage, rows = [text(30), text(15), text(12)], []
    for i in range(120):
        words = text(draw.randint(0, 40))
        for p in draw.choices(passage, k=draw.randint(0, 3)):
            a = draw.randint(0, 3)
            words += p[a:] + text(draw.randint(0, 5))
        rows.append((i, words))
    rows += [(200 + i, rows[draw.randrange(100)][1]) for i in range(20)] + [(300 + i, w[:k] + ["new"] + w[k + 1 :]) for i, (_, w) in enumerate(rows[:30]) for k in (len(w) // 2,)]
    rows += [(400, ["x"] * 500), (401, ["x"] * 300 + ["y"] + ["x"] * 40), (90, ["x"] * 11)]
    rows = [(i, draw.choice((" ", "\n", "\t ", "\x0b")).join(w)) for i, w in rows]
    rows += [(None, rows[-3][1]), (500, None), (501, ""), (502, "   "), (400, rows[0][1]), rows[5], rows[5], (503, "  " * 12 + " ")]
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, start int, least long, key string").repartition(5)
    want = brute(rows, 12)
    assert found(passages.remove_repeats(docs, window=12, mer=4)) == want and sum(r[2] for r in want) > 2000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert passages.remove_repeats(docs).collect() == []


def test_long_text(spark):
    """A million words, a half of which stands in a smaller document."""
    draw = random.Random(1)
    words = [str(draw.randrange(10**6)) for _ in range(1_000_000)]
    docs = spark.createDataFrame([(1, " ".join(words[:500_000])), (2, " ".join(words))], "doc_id long, text string")
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in passages.remove_repeats(docs).collect()} == {(1, 500_000, 0), (2, 1_000_000, 500_000)}


def test_query_by_brute_force(spark, sf_dir):
    """The query over whole tables."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, 50)), key=str)
    got = sorted((tuple(r) for r in queries.QUERIES["op13_passages"](spark, sf_dir).collect()), key=str)
    assert got == want and sum(r[2] for r in want) > 1000
