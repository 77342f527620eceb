import random
import re
from collections import Counter
from zlib import crc32

import pytest

from castmill.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), None if form[w] is None else counts[form[w]]) for w in counts}


def words_of(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def found(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("crowd", [spelling.CROWD, 3])
def test_groups_by_brute_force(spark, monkeypatch, crowd):
    """Random words over few letters, so many near ones, repeats of one letter and accents; also where every chunk is crowded."""
    monkeypatch.setattr(spelling, "CROWD", crowd)
    draw = random.Random(7)
    counts = {"".join(draw.choice("abé") for _ in range(draw.randint(7, 9))): draw.choice((2, 3, 25, 300, 4000)) for _ in range(500)}
    counts |= {"a" * n: 2 for n in range(7, 14)} | {"x" * 300: 2, "x" * 299 + "y": 40, "x" * 256: 2, "x" * 257: 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.group_variants(words)) == brute(counts)


def test_chain_of_forms(spark):
    """Eighteen forms one after the other, each ten times as frequent."""
    counts = {"z" * k + "abcdefgh": 2 * 10 ** (18 - k) for k in range(1, 18)}
    got = found(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and {r[2] for r in got} == {"zabcdefgh"}


def test_texts_by_brute_force(spark):
    """Nulls in id and text, empty, long and repeated texts, clashing column names; crc32 takes letters out."""
    draw = random.Random(3)
    base = ["international", "Überraschung", "naïveté", "straßenbahn", "information"]
    rows = [(i, " ".join(draw.choices(base, k=40)) + " INFORMATION x") for i in range(200)]
    rows += [(None, "information naïveté"), (5, None), (6, ""), (7, "information" * 5000), (7, "information" * 5000), *rows[:3]]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    want = words_of(rows)
    assert found(spelling.group_variants(spelling.spoiled_words(docs))) == brute(want) and any(r[1] for r in brute(want))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert found(spelling.group_variants(spelling.spoiled_words(docs))) == set()


def test_query_by_brute_force(spark):
    """The query over the smallest tables, against the definition."""
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert found(queries.QUERIES["op11_spelling"](spark, d)) == brute(words_of(rows))
