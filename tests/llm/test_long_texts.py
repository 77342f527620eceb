"""Texts of a million words or one word of a million letters through the operators that read documents."""

import hashlib
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from castmill.llm import licenses, media, packing, passages, rules, simhash, spelling, tokens

LINE = "Plain words of a long text number {} go on under the MIT License."
LONG = "\n".join(LINE.format(k % 1000) for k in range(80_000))
TEXTS = {1: LONG, 2: "x" * 1_000_000, 3: LONG + " end", 4: "", 5: "é" * 500_000}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in TEXTS.items()], "doc_id long, text string, lang string").repartition(2)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_licenses(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(licenses.op1_licenses(spark, str(tmp_path)))
    assert found[1]["n_base"] == 80_000 and found[1]["base_labels"] == "mit" and found[2]["n_base"] == 0 and found[4]["n_words"] == 0
    assert found[1]["last_word"] == found[1]["n_words"] - 4


def test_fingerprints(docs):
    found = by_id(simhash.near_duplicates(docs))
    words = LONG.lower().encode().split()
    sums = [0] * 64
    for h, n in Counter(b" ".join(words[i : i + 3]) for i in range(len(words) - 2)).items():
        x = xxhash.xxh64_intdigest(h, seed=42)
        for k in range(64):
            sums[k] += n if x >> k & 1 else -n
    assert found[1]["fp"] % 2**64 == sum(1 << k for k in range(64) if sums[k] > 0) and found[3]["component_id"] == 1 and found[4]["fp"] == 0


def test_packing(docs):
    rows = packing.pack(docs).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    for i in TEXTS:
        own = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) == next(r["doc_tokens"] for r in rows if r["doc_id"] == i)
    assert max(r["offset"] + r["length"] for r in rows) <= 2048


def test_audio(docs):
    found = by_id(media.audio_features(docs))
    for i, t in TEXTS.items():
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert found[i]["n_bytes"] == len(raw) and found[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and found[i]["tail_crc32"] == zlib.crc32(payload[-16:])


def test_rules(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    found = by_id(rules.quality_rules(docs, labels))
    assert found[1]["n_words"] == 80_000 * 14 and found[1]["n_dup_lines"] == 79_000 and found[1]["base_failed"] and found[2]["n_words"] == 1


def test_token_files(spark, docs):
    found = by_id(tokens.read_token_shards(spark, tokens.write_token_shards(docs)))
    at = 0
    for i in sorted(TEXTS):
        assert found[i]["start"] == at and found[i]["n_tokens"] >= 1
        at += found[i]["n_tokens"]


def test_spelling_and_passages(spark, docs):
    twice = docs.union(docs)
    words = {r["word"]: r["n"] for r in spelling.group_variants(spelling.spoiled_words(twice)).select("word", "n").collect()}
    assert words["license"] > 100_000 and any(len(w) >= 499_999 for w in words)
    gone = by_id(passages.remove_repeats(docs).select("doc_id", "n_words", "n_removed"))
    assert gone[1]["n_removed"] == 0 and gone[3]["n_removed"] == 80_000 * 14 and gone[3]["n_words"] == 80_000 * 14 + 1


def test_levenshtein_of_long_words_is_linear(spark):
    """Two words of 200,000 letters, one edit apart."""
    a = "ab" * 100_000
    words = spark.createDataFrame([(a, 2), (a[:5] + "x" + a[6:], 40)], "word string, n long")
    found = {r["n"]: (r["n_near"], r["form_n"]) for r in spelling.group_variants(words).collect()}
    assert found == {2: (1, 40), 40: (1, None)}
