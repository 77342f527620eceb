import zlib

import pyarrow as pa

from castmill.llm import packing, pieces, pipeline, tokens

TEXTS = [None, "", "the cat sat", "abén ▁ x\ny", "one two three four. " * 700]


def test_segment_keeps_every_path(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    rows = {r["doc_id"]: r["paths"] for r in pieces.segment(docs, n=4).collect()}
    found = pieces.Lattice().encode(pa.array([t or "" for t in TEXTS]), 4)
    for i, own in enumerate(found):
        assert [(p["score"], p["ids"]) for p in rows[i]] == [(s, ids.tolist()) for s, ids in own]
    assert len(rows[2]) == 4
    flat = pieces.segment(docs, n=4).selectExpr("text", "explode(paths.ids) ids")
    assert all(r["decoded"] == r["text"] for r in pieces.decode(flat).collect())


def test_nbest_columns(spark, sf_dir):
    rows = {r["doc_id"]: r for r in pieces.op5_nbest(spark, sf_dir).limit(50).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lattice = pieces.Lattice()
    for i, r in rows.items():
        found = lattice.encode(pa.array([texts[i] or ""]), 2)[0]
        (score, ids), second = found[0], found[1][0] if len(found) > 1 else None
        assert tuple(r) == (i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), score, second, True)


def test_pack_keeps_ids(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    t, rows = tokens.load_tokenizer("byte_bpe_50k.json"), pipeline.pack_sequences(spark, docs, "").toPandas()
    for i, text in enumerate(TEXTS):
        own = rows[rows.doc_id == i].sort_values("start")
        assert [x for ids in own.ids for x in ids] == [*t.encode(text or "", add_special_tokens=False).ids, 1]
    assert "ids" not in packing.op3_packing(spark, "/root/testdata/sf0.001").columns
