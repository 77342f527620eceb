"""Substring dedup by super-k-mers: words covered by a window of WINDOW words that also starts in a smaller document go.

The minimiser of a window is the least hash of its MER-word sequences. Consecutive windows of one minimiser travel as one
piece, not one by one. Pieces are first known by minimiser and hash alone: a minimiser of one document settles itself, and
where all pieces of a minimiser are the same words, its smallest document owns them. Of other minimisers each distinct piece
travels once, as one packed string, to its minimiser's bucket, where its windows are sorted and so counted exactly; the
result is the smallest document of each window of each distinct piece, and every occurrence looks its own up. A minimiser of
over CROWD distinct pieces, or with one of over LONG windows, has no bucket of its own: its windows are dealt by their
128-bit hash and summed up before and after the shuffle, so a passage that a third of all documents share meets in no
single task.

Equal pieces are told by 64 bits beside their 64-bit minimiser. Null and empty texts have no words. Rows without an id
neither remove nor lose words; repeated rows, and rows that share an id, don't remove each other's. An empty table gives
an empty result. Only the id and text columns are read.
"""

from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, texts
from .copies import small
from .parts import slices

WINDOW, MER, CROWD, LONG = 50, 8, 2000, 10_000
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def minimisers(h: np.ndarray, window: int, mer: int) -> np.ndarray:
    """The least hash of the mer-word sequences of each window, from the hashes of a text's words."""
    n = len(h) - mer + 1
    g = np.zeros(n, np.uint64)
    for k in range(mer):
        g = g * ODD + h[k : k + n]
    g = (g ^ (g >> np.uint64(33))) * MIX
    g ^= g >> np.uint64(29)
    width, size = 1, window - mer + 1
    while 2 * width <= size:
        g, width = np.minimum(g[: len(g) - width], g[width:]), 2 * width
    return np.minimum(g[: len(g) - (size - width)], g[size - width :])


def pieces_of(words: list[bytes], window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Start, number of windows, minimiser and hash of each piece of a text."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    least = minimisers(h, window, mer)
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    counts = np.diff(np.append(starts, len(least)))
    raw, ends = h.tobytes(), starts + counts + (window - 1)
    return starts, counts, least[starts], [xxhash.xxh64_intdigest(raw[8 * a : 8 * b], seed=7) for a, b in zip(starts.tolist(), ends.tolist())]


def _pieces(batches, window: int, mer: int):
    for b in slices(batches, 256):
        rows, cols = [], [[], [], [], []]
        for k, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            words = text.split()
            if len(words) >= window:
                found = pieces_of(words, window, mer)
                rows.append(np.full(len(found[0]), k))
                for c, x in zip(cols, found):
                    c.append(np.asarray(x, np.uint64).view(np.int64))
        rows = np.concatenate([np.empty(0, np.int64), *rows])
        start, n, least, key = (np.concatenate([np.empty(0, np.int64), *c]) for c in cols)
        own = [b.column(c).take(pa.array(rows)) for c in ("doc_id", "text_key")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(least), pa.array(key)], ["doc_id", "text_key", "start", "n", "least", "key"])


def _packed(batches, window: int):
    """The packed string of each piece asked for."""
    for b in slices(batches, 64):
        least, key, doc, packed = [], [], [], []
        for d, text, asked in zip(b.column("doc_id"), b.column("text").cast(pa.binary()).to_pylist(), b.column("asked").to_pylist()):
            words = text.split()
            for p in asked:
                least.append(p["least"]), key.append(p["key"]), doc.append(d), packed.append(b" ".join(words[p["start"] : p["start"] + p["n"] + window - 1]))
        owner = pa.array([d.as_py() for d in doc], b.column("doc_id").type)
        yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(key, pa.int64()), owner, pa.array(packed, pa.binary())], ["least", "key", "doc_id", "packed"])


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """Each window of a packed string, as bytes of it."""
    gaps = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(packed))
    return [packed[a:b] for a, b in zip(starts[: len(starts) - window + 1].tolist(), ends[window - 1 :].tolist())]


def owners_of(bucket: dict, window: int) -> dict:
    """For each piece (key: document, packed string) of a bucket the smallest document of each of its windows, by sorting all windows."""
    rows = sorted((w, doc, key, i) for key, (doc, packed) in bucket.items() for i, w in enumerate(windows_of(packed, window)))
    out = {key: {} for key in bucket}
    for _, run in groupby(rows, lambda r: r[0]):
        run = list(run)
        for _, _, key, i in run:
            out[key][i] = run[0][1]
    return {key: [x[i] for i in range(len(x))] for key, x in out.items()}


def _count(batches, window: int):
    """Rows come by minimiser; one bucket is held at a time."""
    now, bucket = None, {}
    names, kinds = ["least", "key", "owners"], None

    def out():
        found = owners_of(bucket, window)
        return pa.RecordBatch.from_arrays([pa.array([now] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(kinds))], names)

    for b in slices(batches, 1024):
        kinds = b.column("doc_id").type
        for least, key, doc, packed in zip(*[b.column(c).to_pylist() for c in ("least", "key", "doc_id", "packed")]):
            if least != now and bucket:
                yield out()
                bucket = {}
            now = least
            bucket[key] = (doc, packed)
    if bucket:
        yield out()


def _hashed(batches, window: int):
    """least, key, place and hash of each window."""
    for b in slices(batches, 64):
        cols = [[], [], [], [], [], []]
        for least, key, doc, packed in zip(*[b.column(c).to_pylist() for c in ("least", "key", "doc_id", "packed")]):
            for i, w in enumerate(windows_of(packed, window)):
                h = xxhash.xxh3_128_digest(w)
                for c, x in zip(cols, (least, key, doc, i, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True))):
                    c.append(x)
        kinds = [pa.int64(), pa.int64(), b.column("doc_id").type, pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["least", "key", "doc_id", "i", "w1", "w2"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mer: int = MER) -> DataFrame:
    """doc_id, text_key, at, n: runs of windows (first place and number) of each row that also start in a document of a smaller id."""
    rows = texts(docs, id_col, text_col).where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = durable(rows.mapInArrow(partial(_pieces, window=window, mer=mer), f"doc_id {kind}, text_key long, start int, n int, least long, key long"))
    marks = pieces.groupBy("least").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("key").alias("low"), F.max("key").alias("high"))
    marks = marks.where(F.col("first") < F.col("last")).select("least", "first", (F.col("low") == F.col("high")).alias("alike"))
    shared = durable(pieces.join(marks, "least"))
    whole = shared.where("alike and first < doc_id").select("doc_id", "text_key", F.col("start").alias("at"), "n")

    mixed = shared.where("not alike")
    first = F.min(F.struct("doc_id", "text_key", "start", "n")).alias("f")
    kinds = durable(mixed.groupBy("least", "key").agg(first).select("least", "key", "f.*"))
    crowded = kinds.groupBy("least").agg(F.count("*").alias("k"), F.max("n").alias("most")).where((F.col("k") > CROWD) | (F.col("most") > LONG)).select("least", F.lit(True).alias("crowd"))
    kinds = kinds.join(small(crowded), "least", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    asked = kinds.groupBy("doc_id", "text_key", "crowd").agg(F.collect_list(F.struct("least", "key", "start", "n")).alias("asked"))
    packed = rows.join(asked, ["doc_id", "text_key"]).select("doc_id", "text", "asked", "crowd")
    cut = lambda some: some.select("doc_id", "text", "asked").mapInArrow(partial(_packed, window=window), f"least long, key long, doc_id {kind}, packed binary")
    calm = cut(packed.where("not crowd")).repartition("least").sortWithinPartitions("least").mapInArrow(partial(_count, window=window), f"least long, key long, owners array<{kind}>")

    each = durable(cut(packed.where("crowd")).mapInArrow(partial(_hashed, window=window), f"least long, key long, doc_id {kind}, i int, w1 long, w2 long"))
    owner = each.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"))
    listed = each.join(owner, ["w1", "w2"]).groupBy("least", "key").agg(F.transform(F.array_sort(F.collect_set(F.struct("i", "owner"))), lambda x: x["owner"]).alias("owners"))

    met = mixed.join(calm.union(listed), ["least", "key"])
    flags = F.transform("owners", lambda o: o < F.col("doc_id"))
    edge = lambda side: F.filter(F.sequence(F.lit(0), F.size("gone") - 1), lambda i: F.get("gone", i) & ~F.coalesce(F.get("gone", i + side), F.lit(False)))
    runs = met.withColumn("gone", flags).where(F.array_contains("gone", True))
    runs = runs.select("doc_id", "text_key", "start", F.explode(F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b"))).alias("r"))
    return whole.union(runs.select("doc_id", "text_key", F.col("start") + F.col("r.a"), F.col("r.b") - F.col("r.a") + 1))


def _cut(batches, window: int):
    for b in slices(batches, 128):
        n, gone, kept = [], [], []
        for text, runs in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist()):
            words = text.split()
            if runs:
                steps = np.zeros(len(words) + 1, np.int64)
                at = np.array([(r["at"], r["at"] + r["n"] + window - 1) for r in runs])
                np.add.at(steps, at[:, 0], 1), np.add.at(steps, at[:, 1], -1)
                stay = np.cumsum(steps[:-1]) == 0
                kept.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s])), gone.append(int(len(words) - stay.sum()))
            else:
                kept.append(b" ".join(words)), gone.append(0)
            n.append(len(words))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mer: int = MER) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space): a row for each row of docs."""
    runs = repeated_windows(docs, id_col, text_col, window, mer).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    rows = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text")).join(runs, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_cut, window=window), f"doc_id {kind}, n_words long, n_removed long, kept string")


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
