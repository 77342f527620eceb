"""Near copies at five words and Jaccard 0.8: SimHash links, MinHash buckets for what lies beyond its radius.

Texts are sets of XXH64 hashes of their WIDTH-word shingles; equal word sequences are one class. The classes'
SimHash fingerprints are compared by the tiled exact comparison of `simhash`, within RADIUS bits. Copies of Jaccard
0.8 differ in about ten bits of 64, where population counts skip nothing and the comparison would be quadratic;
so classes also fall into BANDS buckets, each keyed by the ROWS smallest values of seeded hashes: two classes
of Jaccard j share a bucket with probability 1 - (1 - j^ROWS)^BANDS (0.9998 at 0.8). Each member of a bucket is proposed
to the leader of it, the member that meets most others over all its buckets (an original meets more than its copies
do). Then buckets of at most SMALL members propose all pairs that aren't yet connected. The members of larger buckets
that still hold several components are joined by prefix filtering instead, which loses no pair and makes none of texts
that share frequent shingles alone. So there are three rounds, whatever the input. Any proposed pair becomes a link only
where the Jaccard of the whole sets is at least LEAST.

Null and empty texts are one class; texts under WIDTH words are one shingle; rows without an id share the
component of their class; repeated rows each get a row; an empty table gives an empty result. Only the id and
text columns are read; `one_of_each_group` hands all columns through.
"""

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, scratch, texts
from .graph import connected_components
from .parts import slices
from .simhash import RADIUS, bits_of, links

WIDTH, LEAST, BANDS, ROWS, SMALL = 5, 0.8, 16, 4, 128
#: Rows of two or three numbers that are sent to every task; more are shuffled.
SENT = 1_000_000
_draw = np.random.default_rng(42)
ODD = _draw.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _draw.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64)


def shingle_set(text: str, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """Hash of the word sequence, and the sorted distinct hashes of its shingles."""
    words = text.encode().lower().split()
    whole = b" ".join(words)
    parts = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [whole]
    h = np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), parts), np.uint64))
    return xxhash.xxh64_intdigest(whole, seed=7), h


def buckets(h: np.ndarray) -> np.ndarray:
    """One key a band."""
    least = np.full((len(ODD), 1), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 8192):
        least = np.minimum(least, (h[None, i : i + 8192] * ODD + ADD).min(1, keepdims=True))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), seed=k) for k, r in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sign(batches, width: int):
    for b in slices(batches, 128):
        keys, fps, bands = [], [], []
        for text in b.column(1).to_pylist():
            key, h = shingle_set(text, width)
            keys.append(key), fps.append(bits_of(h)), bands.append(buckets(h))
        own = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *own], ["doc_id", "text_key", "key", "fp", "bands"])


def _verify(batches, width: int, least: float):
    """Pairs a, b whose texts x, y reach the Jaccard; rows come by b, so its set is made once."""
    known, set_b = None, None
    for rows in slices(batches, 128):
        good = []
        for a, b, x, y in zip(*[col.to_pylist() for col in rows.columns]):
            if b != known:
                known, set_b = b, shingle_set(y, width)[1]
            if jaccard(shingle_set(x, width)[1], set_b) >= least:
                good.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in good], pa.int64()) for k in (0, 1)], ["a", "b"])


def small(rows: DataFrame) -> DataFrame:
    """rows of a few numbers each, marked for a broadcast where a count shows that they are at most SENT."""
    rows = durable(rows)
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _shingles(batches, width: int):
    for b in slices(batches, 128):
        sets = [shingle_set(t, width)[1] for t in b.column("text").to_pylist()]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        h = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
        size = np.array([len(x) for x in sets], np.int64)[at]
        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at)), b.column("root").take(pa.array(at)), pa.array(size), pa.array(h)], ["key", "root", "size", "h"])


def prefix_pairs(crowd: DataFrame, width: int, least: float) -> DataFrame:
    """a, b: of rows key, root, text the pairs of different roots that can reach the Jaccard, by prefix filtering.

    Shingles that no two roots share add to no pair; a row of which under `least` is shared goes, and what is left is looked
    at once more. Shingles are then ranked by how few rows have them: two sets of this Jaccard share a shingle among the
    n - ceil(least n) + 1 rarest of each, and from their first common one on hold least / (1 + least) of both sizes. No pair is lost."""
    each = crowd.mapInArrow(partial(_shingles, width=width), "key long, root long, size long, h long")
    alike, own = Window.partitionBy("h"), Window.partitionBy("key")
    for _ in range(2):
        each = each.withColumns({"n": F.count("*").over(alike), "mixed": F.min("root").over(alike) != F.max("root").over(alike)})
        each = each.withColumn("shared", F.count_if("mixed").over(own)).where(F.col("shared") >= least * F.col("size") - 1e-6)
    each = durable(each)
    # Every shingle of a row counts for its places, those of one root alone too.
    place = F.row_number().over(Window.partitionBy("key").orderBy("n", "h"))
    first = each.withColumn("place", place).where("mixed").where(F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - 1e-6) + 1)
    first = first.select("h", "key", "root", "size", "shared", "place")
    other = first.select("h", *[F.col(c).alias(f"{c}_b") for c in ("key", "root", "size", "shared", "place")])
    both = least / (1 + least) * (F.col("size") + F.col("size_b"))
    on = (first["h"] == other["h"]) & (F.col("key") < F.col("key_b")) & (F.col("root") != F.col("root_b")) & (F.least("size", "size_b") >= least * F.greatest("size", "size_b") - 1e-6)
    on = on & (F.least("shared", "shared_b") >= both - 1e-6) & (1 + F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b")) >= both - 1e-6)
    return first.join(other, on).select(F.col("key").alias("a"), F.col("key_b").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """doc_id, text_key (XXH64 of the text), key, root (the component's), component_id (smallest doc_id reachable over links of at least this Jaccard)."""
    with scratch(docs.sparkSession) as keep:
        return keep(durable(_near_copies(docs, id_col, text_col, width, least)))


def _near_copies(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    spark, rows = docs.sparkSession, texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    signed = durable(rows.mapInArrow(partial(_sign, width=width), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, key long, fp long, bands array<long>"))
    classes = durable(signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    members = classes.select("key", F.explode("bands").alias("band"))
    many = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = members.join(many, "band")
    members = durable(members.join(members.groupBy("key").agg(F.sum("n").alias("met")), "key"))
    # Only classes that share a bucket can reach the Jaccard; one text of each is kept for that.
    one = signed.select("key", "text_key").join(members.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text_key").alias("text_key"))
    whole = durable(rows.select("text_key", "text").join(small(one), "text_key").groupBy("key").agg(F.first("text").alias("text")))
    side = lambda k, name: whole.select(F.col("key").alias(k), F.col("text").alias(name))

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a", "x"), "a").join(side("b", "y"), "b")
        return durable(met.select("a", "b", "x", "y").mapInArrow(partial(_verify, width=width, least=least), "a long, b long"))

    def rooted(found: DataFrame) -> DataFrame:
        """members with the root of their component so far."""
        tops = connected_components(found).select(F.col("node").alias("key"), "root")
        return durable(members.join(small(tops), "key", "left").withColumn("root", F.coalesce("root", "key")))

    with scratch(spark) as keep:
        fps = durable(classes.groupBy("fp").agg(F.min("key").alias("lead")))
        same = classes.join(fps, "fp").where("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b"))
        lead = lambda k: fps.select(F.col("fp").alias(f"fp_{k}"), F.col("lead").alias(k))
        near = links(fps.select("fp"), RADIUS).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(lead("a"), "fp_a").join(lead("b"), "fp_b").select("a", "b")
        leaders = members.groupBy("band").agg(F.min(F.struct((-F.col("met")).alias("order"), F.col("key").alias("b"))).alias("l")).select("band", "l.b")
        to_leader = members.join(leaders, "band").where("key <> b").select(F.col("key").alias("a"), "b")
        found = keep(verified(same.union(near).union(to_leader)))
    with scratch(spark) as keep:
        now = rooted(found)
        few = now.where(F.col("n") <= SMALL)
        both = few.select("band", F.col("key").alias("a"), "root").join(few.select("band", F.col("key").alias("b"), F.col("root").alias("root_b")), "band")
        more = keep(verified(both.where("a < b and root <> root_b").select("a", "b")))
    found = found.union(more)
    with scratch(spark) as keep:
        now = rooted(found).where(F.col("n") > SMALL)
        mixed = now.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
        crowd = durable(now.join(mixed, "band", "left_semi").select("key", "root").distinct())
        if not crowd.isEmpty():
            found = found.union(keep(verified(prefix_pairs(whole.join(crowd, "key"), width, least))))
    tops = connected_components(found).select(F.col("node").alias("key"), "root")
    firsts = classes.select("key", "first_id").join(small(tops), "key", "left").withColumn("root", F.coalesce("root", "key"))
    low = firsts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return signed.select("doc_id", "text_key", "key").join(firsts.join(low, "root").select("key", "root", "component_id"), "key").select("doc_id", "text_key", "key", "root", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """One row of docs, with all its columns, of each group of near copies: that of the smallest id (rows without one last, then by text hash)."""
    own = uuid.uuid4().hex  # no column of docs has such names
    root, id_key, text_key = f"root_{own}", f"id_{own}", f"text_{own}"
    rows = near_copies(docs, id_col, text_col, width, least).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"), "n")).alias("w")
    kept = rows.groupBy("root").agg(first).select(F.col("root").alias(root), F.xxhash64("w.id").alias(id_key), F.col("w.text").alias(text_key), F.col("w.n").alias("n"))
    kept = durable(kept)
    same = (F.xxhash64(id_col) == F.col(id_key)) & (F.xxhash64(F.coalesce(text_col, F.lit(""))) == F.col(text_key))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(small(kept.where("n = 1").drop("n")), same).select(columns)
    # Rows of one id and text are one.
    again = docs.join(small(kept.where("n > 1").drop("n")), same).groupBy(root).agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
    return out.unionByName(again) if not kept.where("n > 1").isEmpty() else out
