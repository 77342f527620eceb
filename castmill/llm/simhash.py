"""SimHash near-duplicates by tiled exact comparison.

A fingerprint is 64 bits over XXH64 hashes of three-word shingles. Equal fingerprints are one class.
Classes fall into cells by the population counts of their four 16-bit quarters; the distance of two
fingerprints is at least the sum of the differences of these counts, so cells that differ by more than
the radius are skipped. Cells are cut into tiles of about TILE fingerprints, and each tile pair that
is left is compared whole by numpy exclusive-or and bit counts. A tile pair hands on a spanning forest
of its links, never all pairs, which keeps the components.

Null and empty texts have fingerprint zero and are linked like others; ties take the smallest id;
repeated rows each get a row; an empty table gives an empty result. Rows without an id share the
component of their class. Only the id and text columns are read.
"""

from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, texts
from .graph import connected_components
from .parts import slices

RADIUS, TILE = 2, 4096


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    return bits_of(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64))


def bits_of(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes, as a signed number."""
    ones = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), 65536))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the fingerprints of two tiles that lie within the radius."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    links, step = [], max(1, (1 << 20) // len(b))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius
        for x, y in zip(*np.nonzero(near)):
            x, y = int(a[i + x]), int(b[y])
            if x != y and (p := top(x)) != (q := top(y)):
                parent[p] = q
                links.append((x, y))
    return links


def _compare(batches, radius: int):
    for batch in slices(batches, 64):
        left, right = batch.column(0), batch.column(1)
        lo, ro, lv, rv = left.offsets.to_numpy(), right.offsets.to_numpy(), left.values.to_numpy().view(np.uint64), right.values.to_numpy().view(np.uint64)
        links = [x for i in range(len(left)) for x in _forest(lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]], radius)]
        a = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints fp that keep every component at the radius."""
    parts = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]
    cells = classes.select("fp", F.array(*parts).alias("cell"))
    # At most 17^4 cells, whatever the input.
    chunks = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("n"))
    tiles = durable(
        cells.join(F.broadcast(chunks), "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("n")))
        .groupBy("cell", "chunk").agg(F.collect_list("fp").alias("fps"))
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    key = tiles.select("cell", "chunk")
    near = key.select(F.col("cell").alias("l"), F.col("chunk").alias("lc"), F.explode(F.array(*[F.array(*map(F.lit, d)) for d in steps])).alias("d"))
    near = near.select("l", "lc", F.zip_with("l", "d", lambda x, y: x + y).alias("r"))
    pairs = near.join(key.select(F.col("cell").alias("r"), F.col("chunk").alias("rc")), "r").where("l <> r or lc <= rc")
    both = pairs.join(tiles.select(F.col("cell").alias("l"), F.col("chunk").alias("lc"), F.col("fps").alias("left")), ["l", "lc"])
    both = both.join(tiles.select(F.col("cell").alias("r"), F.col("chunk").alias("rc"), F.col("fps").alias("right")), ["r", "rc"])
    return both.select("left", "right").mapInArrow(partial(_compare, radius=radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most radius bits)."""
    signed = durable(fingerprints(docs, id_col, text_col))
    classes = durable(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = classes.join(connected_components(links(classes, radius)), F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return signed.join(roots.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
