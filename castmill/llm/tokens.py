"""Token ids as binary shards, each document compressed by itself with one shared zstandard dictionary.

The dictionary is trained on the serialized ids of at most DICTIONARY_DOCS whole documents (a bound of the
fit alone: every document is encoded and compressed). Documents are sorted by id over range partitions; a
shard row holds up to SHARD_DOCS of them, or about SHARD_BYTES: their ids, lengths, a byte offset index,
the payload and the dictionary's hash. The dictionary's bytes lie beside the shards, so a path is all a
reader needs; `read_document` finds a shard by its range of ids and unpacks one slice of its payload.

Null and empty texts are their end id alone. Ids may be of any type that Spark sorts; rows without an id
come first; repeated rows each stay, in the order of their packed ids; an empty table gives an empty result. Only the id and text columns
are read.
"""

import hashlib
import json
import os
import re
import uuid
import zlib
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, shared_dir, table, texts
from .parts import chunks, distinct, raw, spread

END_ID, LEVEL, SHARD_DOCS, SHARD_BYTES = 2, 3, 1024, 64 << 20
DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_BYTES = 512, 65_536, 32_768


def load_tokenizer(name: str):
    """A tokenizer by file name, or by path where name is one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


class Encoder:
    """Whole texts to ids, each distinct part of them encoded once while it is remembered.

    In both tokenizers a single space or line feed between two characters that aren't white space starts a
    pre-token, and merges never leave a pre-token; so the ids of a text are those of its parts. A part of
    Latin letters and closing ASCII marks is known to be one or two pre-tokens, which go to the tokenizer's
    model directly; any other part goes through the whole tokenizer. A tokenizer of another make gets whole
    texts. At most WORDS parts, and those that one call adds, are remembered.
    """

    WORDS, CALL = 500_000, 2000
    PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
    LATIN = "".join(map(chr, [10, 32, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    # Fixed value: the pre-token pattern of the tokenizer with word ends.
    WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, name: str):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.known = load_tokenizer(name), {}
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.ends: dict[tuple[str, str], tuple[bytes, bytes]] = {}
        self.shown = str.maketrans({c: shown.pre_tokenize_str(c)[0][0] for c in self.LATIN})
        self.kind = self._kind()

    def _kind(self) -> str | None:
        state = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        before, cut = state(self.tokenizer.normalizer), state(self.tokenizer.pre_tokenizer)
        if not before and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
            return "byte"
        steps = [x.get("type") for x in before.get("normalizers", [])]
        first, *rest = cut.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": self.WORD_END} and [x.get("type") for x in rest] == ["ByteLevel"]:
            return "word"
        return None

    def model_ids(self, word: str) -> bytes:
        """Ids of one pre-token in the model's letters."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def plain(self, part: str) -> bytes | None:
        """Ids of a part of letters and marks; None for any other."""
        if self.kind is None or (m := self.PLAIN.fullmatch(part)) is None:
            return None
        first, letters, marks = m.groups()
        if not letters.isascii():
            letters = (letters.lower() if self.kind == "word" else letters).translate(self.shown)
        elif self.kind == "word":
            letters = letters.lower()
        if self.kind == "word":
            first = ""
        elif first == " ":
            first, letters, marks = ("", self.shown[32] + letters, marks) if letters else ("", "", self.shown[32] + marks)
        out = self.model_ids(letters) if letters else b""
        if first or marks:
            if (end := self.ends.get((first, marks))) is None:
                end = self.ends[first, marks] = self.model_ids(first.translate(self.shown)) if first else b"", self.model_ids(marks) if marks else b""
            return end[0] + out + end[1]
        return out

    def learn(self, new: list[bytes]) -> None:
        other = []
        for raw in new:
            if (ids := self.plain(part := raw.decode())) is None:
                other.append(part)
            else:
                self.known[raw] = ids
        for i in range(0, len(other), self.CALL):
            some = other[i : i + self.CALL]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update((x.encode(), array("I", e.ids).tobytes()) for x, e in zip(some, found))

    def starts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where parts start, and the number of the first part of each row. A doubtful neighbour makes no cut."""
        if self.kind is None or len(data) < 3:
            cut = np.empty(0, np.int64)
        else:
            white = np.zeros(256, bool)
            white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
            after = ~white
            after[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # first bytes of wider white space
            at = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10)) + 1
            last = data[at - 1]
            two = data[np.maximum(at - 2, 0)]
            cut = at[after[data[at + 1]] & np.where(last < 128, ~white[last], (two >= 0xC3) & (two < 0xE0))]
            # A neighbour in another row is none.
            edge = np.zeros(len(data) + 1, bool)
            edge[ends] = True
            cut = cut[~edge[cut] & ~edge[cut + 1]]
        flag = np.zeros(len(data) + 1, bool)
        flag[ends] = flag[cut] = True
        starts = np.flatnonzero(flag[:-1])
        return starts, np.searchsorted(starts, ends)

    def rest(self) -> None:
        self.known.clear(), self.ends.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offset of each text's."""
        data, ends = raw(texts)
        starts, rows = self.starts(data, ends)
        kind, parts = distinct(data, starts)
        for kept in (self.known, self.ends):
            if len(kept) > self.WORDS:
                kept.clear()
        known = self.known
        self.learn([x for x in parts if x not in known])
        blobs = [known[x] for x in parts]
        offsets = np.cumsum([0, *map(len, blobs)]) // 4
        where, at = spread(offsets, kind)
        return np.frombuffer(b"".join(blobs), "<u4")[where], at[rows]


@lru_cache(maxsize=1)
def worker_encoder(name: str) -> Encoder:
    """One encoder for all tasks of a Python worker; a task ends by `rest`, so that its parts don't stay beside later stages."""
    return Encoder(name)


def _encoded(batches, name: str, end_id: int, dictionary: bytes | None):
    encoder, end = worker_encoder(name), np.array([end_id], "<u4").tobytes()
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=LEVEL)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress if dictionary is not None else bytes
    for b in batches:
        for at, some in chunks(b.column(1)):
            ids, ends = encoder.encode(some)
            whole, cut = memoryview(ids.tobytes()), (4 * ends).tolist()
            blobs = [pack(bytes(whole[x:y]) + end) for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(np.diff(ends) + 1), pa.array(blobs, pa.binary())], ["doc_id", "n", "blob"])
    encoder.rest()


def train_dictionary(rows: DataFrame, name: str, end_id: int, n_docs: int = DICTIONARY_DOCS, most_chars: int = DICTIONARY_CHARS) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES, trained on whole documents; empty where they are too few to train one.

    The sample is the n_docs documents of smallest id hash among those of at most most_chars characters, as
    the dictionary serves short documents; so at most their ids reach the driver, and no document is cut."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    few = rows.where(F.col("doc_id").isNotNull() & (F.length("text") <= most_chars))
    first = few.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    sample = few.join(F.broadcast(first), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").mapInArrow(partial(_encoded, name=name, end_id=end_id, dictionary=None), f"doc_id {kind}, n long, blob binary")
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["blob"]) for r in sample.select("blob").collect()]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _shards(batches, sha: str):
    part, shard, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row():
        ids, n, blobs = zip(*held)
        known = [i for i in ids if i is not None]
        offsets = np.cumsum([0, *map(len, blobs)])
        values = [part, shard, len(ids), sum(n), known[0] if known else None, known[-1] if known else None, ids, n, offsets, b"".join(blobs), sha]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), kind, kind, pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], SHARD_COLUMNS)

    for b in batches:
        kind = b.schema.field(0).type
        for doc in zip(*[c.to_pylist() for c in b.columns]):
            held.append(doc)
            size += len(doc[2])
            if len(held) == SHARD_DOCS or size >= SHARD_BYTES:
                yield row()
                shard, held, size = shard + 1, [], 0
    if held:
        yield row()


SHARD_COLUMNS = ["part", "shard", "n_docs", "n_tokens", "low", "high", "doc_ids", "lengths", "offsets", "payload", "dictionary_sha256"]


def write_token_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID) -> str:
    """Write shards and dictionary under path (a new folder of the shared one by default); returns path."""
    spark, rows = docs.sparkSession, texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    path = path or f"{shared_dir(spark)}/castmill/{uuid.uuid4().hex}"
    dictionary = train_dictionary(rows, tokenizer, end_id)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "dictionary_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    coded = durable(rows.mapInArrow(partial(_encoded, name=tokenizer, end_id=end_id, dictionary=dictionary), f"doc_id {kind}, n long, blob binary"))
    ordered = coded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "blob")  # rows of one id in an order of their own
    columns = f"part int, shard long, n_docs int, n_tokens long, low {kind}, high {kind}, doc_ids array<{kind}>, lengths array<long>, offsets array<long>, payload binary, dictionary_sha256 string"
    ordered.mapInArrow(partial(_shards, sha=sha), columns).write.parquet(f"{path}/shards")
    return path


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The shards and the one dictionary that lies beside them."""
    return spark.read.parquet(f"{path}/shards"), bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def _unpacker(dictionary: bytes, sha: str):
    if hashlib.sha256(dictionary).hexdigest() != sha:
        raise ValueError("the shard was written with another dictionary")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress


def _read(batches, dictionary: bytes):
    for b in batches:
        for i in range(len(b)):
            first, doc_ids, offsets, payload, sha = [c[i] for c in b.columns]
            unpack, payload = _unpacker(dictionary, sha.as_py()), memoryview(payload.as_buffer())
            at = offsets.values.to_numpy()
            n, crc = [], []
            for x, y in zip(at, at[1:]):
                ids = unpack(payload[x:y])
                n.append(len(ids) // 4), crc.append(zlib.crc32(ids))
            n = np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first.as_py() + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the payloads."""
    shards, dictionary = _open(spark, path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))  # a row per file
    before = lambda w: F.coalesce(F.sum("all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    inner = shards.select("part", "shard", F.col("n_tokens").alias("all")).select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("within"))
    rows = shards.join(inner, ["part", "shard"]).join(parts, "part")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    return rows.select((F.col("base") + F.col("within")).alias("first"), "doc_ids", "offsets", "payload", "dictionary_sha256").mapInArrow(partial(_read, dictionary=dictionary), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _slice(batches, dictionary: bytes):
    for b in batches:
        ids = [np.frombuffer(_unpacker(dictionary, sha)(x), "<u4").astype(np.int64) for x, sha in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])


def read_document(spark: SparkSession, path: str, doc_id) -> DataFrame:
    """doc_id, ids of every document of this id (none: no row). Shards are chosen by their range of ids, and only its slices are unpacked."""
    shards, dictionary = _open(spark, path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    own = shards.where((F.col("low") <= doc_id) & (F.col("high") >= doc_id))
    at = own.select("payload", "offsets", "dictionary_sha256", F.posexplode("doc_ids").alias("i", "doc_id")).where(F.col("doc_id") == doc_id)
    start, end = F.col("offsets")[F.col("i")], F.col("offsets")[F.col("i") + 1]
    cut = at.select("doc_id", F.substring("payload", start + 1, end - start).alias("blob"), "dictionary_sha256")
    return cut.mapInArrow(partial(_slice, dictionary=dictionary), f"doc_id {kind}, ids array<long>")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_shards(spark, write_token_shards(table(spark, sf_dir, "documents")))
