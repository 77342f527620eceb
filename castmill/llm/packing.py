"""Order-preserving packing of token ids into windows, by dynamic programming with a monotone queue.

Documents are taken in the order of their partition. Cut points are document ends, sentence ends and,
in sentences over STRIDE tokens, every STRIDE tokens. A window ends at a cut point; it costs its padding
plus a penalty where it cuts a document. best[j] = min over c[j] - c[i] <= size of best[i] + c[i], plus
size - c[j] + penalty[j]; the minimum slides, so a monotone queue gives it in constant time. Windows are
handed on as soon as every place from which a later window may start has them on its best way, so the
cuts are the best ones of the whole partition while only a few windows are held.

Null and empty texts are their end id alone. Repeated rows are packed each, and ids of any type or none
are handed through. An empty table gives an empty result. Only the id and text columns are read.
Sequence ids are the partition number and a count within it, so a repeated task gives the same ids; the
last sequence of a partition may be padded to a smaller power of two.
"""

import zlib
from collections import deque
from functools import partial
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts
from .parts import chunks
from .tokens import worker_encoder

SIZE, END_ID, STRIDE = 2048, 1, 64
SENTENCE_CUT, HARD_CUT = 2, 6
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def sentence_ends(tokenizer) -> np.ndarray:
    """For each id, whether its piece ends a sentence or a line."""
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    for piece, i in tokenizer.get_vocab().items():
        ends[i] = piece[-1] in ".!?Ċ"
    return ends


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end in these documents (each has its end id), and what each cut costs."""
    cost = np.full(len(ids) + 1, -1, np.int8)
    cost[1:][ends[ids]] = SENTENCE_CUT
    cost[doc_ends] = 0
    bounds = np.flatnonzero(cost >= 0)
    gaps = np.diff(bounds, prepend=0)
    wide = np.flatnonzero(gaps > stride)
    n = (gaps[wide] - 1) // stride
    hard = np.repeat(bounds[wide] - gaps[wide], n) + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    cost[hard] = HARD_CUT
    cuts = np.flatnonzero(cost >= 0)
    return cuts, cost[cuts]


class Cuts:
    """The best window ends over a stream of cut points (steps of at most size)."""

    def __init__(self, size: int):
        self.size, self.at, self.value, self.back, self.queue, self.first = size, [0], [0], [0], deque([0]), 0

    def add(self, points: list[int], costs: list[int]) -> None:
        """Points and back pointers are numbered from the start of the stream; first is the number of at[0]."""
        at, value, back, queue, size, first = self.at, self.value, self.back, self.queue, self.size, self.first
        for point, cost in zip(points, costs):
            while point - at[queue[0] - first] > size:
                queue.popleft()
            i = queue[0]
            best = value[i - first] + at[i - first] + size - point + cost
            at.append(point), value.append(best), back.append(i)
            while queue and value[queue[-1] - first] + at[queue[-1] - first] >= best + point:
                queue.pop()
            queue.append(first + len(at) - 1)

    def _path(self, j: int) -> list[int]:
        out = []
        while j > self.first:
            out.append(self.at[j - self.first])
            j = self.back[j - self.first]
        return out[::-1]

    def settled(self) -> list[int]:
        """Further window ends that no later cut point can change: the way to the last point that all live ways pass."""
        live = [-i for i in self.queue]
        heapify(live)
        while len(live) > 1:
            i = -live[0]
            heapreplace(live, -self.back[i - self.first])
            while len(live) > 1 and live[0] == min(live[1:3]):
                heappop(live)
        joint = -live[0]
        out, drop = self._path(joint), joint - self.first
        self.at, self.value, self.back, self.first = self.at[drop:], self.value[drop:], self.back[drop:], joint
        return out

    def last(self) -> list[int]:
        """The window ends that are left."""
        return self._path(self.first + len(self.at) - 1)


def best_cuts(points: list[int], costs: list[int], size: int) -> list[int]:
    """Window ends over increasing points (0 is the start, steps of at most size) at the least total cost."""
    cuts = Cuts(size)
    cuts.add(points, costs)
    return cuts.last()


class Packer:
    """Holds the tokens that aren't in a settled window yet; positions count the tokens of the partition."""

    def __init__(self, size: int, first: int, kind: pa.DataType):
        self.cuts, self.sequence, self.kind = Cuts(size), first, kind
        self.done = 0  # tokens in windows handed on
        self.tokens = np.empty(0, "<u4")
        self.doc_ids, self.starts, self.ends = [], np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray) -> None:
        base = self.done + len(self.tokens)
        points, costs = cut_points(ids, doc_ends, sentence, min(STRIDE, self.cuts.size))
        self.cuts.add((points + base).tolist(), costs.tolist())
        self.tokens = np.concatenate((self.tokens, ids))
        self.doc_ids += doc_ids.to_pylist()
        self.starts = np.concatenate((self.starts, base + np.concatenate(([0], doc_ends[:-1]))[: len(doc_ends)]))
        self.ends = np.concatenate((self.ends, base + doc_ends))

    def rows(self, windows: list[int]) -> pa.RecordBatch:
        """A row per piece of these windows."""
        windows, done = np.array(windows, np.int64), self.done
        to = int(windows[-1]) if len(windows) else done
        stops = np.union1d(windows, self.ends[(self.ends > done) & (self.ends < to)])
        begins = np.concatenate(([done], stops[:-1]))[: len(stops)]
        doc, window = np.searchsorted(self.ends, stops), np.searchsorted(windows, stops)
        window_start = np.concatenate(([done], windows))[window]
        held = self.tokens[: to - done]
        crc = [zlib.crc32(held[a:b].tobytes()) for a, b in zip((begins - done).tolist(), (stops - done).tolist())]
        columns = [
            pa.array([self.doc_ids[i] for i in doc.tolist()], self.kind), pa.array(begins - self.starts[doc]), pa.array(stops - begins), pa.array(crc, pa.int64()),
            pa.array(self.ends[doc] - self.starts[doc]), pa.array(self.sequence + window), pa.array(begins - window_start),
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops - done)).astype(np.int32)), pa.array(held.view(np.int32))),
        ]
        gone = int(np.searchsorted(self.ends, to, "right"))
        self.doc_ids, self.starts, self.ends = self.doc_ids[gone:], self.starts[gone:], self.ends[gone:]
        self.tokens, self.done, self.sequence = self.tokens[to - done :], to, self.sequence + len(windows)
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]])


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents with the end id after each, and where each document ends."""
    doc_ends = ends[1:] + np.arange(1, len(ends))
    out = np.full(len(ids) + len(doc_ends), end_id, "<u4")
    own = np.ones(len(out), bool)
    own[doc_ends - 1] = False
    out[own] = ids
    return out, doc_ends


def _pack(batches, name: str, size: int, end_id: int):
    encoder = worker_encoder(name)
    sentence, packer = sentence_ends(encoder.tokenizer), None
    for b in batches:
        packer = packer or Packer(size, TaskContext.get().partitionId() << 33, b.schema.field(0).type)
        for at, some in chunks(b.column(1)):
            packer.add(b.column(0).slice(at, len(some)), *with_end(*encoder.encode(some), end_id), sentence)
            yield packer.rows(packer.cuts.settled())
    if packer:
        yield packer.rows(packer.cuts.last())
    encoder.rest()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (those of the piece)."""
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(partial(_pack, name=tokenizer, size=size, end_id=end_id), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
