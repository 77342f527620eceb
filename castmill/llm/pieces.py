"""SentencePiece segmentation with the N best paths of the piece lattice, and decoding.

A path's score is the sum of its pieces' scores; the best path is the one of the largest sum. With a BPE
model the scores are merge ranks, so this is the best-sum segmentation, which need not be the one that
merging gives. Characters without a piece become byte pieces at a penalty. Pieces never cross the start of
a word, so the lattice of a text is a chain of word lattices.

Forward: each distinct word of a batch is walked through a trie of all pieces, all positions at once, and
Viterbi scores are taken position by position over all words. Along its best way the least loss of any
other edge is a word's distance to its second path. Backward: the N best of a text differ from its best
path in no more than the N - 1 words of least loss, so an A-star search goes over the chain of those, with
the Viterbi scores as exact heuristic; states hold a pointer to the state after them, and a state is kept
only while fewer than N ways are known to be better. So memory grows with the length of a text alone.

Null and empty texts have one path without pieces, of score 0. Ties go to the path whose last pieces are
longer. Repeated rows each get a row, ids of any type or none are handed through; an empty table gives an
empty result. Only the id and text columns are read.
"""

import heapq
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .parts import chunks, distinct, raw, spread

MARK, BYTE_PENALTY = "▁", 10.0
LONG, GROUP, SLOTS, CHUNK = 64, 1 << 16, 20, 3 << 20


class Lattice:
    def __init__(self, name: str = "piece_bpe_32k.model"):
        import sentencepiece

        if "/" not in name:
            import public_tokenizers

            name = public_tokenizers.path(name)
        model = sentencepiece.SentencePieceProcessor(model_file=name)
        ids = range(model.get_piece_size())
        shown = [model.id_to_piece(i) for i in ids]
        bytes_of = {i: bytes([int(shown[i][3:5], 16)]) for i in ids if model.is_byte(i)}
        self.byte = np.zeros(256, np.int32)
        for i, b in bytes_of.items():
            self.byte[b[0]] = i
        self.raw = pa.array([bytes_of.get(i, b"" if model.is_control(i) else shown[i].replace(MARK, " ").encode()) for i in ids], pa.binary())
        own = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.pieces = {shown[i]: (i, model.get_score(i)) for i in own}
        self.longest = max(map(len, self.pieces))
        self.floor = min(s for _, s in self.pieces.values()) - BYTE_PENALTY
        self.keys = None  # decoding needs no trie

    def _trie(self) -> None:
        """Steps (node, character) -> node, in a table with open addresses; a piece and its score at each node."""
        steps, at = {}, [(-1, -np.inf)]
        for piece, (i, score) in self.pieces.items():
            node = 0
            for c in piece:
                if (to := steps.get((node, ord(c)))) is None:
                    to = steps[node, ord(c)] = len(at)
                    at.append((-1, -np.inf))
                node = to
            at[node] = (i, score)
        self.piece_at, self.score_at = np.array([p for p, _ in at], np.int32), np.array([s for _, s in at])
        self.keys, self.to = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, np.int32)
        keys = np.array([n << 21 | c for n, c in steps], np.int64)
        for key, slot, to in zip(keys.tolist(), self._slot(keys).tolist(), steps.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % (1 << SLOTS)
            self.keys[slot], self.to[slot] = key, to

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after each step, or -1."""
        keys = node.astype(np.int64) << 21 | char
        slot, out = self._slot(keys), np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            here = self.keys[slot]
            hit = here == keys[left]
            out[left[hit]] = self.to[slot[hit]]
            on = ~hit & (here >= 0)
            left, slot = left[on], (slot[on] + 1) % (1 << SLOTS)
        return out

    def _edges(self, chars: np.ndarray, room: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and piece of each length at each position; length 1 without a piece is the character's bytes (piece -1)."""
        score, piece = np.full((self.longest + 1, len(chars)), -np.inf), np.full((self.longest + 1, len(chars)), -1, np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int32)
        for k in range(1, self.longest + 1):
            on = room[at] >= k
            at, node = at[on], node[on]
            node = self._step(node, chars[at + k - 1])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            score[k, at], piece[k, at] = self.score_at[node], self.piece_at[node]
        bare = piece[1] < 0
        score[1, bare] = self.floor * width[bare]
        return score, piece

    def _group(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, least loss of another path, number of best ids, and these ids, of words, the longest word first."""
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        width = 1 + (chars > 0x7F) + (chars > 0x7FF).astype(np.int64) + (chars > 0xFFFF)
        if self.keys is None:
            self._trie()
        score, piece = self._edges(chars, (start + size)[word] - np.arange(len(chars)), width)
        base = start + np.arange(len(words))  # a word has a node before each character, and one at its end
        best, back = np.zeros(len(chars) + len(words)), np.zeros(len(chars) + len(words), np.int64)
        for j in range(1, size[0] + 1):
            m = int(np.searchsorted(-size, -j, "right"))
            node, at = base[:m] + j, start[:m] + j
            top, by = best[node - 1] + score[1, at - 1], np.ones(m, np.int64)
            for k in range(2, min(j, self.longest) + 1):
                other = best[node - k] + score[k, at - k]
                more = (other >= top) & (other > -np.inf)
                top[more], by[more] = other[more], k
            best[node], back[node] = top, by
        on, left = np.zeros(len(best), bool), base + size
        while len(left):
            on[left] = True
            left = left - back[left]
            left = left[back[left] > 0]
        node = np.flatnonzero(on)
        own = np.searchsorted(base, node, "right") - 1
        at, by, deep = node - own, back[node], node - base[own]
        second = np.full(len(node), -np.inf)
        for k in range(1, self.longest + 1):
            may = (deep >= k) & (by != k)
            second[may] = np.maximum(second[may], best[node[may] - k] + score[k, at[may] - k])
        first = np.searchsorted(own, np.arange(len(words)))
        loss = np.minimum.reduceat(best[node] - second, first)
        ids = piece[by, at - by]
        n, bare = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
        n[bare] = width[at[bare] - 1]
        wide, to = np.repeat(ids, n), np.cumsum(n)
        for i in bare.tolist():
            wide[to[i] - n[i] : to[i]] = self.byte[list(text[at[i] - 1].encode())]
        return best[base + size], loss, np.add.reduceat(n, first), wide

    def into(self, word: str, j: int) -> list[tuple[int, float, tuple]]:
        """Edges that end at j, the longest first: start, score, ids."""
        out, pieces = [], self.pieces
        for i in range(max(0, j - self.longest), j):
            if (p := pieces.get(word[i:j])) is not None:
                out.append((i, p[1], (p[0],)))
        if word[j - 1] not in pieces:
            own = word[j - 1].encode()
            out.append((j - 1, self.floor * len(own), tuple(self.byte[list(own)].tolist())))
        return out

    def forward(self, word: str) -> list[float]:
        """Best score up to each position."""
        best, pieces, longest = [0.0], self.pieces, self.longest
        for j in range(1, len(word) + 1):
            top = -np.inf
            for i in range(max(0, j - longest), j):
                if (p := pieces.get(word[i:j])) is not None and best[i] + p[1] > top:
                    top = best[i] + p[1]
            if word[j - 1] not in pieces:
                top = max(top, best[j - 1] + self.floor * len(word[j - 1].encode()))
            best.append(top)
        return best

    def search(self, words: list[str], n: int) -> list[tuple[float, list[list[int]]]]:
        """The n best paths over a chain of words, by A-star from the end: score, ids of each word."""
        best = [self.forward(w) for w in words]
        before = np.cumsum([0.0, *(b[-1] for b in best)]).tolist()
        tick, out = 0, []
        bound = [before[-1]]  # scores of the best n ways known, which differ from each other
        heap = [(-before[-1], 0, len(words), 0, 0.0, None)]
        while heap and len(out) < n:
            _, _, k, j, tail, state = heapq.heappop(heap)
            if j == 0 and k == 0:
                out.append((tail, self._ids(state, len(words))))
                continue
            if j == 0:
                k, j = k - 1, len(words[k - 1])
            ways = []
            for i, s, ids in self.into(words[k], j):
                ways.append((before[k] + best[k][i] + s + tail, i, s + tail, (k, ids, state)))
            lead = max(range(len(ways)), key=lambda x: ways[x][0])
            for x, (total, i, done, own) in enumerate(ways):
                if x != lead:
                    if len(bound) == n and total < bound[0]:
                        continue
                    heapq.heappush(bound, total)
                    if len(bound) > n:
                        heapq.heappop(bound)
                tick += 1
                heapq.heappush(heap, (-total, tick, k, i, done, own))
        return out

    @staticmethod
    def _ids(state, n: int) -> list[list[int]]:
        out = [[] for _ in range(n)]
        while state is not None:
            k, ids, state = state
            out[k] += ids
        return out

    def _long(self, word: str) -> tuple[float, float, np.ndarray]:
        found = self.search([word], 2)
        return found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf, np.array(found[0][1][0], np.int32)

    def solve(self, kinds: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct word: best score, least loss of another path, offset of its best ids; and all these ids."""
        score, loss, n = np.zeros(len(kinds)), np.full(len(kinds), np.inf), np.zeros(len(kinds), np.int64)
        words = [None if k == MARK.encode() else k.decode().replace(" ", MARK) for k in kinds]
        size, found = np.array([0 if w is None else len(w) for w in words], np.int64), []
        for i in np.flatnonzero(size == 0).tolist():  # the mark itself in a text isn't a space
            score[i], n[i] = self.floor * len(kinds[i]), len(kinds[i])
            found.append(([i], self.byte[list(kinds[i])]))
        for i in np.flatnonzero(size > LONG).tolist():
            score[i], loss[i], ids = self._long(words[i])
            n[i] = len(ids)
            found.append(([i], ids))
        order = np.flatnonzero((size > 0) & (size <= LONG))
        order = order[np.argsort(-size[order], kind="stable")]
        cut = np.searchsorted(np.cumsum(size[order]), np.arange(GROUP, size[order].sum() + GROUP, GROUP))
        for some in np.split(order, cut):
            if len(some):
                score[some], loss[some], n[some], ids = self._group([words[i] for i in some.tolist()])
                found.append((some, ids))
        offsets = np.concatenate(([0], np.cumsum(n)))
        flat = np.empty(offsets[-1], np.int32)
        for some, ids in found:
            flat[spread(offsets, np.asarray(some))[0]] = ids
        return score, loss, offsets, flat

    @staticmethod
    def starts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start (a run of blanks, a line feed, a mark, what follows a mark), and the first word of each row."""
        flag = np.zeros(len(data) + 1, bool)
        flag[ends] = True
        if len(data):
            blank = data == 32
            flag[:-1] |= data == 10
            flag[:-1] |= blank & ~np.concatenate(([False], blank[:-1]))
            mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            flag[mark] = flag[mark + 3] = True
        starts = np.flatnonzero(flag[:-1])
        return starts, np.searchsorted(starts, ends)

    def encode(self, column: pa.Array, n: int) -> list[list[tuple[float, np.ndarray]]]:
        """The n best segmentations of each text, best first: score, ids."""
        data, ends = raw(pa.array([f" {t}" if t else "" for t in column.to_pylist()], pa.string()))
        starts, rows = self.starts(data, ends)
        kind, kinds = distinct(data, starts)
        score, loss, offsets, ids = self.solve(kinds)
        where, at = spread(offsets, kind)
        flat = ids[where]
        part_loss, part_score = loss[kind], score[kind]
        out = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            total, own = float(part_score[a:b].sum()), flat[at[a] : at[b]]
            few = np.argpartition(part_loss[a:b], n - 2)[: n - 1] if 1 < n <= b - a else np.arange(b - a)
            free = [a + i for i in np.sort(few).tolist() if part_loss[a + i] < np.inf] if n > 1 else []
            found = self.search([kinds[kind[i]].decode().replace(" ", MARK) for i in free], n)
            paths = [(total, own)]
            for gain, change in found[1:]:
                bits, done = [], at[a]
                for i, new in zip(free, change):
                    bits += [flat[done : at[i]], np.array(new, np.int32)]
                    done = at[i + 1]
                paths.append((total + gain - found[0][0], np.concatenate([*bits, flat[done : at[b]]])))
            out.append(paths)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank before the first word isn't part of it."""
        bits = self.raw.take(pa.array(ids))
        whole = bits.buffers()[2].to_pybytes() if len(ids) and bits.buffers()[2] else b""
        return whole.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=1)
def worker_lattice(name: str) -> Lattice:
    return Lattice(name)


def _nested(rows: list[list[tuple[float, np.ndarray]]]) -> pa.Array:
    """Arrays of structs score, ids."""
    flat = [p for r in rows for p in r]
    at = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    ids = pa.ListArray.from_arrays(at([len(i) for _, i in flat]), pa.array(np.concatenate([np.empty(0, np.int32), *(i for _, i in flat)])))
    return pa.ListArray.from_arrays(at(map(len, rows)), pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), ids], ["score", "ids"]))


def _encode(batches, name: str, n: int):
    lattice = worker_lattice(name)
    for b in batches:
        for at, some in chunks(b.column(1), CHUNK):
            yield pa.RecordBatch.from_arrays([*[c.slice(at, len(some)) for c in b.columns], _nested(lattice.encode(some, n))], ["doc_id", "text", "paths"])


def _decode(batches, name: str, ids_col: str, out_col: str):
    lattice = worker_lattice(name)
    for b in batches:
        found = [None if i.values is None else lattice.decode(i.values) for i in b.column(ids_col)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, out_col])


def _digest(batches, name: str):
    """Checksum of the best path's ids, and whether they decode to the text."""
    lattice = worker_lattice(name)
    for b in batches:
        texts_, paths = b.column(1), b.column(2)
        n, crc, same = [], [], []
        for i in range(len(b)):
            ids = paths[i].values.field(1)[0].values
            n.append(len(ids)), crc.append(zlib.crc32(ids.to_numpy().astype("<u4").tobytes()))
            same.append(lattice.decode(ids) == texts_[i].as_py())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), b.column(3), b.column(4), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "score", "second_score", "round_trip"])


def _with(rows: DataFrame, column: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), column])


def segment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", n: int = 2) -> DataFrame:
    """doc_id, text, paths: the n best segmentations, best first, each its score and its ids (fewer where there are no more)."""
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(partial(_encode, name=model, n=n), _with(rows, "paths array<struct<score:double,ids:array<int>>>"))


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = "piece_bpe_32k.model") -> DataFrame:
    """rows with the text that the ids stand for; null ids give null."""
    return rows.mapInArrow(partial(_decode, name=model, ids_col=ids_col, out_col=out_col), _with(rows, f"`{out_col}` string"))


def op5_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and checksum of the best segmentation, its score, the second's, and whether it decodes to the text."""
    score = lambda k: F.try_element_at("paths", F.lit(k))["score"].alias("score" if k == 1 else "second_score")
    found = segment(table(spark, sf_dir, "documents")).select("doc_id", "text", "paths", score(1), score(2))
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(partial(_digest, name="piece_bpe_32k.model"), f"doc_id {kind}, n_pieces long, ids_crc32 long, score double, second_score double, round_trip boolean")
