"""TF-IDF centroids of groups of sentences, for a block of rows at a time, over arrays in tasks.

Terms are runs of lower-case ASCII letters and digits of texts that are lower-cased already. A place is one sentence, or all
sentences of one order; each place belongs to a group, and a group's title joins its centroid without being a place."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 256  # rows a block
LETTER = np.zeros(256, bool)
LETTER[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all terms, equal for equal terms, and the text each stands in."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, bounds = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
    inside = LETTER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = bounds[:-1][bounds[:-1] < len(data)]
    first[starts] = inside[starts]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(np.add.reduceat(inside, at, dtype=np.int64), out=ends[1:])
    found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return found.dictionary_encode().indices.to_numpy().astype(np.int64), np.searchsorted(bounds, at, "right") - 1


def cosines(texts: pa.Array, places: np.ndarray, groups: np.ndarray, sizes: np.ndarray, titles: pa.Array) -> np.ndarray:
    """Cosine of each place's vector to its group's centroid, nan without terms; places of texts, groups of places, sentences and titles of groups."""
    n, real = len(groups), np.arange(len(groups) + len(sizes)) < len(groups)
    if titles.null_count < len(titles):
        texts, places = pa.concat_arrays([texts, titles]), np.concatenate([places, n + np.arange(len(sizes))])
    groups = np.concatenate([groups, np.arange(len(sizes))])
    term, text = terms_of(texts)
    kinds = int(term.max(initial=0)) + 1
    pair, tf = np.unique(places[text] * kinds + term, return_counts=True)
    place = pair // kinds
    key, at = np.unique(groups[place] * kinds + pair % kinds, return_inverse=True)
    df, every, group = np.bincount(at, real[place], len(key)), np.bincount(at, tf, len(key)), key // kinds
    idf = np.log((1 + sizes[group]) / (1 + df)) + 1
    center = np.where(df > 0, every * idf, 0.0)
    size = np.sqrt(np.bincount(group, center * center, len(sizes)))
    w = tf * idf[at]
    met, own = np.bincount(place, w * center[at], len(groups))[:n], np.bincount(place, w * w, len(groups))[:n]
    return np.divide(met, np.sqrt(own) * size[groups[:n]], out=np.full(n, np.nan), where=own > 0)


def best(scores: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """The k best places of each group; the first of equals."""
    live = np.flatnonzero(~np.isnan(scores))
    order = live[np.lexsort((live, -np.round(scores[live], 9), groups[live]))]
    own = groups[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < max(1, k)]


def by_blocks(one, kind: T.DataType):
    """A column function of lists and a title that takes blocks of rows through one(values of each list, lengths, titles), which gives values and their number for each row."""

    @F.arrow_udf(T.ArrayType(kind))
    def apply(texts: pa.Array, again: pa.Array, firsts: pa.Array, titles: pa.Array) -> pa.Array:
        parts = []
        for a in range(0, len(texts), BLOCK):
            own = [x.slice(a, BLOCK) for x in (texts, again, firsts)]
            lengths = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in own]
            values, counts = one(own[0].flatten(), own[1].flatten().to_numpy(zero_copy_only=False).astype(bool), own[2].flatten().to_numpy(zero_copy_only=False), lengths[0], lengths[2], titles.slice(a, BLOCK))
            parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return apply


def chosen(per_chunk: int, most: int):
    """For each row the 0-based places of the best sentences of each chunk, and of these the best of all."""

    def one(texts, again, firsts, lengths, chunks, titles):
        row, start = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
        head = np.zeros(len(row), bool)
        head[firsts + np.repeat(start, chunks)] = True
        chunk, place = np.cumsum(head) - 1, np.cumsum(~again) - 1
        at = np.flatnonzero(head | ~again)  # the first sentence of each place of a chunk
        scores = cosines(texts, np.cumsum(head | ~again) - 1, chunk[at], np.bincount(chunk, minlength=len(firsts)), titles.take(pa.array(np.repeat(np.arange(len(lengths)), chunks))))
        some = np.flatnonzero(np.isin(place, place[at[best(scores, chunk[at], per_chunk)]]))
        _, at, own = np.unique(place[some], return_index=True, return_inverse=True)
        scores = cosines(texts.take(pa.array(some)), own, row[some][at], np.bincount(row[some], minlength=len(lengths)), titles)
        kept = some[np.isin(own, best(scores, row[some][at], most))]
        return pa.array(kept - start[row[kept]], pa.int32()), np.bincount(row[kept], minlength=len(lengths))

    return by_blocks(one, T.IntegerType())


def scores():
    """For each row, as one chunk, the cosine of each place."""

    def one(texts, again, firsts, lengths, chunks, titles):
        row, at = np.repeat(np.arange(len(lengths)), lengths), np.flatnonzero(~again)
        found = cosines(texts, np.cumsum(~again) - 1, row[at], lengths, titles)
        return pa.array(found, pa.float64(), from_pandas=True), np.bincount(row[at], minlength=len(lengths))

    return by_blocks(one, T.DoubleType())
