"""Texts cut into parts, so that each distinct part of a batch is worked out once.

A batch of texts is one byte buffer. Cuts are found over the whole buffer, the parts between them are
dictionary encoded by Arrow, and results of the distinct parts are spread over all parts again.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES, SLICE = 4 << 20, 512


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that a task holds the Python objects of few at a time; buffers go back at the end."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole rows of about `most` bytes (one longer row is a slice by itself), with their first row."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and the offset of each row (and of the end)."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each part from one start to the next (the last to the end of data) the number of its kind; and the kinds."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    parts = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = parts.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def spread(offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of each part lie among those of the kinds (cut at offsets), and the offset of each part's values."""
    size = np.diff(offsets)[kind]
    ends = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(offsets[kind] - ends[:-1], size) + np.arange(ends[-1]), ends
