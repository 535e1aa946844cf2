"""Words of many texts at once: Arrow buffers cut by byte class, so that a task never loops over words.

Texts are UTF-8, where every byte of a character beyond ASCII is 0x80 or more; a class of ASCII characters and
"all others" is therefore a class of bytes, and cutting bytes cuts the same words as cutting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B = np.arange(256)
#: Words `[^\x20\x09-\x0D]+`.
UNSPACED = ~((_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D)))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased.
LETTERS = ((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
LOWER = np.where((_B >= 0x41) & (_B <= 0x5A), _B + 32, _B).astype(np.uint8)


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `texts` (null: empty) back to back, and where each begins (one entry more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def binary(data: np.ndarray, off: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Bytes and offsets as an Arrow array (of `binary` unless `kind` says `string`)."""
    return pa.Array.from_buffers(kind or pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """`batches` cut into runs of rows whose `column` has at most `limit` bytes, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
        pa.default_memory_pool().release_unused()


def cut(data: np.ndarray, off: np.ndarray, keep: np.ndarray, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words in order as one binary array."""
    if lower:
        data = LOWER[data]
    m = keep[data]
    n = len(m)
    edge = off[(off > 0) & (off < n)]
    begins, ends = m.copy(), m.copy()
    begins[1:] &= ~m[:-1]
    ends[:-1] &= ~m[1:]
    begins[edge] = m[edge]
    ends[edge - 1] = m[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(start, off))
    return counts, binary(data[m], np.concatenate(([0], np.cumsum(stop - start))))


def distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each word its place among the distinct words, and these."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
