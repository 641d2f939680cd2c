"""Words of texts as Arrow arrays and numpy codes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 22   # text split at once; a longer text is a slice of its own


def byte_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (first, end) of rows of an Arrow string array that hold at most ``limit`` bytes, or one row."""
    offsets = _offsets(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end
        first = end


def batches_of(batches, column: int, limit: int) -> Iterator[list]:
    """Lists of consecutive Arrow batches with about ``limit`` bytes of texts in ``column``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        offsets = _offsets(batch.column(column))
        size += int(offsets[-1] - offsets[0])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _offsets(column) -> np.ndarray:
    wide = str(column.type) in ("large_string", "large_binary")
    raw = column.buffers()[1]
    if raw is None:
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(raw, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def split_words(column, letter: np.ndarray, fold: np.ndarray | None = None):
    """(words, counts): all words of an Arrow string array without nulls, and how many each row has.

    ``letter`` tells for each of the 256 byte values whether it belongs to a
    word; ``fold`` maps byte values first.  Words never cross rows.
    """
    import pyarrow as pa

    offsets = _offsets(column)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    if fold is not None:
        data = fold[data]
    inside = letter[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)   # a row starts here
    fresh[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | fresh[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    places = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=places[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data[inside].tobytes())])
    return words, np.diff(np.searchsorted(starts, offsets))


def coded(words) -> tuple[np.ndarray, list[bytes]]:
    """The code of each word and the distinct words by code."""
    if not len(words):
        return np.zeros(0, dtype=np.int64), []
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def byte_set(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)
