"""All words of a slice of texts as one flat array, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = (9, 10, 11, 12, 13, 32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SEPARATORS)] = True


def flat_words(texts: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all texts, one after the other, and each text's number of words.

    A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, as it stands;
    nulls have none.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    data = np.frombuffer(b"\n".join(t.as_buffer() if t.is_valid else b"" for t in texts), np.uint8)
    inside = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())])
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    return words, np.diff(np.searchsorted(starts, first))


def joined(words: pa.LargeBinaryArray, keep: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space; ``counts`` are the words of each text."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    upto = np.concatenate([[0], np.cumsum(keep)])[ends]
    rows = pa.LargeListArray.from_arrays(pa.array(upto.astype(np.int64)), words.filter(pa.array(keep)))
    return pc.binary_join(rows, pa.scalar(b" ", pa.large_binary()))
