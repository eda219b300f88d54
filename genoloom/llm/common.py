"""What several operators share: tables, bounded Arrow batches, hashes of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 256 << 10
_P = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_bytes(spark: SparkSession, path: str) -> Broadcast:
    """A small model file, read once by the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def extended(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` with more columns at its end."""
    return StructType([*df.schema.fields, *(StructType.fromDDL(added).fields if added else [])])


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of a number written as text, modulo n."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        upto = np.cumsum(np.asarray(sizes, np.int64))
        start = 0
        while start < len(upto):
            base = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, base + size, side="right")))
            yield batch.slice(start, end - start)
            start = end


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


# Powers of _P modulo 2**64 and of its inverse, grown as longer slices come.
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice of texts, and each text's number of words.

    A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, A-Z lower-cased if asked.
    A word's hash is its byte polynomial modulo 2**64, finalized; nulls have no words.
    """
    texts = pa.array(texts) if not isinstance(texts, pa.Array) else texts
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    data = np.frombuffer(b"\n".join(t.as_buffer() if t.is_valid else b"" for t in texts), np.uint8)
    data = _LOWER[data] if lower else data
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers_upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])  # where each text starts
    counts = np.diff(np.searchsorted(starts, first))
    return hashes, counts


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct hashes of k consecutive words, sorted; a text of fewer words
    gives its whole sequence as one, one without words gives none."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    joined = np.zeros(n, np.uint64)
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[:max(0, n - j)] = hashes[j:]
        joined = joined * _P + part
    joined = mixed(joined + np.uint64(k))
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(joined[at:at + c - k + 1]))
        elif c:
            h = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in hashes[at:at + c]:
                    h = h * _P + w
            out.append(mixed(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
