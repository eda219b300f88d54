"""Periodic runs of words: stretches that repeat one block of words four times or more.

Recursive frequency splitting comes first.  In a run with period q and at least 4 * q words
every word occurs four times at least, so a word that occurs less often within its segment
is in no run and splits the segment; the parts are counted anew until nothing changes.
All segments of a slice of texts are split side by side.

Surviving segments are scanned lag by lag.  A run of period q holds three blocks of q words
that start at multiples of q and are equal; comparing only such blocks, by rolling hashes,
takes m / q steps for lag q and m * log(m) for all.  What the hashes propose is then compared
word by word and extended both ways, so hashes cost time at most, never a result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from genoloom.llm.common import _powers_upto, arrow_slices, extended, mixed
from genoloom.llm.words import flat_words, joined

PAIRS = 1 << 18  # blocks compared at a time


@dataclass(frozen=True)
class Shape:
    """What counts as a run: at least ``words`` words and ``times`` periods (3 at least)."""

    words: int = 6
    times: int = 4

    def least(self, period: int) -> int:
        return max(self.words, self.times * period)


def split(ids: np.ndarray, counts: np.ndarray, shape: Shape) -> list[tuple[int, int]]:
    """Segments [from, to) of the flat words of several texts in which every word occurs
    ``shape.times`` times or more, none across two texts; all runs lie inside them."""
    place = np.arange(len(ids))
    part = np.repeat(np.arange(len(counts)), counts)
    n_ids = int(ids.max()) + 1 if len(ids) else 0
    done: list[tuple[int, int]] = []
    while len(place):
        _, which, often = np.unique(part * n_ids + ids[place], return_inverse=True, return_counts=True)
        keep = often[which] >= shape.times
        # Segments that lost nothing are stable.
        lost = np.bincount(part, ~keep)[part] > 0
        stable = ~lost
        if stable.any():
            at, of = place[stable], part[stable]
            cut = np.flatnonzero(np.diff(of)) + 1
            firsts, lasts = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
            done += zip(at[firsts].tolist(), (at[lasts] + 1).tolist(), strict=True)
        on = keep & lost
        place, of = place[on], part[on]
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(of) != 0)) + 1
        sizes = np.diff(np.concatenate([[0], cut, [len(place)]]))
        long = np.repeat(sizes >= shape.words, sizes)
        part = np.repeat(np.arange(len(sizes)), sizes)[long]
        part = np.unique(part, return_inverse=True)[1] if len(part) else part
        place = place[long]
    return sorted(s for s in done if s[1] - s[0] >= shape.words)


def _same_upto(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two arrays of one length share from the start."""
    at, step = 0, 64
    while at < len(a):
        differ = a[at:at + step] != b[at:at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return len(a)


def _proposed(ids: np.ndarray, shape: Shape) -> Iterator[tuple[int, int]]:
    """(period, start) of the first of three equal blocks in a row, shorter periods first."""
    m = len(ids)
    up, down = _powers_upto(m + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        blocks = m // np.arange(1, m // shape.times + 1)
        upto = np.concatenate([[0], np.cumsum(blocks)])
        at = 0
        while at < len(blocks):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
            q = np.repeat(np.arange(at + 1, end + 1), blocks[at:end])
            start = (np.arange(len(q)) - np.repeat(upto[at:end] - upto[at], blocks[at:end])) * q
            h = (sums[start + q] - sums[start]) * down[start]
            same = np.append((h[1:] == h[:-1]) & (q[1:] == q[:-1]), False)
            chain = same & np.append(same[1:], False)
            chain &= ~np.append(False, same[:-1])
            for i in np.flatnonzero(chain).tolist():
                yield int(q[i]), int(start[i])
            at = end


def lag_scan(ids: np.ndarray, shape: Shape) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, by start, then period."""
    found: dict[int, tuple[list[int], list[int]]] = {}  # period -> starts and ends, ascending
    for q, at in _proposed(ids, shape):
        # A run of a divisor around the block: the block's smallest period is not q.
        for d, (starts, ends) in found.items():
            if q % d == 0 and (k := bisect_right(starts, at)) and ends[k - 1] >= at + q:
                break
        else:
            back = _same_upto(ids[:at][::-1], ids[q:q + at][::-1])
            end = at + _same_upto(ids[at:len(ids) - q], ids[at + q:]) + q
            if end - at + back >= shape.least(q):
                starts, ends = found.setdefault(q, ([], []))
                starts.append(at - back)
                ends.append(end)
    return sorted((s, e - s, q) for q, (starts, ends) in found.items() for s, e in zip(starts, ends, strict=True))


def runs_of(ids: np.ndarray, counts: np.ndarray, shape: Shape) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """Each text's runs, and which of the flat words stay when runs keep one period."""
    first = np.concatenate([[0], np.cumsum(counts)])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    change = np.zeros(len(ids) + 1, np.int64)
    for lo, hi in split(ids, counts, shape):
        k = int(np.searchsorted(first, lo, side="right")) - 1
        for start, length, period in lag_scan(ids[lo:hi], shape):
            runs[k].append((lo + start - int(first[k]), length, period))
            change[lo + start + period] += 1
            change[lo + start + length] -= 1
    return runs, np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, shape: Shape = Shape(), *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period, counted in words
    from 0) and ``collapsed``: the words joined by one space without those that any run
    holds after its first period.

    A null or empty text has no words, no runs and an empty ``collapsed``.  Columns of
    these names are replaced, others stay; repeated rows give repeated results, and rows
    are independent of each other, so nothing is shuffled.  A text is held whole in one
    task, as some tens of bytes a word.
    """
    kept = docs.drop("n_words", "runs", "collapsed")
    added = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, text_col):
            words, counts = flat_words(part.column(text_col))
            ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs, keep = runs_of(ids, counts, shape)
            flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(struct))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), fields),
                 joined(words, keep, counts).cast(pa.large_string()).cast(pa.string())],
                names=[*part.schema.names, "n_words", "runs", "collapsed"])

    return kept.mapInArrow(work, extended(kept, added))
