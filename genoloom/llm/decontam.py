"""Benchmark decontamination by q-gram filtering and banded alignment.

An item counts as leaked if a stretch of a document is within the edit budget of the whole
item, on normalized text; an item longer than a window, if that holds for one of its
windows; and any item longer than an excerpt, if that holds for one of its short parts,
which start so close together that every verbatim excerpt of that length holds a whole one.
A stretch with at most e edits against an item of m characters
shares at least m + 1 - q * (e + 1) q-grams with it, on diagonals that lie at most e apart.
So shared q-grams are counted in diagonal bands of more than 2e + 1 diagonals that overlap
by e, bands that reach the bound are kept, and each is verified by an alignment that stays
in the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import arrow_slices, mixed
from genoloom.session import cut_lineage

_P = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


@dataclass(frozen=True)
class Settings:
    q: int = 8                # characters of a q-gram
    rate: float = 0.05        # edits for each character of an item, rounded down
    least: int = 40           # items of fewer normalized characters are matched without edits, as whole words
    window: int = 800         # longer items are searched for as windows of that size, half overlapping
    excerpt: int = 250        # of longer items a verbatim excerpt of so many characters is found, whatever its offset,
    part: int = 200           # as parts of that size that start excerpt - part apart are searched for, too
    block_chars: int = 4 << 20  # benchmark characters that are indexed and broadcast at once

    def budget(self, m: int) -> int:
        """The edits that an item of m characters is granted: as many as the rate gives and
        the q-gram bound can still tell from chance."""
        if m < self.least:
            return 0
        return max(0, min(int(self.rate * m), (m + 1 - 2 * self.q) // self.q - 1))

    def bound(self, m: int) -> int:
        return m + 1 - self.q * (self.budget(m) + 1)


def _codes(text: str | None) -> np.ndarray:
    """Code points, lower-cased, each run of other than letters and digits as one space."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(raw):
        return raw
    plain = _WORDLIKE[np.minimum(raw, len(_WORDLIKE) - 1)] | (raw >= len(_WORDLIKE))
    codes = np.where(plain, raw, np.uint32(32))
    keep = plain | np.concatenate([[False], plain[:-1]])
    return codes[keep]


_SPACE = np.array([32], np.uint32).tobytes()
_WORDLIKE = np.array([chr(c).isalnum() for c in range(0x3000)])


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    size, h, done, out = 1, codes.astype(np.uint64) + np.uint64(1), 0, None
    power = np.array([_P])
    while size <= q:  # h: hashes of ``size`` characters
        if q & size:
            out = h.copy() if out is None else out[:len(h) - done] * power + h[done:]
            done += size
        if 2 * size > q:
            break
        h = h[:-size] * power + h[size:]
        power, size = power * power, 2 * size
    return mixed(out[:len(codes) - q + 1])


class Index:
    """The q-grams of a block of items: sorted hashes with item and place of each."""

    def __init__(self, items: list[tuple[int, str]], s: Settings):
        self.s = s
        self.ids = [i for i, _ in items]
        self.codes = [_strip(_codes(t)) for _, t in items]
        hashes = [_grams(c, s.q) for c in self.codes]
        self.hash = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items), dtype=np.int64), [len(h) for h in hashes])
        self.place = np.concatenate([*[np.arange(len(h), dtype=np.int64) for h in hashes], np.zeros(0, np.int64)])
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.hash >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.units = [_units(len(c), s) for c in self.codes]
        self.bounds = np.array([min(s.bound(size) for size, _ in u) for u in self.units], np.int64)
        self.tiny = [(k, b"".join((_SPACE, c.tobytes(), _SPACE))) for k, c in enumerate(self.codes) if 0 < len(c) < s.q]

    def leaks(self, codes: np.ndarray) -> dict[int, int]:
        """Items found in a text and their edits."""
        found: dict[int, int] = {}
        h = _grams(codes, self.s.q)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if len(at):
            low = np.searchsorted(self.hash, h[at], "left")
            many = np.searchsorted(self.hash, h[at], "right") - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            each = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            # Most items share some q-grams with a text, few as many as their bound.
            item = self.item[each]
            on = np.bincount(item, minlength=len(self.ids))[item] >= self.bounds[item] if len(item) else np.zeros(0, bool)
            if on.any():
                each = each[on]
                self._bands(codes, item[on], np.repeat(at, many)[on] - self.place[each], self.place[each], found)
        if self.tiny:
            text = b"".join((_SPACE, codes.tobytes(), _SPACE))
            for k, word in self.tiny:
                if _inside(word, text, 4):
                    found[self.ids[k]] = 0
        return found

    def _bands(self, codes, item, diagonal, place, found: dict[int, int]) -> None:
        order = np.lexsort((diagonal, item))
        item, diagonal, place = item[order], diagonal[order], place[order]
        edges = np.flatnonzero(np.diff(item)) + 1
        for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(item)]]), strict=True):
            k = int(item[a])
            if self.ids[k] in found:
                continue
            if len(self.codes[k]) < self.s.least:
                if _stands_in(codes, self.codes[k], diagonal[a:b]):
                    found[self.ids[k]] = 0
                continue
            for size, starts in self.units[k]:
                edits = self._unit(codes, self.codes[k], size, starts, diagonal[a:b], place[a:b])
                if edits is not None:
                    found[self.ids[k]] = edits
                    break

    def _unit(self, codes, item, size: int, starts: np.ndarray, diagonal, place) -> int | None:
        """The fewest edits of the first of an item's stretches from ``starts`` on that is found."""
        e, bound = self.s.budget(size), self.s.bound(size)
        if len(place) < bound:
            return None
        low = np.searchsorted(starts, place - (size - self.s.q), "left")
        many = np.searchsorted(starts, place, "right") - low  # how many stretches hold a q-gram
        which = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        d = np.repeat(diagonal, many)
        width = 2 * e + 2
        bands = d // width
        more = d - bands * width < e  # the last band reaches e further
        least = int(bands.min()) - 1
        n_bands = int(bands.max()) - least + 1
        names = which * n_bands + bands - least
        names, counts = np.unique(np.concatenate([names, names[more] - 1]), return_counts=True)
        best = last = None
        for n, band in zip(*divmod(names[counts >= bound], n_bands), strict=True):
            n, band = int(n), int(band) + least
            if best is not None and n != last:
                break
            last, start = n, int(starts[n])
            low, high = band * width, (band + 1) * width + e - 1
            if _verbatim(codes, item[start:start + size], d[(which == n) & (d >= low) & (d <= high)] + start, self.s.q):
                return 0
            edits = within(item[start:start + size], codes, low + start, high + start, e)
            if edits is not None and (best is None or edits < best):
                best = edits
        return best


def _verbatim(codes: np.ndarray, item: np.ndarray, places: np.ndarray, q: int) -> bool:
    """Whether an item stands in a text as it is, at a place that all its q-grams speak for."""
    at, counts = np.unique(places, return_counts=True)
    return any((codes[k:k + len(item)] == item).all() for k in at[counts == len(item) - q + 1].tolist()
               if k >= 0 and k + len(item) <= len(codes))


def _stands_in(codes: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> bool:
    """Whether an item stands in a text, as whole words, on one of the diagonals."""
    for at in np.unique(diagonal).tolist():
        end = at + len(item)
        if at >= 0 and end <= len(codes) and (not at or codes[at - 1] == 32) and (end == len(codes) or codes[end] == 32) \
                and (codes[at:end] == item).all():
            return True
    return False


def _strip(codes: np.ndarray) -> np.ndarray:
    return codes[:-1] if len(codes) and codes[-1] == 32 else codes


def _units(m: int, s: Settings) -> list[tuple[int, np.ndarray]]:
    """Sizes and starts of the stretches of an item of m characters that are searched for."""
    out = [(min(m, s.window), _starts(m, s.window, s.window // 2))]
    if m > s.excerpt:
        out.append((s.part, _starts(m, s.part, s.excerpt - s.part)))
    return out


def _starts(m: int, size: int, step: int) -> np.ndarray:
    return np.array([*range(0, m - size, step), max(0, m - size)], np.int64)


def _inside(part: bytes, whole: bytes, step: int) -> bool:
    at = whole.find(part)
    while at >= 0 and at % step:
        at = whole.find(part, at + 1)
    return at >= 0


def within(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int | None:
    """The fewest edits that turn the item into a stretch of the text that starts on a
    diagonal (text place less item place) from low to high, kept within ``most`` of these;
    None if more than ``most``."""
    low, high = low - most, high + most
    n, width = len(text), high - low + 1
    far = most + 1
    # row[d]: fewest edits for item[:i] against a stretch that ends at text place i + low + d
    at = low + np.arange(width)
    row = np.where((at >= 0) & (at <= n), 0, far)
    steps = np.arange(width)
    for i in range(1, len(item) + 1):
        at = at + 1
        there = (at >= 0) & (at <= n)
        letter = np.full(width, -1, np.int64)
        ok = (at >= 1) & (at <= n)
        letter[ok] = text[at[ok] - 1]
        new = row + (letter != item[i - 1])                       # match or replace
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)              # the text lacks the letter
        new = np.where(there, new, far)
        new = np.minimum.accumulate(new - steps) + steps          # the text has letters more
        row = np.where(there, np.minimum(new, far), far)
        if row.min() > most:
            return None
    return int(row.min())


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, edits): each item that a document contains within the item's budget,
    whole or, as the module says, in part; the edits are the whole's, else the part's.

    Texts are compared lower-cased, with one space for each run of other characters than
    letters and digits.  An item of fewer than ``least`` characters counts without edits and
    as whole words only: "yes" is not in "eyes", but an item of one common word is in very
    many documents.  Items are indexed and broadcast in blocks of a bounded number of
    characters, each met with all documents; one longer than a block is a block.  Null and
    empty items and texts match nothing, null ids are kept as they are, repeated documents
    come out repeated, repeated items once for each.  Of other columns none is read.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("text is not null")
    items = cut_lineage(benchmark.select("item_id", "text").where("text is not null and length(text) > 0").withColumn(
        "chars", F.length("text").cast("long")))
    out = None
    for block in _blocks(items, s.block_chars):
        shared = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in block], s))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for part in arrow_slices(batches, "text"):
                rows = [(doc, item, edits)
                        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                        for item, edits in index.leaks(_codes(text)).items()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "item_id", "edits"])

        found = texts.mapInArrow(work, "doc_id bigint, item_id bigint, edits int")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint, edits int")


def _blocks(items: DataFrame, chars: int) -> Iterator[list]:
    """Items in blocks of about ``chars`` characters, one block on the driver at a time."""
    total = items.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    if not total:
        return
    n = -(-total // chars)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if block:
            yield block


def without_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without those that contain an item.  Rows without an id stay."""
    found = cut_lineage(leaks(docs.where("doc_id is not null"), benchmark, s).select("doc_id").distinct())
    return docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti")
