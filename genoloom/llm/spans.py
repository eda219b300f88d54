"""Removal of word spans that a corpus holds earlier, by suffix automata of reference shards.

A window is ``words`` consecutive words.  Of equal windows the first one, by document and
place, stays; every word that another one covers goes.

The whole corpus is its own reference, so no bound holds for an automaton that everyone is
sent.  Instead reference and documents are cut so that equal windows meet.  A window's
anchor is the smallest hash among its n-grams; a piece is a stretch of windows with one
anchor at one place, and windows of an anchor that occurs once are first ones.  Equal pieces
count as one, the earliest, before anything but hashes moves.  The others are dealt to
shards by anchor.  A shard's task takes its pieces in order of document and place and
streams each through the automaton of those before it: where the matching length reaches
the window, the window occurred earlier.  Then the piece joins the automaton, unless all of
it is there already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import _P, _powers_upto, arrow_slices, extended, mixed, word_hashes
from genoloom.llm.sketch import bloom_of, in_bloom
from genoloom.llm.words import flat_words, joined
from genoloom.operators.requests import is_small, sized
from genoloom.session import cut_lineage

SLICE = 1 << 18
SHARD_PIECES = 2_000    # pieces that one automaton takes, about
ANCHOR_PIECES = 8_000   # an anchor of more different pieces is dealt by windows instead
BLOOM_PIECES = 4_000_000  # up to so many pieces a Bloom filter tells where to cut them out


@dataclass(frozen=True)
class Shape:
    words: int = 20   # of a window
    anchor: int = 5   # words of an n-gram


class Automaton:
    """The suffix automaton of a growing set of word sequences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def matched(self, words: list[bytes]) -> list[int]:
        """For each word, how many words up to it are a stretch of some sequence here."""
        state, n, out, nxt, link, length = 0, 0, [], self.next, self.link, self.length
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is not None:
                state, n = to, n + 1
            out.append(n)
        return out

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            to = nxt[last].get(w)
            if to is not None:
                last = to if length[to] == length[last] + 1 else self._split(last, w, to)
                continue
            new, p = len(nxt), last
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and (to := nxt[p].get(w)) is None:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                link[new] = to if length[to] == length[p] + 1 else self._split(p, w, to)
            last = new

    def _split(self, p: int, w: bytes, old: int) -> int:
        """A state of the shorter stretches of ``old``, those that come by way of ``p``."""
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[old]))
        link.append(link[old])
        length.append(length[p] + 1)
        link[old] = new
        while p >= 0 and nxt[p].get(w) == old:
            nxt[p][w] = new
            p = link[p]
        return new


@dataclass
class Pieces:
    """The pieces of a slice of texts, as arrays."""

    text: np.ndarray     # which text
    start: np.ndarray    # first word, within the text
    windows: np.ndarray  # how many
    anchor: np.ndarray
    content: np.ndarray  # hash of all words
    counts: np.ndarray   # words of each text


def pieces_of(texts: pa.Array, shape: Shape) -> Pieces:
    hashes, counts = word_hashes(texts, lower=False)
    n, size = len(hashes), shape.words - shape.anchor + 1
    windows = np.maximum(counts - shape.words + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none, none, counts)
    with np.errstate(over="ignore"):
        grams = np.zeros(n, np.uint64)
        for j in range(shape.anchor):
            grams[:n - j] = grams[:n - j] * _P + hashes[j:]
            grams[n - j:] = 0
        grams = mixed(grams)
        up, down = _powers_upto(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])])
    least, place, span = grams, np.arange(n), 1
    while span < size:  # smallest n-gram of each window, the leftmost of equal ones
        step = min(span, size - span)
        left = least[:-step] <= least[step:]
        least, place = np.where(left, least[:-step], least[step:]), np.where(left, place[:-step], place[step:])
        span += step
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(windows.sum()) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(windows)])[:-1], windows)
    place = place[at]
    cut = np.flatnonzero(np.diff(place, prepend=-1))
    start, many = at[cut], np.diff(np.append(cut, len(at)))
    text = np.searchsorted(first, start, side="right") - 1
    with np.errstate(over="ignore"):
        content = mixed((sums[start + many + shape.words - 1] - sums[start]) * down[start] + many.astype(np.uint64))
    return Pieces(text, start - first[text], many, grams[place[cut]].view(np.int64), content.view(np.int64), counts)


def _key(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One number of a piece; used to tell where it may be, not to tell pieces apart."""
    with np.errstate(over="ignore"):
        return mixed(anchor.view(np.uint64) * _P + content.view(np.uint64)).view(np.int64)


def _anchors(docs: DataFrame, shape: Shape) -> DataFrame:
    """(anchor, n): how many pieces have it, summed in each slice and task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "text", SLICE):
            anchor, n = np.unique(pieces_of(part.column("text"), shape).anchor, return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": anchor, "n": n})

    return docs.select("text").mapInArrow(work, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))


def _occurrences(docs: DataFrame, repeated: DataFrame, shape: Shape) -> DataFrame:
    """(id, v, start, windows, anchor, content) of all pieces whose anchor is in ``repeated``,
    and of some others: a filter of fixed size decides."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(repeated))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "text", SLICE):
            p = pieces_of(part.column("text"), shape)
            on = in_bloom(shared.value, p.anchor)
            row = pa.array(p.text[on])
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id").take(row), "v": part.column("v").take(row), "start": p.start[on].astype(np.int32),
                "windows": p.windows[on].astype(np.int32), "anchor": p.anchor[on], "content": p.content[on]})

    return docs.mapInArrow(work, "id bigint, v bigint, start int, windows int, anchor bigint, content bigint")


def _cut_out(docs: DataFrame, kinds: DataFrame, n_kinds: int, shape: Shape) -> DataFrame:
    """(id, v, start, anchor, words): the words of the earliest piece of each kind at least.

    Few kinds are found by a Bloom filter where the texts lie; then a few other pieces come
    too, which changes nothing.  With more kinds, texts meet their own pieces.
    """
    few = n_kinds <= BLOOM_PIECES
    added = "id bigint, v bigint, start int, anchor bigint, words binary"
    if few:
        def code(ids: pa.Array, start: np.ndarray, content: np.ndarray) -> np.ndarray:
            return _key(_key(ids.fill_null(-1).to_numpy(), start.astype(np.int64)), content)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict({
                    "code": code(b.column("id"), b.column("start").to_numpy(), b.column("content").to_numpy())})

        codes = kinds.select("id", "start", "content").mapInArrow(keyed, "code bigint")
        shared = docs.sparkSession.sparkContext.broadcast(bloom_of(codes))
    else:
        own = kinds.groupBy("id", "v").agg(F.collect_list("start").alias("starts"))
        docs = docs.join(own.hint("shuffle_hash"), docs["id"].eqNullSafe(own["id"]) & (docs["v"] == own["v"])).select(
            docs["*"], "starts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "text", SLICE):
            texts = part.column("text")
            p = pieces_of(texts, shape)
            if few:
                on = in_bloom(shared.value, code(part.column("id").take(pa.array(p.text)), p.start, p.content))
            else:
                on = np.zeros(len(p.start), bool)
                first = np.searchsorted(p.text, np.arange(len(texts) + 1))
                for k, starts in enumerate(part.column("starts")):
                    own = slice(first[k], first[k + 1])
                    on[own] = np.isin(p.start[own], starts.values.to_numpy())
            words, _ = flat_words(texts)
            at = np.concatenate([[0], np.cumsum(p.counts)])[p.text[on]] + p.start[on]
            sizes = p.windows[on] + shape.words - 1
            flat = np.repeat(at - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())
            row = pa.array(p.text[on])
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id").take(row), "v": part.column("v").take(row), "start": p.start[on].astype(np.int32),
                "anchor": p.anchor[on],
                "words": joined(words.take(pa.array(flat)), np.ones(len(flat), bool), sizes).cast(pa.binary())})

    return docs.mapInArrow(work, added)


_FIRST = "id bigint, v bigint, start int, windows int"


def first_windows(pieces: list[tuple[tuple, int, list[bytes]]], words: int) -> Iterator[tuple[tuple, int, int]]:
    """Stretches (document, start, windows) of windows that no earlier piece holds; pieces
    are (document, start, words) by document and place."""
    seen = Automaton()
    for doc, start, text in pieces:
        lengths = seen.matched(text)
        if lengths[-1] < len(text):
            seen.add(text)
        at = None
        for i, n in enumerate(lengths[words - 1:]):
            if n < words and at is None:
                at = i
            elif n >= words and at is not None:
                yield doc, start + at, i - at
                at = None
        if at is not None:
            yield doc, start + at, len(text) - words + 1 - at


def _streamed(rows: DataFrame, shards: int, shape: Shape) -> DataFrame:
    """First windows of pieces dealt by anchor, each shard against its own automaton."""

    def work(table: pa.Table) -> pa.Table:
        ids, v, start, words = (table.column(c).to_pylist() for c in ("id", "v", "start", "words"))
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, v[k], start[k]))
        found = list(first_windows([((ids[k], v[k]), start[k], words[k].split()) for k in order], shape.words))
        return pa.table({
            "id": pa.array([d[0] for d, _, _ in found], pa.int64()), "v": pa.array([d[1] for d, _, _ in found], pa.int64()),
            "start": pa.array([s for _, s, _ in found], pa.int32()), "windows": pa.array([n for _, _, n in found], pa.int32())})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    return rows.select("id", "v", "start", "words", shard).groupBy("shard").applyInArrow(work, _FIRST)


def _by_window(rows: DataFrame, shape: Shape) -> DataFrame:
    """First windows of pieces whose anchor has too many kinds for one task: each window is
    a row of its own, by digest, and equal ones are merged before they move."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "words", SLICE >> 4):
            ids, v, start, words = [], [], [], []
            for i, j, s, text in zip(*(part.column(c).to_pylist() for c in ("id", "v", "start", "words")), strict=True):
                text = text.split()
                for k in range(len(text) - shape.words + 1):
                    ids.append(i)
                    v.append(j)
                    start.append(s + k)
                    words.append(blake2b(b" ".join(text[k:k + shape.words]), digest_size=16).digest())
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()), "v": pa.array(v, pa.int64()), "start": pa.array(start, pa.int32()),
                "words": pa.array(words, pa.binary())})

    windows = rows.select("id", "v", "start", "words").mapInArrow(work, "id bigint, v bigint, start int, words binary")
    first = windows.groupBy("words").agg(F.min(F.struct("id", "v", "start")).alias("m"))
    return first.select("m.id", "m.v", "m.start", F.lit(1).alias("windows"))


def _first_windows(docs: DataFrame, occurrences: DataFrame, shape: Shape) -> DataFrame:
    """Stretches of windows among the occurrences that are the first of their words."""
    kinds = occurrences.groupBy("anchor", "content").agg(
        F.min(F.struct("id", "v", "start", "windows")).alias("m"), F.count(F.lit(1)).alias("times"))
    kinds = cut_lineage(kinds.select("anchor", "content", "m.*", "times"))
    totals = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("times"))
    many = cut_lineage(totals.where(F.col("kinds") > ANCHOR_PIECES).select("anchor", F.lit(True).alias("hot")))
    once = totals.where("times = 1").select("anchor")
    alone = cut_lineage(kinds.where("times = 1").join(once, "anchor", "left_semi").select("id", "v", "start", "windows", "anchor"))
    asked = cut_lineage(kinds.join(alone.select("anchor"), "anchor", "left_anti"))
    n = asked.count()
    rows = _cut_out(docs, asked, n, shape)
    if not many.isEmpty():
        rows = cut_lineage(rows.join(sized(many, is_small(many)), "anchor", "left"))
        found = _streamed(rows.where("hot is null"), max(1, n // SHARD_PIECES), shape).union(_by_window(rows.where("hot"), shape))
    else:
        found = _streamed(rows, max(1, n // SHARD_PIECES), shape)
    return found.union(alone.drop("anchor"))


def deduplicated(docs: DataFrame, shape: Shape = Shape(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words that stay joined by one
    space.

    A word is a run of characters other than space and \\t \\n \\v \\f \\r, as it stands.  A null
    or empty text has none; one of fewer words than a window loses none.  A null id counts
    as smaller than all others.  Different texts under one id are documents of their own,
    ordered by a hash of the text; rows that repeat id and text are one document, with one
    result on each.  Columns of these three names are replaced, others stay.
    """
    kept = docs.drop("n_words", "n_removed", "kept")
    thin = kept.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("v"))
    versions = not thin.groupBy("id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").isEmpty()
    key = [F.col(id_col).cast("bigint").alias("id"), (F.xxhash64(text_col) if versions else F.lit(0).cast("bigint")).alias("v")]
    texts = kept.select(*key, F.col(text_col).alias("text"))

    repeated = cut_lineage(_anchors(texts, shape).where("n > 1").select("anchor"))
    occurrences = cut_lineage(_occurrences(texts, repeated, shape))
    first = _first_windows(texts, occurrences, shape)
    marks = occurrences.select("id", "v", "start", "windows", F.lit(False).alias("first")).union(
        first.select("id", "v", "start", "windows", F.lit(True).alias("first")))
    # Both as one number: the place, the number of windows, whether they are first ones.
    code = (F.col("start").cast("bigint") * (1 << 21) + F.col("windows") * 2 + F.col("first").cast("int")).alias("code")
    marks = marks.select("id", "v", code).groupBy("id", "v").agg(F.collect_list("code").alias("marks"))
    marks = marks.select(F.col("id").alias("_id"), F.col("v").alias("_v"), "marks")
    here = kept.select(*[F.col(c) for c in kept.columns], *[k.alias(f"_{c}") for k, c in zip(key, ("doc", "version"), strict=True)])
    met = here.join(marks.hint("shuffle_hash"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("_v")), "left")
    met = met.select(*kept.columns, F.col("marks").alias("_marks"))
    names = [*kept.columns, "n_words", "n_removed", "kept"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, text_col, SLICE):
            words, counts = flat_words(part.column(text_col))
            first_word = np.concatenate([[0], np.cumsum(counts)])
            marks = part.column("_marks")
            sizes = np.array([len(m) if m.is_valid else 0 for m in marks])
            code = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            start, many = (code >> 21) + np.repeat(first_word[:-1], sizes), (code >> 1) & ((1 << 20) - 1)
            covered = [np.cumsum(np.bincount(start[on], minlength=len(words) + 1)
                                 - np.bincount((start + many)[on], minlength=len(words) + 1)) > 0
                       for on in (code % 2 == 0, code % 2 == 1)]
            again = np.flatnonzero(covered[0] & ~covered[1])
            gone = np.cumsum(np.bincount(again, minlength=len(words) + 1)
                             - np.bincount(again + shape.words, minlength=len(words) + 1))[:len(words)] > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first_word[:-1]) * (counts > 0) if len(counts) else counts
            yield pa.RecordBatch.from_arrays(
                [*part.drop_columns(["_marks"]).columns, pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)),
                 joined(words, ~gone, counts).cast(pa.large_string()).cast(pa.string())],
                names=names)

    return met.mapInArrow(work, extended(kept, "n_words bigint, n_removed bigint, kept string"))
