"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words of a text and their beginnings - that one occurs, occurs
twice, makes up a share of the text - is trained from confirmed toxic texts and unlabelled
ones.  The risk on negatives is estimated as the risk on
unlabelled text less the class prior times that on positives, and kept from falling below
zero, where it would reward overfitting.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import arrow_slices, extended
from genoloom.session import cut_lineage

WORDS = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = range(3, 8)
CACHED_WORDS = 100_000
SHARE = 150  # a gram is dense from one word in so many on


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the model; none of them touches scoring."""

    positives: int = 5_000   # confirmed toxic texts, about
    unlabelled: int = 8_000  # unlabelled texts, about
    width: int = 1 << 16     # weights; grams are hashed into them
    support: int = 3         # toxic texts that have a gram
    least_z: float = 4.0     # by how many standard errors a gram's toxic rate exceeds its unlabelled rate,
    least_lift: float = 4.0  # and how many times as large it has to be
    steps: int = 600
    decay: float = 1e-4
    tolerance: float = 0.01  # of the negatives' risk below zero, before a step back
    discount: float = 0.1    # of that step


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float


def grams(word: str) -> list[str]:
    """A word and its beginnings (marked with a star)."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k <= len(word))]


def marks(counts: dict[str, int], words: int) -> set[str]:
    """What a text of ``words`` words shows of its counted grams: each, those that occur
    twice (``+``) and those that are dense (``%``)."""
    twice = {g + "+" for g, c in counts.items() if c >= 2}
    return {*counts, *twice, *(g + "%" for g, c in counts.items() if c * SHARE >= words)}


def _marks_of(text: str | None) -> set[str]:
    words, counts = WORDS((text or "").lower()), Counter()
    for w, c in Counter(words).items():
        for g in grams(w):
            counts[g] += c
    return marks(counts, len(words))


def _sampled(docs: DataFrame, size: int) -> DataFrame:
    """About ``size`` rows of (id, text), all if there are fewer, drawn by a hash of the id."""
    n = docs.count()
    if n <= size:
        return docs
    return docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * size / n))


def _frequencies(docs: DataFrame, known: frozenset[str] | None = None) -> DataFrame:
    """(gram, n): in how many texts each gram, or each known one, occurs, summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for part in arrow_slices(batches, "text"):
            for text in part.column("text").to_pylist():
                found = _marks_of(text)
                counts.update(found if shared.value is None else found & shared.value)
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return docs.select("text").mapInArrow(work, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"gram": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def _telling(toxic: DataFrame, unlabelled: DataFrame, n_p: int, n_u: int, s: Settings) -> list[str]:
    """All grams whose rate in toxic texts exceeds that in unlabelled ones by far and surely.
    How many texts have a gram is bounded by the samples, and so are the lists here."""
    in_p = {r.gram: r.n for r in _frequencies(toxic).where(F.col("n") >= s.support).collect()}
    in_u = {r.gram: r.n for r in _frequencies(unlabelled, frozenset(in_p)).collect()}
    names = sorted(in_p)
    a, c = (np.array([float(n.get(g, 0)) for g in names]) for n in (in_p, in_u))
    p, q, both = a / n_p, c / n_u, (a + c) / (n_p + n_u)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    return [g for g, ok in zip(names, (z >= s.least_z) & (p >= s.least_lift * q), strict=True) if ok]


def fit(toxic: DataFrame, unlabelled: DataFrame, prior: float, s: Settings = Settings()) -> ToxicModel:
    """A model from (id, text) rows of confirmed toxic and of unlabelled text.

    Training draws bounded samples of both, as ``Settings`` says.  Without toxic texts, or
    with too few to tell any gram, the model scores everything close to zero.
    """
    toxic, unlabelled = (cut_lineage(_sampled(d, n)) for d, n in ((toxic, s.positives), (unlabelled, s.unlabelled)))
    n_p, n_u = toxic.count(), unlabelled.count()
    names = _telling(toxic, unlabelled, n_p, n_u, s) if n_p and n_u else []
    if not names:
        return ToxicModel({}, -5.0)
    slots = {g: crc32(g.encode()) % s.width for g in names}
    shared = toxic.sparkSession.sparkContext.broadcast(slots)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "text"):
            hits = [sorted(shared.value[g] for g in _marks_of(t) & shared.value.keys()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"hits": pa.array(hits, pa.list_(pa.int32()))})

    samples = []
    for docs in (toxic, unlabelled):  # equal rows are counted together, in a fixed order
        found = docs.select("text").mapInArrow(rows, "hits array<int>").groupBy("hits").count().orderBy("hits").collect()
        samples.append(Sample([r.hits for r in found], [r["count"] for r in found]))
    shared.destroy()
    w, b = non_negative_pu(*samples, prior, s)
    return ToxicModel({g: float(w[i]) for g, i in slots.items()}, float(b))


class Sample:
    """Distinct sparse rows of ones and the share of texts that each stands for."""

    def __init__(self, hits: list[list[int]], counts: list[int]):
        self.hits = hits
        self.share = np.array(counts, np.float64) / max(1, sum(counts))
        self.row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        self.slot = np.array([i for h in hits for i in h], np.int64)

    def sums(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.slot], len(self.hits)) + b

    def gradient(self, d: np.ndarray, width: int) -> np.ndarray:
        return np.append(np.bincount(self.slot, d[self.row], width), d.sum())


def _sigmoid(t):
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def non_negative_pu(positive: Sample, unlabelled: Sample, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the non-negative risk with the logistic loss.

    A negatives' risk below minus the tolerance takes a discounted step back.  Grams were
    chosen for a sure difference, so all steps are taken: stopping early costs minorities.
    The intercept never exceeds the log odds of the prior, so a text without any evidence
    stays below 0.5, and is lowered in the end until the mean score of the unlabelled sample
    is at most the prior.
    """
    prior, p, u = min(max(prior, 1e-4), 0.45), positive, unlabelled
    top = float(np.log(prior / (1 - prior)))
    w, b = np.zeros(s.width), top
    m, v = np.zeros(s.width + 1), np.zeros(s.width + 1)
    for step in range(1, s.steps + 1):
        f_p, f_u = p.sums(w, b), u.sums(w, b)
        back, d_u = -prior * p.share * _sigmoid(f_p), u.share * _sigmoid(f_u)
        as_negative = u.share @ np.logaddexp(0, f_u) - prior * (p.share @ np.logaddexp(0, f_p))
        if as_negative >= -s.tolerance:
            grad = p.gradient(prior * p.share * (_sigmoid(f_p) - 1) + back, s.width) + u.gradient(d_u, s.width)
        else:
            grad = -s.discount * (p.gradient(back, s.width) + u.gradient(d_u, s.width))
        grad[:-1] += s.decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], min(top, b - move[-1])
    low, high = b - 30, b
    sums = u.sums(w, 0.0)
    if u.share @ _sigmoid(sums + b) > prior:
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if u.share @ _sigmoid(sums + middle) <= prior else (low, middle)
        b = low
    return w, b


class _Found(dict):
    """The model's grams in each word."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.grams = {g.rstrip("+%") for g in weights}

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(g for g in grams(word) if g in self.grams)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


def scored(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of each whole text.

    Null and empty texts get the score of a text without any known gram.  Columns of these
    names are replaced, others stay; repeated rows give repeated results.
    """
    kept = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        found = _Found(weights)
        for part in arrow_slices(batches, "text"):
            sums = []
            for text in part.column("text").to_pylist():
                words, counts = WORDS((text or "").lower()), Counter()
                for w, c in Counter(words).items():
                    for g in found[w]:
                        counts[g] += c
                sums.append(bias + sum(weights[g] for g in sorted(marks(counts, len(words)) & weights.keys())))
            score = 1 / (1 + np.exp(-np.clip(sums, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(work, extended(kept, "score double, predicted int"))


def fit_on_labels(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> ToxicModel:
    """A model from documents and (doc_id, toxic) labels: the documents labelled 1 are the
    confirmed ones, all documents the unlabelled text, the prior is the labels' own rate.
    Null ids, texts and labels take no part; of repeated labels the largest counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut_lineage(known)
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
    asked = known.where("toxic = 1").select(F.col("doc_id").alias("id"))
    if ones > s.positives:  # draw before the join, so that it carries the sample alone
        asked = _sampled(asked, s.positives)
    return fit(texts.join(F.broadcast(asked), "id", "left_semi"), texts, (ones + 0.5) / (n + 1), s)
