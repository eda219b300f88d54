"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its words' hashed subwords; a linear softmax on
it gives the language.  Both are trained together by stochastic gradient descent.  For
prediction they are multiplied out once, so that a word is a sum of rows of one small
table, the same for every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import arrow_slices, extended
from genoloom.operators.requests import is_small, sized
from genoloom.session import cut_lineage

WORDS = re.compile(r"[^\W\d_]+").findall
BUCKETS = 1 << 16
UNDETERMINED = "und"
CACHED_WORDS = 500_000


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the model; none of them touches prediction."""

    per_language: int = 600  # documents, about; each also gives a snippet of a few words
    total: int = 60_000      # documents of all languages, about, so fewer of each if there are very many
    dimensions: int = 16
    epochs: int = 4
    rate: float = 0.5
    precision: float = 0.99  # what accepted calibration texts have to reach


@dataclass
class LanguageModel:
    names: list[str]
    table: np.ndarray  # BUCKETS x languages: what a subword adds
    bias: np.ndarray
    heat: float        # the temperature found on calibration texts
    least: float       # predictions below this probability are rejected


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its 2- and 3-grams with its ends marked; none without a letter."""
    if not any(c.isalpha() for c in word):
        return []
    marked = f"<{word}>"
    parts = [marked, *(marked[i:i + n] for n in (2, 3) for i in range(len(marked) - n + 1))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def _words(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    counts: Counter[int] = Counter()
    for w, n in Counter(texts).items():
        for b in subwords(w):
            counts[b] += n
    ids = np.array(sorted(counts), np.int32)
    return ids, np.array([counts[i] for i in ids.tolist()], np.float32)


def _training_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """(lang, id, ids, counts): the sample's texts and one snippet of each as subword counts.

    Documents are drawn by a hash of their id, each language at its own rate.
    """
    sizes = cut_lineage(docs.groupBy("lang").count())
    each = min(s.per_language, max(1, s.total // max(1, sizes.count())))
    rates = sizes.select("lang", (F.lit(each) / F.col("count")).alias("rate"))
    drawn = docs.join(sized(rates, is_small(rates)), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "text"):
            out = {"lang": [], "id": [], "ids": [], "counts": []}
            for doc, lang, text in zip(*(part.column(c).to_pylist() for c in ("id", "lang", "text")), strict=True):
                words = _words(text)
                at = zlib.crc32(str(doc).encode())
                start, size = at % max(1, len(words)), 2 + at % 9
                for piece in (words, words[start:start + size]):
                    ids, counts = _features(piece)
                    if len(ids):
                        for k, v in zip(out, (lang, doc, ids, counts), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["lang"], pa.string()), pa.array(out["id"], pa.int64()),
                 pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["counts"], pa.list_(pa.float32()))], names=list(out))

    return drawn.select("id", "lang", "text").mapInArrow(work, "lang string, id bigint, ids array<int>, counts array<float>")


def fit(docs: DataFrame, s: Settings = Settings()) -> LanguageModel | None:
    """A model from (id, lang, text) rows; null ids, languages and texts take no part.
    None if nothing is left to learn from."""
    rows = cut_lineage(_training_rows(docs.where("id is not null and lang is not null and text is not null"), s))
    rows = rows.orderBy("id", F.size("ids"), "lang", "ids").toArrow()  # bounded: the sample
    if not rows.num_rows:
        return None
    langs, doc_ids = rows.column("lang").to_pylist(), rows.column("id").to_numpy()
    names = sorted(set(langs))
    y = np.array([names.index(g) for g in langs])
    x = [(np.asarray(i.values), np.asarray(c.values)) for i, c in zip(rows.column("ids"), rows.column("counts"), strict=True)]
    held = np.array([zlib.crc32(b"calibrate %d" % i) % 5 == 0 for i in doc_ids.tolist()])
    if held.all() or not held.any():
        held[:] = False
    emb, soft, bias = _descent(x, y, np.flatnonzero(~held), len(names), s)
    table = emb @ soft
    seen = np.flatnonzero(held) if held.any() else np.arange(len(x))
    logits = np.stack([c @ table[i] / c.sum() + bias for i, c in (x[k] for k in seen)])
    heat, least = _calibrated(logits, y[seen], s.precision)
    return LanguageModel(names, table.astype(np.float32), bias, heat, least)


def _descent(x, y, rows: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    emb = rng.uniform(-1, 1, (BUCKETS, s.dimensions)).astype(np.float32) / s.dimensions
    soft, bias = np.zeros((s.dimensions, k), np.float32), np.zeros(k, np.float32)
    done, whole = 0, max(1, s.epochs * len(rows))
    for _ in range(s.epochs):
        for r in rng.permutation(rows):
            rate = s.rate * (1 - done / whole)
            done += 1
            ids, counts = x[r]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ emb[ids]
            z = mean @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[r]] -= 1
            back = soft @ p
            soft -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            # Each subword moves by its share of the text, scaled to the mean share.
            emb[ids] -= (rate * min(len(ids), 50)) * np.outer(share, back)
    return emb, soft, bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _calibrated(logits: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature of least log loss, and the probability from which on predictions
    are as precise as asked."""
    at = np.arange(len(y))
    heats = np.geomspace(0.1, 10, 41)
    losses = [-np.log(_softmax(logits / h)[at, y] + 1e-12).mean() for h in heats]
    heat = float(heats[int(np.argmin(losses))])
    p = _softmax(logits / heat)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    least = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return heat, least


class _Words(dict):
    """Rows of a growing table: what each word adds for each language, and its subwords."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.names) + 1))

    def __missing__(self, word: str) -> int:
        ids, at = subwords(word), len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at, :-1] = self.model.table[ids].sum(axis=0, dtype=np.float64)
        self.rows[at, -1] = len(ids)
        self[word] = at
        return at


def predicted(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the calibrated probability) and ``accepted``.

    ``und`` with score 0, not accepted, for a null text, one without a letter, or without a
    model.  ``accepted`` is false below the probability found in calibration.  Columns of
    these names are replaced, others stay; every text is read whole.
    """
    kept = docs.drop("lang_pred", "score", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = _Words(m) if m else {}
        for part in arrow_slices(batches, "text"):
            if len(known) > CACHED_WORDS:
                known = _Words(m)
            names, scores = [], []
            if m is None:
                names, scores = [UNDETERMINED] * part.num_rows, [0.0] * part.num_rows
            else:
                at = [[known[w] for w in _words(t)] for t in part.column("text").to_pylist()]
                for found in at:
                    total = known.rows[found].sum(axis=0) if found else np.zeros(len(m.names) + 1)
                    if not total[-1]:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    p = _softmax((total[:-1] / total[-1] + m.bias) / m.heat)
                    names.append(m.names[int(p.argmax())])
                    scores.append(float(p.max()))
            sure = [n != UNDETERMINED and x >= m.least for n, x in zip(names, scores, strict=True)] if m else [False] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())],
                names=[*part.schema.names, "lang_pred", "score", "accepted"])

    return kept.mapInArrow(work, extended(kept, "lang_pred string, score double, accepted boolean"))
