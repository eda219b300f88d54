"""SentencePiece encoding and decoding by backtracking over longest matches.

A merge-type (BPE) encoding is the only token sequence in which every adjacent pair of
tokens, merged again from its characters, comes out as that same pair.  So the encoder
walks a text with the tokens an Aho-Corasick automaton finds at each place, longest
first, keeps a token if the pair it forms with the one before survives re-merging, and
otherwise tries a shorter one or steps back.  A bitfield remembers the positions from
which no way on was found, so that none is tried twice.

No piece of a model holds a space mark after another character, nor a line feed, if the
model passes the check in ``Coder``; then no merge crosses the start of a word or a line
feed, each stretch between them is encoded alone, and equal stretches once per worker.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from genoloom.llm.common import arrow_slices, broadcast_bytes, extended

SPACE = "▁"
CACHED_STRETCHES = 300_000
CACHED_PAIRS = 400_000


class Coder:
    """Encodes and decodes with the pieces of one SentencePiece BPE model.

    Of the library it uses the reader of the model file alone.  It refuses models whose
    normalizer changes texts or that are no BPE models with byte fallback.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of: dict[int, int] = {}
        self.silent: set[int] = set()
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes_of[i] = int(piece[3:5], 16)
            elif sp.is_control(i):
                self.silent.add(i)
            elif not sp.is_unknown(i) and not sp.is_unused(i):
                self.score[piece] = sp.get_score(i)
                self.id_of[piece] = i
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        if len(self.byte_id) != 256:
            raise ValueError("a model with byte fallback is needed")
        inner = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.parts_at_words = not inner and not any("\n" in p for p in self.score)
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.pair_cache: dict[tuple[str, str], bool] = {}
        self.words = Stretches(lambda s: self.encoded(SPACE + s))
        self.plain = Stretches(self.encoded)

    # -- one stretch of text ----------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The text merged from its characters: best score first, leftmost on a tie."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: str, token: str) -> bool:
        """Whether re-merging two tokens gives them back; with ``before`` empty, the token alone."""
        key = (before, token)
        found = self.pair_cache.get(key)
        if found is None:
            if len(self.pair_cache) >= CACHED_PAIRS:
                self.pair_cache.clear()
            found = self.merged(before + token) == [t for t in key if t]
            self.pair_cache[key] = found
        return found

    def tokens(self, text: str) -> list[str]:
        """The merge-type encoding of ``text`` as strings, by backtracking."""
        n = len(text)
        lengths: list[list[int]] = [[] for _ in range(n + 1)]
        for end, length in self.automaton.iter(text):
            lengths[end - length + 1].append(length)  # shorter before longer
        failed = bytearray(n // 8 + 1)
        taken: list[tuple[str, int]] = []  # token, its place among the lengths at its start
        at, before = 0, ""
        place: int | None = None
        while at < n:
            here = lengths[at]
            if not here or here[0] != 1:
                here.insert(0, 1)  # a character that is no piece itself
            if place is None:
                place = len(here) - 1
            while place >= 0:
                end = at + here[place]
                if not failed[end >> 3] >> (end & 7) & 1 and self.fits(before, text[at:end]):
                    break
                place -= 1
            if place >= 0:
                before = text[at:end]
                taken.append((before, place))
                at, place = end, None
            else:
                if not taken:
                    raise ValueError("no encoding found")
                failed[at >> 3] |= 1 << (at & 7)
                token, place = taken.pop()
                at, place = at - len(token), place - 1
                before = taken[-1][0] if taken else ""
        return [token for token, _ in taken]

    def ids(self, text: str) -> list[int]:
        out = []
        for token in self.tokens(text):
            known = self.id_of.get(token)
            if known is None:
                out.extend(self.byte_id[b] for b in token.encode())
            else:
                out.append(known)
        return out

    def encoded(self, stretch: str) -> tuple[bytes, str]:
        """Ids packed as 32-bit numbers, and what they decode to (space marks as spaces)."""
        ids = self.ids(stretch)
        return array("i", ids).tobytes(), self.surface(ids)

    # -- whole texts --------------------------------------------------------------

    def surface(self, ids: list[int]) -> str:
        """The ids' text, a leading space kept."""
        out, run = [], bytearray()
        for i in ids:
            byte = self.bytes_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_text_of(run))
                run = bytearray()
            if i not in self.silent:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_text_of(run))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any list of ids; the space in front that encoding adds is dropped."""
        text = self.surface(ids)
        heard = next((i for i in ids if i not in self.silent), None)
        return text[1:] if heard is not None and self.pieces[heard].startswith(SPACE) else text

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Packed ids of a whole text and the text they decode to; null counts as empty."""
        if not text:
            return b"", ""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.parts_at_words:
            packed, out = self.encoded(marked)
            return packed, out[1:]
        got: list[tuple[bytes, str]] = []
        for k, line in enumerate(marked.split("\n")):
            if k:
                got.append(self.plain["\n"])
            if SPACE + SPACE in line or line.endswith(SPACE):
                got.extend([self.plain[s] for s in _stretches(line)])
                continue
            head, *words = line.split(SPACE)
            if head:
                got.append(self.plain[head])
            get = self.words
            got.extend([get[w] for w in words])
        return b"".join([g[0] for g in got]), "".join([g[1] for g in got])[1:]


_stretches = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


def _text_of(run: bytearray) -> str:
    """Bytes as UTF-8, each byte outside a whole character as a replacement mark."""
    out, at, n = [], 0, len(run)
    while at < n:
        lead = run[at]
        size = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
        try:
            out.append(run[at:at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


class Stretches(dict):
    """Results by stretch; when full, the older half of the generations is dropped."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, stretch: str):
        if len(self) >= CACHED_STRETCHES:
            self.older = dict(self)
            self.clear()
        found = self.older.get(stretch)
        if found is None:
            found = self.make(stretch)
        if len(stretch) <= 64:  # long stretches hardly ever come again
            self[stretch] = found
        return found


@functools.lru_cache(maxsize=2)
def coder(model: bytes) -> Coder:
    return Coder(model)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Each document with its token ids and the text that these decode to.

    Adds ``ids`` array<int>, ``n_tokens`` long and ``decoded`` string; other columns stay,
    but columns of these three names are replaced.  A null text counts as empty: no ids,
    empty ``decoded``.  Long texts are encoded whole.  Rows are independent: repeated rows
    give repeated results, an empty table an empty one.
    """
    spark = docs.sparkSession
    kept = docs.drop("ids", "n_tokens", "decoded")
    model = broadcast_bytes(spark, model_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model.value)
        for part in arrow_slices(batches, "text"):
            got = [c.encode(t) for t in part.column("text").to_pylist()]
            sizes = np.fromiter((len(g[0]) // 4 for g in got), np.int64, len(got))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join([g[0] for g in got]), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, lists, pa.array(sizes), pa.array([g[1] for g in got], pa.string())],
                names=[*part.schema.names, "ids", "n_tokens", "decoded"])

    return kept.mapInArrow(work, extended(kept, "ids array<int>, n_tokens bigint, decoded string"))
