"""Similarity classes of documents: an exact Jaccard join on word n-grams.

Documents with equal sets are one node from the start.  A node's n-grams are ordered rare
first, by hashed document frequencies counted over all documents; two nodes that link
must share an n-gram among the first few (the prefix), and at places, sizes and counts of
n-gram hashes in eight bands that leave room for the overlap asked for (positional,
length and suffix filters).

Pairs are formed in two steps, so that a large group of near copies never meets itself in
full: first each node meets one node only, the smallest of its size class in the prefix
n-grams they share most; then only nodes of different classes so far meet.  Pairs whose
parities differ too much (a bit or two for each n-gram) are dropped; each other one is
verified once on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import arrow_slices, shingle_sets
from genoloom.llm.components import components
from genoloom.llm.sketch import SCHEMA as SKETCH, bloom_of, chunk_rows, gathered, in_bloom
from genoloom.operators.requests import is_small, sized
from genoloom.session import cut_lineage

COUNTER_BITS = 20
LANES = 8
LANE_MAX = 255
BLOCK = 64  # partners that meet one set together, about
PARITY_BITS = 64  # of the smallest sets


@dataclass(frozen=True)
class Rule:
    """Link when ``whole * intersection >= part * union``, on sets of ``words``-grams."""

    words: int = 5
    part: int = 80
    whole: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.part * n // self.whole) + 1

    def needed(self, n):
        """The smallest overlap of two sets of ``n`` elements together."""
        return F.call_function("div", self.part * n + self.part + self.whole - 1, F.lit(self.part + self.whole))

    def may_differ(self, n: int) -> int:
        """In how many elements two sets that link differ at most, of ``n`` elements together."""
        return n - 2 * -(-self.part * n // (self.part + self.whole))


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for part in arrow_slices(batches, "text"):
        yield part.column("id"), shingle_sets(part.column("text"), words)


def _survey(docs: DataFrame, rule: Rule) -> DataFrame:
    """One pass: a row per document (id, size and digest of its set), and the tasks' counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for ids, sets in _sets(batches, rule.words):
            np.add.at(counts, _counter(np.concatenate(sets)), 1)
            n = len(sets)
            yield pa.RecordBatch.from_pydict({
                "id": ids, "n": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "chunk": pa.nulls(n, pa.int32()), "part": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary())})
        own = chunk_rows(counts)
        n = own.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *own.columns],
            names=["id", "n", "digest", "chunk", "part", "counts"])

    return docs.mapInArrow(work, f"id bigint, n bigint, digest binary, {SKETCH}")


def _parity(s: np.ndarray) -> bytes:
    """For each of as many slots as ``s`` has elements, up to a power of two, whether the
    number of elements there is odd.  Two sets differ in as many elements at least as their
    parities in bits."""
    bits = max(PARITY_BITS, 1 << (len(s) - 1).bit_length()) if len(s) else PARITY_BITS
    count = np.bincount(((s >> np.uint64(3)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(bool), bitorder="little").tobytes()


def _odd_slots(x: bytes, y: bytes) -> int:
    """In how many bits two parities differ, the longer one folded to the other's length."""
    bits = 8 * min(len(x), len(y))

    def folded(raw: bytes) -> int:
        v, k = int.from_bytes(raw, "little"), 8 * len(raw)
        while k > bits:
            k //= 2
            v = (v >> k) ^ (v & ((1 << k) - 1))
        return v

    return (folded(x) ^ folded(y)).bit_count()


def _prefixes(docs: DataFrame, rule: Rule, counts: np.ndarray, copies: np.ndarray) -> DataFrame:
    """(id, n, grams, lanes, parity, maybe): each document's rarest n-grams, as many as its
    prefix has, and whether it may be in the Bloom filter ``copies``."""
    shared, filtered = docs.sparkSession.sparkContext.broadcast(counts), docs.sparkSession.sparkContext.broadcast(copies)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, rule.words):
            grams, lanes, parity = [], [], []
            for s in sets:
                parity.append(_parity(s))
                order = np.lexsort((s, shared.value[_counter(s)]))[:rule.prefix(len(s)) if len(s) else 0]
                grams.append(s[order].view(np.int64))
                band = np.minimum(np.bincount((s & np.uint64(LANES - 1)).astype(np.int64), minlength=LANES), LANE_MAX)
                lanes.append(int.from_bytes(band.astype(np.uint8).tobytes(), "little", signed=True))
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "id": ids, "n": pa.array([len(s) for s in sets], pa.int64()),
                "grams": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams))),
                "lanes": pa.array(lanes, pa.int64()), "parity": pa.array(parity, pa.binary()),
                "maybe": pa.array(in_bloom(filtered.value, ids.to_numpy()))})

    return docs.mapInArrow(work, "id bigint, n bigint, grams array<bigint>, lanes bigint, parity binary, maybe boolean")


def _nodes(docs: DataFrame, member: DataFrame, rule: Rule, counts: np.ndarray) -> DataFrame:
    """``_prefixes`` of the nodes.  Copies of nodes are told by a Bloom filter, and what it
    takes for a copy by an exact join, so that the prefixes of nodes stay where they are."""
    last = cut_lineage(member.groupBy("id").agg(F.max("node").alias("node")))
    made = cut_lineage(_prefixes(docs.where("id is not null"), rule, counts, bloom_of(last.where("node < id").select("id"))))
    doubted = made.where("maybe").select("id").distinct()
    spared = cut_lineage(doubted.join(last.where("node = id").select("id"), "id", "left_semi"))
    return made.where("not maybe").unionByName(
        made.where("maybe").join(sized(spared, is_small(spared)), "id", "left_semi")).drop("maybe")


def _plausible(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that the parities of their sets do not rule out."""
    sets = nodes.select("id", "n", "parity")
    half = sets.join(sized(pairs, is_small(pairs)), F.col("id") == F.col("b")).select(
        "a", "b", F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    ends = cut_lineage(pairs.select("a").distinct())
    asked = sets.withColumnRenamed("id", "a").join(sized(ends, is_small(ends)), "a", "left_semi")
    met = half.join(asked.hint("merge"), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column("n").to_numpy() + batch.column("n_b").to_numpy()).tolist()
            both = zip(sizes, batch.column("parity").to_pylist(), batch.column("parity_b").to_pylist(), strict=True)
            kept = [_odd_slots(x, y) <= rule.may_differ(n) for n, x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    # Rows that share an id are told apart when the sets are.
    return cut_lineage(met.select("a", "b", "n", "n_b", "parity", "parity_b").mapInArrow(work, "a bigint, b bigint").distinct())


def _packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash; two n-grams of a pair of texts of a thousand words
    are mixed up once in 10**8 pairs."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.view("<u8").ravel()


def _verified(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link, judged on the full sets of both texts.

    The sets are made where the texts lie; a Bloom filter keeps most documents that are
    in no pair from being hashed, and the joins are exact.  The partners of one b meet it
    in blocks, so that its set moves once for each block, and a's once for each pair.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(asked))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing():
            for batch in batches:
                yield batch.filter(pa.array(in_bloom(shared.value, batch.column("id").to_numpy())))

        for ids, sets in _sets(passing(), rule.words):
            yield pa.RecordBatch.from_pydict({"id": ids, "grams": pa.array([_packed(s) for s in sets], pa.binary())})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for b, sides in zip(batch.column("b").to_pylist(), batch.column("sides"), strict=True):
                ids = sides.values.field("id").to_pylist()
                sets = [_unpacked(v.as_buffer()) for v in sides.values.field("grams")]
                own = [s for i, s in zip(ids, sets, strict=True) if i == b]
                linked += {(i, b) for i, s in zip(ids, sets, strict=True) if i != b and any(_links(s, o, rule) for o in own)}
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})

    sets = docs.where("id is not null").mapInArrow(make, "id bigint, grams binary")
    blocks = cut_lineage(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    dealt = pairs.join(sized(blocks, is_small(blocks)), "b").withColumn("block", F.pmod(F.xxhash64("a"), "blocks"))
    roles = cut_lineage(dealt.select("b", "block", F.explode(F.array("a", "b")).alias("id")).distinct())
    # Few roles are broadcast, so that sets move once, to their block.
    both = sets.join(sized(roles, is_small(roles)), "id").groupBy("b", "block").agg(
        F.collect_list(F.struct("id", "grams")).alias("sides"))
    return cut_lineage(both.select("b", "sides").mapInArrow(judge, "a bigint, b bigint"))


def _links(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return rule.whole * both >= rule.part * (len(x) + len(y) - both)


def _shared_grams(nodes: DataFrame, rule: Rule) -> DataFrame:
    """(gram, id, n, pos, lanes, size): the nodes' prefix n-grams that two nodes or more have.

    A Bloom filter keeps most others from becoming rows; the join that follows is exact.
    """
    made = nodes.drop("parity")
    often = cut_lineage(made.select(F.explode("grams").alias("gram")).groupBy("gram").count().where("count > 1").select("gram"))
    shared = nodes.sparkSession.sparkContext.broadcast(bloom_of(often))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams").flatten().to_numpy()
            many = pc.list_value_length(batch.column("grams")).to_numpy()
            row = np.repeat(np.arange(len(many)), many)
            pos = np.arange(len(grams)) - np.repeat(np.cumsum(many) - many, many)
            on = in_bloom(shared.value, grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[on]), *batch.select(["id", "n", "lanes"]).take(pa.array(row[on])).columns, pa.array(pos[on].astype(np.int32))],
                names=["gram", "id", "n", "lanes", "pos"])

    rows = made.mapInArrow(work, "gram bigint, id bigint, n bigint, lanes bigint, pos int")
    size = F.floor(F.ln("n") / float(np.log(rule.whole / rule.part))).cast("int").alias("size")
    return cut_lineage(rows.join(often, "gram", "left_semi").select("*", size))


def _first_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): each node with the one it shares most prefix n-grams with, among the
    smallest nodes of its size class that hold one of them and pass the filters."""
    low = cut_lineage(rows.groupBy("gram", "size").agg(F.min(F.struct("id", "n", "pos", "lanes")).alias("low")))
    x, y = rows.alias("x"), low.select("gram", "size", "low.*").alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.size") == F.col("y.size"))
                 & (F.col("x.id") != F.col("y.id")) & _may_link(rule))
    met = met.groupBy(F.col("x.id").alias("id"), F.col("y.id").alias("low")).count()
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("count")).alias("less"), "low")).alias("m"))
    return cut_lineage(best.select(F.col("id").alias("a"), F.col("m.low").alias("b")))


def _lane_overlap(a: str, b: str):
    """An upper bound of the overlap, from the counts in each band of hashes."""
    parts = []
    for k in range(LANES):
        x, y = (F.shiftrightunsigned(F.col(f"{s}.lanes"), 8 * k).bitwiseAND(LANE_MAX) for s in (a, b))
        most = F.when((x == LANE_MAX) & (y == LANE_MAX), F.least(f"{a}.n", f"{b}.n"))
        parts.append(most.when(x == LANE_MAX, y).when(y == LANE_MAX, x).otherwise(F.least(x, y)))
    return sum(parts[1:], parts[0])


def _may_link(rule: Rule):
    """Length, positional and suffix filters on rows x and y of a shared n-gram.

    The positional filter counts what stands from this n-gram on, as nothing before the
    first shared one is shared; so a pair that links passes at its first one at least.
    """
    together = F.col("x.n") + F.col("y.n")
    ahead = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return ((rule.whole * F.least("x.n", "y.n") >= rule.part * F.greatest("x.n", "y.n"))
            & (ahead >= rule.needed(together))
            & (_lane_overlap("x", "y") >= rule.needed(together)))


def _other_pairs(rows: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): nodes of different classes so far that pass all filters on a shared n-gram."""
    classed = rows.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    mixed = classed.groupBy("gram").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
    live = cut_lineage(classed.join(cut_lineage(mixed), "gram", "left_semi"))
    x, y = live.alias("x"), live.alias("y")
    on = ((F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id"))
          & (F.col("x.component") != F.col("y.component")) & _may_link(rule))
    return cut_lineage(x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())


def similar_classes(docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the document itself included.
    A text of fewer words than an n-gram has is one n-gram as a whole; a null or empty text
    has none and links with nothing.  Rows that share an id are versions of one document
    and share its class.  A null id links with nothing and has a null class.  Repeated rows
    come out repeated.  Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    survey = cut_lineage(_survey(texts, rule))
    counts = gathered(survey.where("chunk is not null").select("chunk", "part", "counts"), 1 << COUNTER_BITS, np.add)
    rows = survey.where("n is not null").select("id", "n", "digest")
    known = rows.where("n > 0 and id is not null")
    node = cut_lineage(known.groupBy("digest").agg(F.min("id").alias("node")))
    member = cut_lineage(known.join(node, "digest").select("id", "n", "node"))

    nodes = _nodes(texts, member, rule, counts)
    shared = _shared_grams(nodes, rule)
    versions = member.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi")
    versions = member.join(cut_lineage(versions.select("id", "b")), "id").select(F.col("node").alias("a"), "b")
    links = _verified(texts, _plausible(_first_pairs(shared, rule), nodes, rule), rule).union(versions)
    found = cut_lineage(components(links))
    more = _verified(texts, _plausible(_other_pairs(shared, found, rule), nodes, rule), rule)
    found = cut_lineage(components(more.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))))

    classed = member.join(found, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "node").alias("component_id"))
    alone = rows.where("n = 0 or id is null").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return classed.union(alone)


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` with one document of each class: the one of the smallest doc_id, and of rows
    that repeat its doc_id the one with the smallest text.  Rows with a null id stay."""
    classed = cut_lineage(similar_classes(docs, rule))
    kept = classed.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    kept = cut_lineage(kept)
    # Hashing the thin side spares sorting the texts.
    once = docs.join(kept.where("times = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    again = docs.join(kept.where("times > 1").select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("row"))
    again = again.groupBy("doc_id").agg(F.min("row").alias("row")).select("doc_id", "row.*")
    return once.unionByName(again).unionByName(docs.where("doc_id is null")).select(*docs.columns)
