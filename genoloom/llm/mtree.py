"""Exact top-k inner-product search in an M-tree of paged nodes.

Maximum inner products become nearest neighbours in a metric space: with one more
component, sqrt(M - |x|^2) for a stored vector and 0 for a query, the squared distance is
|q|^2 + M - 2 q.x.  The tree has three levels below its root: clusters around routing
objects taken from a bounded sample, nodes (rows of a table, each of a bounded number of
vectors) and pages inside a node.  Every page has a covering radius and the distance of
its routing object to the cluster's, every vector the distance to its page's.

A search goes to one node of the query's own cluster first, which bounds its k-th score,
then to the clusters whose radius may still hold a better one.  Inside a node pages are
visited best first; stored parent distances rule out pages and vectors by the triangle
inequality before any distance to them is computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.session import cut_lineage

SCALE = 64
LARGEST = 1 << 26  # vectors with scaled components from here on are kept out of the tree and scored one by one
OVERSIZED = 1024   # such vectors that are broadcast at once
LONG = (1 << 63) - 1
SLACK = 1e-6
NO_SCORE = -(1 << 62)
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    k: int = 20
    sample: int = 4096   # vectors from which routing objects are taken, about
    clusters: int = 64
    node: int = 1024     # vectors of a node, about
    page: int = 64       # vectors of a page, about
    block: int = 256     # queries that are searched together, about


def _picked(rows: DataFrame, id_col: str, vector_col: str, large: bool) -> DataFrame:
    vector = F.col(vector_col)

    def below(most: float) -> Column:  # false for NaN and null
        return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < most)), F.lit(False))

    there = F.col(id_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0)
    fit = below(float("inf")) & ~below(LARGEST / SCALE) if large else below(LARGEST / SCALE)
    return rows.where(there & fit).select(F.col(id_col).cast("bigint").alias("id"), vector.cast("array<double>").alias("v"))


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, norm): components scaled and floored, as packed 32-bit numbers.

    Rows with a null id, a null or empty vector, a null or non-finite component are left
    out; those with a component from ``LARGEST`` on are ``oversized`` ones.
    """
    picked = _picked(rows, id_col, vector_col, False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = np.floor(SCALE * np.asarray(v.flatten())).astype(np.int32)
            ends = np.cumsum(np.asarray(pc.list_value_length(v)))
            rows = np.split(flat, ends[:-1]) if len(ends) else []
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "vec": pa.array([r.tobytes() for r in rows], pa.binary()),
                "norm": pa.array([int(r.astype(np.int64) @ r.astype(np.int64)) for r in rows], pa.int64())})

    return picked.mapInArrow(work, "id bigint, vec binary, norm bigint")


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(packed), dim), np.float64)
    for i, raw in enumerate(packed):
        row = np.frombuffer(raw, np.int32)
        out[i, :len(row)] = row
    return out


@dataclass(frozen=True)
class Space:
    """The metric space: points are vectors with the component that evens out their norms."""

    dim: int
    most: int  # the largest squared norm

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    @staticmethod
    def queries(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _spread(points: np.ndarray, n: int) -> list[int]:
    """Up to n points, each the one farthest from those taken before."""
    taken = [0]
    near = distances(points[:1], points)[0]
    while len(taken) < n and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, distances(points[taken[-1]:taken[-1] + 1], points)[0])
    return taken


NODE = ("cluster int, node bigint, ids binary, vecs binary, away binary, starts binary, centers binary, "
        "radii binary, parents binary")


def _node(cluster: int, chunk: int, ids: np.ndarray, x: np.ndarray, root: np.ndarray, space: Space, s: Settings) -> dict:
    """A node's pages: vectors by page and id, with distances to the page's routing object."""
    points = space.points(x)
    centers = _spread(points, -(-len(ids) // s.page))
    gap = distances(points, points[centers])
    page = gap.argmin(axis=1)
    order = np.lexsort((ids, page))
    page, away = page[order], gap[np.arange(len(ids)), gap.argmin(axis=1)][order]
    names, starts = np.unique(page, return_index=True)
    radii = np.maximum.reduceat(away, starts)
    middle = points[centers][names]
    return {"cluster": cluster, "node": chunk, "ids": ids[order].tobytes(), "vecs": x[order].astype(np.int32).tobytes(),
            "away": away.tobytes(), "starts": np.append(starts, len(ids)).astype(np.int64).tobytes(),
            "centers": middle.tobytes(), "radii": radii.tobytes(),
            "parents": distances(root[None, :], middle)[0].tobytes()}


@dataclass
class Tree:
    space: Space
    roots: np.ndarray  # the clusters' routing objects as points
    nodes: DataFrame   # NODE
    radii: np.ndarray


def build(vectors: DataFrame, s: Settings) -> Tree | None:
    """The tree over (id, vec, norm) rows; None without rows.

    Routing objects come from a bounded sample drawn by a hash; every vector is stored.
    """
    n, most, dim = vectors.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.octet_length("vec"))).first()
    if not n:
        return None
    space = Space(dim // 4, most)
    share = min(1.0, s.sample / n)
    picked = vectors.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy("id", "vec").limit(2 * s.sample)
    sample = space.points(_matrix([r.vec for r in picked.select("vec").collect()] or [vectors.first().vec], space.dim))
    roots = sample[_spread(sample, s.clusters)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = distances(space.points(_matrix(batch.column("vec").to_pylist(), space.dim)), roots)
                yield pa.RecordBatch.from_pydict({
                    "cluster": pa.array(gap.argmin(axis=1), pa.int32()), "away": pa.array(gap.min(axis=1)),
                    "id": batch.column("id"), "vec": batch.column("vec")})

    placed = cut_lineage(vectors.select("id", "vec").mapInArrow(assign, "cluster int, away double, id bigint, vec binary"))
    sizes = {r.cluster: r for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()}
    radii = np.array([sizes[c].r if c in sizes else -1.0 for c in range(len(roots))])
    parts = F.element_at(F.array(*[F.lit(-(-sizes[c].n // s.node) if c in sizes else 1) for c in range(len(roots))]), F.col("cluster") + 1)

    def bulk(table: pa.Table) -> pa.Table:
        c, k = table.column("cluster")[0].as_py(), table.column("chunk")[0].as_py()
        x = _matrix(table.column("vec").to_pylist(), space.dim)
        return pa.Table.from_pylist([_node(c, k, table.column("id").to_numpy(), x, roots[c], space, s)], _schema(NODE))

    chunked = placed.withColumn("chunk", F.pmod(F.xxhash64("id", "vec"), parts).cast("bigint"))
    return Tree(space, roots, cut_lineage(chunked.groupBy("cluster", "chunk").applyInArrow(bulk, NODE)), radii)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


class Best:
    """The best k of each query so far: scores from high to low, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NO_SCORE, np.int64), np.full((n, k), NO_ID, np.int64)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """New scores (rows x ids) for some of the queries."""
        k = self.score.shape[1]
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        i[s == NO_SCORE] = NO_ID
        order = np.lexsort((i, -s), axis=-1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search_node(node: dict, q_ids: np.ndarray, q: np.ndarray, roots: np.ndarray, space: Space, best: Best, floor: np.ndarray) -> None:
    """Offers the node's vectors to a block of queries, whose k-th scores elsewhere are ``floor``."""
    starts, ids = np.frombuffer(node["starts"], np.int64), np.frombuffer(node["ids"], np.int64)
    x = np.frombuffer(node["vecs"], np.int32).reshape(len(ids), space.dim)
    away, radii, parents = (np.frombuffer(node[c], np.float64) for c in ("away", "radii", "parents"))
    middle = np.frombuffer(node["centers"], np.float64).reshape(len(radii), space.dim + 1)
    points = space.queries(q)
    norms = (q * q).sum(axis=1)

    def most(near: np.ndarray, rows=slice(None)) -> np.ndarray:
        """The largest score at a distance of ``near`` or more."""
        return np.floor((norms[rows][:, None] + space.most - np.maximum(near - SLACK * (1 + near), 0) ** 2) / 2 + SLACK)

    to_root = distances(points, roots[node["cluster"]][None, :])
    bound = most(np.abs(to_root - parents[None, :]) - radii[None, :])  # without a distance to any page
    for p in np.argsort(-bound.max(axis=0), kind="stable"):
        kth = np.maximum(best.score[:, -1], floor)
        rows = np.flatnonzero(bound[:, p] >= kth)
        if not len(rows):
            continue
        gap = distances(points[rows], middle[p:p + 1])
        rows, gap = (v[most(gap - radii[p], rows)[:, 0] >= kth[rows]] for v in (rows, gap))
        if not len(rows):
            continue
        a, b = starts[p], starts[p + 1]
        open_ = most(np.abs(gap - away[None, a:b]), rows) >= kth[rows][:, None]
        some = np.flatnonzero(open_.any(axis=0))
        if not len(some):
            continue
        inside = a + some
        score = _products(q[rows], x[inside])
        score[(ids[inside][None, :] == q_ids[rows][:, None]) | (score < kth[rows][:, None])] = NO_SCORE
        worth = (score != NO_SCORE).any(axis=1)
        if worth.any():
            best.offer(rows[worth], score[worth], ids[inside])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where all sums are exact."""
    if np.abs(a).max(initial=0) * float(np.abs(b.astype(np.int64)).max(initial=0)) * a.shape[1] < 1 << 53:
        return (a @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _exactly(rows: DataFrame, asked: DataFrame, vectors: DataFrame, query: Column, id_col: str, vector_col: str, k: int) -> DataFrame | None:
    """(query_id, mark, id, score) with at least the k best pairs of which one is oversized:
    all queries against oversized candidates and oversized queries against all, in blocks
    of ``OVERSIZED`` and whole numbers of any size.  None if there are none."""
    large = cut_lineage(_picked(rows, id_col, vector_col, True))
    n = large.count()
    if not n:
        return None
    marked = cut_lineage(_picked(rows.where(query), id_col, vector_col, True).select(
        "id", F.xxhash64("v").alias("mark"), "v").distinct())
    parts, out = -(-n // OVERSIZED), None
    plain = asked.select("id", "mark", "vec", F.lit(None).cast("array<double>").alias("v"))
    queries = plain.unionByName(marked.withColumn("vec", F.lit(None).cast("binary")))
    stored = vectors.select("id", F.lit(0).cast("bigint").alias("mark"), "vec", F.lit(None).cast("array<double>").alias("v"))
    for p in range(parts):
        mine = F.pmod(F.xxhash64("id"), F.lit(parts)) == p
        for many, few, asking in ((queries, large.where(mine).withColumn("mark", F.lit(0)), True), (stored, marked.where(mine), False)):
            block = [(r.id, r.mark, _scaled(r.v)) for r in few.select("id", "mark", "v").collect()]
            if not block:
                continue
            shared = rows.sparkSession.sparkContext.broadcast(block)

            def work(batches: Iterator[pa.RecordBatch], shared=shared, asking=asking) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    best: dict[tuple, list[tuple[int, int]]] = {}
                    for i, mark, vec, v in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "vec", "v")), strict=True):
                        x = _scaled(v) if vec is None else np.frombuffer(vec, np.int32).tolist()
                        for j, other, y in shared.value:
                            if i != j:
                                q, c = ((i, mark), j) if asking else ((j, other), i)
                                score = sum(a * b for a, b in zip(x, y, strict=False))
                                best.setdefault(q, []).append((-max(-LONG - 1, min(LONG, score)), c))
                    kept = [(q, m, c, -s) for (q, m), found in best.items() for s, c in sorted(found)[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], pa.int64()) for c in range(4)],
                                                     names=["query_id", "mark", "id", "score"])

            hits = many.mapInArrow(work, "query_id bigint, mark bigint, id bigint, score bigint")
            out = hits if out is None else out.union(hits)
    return out


def _scaled(v: list[float]) -> list[int]:
    return [math.floor(SCALE * x) if abs(x) < 1e300 else SCALE * int(x) for x in v]


ASKED = "cluster int, id bigint, mark bigint, vec binary, floor bigint"
BLOCK = "cluster int, block bigint, qids binary, marks binary, qvecs binary, floors binary"


def top_k(rows: DataFrame, query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
          s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k largest integer inner products.

    Queries are the rows for which ``query`` holds; candidates all rows but those of the
    query's id.  Ties go to the smaller id; repeated candidate rows count each, repeated
    query rows once; rows of one id with different vectors are queries of their own.  The
    shorter of two vectors counts as filled up with zeros.  Null ids, null and empty vectors
    and those with null or non-finite components take no part.  A score that no long holds
    is given as the largest or smallest long.  With fewer candidates than k all are returned, without any
    none.  Other columns are not read.
    """
    spark = rows.sparkSession
    vectors = cut_lineage(whole_vectors(rows, id_col, vector_col))
    asked = cut_lineage(whole_vectors(rows.where(query), id_col, vector_col).select(
        "id", F.xxhash64("vec").alias("mark"), "vec").distinct())
    per_query = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "id")

    def ranked(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= s.k)

    def answer(hits: DataFrame) -> DataFrame:
        return hits.select("query_id", "rank", F.col("id").alias(id_col), "score")

    exact = _exactly(rows, asked, vectors, query, id_col, vector_col, s.k)
    tree = build(vectors, s)
    if tree is None:
        none = spark.createDataFrame([], "query_id bigint, mark bigint, id bigint, score bigint")
        return answer(ranked(exact or none))
    space, roots, radii = tree.space, tree.roots, tree.radii
    blocks = max(1, -(-asked.count() // s.block))

    def send(home_only: bool):
        """Each query with its nearest cluster, or with every one that may hold a better score."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column("vec").to_pylist(), space.dim)
                gap = distances(space.queries(q), roots)
                gap[:, radii < 0] = np.inf
                floor = batch.column("floor").to_numpy()
                if home_only:
                    at, c = np.arange(len(q)), gap.argmin(axis=1)
                else:
                    near = np.maximum(gap - radii[None, :], 0)
                    near = np.maximum(near - SLACK * (1 + near), 0)
                    upto = ((q * q).sum(axis=1)[:, None] + space.most - near ** 2) / 2 + SLACK
                    at, c = np.nonzero((np.floor(upto) >= floor[:, None]) & np.isfinite(gap))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32()), *[batch.column(n).take(pa.array(at)) for n in ("id", "mark", "vec", "floor")]],
                    names=["cluster", "id", "mark", "vec", "floor"])

        return work

    def pack(group: pa.Table) -> pa.Table:
        numbers = {n: group.column(f).to_numpy().astype(np.int64).tobytes() for n, f in (("qids", "id"), ("marks", "mark"), ("floors", "floor"))}
        return pa.Table.from_pylist([numbers | {
            "cluster": group.column("cluster")[0].as_py(), "block": group.column("block")[0].as_py(),
            "qvecs": _matrix(group.column("vec").to_pylist(), space.dim).tobytes()}], _schema(BLOCK))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, marks, floors = (np.frombuffer(row[c], np.int64) for c in ("qids", "marks", "floors"))
                best = Best(len(ids), s.k)
                search_node(row, ids, np.frombuffer(row["qvecs"]).reshape(len(ids), space.dim), roots, space, best, floors)
                at, place = np.nonzero(best.score != NO_SCORE)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(ids[at]), "mark": pa.array(marks[at]),
                    "id": pa.array(best.id[at, place]), "score": pa.array(best.score[at, place])})

    def found(queries: DataFrame, home_only: bool, nodes: DataFrame) -> DataFrame:
        sent = queries.select("id", "mark", "vec", "floor").mapInArrow(send(home_only), ASKED)
        packed = cut_lineage(sent.withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.lit(blocks))).groupBy(
            "cluster", "block").applyInArrow(pack, BLOCK))
        hits = packed.join(nodes, "cluster").mapInArrow(search, "query_id bigint, mark bigint, id bigint, score bigint")
        return ranked(hits)  # keeps k rows of a query in each task before they are shuffled

    # One node of the own cluster, the same for all its queries, bounds the k-th scores.
    first = found(asked.withColumn("floor", F.lit(NO_SCORE)), True, tree.nodes.where("node = 0"))
    kth = cut_lineage(first.where(F.col("rank") == s.k).select(F.col("query_id").alias("id"), "mark", F.col("score").alias("floor")))
    bounded = asked.join(kth, ["id", "mark"], "left").withColumn("floor", F.coalesce("floor", F.lit(NO_SCORE)))
    best = found(bounded, False, tree.nodes)
    return answer(best if exact is None else ranked(best.drop("rank").unionByName(exact)))
