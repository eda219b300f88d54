"""A Merkle manifest of a dataset, with octopus multiproofs.

A tree has an ordered list of leaves; every ``FAN`` consecutive nodes (the last run may be
shorter) become the hash of their digests until one is left.  Each group of rows has a tree
of its own, and the roots of these are the leaves of one more tree.

Trees are built and proven in blocks of ``FAN ** LEVELS`` consecutive nodes, so that no task
holds a whole tree: blocks of leaves become one node each, these fall into blocks of the
next tier, and so on.  Proving goes the other way.  A block takes the positions asked for in
it, works out the smallest union of nodes that their proofs need and that cannot be derived
from each other, reads those once, derives the interior nodes that proofs share, and writes
out each proof.  What lies outside a block is the same for all its members: the proof of the
block's own node, one row that the tier above hands down.  So no node near a root is asked
for by many tasks, and nothing is joined but unique block names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from genoloom.llm.common import extended
from genoloom.operators.requests import is_small, sized
from genoloom.session import cut_lineage

FAN = 3
LEVELS = 7


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and the value, ``-`` if null."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def widths(width: int, whole: bool, levels: int) -> list[int]:
    """The number of nodes on each level of a block: down to one if the block is the whole
    tier of its tree, else to the level of a full block's node."""
    out = [width]
    while out[-1] > 1 if whole else len(out) <= levels:
        out.append(-(-out[-1] // FAN))
    return out


def siblings(level: int, at: int, sizes: list[int]) -> list[int]:
    """The other positions of a node's run, left to right."""
    first = at // FAN * FAN
    return [i for i in range(first, min(first + FAN, sizes[level])) if i != at]


def octopus(asked: set[int], sizes: list[int]) -> list[set[int]]:
    """The smallest set of positions on each level that has to be read to prove all asked
    leaves of a block together: siblings of known nodes that are not known themselves."""
    missing, known = [], asked
    for level in range(len(sizes) - 1):
        missing.append({i for at in known for i in siblings(level, at, sizes)} - known)
        known = {at // FAN for at in known}
    return missing


def built(leaves: list[str], sizes: list[int]) -> list[list[str]]:
    """All levels of a block, its leaves first."""
    out = [leaves]
    for _ in sizes[1:]:
        below = out[-1]
        out.append([digest(*below[i:i + FAN]) for i in range(0, len(below), FAN)])
    return out


def proofs(asked: dict[int, str], read: list[dict[int, str]], sizes: list[int]) -> Iterator[tuple[int, str]]:
    """Each asked position and its proof: the siblings of its path, level by level with a
    slash between, each level as the digests on the left, a colon, those on the right.

    ``read`` holds what ``octopus`` asks for; interiors that proofs share are derived once.
    """
    nodes = [asked | read[0]] if read else [asked]
    for level, more in enumerate([*read[1:], {}] if read else []):
        below, above = nodes[-1], dict(more)
        for run in sorted({at // FAN for at in below}):
            members = range(run * FAN, min(run * FAN + FAN, sizes[level]))
            if all(i in below for i in members):
                above[run] = digest(*(below[i] for i in members))
        nodes.append(above)
    for at in sorted(asked):
        path, i = [], at
        for level in range(len(sizes) - 1):
            known, around = nodes[level], siblings(level, i, sizes)
            path.append("".join(known[j] for j in around if j < i) + ":" + "".join(known[j] for j in around if j > i))
            i //= FAN
        yield at, "/".join(path)


def digests_of(path: str) -> str:
    return path.replace("/", "").replace(":", "")


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and a proof lead to."""
    for level in path.split("/") if path else ():
        left, right = level.split(":")
        leaf = digest(left, leaf, right)
    return leaf


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their position in ``order`` within ``group`` (nulls first), and
    ``width``, the number of rows of their group.

    Rows are dealt by ranges of group and order, so a group of a third of all rows spreads
    over many tasks; each task counts on from the rows of its group in earlier tasks.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("task", F.spark_partition_id())
    k = dealt.columns.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for batch in batches:
            at = []
            for g in batch.column(k).to_pylist():
                last, n = (g, n + 1) if g == last else (g, 0)
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])

    local = cut_lineage(dealt.mapInArrow(number, extended(dealt, "at bigint")))
    sizes = local.groupBy(F.col(group).alias("of"), F.col("task").alias("in_task")).agg(F.count(F.lit(1)).alias("n"))
    before = cut_lineage(sizes.selectExpr(
        "of", "in_task", "sum(n) over (partition by of order by in_task) - n as before", "sum(n) over (partition by of) as width"))
    here = (F.col("task") == F.col("in_task")) & F.col(group).eqNullSafe(F.col("of"))
    return local.join(sized(before, is_small(before)), here).withColumn("at", F.col("at") + F.col("before")).drop(
        "of", "in_task", "before", "task")


@dataclass(frozen=True)
class Forest:
    """Trees as tiers of nodes (tree, at, width, hash); the first tier, the leaves, may have
    more columns.  The nodes of a tier are those of the blocks below."""

    tiers: list[DataFrame]
    levels: int

    @property
    def block(self) -> Column:
        return F.expr(f"at div {FAN ** self.levels}").alias("block")

    @property
    def whole(self) -> Column:
        """That a tree ends in this tier."""
        return F.col("width") <= FAN ** self.levels

    def roots(self) -> DataFrame:
        """(tree, hash) of each tree."""
        out = [self.above(t.where(self.whole)).select("tree", "hash") for t in self.tiers]
        for t in out[1:]:
            out[0] = out[0].union(t)
        return out[0]

    def above(self, tier: DataFrame) -> DataFrame:
        """(tree, at, width, hash): the node of each block of a tier."""
        levels = self.levels

        def work(key: tuple, table: pa.Table) -> pa.Table:
            table, width = table.sort_by("at"), table.column("width")[0]
            leaves = table.column("hash").to_pylist()
            top = built(leaves, widths(len(leaves), width.as_py() <= FAN ** levels, levels))[-1][0]
            return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "at": pa.array([key[1].as_py()], pa.int64()),
                             "width": pa.array([width.as_py()], pa.int64()), "hash": pa.array([top])})

        return tier.select("tree", self.block, "at", "width", "hash").groupBy("tree", "block").applyInArrow(
            work, "tree bigint, at bigint, width bigint, hash string")


def planted(leaves: DataFrame, levels: int = LEVELS) -> Forest:
    """The trees of leaves (tree, at, width, hash, ...), ``at`` from 0 to ``width`` - 1, in
    blocks of ``FAN ** levels``."""
    forest = Forest([cut_lineage(leaves)], levels)
    span = FAN ** levels
    while not (over := forest.tiers[-1].where(~forest.whole)).isEmpty():
        forest.tiers.append(cut_lineage(forest.above(over).withColumn("width", F.expr(f"(width + {span - 1}) div {span}"))))
    return forest


def proven(forest: Forest, asked: DataFrame | None = None, outer: DataFrame | None = None, *, claim: str | None = None) -> DataFrame:
    """The asked leaves, (tree, at), of a forest, all if none are given, with ``path``.

    ``outer`` is an optional (tree, path) that continues the path beyond each tree's root.
    With a ``claim``, the name of a leaf column, each proof is used where it is made and not
    returned: instead of ``path`` there are ``proof_sha256``, the digest of its digests, and
    ``folded``, where the claimed digest leads.  Positions outside a tree give no row.

    Goes down the tiers; a block of each is one group, together with one row from above.
    """
    tiers, wanted = forest.tiers, [asked and asked.select("tree", "at").distinct()]
    for _ in tiers[1:]:
        wanted.append(wanted[-1] and wanted[-1].select("tree", forest.block).distinct().withColumnRenamed("block", "at"))
    above = None
    for k in reversed(range(len(tiers))):
        tier, want = tiers[k], wanted[k]
        rows = tier.select("*", forest.block, F.lit(None).cast("string").alias("path"))
        if want:
            want = cut_lineage(want)
            rows = rows.join(want.select("tree", forest.block).distinct(), ["tree", "block"], "left_semi").join(
                want.withColumn("want", F.lit(True)), ["tree", "at"], "left")
        else:
            rows = rows.withColumn("want", F.lit(True))
        down = [above.select("tree", F.col("at").alias("block"), "path")] if above else []
        if outer:
            ends = tier.where(forest.whole).where("at = 0").select("tree", F.lit(0).cast("bigint").alias("block"))
            down.append(outer.select("tree", "path").join(ends, "tree").select("tree", "block", "path"))
        for d in down:
            rows = rows.unionByName(d, allowMissingColumns=True)
        kept = rows.drop("block", "path", "want") if not k else rows.select("tree", "at")
        last = claim if not k else None
        schema = extended(kept, "proof_sha256 string, folded string" if last else "path string")
        above = cut_lineage(rows.groupBy("tree", "block").applyInArrow(_prover(schema, last, forest.levels), schema))
    return above


def _prover(schema: StructType, claim: str | None, levels: int):
    columns = [f.name for f in schema.fields if f.name not in ("path", "proof_sha256", "folded")]

    def work(table: pa.Table) -> pa.Table:
        ends = table.filter(pc.is_null(table.column("at"))).column("path").to_pylist()
        nodes = table.filter(pc.is_valid(table.column("at"))).sort_by("at")
        asked = nodes.filter(pc.fill_null(nodes.column("want"), False))
        out = asked.select(columns)
        paths: list[str] = []
        if out.num_rows:
            hashes = nodes.column("hash").to_pylist()
            sizes = widths(len(hashes), nodes.column("width")[0].as_py() <= FAN ** levels, levels)
            places = [at % FAN ** levels for at in asked.column("at").to_pylist()]
            missing = octopus(set(places), sizes)
            tree = built(hashes, sizes) if any(missing) else []
            read = [{i: tree[k][i] for i in positions} for k, positions in enumerate(missing)]
            made = proofs({i: hashes[i] for i in places}, read, sizes)
            paths = ["/".join(p for p in (path, *ends) if p) for _, path in made]
        if not claim:
            return out.append_column("path", pa.array(paths, pa.string()))
        claimed = asked.column(claim).to_pylist()
        return out.append_column("proof_sha256", pa.array([digest(digests_of(p)) for p in paths], pa.string())).append_column(
            "folded", pa.array([folded(c, p) for c, p in zip(claimed, paths, strict=True)], pa.string()))

    return work


def manifest(docs: DataFrame, columns: list[str], *, group: str = "source", order: str = "doc_id",
             claimed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """A proof of each row of ``docs``: (``order``, ``group``, leaf, subroot, root,
    proof_sha256, folded_root, verified).

    A row's leaf covers ``columns`` in this order.  Leaves of a group ascend by ``order``,
    nulls first, ties by their digests; groups by their UTF-8 bytes, null first.  What is
    verified is the row with the columns in ``claimed`` replaced, so without any every row
    is.  Repeated rows are leaves of their own.  An empty table gives no rows.  Other
    columns are not read, and texts are read once and do not move.
    """
    claimed = claimed or {}
    leaves = cut_lineage(docs.select(
        F.col(order).alias("row"), F.col(group).alias("g"), leaf_of(*(F.col(c) for c in columns)).alias("hash"),
        leaf_of(*(claimed.get(c, F.col(c)) for c in columns)).alias("claim")))
    placed = cut_lineage(numbered(leaves, "g", ["row", "hash", "claim"]))
    groups = numbered(cut_lineage(placed.select(F.lit(0).alias("all"), F.col("g").alias("name")).distinct()), "all", ["name"])
    groups = cut_lineage(groups.select("name", F.col("at").alias("tree"), F.col("width").alias("n_groups")))
    placed = placed.join(sized(groups.select("name", "tree"), is_small(groups)), F.col("g").eqNullSafe(F.col("name"))).drop("name")
    trees = planted(placed, levels)
    subroots = cut_lineage(trees.roots())
    top = planted(groups.join(subroots, "tree").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.col("n_groups").alias("width"), "hash"), levels)
    root = top.roots().first()  # one digest
    outer = proven(top).select(F.col("at").alias("tree"), "path")
    found = proven(trees, None, outer, claim="claim")
    found = found.join(sized(subroots.withColumnRenamed("hash", "subroot"), is_small(subroots)), "tree")
    whole = F.lit(root["hash"] if root else None).cast("string")
    return found.select(
        F.col("row").alias(order), F.col("g").alias(group), F.col("hash").alias("leaf"), "subroot", whole.alias("root"),
        "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == whole).alias("verified"))
