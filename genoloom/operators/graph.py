"""Neighbours, bounded-hop search, path steps and DOT text over segments and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .requests import is_small, sized
from .segments import segment_samples
from .variants import SAMPLES_PER_PART, with_phasing

# Hops after which what was reached is written as one table.
HOPS_PER_CUT = 8


def out_neighbors(edge: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(chrom, seg_id, neighbor)`` along the edges leaving the given vertices."""
    return vertices.select("chrom", "seg_id").distinct().join(
        edge.withColumnRenamed("src", "seg_id"), ["chrom", "seg_id"]
    ).select("chrom", "seg_id", F.col("dst").alias("neighbor"))


def in_neighbors(edge: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(chrom, seg_id, neighbor)`` along the edges entering the given vertices."""
    return vertices.select("chrom", "seg_id").distinct().join(
        edge.withColumnRenamed("dst", "seg_id"), ["chrom", "seg_id"]
    ).select("chrom", "seg_id", F.col("src").alias("neighbor"))


def out_degree(edge: DataFrame) -> DataFrame:
    return edge.groupBy("chrom", F.col("src").alias("seg_id")).agg(
        F.count(F.lit(1)).alias("degree"))


def in_degree(edge: DataFrame) -> DataFrame:
    return edge.groupBy("chrom", F.col("dst").alias("seg_id")).agg(
        F.count(F.lit(1)).alias("degree"))


def existing_edges(edge: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked ``(chrom, src, dst)`` rows that are edges."""
    return asked.join(edge, ["chrom", "src", "dst"], "left_semi")


def all_vertices(edge: DataFrame) -> DataFrame:
    """Vertices with an edge leaving them."""
    return edge.select("chrom", F.col("src").alias("seg_id")).distinct()


def within_hops(edge: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """``(root, chrom, seg_id, hops)`` for vertices at most ``radius`` edges away.

    ``roots`` has ``(root, chrom, seg_id)``.  Only the vertices reached last meet the
    edges: while they are few they are broadcast, cut to the hull of their ids, and no edge
    moves.  Each hop's new vertices are written out, which counts them for the next one.
    """
    key = ["root", "chrom", "seg_id"]
    frontier = cut_lineage(roots.select(*key).distinct().withColumn("hops", F.lit(0)))
    reached = frontier
    for hop in range(1, radius + 1):
        few = is_small(frontier)
        low, high = frontier.agg(F.min("seg_id"), F.max("seg_id")).first()
        if low is None:
            break
        near = edge.where(F.col("src").between(low, high)).select("chrom", F.col("src").alias("seg_id"), "dst")
        met = near.join(sized(frontier.drop("hops"), few), ["chrom", "seg_id"]).select(
            "root", "chrom", F.col("dst").alias("seg_id")).distinct()
        frontier = cut_lineage(met.join(reached, key, "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(frontier)
        if hop % HOPS_PER_CUT == 0:
            reached = cut_lineage(reached)
    return reached


def shared_successors(edge: DataFrame, pairs: DataFrame) -> DataFrame:
    """Common out-neighbours of each ``(chrom, left, right)`` pair."""
    l_edge = edge.select("chrom", F.col("src").alias("left"), F.col("dst").alias("common"))
    r_edge = edge.select("chrom", F.col("src").alias("right"), F.col("dst").alias("common"))
    return pairs.join(l_edge, ["chrom", "left"]).join(r_edge, ["chrom", "right", "common"]).select(
        "chrom", "left", "right", "common")


def neighbor_order(edge: DataFrame, segment: DataFrame) -> DataFrame:
    """Search order of a vertex's neighbours: ALT segments ahead of reference ones."""
    target = segment.select("chrom", F.col("seg_id").alias("dst"),
                            (F.col("kind") == "REF").cast("int").alias("is_ref"))
    return edge.join(target, ["chrom", "dst"]).select("chrom", "src", "dst", "is_ref")


def path_step(edge: DataFrame, segment: DataFrame, marking: DataFrame, carrier: DataFrame,
              asked: DataFrame) -> DataFrame:
    """Where a sample's path goes from a vertex: the neighbour marked with the sample,
    else the reference neighbour with the smallest start.

    ``asked`` has ``(chrom, src, sample_id)``; ``marking`` is that of ``segment_sites``.
    Sites and carriers are cut down to the neighbours of the asked vertices before the
    samples are looked up.
    """
    asked = asked.select("chrom", "src", "sample_id").distinct()
    vertices = asked.select("chrom", "src").distinct()
    target = segment.select("chrom", F.col("seg_id").alias("dst"), "kind", "ref_start")
    near = cut_lineage(edge.join(sized(vertices, is_small(vertices)), ["chrom", "src"], "left_semi"))
    ends = near.select("chrom", "dst").distinct()
    few = is_small(ends)
    near = near.join(target.join(sized(ends, few), ["chrom", "dst"], "left_semi"), ["chrom", "dst"])
    sites = marking.select("chrom", F.col("seg_id").alias("dst"), "site_id").join(sized(ends, few), ["chrom", "dst"], "left_semi")
    options = cut_lineage(asked.join(near, ["chrom", "src"]))
    marked = options.select("chrom", "dst", "sample_id").distinct().join(sites, ["chrom", "dst"]).join(
        carrier.select("chrom", "site_id", "sample_id"), ["chrom", "site_id", "sample_id"], "left_semi").select(
        "chrom", "dst", "sample_id", F.lit(1).alias("marked")).distinct()
    options = options.join(marked, ["chrom", "dst", "sample_id"], "left").where(
        F.col("marked").isNotNull() | (F.col("kind") == "REF"))
    choice = F.struct(F.coalesce(-F.col("marked"), F.lit(0)).alias("by_mark"), "ref_start", "dst")
    return options.groupBy("chrom", "src", "sample_id").agg(F.min(choice).alias("best")).select(
        "chrom", "src", "sample_id", F.col("best.dst").alias("dst"),
        (F.col("best.by_mark") != 0).alias("on_variant"))


def dot_lines(found: DataFrame, segment: DataFrame, edge: DataFrame, marking: DataFrame,
              carrier: DataFrame, coord: DataFrame, sample: DataFrame) -> DataFrame:
    """DOT text of each root's neighbourhood as ordered rows ``(root, ord..., line)``.

    A label with thousands of samples is as many rows, never one collected string;
    sorting by ``root, section, a, b`` puts the lines in file order.  Edges leaving
    the neighbourhood are drawn, as its border.  ``marking`` is that of
    ``segments.segment_sites``; only the carriers of drawn segments are looked up.
    """
    nodes = found.select("root", "chrom", "seg_id")
    about = segment.select("chrom", "seg_id", "kind", "length", "ref_start")
    labelled = nodes.join(about, ["chrom", "seg_id"])
    # The text of labels, here and below, and of the frame.
    head = labelled.select(
        "root", F.lit(1).alias("section"), F.col("seg_id").alias("a"),
        F.lit(-2).cast("long").alias("b"),
        F.format_string('%d[ label="%d l:%d', "seg_id", "seg_id", "length").alias("line"))
    ref_mark = labelled.where(F.col("kind") == "REF").select(
        "root", "seg_id", F.lit(-1).cast("long").alias("sample_id"), F.lit("ref").alias("name"),
        F.col("ref_start").alias("index"))
    marks = segment_samples(nodes.join(marking, ["chrom", "seg_id"]), carrier, coord)
    sample_mark = marks.join(sample, "sample_id").select(
        "root", "seg_id", "sample_id", "name", "index")
    marked = ref_mark.unionByName(sample_mark)
    span = marked.groupBy("root", "seg_id").agg(
        F.min("sample_id").alias("first"), F.max("sample_id").alias("last"))
    tags = marked.join(span, ["root", "seg_id"]).select(
        "root", F.lit(1).alias("section"), F.col("seg_id").alias("a"), F.col("sample_id").alias("b"),
        F.concat(
            F.when(F.col("sample_id") == F.col("first"), "(").otherwise(""),
            F.format_string("%s i:%d", "name", "index"),
            F.when(F.col("sample_id") == F.col("last"), ')"]').otherwise(""),
        ).alias("line"))

    is_ref = segment.select("chrom", "seg_id", (F.col("kind") == "REF").alias("is_ref"))
    drawn = (
        nodes.withColumnRenamed("seg_id", "src").join(edge, ["chrom", "src"])
        .join(is_ref.select("chrom", F.col("seg_id").alias("src"), F.col("is_ref").alias("s")),
              ["chrom", "src"])
        .join(is_ref.select("chrom", F.col("seg_id").alias("dst"), F.col("is_ref").alias("d")),
              ["chrom", "dst"])
    )
    on_ref = F.col("s") & F.col("d")
    arrows = drawn.select(
        "root", F.when(on_ref, 3).otherwise(5).alias("section"), F.col("src").alias("a"),
        F.col("dst").alias("b"),
        F.when(on_ref, F.format_string("\t\t%d -> %d", "src", "dst"))
        .otherwise(F.format_string("\t%d -> %d", "src", "dst")).alias("line"))
    fixed = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(a).cast("long").alias("a"), F.lit(t).alias("line"))
        for s, a, t in [
            (0, 0, "digraph {"), (2, 0, "\tsubgraph cluster_0 {"), (2, 1, '\t\tlabel="reference";'),
            (4, 0, "\t}"), (6, 0, "}"),
        ]
    ])
    frame = nodes.select("root").distinct().select("root", F.explode(fixed).alias("f")).select(
        "root", "f.section", "f.a", F.lit(0).cast("long").alias("b"), "f.line")
    return frame.unionByName(head).unionByName(tags).unionByName(arrows)


def vertex_info(segment: DataFrame, marks: DataFrame, classes: DataFrame,
                sample: DataFrame) -> DataFrame:
    """A line of text per vertex and carrier part: id, offset, length, class and carriers."""
    named = with_phasing(marks, sample)
    # The words of the line, here and below.
    text = F.format_string("Sample id: %s Sample phase: %s Index: %d ", "name", "phasing", "index")
    part = F.call_function("div", F.col("sample_id"), F.lit(SAMPLES_PER_PART))
    listed = named.groupBy("chrom", "seg_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("sample_id", text.alias("text")))).alias("s"))
    # Reference segments have no site; a key of their own keeps them from meeting as nulls.
    about = segment.select(
        "chrom", "seg_id", "ref_start", "length",
        F.coalesce("site_id", -1 - F.col("seg_id")).alias("site_id")
    ).join(classes, ["chrom", "site_id"], "left")
    head = F.format_string("ID: %d Offset: %d length: %d sample_class: %d Samples: ", "seg_id",
                           "ref_start", "length", F.coalesce("class_id", F.lit(0)))
    carriers = F.coalesce(F.array_join(F.transform("s", lambda e: e["text"]), ""), F.lit(""))
    return about.join(listed, ["chrom", "seg_id"], "left").select(
        "chrom", "seg_id", F.coalesce("part", F.lit(0)).alias("part"),
        F.concat(head, carriers).alias("info"))
