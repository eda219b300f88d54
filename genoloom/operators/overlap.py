"""Overlapping variants of one sample: which ones give way.

A path takes a variant when it starts after the last taken one ends.  Deciding
that is sequential, but only within a run of variants that really overlap.  Most
variants overlap nothing and are settled by one scan.  The rest are grouped by
run and cell.  A run that crosses cells is settled by first working out, for each
of its cells, how far the path reaches after the cell as a function of how far
it reached before.  These step functions are composed in a tree: ``FAN`` neighbours
into one, and so on up to the whole run; then the reach at the start of each node is
handed down, and only then is each cell walked with its known start.  No group
exceeds one cell of positions or ``FAN`` short functions, however long a run is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import DEFAULT_WIDTH, cell_of, cell_start
from ..session import cut_lineage
from .scan import ordered_scan

PATH = ["chrom", "sample_id"]
RUN = [*PATH, "_run"]
FAN = 64
_STEPS = "array<struct<upto: bigint, exit: bigint>>"


def _reach_after(steps: Column, reach: Column) -> Column:
    """Apply a cell's step function: ``steps`` holds ``(upto, exit)`` by falling
    ``upto``; the last step whose ``upto`` is beyond ``reach`` is the one taken."""
    taken = F.filter(steps, lambda s: s["upto"] > reach)
    return F.when(F.size(taken) > 0, F.try_element_at(taken, F.lit(-1))["exit"]).otherwise(reach)


def _cell_steps(edits: Column, cell_end: Column) -> Column:
    """How far the path reaches after a cell, for every reach before it.

    Edits are taken last to first.  Ends inside the cell all count as its last
    base, so neighbouring steps mostly fall together and few remain.
    """
    def step(acc: Column, edit: Column) -> Column:
        ends = F.greatest(edit["hi"], cell_end)
        leads_to = F.filter(acc, lambda s: s["upto"] > edit["hi"])
        exit_ = F.when(F.size(leads_to) > 0,
                       F.try_element_at(leads_to, F.lit(-1))["exit"]).otherwise(ends)
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["exit"] == exit_)
        one = F.array(F.struct(edit["lo"].alias("upto"), exit_.alias("exit")))
        return F.when(same, acc).otherwise(F.concat(acc, one))

    return F.aggregate(F.reverse(edits), F.expr(f"cast(array() as {_STEPS})"), step)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _composed(nodes: Column) -> Column:
    """The step function of neighbouring nodes ``(at, steps)``, in order, as one.

    A reach beyond all steps of the earlier ones meets the later ones as it is.  Of steps
    that lead to the same place only the first is kept, so composites stay short.
    """
    def then(f: Column, g: Column) -> Column:
        top = F.coalesce(F.get(f, 0)["upto"], F.lit(-1))
        chained = F.concat(F.filter(g, lambda s: s["upto"] > top), F.transform(f, lambda s: F.struct(
            s["upto"].alias("upto"), _reach_after(g, s["exit"]).alias("exit"))))
        return _let(chained, lambda c: F.filter(
            c, lambda s, i: ~s["exit"].eqNullSafe(F.get(c, i - 1)["exit"])))

    return F.aggregate(nodes, F.expr(f"cast(array() as {_STEPS})"), lambda f, node: then(f, node["steps"]))


def _starts(nodes: Column, reach: Column) -> Column:
    """``(at, reach)`` at the start of each of up to ``FAN`` neighbours."""
    start = F.struct(reach.alias("reach"), F.expr("cast(array() as array<struct<at: bigint, reach: bigint>>)").alias("seen"))

    def step(acc: Column, node: Column) -> Column:
        here = F.array(F.struct(node["at"].alias("at"), acc["reach"].alias("reach")))
        return F.struct(_reach_after(node["steps"], acc["reach"]).alias("reach"), F.concat(acc["seen"], here).alias("seen"))

    return F.aggregate(nodes, start, step, lambda acc: acc["seen"])


def run_starts(cells: DataFrame) -> DataFrame:
    """``(RUN, at, reach)``: how far the path reaches ahead of each cell of a run, for cells
    ``(RUN, at, steps)`` numbered from 0 along it.  Runs of one cell are left out."""
    last = cells.groupBy(*RUN).agg(F.max("at").alias("last")).where("last > 0")
    most = last.agg(F.max("last")).first()[0]
    nodes = [cut_lineage(cells.join(last.select(*RUN), RUN, "left_semi"))]
    above = F.call_function("div", F.col("at"), F.lit(FAN)).alias("above")

    def families(level: DataFrame) -> DataFrame:
        return level.groupBy(*RUN, above).agg(F.sort_array(F.collect_list(F.struct("at", "steps"))).alias("nodes"))

    while most and most >= FAN ** len(nodes):
        nodes.append(cut_lineage(families(nodes[-1]).select(*RUN, F.col("above").alias("at"), _composed(F.col("nodes")).alias("steps"))))
    starts = nodes[-1].select(*RUN, F.lit(0).cast("long").alias("above"), F.lit(-1).cast("long").alias("reach")).distinct()
    for level in reversed(nodes):
        starts = cut_lineage(families(level).join(starts, [*RUN, "above"]).select(
            *RUN, F.explode(_starts(F.col("nodes"), F.col("reach"))).alias("n")).select(
            *RUN, F.col("n.at").alias("above"), "n.reach"))
    return starts.withColumnRenamed("above", "at")


def _lost_in_cell(edits: Column, reach: Column) -> Column:
    """Walk a cell from a known reach; returns the keys of the edits that give way."""
    start = F.struct(
        reach.alias("reach"), F.expr("cast(array() as array<bigint>)").alias("lost"))

    def step(acc: Column, edit: Column) -> Column:
        fits = edit["lo"] > acc["reach"]
        return F.struct(
            F.when(fits, edit["hi"]).otherwise(acc["reach"]).alias("reach"),
            F.when(fits, acc["lost"]).otherwise(
                F.concat(acc["lost"], F.array(edit["edit_key"]))).alias("lost"),
        )

    return F.aggregate(edits, start, step, lambda acc: acc["lost"])


def overlapped_edits(candidates: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``(chrom, sample_id, _cell, edit_key)`` of the candidates left off the path."""
    slim = candidates.select(*PATH, "_cell", "edit_key", "lo", "hi")
    scanned = ordered_scan(
        slim, PATH, "_cell", ["edit_key"],
        reach=("max_before", F.col("hi")), next_lo=("next", F.col("lo")),
    )
    leads = F.col("reach").isNull() | (F.col("lo") > F.col("reach"))
    # Few rows as a rule, and read many times below.
    touching = cut_lineage(scanned.where(~leads | (F.col("next_lo") <= F.col("hi"))))
    runs = ordered_scan(
        touching.withColumn("_lead", F.when(leads, F.col("lo"))), PATH, "_cell", ["edit_key"],
        lead_before=("max_before", F.col("_lead")),
    ).withColumn("_run", F.coalesce("_lead", "lead_before"))
    groups = cut_lineage(runs.groupBy(*RUN, "_cell").agg(
        F.sort_array(F.collect_list(F.struct("edit_key", "lo", "hi"))).alias("edits")))

    cell_end = cell_start(F.col("_cell") + 1, width) - 1
    first = cell_of("_run", width)  # a run is named by where it starts
    starts = run_starts(groups.select(
        *RUN, (F.col("_cell") - first).alias("at"), _cell_steps(F.col("edits"), cell_end).alias("steps"))).select(
        *RUN, (F.col("at") + first).alias("_cell"), "reach")
    walked = groups.join(starts, [*RUN, "_cell"], "left").select(
        *PATH, "_cell",
        F.explode(_lost_in_cell(
            F.col("edits"), F.coalesce("reach", F.lit(-1).cast("long")))).alias("edit_key"),
    )
    return walked
