"""Ordered scans over a contig without putting a contig in one task.

A plain ``Window.partitionBy('chrom').orderBy('pos')`` sends a whole contig to
one task.  Here the window runs inside each grid cell, one summary row per cell
is scanned over the cells, and the two are added up.  The first window sees one
cell of positions, the second one row per cell of the contig.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    cell: str,
    order: Sequence[str],
    **outputs: tuple[str, Column],
) -> DataFrame:
    """Add scan columns to ``df``; each output is ``name=(kind, value)``.

    Kinds, all along ``order`` within ``by``:

    * ``sum_before``: sum of the values of earlier rows
    * ``max_before``: largest value of earlier rows, null if none
    * ``min_after``: smallest value of later rows, null if none
    * ``previous`` / ``next``: value of the neighbouring row, null at the ends

    ``cell`` must not decrease along ``order``, nor may the values of ``previous`` and
    ``next``, which must not be null either.  ``df`` is read twice, in full for the
    rows and by its keys and values for the cell summaries; an expensive one is best
    written out first.
    """
    keys = [*by, cell]
    inside = Window.partitionBy(*keys).orderBy(*order)
    across = Window.partitionBy(*by).orderBy(cell)
    before, after = (_FIRST, -1), (1, _LAST)

    local: dict[str, Column] = {}
    totals: list[Column] = []
    carried: list[Column] = []
    combine: dict[str, Column] = {}
    for name, (kind, value) in outputs.items():
        here, total, carry = f"_here_{name}", f"_total_{name}", f"_carry_{name}"
        if kind == "sum_before":
            local[here] = F.coalesce(F.sum(value).over(inside.rowsBetween(*before)), F.lit(0))
            totals.append(F.sum(value).alias(total))
            carried.append(
                F.coalesce(F.sum(total).over(across.rowsBetween(*before)), F.lit(0)).alias(carry))
            combine[name] = F.col(here) + F.col(carry)
        elif kind == "max_before":
            local[here] = F.max(value).over(inside.rowsBetween(*before))
            totals.append(F.max(value).alias(total))
            carried.append(F.max(total).over(across.rowsBetween(*before)).alias(carry))
            combine[name] = F.greatest(F.col(here), F.col(carry))
        elif kind == "min_after":
            local[here] = F.min(value).over(inside.rowsBetween(*after))
            totals.append(F.min(value).alias(total))
            carried.append(F.min(total).over(across.rowsBetween(*after)).alias(carry))
            combine[name] = F.least(F.col(here), F.col(carry))
        elif kind == "previous":
            local[here] = F.lag(value, 1).over(inside)
            totals.append(F.max(value).alias(total))
            carried.append(F.lag(total, 1).over(across).alias(carry))
            combine[name] = F.coalesce(F.col(here), F.col(carry))
        elif kind == "next":
            local[here] = F.lead(value, 1).over(inside)
            totals.append(F.min(value).alias(total))
            carried.append(F.lead(total, 1).over(across).alias(carry))
            combine[name] = F.coalesce(F.col(here), F.col(carry))
        else:
            raise ValueError(f"unknown scan kind: {kind}")

    # With few rows a cell it has almost as many rows as ``df``, and the planner, going by the
    # size of compressed files, would broadcast it.
    carry_in = df.groupBy(*keys).agg(*totals).select(*keys, *carried).hint("merge")
    scanned = df.select("*", *[c.alias(n) for n, c in local.items()]).join(carry_in, keys)
    return scanned.select(*df.columns, *[c.alias(n) for n, c in combine.items()])
