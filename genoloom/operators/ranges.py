"""Range and interval joins as equi-joins on grid cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import DEFAULT_WIDTH, cell_of
from . import requests as sizes
from .requests import cells_of_requests, profile, sized, within_hull


def points_in_ranges(
    points: DataFrame,
    requests: DataFrame,
    *,
    pos: str = "pos",
    lo: str = "x",
    hi: str = "y",
    by: Sequence[str] = ("chrom",),
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Every (request, point) with ``lo <= pos < hi`` and equal ``by`` columns.

    A request becomes one row per cell it touches, so the exploded side is never
    larger than the answer plus its empty cells.  When that side is small it is
    broadcast and the points are read where they lie; otherwise both sides meet
    in a sort-merge join.
    """
    prof = profile(requests, lo, hi, width)
    wanted = cells_of_requests(requests, lo, hi, width)
    near = within_hull(points, pos, requests, lo, hi, prof).withColumn("_cell", cell_of(pos, width))
    joined = near.join(sized(wanted, prof.broadcastable), [*by, "_cell"])
    return joined.where((F.col(pos) >= F.col(lo)) & (F.col(pos) < F.col(hi))).drop("_cell")


def points_in_cells(
    points: DataFrame,
    requests: DataFrame,
    *,
    pos: str = "pos",
    lo: str = "x",
    hi: str = "y",
    by: Sequence[str] = ("chrom",),
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """The points in some cell a request touches, each once: a cut ahead of a join."""
    prof = profile(requests, lo, hi, width)
    wanted = cells_of_requests(requests.select(*by, lo, hi), lo, hi, width).select(
        *by, "_cell").distinct()
    near = within_hull(points, pos, requests, lo, hi, prof).withColumn("_cell", cell_of(pos, width))
    return near.join(sized(wanted, prof.broadcastable), [*by, "_cell"], "left_semi").drop("_cell")


# Cells of a level are so many times as wide as those of the level below.
FAN, LEVELS = 16, 6


def cover(lo: Column, hi: Column, width: int, levels: int = LEVELS) -> Column:
    """Cells ``(level, cell)`` that together hold ``[lo, hi)``, wider ones the longer it is:
    at each level those that do not fill one of the next, less than ``2 * FAN`` below the
    last.  An empty range has none."""
    first, last = cell_of(lo, width), cell_of(hi - 1, width)
    out, open_ = [], lo < hi

    def some(level: int, ok: Column, a: Column, b: Column) -> Column:
        empty = F.expr("cast(array() as array<struct<_level: int, _cell: bigint>>)")
        cells = F.transform(F.sequence(a, b), lambda c: F.struct(F.lit(level).alias("_level"), c.alias("_cell")))
        return F.when(ok & (a <= b), cells).otherwise(empty)

    for level in range(levels):
        up = F.call_function("div", first + FAN - 1, F.lit(FAN))       # first whole cell of the next level
        down = F.call_function("div", last + 1, F.lit(FAN)) - 1        # and the last
        rises = open_ & (up <= down) if level < levels - 1 else F.lit(False)
        out += [some(level, open_ & ~rises, first, last), some(level, rises, first, up * FAN - 1),
                some(level, rises, (down + 1) * FAN, last)]
        first, last, open_ = up, down, rises
    return F.concat(*out)


def ancestors(pos: Column, width: int, levels: int = LEVELS) -> Column:
    """The cells of all levels that hold a position."""
    cell, out = cell_of(pos, width), []
    for level in range(levels):
        out.append(F.struct(F.lit(level).alias("_level"), cell.alias("_cell")))
        cell = F.call_function("div", cell, F.lit(FAN))
    return F.array(*out)


def _met(points: DataFrame, at: Column, ranges: DataFrame, lo: Column, hi: Column, by: Sequence[str], width: int,
         levels: int = LEVELS) -> tuple[DataFrame, DataFrame, Callable[[DataFrame, DataFrame], DataFrame]]:
    """Points and ranges ``[lo, hi)`` spread over cells, and the join that gives each point
    with each range that holds it once: a range's cells are disjoint, one at most holds it."""
    spread = [df.select("*", F.explode(c).alias("_c")).select("*", "_c._level", "_c._cell").drop("_c")
              for df, c in ((points, ancestors(at, width, levels)), (ranges, cover(lo, hi, width, levels)))]
    return *spread, lambda p, r: p.join(r, [*by, "_level", "_cell"]).where((at >= lo) & (at < hi)).drop("_level", "_cell")


def intervals_in_ranges(
    intervals: DataFrame,
    requests: DataFrame,
    *,
    start: str = "ref_start",
    end: str = "ref_end",
    lo: str = "x",
    hi: str = "y",
    by: Sequence[str] = ("chrom",),
    width: int = DEFAULT_WIDTH,
    contained: bool = False,
) -> DataFrame:
    """Intervals ``[start, end]`` (closed) that overlap, or lie within, ``[lo, hi)``.

    Two of them overlap if the interval starts inside the request or the request starts
    inside the interval, after the interval's own start; each is a join of points with
    ranges.  Ranges are covered by cells that widen with their length, so a long one is a
    few dozen rows, and a pair of long ones meets in one cell instead of in all they share.
    """
    prof = profile(requests, lo, hi, width)
    asked = requests.where(F.col(lo) < F.col(hi))
    near = intervals.where(F.col(start) <= F.col(end))
    if prof.rows:
        near = near.where((F.col(end) >= prof.low) & (F.col(start) < prof.high))
    x, y, a, b = (F.col(c) for c in (lo, hi, start, end))
    longest = asked.agg(F.max(cell_of(y - 1, width) - cell_of(x, width) + 1)).first()[0] or 1
    levels = next((n for n in range(1, LEVELS) if longest < FAN ** n), LEVELS)  # that the requests use
    points, wanted, join = _met(near, a, asked, x, y, by, width, levels)
    few = min(prof.cells, prof.rows * 2 * FAN * LEVELS) <= sizes.BROADCAST_ROWS
    inside = join(points, sized(wanted, few))
    if contained:
        return inside.where(b < y)
    points, spread, join = _met(asked, x, near, a + 1, b + 1, by, width)
    return inside.unionByName(join(sized(points, prof.rows * LEVELS <= sizes.BROADCAST_ROWS), spread))
