"""The position grid every relation shares.

A contig is cut into fixed cells of ``width`` bases.  Cells are the unit of
distribution: range joins meet on a cell, running sums are computed inside a
cell and stitched over cells, and reference bases are stored one row per cell.
A cell holds at most ``width`` distinct positions, which is what bounds every
per-cell group in the package no matter how many rows a contig or sample has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_WIDTH = 4096


def cell_of(pos: Column | str, width: int = DEFAULT_WIDTH) -> Column:
    """Cell number of a 1-based position."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.call_function("div", pos - 1, F.lit(width))


def cell_start(cell: Column | str, width: int = DEFAULT_WIDTH) -> Column:
    """First position of a cell."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return cell * width + 1
