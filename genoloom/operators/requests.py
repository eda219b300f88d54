"""Batches of requests: how large they are and which side of a join may be broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import cell_of

# A broadcast side is at most this many rows and bytes of text.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
# Up to this many ranges are handed to the scan one by one, beyond it their hull.
PUSHED_RANGES = 32


@dataclass(frozen=True)
class Profile:
    """What one aggregate over a request batch tells about it."""

    rows: int
    cells: int
    low: int | None
    high: int | None

    @property
    def few(self) -> bool:
        return self.rows <= BROADCAST_ROWS

    @property
    def broadcastable(self) -> bool:
        return self.cells <= BROADCAST_ROWS


def profile(requests: DataFrame, lo: str, hi: str, width: int) -> Profile:
    """Size and hull of half-open request ranges ``[lo, hi)``; one small action."""
    spread = cell_of(F.col(hi) - 1, width) - cell_of(lo, width) + 1
    row = requests.where(F.col(lo) < F.col(hi)).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(spread).alias("cells"),
        F.min(lo).alias("low"), F.max(hi).alias("high"),
    ).first()
    return Profile(row["rows"], row["cells"] or 0, row["low"], row["high"])


def sized(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side whose size was checked, else ask for a sort-merge join,
    which adaptive execution can split on skewed keys."""
    return F.broadcast(df) if small else df.hint("merge")


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has few enough rows and bytes of text to broadcast.

    Counted by one plain aggregate: each task sends one row of partial sums.
    """
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    rows, size = df.agg(F.count(F.lit(1)), sum(text, F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def within_hull(points: DataFrame, pos: str, requests: DataFrame, lo: str, hi: str,
                prof: Profile) -> DataFrame:
    """Keep points that some request range could hold, as plain comparisons that
    reach the parquet scan."""
    if prof.rows == 0:
        return points.where(F.lit(False))
    p = F.col(pos)
    if prof.rows <= PUSHED_RANGES:
        ranges = requests.where(F.col(lo) < F.col(hi)).select(lo, hi).distinct().limit(
            PUSHED_RANGES).collect()
        wanted = F.lit(False)
        for r in ranges:
            wanted = wanted | ((p >= r[0]) & (p < r[1]))
        return points.where(wanted)
    return points.where((p >= prof.low) & (p < prof.high))


def cells_of_requests(requests: DataFrame, lo: str, hi: str, width: int,
                      out: str = "_cell") -> DataFrame:
    """One row per request and cell its half-open range touches."""
    return requests.where(F.col(lo) < F.col(hi)).withColumn(
        out, F.explode(F.sequence(cell_of(lo, width), cell_of(F.col(hi) - 1, width))))


def check_columns(df: DataFrame, needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
