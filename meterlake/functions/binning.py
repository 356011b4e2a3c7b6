"""Equal-width binning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label format of a temperature bin.
BIN_LABEL = "%.1f°C to %.1f°C"


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int = 10) -> Column:
    """Right-closed bins ``(edge_i, edge_i+1]`` over ``[lo, hi]``; the minimum
    falls in bin 0. ``lo``/``hi`` are scalar columns (e.g. ``df.scalar()``).
    A single value range (lo = hi) is one bin 0."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.ceil((x - lo) / width) - 1
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)))
    return F.when(x.isNotNull(), b.cast("int"))


def bin_edges(b: Column, lo: Column, hi: Column, bins: int = 10) -> tuple[Column, Column]:
    """Left and right edge of bin ``b``. pandas widens the outer edges by 0.1 %
    of the range so the minimum is included; the printed labels use these."""
    rng = hi - lo
    width = rng / F.lit(float(bins))
    left = lo + b * width
    right = lo + (b + 1) * width
    left = F.when(b == 0, lo - rng * F.lit(0.001)).otherwise(left)
    return left, right


def bin_label(left: Column, right: Column, fmt: str = BIN_LABEL) -> Column:
    return F.format_string(fmt, left, right)
