"""Energy arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the source holds one reading per minute.
SAMPLES_PER_HOUR = 60
UNIT_SUFFIX = " [kW]"


def _c(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def net_energy(use: str | Column, gen: str | Column) -> Column:
    """Use minus generation (NULL if either side is NULL)."""
    return _c(use) - _c(gen)


def energy_ratio(use: str | Column, gen: str | Column) -> Column:
    """gen/use when use > 0, else 0 (NULL use also gives 0)."""
    u, g = _c(use), _c(gen)
    return F.when(u > 0, g / u).otherwise(F.lit(0.0))


def kw_to_kwh(kw_sum: str | Column, samples_per_hour: int = SAMPLES_PER_HOUR) -> Column:
    """A sum of per-sample kW readings as kWh."""
    return _c(kw_sum) / F.lit(float(samples_per_hour))


def strip_unit(label: str | Column, suffix: str = UNIT_SUFFIX) -> Column:
    """Remove the literal unit suffix from a label (not a regex)."""
    return F.replace(_c(label), F.lit(suffix), F.lit(""))
