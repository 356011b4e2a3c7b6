"""meterlake: Spark-native analytics for regular meter / covariate time series.

Every public operator is a plain ``DataFrame -> DataFrame`` function that is
grouped by an optional list of series ``keys`` (meter, device, home ...).
"""

from meterlake.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
