"""Feature statistics over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_minmax(stream: DataFrame, features: str = "features") -> DataFrame:
    """f, mn, mx so far of a stream of array-valued rows; a bounded state of one row for each feature (output mode complete or update)."""
    long = stream.select(F.posexplode(features).alias("f", "v"))
    return long.groupBy("f").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
