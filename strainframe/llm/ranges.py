"""Rows in the order of an id over many tasks: ranges of ids with known borders."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_range(docs: DataFrame, id_column: str, ranges: int, name: str) -> DataFrame:
    """Rows with the number of their id range, about equally many rows each; null ids count as the lowest.

    The borders come from one pass over the id column alone. Equal ids share a range.
    """
    shares = [n / ranges for n in range(1, ranges)]
    value = F.col(id_column).cast("double")
    borders = docs.agg(F.percentile_approx(value, shares, 10 * ranges).alias("at")).first()["at"] if shares else None
    borders = sorted(set(borders or ()))
    if not borders:
        return docs.withColumn(name, F.lit(0))
    raw, placed = f"{name} of", f"{name} as double"
    bucket = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol=raw, outputCol=placed)
    found = bucket.transform(docs.withColumn(raw, F.coalesce(value, F.lit(float("-inf")))))
    return found.withColumn(name, F.col(placed).cast("int")).drop(raw, placed)
