"""Embedding scaling, projection and label rows."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaled(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``scaled`` (z-scores per dimension, deviation 0 -> 1) and ``embedding_norm`` of the raw vector.

    All vectors have the same length; their sums are taken whole, one row a vector,
    and the statistics travel as a single row.
    """
    whole = embeddings.filter(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    found = whole.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("_s"))
    count = F.col("_s.count")
    # The summary has the deviation of a sample; the population's is wanted.
    population = F.transform(vector_to_array("_s.variance"), lambda x: F.when(count > 0, F.sqrt(x * (count - 1) / count)))
    packed = found.select(vector_to_array("_s.mean").alias("_mean"), population.alias("_std"))
    score = lambda x, place: (x.cast("double") - F.get("_mean", place)) / F.when(F.get("_std", place) > 0, F.get("_std", place)).otherwise(1.0)
    square = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    joined = embeddings.crossJoin(F.broadcast(packed))  # one row
    return joined.withColumns({"scaled": F.transform(vector, score), "embedding_norm": F.sqrt(square)}).drop("_mean", "_std")


def projected(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``projection_x`` and ``projection_y``, the first two principal components of the z-scores.

    The sign of a component makes its largest loading positive. A single vector
    lies at the origin; with one dimension the second coordinate is 0.
    """
    rows = scaled(embeddings, vector)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).head()
    if not shape["n"]:
        raise ValueError("cannot project an empty embedding table")
    if shape["n"] == 1:
        return rows.withColumns({"projection_x": F.lit(0.0), "projection_y": F.lit(0.0)}).drop("scaled")
    parts = min(2, shape["n"], shape["d"])
    vectors = rows.withColumn("_v", array_to_vector("scaled"))
    model = PCA(k=parts, inputCol="_v", outputCol="_p").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if max(column, key=abs) >= 0 else -1.0 for column in loadings.T]
    place = vector_to_array("_p")
    coordinates = {"projection_x": place[0] * signs[0]}
    coordinates["projection_y"] = place[1] * signs[1] if parts > 1 else F.lit(0.0)
    return model.transform(vectors).withColumns(coordinates).drop("_v", "_p", "scaled")


def labelled(embeddings: DataFrame, labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Each vector with its label row, predictions and norm."""
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = embeddings.withColumnRenamed(key, "beatmap_id").withColumn("embedding_norm", F.sqrt(square))
    picked = ["beatmap_id", *[name for name in predictions.columns if name.startswith("pred_")]]
    return rows.join(labels, "beatmap_id").join(predictions.select(*picked), "beatmap_id", "left")
