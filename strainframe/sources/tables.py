"""Domain views over the star-schema tables.

Each function is a plain projection, so filters and column pruning reach the
Parquet scan. The same mappings exist as SQL text in ``catalog/views.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_notes(spark: SparkSession, folder: str) -> DataFrame:
    """events -> unsorted notes: one user is one chart, 30 days become 30 s on a 50 ms grid."""
    micros = F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')")
    is_ln = (F.col("event_type") == "purchase").cast("int")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("beatmap_id"),
        F.col("event_id").alias("source_order"),
        (F.floor(micros / F.lit(4_320_000_000)) * 50).cast("long").alias("time_ms"),
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(KEYS)).alias("col"),
        is_ln.alias("is_ln"),
        F.when(is_ln == 1, F.floor(F.col("value") * 10)).otherwise(0).cast("long").alias("ln_length_ms"),
    )


def accuracy() -> Column:
    return F.lit(1.0) - F.col("l_discount") * F.col("l_quantity") / 50


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_partkey").alias("beatmap_id"), accuracy().alias("accuracy"))


def maps(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("beatmap_id"),
        F.col("p_brand").alias("beatmapset_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("artist"),
        F.col("p_brand").alias("mapper"),
        size.cast("string").alias("version"),
        (size.cast("long") * 1000).alias("length_ms"),
        (F.lit(90.0) + size * 3).alias("bpm"),
        F.col("p_retailprice").alias("difficulty_rating"),
        F.when(size % 10 == 0, 0).otherwise(3).alias("mode"),
        F.when(size % 7 == 0, 7).otherwise(4).alias("keys"),
        (F.lit(3.0) + size / 10).alias("hp_drain_rate"),
        F.when(size % 7 != 3, size / F.lit(5.0)).alias("overall_difficulty"),
        (F.lit(5.0) + size % 5).alias("approach_rate"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """orders -> pair annotations with free-text choice and confidence."""
    choice = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "A")
        .when(F.col("o_orderpriority") == "2-HIGH", "right")
        .when(F.col("o_orderpriority") == "3-MEDIUM", " Tie ")
        .when(F.col("o_orderpriority") == "5-LOW", "uncertain")
        .otherwise("")
    )
    price = F.col("o_totalprice")
    confidence = (
        F.when(F.col("o_orderkey") % 11 == 0, "")
        .when(F.col("o_orderkey") % 13 == 0, "n/a")
        .otherwise(F.round(price / 100_000, 2).cast("string"))
    )
    stages = F.array(*[F.lit(name) for name in STAGE_IDS])
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pair_id"),
        F.when(F.col("o_orderstatus") == "F", "segment").otherwise("map").alias("scope"),
        F.element_at(stages, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("player_stage"),
        F.col("o_custkey").alias("a_beatmap_id"),
        (F.col("o_orderkey") % 150 + 1).alias("b_beatmap_id"),
        F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 20).cast("double")).alias("start_sec"),
        F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 20 + 1 + F.col("o_orderkey") % 4).cast("double")).alias("end_sec"),
        (price / 100_000).alias("a_peak_strain"),
        F.when(F.col("o_orderkey") % 17 != 0, F.pmod(price, F.lit(1000.0)) / 100).alias("b_peak_strain"),
        choice.alias("harder_choice"),
        confidence.alias("confidence"),
    )


# Stage ids in the order of the stage table, then one unknown id.
STAGE_IDS = [
    "readless_beginner",
    "beginner",
    "novice",
    "intermediate",
    "advanced",
    "dan_ready",
    "unlisted_stage",
]


def history(spark: SparkSession, folder: str) -> DataFrame:
    """events -> training history rows; ``epoch`` is added where order is computed."""
    val_loss = F.col("value") / 100
    key = F.col("event_id")
    return table(spark, folder, "events").select(
        F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("run"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("logged_at"),
        key.alias("event_id"),
        (val_loss * (F.lit(0.8) + (key % 5) / F.lit(10.0))).alias("train_loss"),
        F.when(key % 29 != 0, val_loss).alias("val_loss"),
        F.when(key % 7 != 0, val_loss * F.lit(0.5) + (key % 3) / F.lit(1000.0)).alias("val_mean_mae"),
        F.when(key % 5 != 0, (key % 100) / F.lit(100.0)).alias("val_mean_pairwise_order_accuracy"),
        F.when(key % 3 != 0, (key % 240).cast("double")).alias("epoch_seconds"),
        (F.lit(1.0) / (key % 10 + 1)).alias("lr"),
        F.when(F.col("user_id") % 3 != 0, (key % 20_000).cast("double")).alias("cuda_max_memory_mb"),
    )
