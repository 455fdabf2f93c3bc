"""Player stages: a small fixed dimension of abilities in [0, 1]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ABILITIES = ["reading", "speed", "stamina", "jack", "chord", "ln", "accuracy", "pattern_memory"]
STAGE_COLUMNS = ["stage_id", *ABILITIES]

# Default stages, abilities in the order above.
DEFAULT_STAGES = [
    ("readless_beginner", 0.05, 0.08, 0.05, 0.03, 0.04, 0.02, 0.05, 0.00),
    ("beginner", 0.18, 0.20, 0.16, 0.12, 0.13, 0.10, 0.16, 0.08),
    ("novice", 0.35, 0.38, 0.32, 0.28, 0.30, 0.24, 0.34, 0.22),
    ("intermediate", 0.55, 0.58, 0.53, 0.48, 0.50, 0.45, 0.55, 0.44),
    ("advanced", 0.74, 0.76, 0.72, 0.70, 0.70, 0.66, 0.74, 0.66),
    ("dan_ready", 0.88, 0.90, 0.88, 0.86, 0.85, 0.82, 0.88, 0.82),
]


def default_stages(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(*[F.lit(value).alias(name) for name, value in zip(STAGE_COLUMNS, row, strict=True)])
        for row in DEFAULT_STAGES
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def stage_violations(stages: DataFrame) -> DataFrame:
    """(stage_id, column, problem) for every broken rule; empty for a valid table."""
    missing = [name for name in STAGE_COLUMNS if name not in stages.columns]
    if missing:
        raise ValueError(f"Missing player stage columns: {', '.join(missing)}")
    name_of = F.col("stage_id").cast("string")
    problem = lambda condition, column, text: F.when(
        condition, F.struct(F.lit(column).alias("column"), F.lit(text).alias("problem"))
    )
    rules = [problem(F.coalesce(F.trim(name_of) == "", F.lit(True)), "stage_id", "empty")]
    for name in ABILITIES:
        number = F.col(name).try_cast("double")
        usable = number.isNotNull() & ~F.isnan(number)
        rules.append(problem(~usable, name, "not a number"))
        rules.append(problem(usable & ((number < 0.0) | (number > 1.0)), name, "outside 0..1"))
    broken = stages.select(name_of.alias("stage_id"), F.explode(F.array_compact(F.array(*rules))).alias("r"))
    repeated = stages.groupBy(name_of.alias("stage_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = repeated.select("stage_id", F.lit("stage_id").alias("column"), F.lit("duplicate").alias("problem"))
    return broken.select("stage_id", "r.*").unionByName(twice)


def validated_stages(stages: DataFrame) -> DataFrame:
    first = stage_violations(stages).head()
    if first is not None:
        raise ValueError(f"{first['column']} of stage {first['stage_id']!r}: {first['problem']}")
    return stages.select(
        F.col("stage_id").cast("string").alias("stage_id"), *[F.col(n).cast("double").alias(n) for n in ABILITIES]
    )
