"""Candidate pairs for labeling: neighbours in strain order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.operators.curves import segment_skill, top_segments
from strainframe.operators.judgments import annotation_table
from strainframe.operators.review import top_rows
from strainframe.plans.ordered import OrderedRuns

FIELDS = ["beatmap_id", "title", "artist", "version", "start_sec", "end_sec", "dominant_skill", "peak_strain"]


def _neighbour_pairs(sides: DataFrame, order: list[str], closeness: list[Column], limit: int) -> DataFrame:
    """Pair each row with its predecessor in ``order`` and keep the closest ``limit`` pairs."""
    packed = sides.withColumn("side", F.struct(*[F.col(name) for name in FIELDS]))
    runs = OrderedRuns.build(packed.select(*order, "side"), [], order).indexed("place").lagged({"left": ("side", 1)})
    pairs = runs.rows().filter("place > 0").select("left", F.col("side").alias("right"), "place")
    pairs = pairs.withColumns({f"_c{i}": column for i, column in enumerate(closeness)})
    ranking = [*[F.col(f"_c{i}") for i in range(len(closeness))], F.col("place")]
    return top_rows(pairs, ranking, limit, "number").withColumn("number", F.col("number") - 1).select("number", "left", "right")


def _gap() -> Column:
    return F.abs(F.col("left.peak_strain") - F.col("right.peak_strain"))


def map_pairs(summary: DataFrame, limit: int) -> DataFrame:
    sides = summary.select(
        "beatmap_id", "title", "artist", "version",
        F.lit(None).cast("double").alias("start_sec"), F.lit(None).cast("double").alias("end_sec"),
        "dominant_skill", "peak_strain",
    )
    same = (F.col("left.dominant_skill") == F.col("right.dominant_skill")).cast("int")
    return _neighbour_pairs(sides, ["peak_strain", "beatmap_id"], [_gap(), same], limit)


def segment_pairs(curve: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """The two strongest windows of each chart, paired across charts.

    The curve only has labelled charts, so no pair loses a side in the join.
    """
    segments = top_segments(curve).withColumn("dominant_skill", segment_skill())
    sides = segments.join(labels.select("beatmap_id", "title", "artist", "version"), "beatmap_id").select(
        "beatmap_id", "title", "artist", "version", "start_sec", "end_sec", "dominant_skill",
        F.col("feel_strain").alias("peak_strain"),
    )
    return _neighbour_pairs(sides, ["peak_strain", "beatmap_id", "start_sec"], [_gap()], limit)


def pair_candidates(
    summary: DataFrame, curve: DataFrame, labels: DataFrame, stage_ids: list[str], *, max_pairs: int = 80
) -> DataFrame:
    """Annotation rows: map pairs first, then segment pairs, up to ``max_pairs``.

    Odd pairs swap sides; stages are dealt in turn across both lists.
    """
    maps = map_pairs(summary, max_pairs).withColumn("scope", F.lit("map"))
    segments = segment_pairs(curve, labels, max_pairs).withColumn("scope", F.lit("segment"))
    # At most 2 * max_pairs rows from here on; 'map' sorts before 'segment'.
    both = top_rows(maps.unionByName(segments), [F.col("scope"), F.col("number")], max_pairs, "turn")
    stages = F.array(*[F.lit(name) for name in stage_ids])
    odd = F.col("number") % 2 == 1
    both = both.withColumns(
        {
            "player_stage": F.element_at(stages, ((F.col("turn") - 1) % len(stage_ids) + 1).cast("int")),
            "a": F.when(odd, F.col("right")).otherwise(F.col("left")),
            "b": F.when(odd, F.col("left")).otherwise(F.col("right")),
        }
    )
    name = F.format_string("%s_%s_%04d", F.col("scope"), F.col("player_stage"), F.col("number"))
    columns = [F.col(f"{side}.{field}").alias(f"{side}_{field}") for side in ("a", "b") for field in FIELDS]
    return annotation_table(both.select(name.alias("pair_id"), "scope", "player_stage", *columns))
