"""Landed JSON: search pages, score payloads, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.functions.casts import truncated_int

# Cells whose JSON type decides are kept as variants: the text "3" is not the number 3.
_MAP_FIELDS = (
    "id: long, mode: variant, mode_int: variant, status: variant, ranked: variant, cs: string, version: string, "
    "total_length: string, bpm: variant, difficulty_rating: string, drain: string, accuracy: string, ar: string"
)
PAGE_SCHEMA = (
    "beatmapsets array<struct<id: string, title: string, artist: string, creator: string, bpm: variant, "
    f"beatmaps: array<struct<{_MAP_FIELDS}>>>>"
)


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    """The value of a JSON number; true counts as one, false as zero."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double")
    )


def first_truthy(*values: Column) -> Column:
    """First JSON value that is neither missing, null, an empty text, false nor a zero; text of digits is text."""
    usable = lambda v: v.isNotNull() & (F.schema_of_variant(v) != "VOID") & (F.coalesce(_text(v), F.lit("x")) != "") & (F.coalesce(_number(v), F.lit(1.0)) != 0)
    return F.coalesce(*[F.when(usable(v), v) for v in values])


def is_ranked_keymode(chart: str, keys: int = 4) -> Column:
    field = lambda name: F.col(f"{chart}.{name}")
    mode = first_truthy(field("mode"), field("mode_int"))
    status = first_truthy(field("status"), field("ranked"))
    same = lambda value, text, number: F.coalesce(_text(value) == text, _number(value) == number, F.lit(False))
    ok = same(mode, "mania", 3) & same(status, "ranked", 1) & (truncated_int(field("cs")) == keys)
    return F.coalesce(ok, F.lit(False))


def flatten_pages(pages: DataFrame, keys: int = 4) -> DataFrame:
    """(page_no, page json) -> one row per ranked chart of the key mode, in page order."""
    parsed = pages.select("page_no", F.from_json("page", PAGE_SCHEMA).alias("j"))
    sets = parsed.select("page_no", F.posexplode("j.beatmapsets").alias("set_no", "s"))
    charts = sets.select("page_no", "set_no", "s", F.posexplode("s.beatmaps").alias("map_no", "m"))
    kept = charts.filter(is_ranked_keymode("m", keys))
    number = lambda name: F.col(f"m.{name}").try_cast("double")
    return kept.select(
        "page_no",
        "set_no",
        "map_no",
        F.col("m.id").alias("beatmap_id"),
        F.col("s.id").alias("beatmapset_id"),
        F.coalesce("s.title", F.lit("")).alias("title"),
        F.coalesce("s.artist", F.lit("")).alias("artist"),
        F.coalesce("s.creator", F.lit("")).alias("mapper"),
        F.coalesce("m.version", F.lit("")).alias("version"),
        (F.coalesce(truncated_int(F.col("m.total_length")), F.lit(0)) * 1000).alias("length_ms"),
        F.try_variant_get(first_truthy(F.col("m.bpm"), F.col("s.bpm")), "$", "double").alias("bpm"),
        number("difficulty_rating").alias("difficulty_rating"),
        F.lit(3).alias("mode"),
        number("cs").alias("circle_size"),
        truncated_int(F.col("m.cs")).cast("int").alias("keys"),
        number("drain").alias("hp_drain_rate"),
        number("accuracy").alias("overall_difficulty"),
        number("ar").alias("approach_rate"),
    )


PAGE_ORDER = ["page_no", "set_no", "map_no"]


def first_maps(flat: DataFrame, target: int) -> DataFrame:
    """First row per chart in page order, up to ``target`` charts.

    The earliest row is picked by a combinable aggregate, so copies of a chart
    are reduced before the shuffle.
    """
    payload = [name for name in flat.columns if name != "beatmap_id"]
    row = F.struct(*[F.col(name) for name in payload])
    first = flat.groupBy("beatmap_id").agg(F.min_by(row, F.struct(*PAGE_ORDER)).alias("r")).select("beatmap_id", "r.*")
    return first.orderBy(*PAGE_ORDER).limit(target)


def score_rows(payloads: DataFrame) -> DataFrame:
    """(beatmap_id, payload json) -> accuracies, nulls dropped."""
    parsed = F.from_json("payload", "scores array<struct<accuracy: double>>")
    rows = payloads.select("beatmap_id", F.explode(parsed["scores"]).alias("s"))
    return rows.select("beatmap_id", F.col("s.accuracy").alias("accuracy")).filter("accuracy is not null")


# Columns of the run comparison.
TARGET_METRICS = [
    "mae", "r2", "spearman", "pairwise_order_accuracy", "baseline_mae", "mae_improvement_vs_baseline",
    "mae_improvement_pct", "difficulty_rating_baseline_mae", "mae_improvement_vs_difficulty_rating_baseline",
    "mae_improvement_pct_vs_difficulty_rating_baseline",
]
RUN_COLUMNS = [
    "model_name", "seed", "feature_set", "split_strategy", "group_column", "group_count", "device", "requested_device",
    "amp_enabled", "effective_batch_size", "grad_accum_steps", "grad_clip_norm", "loss", "huber_delta",
    "sample_weight_column", "sample_weight_train_mean", "sample_weight_train_downweighted_rate", "checkpoint_metric",
    "best_checkpoint_score", "best_epoch", "epochs_completed", "stop_reason", "early_stopped", "git_commit",
    "git_branch", "git_dirty", "git_status_entries", "best_val_loss", "test_loss", "cv_folds", "train_size", "val_size",
    "test_size", "sample_size",
]


def run_metric_rows(documents: DataFrame) -> DataFrame:
    """(path, json, default_evaluation) -> one row per run, evaluation and target.

    The run is the folder above the file. Keys starting with '_' are no
    targets; absent metrics and run values are NULL.
    """
    parsed = documents.withColumn("doc", F.from_json("json", "map<string, string>"))
    info = F.from_json(F.try_element_at("doc", F.lit("_run")), "map<string, string>")
    parsed = parsed.select(
        F.element_at(F.split("path", "/"), -2).alias("run"), "default_evaluation", info.alias("info"), F.explode("doc").alias("target", "body")
    )
    targets = parsed.filter(~F.col("target").startswith("_")).withColumn("m", F.from_json("body", "map<string, string>"))
    of_run = lambda name: F.try_element_at("info", F.lit(name))
    return targets.filter("m is not null").select(
        "run",
        F.coalesce(of_run("evaluation"), F.col("default_evaluation")).alias("evaluation"),
        "target",
        *[F.try_element_at("m", F.lit(name)).try_cast("double").alias(name) for name in TARGET_METRICS],
        *[of_run(name).alias(name) for name in RUN_COLUMNS],
    )


def read_run_metrics(spark, pattern: str, default_evaluation: str) -> DataFrame:
    """Documents from files such as ``runs/*/metrics.json``."""
    files = spark.read.text(pattern, wholetext=True)
    return files.select(
        F.input_file_name().alias("path"), F.col("value").alias("json"), F.lit(default_evaluation).alias("default_evaluation")
    )
