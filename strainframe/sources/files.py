"""Table files: tolerant CSV in, partitioned Parquet and CSV out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainframe.session import cut_lineage, scratch_path, shuffle_width

MAP_SCHEMA = (
    "beatmap_id long, beatmapset_id string, title string, artist string, mapper string, version string, "
    "length_ms long, bpm double, difficulty_rating double, mode int, circle_size double, keys int, "
    "hp_drain_rate double, overall_difficulty double, approach_rate double"
)
# Training history layout.
HISTORY_COLUMNS = [
    "epoch", "train_loss", "val_loss", "val_mean_mae", "val_mean_pairwise_order_accuracy", "epoch_seconds", "lr",
    "cuda_max_memory_mb",
]


def read_csv(spark: SparkSession, path: str, schema: str | None = None, *, line_breaks: bool = False) -> DataFrame:
    """Header CSV; empty cells are NULL. Without a schema every column is text.

    ``line_breaks`` allows breaks inside quoted cells; such files cannot be split.
    """
    reader = spark.read.option("header", True).option("nullValue", "").option("escape", '"')
    reader = reader.option("multiLine", line_breaks)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_labels(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of a label CSV, and its rejected lines as (line).

    A line with a cell that is not of its type, or with another number of cells, is
    rejected whole; empty cells are NULL. The files are scanned once.
    """
    reader = spark.read.option("header", True).option("nullValue", "").option("escape", '"')
    reader = reader.option("columnNameOfCorruptRecord", "_line").option("enforceSchema", False)
    parsed = cut_lineage(reader.schema(f"{schema}, _line string").csv(path))
    return parsed.filter("_line is null").drop("_line"), parsed.filter("_line is not null").select(F.col("_line").alias("line"))


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_sequences(notes: DataFrame, path: str) -> None:
    """Store notes so that a chart is read from few files and a note limit prunes row groups.

    Range partitioning on (chart, place) splits a long chart over files.
    """
    spread = notes.repartitionByRange("beatmap_id", "note_index")
    spread.sortWithinPartitions("beatmap_id", "note_index").write.mode("overwrite").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bucketed(frame: DataFrame, order: list[str], buckets: int | None = None, key: str = "beatmap_id") -> DataFrame:
    """The rows stored in buckets by key and read back: windows, groups and joins on the key need no exchange.

    Tasks take ranges of (bucket, key, order), so a task writes few buckets and a long
    key is written by several tasks, into several files of its bucket. Tables to be
    joined need the same number of buckets.
    """
    spark = frame.sparkSession
    buckets = buckets or shuffle_width(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    spread = frame.repartitionByRange(bucket, key, *order)
    # An external table: its files lie with the other tables of the run.
    writer = spread.write.bucketBy(buckets, key).sortBy(key, *order).option("path", scratch_path(spark))
    writer.saveAsTable(name)
    return spark.table(name)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    values = ", ".join(f"{name} double" for name in HISTORY_COLUMNS if name != "epoch")
    return spark.read.schema(f"epoch long, {values}, run string").parquet(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Add (run, epoch, ...) rows to a history table partitioned by run.

    An epoch that is already there is replaced, so an append that is repeated, or
    whose tasks are, leaves each epoch of a run once. Of rows with the same run and
    epoch in one append the greatest stays, column by column. Columns of the layout
    that the rows lack are NULL, other columns are left out; a blank run counts as
    NULL, rows without an epoch are left out. Only partitions of the runs at hand are
    read and replaced.
    """
    spark = rows.sparkSession
    values = [name for name in HISTORY_COLUMNS if name != "epoch"]
    known = {name.lower() for name in rows.columns}
    cell = lambda name: F.col(name).cast("double") if name in known else F.lit(None).cast("double")
    run = F.when(F.col("run").cast("string") != "", F.col("run").cast("string"))
    new = rows.select(run.alias("run"), F.col("epoch").cast("long").alias("epoch"), *[cell(name).alias(name) for name in values])
    new = cut_lineage(new.filter("epoch is not null").withColumn("_new", F.lit(True)))
    both = new
    if _exists(spark, path):
        runs = new.select(F.col("run").alias("_run")).distinct()
        old = read_history(spark, path).join(runs, F.col("run").eqNullSafe(F.col("_run")), "left_semi")
        both = new.unionByName(old.withColumn("_new", F.lit(False)))
    last = both.groupBy("run", "epoch").agg(F.max(F.struct("_new", *values)).alias("_row"))
    merged = cut_lineage(last.select("run", "epoch", *[F.col("_row")[name].alias(name) for name in values]))
    spread = merged.repartitionByRange("run", "epoch").write.mode("overwrite").partitionBy("run")
    spread.option("partitionOverwriteMode", "dynamic").parquet(path)


def widened_history(old: DataFrame, new: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Older history rows under the current columns, absent values NULL, followed by new rows."""
    names = [*(extra or []), *HISTORY_COLUMNS]
    both = old.unionByName(new, allowMissingColumns=True)
    return both.select([F.col(n) if n in both.columns else F.lit(None).cast("double").alias(n) for n in names])
