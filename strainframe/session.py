"""Session settings and the checkpoint folder every lineage cut goes to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_folders: list[tempfile.TemporaryDirectory] = []


def build_session(app: str = "strainframe", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local inputs: keep all cores busy instead of merging partitions up to 1 MB.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; make one only for a local master.

    On a cluster the folder has to be shared by all executors, so a missing
    setting is an error there instead of a silent machine-local fallback.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the whole cluster.")
    folder = tempfile.TemporaryDirectory(prefix="strainframe-checkpoint-", ignore_cleanup_errors=True)
    _local_folders.append(folder)  # removed when the process ends
    context.setCheckpointDir(folder.name)


def run_folder(spark: SparkSession) -> str:
    """The one sub-folder that holds all tables of this application's run."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    """A new path in the run's folder."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def remove_run_folder(spark: SparkSession) -> None:
    """Delete the tables of this run; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    One pass over the input, columnar, and later stages re-read the files after
    an executor is lost.
    """
    path = scratch_path(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint, for rows whose partitioning the next steps rely on."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
