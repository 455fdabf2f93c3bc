"""Chart text files: sections, lines, metadata and hit objects.

Everything up to the parsed note is a narrow transformation: a text is cut at
its section headers, then into lines, without a shuffle.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strainframe.functions.casts import truncated_int
from strainframe.session import shuffle_width

# The task function travels with the query; a cluster needs no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the file format.
HEADER_START = r"(?m)(?=^[ \t\f]*\[.*\][ \t\f]*$)"
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
PLAYFIELD_WIDTH = 512
LONG_NOTE_BIT = 128
METADATA_FIELDS = {
    "mode": ("General", "Mode"),
    "circle_size": ("Difficulty", "CircleSize"),
    "hp_drain_rate": ("Difficulty", "HPDrainRate"),
    "overall_difficulty": ("Difficulty", "OverallDifficulty"),
    "approach_rate": ("Difficulty", "ApproachRate"),
}


# A chart file is <id>.<ext> or lies in a folder beatmap_id=<id>.
FILE_ID = r"(?:/beatmap_id=(\d+)/|/(\d+)[^/]*$)"


# How Spark names a folder without a value, and what it escapes in folder names.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    """(beatmap_id, text) a file; bytes that are no UTF-8 become replacement characters, a byte order mark goes.

    A file is one row and at most 2 GB; empty files give no row. Files without an id in their name have a NULL id.
    """
    # Folders of one chart are listed by few tasks, not by a task each.
    with _setting(spark, LISTING, str(4 * shuffle_width(spark))):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = F.coalesce(*[F.regexp_extract("path", FILE_ID, n).try_cast("long") for n in (1, 2)])
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    return files.select(found.alias("beatmap_id"), text.alias("text"))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_charts(charts: DataFrame, path: str) -> None:
    """(beatmap_id, content binary or text) as a file a chart, in a folder of its own.

    The texts are small and the files many, so the charts are dealt over all tasks, however few bytes there are. In a
    folder that all machines mount the tasks write the files themselves: Hadoop's local file system starts a process
    for every file and every folder it makes. Elsewhere Spark's writer does, and each task moves its own files.
    """
    spark = charts.sparkSession
    dealt = charts.select("beatmap_id", F.col("content").cast("string").alias("content"))
    dealt = dealt.repartition(shuffle_width(spark), "beatmap_id")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        writer = dealt.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.partitionBy("beatmap_id").text(path)
        return
    system.delete(place, True)
    system.mkdirs(place)
    folder = unquote(urlsplit(system.makeQualified(place).toUri().toString()).path)
    # Rows of a chart lie together, so a task has one file open.
    rows = dealt.select(F.col("beatmap_id").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    rows.sortWithinPartitions("name").mapInArrow(lambda batches: _written(batches, folder), "files long").agg(F.sum("files")).collect()


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes rows (name, content) sorted by name as a file a name, a line a row; gives the number of files."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    part, files = f"part-{TaskContext.get().partitionId():05d}.txt", 0
    for name, lines in groupby(rows, key=lambda row: row[0]):
        value = re.sub(ESCAPED, lambda found: f"%{ord(found[0]):02X}", name) if name else NO_VALUE
        own = f"{folder}/beatmap_id={value}"
        os.makedirs(own, exist_ok=True)
        # Under a hidden name first: a task that is run again, or twice, leaves whole files.
        with open(hidden := f"{own}/.{part}.{uuid.uuid4().hex}", "wb") as file:
            for _, content in lines:
                file.write((content or b"") + b"\n")
        os.replace(hidden, f"{own}/{part}")
        files += 1
    yield pa.record_batch({"files": pa.array([files], pa.int64())})


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chart_lines(charts: DataFrame) -> DataFrame:
    """(beatmap_id, line_order, section, line) without blanks, comments and headers."""
    text = F.regexp_replace("text", r"^\ufeff", "")
    blocks = charts.select("beatmap_id", F.posexplode(F.split(text, HEADER_START)).alias("block_no", "block"))
    lines = blocks.withColumn("lines", F.transform(F.split("block", LINE_BREAK), stripped))
    first = F.get("lines", F.lit(0))
    header = first.startswith("[") & first.endswith("]")
    lines = lines.withColumn("section", F.when(header, F.substring(first, F.lit(2), F.length(first) - 2)).otherwise(""))
    exploded = lines.select("beatmap_id", "block_no", "section", F.posexplode("lines").alias("line_no", "line"))
    kept = (F.col("line") != "") & ~F.col("line").startswith("//")
    kept = kept & ~(F.col("line").startswith("[") & F.col("line").endswith("]"))
    order = F.call_function("shiftleft", F.col("block_no").cast("long"), F.lit(32)) + F.col("line_no")
    return exploded.filter(kept).select("beatmap_id", order.alias("line_order"), "section", "line")


def chart_metadata(charts: DataFrame) -> DataFrame:
    """Numeric metadata per chart, the last line of a key winning; unusable values are NULL.

    Works inside the row: only the two metadata sections are cut into lines.
    """
    text = F.regexp_replace("text", r"^\ufeff", "")
    title = lambda block: stripped(F.regexp_extract(block, r"^[^\r\n]*", 0))
    blocks = charts.select("beatmap_id", F.split(text, HEADER_START).alias("blocks"))
    sections = sorted({section for section, _ in METADATA_FIELDS.values()})
    usable = lambda line: line.contains(":") & ~line.startswith("//")
    pair = lambda line: F.struct(
        stripped(F.split(line, ":", 2)[0]).alias("key"), stripped(F.split(line, ":", 2)[1]).alias("value")
    )

    def pairs_of(section: str) -> Column:
        own = F.filter("blocks", lambda block: title(block) == f"[{section}]")
        lines = F.flatten(F.transform(own, lambda block: F.transform(F.split(block, LINE_BREAK), stripped)))
        return F.transform(F.filter(lines, usable), pair)

    rows = blocks.select("beatmap_id", *[pairs_of(name).alias(name) for name in sections])

    def value_of(section: str, key: str) -> Column:
        found = F.filter(section, lambda item: item["key"] == key)
        return F.try_element_at(found, F.lit(-1))["value"].try_cast("double")

    values = rows.select("beatmap_id", *[value_of(*place).alias(name) for name, place in METADATA_FIELDS.items()])
    return values.withColumn("keys", F.col("circle_size"))


def hit_objects(lines: DataFrame, keys: int = 4) -> DataFrame:
    """Raw notes; lines with too few parts or unusable numbers are dropped."""
    parts = lines.filter(F.col("section") == "HitObjects").withColumn("p", F.split("line", ","))
    numbers = parts.filter(F.size("p") >= 5).select(
        "beatmap_id",
        F.col("line_order").alias("source_order"),
        truncated_int(F.col("p")[0]).alias("x"),
        truncated_int(F.col("p")[2]).alias("time_ms"),
        F.trim(F.col("p")[3]).try_cast("long").alias("kind"),
        truncated_int(F.substring_index(F.get("p", F.lit(5)), ":", 1)).alias("end_ms"),
    )
    usable = numbers.filter("x is not null and time_ms is not null and kind is not null")
    long_note = F.col("kind").bitwiseAND(F.lit(LONG_NOTE_BIT)) != 0
    held = F.coalesce(F.greatest(F.lit(0), F.col("end_ms") - F.col("time_ms")), F.lit(0))
    column = (F.col("x") * keys / PLAYFIELD_WIDTH).cast("int")
    return usable.select(
        "beatmap_id",
        "source_order",
        "time_ms",
        F.greatest(F.lit(0), F.least(F.lit(keys - 1), column)).alias("col"),
        long_note.cast("int").alias("is_ln"),
        F.when(long_note, held).otherwise(0).cast("long").alias("ln_length_ms"),
    )
