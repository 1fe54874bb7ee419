"""Exported version-control texts: logs with line counts, and diffs.

A log is read by records (a header and the lines up to the next one), so that a log of any size is split between
tasks and no header has to be carried from line to line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Begins every header of a log written with --format=%x1e%H|%an|%aI --numstat.
MARK = "\x1e"


def read_numstat(spark: SparkSession, path: str) -> DataFrame:
    """(hash, author, date, file_path, added, removed) of a log's text files; binary files count 0."""
    return parse_numstat(spark.read.option("lineSep", MARK).text(path).withColumnRenamed("value", "record"))


def parse_numstat(records: DataFrame) -> DataFrame:
    """Records (one column record) to rows; records without a header, and other lines, are left out."""
    r = records.select(F.split("record", "\n").alias("l")).withColumn("h", F.split(F.col("l")[0], r"\|")).where(F.size("h") >= 3)
    rows = r.select(F.col("h")[0].alias("hash"), F.col("h")[1].alias("author"), F.col("h")[2].alias("date"), F.explode("l").alias("line")).withColumn("p", F.split("line", "\t")).where(F.size("p") >= 3)
    count = lambda c: F.when(c == "-", 0).otherwise(c.try_cast("int"))
    return rows.select("hash", "author", "date", F.col("p")[2].alias("file_path"), count(F.col("p")[0]).alias("added"), count(F.col("p")[1]).alias("removed")).where("added IS NOT NULL AND removed IS NOT NULL")


def diff_files(numstat: DataFrame, name_status: DataFrame) -> DataFrame:
    """Changed files from two texts of a diff, each with columns change_id and line.

    A renamed file is its new path. Files that the status text doesn't mention are modified; binary files count 0.
    """
    a = numstat.withColumn("p", F.split("line", "\t")).where(F.size("p") >= 3)
    count = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    a = a.select("change_id", F.col("p")[2].alias("file_path"), count(F.col("p")[0]).alias("additions"), count(F.col("p")[1]).alias("deletions"), (F.col("p")[0] == "-").alias("is_binary"))
    b = name_status.withColumn("p", F.split("line", "\t")).where(F.size("p") >= 2)
    kind = F.col("p")[0]
    status = F.when(kind == "A", "added").when(kind == "D", "deleted").when(kind.startswith("R"), "renamed").otherwise("modified")
    b = b.select("change_id", F.element_at("p", -1).alias("file_path"), status.alias("status"))
    return a.join(b, ["change_id", "file_path"], "left").withColumn("status", F.coalesce("status", F.lit("modified")))
