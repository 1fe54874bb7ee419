"""Stores: graphs, snapshots and search indexes on disk, staleness, result envelopes and the registry of analyses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("id", T.StringType()), ("type", T.StringType()), ("name", T.StringType()), ("filePath", T.StringType()), ("lineStart", T.IntegerType()), ("lineEnd", T.IntegerType()), ("exported", T.BooleanType()),
        ("complexity", T.IntegerType()), ("modificationCount", T.IntegerType()), ("lastModified", T.StringType()), ("contributors", T.ArrayType(T.StringType())), ("documentation", T.StringType()),
        ("language", T.StringType()), ("lineCount", T.IntegerType()), ("parameters", T.ArrayType(T.StringType())), ("returnType", T.StringType()),
    )]
)
EDGE = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("source", T.StringType()), ("target", T.StringType()), ("type", T.StringType()), ("weight", T.DoubleType()))])
GRAPH = T.StructType([T.StructField("version", T.StringType()), T.StructField("nodes", T.MapType(T.StringType(), NODE)), T.StructField("edges", T.ArrayType(EDGE))])


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graphs saved as JSON documents; a document that breaks the schema is an error."""
    g = spark.read.schema(GRAPH).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return g.select(F.explode(F.map_values("nodes")).alias("n")).select("n.*"), g.select(F.explode("edges").alias("e")).select("e.*")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet; an existing store is replaced."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, summary: bool = False) -> None:
    """Rows as JSON lines, or counts only."""
    if summary:
        nodes.groupBy("type").count().write.mode("overwrite").json(path)
        return
    nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("row")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("row"))).write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def graph_exists(spark: SparkSession, path: str) -> bool:
    """S14."""
    fs, p = _fs(spark, f"{path}/nodes")
    return fs.exists(p)


def delete_graph(spark: SparkSession, path: str) -> None:
    """S15."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def is_stale(files: DataFrame, scanned_us: int) -> DataFrame:
    """One row: whether any file (modified_us) is newer than the scan or the index."""
    return files.agg(F.coalesce(F.max("modified_us") > F.lit(scanned_us), F.lit(False)).alias("stale"))


# ---- snapshots ----


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    """Append rows with a column day; one folder a day, so that ranges read only theirs."""
    snapshot.write.mode("append").partitionBy("day").parquet(path)


def load_snapshots(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Snapshots, both ends of the range included; the filter prunes folders."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("day") >= first)
    if last is not None:
        df = df.where(F.col("day") <= last)
    return df


def latest_snapshots(snapshots: DataFrame, per: str = "repo") -> DataFrame:
    """The newest snapshot of each group; of several of a day any one of its greatest row."""
    rest = [c for c in snapshots.columns if c != per]
    return snapshots.groupBy(per).agg(F.max(F.struct("day", *[c for c in rest if c != "day"])).alias("_s")).select(per, *[F.col(f"_s.{c}").alias(c) for c in rest]).select(*snapshots.columns)


def snapshot_by_id(snapshots: DataFrame, snapshot_id: str) -> DataFrame:
    """The snapshots of a column id that equals the given one."""
    return snapshots.where(F.col("id") == snapshot_id)


def snapshot_count(snapshots: DataFrame) -> int:
    """S16."""
    return snapshots.count()


def clear_snapshots(spark: SparkSession, path: str) -> int:
    """The number of snapshots that were there; the folder is removed."""
    fs, p = _fs(spark, path)
    k = spark.read.parquet(path).count() if fs.exists(p) else 0
    fs.delete(p, True)
    return k


def prune_snapshots(snapshots: DataFrame, most: int = 100) -> DataFrame:
    """The newest snapshots per repository, up to a number."""
    w = Window.partitionBy("repo").orderBy(F.desc("day"))
    return snapshots.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


# ---- search index ----


def save_index(weights: DataFrame, path: str) -> None:
    """Postings as Parquet, clustered by term so that a query reads few row groups."""
    weights.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---- results ----


def envelope(df: DataFrame, command: str, at: datetime, **meta: str) -> DataFrame:
    """Every row as one JSON text: command, timestamp, success, data, meta."""
    m: Column = F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]) if meta else F.lit(None).cast("string")
    return df.select(F.to_json(F.struct(F.lit(command).alias("command"), F.lit(at.isoformat()).alias("timestamp"), F.lit(True).alias("success"), F.struct("*").alias("data"), m.alias("meta"))).alias("json"))


def registry() -> dict[str, str]:
    """Names of all analyses with the first line of what they do."""
    from .. import catalog

    return {k: (getattr(q, "__doc__", None) or k).split("\n")[0] for k, q in catalog.queries().items()}
