"""G1: from a source tree and its history to a code graph: scan, nodes, edges, enrichment, metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, number_rows
from ..sources import store, trees


@dataclass
class Graph:
    """nodes and edges in the columns of the relations, metadata in one row, errors of files that don't parse."""

    nodes: DataFrame
    edges: DataFrame
    metadata: DataFrame
    errors: DataFrame

    def save(self, path: str) -> None:
        """Nodes, edges and metadata as Parquet below a path; what is there is replaced."""
        store.save_graph(self.nodes, self.edges, path)
        self.metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def import_targets(scanned: DataFrame) -> DataFrame:
    """(file_path, pos, target, symbols, is_default, is_namespace, is_type_only): the imports of relative modules with the paths they mean."""
    i = scanned.select("file_path", F.posexplode("imports").alias("pos", "i")).where(F.col("i.module").startswith(".") | F.col("i.module").startswith("/"))
    return i.select("file_path", "pos", trees.resolve(F.col("file_path"), F.col("i.module")).alias("target"), "i.symbols", "i.is_default", "i.is_namespace", "i.is_type_only")


def file_histories(changes: DataFrame) -> DataFrame:
    """(file_path, modification_count, modified_us, contributors): commits of a file, the newest, and who made them.

    changes: file_path, hash, at_us, author_name. Contributors come by falling number of commits, then by name.
    """
    who = changes.groupBy("file_path", "author_name").agg(F.countDistinct("hash").alias("k"), F.max("at_us").alias("at_us"))
    return who.groupBy("file_path").agg(
        F.sum("k").alias("modification_count"),
        F.max("at_us").alias("modified_us"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("author_name").isNotNull(), F.struct((-F.col("k")).alias("k"), F.col("author_name").alias("name"))))), lambda x: x["name"]).alias("contributors"),
    )


def build_graph(files: DataFrame, changes: DataFrame | None = None, scanned_us: int | None = None) -> Graph:
    """G1: the graph of a table of files (file_path, content).

    Every file is a node and so is every symbol; of symbols with one id the last of the text counts. A contains edge
    leads from a file to each of its symbols, an import edge to the path that each relative import means, whether such
    a file exists or not; edges are numbered from 0 in the order of paths. The import count of a file is that of its distinct targets, or of its
    import declarations if none is relative. With a history (file_path, hash, at_us, author_name) the
    file nodes get their counts of changes, newest change and contributors. Files with syntax errors yield what can be read of them
    and a row of errors. An empty table gives an empty graph with a row of metadata. The scan runs when this is called.
    """
    scanned = cut(trees.scan(files))
    symbols = scanned.select(F.posexplode("symbols").alias("pos", "s")).select("pos", "s.*")
    targets = import_targets(scanned)
    deps = targets.groupBy("file_path").agg(F.countDistinct("target").alias("targets"))
    complexity = F.aggregate("symbols", F.lit(0), lambda a, x: a + F.coalesce(x["complexity"], F.lit(0)))
    own = scanned.select(
        F.col("file_path").alias("id"), F.lit("file").alias("node_type"), F.element_at(F.split("file_path", "/"), -1).alias("name"), "file_path", F.lit(1).alias("line_start"), F.col("line_count").alias("line_end"),
        F.lit(False).alias("exported"), complexity.alias("complexity"), trees.language_of(F.col("file_path")).alias("language"), "line_count", F.size("imports").alias("imports"),
        F.size(F.array_distinct(F.transform("exports", lambda x: x["name"]))).alias("export_count"),
    )
    own = own.join(deps, "file_path", "left").withColumn("import_count", F.coalesce(F.col("targets").cast("int"), "imports")).drop("targets", "imports")
    if changes is not None:
        own = own.join(file_histories(changes), "file_path", "left")
    last = symbols.groupBy("id").agg(F.max_by(F.struct(*[c for c in symbols.columns if c not in ("id", "pos")]), "pos").alias("s")).select("id", "s.*")
    nodes = own.unionByName(last, allowMissingColumns=True)
    contains = number_rows(symbols.select("file_path", "pos", F.col("id").alias("target_id")), "k", "file_path", "pos").select(
        F.concat(F.lit("contains-"), F.col("k").cast("string")).alias("id"), F.col("file_path").alias("source_id"), "target_id", F.lit("contains").alias("edge_type")
    )
    imports = number_rows(targets, "k", "file_path", "pos").select(
        F.concat(F.lit("import-"), F.col("k").cast("string")).alias("id"), F.col("file_path").alias("source_id"), F.col("target").alias("target_id"), F.lit("imports").alias("edge_type"), "symbols", "is_default", "is_namespace", "is_type_only",
    )
    edges = contains.unionByName(imports, allowMissingColumns=True)
    by_language = F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files"))))
    metadata = (
        own.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))
        .agg(F.coalesce(F.sum("files"), F.lit(0)).alias("file_count"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), by_language.alias("languages"))
        .withColumn("scanned_us", F.lit(scanned_us).cast("long"))
    )
    errors = scanned.where("error IS NOT NULL").select(F.col("file_path").alias("file"), "error")
    return Graph(nodes, edges, metadata, errors)


def build_tree(spark: SparkSession, root: str, changes: DataFrame | None = None, scanned_us: int | None = None) -> Graph:
    """G1 over a folder: the files that a scan takes in, read, and their graph."""
    return build_graph(trees.read_tree(spark, root), changes, scanned_us)
