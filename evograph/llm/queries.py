"""The pN_ queries: every operator of this subpackage over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import docs, handwritten, leaks, names, packing, quality, syntax, vectors


def p1_documented(spark: SparkSession, d: str) -> DataFrame:
    """Every documented function, with code where its file has an island for it."""
    return docs.documented_functions(table(spark, d, "nodes"), table(spark, d, "source_files"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_documented(spark, d).select("id")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of code and description: a function without an island is none."""
    return p1_documented(spark, d).where("code IS NOT NULL")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "source_files")).select("file_id")


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """With the line count and complexity that the scan recorded for the file."""
    nodes = table(spark, d, "nodes").where("node_type = 'file'")
    scanned = nodes.groupBy("file_path").agg(F.max("line_count").alias("line_count"), F.max("complexity").alias("complexity"))
    return handwritten.not_handwritten(table(spark, d, "source_files")).join(scanned, "file_path", "left")


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_classes(names.expert_entities(table(spark, d, "experts"), table(spark, d, "commits"), table(spark, d, "nodes")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_pairs(cut(names.expert_entities(table(spark, d, "experts"), table(spark, d, "commits"), table(spark, d, "nodes"))))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbours(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(p4_neighbours(spark, d), 0.85)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_errors(table(spark, d, "source_files")).where("evidence <> 'depth'").select("file_id").distinct()


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_errors(table(spark, d, "source_files"))


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many errors were told by summaries, by local grammars, by names of several runs, and by a parse of the whole."""
    return syntax.syntax_errors(table(spark, d, "source_files")).groupBy("ext", "evidence").agg(F.count("*").alias("files"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_rates(table(spark, d, "source_files"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(p6_containers(spark, d))


#: Containers in which all three capacities bind: many short texts, or a few long ones, fill them before their tokens do.
TIGHT = packing.Container(documents=16, attention=0.25)


def p6_tight(spark: SparkSession, d: str) -> DataFrame:
    """Packing under tokens, documents and attention cost that bind."""
    return packing.pack(table(spark, d, "documents"), TIGHT)


def p6_tight_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(p6_tight(spark, d), TIGHT)


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, how widely and at most how much."""
    return p7_leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("held").alias("most_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_statistics(spark, d).where("not_prose").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    """None of these operators has an SQL form; tests hold them against brute force."""
    return {}
