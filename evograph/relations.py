"""The named relations that the operators read, cleaned of repeated and late rows, and column helpers.

Every relation has an explicit column contract. Repeated ids are resolved the same way everywhere: of a node the
row with the highest ord counts; of edges, commits and commit files the smallest value of each column, so that
the result doesn't depend on the order of rows. Times are microseconds since 1970 (``at_us``), which no session
time zone touches.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import table

#: Time "now" of all operators, unless another is given: 2025-07-01T00:00:00Z.
AS_OF_US = 1_751_328_000_000_000
DAY_US = 86_400_000_000

NODE_COLUMNS = (
    "id node_type name file_path line_start line_end exported complexity modification_count last_modified contributors documentation language line_count import_count export_count parameters return_type"
    " is_async is_generator is_abstract extends_name implements_names member_count ord"
).split()

SOURCE = r"\.(?:ts|tsx|js|jsx)$"


class Relations:
    """Lazy relations of a data directory. All attributes are DataFrames; nothing is computed before it is used."""

    def __init__(self, spark: SparkSession, path: str, as_of_us: int = AS_OF_US):
        self.spark, self.path, self.as_of_us = spark, path, as_of_us

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    def _latest(self, where: str | None = None) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.col("ord").desc_nulls_last(), F.col("ingested_at").desc_nulls_last())
        columns = [c for c in NODE_COLUMNS if c != "last_modified"]
        known = self.raw("nodes").select(*NODE_COLUMNS, "ingested_at")  # whatever else the table holds can't clash
        if where:
            known = known.where(where)
        return known.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*columns, F.unix_micros("last_modified").alias("modified_us"))

    @cached_property
    def nodes(self) -> DataFrame:
        """One row per id, with modified_us instead of the timestamp."""
        return self._latest()

    @cached_property
    def files(self) -> DataFrame:
        """The file nodes. A re-scan doesn't change an id's type, so the filter goes before the window and into the scan."""
        return self._latest("node_type = 'file'")

    @cached_property
    def symbols(self) -> DataFrame:
        return self._latest("node_type <> 'file'")

    @cached_property
    def edges(self) -> DataFrame:
        """(id, source_id, target_id, edge_type, weight, symbols, is_type_only), one row per id."""
        return self.raw("edges").groupBy("id").agg(*[F.min(c).alias(c) for c in ("source_id", "target_id", "edge_type", "weight", "symbols", "is_type_only")])

    @cached_property
    def imports(self) -> DataFrame:
        """(src, dst) of import edges, one row per edge."""
        return self.edges.where("edge_type = 'imports'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "id", "symbols", "weight")

    @cached_property
    def file_imports(self) -> DataFrame:
        """(src, dst) distinct import pairs between known files; dangling ends are dropped."""
        known = self.files.select("id")
        e = self.imports.select("src", "dst").distinct()
        return e.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")

    @cached_property
    def commits(self) -> DataFrame:
        """(hash, repo, at_us, author_name, author_email, message, refs, author); author is the lower-case mail, else the name."""
        c = (
            self.raw("commits")
            .groupBy("hash")
            .agg(F.min("repo").alias("repo"), F.min(F.unix_micros("committed_at")).alias("at_us"), *[F.min(x).alias(x) for x in ("author_name", "author_email", "message", "refs")])
        )
        return c.withColumn("author", F.lower(F.coalesce("author_email", "author_name")))

    @cached_property
    def commit_files(self) -> DataFrame:
        """(hash, file_path, added, removed); missing counts (binary files) are 0.

        Laid out by hash, so that the join with the commits needs no second shuffle of the largest table; rows
        are rarely repeated, so combining them before this shuffle would save nothing.
        """
        return self.raw("commit_files").select("hash", "file_path", "added", "removed").repartition("hash").groupBy("hash", "file_path").agg(F.coalesce(F.max("added"), F.lit(0)).alias("added"), F.coalesce(F.max("removed"), F.lit(0)).alias("removed"))

    @cached_property
    def changes(self) -> DataFrame:
        """Commit files with their commit: hash, file_path, added, removed, repo, at_us, author, message."""
        return self.commit_files.join(self.commits.select("hash", "repo", "at_us", "author", "message"), "hash")


#: The same relations as common table expressions of the SQL that checks the operators.
CTE = """
nodes_ AS (SELECT * EXCLUDE (rn_, last_modified), epoch_us(last_modified) AS modified_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC NULLS LAST, ingested_at DESC NULLS LAST) AS rn_ FROM nodes) WHERE rn_ = 1),
files_ AS (SELECT * FROM nodes_ WHERE node_type = 'file'),
symbols_ AS (SELECT * FROM nodes_ WHERE node_type <> 'file'),
edges_ AS (SELECT id, min(source_id) AS source_id, min(target_id) AS target_id, min(edge_type) AS edge_type, min(weight) AS weight, min(symbols) AS symbols FROM edges GROUP BY id),
imports_ AS (SELECT source_id AS src, target_id AS dst, id, symbols, weight FROM edges_ WHERE edge_type = 'imports'),
file_imports_ AS (SELECT DISTINCT src, dst FROM imports_ WHERE src IN (SELECT id FROM files_) AND dst IN (SELECT id FROM files_)),
commits_ AS (SELECT *, lower(coalesce(author_email, author_name)) AS author FROM (SELECT hash, min(repo) AS repo, min(epoch_us(committed_at)) AS at_us, min(author_name) AS author_name, min(author_email) AS author_email, min(message) AS message, min(refs) AS refs FROM commits GROUP BY hash)),
commit_files_ AS (SELECT hash, file_path, coalesce(max(added), 0) AS added, coalesce(max(removed), 0) AS removed FROM commit_files GROUP BY hash, file_path),
changes_ AS (SELECT f.*, c.repo, c.at_us, c.author, c.message FROM commit_files_ f JOIN commits_ c USING (hash))
""".strip()


def sql(body: str) -> str:
    """A checking query over the relations; body may begin with further common table expressions (", x AS (...)")."""
    body = body.strip()
    return f"WITH {CTE}\n{body}"


# ---- column helpers, and their SQL ----


def js_round(x: Column) -> Column:
    """floor(x + 0.5), also for negative numbers; a BIGINT."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def r2(x: Column, digits: int = 2) -> Column:
    """Rounded half up to digits, as a DOUBLE."""
    return F.floor(x * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def step(x: Column, bounds: list[tuple[float, float]], other: float) -> Column:
    """The value of the first bound that x doesn't exceed."""
    c = F.when(x <= bounds[0][0], F.lit(bounds[0][1]))
    for b, v in bounds[1:]:
        c = c.when(x <= b, F.lit(v))
    return c.otherwise(F.lit(other))


def step_sql(x: str, bounds: list[tuple[float, float]], other: float) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {b} THEN {v}" for b, v in bounds) + f" ELSE {other} END"


def n(x: Column | str = "*") -> Column:
    """count as BIGINT."""
    return F.count(x)


def day_of(us: Column | str) -> Column:
    """Days since 1970, in UTC."""
    return F.floor((F.col(us) if isinstance(us, str) else us) / F.lit(DAY_US)).cast("bigint")


def path_dir(path: Column | str) -> Column:
    """Directory of a path, '.' at the root."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


DIR_SQL = r"CASE WHEN instr({0}, '/') > 0 THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"


def area_of(path: Column | str) -> Column:
    """Area of a path below its repository and package: root, src/x, or the first folder."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    rest = F.slice(parts, 4, 100)
    return F.when(F.size(rest) <= 1, F.lit("root")).when((rest[0] == "src") & (F.size(rest) > 2), F.concat(F.lit("src/"), rest[1])).otherwise(rest[0])


AREA_SQL = "CASE WHEN len(string_split({0}, '/')) <= 4 THEN 'root' WHEN string_split({0}, '/')[4] = 'src' AND len(string_split({0}, '/')) > 5 THEN 'src/' || string_split({0}, '/')[5] ELSE string_split({0}, '/')[4] END"
