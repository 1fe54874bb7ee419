"""Complexity reports, health scores and snapshots over the symbols and files of the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..relations import DIR_SQL, Relations, js_round, n, path_dir, r2, sql

CATEGORIES = ((5, "low"), (10, "medium"), (20, "high"))


def category(c):
    """low to 5, medium to 10, high to 20, else veryHigh; null stays null."""
    return F.when(c <= 5, "low").when(c <= 10, "medium").when(c <= 20, "high").when(c > 20, "veryHigh")


def categories(r: Relations) -> DataFrame:
    """Category of every symbol with a complexity."""
    return r.symbols.where("complexity IS NOT NULL").select("id", F.col("complexity").cast("bigint").alias("complexity"), category(F.col("complexity")).alias("category"))


def hotspots(r: Relations, limit: int = 10, threshold: int = 10, include_files: bool = False) -> DataFrame:
    """The most complex symbols; null and 0 are no complexity; ties keep the order of insertion (ord, id)."""
    df = r.nodes if include_files else r.symbols
    top = df.where((F.col("complexity") != 0) & (F.col("complexity") >= threshold)).orderBy(F.desc("complexity"), "ord", "id").limit(limit)
    return top.select("id", "name", "file_path", F.col("complexity").cast("bigint").alias("complexity"), category(F.col("complexity")).alias("category"))


def refactoring_targets(r: Relations) -> DataFrame:
    """Up to two suggestions per symbol, by complexity and, apart from it, by length."""
    c, span = F.col("complexity"), F.col("line_end") - F.col("line_start") + 1
    made = F.array(
        F.when(c > 20, F.struct(F.lit("high").alias("priority"), F.lit("complexity").alias("reason"))).when(c > 10, F.struct(F.lit("medium").alias("priority"), F.lit("complexity").alias("reason"))),
        F.when((span > 50) & (c > 5), F.struct(F.lit("medium").alias("priority"), F.lit("length").alias("reason"))),
    )
    return r.symbols.where("complexity <> 0").select("id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("t")).select("id", "t.priority", "t.reason")


def report(r: Relations) -> DataFrame:
    """A1: one row over all symbols with a complexity; zeros where there is none."""
    c = F.col("complexity")
    return r.symbols.where("complexity IS NOT NULL").agg(
        n().alias("symbols"), F.coalesce(r2(F.avg(c)), F.lit(0.0)).alias("average"), F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias("maximum"),
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("total"), F.count_if(c <= 5).alias("low"), F.count_if((c > 5) & (c <= 10)).alias("medium"),
        F.count_if((c > 10) & (c <= 20)).alias("high"), F.count_if(c > 20).alias("very_high"),
    )


def by_directory(r: Relations) -> DataFrame:
    """A2: files with a complexity per directory."""
    return (
        r.files.where("complexity <> 0")
        .groupBy(path_dir("file_path").alias("directory"))
        .agg(n().alias("files"), F.sum("complexity").cast("bigint").alias("total"), r2(F.avg("complexity")).alias("average"))
    )


def health_family(r: Relations) -> DataFrame:
    """H1-H8: the health formulas, each over its own population, as rows (formula, score).

    H1 symbols; H2 all nodes; H3 symbols with penalties; H4 the same over files; H5 the ten worst; H6, H7 gentler
    and defaulted averages; H8 over all nodes, missing complexity as 0. Empty populations give the full score.
    """
    c = F.col("complexity").cast("double")
    sym, fil = F.col("node_type") != "file", F.col("node_type") == "file"
    avg = lambda cond: F.avg(F.when(cond & c.isNotNull(), c))
    top = r.symbols.where("complexity <> 0").orderBy(F.desc("complexity"), "ord", "id").limit(10).agg(F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("worst"))
    one = r.nodes.agg(
        avg(sym).alias("s"), avg(F.lit(True)).alias("a"), F.avg(F.when(fil & (c > 0), c)).alias("f"),
        F.count_if(sym & (c > 15)).alias("s15"), F.count_if(sym & (c > 20)).alias("s20"), F.count_if(fil & (c > 15)).alias("f15"), F.count_if(fil & (c > 20)).alias("f20"),
        F.avg(F.coalesce(c, F.lit(0.0))).alias("z"), F.count_if(sym & (c >= 10)).alias("hot"),
    ).crossJoin(F.broadcast(top))  # fmt: skip  # one row beside one row
    low = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    h = {
        "h1": F.greatest(F.lit(0.0), 100 - 5 * r2(zero(F.col("s")))), "h2": F.greatest(F.lit(0.0), 100 - 5 * r2(zero(F.col("a")))),
        "h3": low(js_round(100 - 3 * zero(F.col("s")) - 2 * F.col("s15") - 5 * F.col("s20")).cast("double")),
        "h4": low(js_round(100 - 3 * zero(F.col("f")) - 2 * F.col("f15") - 5 * F.col("f20")).cast("double")),
        "h5": F.greatest(F.lit(0.0), js_round(100 - 3 * F.col("worst")).cast("double")), "h6": low(100 - 2 * r2(zero(F.col("a")))),
        "h7": low(100 - 5 * F.when(zero(r2(F.col("s"))) == 0, 1.0).otherwise(r2(F.col("s")))),
        "h8": 100 - F.least(F.lit(30.0), 2.0 * F.col("hot")) - F.least(F.lit(20.0), 2 * F.greatest(F.lit(0.0), F.col("z") - 5)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("formula"), r2(v, 4).alias("score")) for k, v in h.items()])
    return one.select(F.explode(rows).alias("x")).select("x.formula", "x.score")


def grade(score):
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def file_grades(r: Relations) -> DataFrame:
    """P20: grade of every file by 100 minus five times its mean symbol complexity."""
    score = F.greatest(F.lit(0.0), 100 - 5 * r2(F.avg("complexity")))
    return r.symbols.where("complexity IS NOT NULL").groupBy("file_path").agg(score.alias("score")).withColumn("grade", grade(F.col("score")))


def compare_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of symbols whose complexity improved, worsened or stayed; null and 0 on either side are left out."""
    b, a = before.select("id", F.col("complexity").alias("old")), after.select("id", F.col("complexity").alias("new"))
    j = b.join(a, "id").where("old <> 0 AND new <> 0")
    return j.agg(F.count_if(F.col("new") < F.col("old")).alias("improved"), F.count_if(F.col("new") > F.col("old")).alias("worsened"), F.count_if(F.col("new") == F.col("old")).alias("unchanged"))


def hotspot_difference(before: DataFrame, after: DataFrame, threshold: int = 15) -> DataFrame:
    """Files that are hotspots in one version only, as (file_path, change)."""
    hot = lambda df: df.where(F.col("complexity") >= threshold).select("file_path").distinct()
    b, a = hot(before), hot(after)
    return a.join(b, "file_path", "left_anti").withColumn("change", F.lit("new")).unionByName(b.join(a, "file_path", "left_anti").withColumn("change", F.lit("resolved")))


def two_versions(r: Relations) -> tuple[DataFrame, DataFrame]:
    """Files as they are, and with a complexity that grew by a third where they were changed more than ten times."""
    now = r.files.select("id", "file_path", "complexity", "modification_count")
    return now, now.withColumn("complexity", F.when(F.col("modification_count") > 10, F.floor(F.col("complexity") * 4 / 3).cast("int")).when(F.col("modification_count") < 2, F.col("complexity") - 1).otherwise(F.col("complexity")))


def branch_verdict(r: Relations) -> DataFrame:
    """Two versions compared: average complexity, health, new and resolved hotspots, and a verdict."""
    before, after = two_versions(r)
    side = lambda df, p: df.where("complexity IS NOT NULL").agg(r2(F.avg("complexity")).alias(f"{p}_average"))
    d = hotspot_difference(before, after).agg(F.count_if(F.col("change") == "new").alias("new_hotspots"), F.count_if(F.col("change") == "resolved").alias("resolved_hotspots"))
    j = side(before, "old").crossJoin(side(after, "new")).crossJoin(d)  # single rows
    health = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 5 * F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))))
    j = j.withColumn("health_change", r2(health("new_average") - health("old_average"))).withColumn("complexity_change", r2(F.col("new_average") - F.col("old_average")))
    return j.withColumn(
        "verdict",
        F.when((F.col("health_change") < -10) | (F.col("new_hotspots") >= 3), "danger")
        .when((F.col("health_change") < -5) | (F.col("new_hotspots") >= 1) | (F.col("complexity_change") > 2), "caution")
        .otherwise("safe"),
    )


def snapshot(r: Relations) -> DataFrame:
    """Metrics and distribution of a health snapshot per repository."""
    c = F.col("complexity").cast("double")
    sym = (F.col("node_type") != "file") & c.isNotNull()
    per = r.nodes.groupBy(F.split("file_path", "/")[0].alias("repo")).agg(
        F.count_if(F.col("node_type") == "file").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("bigint").alias("lines"),
        F.coalesce(r2(F.avg(F.when(sym, c))), F.lit(0.0)).alias("average"), F.coalesce(F.max(F.when(sym, F.col("complexity"))), F.lit(0)).cast("bigint").alias("maximum"),
        F.count_if(sym & (c > 15)).alias("c15"), F.count_if(sym & (c > 20)).alias("c20"),
        F.count_if(sym & (c <= 5)).alias("low"), F.count_if(sym & (c > 5) & (c <= 10)).alias("medium"), F.count_if(sym & (c > 10) & (c <= 20)).alias("high"), F.count_if(sym & (c > 20)).alias("very_high"),
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), js_round(100 - 3 * F.col("average") - 2 * F.col("c15") - 5 * F.col("c20"))))
    return per.withColumn("health", score).drop("c20").withColumnRenamed("c15", "hotspots")


def _q(f, *args, **kw):
    return lambda spark, d: f(Relations(spark, d), *args, **kw)


QUERIES = {
    "pf1_categories": _q(categories), "pf2_hotspots": _q(hotspots), "pf2_hotspots_with_files": _q(hotspots, 20, 10, True), "pf3_refactoring_targets": _q(refactoring_targets),
    "a1_complexity_report": _q(report), "a2_complexity_by_directory": _q(by_directory), "h_health_family": _q(health_family), "pf20_file_grades": _q(file_grades),
    "j8_compare_versions": lambda s, d: compare_versions(*two_versions(Relations(s, d))), "j9_hotspot_difference": lambda s, d: hotspot_difference(*two_versions(Relations(s, d))),
    "pf34_branch_verdict": _q(branch_verdict), "w8_snapshots": _q(snapshot),
}

CAT = "CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'medium' WHEN complexity <= 20 THEN 'high' WHEN complexity > 20 THEN 'veryHigh' END"
VERSIONS = ", before_ AS (SELECT id, file_path, complexity FROM files_), after_ AS (SELECT id, file_path, CASE WHEN modification_count > 10 THEN complexity * 4 // 3 WHEN modification_count < 2 THEN complexity - 1 ELSE complexity END AS complexity FROM files_)"
DIFF = ", hot_b AS (SELECT DISTINCT file_path FROM before_ WHERE complexity >= 15), hot_a AS (SELECT DISTINCT file_path FROM after_ WHERE complexity >= 15), diff_ AS (SELECT file_path, 'new' AS change FROM hot_a WHERE file_path NOT IN (FROM hot_b) UNION ALL SELECT file_path, 'resolved' FROM hot_b WHERE file_path NOT IN (FROM hot_a))"
SQL = {
    "pf1_categories": sql(f"SELECT id, complexity::BIGINT AS complexity, {CAT} AS category FROM symbols_ WHERE complexity IS NOT NULL"),
    "pf2_hotspots": sql(f"SELECT id, name, file_path, complexity::BIGINT AS complexity, {CAT} AS category FROM symbols_ WHERE complexity <> 0 AND complexity >= 10 ORDER BY complexity DESC, ord, id LIMIT 10"),
    "pf2_hotspots_with_files": sql(f"SELECT id, name, file_path, complexity::BIGINT AS complexity, {CAT} AS category FROM nodes_ WHERE complexity <> 0 AND complexity >= 10 ORDER BY complexity DESC, ord, id LIMIT 20"),
    "pf3_refactoring_targets": sql("""SELECT id, CASE WHEN complexity > 20 THEN 'high' ELSE 'medium' END AS priority, 'complexity' AS reason FROM symbols_ WHERE complexity > 10
        UNION ALL SELECT id, 'medium', 'length' FROM symbols_ WHERE line_end - line_start + 1 > 50 AND complexity > 5"""),
    "a1_complexity_report": sql("""SELECT count(*) AS symbols, coalesce(floor(avg(complexity) * 100 + 0.5) / 100, 0) AS average, coalesce(max(complexity), 0)::BIGINT AS maximum, coalesce(sum(complexity), 0)::BIGINT AS total,
        count(*) FILTER (complexity <= 5) AS low, count(*) FILTER (complexity > 5 AND complexity <= 10) AS medium, count(*) FILTER (complexity > 10 AND complexity <= 20) AS high, count(*) FILTER (complexity > 20) AS very_high
        FROM symbols_ WHERE complexity IS NOT NULL"""),
    "a2_complexity_by_directory": sql(f"SELECT {DIR_SQL.format('file_path')} AS directory, count(*) AS files, sum(complexity)::BIGINT AS total, floor(avg(complexity) * 100 + 0.5) / 100 AS average FROM files_ WHERE complexity <> 0 GROUP BY 1"),
    "h_health_family": sql("""
        , s AS (SELECT avg(complexity)::DOUBLE AS v, count(*) FILTER (complexity > 15) AS c15, count(*) FILTER (complexity > 20) AS c20, count(*) FILTER (complexity >= 10) AS hot FROM symbols_),
        a AS (SELECT avg(complexity)::DOUBLE AS v, avg(coalesce(complexity, 0))::DOUBLE AS z FROM nodes_),
        f AS (SELECT avg(complexity) FILTER (complexity > 0) AS v, count(*) FILTER (complexity > 15) AS c15, count(*) FILTER (complexity > 20) AS c20 FROM files_),
        w AS (SELECT avg(complexity) AS v FROM (SELECT complexity FROM symbols_ WHERE complexity <> 0 ORDER BY complexity DESC LIMIT 10)),
        h AS (SELECT 'h1' AS formula, greatest(0.0, 100 - 5 * (floor(v * 100 + 0.5) / 100)) AS score FROM s
        UNION ALL SELECT 'h2', greatest(0.0, 100 - 5 * (floor(v * 100 + 0.5) / 100)) FROM a
        UNION ALL SELECT 'h3', greatest(0.0, least(100.0, floor(100 - 3 * v - 2 * c15 - 5 * c20 + 0.5))) FROM s
        UNION ALL SELECT 'h4', greatest(0.0, least(100.0, floor(100 - 3 * v - 2 * c15 - 5 * c20 + 0.5))) FROM f
        UNION ALL SELECT 'h5', greatest(0.0, floor(100 - 3 * v + 0.5)) FROM w
        UNION ALL SELECT 'h6', greatest(0.0, least(100.0, 100 - 2 * (floor(v * 100 + 0.5) / 100))) FROM a
        UNION ALL SELECT 'h7', greatest(0.0, least(100.0, 100 - 5 * (floor(v * 100 + 0.5) / 100))) FROM s
        UNION ALL SELECT 'h8', 100 - least(30, 2 * s.hot) - least(20.0, 2 * greatest(0.0, a.z - 5)) FROM s, a)
        SELECT formula, (floor(score * 10000 + 0.5) / 10000)::DOUBLE AS score FROM h"""),
    "pf20_file_grades": sql("""SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade
        FROM (SELECT file_path, greatest(0.0::DOUBLE, 100 - 5 * (floor(avg(complexity) * 100 + 0.5) / 100)) AS score FROM symbols_ WHERE complexity IS NOT NULL GROUP BY 1)"""),
    "j8_compare_versions": sql(VERSIONS + " SELECT count(*) FILTER (a.complexity < b.complexity) AS improved, count(*) FILTER (a.complexity > b.complexity) AS worsened, count(*) FILTER (a.complexity = b.complexity) AS unchanged FROM before_ b JOIN after_ a USING (id) WHERE b.complexity <> 0 AND a.complexity <> 0"),
    "j9_hotspot_difference": sql(VERSIONS + DIFF + " SELECT * FROM diff_"),
    "pf34_branch_verdict": sql(VERSIONS + DIFF + """, o AS (SELECT floor(avg(complexity) * 100 + 0.5) / 100 AS old_average FROM before_), w AS (SELECT floor(avg(complexity) * 100 + 0.5) / 100 AS new_average FROM after_),
        x AS (SELECT *, (SELECT count(*) FROM diff_ WHERE change = 'new') AS new_hotspots, (SELECT count(*) FROM diff_ WHERE change = 'resolved') AS resolved_hotspots,
            floor((greatest(0.0, least(100.0, 100 - 5 * new_average)) - greatest(0.0, least(100.0, 100 - 5 * old_average))) * 100 + 0.5) / 100 AS health_change, floor((new_average - old_average) * 100 + 0.5) / 100 AS complexity_change FROM o, w)
        SELECT *, CASE WHEN health_change < -10 OR new_hotspots >= 3 THEN 'danger' WHEN health_change < -5 OR new_hotspots >= 1 OR complexity_change > 2 THEN 'caution' ELSE 'safe' END AS verdict FROM x"""),
    "w8_snapshots": sql("""SELECT repo, files, lines, average, maximum, hotspots, low, medium, high, very_high, greatest(0, least(100, floor(100 - 3 * average - 2 * hotspots - 5 * c20 + 0.5)))::BIGINT AS health FROM (
        SELECT split_part(file_path, '/', 1) AS repo, count(*) FILTER (node_type = 'file') AS files, coalesce(sum(line_count), 0)::BIGINT AS lines, coalesce(floor(avg(complexity) FILTER (node_type <> 'file') * 100 + 0.5) / 100, 0) AS average,
        coalesce(max(complexity) FILTER (node_type <> 'file'), 0)::BIGINT AS maximum, count(*) FILTER (node_type <> 'file' AND complexity > 15) AS hotspots, count(*) FILTER (node_type <> 'file' AND complexity > 20) AS c20,
        count(*) FILTER (node_type <> 'file' AND complexity <= 5) AS low, count(*) FILTER (node_type <> 'file' AND complexity > 5 AND complexity <= 10) AS medium,
        count(*) FILTER (node_type <> 'file' AND complexity > 10 AND complexity <= 20) AS high, count(*) FILTER (node_type <> 'file' AND complexity > 20) AS very_high FROM nodes_ GROUP BY 1)"""),
}
