"""Change coupling and the risk of change sets, for all files and all commits at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..relations import SOURCE, Relations, js_round, n, r2, sql, step, step_sql
from .graph import dead_by_name, direct_dependents, indirect_dependents
from .history import _newest, newest, ownership

# ---- coupling ----


def unrelated(a, b):
    """Paths are related within one top folder, unless both lie deeper and the second folders differ."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = (F.size(x) > 1) & (F.size(y) > 1) & (F.get(x, F.lit(0)) == F.get(y, F.lit(0)))
    return F.when(same, F.when((F.size(x) > 2) & (F.size(y) > 2), F.get(x, F.lit(1)) != F.get(y, F.lit(1))).otherwise(False)).otherwise(True)


def small_commits(r: Relations, limit: int = 500, most: int = 20) -> DataFrame:
    """Files of the newest commits of a repository that change 1 to 20 source files; a larger commit ties nothing together."""
    c = newest(r.commits, "repo", limit).select("hash")
    f = r.commit_files.where(F.col("file_path").rlike(SOURCE)).select("hash", "file_path").join(c, "hash", "left_semi")
    ok = f.groupBy("hash").agg(n().alias("k")).where(F.col("k") <= most).select("hash")
    return f.join(ok, "hash", "left_semi")


def coupling(r: Relations, least: int = 30) -> DataFrame:
    """Pairs of files that change together: commits in common over the fewer changes of the two, in percent.

    The self-join is bounded by the commits' size (190 pairs at most). Imports in either direction are expected;
    strong ties without one are suspicious (from 70, in unrelated paths) or hidden (from 50).
    """
    f = small_commits(r)
    total = f.groupBy("file_path").agg(n().alias("k"))
    a, b = f.select("hash", F.col("file_path").alias("a")), f.select("hash", F.col("file_path").alias("b"))
    both = a.join(b, "hash").where("a < b").groupBy("a", "b").agg(n().alias("together"))
    j = both.join(total.select(F.col("file_path").alias("a"), F.col("k").alias("ka")), "a").join(total.select(F.col("file_path").alias("b"), F.col("k").alias("kb")), "b")
    j = j.withColumn("strength", js_round(100.0 * F.col("together") / F.least("ka", "kb"))).where(F.col("strength") >= least)
    imports = r.imports.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("imported", F.lit(True))
    j = j.join(imports, ["a", "b"], "left").withColumn("imported", F.coalesce("imported", F.lit(False)))
    kind = F.when(F.col("imported"), "expected").when((F.col("strength") >= 70) & unrelated("a", "b"), "suspicious").when(F.col("strength") >= 50, "hidden").otherwise("expected")
    return j.select("a", "b", "together", (F.col("ka") + F.col("kb") - F.col("together")).alias("changes"), "strength", "imported", kind.alias("kind"))


def unrelated_pairs(r: Relations) -> DataFrame:
    """C2 over the imports between files: pairs whose paths are unrelated."""
    return r.file_imports.where(unrelated("src", "dst"))


def co_changes(r: Relations, targets: int | None = 20, limit: int = 200, least: float = 0.3) -> DataFrame:
    """For the most changed source files (all if targets is None), the files in at least three tenths of their newest 200 commits."""
    if targets is None:
        of = r.changes.where(F.col("file_path").rlike(SOURCE))
    else:
        top = r.commit_files.where(F.col("file_path").rlike(SOURCE)).groupBy("file_path").agg(n().alias("k")).orderBy(F.desc("k"), "file_path").limit(targets).select("file_path")
        of = r.changes.join(F.broadcast(top), "file_path", "left_semi")
    c = newest(of, "file_path", limit).select(F.col("file_path").alias("target"), "hash")  # of some files
    total = c.groupBy("target").agg(n().alias("commits"))
    o = c.join(r.commit_files.select("hash", "file_path"), "hash").where("file_path <> target").groupBy("target", "file_path").agg(n().alias("together"))
    return o.join(total, "target").withColumn("strength", r2(F.col("together") / F.col("commits"))).where(F.col("strength") >= least).select("target", "file_path", "together", "strength")


def co_changes_all(r: Relations) -> DataFrame:
    """C3/J6 for every changed source file."""
    return co_changes(r, None)


def impact(r: Relations) -> DataFrame:
    """T4: impact of a change to every file, .35 dependents, .25 coupling, .25 complexity, .15 churn, with its level."""
    one = direct_dependents(r).withColumnRenamed("id", "file_path")
    more = indirect_dependents(r).withColumnRenamed("id", "file_path")
    f = small_commits(r)
    total = f.groupBy("file_path").agg(n().alias("k"))
    pairs = f.join(f.select("hash", F.col("file_path").alias("other")), "hash").where("file_path <> other").groupBy("file_path", "other").agg(n().alias("co")).join(total, "file_path")
    pairs = pairs.where(F.col("co") / F.col("k") >= 0.3)
    imports = r.imports.select(F.col("src").alias("file_path"), F.col("dst").alias("other")).union(r.imports.select("dst", "src")).distinct().withColumn("tied", F.lit(True))
    coup = pairs.join(imports, ["file_path", "other"], "left").groupBy("file_path").agg(n().alias("coupled"), F.count_if((F.col("co") / F.col("k") >= 0.5) & F.col("tied").isNull()).alias("hidden"))
    top = r.nodes.groupBy("file_path").agg(F.coalesce(F.max("complexity"), F.lit(0)).alias("c"))
    j = r.files.select("file_path", "modification_count", "contributors").join(one, "file_path", "left").join(more, "file_path", "left").join(coup, "file_path", "left").join(top, "file_path")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    dep = step(F.when(z("dependents") + z("indirect") * 0.3 == 0, -1.0).otherwise(z("dependents") + z("indirect") * 0.3), [(-1, 0), (2, 20), (5, 40), (10, 60), (20, 80)], 100)
    cou = F.least(z("coupled") * 10, F.lit(50)) + F.least(z("hidden") * 20, F.lit(50))
    c = F.col("c")
    com = F.when(c <= 5, c * 4).when(c <= 10, 20 + (c - 5) * 4).when(c <= 15, 40 + (c - 10) * 6).otherwise(F.least(70 + (c - 15) * 3, F.lit(100)))
    chu = js_round(F.least(z("modification_count") / 50.0, F.lit(1.0)) * 50 + F.least(F.coalesce(F.size(F.coalesce("contributors", F.array())), F.lit(0)) / 5.0, F.lit(1.0)) * 50)
    # weights in hundredths, so that the sum is exact
    j = j.select("file_path", z("dependents").alias("direct"), z("indirect").alias("indirect"), js_round((35 * dep + 25 * cou + 25 * com + 15 * chu) / 100.0).alias("score"))
    return j.withColumn("level", F.when(F.col("score") < 25, "low").when(F.col("score") < 50, "medium").when(F.col("score") < 75, "high").otherwise("critical"))


# ---- risk of change sets ----

FILES_STEPS = [(0, 0), (3, 10), (10, 40), (20, 70)]
LINES_STEPS = [(0, 0), (50, 10), (200, 30), (500, 50), (1000, 75)]
COMPLEXITY_STEPS = [(0, 0), (5, 10), (10, 30), (20, 60)]
DEPENDENT_STEPS = [(0, 0), (3, 15), (10, 40), (25, 70)]
TEST = r"\.test\.|\.spec\.|__tests__|^tests?/"


def change_risk(r: Relations) -> DataFrame:
    """K1-K7: every commit as a change set: six factors, the overall risk, its level and number of recommendations.

    Weights: files .15, lines .15, complexity .25, dependents .25, bus factor .1, tests .1. Dependents in the change
    itself don't count; complexity is that of all nodes of the files. A source file is tested if a test file of the
    change has its name in its own, or the other way round.
    """
    cf = r.commit_files
    base = cf.groupBy("hash").agg(n().alias("files"), F.sum(F.col("added") + F.col("removed")).alias("lines"))
    top = r.nodes.groupBy("file_path").agg(F.max("complexity").alias("c"))
    com = cf.join(top, "file_path").groupBy("hash").agg(F.max("c").alias("c"))
    imp = r.file_imports.where("src <> dst").select(F.col("dst").alias("file_path"), "src")
    deps = cf.select("hash", "file_path").join(imp, "file_path").select("hash", "src").distinct()
    deps = deps.join(cf.select("hash", F.col("file_path").alias("src")), ["hash", "src"], "left_anti").groupBy("hash").agg(n().alias("d"))
    owners = r.files.select("file_path", F.size(F.coalesce("contributors", F.array())).alias("k"))
    bus = cf.join(owners, "file_path").groupBy("hash").agg(F.count_if(F.col("k") == 1).alias("one"), F.count_if(F.col("k") == 2).alias("two"))
    low = cf.select("hash", F.lower("file_path").alias("p"))
    is_test = F.col("p").rlike(TEST)
    src = low.where(~is_test & F.col("p").rlike(SOURCE)).select("hash", "p", F.regexp_replace(F.regexp_replace("p", SOURCE, ""), "^src/", "").alias("s"))
    tests = low.where(is_test).select("hash", F.regexp_replace(F.regexp_replace("p", r"\.(?:test|spec)\.(?:ts|tsx|js|jsx)$", ""), r"^(?:test|tests|__tests__)/", "").alias("t"))
    tested = src.join(tests, "hash").where(F.col("s").contains(F.col("t")) | F.col("t").contains(F.col("s"))).select("hash", "p").distinct().withColumn("ok", F.lit(1))
    cover = src.join(tested, ["hash", "p"], "left").groupBy("hash").agg(n().alias("sources"), F.count_if(F.col("ok").isNull()).alias("bare"))
    j = base.join(com, "hash", "left").join(deps, "hash", "left").join(bus, "hash", "left").join(cover, "hash", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    risky = z("one") + z("two")
    ratio = F.try_divide(risky, F.col("files"))
    bare = F.try_divide(z("bare"), z("sources"))
    j = j.select(
        "hash", step(F.col("files"), FILES_STEPS, 100).alias("k1"), step(F.col("lines"), LINES_STEPS, 100).alias("k2"), step(z("c"), COMPLEXITY_STEPS, 90).alias("k3"), step(z("d"), DEPENDENT_STEPS, 100).alias("k4"),
        F.when(risky == 0, 0).otherwise(F.least(F.lit(100), F.when(ratio <= 0.2, 15).when(ratio <= 0.5, 40).otherwise(70) + F.when(z("one") > 0, 15).otherwise(0))).alias("k5"),
        F.when((z("sources") == 0) | (z("bare") == 0), 0).when(bare <= 0.25, 20).when(bare <= 0.5, 40).when(bare <= 0.75, 60).otherwise(80).alias("k6"),
    )
    # weights in hundredths: a sum of integers is the same in any order
    j = j.withColumn("overall", js_round((15 * F.col("k1") + 15 * F.col("k2") + 25 * F.col("k3") + 25 * F.col("k4") + 10 * F.col("k5") + 10 * F.col("k6")) / 100.0))
    level = F.when(F.col("overall") <= 25, "low").when(F.col("overall") <= 50, "medium").when(F.col("overall") <= 75, "high").otherwise("critical")
    marks = [F.col("k1") >= 60, F.col("k2") >= 60, F.col("k3") >= 50, F.col("k4") >= 50, F.col("k5") >= 40, F.col("k6") >= 50]
    advice = sum((m.cast("int") for m in marks[1:]), marks[0].cast("int"))
    return j.select("hash", *[F.col(f"k{i}").cast("bigint").alias(f"k{i}") for i in range(1, 7)], "overall", level.alias("level"), advice.cast("bigint").alias("recommendations"))


# Factors of the risk, from which score on each calls for something, and for what.
ADVICE = (
    ("k1", 60, "split the change"), ("k2", 60, "commit in smaller steps"), ("k3", 50, "have the complex code reviewed again"), ("k4", 50, "test what depends on the files"), ("k5", 40, "review in pairs"), ("k6", 50, "add tests for the files"),
)


def recommendations(r: Relations) -> DataFrame:
    """K7: (hash, ord, recommendation) for every change set, in the order of the factors; one that calls for nothing is safe."""
    k = change_risk(r)
    told = F.filter(F.array(*[F.when(F.col(c) >= least, F.lit(said)) for c, least, said in ADVICE]), lambda x: x.isNotNull())
    told = F.when(F.size(told) == 0, F.array(F.lit("safe as it is"))).otherwise(told)
    return k.select("hash", F.posexplode(told).alias("ord", "recommendation")).select("hash", F.col("ord").cast("bigint").alias("ord"), "recommendation")


def concerns(r: Relations) -> DataFrame:
    """K7: per change set its level and the factor of the highest score, if that is 50 or more; of equal ones the first."""
    names = [("k1", "files"), ("k2", "lines"), ("k3", "complexity"), ("k4", "dependents"), ("k5", "owners"), ("k6", "tests")]
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("score"), F.lit(-i).alias("i"), F.lit(x).alias("name")) for i, (c, x) in enumerate(names)]))
    return change_risk(r).withColumn("b", best).select("hash", "level", F.when(F.col("b.score") >= 50, F.col("b.name")).otherwise("none").alias("concern"))


def largest_files(r: Relations) -> DataFrame:
    """The largest file of every change set; ties go to the first path."""
    w = Window.partitionBy("hash").orderBy(F.desc(F.col("added") + F.col("removed")), "file_path")
    return r.commit_files.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("hash", "file_path", (F.col("added") + F.col("removed")).cast("bigint").alias("lines"))


def find_file(r: Relations, wanted: DataFrame) -> DataFrame:
    """Nodes of wanted paths: the exact path, else the first file in order of insertion whose path ends in it.

    wanted: one column path; an empty one finds nothing. A suffix with a folder meets by its last component, one that may begin inside a file's
    name by each end of that name, so nothing is compared with every file.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    w = wanted.select("path").where("path <> ''").distinct().withColumn("name", name("path"))
    f = r.files.select("id", "file_path", "ord", name("file_path").alias("name"))
    deep = F.col("path").contains("/")
    ends = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr("name", i))
    by_name = w.where(deep).join(f, "name").where(F.col("file_path").endswith(F.col("path")))
    by_end = w.where(~deep).drop("name").join(f.where("name <> ''").withColumn("path", F.explode(ends)), "path")
    hit = by_name.select("path", "id", "file_path", "ord").unionByName(by_end.select("path", "id", "file_path", "ord"))
    best = Window.partitionBy("path").orderBy(F.when(F.col("file_path") == F.col("path"), 0).otherwise(1), F.asc_nulls_last("ord"), "id")
    return hit.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("path", "id")


def reported_files(r: Relations) -> DataFrame:
    """J10 for the paths of build errors, as typed."""
    return find_file(r, r.raw("build_errors").where("file_path IS NOT NULL").select(F.regexp_replace("file_path", "^/?workspace/", "").alias("path")))


def _dependents(r: Relations) -> DataFrame:
    return r.imports.groupBy(F.col("dst").alias("file_path")).agg(n().alias("dependents"))


def predicted_risk(r: Relations) -> DataFrame:
    """Risk of every changed file of the newest commits, 30 and what size, name, complexity and dependents add or take."""
    f = r.commit_files.join(newest(r.commits, "repo", 50).select("hash"), "hash", "left_semi").join(r.files.select("file_path", "complexity"), "file_path", "left").join(_dependents(r), "file_path", "left")
    p, k, d = F.col("file_path"), F.col("added") + F.col("removed"), F.coalesce("dependents", F.lit(0))
    w = lambda cond, v: F.when(cond, v).otherwise(0)
    score = (
        30 + F.when(k > 200, 25).when(k > 50, 10).when(k < 10, -10).otherwise(0) + w(p.contains("config") | p.contains(".env"), 20) + w(p.contains("package.json"), 15)
        + w(p.contains("migration") | p.contains("schema"), 25) + w(p.contains("test") | p.contains("spec"), -15) + w(F.col("complexity") > 15, 15) + F.when(d > 5, 20).when(d > 2, 10).otherwise(0)
    )
    risk = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return f.select("hash", "file_path", risk.cast("bigint").alias("risk"), F.ceil((2 + k / 30.0) * (1 + risk / 100.0)).cast("bigint").alias("minutes"))


def prediction(r: Relations) -> DataFrame:
    """Per commit the largest and mean risk, minutes of review, and how many reviewers it needs."""
    g = predicted_risk(r).groupBy("hash").agg(F.max("risk").alias("top"), F.avg("risk").alias("mean"), F.sum("minutes").cast("bigint").alias("minutes"))
    level = F.when((F.col("top") >= 70) | (F.col("mean") >= 50), "high").when((F.col("top") >= 50) | (F.col("mean") >= 35), "medium").otherwise("low")
    return g.select("hash", "top", r2(F.col("mean")).alias("mean"), "minutes", level.alias("level"), F.when(level == "high", 3).when(level == "medium", 2).otherwise(1).cast("bigint").alias("reviewers"))


def precommit(r: Relations) -> DataFrame:
    """Per commit the highest risk (0 low, 1 medium, 2 high) of its files by size, name, complexity and dependents, and a status."""
    f = r.commit_files.join(r.files.select("file_path", "complexity"), "file_path", "left").join(_dependents(r), "file_path", "left")
    p, k = F.col("file_path"), F.col("added") + F.col("removed")
    level = F.greatest(
        F.when(k > 200, 2).when(k > 50, 1).otherwise(0), F.when(p.contains("config") | p.endswith(".env") | p.contains("migration") | p.contains("schema"), 2).when(p.contains("package.json"), 1).otherwise(0),
        F.when(F.col("complexity") > 20, 2).otherwise(0), F.when(F.coalesce("dependents", F.lit(0)) > 5, 1).otherwise(0),
    )
    g = f.groupBy("hash").agg(F.max(level).cast("bigint").alias("risk"), F.count_if(level == 2).alias("high_files"))
    return g.withColumn("status", F.when(F.col("risk") == 2, F.when(F.col("high_files") >= 3, "fail").otherwise("warn")).when(F.col("risk") == 1, "warn").otherwise("pass"))


def review_risk(r: Relations) -> DataFrame:
    """Points of every changed file: sensitive names 3, manifests 2, size 1 to 3, tests one less; levels at 2, 4 and 6."""
    p, k = F.col("file_path"), F.col("added") + F.col("removed")
    points = F.when(p.rlike("auth|payment|security"), 3).otherwise(0) + F.when(p.rlike(r"package\.json|tsconfig\.json|\.env"), 2).otherwise(0) + F.when(k > 500, 3).when(k > 200, 2).when(k > 50, 1).otherwise(0)
    points = F.when(p.contains("test") | p.contains("spec"), F.greatest(F.lit(0), points - 1)).otherwise(points)
    level = F.when(points >= 6, "critical").when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")
    return r.commit_files.groupBy("hash", level.alias("level")).agg(n().alias("files"))


# ---- fixes ----


def fix_suggestions(r: Relations) -> DataFrame:
    """Suggestions of five kinds (complexity, size, cycles of two, dead exports, single owners), with severities."""
    c = r.symbols.where("complexity >= 10").select("id", F.lit("complexity").alias("kind"), F.when(F.col("complexity") >= 20, "critical").otherwise("warning").alias("severity"))
    s = r.files.where("line_count > 300").select("id", F.lit("size").alias("kind"), F.when(F.col("line_count") > 500, "warning").otherwise("info").alias("severity"))
    e = r.file_imports
    cyc = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").select(F.col("src").alias("id"), F.lit("cycle").alias("kind"), F.lit("warning").alias("severity")).distinct()
    d = dead_by_name(r).select(F.col("file_path").alias("id")).distinct().select("id", F.lit("dead_export").alias("kind"), F.lit("info").alias("severity"))
    o = ownership(r).where("bus_factor = 1").select(F.col("file_path").alias("id"), F.lit("single_owner").alias("kind"), F.lit("warning").alias("severity"))
    return c.unionByName(s).unionByName(cyc).unionByName(d).unionByName(o)


def extractable_blocks(r: Relations, least: int = 10) -> DataFrame:
    """Symbols inside a class that don't overlap a longer one chosen before: greedy, longest first, per class.

    A number of blocks (a tenth of the complexity, 1 to 5) is chosen for each class. The greedy choice goes over
    the members of one class at a time.
    """
    import pandas as pd

    cls = r.symbols.where("node_type = 'class' AND line_end >= line_start").select("file_path", F.col("id").alias("owner"), F.col("line_start").alias("cs"), F.col("line_end").alias("ce"), F.coalesce("complexity", F.lit(0)).alias("cc"))
    m = r.symbols.where("node_type = 'function'").select("file_path", "id", "line_start", "line_end")
    inside = m.join(cls, "file_path").where(f"line_start > cs AND line_end < ce AND line_end - line_start + 1 >= {int(least)}")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        most, taken, out = max(1, min(-(-int(frame.cc.iloc[0]) // 10), 5)), [], []
        for x in frame.assign(length=frame.line_end - frame.line_start).sort_values(["length", "id"], ascending=[False, True]).itertuples():
            if len(out) < most and all(x.line_end < a or x.line_start > b for a, b in taken):
                taken.append((x.line_start, x.line_end))
                out.append((x.owner, x.id))
        return pd.DataFrame(out, columns=["owner", "id"])

    return inside.groupBy("owner").applyInPandas(choose, "owner string, id string")


def symbol_groups(r: Relations) -> DataFrame:
    """Functions by the first pattern that their name fits: getters, setters, handlers, creation, checks, transformation."""
    name = F.element_at(F.split("name", r"\."), -1)
    g = (
        F.when(name.rlike("^(?i)(?:get|fetch|find|load|read)"), "getters").when(name.rlike("^(?i)(?:set|update|write|save)"), "setters").when(name.rlike("^(?i)(?:on|handle)"), "handlers")
        .when(name.rlike("^(?i)(?:create|build|make|init)"), "creation").when(name.rlike("^(?i)(?:is|has|can|check|validate|match)"), "checks").when(name.rlike("^(?i)(?:parse|format|render|merge|split|convert|transform)"), "transformation").otherwise("other")
    )
    return r.symbols.where("node_type = 'function'").groupBy("file_path", g.alias("grp")).agg(n().alias("functions"))


def _q(f, *a, **k):
    return lambda spark, d: f(Relations(spark, d), *a, **k)


QUERIES = {
    "c1_coupling": _q(coupling), "c2_unrelated": _q(unrelated_pairs), "c3_co_changes": _q(co_changes), "c3_co_changes_all": _q(co_changes_all), "t4_impact": _q(impact), "k_risk_batch": _q(change_risk), "k7_recommendations": _q(recommendations), "k7_concerns": _q(concerns), "k2_largest_files": _q(largest_files), "j10_find_file": _q(reported_files),
    "pf11_file_risk": _q(predicted_risk), "pf11_prediction": _q(prediction), "pf12_precommit": _q(precommit), "pf13_review_risk": _q(review_risk), "pf28_fixes": _q(fix_suggestions), "pf29_blocks": _q(extractable_blocks), "pf30_groups": _q(symbol_groups),
}

SRC = r"regexp_matches(file_path, '\.(ts|tsx|js|jsx)$')"
SMALL = f", sc0_ AS (SELECT hash, file_path FROM commit_files_ WHERE {SRC} AND hash IN (SELECT hash FROM {_newest('commits_', 'repo', 500)})), sc_ AS (SELECT * FROM sc0_ WHERE hash IN (SELECT hash FROM sc0_ GROUP BY 1 HAVING count(*) <= 20)), st_ AS (SELECT file_path, count(*) AS k FROM sc_ GROUP BY 1)"


def _unrelated(a: str, b: str) -> str:
    x, y = f"string_split({a}, '/')", f"string_split({b}, '/')"
    return f"CASE WHEN len({x}) > 1 AND len({y}) > 1 AND {x}[1] = {y}[1] THEN CASE WHEN len({x}) > 2 AND len({y}) > 2 THEN {x}[2] <> {y}[2] ELSE false END ELSE true END"


DEP = ", dp_ AS (SELECT dst AS file_path, count(*) AS dependents FROM imports_ GROUP BY 1)"
PRED = DEP + f""", pr_ AS (SELECT hash, file_path, risk, ceil((2 + k / 30.0::DOUBLE) * (1 + risk / 100.0::DOUBLE))::BIGINT AS minutes FROM (SELECT hash, file_path, k, greatest(0, least(100, 30 + CASE WHEN k > 200 THEN 25 WHEN k > 50 THEN 10 WHEN k < 10 THEN -10 ELSE 0 END
+ CASE WHEN file_path LIKE '%config%' OR file_path LIKE '%.env%' THEN 20 ELSE 0 END + CASE WHEN file_path LIKE '%package.json%' THEN 15 ELSE 0 END + CASE WHEN file_path LIKE '%migration%' OR file_path LIKE '%schema%' THEN 25 ELSE 0 END + CASE WHEN file_path LIKE '%test%' OR file_path LIKE '%spec%' THEN -15 ELSE 0 END
+ CASE WHEN complexity > 15 THEN 15 ELSE 0 END + CASE WHEN coalesce(dependents, 0) > 5 THEN 20 WHEN coalesce(dependents, 0) > 2 THEN 10 ELSE 0 END))::BIGINT AS risk FROM (SELECT c.hash, c.file_path, c.added + c.removed AS k, f.complexity, d.dependents FROM commit_files_ c LEFT JOIN files_ f USING (file_path) LEFT JOIN dp_ d USING (file_path) WHERE c.hash IN (SELECT hash FROM {_newest('commits_', 'repo', 50)}))))"""
from .graph import DIRECT, USED  # noqa: E402
from .history import OWN  # noqa: E402

IND = ", ie_ AS (SELECT src, dst FROM file_imports_ WHERE src <> dst), i2_ AS (SELECT DISTINCT a.dst AS id, b.src AS dep FROM ie_ a JOIN ie_ b ON b.dst = a.src), i3_ AS (SELECT DISTINCT id, b.src AS dep FROM (SELECT * FROM i2_ WHERE id <> dep AND (dep, id) NOT IN (SELECT (src, dst) FROM ie_)) x JOIN ie_ b ON b.dst = x.dep), ind_ AS (SELECT id, count(*) AS indirect FROM (SELECT * FROM i2_ UNION SELECT * FROM i3_) WHERE id <> dep AND (dep, id) NOT IN (SELECT (src, dst) FROM ie_) GROUP BY 1)"
SQL = {
    "c1_coupling": sql(SMALL + f""", b AS (SELECT x.file_path AS a, y.file_path AS b, count(*) AS together FROM sc_ x JOIN sc_ y ON x.hash = y.hash AND x.file_path < y.file_path GROUP BY 1, 2),
        j AS (SELECT b.*, p.k AS ka, q.k AS kb, floor(100.0::DOUBLE * together / least(p.k, q.k) + 0.5)::BIGINT AS strength, (b.a, b.b) IN (SELECT (least(src, dst), greatest(src, dst)) FROM imports_) AS imported FROM b JOIN st_ p ON p.file_path = b.a JOIN st_ q ON q.file_path = b.b)
        SELECT a, b, together, ka + kb - together AS changes, strength, imported, CASE WHEN imported THEN 'expected' WHEN strength >= 70 AND {_unrelated('a', 'b')} THEN 'suspicious' WHEN strength >= 50 THEN 'hidden' ELSE 'expected' END AS kind FROM j WHERE strength >= 30"""),
    "c2_unrelated": sql(f"SELECT src, dst FROM file_imports_ WHERE {_unrelated('src', 'dst')}"),
    "c3_co_changes": sql(f""", t AS (SELECT file_path FROM commit_files_ WHERE {SRC} GROUP BY 1 ORDER BY count(*) DESC, file_path LIMIT 20), c AS {_newest('(SELECT * FROM changes_ WHERE file_path IN (FROM t))', 'file_path', 200)}, z AS (SELECT file_path AS target, count(*) AS commits FROM c GROUP BY 1),
        o AS (SELECT c.file_path AS target, f.file_path, count(*) AS together FROM c JOIN commit_files_ f USING (hash) WHERE f.file_path <> c.file_path GROUP BY 1, 2) SELECT target, file_path, together, floor(together::DOUBLE / commits * 100 + 0.5) / 100 AS strength FROM o JOIN z USING (target) WHERE floor(together::DOUBLE / commits * 100 + 0.5) / 100 >= 0.3"""),
    "t4_impact": sql(DIRECT + IND + SMALL + """, pc AS (SELECT x.file_path, y.file_path AS other, count(*) AS co, any_value(k) AS k FROM sc_ x JOIN sc_ y ON x.hash = y.hash AND x.file_path <> y.file_path JOIN st_ s ON s.file_path = x.file_path GROUP BY 1, 2),
        cc AS (SELECT file_path, count(*) AS coupled, count(*) FILTER (co::DOUBLE / k >= 0.5 AND (file_path, other) NOT IN (SELECT (src, dst) FROM imports_) AND (other, file_path) NOT IN (SELECT (src, dst) FROM imports_)) AS hidden FROM pc WHERE co::DOUBLE / k >= 0.3 GROUP BY 1),
        j AS (SELECT f.file_path, coalesce(d.dependents, 0) AS direct, coalesce(i.indirect, 0) AS indirect, coalesce(coupled, 0) AS coupled, coalesce(hidden, 0) AS hidden, coalesce(t.c, 0) AS c, coalesce(f.modification_count, 0) AS m, coalesce(len(f.contributors), 0) AS p FROM files_ f LEFT JOIN direct_ d ON d.id = f.file_path LEFT JOIN ind_ i ON i.id = f.file_path LEFT JOIN cc ON cc.file_path = f.file_path
            LEFT JOIN (SELECT file_path, max(complexity) AS c FROM nodes_ GROUP BY 1) t ON t.file_path = f.file_path),
        s AS (SELECT *, CASE WHEN direct + indirect * 0.3::DOUBLE = 0 THEN 0 WHEN direct + indirect * 0.3::DOUBLE <= 2 THEN 20 WHEN direct + indirect * 0.3::DOUBLE <= 5 THEN 40 WHEN direct + indirect * 0.3::DOUBLE <= 10 THEN 60 WHEN direct + indirect * 0.3::DOUBLE <= 20 THEN 80 ELSE 100 END AS dep, least(coupled * 10, 50) + least(hidden * 20, 50) AS cou,
            CASE WHEN c <= 5 THEN c * 4 WHEN c <= 10 THEN 20 + (c - 5) * 4 WHEN c <= 15 THEN 40 + (c - 10) * 6 ELSE least(70 + (c - 15) * 3, 100) END AS com, floor(least(m / 50.0::DOUBLE, 1.0) * 50 + least(p / 5.0::DOUBLE, 1.0) * 50 + 0.5) AS chu FROM j),
        r AS (SELECT file_path, direct, indirect, floor((35 * dep + 25 * cou + 25 * com + 15 * chu) / 100.0::DOUBLE + 0.5)::BIGINT AS score FROM s)
        SELECT *, CASE WHEN score < 25 THEN 'low' WHEN score < 50 THEN 'medium' WHEN score < 75 THEN 'high' ELSE 'critical' END AS level FROM r"""),
    "k_risk_batch": sql(f""", top AS (SELECT file_path, max(complexity) AS c FROM nodes_ GROUP BY 1), b AS (SELECT hash, count(*) AS files, sum(added + removed) AS lines FROM commit_files_ GROUP BY 1), cx AS (SELECT hash, max(c) AS c FROM commit_files_ JOIN top USING (file_path) GROUP BY 1),
        de AS (SELECT DISTINCT f.hash, i.src FROM commit_files_ f JOIN file_imports_ i ON i.dst = f.file_path AND i.src <> i.dst), dd AS (SELECT hash, count(*) AS d FROM de WHERE (hash, src) NOT IN (SELECT (hash, file_path) FROM commit_files_) GROUP BY 1),
        bu AS (SELECT hash, count(*) FILTER (len(contributors) = 1) AS one, count(*) FILTER (len(contributors) = 2) AS two FROM commit_files_ JOIN files_ USING (file_path) GROUP BY 1),
        lo AS (SELECT hash, lower(file_path) AS p, regexp_matches(lower(file_path), '\\.test\\.|\\.spec\\.|__tests__|^tests?/') AS t FROM commit_files_), sr AS (SELECT hash, p, regexp_replace(regexp_replace(p, '\\.(ts|tsx|js|jsx)$', ''), '^src/', '') AS s FROM lo WHERE NOT t AND regexp_matches(p, '\\.(ts|tsx|js|jsx)$')),
        te AS (SELECT hash, regexp_replace(regexp_replace(p, '\\.(test|spec)\\.(ts|tsx|js|jsx)$', ''), '^(test|tests|__tests__)/', '') AS t FROM lo WHERE t), co AS (SELECT hash, count(*) AS sources, count(*) FILTER (NOT EXISTS (SELECT 1 FROM te WHERE te.hash = sr.hash AND (contains(s, te.t) OR contains(te.t, s)))) AS bare FROM sr GROUP BY 1),
        j AS (SELECT b.hash, files, lines, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(one, 0) AS one, coalesce(one, 0) + coalesce(two, 0) AS risky, coalesce(sources, 0) AS sources, coalesce(bare, 0) AS bare FROM b LEFT JOIN cx USING (hash) LEFT JOIN dd USING (hash) LEFT JOIN bu USING (hash) LEFT JOIN co USING (hash)),
        k AS (SELECT hash, {step_sql('files', FILES_STEPS, 100)} AS k1, {step_sql('lines', LINES_STEPS, 100)} AS k2, {step_sql('c', COMPLEXITY_STEPS, 90)} AS k3, {step_sql('d', DEPENDENT_STEPS, 100)} AS k4,
            CASE WHEN risky = 0 THEN 0 ELSE least(100, CASE WHEN risky::DOUBLE / files <= 0.2 THEN 15 WHEN risky::DOUBLE / files <= 0.5 THEN 40 ELSE 70 END + CASE WHEN one > 0 THEN 15 ELSE 0 END) END AS k5,
            CASE WHEN sources = 0 OR bare = 0 THEN 0 WHEN bare::DOUBLE / sources <= 0.25 THEN 20 WHEN bare::DOUBLE / sources <= 0.5 THEN 40 WHEN bare::DOUBLE / sources <= 0.75 THEN 60 ELSE 80 END AS k6 FROM j),
        o AS (SELECT *, floor((15 * k1 + 15 * k2 + 25 * k3 + 25 * k4 + 10 * k5 + 10 * k6) / 100.0::DOUBLE + 0.5)::BIGINT AS overall FROM k)
        SELECT hash, k1::BIGINT AS k1, k2::BIGINT AS k2, k3::BIGINT AS k3, k4::BIGINT AS k4, k5::BIGINT AS k5, k6::BIGINT AS k6, overall, CASE WHEN overall <= 25 THEN 'low' WHEN overall <= 50 THEN 'medium' WHEN overall <= 75 THEN 'high' ELSE 'critical' END AS level,
        ((k1 >= 60)::INT + (k2 >= 60)::INT + (k3 >= 50)::INT + (k4 >= 50)::INT + (k5 >= 40)::INT + (k6 >= 50)::INT)::BIGINT AS recommendations FROM o"""),
    "k2_largest_files": sql("SELECT hash, file_path, (added + removed)::BIGINT AS lines FROM commit_files_ QUALIFY row_number() OVER (PARTITION BY hash ORDER BY added + removed DESC, file_path) = 1"),
    "j10_find_file": sql(", w AS (SELECT DISTINCT regexp_replace(file_path, '^/?workspace/', '') AS path FROM build_errors WHERE file_path IS NOT NULL) SELECT path, id FROM w JOIN files_ ON path <> '' AND ends_with(file_path, path) QUALIFY row_number() OVER (PARTITION BY path ORDER BY file_path <> path, ord NULLS LAST, id) = 1"),
    "pf11_file_risk": sql(PRED + " SELECT * FROM pr_"),
    "pf11_prediction": sql(PRED + """ SELECT hash, top, floor(mean * 100 + 0.5) / 100 AS mean, minutes, level, CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END::BIGINT AS reviewers FROM (SELECT *, CASE WHEN top >= 70 OR mean >= 50 THEN 'high' WHEN top >= 50 OR mean >= 35 THEN 'medium' ELSE 'low' END AS level
        FROM (SELECT hash, max(risk) AS top, avg(risk) AS mean, sum(minutes)::BIGINT AS minutes FROM pr_ GROUP BY 1))"""),
    "pf12_precommit": sql(DEP + """, l AS (SELECT hash, greatest(CASE WHEN added + removed > 200 THEN 2 WHEN added + removed > 50 THEN 1 ELSE 0 END, CASE WHEN file_path LIKE '%config%' OR file_path LIKE '%.env' OR file_path LIKE '%migration%' OR file_path LIKE '%schema%' THEN 2 WHEN file_path LIKE '%package.json%' THEN 1 ELSE 0 END,
        CASE WHEN complexity > 20 THEN 2 ELSE 0 END, CASE WHEN coalesce(dependents, 0) > 5 THEN 1 ELSE 0 END) AS level FROM commit_files_ LEFT JOIN files_ USING (file_path) LEFT JOIN dp_ USING (file_path))
        SELECT hash, max(level)::BIGINT AS risk, count(*) FILTER (level = 2) AS high_files, CASE WHEN max(level) = 2 THEN CASE WHEN count(*) FILTER (level = 2) >= 3 THEN 'fail' ELSE 'warn' END WHEN max(level) = 1 THEN 'warn' ELSE 'pass' END AS status FROM l GROUP BY 1"""),
    "pf13_review_risk": sql(r""", p AS (SELECT hash, file_path, CASE WHEN regexp_matches(file_path, 'auth|payment|security') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(file_path, 'package\.json|tsconfig\.json|\.env') THEN 2 ELSE 0 END + CASE WHEN added + removed > 500 THEN 3 WHEN added + removed > 200 THEN 2 WHEN added + removed > 50 THEN 1 ELSE 0 END AS x FROM commit_files_),
        q AS (SELECT hash, CASE WHEN file_path LIKE '%test%' OR file_path LIKE '%spec%' THEN greatest(0, x - 1) ELSE x END AS x FROM p) SELECT hash, CASE WHEN x >= 6 THEN 'critical' WHEN x >= 4 THEN 'high' WHEN x >= 2 THEN 'medium' ELSE 'low' END AS level, count(*) AS files FROM q GROUP BY 1, 2"""),
    "pf28_fixes": sql(USED + OWN + """ SELECT id, 'complexity' AS kind, CASE WHEN complexity >= 20 THEN 'critical' ELSE 'warning' END AS severity FROM symbols_ WHERE complexity >= 10
        UNION ALL SELECT id, 'size', CASE WHEN line_count > 500 THEN 'warning' ELSE 'info' END FROM files_ WHERE line_count > 300 UNION ALL SELECT DISTINCT src, 'cycle', 'warning' FROM file_imports_ WHERE (dst, src) IN (SELECT (src, dst) FROM file_imports_)
        UNION ALL SELECT DISTINCT file_path, 'dead_export', 'info' FROM dead_ UNION ALL SELECT file_path, 'single_owner', 'warning' FROM own_ WHERE bus_factor = 1"""),
    "pf30_groups": sql("""SELECT file_path, grp, count(*) AS functions FROM (SELECT file_path, CASE WHEN regexp_matches(nm, '^(get|fetch|find|load|read)') THEN 'getters' WHEN regexp_matches(nm, '^(set|update|write|save)') THEN 'setters' WHEN regexp_matches(nm, '^(on|handle)') THEN 'handlers'
        WHEN regexp_matches(nm, '^(create|build|make|init)') THEN 'creation' WHEN regexp_matches(nm, '^(is|has|can|check|validate|match)') THEN 'checks' WHEN regexp_matches(nm, '^(parse|format|render|merge|split|convert|transform)') THEN 'transformation' ELSE 'other' END AS grp
        FROM (SELECT file_path, lower(split_part(name, '.', -1)) AS nm FROM symbols_ WHERE node_type = 'function')) GROUP BY 1, 2"""),
}
SQL["k7_recommendations"] = f"""WITH r_ AS ({SQL["k_risk_batch"]}), t_ AS (SELECT hash, 1 AS f, 'split the change' AS recommendation FROM r_ WHERE k1 >= 60 UNION ALL SELECT hash, 2, 'commit in smaller steps' FROM r_ WHERE k2 >= 60 UNION ALL SELECT hash, 3, 'have the complex code reviewed again' FROM r_ WHERE k3 >= 50
    UNION ALL SELECT hash, 4, 'test what depends on the files' FROM r_ WHERE k4 >= 50 UNION ALL SELECT hash, 5, 'review in pairs' FROM r_ WHERE k5 >= 40 UNION ALL SELECT hash, 6, 'add tests for the files' FROM r_ WHERE k6 >= 50 UNION ALL SELECT hash, 7, 'safe as it is' FROM r_ WHERE recommendations = 0)
    SELECT hash, row_number() OVER (PARTITION BY hash ORDER BY f) - 1 AS ord, recommendation FROM t_"""
SQL["k7_concerns"] = f"""WITH r_ AS ({SQL["k_risk_batch"]}) SELECT hash, level, CASE WHEN greatest(k1, k2, k3, k4, k5, k6) < 50 THEN 'none' ELSE CASE greatest(k1, k2, k3, k4, k5, k6) WHEN k1 THEN 'files' WHEN k2 THEN 'lines' WHEN k3 THEN 'complexity' WHEN k4 THEN 'dependents' WHEN k5 THEN 'owners' ELSE 'tests' END END AS concern FROM r_"""
