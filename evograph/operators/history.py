"""Version-control history: churn, ownership, bus factors, experts, reviewers, activity, change logs and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..relations import AREA_SQL, AS_OF_US, DAY_US, DIR_SQL, SOURCE, Relations, area_of, day_of, js_round, n, path_dir, r2, sql
from ..session import number_rows

def _repo(c: str = "file_path"):
    return F.split(c, "/")[0]


def newest(df: DataFrame, per: str, limit: int) -> DataFrame:
    """The newest rows per key; ties in time go by hash. The limit is applied before the rows are shuffled, too."""
    w = Window.partitionBy(per).orderBy(F.desc("at_us"), "hash")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def ranked(df: DataFrame, per: list[str], *order) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))


# ---- scans ----


def commit_scan(r: Relations, limit: int = 200, since_days: int | None = None, no_merges: bool = False) -> DataFrame:
    """The newest commits per repository, optionally since some days ago and without merges."""
    c = r.commits
    if since_days is not None:
        c = c.where(F.col("at_us") >= r.as_of_us - since_days * DAY_US)
    if no_merges:
        c = c.where(~F.lower(F.coalesce("message", F.lit(""))).startswith("merge "))
    return newest(c, "repo", limit).select("hash", "repo", "at_us")


def commit_file_scan(r: Relations) -> DataFrame:
    """Files of every commit, as counts of files and lines per commit."""
    return r.changes.groupBy("hash").agg(n().alias("files"), F.sum("added").cast("bigint").alias("added"), F.sum("removed").cast("bigint").alias("removed"))


def repo_stats(r: Relations) -> DataFrame:
    """Commits, contributors, first and last commit of every repository (the true oldest one)."""
    return r.commits.groupBy("repo").agg(n().alias("commits"), F.countDistinct("author").alias("contributors"), F.min("at_us").alias("oldest_us"), F.max("at_us").alias("newest_us"))


# ---- files ----


def file_history(r: Relations, limit: int = 50) -> DataFrame:
    """A3: per file over its newest 50 commits: commits, contributors, who made most of them, and the last ten short hashes."""
    c = newest(r.changes, "file_path", limit)
    per = ranked(c.groupBy("file_path", "author").agg(n().alias("k"), F.max("at_us").alias("last")), ["file_path"], F.desc("k"), F.desc("last"), F.asc_nulls_last("author"))
    who = per.groupBy("file_path").agg(F.sum("k").alias("commits"), n().alias("contributors"), F.max(F.when(F.col("rn") == 1, F.col("author"))).alias("main_author"))
    recent = ranked(c.select("file_path", "hash", "at_us"), ["file_path"], F.desc("at_us"), "hash").where("rn <= 10")
    short = recent.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.substring("hash", 1, 7).alias("h")))), lambda x: x.h), " ").alias("recent"))
    return who.join(short, "file_path")


def churn(r: Relations, since_days: int = 365) -> DataFrame:
    """A4: changes of source files since a time: commits, last change, distinct authors."""
    c = r.changes.where(F.col("file_path").rlike(SOURCE) & (F.col("at_us") >= r.as_of_us - since_days * DAY_US))
    return c.groupBy("file_path").agg(n().alias("commits"), F.max("at_us").alias("last_us"), F.countDistinct("author").alias("authors"))


def hot_files(r: Relations, threshold: int = 10) -> DataFrame:
    """Files with at least a number of commits."""
    return r.commit_files.groupBy("file_path").agg(n().alias("commits")).where(F.col("commits") >= threshold)


def churn_score(commits, contributors, days):
    """.4 commits to 50, .3 contributors to 5, .3 for freshness within 180 days."""
    return 0.4 * F.least(commits / 50.0, F.lit(1.0)) + 0.3 * F.least(contributors / 5.0, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), 1 - days / 180.0)


def churn_scores(r: Relations) -> DataFrame:
    """P7 for every file of the history."""
    h = r.changes.groupBy("file_path").agg(n().alias("c"), F.countDistinct("author").alias("k"), F.max("at_us").alias("last"))
    days = F.floor((F.lit(r.as_of_us) - F.col("last")) / DAY_US)
    return h.select("file_path", r2(churn_score(F.col("c"), F.col("k"), days), 4).alias("score"))


def estimated_history(r: Relations) -> DataFrame:
    """Shares of the contributors that a file node lists, estimated by their places: commits max(1, round(n / (i + 1))), share round(100 / (i + 1))."""
    f = r.files.where("size(contributors) > 0").select("id", "modification_count", F.posexplode("contributors").alias("i", "contributor"))
    return f.where("contributor IS NOT NULL").select(
        "id", "contributor", F.col("i").cast("bigint").alias("place"), F.greatest(F.lit(1), js_round(F.coalesce("modification_count", F.lit(0)) / (F.col("i") + 1))).alias("commits"), js_round(100 / (F.col("i") + 1)).alias("share")
    )


# ---- ownership ----


def ownership(r: Relations, limit: int = 500) -> DataFrame:
    """Owner of every source file over the newest 500 commits of its repository, share, bus factor and risk.

    The owner made most commits (ties: the smaller name). Authors with a fifth of the commits count for the bus
    factor, which is 1 at least; the risk level looks at the count before that.
    """
    recent = newest(r.commits, "repo", limit).select("hash", "author", "at_us")
    c = r.commit_files.where(F.col("file_path").rlike(SOURCE)).join(recent, "hash")
    per = c.groupBy("file_path", "author").agg(n().alias("k"), F.max("at_us").alias("last"))
    w = Window.partitionBy("file_path")
    per = ranked(per.withColumn("total", F.sum("k").over(w)), ["file_path"], F.desc("k"), F.asc_nulls_last("author")).withColumn("share", js_round(100.0 * F.col("k") / F.col("total")))
    out = per.groupBy("file_path").agg(
        F.max(F.when(F.col("rn") == 1, F.col("author"))).alias("owner"), F.max(F.when(F.col("rn") == 1, F.col("share"))).alias("share"), F.count_if(F.col("share") >= 20).alias("many"),
        n().alias("authors"), F.floor((F.lit(r.as_of_us) - F.max("last")) / DAY_US).alias("days"),
    )
    b = F.col("many")
    risk = F.when((b <= 1) & (F.col("share") >= 80), "critical").when((b <= 1) | (F.col("share") >= 70), "high").when((b <= 2) | (F.col("days") > 180), "medium").otherwise("low")
    return out.select("file_path", "owner", "share", F.greatest(F.lit(1), b).cast("bigint").alias("bus_factor"), "authors", F.col("days").cast("bigint").alias("days"), risk.alias("risk"))


def overall_bus_factor(r: Relations) -> DataFrame:
    """Mean bus factor of the files, critical ones twice and high ones one and a half times; 0 without files."""
    w = F.when(F.col("risk") == "critical", 2.0).when(F.col("risk") == "high", 1.5).otherwise(1.0)
    return ownership(r).agg(F.coalesce(r2(F.try_divide(F.sum(w * F.col("bus_factor")), F.sum(w)), 1), F.lit(0.0)).alias("bus_factor"), n().alias("files"))


def ownership_distribution(r: Relations, limit: int = 10) -> DataFrame:
    """Files per owner and their share of all files, the ten largest."""
    o = ownership(r)
    per = o.groupBy("owner").agg(n().alias("files")).crossJoin(F.broadcast(o.agg(n().alias("total"))))  # against one row
    return per.orderBy(F.desc("files"), F.asc_nulls_last("owner")).limit(limit).select("owner", "files", js_round(100.0 * F.col("files") / F.col("total")).alias("share"))


def directory_knowledge(r: Relations) -> DataFrame:
    """Bus factor of every directory: owners of a fifth of its files at least."""
    o = ownership(r).withColumn("directory", path_dir("file_path"))
    per = o.groupBy("directory", "owner").agg(n().alias("k")).withColumn("files", F.sum("k").over(Window.partitionBy("directory")))
    return per.groupBy("directory").agg(F.max("files").alias("files"), n().alias("owners"), F.greatest(F.lit(1), F.count_if(F.col("k") >= 0.2 * F.col("files"))).cast("bigint").alias("bus_factor"))


def area_shares(r: Relations) -> DataFrame:
    """Contributions (commits and a tenth of the lines) of authors to areas, with their rounded shares."""
    c = r.changes.groupBy("repo", area_of("file_path").alias("area"), "author").agg(F.countDistinct("hash").alias("commits"), (F.sum("added") + F.sum("removed")).alias("lines"))
    # in tenths, so that sums of them are exact
    c = c.withColumn("part", F.col("commits") * 10 + F.col("lines"))
    return c.withColumn("share", js_round(100.0 * F.try_divide(F.col("part"), F.sum("part").over(Window.partitionBy("repo", "area")))))


def area_bus_factors(r: Relations) -> DataFrame:
    """Per area its bus factor, leading contributor and share, files and lines, and how critical it is."""
    s = ranked(area_shares(r), ["repo", "area"], F.desc("part"), F.asc_nulls_last("author"))
    per = s.groupBy("repo", "area").agg(
        F.greatest(F.lit(1), F.count_if(F.col("share") >= 20)).cast("bigint").alias("bus_factor"), F.max(F.when(F.col("rn") == 1, F.col("author"))).alias("leader"), F.max(F.when(F.col("rn") == 1, F.col("share"))).alias("share"), n().alias("contributors")
    )
    size = r.files.groupBy(_repo().alias("repo"), area_of("file_path").alias("area")).agg(n().alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("bigint").alias("lines"))
    j = per.join(size, ["repo", "area"], "left").withColumn("files", F.coalesce("files", F.lit(0))).withColumn("lines", F.coalesce("lines", F.lit(0)))
    core = F.col("area").rlike("^(?:src/core|src/graph|src/analyzers|core|lib)")
    large = (F.col("lines") > 1000) | (F.col("files") > 10)
    b = F.col("bus_factor")
    level = (
        F.when((b == 1) & ((F.col("share") >= 80) | core | large), "critical").when((b == 1) | (F.col("share") >= 70) & (core | large), "high").when((b <= 2) | (F.col("share") >= 60), "medium").otherwise("low")
    )
    return j.withColumn("criticality", level)


def bus_factor_summary(r: Relations) -> DataFrame:
    """Overall bus factor by lines, lines of areas with one owner and their share, per repository."""
    a = area_bus_factors(r)
    g = a.groupBy("repo").agg(
        F.coalesce(r2(F.try_divide(F.sum(F.col("bus_factor") * F.col("lines")), F.sum("lines")), 1), r2(F.avg("bus_factor"), 1)).alias("overall"),
        F.sum(F.when(F.col("bus_factor") == 1, F.col("lines")).otherwise(0)).alias("solo_lines"), F.sum("lines").alias("all_lines"),
    )
    g = g.withColumn("at_risk", js_round(100.0 * F.col("solo_lines") / F.greatest(F.lit(1), F.col("all_lines"))))
    o, p = F.col("overall"), F.col("at_risk")
    level = F.when((o >= 3) & (p < 10), "healthy").when((o >= 2) & (p < 25), "concerning").when((o >= 1.5) | (p < 50), "dangerous").otherwise("critical")
    return g.select("repo", "overall", "solo_lines", "at_risk", level.alias("level"))


def knowledge_map(r: Relations, areas: int = 3) -> DataFrame:
    """The three areas of a repository in which each contributor has the largest score (share, 100 at most), and their coverage."""
    s = area_shares(r).withColumn("score", F.least(F.lit(100), F.col("share")))
    b = s.groupBy("repo", "area").agg(F.greatest(F.lit(1), F.count_if(F.col("score") >= 20)).alias("b"))
    cover = F.when(F.col("b") == 1, "solo").when(F.col("b") == 2, "pair").when(F.col("b") <= 4, "team").otherwise("distributed")
    top = ranked(s.where("author IS NOT NULL"), ["repo", "author"], F.desc("score"), "area").where(F.col("rn") <= areas)
    return top.join(b, ["repo", "area"]).select("repo", "author", "area", "score", cover.alias("coverage"))


def experts_of_files(r: Relations) -> DataFrame:
    """The five experts of every source file: commits, lines (20 a commit if unknown), expertise, recent activity."""
    per = r.changes.where(F.col("file_path").rlike(SOURCE)).groupBy("file_path", "author").agg(n().alias("commits"), (F.sum("added") + F.sum("removed")).cast("bigint").alias("counted"), F.max("at_us").alias("last"))
    total = F.sum("commits").over(Window.partitionBy("file_path"))
    per = ranked(per.withColumn("share", F.col("commits") / total), ["file_path"], F.desc("commits"), F.asc_nulls_last("author")).where("rn <= 5")
    kind = F.when(F.col("share") >= 0.5, "primary").when(F.col("share") >= 0.2, "significant").otherwise("contributor")
    lines = F.when(F.col("counted") > 0, F.col("counted")).otherwise(F.col("commits") * 20)
    return per.select("file_path", "author", "commits", lines.alias("lines"), kind.alias("expertise"), (F.col("last") >= r.as_of_us - 30 * DAY_US).alias("recent"))


def related_experts(r: Relations) -> DataFrame:
    """Authors of most commits to a file's directory who are no primary expert of the file."""
    d = r.changes.where(F.col("file_path").rlike(SOURCE)).withColumn("directory", path_dir("file_path"))
    lead = ranked(d.groupBy("directory", "author").agg(n().alias("k")), ["directory"], F.desc("k"), F.asc_nulls_last("author")).where("rn = 1 AND author IS NOT NULL").select("directory", "author")
    own = experts_of_files(r).where("expertise = 'primary'").select("file_path", "author")
    return d.select("directory", "file_path").distinct().join(lead, "directory").join(own, ["file_path", "author"], "left_anti").select("file_path", "author")


def reviewers(r: Relations, per_file: int = 50, last: int = 20) -> DataFrame:
    """Reviewers for the newest commits of every repository: authors of their files, but the commit's own.

    Score: 50 for the share of known files, 30 for up to 20 commits, 20 for having touched one within 30 days.
    """
    target = newest(r.commits, "repo", last).select("hash", F.col("author").alias("own"))
    files = r.commit_files.join(target, "hash").select("hash", "own", "file_path")
    size = files.groupBy("hash").agg(n().alias("files"))
    known = newest(r.changes, "file_path", per_file).groupBy("file_path", "author").agg(n().alias("k"), F.max("at_us").alias("last"))
    c = files.join(known, "file_path").where(~F.col("author").eqNullSafe(F.col("own")) & F.col("author").isNotNull())
    c = c.groupBy("hash", "author").agg(n().alias("known"), F.sum("k").alias("commits"), F.max("last").alias("last")).join(size, "hash")
    score = js_round(50.0 * F.col("known") / F.col("files") + 30 * F.least(F.col("commits") / 20.0, F.lit(1.0)) + F.when(F.col("last") > r.as_of_us - 30 * DAY_US, 20).otherwise(0))
    return c.select("hash", "author", "known", "commits", score.alias("score"))


# ---- people ----


def leaderboard(r: Relations, since_days: int = 365) -> DataFrame:
    """Contributors since a time by commits, lines, net change and files that others know too, ranked by points.

    Change: round((added - removed) / files / 10). Shared files: those with two authors at least, five points of ten
    at most. Points: 10 a commit, 5 a reduced and -5 an added step, 50 a shared ten; never below 0.
    """
    c = r.changes.where((F.col("at_us") >= r.as_of_us - since_days * DAY_US) & F.col("author").isNotNull())
    per = c.groupBy("author").agg(F.countDistinct("hash").alias("commits"), F.sum("added").cast("bigint").alias("added"), F.sum("removed").cast("bigint").alias("removed"), F.countDistinct("file_path").alias("files"))
    shared = c.select("file_path", "author").distinct()
    many = shared.groupBy("file_path").agg(n().alias("k")).where("k >= 2").select("file_path")
    s = shared.join(many, "file_path", "left_semi").groupBy("author").agg(n().alias("shared"))
    j = per.join(s, "author", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    delta = js_round((F.col("added") - F.col("removed")) / F.col("files") / 10.0)
    j = j.withColumn("delta", delta).withColumn("bonus", F.least(F.floor(F.col("shared") / 10), F.lit(5)))
    points = F.greatest(F.lit(0), 10 * F.col("commits") - 5 * F.col("delta") + 50 * F.col("bonus"))
    return j.select("author", "commits", "added", "removed", "files", "delta", "shared", points.cast("bigint").alias("points"))


def leaders(r: Relations, limit: int = 20) -> DataFrame:
    """The first places of the leaderboard; ties go by name."""
    top = leaderboard(r).orderBy(F.desc("points"), "author").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("points"), "author")).cast("bigint")).select("rank", "author", "points")  # over the few rows of the limit


def hour_of(us):
    return F.pmod(F.floor(us / 3_600_000_000), F.lit(24))


def weekday_of(us):
    """0 Sunday to 6 Saturday, in UTC."""
    return F.pmod(F.floor(us / DAY_US) + 4, F.lit(7))


def habits(r: Relations) -> DataFrame:
    """Per author commits, on weekends, late at night (22 to 5), fixes, reverts, and the average size of a commit."""
    size = r.commit_files.groupBy("hash").agg((F.sum("added") + F.sum("removed")).alias("lines"))
    c = r.commits.where("author IS NOT NULL").join(size, "hash", "left").withColumn("m", F.lower(F.coalesce("message", F.lit(""))))
    h, d = hour_of(F.col("at_us")), weekday_of(F.col("at_us"))
    return c.groupBy("author").agg(
        n().alias("commits"), F.count_if((d == 0) | (d == 6)).alias("weekend"), F.count_if((h >= 22) | (h <= 5)).alias("late"), F.count_if(F.col("m").rlike(r"\b(?:fix|bug|hotfix|patch)")).alias("fixes"),
        F.count_if(F.col("m").rlike("revert")).alias("reverts"), r2(F.avg(F.coalesce("lines", F.lit(0)))).alias("mean_lines"),
    )


def awards(r: Relations) -> DataFrame:
    """For every measure the author with the largest value; of equals the later one in order of name wins."""
    long = habits(r).select("author", F.explode(F.array(*[F.struct(F.lit(c).alias("award"), F.col(c).cast("double").alias("value")) for c in ("commits", "weekend", "late", "fixes", "reverts", "mean_lines")])).alias("x")).select("author", "x.award", "x.value")
    return ranked(long, ["award"], F.desc("value"), F.desc("author")).where("rn = 1").drop("rn")


def streaks(r: Relations) -> DataFrame:
    """Longest and current run of days with commits, per author; a run is current if it reaches yesterday at least."""
    days = r.commits.where("author IS NOT NULL").select("author", day_of("at_us").alias("day")).distinct()
    runs = ranked(days, ["author"], "day").withColumn("island", F.col("day") - F.col("rn")).groupBy("author", "island").agg(n().alias("length"), F.max("day").alias("last"))
    today = r.as_of_us // DAY_US
    return runs.groupBy("author").agg(F.max("length").alias("longest"), F.coalesce(F.max(F.when(F.col("last") >= today - 1, F.col("length"))), F.lit(0)).alias("current"), F.sum("length").alias("days"))


def wrapped(r: Relations, year: int = 2024) -> DataFrame:
    """A year per repository: commits, authors, lines, busiest month, weekday and hour, nights (0 to 4) and weekends."""
    date = F.date_from_unix_date(day_of("at_us").cast("int"))
    c = r.commits.where(F.year(date) == year).select("repo", "hash", "author", F.month(date).alias("month"), weekday_of(F.col("at_us")).alias("weekday"), hour_of(F.col("at_us")).alias("hour"))
    busiest = lambda what: ranked(c.groupBy("repo", what).agg(n().alias("k")), ["repo"], F.desc("k"), what).where("rn = 1").select("repo", F.col(what).cast("bigint").alias(f"busiest_{what}"))
    base = c.groupBy("repo").agg(n().alias("commits"), F.countDistinct("author").alias("authors"), F.count_if(F.col("hour") <= 4).alias("nights"), F.count_if(F.col("weekday").isin(0, 6)).alias("weekends"))
    lines = r.commit_files.join(c.select("hash", "repo"), "hash").groupBy("repo").agg(F.sum("added").cast("bigint").alias("added"), F.sum("removed").cast("bigint").alias("removed"))
    return base.join(lines, "repo", "left").join(busiest("month"), "repo").join(busiest("weekday"), "repo").join(busiest("hour"), "repo")


def wrapped_top(r: Relations, year: int = 2024, limit: int = 5) -> DataFrame:
    """The five contributors of a year with their share, per repository."""
    date = F.date_from_unix_date(day_of("at_us").cast("int"))
    per = r.commits.where((F.year(date) == year) & F.col("author").isNotNull()).groupBy("repo", "author").agg(n().alias("commits"))
    per = per.withColumn("total", F.sum("commits").over(Window.partitionBy("repo")))
    return ranked(per, ["repo"], F.desc("commits"), "author").where(F.col("rn") <= limit).select("repo", "author", "commits", js_round(100.0 * F.col("commits") / F.col("total")).alias("share"))


def origin(r: Relations, founders: int = 10) -> DataFrame:
    """The ten contributors of most commits per repository, when they began, and whether within 30 days of its first commit."""
    per = r.commits.where("author IS NOT NULL").groupBy("repo", "author").agg(n().alias("commits"), F.min("at_us").alias("first_us"))
    per = per.withColumn("start", F.min("first_us").over(Window.partitionBy("repo")))
    return ranked(per, ["repo"], F.desc("commits"), "author").where(F.col("rn") <= founders).select("repo", "author", "commits", "first_us", (F.col("first_us") <= F.col("start") + 30 * DAY_US).alias("founder"))


def milestones(r: Relations) -> DataFrame:
    """Tags, and authors' first commits, in order of time per repository."""
    tags = r.commits.where(F.col("refs").rlike("tag: ")).select("repo", "at_us", F.lit("tag").alias("kind"), F.regexp_extract("refs", r"tag: ([^,\s]+)", 1).alias("name"))
    joins = r.commits.where("author IS NOT NULL").groupBy("repo", "author").agg(F.min("at_us").alias("at_us")).select("repo", "at_us", F.lit("join").alias("kind"), F.col("author").alias("name"))
    return tags.unionByName(joins)


def morning(r: Relations) -> DataFrame:
    """What a repository saw within the last 24 hours, and over the week."""
    c = r.changes.where(F.col("at_us") >= r.as_of_us - 7 * DAY_US)
    fresh = F.col("at_us") >= r.as_of_us - DAY_US
    return c.groupBy("repo").agg(
        F.countDistinct(F.when(fresh, F.col("hash"))).alias("commits"), F.countDistinct(F.when(fresh, F.col("file_path"))).alias("files"), F.countDistinct(F.when(fresh, F.col("author"))).alias("contributors"),
        F.countDistinct("hash").alias("week_commits"), F.countDistinct("file_path").alias("week_files"),
    )


def week_hot_files(r: Relations, days: int = 7, limit: int = 3) -> DataFrame:
    """The most changed files of a period per repository, over its newest 50 commits."""
    c = newest(r.commits.where(F.col("at_us") >= r.as_of_us - days * DAY_US), "repo", 50)
    per = r.commit_files.join(c.select("hash", "repo"), "hash").groupBy("repo", "file_path").agg(n().alias("changes"))
    return ranked(per, ["repo"], F.desc("changes"), "file_path").where(F.col("rn") <= limit).select("repo", "file_path", "changes")


def departed(r: Relations) -> DataFrame:
    """Files of the history that the graph doesn't know: first and last change, lifespan in days, commits and authors."""
    h = r.changes.where(F.col("file_path").rlike(SOURCE)).groupBy("file_path").agg(n().alias("commits"), F.countDistinct("author").alias("authors"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"))
    return h.join(r.files.select("file_path"), "file_path", "left_anti").withColumn("days", F.floor((F.col("last_us") - F.col("first_us")) / DAY_US).cast("bigint"))


def obituaries(r: Relations) -> DataFrame:
    """Life of every file: commits, authors, lines added and removed, age in days."""
    h = r.changes.groupBy("file_path").agg(
        n().alias("commits"), F.countDistinct("author").alias("authors"), F.sum("added").cast("bigint").alias("added"), F.sum("removed").cast("bigint").alias("removed"), F.min("at_us").alias("first"),
    )
    return h.select("file_path", "commits", "authors", "added", "removed", F.floor((F.lit(r.as_of_us) - F.col("first")) / DAY_US).cast("bigint").alias("age"))


# ---- archaeology ----


def archaeology(r: Relations, limit: int = 100) -> DataFrame:
    """Per file over its newest 100 commits: age, rewrites, growth and volatility.

    A rewrite changes more than 50 lines and removes more than half of what it adds; the first commit is none.
    Growth compares the shares of commits that mostly add, mostly remove, or neither.
    """
    c = newest(r.changes, "file_path", limit)
    c = ranked(c, ["file_path"], "at_us", F.desc("hash"))
    total = F.col("added") + F.col("removed")
    rewrite = (total > 50) & (F.col("removed") > F.col("added") / 2) & (F.col("rn") > 1)
    g = c.groupBy("file_path").agg(
        n().alias("commits"), F.count_if(rewrite).alias("rewrites"), F.count_if(F.col("added") > 2 * F.col("removed")).alias("grow"), F.count_if(F.col("removed") > 2 * F.col("added")).alias("shrink"), F.min("at_us").alias("first")
    )
    days = F.floor((F.lit(r.as_of_us) - F.col("first")) / DAY_US)
    growth = F.when(F.col("grow") >= 0.4 * F.col("commits"), "growing").when(F.col("shrink") >= 0.4 * F.col("commits"), "shrinking").when(F.col("grow") + F.col("shrink") <= 0.2 * F.col("commits"), "steady").otherwise("mixed")
    return g.select("file_path", "commits", "rewrites", days.cast("bigint").alias("age"), growth.alias("growth"), r2(F.col("commits") / F.greatest(F.lit(1.0), days / 30.0), 1).alias("volatility"))


def evolution_phases(r: Relations, limit: int = 100) -> DataFrame:
    """Phases of every file's life, folded over its commits in order of time: a rewrite, or more than 180 days
    since the phase began, begins a new one."""
    c = newest(r.changes, "file_path", limit)
    item = F.struct("at_us", "hash", ((F.col("added") + F.col("removed") > 50) & (F.col("removed") > F.col("added") / 2)).alias("rewrite"))
    per = c.groupBy("file_path").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("phases"), F.lit(0).cast("bigint").alias("since"))
    fold = F.aggregate(
        "items", start,
        lambda a, x: F.when((a.phases == 0) | x.rewrite | (x.at_us - a.since > 180 * DAY_US), F.struct((a.phases + 1).alias("phases"), x.at_us.alias("since"))).otherwise(a),
    )
    return per.select("file_path", fold.phases.alias("phases"))


# ---- change log and delivery ----

# Commit types and the sections they go to.
TYPES = {"feat": "feat", "feature": "feat", "fix": "fix", "bugfix": "fix", "refactor": "refactor", "docs": "docs", "test": "test", "tests": "test", "chore": "chore", "build": "chore", "ci": "chore", "style": "chore", "perf": "feat"}
HEAD = r"^(\w+)(?:\(([^)]+)\))?(!?):\s*(.+)$"


def changelog(r: Relations) -> DataFrame:
    """Commits parsed by their first line: section, scope, whether breaking, description; the rest is 'other'."""
    first = F.split(F.coalesce("message", F.lit("")), "\n")[0]
    word = F.lower(F.regexp_extract("first", HEAD, 1))
    kind = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in TYPES.items()], F.lit("other"))
    c = r.commits.withColumn("first", first).withColumn("parsed", F.col("first").rlike(HEAD))
    return c.select(
        "hash", F.when(F.col("parsed"), kind).otherwise("other").alias("section"), F.regexp_extract("first", HEAD, 2).alias("scope"),
        ((F.regexp_extract("first", HEAD, 3) == "!") | F.col("parsed") & F.coalesce(F.col("message").contains("BREAKING CHANGE"), F.lit(False))).alias("breaking"),
        F.when(F.col("parsed"), F.regexp_extract("first", HEAD, 4)).otherwise(F.col("first")).alias("description"),
    )


def changelog_stats(r: Relations) -> DataFrame:
    """Commits, breaking ones, contributors and the range of dates per section (from the first to the last)."""
    c = changelog(r).join(r.commits.select("hash", "author", "at_us"), "hash")
    return c.groupBy("section").agg(n().alias("commits"), F.count_if("breaking").alias("breaking"), F.countDistinct("author").alias("contributors"), F.min("at_us").alias("from_us"), F.max("at_us").alias("to_us"))


LOOK_AHEAD = 49


def recoveries(r: Relations) -> DataFrame:
    """For every revert the first fix among the next 49 commits of its repository, and the hours between them.

    A look-ahead of bounded length needs no window over a repository in one task: commits are numbered in order,
    and reverts meet the fixes of their own and the next block of numbers.
    """
    m = F.lower(F.coalesce("message", F.lit("")))
    c = number_rows(r.commits.select("repo", "at_us", "hash", m.alias("m")), "k", "repo", "at_us", "hash")
    fixes = c.where(F.col("m").rlike("fix|patch|restore")).select(F.col("repo").alias("repo"), F.col("k").alias("fk"), F.col("at_us").alias("fixed"), F.floor(F.col("k") / LOOK_AHEAD).alias("block"))
    reverts = c.where(F.col("m").contains("revert")).select("repo", "k", "hash", "at_us", F.explode(F.array(F.floor(F.col("k") / LOOK_AHEAD), F.floor(F.col("k") / LOOK_AHEAD) + 1)).alias("block"))
    hit = reverts.join(fixes, ["repo", "block"]).where((F.col("fk") > F.col("k")) & (F.col("fk") <= F.col("k") + LOOK_AHEAD))
    first = hit.groupBy("repo", "hash", "at_us").agg(F.min(F.struct("fk", "fixed")).alias("f"))
    return first.select("repo", "hash", ((F.col("f.fixed") - F.col("at_us")) / 3_600_000_000).alias("h")).where("h > 0 AND h < 720").select("repo", "hash", r2(F.col("h"), 3).alias("hours"))


def releases(r: Relations) -> DataFrame:
    """Tags per repository with the time of the tag before (-1: none)."""
    t = r.commits.where(F.col("refs").rlike("tag: ")).select("repo", F.regexp_extract("refs", r"tag: ([^,\s]+)", 1).alias("tag"), "at_us")
    t = t.groupBy("repo", "tag").agg(F.min("at_us").alias("at_us"))
    return t.withColumn("previous_us", F.lag("at_us", 1, -1).over(Window.partitionBy("repo").orderBy("at_us", "tag")))


def lead_times(r: Relations, bucket_days: int = 30) -> DataFrame:
    """Commits between a tag and the one before (at the first tag: all before it), and their mean hours until the tag.

    No range join multiplies rows, and no window holds a whole repository: tags and commits are put in one order
    within buckets of time, and what follows the last tag of its bucket takes the first tag of the next bucket
    that has one.
    """
    t = releases(r).select("repo", "tag", F.col("at_us").alias("tag_us"))
    bucket = F.floor(F.col("at_us") / (bucket_days * DAY_US)).alias("bucket")
    c = r.commits.select("repo", "at_us", F.lit(None).cast("string").alias("tag"), F.lit(0).alias("is_tag"))
    both = c.unionByName(t.select("repo", F.col("tag_us").alias("at_us"), "tag", F.lit(1).alias("is_tag"))).select("*", bucket)
    # a running frame from the latest to the earliest: the last tag met is the next one
    back = Window.partitionBy("repo", "bucket").orderBy(F.desc("at_us"), F.desc("is_tag"), F.desc("tag"))
    inside = both.withColumn("next", F.last(F.when(F.col("is_tag") == 1, F.struct("tag", "at_us")), ignorenulls=True).over(back)).where("is_tag = 0")
    firsts = both.groupBy("repo", "bucket").agg(F.min(F.when(F.col("is_tag") == 1, F.struct("at_us", "tag"))).alias("first"))
    later = Window.partitionBy("repo").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # over buckets
    firsts = firsts.withColumn("after", F.last("first", ignorenulls=True).over(later)).select("repo", "bucket", "after")
    nxt = inside.join(firsts, ["repo", "bucket"]).select("repo", "at_us", F.coalesce("next.tag", "after.tag").alias("tag"), F.coalesce("next.at_us", "after.at_us").alias("tag_us")).where("tag IS NOT NULL")
    return nxt.groupBy("repo", "tag").agg(n().alias("commits"), r2(F.avg((F.col("tag_us") - F.col("at_us")) / 3_600_000_000), 2).alias("hours"))


def delivery(r: Relations, weeks: int = 52) -> DataFrame:
    """The four measures of delivery per repository over a period, a level for each and for their mean.

    Deployments are tags. Lead time: mean over tags, else half the time between deployments. Failure rate: reverts
    to merges or deployments. Recovery: mean hours of recoveries, else 24 if there were reverts.
    """
    since = r.as_of_us - weeks * 7 * DAY_US
    m = F.lower(F.coalesce("message", F.lit("")))
    c = r.commits.where(F.col("at_us") >= since).groupBy("repo").agg(
        n().alias("commits"), F.count_if(m.startswith("revert") | m.contains('revert "')).alias("reverts"), F.count_if(m.startswith("merge") | F.coalesce(F.col("refs").rlike("main|master"), F.lit(False))).alias("merges")
    )
    tags = releases(r).where(F.col("at_us") >= since).groupBy("repo").agg(n().alias("tags"))
    lead = lead_times(r).join(releases(r).where(F.col("at_us") >= since).select("repo", "tag"), ["repo", "tag"]).groupBy("repo").agg(F.avg("hours").alias("lead"))
    rec = recoveries(r).join(r.commits.where(F.col("at_us") >= since).select("hash"), "hash").groupBy("repo").agg(F.avg("hours").alias("rec"))
    j = c.join(tags, "repo", "left").join(lead, "repo", "left").join(rec, "repo", "left").withColumn("tags", F.coalesce("tags", F.lit(0)))
    j = j.select(
        "repo", "commits", "tags", (F.col("tags") / float(weeks)).alias("per_week"),
        F.coalesce("lead", F.when(F.col("tags") > 0, F.try_divide(F.lit(weeks * 168.0), F.col("tags")) / 2), F.lit(0.0)).alias("lead"),
        (100.0 * F.col("reverts") / F.greatest("merges", "tags", F.lit(1))).alias("failures"), F.coalesce("rec", F.when(F.col("reverts") > 0, 24.0), F.lit(0.0)).alias("recovery"),
    )
    up = lambda x, a, b, d: F.when(x >= a, 4).when(x >= b, 3).when(x >= d, 2).otherwise(1)
    down = lambda x, a, b, d: F.when(x <= a, 4).when(x <= b, 3).when(x <= d, 2).otherwise(1)
    mean = (up(F.col("per_week"), 7, 1, 0.25) + down(F.col("lead"), 1, 168, 720) + down(F.col("failures"), 5, 10, 15) + down(F.col("recovery"), 1, 24, 168)) / 4.0
    level = F.when(mean >= 3.5, "elite").when(mean >= 2.5, "high").when(mean >= 1.5, "medium").otherwise("low")
    return j.select("repo", "commits", "tags", r2(F.col("per_week"), 3).alias("per_week"), r2(F.col("lead"), 1).alias("lead_hours"), r2(F.col("failures"), 2).alias("failure_rate"), r2(F.col("recovery"), 1).alias("recovery_hours"), level.alias("level"))


def _q(f, *a, **k):
    return lambda spark, d: f(Relations(spark, d), *a, **k)


QUERIES = {
    "s9_commit_scan": _q(commit_scan, 200, 365, True), "s10_commit_files": _q(commit_file_scan), "s13_repo_stats": _q(repo_stats), "a3_file_history": _q(file_history), "a4_churn": _q(churn), "pf8_hot_files": _q(hot_files),
    "pf7_churn_scores": _q(churn_scores), "pf6_estimated_history": _q(estimated_history), "a5_ownership": _q(ownership), "a7_overall_bus_factor": _q(overall_bus_factor), "a8_ownership_distribution": _q(ownership_distribution),
    "a9_directory_knowledge": _q(directory_knowledge), "a10_area_bus_factors": _q(area_bus_factors), "a11_bus_factor_summary": _q(bus_factor_summary), "a12_knowledge_map": _q(knowledge_map), "a13_experts": _q(experts_of_files),
    "j17_related_experts": _q(related_experts), "a14_reviewers": _q(reviewers), "a15_leaderboard": _q(leaderboard), "a15_leaders": _q(leaders), "a16_habits": _q(habits), "a16_awards": _q(awards), "a18_streaks": _q(streaks), "a17_wrapped": _q(wrapped),
    "a17_wrapped_top": _q(wrapped_top), "a19_origin": _q(origin), "a19_milestones": _q(milestones), "a20_morning": _q(morning), "a20_week_hot_files": _q(week_hot_files), "a28_departed": _q(departed), "a28_obituaries": _q(obituaries),
    "a27_archaeology": _q(archaeology), "a27_phases": _q(evolution_phases), "pf18_changelog": _q(changelog), "a26_changelog_stats": _q(changelog_stats), "j13_recoveries": _q(recoveries), "j14_releases": _q(releases), "j14_lead_times": _q(lead_times), "a23_delivery": _q(delivery),
}

SRC = r"regexp_matches(file_path, '\.(ts|tsx|js|jsx)$')"


def _newest(src: str, per: str, k: int) -> str:
    return f"(SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY at_us DESC, hash) AS rn_ FROM {src}) WHERE rn_ <= {k})"


OWN = f""", oc_ AS (SELECT f.file_path, c.author, c.at_us FROM commit_files_ f JOIN {_newest('commits_', 'repo', 500)} c USING (hash) WHERE {SRC}), op_ AS (SELECT file_path, author, count(*) AS k, max(at_us) AS last FROM oc_ GROUP BY 1, 2),
ow_ AS (SELECT *, floor(100.0::DOUBLE * k / sum(k) OVER (PARTITION BY file_path) + 0.5)::BIGINT AS share, row_number() OVER (PARTITION BY file_path ORDER BY k DESC, author NULLS LAST) AS rn FROM op_),
own_ AS (SELECT file_path, owner, share, greatest(1, many) AS bus_factor, authors, days, CASE WHEN many <= 1 AND share >= 80 THEN 'critical' WHEN many <= 1 OR share >= 70 THEN 'high' WHEN many <= 2 OR days > 180 THEN 'medium' ELSE 'low' END AS risk FROM (
SELECT file_path, max(author) FILTER (rn = 1) AS owner, max(share) FILTER (rn = 1) AS share, count(*) FILTER (share >= 20) AS many, count(*) AS authors, (({AS_OF_US} - max(last)) // 86400000000)::BIGINT AS days FROM ow_ GROUP BY 1))"""
SHARES = f""", sh0_ AS (SELECT repo, {AREA_SQL.format('file_path')} AS area, author, count(DISTINCT hash) * 10 + sum(added) + sum(removed) AS part FROM changes_ GROUP BY 1, 2, 3),
sh_ AS (SELECT *, floor(100.0::DOUBLE * part / nullif(sum(part) OVER (PARTITION BY repo, area), 0) + 0.5)::BIGINT AS share, row_number() OVER (PARTITION BY repo, area ORDER BY part DESC, author NULLS LAST) AS rn FROM sh0_)"""
AREAS = SHARES + f""", ar_ AS (SELECT s.*, coalesce(z.files, 0) AS files, coalesce(z.lines, 0)::BIGINT AS lines FROM (SELECT repo, area, greatest(1, count(*) FILTER (share >= 20)) AS bus_factor, max(author) FILTER (rn = 1) AS leader, max(share) FILTER (rn = 1) AS share, count(*) AS contributors FROM sh_ GROUP BY 1, 2) s
LEFT JOIN (SELECT split_part(file_path, '/', 1) AS repo, {AREA_SQL.format('file_path')} AS area, count(*) AS files, sum(line_count) AS lines FROM files_ GROUP BY 1, 2) z USING (repo, area)),
area_ AS (SELECT *, CASE WHEN bus_factor = 1 AND (share >= 80 OR core OR large) THEN 'critical' WHEN bus_factor = 1 OR share >= 70 AND (core OR large) THEN 'high' WHEN bus_factor <= 2 OR share >= 60 THEN 'medium' ELSE 'low' END AS criticality FROM (
SELECT *, regexp_matches(area, '^(src/core|src/graph|src/analyzers|core|lib)') AS core, lines > 1000 OR files > 10 AS large FROM ar_))"""
EXP = f""", ex0_ AS (SELECT file_path, author, count(*) AS commits, (sum(added) + sum(removed))::BIGINT AS counted, max(at_us) AS last FROM changes_ WHERE {SRC} GROUP BY 1, 2),
ex_ AS (SELECT file_path, author, commits, CASE WHEN counted > 0 THEN counted ELSE commits * 20 END AS lines, CASE WHEN share >= 0.5 THEN 'primary' WHEN share >= 0.2 THEN 'significant' ELSE 'contributor' END AS expertise, last >= {AS_OF_US - 30 * DAY_US} AS recent
FROM (SELECT *, commits::DOUBLE / sum(commits) OVER (PARTITION BY file_path) AS share, row_number() OVER (PARTITION BY file_path ORDER BY commits DESC, author NULLS LAST) AS rn FROM ex0_) WHERE rn <= 5)"""
BOARD = f""", lc_ AS (SELECT * FROM changes_ WHERE at_us >= {AS_OF_US - 365 * DAY_US} AND author IS NOT NULL), lm_ AS (SELECT file_path FROM lc_ GROUP BY 1 HAVING count(DISTINCT author) >= 2),
lb_ AS (SELECT *, greatest(0, 10 * commits - 5 * delta + 50 * least(shared // 10, 5))::BIGINT AS points FROM (SELECT author, count(DISTINCT hash) AS commits, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, count(DISTINCT file_path) AS files,
floor((sum(added) - sum(removed))::DOUBLE / count(DISTINCT file_path) / 10.0 + 0.5)::BIGINT AS delta, count(DISTINCT file_path) FILTER (file_path IN (FROM lm_)) AS shared FROM lc_ GROUP BY 1))"""
HABITS = r""", hb_ AS (SELECT author, count(*) AS commits, count(*) FILTER (d IN (0, 6)) AS weekend, count(*) FILTER (h >= 22 OR h <= 5) AS late, count(*) FILTER (regexp_matches(m, '\b(fix|bug|hotfix|patch)')) AS fixes, count(*) FILTER (m LIKE '%revert%') AS reverts, floor(avg(coalesce(lines, 0)) * 100 + 0.5) / 100 AS mean_lines
FROM (SELECT author, hash, (at_us // 86400000000 + 4) % 7 AS d, (at_us // 3600000000) % 24 AS h, lower(coalesce(message, '')) AS m FROM commits_ WHERE author IS NOT NULL) LEFT JOIN (SELECT hash, sum(added) + sum(removed) AS lines FROM commit_files_ GROUP BY 1) USING (hash) GROUP BY 1)"""
YEAR = ", yc_ AS (SELECT * FROM (SELECT repo, hash, author, year(DATE '1970-01-01' + (at_us // 86400000000)::INTEGER) AS y, month(DATE '1970-01-01' + (at_us // 86400000000)::INTEGER) AS month, (at_us // 86400000000 + 4) % 7 AS weekday, (at_us // 3600000000) % 24 AS hour FROM commits_) WHERE y = 2024)"
_busy = lambda w: f"(SELECT repo, {w}::BIGINT AS busiest_{w} FROM (SELECT repo, {w}, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, {w}) AS rn FROM yc_ GROUP BY 1, 2) WHERE rn = 1)"
KIND = "CASE lower(regexp_extract(f, '{h}', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " ELSE 'other' END"
HEAD_SQL = HEAD.replace("(?:\\(([^)]+)\\))", "(?:\\(([^)]+)\\))")
LOG = f""", lg0_ AS (SELECT *, string_split(coalesce(message, ''), chr(10))[1] AS f FROM commits_), lg_ AS (SELECT hash, author, at_us, CASE WHEN p THEN {KIND.format(h=HEAD_SQL)} ELSE 'other' END AS section, regexp_extract(f, '{HEAD_SQL}', 2) AS scope,
(regexp_extract(f, '{HEAD_SQL}', 3) = '!' OR p AND coalesce(contains(message, 'BREAKING CHANGE'), false)) AS breaking, CASE WHEN p THEN regexp_extract(f, '{HEAD_SQL}', 4) ELSE f END AS description FROM (SELECT *, regexp_matches(f, '{HEAD_SQL}') AS p FROM lg0_))"""
REC = """, rk_ AS (SELECT repo, hash, at_us, lower(coalesce(message, '')) AS m, row_number() OVER (PARTITION BY repo ORDER BY at_us, hash) AS k FROM commits_),
rf_ AS (SELECT *, first_value(CASE WHEN regexp_matches(m, 'fix|patch|restore') THEN at_us END IGNORE NULLS) OVER (PARTITION BY repo ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 49 FOLLOWING) AS fixed FROM rk_),
rec_ AS (SELECT repo, hash, floor(h * 1000 + 0.5) / 1000 AS hours FROM (SELECT repo, hash, (fixed - at_us) / 3600000000.0::DOUBLE AS h FROM rf_ WHERE m LIKE '%revert%') WHERE h > 0 AND h < 720)"""
REL = r""", rt_ AS (SELECT repo, tag, min(at_us) AS at_us FROM (SELECT repo, regexp_extract(refs, 'tag: ([^,\s]+)', 1) AS tag, at_us FROM commits_ WHERE regexp_matches(refs, 'tag: ')) GROUP BY 1, 2),
rel_ AS (SELECT *, lag(at_us) OVER (PARTITION BY repo ORDER BY at_us, tag) AS previous_us FROM rt_),
lt_ AS (SELECT repo, tag, count(*) AS commits, floor(avg((tag_us - at_us) / 3600000000.0::DOUBLE) * 100 + 0.5) / 100 AS hours FROM (SELECT c.repo, c.at_us, t.tag, t.at_us AS tag_us, row_number() OVER (PARTITION BY c.hash ORDER BY t.at_us, t.tag) AS rn FROM commits_ c JOIN rt_ t ON t.repo = c.repo AND t.at_us >= c.at_us) WHERE rn = 1 GROUP BY 1, 2)"""
S52 = AS_OF_US - 52 * 7 * DAY_US
SQL = {
    "s9_commit_scan": sql(f"SELECT hash, repo, at_us FROM {_newest(f'''(SELECT * FROM commits_ WHERE at_us >= {AS_OF_US - 365 * DAY_US} AND lower(coalesce(message, '')) NOT LIKE 'merge %')''', 'repo', 200)}"),
    "s10_commit_files": sql("SELECT hash, count(*) AS files, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM changes_ GROUP BY 1"),
    "s13_repo_stats": sql("SELECT repo, count(*) AS commits, count(DISTINCT author) AS contributors, min(at_us) AS oldest_us, max(at_us) AS newest_us FROM commits_ GROUP BY 1"),
    "a3_file_history": sql(f""", c AS {_newest('changes_', 'file_path', 50)}, p AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY k DESC, last DESC, author NULLS LAST) AS rn FROM (SELECT file_path, author, count(*) AS k, max(at_us) AS last FROM c GROUP BY 1, 2)),
        x AS (SELECT file_path, string_agg(substr(hash, 1, 7), ' ' ORDER BY at_us DESC, hash) AS recent FROM {_newest('changes_', 'file_path', 10)} GROUP BY 1)
        SELECT file_path, sum(k)::BIGINT AS commits, count(*) AS contributors, max(author) FILTER (rn = 1) AS main_author, any_value(recent) AS recent FROM p JOIN x USING (file_path) GROUP BY 1"""),
    "a4_churn": sql(f"SELECT file_path, count(*) AS commits, max(at_us) AS last_us, count(DISTINCT author) AS authors FROM changes_ WHERE {SRC} AND at_us >= {AS_OF_US - 365 * DAY_US} GROUP BY 1"),
    "pf8_hot_files": sql("SELECT file_path, count(*) AS commits FROM commit_files_ GROUP BY 1 HAVING count(*) >= 10"),
    "pf7_churn_scores": sql(f"""SELECT file_path, floor((0.4::DOUBLE * least(c / 50.0::DOUBLE, 1.0) + 0.3::DOUBLE * least(k / 5.0::DOUBLE, 1.0) + 0.3::DOUBLE * greatest(0.0, 1 - d / 180.0::DOUBLE)) * 10000 + 0.5) / 10000 AS score FROM (
        SELECT file_path, count(*) AS c, count(DISTINCT author) AS k, ({AS_OF_US} - max(at_us)) // 86400000000 AS d FROM changes_ GROUP BY 1)"""),
    "pf6_estimated_history": sql("""SELECT id, contributor, i AS place, greatest(1, floor(coalesce(modification_count, 0)::DOUBLE / (i + 1) + 0.5))::BIGINT AS commits, floor(100.0::DOUBLE / (i + 1) + 0.5)::BIGINT AS share
        FROM (SELECT id, modification_count, unnest(contributors) AS contributor, unnest(range(len(contributors))) AS i FROM files_ WHERE len(contributors) > 0) WHERE contributor IS NOT NULL"""),
    "a5_ownership": sql(OWN + " SELECT * FROM own_"),
    "a7_overall_bus_factor": sql(OWN + " SELECT coalesce(floor(sum(w * bus_factor) / sum(w) * 10 + 0.5) / 10, 0) AS bus_factor, count(*) AS files FROM (SELECT bus_factor, CASE risk WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM own_)"),
    "a8_ownership_distribution": sql(OWN + " SELECT owner, count(*) AS files, floor(100.0::DOUBLE * count(*) / (SELECT count(*) FROM own_) + 0.5)::BIGINT AS share FROM own_ GROUP BY 1 ORDER BY files DESC, owner NULLS LAST LIMIT 10"),
    "a9_directory_knowledge": sql(OWN + f", d AS (SELECT {DIR_SQL.format('file_path')} AS directory, owner, count(*) AS k FROM own_ GROUP BY 1, 2), e AS (SELECT *, sum(k) OVER (PARTITION BY directory) AS files FROM d) SELECT directory, max(files)::BIGINT AS files, count(*) AS owners, greatest(1, count(*) FILTER (k >= 0.2 * files)) AS bus_factor FROM e GROUP BY 1"),
    "a10_area_bus_factors": sql(AREAS + " SELECT repo, area, bus_factor, leader, share, contributors, files, lines, criticality FROM area_"),
    "a11_bus_factor_summary": sql(AREAS + """ SELECT repo, overall, solo_lines, at_risk, CASE WHEN overall >= 3 AND at_risk < 10 THEN 'healthy' WHEN overall >= 2 AND at_risk < 25 THEN 'concerning' WHEN overall >= 1.5 OR at_risk < 50 THEN 'dangerous' ELSE 'critical' END AS level FROM (
        SELECT repo, coalesce(floor(sum(bus_factor * lines)::DOUBLE / nullif(sum(lines), 0) * 10 + 0.5) / 10, floor(avg(bus_factor) * 10 + 0.5) / 10) AS overall, coalesce(sum(lines) FILTER (bus_factor = 1), 0)::BIGINT AS solo_lines,
        floor(100.0::DOUBLE * coalesce(sum(lines) FILTER (bus_factor = 1), 0) / greatest(1, sum(lines)) + 0.5)::BIGINT AS at_risk FROM area_ GROUP BY 1)"""),
    "a12_knowledge_map": sql(SHARES + """, b AS (SELECT repo, area, greatest(1, count(*) FILTER (least(100, share) >= 20)) AS b FROM sh_ GROUP BY 1, 2), t AS (SELECT *, least(100, share) AS score, row_number() OVER (PARTITION BY repo, author ORDER BY least(100, share) DESC, area) AS place FROM sh_ WHERE author IS NOT NULL)
        SELECT repo, author, area, score, CASE WHEN b = 1 THEN 'solo' WHEN b = 2 THEN 'pair' WHEN b <= 4 THEN 'team' ELSE 'distributed' END AS coverage FROM t JOIN b USING (repo, area) WHERE place <= 3"""),
    "a13_experts": sql(EXP + " SELECT * FROM ex_"),
    "j17_related_experts": sql(EXP + f""", d AS (SELECT *, {DIR_SQL.format('file_path')} AS directory FROM changes_ WHERE {SRC}), l AS (SELECT directory, author FROM (SELECT directory, author, row_number() OVER (PARTITION BY directory ORDER BY count(*) DESC, author NULLS LAST) AS rn FROM d GROUP BY 1, 2) WHERE rn = 1 AND author IS NOT NULL)
        SELECT DISTINCT d.file_path, l.author FROM d JOIN l USING (directory) WHERE NOT EXISTS (SELECT 1 FROM ex_ x WHERE x.expertise = 'primary' AND x.file_path = d.file_path AND x.author = l.author)"""),
    "a14_reviewers": sql(f""", t AS {_newest('commits_', 'repo', 20)}, f AS (SELECT t.hash, t.author AS own, file_path FROM commit_files_ JOIN t USING (hash)), z AS (SELECT hash, count(*) AS files FROM f GROUP BY 1),
        k AS (SELECT file_path, author, count(*) AS k, max(at_us) AS last FROM {_newest('changes_', 'file_path', 50)} GROUP BY 1, 2),
        c AS (SELECT hash, k.author, count(*) AS known, sum(k)::BIGINT AS commits, max(last) AS last FROM f JOIN k USING (file_path) WHERE k.author IS DISTINCT FROM own AND k.author IS NOT NULL GROUP BY 1, 2)
        SELECT hash, author, known, commits, floor(50.0::DOUBLE * known / files + 30 * least(commits / 20.0::DOUBLE, 1.0) + CASE WHEN last > {AS_OF_US - 30 * DAY_US} THEN 20 ELSE 0 END + 0.5)::BIGINT AS score FROM c JOIN z USING (hash)"""),
    "a15_leaderboard": sql(BOARD + " SELECT * FROM lb_"),
    "a15_leaders": sql(BOARD + " SELECT row_number() OVER (ORDER BY points DESC, author) AS rank, author, points FROM lb_ QUALIFY rank <= 20"),
    "a16_habits": sql(HABITS + " SELECT * FROM hb_"),
    "a16_awards": sql(HABITS + ", l AS (" + " UNION ALL ".join(f"SELECT author, '{c}' AS award, {c}::DOUBLE AS value FROM hb_" for c in ("commits", "weekend", "late", "fixes", "reverts", "mean_lines")) + ") SELECT author, award, value FROM l QUALIFY row_number() OVER (PARTITION BY award ORDER BY value DESC, author DESC) = 1"),
    "a18_streaks": sql(f""", d AS (SELECT DISTINCT author, at_us // 86400000000 AS day FROM commits_ WHERE author IS NOT NULL), i AS (SELECT author, day - row_number() OVER (PARTITION BY author ORDER BY day) AS island, day FROM d), r AS (SELECT author, island, count(*) AS length, max(day) AS last FROM i GROUP BY 1, 2)
        SELECT author, max(length) AS longest, coalesce(max(length) FILTER (last >= {AS_OF_US // DAY_US - 1}), 0) AS current, sum(length)::BIGINT AS days FROM r GROUP BY 1"""),
    "a17_wrapped": sql(YEAR + f""" SELECT b.*, l.added, l.removed, m.busiest_month, w.busiest_weekday, h.busiest_hour FROM (SELECT repo, count(*) AS commits, count(DISTINCT author) AS authors, count(*) FILTER (hour <= 4) AS nights, count(*) FILTER (weekday IN (0, 6)) AS weekends FROM yc_ GROUP BY 1) b
        LEFT JOIN (SELECT repo, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM commit_files_ JOIN yc_ USING (hash) GROUP BY 1) l USING (repo) JOIN {_busy('month')} m USING (repo) JOIN {_busy('weekday')} w USING (repo) JOIN {_busy('hour')} h USING (repo)"""),
    "a17_wrapped_top": sql(YEAR + " SELECT repo, author, commits, share FROM (SELECT repo, author, count(*) AS commits, floor(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY repo) + 0.5)::BIGINT AS share, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, author) AS rn FROM yc_ WHERE author IS NOT NULL GROUP BY 1, 2) WHERE rn <= 5"),
    "a19_origin": sql(f"SELECT repo, author, commits, first_us, first_us <= start + {30 * DAY_US} AS founder FROM (SELECT repo, author, count(*) AS commits, min(at_us) AS first_us, min(min(at_us)) OVER (PARTITION BY repo) AS start, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, author) AS rn FROM commits_ WHERE author IS NOT NULL GROUP BY 1, 2) WHERE rn <= 10"),
    "a19_milestones": sql(r"SELECT repo, at_us, 'tag' AS kind, regexp_extract(refs, 'tag: ([^,\s]+)', 1) AS name FROM commits_ WHERE regexp_matches(refs, 'tag: ') UNION ALL SELECT repo, min(at_us), 'join', author FROM commits_ WHERE author IS NOT NULL GROUP BY repo, author"),
    "a20_morning": sql(f"""SELECT repo, count(DISTINCT hash) FILTER (at_us >= 1751328000000000 - 86400000000) AS commits, count(DISTINCT file_path) FILTER (at_us >= 1751328000000000 - 86400000000) AS files, count(DISTINCT author) FILTER (at_us >= 1751328000000000 - 86400000000) AS contributors,
        count(DISTINCT hash) AS week_commits, count(DISTINCT file_path) AS week_files FROM changes_ WHERE at_us >= {AS_OF_US - 7 * DAY_US} GROUP BY 1"""),
    "a20_week_hot_files": sql(f", c AS {_newest(f'(SELECT * FROM commits_ WHERE at_us >= 1751328000000000 - 7 * 86400000000)', 'repo', 50)} SELECT repo, file_path, changes FROM (SELECT c.repo, file_path, count(*) AS changes, row_number() OVER (PARTITION BY c.repo ORDER BY count(*) DESC, file_path) AS rn FROM commit_files_ JOIN c USING (hash) GROUP BY 1, 2) WHERE rn <= 3"),
    "a28_departed": sql(f"SELECT file_path, count(*) AS commits, count(DISTINCT author) AS authors, min(at_us) AS first_us, max(at_us) AS last_us, ((max(at_us) - min(at_us)) // 86400000000)::BIGINT AS days FROM changes_ WHERE {SRC} AND file_path NOT IN (SELECT file_path FROM files_) GROUP BY 1"),
    "a28_obituaries": sql(f"SELECT file_path, count(*) AS commits, count(DISTINCT author) AS authors, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, (({AS_OF_US} - min(at_us)) // 86400000000)::BIGINT AS age FROM changes_ GROUP BY 1"),
    "a27_archaeology": sql(f""", c AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY at_us, hash DESC) AS rn FROM {_newest('changes_', 'file_path', 100)}),
        g AS (SELECT file_path, count(*) AS commits, count(*) FILTER (added + removed > 50 AND removed > added / 2 AND rn > 1) AS rewrites, count(*) FILTER (added > 2 * removed) AS grow, count(*) FILTER (removed > 2 * added) AS shrink, (({AS_OF_US} - min(at_us)) // 86400000000)::BIGINT AS age FROM c GROUP BY 1)
        SELECT file_path, commits, rewrites, age, CASE WHEN grow >= 0.4 * commits THEN 'growing' WHEN shrink >= 0.4 * commits THEN 'shrinking' WHEN grow + shrink <= 0.2 * commits THEN 'steady' ELSE 'mixed' END AS growth, floor(commits / greatest(1.0, age / 30.0::DOUBLE) * 10 + 0.5) / 10 AS volatility FROM g"""),
    "pf18_changelog": sql(LOG + " SELECT hash, section, scope, breaking, description FROM lg_"),
    "a26_changelog_stats": sql(LOG + " SELECT section, count(*) AS commits, count(*) FILTER (breaking) AS breaking, count(DISTINCT author) AS contributors, min(at_us) AS from_us, max(at_us) AS to_us FROM lg_ GROUP BY 1"),
    "j13_recoveries": sql(REC + " SELECT * FROM rec_"),
    "j14_releases": sql(REL + " SELECT repo, tag, at_us, coalesce(previous_us, -1) AS previous_us FROM rel_"),
    "j14_lead_times": sql(REL + " SELECT * FROM lt_"),
    "a23_delivery": sql(REC + REL + f""", c AS (SELECT repo, count(*) AS commits, count(*) FILTER (starts_with(m, 'revert') OR contains(m, 'revert "')) AS reverts, count(*) FILTER (starts_with(m, 'merge') OR coalesce(regexp_matches(refs, 'main|master'), false)) AS merges FROM (SELECT *, lower(coalesce(message, '')) AS m FROM commits_ WHERE at_us >= {S52}) GROUP BY 1),
        j AS (SELECT c.repo, commits, coalesce(tags, 0) AS tags, coalesce(tags, 0) / 52.0::DOUBLE AS pw, coalesce(lead, CASE WHEN tags > 0 THEN {52 * 168.0} / tags / 2 END, 0) AS lead, 100.0::DOUBLE * reverts / greatest(merges, coalesce(tags, 0), 1) AS fr, coalesce(rec, CASE WHEN reverts > 0 THEN 24.0 END, 0)::DOUBLE AS rec FROM c
        LEFT JOIN (SELECT repo, count(*) AS tags FROM rel_ WHERE at_us >= {S52} GROUP BY 1) USING (repo) LEFT JOIN (SELECT repo, avg(hours) AS lead FROM lt_ JOIN (SELECT repo, tag FROM rel_ WHERE at_us >= {S52}) USING (repo, tag) GROUP BY 1) USING (repo)
        LEFT JOIN (SELECT rec_.repo, avg(hours) AS rec FROM rec_ JOIN commits_ USING (hash) WHERE commits_.at_us >= {S52} GROUP BY 1) USING (repo))
        SELECT repo, commits, tags, floor(pw * 1000 + 0.5) / 1000 AS per_week, floor(lead * 10 + 0.5) / 10 AS lead_hours, floor(fr * 100 + 0.5) / 100 AS failure_rate, floor(rec * 10 + 0.5) / 10 AS recovery_hours, CASE WHEN mean >= 3.5 THEN 'elite' WHEN mean >= 2.5 THEN 'high' WHEN mean >= 1.5 THEN 'medium' ELSE 'low' END AS level
        FROM (SELECT *, (CASE WHEN pw >= 7 THEN 4 WHEN pw >= 1 THEN 3 WHEN pw >= 0.25 THEN 2 ELSE 1 END + CASE WHEN lead <= 1 THEN 4 WHEN lead <= 168 THEN 3 WHEN lead <= 720 THEN 2 ELSE 1 END + CASE WHEN fr <= 5 THEN 4 WHEN fr <= 10 THEN 3 WHEN fr <= 15 THEN 2 ELSE 1 END + CASE WHEN rec <= 1 THEN 4 WHEN rec <= 24 THEN 3 WHEN rec <= 168 THEN 2 ELSE 1 END) / 4.0 AS mean FROM j)"""),
}
