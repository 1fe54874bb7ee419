"""Hotspots and time series: percentile ranks, regression, projections, velocity, periods, snapshot differences, debt, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..relations import AS_OF_US, DAY_US, SOURCE, Relations, clamp, js_round, n, path_dir, r2, sql
from .complexity import report
from .graph import DRIFT, USED, dead_by_name, drift
from .history import OWN, ownership

# ---- hotspots ----


def percentile_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """round(100 * share of rows with a value up to the row's), as a further column.

    The values are counted first, so that the running total goes over distinct values and not over all rows.
    """
    counts = df.groupBy(column).agg(n().alias("_k"))
    run = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranks = counts.withColumn(name, js_round(100.0 * F.sum("_k").over(run) / F.sum("_k").over(all_rows))).drop("_k")
    return df.join(ranks, column)


def file_hotspots(r: Relations, weeks: int = 52) -> DataFrame:
    """Every file's percentiles of complexity and churn, its score (geometric mean), priority, quadrant and debt.

    The percentiles are over all files, those without churn included; files with neither drop out afterwards.
    """
    since = r.as_of_us - weeks * 7 * DAY_US
    c = r.changes.where((F.col("at_us") >= since) & F.col("file_path").rlike(SOURCE)).groupBy("file_path").agg(n().alias("k"))
    f = r.files.select("file_path", F.coalesce("complexity", F.lit(0)).alias("c")).join(c, "file_path", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    f = percentile_ranks(percentile_ranks(f, "c", "complexity"), "k", "churn").where("c > 0 OR k > 0")
    f = f.withColumn("score", js_round(F.sqrt(F.col("complexity").cast("double") * F.col("churn"))))
    p = F.when(F.col("score") >= 75, "critical").when(F.col("score") >= 50, "high").when(F.col("score") >= 25, "medium").otherwise("low")
    f = f.withColumn("priority", p)
    factor = F.when(F.col("priority") == "critical", 2.0).when(F.col("priority") == "high", 1.5).when(F.col("priority") == "medium", 1.0).otherwise(0.5)
    side = lambda c: F.when(F.col(c) >= 50, "high").otherwise("low")
    return f.select(
        "file_path", "complexity", "churn", r2(F.col("k") / float(max(weeks, 1)), 1).alias("churn_rate"), "score", "priority",
        F.concat(side("complexity"), F.lit("_complexity_"), side("churn"), F.lit("_churn")).alias("quadrant"), js_round(F.col("complexity") / 10.0 * factor).alias("debt_hours"),
    )


def hotspots(r: Relations, top: int = 20, weeks: int = 52) -> DataFrame:
    """W2/O1, the flagship: the files with the highest hotspot scores; ties go by path."""
    return file_hotspots(r, weeks).orderBy(F.desc("score"), "file_path").limit(top).select("file_path", "complexity", "churn", "churn_rate", "score", "priority", "debt_hours")


def hotspot_summary(r: Relations, top: int = 20) -> DataFrame:
    """Critical and high ones and hours of debt among the top files only."""
    return hotspots(r, top).agg(F.count_if(F.col("priority") == "critical").alias("critical"), F.count_if(F.col("priority") == "high").alias("high"), F.coalesce(F.sum("debt_hours"), F.lit(0)).alias("hours"))


def quadrants(r: Relations) -> DataFrame:
    """Files per quadrant, before the top is taken."""
    return file_hotspots(r).groupBy("quadrant").agg(n().alias("files"))


# ---- snapshots as a time series ----


def snapshots(r: Relations) -> DataFrame:
    """A snapshot per day of the events: health, average complexity, hotspots and files."""
    e = r.raw("events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY_US).cast("bigint").alias("day"), "user_id", "event_type", "value")
    return e.groupBy("day").agg(
        clamp(F.floor(F.avg("value"))).cast("bigint").alias("health"), r2(F.avg("value") / 10).alias("average"), F.count_if(F.col("event_type") == "error").alias("hotspots"), F.countDistinct("user_id").alias("files")
    )


def percent_change(before, after):
    """From 0 it is 100, or 0 if nothing changed."""
    return F.when(before == 0, F.when(after == 0, 0).otherwise(100)).otherwise(js_round(100.0 * F.try_divide(after - before, before))).cast("bigint")


def differences(r: Relations) -> DataFrame:
    """Each snapshot against the one before. One row a day: the window is over days, not events."""
    w = Window.orderBy("day")
    s = snapshots(r)
    back = {c: F.lag(c).over(w) for c in ("health", "average", "hotspots", "files")}
    s = s.select("day", *[F.col(c) for c in back], *[v.alias(f"b_{c}") for c, v in back.items()]).where("b_health IS NOT NULL")
    return s.select(
        "day", (F.col("health") - F.col("b_health")).alias("health_change"), r2(F.col("average") - F.col("b_average")).alias("average_change"), (F.col("hotspots") - F.col("b_hotspots")).alias("hotspots_change"),
        (F.col("files") - F.col("b_files")).alias("files_change"), percent_change(F.col("b_health"), F.col("health")).alias("percent"), (F.col("health") > F.col("b_health")).alias("improving"),
    )


def metric_changes(r: Relations) -> DataFrame:
    """(day, metric, before, after, change) for each of the ten metrics of a snapshot against the one before: files, lines,
    average and highest complexity, hotspots, health, and how many are of low, medium, high and very high complexity.

    Snapshots are days of the events; ten rows a day, so that the window is over days.
    """
    c = F.col("value") / 10
    e = r.raw("events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY_US).cast("bigint").alias("day"), "user_id", "event_type", "value")
    s = e.groupBy("day").agg(
        F.countDistinct("user_id").alias("files"), n().alias("lines"), r2(F.avg("value") / 10).alias("average"), r2(F.max("value") / 10).alias("most"), F.count_if(F.col("event_type") == "error").alias("hotspots"),
        clamp(F.floor(F.avg("value"))).alias("health"), F.count_if(c <= 5).alias("low"), F.count_if((c > 5) & (c <= 10)).alias("medium"), F.count_if((c > 10) & (c <= 20)).alias("high"), F.count_if(c > 20).alias("very_high"),
    )
    names = [x for x in s.columns if x != "day"]
    rows = s.select("day", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("v")) for x in names])).alias("m")).select("day", "m.*")
    b = rows.withColumn("before", F.lag("v").over(Window.partitionBy("metric").orderBy("day"))).where("before IS NOT NULL")
    return b.select("day", "metric", "before", F.col("v").alias("after"), r2(F.col("v") - F.col("before")).alias("change"))


def regression(r: Relations) -> DataFrame:
    """Least squares of health over weeks since the first snapshot; one point gives slope 0 and r2 1, none zeros."""
    s = snapshots(r)
    first = s.agg(F.min("day").alias("d0"))
    x = s.crossJoin(F.broadcast(first)).select(((F.col("day") - F.col("d0")) / 7.0).alias("w"), F.col("health").cast("double").alias("h"))  # against one row
    a = x.agg(n().alias("points"), F.regr_slope("h", "w").alias("s"), F.regr_intercept("h", "w").alias("i"), F.regr_r2("h", "w").alias("q"), F.max("h").alias("only"))
    few = F.col("points") < 2
    return a.select(
        "points", r2(F.when(few, 0.0).otherwise(F.coalesce("s", F.lit(0.0))), 4).alias("slope"), r2(F.when(few, F.coalesce("only", F.lit(0.0))).otherwise(F.col("i")), 4).alias("intercept"),
        r2(F.when(F.col("points") == 0, 0.0).when(few, 1.0).otherwise(F.coalesce("q", F.lit(1.0))), 4).alias("r2"),
    )


def trajectory(r: Relations) -> DataFrame:
    """Health in 1, 4 and 12 weeks, likely, best and worst, with the confidence of each. The rate is held to 50 either way."""
    s = snapshots(r)
    last = s.agg(F.max_by("health", "day").alias("now"), (F.max("day") - F.min("day")).alias("span"))
    b = regression(r).crossJoin(last).withColumn("rate", F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("slope"))))  # single rows
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("weeks"), F.lit(k).alias("scenario"), F.lit(v).alias("side")) for w in (1, 4, 12) for k, v in (("likely", 0.0), ("best", 0.5), ("worst", -0.5))]))
    x = b.select("*", rows.alias("x")).select("*", "x.weeks", "x.scenario", "x.side")
    span = F.greatest(F.lit(1), F.col("span"))
    conf = 90 - F.when(F.col("points") < 5, (5 - F.col("points")) * 10).otherwise(0) - F.when(span < 14, (14 - span) * 2).otherwise(0) - F.when(F.col("r2") < 0.7, (0.7 - F.col("r2")) * 30).otherwise(0) - F.col("weeks") * 5
    trend = F.when(F.col("rate") >= 2, "improving").when(F.col("rate") >= -1, "stable").when(F.col("rate") >= -5, "declining").otherwise("critical")
    health = js_round(F.col("now") + F.col("rate") * F.col("weeks") + F.abs(F.col("rate")) * F.col("side") * F.col("weeks"))
    return x.select(F.col("weeks").cast("bigint").alias("weeks"), "scenario", F.greatest(F.lit(0), F.least(F.lit(100), health)).cast("bigint").alias("health"), F.greatest(F.lit(10), F.least(F.lit(100), js_round(conf))).cast("bigint").alias("confidence"), trend.alias("trend"))


def velocity(r: Relations) -> DataFrame:
    """Weekly change of every file's complexity, estimated from the first and last snapshot's averages, with its trend."""
    s = snapshots(r).agg(F.min_by("average", "day").alias("old"), F.max_by("average", "day").alias("new"), F.greatest(F.lit(1), F.max("day") - F.min("day")).alias("days"), n().alias("k"))
    f = r.files.where("complexity IS NOT NULL").select("file_path", F.col("complexity").cast("double").alias("c")).crossJoin(F.broadcast(s)).where("k >= 2")  # against one row
    before = F.when(F.col("new") == 0, F.col("c")).otherwise(r2(F.col("c") * F.try_divide(F.col("old"), F.col("new"))))
    f = f.withColumn("per_week", r2((F.col("c") - before) / (F.col("days") / 7.0)))
    trend = F.when(F.col("per_week") <= -5, "improving").when(F.col("per_week") <= 2, "stable").when(F.col("per_week") <= 10, "degrading").otherwise("critical")
    return f.select("file_path", "per_week", trend.alias("trend"))


def velocity_summary(r: Relations, days: int = 30) -> DataFrame:
    """One row: the files' summed complexity and its change a week, the trend, and the complexity projected 30 days on.

    Without two snapshots nothing changes.
    """
    v = velocity(r).agg(n().alias("files"))
    s = snapshots(r).agg(F.min_by("average", "day").alias("old"), F.max_by("average", "day").alias("new"), F.greatest(F.lit(1), F.max("day") - F.min("day")).alias("days"), n().alias("k"))
    f = r.files.where("complexity IS NOT NULL").select(F.col("complexity").cast("double").alias("c")).crossJoin(F.broadcast(s))  # against one row
    before = F.when((F.col("new") == 0) | (F.col("k") < 2), F.col("c")).otherwise(r2(F.col("c") * F.try_divide(F.col("old"), F.col("new"))))
    # in hundredths, so that the sum is the same in any order
    moved = F.sum(F.floor((F.col("c") - before) * 100 + 0.5).cast("bigint")) / 100.0
    a = f.agg(F.coalesce(F.sum(F.col("c").cast("bigint")), F.lit(0)).alias("total"), F.coalesce(r2(moved / (F.max("days") / 7.0)), F.lit(0.0)).alias("per_week"))
    trend = F.when(F.col("per_week") <= -5, "improving").when(F.col("per_week") <= 2, "stable").when(F.col("per_week") <= 10, "degrading").otherwise("critical")
    return v.crossJoin(a).select("files", "total", "per_week", trend.alias("trend"), js_round(F.col("total") + F.col("per_week") * (days / 7.0)).alias("projected"))  # single rows


def period_trends(r: Relations) -> DataFrame:
    """First against last snapshot of the last week, month (30 days) and all time; better or worse from three points on."""
    s = snapshots(r)
    end = s.agg(F.max("day").alias("end"))
    x = s.crossJoin(F.broadcast(end)).select(  # against one row
        "day", "health", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), (F.col("day") > F.col("end") - d).alias("in")) for p, d in (("day", 1), ("week", 7), ("month", 30), ("all", 1_000_000))])).alias("x")
    )
    g = x.where("x.in").groupBy(F.col("x.period").alias("period")).agg(F.min_by("health", "day").alias("first"), F.max_by("health", "day").alias("last"), n().alias("k"))
    d = F.col("last") - F.col("first")
    return g.select("period", F.when(F.col("k") < 2, "stable").when(d > 2, "improving").when(d < -2, "declining").otherwise("stable").alias("direction"), F.when(F.col("k") < 2, 0).otherwise(percent_change(F.col("first"), F.col("last"))).cast("bigint").alias("percent"))


def health_history(r: Relations, last: int = 10) -> DataFrame:
    """The last ten health values as one text, and a label for the time they span."""
    newest = snapshots(r).orderBy(F.desc("day")).limit(last)
    g = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "health"))), lambda x: x.health.cast("string")), " ").alias("history"), (F.max("day") - F.min("day")).alias("days"), n().alias("k"))
    d = F.col("days")
    label = F.when(F.col("k") == 0, "no history").when(F.col("k") == 1, "1 snapshot").when(d == 0, "today").when(d == 1, "1 day").when(d < 7, F.concat(d.cast("string"), F.lit(" days")))
    label = label.when(d < 30, F.concat(F.floor(d / 7).cast("string"), F.when(d >= 14, " weeks").otherwise(" week"))).otherwise(F.concat(F.floor(d / 30).cast("string"), F.when(d >= 60, " months").otherwise(" month")))
    return g.select("history", label.alias("span"))


def debt(r: Relations) -> DataFrame:
    """Facts of technical debt per file in hours: hotspots, single owners, cycles of two and dead exports; the cause that
    comes first in this order gives the file its priority."""
    h = file_hotspots(r).where("score >= 25").select("file_path", F.col("debt_hours").cast("double").alias("hours"), F.lit(1).alias("cause"))
    lines = r.files.select("file_path", "line_count")
    b = ownership(r).where("bus_factor = 1").join(lines, "file_path").select("file_path", r2(F.least(F.lit(40.0), 2 * 40 * F.coalesce("line_count", F.lit(0)) / 1000.0)).alias("hours"), F.lit(2).alias("cause"))
    e = r.file_imports
    c = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").select(F.col("src").alias("file_path"), F.lit(4.0).alias("hours"), F.lit(3).alias("cause"))
    d = dead_by_name(r).groupBy("file_path").agg(n().alias("k")).join(lines, "file_path").select("file_path", r2(F.least(F.lit(10.0), F.col("k") / F.greatest(F.lit(1.0), F.coalesce("line_count", F.lit(0)) / 100.0))).alias("hours"), F.lit(4).alias("cause"))
    facts = h.unionByName(b).unionByName(c).unionByName(d)
    names = F.element_at(F.array(*[F.lit(x) for x in ("hotspot", "owner", "cycle", "dead")]), F.min("cause"))
    return facts.groupBy("file_path").agg(r2(F.sum("hours")).alias("hours"), n().alias("facts"), names.alias("priority"))


def overview(r: Relations) -> DataFrame:
    """The independent analyses in one row: complexity, hotspots, owners, drift, dead exports, and labels for them."""
    c = report(r).select("average", F.greatest(F.lit(0.0), 100 - 5 * F.col("average")).alias("health"))
    h = hotspot_summary(r)
    o = ownership(r).agg(r2(F.avg("bus_factor"), 1).alias("bus_factor"))
    v = drift(r).agg(n().alias("violations"))
    d = dead_by_name(r).agg(n().alias("dead_exports"))
    one = c.crossJoin(h.select("critical", "high")).crossJoin(o).crossJoin(v).crossJoin(d)  # single rows
    return one.withColumn("label", F.when(F.col("health") >= 80, "healthy").when(F.col("health") >= 60, "fair").otherwise("poor")).withColumn(
        "ownership", F.when(F.col("bus_factor") >= 3, "good").when(F.col("bus_factor") >= 2, "fair").otherwise("risky")
    )


def moods(r: Relations) -> DataFrame:
    """Mood of every directory by the health of its files, and how strong it is."""
    g = r.files.where("complexity IS NOT NULL").groupBy(path_dir("file_path").alias("directory")).agg(F.greatest(F.lit(0.0), 100 - 5 * r2(F.avg("complexity"))).alias("health"))
    h = F.col("health")
    return g.select("directory", F.when(h > 90, "happy").when(h > 70, "content").when(h > 50, "worried").otherwise("grumpy").alias("mood"), r2(F.when(h > 50, (h - 50) / 50).otherwise((50 - h) / 50)).alias("intensity"))


def _q(f, *a, **k):
    return lambda spark, d: f(Relations(spark, d), *a, **k)


QUERIES = {
    "w2_hotspots": _q(hotspots), "w1_percentiles": _q(file_hotspots), "w2_summary": _q(hotspot_summary), "w2_quadrants": _q(quadrants), "r10_snapshots": _q(snapshots), "w7_differences": _q(differences), "w3_regression": _q(regression),
    "w4_trajectory": _q(trajectory), "w5_velocity": _q(velocity), "w5_summary": _q(velocity_summary), "w7_metrics": _q(metric_changes), "w6_period_trends": _q(period_trends), "w12_health_history": _q(health_history), "a24_debt": _q(debt), "a29_overview": _q(overview), "pf21_moods": _q(moods),
}

HOT = f""", hc_ AS (SELECT file_path, count(*) AS k FROM changes_ WHERE regexp_matches(file_path, '\\.(ts|tsx|js|jsx)$') AND at_us >= {AS_OF_US - 52 * 7 * DAY_US} GROUP BY 1), hf_ AS (SELECT file_path, coalesce(complexity, 0) AS c, coalesce(k, 0) AS k FROM files_ LEFT JOIN hc_ USING (file_path)),
hp_ AS (SELECT *, floor(100 * cume_dist() OVER (ORDER BY c) + 0.5)::BIGINT AS complexity, floor(100 * cume_dist() OVER (ORDER BY k) + 0.5)::BIGINT AS churn FROM hf_), hs_ AS (SELECT *, floor(sqrt(complexity::DOUBLE * churn) + 0.5)::BIGINT AS score FROM hp_ WHERE c > 0 OR k > 0),
ht_ AS (SELECT *, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS priority FROM hs_),
hot_ AS (SELECT file_path, complexity, churn, floor(k / 52.0::DOUBLE * 10 + 0.5) / 10 AS churn_rate, score, priority, CASE WHEN complexity >= 50 THEN 'high' ELSE 'low' END || '_complexity_' || CASE WHEN churn >= 50 THEN 'high' ELSE 'low' END || '_churn' AS quadrant,
floor(complexity / 10.0::DOUBLE * CASE priority WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 WHEN 'medium' THEN 1.0 ELSE 0.5 END + 0.5)::BIGINT AS debt_hours FROM ht_), top_ AS (SELECT * FROM hot_ ORDER BY score DESC, file_path LIMIT 20)"""
SNAP = ", sn_ AS (SELECT epoch_us(ts) // 86400000000 AS day, greatest(0, least(100, floor(avg(value))))::BIGINT AS health, floor(avg(value) / 10 * 100 + 0.5) / 100 AS average, count(*) FILTER (event_type = 'error') AS hotspots, count(DISTINCT user_id) AS files FROM events GROUP BY 1)"
REG = SNAP + """, rg0_ AS (SELECT (day - (SELECT min(day) FROM sn_)) / 7.0::DOUBLE AS w, health::DOUBLE AS h FROM sn_), rg_ AS (SELECT count(*) AS points, floor(coalesce(regr_slope(h, w), 0) * 10000 + 0.5) / 10000 AS slope, floor(regr_intercept(h, w) * 10000 + 0.5) / 10000 AS intercept, floor(coalesce(regr_r2(h, w), 1) * 10000 + 0.5) / 10000 AS r2 FROM rg0_)"""
METRICS = """, en_ AS (SELECT epoch_us(ts) // 86400000000 AS day, user_id, event_type, value FROM events), mt_ AS (FROM (SELECT day, count(DISTINCT user_id)::DOUBLE AS files, count(*)::DOUBLE AS lines, floor(avg(value) / 10 * 100 + 0.5) / 100 AS average, floor(max(value) / 10 * 100 + 0.5) / 100 AS most,
(count(*) FILTER (event_type = 'error'))::DOUBLE AS hotspots, greatest(0, least(100, floor(avg(value))))::DOUBLE AS health, (count(*) FILTER (value <= 50))::DOUBLE AS low, (count(*) FILTER (value > 50 AND value <= 100))::DOUBLE AS medium, (count(*) FILTER (value > 100 AND value <= 200))::DOUBLE AS high,
(count(*) FILTER (value > 200))::DOUBLE AS very_high FROM en_ GROUP BY day) UNPIVOT INCLUDE NULLS (v FOR metric IN (files, lines, average, most, hotspots, health, low, medium, high, very_high)))"""
PCT = "CASE WHEN {0} = 0 THEN CASE WHEN {1} = 0 THEN 0 ELSE 100 END ELSE floor(100.0::DOUBLE * ({1} - {0}) / {0} + 0.5) END::BIGINT"
SQL = {
    "w2_hotspots": sql(HOT + " SELECT file_path, complexity, churn, churn_rate, score, priority, debt_hours FROM top_"),
    "w1_percentiles": sql(HOT + " SELECT * FROM hot_"),
    "w2_summary": sql(HOT + " SELECT count(*) FILTER (priority = 'critical') AS critical, count(*) FILTER (priority = 'high') AS high, coalesce(sum(debt_hours), 0)::BIGINT AS hours FROM top_"),
    "w2_quadrants": sql(HOT + " SELECT quadrant, count(*) AS files FROM hot_ GROUP BY 1"),
    "r10_snapshots": sql(SNAP + " SELECT * FROM sn_"),
    "w7_differences": sql(SNAP + f""", b AS (SELECT *, lag(health) OVER w AS bh, lag(average) OVER w AS ba, lag(hotspots) OVER w AS bs, lag(files) OVER w AS bf FROM sn_ WINDOW w AS (ORDER BY day))
        SELECT day, health - bh AS health_change, floor((average - ba) * 100 + 0.5) / 100 AS average_change, hotspots - bs AS hotspots_change, files - bf AS files_change, {PCT.format('bh', 'health')} AS percent, health > bh AS improving FROM b WHERE bh IS NOT NULL"""),
    "w3_regression": sql(REG + " SELECT * FROM rg_"),
    "w4_trajectory": sql(REG + """, l AS (SELECT arg_max(health, day) AS now, max(day) - min(day) AS span FROM sn_), b AS (SELECT *, greatest(-50.0, least(50.0, slope)) AS rate FROM rg_, l),
        x AS (SELECT * FROM b, (VALUES (1), (4), (12)) w(weeks), (VALUES ('likely', 0.0), ('best', 0.5), ('worst', -0.5)) s(scenario, side))
        SELECT weeks::BIGINT AS weeks, scenario, greatest(0, least(100, floor(now + rate * weeks + abs(rate) * side * weeks + 0.5)))::BIGINT AS health,
        greatest(10, least(100, floor(90 - CASE WHEN points < 5 THEN (5 - points) * 10 ELSE 0 END - CASE WHEN greatest(1, span) < 14 THEN (14 - greatest(1, span)) * 2 ELSE 0 END - CASE WHEN r2 < 0.7 THEN (0.7::DOUBLE - r2) * 30 ELSE 0 END - weeks * 5 + 0.5)))::BIGINT AS confidence,
        CASE WHEN rate >= 2 THEN 'improving' WHEN rate >= -1 THEN 'stable' WHEN rate >= -5 THEN 'declining' ELSE 'critical' END AS trend FROM x"""),
    "w5_velocity": sql(SNAP + """, s AS (SELECT arg_min(average, day) AS old, arg_max(average, day) AS new, greatest(1, max(day) - min(day)) AS days, count(*) AS k FROM sn_),
        v AS (SELECT file_path, floor((complexity - CASE WHEN new = 0 THEN complexity ELSE floor(complexity * (old / new) * 100 + 0.5) / 100 END) / (days / 7.0::DOUBLE) * 100 + 0.5) / 100 AS per_week FROM files_, s WHERE complexity IS NOT NULL AND k >= 2)
        SELECT *, CASE WHEN per_week <= -5 THEN 'improving' WHEN per_week <= 2 THEN 'stable' WHEN per_week <= 10 THEN 'degrading' ELSE 'critical' END AS trend FROM v"""),
    "w5_summary": sql(SNAP + """, s AS (SELECT arg_min(average, day) AS old, arg_max(average, day) AS new, greatest(1, max(day) - min(day)) AS days, count(*) AS k FROM sn_),
        f AS (SELECT complexity AS c, days, k, floor((complexity - CASE WHEN new = 0 OR k < 2 THEN complexity ELSE floor(complexity * (old / new) * 100 + 0.5) / 100 END) * 100 + 0.5)::BIGINT AS moved FROM files_, s WHERE complexity IS NOT NULL),
        a AS (SELECT count(*) FILTER (k >= 2) AS files, coalesce(sum(c), 0)::BIGINT AS total, coalesce(floor(sum(moved) / 100.0::DOUBLE / (max(days) / 7.0::DOUBLE) * 100 + 0.5) / 100, 0) AS per_week FROM f)
        SELECT *, CASE WHEN per_week <= -5 THEN 'improving' WHEN per_week <= 2 THEN 'stable' WHEN per_week <= 10 THEN 'degrading' ELSE 'critical' END AS trend, floor(total + per_week * (30 / 7.0::DOUBLE) + 0.5)::BIGINT AS projected FROM a"""),
    "w7_metrics": sql(METRICS + """, b AS (SELECT metric, day, v, lag(v) OVER (PARTITION BY metric ORDER BY day) AS p FROM mt_) SELECT day, metric, p AS before, v AS after, floor((v - p) * 100 + 0.5) / 100 AS change FROM b WHERE p IS NOT NULL"""),
    "w6_period_trends": sql(SNAP + f""", g AS (SELECT period, arg_min(health, day) AS f, arg_max(health, day) AS l, count(*) AS k FROM sn_, (VALUES ('day', 1), ('week', 7), ('month', 30), ('all', 1000000)) p(period, d) WHERE day > (SELECT max(day) FROM sn_) - d GROUP BY 1)
        SELECT period, CASE WHEN k < 2 THEN 'stable' WHEN l - f > 2 THEN 'improving' WHEN l - f < -2 THEN 'declining' ELSE 'stable' END AS direction, CASE WHEN k < 2 THEN 0 ELSE {PCT.format('f', 'l')} END::BIGINT AS percent FROM g"""),
    "w12_health_history": sql(SNAP + """, t AS (SELECT * FROM sn_ ORDER BY day DESC LIMIT 10), g AS (SELECT string_agg(health::VARCHAR, ' ' ORDER BY day) AS history, max(day) - min(day) AS d, count(*) AS k FROM t)
        SELECT history, CASE WHEN k = 0 THEN 'no history' WHEN k = 1 THEN '1 snapshot' WHEN d = 0 THEN 'today' WHEN d = 1 THEN '1 day' WHEN d < 7 THEN d || ' days' WHEN d < 30 THEN (d // 7) || CASE WHEN d >= 14 THEN ' weeks' ELSE ' week' END ELSE (d // 30) || CASE WHEN d >= 60 THEN ' months' ELSE ' month' END END AS span FROM g"""),
    "a24_debt": sql(HOT + OWN + USED + """, f AS (SELECT file_path, debt_hours::DOUBLE AS hours, 1 AS cause FROM hot_ WHERE score >= 25 UNION ALL SELECT file_path, floor(least(40.0, 2 * 40 * coalesce(line_count, 0) / 1000.0::DOUBLE) * 100 + 0.5) / 100, 2 FROM own_ JOIN files_ USING (file_path) WHERE bus_factor = 1
        UNION ALL SELECT src, 4.0, 3 FROM file_imports_ WHERE (dst, src) IN (SELECT (src, dst) FROM file_imports_) UNION ALL SELECT file_path, floor(least(10.0, k / greatest(1.0, coalesce(line_count, 0) / 100.0::DOUBLE)) * 100 + 0.5) / 100, 4 FROM (SELECT file_path, count(*) AS k FROM dead_ GROUP BY 1) JOIN files_ USING (file_path))
        SELECT file_path, floor(sum(hours) * 100 + 0.5) / 100 AS hours, count(*) AS facts, ['hotspot', 'owner', 'cycle', 'dead'][min(cause)] AS priority FROM f GROUP BY 1"""),
    "a29_overview": sql(HOT + OWN + USED + DRIFT + """, o AS (SELECT (SELECT floor(avg(complexity) * 100 + 0.5) / 100 FROM symbols_) AS average, (SELECT count(*) FROM top_ WHERE priority = 'critical') AS critical, (SELECT count(*) FROM top_ WHERE priority = 'high') AS high,
        (SELECT floor(avg(bus_factor) * 10 + 0.5) / 10 FROM own_) AS bus_factor, (SELECT count(*) FROM drift_) AS violations, (SELECT count(*) FROM dead_) AS dead_exports), p AS (SELECT *, greatest(0.0, 100 - 5 * average) AS health FROM o)
        SELECT *, CASE WHEN health >= 80 THEN 'healthy' WHEN health >= 60 THEN 'fair' ELSE 'poor' END AS label, CASE WHEN bus_factor >= 3 THEN 'good' WHEN bus_factor >= 2 THEN 'fair' ELSE 'risky' END AS ownership FROM p"""),
    "pf21_moods": sql("""SELECT directory, CASE WHEN h > 90 THEN 'happy' WHEN h > 70 THEN 'content' WHEN h > 50 THEN 'worried' ELSE 'grumpy' END AS mood, floor(CASE WHEN h > 50 THEN (h - 50) / 50 ELSE (50 - h) / 50 END * 100 + 0.5) / 100 AS intensity FROM (
        SELECT CASE WHEN instr(file_path, '/') > 0 THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS directory, greatest(0.0::DOUBLE, 100 - 5 * (floor(avg(complexity) * 100 + 0.5) / 100)) AS h FROM files_ WHERE complexity IS NOT NULL GROUP BY 1)"""),
}
