"""The code graph: construction, degrees, dependents, reachability, cycles, dead code, zones, drift and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components, strongly_connected
from ..relations import AS_OF_US, AREA_SQL, DAY_US, DIR_SQL, Relations, area_of, clamp, js_round, n, path_dir, r2, sql
from ..session import cut, number_rows

# ---- construction ----


def contains_edges(r: Relations) -> DataFrame:
    """An edge from its file to every symbol, numbered in order of insertion; symbols of unknown files have none."""
    s = r.symbols.join(r.files.select(F.col("id").alias("file_path")), "file_path", "left_semi").select(F.col("file_path").alias("source_id"), F.col("id").alias("target_id"), "ord")
    return number_rows(s, "k", "ord", "target_id").select(F.concat(F.lit("contains-"), F.col("k").cast("string")).alias("id"), "source_id", "target_id")


def import_edges(r: Relations) -> DataFrame:
    """One edge per import, not deduplicated, numbered from 0."""
    return number_rows(r.imports.select("src", "dst", F.col("id").alias("key")), "k", "src", "dst", "key").select(
        F.concat(F.lit("import-"), F.col("k").cast("string")).alias("id"), F.col("src").alias("source_id"), F.col("dst").alias("target_id")
    )


def dependency_map(r: Relations) -> DataFrame:
    """Distinct targets per source and, reversed, distinct sources per target, as counts by file and direction."""
    d = r.imports.select("src", "dst").distinct()
    out = d.groupBy(F.col("src").alias("file_path")).agg(n().alias("files")).withColumn("direction", F.lit("imports"))
    return out.unionByName(d.groupBy(F.col("dst").alias("file_path")).agg(n().alias("files")).withColumn("direction", F.lit("imported_by")))


def import_counts(r: Relations) -> DataFrame:
    """Import count of a file: its distinct dependencies, or what the scan counted where it has none."""
    deps = r.imports.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("found"))
    return r.files.join(deps, "id", "left").select("id", F.coalesce("found", F.col("import_count").cast("bigint")).alias("imports"))


def enriched_files(r: Relations) -> DataFrame:
    """Files with what their history tells: last change (UTC day), number of changes, authors by their commits."""
    per = r.changes.groupBy("file_path", "author").agg(n().alias("commits"), F.max("at_us").alias("last"))
    w = Window.partitionBy("file_path").orderBy(F.desc("commits"), F.asc_nulls_last("author"))
    top = per.withColumn("rn", F.row_number().over(w))
    h = top.groupBy("file_path").agg(F.sum("commits").alias("changes"), F.max("last").alias("last"), n("author").alias("authors"), F.max(F.when(F.col("rn") == 1, F.col("author"))).alias("first_author"))
    return r.files.join(h, "file_path", "left").select(
        "id", F.coalesce("changes", F.lit(0)).alias("changes"), F.floor(F.col("last") / DAY_US).alias("last_day"), F.coalesce("authors", F.lit(0)).alias("authors"), "first_author"
    )


def language_histogram(r: Relations) -> DataFrame:
    """Files and lines per language."""
    return r.files.groupBy("language").agg(n().alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("bigint").alias("lines"))


def graph_stats(r: Relations) -> DataFrame:
    """Nodes and edges by type; for nodes the average complexity, files included, and the maximum (-1: none)."""
    nodes = r.nodes.groupBy(F.col("node_type").alias("kind")).agg(n().alias("count"), r2(F.avg("complexity")).alias("average"), F.coalesce(F.max("complexity"), F.lit(-1)).cast("bigint").alias("maximum"))
    edges = r.edges.groupBy(F.col("edge_type").alias("kind")).agg(n().alias("count")).withColumn("average", F.lit(None).cast("double")).withColumn("maximum", F.lit(-1).cast("bigint"))
    return nodes.withColumn("of", F.lit("nodes")).unionByName(edges.withColumn("of", F.lit("edges")))


def update_incremental(old: DataFrame, changed: DataFrame) -> DataFrame:
    """An existing node table with re-scanned rows put in; the row with the highest ord of an id counts."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("ord"))
    return old.unionByName(changed, allowMissingColumns=True).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def scan_errors(r: Relations) -> DataFrame:
    """Errors per file of all runs; paths are made relative, and what concerns no known file counts for its repository."""
    e = r.raw("build_errors").where("error IS NOT NULL").select("repo", F.regexp_replace("file_path", "^/?workspace/", "").alias("file_path"), "error").distinct()
    known = r.files.select("file_path").withColumn("known", F.lit(True))
    return e.join(known, "file_path", "left").groupBy(F.coalesce(F.when(F.col("known"), F.col("file_path")), F.col("repo")).alias("subject")).agg(n().alias("errors"))


# ---- relations between files ----


def resolved_imports(r: Relations) -> DataFrame:
    """Import edges with both ends known, as pairs of paths with the number of edges; dangling ends drop out."""
    f = r.nodes.select("id", "file_path")
    s, t = f.select(F.col("id").alias("src"), F.col("file_path").alias("source_path")), f.select(F.col("id").alias("dst"), F.col("file_path").alias("target_path"))
    return r.imports.join(s, "src").join(t, "dst").groupBy("source_path", "target_path").agg(n().alias("edges"))


def degrees(r: Relations) -> DataFrame:
    """Import edges out of and into every file; edges count, not distinct files."""
    out = r.imports.groupBy(F.col("src").alias("id")).agg(n().alias("o"))
    into = r.imports.groupBy(F.col("dst").alias("id")).agg(n().alias("i"))
    return r.files.select("id").join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def direct_dependents(r: Relations) -> DataFrame:
    """Distinct importers of every file that has any, but itself."""
    return r.file_imports.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(n().alias("dependents"))


def indirect_dependents(r: Relations) -> DataFrame:
    """Files that reach a file over two or three imports and neither are it nor import it directly."""
    e = r.file_imports.where("src <> dst")
    one = e.select(F.col("dst").alias("id"), F.col("src").alias("dep"))
    up = e.select(F.col("dst").alias("dep"), F.col("src").alias("next"))
    seen = one
    level = one
    for _ in range(2):
        level = level.join(up, "dep").select("id", F.col("next").alias("dep")).where("id <> dep").distinct().join(seen, ["id", "dep"], "left_anti")
        seen = seen.union(level)
    return seen.join(one, ["id", "dep"], "left_anti").groupBy("id").agg(n().alias("indirect"))


def coupling_scores(r: Relations) -> DataFrame:
    """Coupling of files that import one another: .3 a direction, .05 a shared dependency or importer up to .2 each."""
    e = r.file_imports.where("src <> dst")
    pairs = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    x, y = e.select(F.col("src").alias("a"), F.col("dst").alias("k")), e.select(F.col("src").alias("b"), F.col("dst").alias("k"))
    deps = pairs.join(x, "a").join(y, ["b", "k"]).groupBy("a", "b").agg(n().alias("deps"))
    u, v = e.select(F.col("dst").alias("a"), F.col("src").alias("k")), e.select(F.col("dst").alias("b"), F.col("src").alias("k"))
    ups = pairs.join(u, "a").join(v, ["b", "k"]).groupBy("a", "b").agg(n().alias("ups"))
    ways = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(n().alias("ways"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.least(F.lit(1.0), 0.3 * zero("ways") + F.least(F.lit(0.2), 0.05 * zero("deps")) + F.least(F.lit(0.2), 0.05 * zero("ups")))
    return ways.join(deps, ["a", "b"], "left").join(ups, ["a", "b"], "left").select("a", "b", r2(score, 4).alias("score"))


def relationships(r: Relations) -> DataFrame:
    """P5: imports, importers (raw edge ends, dangling ones included) and exported symbols of every file, and its coupling."""
    out = r.imports.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("o"))
    into = r.imports.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("i"))
    exported = r.symbols.where("exported").groupBy(F.col("file_path").alias("id")).agg(n().alias("e"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        r.files.select("id").join(out, "id", "left").join(into, "id", "left").join(exported, "id", "left")
        .select("id", z("o").alias("imports"), z("i").alias("imported_by"), z("e").alias("exports"), r2(F.least(F.lit(1.0), (z("o") + z("i")) / 20.0)).alias("coupling"))
    )


def import_flags(r: Relations) -> DataFrame:
    """One row: pairs of files that import each other, files that import themselves, and all import pairs of known files."""
    both = mutual_imports(r).agg(n().alias("mutual_pairs"))
    return both.crossJoin(r.file_imports.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_imports"), n().alias("imports")))  # single rows


def mutual_imports(r: Relations) -> DataFrame:
    """Pairs of files that import each other."""
    e = r.file_imports
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").where("src < dst")


# ---- dead code, three definitions ----


def dead_by_name(r: Relations) -> DataFrame:
    """Exported symbols whose name is imported nowhere; aliases count as the name they stand for."""
    used = r.imports.select(F.explode("symbols").alias("s")).select(F.trim(F.split("s", " as ")[0]).alias("name")).distinct()
    return r.symbols.where("exported").join(used, "name", "left_anti").select("id", "name", "file_path", F.col("line_start").cast("bigint").alias("line_start"))


def dead_by_target(r: Relations) -> DataFrame:
    """Exported symbols whose id is the target of no import. Imports end in files, so these are all exported symbols."""
    return r.symbols.where("exported").join(r.imports.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id")


def dead_by_symbol(r: Relations) -> DataFrame:
    """Exported symbols whose name occurs in no import's symbols as written, aliases not taken apart; counts per file."""
    used = r.imports.select(F.explode("symbols").alias("name")).distinct()
    return r.symbols.where("exported").join(used, "name", "left_anti").groupBy("file_path").agg(n().alias("dead"))


# ---- reachability and cycles ----


def call_chain(r: Relations, start: DataFrame, max_depth: int = 5) -> DataFrame:
    """Nodes within max_depth + 1 undirected edges (imports and contains) of a start, with depth and smallest shortest path.

    start: one column id. Each level joins the frontier with the edges and drops what was seen.
    """
    known = r.nodes.select("id")
    e = r.edges.select("source_id", "target_id").where("source_id <> target_id")
    e = e.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    both = cut(e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(e.select("target_id", "source_id")).distinct())
    seen = front = start.select("id", F.lit(0).cast("bigint").alias("depth"), F.col("id").alias("path"))
    for level in range(1, max_depth + 2):
        front = front.join(both, front.id == both.a).groupBy(F.col("b").alias("id")).agg(F.min(F.concat_ws(">", "path", "b")).alias("path"))
        front = cut(front.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).cast("bigint").alias("depth"), "path"))
        seen = seen.union(front)
    return seen


def chain_from_hub(r: Relations) -> DataFrame:
    """T1 from the file with most importers (ties: smallest id)."""
    hub = r.file_imports.groupBy(F.col("dst").alias("id")).agg(n().alias("k")).orderBy(F.desc("k"), "id").limit(1)
    return call_chain(r, hub.select("id"), 2)


def chain_from_hub_deep(r: Relations) -> DataFrame:
    """T1 from the same file at the survey's depth, 6 edges."""
    hub = r.file_imports.groupBy(F.col("dst").alias("id")).agg(n().alias("k")).orderBy(F.desc("k"), "id").limit(1)
    return call_chain(r, hub.select("id"))


def cyclic_core(r: Relations, rounds: int = 8) -> DataFrame:
    """Import pairs that can lie on a cycle: ends without another import in or out are taken away, layer by layer.

    After some rounds what is left may still hold layers of a deep acyclic part; that costs later joins some rows, but no cycle.
    """
    e = cut(r.file_imports)
    size = e.count()
    for _ in range(rounds):
        e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        now = e.count()
        if now == size:
            break
        size = now
    return e


def severity(length):
    """O2: length to 3 low, to 5 medium, else high."""
    return F.when(length <= 3, "low").when(length <= 5, "medium").otherwise("high")


def bounded_cycles(r: Relations, longest: int = 4) -> DataFrame:
    """T5: elementary import cycles of bounded length, each written from its smallest file on.

    Paths grow only from their smallest member over larger ones, so each cycle is found once.
    """
    e = cyclic_core(r).select("src", "dst")
    out = e.where("src = dst").select(F.col("src").alias("cycle"), F.lit(1).cast("bigint").alias("length"))
    paths = e.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes"))
    for length in range(2, longest + 1):
        closed = paths.join(e.select(F.col("src").alias("last"), F.col("dst").alias("first")), ["last", "first"], "left_semi")
        out = out.union(closed.select(F.array_join("nodes", " > ").alias("cycle"), F.lit(length).cast("bigint").alias("length")))
        if length < longest:
            paths = paths.join(e.select(F.col("src").alias("last"), F.col("dst").alias("step")), "last").where((F.col("step") > F.col("first")) & ~F.array_contains("nodes", F.col("step")))
            paths = paths.select("first", F.col("step").alias("last"), F.concat("nodes", F.array("step")).alias("nodes"))
    return out.withColumn("severity", severity(F.col("length")))


def cycles_to_six(r: Relations) -> DataFrame:
    """T5 to the survey's length."""
    return bounded_cycles(r, 6)


def back_edges(r: Relations) -> DataFrame:
    """One cycle for each back edge of a depth-first walk, by component of the cyclic core.

    Files are visited in order of their ids. A walk goes on from what it has seen, so one task walks a component
    whatever its size, and holds its edges.
    """
    import pandas as pd

    e = cyclic_core(r)
    c = connected_components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    e = cut(e.join(c, e.src == c.node).select("component", "src", "dst"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        to: dict[str, list[str]] = {}
        for s, t in sorted(zip(frame.src, frame.dst)):
            to.setdefault(s, []).append(t)
        state: dict[str, int] = {}
        found = set()
        for root in sorted(to):
            if root in state:
                continue
            path, todo, place = [root], [iter(to[root])], {root: 0}
            state[root] = 1
            while todo:
                nxt = next(todo[-1], None)
                if nxt is None:
                    state[path.pop()] = 2
                    todo.pop()
                elif state.get(nxt, 0) == 1:
                    ring = path[place[nxt] :]
                    k = ring.index(min(ring))
                    found.add(" > ".join(ring[k:] + ring[:k]))
                elif nxt not in state:
                    state[nxt] = 1
                    place[nxt] = len(path)
                    path.append(nxt)
                    todo.append(iter(to.get(nxt, ())))
        return pd.DataFrame([(frame.component.iloc[0], x, x.count(" > ") + 1) for x in sorted(found)], columns=["component", "cycle", "length"])

    rings = e.groupBy("component").applyInPandas(walk, "component string, cycle string, length bigint")
    return rings.withColumn("severity", severity(F.col("length")))


def import_knots(r: Relations) -> DataFrame:
    """T5/T6 whole: (id, component, size): the files that reach one another by imports, by strongly connected component, which is named
    by its smallest file. Every cycle of two files or more lies in one of them, whatever its length; the cycles themselves are the detail of ``bounded_cycles`` and ``back_edges``."""
    c = strongly_connected(r.file_imports.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return c.join(c.groupBy("component").agg(n().alias("size")), "component").select(F.col("node").alias("id"), "component", "size")


# ---- judgements over files ----


def _with_degrees(r: Relations) -> DataFrame:
    return r.files.join(degrees(r), "id")



def zones(r: Relations) -> DataFrame:
    """Safety of every file, 50 and what complexity, imports, importers, name and size add or take; safe from 70, danger below 40."""
    p, c, lines = F.col("file_path"), F.col("complexity"), F.col("line_count")
    w = lambda cond, v: F.when(cond, v).otherwise(0)
    score = (
        50
        + F.when(c.isNull(), 0).when(c < 5, 15).when(c < 10, 5).when(c < 20, -10).otherwise(-25)
        + F.when(F.col("out_degree") < 3, 10).when(F.col("out_degree") > 10, -10).otherwise(0)
        + F.when(F.col("in_degree") == 0, 10).when(F.col("in_degree") > 5, -15).otherwise(0)
        + w(p.rlike("test|spec"), 20) + w(p.rlike("util|helper"), 5) + w(p.contains("config"), -10)
        + w(p.contains("index") & (F.size(F.split(p, "/")) <= 2), -15)
        + F.when(lines.isNull(), 0).when(lines < 100, 10).when(lines > 500, -10).otherwise(0)
    )
    z = _with_degrees(r).select("id", clamp(score).cast("bigint").alias("safety"))
    return z.withColumn("zone", F.when(F.col("safety") >= 70, "safe").when(F.col("safety") < 40, "danger").otherwise("caution"))


def standup_risk(r: Relations) -> DataFrame:
    """P10: risk of every file from complexity, importers, size and being an entry point, 100 at most."""
    p, c = F.col("file_path"), F.col("complexity")
    risk = (
        F.when(c > 20, 40).when(c > 15, 25).when(c > 10, 10).otherwise(0)
        + F.when(F.col("in_degree") > 10, 30).when(F.col("in_degree") > 5, 15).otherwise(0)
        + F.when(F.col("line_count") > 500, 15).otherwise(0) + F.when(p.contains("index") & (F.size(F.split(p, "/")) <= 2), 20).otherwise(0)
    )
    return _with_degrees(r).select("id", F.least(F.lit(100), risk).cast("bigint").alias("risk")).where("risk > 0")


def edit_warnings(r: Relations) -> DataFrame:
    """Warnings before a file is edited: tangled, many dependents, one owner, stale, churning."""
    top = r.nodes.groupBy(F.col("file_path").alias("id")).agg(F.max("complexity").alias("top"))
    f = r.files.join(top, "id", "left").join(direct_dependents(r), "id", "left")
    owners = F.size(F.array_distinct(F.filter(F.coalesce("contributors", F.array()), lambda x: F.trim(x) != "")))
    stale = F.floor((F.lit(r.as_of_us) - F.col("modified_us")) / DAY_US)
    kinds = F.array(
        F.when(F.col("top") >= 15, "complex"), F.when(F.col("dependents") >= 5, "depended_on"), F.when(owners == 1, "single_owner"), F.when(stale > 180, "stale"), F.when(F.col("modification_count") > 30, "churning")
    )
    return f.select("id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("warning"))


# Layers by folder, and what each may not import.
LAYERS = (
    ("ui", r"components?/|pages?/|views?/|ui/", ("db", "database", "models", "repositories")),
    ("utils", r"utils?/|helpers?/|lib/utils", ("components", "pages", "views", "ui", "services")),
    ("api", r"api/|routes?/|controllers?/", ("components", "pages", "views", "ui")),
)


def layer(path):
    c = F.when(path.rlike(LAYERS[0][1]), LAYERS[0][0])
    for name, pattern, _ in LAYERS[1:]:
        c = c.when(path.rlike(pattern), name)
    return c


def drift(r: Relations) -> DataFrame:
    """Violations (kind, severity, file): complexity, fan-out, fan-in, forbidden and mutual imports of layers."""
    f = r.files.withColumn("c", F.coalesce("complexity", F.lit(0)))
    mean = f.agg(F.coalesce(F.avg(F.when(F.col("c") > 0, F.col("c"))), F.lit(5.0)).alias("mean"))
    tangled = f.crossJoin(F.broadcast(mean)).select(  # against one row
        "file_path", F.when(F.col("c") > 30, "high").when(F.col("c") > 20, "medium").when((F.col("c") > 2 * F.col("mean")) & (F.col("c") > 10), "low").alias("severity"), F.lit("complexity").alias("kind")
    )
    d = degrees(r).withColumnRenamed("id", "file_path")
    outs = d.select("file_path", F.when(F.col("out_degree") > 25, "high").when(F.col("out_degree") > 15, "medium").when(F.col("out_degree") > 10, "low").alias("severity"), F.lit("dependency").alias("kind"))
    ins = d.select("file_path", F.when(F.col("in_degree") > 30, "high").when(F.col("in_degree") > 20, "medium").alias("severity"), F.lit("coupling").alias("kind"))
    i = r.file_imports.withColumn("from_layer", layer(F.col("src"))).withColumn("to_layer", layer(F.col("dst")))
    bad = F.when(F.col("from_layer") == LAYERS[0][0], F.lower("dst").rlike("|".join(LAYERS[0][2])))
    for name, _, words in LAYERS[1:]:
        bad = bad.when(F.col("from_layer") == name, F.lower("dst").rlike("|".join(words)))
    forbidden = i.where(bad).select(F.col("src").alias("file_path"), F.lit("high").alias("severity"), F.lit("layering").alias("kind"))
    pairs = i.where("from_layer <> to_layer").select("from_layer", "to_layer").distinct()
    back = pairs.select(F.col("to_layer").alias("from_layer"), F.col("from_layer").alias("to_layer"))
    mutual = pairs.join(back, ["from_layer", "to_layer"], "left_semi").where("from_layer < to_layer").select(F.concat_ws(" <-> ", "from_layer", "to_layer").alias("file_path"), F.lit("medium").alias("severity"), F.lit("layering").alias("kind"))
    return tangled.unionByName(outs).unionByName(ins).unionByName(forbidden).unionByName(mutual).where("severity IS NOT NULL")


def drift_score(r: Relations) -> DataFrame:
    """100 less the penalties (10, 5, 2) of all violations over a hundredth of five times the files, at least 100."""
    p = F.when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 5).otherwise(2)
    v = drift(r).agg(n().alias("violations"), F.coalesce(F.sum(p), F.lit(0)).alias("penalty"))
    one = v.crossJoin(r.files.agg(n().alias("files")))  # two single rows
    return one.select("violations", js_round(F.greatest(F.lit(0.0), 100 - 100 * F.col("penalty") / F.greatest(F.lit(100), 5 * F.col("files")))).alias("score"))


def architecture(r: Relations) -> DataFrame:
    """Files, lines, symbols and maximal complexity of every directory with all below it (a rollup over paths)."""
    parts = F.filter(F.split("file_path", "/"), lambda x: (x != "") & (x != "."))
    up = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice("parts", 1, i), "/")))
    # symbols are counted per file before a path is taken apart
    per = r.nodes.groupBy("file_path").agg(
        F.count_if(F.col("node_type") == "file").alias("f"), F.sum(F.when(F.col("node_type") == "file", F.coalesce("line_end", F.lit(0))).otherwise(0)).alias("l"),
        F.count_if(F.col("node_type") != "file").alias("s"), F.max(F.coalesce("complexity", F.lit(0))).alias("c"),
    )
    rows = per.withColumn("parts", parts).where(F.size("parts") > 0).select(F.explode(up).alias("directory"), "f", "l", "s", "c")
    return rows.groupBy("directory").agg(F.sum("f").alias("files"), F.sum("l").cast("bigint").alias("lines"), F.sum("s").alias("symbols"), F.max("c").cast("bigint").alias("max_complexity")).where("files > 0")


def diagram(r: Relations, depth: int = 3) -> DataFrame:
    """P25: import edges between groups of files (the first folders of their paths), without loops, once each."""
    g = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, depth), "/")
    return r.file_imports.select(g("src").alias("source"), g("dst").alias("target")).where("source <> target").groupBy("source", "target").agg(n().alias("imports"))


def diagram_text(r: Relations, style: str = "mermaid") -> DataFrame:
    """The diagram's lines in one of the styles mermaid, d2 and ascii."""
    arrow = {"mermaid": '  "%s" --> "%s"', "d2": '"%s" -> "%s"', "ascii": "%s --> %s"}[style]
    return diagram(r).select(F.format_string(arrow, "source", "target").alias("line"))


def tour(r: Relations) -> DataFrame:
    """Stops of a tour: entry and config files, the three most complex files above 15, the four most imported, three files of each larger folder."""
    d = _with_degrees(r).withColumn("name", F.element_at(F.split("file_path", "/"), -1))
    entry = d.where(F.col("name").rlike(r"^(?:index|main|app|server|cli)\.(?:ts|tsx|js|jsx)$")).select("id", F.lit("entry").alias("stop"))
    config = d.where(F.col("file_path").rlike(r"/config/")).select("id", F.lit("config").alias("stop"))
    hot = d.where("complexity > 15").orderBy(F.desc("complexity"), "ord", "id").limit(3).select("id", F.lit("hotspot").alias("stop"))
    core = d.where("in_degree > 0").orderBy(F.desc("in_degree"), "ord", "id").limit(4).select("id", F.lit("core").alias("stop"))
    folder = d.withColumn("folder", path_dir("file_path"))
    w = Window.partitionBy("folder").orderBy(F.coalesce("complexity", F.lit(0)).desc(), "id")
    many = folder.withColumn("rn", F.row_number().over(w)).join(folder.groupBy("folder").agg(n().alias("k")).where("k >= 2"), "folder").where("rn <= 3").select("id", F.lit("folder").alias("stop"))
    return entry.unionByName(config).unionByName(hot).unionByName(core).unionByName(many)


def confession(r: Relations) -> DataFrame:
    """Per file its symbols, functions, importers, unused exports and days since it changed (-1: unknown)."""
    s = r.symbols.groupBy(F.col("file_path").alias("id")).agg(n().alias("symbols"), F.count_if(F.col("node_type") == "function").alias("functions"))
    dead = dead_by_name(r).groupBy(F.col("file_path").alias("id")).agg(n().alias("unused"))
    f = r.files.join(s, "id", "left").join(direct_dependents(r), "id", "left").join(dead, "id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return f.select("id", z("symbols").alias("symbols"), z("functions").alias("functions"), z("dependents").alias("importers"), z("unused").alias("unused_exports"), F.coalesce(F.floor((F.lit(r.as_of_us) - F.col("modified_us")) / DAY_US), F.lit(-1)).cast("bigint").alias("days"))


def codebase_summary(r: Relations) -> DataFrame:
    """Per repository counts, mean and maximal complexity, its largest area and the contributor of most files."""
    repo = F.split("file_path", "/")[0].alias("repo")
    base = r.nodes.groupBy(repo).agg(
        F.count_if(F.col("node_type") == "file").alias("files"), F.count_if(F.col("node_type") == "function").alias("functions"), F.count_if(F.col("node_type") == "class").alias("classes"),
        r2(F.avg(F.when(F.col("node_type") != "file", F.col("complexity")))).alias("average"), F.max("complexity").cast("bigint").alias("maximum"),
    )
    first = lambda df, what, name: (
        df.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("k"), what))).where("rn = 1").select("repo", F.col(what).alias(name))
    )
    areas = first(r.files.groupBy(repo, area_of("file_path").alias("area")).agg(n().alias("k")), "area", "largest_area")
    people = r.files.select(repo, F.explode(F.array_distinct("contributors")).alias("person")).where("trim(person) <> ''")
    people = first(people.groupBy("repo", "person").agg(n().alias("k")), "person", "most_active")
    return base.join(areas, "repo", "left").join(people, "repo", "left")


def _q(f, *a, **k):
    return lambda spark, d: f(Relations(spark, d), *a, **k)


QUERIES = {
    "g1_nodes": lambda s, d: Relations(s, d).nodes.select("id", "node_type", F.col("ord").alias("ord"), F.coalesce("modification_count", F.lit(-1)).cast("bigint").alias("modification_count")),
    "g2_contains_edges": _q(contains_edges), "g3_import_edges": _q(import_edges), "g4_dependency_map": _q(dependency_map), "g5_import_counts": _q(import_counts), "g6_enriched_files": _q(enriched_files),
    "g7_languages": _q(language_histogram), "g8_graph_stats": _q(graph_stats), "g10_scan_errors": _q(scan_errors), "j1_resolved_imports": _q(resolved_imports), "t7_degrees": _q(degrees),
    "g9_incremental": lambda s, d: update_incremental(Relations(s, d).nodes.select("id", "ord", "modification_count"), Relations(s, d).raw("nodes").select("id", "ord", "modification_count")).select("id", F.coalesce("modification_count", F.lit(-1)).cast("bigint").alias("modification_count")),
    "t2_direct_dependents": _q(direct_dependents), "t3_indirect_dependents": _q(indirect_dependents), "t8_coupling_scores": _q(coupling_scores), "pf5_relationships": _q(relationships), "pf27_mutual_imports": _q(mutual_imports), "pf27_import_flags": _q(import_flags),
    "j3_dead_by_name": _q(dead_by_name), "j4_dead_by_target": _q(dead_by_target), "a21_dead_by_symbol": _q(dead_by_symbol), "t1_call_chain": _q(chain_from_hub), "t1_call_chain_deep": _q(chain_from_hub_deep), "t5_bounded_cycles": _q(bounded_cycles), "t5_cycles_to_six": _q(cycles_to_six), "t6_import_knots": _q(import_knots), "t6_back_edges": _q(back_edges),
    "pf9_zones": _q(zones), "pf10_standup_risk": _q(standup_risk), "pf14_edit_warnings": _q(edit_warnings), "a25_drift": _q(drift), "a25_drift_score": _q(drift_score), "a22_architecture": _q(architecture), "pf25_diagram": _q(diagram),
    "s22_diagram_text": _q(diagram_text), "pf24_tour": _q(tour), "pf26_confession": _q(confession), "a21_summary": _q(codebase_summary),
}

DEG = ", deg_ AS (SELECT f.id, (SELECT 1) AS one, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree FROM files_ f LEFT JOIN (SELECT src, count(*) AS k FROM imports_ GROUP BY 1) o ON o.src = f.id LEFT JOIN (SELECT dst, count(*) AS k FROM imports_ GROUP BY 1) i ON i.dst = f.id)"
DIRECT = ", direct_ AS (SELECT dst AS id, count(*) AS dependents FROM file_imports_ WHERE src <> dst GROUP BY 1)"
USED = ", used_ AS (SELECT DISTINCT trim(split_part(s, ' as ', 1)) AS name FROM (SELECT unnest(symbols) AS s FROM imports_) WHERE s IS NOT NULL), dead_ AS (SELECT id, name, file_path, line_start::BIGINT AS line_start FROM symbols_ WHERE exported AND name NOT IN (SELECT name FROM used_))"
CORE = ", e0 AS (SELECT src, dst FROM file_imports_)" + "".join(f", e{k + 1} AS (SELECT src, dst FROM e{k} WHERE src IN (SELECT dst FROM e{k}) AND dst IN (SELECT src FROM e{k}))" for k in range(3))
LAYER = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{name}'" for name, p, _ in LAYERS) + " END"
DRIFT = DEG + f""", mean_ AS (SELECT coalesce(avg(complexity) FILTER (complexity > 0), 5.0) AS mean FROM files_), li_ AS (SELECT src, dst, {LAYER.format('src')} AS fl, {LAYER.format('dst')} AS tl FROM file_imports_), lp_ AS (SELECT DISTINCT fl, tl FROM li_ WHERE fl <> tl),
drift_ AS (SELECT * FROM (
SELECT file_path, CASE WHEN coalesce(complexity, 0) > 30 THEN 'high' WHEN coalesce(complexity, 0) > 20 THEN 'medium' WHEN coalesce(complexity, 0) > 2 * mean AND coalesce(complexity, 0) > 10 THEN 'low' END AS severity, 'complexity' AS kind FROM files_, mean_
UNION ALL SELECT id, CASE WHEN out_degree > 25 THEN 'high' WHEN out_degree > 15 THEN 'medium' WHEN out_degree > 10 THEN 'low' END, 'dependency' FROM deg_
UNION ALL SELECT id, CASE WHEN in_degree > 30 THEN 'high' WHEN in_degree > 20 THEN 'medium' END, 'coupling' FROM deg_
UNION ALL SELECT src, 'high', 'layering' FROM li_ WHERE CASE fl {" ".join(f"WHEN '{name}' THEN regexp_matches(lower(dst), '{'|'.join(w)}')" for name, _, w in LAYERS)} END
UNION ALL SELECT fl || ' <-> ' || tl, 'medium', 'layering' FROM lp_ WHERE fl < tl AND (tl, fl) IN (SELECT (fl, tl) FROM lp_)) WHERE severity IS NOT NULL)"""


def _chain_sql(levels: int) -> str:
    s = ", known_ AS (SELECT id FROM nodes_), und0 AS (SELECT source_id AS a, target_id AS b FROM edges_ WHERE source_id <> target_id AND source_id IN (FROM known_) AND target_id IN (FROM known_)), und AS (SELECT a, b FROM und0 UNION SELECT b, a FROM und0)"
    s += ", l0 AS (SELECT dst AS id, dst AS path FROM file_imports_ GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
    for k in range(1, levels + 1):
        s += f", l{k} AS (SELECT b AS id, min(path || '>' || b) AS path FROM l{k - 1} JOIN und ON a = id WHERE b NOT IN ({' UNION ALL '.join(f'SELECT id FROM l{j}' for j in range(k))}) GROUP BY b)"
    return s + " " + " UNION ALL ".join(f"SELECT id, {k}::BIGINT AS depth, path FROM l{k}" for k in range(levels + 1))


SQL = {
    "g1_nodes": sql("SELECT id, node_type, ord, coalesce(modification_count, -1)::BIGINT AS modification_count FROM nodes_"),
    "g9_incremental": sql("SELECT id, coalesce(modification_count, -1)::BIGINT AS modification_count FROM nodes_"),
    "g2_contains_edges": sql("SELECT 'contains-' || (row_number() OVER (ORDER BY ord, id) - 1) AS id, file_path AS source_id, id AS target_id FROM symbols_ WHERE file_path IN (SELECT id FROM files_)"),
    "g3_import_edges": sql("SELECT 'import-' || (row_number() OVER (ORDER BY src, dst, id) - 1) AS id, src AS source_id, dst AS target_id FROM imports_"),
    "g4_dependency_map": sql("SELECT src AS file_path, count(DISTINCT dst) AS files, 'imports' AS direction FROM imports_ GROUP BY 1 UNION ALL SELECT dst, count(DISTINCT src), 'imported_by' FROM imports_ GROUP BY 1"),
    "g5_import_counts": sql("SELECT f.id, coalesce(d.k, f.import_count)::BIGINT AS imports FROM files_ f LEFT JOIN (SELECT src, count(DISTINCT dst) AS k FROM imports_ GROUP BY 1) d ON d.src = f.id"),
    "g6_enriched_files": sql(""", per AS (SELECT file_path, author, count(*) AS k, max(at_us) AS last FROM changes_ GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY k DESC, author NULLS LAST) AS rn FROM per)
        SELECT f.id, coalesce(h.changes, 0)::BIGINT AS changes, (h.last // 86400000000)::BIGINT AS last_day, coalesce(h.authors, 0) AS authors, h.first_author FROM files_ f
        LEFT JOIN (SELECT file_path, sum(k) AS changes, max(last) AS last, count(author) AS authors, max(author) FILTER (rn = 1) AS first_author FROM ranked GROUP BY 1) h USING (file_path)"""),
    "g7_languages": sql("SELECT language, count(*) AS files, coalesce(sum(line_count), 0)::BIGINT AS lines FROM files_ GROUP BY 1"),
    "g8_graph_stats": sql("""SELECT node_type AS kind, count(*) AS count, floor(avg(complexity) * 100 + 0.5) / 100 AS average, coalesce(max(complexity), -1)::BIGINT AS maximum, 'nodes' AS "of" FROM nodes_ GROUP BY 1
        UNION ALL SELECT edge_type, count(*), NULL, -1, 'edges' FROM edges_ GROUP BY 1"""),
    "g10_scan_errors": sql("""SELECT CASE WHEN file_path IN (SELECT file_path FROM files_) THEN file_path ELSE repo END AS subject, count(*) AS errors
        FROM (SELECT DISTINCT repo, regexp_replace(file_path, '^/?workspace/', '') AS file_path, error FROM build_errors WHERE error IS NOT NULL) GROUP BY 1"""),
    "j1_resolved_imports": sql("SELECT s.file_path AS source_path, t.file_path AS target_path, count(*) AS edges FROM imports_ JOIN nodes_ s ON s.id = src JOIN nodes_ t ON t.id = dst GROUP BY 1, 2"),
    "t7_degrees": sql(DEG + " SELECT id, out_degree, in_degree FROM deg_"),
    "t2_direct_dependents": sql(DIRECT + " SELECT * FROM direct_"),
    "t6_import_knots": """WITH RECURSIVE """ + sql("").split("WITH ", 1)[1].rstrip() + """, ed_ AS (SELECT src, dst FROM file_imports_ WHERE src <> dst), re_ AS (SELECT src AS a, dst AS b FROM ed_ UNION SELECT a, dst FROM re_ JOIN ed_ ON src = b), mu_ AS (SELECT x.a AS id, x.b AS other FROM re_ x JOIN re_ y ON y.a = x.b AND y.b = x.a),
        kn_ AS (SELECT id, least(id, min(other)) AS component FROM mu_ WHERE id <> other GROUP BY 1) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM kn_""",
    "t3_indirect_dependents": sql(""", e AS (SELECT src, dst FROM file_imports_ WHERE src <> dst), l2 AS (SELECT DISTINCT a.dst AS id, b.src AS dep FROM e a JOIN e b ON b.dst = a.src),
        l3 AS (SELECT DISTINCT id, b.src AS dep FROM (SELECT * FROM l2 WHERE id <> dep AND (dep, id) NOT IN (SELECT (src, dst) FROM e)) x JOIN e b ON b.dst = x.dep)
        SELECT id, count(*) AS indirect FROM (SELECT * FROM l2 UNION SELECT * FROM l3) WHERE id <> dep AND (dep, id) NOT IN (SELECT (src, dst) FROM e) GROUP BY 1"""),
    "t8_coupling_scores": sql(""", e AS (SELECT src, dst FROM file_imports_ WHERE src <> dst), p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS ways FROM e GROUP BY 1, 2)
        SELECT a, b, floor(least(1.0, 0.3::DOUBLE * ways + least(0.2::DOUBLE, 0.05::DOUBLE * (SELECT count(*) FROM e x JOIN e y ON x.dst = y.dst WHERE x.src = a AND y.src = b))
            + least(0.2::DOUBLE, 0.05::DOUBLE * (SELECT count(*) FROM e x JOIN e y ON x.src = y.src WHERE x.dst = a AND y.dst = b))) * 10000 + 0.5) / 10000 AS score FROM p"""),
    "pf5_relationships": sql("""SELECT id, coalesce(o, 0) AS imports, coalesce(i, 0) AS imported_by, coalesce(e, 0) AS exports, floor(least(1.0, (coalesce(o, 0) + coalesce(i, 0)) / 20.0) * 100 + 0.5) / 100 AS coupling
        FROM (SELECT id FROM files_) LEFT JOIN (SELECT src AS id, count(DISTINCT dst) AS o FROM imports_ GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, count(DISTINCT src) AS i FROM imports_ GROUP BY 1) USING (id)
        LEFT JOIN (SELECT file_path AS id, count(*) AS e FROM symbols_ WHERE exported GROUP BY 1) USING (id)"""),
    "pf27_import_flags": sql("SELECT (SELECT count(*) FROM file_imports_ a JOIN file_imports_ b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) AS mutual_pairs, count(*) FILTER (src = dst) AS self_imports, count(*) AS imports FROM file_imports_"),
    "pf27_mutual_imports": sql("SELECT src, dst FROM file_imports_ WHERE src < dst AND (dst, src) IN (SELECT (src, dst) FROM file_imports_)"),
    "j3_dead_by_name": sql(USED + " SELECT * FROM dead_"),
    "j4_dead_by_target": sql("SELECT id FROM symbols_ WHERE exported AND id NOT IN (SELECT dst FROM imports_)"),
    "a21_dead_by_symbol": sql(", s AS (SELECT DISTINCT unnest(symbols) AS name FROM imports_) SELECT file_path, count(*) AS dead FROM symbols_ WHERE exported AND name NOT IN (SELECT name FROM s WHERE name IS NOT NULL) GROUP BY 1"),
    "t1_call_chain": sql(_chain_sql(3)),
    "t5_bounded_cycles": sql("""SELECT cycle, length::BIGINT AS length, CASE WHEN length <= 3 THEN 'low' ELSE 'medium' END AS severity FROM (
        SELECT src AS cycle, 1 AS length FROM file_imports_ WHERE src = dst
        UNION ALL SELECT concat_ws(' > ', a.src, a.dst), 2 FROM file_imports_ a JOIN file_imports_ b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
        UNION ALL SELECT concat_ws(' > ', a.src, a.dst, b.dst), 3 FROM file_imports_ a JOIN file_imports_ b ON b.src = a.dst JOIN file_imports_ c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst
        UNION ALL SELECT concat_ws(' > ', a.src, a.dst, b.dst, c.dst), 4 FROM file_imports_ a JOIN file_imports_ b ON b.src = a.dst JOIN file_imports_ c ON c.src = b.dst JOIN file_imports_ d ON d.src = c.dst AND d.dst = a.src
            WHERE a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.dst <> b.dst AND a.dst <> c.dst AND b.dst <> c.dst)"""),
    "pf9_zones": sql(DEG + """ SELECT id, s AS safety, CASE WHEN s >= 70 THEN 'safe' WHEN s < 40 THEN 'danger' ELSE 'caution' END AS zone FROM (SELECT id, greatest(0, least(100, 50
        + CASE WHEN complexity IS NULL THEN 0 WHEN complexity < 5 THEN 15 WHEN complexity < 10 THEN 5 WHEN complexity < 20 THEN -10 ELSE -25 END + CASE WHEN out_degree < 3 THEN 10 WHEN out_degree > 10 THEN -10 ELSE 0 END
        + CASE WHEN in_degree = 0 THEN 10 WHEN in_degree > 5 THEN -15 ELSE 0 END + CASE WHEN file_path LIKE '%test%' OR file_path LIKE '%spec%' THEN 20 ELSE 0 END + CASE WHEN file_path LIKE '%util%' OR file_path LIKE '%helper%' THEN 5 ELSE 0 END
        + CASE WHEN file_path LIKE '%config%' THEN -10 ELSE 0 END + CASE WHEN file_path LIKE '%index%' AND len(string_split(file_path, '/')) <= 2 THEN -15 ELSE 0 END
        + CASE WHEN line_count IS NULL THEN 0 WHEN line_count < 100 THEN 10 WHEN line_count > 500 THEN -10 ELSE 0 END))::BIGINT AS s FROM files_ JOIN deg_ USING (id))"""),
    "pf10_standup_risk": sql(DEG + """ SELECT * FROM (SELECT id, least(100, CASE WHEN complexity > 20 THEN 40 WHEN complexity > 15 THEN 25 WHEN complexity > 10 THEN 10 ELSE 0 END + CASE WHEN in_degree > 10 THEN 30 WHEN in_degree > 5 THEN 15 ELSE 0 END
        + CASE WHEN line_count > 500 THEN 15 ELSE 0 END + CASE WHEN file_path LIKE '%index%' AND len(string_split(file_path, '/')) <= 2 THEN 20 ELSE 0 END)::BIGINT AS risk FROM files_ JOIN deg_ USING (id)) WHERE risk > 0"""),
    "pf14_edit_warnings": sql(DIRECT + f""", f AS (SELECT id, modified_us, modification_count, len(list_distinct(list_filter(coalesce(contributors, []), lambda x: trim(x) <> ''))) AS owners, (SELECT max(complexity) FROM nodes_ m WHERE m.file_path = files_.id) AS top, dependents FROM files_ LEFT JOIN direct_ USING (id))
        SELECT id, 'complex' AS warning FROM f WHERE top >= 15 UNION ALL SELECT id, 'depended_on' FROM f WHERE dependents >= 5 UNION ALL SELECT id, 'single_owner' FROM f WHERE owners = 1
        UNION ALL SELECT id, 'stale' FROM f WHERE ({AS_OF_US} - modified_us) // 86400000000 > 180 UNION ALL SELECT id, 'churning' FROM f WHERE modification_count > 30"""),
    "a25_drift": sql(DRIFT + " SELECT * FROM drift_"),
    "a25_drift_score": sql(DRIFT + " SELECT (SELECT count(*) FROM drift_) AS violations, floor(greatest(0.0, 100 - 100 * (SELECT coalesce(sum(CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END), 0) FROM drift_)::DOUBLE / greatest(100, 5 * (SELECT count(*) FROM files_))) + 0.5)::BIGINT AS score"),
    "a22_architecture": sql(""", p AS (SELECT *, string_split(file_path, '/') AS parts FROM nodes_), x AS (SELECT *, unnest(range(0, len(parts))) AS i FROM p)
        SELECT CASE WHEN i = 0 THEN '.' ELSE array_to_string(parts[1:i], '/') END AS directory, count(*) FILTER (node_type = 'file') AS files, coalesce(sum(line_end) FILTER (node_type = 'file'), 0)::BIGINT AS lines,
        count(*) FILTER (node_type <> 'file') AS symbols, max(coalesce(complexity, 0))::BIGINT AS max_complexity FROM x GROUP BY 1 HAVING count(*) FILTER (node_type = 'file') > 0"""),
    "pf25_diagram": sql("SELECT source, target, count(*) AS imports FROM (SELECT array_to_string(string_split(src, '/')[1:3], '/') AS source, array_to_string(string_split(dst, '/')[1:3], '/') AS target FROM file_imports_) WHERE source <> target GROUP BY 1, 2"),
    "s22_diagram_text": sql("""SELECT DISTINCT '  "' || source || '" --> "' || target || '"' AS line FROM (SELECT array_to_string(string_split(src, '/')[1:3], '/') AS source, array_to_string(string_split(dst, '/')[1:3], '/') AS target FROM file_imports_) WHERE source <> target"""),
    "pf24_tour": sql(DEG + f""", d AS (SELECT *, {DIR_SQL.format('file_path')} AS folder, regexp_extract(file_path, '[^/]*$') AS base FROM files_ JOIN deg_ USING (id))
        SELECT id, 'entry' AS stop FROM d WHERE regexp_matches(base, '^(index|main|app|server|cli)\\.(ts|tsx|js|jsx)$') UNION ALL SELECT id, 'config' FROM d WHERE file_path LIKE '%/config/%'
        UNION ALL SELECT * FROM (SELECT id, 'hotspot' FROM d WHERE complexity > 15 ORDER BY complexity DESC, ord, id LIMIT 3) UNION ALL SELECT * FROM (SELECT id, 'core' FROM d WHERE in_degree > 0 ORDER BY in_degree DESC, ord, id LIMIT 4)
        UNION ALL SELECT id, 'folder' FROM (SELECT id, row_number() OVER (PARTITION BY folder ORDER BY coalesce(complexity, 0) DESC, id) AS rn, count(*) OVER (PARTITION BY folder) AS k FROM d) WHERE k >= 2 AND rn <= 3"""),
    "pf26_confession": sql(USED + DIRECT + f""" SELECT id, coalesce(symbols, 0) AS symbols, coalesce(functions, 0) AS functions, coalesce(dependents, 0) AS importers, coalesce(unused, 0) AS unused_exports, coalesce(({AS_OF_US} - modified_us) // 86400000000, -1)::BIGINT AS days FROM files_
        LEFT JOIN (SELECT file_path AS id, count(*) AS symbols, count(*) FILTER (node_type = 'function') AS functions FROM symbols_ GROUP BY 1) USING (id) LEFT JOIN direct_ USING (id) LEFT JOIN (SELECT file_path AS id, count(*) AS unused FROM dead_ GROUP BY 1) USING (id)"""),
    "a21_summary": sql(f""", b AS (SELECT split_part(file_path, '/', 1) AS repo, count(*) FILTER (node_type = 'file') AS files, count(*) FILTER (node_type = 'function') AS functions, count(*) FILTER (node_type = 'class') AS classes,
        floor(avg(complexity) FILTER (node_type <> 'file') * 100 + 0.5) / 100 AS average, max(complexity)::BIGINT AS maximum FROM nodes_ GROUP BY 1),
        a AS (SELECT repo, area, row_number() OVER (PARTITION BY repo ORDER BY k DESC, area) AS rn FROM (SELECT split_part(file_path, '/', 1) AS repo, {AREA_SQL.format('file_path')} AS area, count(*) AS k FROM files_ GROUP BY 1, 2)),
        p AS (SELECT repo, person, row_number() OVER (PARTITION BY repo ORDER BY k DESC, person) AS rn FROM (SELECT repo, person, count(*) AS k FROM (SELECT split_part(file_path, '/', 1) AS repo, unnest(list_distinct(contributors)) AS person FROM files_) WHERE trim(person) <> '' GROUP BY 1, 2))
        SELECT b.*, a.area AS largest_area, p.person AS most_active FROM b LEFT JOIN a ON a.repo = b.repo AND a.rn = 1 LEFT JOIN p ON p.repo = b.repo AND p.rn = 1"""),
}
