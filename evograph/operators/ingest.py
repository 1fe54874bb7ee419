"""Queries over the sources: what scans, logs and diffs of the given tables yield."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import build
from ..relations import Relations, n, sql
from ..sources import gitlog, store, trees


def _files(r: Relations) -> DataFrame:
    return r.raw("source_files").select("file_path", "content").dropDuplicates(["file_path"])


def languages(r: Relations) -> DataFrame:
    """S5."""
    return _files(r).groupBy(trees.language_of(F.col("file_path")).alias("language")).agg(n().alias("files"))


def scanned_symbols(r: Relations) -> DataFrame:
    """Symbols found in the files' texts."""
    return trees.extract_symbols(_files(r))


def declared(r: Relations) -> DataFrame:
    """S3: the symbols at the top level of the files, without methods and variables."""
    s = trees.extract_symbols(_files(r)).where("node_type <> 'variable' AND NOT contains(name, '.')")
    return s.select("file_path", "node_type", "name", F.col("line_start").cast("bigint").alias("line_start"), "exported")


def imports(r: Relations) -> DataFrame:
    """S6."""
    return trees.extract_imports(_files(r)).select("file_path", "module", "is_type_only", F.size("symbols").cast("bigint").alias("names"))


def resolved(r: Relations) -> DataFrame:
    """Modules of imports with the paths they mean."""
    return trees.extract_imports(_files(r)).select("file_path", "module", trees.resolve(F.col("file_path"), F.col("module")).alias("target")).distinct()


def exports(r: Relations) -> DataFrame:
    """S8."""
    return trees.extract_exports(_files(r)).groupBy("file_path").agg(n().alias("exports"), F.count_if("is_default").alias("defaults"))


def _graph(r: Relations):
    authors = r.raw("commits").groupBy("hash").agg(F.min("author_name").alias("author_name"))
    return build.build_graph(_files(r), r.changes.select("hash", "file_path", "at_us").join(authors, "hash"))


def built_files(r: Relations) -> DataFrame:
    """G1: the file nodes of the graph that is built from texts and history."""
    f = _graph(r).nodes.where("node_type = 'file'")
    return f.select("id", "name", "language", F.col("line_count").cast("bigint").alias("line_count"), F.coalesce("modification_count", F.lit(0)).alias("modification_count"), "modified_us", F.size(F.coalesce("contributors", F.array())).cast("bigint").alias("contributors"))


def built_nodes(r: Relations) -> DataFrame:
    """G1: all nodes of the graph."""
    return _graph(r).nodes


def built_edges(r: Relations) -> DataFrame:
    """G1: all edges of the graph."""
    return _graph(r).edges


def built_metadata(r: Relations) -> DataFrame:
    """G1: one row a language of the graph's metadata, with the totals of all."""
    m = _graph(r).metadata
    return m.select("file_count", "total_lines", F.explode("languages").alias("language", "files"))


def log_round_trip(r: Relations) -> DataFrame:
    """The history written as a log's records and parsed again."""
    lines = r.commit_files.groupBy("hash").agg(F.array_join(F.collect_list(F.concat_ws("\t", F.col("added").cast("string"), F.col("removed").cast("string"), "file_path")), "\n").alias("body"))  # files of one commit
    records = r.commits.join(lines, "hash").select(F.concat("hash", F.lit("|"), F.coalesce("author", F.lit("")), F.lit("|"), F.col("at_us").cast("string"), F.lit("\n"), "body", F.lit("\n\n")).alias("record"))
    return gitlog.parse_numstat(records).select("hash", "file_path", F.col("added").cast("bigint").alias("added"), F.col("removed").cast("bigint").alias("removed"))


def diff_round_trip(r: Relations) -> DataFrame:
    """Changes written as the two texts of a diff and put together again; a first change adds its file."""
    first = r.changes.groupBy("file_path").agg(F.min(F.struct("at_us", "hash")).alias("f")).select("file_path", F.col("f.hash").alias("hash"))
    a = r.commit_files.select(F.col("hash").alias("change_id"), F.concat_ws("\t", F.col("added").cast("string"), F.col("removed").cast("string"), "file_path").alias("line"))
    b = first.select(F.col("hash").alias("change_id"), F.concat(F.lit("A\t"), "file_path").alias("line"))
    return gitlog.diff_files(a, b).groupBy("change_id", "status").agg(n().alias("files"), F.sum("additions").cast("bigint").alias("additions"), F.sum("deletions").cast("bigint").alias("deletions"))


def envelopes(r: Relations) -> DataFrame:
    """S19 over the languages."""
    return store.envelope(languages(r), "languages", datetime(2025, 7, 1), source="scan")


def staleness(r: Relations, scanned_us: int = 1_740_000_000_000_000) -> DataFrame:
    """Whether a repository has a file changed since a scan."""
    return r.files.groupBy(F.split("file_path", "/")[0].alias("repo")).agg(F.coalesce(F.max("modified_us") > F.lit(scanned_us), F.lit(False)).alias("stale"))


def _q(f, *a, **k):
    return lambda spark, d: f(Relations(spark, d), *a, **k)


QUERIES = {
    "g1_build_files": _q(built_files), "g1_build_nodes": _q(built_nodes), "g1_build_edges": _q(built_edges), "g1_build_metadata": _q(built_metadata),
    "s3_symbols": _q(scanned_symbols), "s3_declared": _q(declared), "s5_languages": _q(languages), "s6_imports": _q(imports), "s7_resolved": _q(resolved), "s8_exports": _q(exports), "s11_log": _q(log_round_trip), "s12_diff": _q(diff_round_trip), "s18_staleness": _q(staleness), "s19_envelopes": _q(envelopes),
}
TREE = r", tf_ AS (SELECT file_path, replace(coalesce(any_value(content), ''), chr(13) || chr(10), chr(10)) AS t FROM source_files GROUP BY 1)"
# the grammar's results are checked by patterns over whole declarations, which share nothing with it
IMP = TREE + r""", im0_ AS (SELECT file_path, unnest(regexp_extract_all(t, '(?m)^\x{FEFF}?import\s+(?:[^;''"`()]*?\sfrom\s*)?[''"][^''"\n]+[''"]')) AS d FROM tf_),
im_ AS (SELECT file_path, regexp_extract(d, '[''"]([^''"\n]+)[''"]$', 1) AS module, regexp_matches(d, 'import\s+type\s+[\w{*]') AS is_type_only,
len(list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(d, '(?s)import\s+(?:type\s+)?(.*)\sfrom', 1), '[{}]', ',', 'g'), '\s+', ' ', 'g'), ','), lambda x: trim(x) <> '')) AS names FROM im0_)"""
LANG = "CASE lower(regexp_extract(file_path, '\\.([A-Za-z]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'jsx' THEN 'jsx' ELSE 'javascript' END"
SQL = {
    "s5_languages": sql(TREE + f" SELECT {LANG} AS language, count(*) AS files FROM tf_ GROUP BY 1"),
    "s6_imports": sql(IMP + " SELECT file_path, module, is_type_only, names FROM im_ WHERE starts_with(module, '.') OR starts_with(module, '/')"),
    "s7_resolved": sql(IMP + r""" SELECT DISTINCT file_path, module, CASE WHEN regexp_matches(p, '\.(ts|tsx|js|jsx)$') THEN p ELSE p || '.ts' END AS target FROM (SELECT *, regexp_replace(file_path, '[^/]*$', '') || regexp_replace(module, '^\./', '') AS p FROM im_ WHERE starts_with(module, '.'))"""),
    "s3_declared": sql(TREE + r""", l AS (SELECT file_path, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line_start FROM tf_ WHERE file_path IS NOT NULL),
        d AS (SELECT *, regexp_extract(x, '^\x{FEFF}?(export )?(?:default )?(?:declare )?(?:abstract )?(?:async )?(?:const )?(function|class|interface|type|enum)\s*\*?\s+(\w+)(?:\W|$)', ['e', 'node_type', 'name']) AS m FROM l)
        SELECT file_path, m.node_type AS node_type, m.name AS name, line_start, m.e <> '' AS exported FROM d WHERE m.name <> ''"""),
    "s8_exports": sql(TREE + r""" SELECT file_path, count(*) AS exports, count(*) FILTER (contains(d, 'export default')) AS defaults FROM (SELECT file_path, unnest(regexp_extract_all(t, '(?m)^\x{FEFF}?export (?:default\b|(?:declare )?(?:abstract )?(?:async )?(?:const enum|const|let|var|function\*?|class|interface|type|enum) *\*? *\w+)')) AS d FROM tf_) GROUP BY 1"""),
    "g1_build_files": sql(TREE + f""", h AS (SELECT file_path, count(DISTINCT hash) AS k, max(at_us) AS at FROM changes_ GROUP BY 1), w AS (SELECT file_path, count(DISTINCT author_name) AS k FROM changes_ JOIN commits_ USING (hash) GROUP BY 1)
        SELECT file_path AS id, regexp_extract(file_path, '[^/]*$') AS name, {LANG} AS language, length(t) - length(replace(t, chr(10), '')) + (t <> '' AND NOT ends_with(t, chr(10)))::INT AS line_count, coalesce(h.k, 0) AS modification_count, h.at AS modified_us, coalesce(w.k, 0) AS contributors
        FROM tf_ LEFT JOIN h USING (file_path) LEFT JOIN w USING (file_path)"""),
    "g1_build_metadata": sql(TREE + f""", l AS (SELECT {LANG} AS language, length(t) - length(replace(t, chr(10), '')) + (t <> '' AND NOT ends_with(t, chr(10)))::INT AS lines FROM tf_ WHERE file_path IS NOT NULL)
        SELECT (SELECT count(*) FROM l) AS file_count, (SELECT sum(lines)::BIGINT FROM l) AS total_lines, language, count(*) AS files FROM l GROUP BY language"""),
    "s11_log": sql("SELECT hash, file_path, added::BIGINT AS added, removed::BIGINT AS removed FROM changes_"),
    "s12_diff": sql(", f AS (SELECT file_path, hash FROM changes_ QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY at_us, hash) = 1) SELECT c.hash AS change_id, CASE WHEN f.hash IS NULL THEN 'modified' ELSE 'added' END AS status, count(*) AS files, sum(added)::BIGINT AS additions, sum(removed)::BIGINT AS deletions FROM commit_files_ c LEFT JOIN f ON f.hash = c.hash AND f.file_path = c.file_path GROUP BY 1, 2"),
    "s18_staleness": sql("SELECT split_part(file_path, '/', 1) AS repo, coalesce(max(modified_us) > 1740000000000000, false) AS stale FROM files_ GROUP BY 1"),
    "s19_envelopes": sql(TREE + f""" SELECT '{{"command":"languages","timestamp":"2025-07-01T00:00:00","success":true,"data":{{"language":"' || language || '","files":' || files || '}},"meta":{{"source":"scan"}}}}' AS json FROM (SELECT {LANG} AS language, count(*) AS files FROM tf_ GROUP BY 1)"""),
}
