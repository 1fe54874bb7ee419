"""Hand-computed cases at the boundaries of the rules."""

import pytest
from pyspark.sql import functions as F

from evograph.operators import complexity as C
from evograph.operators import coupling as K
from evograph.operators import search as X
from evograph.operators import trends as W
from evograph.plans.components import connected_components, strongly_connected
from evograph.relations import clamp, js_round, step
from evograph.session import number_rows
from evograph.sources import gitlog, store, trees


def column(spark, values, f, kind="double"):
    df = spark.createDataFrame([(i, float(v) if kind == "double" and v is not None else v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_rounding_and_steps(spark):
    assert column(spark, [-2.5, -2.6, 2.5, 2.4], js_round) == [-2, -3, 3, 2]
    assert column(spark, [-3.0, 50.0, 120.0], clamp) == [0, 50, 100]
    assert column(spark, [0.0, 3, 4, 10, 11, 20, 21], lambda v: step(v, K.FILES_STEPS, 100)) == [0, 10, 40, 40, 70, 70, 100]
    assert column(spark, [0.0, 50, 51, 200, 201, 500, 501, 1000, 1001], lambda v: step(v, K.LINES_STEPS, 100)) == [0, 10, 30, 30, 50, 50, 75, 75, 100]
    assert column(spark, [0.0, 5, 10, 20, 21], lambda v: step(v, K.COMPLEXITY_STEPS, 90)) == [0, 10, 30, 60, 90]
    assert column(spark, [0.0, 3, 4, 10, 11, 25, 26], lambda v: step(v, K.DEPENDENT_STEPS, 100)) == [0, 15, 40, 40, 70, 70, 100]


def test_categories_and_grades(spark):
    assert column(spark, [5.0, 6, 10, 11, 20, 21, None], C.category) == ["low", "medium", "medium", "high", "high", "veryHigh", None]
    assert column(spark, [90.0, 89.9, 80, 70, 60, 59.9], C.grade) == ["A", "B", "B", "C", "D", "F"]


def test_percent_change(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (80, 60)], "a int, b int")
    assert [r[0] for r in df.select(W.percent_change(F.col("a"), F.col("b"))).collect()] == [0, 100, -25]


def test_percentiles(spark):
    df = spark.createDataFrame([(1,), (1,), (3,), (9,)], "v int")
    assert sorted((r.v, r.p) for r in W.percentile_ranks(df, "v", "p").collect()) == [(1, 50), (1, 50), (3, 75), (9, 100)]


def test_unrelated_paths(spark):
    pairs = [("src/a/x.ts", "src/a/y.ts", False), ("src/a/x.ts", "src/b/y.ts", True), ("src/x.ts", "src/b/y.ts", False), ("src/a.ts", "lib/a.ts", True), ("a.ts", "b.ts", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", K.unrelated("a", "b")).collect())


def test_tokens_and_fuzzy_names(spark):
    assert column(spark, ["parseHTTPRequest", "a b-cd2", None, ""], X.tokenize, "string") == [["parse", "http", "request"], ["cd2"], [], []]
    import re

    assert re.search(X.subsequence("gfh"), "getfilehistory") and not re.search(X.subsequence("ghf"), "getfilehistory")


def test_idf_of_a_term_in_every_text_is_zero_and_cosine_cases(spark):
    docs = spark.createDataFrame([("1", "alpha beta"), ("2", "alpha gamma"), ("3", ""), ("4", None)], "id string, text string").where("id < '3'")
    idf = {r.term: r.idf for r in X.inverse_frequency(docs).collect()}
    assert idf["alpha"] == 0 and idf["beta"] > 0 and {r.id for r in X.weights(docs).collect()} == {"1", "2"}
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(X.cosine_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_text_hash_wraps_like_32_bits(spark):
    def h(s):
        x = 0
        for c in s:
            x = (x * 31 + ord(c) + 2**31) % 2**32 - 2**31
        return x

    texts = ["", "a", "3-14-meridian-core", "x" * 40]
    assert column(spark, texts, X.text_hash, "string") == [h(t) for t in texts]


def test_components_are_those_of_a_plain_union(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS v")
    assert [(r.v, r.k) for r in number_rows(df, "k", "v").orderBy("v").collect()] == [(i, i) for i in range(1000)]
    assert number_rows(df.limit(0), "k", "v").count() == 0


def test_symbols_of_a_text():
    text = "import { a } from './a.js';\n\nexport class A {\n  m(x) {\n    if (x && '}') { return 1; }\n  }\n}\n\nexport const b = 1;\nconst c = 2;\nfunction f() { return 1; }\nenum E { A }\n"
    got = {(x["node_type"], x["name"]): x for x in trees.scan_text("p.ts", text)[3]}
    assert set(got) == {("class", "A"), ("function", "A.m"), ("variable", "b"), ("function", "f"), ("enum", "E")}
    lines = lambda x: (x["line_start"], x["line_end"])
    assert lines(got["class", "A"]) == (3, 7) and lines(got["function", "A.m"]) == (4, 6) and got["function", "A.m"]["complexity"] == 3 and not got["function", "f"]["exported"]


def test_tree_imports_and_resolution(spark, tmp_path):
    (tmp_path / "src" / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_text("import type { X, Y as Z } from '../lib/b';\nimport c from 'pkg';\nimport './d.js';\nexport default function f() {}\n")
    (tmp_path / "src" / "node_modules" / "x" / "y.js").write_text("export const a = 1\n")
    (tmp_path / "src" / "z.md").write_text("no")
    t = trees.read_tree(spark, str(tmp_path))
    assert [r.file_path for r in t.collect()] == ["src/a.ts"]
    i = trees.extract_imports(t).withColumn("to", trees.resolve(F.col("file_path"), F.col("module")))
    assert {(r.module, tuple(r.symbols), r.is_type_only, r.to) for r in i.collect()} == {("../lib/b", ("X", "Y as Z"), True, "lib/b.ts"), ("./d.js", (), False, "src/d.js")}
    assert [(r.name, r.is_default) for r in trees.extract_exports(t).collect()] == [("default", True)]
    assert store.is_stale(t, 0).first().stale and not store.is_stale(t, 2**62).first().stale


def test_log_and_diff(spark, tmp_path):
    (tmp_path / "log").write_text("\x1eabc|Ann|2025-01-01\n\n3\t1\ta.ts\n-\t-\tb.png\n\x1edef|Bo|2025-01-02\n\n0\t9\tdir/c.ts\nnoise\n")
    got = {(r.hash, r.author, r.file_path, r.added, r.removed) for r in gitlog.read_numstat(spark, str(tmp_path / "log")).collect()}
    assert got == {("abc", "Ann", "a.ts", 3, 1), ("abc", "Ann", "b.png", 0, 0), ("def", "Bo", "dir/c.ts", 0, 9)}
    a = spark.createDataFrame([(1, "3\t1\ta.ts"), (1, "-\t-\tb.png"), (1, "1\t0\tnew.ts")], "change_id int, line string")
    b = spark.createDataFrame([(1, "A\ta.ts"), (1, "R090\told.ts\tnew.ts")], "change_id int, line string")
    got = {(r.file_path, r.status, r.additions, r.is_binary) for r in gitlog.diff_files(a, b).collect()}
    assert got == {("a.ts", "added", 3, False), ("b.png", "modified", 0, True), ("new.ts", "renamed", 1, False)}


def test_stores(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"version": "1", "nodes": {"a": {"id": "a", "type": "file", "name": "a", "filePath": "a.ts", "contributors": ["x"], "lineCount": 3}}, "edges": [{"id": "e", "source": "a", "target": "b", "type": "imports", "weight": 1.5}]}')
    nodes, edges = store.load_graph(spark, str(tmp_path / "g.json"))
    store.save_graph(nodes, edges, str(tmp_path / "s"))
    assert store.graph_exists(spark, str(tmp_path / "s")) and spark.read.parquet(str(tmp_path / "s/nodes")).first().lineCount == 3
    store.export_graph(nodes, edges, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 2
    store.delete_graph(spark, str(tmp_path / "s"))
    assert not store.graph_exists(spark, str(tmp_path / "s"))
    (tmp_path / "bad.json").write_text('{"nodes": 5')
    with pytest.raises(Exception):
        store.load_graph(spark, str(tmp_path / "bad.json"))[0].collect()
    s = spark.createDataFrame([("r", d, d * 2) for d in range(10)], "repo string, day int, health int")
    store.save_snapshot(s, str(tmp_path / "snap"))
    assert store.load_snapshots(spark, str(tmp_path / "snap"), 3, 5).count() == 3 and sorted(r.day for r in store.prune_snapshots(s, 2).collect()) == [8, 9]


def test_breaking_changes(spark):
    old = spark.createDataFrame([(1, "export const a = 1;\nexport function f(x) {\n}\n"), (2, "export class B {\n}\n"), (3, "")], "file_id long, text string")
    new = spark.createDataFrame([(1, "export function f(x, y) {\n}\n"), (3, "export const n = 1;\n")], "file_id long, text string")
    assert {tuple(r) for r in X.breaking_changes(old, new).collect()} == {(1, "a", "removed"), (1, "f", "signature"), (2, "*", "deleted")}


def test_keywords_of_a_query(spark):
    from evograph.operators import search

    one = lambda text: [r.keyword for r in search.parse_query(spark, text).orderBy("ord").collect()]
    assert one("login") == ["login", "signin", "sign-in", "authenticate", "auth", "authentication", "session", "token", "jwt", "oauth"]
    assert one("  Schema ") == ["schema", "model", "entity", "definition", "type", "db", "database", "repository", "store", "interface", "dto"]
    assert one("exception") == ["exception", "error", "throw", "catch", "handle"] and one("a x-y") == [] and one("zebra") == ["zebra"]


def test_questions_and_purposes(spark):
    from evograph.operators import search

    asked = {
        "What does the parser do?": ("what-does", "parser do"), "Where are tokens stored in it": ("where-is", "tokens"), "who is the owner": ("general", "who is the owner"), "How many files": ("general", "how many files"), "who owns my cache module?": ("who-wrote", "my cache module"),
        "Explain the cache module": ("what-does", "explain the cache"), "show me cycles": ("list", "cycles"), "How does login work?": ("how-works", "login"), "Why does X exist": ("why-exists", "x"), "whatever": ("general", "whatever"),
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string").select("q", search.question_type(F.col("q")).alias("t"), search.subject(F.col("q")).alias("s"))
    got = {r.q: (r.t, r.s) for r in df.collect()}
    assert {q: t for q, (t, _) in got.items()} == {q: t for q, (t, _) in asked.items()}
    assert got["Where are tokens stored in it"][1] == "tokens" and got["How does login work?"][1] == "login" and got["Why does X exist"][1] == "x" and got["show me cycles"][1] == "cycles"


def test_strongly_connected_components_are_brute_force(spark):
    import random

    rng = random.Random(11)
    # rings of several lengths, a knot, chains between and behind them, self loops and repeated edges
    edges = [(i, (i + 1) % 7) for i in range(7)] + [(10, 11), (11, 10), (6, 10), (11, 20), (20, 21), (21, 22), (30, 30), (40, 41), (40, 41)]
    edges += [(50 + rng.randrange(8), 50 + rng.randrange(8)) for _ in range(14)] + [(22, 50), (57, 60), (60, 61), (61, 62), (62, 60)]
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    r = {a: reach(a) for a in {x for e in edges for x in e}}
    want = {a: min(s) for a in r for s in [{a} | {b for b in r[a] if a in r[b]}] if len(s) > 1}
    got = {x.node: x.component for x in strongly_connected(spark.createDataFrame(edges + [(None, 1), (1, None)], "a long, b long")).collect()}
    assert got == want and len(set(want.values())) >= 3
    assert strongly_connected(spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "a long, b long")).count() == 0
    assert strongly_connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_breaking_changes(spark):
    old = "export function f(a: string) {}\nexport const c = 1;\nexport interface I {\n  id: string;\n  size?: number;\n}\nfunction g(a: string) {}\nfunction h(a: string) {}\n"
    new = "export function f(a: number) {}\nexport interface I {\n  size: number;\n}\nfunction g(a: string, b: string) {}\nfunction h(a: string, c: string) { k({ c?: 1 }) }\n"
    df = lambda rows: spark.createDataFrame(rows, "file_id long, text string")
    x = X.breaking_changes(df([(1, old), (2, "export const z = 1;\n"), (3, "same")]), df([(1, new), (3, "same"), (4, "  new: 1")]))
    assert {tuple(r) for r in x.collect()} == {(1, "c", "removed", "high"), (1, "f", "signature", "high"), (2, "*", "deleted", "high"), (1, "id", "property", "medium"), (1, "b", "parameter", "medium")}
    assert X.breaking_level(x).first().level == "breaking" and X.breaking_level(x.where("severity = 'medium'")).first().level == "caution" and X.breaking_level(x.limit(0)).first().level == "safe"


def test_snapshots_by_id_newest_count_and_clear(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "r", 5), ("b", 3, "r", 7), ("c", 2, "s", 9)], "id string, day int, repo string, health int")
    path = str(tmp_path / "snapshots")
    store.save_snapshot(rows, path)
    s = store.load_snapshots(spark, path).select("id", "day", "repo", "health")
    assert {(r.repo, r.id) for r in store.latest_snapshots(s).collect()} == {("r", "b"), ("s", "c")} and store.snapshot_by_id(s, "a").first().health == 5
    assert store.snapshot_count(s) == 3 and store.clear_snapshots(spark, path) == 3 and store.clear_snapshots(spark, path) == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from evograph.session import checkpoint_dir

    none = SimpleNamespace(get=lambda k, d=None: None)
    gone = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            checkpoint_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: none, master=master, _jsc=gone), conf=none))


def test_files_by_the_end_of_their_path(spark):
    from types import SimpleNamespace

    files = spark.createDataFrame([("r/src/scanHotspot.ts", 3), ("r/lib/Hotspot.ts", 5), ("q/src/a.ts", 1), ("r/src/a.ts", 2)], "id string, ord long").selectExpr("id", "id AS file_path", "ord")
    wanted = spark.createDataFrame([(x,) for x in ("Hotspot.ts", "src/a.ts", "r/src/a.ts", "rc/a.ts", "t.ts", "missing.ts", "", None)], "path string")
    got = {r.path: r.id for r in K.find_file(SimpleNamespace(files=files), wanted).collect()}
    assert got == {"Hotspot.ts": "r/src/scanHotspot.ts", "src/a.ts": "q/src/a.ts", "r/src/a.ts": "r/src/a.ts", "rc/a.ts": "q/src/a.ts", "t.ts": "r/src/scanHotspot.ts"}
