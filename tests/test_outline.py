"""Symbols, imports and exports by grammar against hand-computed cases and the scanned nodes; the graph built from a folder."""

import os
import re

import pandas as pd
import pytest

from evograph.plans.build import build_graph, build_tree
from evograph.sources.outline import complexity, lines_of, outline
from evograph.sources.trees import EXCLUDED, extract_exports, extract_imports, extract_symbols, scan_text

TEXT = """import a, { b as c, type D } from './x';
import * as n from "./y";
import type { T } from './t';
import {
  q,
  r,
} from '../z';
import 'side';
/**
 * Adds.
 * @param a x
 */
export async function* add(a: number, { b, c } = {}, ...rest: string[]): Promise<Map<string, number>> { if (a && b || c) { return x ? 1 : 2; } }
@Dec({ a: 1 })
export abstract class A<T> extends B<T> implements C, D<E, F> {
  #p = 1;
  constructor(private x: string) { doWork(x); }
  get v() { return 1; }
  /** Runs. */
  @Log() async run<T>(x: T, y?: string): void { doWork(x); for (const z of x) {} }
  static s() {}
  over(a: string): void;
  over(a: any) { switch (a) { case 1: case 2: break; default: } }
  abstract z(): number;
}
interface I { a(): void }
export type U = A extends B ? C : D;
export const enum E { X }
export const k = 1, [m, o] = [1, 2], fn = (a, b) => a && b;
const hidden = 1;
namespace N { export function inner() {} }
  declare function dd(a: string): void;
function later() { const nested = function () {}; class Inner {} }
export { later as l2, hidden };
export * from './all'; export * as ns from './ns';
export { u, v as w } from './uv';
export default later;
"""


def test_symbols():
    o, line = outline(TEXT, "ts"), lines_of(TEXT)
    got = {x.name: (x.kind, line(x.start), line(x.end - 1), x.exported) for x in o.symbols}
    assert o.errors == [] and got == {
        "add": ("function", 13, 13, True), "A": ("class", 14, 25, True), "A.run": ("function", 20, 20, True), "A.s": ("function", 21, 21, True), "A.over": ("function", 23, 23, True), "A.z": ("function", 24, 24, True),
        "I": ("interface", 26, 26, False), "U": ("type", 27, 27, True), "E": ("enum", 28, 28, True), "k": ("variable", 29, 29, True), "[m, o]": ("variable", 29, 29, True), "fn": ("variable", 29, 29, True),
        "dd": ("function", 32, 32, False), "later": ("function", 33, 33, True),
    }
    by = {x.name: x for x in o.symbols}
    assert (by["add"].is_async, by["add"].is_generator, by["add"].parameters, by["add"].return_type, by["add"].documentation) == (True, True, ["a", "{ b, c }", "rest"], "Promise<Map<string, number>>", "Adds.")
    assert (by["A"].is_abstract, by["A"].extends, by["A"].implements, by["A"].members) == (True, "B<T>", ["C", "D<E, F>"], 7)
    assert (by["A.run"].parameters, by["A.run"].documentation, by["A.run"].is_async) == (["x", "y"], "Runs.", True)
    # if, ternary, the logical expression and the one within; for; two cases; the class has what its methods have
    assert [complexity(o, by[n]) for n in ("add", "A.run", "A.over", "A.s", "A")] == [5, 2, 3, 1, 4]


@pytest.mark.parametrize(
    "body, want",
    [
        ("", 1), ("if (a) {} else if (b) {}", 3), ("return a ? b : c ? d : e;", 3), ("for (;;) {} for (const a in b) {} for (const a of b) {} while (a) {} do {} while (b);", 6),
        ("switch (a) { case 1: break; case 2: default: }", 3), ("try {} catch {} finally {}", 2), ("return a && b;", 2), ("return a && b && c;", 3), ("return a + (b ?? c);", 3), ("x = a || b;", 3), ("return a + b;", 1),
        ("if (a) x = y ? (b) : c; (a) => a ? 1 : 2;", 4), ("type T = A extends B ? C : D;", 2), ("return [a].map((x) => x || y);", 2), ("return '&&' + b;", 2),
    ],
)
def test_complexity(body, want):
    """The branches by kind, and binary expressions (assignments too) in whose text a logical operator stands."""
    o = outline("function f() { " + body + " }", "ts")
    assert o.errors == [] and complexity(o, o.symbols[0]) == want


def test_imports_and_exports(spark):
    df = spark.createDataFrame([("r/a.ts", TEXT), ("r/a.ts", TEXT), ("r/b.js", "export default class {}\nexport function f() {}\nexport const { x, y } = z\n"), ("r/c.js", None), (None, "import a from './x'")], "file_path string, content string")
    i = {(r.module, tuple(r.symbols), r.is_default, r.is_namespace, r.is_type_only) for r in extract_imports(df).collect()}
    assert i == {
        ("./x", ("a", "b as c", "D"), True, False, False), ("./y", ("* as n",), False, True, False), ("./t", ("T",), False, False, True), ("../z", ("q", "r"), False, False, False),
    }
    e = sorted((r.file_path[2:], r.name, r.is_default, r.is_re_export, r.source or "") for r in extract_exports(df).collect())
    assert e == sorted([
        ("a.ts", "later", False, False, ""), ("a.ts", "l2", False, False, ""), ("a.ts", "hidden", False, False, ""), ("a.ts", "hidden", False, False, ""), ("a.ts", "*", False, True, "./all"), ("a.ts", "ns", False, True, "./ns"),
        ("a.ts", "u", False, True, "./uv"), ("a.ts", "v", False, True, "./uv"), ("a.ts", "default", True, False, ""), *(("a.ts", n, False, False, "") for n in ("add", "A", "U", "E", "k", "[m, o]", "fn")),
        ("b.js", "default", True, False, ""), ("b.js", "f", False, False, ""), ("b.js", "{ x, y }", False, False, ""),
    ])
    assert extract_symbols(df.limit(0)).count() == 0


def test_one_error_loses_one_statement():
    o = outline("export function a() { return 1; }\nexport function b( {\n  x(;\n}\nexport class C {\n  m() {}\n}\nconst t = `\n", "ts")
    assert [x.name for x in o.symbols] == ["a", "b", "C", "C.m"] and len(o.errors) == 2
    assert outline("\x00", "ts").symbols == [] and outline(None, "ts").symbols == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_scanned_nodes(sf):
    """Every symbol node of a file that parses is found, by type, name, path and first line, and agrees in what the text tells."""
    d = f"/root/testdata/sf{sf}"
    if not os.path.exists(d):
        pytest.skip("no test tables here")
    files = pd.read_parquet(f"{d}/source_files.parquet").drop_duplicates("file_path")
    nodes = pd.read_parquet(f"{d}/nodes.parquet").sort_values("ord").drop_duplicates("id", keep="last")
    found, whole = {}, set()
    for p, t in zip(files.file_path, files.content):
        _, lines, error, symbols, _, _ = scan_text(p, t)
        if error is None:
            whole.add(p)
            found |= {(s["node_type"], s["name"], p, s["line_start"]): s for s in symbols}
            found[p] = lines
    seen = 0
    for n in nodes.itertuples():
        if n.file_path in whole and n.node_type == "file":
            assert found[n.file_path] == n.line_count
        elif n.file_path in whole:
            s = found[n.node_type, n.name, n.file_path, int(n.line_start)]
            assert s["line_end"] == n.line_end and s["exported"] == n.exported
            if n.node_type == "function":
                assert (s["is_async"], s["is_generator"], s["parameters"]) == (n.is_async, n.is_generator, list(n.parameters))
            seen += 1
    assert seen > 100


def test_excluded():
    out = ["a/node_modules/b.ts", "a.test.ts", "x/a.spec.tsx", "a/b.generated.ts", "a/.pnpm/x.js", "prisma/client/i.ts", "a/.vercel/o.js", "a/playwright-report/x.js", ".history/a.ts", "a/b.d.ts", "a/generated/b.ts"]
    kept = ["a/b.ts", "a/test.ts", "a/prisma/b.ts", "a/rebuild/x.ts", "a/outer/b.js", "tests/a.ts", "a/x.test.js"]
    assert all(re.search(EXCLUDED, x) for x in out) and not any(re.search(EXCLUDED, x) for x in kept)


def test_graph_of_a_folder(spark, tmp_path):
    (tmp_path / "src/lib").mkdir(parents=True)
    (tmp_path / "node_modules/p").mkdir(parents=True)
    (tmp_path / "src/a.ts").write_text("import { f } from './lib/b';\nimport * as x from './lib/b.js';\nimport y from 'pkg';\nexport class A { m() { return a && b; } }\n")
    (tmp_path / "src/lib/b.ts").write_text("import z from 'z';\nexport function f() {}\nfunction f() {}\n")
    (tmp_path / "src/c.test.ts").write_text("f();")
    (tmp_path / "node_modules/p/i.js").write_text("f();")
    (tmp_path / "src/bad.js").write_text("export const a = ;\n")
    changes = spark.createDataFrame([("src/a.ts", "1", 10, "Li"), ("src/a.ts", "2", 30, "Mo"), ("src/a.ts", "3", 20, "Mo"), ("gone.ts", "1", 10, None)], "file_path string, hash string, at_us long, author_name string")
    g = build_tree(spark, str(tmp_path), changes, 99)
    nodes = {r.id: r for r in g.nodes.collect()}
    assert {i for i, r in nodes.items() if r.node_type == "file"} == {"src/a.ts", "src/lib/b.ts", "src/bad.js"}
    a, b = nodes["src/a.ts"], nodes["src/lib/b.ts"]
    assert (a.line_count, a.import_count, a.export_count, a.complexity, a.modification_count, a.modified_us, a.contributors) == (4, 2, 1, 4, 3, 30, ["Mo", "Li"])
    assert (b.import_count, b.modification_count, b.complexity, b.language) == (1, None, 2, "typescript") and nodes["src/a.ts:function:A.m:4"].complexity == 2
    edges = {(r.source_id, r.target_id, r.edge_type) for r in g.edges.collect()}
    assert ("src/a.ts", "src/lib/b.ts", "imports") in edges and ("src/a.ts", "src/lib/b.js", "imports") in edges and ("src/a.ts", "src/a.ts:class:A:4", "contains") in edges
    assert g.edges.where("edge_type = 'contains'").count() == 5 and g.edges.select("id").distinct().count() == g.edges.count()
    m = g.metadata.collect()[0]
    assert (m.file_count, m.total_lines, m.languages, m.scanned_us) == (3, 8, {"typescript": 2, "javascript": 1}, 99)
    assert [r.file for r in g.errors.collect()] == ["src/bad.js"]  # a name declared twice is no syntax error of TypeScript
    g.save(str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/nodes")).count() == len(nodes)
    empty = build_graph(spark.createDataFrame([], "file_path string, content string"))
    assert empty.nodes.count() == empty.edges.count() == 0 and empty.metadata.collect()[0].file_count == 0
