import base64
import random

from evograph.llm.handwritten import not_handwritten

HAND = """import { a } from './a.js';
/**
 * Waits for the lock.
 */
export function load(rows, depth) {
  const total = rows.filter((x) => x.size > depth).map((x) => x.name);
  if (!total.length) {
    return null;
  }
  for (const x of total) {
    log.debug(x, depth);
  }
  return total;
}
"""
RNG = random.Random(1)
GETTERS = "export class A {\n" + "".join(f"  get{c}() {{\n    return this['{c}'];\n  }}\n" for c in "ABCDEFGHIJ") + "}\n"
CASES = {
    "vendored by banner": ("r/src/lib/x.js", "/*!\n * pixelmill v1.2.3\n * (c) the pixelmill contributors, MIT licensed\n */\n" + HAND),
    "vendored by folder": ("r/third_party/x.js", HAND),
    "vendored copy": ("r/src/x.ts", "// Copied unchanged from pixelmill@1.2.3 so that we need no dependency.\n" + HAND),
    "generated": ("r/src/x.ts", "// Code generated by pixelmill 1.2.3. DO NOT EDIT.\n" + HAND),
    "generated, German": ("r/src/x.ts", "// Automatisch erzeugt, nicht von Hand ändern.\r\n" + HAND),
    "repetition": ("r/src/x.ts", GETTERS),
    "bundled": ("r/out/x.js", "(() => {\nvar m = ({\n" + "".join(f"/***/ {i}:\n/***/ ((module, exports, load) => {{\n  exports.a = load({i});\n/***/ }}),\n" for i in range(5)) + "});\n})();"),
    "compiled": ("r/src/x.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\nvar __lift = (this && this.__lift) || function (a) { return a; };\n' + HAND),
    "minified": ("r/dist/x.min.js", "!function(){" + "var a=function(e){return e?1:0};" * 40 + "}()"),
    "base64": ("r/src/x.ts", "export const image = '" + base64.b64encode(RNG.randbytes(2000)).decode() + "';\n"),
    "numbers": ("r/src/x.ts", "export const w = [\n" + "  0.123, 4.567, 8.91, 2.345,\n" * 40 + "];\n"),
    "json": ("r/src/x.ts", "{\n" + "".join(f'  "k{i}": {{"weight": {i}, "tags": ["a", "b"]}},\n' for i in range(30)) + '  "end": null\n}\n'),
    "messages": ("r/src/x.ts", "export default {\n" + "".join(f'  "a.b.{i}": "Für cedar-press sind die Werte schwer zu lesen.",\n' for i in range(30)) + "};\n"),
    "snapshots": ("r/src/x.js", "// Test snapshot v1\n\n" + "".join(f"exports[`a {i}`] = `\nObject {{\n  \"a\": {i},\n}}\n`;\n\n" for i in range(4))),
}
DECOYS = {
    "hand": ("r/src/x.js", HAND), "folder": ("r/src/vendor-portal/x.js", HAND), "folder 2": ("r/lib/generators/x.js", HAND), "build scripts": ("r/tools/build-scripts/x.ts", HAND),
    "licence": ("r/src/x.js", "/*\n * Copyright the project authors.\n * Released under the terms in the LICENSE file at the root.\n */\n" + HAND),
    "about another file": ("r/src/x.ts", "// The drift index is generated by the nightly job; this file only reads it and is edited by hand.\n" + HAND),
    "banner in a string": ("r/src/x.ts", HAND + "export const banner = ['// Code generated by the tag writer. DO NOT ' + 'EDIT.', ''].join('\\n');\n"),
    "long pattern": ("r/src/x.ts", HAND * 2 + "export const p = /^(?:" + "|".join(f"word{i}" for i in range(70)) + ")$/i;\n"),
    "small table": ("r/src/x.ts", HAND + "const T = [\n" + "  ['queue', 41],\n" * 9 + "];\n"),
    "templates": ("r/src/x.ts", "const a = `x`;\n" + HAND * 2 + "const b = `y`;\n"),
    "empty": ("r/src/x.ts", ""), "null": ("r/src/x.ts", None), "no path": (None, HAND), "blank": ("r/src/x.ts", " \n"),
    "stylesheet": ("r/src/x.js", "".join(f".a{i} {{\n  margin: {i}px auto;\n  color: #353;\n}}\n\n" for i in range(11))),
}


def test_cases_and_decoys(spark):
    named = list({**CASES, **DECOYS}.items())
    rows = [(i, "r", p, t) for i, (_, (p, t)) in enumerate(named)]
    df = spark.createDataFrame(rows + rows[:3], "file_id long, repo string, file_path string, content string").selectExpr("*", "1 AS n_lines", "'x' AS reason")
    got = not_handwritten(df).collect()
    assert sorted(named[r.file_id][0] for r in got) == sorted(CASES)
    assert {named[r.file_id][0]: r.reason for r in got}["minified"] == "minified"
    assert not_handwritten(df.limit(0)).count() == 0


LICENCE = [f"Line {i} of the terms under which copies of the Software may be used." for i in range(40)]


def test_banner_below_a_long_licence(spark):
    star, bare, slashes = "/*\n" + "".join(f" * {x}\n" for x in LICENCE), "/*\n" + "".join(f"{x}\n\n" for x in LICENCE), "".join(f"// {x}\n" for x in LICENCE)
    texts = {
        1: star + " */\n// @generated\n" + HAND, 2: star + " * Copied from pixelmill@1.2.3\n */\n" + HAND, 3: bare + "@generated\n*/\n" + HAND, 4: slashes + "\n// Code generated by pixelmill. DO NOT EDIT.\n" + HAND,
        5: "<!--\n" + "\n".join(LICENCE) + "\n-->\n<!-- @generated -->\n" + HAND, 6: '"use strict";\n// @generated\n' + HAND,
        # after the first code a comment is no banner; a licence has phrases of banners
        11: star + " */\n" + HAND + "// @generated\n" + HAND, 12: bare + "*/ const a = 1;\n" + HAND + "// @generated\n", 13: slashes + "// see src/* for more\n" + HAND + "/* @generated */\n", 14: star + " * The contents of the NOTICE file do not modify the License.\n */\n" + HAND,
    }
    df = spark.createDataFrame([(i, "r", "r/src/x.ts", t) for i, t in texts.items()], "file_id long, repo string, file_path string, content string")
    assert {r.file_id: r.reason for r in not_handwritten(df).collect()} == {1: "generated", 2: "vendored", 3: "generated", 4: "generated", 5: "generated", 6: "generated"}


def test_banner_behind_directives_and_imports(spark):
    body = "export function f(a) {\n  return a;\n}\n" * 3
    imports = "'use strict';\n" + "".join(f"import {{ a{i} }} from './a{i}';\n" for i in range(12)) + "import {\n  x,\n  y,\n} from 'z';\n"
    rows = [
        (1, "r", "r/src/a.ts", imports + "// @generated by tool, do not edit\n" + body),
        (2, "r", "r/src/b.ts", imports + body + "// @generated by tool, do not edit\n"),
        (3, "r", "r/src/vendor-portal/c.ts", body), (4, "r", "r/vendor/c.ts", body),
    ]
    df = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string")
    assert {r.file_id: r.reason for r in not_handwritten(df).collect()} == {1: "generated", 4: "foreign folder"}
