import pytest

from evograph.llm.docs import documented_functions, has_content, islands

P = ["rows", "filePath", "nodeIds"]


@pytest.mark.parametrize(
    "doc",
    [
        None, "", "  \n", "TODO", "FIXME later", "n/a", "...", "-----------", "?", "@returns {*}", "@param rows\n@returns", "{@inheritDoc}",
        "@param {object} rows - the rows\n@param {number} filePath - the file path\n@returns {*}", "fetchArea function", "The fetch area function",
        "Fetches the area.", "Fetch area by node ids and file path.", "Fetch area by no arguments.", "fetchArea()", "See above.", "Same as before.", "@see the docs",
        "istanbul ignore next", "eslint-disable-next-line", "prettier-ignore", "@ts-ignore", "@private", "@override", "@deprecated", "Description goes here.",
        "// const a = fetch(3);\n// return a;", "This is the function fetchArea. It is used to fetch area. It takes rows and returns the result of fetch area.",
        "Created from the file template. Please change this text.", "Auto-inserted comment, replace with a real one.", "XXX document me later",
        "Method fetchArea of the class. Stub comment inserted by the editor.", "Missing documentation for this method.", "No description.", "/**\n *\n */", "<p></p>",
    ],
)
def test_without_content(doc):
    assert not has_content(doc, "Map.fetchArea", P, "string")


@pytest.mark.parametrize(
    "doc",
    [
        "Skips a row without owner on purpose.", "/**\n * Throws if the cache is older than the layer.\n */", "Fetch area: Costs one git call per layer; pass a queue to avoid that.",
        "<p>Falls back to an empty\nlist.</p>", "// Zero means that the branch is unknown, not that it is empty.\n// Not thread safe.", "@param rows\n@returns null when the budget is exhausted before the first page arrives",
        "Half of the budget goes to the first layer,\n * the rest is shared evenly.", "@deprecated use the streaming reader instead, it never blocks",
    ],
)
def test_with_content(doc):
    assert has_content(doc, "Map.fetchArea", P, "string")


CODE = """/** About a. */
export async function a(x: string): Promise<void> {
  const s = `}${ { b: '/*' } }`; // {
}

// one
// two
const b = (x) => {
  return /[}]/.test(x);
};
class C {
  @dec()
  /* of m */
  private m(x = { y: 1 }): { z: number } {
    if (x) { return 1; }
  }
  n() { call(1); }
}
x(); // trailing
function d() { (
"""


def test_islands():
    found = islands(CODE.replace("\n", "\r\n"))
    one = lambda line: found[line][1][0]
    assert found[2][0] == "/** About a. */" and one(2).code.endswith("// {\n}") and one(2).signature == "export async function a(x: string)"
    assert found[8][0] == "// one\n// two" and one(8).code.startswith("const b") and one(8).code.endswith("}")
    assert found[14][0] == "/* of m */" and one(14).code.count("\n") == 2
    # a function behind annotations begins with them, and is found by its own line as well
    assert one(12).code == "@dec()\n  /* of m */\n  " + one(14).code and one(12).signature == one(14).signature
    assert found[17][0] is None and one(17).code == "n() { call(1); }"
    assert found.get(20, (None,))[0] is None
    assert islands("") == {}


MORE = """class A {
  /** About run. */
  @Log({ a: [1] })
  // and again
  @Twice
  run(x: string): { z: number } | void { go(); }
}
function a() { return 1; } function b(): string { return "2; c() {"; }
/* before */ function c() { return 3; }
const o = {
  // on a click
  onClick: () => { x(); }, onBlur: async (e) => e.y,
  'quoted'(z) { return z; }, call: other(1),
};
export class C { p = (a) => { q(); }; static r() {} }
"""


def test_annotations_members_and_several_functions_on_a_line():
    found = islands(MORE)
    names = {line: [x.name for x in fs] for line, (_, fs) in found.items() if fs}
    assert names == {3: ["run"], 6: ["run"], 8: ["a", "b"], 9: ["c"], 12: ["onClick", "onBlur"], 13: ["quoted"], 15: ["p", "r"]}
    assert found[3][0] == "/** About run. */" and found[3][1][0].code.startswith("@Log") and found[3][1][0].code.endswith("{ go(); }")
    assert found[8][1][1].code == 'function b(): string { return "2; c() {"; }'
    assert found[9][1][0].code == "function c() { return 3; }" and found[12][0] == "// on a click"
    # no type annotations and no type arguments in plain scripts; text of elements in JSX only
    assert not [x for _, fs in islands("function f<T>(a) { }", "js").values() for x in fs] and islands("function f<T>(a) { }", "ts")
    jsx = "const a = () => <p>it's {1}</p>;\nfunction b() { return <i>'</i>; }\n"
    assert [x.name for _, fs in sorted(islands(jsx, "jsx").items()) for x in fs[1]] == ["a", "b"]


def test_table(spark):
    files = spark.createDataFrame(
        [("f.ts", CODE.rsplit("function d", 1)[0]), ("g.ts", "// Waits for the lock before reading.\nfunction g() { ("), ("h.js", None), ("f.ts", CODE.rsplit("function d", 1)[0])],
        "file_path string, content string",
    ).selectExpr("*", "1 AS line", "'x' AS id")
    more = spark.createDataFrame([("m.ts", MORE), ("m.ts", MORE)], "file_path string, content string").selectExpr("*", "1 AS line", "'x' AS id")
    files = files.union(more)
    rows = [
        ("7", "function", "b", "m.ts", 8, "Waits for the lock before reading.", [], "string", 1),
        ("8", "function", "A.run", "m.ts", 3, None, ["x"], None, 1),
        ("1", "function", "a", "f.ts", 2, None, ["x"], None, 1),
        ("2", "function", "b", "f.ts", 8, "Keeps the lock until the last reader leaves.", None, None, 1),
        ("2", "function", "b", "f.ts", 8, "Keeps the lock until the last reader leaves.", None, None, 2),
        ("3", "function", "g", "g.ts", 2, None, [], None, None),
        ("4", "function", "g", "g.ts", 3, "Waits for the lock before reading.", [None], None, None),
        ("5", "class", "g", "g.ts", 3, "Waits for the lock before reading.", None, None, 1),
        (None, "function", None, None, None, None, None, None, None),
        ("6", "function", None, None, None, "Waits for the lock before reading.", None, None, None),
    ]
    nodes = spark.createDataFrame(
        rows, "id string, node_type string, name string, file_path string, line_start int, documentation string, parameters array<string>, return_type string, ord long"
    ).selectExpr("*", "'y' AS code")
    got = {r.id: r for r in documented_functions(nodes, files).collect()}
    assert set(got) == {"2", "4", "6", "7"} and got["7"].signature == "function b()"
    assert got["2"].code.startswith("const b") and got["2"].documented_by == "node" and got["6"].code is None
    assert documented_functions(nodes.limit(0), files.limit(0)).count() == 0
