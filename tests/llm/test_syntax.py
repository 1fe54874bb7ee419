import random
from functools import reduce

from evograph.llm.syntax import CODE, chunk_map, chunks, combine, judge, syntax_errors, syntax_rates
from evograph.sources.ecma import check

GOOD = """import a from 'a';
/* a ' comment */
const x = `t ${ { a: `n${1}` }.a } ' end`;
function f(a) {
  if (a) { return /[/'"]/.test(a) ? 'it' : "x"; }
  if (a) /['"]/.test(a);
  return (a) / 2 / 3;
}
export class A { m() { return [1, (2)]; } }
const y = { a: 1 };
"""
GOOD_JSX = """import a from 'a';
export function B({ items }) {
  const n = items.length < 3 ? items.length / 2 : 1;
  return (
    <div className="it's" title={`n ${n}`} {...items}>
      Don't {n > 1 && <b key='x'>stop "now"</b>} // no comment
      <><img alt="}" /> it's {/* a ' comment */} {items.map((x) => <i>{x}'</i>)}</>
      <A.B icon=<b/> />
    </div>
  );
}
const C = () => <p>'</p>;
export const y = { a: 1 };
"""


def mutants(text, n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        p = rng.randrange(len(text))
        yield text[:p] + rng.choice(["", "}", "(", "`", "'", "/*", "\n", ";", "<", ">", "</b>", "<b>", "{"]) + text[p + rng.randint(0, 2) :]


def test_verdict_by_summaries_and_runs_is_the_whole_files():
    for text, ext in ((GOOD, "js"), (GOOD_JSX, "jsx"), (GOOD_JSX, "tsx")):
        assert check(text, ext) is None
        for t in (text, *mutants(text, 250, 5)):
            for size in (5, 40, 10_000):
                assert bool(judge(t, ext, size)) == bool(check(t, ext)), (size, t)


def test_evidence():
    tell = lambda t, ext="ts": judge(t, ext) and (judge(t, ext).evidence, t.count("\n", 0, judge(t, ext).at) + 1)
    assert tell("const a = 1;\nfunction f() {\n") == ("summary", 2)
    assert tell("const a = 1;\n}\n") == ("summary", 2)
    assert tell("const a = 'x\nlet b;\n") == ("summary", 1)
    assert tell("const a = 1;\n/* x\n") == ("summary", 2)
    assert tell("a();\n<<<<<<< HEAD\nb();\n=======\nc();\n>>>>>>> x\n") == ("summary", 2)
    assert tell("const s = `\n<<<<<<< HEAD\n`;\n") is None
    assert tell("const a = 1;\nconst b = = 2;\nconst c = 3;\n") == ("statement", 2)
    assert tell("function f() {}\nconst f = 1;\n", "js") == ("names", 2)
    assert tell("x = <a>it's</a>;\n", "tsx") is None and tell("x = <a>it's</b>;\n", "tsx") == ("summary", 1)
    # a slash behind a brace may divide or begin a regular expression: only the whole tells
    assert tell("x = {} / 1 / (2;\n", "js")[0] == "whole"


def test_deep_nesting_is_judged():
    n = 20_000
    assert judge("x = " + "(" * n + "1" + ")" * n + ";", "js") is None
    assert judge("x = " + "(" * n + "1 1" + ")" * n + ";", "js").evidence == "statement"


def test_combination_is_associative():
    for text, ext in ((GOOD, "ts"), (GOOD_JSX, "jsx")):
        maps = [chunk_map(t, i == 0, base, ext) for i, (base, t) in enumerate(chunks(text, 20))]
        left = reduce(combine, maps)
        right = reduce(lambda b, a: combine(a, b), reversed(maps))
        assert left == right
    maps = [chunk_map(t, i == 0, base) for i, (base, t) in enumerate(chunks(GOOD, 20))]
    left, one = reduce(combine, maps), chunk_map(GOOD, True, 0)
    assert left[CODE].state == one[CODE].state and set(left[CODE].cuts) <= set(one[CODE].cuts) and left[CODE].opened == one[CODE].opened == ()


def test_table(spark):
    rows = [
        (1, "r", "r/a.ts", "const a: number = 1"), (1, "r", "r/a.ts", "const a: number = 1"), (2, "r", "r/a.js", "const a: number = 1"),
        (3, None, "a.tsx", None), (4, None, "a.jsx", "<a>"), (5, "r", None, "("), (6, "r", "r/x.css", "{{"), (7, "s", "s/e.ts", ""),
        (8, "s", "s/long.js", "f(1);\n" * 60_000 + "f("), (9, "s", "s/fine.js", "f(1);\n" * 60_000),
    ]
    df = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string").selectExpr("*", "1 AS line", "2 AS part")
    found = {r.file_id: (r.evidence, r.line) for r in syntax_errors(df).collect()}
    assert found == {2: ("statement", 1), 4: ("summary", 1), 8: ("summary", 60_001)}
    rates = {(r.repo, r.language): (r.files, r.broken, r.not_judged, r.rate) for r in syntax_rates(df).collect()}
    assert rates[("r", "javascript")] == (1, 1, 0, 1.0) and rates[("r", "typescript")] == (1, 0, 0, 0.0) and rates[(None, "jsx")] == (1, 1, 0, 1.0)
    assert rates[("r", "other")] == (2, 0, 0, 0.0)
    assert syntax_errors(df.limit(0)).count() == 0


def test_many_chunks_over_tasks(spark):
    """Files cut into many chunks, which are summarised, reduced and parsed apart, get the verdicts of files in one piece."""
    texts = [(GOOD * 1, "js"), (GOOD_JSX, "jsx"), *((t, "js") for t in mutants(GOOD, 25, 1)), *((t, "tsx") for t in mutants(GOOD_JSX, 25, 2)), ("".join(f"function f{i}() {{}}\n" for i in range(9)) + "const f3 = 1;\n", "js")]
    rows = [(i, "r", f"r/{i}.{e}", t) for i, (t, e) in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string")
    one = {r.file_id: r.line for r in syntax_errors(df).collect()}
    many = {r.file_id: r for r in syntax_errors(df, 30).collect()}
    assert one.keys() == many.keys() == {i for i, (t, e) in enumerate(texts) if check(t, e)}
    assert {"summary", "statement"} <= {r.evidence for r in many.values()}
    assert many[len(texts) - 1].evidence == "names" and many[len(texts) - 1].ext == "js" and all(r.line >= 1 for r in many.values())
