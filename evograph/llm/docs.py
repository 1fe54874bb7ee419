"""Functions paired with their documentation.

Files are read by an island grammar of their language (types and their modifiers in TypeScript, elements in the
JSX languages): the islands are comments, annotations (decorators), signatures and balanced bodies; all other
code is water that is skipped token by token. An island is keyed by the line on which its function begins, so that
it meets its node by an equality on path and line, however many functions a file holds. A description is kept if something remains of it when markup, tool
directives, stand-ins, pointers, disabled code and restatements of the signature are taken away.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, spread
from ..sources.ecma import check
from .syntax import CODE, Trace, extension, lex, syntax_errors

# ---- what a description says ----

# Words without content of their own.
STOP = frozenset(
    "a an the of to in on at by for from with and or nor but not no if then else so as is are was were be been being it its this that these"
    " those there here which who whom whose what when where will would shall should can could may might must do does did done has have had"
    " i we you they he she them their our your my me us one ones any all each every some such than too very just also only".split()
)
# Words by which a description speaks of code or of itself instead of behaviour.
GENERIC = frozenset(
    "function method class constructor member helper util utility used use uses using take takes taking return returns returned returning"
    " result results outcome argument arguments arg args parameter parameters param params given value values object instance type call calls"
    " called name named nothing void none null undefined string number boolean bool array list any promise type file".split()
)
# Words of stand-ins for a description.
STAND_IN = frozenset(
    "todo fixme xxx tbd tba hack wip description desc describe document documents documented documentation docs doc undocumented comment"
    " comments commented write written writing add added adding later missing placeholder stub template editor inserted insert auto"
    " automatically created create generated generate change changed replace replaced text real please summary fill filled insert pending"
    " self explanatory obvious empty blank lorem ipsum dolor sit amet na n default sample example unknown soon coming ide skeleton boilerplate"
    " foo bar baz explain explanation sentence info information goes go".split()
)
# Beginnings of lines that are meant for tools.
TOOL = re.compile(
    r"^(?:@ts-\w[\w-]*|eslint\b|eslint-|prettier-|istanbul\b|c8\b|v8\b|tslint\b|tslint:|jshint\b|jslint\b|jscs\b|biome-|noinspection\b|nosonar\b"
    r"|webpack\w*|#?(?:end)?region\b|sourcemappingurl|@?flow\b|type-coverage|codecov|coverage[: ]ignore|globals?\s+\w|stylelint|@license|@preserve|@cc_on|vim?:|-\*-|spell-?check|cspell|ts-ignore|ts-expect-error|ts-nocheck|pragma\b|lint-|deno-|@jsx\b|oxlint|sonar)",
    re.I,
)
POINTER = re.compile(r"^(?:please\s+)?(?:see|cf\.?|refer\s+to|same\s+as|as\s+(?:above|below|before)|ditto|likewise|like\s+(?:above|below|before)|look\s+(?:at|into)|consult|read|compare\s+with|described\s+in|documented\s+in|more\s+in|details\s+in)\b", re.I)
TODO = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|hack)\b", re.I)
TAG = re.compile(r"^@(\w+)")
WORD = re.compile(r"[^\W\d_]+(?:'[a-z]+)?|\d+")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
CODE_LINE = re.compile(r"[;{}]\s*$|=>|^\s*[\w$.]+\s*\([^)]*\)\s*$|^\s*(?:const|let|var|return|import|export|await)\b.*[;(=]|^\s*[\w$.\[\]]+\s*[-+*/]?=[^=]")


def stem(w: str) -> str:
    w = w.lower()
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3]
    for s in ("ing", "ed", "es", "s", "e", "y"):
        if w.endswith(s) and len(w) - len(s) >= 2 and not w.endswith("ss"):
            return w[: -len(s)]
    return w


def plain_text(doc: str) -> list[str]:
    """The lines of a documentation text without comment markup and tags of markup languages."""
    doc = doc.replace("\r\n", "\n").replace("\r", "\n")
    doc = re.sub(r"\{@inheritdoc\}", " ", doc, flags=re.I)
    doc = re.sub(r"\{@\w+\s+([^}]*)\}", r"\1", doc)
    doc = re.sub(r"</?[A-Za-z][^<>\n]*>", " ", doc)
    lines = []
    for line in doc.split("\n"):
        line = re.sub(r"^\s*(?:/\*+!?|<!--)", "", line)
        line = re.sub(r"(?:\*+/|-->)\s*$", "", line)
        line = re.sub(r"^\s*(?:///?!?|\*(?!\*)|\*(?=\s|$))", "", line)
        lines.append(line.strip())
    return lines


def units(doc: str) -> list[tuple[str, str]]:
    """(tag or '', text) of a description's parts, directives, separators and disabled code left out."""
    lines = [x for x in plain_text(doc) if WORD.search(x)]
    lines = [x for x in lines if not TOOL.match(x)]
    if lines and all(CODE_LINE.search(x) for x in lines):
        return []
    if lines and any(CODE_LINE.search(x) for x in lines) and check("\n".join(lines), "tsx") is None:
        return []
    lines = [x for x in lines if not re.search(r";\s*$", x) or not CODE_LINE.search(x) or check(x, "ts") is not None]
    out: list[list[str]] = []
    for line in lines:
        m = TAG.match(line)
        if m:
            out.append([m.group(1).lower(), line[m.end() :]])
        elif out:
            out[-1][1] += " " + line
        else:
            out.append(["", line])
    return [(t, x.strip()) for t, x in out]


def has_content(doc: str | None, name: str | None, parameters=None, types: str | None = None) -> bool:
    """Whether a description tells something that the signature doesn't tell already. Null and blank: no."""
    if not doc or not doc.strip():
        return False
    known = {stem(w) for x in [name or "", types or "", *(p or "" for p in (parameters if parameters is not None else []))] for w in CAMEL.findall(x)}
    short = {"".join(c for c in x if c.isalpha()).lower() for x in (name or "").split(".")}
    free = 0
    for tag, text in units(doc):
        if tag in ("see", "link", "author", "since", "version", "todo", "private", "public", "protected", "override", "deprecated", "internal", "inheritdoc", "module", "type", "typedef", "async", "generator", "abstract", "readonly", "static", "memberof", "category", "group", "packagedocumentation") and not (tag == "deprecated" and len(text.split()) > 2):
            continue
        if tag in ("param", "arg", "argument", "returns", "return", "throws", "template", "property", "prop"):
            text = re.sub(r"^\s*\{[^}]*\}", "", text)
            if tag not in ("returns", "return", "throws"):
                text = re.sub(r"^\s*\[?[\w$.]+(?:=[^\]]*)?\]?\s*-?", "", text)
        for sentence in re.split(r"(?<=[.!?:;])\s+|\n", text):
            sentence = sentence.strip()
            if TODO.match(sentence):
                break
            if POINTER.match(sentence) and len(sentence.split()) <= 9:
                continue
            words = [w for w in WORD.findall(sentence) if w.lower() not in STOP]
            rest = [w for w in words if stem(w) not in known and w.lower() not in GENERIC and w.lower() not in short and not all(stem(c) in known for c in CAMEL.findall(w))]
            if not [w for w in rest if w.lower() not in STAND_IN]:
                continue
            if len([w for w in words if w.lower() in STAND_IN or w.lower() in GENERIC]) > 0.6 * len(words):
                continue
            need = 4 if tag in ("param", "arg", "argument", "returns", "return", "template", "property", "prop") else 2
            if len(rest) >= need:
                return True
            if not tag:
                free += len(rest)
    # single words over several sentences
    return free >= 3


# ---- islands ----

# Words that may stand before a function's own.
_MODIFIERS = "export default declare async public private protected static abstract override readonly get set accessor".split()
_SCRIPT_MODIFIERS = "export default async static get set accessor".split()
_NAME = r"[\w$#]+|\[[^\]\n]+\]|'[^'\n]+'|\"[^\"\n]+\""


class Grammar:
    """What an island looks like in one language."""

    def __init__(self, types: bool, jsx: bool):
        self.types, self.jsx = types, jsx
        words = "|".join(_MODIFIERS if types else _SCRIPT_MODIFIERS)
        call = r"[(<]" if types else r"\("  # what begins a signature
        typed = r"(?::[^=\n]+)?" if types else ""
        arrow = r"(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*\s*(?=\()|(?=\(|[\w$]+\s*=>" + (r"|<" if types else "") + r"))"
        # a signature up to its parenthesis: functions, functions as values of names, of members and of properties, methods
        self.head = re.compile(
            rf"(?:(?:{words})\s+|\*\s*)*"
            rf"(?:function\b\s*\*?\s*(?P<f>[\w$]*)\s*(?={call})|(?:const|let|var)\s+(?P<v>[\w$]+)\s*{typed}=\s*{arrow}"
            rf"|(?P<k>{_NAME})\s*(?::|{typed}=(?![=>]))\s*{arrow}|(?P<m>{_NAME})\s*\??\s*(?={call}))"
        )
        # between the parameters and the body: a return type where there are types, the arrow; braces directly behind
        # a sign of the type belong to it
        result = r"(?::\s*(?:(?:[^={;\n]*[|&<,(:]\s*)?\{[^{}\n]*\})*[^={;\n]*)?" if types else ""
        self.tail = re.compile(rf"\s*{result}\s*(=>)?\s*")


GRAMMARS = {"ts": Grammar(True, False), "tsx": Grammar(True, True), "js": Grammar(False, False), "jsx": Grammar(False, True)}

LINE = re.compile(r"^[ \t\ufeff]*(?=\S)", re.M)
SPACES = re.compile(r"[ \t]*")
#: Behind these on a line a further function can begin.
WITHIN = re.compile(r"[;{},][ \t]*(?=[A-Za-z_$*#'\"@\[])")
ANNOTATION = re.compile(r"@[\w$.]+[ \t]*")
BLANKS = re.compile(r"\s*")
# Words before a parenthesis that begin no method.
NOT_METHOD = frozenset("if for while switch catch return function await typeof new throw super this import export do else case with yield void delete".split())


def scan(text: str, grammar: Grammar) -> tuple[list[tuple[int, int, bool]], list[int], dict[int, int]]:
    """Comments as (start, end, whether first on their line), offsets at which code can begin an island, and which bracket closes which."""
    trace = Trace()
    lex(text, CODE, 0, trace, grammar.jsx, grammar.types)
    comments = []
    for a, b in trace.comments:
        ahead = text[text.rfind("\n", 0, a) + 1 : a]
        comments.append((a, b, not ahead.strip() or re.fullmatch(r"\s*(?:/\*.*?\*/\s*)+", ahead) is not None))
    spans = sorted(trace.comments + trace.templates)
    starts = [a for a, _ in spans]

    def behind(at: int) -> int:
        """The first code of a line from an offset on, behind comments; -1 if the line has none."""
        while True:
            i = bisect_right(starts, at) - 1
            if i < 0 or at >= spans[i][1]:
                return at
            end = spans[i][1]
            if "\n" in text[at:end]:
                return -1
            at = SPACES.match(text, end).end()
            if at >= len(text) or text[at] == "\n":
                return -1

    firsts = {behind(m.end()) for p in (LINE, WITHIN) for m in p.finditer(text)}
    return comments, sorted(firsts - {-1}), trace.match


def annotated(text: str, at: int, match: dict[int, int], comments: dict[int, int]) -> int:
    """The offset behind the annotations that begin at an offset, and behind comments between them."""
    while True:
        m = ANNOTATION.match(text, at)
        if m:
            at = m.end()
            if text[at : at + 1] == "(":
                if at not in match:
                    return at
                at = match[at] + 1
        elif at in comments:
            at = comments[at]
        else:
            return at
        at = BLANKS.match(text, at).end()


class Island(NamedTuple):
    """A function: its name as typed, its signature and its code to the end of the balanced body."""

    name: str
    signature: str
    code: str


def islands(text: str, ext: str = "ts") -> dict[int, tuple[str | None, list[Island]]]:
    """line -> (comment that ends on the line above, functions that begin on the line) of a file, for lines with either.

    Lines count from 1. Code runs from the function's first word, or from its annotations, to the end of its
    balanced body, or of its signature if it has none. A function behind annotations is found by their first line and
    by its own. Comments of one line each that stand below one another are one comment.
    """
    grammar = GRAMMARS.get(ext, GRAMMARS["ts"])
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    comments, firsts, match = scan(text, grammar)
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    line_of = lambda at: bisect_right(starts, at)
    docs: dict[int, str] = {}
    run: tuple[int, str] | None = None  # line and text of the comments of one line directly above
    for a, b, first in comments:
        if not first:
            run = None
            continue
        body, begin, end = text[a:b], line_of(a), line_of(max(a, b - 1))
        if body.startswith("//"):
            body = run[1] + "\n" + body if run and run[0] == begin - 1 else body
            run = (end, body)
        else:
            run = None
        docs[end + 1] = body
    ends = {a: b for a, b, _ in comments}
    found: dict[int, list[Island]] = {}
    seen: set[int] = set()
    for begin in firsts:
        at = annotated(text, begin, match, ends) if text[begin] == "@" else begin
        m = grammar.head.match(text, at)
        if not m or at in seen or not (m["f"] is not None or m["v"] or m["k"] or m["m"]) or m["m"] in NOT_METHOD:
            continue
        value = bool(m["v"] or m["k"])
        p = text.find("(", m.end())
        if p not in match and not value:
            continue
        end = match.get(p, m.end()) + 1
        tail = grammar.tail.match(text, end)
        q = tail.end()
        if (m["m"] or m["k"]) and text[q : q + 1] != "{" and not (m["k"] and tail[1]):
            continue
        seen.add(at)
        code_end = match.get(q, q) + 1 if text[q : q + 1] == "{" else (text.find("\n", q) if value and text.find("\n", q) > 0 else end)
        island = Island((m["f"] or m["v"] or m["k"] or m["m"] or "").strip("'\""), text[at:end].strip(), text[begin:code_end])
        found.setdefault(line_of(begin), []).append(island)
        if line_of(at) > line_of(begin):
            found.setdefault(line_of(at), []).append(island._replace(code=text[at:code_end]))
    return {line: (docs.get(line), found.get(line, [])) for line in docs.keys() | found.keys()}


_ISLANDS = "file_path string, line int, comment string, functions array<struct<name:string,signature:string,code:string>>"


def _islands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, text in zip(f.file_path, f.content):
            text = text[1:] if text.startswith("\ufeff") else text
            rows += [(path, line, comment, [x._asdict() for x in fs]) for line, (comment, fs) in islands(text, extension(path)).items()]
        yield pd.DataFrame(rows, columns=["file_path", "line", "comment", "functions"])


def file_islands(files: DataFrame) -> DataFrame:
    """Rows (file_path, line, comment, functions) of all islands of the files; repeated paths count once."""
    once = files.select("file_path", "content").where("file_path IS NOT NULL AND content <> ''")
    return spread(once, "file_path").dropDuplicates(["file_path"]).mapInPandas(_islands, _ISLANDS)


@F.pandas_udf(T.BooleanType())
def _content(doc: pd.Series, name: pd.Series, parameters: pd.Series, types: pd.Series) -> pd.Series:
    return pd.Series([has_content(*x) for x in zip(doc, name, parameters, types)], dtype=bool)


@F.pandas_udf(T.StringType())
def _described(doc: pd.Series) -> pd.Series:
    return doc.map(lambda x: "\n".join(f"@{t} {s}" if t else s for t, s in units(x)))


def documented_functions(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (id, file_path, name, parameters, signature, code, description, documented_by), one per function id.

    nodes: id, node_type, name, file_path, line_start, documentation, parameters, return_type, ord. Of the
    repeated rows of an id, the one with the highest ord counts. The documentation is nodes.documentation or,
    where that is null, the comment that ends on the line above the function, if the file parses. Functions
    whose documentation is missing or without content are left out. Of several functions on a line the one of the
    node's name is taken, else the first. Code and signature are null where the file is unknown or has no
    function on that line; null ids, and nulls elsewhere, do no harm. Only files of which a comment would count are
    parsed, by the operator of syntax errors; the rows up to there are kept (a checkpoint).
    """
    w = Window.partitionBy("id").orderBy(F.col("ord").desc_nulls_last(), F.col("documentation").desc_nulls_last(), "line_start")
    functions = (
        nodes.where("node_type = 'function' AND id IS NOT NULL")
        .select("id", "name", "file_path", "line_start", "documentation", "parameters", "return_type", "ord")
        .withColumn("rn", F.row_number().over(w))
        .where("rn = 1")
        .drop("rn", "ord")
    )
    found = file_islands(files).withColumnRenamed("line", "line_start")
    short = F.element_at(F.split(F.coalesce("name", F.lit("")), r"\."), -1)
    named = F.filter("functions", lambda x: x["name"] == short)
    kept = cut(
        functions.join(found, ["file_path", "line_start"], "left")
        .withColumn("doc", F.coalesce("documentation", "comment"))
        .where("doc IS NOT NULL AND trim(doc) <> ''")
        .where(_content("doc", "name", "parameters", "return_type"))
        .withColumn("island", F.coalesce(F.get(named, F.lit(0)), F.get("functions", F.lit(0))))
        .select(
            "id", "file_path", "name", "parameters", "island.signature", "island.code", _described("doc").alias("description"),
            F.when(F.col("documentation").isNull(), "comment").otherwise("node").alias("documented_by"),
        )
    )
    asked = kept.where("documented_by = 'comment'").select("file_path").distinct()
    # kept, for the operator reads its files twice
    some = cut(files.select(F.col("file_path").alias("repo"), "file_path", "content").where("content <> ''").join(asked, "file_path", "left_semi").dropDuplicates(["file_path"]))
    broken = syntax_errors(some.withColumn("file_id", F.xxhash64("file_path"))).where("evidence <> 'depth'").select("file_path").distinct()
    by_comment = kept.where("documented_by = 'comment'").join(broken, "file_path", "left_anti").select(*kept.columns)
    return kept.where("documented_by = 'node'").union(by_comment)
