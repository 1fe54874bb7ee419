"""Source files that do not parse.

A file is cut into chunks at line ends. Every chunk is summarised without knowing what comes before it, as a
*lexer-state map*: for each state the lexer can be in at a line start (code where a regular expression may
follow, code where it may not, block comment, template text, and in JSX the inside of a tag and the text of an
element) the state at the chunk's end, the brackets and elements it closes and opens beyond itself, and the
places at which a top-level statement can begin. Two summaries combine into one of the same form and the
combination is associative, so the summaries of a file reduce in any grouping: those of a file of one chunk in
the task that made them, those of a larger file over tasks, by runs of chunks first. The reduced summary
decides on files that are unbalanced, unterminated or marked by a merge conflict, and tells where. It cuts the
rest into balanced runs of statements; each run is parsed by a local grammar of the file's language, wherever
it lies, and the names that runs declare and export are merged.

What a summary can't decide (whether a brace beyond the chunk was a template's hole or a tag's, a slash behind
a closing brace, a type parameter that looks like an element) is a counted doubt: only such files are parsed
whole, and their rows say so in the column evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from ..sources.ecma import REGEX, check, segment

#: Characters of a chunk, at least; it ends with the line.
CHUNK = 1 << 16
#: Chunks whose summaries one task reduces before those of the whole file are.
RUN = 64

CODE, VALUE, COMMENT, TEMPLATE, TAG, ELEMENT = range(6)
PAIRS = {")": "(", "]": "[", "}": "{", "`": "`"}
#: The state behind a closing brace or the end of an element, by what was opened.
BEHIND = {"${": TEMPLATE, "A{": TAG, "J{": ELEMENT, "<": VALUE, "<a": TAG, "<e": ELEMENT}

# Words behind which an operand follows.
OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else await yield default extends".split())
# Words whose parenthesis is followed by a statement.
CONDITION = frozenset("if while for with".split())

TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")


class Summary(NamedTuple):
    """What a chunk does to a lexer that enters it in one state."""

    state: int  # at the end; -1 if only the text can tell
    closed: tuple  # (kind, offset) of brackets closed that were opened before
    opened: tuple  # (kind, offset) of brackets opened and not closed
    cuts: tuple  # (offset, brackets closed before it) of statement starts outside all of the chunk's brackets
    bad: int  # offset of the first thing that can't be in a valid file, or -1
    why: str  # what it is
    doubt: bool  # whether something was taken for one thing that may be another


# What the lexer stops at: texts, comments, brackets, slashes, conflict markers, and words at the beginning of a
# line that can begin a statement. All else lies between and is looked back at where it matters.
_STOP = (
    r"(?P<q>'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\")|(?P<l>//[^\n]*)|(?P<c>/\*)|(?P<o>[(\[{])|(?P<x>[)\]}])|(?P<t>`)|(?P<d>/)|(?P<u>['\"])"
    r"|(?P<w>^(?:import|export|const|var|function|class|enum)(?![\w$]))|(?P<m>^(?:<{7}|={7}|>{7}|\|{7})(?=[ \n]|\Z))"
)
STOP = re.compile(_STOP, re.M)
STOP_JSX = re.compile(_STOP + r"|(?P<j><(?=[A-Za-z_$>]))", re.M)
LAST_WORD = re.compile(r"[\w$\u0080-\U0010ffff]+$")
# Inside a tag and in the text of an element.
IN_TAG = re.compile(r"(?P<q>\"[^\"]*\"|'[^']*')|(?P<l>//[^\n]*)|(?P<c>/\*)|(?P<o>\{)|(?P<e>/\s*>)|(?P<g>>)|(?P<j><(?=[A-Za-z_$>]))|(?P<u>['\"}<(;])")
IN_TEXT = re.compile(r"[^<{>}]*(?:(?P<o>\{)|(?P<e></\s*(?P<name>[\w$.:\-]*)\s*>)|(?P<j><(?=[A-Za-z_$>]))|(?P<u>[<>}]))?")
ELEMENT_NAME = re.compile(r"<([\w$.:\-]*)")
GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\s+(?!=)|=(?![>\s]*[\"'{]))")
MAYBE_GENERIC = re.compile(r"<\s*[\w$]+\s*>\s*\(")


class Trace:
    """What the lexer met on its way: spans of comments, spans of template text, and which bracket closes which."""

    def __init__(self):
        self.comments: list[tuple[int, int]] = []
        self.templates: list[tuple[int, int]] = []
        self.match: dict[int, int] = {}


def lex(text: str, state: int, base: int = 0, trace: Trace | None = None, jsx: bool = False, ts: bool = True) -> Summary:
    """Run the lexer over one chunk from one entry state."""
    trace = trace or Trace()
    closed: list[tuple[str, int]] = []
    opened: list[tuple[str, int]] = []
    names: list[str] = []  # of the elements that are open
    cuts: list[tuple[int, int]] = []
    comments = trace.comments  # to look back over
    entry = state if state in (CODE, VALUE) else CODE
    bad, why, doubt, p, n = -1, "", False, 0, len(text)
    stop = STOP_JSX if jsx else STOP
    opener: dict[int, int] = {}  # offsets of opening parentheses by those of closing ones
    slashes: set[int] = set()  # offsets of characters that end a regular expression
    elements: set[int] = set()  # offsets of characters that end an element

    def before(at: int) -> int:
        """Offset of the last character of code before an offset, or -1."""
        i = len(comments) - 1
        while True:
            while at > 0 and text[at - 1].isspace():
                at -= 1
            while i >= 0 and comments[i][1] > at:
                i -= 1
            if i >= 0 and comments[i][1] == at:
                at = comments[i][0]
                continue
            return at - 1

    def word_at(i: int) -> str:
        return LAST_WORD.search(text, max(0, i - 15), i + 1).group()

    def value_at(at: int) -> int:
        """CODE or VALUE: whether an operand has ended before an offset; -1 - that where it may be the other way."""
        i = before(at)
        if i < 0:
            return entry
        c = text[i]
        if c == ")":
            if i not in opener:
                return -1 - VALUE
            j = before(opener[i])
            if j >= 0 and (text[j].isalnum() or text[j] in "_$") and word_at(j) in CONDITION:
                return CODE
            return VALUE
        if c in "]'\"`":
            return VALUE
        if c == "}":
            return -1 - CODE
        if c.isalnum() or c in "_$" or c >= "\x80":
            w = word_at(i)
            return CODE if w in OPERAND and text[i - len(w) : i - len(w) + 1] != "." else VALUE
        if c in "+-" and i and text[i - 1] == c:
            return value_at(i - 1)
        if c == "/" and i in slashes or c == ">" and i in elements:
            return VALUE
        return CODE

    def wrong(at: int, what: str) -> None:
        nonlocal bad, why
        if bad < 0:
            bad, why = base + at, what

    def out(state: int) -> Summary:
        return Summary(state, tuple(closed), tuple(opened), tuple(cuts), bad, why, doubt)

    def begin(at: int, kind: str) -> int:
        """Open an element; the offset behind its name."""
        m = ELEMENT_NAME.match(text, at)
        opened.append((kind, base + at))
        names.append(m[1])
        return m.end()

    def finish(end: int, name: str | None = None) -> int:
        """Close the element that is open; the state behind it."""
        nonlocal doubt
        if not opened or opened[-1][0] not in ("<", "<a", "<e"):
            doubt = True  # of an element that began before the chunk
            return VALUE
        kind, at = opened.pop()
        if name is not None and name != names[-1]:
            wrong(end, "closing tag doesn't match")
        names.pop()
        elements.add(end)
        return BEHIND[kind]

    if base == 0 and state == CODE and text.startswith(("#!", "\ufeff#!")):
        p = text.find("\n") if "\n" in text else n
        comments.append((0, p))
    while p < n:
        if state == COMMENT:
            e = text.find("*/", p)
            end = n if e < 0 else e + 2
            comments.append((p, end))
            if e < 0:
                return out(COMMENT)
            p, state = end, CODE
            continue
        if state == TEMPLATE:
            m = TEXT.match(text, p)
            trace.templates.append((p, m.end()))
            p = m.end()
            if m.group(1) is None:
                return out(TEMPLATE)
            if m.group(1) == "`":
                if opened:
                    opened.pop()
                else:
                    closed.append(("`", base + p - 1))
            else:
                opened.append(("${", base + p - 1))
            state = CODE
            continue
        if state == TAG:
            m = IN_TAG.search(text, p)
            if not m:
                return out(TAG)
            k, at, p = m.lastgroup, m.start(), m.end()
            if k == "l":
                comments.append((at, p))
            elif k == "c":
                e = text.find("*/", p)
                if e < 0:
                    doubt = True
                    return out(TAG)
                p = e + 2
            elif k == "o":
                opened.append(("A{", base + at))
                state = CODE
            elif k == "e":
                state = finish(p - 1)
            elif k == "g":
                state = ELEMENT
            elif k == "j":
                i = before(at)
                if text[i] == "=":
                    p = begin(at, "<a")
                else:
                    doubt = True
                    return out(TAG)
            elif k == "u":
                doubt = doubt or ts and text[at] in "<("
                wrong(at, "unexpected token")
            continue
        if state == ELEMENT:
            m = IN_TEXT.match(text, p)
            k, p = m.lastgroup, m.end()
            if k is None:
                return out(ELEMENT)
            if k == "o":
                opened.append(("J{", base + p - 1))
                state = CODE
            elif k == "j":
                p = begin(p - 1, "<e")
                state = TAG
            elif k == "u":
                wrong(p - 1, "stray token in text")
            else:
                state = finish(p - 1, m["name"])
            continue
        m = stop.search(text, p)
        if not m:
            break
        k, at = m.lastgroup, m.start()
        p = m.end()
        if k == "o":
            opened.append((text[at], base + at))
        elif k == "x":
            v = text[at]
            if opened:
                top, place = opened[-1]
                if v == "}" and top in BEHIND and top[0] != "<":
                    opened.pop()
                    state = BEHIND[top]
                elif PAIRS[v] != top:
                    wrong(at, "brackets don't match")
                else:
                    opened.pop()
                    trace.match[place - base] = at
                    opener[at] = place - base
            else:
                closed.append((v, base + at))
        elif k == "w":
            # the text before the chunk is not known, so that only a file's first word counts without one
            if not opened:
                i = before(at)
                if i >= 0 and text[i] in ";}" or i < 0 and base == 0:
                    cuts.append((base + at, len(closed)))
        elif k == "l":
            comments.append((at, p))
        elif k == "c":
            e = text.find("*/", at + 2)
            if e < 0:
                comments.append((at, n))
                return out(COMMENT)
            comments.append((at, e + 2))
            p = e + 2
        elif k == "t":
            opened.append(("`", base + at))
            state = TEMPLATE
        elif k == "d":
            r = REGEX.match(text, at)
            if r:
                v = value_at(at)
                if v < 0:
                    doubt, v = True, -1 - v
                if v == CODE:
                    p = r.end()
                    slashes.add(p - 1)
        elif k == "j":
            if value_at(at) in (CODE, -1 - CODE) and not (ts and GENERIC.match(text, at)):
                doubt = doubt or ts and MAYBE_GENERIC.match(text, at) is not None
                p = begin(at, "<")
                state = TAG
        elif k == "m":
            wrong(at, "conflict marker")
        elif k == "u":
            wrong(at, "unterminated text")
    if state not in (CODE, VALUE):
        return out(state)
    v = value_at(n)
    return out(-1 - v if v < 0 else v)


def chunk_map(text: str, first: bool, base: int, ext: str = "ts") -> dict[int, Summary]:
    """The chunk's lexer-state map; the first chunk of a file is entered in one state only."""
    jsx = ext in ("tsx", "jsx")
    states = (CODE,) if first else (CODE, VALUE, COMMENT, TEMPLATE, TAG, ELEMENT)[: 6 if jsx else 4]
    return {s: lex(text, s, base, None, jsx, ext in ("ts", "tsx")) for s in states}


def _join(a: Summary, b: Summary) -> Summary:
    n = min(len(a.opened), len(b.closed))
    bad, why = (a.bad, a.why) if a.bad >= 0 else (b.bad, b.why)
    for i in range(n):
        (top, _), (c, at) = a.opened[-1 - i], b.closed[i]
        if PAIRS.get(c) != top:
            if c == "}" and top in BEHIND:
                return Summary(-1, (), (), (), bad, why, True)  # only the text itself can tell
            if bad < 0 or at < bad:
                bad, why = at, "brackets don't match"
    closed = a.closed + b.closed[n:]
    opened = a.opened[: len(a.opened) - n] + b.opened
    cuts = a.cuts + tuple((at, len(a.closed) + k - len(a.opened)) for at, k in b.cuts if k >= len(a.opened))
    return Summary(b.state, closed, opened, cuts, bad, why, a.doubt or b.doubt)


def combine(a: dict[int, Summary], b: dict[int, Summary]) -> dict[int, Summary]:
    """The map of two neighbouring stretches; associative."""
    out = {}
    for s, x in a.items():
        y = b.get(x.state)
        out[s] = _join(x, y) if y is not None else x._replace(state=-1, doubt=True)
    return out


def chunks(text: str, size: int = CHUNK) -> Iterator[tuple[int, str]]:
    """(offset, text) of a file's chunks; a cut lies behind a line end that no backslash escapes."""
    p = 0
    while p < len(text):
        e = p + size
        while e < len(text):
            e = text.find("\n", e)
            if e < 0:
                break
            e += 1
            if text[e - 2 : e - 1] != "\\":
                break
        if e < 0 or e >= len(text):
            e = len(text)
        yield p, text[p:e]
        p = e


class Verdict(NamedTuple):
    """A syntax error, and what told it: summary, statement (a local grammar), names (of several runs), whole, depth."""

    evidence: str
    error: str
    at: int


def decide(whole: Summary) -> Verdict | None | list[int]:
    """What a file's reduced summary tells: an error, nothing (None, a doubt), or the offsets of its balanced runs."""
    if whole.doubt or whole.state < 0:
        return None
    if whole.bad >= 0:
        return Verdict("summary", whole.why, whole.bad)
    if whole.closed:
        return Verdict("summary", f"{whole.closed[0][0]} without an opening one", whole.closed[0][1])
    if whole.opened or whole.state not in (CODE, VALUE):
        kind, at = whole.opened[-1] if whole.opened else ("comment", -1)
        return Verdict("summary", "input ended too early" if kind != "comment" else "unterminated comment", at)
    return [0, *(c for c, k in whole.cuts if k == 0 and c > 0)]


class Run(NamedTuple):
    """What the local grammar tells of a balanced run of statements."""

    at: int
    error: str | None
    where: int
    declared: list[str]
    exported: list[str]


def parse_run(text: str, at: int, ext: str) -> Run:
    error, declared, exported = segment(text, ext)
    return Run(at, error[0] if error else None, at + error[1] if error else -1, declared, exported)


def merge(runs: list[Run]) -> Verdict | None:
    """The first error of a file's runs in their order: of one of them, or of a name that two declare or export."""
    names: set[str] = set()
    exports: set[str] = set()
    for r in runs:
        if r.error is not None:
            return Verdict("depth" if r.where < r.at else "statement", r.error, max(r.where, r.at))
        clash = any(x in names or f"var {x}" in names or x.startswith("var ") and x[4:] in names for x in r.declared if not (x.startswith("var ") and x in names))
        if clash or exports.intersection(r.exported):
            return Verdict("names", "name declared twice" if clash else "exported twice", r.at)
        names.update(r.declared)
        exports.update(r.exported)
    return None


def parse_whole(text: str, ext: str) -> Verdict | None:
    error = check(text, ext)
    return Verdict("depth" if error[1] < 0 else "whole", error[0], error[1]) if error else None


def judge(text: str, ext: str, size: int = CHUNK) -> Verdict | None:
    """The first syntax error of a file, or None: by its summary, its runs, and only in doubt by a parse of the whole."""
    whole = reduce(combine, [chunk_map(t, i == 0, b, ext) for i, (b, t) in enumerate(chunks(text, size))])[CODE]
    found = decide(whole)
    if found is None:
        return parse_whole(text, ext)
    if isinstance(found, Verdict):
        # a comment is all that is open without a bracket
        return found if found.at >= 0 else found._replace(at=max(text.rfind("/*"), 0))
    return merge([parse_run(text[a:b], a, ext) for a, b in zip(found, [*found[1:], len(text)])])


def extension(path: str | None) -> str:
    ext = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""
    return {"mts": "ts", "cts": "ts", "mjs": "js", "cjs": "js"}.get(ext, ext)


JUDGED = ("ts", "tsx", "js", "jsx")
_ERROR = "file_id long, repo string, file_path string, ext string, evidence string, error string, line int"
_COLUMNS = ["file_id", "repo", "file_path", "ext", "evidence", "error", "line"]


def _small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files of one chunk: summarised, cut into runs and parsed in one go."""
    for f in frames:
        rows = []
        for file_id, repo, path, text in zip(f.file_id, f.repo, f.file_path, f.content):
            ext = extension(path)
            v = judge(text, ext) if text and ext in JUDGED else None
            if v:
                rows.append((file_id, repo, path, ext, v.evidence, v.error, text.count("\n", 0, max(v.at, 0)) + 1))
        yield pd.DataFrame(rows, columns=_COLUMNS)


_PARTS = "file_id long, ext string, part long, base long, text string"
_MAP = "array<struct<entry:int,state:int,closed:array<string>,closed_at:array<long>,opened:array<string>,opened_at:array<long>,at:array<long>,depth:array<int>,bad:long,why:string,doubt:boolean>>"


def _pack(m: dict[int, Summary]) -> list[dict]:
    return [
        {"entry": e, "state": s.state, "closed": [k for k, _ in s.closed], "closed_at": [a for _, a in s.closed], "opened": [k for k, _ in s.opened], "opened_at": [a for _, a in s.opened],
         "at": [a for a, _ in s.cuts], "depth": [k for _, k in s.cuts], "bad": s.bad, "why": s.why, "doubt": s.doubt}
        for e, s in m.items()
    ]


def _unpack(m) -> dict[int, Summary]:
    ints = lambda x: map(int, x)
    return {
        int(x["entry"]): Summary(int(x["state"]), tuple(zip(x["closed"], ints(x["closed_at"]))), tuple(zip(x["opened"], ints(x["opened_at"]))), tuple(zip(ints(x["at"]), ints(x["depth"]))), int(x["bad"]), x["why"], bool(x["doubt"]))
        for x in m
    }


def _reduce(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("part")
    out = reduce(combine, map(_unpack, frame["map"]))
    return pd.DataFrame([(frame.file_id.iloc[0], int(frame.part.iloc[0]), _pack(out))], columns=["file_id", "part", "map"])


def large_files(once: DataFrame, size: int) -> DataFrame:
    """syntax_errors for files of several chunks: the chunks of a file are summarised, reduced and parsed in many tasks."""

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, extension(p), k, b, t) for i, p, text in zip(f.file_id, f.file_path, f.content) if extension(p) in JUDGED for k, (b, t) in enumerate(chunks(text, size))]
            yield pd.DataFrame(rows, columns=["file_id", "ext", "part", "base", "text"])

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, _pack(chunk_map(t, k == 0, b, e))) for i, e, k, b, t in zip(f.file_id, f.ext, f.part, f.base, f.text)]
            yield pd.DataFrame(rows, columns=["file_id", "part", "map"])

    def verdicts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, m in zip(f.file_id, f["map"]):
                d = decide(_unpack(m)[CODE])
                rows.append((i, None, None, -1, None) if d is None else (i, d.evidence, d.error, d.at, None) if isinstance(d, Verdict) else (i, None, None, -1, d))
            yield pd.DataFrame(rows, columns=["file_id", "evidence", "error", "at", "runs"])

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A chunk's share of each run that it holds a part of."""
        for f in frames:
            rows = []
            for i, e, k, b, t, runs in zip(f.file_id, f.ext, f.part, f.base, f.text, f.runs):
                starts = [int(x) for x in runs]
                for x, y in zip(starts, [*starts[1:], b + len(t) + 1]):
                    lo, hi = max(x, b), min(y, b + len(t))
                    if lo < hi:
                        rows.append((i, e, x, lo, t[lo - b : hi - b]))
            yield pd.DataFrame(rows, columns=["file_id", "ext", "run", "base", "text"])

    def parse(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("base")
        r = parse_run("".join(frame.text), int(frame.run.iloc[0]), frame.ext.iloc[0])
        return pd.DataFrame([(frame.file_id.iloc[0], *r)], columns=["file_id", "run", "error", "at", "declared", "exported"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        v = merge([Run(int(a), e, int(w), list(d), list(x)) for a, e, w, d, x in frame.sort_values("run")[["run", "error", "at", "declared", "exported"]].itertuples(index=False)])
        return pd.DataFrame([(frame.file_id.iloc[0], *v)] if v else [], columns=["file_id", "evidence", "error", "at"])

    def doubted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(i, parse_whole(t, extension(p))) for i, p, t in zip(f.file_id, f.file_path, f.content)]
            yield pd.DataFrame([(i, *v) for i, v in found if v], columns=["file_id", "evidence", "error", "at"])

    found = "file_id long, evidence string, error string, at long"
    parts = spread(once.mapInPandas(cut_up, _PARTS), "file_id", "part")
    maps = parts.mapInPandas(summarise, f"file_id long, part long, map {_MAP}")
    some = maps.withColumn("run", F.floor(F.col("part") / RUN)).groupBy("file_id", "run").applyInPandas(_reduce, f"file_id long, part long, map {_MAP}")
    whole = some.groupBy("file_id").applyInPandas(_reduce, f"file_id long, part long, map {_MAP}")
    decided = whole.mapInPandas(verdicts, f"{found}, runs array<long>")
    runs = parts.join(decided.where("runs IS NOT NULL").select("file_id", "runs"), "file_id")
    parsed = (
        runs.mapInPandas(pieces, "file_id long, ext string, run long, base long, text string")
        .groupBy("file_id", "run").applyInPandas(parse, "file_id long, run long, error string, at long, declared array<string>, exported array<string>")
        .groupBy("file_id").applyInPandas(merged, found)
    )
    rest = once.join(decided.where("runs IS NULL AND evidence IS NULL"), "file_id", "left_semi").mapInPandas(doubted, found)
    errors = decided.where("evidence IS NOT NULL").drop("runs").union(parsed).union(rest)
    # the lines before an error are counted chunk by chunk
    ahead = F.size(F.split(F.expr("substring(text, 1, greatest(at - base, 0))"), "\n")) - 1
    lines = parts.join(errors.select("file_id", "at"), "file_id").where("base <= at OR at < 0").groupBy("file_id").agg((F.sum(ahead) + 1).cast("int").alias("line"))
    ext = F.lower(F.element_at(F.split("file_path", r"\."), -1))
    kind = F.when(ext.isin("mts", "cts"), "ts").when(ext.isin("mjs", "cjs"), "js").otherwise(ext)
    return errors.join(lines, "file_id", "left").join(once.select("file_id", "repo", "file_path", kind.alias("ext")), "file_id").select(
        "file_id", "repo", "file_path", "ext", "evidence", "error", F.coalesce("line", F.lit(1)).alias("line")
    )


def syntax_errors(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (file_id, repo, file_path, ext, evidence, error, line) of the files that break their extension's grammar.

    files: file_id, repo, file_path, content; other columns are ignored. Repeated rows of a file_id count
    once. Null and empty contents are valid, as are files whose extension (or null path) names no language
    of the grammar. evidence names what told the error: summary (of lexer states and brackets), statement (the
    local grammar of a balanced run), names (declared by two runs), whole (a doubt of the summary, so the file was
    parsed whole) or depth: nesting beyond what the parser can hold, which is no error but a file not judged.
    Files of more than a chunk are looked for when this is called (one job), the rest is lazy.
    """
    once = lambda x: spread(x, "file_id").dropDuplicates(["file_id"])
    some = files.select("file_id", "repo", "file_path", "content").where("content <> ''")
    long = F.length("content") > chunk
    small = once(some.where(~long)).mapInPandas(_small, _ERROR)
    # the files of several chunks are read by several stages, so they are kept; mostly there are few
    large = cut(once(some.where(long)))
    return small if large.isEmpty() else small.unionByName(large_files(large, chunk)).dropDuplicates(["file_id"])


LANGUAGE = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx"}


def syntax_rates(files: DataFrame) -> DataFrame:
    """Rows (repo, language, files, broken, not_judged, rate) over all files, by the language that the extension stands for.

    Files of another extension count under language 'other'; a null repo is a group of its own. Files that are
    nested too deeply to be judged count apart and not as broken.
    """
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))
    language = F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in LANGUAGE.items()], F.lit("other"))
    all_files = files.select("file_id", "repo", "file_path").dropDuplicates(["file_id"]).select("repo", language.alias("language"))
    total = all_files.groupBy("repo", "language").agg(F.count("*").alias("files"))
    deep = F.col("evidence") == "depth"
    broken = syntax_errors(files).select("repo", language.alias("language"), "evidence").groupBy("repo", "language").agg(F.count_if(~deep).alias("broken"), F.count_if(deep).alias("not_judged"))
    # a null repo is a group like any other, so its rows must meet
    t, b = total.alias("t"), broken.alias("b")
    some = F.coalesce("b.broken", F.lit(0))
    return t.join(b, F.col("t.repo").eqNullSafe(F.col("b.repo")) & (F.col("t.language") == F.col("b.language")), "left").select(
        "t.repo", "t.language", "t.files", some.alias("broken"), F.coalesce("b.not_judged", F.lit(0)).alias("not_judged"), F.round(some / F.col("t.files"), 6).alias("rate")
    )
