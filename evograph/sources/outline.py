"""What a module declares, imports and exports, by the grammar: symbols with their spans, signatures and complexity.

The recogniser of ``ecma`` walks the text; this keeps what it meets at the top level and in the classes there. A text
that breaks the grammar is taken up again at the next line that begins a declaration, so that one error loses one
statement and not the file.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from .ecma import DEEP, STEP, Bad, Parser

RESUME = re.compile(r"^(?:import|export|const|let|var|function|async|class|abstract|interface|type|enum|declare)(?![\w$])", re.M)
DECLARED = re.compile(
    r"(?P<export>export\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?P<async>async\s+)?(?:const\s+(?=enum\b))?(?P<kind>function|class|interface|type|enum|const|let|var)\b\s*(?P<gen>\*)?\s*(?P<name>[\w$\u0080-\U0010ffff]+)"
)
JSDOC = re.compile(r"/\*\*(?!/)((?:[^*]|\*(?!/))*)\*/")
#: Operators that make a binary expression count, wherever in its text they stand.
LOGICAL = re.compile(r"&&|\|\||\?\?")


@dataclass
class Symbol:
    """A declaration; offsets are those of the text."""

    kind: str
    name: str
    start: int
    end: int = -1
    exported: bool = False
    default: bool = False
    counted: bool = False  # whether it has a complexity
    parameters: list[str] | None = None
    return_type: str | None = None
    is_async: bool | None = None
    is_generator: bool | None = None
    is_abstract: bool | None = None
    extends: str | None = None
    implements: list[str] | None = None
    members: int | None = None
    documentation: str | None = None
    body: bool = True


@dataclass
class Outline:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[tuple[str, list[str], bool, bool, bool]] = field(default_factory=list)  # module, symbols, default, namespace, types only
    exports: list[tuple[str, bool, str | None]] = field(default_factory=list)  # name, default, module it comes from
    renamed: list[tuple[str, str]] = field(default_factory=list)  # local and exported names of `export { a as b }`
    errors: list[tuple[str, int]] = field(default_factory=list)
    branches: list[int] = field(default_factory=list)


def tokens(text: str, p: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end) of the tokens of a piece of text that is known to be made of plain ones."""
    while p < len(text):
        m = STEP.match(text, p)
        if not m or m.lastgroup == "eof":
            return
        yield m.lastgroup, m[m.lastgroup], *m.span(m.lastgroup)
        p = m.end()


def parameter_names(text: str) -> list[str]:
    """Names of the parameters in a list's text without its parentheses; a pattern's name is its text."""
    out: list[str] = []
    depth, fresh, pattern = 0, True, None
    for kind, v, a, b in tokens(text):
        if depth == 0 and fresh and pattern is None:
            if v in ("{", "["):
                pattern = a
            elif v == "@":
                pass
            elif kind == "id" and v not in ("public", "private", "protected", "readonly", "override") or kind == "id" and not re.match(r"\s+[\w$]", text[b : b + 40]):
                if not text[:a].rstrip().endswith("@"):
                    out.append(v)
                    fresh = False
        if kind == "p":
            # in types an arrow and what closes type arguments are no brackets of a kind that matters here
            if v in "([{" or v == "<":
                depth += 1
            elif v in ")]}" or v == ">":
                depth = max(depth - 1, 0)
                if depth == 0 and pattern is not None:
                    out.append(text[pattern:b])
                    pattern, fresh = None, False
            elif v == "," and depth == 0:
                fresh = True
    return out


def description(text: str) -> str | None:
    """The descriptions of the documentation comments in what lies before a declaration, without their tags."""
    out = []
    for m in JSDOC.finditer(text):
        lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in m[1].split("\n")]
        kept = []
        for x in lines:
            if x.lstrip().startswith("@"):
                break
            kept.append(x)
        out.append("\n".join(kept).strip())
    return "\n".join(out) or None


class Walker(Parser):
    """The recogniser, with a record of what stands at the top level."""

    def __init__(self, text: str, ts: bool, jsx: bool):
        self.out = Outline()
        self.marks: list[tuple[int, int]] = []  # (start, end or -1) of branches and of binary expressions
        self.last = 0  # end of the token before the current one
        self.outer = False  # whether the statement at hand is one of the module's own
        self.chain = False  # whether the statement within belongs to the one at hand
        self.namespace = 0
        self.begin = 0
        self.shown = self.by_default = False
        self.owner: Symbol | None = None
        self.want: Symbol | None = None  # the function whose signature comes next
        super().__init__(text, ts, jsx)

    # ---- tokens
    def next(self):
        self.last = self.st + len(self.v)
        super().next()

    def save(self):
        return super().save(), len(self.marks), self.last

    def restore(self, x):
        state, marks, self.last = x
        super().restore(state)
        del self.marks[marks:]

    def mark(self, kind, start):
        if kind == "branch":
            self.marks.append((start, -1))
        elif LOGICAL.search(self.s, start, self.last):
            self.marks.append((start, self.last))

    def s_if(self):
        self.mark("branch", self.st)
        super().s_if()

    def s_for(self):
        self.mark("branch", self.st)
        super().s_for()

    def s_while(self):
        self.mark("branch", self.st)
        super().s_while()

    def s_do(self):
        self.mark("branch", self.st)
        super().s_do()

    # ---- statements
    def module(self):
        self.scopes = [(set(), set(), True)]
        while self.k != "eof":
            at, known, before = self.st, len(self.out.symbols), self.last
            try:
                self.statement(top=True)
            except Bad as e:
                self.out.errors.append((e.what, e.at))
                self.resume(at)
                self.salvage(at, known, before)

    def salvage(self, at: int, known: int, before: int):
        """Keep what the first words of a broken statement declare; it ends where the next declaration begins."""
        end = len(self.s[: self.st].rstrip())
        for x in self.out.symbols[known:]:
            x.end = x.end if x.end >= 0 else end
        m = DECLARED.match(self.s, at)
        if m and len(self.out.symbols) == known and (m["kind"] not in ("const", "let", "var") or m["export"]):
            kind = "variable" if m["kind"] in ("const", "let", "var") else m["kind"]
            x = Symbol(kind, m["name"], at, end, bool(m["export"]), bool(m["default"]), kind in ("function", "class"))
            if kind == "function":
                x.parameters, x.is_async, x.is_generator = [], bool(m["async"]), bool(m["gen"])
            x.documentation = description(self.s[before:at])
            self.out.symbols.append(x)

    def resume(self, at: int):
        """Go on at the next line behind the one of an offset that begins a declaration."""
        self.fn = self.is_async = self.gen = self.no_in = self.ambient = self.static_block = self.no_extends = self.ctor = self.method = False
        self.loop = self.brk = self.cls = self.no_cond_arrow = self.namespace = 0
        self.labels, self.scopes = [], [(set(), set(), True)]
        self.owner = self.want = self.returns = None
        self.outer = self.chain = False
        while True:
            m = RESUME.search(self.s, self.s.find("\n", at) + 1) if "\n" in self.s[at:] else None
            self.p = m.start() if m else len(self.s)
            try:
                self.next()
                return
            except Bad as e:
                at = max(e.at, self.p + 1)

    def statement(self, top=False):
        old = self.outer, self.shown, self.by_default
        chained, self.chain = self.chain, False
        self.outer = top and not self.namespace or chained
        if top and not self.namespace:
            self.begin, self.before = self.st, self.last
            self.shown = self.by_default = False
        try:
            super().statement(top)
        finally:
            self.outer, self.shown, self.by_default = old

    def ts_module(self):
        self.namespace += 1
        try:
            super().ts_module()
        finally:
            self.namespace -= 1

    def ts_statement(self):
        kind = self.v
        if not self.outer:
            return super().ts_statement()
        if kind == "declare":
            self.chain = True
            try:
                return super().ts_statement()
            finally:
                self.chain = False
        name, exported = self.peek()[1], self.shown
        begin = self.begin
        if not super().ts_statement():
            return False
        if kind in ("interface", "type"):
            self.add_symbol(Symbol(kind, name, begin, self.last, exported))
        return True

    def s_enum(self):
        outer, name = self.outer, self.peek()[1]
        super().s_enum()
        if outer:
            self.add_symbol(Symbol("enum", name, self.begin, self.last, self.shown))

    def add_symbol(self, x: Symbol):
        x.default = self.by_default
        x.documentation = description(self.s[self.before : x.start])
        self.out.symbols.append(x)

    def declarator(self, kind, in_for):
        if not (self.outer and self.shown) or in_for:
            return super().declarator(kind, in_for)
        at = self.st
        self.outer = False  # of what stands within
        super().declarator(kind, in_for)
        self.outer = True
        text = self.s[at : self.last]
        name = re.match(r"[\w$\u0080-\U0010ffff]+", text)
        self.out.symbols.append(Symbol("variable", name[0] if name else pattern_text(text), at, self.last, True))

    # ---- functions and classes
    def params(self):
        x, self.want = self.want, None
        at = self.st
        super().params()
        if x is not None:
            x.parameters = parameter_names(self.s[at + 1 : self.last - 1])
            self.returns = x

    returns: Symbol | None = None

    def return_type(self):
        x, self.returns = self.returns, None
        at = self.st
        super().return_type()
        if x is not None:
            x.return_type = self.s[at : self.last].strip()

    def function_rest(self, *a, **k):
        x = self.want
        outer, self.outer = self.outer, False
        owner, self.owner = self.owner, None
        has = super().function_rest(*a, **k)
        self.outer, self.owner = outer, owner
        self.returns = None
        if x is not None:
            x.body = bool(has)
        return has

    def function(self, is_async, default=False):
        if not self.outer:
            return super().function(is_async, default)
        after = self.peek()
        gen = after[1] == "*"
        x = Symbol("function", "<anonymous>", self.begin, exported=self.shown, counted=True, is_async=is_async, is_generator=gen)
        ambient = self.ambient
        at = self.st
        self.want = x
        super().function(is_async, default)
        m = re.compile(r"function\s*\*?\s*([\w$\u0080-\U0010ffff]+)").match(self.s, at)
        x.name, x.end = m[1] if m else x.name, self.last
        if x.body or ambient:  # not of an overload
            self.add_symbol(x)

    def klass(self, expression=False, default=False):
        if expression or not self.outer:
            outer, self.outer = self.outer, False
            owner, self.owner = self.owner, None
            super().klass(expression, default)
            self.outer, self.owner = outer, owner
            return
        x = Symbol("class", "<anonymous>", self.begin, exported=self.shown, counted=True, members=0, implements=[])
        x.is_abstract = re.search(r"\babstract\s*$", self.s[self.begin : self.st]) is not None
        k, v, _ = self.peek()
        if k == "id" and v not in ("extends", "implements"):
            x.name = v
        self.add_symbol(x)
        self.heritage(x, self.st)
        self.owner, self.outer = x, False
        super().klass(expression, default)
        self.owner, self.outer = None, True
        x.end = self.last

    def member(self, seen):
        x = self.owner
        if x is None:
            return super().member(seen)
        at, before = self.st, self.last
        self.owner = None
        # the modifiers and the name, told ahead from the text
        m = MEMBER.match(self.s, self.behind_decorators(at))
        method = None
        if m and m["name"] and m["open"] and not m["accessor"] and m["name"] != "constructor":
            method = Symbol("function", f"{x.name}.{m['name']}", at, exported=x.exported, counted=True, is_async=bool(m["async"]), is_generator=bool(m["gen"]), documentation=description(self.s[before:at]))
            self.want = method
        super().member(seen)
        self.owner, self.want = x, None
        overload = m and m["open"] and self.s[self.last - 1] != "}" and not re.search(r"\b(?:abstract|declare)\b", m["words"] or "")
        if not overload or self.ambient:
            x.members = (x.members or 0) + 1
            if method is not None and method.parameters is not None:
                method.end = self.last
                self.out.symbols.append(method)

    def behind_decorators(self, at: int) -> int:
        """The offset behind the decorators of a member."""
        if self.s[at] != "@":
            return at
        state = self.save()
        try:
            while self.is_p("@"):
                self.decorator()
            return self.st
        finally:
            self.restore(state)

    def heritage(self, x: Symbol, at: int):
        """What a class extends and implements, from the text up to its body."""
        depth, end = 0, at
        for kind, v, a, _ in tokens(self.s, at):
            if kind == "p":
                depth += (v in ("(", "<", "[")) - (v in (")", ">", "]"))
                if v == "{" and depth <= 0:
                    end = a
                    break
        head = self.s[at:end]
        m = re.search(r"\bextends\s+(.*?)(?=\s*(?:\bimplements\b|$))", head, re.S)
        x.extends = m[1].strip() if m else None
        m = re.search(r"\bimplements\s+(.*)$", head, re.S)
        x.implements = [y.strip() for y in split_list(m[1])] if m else []

    # ---- modules
    def import_(self):
        at = self.st
        super().import_()
        self.keep_import(self.s[at : self.last])

    def keep_import(self, text: str):
        t = list(tokens(text))
        module = next((v[1:-1] for k, v, *_ in reversed(t) if k == "str"), None)
        if module is None or len(t) > 2 and t[-1][1] == ")":
            return
        words = [v for _, v, *_ in t[1:]]
        types = len(words) > 1 and words[0] == "type" and words[1] not in ("from", ",")
        if types:
            words = words[1:]
        names: list[str] = []
        default = namespace = False
        if words and words[0] not in ("{", "*") and words[0][0] not in "'\"":
            names.append(words[0])
            default = True
        if "*" in words[:3]:
            namespace = True
            names.append(f"* as {words[words.index('as') + 1]}")
        if "{" in words:
            inner = words[words.index("{") + 1 : words.index("}")]
            names += [" ".join(x[1:] if x[0] == "type" and len(x) in (2, 4) else x) for x in _by_comma(inner)]
        self.out.imports.append((module, names, default, namespace, types))

    def export(self):
        at = self.st
        top = self.outer
        self.shown = True
        v = self.peek()[1]
        if v == "default":
            self.by_default = True
            before = len(self.out.symbols)
            super().export()
            if len(self.out.symbols) == before or self.out.symbols[before].kind not in ("function", "class", "interface"):
                self.out.exports.append(("default", True, None))
                m = re.match(r"export\s+default\s+([\w$]+)\s*;?\s*$", self.s[at : self.last])
                if m:
                    self.out.renamed.append((m[1], "default"))
            return
        self.chain = top and v not in ("{", "*", "=")
        super().export()
        self.chain = False
        if v in ("{", "type", "*"):
            text = self.s[at : self.last]
            t = list(tokens(text))
            words = [x[1] for x in t]
            module = t[-1][1][1:-1] if t and t[-1][0] == "str" else next((x[1][1:-1] for x in t if x[0] == "str" and "from" in words), None)
            if "{" in words and words[1] in ("{", "type") and words.index("{") <= 2:
                for x in _by_comma(words[words.index("{") + 1 : words.index("}")]):
                    x = x[1:] if x[0] == "type" and len(x) in (2, 4) else x
                    self.out.exports.append((x[0], False, module))
                    if module is None:
                        self.out.renamed.append((x[0], x[-1]))
            elif "*" in words[:3]:
                self.out.exports.append((words[words.index("as") + 1] if "as" in words else "*", False, module))
        elif v == "=":
            self.out.exports.append(("default", True, None))


MEMBER = re.compile(
    r"(?P<words>(?:(?:public|private|protected|static|abstract|override|readonly|declare)\s+(?=[\w$#'\"*\[]))*)(?P<async>async\s+(?=[\w$#'\"*\[]))?(?P<gen>\*\s*)?"
    r"(?P<accessor>(?:get|set)\s+(?=[\w$#'\"\[]))?(?P<name>#?[\w$\u0080-\U0010ffff]+|'[^'\n]*'|\"[^\"\n]*\"|\[[^\]\n]*\])\s*\??\s*(?P<open>[(<])?"
)


def _by_comma(words: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in words:
        if w == ",":
            out.append([])
        else:
            out[-1].append(w)
    return [x for x in out if x]


def split_list(text: str) -> list[str]:
    """The parts of a list of types between the commas outside all brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ">)]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [x for x in [*out, text[start:]] if x.strip()]


def pattern_text(text: str) -> str:
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "{[") - (c in "}]")
        if depth == 0 and i:
            return text[: i + 1]
    return text


def outline(text: str | None, ext: str) -> Outline:
    """The outline of a text for its extension (ts, tsx, js, jsx). Null and empty texts declare nothing.

    Symbols are in the order of the text. A name that is exported by a list or as the default further down counts as
    exported.
    """
    if not text:
        return Outline()
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))
    ext = ext.lower().lstrip(".")
    w = None
    try:
        w = Walker(text, ext in ("ts", "tsx", "mts", "cts"), ext in ("tsx", "jsx"))
        w.module()
    except Bad as e:
        if w is None:
            # not even the first token can be read
            return Outline(errors=[(e.what, e.at)])
        w.out.errors.append((e.what, e.at))
    out = w.out
    out.branches = sorted({*w.marks}, key=lambda m: m[0])
    local = {a for a, _ in out.renamed}
    for x in out.symbols:
        x.exported = x.exported or x.name in local and x.kind != "variable"
    owners = {x.name: x.exported for x in out.symbols if x.kind == "class"}
    for x in out.symbols:
        if x.kind == "function" and "." in x.name:
            x.exported = owners.get(x.name.split(".")[0], x.exported)
    return out


def complexity(out: Outline, x: Symbol) -> int:
    """One more than the branches and logical expressions within a symbol."""
    starts = [a for a, _ in out.branches]
    return 1 + bisect_left(starts, x.end) - bisect_left(starts, x.start)


def lines_of(text: str):
    """offset -> line, from 1."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    return lambda at: bisect_right(starts, at)
