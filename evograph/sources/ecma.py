"""A hand-written recursive-descent recogniser for ES modules, TypeScript and JSX.

It answers one question per text, ``check(text, ext)``: the first syntax error or None. The grammar follows
the ECMAScript and TypeScript language descriptions; there is no tree, only recognition, because callers
need verdicts and line numbers. Early errors of strict ES modules (duplicate lexical names, ``return``
outside a function, ``await`` outside async code and the like) are reported for plain JavaScript only;
TypeScript treats most of them as later, semantic diagnostics.
"""

from __future__ import annotations

import re
import sys

ID = r"(?:[A-Za-z_$\u0080-\U0010ffff]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$\u200c\u200d\u0080-\U0010ffff]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*"
SPACE = re.compile(r"(?:[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+|[\n\r\u2028\u2029]|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)+")
TOKEN = re.compile(
    rf"(?P<id>{ID})"
    r"|(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*n|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?))"
    r"|(?P<str>'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"
    rf"|(?P<priv>\#{ID})"
    r"|(?P<p>\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|\+\+|--|<<=|<<|<=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@`#])"
)
# White space and comments in one go with the token behind them.
STEP = re.compile(
    r"(?:[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000\n\r\u2028\u2029]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*+"
    r"(?:" + TOKEN.pattern + r"|(?P<eof>\Z))"
)
REGEX = re.compile(r"/(?![*/])((?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+)/([A-Za-z]*)")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
JSX_TEXT = re.compile(r"[^<{>}]*")
JSX_NAME = re.compile(rf"{ID}(?:-[\w$-]*)*")
JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
BREAK = re.compile(r"[\n\r\u2028\u2029]")
BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9A-Fa-f]{2})|u(?![0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\}))")
OCTAL_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|0[0-9])")

# Words of the language descriptions.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in"
    " instanceof new null return super switch this throw true try typeof var void while with".split()
)
STRICT = frozenset("implements interface let package private protected public static yield".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
MODIFIERS = frozenset("public private protected static readonly abstract override declare accessor".split())


#: Frames of the parser. They live on the heap, so that the nesting of a text (about ten frames a level) is bound by memory only.
DEEP = 2_000_000


class Bad(Exception):
    """A syntax error at an offset."""

    def __init__(self, what: str, at: int):
        super().__init__(what)
        self.what, self.at = what, at


class Parser:
    def __init__(self, text: str, ts: bool, jsx: bool):
        self.s, self.ts, self.jsx = text, ts, jsx
        self.p = 0
        self.k, self.v, self.st, self.nl = "eof", "", 0, False
        self.memo: dict[int, tuple] = {}  # tokens by the offset from which they were read
        self.added: list[tuple[set, str]] = []  # names in order of declaration, to take them back
        self.fn = self.is_async = self.gen = False
        self.loop = self.brk = 0
        self.labels: list[str] = []
        self.no_arrow: set[int] = set()
        self.no_in = False
        self.ambient = False
        self.cls = 0
        self.static_block = False
        self.scopes: list[tuple[set, set, bool]] = []  # lexical names, var names, whether a function's
        self.exports: set[str] = set()
        self.no_cond_arrow = 0
        self.no_extends = False
        self.ctor = self.method = False
        if self.s.startswith("#!") or self.s.startswith("\ufeff#!"):
            m = BREAK.search(self.s)
            self.p = m.start() if m else len(self.s)
        self.next()

    # ---- tokens
    def scan(self, p):
        """The token at or behind an offset as (kind, text, start, whether a line break comes before, end); kept by offset."""
        s = self.s
        m = STEP.match(s, p)
        if not m:
            m = SPACE.match(s, p)
            at = m.end() if m else p
            raise Bad("unterminated text" if s[at : at + 1] in ("'", '"') or s.startswith("/*", at) else "unexpected character", at)
        k = m.lastgroup
        at, end = m.span(k)
        v = s[at:end]
        nl = at - p > 1 and BREAK.search(s, p, at) is not None or at - p == 1 and s[p] in "\n\r\u2028\u2029" or p == 0
        if k == "eof":
            token = self.memo[p] = ("eof", "", at, nl, at)
            return token
        if k == "id":
            if not v.isascii() and not v.replace("$", "_").isidentifier():
                raise Bad("unexpected character", at)
        elif k == "num":
            c = s[end : end + 1]
            if c and (c.isalnum() or c in "_$\\"):
                raise Bad("identifier directly after number", at)
            if (len(v) > 1 and v[0] == "0" and v[1].isdigit()) or v[-1] == "_" or "__" in v:
                raise Bad("bad number", at)
        elif k == "str":
            if "\\" in v and (BAD_ESCAPE.search(re.sub(r"\\[^xu]", "", v)) or OCTAL_ESCAPE.search(v)):
                raise Bad("bad escape", at)
        elif s.startswith("/*", at):
            raise Bad("unterminated comment", at)
        token = self.memo[p] = (k, v, at, nl, end)
        return token

    def next(self):
        self.k, self.v, self.st, self.nl, self.p = self.memo.get(self.p) or self.scan(self.p)

    def save(self):
        return self.p, self.k, self.v, self.st, self.nl, self.fn, self.is_async, self.gen, self.loop, self.brk, self.no_in, self.no_cond_arrow, self.method, self.static_block, self.cls, self.ambient, self.no_extends, self.labels, len(self.labels), self.scopes, len(self.scopes), len(self.added)

    def restore(self, x):
        self.p, self.k, self.v, self.st, self.nl, self.fn, self.is_async, self.gen, self.loop, self.brk, self.no_in, self.no_cond_arrow, self.method, self.static_block, self.cls, self.ambient, self.no_extends, self.labels, labels, self.scopes, scopes, added = x
        del self.labels[labels:]
        del self.scopes[scopes:]
        while len(self.added) > added:
            names, name = self.added.pop()
            names.discard(name)

    def mark(self, kind, start):
        """Called for every branch and every binary expression behind its end; recognition alone has no use for it."""

    def trial(self, f):
        x = self.save()
        try:
            return f()
        except Bad:
            self.restore(x)
            return None

    def fail(self, what="unexpected token"):
        raise Bad("input ended too early" if self.k == "eof" else what, self.st)

    def is_p(self, v):
        return self.k == "p" and self.v == v

    def is_w(self, v):
        return self.k == "id" and self.v == v

    def eat(self, v):
        if self.v == v and self.k in ("p", "id"):
            self.next()
            return True
        return False

    def need(self, v):
        if self.v != v or self.k not in ("p", "id"):
            self.fail(f"{v} expected")
        self.next()

    def semi(self):
        if self.is_p(";"):
            self.next()
        elif not (self.nl or self.k == "eof" or self.is_p("}")):
            self.fail("; expected")

    def peek(self):
        """(kind, text, whether a line break comes before) of the next token."""
        t = self.memo.get(self.p)
        if t is None:
            try:
                t = self.scan(self.p)
            except Bad:
                return "bad", "", False
        return t[0], t[1], t[3]

    # ---- scopes (plain JavaScript only)
    def add(self, names, name):
        if name not in names:
            names.add(name)
            self.added.append((names, name))

    def declare(self, name, kind, at):
        if self.ts or not self.scopes or name is None:
            return
        lex, var, function = self.scopes[-1]
        if kind == "var":
            for lex, var, function in reversed(self.scopes):
                if name in lex:
                    raise Bad("name declared twice", at)
                self.add(var, name)
                if function:
                    break
        elif kind == "param":
            self.add(var, name)
        elif kind == "fn" and function and len(self.scopes) > 1:
            if name in lex:
                raise Bad("name declared twice", at)
            self.add(var, name)
        else:
            if name in lex or name in var:
                raise Bad("name declared twice", at)
            self.add(lex, name)

    # ---- names
    def ident(self, binding=True):
        if self.k != "id" or self.v in RESERVED:
            self.fail("identifier expected")
        v = self.v
        if not self.ts and v in STRICT or v == "yield" and self.gen or v == "await" and (self.is_async or not self.fn and not self.ts or self.static_block):
            self.fail("reserved word")
        if binding and not self.ts and v in ("eval", "arguments"):
            self.fail("reserved word")
        self.next()
        return v

    def pattern(self, kind):
        if self.is_p("["):
            self.next()
            while not self.is_p("]"):
                if self.eat(","):
                    continue
                if self.eat("..."):
                    self.pattern(kind)
                    if not self.is_p("]"):
                        self.fail("rest must be last")
                    break
                self.pattern_init(kind)
                if not self.is_p("]"):
                    self.need(",")
            self.need("]")
        elif self.is_p("{"):
            self.next()
            while not self.is_p("}"):
                if self.eat("..."):
                    self.declare(self.ident(), kind, self.st)
                    if not self.is_p("}"):
                        self.fail("rest must be last")
                    break
                if self.is_p("["):
                    self.next()
                    self.assign()
                    self.need("]")
                    self.need(":")
                    self.pattern_init(kind)
                else:
                    word, at, v = self.k == "id", self.st, self.v
                    if self.k not in ("id", "str", "num"):
                        self.fail("property name expected")
                    self.next()
                    if self.eat(":"):
                        self.pattern_init(kind)
                    elif not word or v in RESERVED or not self.ts and v in STRICT:
                        self.fail(": expected")
                    else:
                        self.declare(v, kind, at)
                        if self.eat("="):
                            self.with_in(self.assign)
                if not self.is_p("}"):
                    self.need(",")
            self.need("}")
        else:
            at = self.st
            self.declare(self.ident(), kind, at)

    def pattern_init(self, kind):
        self.pattern(kind)
        if self.eat("="):
            self.with_in(self.assign)

    def with_in(self, f):
        old, self.no_in = self.no_in, False
        cond, self.no_cond_arrow = self.no_cond_arrow, 0
        f()
        self.no_in, self.no_cond_arrow = old, cond

    # ---- functions
    def params(self):
        self.need("(")
        while not self.is_p(")"):
            while self.is_p("@"):
                self.decorator()
            if self.ts:
                while self.k == "id" and self.v in MODIFIERS and self.peek()[0] == "id" or self.k == "id" and self.v in MODIFIERS and self.peek()[1] in ("{", "["):
                    self.next()
            if self.eat("..."):
                self.pattern("param")
                if self.ts and self.eat(":"):
                    self.type()
                if self.ts and self.is_p(","):
                    self.next()
                if not self.is_p(")"):
                    self.fail("rest must be last")
                break
            if self.ts and self.is_w("this"):
                self.next()
            else:
                self.pattern("param")
            if self.ts:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.with_in(self.assign)
            if not self.is_p(")"):
                self.need(",")
        self.need(")")

    def function_rest(self, is_async, gen, arrow=False, body=True, method=False, head=None):
        old = self.fn, self.is_async, self.gen, self.loop, self.brk, self.labels, self.no_in, self.method, self.static_block, self.no_cond_arrow
        self.fn, self.is_async, self.loop, self.brk, self.labels, self.no_in, self.no_cond_arrow = True, is_async, 0, 0, [], False, 0
        self.gen = gen
        if not arrow:
            self.method, self.static_block = method, False
        self.scopes.append((set(), set(), True))
        (head or self.signature)()
        has = True
        if arrow:
            self.need("=>")
            if self.is_p("{"):
                self.body()
            else:
                self.no_in = old[6]
                self.no_cond_arrow = old[9]
                self.assign()
        elif self.is_p("{"):
            self.body()
        elif body and not (self.ts or self.ambient):
            self.fail("{ expected")
        else:
            has = False
            self.semi()
        self.scopes.pop()
        self.fn, self.is_async, self.gen, self.loop, self.brk, self.labels, self.no_in, self.method, self.static_block, self.no_cond_arrow = old
        return has

    def signature(self):
        if self.ts and self.is_p("<"):
            self.type_params()
        self.params()
        if self.ts and self.eat(":"):
            self.return_type()

    def body(self):
        self.need("{")
        while not self.is_p("}"):
            if self.k == "eof":
                self.fail()
            self.statement()
        self.need("}")

    # ---- expressions
    def expr(self):
        self.assign()
        while self.is_p(","):
            self.next()
            self.assign()

    def arrow(self, is_async):
        def head():
            self.signature()
            if not self.is_p("=>") or self.nl:
                self.fail()

        self.function_rest(is_async, False, arrow=True, head=head)
        return True

    def assign(self):
        st = self.st
        if self.k == "id":
            if self.v == "yield" and (self.gen or not self.ts):
                if not self.gen:
                    self.fail("reserved word")
                self.next()
                if not self.nl and not (self.k == "eof" or self.k == "p" and self.v in (")", "]", "}", ",", ";", ":")) and not self.is_w("in"):
                    self.eat("*")
                    self.assign()
                return
            if self.v == "async":
                k, v, nl = self.peek()
                if not nl and k == "id" and v != "function" and v not in RESERVED:
                    x = self.save()
                    self.next()
                    if self.peek()[1] == "=>":
                        return self.simple_arrow(True)
                    self.restore(x)
                elif not nl and v in ("(", "<") and k == "p" and st not in self.no_arrow:
                    x = self.save()
                    self.next()
                    if self.trial(lambda: self.arrow(True)):
                        return
                    self.restore(x)
                    self.no_arrow.add(st)
            if self.v not in RESERVED:
                k, v, nl = self.peek()
                if k == "p" and v == "=>":
                    return self.simple_arrow(False)
        elif self.is_p("(") and st not in self.no_arrow or self.ts and self.is_p("<") and st not in self.no_arrow:
            if self.is_p("<") and self.jsx and not re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\s+(?!=))").match(self.s, st):
                pass
            else:
                x = self.save()
                if self.trial(lambda: self.arrow(False)):
                    # in a ? (b) : c, a typed arrow needs a colon after it
                    if self.no_cond_arrow and self.ts and not self.is_p(":"):
                        self.restore(x)
                    else:
                        return
                self.no_arrow.add(st)
        target = self.conditional()
        if self.k == "p" and (self.v in ASSIGN or self.v == ">" and self.wide_gt() in (">>=", ">>>=")):
            if self.v == ">":
                self.p = self.st + len(self.wide_gt())
            elif target == "pattern" and self.v != "=":
                self.fail("bad assignment target")
            if target is None:
                self.fail("bad assignment target")
            self.next()
            self.assign()
            self.mark("binary", st)
            return None
        if target == "pattern!":
            self.fail("initialiser in an object")
        return target

    def simple_arrow(self, is_async):
        def head():
            at = self.st
            self.declare(self.ident(), "param", at)
            if self.nl:
                self.fail()

        self.function_rest(is_async, False, arrow=True, head=head)
        return True

    def wide_gt(self):
        m = re.compile(r">>>=|>>=|>>>|>>|>=|>").match(self.s, self.st)
        return m.group()

    def conditional(self):
        t = self.binary(0)
        if self.is_p("?"):
            self.mark("branch", self.st)
            self.next()
            old, self.no_in = self.no_in, False
            self.no_cond_arrow += 1
            self.assign()
            self.no_cond_arrow -= 1
            self.no_in = old
            self.need(":")
            self.assign()
            return None
        return t

    def binary(self, least):
        st = self.st
        if self.k == "priv" and self.peek()[1] == "in":
            self.next()
            t = None
        else:
            t = self.unary()
        mixed = None
        while True:
            v = self.v
            if self.k == "p":
                if v == ">":
                    v = self.wide_gt()
                    if v in (">>=", ">>>="):
                        return t
            elif self.k != "id":
                return t
            elif self.ts and v in ("as", "satisfies") and not self.nl and least <= 8:
                self.next()
                if not self.eat("const"):
                    self.type()
                t = t or "target"
                continue
            n = BINARY.get(v)
            if n is None or n <= least or v == "in" and self.no_in:
                return t
            if v == "**" and t == "unary":
                self.fail("unary before **")
            if v in ("??", "||", "&&"):
                group = v == "??"
                if mixed is not None and mixed != group:
                    self.fail("?? mixed with || or &&")
                mixed = group
            if self.k == "p" and self.v == ">":
                self.p = self.st + len(v)
            self.next()
            self.binary(3 if v == "??" else n - 1 if v == "**" else n)
            self.mark("binary", st)
            t = None

    def unary(self):
        v = self.v
        if self.k == "p":
            if v in ("+", "-", "!", "~"):
                self.next()
                self.unary()
                return "unary"
            if v in ("++", "--"):
                self.next()
                if self.unary() not in ("target", "name"):
                    self.fail("bad operand")
                return None
            if v == "<" and self.ts and not self.jsx:
                self.next()
                if not self.eat("const"):
                    self.type()
                self.need(">")
                return self.unary()
        elif self.k == "id":
            if v in ("delete", "void", "typeof"):
                self.next()
                bare = self.k == "id" and self.v not in RESERVED
                t = self.unary()
                if v == "delete" and not self.ts and bare and t == "name":
                    self.fail("delete of a name")
                return "unary"
            if v == "await" and (self.is_async or not self.fn):
                if self.static_block:
                    self.fail("await in a static block")
                k, w, nl = self.peek()
                self.next()
                self.unary()
                return "unary"
        t = self.postfix()
        if self.k == "p" and self.v in ("++", "--") and not self.nl:
            if t not in ("target", "name"):
                self.fail("bad operand")
            self.next()
            return None
        return t

    def args(self):
        self.need("(")
        while not self.is_p(")"):
            self.eat("...")
            self.with_in(self.assign)
            if not self.is_p(")"):
                self.need(",")
        self.need(")")

    def member_name(self):
        if self.k not in ("id", "priv"):
            self.fail("name expected")
        if self.k == "priv" and not self.cls:
            self.fail("private name outside a class")
        self.next()

    def type_args_call(self):
        """Type arguments of a call or a template, or an instantiation; None when < is an operator."""

        def f():
            self.need("<")
            while True:
                self.type()
                if not self.eat(","):
                    break
            if not self.is_p(">"):
                self.fail()
            self.next()
            if self.k == "p" and self.v in ("(", "`"):
                return True
            if self.nl or self.k == "eof" or self.k == "p" and self.v in (")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "^", "&", "|", "}", "="):
                return True
            self.fail()

        return self.trial(f)

    def postfix(self):
        st = self.st
        if self.is_w("new"):
            t = self.new()
        elif self.is_w("super"):
            self.next()
            if not (self.k == "p" and self.v in (".", "[", "(")):
                self.fail()
            if not self.cls and not self.method:
                raise Bad("super outside a method", st)
            t = None
        elif self.is_w("import"):
            self.next()
            if self.eat("."):
                self.need("meta")
            elif not self.is_p("("):
                self.fail()
            t = None
        else:
            t = self.primary()
        chain = False
        while True:
            if self.k == "p":
                v = self.v
                if v == ".":
                    self.next()
                    self.member_name()
                    t = None if chain else "target"
                    continue
                if v == "?.":
                    self.next()
                    chain = True
                    if self.is_p("("):
                        self.args()
                    elif self.is_p("["):
                        self.index()
                    elif self.is_p("`"):
                        self.fail()
                    elif self.ts and self.is_p("<") and self.type_args_call():
                        pass
                    else:
                        self.member_name()
                    t = None
                    continue
                if v == "[":
                    self.index()
                    t = None if chain else "target"
                    continue
                if v == "(":
                    if t == "arrowless":
                        return None
                    self.args()
                    t = None
                    continue
                if v == "`":
                    if chain:
                        self.fail()
                    self.template()
                    t = None
                    continue
                if v == "!" and self.ts and not self.nl:
                    self.next()
                    continue
                if v == "<" and self.ts and self.type_args_call():
                    t = None
                    continue
            return t

    def index(self):
        self.need("[")
        self.with_in(self.expr)
        self.need("]")

    def new(self):
        self.need("new")
        if self.eat("."):
            self.need("target")
            if not self.fn and not self.cls:
                self.fail("new.target outside a function")
            return None
        if self.is_w("new"):
            self.new()
        elif self.is_w("import"):
            self.fail()
        else:
            if self.is_w("super"):
                self.next()
            else:
                self.primary()
        while True:
            if self.is_p("."):
                self.next()
                self.member_name()
            elif self.is_p("["):
                self.index()
            elif self.is_p("!") and self.ts and not self.nl:
                self.next()
            elif self.is_p("`"):
                self.template()
            elif self.ts and self.is_p("<") and self.type_args_call():
                pass
            elif self.is_p("?."):
                self.fail()
            else:
                break
        if self.is_p("("):
            self.args()
        return None

    def template(self):
        while True:
            m = TEMPLATE.match(self.s, self.p)
            if not m:
                raise Bad("unterminated template", self.st)
            self.p = m.end()
            self.next()
            if m.group(1) == "`":
                return
            self.with_in(self.expr)
            if not self.is_p("}"):
                self.fail()
            # the text goes on directly behind the brace
            self.p = self.st + 1

    def primary(self):
        k, v = self.k, self.v
        if k == "id":
            if v == "function":
                return self.function_expr(False)
            if v == "async":
                pk, pv, nl = self.peek()
                if pv == "function" and not nl:
                    self.next()
                    return self.function_expr(True)
            if v == "class":
                self.klass(True)
                return None
            if v in ("this", "null", "true", "false"):
                self.next()
                return None
            if v in RESERVED:
                self.fail()
            self.ident(False)
            if not self.ts and v in ("eval", "arguments"):
                return None
            return "name"
        if k in ("num", "str"):
            self.next()
            return None
        if k == "p":
            if v == "(":
                self.next()
                inner = []
                self.with_in(lambda: inner.append(self.paren()))
                self.need(")")
                return inner[0]
            if v == "[":
                self.next()
                while not self.is_p("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.with_in(self.assign)
                    if not self.is_p("]"):
                        self.need(",")
                self.need("]")
                return "pattern"
            if v == "{":
                return self.object()
            if v == "`":
                self.template()
                return None
            if v in ("/", "/="):
                m = REGEX.match(self.s, self.st)
                if not m:
                    raise Bad("unterminated regular expression", self.st)
                self.regex(m.group(1), m.group(2))
                self.p = m.end()
                self.next()
                return None
            if v == "<" and self.jsx:
                self.jsx_element()
                return None
            if v == "@":
                while self.is_p("@"):
                    self.decorator()
                self.klass(True)
                return None
        self.fail("expression expected")

    def paren(self):
        """The inside of parentheses; what can be assigned to stays so only if it is a single target."""
        t = self.assign()
        if self.is_p(","):
            t = None
            while self.eat(","):
                self.assign()
        return t if t in ("target", "name") else None

    def regex(self, body, flags):
        if len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy"):
            raise Bad("bad regular expression flags", self.st)
        depth, i, klass, start = 0, 0, False, True
        while i < len(body):
            c = body[i]
            if c == "\\":
                i += 2
                start = False
                continue
            if klass:
                klass = c != "]"
            elif c == "[":
                klass, start = True, False
            elif c == "(":
                depth += 1
                start = True
                i += 1
                m = re.compile(r"\?(?:[:=!]|<[=!]|<[A-Za-z_$][\w$]*>|[a-z]*(?:-[a-z]+)?:)").match(body, i)
                if m:
                    i = m.end()
                elif body[i : i + 1] == "?":
                    raise Bad("bad regular expression", self.st)
                continue
            elif c == ")":
                depth -= 1
                start = False
                if depth < 0:
                    raise Bad("bad regular expression", self.st)
            elif c == "|":
                start = True
            elif c in "*+?":
                if start:
                    raise Bad("bad regular expression", self.st)
                if body[i + 1 : i + 2] == "?":
                    i += 1
                start = True
            else:
                start = c == "^"
            i += 1
        if depth:
            raise Bad("bad regular expression", self.st)

    def function_expr(self, is_async):
        self.need("function")
        gen = self.eat("*")
        if self.k == "id" and not self.is_p("("):
            old = self.gen, self.is_async, self.fn
            self.gen, self.is_async, self.fn = gen, is_async, True
            self.ident()
            self.gen, self.is_async, self.fn = old
        amb, self.ambient = self.ambient, False
        ts = self.ts
        if not self.function_rest(is_async, gen):
            self.fail("{ expected")
        self.ambient = amb
        return None

    def prop_name(self):
        """A property's name; its text, or None for computed ones."""
        if self.is_p("["):
            self.next()
            self.with_in(self.assign)
            self.need("]")
            return None
        if self.k not in ("id", "str", "num", "priv"):
            self.fail("property name expected")
        v = self.v if self.k != "str" else self.v[1:-1]
        self.next()
        return v

    def object(self):
        self.need("{")
        cover = False
        while not self.is_p("}"):
            if self.eat("..."):
                self.with_in(self.assign)
            else:
                is_async = gen = acc = False
                if self.is_w("async"):
                    pk, pv, nl = self.peek()
                    if not nl and (pk in ("id", "str", "num", "priv") or pv in ("[", "*")):
                        self.next()
                        is_async = True
                if self.is_p("*"):
                    self.next()
                    gen = True
                if not (is_async or gen) and self.k == "id" and self.v in ("get", "set"):
                    pk, pv, nl = self.peek()
                    if pk in ("id", "str", "num", "priv") or pv == "[":
                        self.next()
                        acc = True
                k, v, st = self.k, self.v, self.st
                if k == "priv":
                    self.fail("private name in an object")
                self.prop_name()
                if self.is_p("(") or self.ts and self.is_p("<"):
                    ts = self.ts
                    if not self.function_rest(is_async, gen, method=True):
                        self.fail("{ expected")
                elif is_async or gen or acc:
                    self.fail("( expected")
                elif self.eat(":"):
                    self.with_in(self.assign)
                elif k != "id" or v in RESERVED or not self.ts and v in STRICT or v == "await" and self.is_async:
                    self.fail(": expected")
                elif self.eat("="):
                    self.with_in(self.assign)
                    cover = True
                elif v in ("get", "set", "async") and self.k == "id":
                    self.fail()
            if not self.is_p("}"):
                self.need(",")
        self.need("}")
        return "pattern!" if cover and not self.is_p("=") and not self.is_w("of") and not self.is_w("in") else "pattern"

    # ---- JSX
    def jsx_name(self):
        m = JSX_NAME.match(self.s, self.st) if self.k == "id" else None
        if not m:
            self.fail("element name expected")
        name = m.group()
        self.p = m.end()
        self.next()
        while self.k == "p" and self.v in (".", ":"):
            sep = self.v
            self.next()
            m = JSX_NAME.match(self.s, self.st) if self.k == "id" else None
            if not m:
                self.fail("element name expected")
            name += sep + m.group()
            self.p = m.end()
            self.next()
        return name

    def jsx_element(self, nested=False):
        """At '<'; ends with the token behind the element, or, for a nested one, with self.p behind its '>'."""
        self.need("<")
        name = None
        if not self.is_p(">"):
            name = self.jsx_name()
            if self.ts and self.is_p("<"):
                self.type_args()
            while not (self.k == "p" and self.v in (">", "/")):
                if self.is_p("{"):
                    self.next()
                    self.need("...")
                    self.with_in(self.assign)
                    self.need("}")
                    continue
                self.jsx_name()
                if self.is_p("="):
                    m = JSX_STRING.match(self.s, SPACE.match(self.s, self.p).end() if SPACE.match(self.s, self.p) else self.p)
                    if m:
                        self.p = m.end()
                        self.next()
                        continue
                    self.next()
                    if self.is_p("{"):
                        self.next()
                        self.with_in(self.assign)
                        self.need("}")
                    elif self.is_p("<"):
                        self.jsx_element()
                    else:
                        self.fail("attribute value expected")
            if self.is_p("/"):
                self.next()
                if not self.is_p(">"):
                    self.fail("> expected")
                self.jsx_end(nested)
                return
        # children
        self.p = self.st + 1
        while True:
            m = JSX_TEXT.match(self.s, self.p)
            self.p = m.end()
            c = self.s[self.p : self.p + 1]
            self.st = self.p
            if c == "":
                self.k, self.v = "eof", ""
                self.fail()
            if c in ">}":
                raise Bad("stray token in text", self.p)
            self.next()
            if c == "{":
                self.next()
                if self.is_p("}"):
                    self.p = self.st + 1
                    continue
                self.eat("...")
                self.with_in(self.expr)
                if not self.is_p("}"):
                    self.fail("} expected")
                self.p = self.st + 1
                continue
            if self.peek()[1] == "/":
                self.next()
                self.next()
                close = None if self.is_p(">") else self.jsx_name()
                if close != name or not self.is_p(">"):
                    self.fail("closing tag doesn't match")
                self.jsx_end(nested)
                return
            self.jsx_element(True)

    def jsx_end(self, nested):
        if nested:
            self.p = self.st + 1
        else:
            self.p = self.st + 1
            self.next()
            if self.is_p("<") and re.compile(r"<[A-Za-z>]").match(self.s, self.st):
                self.fail("adjacent elements")

    # ---- classes
    def decorator(self):
        self.need("@")
        if self.is_p("("):
            self.next()
            self.expr()
            self.need(")")
            return
        self.ident(False)
        while self.is_p("."):
            self.next()
            self.member_name()
        if self.ts and self.is_p("<"):
            self.type_args_call()
        if self.is_p("("):
            self.args()

    def klass(self, expression=False, default=False):
        self.need("class")
        if self.k == "id" and self.v not in ("extends", "implements") or self.is_w("implements") and self.peek()[1] in ("{", "extends"):
            at = self.st
            name = self.ident()
            if not expression:
                self.declare(name, "let", at)
        elif not expression and not default:
            self.fail("class name expected")
        if self.ts and self.is_p("<"):
            self.type_params()
        if self.eat("extends"):
            t = self.postfix()
            if self.ts and self.is_p("<"):
                self.type_args()
        if self.ts and self.eat("implements"):
            while True:
                self.type_ref()
                if not self.eat(","):
                    break
        self.need("{")
        self.cls += 1
        old = self.fn, self.is_async, self.gen, self.loop, self.brk, self.labels, self.method, self.static_block
        self.loop = self.brk = 0
        self.labels = []
        seen = []
        while not self.is_p("}"):
            if self.k == "eof":
                self.fail()
            if not self.eat(";"):
                self.member(seen)
        self.fn, self.is_async, self.gen, self.loop, self.brk, self.labels, self.method, self.static_block = old
        self.cls -= 1
        self.need("}")

    def member(self, seen):
        while self.is_p("@"):
            self.decorator()
        is_async = gen = acc = abstract = False
        if self.is_w("static") and self.peek()[1] == "{":
            self.next()
            old = self.static_block, self.is_async, self.gen, self.fn, self.method
            self.static_block, self.is_async, self.gen, self.fn, self.method = True, False, False, False, True
            self.scopes.append((set(), set(), True))
            self.body()
            self.scopes.pop()
            self.static_block, self.is_async, self.gen, self.fn, self.method = old
            return
        words = MODIFIERS if self.ts else ("static", "accessor")
        while self.k == "id" and self.v in words:
            k, v, nl = self.peek()
            if not (k in ("id", "str", "num", "priv") or v in ("[", "*", "{")) or nl and self.v in ("declare", "accessor", "abstract"):
                break
            if self.v == "abstract" or self.v == "declare":
                abstract = True
            self.next()
        if self.is_w("async"):
            k, v, nl = self.peek()
            if not nl and (k in ("id", "str", "num", "priv") or v in ("[", "*")):
                self.next()
                is_async = True
        if self.eat("*"):
            gen = True
        if not (is_async or gen) and self.k == "id" and self.v in ("get", "set"):
            k, v, nl = self.peek()
            if k in ("id", "str", "num", "priv") or v == "[":
                self.next()
                acc = True
        if self.ts and self.is_p("["):
            x = self.save()
            if self.trial(self.index_signature):
                return
            self.restore(x)
        at = self.st
        name = self.prop_name()
        if name == "#constructor":
            self.fail("bad private name")
        if self.ts:
            if not self.eat("?") and self.is_p("!"):
                self.next()
        if self.is_p("(") or self.ts and self.is_p("<"):
            has = self.function_rest(is_async, gen, method=True)
            if has and name == "constructor":
                if not self.ts and "constructor" in seen:
                    raise Bad("two constructors", at)
                seen.append("constructor")
            return
        if is_async or gen or acc:
            self.fail("( expected")
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            old = self.fn, self.is_async, self.gen, self.method
            self.fn, self.is_async, self.gen, self.method = True, False, False, True
            self.with_in(self.assign)
            self.fn, self.is_async, self.gen, self.method = old
        self.semi()

    # ---- statements
    def block(self):
        self.scopes.append((set(), set(), False))
        self.body()
        self.scopes.pop()

    def variables(self, kind, in_for=False):
        self.declarator(kind, in_for)
        while self.eat(","):
            self.declarator(kind, in_for)

    def declarator(self, kind, in_for):
        pattern = self.k == "p"
        self.pattern("var" if kind == "var" else "let")
        if self.ts:
            self.eat("!")
            if self.eat(":"):
                self.type()
        if self.eat("="):
            self.assign()
        elif not in_for and not self.ambient and (kind == "const" or pattern):
            self.fail("initialiser expected")
        elif in_for and (kind == "const" or pattern) and not (self.is_w("of") or self.is_w("in")):
            self.fail("initialiser expected")

    def sub(self, loop=False):
        """The statement behind if, for and the like; no declaration may stand there."""
        if self.k == "id" and (self.v in ("const", "class") or self.v == "let" and not self.ts and self.peek()[0] == "id" or self.v == "function"):
            self.fail("declaration not allowed here")
        if self.k == "id" and self.v in ("import", "export") and self.peek()[1] not in ("(", "."):
            self.fail()
        if loop:
            self.loop += 1
            self.brk += 1
        self.statement()
        if loop:
            self.loop -= 1
            self.brk -= 1

    def statement(self, top=False):
        k, v = self.k, self.v
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                return self.next()
            if v == "@":
                while self.is_p("@"):
                    self.decorator()
                if self.is_w("export"):
                    return self.export()
                if self.is_w("abstract"):
                    self.next()
                return self.klass()
        elif k == "id":
            f = getattr(self, f"s_{v}", None)
            if f and (v in RESERVED or f()):
                return f() if v in RESERVED else None
            if v in ("import", "export"):
                if v == "import" and self.peek()[1] in ("(", "."):
                    pass
                elif not top:
                    self.fail("only at the top level")
                else:
                    return self.import_() if v == "import" else self.export()
            if v == "async":
                pk, pv, nl = self.peek()
                if pv == "function" and not nl:
                    self.next()
                    return self.function(True)
            if self.ts and self.ts_statement():
                return
            if v not in RESERVED and self.peek()[:2] == ("p", ":"):
                name = self.ident(False)
                self.next()
                if name in self.labels:
                    self.fail("label twice")
                self.labels.append(name)
                if self.is_w("function") or self.is_w("class") or self.is_w("const"):
                    self.fail()
                self.statement()
                self.labels.pop()
                return
        elif k == "eof":
            self.fail()
        self.expr()
        self.semi()

    def s_var(self):
        self.next()
        self.variables("var")
        self.semi()

    def s_const(self):
        self.next()
        if self.ts and self.is_w("enum"):
            return self.s_enum()
        self.variables("const")
        self.semi()

    def s_let(self):
        k, v, nl = self.peek()
        if not (k == "id" and v not in ("in", "of", "instanceof") or v in ("[", "{")):
            if self.ts:
                return False
            self.fail("reserved word")
        self.next()
        if self.is_w("let"):
            self.fail("reserved word")
        self.variables("let")
        self.semi()
        return True

    def s_function(self):
        self.function(False)

    def function(self, is_async, default=False):
        self.need("function")
        gen = self.eat("*")
        if not (default and self.is_p("(")):
            at = self.st
            if self.is_w("await") and not self.ts:
                self.fail("reserved word")
            self.declare(self.ident(), "fn", at)
        self.function_rest(is_async, gen)

    def s_class(self):
        self.klass()

    def s_enum(self):
        if not self.ts:
            self.fail("reserved word")
        self.need("enum")
        self.ident()
        self.need("{")
        while not self.is_p("}"):
            self.prop_name()
            if self.eat("="):
                self.assign()
            if not self.is_p("}"):
                self.need(",")
        self.need("}")

    def s_if(self):
        self.next()
        self.need("(")
        self.expr()
        self.need(")")
        self.sub()
        if self.eat("else"):
            self.sub()

    def s_for(self):
        self.next()
        wait = False
        if self.is_w("await"):
            if self.fn and not self.is_async:
                self.fail("await outside async code")
            self.next()
            wait = True
        self.need("(")
        self.scopes.append((set(), set(), False))
        each = False
        if self.is_p(";"):
            pass
        else:
            self.no_in = True
            if self.is_w("var") or self.is_w("const") or self.is_w("let") and (self.peek()[0] == "id" and self.peek()[1] not in ("in", "of") or self.peek()[1] in ("[", "{")):
                kind = self.v
                self.next()
                self.variables(kind, True)
            elif self.is_w("async") and self.peek()[1] == "of" and not wait:
                self.fail()
            else:
                t = self.trial_target()
                if t is None:
                    self.expr()
            self.no_in = False
            if self.is_w("of"):
                each = True
                self.next()
                self.assign()
            elif self.is_w("in"):
                if wait:
                    self.fail()
                each = True
                self.next()
                self.expr()
        if not each:
            if wait:
                self.fail()
            self.need(";")
            if not self.is_p(";"):
                self.expr()
            self.need(";")
            if not self.is_p(")"):
                self.expr()
        self.need(")")
        self.sub(True)
        self.scopes.pop()

    def trial_target(self):
        def f():
            t = self.postfix()
            if t not in ("target", "name", "pattern") or not (self.is_w("of") or self.is_w("in")):
                self.fail()
            return True

        return self.trial(f)

    def s_while(self):
        self.next()
        self.need("(")
        self.expr()
        self.need(")")
        self.sub(True)

    def s_do(self):
        self.next()
        self.sub(True)
        self.need("while")
        self.need("(")
        self.expr()
        self.need(")")
        self.eat(";")

    def s_switch(self):
        self.next()
        self.need("(")
        self.expr()
        self.need(")")
        self.need("{")
        self.brk += 1
        self.scopes.append((set(), set(), False))
        default = False
        while not self.is_p("}"):
            if self.is_w("default"):
                if default:
                    self.fail("two defaults")
                default = True
                self.next()
            else:
                self.mark("branch", self.st)
                self.need("case")
                self.expr()
            self.need(":")
            while not (self.is_p("}") or self.is_w("case") or self.is_w("default")):
                if self.k == "eof":
                    self.fail()
                self.statement()
        self.scopes.pop()
        self.brk -= 1
        self.need("}")

    def s_try(self):
        self.next()
        self.block()
        if self.is_w("catch"):
            self.mark("branch", self.st)
            self.next()
            self.scopes.append((set(), set(), False))
            if self.eat("("):
                self.pattern("let")
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            # a var of the parameter's name is allowed, a let isn't
            self.body()
            self.scopes.pop()
            if self.eat("finally"):
                self.block()
        elif self.eat("finally"):
            self.block()
        else:
            self.fail("catch or finally expected")

    def s_throw(self):
        self.next()
        if self.nl:
            self.fail("expression expected")
        self.expr()
        self.semi()

    def s_return(self):
        if not self.fn or self.static_block:
            if not self.ts or not self.fn:
                self.fail("return outside a function")
        self.next()
        if not (self.nl or self.k == "eof" or self.k == "p" and self.v in (";", "}")):
            self.expr()
        self.semi()

    def jump(self, loop):
        self.next()
        if self.k == "id" and not self.nl:
            if self.v not in self.labels and not self.ts:
                self.fail("no such label")
            self.next()
        elif not loop and not self.ts:
            self.fail("jump outside a loop")
        self.semi()

    def s_break(self):
        self.jump(self.brk)

    def s_continue(self):
        self.jump(self.loop)

    def s_debugger(self):
        self.next()
        self.semi()

    def s_with(self):
        self.fail("with in strict code")

    def string(self):
        if self.k != "str":
            self.fail("module name expected")
        self.next()

    def attributes(self):
        if self.is_w("with") or self.is_w("assert") and not self.nl:
            self.next()
            self.object()

    def specifiers(self, binding):
        """{ a, b as c } of imports and exports; the local names of exports."""
        self.need("{")
        out = []
        while not self.is_p("}"):
            if self.ts and self.is_w("type"):
                k, v, nl = self.peek()
                if k in ("id", "str") and not (v == "as" and False):
                    self.next()
            if self.k not in ("id", "str"):
                self.fail("name expected")
            name, at, word = self.v, self.st, self.k == "id"
            self.next()
            target = name
            renamed = False
            if self.is_w("as"):
                self.next()
                if self.k not in ("id", "str"):
                    self.fail("name expected")
                target, at = self.v, self.st
                renamed = True
                self.next()
            if binding:
                if target in RESERVED or not word and not renamed or not self.ts and target in STRICT:
                    raise Bad("name expected", at)
                self.declare(target, "let", at)
            else:
                out.append((name, target, at))
            if not self.is_p("}"):
                self.need(",")
        self.need("}")
        return out

    def import_(self):
        self.need("import")
        if self.k == "str":
            self.next()
            self.attributes()
            return self.semi()
        if self.ts and self.is_w("type"):
            k, v, nl = self.peek()
            if k == "id" and v != "from" or v in ("{", "*") or k == "id" and v == "from":
                x = self.save()
                self.next()
                if self.is_w("from") and self.peek()[0] == "str":
                    self.restore(x)
        if self.k == "id" and not (self.v in RESERVED):
            at = self.st
            self.declare(self.ident(), "let", at)
            if self.ts and self.is_p("="):
                self.next()
                if self.is_w("require") and self.peek()[1] == "(":
                    self.next()
                    self.next()
                    self.string()
                    self.need(")")
                else:
                    self.type_ref()
                return self.semi()
            if not self.eat(","):
                return self.from_()
        if self.eat("*"):
            self.need("as")
            at = self.st
            self.declare(self.ident(), "let", at)
        elif self.is_p("{"):
            self.specifiers(True)
        else:
            self.fail()
        self.from_()

    def from_(self):
        self.need("from")
        self.string()
        self.attributes()
        self.semi()

    def exported(self, name, at):
        if not self.ts:
            if name in self.exports:
                raise Bad("exported twice", at)
            self.exports.add(name)

    def export(self):
        self.need("export")
        at = self.st
        if self.ts:
            if self.eat("="):
                self.expr()
                return self.semi()
            if self.is_w("as"):
                self.next()
                self.need("namespace")
                self.ident()
                return self.semi()
            if self.is_w("import"):
                return self.import_()
            if self.is_w("type") and self.peek()[1] in ("{", "*"):
                self.next()
        if self.eat("*"):
            if self.eat("as"):
                if self.k not in ("id", "str"):
                    self.fail()
                self.exported(self.v, self.st)
                self.next()
            return self.from_()
        if self.is_p("{"):
            names = self.specifiers(False)
            for name, target, where in names:
                self.exported(target, where)
            if self.is_w("from"):
                self.from_()
            else:
                for name, _, where in names:
                    if name in RESERVED or name[0] in "'\"":
                        raise Bad("name expected", where)
                self.semi()
            return
        if self.eat("default"):
            self.exported("default", at)
            if self.is_w("function"):
                return self.function(False, True)
            if self.is_w("async") and self.peek()[1] == "function" and not self.peek()[2]:
                self.next()
                return self.function(True, True)
            if self.is_p("@"):
                while self.is_p("@"):
                    self.decorator()
            if self.is_w("class"):
                return self.klass(default=True)
            if self.ts and self.is_w("abstract") and self.peek()[1] == "class":
                self.next()
                return self.klass(default=True)
            if self.ts and self.is_w("interface"):
                return self.ts_statement()
            self.assign()
            return self.semi()
        if self.is_p("@"):
            while self.is_p("@"):
                self.decorator()
        if self.k == "id":
            v = self.v
            before = set(self.scopes[-1][0]) | set(self.scopes[-1][1])
            if v in ("var", "const", "function", "class") or v == "let" and not self.ts or v == "async" and self.peek()[1] == "function":
                self.statement()
                for name in (set(self.scopes[-1][0]) | set(self.scopes[-1][1])) - before:
                    self.exported(name, at)
                return
            if self.ts and (v in ("enum", "let") or self.ts_statement_ahead()):
                return self.statement()
        self.fail("declaration expected")

    # ---- TypeScript
    def ts_statement_ahead(self):
        k, v, nl = self.peek()
        w = self.v
        return w in ("interface", "type", "namespace", "module", "declare", "abstract", "global", "async") and (k == "id" and not nl or k == "str" and w == "module" or v == "{")

    def ts_statement(self):
        v = self.v
        k, w, nl = self.peek()
        if v == "interface" and k == "id" and not nl:
            self.next()
            self.ident()
            if self.is_p("<"):
                self.type_params()
            if self.eat("extends"):
                while True:
                    self.type_ref()
                    if not self.eat(","):
                        break
            self.object_type()
            return True
        if v == "type" and k == "id" and not nl and w not in ("in", "of", "instanceof", "as", "satisfies"):
            self.next()
            self.ident()
            if self.is_p("<"):
                self.type_params()
            self.need("=")
            self.type()
            self.semi()
            return True
        if v in ("namespace", "module") and not nl and (k == "id" and w not in RESERVED or k == "str"):
            self.next()
            if self.k == "str":
                self.next()
            else:
                self.ident()
                while self.eat("."):
                    self.ident()
            if self.is_p("{"):
                self.ts_module()
            else:
                self.semi()
            return True
        if v == "global" and w == "{":
            self.next()
            self.ts_module()
            return True
        if v == "declare" and k == "id" and not nl and w not in ("in", "of", "instanceof", "as"):
            self.next()
            old, self.ambient = self.ambient, True
            if self.is_w("export") or self.is_w("import"):
                self.fail()
            self.statement()
            self.ambient = old
            return True
        if v == "abstract" and w == "class" and not nl:
            self.next()
            self.klass()
            return True
        return False

    def ts_module(self):
        self.need("{")
        while not self.is_p("}"):
            if self.k == "eof":
                self.fail()
            self.statement(top=True)
        self.need("}")

    def type_params(self):
        self.need("<")
        while True:
            while self.k == "id" and self.v in ("const", "in", "out") and self.peek()[0] == "id":
                self.next()
            self.ident()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.is_p(">"):
                break
        self.need(">")

    def type_args(self):
        self.need("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        self.need(">")

    def type_ref(self):
        if self.k != "id" or self.v in RESERVED and self.v not in ("this", "void", "null", "true", "false"):
            self.fail("type expected")
        self.next()
        while self.is_p("."):
            self.next()
            if self.k not in ("id", "priv"):
                self.fail("name expected")
            self.next()
        if self.is_p("<") and not self.nl:
            self.type_args()

    def return_type(self):
        if self.is_w("asserts") and self.peek()[0] == "id" and not self.peek()[2]:
            self.next()
            self.next()
            if self.eat("is"):
                self.type()
            return
        if self.k == "id":
            k, v, nl = self.peek()
            if k == "id" and v == "is" and not nl:
                self.next()
                self.next()
        self.type()

    def type(self):
        old, self.no_in = self.no_in, False
        if self.is_function_type():
            self.function_type()
        else:
            self.union()
            if self.is_w("extends") and not self.nl and not self.no_extends:
                self.mark("branch", self.st)
                self.next()
                self.no_extends = True
                try:
                    self.type()
                finally:
                    self.no_extends = False
                self.need("?")
                self.type()
                self.need(":")
                self.type()
        self.no_in = old

    def is_function_type(self):
        if self.is_p("<") or self.is_w("new") or self.is_w("abstract") and self.peek()[1] == "new":
            return True
        if not self.is_p("("):
            return False
        x = self.save()
        try:
            self.next()
            if self.is_p(")") or self.is_p("..."):
                return True
            if self.is_p("{") or self.is_p("["):
                self.pattern("none")
            elif self.k == "id":
                self.next()
            else:
                return False
            if self.k == "p" and self.v in (":", ",", "?", "="):
                return True
            if self.is_p(")"):
                self.next()
                return self.is_p("=>")
            return False
        except Bad:
            return False
        finally:
            self.restore(x)

    def function_type(self):
        self.eat("abstract")
        self.eat("new")
        if self.is_p("<"):
            self.type_params()
        scopes, self.scopes = self.scopes, []
        old, self.no_extends = self.no_extends, False
        self.params()
        self.scopes = scopes
        self.need("=>")
        self.return_type()
        self.no_extends = old

    def union(self):
        if self.is_p("|") or self.is_p("&"):
            self.next()
        while True:
            self.inter_part()
            if self.k == "p" and self.v in ("|", "&"):
                self.next()
                continue
            return

    def inter_part(self):
        if self.is_function_type():
            return self.function_type()
        if self.k == "id" and self.v in ("keyof", "unique", "readonly") and (self.peek()[0] in ("id", "str") or self.peek()[1] in ("(", "[", "{")):
            self.next()
            return self.inter_part()
        if self.is_w("infer") and self.peek()[0] == "id":
            self.next()
            self.ident()
            if self.is_w("extends"):
                def f():
                    self.next()
                    self.union()
                    if self.is_p("?"):
                        self.fail()
                    return True

                self.trial(f)
            return
        self.type_primary()
        while self.is_p("[") and not self.nl or self.is_p("!") and not self.nl:
            if self.eat("!"):
                continue
            self.next()
            if not self.is_p("]"):
                self.type()
            self.need("]")

    def type_primary(self):
        k, v = self.k, self.v
        if k in ("num", "str"):
            return self.next()
        if k == "p":
            if v == "-":
                self.next()
                if self.k != "num":
                    self.fail()
                return self.next()
            if v == "(":
                self.next()
                old, self.no_extends = self.no_extends, False
                self.type()
                self.no_extends = old
                return self.need(")")
            if v == "[":
                self.next()
                while not self.is_p("]"):
                    self.eat("...")
                    if self.k == "id" and self.peek()[1] == ":":
                        self.next()
                        self.next()
                    elif self.k == "id" and self.peek()[1] == "?":
                        x = self.save()
                        self.next()
                        self.next()
                        if not self.eat(":"):
                            self.restore(x)
                    self.type()
                    self.eat("?")
                    if not self.is_p("]"):
                        self.need(",")
                return self.need("]")
            if v == "{":
                return self.object_type()
            if v == "`":
                while True:
                    m = TEMPLATE.match(self.s, self.p)
                    if not m:
                        raise Bad("unterminated template", self.st)
                    self.p = m.end()
                    self.next()
                    if m.group(1) == "`":
                        return
                    self.type()
                    if not self.is_p("}"):
                        self.fail()
                    self.p = self.st + 1
            if v in ("?", "*"):
                self.fail("type expected")
        elif k == "id":
            if v == "typeof":
                self.next()
                if self.is_w("import"):
                    return self.import_type()
                if self.k != "id":
                    self.fail()
                self.next()
                while self.is_p("."):
                    self.next()
                    if self.k not in ("id", "priv"):
                        self.fail()
                    self.next()
                if self.is_p("<") and not self.nl:
                    self.type_args()
                return
            if v == "import":
                return self.import_type()
            if v == "asserts" and self.peek()[0] == "id" and not self.peek()[2] and self.peek()[1] not in ("extends", "is"):
                self.next()
            return self.type_ref()
        self.fail("type expected")

    def import_type(self):
        self.need("import")
        self.need("(")
        self.type()
        if self.eat(","):
            self.object()
        self.need(")")
        while self.eat("."):
            if self.k != "id":
                self.fail()
            self.next()
        if self.is_p("<"):
            self.type_args()

    def index_signature(self):
        self.need("[")
        self.ident()
        self.need(":")
        self.type()
        self.need("]")
        self.need(":")
        self.type()
        self.type_end()
        return True

    def type_end(self):
        if self.is_p(",") or self.is_p(";"):
            self.next()
        elif not (self.nl or self.is_p("}") or self.k == "eof"):
            self.fail("; expected")

    def mapped(self):
        self.need("{")
        if self.k == "p" and self.v in ("+", "-"):
            self.next()
            self.need("readonly")
        else:
            self.eat("readonly")
        self.need("[")
        self.ident()
        self.need("in")
        self.type()
        if self.eat("as"):
            self.type()
        self.need("]")
        if self.k == "p" and self.v in ("+", "-"):
            self.next()
            self.need("?")
        else:
            self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";")
        self.need("}")
        return True

    def object_type(self):
        old, self.no_extends = self.no_extends, False
        x = self.save()
        if self.trial(self.mapped):
            self.no_extends = old
            return
        self.restore(x)
        self.need("{")
        scopes, self.scopes = self.scopes, []
        while not self.is_p("}"):
            if self.k == "eof":
                self.fail()
            while self.k == "id" and self.v in ("readonly", "static", "public", "private", "protected") and (self.peek()[0] in ("id", "str", "num") or self.peek()[1] == "["):
                self.next()
            if self.is_p("[") and self.trial(self.index_signature):
                continue
            if self.k == "p" and self.v in ("(", "<"):
                self.signature()
                self.type_end()
                continue
            if self.is_w("new") and self.peek()[1] in ("(", "<"):
                self.next()
                self.signature()
                self.type_end()
                continue
            if self.k == "id" and self.v in ("get", "set") and (self.peek()[0] in ("id", "str", "num") or self.peek()[1] == "[") and not self.peek()[2]:
                self.next()
            self.prop_name()
            self.eat("?")
            if self.k == "p" and self.v in ("(", "<"):
                self.signature()
            elif self.eat(":"):
                self.type()
            self.type_end()
        self.scopes = scopes
        self.no_extends = old
        self.need("}")

    def module(self):
        self.scopes = [(set(), set(), True)]
        while self.k != "eof":
            self.statement(top=True)


def check(text: str | None, ext: str) -> tuple[str, int] | None:
    """The first syntax error of a text for its extension (.ts, .tsx, .js, .jsx) as (what, offset), or None.

    Null and empty texts are valid. Nesting beyond DEEP frames of the parser gives ("nesting too deep", -1): not judged.
    """
    if not text:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))
    ext = ext.lower().lstrip(".")
    try:
        Parser(text, ext in ("ts", "tsx", "mts", "cts"), ext in ("tsx", "jsx")).module()
    except Bad as e:
        return e.what, e.at
    except RecursionError:
        return "nesting too deep", -1
    return None


def segment(text: str, ext: str) -> tuple[tuple[str, int] | None, list[str], list[str]]:
    """Like check for a run of whole top-level statements; also the names it declares and exports, so that
    duplicates between runs of one file can be found when the runs are put together."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))
    ext = ext.lower().lstrip(".")
    p = None
    try:
        p = Parser(text, ext in ("ts", "tsx", "mts", "cts"), ext in ("tsx", "jsx"))
        p.module()
    except Bad as e:
        return (e.what, e.at), [], []
    except RecursionError:
        return ("nesting too deep", -len(text) - 1), [], []
    lex, var, _ = p.scopes[0]
    return None, sorted(lex) + [f"var {x}" for x in sorted(var)], sorted(p.exports)
