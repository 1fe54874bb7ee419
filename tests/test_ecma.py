import pytest

from evograph.sources.ecma import check

VALID = [
    ("", "js"), (None, "ts"), ("﻿#!/usr/bin/env node\nlet a = 1", "js"),
    ("a = b / c / d; x = /[/]\\/(?:a|b)+/g.test(y) ? 1 : 2", "js"),
    ("const f = async (a, {b = 1, ...c}, [d]) => ({a, b}); for await (const x of y) z(x)", "js"),
    ("class A extends B { #p = 1; static { this.q = 2 } get x() { return this.#p } async *gen() { yield* g() } }", "js"),
    ("label: for (;;) { if (a) continue label; else break label }", "js"),
    ("const t = `a${`b${{a: 1}.a}`}c`; tag`x`", "js"),
    ("const e = <div a='x' {...p}>it's {x} &lt; {/* c */}<b.c/></div>", "jsx"),
    ("const a = b as unknown as string; let c = d!; const f = <T,>(x: T): x is T => true", "tsx"),
    ("type A<T> = T extends (infer U)[] ? U : never; type M = { readonly [K in keyof T]?: T[K] }", "ts"),
    ("abstract class A<T> implements B { constructor(private readonly a: string, public b?: number) { super() } abstract c(): void; d?: string; [k: string]: any }", "ts"),
    ("declare module 'x' { export function f(a: number): void }\nexport type { A } from 'b'; enum E { A = 1, B }", "ts"),
    ("function f(a: string): void;\nfunction f(a: any) {}\nconst g = f<string>('a'), h = a < b && c > d", "ts"),
    ("const x = <any>y; const z = a ? (b) : c => d", "ts"),
    ("if (a) function_call()\nelse b\n++c", "js"),
    ("export default class {}\nexport const a = 1, b = 2\nexport * as ns from 'x'", "js"),
    ("const a = b ?? (c || d); a?.b?.[c]?.(d)", "js"), ("[a, b] = [b, a]; ({a, b} = c)", "js"),
]
INVALID = [
    ("function f( (", "js"), ("const a: number = 1", "js"), ("interface A {}", "js"), ("<div>", "jsx"), ("<a></b>", "tsx"),
    ("const a = <div/>", "ts"), ("<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "ts"), ("let a = 'x", "js"), ("/* open", "ts"),
    ("const t = `a ${b}", "js"), ("{ \"a\": 1, \"b\": 2 }", "js"), ("let 6nd = 1", "js"), ("return 1", "js"), ("await x => 1", "js"),
    ("function f() { await x }", "js"), ("let a; let a", "js"), ("export const a = 1; export { a }", "js"), ("a ?? b || c", "js"),
    ("with (a) b", "js"), ("var x = 017", "js"), ("break", "js"), ("const a", "js"), ("for (const a of b", "ts"), ("if (a) { b } }", "ts"),
    ("x = [1, 2 3]", "ts"), ("import a from b", "ts"), ("class A { constructor() {} constructor() {} }", "js"), ("a => { } => b", "js"),
    ("1 = 2", "js"), ("/a(/", "js"), ("new.target", "js"), ("super.x", "js"), ("delete a", "js"), ("const s: Record&lt;string&gt; = 1", "ts"),
]


@pytest.mark.parametrize("text,ext", VALID)
def test_valid(text, ext):
    assert check(text, ext) is None


@pytest.mark.parametrize("text,ext", INVALID)
def test_invalid(text, ext):
    assert check(text, ext) is not None
