"""Declared names of Python and of JavaScript and TypeScript, scope by scope."""

import pytest

from oreline.operators import python_code, script_code

#: Text, then names that count.
PYTHON = [
    ("a: int = 1\nfor b in c: pass\nwith d as e: pass\ntry: pass\nexcept F as g: pass\n", 0),
    ("import a\nfrom b import c as d, e\n", 3),
    ("class A:\n    b = 1\n    def c(self): d = 1\n", 4),
    ("a = [b for c in d for b in c]\n", 2),
    ("a = {(b := c) for c in d}\n", 1),
    ("def f():\n    global a\n    a = 1\n    def g():\n        a = 2\n", 3),
    ("def f():\n    def g():\n        nonlocal a\n        a = 1\n    a = 2\n", 3),
    ("def f():\n    global a\n    return lambda b: (a := b)\n", 3),
    ("def f():\n    class C:\n        global a\n        a = 1\n    a = 2\n", 3),
    ("def f(a, b: T = (c := 1), /, *d, e=lambda g: g, **h): pass\n", 7),
    ("def f():\n    a += 1\n    type B = int\n    a.b = c[d] = 1\n", 1),
    ("def f(x):\n    match x:\n        case [a, *b]: pass\n        case {'k': c, **d}: pass\n        case _: pass\n        case P(e) as g: pass\n", 7),
    ("async def f():\n    async with a as b: pass\n    async for c, (d, *e) in b: pass\n", 5),
]
SCRIPT = [
    ("const a = 1, b = f(1, 2), c = d", 3),
    ("let a: Map<string, number> = new Map<string, number>(), b!: T;", 2),
    ("for (const a of b) { var c; }", 2),
    ("class A { b() {} get c() { return 1 } static async d(e) {} }", 5),
    ("const o = { a(b) {}, c: 1, get d() { return 2 } }", 4),
    ("class A { if() {} in() {} }\nfunction f(x) { if (x) { } else { } }", 5),
    ("const { a: b, c = 1, ...d } = e", 3),
    ("const f = ({ a: b, c = 1 }, [d, e], ...g) => 1", 6),
    ("function f(a: A, { b, c: d }: { b: B; c: C }) {}", 4),
    ("import a, { b as c, type D } from 'x'; import * as e from 'y'; import type g = require('z'); import type { H } from 'w'; import 'v'", 6),
    ("try {} catch ({ a, b: c }) {}", 2),
    ("const { a: { b: c } } = d", 1),
]


@pytest.mark.parametrize(("text", "n"), PYTHON)
def test_python_names(text, n):
    out = python_code.analyze(text, "m.py")
    assert (out["parsed"], out["identifiers"]) == (True, n)


@pytest.mark.parametrize(("text", "n"), SCRIPT)
def test_script_names(text, n):
    out = script_code.analyze(text, False)
    assert (out["parsed"], out["identifiers"]) == (True, n)
