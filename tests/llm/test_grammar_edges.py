"""Texts at the edges of the grammars: the derivative alone (without Python's parser) and valid text in unusual dress."""

import ast

import pytest

from evalframe.llm.grammars import language

PYTHON_BAD = [
    "1 = 2", "f(a=1, 2)", "def f(a=1, b): pass", "f() = 3", "del 1", "for 1 in x: pass", "None = 1", "def f(*): pass", "lambda a=1, b: 0", "f(x for x in y, 1)", "'\\x1'", "a + b = c", "x += y = 3", "(a, b): int = 1", "[a, b] += 1",
    "f(**k, *a)", "f(**k, 1)", "def f(**k, a): pass", "def f(*, **k): pass", "def f(a, /, b, /): pass", "with a as 1: pass", "try:\n  x\nexcept A, B:\n  y", "b'é'", "'\\u12'", "[i for 1 in x]", "del (a, b), f()", "lambda *: 0", "a.b() += 1", "(yield) = 1", "f(a for a in b, )",
]
PYTHON_GOOD = [
    "a, b = c", "(a, [b, *c]) = d[0].e = f()", "del a, (b, c[0]), d.e", "for (a, b), c.d in e: pass", "def f(a, b=1, /, c=2, *d, e, g=3, **h): pass", "def f(a, /, b, *, c): pass", "def f(*a: *b): pass", "f(a, *b, c=1, *d, **e)", "f(x for x in y)", "f((x for x in y), 1)", "lambda a, b=1, *c, d, **e: 0",
    "x: int = 1", "(x): int", "a[0]: int = 3", "(x) += 1", "a.b[c] //= yield", "with a as (b, c), d as e.f: pass", "'\\N{BULLET}\\x41\\\\x'", "rb'\\x'", "b'\\x41\\u'", "() = x", "f()[0] = 1", "*a, b = c", "class A(b, *c, d=1, **e): pass", "f(a := 1, b)", "x = y = yield z",
]


@pytest.mark.parametrize("code", PYTHON_BAD)
def test_python_refuses(code):
    with pytest.raises(SyntaxError):
        ast.parse(code)
    assert language("python3").failure(code + "\n") is not None


@pytest.mark.parametrize("code", PYTHON_GOOD)
def test_python_takes(code):
    ast.parse(code)
    assert language("python3").failure(code + "\n") is None


@pytest.mark.parametrize("code, good", [
    ("#define REP(i,n) for(int i=0;i<n;i++)\nint main(){ int s=0; REP(i,10) s+=i; }", True),
    ("#define ll long long\nunsigned ll z;\nint main(){ ll a = (ll)3; }", True),
    ("#ifdef X\nint main(int c){\n#else\nint main(){\n#endif\nreturn 0; }", True),
    ("#if 0\nnot code at all ' \n#endif\nint main(){}", True),
    ("#define MAX(a,b) ((a)>(b)?(a):(b))\n#define all(x) (x).begin(), (x).end()\nint main(){ int z = MAX(1, f(2, 3)); sort(all(v)); }", True),
    ("#define x x + 1\nint main(){ int y = x; }", True),
    ("#define log(...) printf(__VA_ARGS__)\nint main(){ log(\"%d\", 1, 2); }", True),
    ("#define fast \\\n  ios::sync_with_stdio(false); \\\n  cin.tie(0)\nint main(){ fast; }", True),
    ("#define f(a) a\n#undef f\nint main(){ f(1); }", True),
    ("#include <iostream>\n#include \"a.h\" // yes\n#pragma once\nint main(){}", True),
    ("#endif\nint main(){}", False), ("#ifdef X\nint main(){}", False), ("#include <iostream\nint main(){}", False), ("#include\nint main(){}", False), ("#if 1\n#else\n#else\n#endif\nint main(){}", False),
    ("#define REP(i,n) for(int i=0;i<n;i++\nint main(){ int s=0; REP(i,10) s+=i; }", False), ("int main { return 0; }", False), ("struct A { int f() const { return 1; } int (*g(int))(char); };", True),
    ("int (*f(int a))(char) { return 0; }", True), ("int A::operator()(int x) const { return x; }", True), ("void f() try { } catch (...) { }", True),
])
def test_cpp(code, good):
    assert (language("cpp17").failure(code + "\n") is None) == good


@pytest.mark.parametrize("body, good", [
    ("a+b;", False), ("5;", False), ("x;", False), ("try { }", False), ('String s = "a\\q";', False), ("public int x;", False), ("(int) x++;", False), ("static final int y = 1;", False), ("char c = '\\q';", False),
    ("x = y = 3;", True), ("a[i]++;", True), ("--x;", True), ("f(1).g();", True), ("new A().b();", True), ("new A();", True), ("this.x += 2;", True), ("final int y = 1;", True), ("@A final var z = 2;", True), ('String s = "\\u0041\\n\\0";', True),
    ("for (i = 0, j = 1; i < 3; i++, --j) f();", True), ("for (int i = 0; ; ) { }", True), ("for (x; ; ) { }", False), ("Runnable r = () -> x++;", True), ("a.b().c = d -> e;", True), ("super.f();", True), ("int[] q = new int[3]; q[0] <<= 2;", True), ("(x) = 3;", True), ("class B { } B b = new B();", True),
])
def test_java(body, good):
    assert (language("java").failure(f"class A {{ void f() {{ {body} }} }}") is None) == good
