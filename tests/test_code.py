"""Symbols, chunks, calls and walks over small sources of three languages."""

from __future__ import annotations

import random

import pytest

from millrace.functions import lexer
from millrace.operators import code as K

PY = '''"""def not_this(): {"""
import os.path
from util import (helper as h,
    other)
x = "def nor_this(): ("  # class Nor: (

@deco(1)
async def outer(a,
    b=(1, 2)):
    """doc ( [ {"""
    def inner():
        return h(a)

    class Local:
        def method(self): return self.other_method(os.getcwd())
        def other_method(self, *a):
            return inner()
    return inner() + outer(1, 2)
class Big(Base):
    y = call_in_class(
  1)

    def one(self):
        return f"{x}"
top(helper)
'''
TS = """import def, { a as b, type C } from './lib/util.js';
// function no() {
/* class No { */
export async function* gen<T>(x: T, y = { z: ')' }): Promise<{ q: number }> {
  const s = `tpl ${b(x)} { ${`in ${deep(`}`)}`} }`;
  if (x) { return later(); }
}
export const arrow = async (p: string): Promise<void> => {
  await p.then(() => run(p));
};
const short = (n) => n * twice(n)
export abstract class Box<T> extends Base {
  private static make(a: number): Box<number> {
    return new Box(a);
  }
  get value() { return this.make(1) }
  constructor(public x: T) { super(x); }
}
interface Shape { area(): number }
export type Kind = 'a' | 'b';
enum Color { Red = '}', }
let str = "class Fake {";
"""
GO = """package main
import (
	"fmt"
	u "example.org/x/util"
)
type Server struct { n int }
type (
	Inner struct { f func() }
)
func (s *Server) Run(x map[string]int) error {
	raw := `func Fake() {`
	fmt.Println("}", raw)
	return s.stop(func() { u.Help() })
}
func stop() { go Run() }
"""


def found(source, language):
    return [(".".join((*s.path, s.name)), s.kind) for s in lexer.symbols(source, language)]


def test_symbols():
    assert found(PY, "python") == [("outer", "function"), ("outer.inner", "function"), ("outer.Local", "class"), ("outer.Local.method", "function"), ("outer.Local.other_method", "function"), ("Big", "class"), ("Big.one", "function")]
    assert found(TS, "typescript") == [("gen", "function"), ("arrow", "arrow"), ("short", "arrow"), ("Box", "class"), ("Box.make", "method"), ("Box.value", "method"), ("Box.constructor", "method"), ("Shape", "class"), ("Kind", "const"), ("Color", "class")]
    assert found(GO, "go") == [("Server", "class"), ("Inner", "class"), ("Run", "method"), ("stop", "function")]
    at = {s.name: PY[s.start : s.end] for s in lexer.symbols(PY, "python")}
    assert at["inner"] == "def inner():\n        return h(a)" and at["Big"].endswith('return f"{x}"') and at["outer"].endswith("outer(1, 2)")
    at = {s.name: TS[s.start : s.end] for s in lexer.symbols(TS, "typescript")}
    assert at["gen"].endswith("later(); }\n}") and at["short"] == "const short = (n) => n * twice(n)" and at["Kind"] == "type Kind = 'a' | 'b';" and at["Color"].endswith("'}', }")
    assert {s.name: GO[s.start : s.end] for s in lexer.symbols(GO, "go")}["stop"] == "func stop() { go Run() }"


def test_imports_and_calls():
    assert lexer.imports(PY, "python") == [("h", "helper", "util"), ("other", "other", "util"), ("os.path", "path", "os.path")]
    assert lexer.imports(TS, "typescript") == [("b", "a", "./lib/util.js"), ("C", "C", "./lib/util.js"), ("def", "default", "./lib/util.js")]
    assert lexer.imports(GO, "go") == [("fmt", "fmt", "fmt"), ("u", "util", "example.org/x/util")]
    by = lambda source, language: [(lexer.symbols(source, language)[i].name if i >= 0 else None, c) for i, c in lexer.calls(source, language, lexer.symbols(source, language))]
    assert by(PY, "python") == [(None, "deco"), ("inner", "h"), ("method", "self.other_method"), ("method", "os.getcwd"), ("other_method", "inner"), ("outer", "inner"), ("outer", "outer"), ("Big", "call_in_class"), (None, "top")]
    assert by(TS, "typescript") == [("gen", "b"), ("gen", "deep"), ("gen", "later"), ("arrow", "p.then"), ("arrow", "run"), ("short", "twice"), ("make", "Box"), ("value", "this.make")]
    assert by(GO, "go") == [("Run", "fmt.Println"), ("Run", "s.stop"), ("Run", "u.Help"), ("stop", "Run")]


@pytest.mark.parametrize(("language", "source"), [("python", PY), ("typescript", TS), ("go", GO)])
def test_chunks_make_up_the_source(language, source):
    rng = random.Random(3)
    for most in (10, 60, 4000):
        for _ in range(60):
            text = list(source)
            for _ in range(rng.randrange(6)):
                i = rng.randrange(len(text))
                text[i : i + rng.randrange(3)] = rng.choice(["{", "}", "(", "`", '"', "'", "\n", "/*", "#", "", "def x():", "é\U0001f600"])
            text = "".join(text)
            pieces = lexer.chunks(text, lexer.symbols(text, language), most)
            assert "".join(text[a:b] for a, b, _ in pieces) == text and all(0 < b - a <= most for a, b, _ in pieces)
            blank, _ = lexer.blanked(text, language)
            assert len(blank) == len(text) and blank.count("\n") == text.count("\n")
            lexer.calls(text, language, lexer.symbols(text, language))
    assert lexer.chunks("", [], 5) == [] and lexer.symbols("", language) == []


def test_long_sources_take_linear_time():
    import time

    for language, unit in (("python", "def f(x):\n    return g(x)\n"), ("typescript", "function f(x) { return g(`${x}`); }\n"), ("go", "func f(x int) { g(x) }\n")):
        took = []
        for n in (2000, 8000):
            began = time.process_time()
            found = lexer.symbols(unit * n, language)
            assert len(found) == n and len(lexer.calls(unit * n, language, found)) == n
            took.append(time.process_time() - began)
        assert took[1] < 12 * max(took[0], 0.05)


FILES = [
    ("src/a.py", "from b import shared, twice as t2\nimport c\ndef local():\n    pass\ndef run():\n    local()\n    shared()\n    t2()\n    c.far()\n    lonely()\n    many()\n    run()\n    nowhere()\n"),
    ("src/b.py", "def shared():\n    local()\ndef twice(): pass\ndef many(): pass\n"), ("src/c.py", "def far(): pass\ndef many(): pass\ndef shared(): pass\n"), ("lib/d.py", "def lonely():\n    run()\n"),
    ("web/x.ts", "export function lonely() { helper(); }\nfunction helper() {}\n"), ("readme.md", "def nothing(): pass"), ("empty.py", None),
]


def test_resolution_and_walks(spark):
    files = spark.createDataFrame(FILES, "path string, source string").repartition(3)
    s, i, c = K.symbols(files), K.imports(files), K.calls(files)
    rows = {(r.caller, r.callee, r.path): (r.state, r.scope, r.target, r.candidates) for r in K.resolved(c, s, i).collect()}
    a = lambda callee: rows["run", callee, "src/a.py"]
    assert a("local") == ("resolved", "file", "src/a.py::local", 1) and a("shared") == ("resolved", "import", "src/b.py::shared", 1) and a("t2") == ("resolved", "import", "src/b.py::twice", 1)
    assert a("c.far") == ("resolved", "import", "src/c.py::far", 1) and a("lonely") == ("resolved", "global", "lib/d.py::lonely", 1) and a("many") == ("ambiguous", "global", None, 2)
    assert a("run") == ("unresolved", None, None, 0) and a("nowhere") == ("unresolved", None, None, 0)
    assert rows["lonely", "helper", "web/x.ts"] == ("resolved", "file", "web/x.ts::helper", 1) and rows["shared", "local", "src/b.py"][:2] == ("resolved", "global")
    e = K.edges(K.resolved(c, s, i))
    up = {r.slug: (r.depth, round(r.confidence, 3)) for r in K.walk(e, ["src/a.py::local"], 3, "in").collect()}
    assert up == {"src/a.py::local": (0, 1.0), "src/a.py::run": (1, 0.769), "src/b.py::shared": (1, 0.769), "lib/d.py::lonely": (2, 0.625)}
    assert "".join(r.content for r in sorted(K.chunks(files).filter("path = 'src/a.py'").collect(), key=lambda r: r["index"])) == FILES[0][1]
    lines = {(r.path, r.symbol): (r.start_line, r.end_line) for r in s.collect()}
    assert lines["src/a.py", "run"] == (5, 13) and lines["src/b.py", "twice"] == (3, 3)


def test_symbol_at_a_line(spark):
    from millrace.operators import maintenance as M

    text = "class A:\n    def f(self):\n        return g(1)\n\ndef g(x):\n    return x\n"
    s = K.symbols(spark.createDataFrame([("a.py", text), ("b.py", "def ("), ("c.py", None)], "path string, source string"))
    assert {r.symbol: (r.kind, r.qualified, r.start_line, r.end_line) for r in s.collect()} == {"A": ("class", "A", 1, 3), "f": ("function", "A.f", 2, 3), "g": ("function", "g", 5, 6)}
    lines = spark.createDataFrame([("a.py", 3), ("a.py", 1), ("a.py", 6), ("a.py", 4)], "path string, line int")
    assert {r.line: r.symbol for r in M.symbol_at(s, lines).collect()} == {3: "f", 1: "A", 6: "g"}


def test_lexing_takes_time_in_proportion():
    """Four times the declarations of one file must not take sixteen times the time."""
    import time

    from millrace.functions import lexer

    def seconds(source, lang):
        best = 1e9
        for _ in range(2):
            t = time.process_time()
            lexer.symbols(source, lang)
            best = min(best, time.process_time() - t)
        return best

    made = {
        "python": lambda n: "".join(f"def part_{i}(x):\n    return 'a name of a part of some length {i}'\n" for i in range(n)),
        "go": lambda n: "".join(f"type T{i} int\n" for i in range(n)),
        "typescript": lambda n: "{ [" * n + "( )" * n,
    }
    for lang, of in made.items():
        small, large = of(8_000), of(32_000)
        assert seconds(large, lang) < 9 * seconds(small, lang) + 0.2, lang


def test_lines_of_symbols_and_chunks(spark):
    source = "\n\ndef a():\n    pass\n\n\nclass B:\n    def c(self):\n        pass\n"
    files = spark.createDataFrame([("m.py", source)], "path string, source string")
    got = {(r.qualified, r.start_line, r.end_line) for r in K.symbols(files).collect()}
    assert got == {("a", 3, 4), ("B", 7, 9), ("B.c", 8, 9)}
    assert [r.start_line for r in K.chunks(files).orderBy("index").collect()] == [1, 3, 4, 7, 9]


def test_one_pass_gives_calls_symbols_and_imports(spark):
    files = spark.createDataFrame([("m.py", "from n import g as h\n\ndef a():\n    h()\n    b()\n\ndef b():\n    pass\n"), ("n.py", "def g():\n    pass\n")], "path string, source string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    calls, symbols, imports = K.lexed(files)
    assert rows(calls) == rows(K.calls(files))
    assert rows(symbols) == rows(K.symbols(files).select(symbols.columns))
    assert rows(imports) == rows(K.imports(files))
    got = {(r.callee, r.state, r.scope, r.target) for r in K.resolved(calls, symbols, imports).collect()}
    assert got == {("h", "resolved", "import", "n.py::g"), ("b", "resolved", "file", "m.py::b")}
