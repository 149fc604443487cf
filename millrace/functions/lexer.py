"""Symbols, imports and calls of source files by a lexer: Python, TypeScript or JavaScript, and Go.

A first pass walks comments, strings and brackets with a stack of states and blanks what isn't code, place by place; declarations are then
looked for in what is left, and end at their matching bracket, or in Python where the indentation does.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "go": "go"}
_STRING = r'"(?:\\.|[^"\\\n])*"?'
_CHAR = r"'(?:\\.|[^'\\\n])*'?"
_C = r"//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z)"
#: What a language's first pass stops at.
_STOPS = {
    "python": re.compile(r"#[^\n]*|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|" + _STRING + "|" + _CHAR + r"|[(\[{)\]}]", re.DOTALL),
    "typescript": re.compile(f"{_C}|{_STRING}|{_CHAR}|`|[(\\[{{)\\]}}]"),
    "go": re.compile(f"{_C}|{_STRING}|{_CHAR}|`[^`]*(?:`|\\Z)|[(\\[{{)\\]}}]"),
}
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.DOTALL)
_PAIRS = {")": "(", "]": "[", "}": "{"}
_NAME = r"[^\W\d][\w$]*"
_TS = re.compile(
    rf"(?P<function>\bfunction\s*\*?\s*(?P<f>{_NAME}))|(?P<class>\b(?:class|interface|enum)\s+(?P<c>{_NAME}))|(?P<type>\btype\s+(?P<t>{_NAME})\b[^=;{{}}]*=(?![=>]))"
    rf"|(?P<arrow>\b(?:const|let|var)\s+(?P<a>{_NAME})\s*(?::[^=;]+)?=\s*(?:async\b\s*)?(?:function\b|(?:<[^<>]*>\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_NAME})\s*(?::[^={{;]+)?=>))"
    rf"|(?P<method>(?:(?<=[\n;{{}}])|^)[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*(?P<m>#?{_NAME})\s*(?:<[^<>]*>\s*)?\((?=[^;]*?\)\s*(?::[^;{{}}]+)?\{{))"
)
_GO = re.compile(rf"^func\s*(?:\((?P<receiver>[^()]*)\)\s*)?(?P<f>{_NAME})|^type\s+(?P<t>{_NAME})\b|^[ \t]+(?P<g>{_NAME})\s+(?:struct|interface)\b", re.MULTILINE)
_PY = re.compile(rf"^(?P<indent>[ \t]*)(?:async\s+)?(?P<kind>def|class)\s+(?P<name>{_NAME})", re.MULTILINE)
_CALL = re.compile(rf"(?<![\w$.])((?:{_NAME}\s*\.\s*)*{_NAME})\s*(?:<[^<>()]*>\s*)?\(")
_NO_CALL = set("if for while switch catch return function func def class await yield typeof new in of and or not with elif except lambda go defer select case super import from as del assert raise is async type const var let".split())


@dataclass
class Symbol:
    name: str
    kind: str
    at: int  # of the name
    start: int
    end: int
    path: tuple[str, ...] = ()


@lru_cache(maxsize=1)
def blanked(source: str, language: str) -> tuple[str, dict[int, int]]:
    """The source with comments and strings as spaces, line ends kept, and where each opening bracket is closed."""
    out, closed, opened, stop = list(source), {}, [], _STOPS[language]
    still = dict.fromkeys("([{`", 0)  # how many of each are open
    at, n = 0, len(source)

    def blank(i: int, j: int) -> None:
        out[i:j] = re.sub(r"[^\n]", " ", source[i:j])

    def template(i: int) -> int:
        m = _TEMPLATE.match(source, i)
        blank(i, m.end())
        if m[1] == "${":
            opened.append(("`", m.end() - 1))
            still["`"] += 1
        return m.end()

    while at < n:
        m = stop.search(source, at)
        if not m:
            break
        at = m.end()
        if m[0] == "`":
            blank(m.start(), at)
            at = template(at)
        elif m[0] in "([{":
            opened.append((m[0], m.start()))
            still[m[0]] += 1
        elif m[0] in ")]}":
            if opened and opened[-1][0] == "`" and m[0] == "}":
                opened.pop()
                still["`"] -= 1
                blank(m.start(), at)
                at = template(at)
            elif still[_PAIRS[m[0]]]:
                while opened[-1][0] != _PAIRS[m[0]]:
                    still[opened.pop()[0]] -= 1  # never closed
                closed[opened.pop()[1]] = m.start()
                still[_PAIRS[m[0]]] -= 1
        else:
            blank(m.start(), at)
    return "".join(out), closed


_SPACE = re.compile(r"\s*")
_NEXT = re.compile(r"\Z|export\b|const\b|let\b|var\b|function\b|class\b|type\b|interface\b|func\b|import\b|@")


def _body(code: str, closed: dict[int, int], at: int, typed: bool = False) -> int:
    """Behind the block that follows a declaration's head, or behind its statement if none does. typed: the head may hold types with blocks.

    Looks at each place once, whatever follows in the file."""
    i = at
    solid = at - 1  # the last place before i that is no white space, or out of sight
    while solid >= 0 and solid >= at - 200 and code[solid].isspace():
        solid -= 1
    while i < len(code):
        c = code[i]
        if typed and c == "<":
            depth, i = 1, i + 1
            while depth and i < len(code):
                i = closed.get(i, i) + 1
                depth += 0 if i >= len(code) else (code[i] == "<") - (code[i] == ">" and code[i - 1] != "=")
        elif c == "{" and typed and solid >= at and code[solid] == ":":
            i = closed.get(i, len(code))
        elif c == "{":
            return closed.get(i, len(code) - 1) + 1
        if c in "([":
            i = closed.get(i, len(code))
        elif c in ";}":
            return i + (c == ";")
        elif c == "\n":
            after = _SPACE.match(code, i).end()
            if _NEXT.match(code, after) and not (solid >= max(at - 200, 0) and code[solid] in "=,&|<([{:?+>-"):
                return i
            i = after  # the line ends up to here are alike
            continue
        if i < len(code) and not code[i].isspace():
            solid = i
        i += 1
    return len(code)


def line_numbers(source: str) -> Callable[[int], int]:
    """The line, from 1, of each place."""
    ends = [m.start() for m in re.finditer("\n", source)]
    return lambda place: bisect_left(ends, place) + 1


def symbols(source: str, language: str) -> list[Symbol]:
    """Functions, classes, methods, bound arrow functions and types, by start; `path` names what stands around each."""
    code, closed = blanked(source, language)
    found: list[Symbol] = []
    if language == "python":
        inner = [0] * (len(code) + 1)  # depth of brackets at line starts matters only: a line inside brackets has no indentation of its own
        for i, j in closed.items():
            inner[i + 1] += 1
            inner[j] -= 1
        depth, lines = 0, []
        for m in re.finditer(r"[^\n]*\n|[^\n]+\Z", code):
            if m[0].strip() and not depth:
                lines.append((m.start(), len(m[0]) - len(m[0].lstrip())))
            depth += sum(inner[m.start() : m.end()])
        starts = [s for s, _ in lines]
        for m in _PY.finditer(code):
            first = bisect_right(starts, m.start()) - 1
            if first < 0 or starts[first] != m.start():
                continue
            indent = len(m["indent"])
            after = next((i for i in range(first + 1, len(lines)) if lines[i][1] <= indent), len(lines))
            end = starts[after] if after < len(lines) else len(code)
            while end and source[end - 1].isspace():
                end -= 1
            found.append(Symbol(m["name"], "class" if m["kind"] == "class" else "function", m.start("name"), m.start() + indent, end))
    elif language == "go":
        for m in _GO.finditer(code):
            group = next(g for g in "ftg" if m[g])
            kind = "class" if not m["f"] else "method" if m["receiver"] is not None else "function"
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            found.append(Symbol(m[group], kind, m.start(group), start, _body(code, closed, m.end())))
    else:
        for m in _TS.finditer(code):
            kind = next(k for k in ("function", "class", "type", "arrow", "method") if m[k])
            group = next(g for g in "fctam" if m[g])
            if kind == "method" and m[group] in _NO_CALL:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            head = m.end(group) if kind == "method" else m.end()
            found.append(Symbol(m[group], "const" if kind == "type" else kind, m.start(group), start, _body(code, closed, head, kind in ("function", "method", "class"))))
    found.sort(key=lambda s: (s.start, -s.end))
    around: list[Symbol] = []
    kept = []
    for s in found:
        while around and around[-1].end <= s.start:
            around.pop()
        if s.kind == "method" and language != "go" and not (around and around[-1].kind == "class"):
            continue  # a call with a block behind it
        s.path = tuple(a.name for a in around)
        kept.append(s)
        around.append(s)
    return kept


def imports(source: str, language: str) -> list[tuple[str, str, str]]:
    """(name, original, module): what a file imports by name."""
    out = []
    if language == "python":
        code = blanked(source, language)[0]
        for m in re.finditer(r"^[ \t]*from\s+([\w.]+)\s+import\s+(\([^)]*\)|[^\n]+)", code, re.MULTILINE):
            for part in m[2].strip("()").split(","):
                if w := re.findall(r"\w+", part):
                    out.append((w[-1], w[0], m[1]))
        for m in re.finditer(r"^[ \t]*import\s+([^\n]+)", code, re.MULTILINE):
            for part in m[1].split(","):
                if w := re.findall(r"[\w.]+", part):
                    out.append((w[-1], w[0].rpartition(".")[2], w[0]))
    elif language == "typescript":
        for m in re.finditer(r"^[ \t]*import\s+(?:type\s+)?([^'\";]+?)\s+from\s+['\"]([^'\"]+)['\"]", source, re.MULTILINE):
            head, _, names = m[1].partition("{")
            for part in names.rstrip("} \n").split(","):
                if w := [x for x in re.findall(r"[\w$]+", part) if x not in ("as", "type")]:
                    out.append((w[-1], w[0], m[2]))
            if w := re.match(r"([\w$]+)", head.strip(" ,\n")):
                out.append((w[1], "default", m[2]))
    else:
        for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|([^\n]+))", source, re.MULTILINE):
            for part in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", m[1] or m[2]):
                last = part[2].rpartition("/")[2]
                out.append((part[1] or last, last, part[2]))
    return out


def calls(source: str, language: str, found: list[Symbol]) -> list[tuple[int, str]]:
    """(index of the innermost symbol around, callee) of each call, once each; -1 outside of symbols."""
    code, declared = blanked(source, language)[0], {s.at for s in found}
    out, seen = [], set()
    at, around = 0, []
    for m in _CALL.finditer(code):
        while at < len(found) and found[at].start <= m.start():
            around.append(at)
            at += 1
        while around and found[around[-1]].end <= m.start():
            around.pop()
        own = next((i for i in reversed(around) if found[i].end > m.start()), -1)
        callee = "".join(m[1].split())
        last = callee.rpartition(".")[2]
        signature = own >= 0 and code.startswith("interface", found[own].start)
        if last in _NO_CALL or m.end(1) - len(last) in declared or signature or (own, callee) in seen:
            continue
        seen.add((own, callee))
        out.append((own, callee))
    return out


def chunks(source: str, found: list[Symbol], most: int = 4000) -> list[tuple[int, int, int]]:
    """(start, end, index of the symbol or -1) of pieces that make up the source: one for each symbol at the top, one for what lies between;
    pieces over `most` characters are cut at line ends."""
    out, at = [], 0
    for i, s in enumerate(found):
        if s.path or s.start < at:
            continue
        out += [(at, s.start, -1), (s.start, s.end, i)]
        at = s.end
    out.append((at, len(source), -1))
    cut = []
    for a, b, i in out:
        while b - a > most:
            line = source.rfind("\n", a + 1, a + most)
            c = line + 1 if line > a else a + most
            cut.append((a, c, i))
            a = c
        if b > a:
            cut.append((a, b, i))
    return cut
