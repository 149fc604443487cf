"""Edits of texts, row by row: exact replacements, unified diffs by shortest edit scripts, and their application."""

from __future__ import annotations

import re
from array import array

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

#: Lines around a change that a diff shows.
CONTEXT = 3
#: Edits up to which a shortest script is looked for; beyond, the lines between the common head and tail are replaced as a whole.
MOST = 2000
#: Rows that are Python texts at a time.
SLICE = 64
NO_END = "\\ No newline at end of file"


def matched(a: list[str], b: list[str], most: int = MOST) -> list[tuple[int, int]]:
    """Pairs of equal lines, one longest common subsequence, by Myers' greedy search over diagonals; none if it takes over `most` edits."""
    n, m = len(a), len(b)
    rounds: list[array] = []
    ends = {1: 0}
    for d in range(min(n + m, most) + 1):
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and ends[k - 1] < ends[k + 1])
            x = ends[k + 1] if down else ends[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            ends[k] = x
            if x >= n and x - k >= m:
                return _walked(rounds, n, m)
        rounds.append(array("l", (ends[k] for k in range(-d, d + 1, 2))))
    return []


def _walked(rounds: list[array], x: int, y: int) -> list[tuple[int, int]]:
    """The equal pairs on the way that the rounds' furthest ends lead back."""
    out = []
    for d in range(len(rounds), 0, -1):
        k, last = x - y, rounds[d - 1]
        at = lambda j, last=last, d=d: last[(j + d - 1) // 2] if -d < j < d else -1
        down = k == -d or (k != d and at(k - 1) < at(k + 1))
        j = k + 1 if down else k - 1
        before = at(j)
        start = before if down else before + 1
        out += [(i, i - k) for i in range(x - 1, start - 1, -1)]
        x, y = before, before - j
    return [*((i, i) for i in range(x)), *reversed(out)]


def _lines(text: str) -> list[str]:
    """Lines with their ends, so that a last line without one differs from one with it."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def diff(before: str, after: str, label: str) -> str:
    """A unified diff, empty for equal texts. `patch` makes `after` of `before` and it again."""
    if before == after:
        return ""
    a, b = _lines(before), _lines(after)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    end = 0
    while end < min(len(a), len(b)) - head and a[-1 - end] == b[-1 - end]:
        end += 1
    same = [*((i, i) for i in range(head)), *((i + head, j + head) for i, j in matched(a[head : len(a) - end], b[head : len(b) - end])), *((len(a) - i, len(b) - i) for i in range(end, 0, -1)), (len(a), len(b))]
    ops: list[tuple[str, str]] = []
    x = y = 0
    for i, j in same:
        ops += [("-", s) for s in a[x:i]] + [("+", s) for s in b[y:j]] + ([(" ", a[i])] if i < len(a) else [])
        x, y = i + 1, j + 1
    changes = [i for i, (kind, _) in enumerate(ops) if kind != " "]
    spans: list[list[int]] = []
    for i in changes:
        if spans and i - spans[-1][1] <= 2 * CONTEXT + 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    out, at, old, new = [f"--- a/{label}\n", f"+++ b/{label}\n"], 0, 0, 0
    for first, last in spans:
        low, high = max(0, first - CONTEXT), min(len(ops), last + CONTEXT + 1)
        old, new = old + sum(k != "+" for k, _ in ops[at:low]), new + sum(k != "-" for k, _ in ops[at:low])
        hunk = ops[low:high]
        n, m = sum(k != "+" for k, _ in hunk), sum(k != "-" for k, _ in hunk)
        out.append(f"@@ -{old + (n > 0)},{n} +{new + (m > 0)},{m} @@\n")
        out += [k + s if s.endswith("\n") else f"{k}{s}\n{NO_END}\n" for k, s in hunk]
        at, old, new = high, old + n, new + m
    return "".join(out)


def patch(before: str, changes: str) -> str:
    """`before` after a unified diff. A hunk that doesn't fit is an error."""
    a, out, at = _lines(before), [], 0
    lines = re.findall(r"[^\n]*\n", changes)
    for i, line in enumerate(lines):
        if m := re.match(r"@@ -(\d+),(\d+) \+\d+,\d+ @@$", line):
            start = int(m[1]) - (m[2] != "0")
            out += a[at:start]
            at = start
        elif line[0] in " +-" and not (i < 2 and line.startswith(("--- ", "+++ "))):
            text = line[1:-1] if i + 1 < len(lines) and lines[i + 1] == NO_END + "\n" else line[1:]
            if line[0] != "+":
                if at >= len(a) or a[at] != text:
                    raise ValueError(f"the diff doesn't fit at line {at + 1}")
                at += 1
            if line[0] != "-":
                out.append(text)
    return "".join(out + a[at:])


def replace(body: str, edits: list[tuple[str, str]], marks: list[tuple[str, str]] = ()) -> dict:
    """body, error, edit, matches: the body after all edits (old, new) in order, or none of them and why.

    An old text must occur once, overlaps counted, outside the blocks between marks, which edits can neither touch nor make.
    """
    blocks = re.compile("|".join(rf"{re.escape(x)}.*?{re.escape(y)}" for x, y in marks), re.DOTALL) if marks else None
    kept = lambda t: [(m.start(), m.end()) for m in blocks.finditer(t)] if blocks else []
    whole = lambda t: [t[i:j] for i, j in kept(t)]
    loose = lambda t: blocks and any(m in blocks.sub("", t) for pair in marks for m in pair)
    fault = lambda error, i=None, n=None: {"body": body, "error": error, "edit": i, "matches": n}
    if not edits or any(not old for old, _ in edits) or loose(body):
        return fault("edit_invalid")
    text = body
    for i, (old, new) in enumerate(edits):
        if any(m in new for pair in marks for m in pair):
            return fault("edit_protected_span", i)
        places = [m.start() for m in re.finditer(f"(?={re.escape(old)})", text)]
        free = [p for p in places if not any(p < y and p + len(old) > x for x, y in kept(text))]
        if len(free) != 1:
            return fault("edit_ambiguous_match" if free else "edit_protected_span" if places else "edit_no_match", i, len(free))
        text = text[: free[0]] + new + text[free[0] + len(old) :]
    if blocks and (loose(text) or whole(text) != whole(body)):
        return fault("edit_protected_span")
    return {"body": text, "error": None, "edit": None, "matches": None}


def _row_by_row(make, *columns: pa.Array) -> pa.Array:
    """make of each row that has no null, by slices: what Python holds as text at once is a slice and not an Arrow batch."""
    parts = [pa.array([], pa.string())]
    for i in range(0, len(columns[0]), SLICE):
        rows = zip(*(c.slice(i, SLICE) for c in columns), strict=True)
        texts = ([x.as_py() for x in r] for r in rows)
        parts.append(pa.array((None if None in t else make(*t) for t in texts), pa.string()))
    return pa.concat_arrays(parts)


@arrow_udf(StringType())
def unified_diff(before: pa.Array, after: pa.Array, label: pa.Array) -> pa.Array:
    return _row_by_row(diff, before, after, label)


@arrow_udf(StringType())
def patched(before: pa.Array, changes: pa.Array) -> pa.Array:
    return _row_by_row(patch, before, changes)


def edited(body: Column, edits: Column, marks: list[tuple[str, str]] = ()) -> Column:
    """struct(body, error, edit, matches) of a body and an array of struct(old, new): see replace."""

    @pandas_udf("body string, error string, edit int, matches int")
    def run(bodies: pd.Series, lists: pd.Series) -> pd.DataFrame:
        done = [replace(b or "", [(e["old"], e["new"]) for e in (x if x is not None else [])], marks) for b, x in zip(bodies, lists, strict=True)]
        out = pd.DataFrame(done, columns=["body", "error", "edit", "matches"])
        return out.astype({"edit": "Int32", "matches": "Int32"})

    return run(body, edits)
