"""Edits, diffs and Markdown chunks on golden and random texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import chunks as C
from millrace.functions import edits as E


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def test_matches_are_longest_common_subsequences():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        m = E.matched(a, b)
        assert all(a[i] == b[j] for i, j in m) and len(m) == lcs(a, b) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert E.matched(list("abcdef"), list("ghijkl"), most=3) == []


def test_patching_with_a_diff_gives_the_other_text():
    rng = random.Random(2)
    lines = ["a\n", "b\n", "\n", "@@ -1,1 +1,1 @@\n", "--- q\n", "+++ z\n", "-\n", "\\ No newline at end of file\n", "é\n", "x\r\n"]
    for _ in range(1500):
        a, b = ("".join(rng.choice(lines) for _ in range(rng.randrange(25))) + rng.choice(["", "end", "other"]) for _ in range(2))
        d = E.diff(a, b, "p.md")
        assert (d == "") == (a == b) and E.patch(a, d) == b
    assert E.diff("1\n2\n3\n4\n5\n6\n7\n8\n9\n", "1\n2\n3\n4\nfive\n6\n7\n8\n9\n", "f") == "--- a/f\n+++ b/f\n@@ -2,7 +2,7 @@\n 2\n 3\n 4\n-5\n+five\n 6\n 7\n 8\n"
    assert E.diff("", "x", "f") == "--- a/f\n+++ b/f\n@@ -0,0 +1,1 @@\n+x\n\\ No newline at end of file\n"
    with pytest.raises(ValueError, match="doesn't fit"):
        E.patch("q\n", E.diff("a\n", "b\n", "f"))
    big = "".join(f"{i}\n" for i in range(6000))
    other = "".join(f"x{i}\n" for i in range(6000))
    assert E.patch(big, E.diff(big, other, "f")) == other  # beyond the bound of edits: one replacement


MARKS = [("<!-- f -->", "<!-- /f -->")]


@pytest.mark.parametrize(
    ("body", "edits", "want"),
    [
        ("one two three", [("two", "2")], ("one 2 three", None, None, None)), ("aa", [("a", "b")], (None, "edit_ambiguous_match", 0, 2)), ("aaa", [("aa", "b")], (None, "edit_ambiguous_match", 0, 2)), ("x", [("y", "z")], (None, "edit_no_match", 0, 0)), ("x", [("x", "y"), ("y", "z")], ("z", None, None, None)),
        ("x", [("x", "y"), ("x", "z")], (None, "edit_no_match", 1, 0)), ("x", [], (None, "edit_invalid", None, None)), ("x", [("", "y")], (None, "edit_invalid", None, None)), ("x <!-- f -->x<!-- /f -->", [("x", "y")], ("y <!-- f -->x<!-- /f -->", None, None, None)),
        ("<!-- f -->x<!-- /f -->", [("x", "y")], (None, "edit_protected_span", 0, 0)), ("x", [("x", "<!-- f -->")], (None, "edit_protected_span", 0, None)), ("ab", [("a", "<!-- "), ("b", "f -->")], (None, "edit_protected_span", None, None)), ("<!-- f -->", [("f", "g")], (None, "edit_invalid", None, None)),
    ],
)
def test_replacements(spark, body, edits, want):
    got = E.replace(body, edits, MARKS)
    assert (got["body"], got["error"], got["edit"], got["matches"]) == (want[0] if want[0] is not None else body, *want[1:])


def test_edits_as_columns(spark):
    df = spark.createDataFrame([(1, "a b", [("b", "c")]), (2, None, [("b", "c")]), (3, "x", None)], "id int, body string, edits array<struct<old:string,new:string>>")
    rows = {r.id: tuple(r.e) for r in df.select("id", E.edited(F.col("body"), F.col("edits")).alias("e")).collect()}
    assert rows == {1: ("a c", None, None, None), 2: ("", "edit_no_match", 0, 0), 3: ("x", "edit_invalid", None, None)}


def test_chunks():
    assert C.markdown("") == [] and C.markdown("  \n") == [] and C.markdown("short") == ["short"]
    assert C.markdown("# A\n\n" + "x" * 250 + "\n## B\n" + "y" * 250 + "\n### C\nz", 4000, 200, 0) == ["# A\n\n" + "x" * 250, "## B\n" + "y" * 250 + "\n### C\nz"]
    assert C.markdown("# A\nfew\n# B\n" + "y" * 300) == ["# A\nfew\n\n# B\n" + "y" * 300]  # a short one goes before the next
    long = " ".join(f"Sentence number {i} is here." for i in range(60))
    cut = C.markdown(long, 400, 50, 100)
    assert all(len(c) <= 600 for c in cut) and all(any(c.startswith(f"Sentence number {i} ") for i in range(60)) for c in cut)
    for before, c in zip(cut, cut[1:], strict=False):
        first = c.split("\n\n")[0]
        assert before.endswith(first) or first in before  # the tail of the one before, from a sentence's beginning
    assert C.markdown(long, 400, 50, 0)[1].split("\n\n")[0] not in C.markdown(long, 400, 50, 0)[0]
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "w. ", "\n", "\n\n", "# H\n", "## I\n", "x" * 90, "\r\n\r\n", "é! "]) for _ in range(rng.randrange(80)))
        for most, least, overlap in ((60, 20, 0), (60, 20, 30), (500, 100, 300), (1, 1, 0)):
            made = C.markdown(text, most, least, overlap)
            assert all(0 < len(c) <= 2 * most for c in made)
            if not overlap:
                assert "".join("".join(made).split()) == "".join(text.split())


def test_chunk_columns(spark):
    df = spark.createDataFrame([("# A\ntext",), ("",), (None,)], "b string").select(C.chunked(F.col("b")).alias("c"))
    assert [None if r.c is None else [tuple(x) for x in r.c] for r in df.collect()] == [[(0, "# A\ntext")], [], None]


def test_diffs_hold_a_slice_of_their_batch(spark):
    import tracemalloc

    import pyarrow as pa

    from millrace.functions.edits import unified_diff

    texts = pa.array([f"{i}\n" + "x" * 20_000 for i in range(1500)] + [None])
    tracemalloc.start()
    made = unified_diff.func(texts, texts.take(pa.array([*range(1, 1501), 0])), pa.array(["p"] * 1501))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.null_count == 2 and made[0].as_py().startswith("--- a/p\n") and peak < 10_000_000
