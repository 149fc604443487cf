"""Phrase collocations against SQL on the given tables and against plain counting on odd ones."""

from __future__ import annotations

import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F


def plain(rows, n, least, within, top):
    """Collocations by counting every phrase of every length."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    many = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    for (lang, p), a in many.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(o == lang and len(q) > len(p) and inside(q) and 100 * b >= within * a for (o, q), b in many.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        s, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    rows = {}
    for lang, found in out.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            rows[lang, rank] = (p.decode(), -a, left, right, total[lang], -s)
    return rows


def got(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def odd_rows():
    rng = random.Random(3)
    words = ["a", "b", "the", "Of", "é", "x" * 400, "日本", "n\x00l", " ", "q'"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n", "\t"]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, ""])) for _ in range(120)]
    return [*rows, (None, "en"), ("", None), ("  .,\n", "fr"), ("only", "xx"), *[("new york city. New  York\tcity!", "en")] * 7, (" ".join(["long tail of words"] * 5000), "de")]


@pytest.mark.parametrize(("n", "least", "within", "top"), [(3, 10, 50, 2000), (2, 3, 50, 5), (4, 4, 90, 40), (5, 2, 10, 2000)])
def test_equals_plain_counting(spark, n, least, within, top):
    from millrace.llm.collocations import collocations

    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, lang, 1, "w", "c") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, f int, w1 string, c string").repartition(5)
    assert got(collocations(docs, words=n, least=least, within=within, top=top)) == plain(rows, n, least, within, top)


def test_folds_and_a_full_screen_change_nothing(spark, monkeypatch):
    from millrace.llm import collocations as m

    rows = odd_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = plain(rows, 3, 5, 50, 2000)
    source = m._source(docs, "text", "lang")
    full = m.screen(source, 5) | ~m.screen(source, 5)  # every bit set: nothing is screened out
    monkeypatch.setattr(m, "screen", lambda *_: full)
    assert got(m.collocations(docs, least=5)) == want


def test_empty_tables(spark):
    from millrace.llm.collocations import collocations

    for rows in ([], [(None, None)], [("...", "en")], [("a b c", "en")]):
        assert collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    from millrace.llm.collocations import score

    rng = random.Random(5)
    rows = [(rng.randrange(1, 10**15), rng.randrange(1, 10**15), rng.randrange(1, 10**15)) for _ in range(300)]
    rows = [(min(r), *sorted(r)[1:]) for r in rows] + [(10**15, 10**15, 10**15), (999_999_999_999_999, 10**15, 10**15), (10, 10**15, 10**15)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", score(F.col("a"), F.col("l"), F.col("r")))
    assert all(x.s == 1_000_000 * x.a * x.a // (x.l * x.r) and not isinstance(x.s, Decimal) for x in df.collect())
