"""The audit of sources against plain counting (op13's SQL is compared in test_llm_queries)."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest


def plain(rows, least=3, top=200):
    df, c = Counter(), Counter()
    sources = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        df.update((lang, t) for t in set(terms))
        c.update((lang, source, t) for t in terms)
    out = set()
    for lang, own in sources.items():
        kept = [t for (o, t), n in df.items() if o == lang and n >= least]
        p = {}
        for s in own:
            n = sum(c[lang, s, t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[lang, s, t] + 1) // (n + len(kept)) for t in kept}
        all_n = sum(c[lang, s, t] for t in kept for s in own)
        q = {t: 1 + 10**9 * (sum(c[lang, s, t] for s in own) + 1) // (all_n + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if c[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(sorted(found), 1)}
    return out


def got(df):
    rows = list(map(tuple, df.collect()))
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows():
    rng = random.Random(4)
    words = ["the", "The", "of", "é", "日本", "x1y", "a-b", "\U0001f600", "q" * 300, *(f"t{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(80))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S1", "", None, "日"])) for _ in range(150)]
    return [*rows, (None, "en", "s9"), ("", "xx", "a"), ("", "xx", "b"), ("solo solo", "yy", "a"), ("12 34", None, None), ("Common word " * 30_000, "en", "s1"), *[("same text", "zz", "one")] * 5]


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 2), (40, 5)])
def test_equals_plain_counting(spark, monkeypatch, least, top):
    from millrace.llm import divergence as m

    monkeypatch.setattr(m, "BLOCK", 7)
    monkeypatch.setattr(m, "TILE", 6)
    monkeypatch.setattr(m, "PAIRS", 5)
    rows = odd_rows()
    docs = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, h int, term string").repartition(6)
    assert got(m.divergences(docs, least=least, top=top)) == plain(rows, least, top)


def test_small_folds_and_many_sources(spark, monkeypatch):
    from millrace.llm import divergence as m

    monkeypatch.setattr(m, "FOLD", 50)
    rng = random.Random(9)
    rows = [(" ".join(f"w{chr(97 + int(rng.expovariate(0.2)) % 26)}" for _ in range(12)), "en", f"s{rng.randrange(70)}") for _ in range(500)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert got(m.divergences(docs)) == plain(rows)


def test_empty_tables(spark):
    from millrace.llm.divergence import divergences

    for rows in ([], [(None, None, None)], [("a", "en", "s")]):
        assert divergences(spark.createDataFrame(rows, "text string, lang string, source string")).collect() == []


def test_shares_are_exact(spark):
    from millrace.llm.divergence import shares

    rng = random.Random(2)
    rows = [(rng.randrange(n), n) for n in (rng.randrange(1, 9 * 10**15) for _ in range(500))] + [(0, 1), (9 * 10**15 - 2, 9 * 10**15 - 1)]
    c, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    assert shares(c, n).tolist() == [1 + 10**9 * (a + 1) // b for a, b in rows]
