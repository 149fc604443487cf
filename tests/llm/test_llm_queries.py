"""Registered queries of the llm package against SQL, brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import same, tables  # noqa: E402

from millrace.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def got(spark, sf_dir):
    made = {}

    def rows(name):
        if name not in made:
            made[name] = {r[0]: r for r in QUERIES[name](spark, sf_dir).collect()}
        return made[name]

    return rows


@pytest.fixture(scope="module")
def docs(sf_dir):
    return tables(sf_dir).execute("select doc_id, text, lang from documents").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_media_round_trip(got, docs):
    from millrace.llm.media import declared, padded, stored

    rows = got("op4_media")
    assert len(rows) == len(docs)
    for i, text, _ in docs:
        b = (text or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        r, m = rows[i], stored(padded(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256, r.declared) == (len(m), hashlib.sha256(m).hexdigest(), declared(p))
        # A medium that stands alone has its own type, whatever it was declared; one inside a multipart body is carved.
        alone = {b"RIFF": "audio/wav", b"BM": "image/bmp", b"\x89PNG": "image/png"}
        true = next((t for x, t in alone.items() if m.startswith(x)), None)
        assert r.type == (true or r.declared) and r.corrected == (r.type != r.declared) and (r.carved_at > 0) == (true is None)
        s = list(p)
        mean = sum(s) / len(s)
        assert f";mean={mean:.3f};spread={math.sqrt(sum((x - mean) ** 2 for x in s) / len(s)):.3f};" in r.feature
    assert {r.carved_at > 0 for r in rows.values()} == {r.corrected for r in rows.values()} == {True, False}


def brute_secrets(t: str) -> tuple[str, str]:
    from millrace.llm.secrets import ASSIGN, CLASSES, DIGITS, PART, PATH, THRESHOLD, UUID, WORDS

    base = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, t) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}", t):
        x = m[0]
        skip = f"(?i){WORDS}|{PART}" if re.search(PATH, x) else f"(?i){PART}"
        passed = {i for s in re.finditer(skip, x) for i in range(*s.span())}
        at = [i for i in range(len(x)) if i not in passed]
        rest = "".join(x[i] for i in at)
        if re.search(UUID, x) or re.search(DIGITS, rest):
            continue
        bar = next((THRESHOLD[k] for k, p in CLASSES.items() if re.search(p, rest)), THRESHOLD["mixed"])
        entropy = lambda w: -sum(n / 20 * math.log2(n / 20) for n in (w.count(c) for c in set(w)))
        hot = [j for j in range(len(rest) - 19) if entropy(rest[j : j + 20]) >= bar]
        if hot:
            more.append((m.start() + at[hot[0]], 3, m.start() + at[hot[-1] + 19] + 1, "entropy"))
    line = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))
    return hashlib.sha256(line(base).encode()).hexdigest(), line(base + more)


def test_secrets(got, docs):
    rows = got("op6_secrets")
    for i, text, _ in docs:
        assert (rows[i].base_sha256, rows[i].spans) == brute_secrets(text or "")


def brute_pii(t: str) -> list[tuple[str, int, int]]:
    from millrace.llm.pii import luhn

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii_base(got, docs):
    rows = got("op10_pii")
    for i, text, _ in docs:
        base = brute_pii(text or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def brute_components(texts: dict[int, str | None], k: int) -> dict[int, tuple[int, int]]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(got, docs):
    rows = got("op2_near_duplicates")
    want = brute_components({i: t for i, t, _ in docs}, 4)
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in rows.items())


def test_token_counts(got, docs):
    from millrace.llm.tokencount import build, counter, default_vocabulary

    c, rows = counter(default_vocabulary()), got("op7_token_counts")
    for i, text, _ in docs:
        t = text or ""
        after = re.sub("[0-9]{3,}", "<NUM>", t)
        assert (rows[i].n_before, rows[i].n_tokens) == (len(c.coder.encode_ordinary(t)), len(c.coder.encode_ordinary(after)))
        n = len(re.findall("[0-9]{3,}", t))
        assert rows[i].n_edits == n and (rows[i].n_encoded > 0) == (n > 0) and rows[i].n_encoded <= rows[i].n_tokens
        if not n:
            assert rows[i].n_leaves == build(t, c).width


def test_pii_spans(got, docs):
    """All spans of the query against base spans by plain patterns and the model decoded in plain Python."""
    from test_llm_operators import brute_model_spans

    from millrace.llm.pii import train

    crf, rows = train(), got("op10_pii")
    for i, text, _ in docs:
        base = brute_pii(text or "")
        more = sorted((k, a, b) for k, a, b in brute_model_spans(text or "", crf) if not any(a < e and s < b for _, s, e in base))
        order = ["tel", "nid", "name", "addr"]
        more.sort(key=lambda x: (order.index(x[0]), x[1]))
        assert rows[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in [*base, *more])


def test_quality_held_out(got, sf_dir):
    rows = got("op8_quality")
    held = [(q, rows[i].predicted) for i, q in tables(sf_dir).execute("select doc_id, quality from labels").fetchall() if rows[i].held_out]
    assert len(held) > 20
    assert sum(q == p for q, p in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_held_out(got, docs):
    rows = got("op9_language")
    held = [(lang, rows[i].lang_pred) for i, _, lang in docs if rows[i].held_out]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
