"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1 bits: all ways to split up to 7 languages in two, or for more languages as
many seeded random splits as keep codewords far apart. For each bit a binary classifier over hashed byte trigrams of the
lower-cased text weighs the languages of its two sides (log-odds of their mean trigram shares). A text's margins are
decoded by loss: the language whose codeword has the least sum of exp(-bit x margin). The score is that language's share of
exp(-loss); a text is ambiguous where the best two losses differ by less than `gap`.

Training counts all trigrams of all training rows in the tasks; counts by (language, bucket) reach the driver, whose
number doesn't grow with the rows. Both passes read whole texts; nothing but counts is shuffled.

Edge cases: a null text, or one without a letter, is `und` with score 0; a text of fewer than three bytes counts as padded
with spaces; with no training rows every text is `und`; with one language every text with a letter is that one, with score 1;
repeated rows each get a row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import CHUNK, LOWER, spans, utf8

BUCKETS = 1 << 12
ROWS = 256
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def counts(col: pa.Array, rows: int = ROWS):
    """(first, last, matrix of trigram counts by row, whether each row has a letter)."""
    raw, at = utf8(col)
    for i, j in spans(at, CHUNK):
        for a in range(i, j, rows):
            b = min(j, a + rows)
            n = np.diff(at[a : b + 1])
            # Each text between two spaces, so that trigrams see where it starts and ends.
            text = np.full(int(at[b] - at[a]) + 2 * (b - a) + 1, 32, np.uint32)
            row = np.repeat(np.arange(b - a), n)
            part = raw[at[a] : at[b]]
            text[np.arange(len(part)) + 2 * row + 1] = LOWER[part]
            h = (text[:-2] * np.uint32(0x9E3779B1) + text[1:-1] * np.uint32(0x85EBCA77) + text[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
            inner = np.zeros(len(text) - 2, bool)
            inner[np.arange(len(part)) + 2 * row] = True  # trigrams centred on a byte of a text
            m = np.bincount(row * BUCKETS + h[inner], minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
            letter = np.bincount(row, weights=_ASCII[part], minlength=b - a) > 0
            for r in np.flatnonzero(~letter & (np.bincount(row, weights=part > 127, minlength=b - a) > 0)):
                letter[r] = any(c.isalpha() for c in raw[at[a + r] : at[a + r + 1]].tobytes().decode("utf8", "replace"))
            yield a, b, m, letter


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1."""
    if n <= 7:
        sides = [s for s in product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(sides).T.reshape(n, -1)
    bits, rng, best = int(np.ceil(15 * np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        m = np.where(rng.random((n, bits)) < 0.5, 1, -1)
        dot = m @ m.T - 2 * bits * np.eye(n)
        near = bits - int(dot.max())
        if near > best[0] and (np.abs(m.sum(0)) < n).all():
            best = (near, m)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray

    def losses(self, m: np.ndarray) -> np.ndarray:
        n = np.maximum(m.sum(1, keepdims=True), 1)
        margin = np.clip(m @ self.weight / np.sqrt(n) / 2, -6, 6)
        return np.exp(-margin[:, None, :] * self.code[None]).mean(2)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count trigrams by language over all of docs and weigh them for each bit."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(1).to_pylist()
            for i, j, m, _ in counts(b.column(0)):
                for name in set(names[i:j]):
                    total[name] = total.get(name, 0) + m[[x == name for x in names[i:j]]].sum(0)
        for name, m in total.items():
            at = np.flatnonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(m[at].astype(np.int64))], ["lang", "bucket", "n"])

    known = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    got = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    share = np.zeros((len(langs), BUCKETS))
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        share[[at[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
        share = (share + 0.5) / (share.sum(1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(langs)) if len(langs) > 1 else np.zeros((len(langs), 0))
    side = lambda s: np.array([share[code[:, b] == s].mean(0) for b in range(code.shape[1])]).T.reshape(BUCKETS, -1)
    return Model(langs, code, np.log(side(1) / side(-1)))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", gap: float = 0.05) -> DataFrame:
    """Per row: doc_id, lang_pred, score, runner_up (null if there is none), ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            best, second = np.full(b.num_rows, -1), np.full(b.num_rows, -1)
            score, close = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for i, j, c, letter in counts(b.column(1)):
                if len(m.langs) == 1:
                    best[i:j], score[i:j] = np.where(letter, 0, -1), letter
                elif m.langs:
                    loss = m.losses(c)
                    order = np.argsort(loss, axis=1, kind="stable")
                    ranked = np.take_along_axis(loss, order[:, :2], 1)
                    p = np.exp(-(loss - ranked[:, :1]))
                    best[i:j], second[i:j] = np.where(letter, order[:, 0], -1), np.where(letter, order[:, 1], -1)
                    score[i:j], close[i:j] = np.where(letter, 1 / p.sum(1), 0.0), letter & (ranked[:, 1] - ranked[:, 0] < gap)
            other = [names[k] if k >= 0 else None for k in second]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(other, pa.string()), pa.array(close)], ["doc_id", "lang_pred", "score", "runner_up", "ambiguous"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, runner_up string, ambiguous boolean")
