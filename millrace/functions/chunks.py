"""Chunks of Markdown: headings, then paragraphs, then sentences, then slices, with a tail of the chunk before where a section goes on."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Shorter tails aren't worth putting before a chunk.
LEAST_TAIL = 16
_HEADING = re.compile(r"^#{1,2}\s", re.MULTILINE)


def sections(body: str) -> list[str]:
    """A body cut before each heading of the first two levels; parts without text are left out."""
    parts: list[list[str]] = [[]]
    for line in re.split(r"\r?\n", body):
        if re.match(r"#{1,2}\s", line) and parts[-1]:
            parts.append([])
        parts[-1].append(line)
    return [s for s in map("\n".join, parts) if s.strip()]


def sentences(text: str, most: int) -> list[str]:
    """The sentences of a text; one beyond `most` characters is cut, behind its last line end if there is one in reach."""
    out = []
    for s in filter(None, re.split(r"(?<=[.!?])\s+", text)):
        at = 0
        while len(s) - at > most:
            line = s.rfind("\n", at + 1, at + most)
            cut = line + 1 if line > at else at + most
            out.append(s[at:cut])
            at = cut
        out.append(s[at:])
    return out


def packed(section: str, most: int) -> list[str]:
    """A section in pieces of at most `most` characters: paragraphs, long ones by sentences, put together while they fit."""
    if len(section) <= most:
        return [section]
    paragraphs = filter(None, re.split(r"\r?\n\s*\n", section))
    out: list[str] = []
    for unit in (u for p in paragraphs for u in ([p] if len(p) <= most else sentences(p, most))):
        if out and len(out[-1]) + 2 + len(unit) <= most:
            out[-1] += "\n\n" + unit
        else:
            out.append(unit)
    return out


def tail(before: str, size: int) -> str:
    """The end of a chunk, at most `size` characters and half of it, from a sentence's or at least a word's beginning on."""
    size = min(size, len(before) // 2)
    if size < LEAST_TAIL:
        return ""
    window = before[-size:]
    starts = [m.end() if i == 0 else m.start() + 1 for i, m in enumerate((re.search(r"(?<=[.!?])\s+", window), re.search(r"\s", window))) if m]
    return next((t for t in (window[i:].strip() for i in starts) if len(t) >= LEAST_TAIL), "")


def markdown(body: str, most: int = 4000, least: int = 200, overlap: int = 300) -> list[str]:
    """A body's chunks, in order. A chunk under `least` characters goes before the next one; none is longer than twice `most`."""
    if most < 1:
        raise ValueError("chunks hold a character or more")
    merged: list[str] = []
    held = ""
    for piece in (p.strip() for s in sections(body) for p in packed(s, most)):
        held = f"{held}\n\n{piece}" if held and piece else held or piece
        if len(held) >= least:
            merged.append(held)
            held = ""
    if held:
        merged.append(held)
    size = min(overlap, most // 2)
    out = merged[:1]
    for before, chunk in zip(merged, merged[1:], strict=False):
        more = "" if size <= 0 or _HEADING.search(chunk) else tail(before, size)
        out.append(f"{more}\n\n{chunk}" if more else chunk)
    return [c for chunk in out for c in ([chunk] if len(chunk) <= 2 * most else sentences(chunk, most))]


def chunked(body: Column, most: int = 4000, least: int = 200, overlap: int = 300) -> Column:
    """array of (index, content): see markdown. A null body gives null, one without text an empty array."""

    @pandas_udf("array<string>")
    def cut(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else markdown(b, most, least, overlap))

    return F.transform(cut(body), lambda c, i: F.struct(i.alias("index"), c.alias("content")))
