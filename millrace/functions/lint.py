"""Rules that a Markdown page should keep, and the repair of those that can be repaired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings that a model leaves before a page (fixed values).
PREAMBLES = (
    r"(?im)^Of course[.!]?\s*Here is (?:a |the )?(?:detailed |comprehensive |updated )?page[^.\n]*\.?\s*",
    r"(?im)^Certainly[.!]?\s*Here is[^.\n]*\.?\s*",
    r"(?im)^Here is (?:a |the )?(?:detailed |comprehensive |updated )?page[^.\n]*\.?\s*",
    r"(?im)^I've (?:created|updated|written|prepared) (?:a |the )?(?:detailed |comprehensive )?page[^.\n]*\.?\s*",
    r"(?im)^Sure[.!,]?\s*Here (?:is|are)[^.\n]*\.?\s*",
    r"(?im)^Absolutely[.!]?\s*Here[^.\n]*\.?\s*",
)
#: Bodies of a section that holds nothing yet (fixed values).
EMPTY = ("", "[No data yet]", "*[To be filled by agent]*")
ISSUE = "struct<line:int,rule:string>"


def _issue(line: Column, rule: str) -> Column:
    return F.struct(line.cast("int").alias("line"), F.lit(rule).alias("rule"))


def _at_top(rule: str, broken: Column) -> Column:
    return F.when(broken, F.array(_issue(F.lit(1), rule))).otherwise(F.array().cast(f"array<{ISSUE}>"))


def lint(body: Column) -> Column:
    """array of (line, rule), rule by rule in the order of the page's checks: llm-preamble (once for each opening), code-fence-wrap,
    placeholder-date, missing-title, missing-type and missing-created of a frontmatter or no-frontmatter, broken-citation,
    empty-section. A null body has none."""
    lines = F.split(body, "\n", -1)
    marked = lambda rule, hit: F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), hit(x, i).alias("hit"))), lambda s: s["hit"]), lambda s: _issue(s["i"] + 1, rule))
    top = [_at_top("llm-preamble", body.rlike(p)) for p in PREAMBLES]
    top.append(_at_top("code-fence-wrap", body.rlike(r"(?m)^```(?:markdown|md)\s*\n") & body.rlike(r"\n```\s*\z")))
    dates = marked("placeholder-date", lambda x, i: x.rlike(r"\bYYYY-MM-DD\b|\bXX-XX\b|\b\d{4}-XX-XX\b"))
    starts = body.startswith("---")
    end = F.locate("---", body, 4)
    head = F.substring(body, F.lit(4), end - 4)
    fields = [_at_top(f"missing-{k}", starts & (end > 0) & ~head.rlike(f"(?m)^{k}:")) for k in ("title", "type", "created")]
    none = _at_top("no-frontmatter", ~starts)
    # Behind a line's last closing bracket a citation opens, and the next line doesn't close it.
    opened = lambda x: F.contains(F.substring_index(x, "]", -1), F.lit("[Source:"))
    cites = marked("broken-citation", lambda x, i: opened(x) & ~F.coalesce(F.get(lines, i + 1).rlike(r"^[^\[]*\]"), F.lit(False)))
    # Sections: what follows a heading of the second level up to the next line that begins with one.
    heading = lambda x: x.rlike(r"^##\s+.+$")
    later = lambda i: F.filter(F.sequence(i + 1, F.size(lines)), lambda j: F.coalesce(F.get(lines, j).startswith("## "), j == F.size(lines)))
    text = lambda i: F.trim(F.regexp_replace(F.array_join(F.slice(lines, i + 2, F.array_min(later(i)) - i - 1), "\n"), r"^\s+|\s+$", ""))
    sections = marked("empty-section", lambda x, i: F.when(heading(x), text(i).isin(*EMPTY)).otherwise(F.lit(False)))
    return F.concat(*top, dates, *fields, none, cites, sections)


def repaired(body: Column) -> Column:
    """The body without model openings and without a fence around all of it, no more than one empty line in a row, one line end behind."""
    for p in PREAMBLES:
        body = F.regexp_replace(body, p, "")
    wrapped = body.rlike(r"\A```(?:markdown|md)\s*\n") & body.rlike(r"\n```\s*\z")
    body = F.when(wrapped, F.regexp_replace(F.regexp_replace(body, r"\A```(?:markdown|md)\s*\n", ""), r"\n```\s*\z", "")).otherwise(body)
    return F.concat(F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", ""), F.lit("\n"))
