"""What needs Unicode normal forms and scripts, which SQL lacks, by Arrow batches: keys of aliases, targets of links."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Longest slug.
LONGEST = 256
_FOREIGN = regex.compile(r"(?=\p{L})\P{Script=Latin}")
_DROPPED = {"NFKD": regex.compile("[^a-z0-9/-]"), "NFKC": regex.compile(r"\p{Variation_Selector}|[^\p{Ll}\p{Lm}\p{Lo}\p{M}\p{N}/-]")}


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def alias_key(text: Column) -> Column:
    """An alias as it is looked up: compatibility form, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), r"(?U)\s+", " "))


def _fold(part: str, form: str) -> str:
    t = regex.sub(r"\s+", "-", unicodedata.normalize(form, part.lower()))
    t = regex.sub("/+", "/", regex.sub("-+", "-", _DROPPED[form].sub("", t)))
    return t.strip("-/")[:LONGEST]


def target(name: str) -> str:
    """A loose name as the slug of a page: Latin letters without accents, hyphens for white space, `/` kept; a part with letters of
    another script, and one of which nothing else would stay, keeps its script. What leaves nothing is `unknown`."""
    latin = lambda p: _fold(p, "NFKD") or _fold(p, "NFKC")
    if not _FOREIGN.search(name):
        return latin(name) or "unknown"
    parts = [_fold(p, "NFKC") if _FOREIGN.search(p) else latin(p) for p in name.split("/")]
    return "/".join(p for p in parts if p)[:LONGEST] or "unknown"


@pandas_udf(StringType())
def link_target(name: pd.Series) -> pd.Series:
    """See target."""
    return name.map(target, na_action="ignore")
