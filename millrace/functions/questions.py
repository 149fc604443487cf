"""What a question asks for: intent, time, relation; column expressions over a question's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intent(question: Column) -> Column:
    """exact (a quotation), howto, personal, factual or topic; the first that fits."""
    return (
        F.when(question.rlike(r'^\W*"[^"]+"\W*$'), "exact")
        .when(question.rlike(r"(?i)\b(how (do|to|can)|steps?)\b"), "howto")
        .when(question.rlike(r"(?i)\b(my|mine|i|me)\b"), "personal")
        .when(question.rlike(r"(?i)\b(who|when|where|which|what)\b|\?"), "factual")
        .otherwise("topic")
    )


def wants_recent(question: Column) -> Column:
    return question.rlike(r"(?i)\b(latest|newest|recent(ly)?|today|yesterday|this (week|month|year)|now|currently)\b")


#: Verbs of a question about a relation, and the link type that each asks for.
RELATIONS = {"works_at": r"works? (at|for)|employed by", "invested_in": r"invest(s|ed)? in", "founded": r"found(s|ed)|start(s|ed) up", "advises": r"advis(es|ed|or)", "located_at": r"(is|are) (in|located)|lives? in"}


def relation(question: Column) -> Column:
    """struct(type, direction, name) of `who works at X` (in) or `where does X work at` (out); null where no relation is asked for."""
    out = F.lit(None).cast("struct<type:string,direction:string,name:string>")
    for kind, verb in RELATIONS.items():
        into = rf"(?i)^\s*(?:who|which \w+)\s+(?:{verb})\s+(.+?)\s*\??\s*$"
        outward = rf"(?i)^\s*(?:where|what|whom?)\s+(?:does|did|is|are|has)\s+(.+?)\s+(?:{verb.replace('s?', '').replace('(s|ed)?', '')})\s*\??\s*$"
        groups = lambda p: F.regexp_extract(question, p, 0) != ""
        name = lambda p: F.regexp_replace(question, p, "$" + str(_last_group(p)))
        out = F.when(groups(into), F.struct(F.lit(kind).alias("type"), F.lit("in").alias("direction"), name(into).alias("name"))).when(groups(outward), F.struct(F.lit(kind).alias("type"), F.lit("out").alias("direction"), F.regexp_extract(question, outward, 1).alias("name"))).otherwise(out)
    return out


def _last_group(pattern: str) -> int:
    import re

    return re.compile(pattern).groups
