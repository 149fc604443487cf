"""Text expressions, JVM-side: tokens, slugs, keys, markup, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def est_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded with two spaces before and one behind."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, one)))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def claim_key(text: Column) -> Column:
    return F.md5(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


def slugify(text: Column, longest: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)


def entity_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("ent_"), kind, F.lit("_"), slugify(name))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([A-Za-z][A-Za-z0-9_-]*)"), F.lit(1)), F.lower))


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|label]], first occurrences in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"), F.lit(1)), F.trim))


def markdown_links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*\]\(([^()\s]+)\)"), F.lit(1)))


def iso_dates(text: Column) -> Column:
    """Real calendar dates of 1900 to 2099, distinct, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2}-\d{2}-\d{2})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.try_to_date(x, "yyyy-MM-dd").isNotNull()))


def without_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"`[^`\n]*`", "")


def fenced_code(text: Column) -> Column:
    """(language, code) of fenced blocks."""
    block = r"(?s)```([A-Za-z0-9_+-]*)\n(.*?)```"
    langs, codes = (F.regexp_extract_all(text, F.lit(block), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(langs.alias("language"), codes.alias("code"))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, block ends become line breaks, five entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|article|section|ul|ol|nav)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def mail_body(text: Column) -> Column:
    """A mail without its signature (from a `-- ` line), quoted lines and the line that introduces them."""
    cut = F.regexp_replace(text, r"(?s)(^|\n)-- ?\n.*$", "")
    cut = F.regexp_replace(cut, r"(?m)^On .{1,200} wrote:\s*$", "")
    return F.trim(F.regexp_replace(cut, r"(?m)^>.*(\n|$)", ""))


def first_sentences(text: Column, n: int = 2) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?s)^\s*((?:.*?[.!?](?=\s|$)\s*){{1,{n}}})", 1))


def cut_at_word(text: Column, size: int) -> Column:
    """At most size characters, cut behind the last whole word; a longer first word is cut."""
    head = F.substring(text, 1, size)
    whole = F.regexp_extract(head, r"(?s)^(.*\S)\s+\S*$", 1)
    return F.when(F.length(text) <= size, text).when(F.substring(text, size + 1, 1).rlike(r"^\s$"), F.rtrim(head)).when(whole != "", whole).otherwise(head)


def prefix_boost(path: Column, boosts: dict[str, float], default: float = 1.0) -> Column:
    """The factor of the longest prefix of the path."""
    out, first = None, True
    for p, v in sorted(boosts.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        out = F.when(path.startswith(p), v) if first else out.when(path.startswith(p), v)
        first = False
    return out.otherwise(default) if out is not None else F.lit(default)


def bare_path(path: Column) -> Column:
    return F.regexp_replace(path, "^page(-truth)?://", "")


def effective_date(frontmatter: Column, name: Column) -> Column:
    """Date of frontmatter (date, event_date, published), else a date in the file's name."""
    get = lambda k: F.try_to_timestamp(F.get_json_object(frontmatter, f"$.{k}"))
    return F.coalesce(get("date"), get("event_date"), get("published"), F.try_to_timestamp(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")))


def horizon(text: Column) -> Column:
    """YYYY-MM: its last day; YYYY-MM-DD: that day if there is one; else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}$"), F.last_day(F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def scrub(text: Column) -> Column:
    """E-mail addresses, long digit runs, bearer tokens and connection passwords masked."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]")
    t = F.regexp_replace(t, r"(?i)bearer\s+[A-Za-z0-9._-]{8,}", "Bearer [TOKEN]")
    t = F.regexp_replace(t, r"://([^:/@\s]+):[^@\s/]+@", "://$1:***@")
    return F.regexp_replace(t, r"\+?\d[\d ().-]{7,}\d", "[NUMBER]")


#: Phrases of stored-prompt injections, by family (fixed values of this library).
INJECTIONS = {
    "override": r"(?i)\b(ignore|disregard|forget)\b.{0,30}\b(previous|above|prior|earlier)\b.{0,20}\b(instructions?|rules?|prompts?)\b",
    "role": r"(?i)\byou are now\b|\bact as (an?|the)\b.{0,30}\b(admin|system|root|developer)\b",
    "exfiltrate": r"(?i)\b(send|post|upload|forward)\b.{0,40}\b(passwords?|secrets?|tokens?|credentials?|keys?)\b",
    "markup": r"(?i)<\s*/?\s*(system|assistant|tool)\s*>|\[\[?system\]?\]",
}


def injection_families(text: Column) -> Column:
    hits = [F.when(text.rlike(p), F.lit(k)) for k, p in INJECTIONS.items()]
    return F.array_compact(F.array(*hits))


def content_sanity(text: Column, warn: int = 50_000, block: int = 500_000, markup: float = 0.85) -> Column:
    """block, warn or ok: by size in bytes, and by the share of characters that are markup."""
    prose = F.length(F.regexp_replace(text, r"(?s)<[^>]*>|\s+", ""))
    solid = F.length(F.regexp_replace(text, r"\s+", ""))
    share = F.when(solid > 0, 1 - prose / solid).otherwise(0.0)
    return F.when(F.octet_length(text) > block, "block").when((F.octet_length(text) > warn) | (share > markup), "warn").otherwise("ok")
