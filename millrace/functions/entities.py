"""Expressions over names, aliases, tags, paths and prose: normal forms, junk names, verbs of links, code references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that stand for no entity (fixed values).
JUNK = (
    "unknown unnamed untitled anonymous anon someone somebody anyone anybody everyone everybody nobody none null nil undefined n/a na tbd tba todo other others misc various etc placeholder "
    "user users guest guests speaker participant participants attendee attendees member members customer customers client clients admin author owner me myself i you we us they them he she it self all "
    "team teams meeting meetings group person people company companies organization org project task event note page idea draft inbox test today"
).split() + ["no one"]
#: Those that may be an acronym when written in capitals (fixed values).
ACRONYMS = "us it me na i he she we all other".split()
#: Writers whose pages are no orphans (fixed values).
DERIVED_WRITERS = ("extract-atoms", "synthesize-concepts", "reflection", "patterns", "drift", "auto-think")


def normalized_alias(text: Column) -> Column:
    """Lower-cased, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def indexable_alias(text: Column, longest: int = 200) -> Column:
    """The normal form, or null where it is empty or too long: too long ones aren't cut, which would merge them."""
    n = normalized_alias(text)
    return F.when((n != "") & (F.length(n) <= longest), n)


def normalized_tag(text: Column, longest: int = 128) -> Column:
    """As an alias; null where it is empty or too long."""
    return indexable_alias(text, longest)


def junk_name(name: Column) -> Column:
    """Whether a name can't be an entity's: empty, without a letter, of one character, or a word of the list, an article before it
    or a path's last part too. Words in capitals of the acronym list are kept."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[*`\"'\[\](){}<>!?.,:;@~^|\\=$%]", ""), r"[-_\s]+", " "))
    letters = F.regexp_replace(name, r"\P{L}", "")
    capitals = (F.length(letters) >= 2) & (letters == F.upper(letters)) & (letters != F.lower(letters))

    def junk(k: Column) -> Column:
        listed = lambda x: x.isin(*JUNK) & ~(capitals & x.isin(*ACRONYMS))
        return ~k.rlike(r"\p{L}") | (F.length(F.replace(k, F.lit(" "), F.lit(""))) <= 1) | listed(k) | listed(F.regexp_replace(k, "^(the|a|an) ", ""))

    last = F.trim(F.regexp_extract(key, "^.+/([^/]+)$", 1))
    return F.when(name.isNull(), True).when(F.length(name) > 120, False).otherwise(junk(key) | ((last != "") & junk(last)))


def diary(kind: Column, slug: Column) -> Column:
    return kind.isin("diary", "journal") | slug.startswith("life/diary/")


def public_fields(*names: str, safe: tuple[str, ...] = ("slug", "type", "title", "updated_at")) -> list[str]:
    """Of the columns named, those that may be shown to anyone."""
    return [n for n in names if n in safe]


#: Paths of code in prose: folders that a repository has at its root, and extensions (fixed values).
CODE_REF = r"\b((?:src|lib|app|test|tests|scripts|docs|packages|internal|cmd|examples)/[\w\-./]+\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs|py|rb|go|rs|java|cs|cpp|cc|hpp|c|h|php|swift|kt|scala|lua|ex|exs|elm|ml|dart|zig|sol|sh|bash|css|html|vue|json|yaml|yml|toml))(?::(\d+))?\b"


def code_refs(text: Column) -> Column:
    """Distinct code paths that prose names outside code blocks, first ones in order."""
    from millrace.functions.text import without_code

    return F.array_distinct(F.regexp_extract_all(without_code(text), F.lit(CODE_REF), F.lit(1)))


#: Verbs of link types, the first that fits wins; a marked one doesn't hold beside words for a role that ended (fixed values).
VERBS = (
    ("founded", r"\b(?:founded|co-?founded|started the company|incorporated|founder of|founders? (?:include|are)|the founder|is a co-?founder|is one of the founders)\b", False),
    ("invested_in", r"\b(?:invested in|invests in|investing in|invest in|investment in|investments in|backed by|funding from|funded by|raised from|led the (?:seed|Series|round|investment)|led .{0,30}(?:Series [A-Z]|seed|round|investment)|participated in (?:the )?(?:seed|Series|round)|wrote (?:a |the )?check|first check|early investor|portfolio (?:company|includes)|board seat (?:at|in|on)|term sheet for)\b", False),
    ("advises", r"\b(?:advises|advised|advis[eo]r (?:to|at|for|of)|board director|non-executive director|independent director|director on the board|sits on the board|board member (?:at|of)|advisory (?:board|role|position|capacity|engagement|partnership|contract|relationship|work)|board advisor|on .{0,20} advisory board|joined .{0,20} advisory board|in an? advisory (?:capacity|role|position)|as an? (?:advis[eo]r|security advis[eo]r|technical advis[eo]r|strategic advis[eo]r|industry advis[eo]r|product advis[eo]r|board advis[eo]r|senior advis[eo]r)|(?:strategic|technical|security|product|industry|senior|board) advis[eo]r (?:to|at|for|of)|consults for|consulting role (?:at|with))\b", True),
    ("works_at", r"\b(?:CEO of|CTO of|COO of|CFO of|CMO of|CRO of|VP at|VP of|VPs? Engineering|VPs? Product|works at|worked at|working at|employed by|employed at|joined as|joined the team|engineer at|engineer for|director at|director of|head of|heads up .{0,20} at|leads engineering|leads product|leads the .{0,20} (?:team|org) at|manages engineering at|manages product at|running (?:engineering|product|design) at|currently at|previously at|previously worked at|spent .* (?:years|months) at|stint at|stint as|tenure at|tenure as|role at|position at|(?:senior|staff|principal|lead|backend|frontend|full-?stack|ML|data|security) engineer at|promoted to (?:senior|staff|principal|lead) .{0,20} at|(?:his|her|their|my) time at)\b", True),
)
#: Words for a role that ended, and how far before a verb they count (fixed values).
ENDED = ("former", "formerly", "ex-", "no longer", "not at", "not with", "not working", "never worked", "never was", "left", "quit", "departed", "previously", "used to")
ENDED_BEFORE = 40
#: What a person's page says of their role anywhere, the first that fits wins (fixed values).
ROLES = (
    ("invested_in", r"\b(?:partner at|partner of|venture partner|VC partner|invested early|investor at|investor in|portfolio|venture capital|early-stage investor|seed investor|fund [A-Z]|invests across|backs companies)\b"),
    ("advises", r"\b(?:full-time advis[eo]r|professional advis[eo]r|advises (?:multiple|several|various)|is an? (?:advis[eo]r|security advis[eo]r|technical advis[eo]r|strategic advis[eo]r|industry advis[eo]r|product advis[eo]r|senior advis[eo]r)|took on advisory roles|(?:her|his|their) advisory (?:work|role|engagement|portfolio)|serves as (?:an )?advis[eo]r)\b"),
    ("works_at", r"\b(?:is an? (?:senior|staff|principal|lead|backend|frontend|full-?stack|ML|data|security|DevOps|platform)? ?engineer at|is an? (?:senior|staff|principal|lead)? ?(?:developer|designer|product manager|engineering manager|director|VP) (?:at|of)|holds? the (?:CTO|CEO|CFO|COO|CMO|CRO|VP) (?:role|position|seat|title) at|is the (?:CTO|CEO|CFO|COO|CMO|CRO) of|employee at|on the team at|works on .{0,30} at)\b"),
)


def verb_link(context: Column, page_type: Column, target: Column | None = None, body: Column | None = None) -> Column:
    """The link type that the words around a link tell; `mentions` where none does, and on media and meeting pages.

    A verb of a role doesn't count within ENDED_BEFORE characters behind a word for its end. Jobs and investments are links to
    companies: a target in another folder is only mentioned. A person's page without any such verb, not even an ended one, that links to a
    company tells the role by its whole body.
    """
    ended = "|".join(rf"\b{w}\b[\s\S]{{0,{ENDED_BEFORE - len(w)}}}" for w in ENDED)
    plain = lambda verb: rf"(?i){verb}"
    holds = lambda verb: rf"(?i)(?={verb})(?!previously\b)(?<!{ended})"
    inside = F.lit(True) if target is None else ~F.contains(target, F.lit("/")) | target.startswith("companies/")
    fits = lambda kind: F.when(inside, kind).otherwise("mentions") if kind in ("works_at", "invested_in") else F.lit(kind)
    over = F.lit(False)
    for _, verb, ends in VERBS:
        over = over | context.rlike(plain(verb)) if ends else over
    out = F.lit("mentions")
    if target is not None and body is not None:
        prior = out
        for kind, role in reversed(ROLES):
            prior = F.when(body.rlike(plain(role)), kind).otherwise(prior)
        out = F.when((page_type == "person") & target.startswith("companies/") & ~over, prior).otherwise(out)
    for kind, verb, ends in reversed(VERBS):
        out = F.when(context.rlike(holds(verb) if ends else plain(verb)), fits(kind)).otherwise(out)
    return F.when(page_type.isin("media", "meeting"), "mentions").otherwise(out)


def embedding_signature(model: Column, dims: Column) -> Column:
    return F.concat_ws(":", model, dims.cast("string"))


def day_in_zone(at: Column, zone: str) -> Column:
    """The calendar day of a UTC moment in a zone."""
    return F.from_utc_timestamp(at, zone).cast("date")


def body_window(text: Column, offset: int, most: int) -> Column:
    """struct(window, next): at most `most` characters from an offset, and where the next window starts (null at the end)."""
    window = F.substring(text, offset + 1, most)
    return F.struct(window.alias("window"), F.when(F.length(text) > offset + most, F.lit(offset + most)).alias("next"))


def dated_bullets(text: Column) -> Column:
    """Dated bullet and third-level heading lines of a body: array of (date, event); only real dates of 1900 to 2099."""
    line = r"(?m)^(?:[ \t]{0,8}[-*][ \t]{1,4}(?:\*\*)?|###[ \t]{1,4})((?:19|20)\d{2}-\d{2}-\d{2})(?:\*\*)?[ \t]{0,4}(?:[—–:-][ \t]{0,4})?([^\n]{1,500})"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), F.lit(1)).alias("date"), F.regexp_extract_all(text, F.lit(line), F.lit(2)).alias("event"))
    return F.filter(found, lambda x: F.try_to_date(x["date"], "yyyy-MM-dd").isNotNull())


#: What a question may carry and how it is masked, in order (fixed values).
MASKS = (
    ("email", r"(?i)\b[\w.%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "[email]"),
    ("bearer", r"\b(?:bearer|Bearer)\s+[\w.~+/-]{10,}=*", "[token]"),
    ("jwt", r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}\b", "[token]"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){2,7}\b", "[iban]"),
    ("card", r"\b(?:\d[ -]?){12,18}\d\b", "[card]"),
    ("phone", r"\+\d[\d\s-]{6,14}\d", "[phone]"),
    ("phone", r"\b(?!\d{4}-\d{2}-\d{2}\b)\d{2,4}[ -]\d{2,4}[ -]\d{2,5}\b", "[phone]"),
    ("ip4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[ip]"),
    ("ip6", r"(?i)\b(?:[a-f0-9]{1,4}:){2,7}[a-f0-9]{0,4}\b", "[ip]"),
)


def masked(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """The text with each kind masked, one after the other."""
    for kind, pattern, mask in MASKS:
        if kinds is None or kind in kinds:
            text = F.regexp_replace(text, pattern, mask)
    return text


def mask_counts(text: Column) -> dict[str, Column]:
    """How many of each kind `masked` masks."""
    out: dict[str, Column] = {}
    for kind, pattern, mask in MASKS:
        n = F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        out[kind] = out[kind] + n if kind in out else n
        text = F.regexp_replace(text, pattern, mask)
    return out


def question_day(question: Column) -> Column:
    """The one day that a question names, unless it bounds a range; else null."""
    days = F.regexp_extract_all(question, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    bound = question.rlike(r"(?i)\b(since|after|before|until|from|by|between)\b[^.!?\n]*\b\d{4}-\d{2}-\d{2}\b")
    return F.when((F.size(days) == 1) & ~bound, F.try_to_date(F.get(days, 0), "yyyy-MM-dd"))


def markup_ratio(text: Column) -> Column:
    """The share of a Markdown body's characters, code and white space aside, that are markup."""
    from millrace.functions.text import without_code

    plain = without_code(text)
    solid = lambda t: F.length(F.regexp_replace(t, r"\s+", ""))
    prose = F.regexp_replace(F.regexp_replace(plain, r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]]*)\]\([^)]*\)", "$1")
    prose = F.regexp_replace(F.regexp_replace(prose, r"<[^>]+>", " "), r"(?m)^\s{0,3}(#{1,6}\s|>\s?|[-*+]\s|\d+\.\s)", " ")
    prose = F.regexp_replace(F.regexp_replace(prose, r"\|", " "), r"[*_~`]+", " ")
    return F.when(solid(plain) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (solid(plain) - solid(prose)) / solid(plain)))


def contextual_prefix(title: Column, synopsis: Column) -> Column:
    """What is put before a chunk when it is embedded: its title and synopsis between marks; null without either."""
    t, s = F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce(synopsis, F.lit(""))), F.lit(""))
    return F.when(t.isNotNull() | s.isNotNull(), F.concat(F.lit("<context>"), F.coalesce(t, F.lit("")), F.lit("\n"), F.coalesce(F.concat(s, F.lit("\n")), F.lit("")), F.lit("</context>\n")))


def frontmatter_tags(tags: Column) -> Column:
    """The tags of a frontmatter field, a JSON list or a comma-separated string, lower-cased, once each."""
    listed = F.from_json(tags, "array<string>")
    raw = F.when(tags.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.split(tags, ","))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


#: Keys of JSON objects whose values are never shown (fixed values of this library).
HIDDEN_KEYS = "password|passwd|secret|token|api_?key|authorization|cookie"


def redacted_json(text: Column) -> Column:
    """JSON text with the string values of hidden keys masked, at any depth."""
    return F.regexp_replace(text, rf'(?i)("(?:{HIDDEN_KEYS})"\s*:\s*)"(?:[^"\\]|\\.)*"', '$1"[redacted]"')


def body_parts(text: Column, most: int) -> Column:
    """A body in parts of at most `most` characters: whole sections where they fit, else paragraphs, else pieces."""
    sections = F.split(text, r"(?<=\n)(?=#{1,6} )")
    pieces = lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most))))
    paragraphs = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.flatten(F.transform(F.split(s, r"(?<=\n\n)"), pieces)))
    return F.filter(F.flatten(F.transform(sections, paragraphs)), lambda p: p != "")


def capitalised_runs(text: Column) -> Column:
    """Candidates for entities: runs of two to four capitalised words, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){1,3})\b"), F.lit(1)))


def parsed_facts(reply: Column) -> Column:
    """Facts of a model's JSON reply: array of (entity, fact, kind, confidence); junk names, empty claims and broken JSON give none."""
    rows = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<struct<entity:string,fact:string,kind:string,confidence:double>>")
    kept = F.filter(F.coalesce(rows, F.array().cast("array<struct<entity:string,fact:string,kind:string,confidence:double>>")), lambda x: ~junk_name(x["entity"]) & F.coalesce(F.trim(x["fact"]) != "", F.lit(False)))
    kind = lambda x: F.when(x["kind"].isin("event", "preference", "commitment", "belief", "fact"), x["kind"]).otherwise("fact")
    return F.transform(kept, lambda x: F.struct(F.trim(x["entity"]).alias("entity"), F.trim(x["fact"]).alias("fact"), kind(x).alias("kind"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x["confidence"], F.lit(1.0)))).alias("confidence")))
