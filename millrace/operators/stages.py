"""Post-fusion stages over the hits of a query, each a function from a result DataFrame to one.

A result has `id` and `score`, and what a stage names beside them (slug, title, path, source). It holds one query's hits, whose
number the arms bound; where a stage needs an order over all of them, it says so. Ties end in the id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.entities import normalized_alias
from millrace.operators.search import title_phrase

#: Factors (fixed values).
EXACT = {"entity": 1.25, "event": 1.1}
TITLE, ALIAS, ALIAS_PRESENT = 1.25, 1.05, 1.1
CHRONICLE = {"off": 1.0, "on": 1.15, "strong": 1.25}
ADJACENT, CROSS_SOURCE, SESSION = 1.05, 1.1, 0.95
#: Ranks of trust (fixed values).
TRUST = {"owner": 3, "member": 2, "agent": 1, "external": 0}
#: Evidence that settles a question, and what each label says about whether a page exists (fixed values).
STRONG = ("exact_title_match", "alias_hit", "high_vector_match")
SAFETY = {"alias_hit": "exists", "exact_title_match": "exists", "high_vector_match": "exists", "keyword_exact": "probable", "weak_semantic": "unknown"}


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("id")]


def scaled(result: DataFrame, factor: Column, name: str | None = None) -> DataFrame:
    """score x factor; with a name, the factor is kept in the map `explain` beside those of earlier stages."""
    out = result.withColumn("score", F.col("score") * factor)
    if name is None:
        return out
    one = F.create_map(F.lit(name), factor.cast("double"))
    return out.withColumn("explain", F.map_concat("explain", one) if "explain" in result.columns else one)


def is_exact(question: str, slug: Column, title: Column) -> Column:
    """Whether slug or title is the question itself: as it stands, in kebab case, or as a slug's last part."""
    q = " ".join(question.lower().split()) if question.strip() else ""
    raw, kebab = question.lower().strip(), "-".join(q.split())
    s = F.lower(slug)
    return F.lit(bool(raw)) & F.coalesce((s == raw) | (s == kebab) | s.endswith(f"/{kebab}") | (F.lower(F.trim(title)) == raw), F.lit(False))


def exact_boost(question: str, taxonomy: str, slug: Column, title: Column) -> Column:
    return F.when(is_exact(question, slug, title), EXACT.get(taxonomy, 1.0)).otherwise(1.0)


def title_boost(question: Column, title: Column) -> Column:
    return F.when(title_phrase(title, question), TITLE).otherwise(1.0)


def salience_multiplier(weight: Column, pinned: Column) -> Column:
    """A document's own weight, kept in [0.5, 2]; a pinned one counts 1.3 at least."""
    w = weight.cast("double")
    own = F.when(w.isNull(), 1.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.5), w)))
    return F.when(F.coalesce(pinned, F.lit(False)), F.greatest(own, F.lit(1.3))).otherwise(own)


def chronicle_boost(path: Column, mode: str = "on") -> Column:
    bare = F.regexp_replace(path, "^page://", "")
    return F.when(bare.startswith("life/events/") | bare.startswith("life/diary/"), CHRONICLE[mode]).otherwise(1.0)


def compiled_truth(path: Column, detail: str = "low", soft: bool = False) -> Column:
    """Twice for a page's distilled text, where little detail is asked for; 1.2 times where that is only guessed."""
    factor = 2.0 if detail == "low" and not soft else 1.2 if soft else 1.0
    return F.when(path.startswith("page-truth://"), factor).otherwise(1.0)


def alias_boost(result: DataFrame, aliases: DataFrame) -> DataFrame:
    """x 1.05 for hits whose slug some alias stands for."""
    known = aliases.select("slug").distinct().withColumn("known", F.lit(True))
    return result.join(known, "slug", "left").withColumn("score", F.when(F.col("known"), F.col("score") * ALIAS).otherwise(F.col("score"))).drop("known")


def alias_hop(result: DataFrame, aliases: DataFrame, question: str, most: int = 3) -> DataFrame:
    """Pages that the question is an alias of: x 1.1 where they are hits already, else put above the best one, three at most.

    result: id, slug, score; aliases: alias (normalised), slug, id of the page's head. Adds `alias_hit`.
    """
    q = " ".join(question.lower().split())
    flagged = result.withColumn("alias_hit", F.lit(False))
    if not q or len(q.split(" ")) > 6:
        return flagged
    named = aliases.filter(normalized_alias(F.col("alias")) == q).select("slug", F.col("id").alias("head")).dropDuplicates(["slug"]).orderBy("slug").limit(most)
    out = flagged.join(F.broadcast(named), "slug", "left").withColumn("alias_hit", F.col("head").isNotNull()).drop("head")
    out = out.withColumn("score", F.when(F.col("alias_hit"), F.col("score") * ALIAS_PRESENT).otherwise(F.col("score")))
    top = result.agg(F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0)).alias("top"))
    missing = named.join(result.select("slug"), "slug", "left_anti").withColumn("n", F.row_number().over(Window.orderBy("slug")))  # three rows at most
    added = missing.join(F.broadcast(top)).select("slug", F.col("head").alias("id"), (F.when(F.col("top") > 0, F.col("top")).otherwise(1.0) + 1e-6 * F.col("n")).alias("score"), F.lit(True).alias("alias_hit"))
    return out.unionByName(added, allowMissingColumns=True)


def exact_lookup(result: DataFrame, question: str, page: str = "slug") -> DataFrame:
    """The hit that the question names put first, if it names hits of one page only."""
    hit = result.filter(is_exact(question, F.col("slug"), F.col("title")))
    one = hit.agg(F.count_distinct(page).alias("pages"), F.min(F.struct((-F.col("score")).alias("s"), "id"))["id"].alias("named"))
    both = result.join(F.broadcast(one)).join(F.broadcast(result.agg(F.max("score").alias("top"))))
    first = (F.col("pages") == 1) & (F.col("id") == F.col("named")) & (F.col("score") < F.col("top"))
    return both.withColumn("score", F.when(first, F.col("top") * (1 + 1e-6)).otherwise(F.col("score"))).drop("pages", "named", "top")


def feedback_order(result: DataFrame, weights: DataFrame, influence: float = 0.1) -> DataFrame:
    """result with `position`: its order by score, moved by learned weights (slug, weight; 0.5 is neutral); scores stay."""
    m = 1 + influence * 2 * (F.coalesce("weight", F.lit(0.5)) - 0.5)
    key = F.when(F.col("score") >= 0, F.col("score") * m).otherwise(F.col("score") / m)
    joined = result.join(weights.select("slug", "weight"), "slug", "left").withColumn("key", key)
    return joined.withColumn("position", F.row_number().over(Window.orderBy(F.desc("key"), *_order()))).drop("key", "weight")  # one query's hits


def graph_signals(result: DataFrame, links: DataFrame, top: int = 20, least: int = 2) -> DataFrame:
    """The `top` best hits: x 1.05 where `least` other hits link to one, x 1.1 where they come from `least` other sources; of hits
    of one session (column `session`), all but the best x 0.95. result: id, slug, source, session, score."""
    head = result.orderBy(*_order()).limit(top)
    ends = head.groupBy("slug").agg(F.min("source").alias("source"))
    inside = links.filter("source_slug <> target_slug").join(ends.select(F.col("slug").alias("source_slug"), F.col("source").alias("from")), "source_slug").join(ends.select(F.col("slug").alias("target_slug"), F.col("source").alias("to")), "target_slug")
    votes = inside.groupBy(F.col("target_slug").alias("slug")).agg(F.count_distinct("source_slug").alias("votes"), F.count_distinct(F.when(F.col("from") != F.col("to"), F.col("from"))).alias("sources"))
    marked = head.select("id", "slug", "session", "score").join(votes, "slug", "left")
    place = F.row_number().over(Window.partitionBy("session").orderBy(*_order()))
    best = F.row_number().over(Window.partitionBy("slug").orderBy(*_order())) == 1
    when = lambda c, f: F.when(c, f).otherwise(1.0)
    factor = when(best & (F.col("votes") >= least), ADJACENT) * when(best & (F.col("sources") >= least), CROSS_SOURCE) * when(F.col("session").isNotNull() & (place > 1), SESSION)
    factors = marked.select("id", factor.alias("factor"))
    return result.join(factors, "id", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def evidence(title: Column, keyword: Column, vector: Column, rank: Column, alias: Column | None = None, band: int = 3) -> Column:
    """Why a hit is one: alias, title, both arms among the first `band`, keyword, or meaning alone."""
    out = F.when(title, "exact_title_match").when(keyword & vector & (rank <= band), "high_vector_match").when(keyword, "keyword_exact").otherwise("weak_semantic")
    return out if alias is None else F.when(alias, "alias_hit").otherwise(out)


def safety(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SAFETY.items() for x in kv]), label)


def confidence(result: DataFrame, band: int = 3) -> DataFrame:
    """One row (grade, reason) from the evidence of the first hits (rank, evidence)."""
    head = result.filter(F.col("rank") <= band).agg(F.sort_array(F.collect_list(F.struct("rank", "evidence"))).alias("h"))
    first = F.get("h", 0)["evidence"]
    later = F.get(F.filter(F.slice("h", 2, band), lambda x: x["evidence"] != "weak_semantic"), 0)["evidence"]
    rows = [
        (first.isNull(), "weak", F.lit("no hits")), (first.isin(*STRONG), "strong", F.concat(F.lit("top hit: "), first)), (first == "keyword_exact", "moderate", F.lit("top hit: keyword_exact")),
        (later.isNotNull(), "moderate", F.concat(F.lit("top hit weak, head holds "), later)),
    ]
    grade, reason = F.lit("weak"), F.lit("head holds only weak_semantic hits")
    for when, g, r in reversed(rows):
        grade, reason = F.when(when, g).otherwise(grade), F.when(when, r).otherwise(reason)
    return head.select(grade.alias("grade"), reason.alias("reason"))


def trusted(tier: Column, least: str | None) -> Column:
    """Whether a tier is at least as trusted; external admits all."""
    if least in (None, "external"):
        return F.lit(True)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), tier)
    return F.coalesce(rank >= TRUST[least], F.lit(False))


def adaptive_return(result: DataFrame, intent: str, entity_most: int = 2, other_most: int = 6, keep: int = 1) -> DataFrame:
    """Two hits for questions with one answer, six for others."""
    most = entity_most if intent in ("factual", "exact") else other_most
    return result.orderBy(*_order()).limit(max(1, keep, most))


def broadened(result: DataFrame, wider: DataFrame) -> DataFrame:
    """The result, or the wider one where it is empty. Both are lazy: emptiness is a count beside the wider rows."""
    n = result.agg(F.count("*").alias("n"))
    return result.unionByName(wider.join(F.broadcast(n)).filter("n = 0").select(result.columns))


def starvation(result: DataFrame, corpus: DataFrame, wanted: int, probe: int = 1000) -> DataFrame:
    """One row: hits, eligible (counted up to `probe`), and whether a filter left fewer hits than it admits."""
    eligible = corpus.select(F.lit(1).alias("one")).limit(probe).agg(F.count("*").alias("eligible"))
    both = result.agg(F.count("*").alias("hits")).join(F.broadcast(eligible))
    return both.withColumn("starved", F.col("hits") < F.least(F.lit(wanted), F.col("eligible")))


def structural_expand(anchors: DataFrame, edges: DataFrame, hops: int = 2, per_hop: int = 50, most: int = 200) -> DataFrame:
    """Anchors (id, score) and what they reach over edges (a, b) in up to two hops, with score / (1 + hop): id, score, hop."""
    seen = front = anchors.select("id", "score", F.lit(0).alias("hop"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for hop in range(1, min(hops, 2) + 1):
        reached = front.join(both, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.max("score").alias("score"))
        new = reached.join(seen.select("id"), "id", "left_anti").orderBy(*_order()).limit(per_hop)
        front = new.select("id", "score", F.lit(hop).alias("hop"))
        seen = seen.unionByName(front)
    return seen.withColumn("score", F.col("score") / (1 + F.col("hop"))).orderBy(*_order()).limit(most)


def relational_recall(kind: str, direction: str, slug: str, links: DataFrame, most: int = 50) -> DataFrame:
    """Pages that a question about a relation asks for: live edges of the type into or out of a page; slug, written_at."""
    near, far = ("target_slug", "source_slug") if direction == "in" else ("source_slug", "target_slug")
    hits = links.filter((F.col("type") == kind) & (F.col(near) == slug) & F.col("valid_until").isNull())
    return hits.groupBy(F.col(far).alias("slug")).agg(F.max("written_at").alias("written_at")).orderBy(F.desc("written_at"), "slug").limit(most)


@dataclass(frozen=True)
class Mode:
    """What a search does beside fusing its arms."""

    limit: int
    fan: int
    relaxed: bool
    graph: bool
    rerank: bool
    budget: int


#: Bundles of switches by name.
MODES = {"conservative": Mode(5, 20, False, False, False, 4000), "balanced": Mode(10, 30, True, True, False, 8000), "tokenmax": Mode(20, 60, True, True, True, 32000)}


def explained(result: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], Column]]]) -> DataFrame:
    """The result after factor stages, with `explain`: each stage's factor by name."""
    for name, factor in stages:
        result = scaled(result, factor(result), name)
    return result
