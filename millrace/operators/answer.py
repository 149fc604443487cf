"""A question against a vault, end to end: arms over a written index and vectors, fusion, stages in their order, selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ranking, search, stages
from millrace.operators.postings import Index

#: Fewer hits with all words than this bring in hits with some of them.
THIN = 5


@dataclass(frozen=True)
class Settings:
    """What a search does beside its arms; a None leaves a stage out."""

    fan: int = 60
    curate: bool = True
    recency_half_life: float | None = None
    salience: float | None = 0.15
    backlinks: float | None = 0.05
    title: bool = True
    exact: bool = True
    per_document: int | None = None
    per_source: int | None = None
    type_share: float | None = None
    budget: int | None = None


def words(question: str) -> list[str]:
    """A question's distinct words, as an index holds them."""
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", question.lower())))


def arms(index: Index, pages: DataFrame, question: str, vectors: DataFrame | None = None, query: Sequence[float] | None = None, fan: int = 60) -> list[DataFrame]:
    """The arms that a question has (id, rank, arm): keyword, with some of the words where few hits have all; identifier; phrase, of a
    quoted question; title; vector. All but the title arm and the vectors read the index alone."""
    order = [F.desc("score"), F.asc("id")]
    asked, out = words(question), []
    if asked:
        every = index.search_all(asked)
        out.append(ranking.arm(every, order, fan, "keyword"))
        if len(asked) > 1 and every.limit(THIN).count() < THIN:
            out.append(ranking.arm(index.search_any(asked), order, fan, "relaxed"))
        named = [w for x in search.identifiers(question) for w in words(x)]
        if named and set(named) != set(asked):
            out.append(ranking.arm(index.search_all(named), order, fan, "identifier"))
        quoted = question.strip()
        if len(quoted) > 2 and quoted[0] == quoted[-1] == '"':
            import regex

            out.append(ranking.arm(index.search_phrase(regex.findall(r"[\p{L}\p{N}]+", quoted.lower())), order, fan, "phrase"))
        titled = pages.join(search.title_match(pages, question), "slug").select("id", F.col("matched").alias("score"))
        out.append(ranking.arm(titled, order, fan, "title"))
    if vectors is not None and query is not None:
        out.append(ranking.arm(search.knn(vectors, query, fan), order, fan, "vector"))
    return out


def answer(index: Index, pages: DataFrame, question: str, n: int = 10, vectors: DataFrame | None = None, query: Sequence[float] | None = None, weights: dict[str, float] | None = None, links: DataFrame | None = None, aliases: DataFrame | None = None, now: Column | None = None, settings: Settings | None = None) -> DataFrame:
    """The n best pages for a question: id, slug, score, arms, explain (each stage's factor by its name).

    pages (id, slug, title, path, source, type, updated_at, salience, content) are joined to the fused hits once; then come, in this
    order and as far as the settings and tables allow: curation by path, recency, salience, backlinks, title, exact name, alias;
    caps per page and source, a type's share, the token budget. Every stage sees at most `fan` hits an arm.
    """
    s = settings or Settings()
    made = arms(index, pages, question, vectors, query, s.fan)
    if not made:
        return pages.limit(0).select("id", "slug", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("arms"), F.create_map().cast("map<string,double>").alias("explain"))
    hits = ranking.rrf(made, weights).join(pages, "id").withColumn("explain", F.create_map().cast("map<string,double>"))
    q = F.lit(question)
    factors: list[tuple[str, Column]] = []
    if s.curate:
        from millrace.functions.text import prefix_boost

        factors.append(("curation", prefix_boost(F.col("path"), ranking.CURATION)))
    if s.recency_half_life and now is not None:
        factors.append(("recency", ranking.recency_decay(F.greatest(F.lit(0), F.datediff(now, F.col("updated_at"))), s.recency_half_life)))
    if s.salience:
        factors.append(("salience", ranking.mattering(F.coalesce("salience", F.lit(0.0)), s.salience)))
    if s.backlinks and links is not None:
        from millrace.operators.graph import inbound

        mine = links.join(hits.select(F.col("slug").alias("target_slug")).distinct(), "target_slug", "left_semi")
        hits = hits.join(inbound(mine).select("slug", "referrers"), "slug", "left")
        factors.append(("backlinks", ranking.backlink_boost(F.coalesce("referrers", F.lit(0)), s.backlinks)))
    if s.title:
        factors.append(("title", stages.title_boost(q, F.coalesce("title", F.lit("")))))
    if s.exact:
        factors.append(("exact", stages.exact_boost(question, "entity", F.col("slug"), F.coalesce("title", F.lit("")))))
    for name, factor in factors:
        hits = stages.scaled(hits, factor, name)
    if aliases is not None:
        hits = stages.alias_boost(hits, aliases)
    for most, key in ((s.per_document, "slug"), (s.per_source, "source")):
        if most:
            hits = ranking.cap_per(hits, key, most)
    if s.type_share:
        hits = ranking.type_diversity(hits, share=s.type_share)
    if s.budget:
        hits = ranking.token_budget(hits, s.budget)
    return hits.orderBy(F.desc("score"), "id").limit(n).select("id", "slug", "score", "arms", "explain")
