"""Lexical and vector arms: postings, all-terms and any-term search, phrases, titles, nearest vectors, hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import jaccard, tokens, trigrams
from millrace.functions.vectors import cosine
from millrace.operators import ranking

#: Words that an any-term retry leaves out (fixed values).
STOPWORDS = (
    "the and for are but not was were with from this that these those there their they them then than what when where which who whom why how about into onto over also been being have has had does did its can "
    "will would should could you your our his her all any some der die das und den dem des ein eine einer eines einem einen mit von für auf ist sind nicht auch als wie wer aus bei nach über oder aber sich wir ihr "
    "sie zum zur dass noch nur war wird werden kann hat haben"
).split()


def identifiers(question: str) -> list[str]:
    """The words of a question that name one thing: addresses, issue numbers, long numbers, hashes, versions, words with digits."""
    import re

    out = []
    for word in re.findall(r"https?://[^\s<>\"`]+|[#\w.%+@/-]+", question):
        w = word.rstrip(".,;:!?)]}")
        named = re.match(r"https?://", w) or re.fullmatch(r"[\w.%+-]+@[\w.-]+\.\w{2,}", w) or re.fullmatch(r"#\d+|\d{6,}|[a-f\d]{7,}|v?\d+(\.\d+){2,}([-+][\w.-]+)?", w, re.IGNORECASE)
        if named or re.fullmatch(r"[^\W_][\w./-]*", w) and re.search(r"\d", w) and re.search(r"[^\W\d_]", w):
            out.append(w.lower())
    return list(dict.fromkeys(out))[:16]


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, id, tf): one row per term of a document; a corpus writes it once, partitioned or bucketed by term."""
    words = docs.select(F.col(doc_id).alias("id"), F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"))


#: Weights of title and body words (fixed values).
FIELD = {"title": 1.0, "body": 0.4}
BUCKETS = 64
#: Parts by id that the postings of a bucket are dealt into at least.
SLICES = 4
#: Queries that are multiplied with a block at a time.
STRIP = 64
#: Words that a task sorts at a time.
AT_ONCE = 1 << 19


def write_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", title: str | None = None, buckets: int = BUCKETS) -> None:
    """Postings of a corpus, written once: (term, id, field, tf, positions) in `buckets` folders by checksum of the term, files sorted by term.

    A search reads the folders of its terms, and of them the row groups that may hold a term; texts aren't read again.
    """
    post = document_postings(docs, doc_id, text, title)
    dealt(post.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % buckets).cast("int"))).write.partitionBy("bucket").parquet(path)


def document_postings(docs: DataFrame, doc_id: str, text: str, title: str | None) -> DataFrame:
    """(term, id, field, tf, positions) of texts and titles. Each task sorts the words of its own documents, so nothing is shuffled."""
    fields = [("body", text)] + ([("title", title)] if title else [])
    every = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).cast("string").alias("t")) for k, c in fields])
    words = docs.select(F.col(doc_id).cast("long").alias("id"), F.inline(every)).select("id", "field", tokens(F.col("t")).alias("t")).filter(F.size("t") > 0)
    return words.mapInArrow(_posted, "term string, id long, field string, tf long, positions array<int>")


def _posted(batches):
    import numpy as np

    for b in batches:
        bound, i = b.column(2).offsets.to_numpy(), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(bound, bound[i] + AT_ONCE, "right")) - 1)
            at, part = bound[i : j + 1] - bound[i], b.slice(i, j - i)
            coded = b.column(2).values.slice(bound[i], at[-1]).dictionary_encode()
            row, term = np.repeat(np.arange(j - i), np.diff(at)), coded.indices.to_numpy()
            order = np.lexsort((row, term))  # stable: places stay in order
            row, term, place = row[order], term[order], (np.arange(at[-1]) - at[:-1][row])[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])])
            stops, own = np.r_[first, len(row)].astype(np.int32), pa.array(row[first])
            lists = pa.ListArray.from_arrays(pa.array(stops), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[first])), part.column(0).take(own), part.column(1).take(own), pa.array(np.diff(stops).astype(np.int64)), lists], ["term", "id", "field", "tf", "positions"])
            i = j


def dealt(posts: DataFrame) -> DataFrame:
    """Postings dealt by bucket and slices of ids, each task's sorted. Adaptive execution joins small parts and splits large ones, so no
    task holds a bucket whole and texts aren't read a first time to find ranges."""
    sliced = posts.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)))
    return sliced.hint("rebalance", "bucket", "slice").sortWithinPartitions("bucket", "term", "id").drop("slice")


def read_index(spark, path: str, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of some terms: other buckets aren't read."""
    import zlib

    mine = sorted({zlib.crc32(t.encode()) % buckets for t in terms})
    schema = "term string, id long, field string, tf long, positions array<int>, bucket int"
    return spark.read.schema(schema).parquet(path).filter(F.col("bucket").isin(*mine) & F.col("term").isin(*terms))


def indexed_all(spark, path: str, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """As search_all, from an index: id, score (log-damped counts, title words by their weight)."""
    terms = list(dict.fromkeys(terms))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in FIELD.items() for x in kv]), F.col("field")) / FIELD["body"]
    got = read_index(spark, path, terms, buckets).groupBy("id").agg(F.count_distinct("term").alias("n"), F.sum(weight * F.log1p("tf")).alias("score"))
    return got.filter(F.col("n") == len(terms)).select("id", F.round("score", 9).alias("score"))


def indexed_any(spark, path: str, terms: Sequence[str], most: int = 16, buckets: int = BUCKETS) -> DataFrame:
    """As search_any, from an index."""
    kept = [t for t in dict.fromkeys(terms) if len(t) >= 3 and t not in STOPWORDS][:most]
    return read_index(spark, path, kept, buckets).groupBy("id").agg(F.count_distinct("term").cast("int").alias("score"))


def indexed_ranked(spark, path: str, terms: Sequence[str], n: int, buckets: int = BUCKETS) -> DataFrame:
    """As search_ranked, from an index: cover density of the terms' positions in bodies."""
    terms = list(dict.fromkeys(terms))
    k = F.array_position(F.lit(terms), F.col("term")).cast("int")
    hits = read_index(spark, path, terms, buckets).filter("field = 'body'").groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("i"), k.alias("k")))))).alias("hits"))
    return hits.filter(F.col("n") == len(terms)).select("id", F.round(covers(F.col("hits"), len(terms)), 9).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def covers(hits: Column, n: int) -> Column:
    """Sum of 1 / width over the shortest spans with all n terms, of hits (i, k: place and number of a term, from 1) by place."""

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, j: F.when(j == x["k"] - 1, x["i"]).otherwise(v))
        first = F.array_min(last)
        new = (first >= 0) & (first != s["first"])
        return F.struct(last.alias("last"), F.when(new, first).otherwise(s["first"]).alias("first"), (s["score"] + F.when(new, 1.0 / (x["i"] - first + 1)).otherwise(0.0)).alias("score"))

    zero = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("first"), F.lit(0.0).alias("score"))
    return F.aggregate(hits, zero, step)["score"]


def search_all(docs: DataFrame, terms: Sequence[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with every term: id, score (log-damped term counts). One scan, no shuffle."""
    t = tokens(F.col(text))
    counted = docs.select(F.col(doc_id).alias("id"), t.alias("t"))
    n = lambda term: F.size(F.filter("t", lambda x: x == term))
    score = sum((F.log1p(n(x)) for x in terms), F.lit(0.0))
    return counted.filter(F.forall(F.lit(list(terms)), lambda x: F.array_contains("t", x))).select("id", F.round(score, 9).alias("score"))


def cover_density(text: Column, terms: Sequence[str]) -> Column:
    """Sum of 1 / width over the shortest spans that hold every term, one for each place where such a span can begin."""
    wanted = F.lit(list(terms))
    places = F.transform(tokens(text), lambda w, i: F.struct(i.alias("i"), F.array_position(wanted, w).cast("int").alias("k")))
    return covers(F.filter(places, lambda x: x["k"] > 0), len(terms))


def search_ranked(docs: DataFrame, terms: Sequence[str], n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The n documents with every term in which the terms stand closest together: id, score."""
    found = docs.filter(F.forall(F.lit(list(terms)), lambda x: F.array_contains(tokens(F.col(text)), x)))
    return found.select(F.col(doc_id).alias("id"), F.round(cover_density(F.col(text), terms), 9).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def search_any(docs: DataFrame, terms: Sequence[str], doc_id: str = "doc_id", text: str = "text", most: int = 16) -> DataFrame:
    """Documents with some term of at least three letters that is no stop word: id, score (terms found)."""
    kept = [t for t in dict.fromkeys(terms) if len(t) >= 3 and t not in STOPWORDS][:most]
    found = docs.select(F.col(doc_id).alias("id"), F.size(F.array_intersect(tokens(F.col(text)), F.lit(kept))).alias("score"))
    return found.filter("score > 0")


def search_exact(docs: DataFrame, phrase: str, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with the phrase as it stands: id, position, a snippet of 400 characters from 100 before it."""
    at = F.instr(text, phrase)
    hits = docs.select(F.col(doc_id).alias("id"), at.alias("position"), F.col(text).alias("__t")).filter("position > 0")
    return hits.orderBy("id").limit(n).select("id", "position", F.substring("__t", F.greatest(F.lit(1), F.col("position") - 100), F.lit(400)).alias("snippet"))


def title_match(pages: DataFrame, question: str) -> DataFrame:
    """Pages whose normalised title is a run of the question's words of at least two words, or one long word: slug, matched."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in question.lower()).split()]
    runs = {" ".join(words[i:j]): j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if j - i >= 2 or len(words[i]) >= 8}
    title = F.array_join(tokens(F.col("title")), " ")
    return pages.filter(title.isin(*runs)).select("slug", F.size(tokens(F.col("title"))).alias("matched"))


def title_phrase(title: Column, question: Column) -> Column:
    """Whether the title's words are a run of the question's."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    return (F.size(tokens(title)) > 0) & F.contains(pad(question), pad(title))


def fuzzy(pages: DataFrame, text: str, threshold: float = 0.3, n: int = 5) -> DataFrame:
    """The pages whose title or slug is most like a text, by trigrams: slug, similarity."""
    q = trigrams(F.lit(text))
    sim = F.greatest(jaccard(trigrams(F.col("title")), q), jaccard(trigrams(F.col("slug")), q))
    return pages.select("slug", F.round(sim, 9).alias("similarity")).filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "slug").limit(n)


def knn(vectors: DataFrame, query: Sequence[float], n: int, row_id: str = "vec_id", vector: str = "embedding", factor: Column | None = None) -> DataFrame:
    """The n rows most like a vector by cosine (x factor): id, score. A scan with a top-n in each task; exact."""
    score = cosine(F.col(vector).cast("array<double>"), F.lit([float(x) for x in query]))
    score = score if factor is None else score * factor
    return vectors.select(F.col(row_id).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(n)


def knn_per_group(vectors: DataFrame, query: Sequence[float], n: int, group: str, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each group's best row, then the n best groups: group, id, score. Partial maxima first."""
    score = cosine(F.col(vector).cast("array<double>"), F.lit([float(x) for x in query]))
    best = vectors.groupBy(group).agg(F.max(F.struct(score.alias("score"), (-F.col(row_id)).alias("k"))).alias("b"))
    return best.select(group, (-F.col("b.k")).alias("id"), F.col("b.score").alias("score")).orderBy(F.desc("score"), "id").limit(n)


def knn_blocks(vectors: DataFrame, queries: DataFrame, n: int, row_id: str = "vec_id", vector: str = "embedding", block: int = 4096, same: str | None = None) -> DataFrame:
    """The n nearest rows of every query by cosine, exactly: query, id, score, rank; a query isn't its own neighbour. With `same`,
    only rows that have the query's value in that column count.

    Queries and rows are dealt into blocks of about `block`; each pair of blocks is one group, multiplied as matrices by
    strips of queries, which leaves n rows a query; a last ranking merges those. Work is queries x rows, memory two blocks and a strip. nearest_cells does
    less work, for most of the neighbours.
    """
    import numpy as np

    def blocks(df: DataFrame) -> int:
        return max(1, -(-df.count() // block))

    nq, nr = blocks(queries), blocks(vectors)
    key = F.xxhash64(same) if same else F.lit(0).cast("long")
    deal = lambda k: F.pmod(F.xxhash64(row_id), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = queries.select(F.col(row_id).alias("id"), F.col(vector).alias("e"), key.alias("k"), deal(nq).alias("qb"), every(nr).alias("rb"))
    r = vectors.select(F.col(row_id).alias("id"), F.col(vector).alias("e"), key.alias("k"), deal(nr).alias("rb"), every(nq).alias("qb"))

    def unit(x: pa.ChunkedArray) -> np.ndarray:
        m = x.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return m

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            right = right.sort_by("id")
            u, v, ids, keys, mine, own = unit(left["e"]), unit(right["e"]).T, *(t[c].to_numpy() for t in (right, left) for c in ("id", "k"))
            k = min(n + 1, len(ids))
            for i in range(0, len(u), STRIP):
                s = u[i : i + STRIP] @ v
                s[(mine[i : i + STRIP, None] == ids[None]) | (own[i : i + STRIP, None] != keys[None])] = -np.inf
                np.negative(s, out=s)
                top = np.argsort(s, axis=1, kind="stable")[:, :k]
                score = -np.take_along_axis(s, top, 1).ravel()
                out.append((np.repeat(mine[i : i + STRIP], k), ids[top].ravel(), score))
        q, r, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        real = np.isfinite(score)
        return pa.table({"query": q[real], "id": r[real], "score": score[real]})

    part = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(best, "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def centres(vectors: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 8, row_id: str = "vec_id", vector: str = "embedding") -> list[list[float]]:
    """Unit centres of cells of vectors, by spherical k-means over at most `sample` rows, those of least hash of their id."""
    import numpy as np

    rows = vectors.select(F.col(vector).alias("e")).orderBy(F.xxhash64(row_id), row_id).limit(sample).toArrow().column("e").to_pylist()
    if not rows:
        return []
    m = np.array(rows, float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    c = m[:: max(1, len(m) // cells)][:cells].copy()
    for _ in range(rounds):
        own = (m @ c.T).argmax(1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = m[own == i].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c.tolist()


def in_cells(vectors: DataFrame, cells: Sequence[Sequence[float]], near: int = 1, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, e, cell): every vector in the `near` cells whose centres are most like it. An index written once, by cell."""
    import numpy as np

    c = np.array(cells, np.float64).reshape(len(cells), -1) if len(cells) else np.zeros((0, 0))

    def run(batches):
        for b in batches:
            m = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            k = min(near, len(c))
            top = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :k] if len(c) and b.num_rows else np.zeros((b.num_rows, 0), int)
            at = np.repeat(np.arange(b.num_rows), top.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(top.ravel().astype(np.int32))], ["id", "e", "cell"])

    kind = vectors.schema[row_id].dataType.simpleString()
    return vectors.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("e")).mapInArrow(run, f"id {kind}, e array<double>, cell int")


def nearest_cells(index: DataFrame, queries: DataFrame, cells: Sequence[Sequence[float]], n: int, probe: int = 16, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The n nearest rows of each query among those of its `probe` nearest cells of an index (in_cells): query, id, score, rank.

    A search reads only the cells that its queries come to; a cell of very many rows is a skewed join key, which adaptive
    execution splits. Neighbours in other cells are missed: test_cells measures how few.
    """
    q = in_cells(queries, cells, probe, row_id, vector).select(F.col("id").alias("query"), F.col("e").alias("u"), "cell")
    hits = q.join(index, "cell").filter(F.col("query") != F.col("id")).select("query", "id", cosine("u", "e").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def hybrid(docs: DataFrame, vectors: DataFrame, terms: Sequence[str], query: Sequence[float], n: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Keyword and vector arms, fused by reciprocal rank, best n: id, score, arms. Documents and vectors share their ids."""
    fan = max(20, 3 * n)
    lexical = ranking.arm(search_any(docs, terms), [F.desc("score"), F.asc("id")], fan, "keyword")
    near = ranking.arm(knn(vectors, query, fan), [F.desc("score"), F.asc("id")], fan, "vector")
    return ranking.rrf([lexical, near], weights).orderBy(F.desc("score"), "id").limit(n)
