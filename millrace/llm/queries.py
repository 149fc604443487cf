"""The registered queries of this package: thin layers over its operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.stash import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import Target, mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, Target(entropy=0.98)).select("doc_id", "source", "mix_pass", "mix_block", "mix_key")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.media import as_media, read_back

    return read_back(as_media(table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.secrets import KINDS, listed, scan

    found = scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[n(k) for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.urlfilter import judge, rules_table, spam_list

    pages = table(spark, sf_dir, "pages")
    return judge(pages, rules_table(spark), blocked=spam_list(pages))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after each run of three digits or more is masked, by incremental edits."""
    from millrace.llm.secrets import located
    from millrace.llm.tokencount import apply_edits, token_trees

    number = "[0-9]{3,}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("found", F.regexp_extract_all("text", F.lit(number), F.lit(0)))
    mask = F.transform("at", lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("stop"), F.lit("<NUM>").alias("insert")))
    docs = docs.withColumn("at", located(F.col("text"), number, F.col("found"))).withColumn("edits", mask)
    done = apply_edits(token_trees(docs, edits="edits"))
    return done.select("doc_id", "n_edits", "n_before", "n_tokens", "n_encoded", (F.size("tokens") / 2).cast("long").alias("n_leaves"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import remainder, score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.langid import identify, train
    from millrace.llm.quality import remainder

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.filter(remainder(F.col("doc_id"), 4) != 2)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.pii import BASE, scan, train

    found = scan(table(spark, sf_dir, "documents"), train())
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), words=3, least=10, within=50, top=2000)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.simhash import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2, seed=42)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.divergence import divergences

    return divergences(table(spark, sf_dir, "documents"), least=3, top=200)


SQL: dict[str, str] = {}

SQL["op5_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS x
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS x
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.x = bw.x AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS c FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

SQL["op3_url_filter"] = r"""
WITH r(host, path, action) AS (VALUES ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','allow'), ('example.net','/de/8','block'), ('org','/es/','block')),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path, row_number() OVER () AS n FROM pages),
m AS (SELECT n, r.host || r.path AS rule, action, row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""

SQL["op1_mixture"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT)) AS tokens FROM documents),
s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
p AS (SELECT tokens / (SELECT sum(tokens) FROM s) AS p FROM s),
b(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN e >= 0.98 * ln(n) THEN (low + high) / 2 ELSE low END, CASE WHEN e >= 0.98 * ln(n) THEN high ELSE (low + high) / 2 END
  FROM (SELECT step, low, high, count(*) AS n,
               ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) AS e
        FROM b, p WHERE step < 50 GROUP BY step, low, high)),
one AS (SELECT ln(count(*)) AS top, -sum(p * ln(p)) AS e FROM p),
a AS (SELECT CASE WHEN (SELECT count(*) FROM p) < 2 OR (SELECT e >= 0.98 * top FROM one) THEN 1.0 ELSE (SELECT max(low) FROM b WHERE step = 50) END AS a),
w AS (SELECT source, tokens, pow(tokens / (SELECT sum(tokens) FROM s), (SELECT a FROM a)) AS x FROM s),
q AS (SELECT source, tokens, CAST(floor(x * (SELECT max(tokens / x) FROM w WHERE tokens = (SELECT max(tokens) FROM s)) + 0.5) AS BIGINT) AS budget FROM w),
r AS (SELECT source, budget // tokens AS passes, budget % tokens AS rest FROM q),
k AS (SELECT doc_id, d.source, tokens, passes, rest, md5('1:' || passes || ':' || doc_id) AS key FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
o AS (SELECT *, CAST(('0x' || substr(key, 1, 8)) AS BIGINT) % 1024 AS block FROM k),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY block, key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o),
n AS (SELECT doc_id, source, passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM u),
m AS (SELECT doc_id, source, unnest(range(0, n)) AS mix_pass FROM n)
SELECT doc_id, source, mix_pass, CAST(('0x' || substr(md5('1:' || mix_pass || ':' || doc_id), 1, 8)) AS BIGINT) % 1024 AS mix_block, md5('1:' || mix_pass || ':' || doc_id) AS mix_key FROM m
"""

SQL["op11_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS x FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, x, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, x, f AS a, string_split(x, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cut AS (SELECT lang, x, a, j, array_to_string(list_slice(w, 1, j), ' ') AS xl, array_to_string(list_slice(w, j + 1, k), ' ') AS xr, k FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
sc AS (SELECT cut.*, fl.f AS l, fr.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
       FROM cut JOIN f AS fl ON fl.lang = cut.lang AND fl.x = xl JOIN f AS fr ON fr.lang = cut.lang AND fr.x = xr),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY score, j) AS b FROM sc) WHERE b = 1),
inside AS (SELECT lang, y, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS y FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND y = x WHERE longer IS NULL OR 100 * longer < 50 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, x) AS rank FROM kept)
SELECT o.lang, rank, x AS phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""

SQL["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS n, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
k AS (SELECT n, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM k GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM k JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1) // (n + v) AS p
      FROM gn JOIN v ON v.lang = gn.lang JOIN kept ON kept.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(c) + 1) // (sum(sum(c)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
         FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
         UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM part)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""

QUERIES = {"op1_mixture": op1_mixture, "op2_near_duplicates": op2_near_duplicates, "op3_url_filter": op3_url_filter, "op4_media": op4_media, "op5_decontaminate": op5_decontaminate, "op6_secrets": op6_secrets, "op7_token_counts": op7_token_counts, "op8_quality": op8_quality, "op9_language": op9_language, "op10_pii": op10_pii, "op11_collocations": op11_collocations, "op12_simhash": op12_simhash, "op13_divergence": op13_divergence}
