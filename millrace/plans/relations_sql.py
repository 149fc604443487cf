"""DuckDB definitions of the relations of millrace.sources.relations."""

RELATIONS = {
    "links": """
SELECT 'customer/' || o_custkey AS source_slug, 'part/' || l_partkey AS target_slug, 'bought' AS type, 1 - l_discount AS confidence,
       o_orderdate AS written_at, CAST(o_orderdate AS DATE) AS valid_from, CAST(l_shipdate AS DATE) AS valid_until
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'supplier/' || l_suppkey, 'part/' || l_partkey, 'supplies', 1 - l_tax, l_shipdate, CAST(l_shipdate AS DATE), NULL FROM lineitem
UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'located_at', 0.9, TIMESTAMP '1994-06-01', DATE '1994-06-01', NULL FROM customer""",
    "vault": """
SELECT 'customer/' || c_custkey AS slug, 'person' AS type, c_name AS title, c_mktsegment AS source_id,
       TIMESTAMP '2000-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS updated_at, c_custkey % 97 = 5 AS deleted, (c_acctbal + 1000) / 11000 AS salience FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey, 'company', s_name, 'vault', TIMESTAMP '2000-01-01' + to_days(CAST(s_suppkey % 500 AS INTEGER)), s_suppkey % 97 = 5, (s_acctbal + 1000) / 11000 FROM supplier
UNION ALL SELECT 'part/' || p_partkey, 'product', p_name || ' ' || p_partkey, p_brand, TIMESTAMP '2000-01-01' + to_days(CAST(p_partkey % 700 AS INTEGER)), p_partkey % 97 = 5, p_size / 50.0 FROM part
UNION ALL SELECT 'nation/' || n_nationkey, 'place', n_name, 'vault', TIMESTAMP '2000-01-01', false, 0.5 FROM nation""",
    "facts": """
SELECT o_orderkey AS id, 'customer/' || o_custkey AS entity_slug, 'src' || (o_orderkey % 5) AS source_id, o_orderstatus || ' ' || o_orderpriority AS fact,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'event' WHEN '2-HIGH' THEN 'commitment' WHEN '3-MEDIUM' THEN 'preference' WHEN '4-NOT SPECIFIED' THEN 'belief' ELSE 'fact' END AS kind,
       0.5 + (o_orderkey % 50) / 100.0 AS confidence, 'totalprice' AS claim_metric, o_totalprice AS claim_value,
       CAST(o_orderdate AS DATE) AS valid_from, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS valid_until,
       o_orderdate AS written_at, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS forgotten_at,
       CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 END AS superseded_by, o_orderstatus AS slot FROM orders""",
    "timeline": "SELECT event_id AS id, 'user/' || user_id AS slug, ts AS occurred_at, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "takes": """
SELECT event_id AS take_key, user_id AS holder, event_type AS domain, least(1.0, value / 200) AS weight, event_id % 10 <> 3 AS active, event_id % 7 AS source_ref, ts AS written_at,
       CASE event_id % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'partial' WHEN 3 THEN 'unresolvable' END AS verdict FROM events""",
    "chunks": """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, l[i + 1] AS content, source AS source_id, lang FROM
 (SELECT doc_id, source, lang, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""",
    "cosines": """
SELECT b.vec_id AS id, b.label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cos FROM embeddings a, embeddings b WHERE a.vec_id = 0""",
}
