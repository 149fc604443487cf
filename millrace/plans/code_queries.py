"""Code: symbols, chunks, calls and walks over source files that are derived from parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import code as K
from millrace.plans.registry import query
from millrace.plans.written import written
from millrace.sources.relations import Tables


def files(spark, d):
    """A file a brand, with a function for each of its parts, and a file a customer, with a function for each order that calls those of its
    parts; of one in three languages, by brand or customer. Strings and comments hold what isn't code."""
    t = Tables(spark, d)
    shape = lambda kind, py, ts, go: F.when(kind == 0, F.concat(*py)).when(kind == 1, F.concat(*ts)).otherwise(F.concat(*go))
    s = F.lit
    brand = F.regexp_extract("p_brand", "(\\d+)", 1).cast("int")
    name = F.concat(s("part_"), "p_partkey")
    part = shape(brand % 3, [s("def "), name, s("(x):\n    return '"), "p_name", s("({'  # def no(): {\n")], [s("export function "), name, s("(x: number) {\n  return `"), "p_name", s(" {`; // function no() {\n}\n")], [s("func "), name, s("(x int) string {\n\treturn \""), "p_name", s(" }\"\n}\n")])
    ext = lambda k: F.element_at(F.array(s("py"), s("ts"), s("go")), (k % 3 + 1).cast("int"))
    parts = t.part.withColumn("b", brand).groupBy("b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", part.alias("code")))), lambda x: x["code"]), "").alias("source")).select(F.concat(s("parts/brand_"), "b", s("."), ext(F.col("b"))).alias("path"), "source")
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("ps"))
    orders = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("ps", F.coalesce("ps", F.array().cast("array<bigint>")))
    call = lambda lead, end: F.array_join(F.transform("ps", lambda p: F.concat(s(lead), s("part_"), p.cast("string"), s(end))), "")
    name = F.concat(s("order_"), "o_orderkey")
    order = shape(F.col("o_custkey") % 3, [s("def "), name, s("():\n    pass\n"), call("    ", "(1)\n")], [s("function "), name, s("() {\n"), call("  ", "(1);\n"), s("}\n")], [s("func "), name, s("() {\n"), call("\t", "(1)\n"), s("}\n")])
    mine = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", order.alias("code")))), lambda x: x["code"]), "").alias("source"))
    return parts.unionByName(mine.select(F.concat(s("orders/customer_"), "o_custkey", s("."), ext(F.col("o_custkey"))).alias("path"), "source"))


EXT = "['py', 'ts', 'go'][{0} % 3 + 1]"
LANG = "['python', 'typescript', 'go'][{0} % 3 + 1]"
B = "CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER)"
SYMS = f"""sy AS (SELECT 'parts/brand_' || b || '.' || {EXT.format('b')} AS path, {LANG.format('b')} AS language, 'part_' || p_partkey AS symbol, p_partkey AS k, CASE b % 3 WHEN 0 THEN 2 ELSE 3 END AS n FROM (SELECT *, {B} AS b FROM part)
UNION ALL SELECT 'orders/customer_' || o_custkey || '.' || {EXT.format('o_custkey')}, {LANG.format('o_custkey')}, 'order_' || o_orderkey, o_orderkey, 2 + (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) FROM orders),
placed AS (SELECT path, language, symbol, n, CAST(sum(n) OVER (PARTITION BY path ORDER BY k) AS INTEGER) AS last FROM sy)"""
CALLS = f"""ca AS (SELECT DISTINCT 'orders/customer_' || o_custkey || '.' || {EXT.format('o_custkey')} || '::order_' || o_orderkey AS source, {LANG.format('o_custkey')} AS language, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
df AS (SELECT p_partkey, {LANG.format('b')} AS language, 'parts/brand_' || b || '.' || {EXT.format('b')} || '::part_' || p_partkey AS target FROM (SELECT *, {B} AS b FROM part)),
re AS (SELECT source, 'part_' || l_partkey AS callee, target FROM ca LEFT JOIN df ON df.p_partkey = l_partkey AND df.language = ca.language)"""


@query("code_symbols", f"WITH {SYMS} SELECT path, language, symbol, last - n + 1 AS start_line, last AS end_line FROM placed")
def _(spark, d):
    return K.symbols(files(spark, d)).select("path", "language", "symbol", "start_line", "end_line")


@query("code_chunks", f"WITH {SYMS} SELECT path, count(*) AS symbols, true AS whole FROM sy GROUP BY path")
def _(spark, d):
    """Chunks of each file: symbols that begin one, and whether the chunks make up the source."""
    f = files(spark, d)
    made = K.chunks(f, 1_000_000).groupBy("path").agg(F.count_distinct("symbol").alias("symbols"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "content"))), lambda x: x["content"]), "").alias("made"))
    return made.join(f, "path").select("path", "symbols", (F.col("made") == F.col("source")).alias("whole"))


def resolved(spark, d):
    def make(path):
        K.resolved(*K.lexed(files(spark, d))).write.parquet(path)

    return spark.read.parquet(written(spark, d, "calls", make))


@query("symbol_edge_resolution", f"WITH {CALLS} SELECT source, callee, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS state, target FROM re")
def _(spark, d):
    """A call is resolved where a file of its language defines the part."""
    return resolved(spark, d).select(K.symbol_id(F.col("path"), F.col("caller")).alias("source"), "callee", "state", "target")


def start(spark, d):
    """The function of part 5."""
    b = Tables(spark, d).part.filter("p_partkey = 5").select(F.regexp_extract("p_brand", "(\\d+)", 1).cast("int")).first()[0]
    return f"parts/brand_{b}.{['py', 'ts', 'go'][b % 3]}::part_5"


@query("code_callers_depth", f"WITH {CALLS}, s AS (SELECT target AS slug FROM df WHERE p_partkey = 5) SELECT slug, 0 AS depth, 1.0 AS confidence FROM s UNION SELECT source, 1, round(1 / 1.3, 9) FROM re JOIN s ON target = slug")
def _(spark, d):
    """Who calls part 5's function."""
    return K.walk(K.edges(resolved(spark, d)), [start(spark, d)], 2, "in").withColumn("confidence", F.round("confidence", 9))


@query("code_blast_radius", f"WITH {CALLS}, s AS (SELECT target AS slug FROM df WHERE p_partkey = 5), o AS (SELECT DISTINCT source AS slug FROM re JOIN s ON target = slug) SELECT slug, 0 AS depth FROM s UNION SELECT slug, 1 FROM o UNION SELECT target, 2 FROM re JOIN o ON source = slug WHERE target IS NOT NULL AND target NOT IN (SELECT slug FROM s)")
def _(spark, d):
    """Who calls part 5's function, and what those call beside it."""
    from millrace.operators.graph import traverse

    return traverse(K.edges(resolved(spark, d)), [start(spark, d)], 2, "both")
