"""Knowledge relations (links, pages, facts, timeline, takes, chunks) derived from the test tables.

The test tables hold none of these, so each is a deterministic view: orders and line items give typed links and
bitemporal facts, customers, parts, suppliers and nations give pages, events give a timeline and takes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Line items that a task joins with their orders.
LINES = 1 << 19


class Tables:
    """The tables of a folder, and the relations that they give."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Partitions for LINES line items each (counted from the files' footers), where that gives more than eight; else 0, which leaves the number to Spark."""
        n = -(-self.lineitem.count() // LINES)
        return n if n > 8 else 0

    @property
    def links(self) -> DataFrame:
        """Adaptive execution merges a join's partitions up to 64 MB, some six million rows sorted in one task; partitions by number stay as they are."""
        li = self.lineitem
        dealt = lambda df, key: df.repartition(self.parts, key) if self.parts else df
        bought = dealt(self.orders, "o_orderkey").join(dealt(li, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(
            slug("customer", "o_custkey").alias("source_slug"), slug("part", "l_partkey").alias("target_slug"), F.lit("bought").alias("type"), (1 - F.col("l_discount")).alias("confidence"),
            F.col("o_orderdate").alias("written_at"), F.col("o_orderdate").cast("date").alias("valid_from"), F.col("l_shipdate").cast("date").alias("valid_until"),
        )
        supplies = li.select(
            slug("supplier", "l_suppkey").alias("source_slug"), slug("part", "l_partkey").alias("target_slug"), F.lit("supplies").alias("type"), (1 - F.col("l_tax")).alias("confidence"),
            F.col("l_shipdate").alias("written_at"), F.col("l_shipdate").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"),
        )
        located = self.customer.select(
            slug("customer", "c_custkey").alias("source_slug"), slug("nation", "c_nationkey").alias("target_slug"), F.lit("located_at").alias("type"), F.lit(0.9).alias("confidence"),
            moment("1994-06-01").alias("written_at"), moment("1994-06-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"),
        )
        return bought.unionByName(supplies).unionByName(located)

    @property
    def vault(self) -> DataFrame:
        def part(df: DataFrame, kind: str, key: str, type_: str, title: Column, source: Column, days: Column, salience: Column, deleted: Column | None = None) -> DataFrame:
            gone = F.col(key) % 97 == 5 if deleted is None else deleted
            return df.select(slug(kind, key).alias("slug"), F.lit(type_).alias("type"), title.alias("title"), source.alias("source_id"), (moment("2000-01-01") + F.make_dt_interval(days.cast("int"))).alias("updated_at"), gone.alias("deleted"), salience.alias("salience"))

        balance = lambda c: (F.col(c) + 1000) / 11000
        people = part(self.customer, "customer", "c_custkey", "person", F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 1000, balance("c_acctbal"))
        firms = part(self.supplier, "supplier", "s_suppkey", "company", F.col("s_name"), F.lit("vault"), F.col("s_suppkey") % 500, balance("s_acctbal"))
        goods = part(self.part, "part", "p_partkey", "product", F.concat_ws(" ", "p_name", "p_partkey"), F.col("p_brand"), F.col("p_partkey") % 700, F.col("p_size") / 50.0)
        places = part(self.nation, "nation", "n_nationkey", "place", F.col("n_name"), F.lit("vault"), F.lit(0), F.lit(0.5), F.lit(False))
        return people.unionByName(firms).unionByName(goods).unionByName(places)

    @property
    def facts(self) -> DataFrame:
        kind = F.when(F.col("o_orderpriority") == "1-URGENT", "event").when(F.col("o_orderpriority") == "2-HIGH", "commitment").when(F.col("o_orderpriority") == "3-MEDIUM", "preference").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "belief").otherwise("fact")
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        gone = F.col("o_orderkey") % 11 == 0
        return self.orders.select(
            F.col("o_orderkey").alias("id"), slug("customer", "o_custkey").alias("entity_slug"), F.concat(F.lit("src"), F.col("o_orderkey") % 5).alias("source_id"),
            F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("fact"), kind.alias("kind"), (0.5 + (F.col("o_orderkey") % 50) / 100.0).alias("confidence"), F.lit("totalprice").alias("claim_metric"), F.col("o_totalprice").alias("claim_value"),
            F.col("o_orderdate").cast("date").alias("valid_from"), F.lead("o_orderdate").over(w).cast("date").alias("valid_until"), F.col("o_orderdate").alias("written_at"),
            F.when(gone, F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("forgotten_at"), F.when(gone, F.col("o_orderkey") + 1).alias("superseded_by"), F.col("o_orderstatus").alias("slot"),
        )

    @property
    def timeline(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("id"), slug("user", "user_id").alias("slug"), F.col("ts").alias("occurred_at"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))

    @property
    def takes(self) -> DataFrame:
        n = F.col("event_id")
        verdict = F.when(n % 5 == 0, "correct").when(n % 5 == 1, "incorrect").when(n % 5 == 2, "partial").when(n % 5 == 3, "unresolvable")
        return self.events.select(n.alias("take_key"), F.col("user_id").alias("holder"), F.col("event_type").alias("domain"), F.least(F.lit(1.0), F.col("value") / 200).alias("weight"), (n % 10 != 3).alias("active"), (n % 7).alias("source_ref"), F.col("ts").alias("written_at"), verdict.alias("verdict"))

    @property
    def chunks(self) -> DataFrame:
        lines = self.documents.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"), F.col("source").alias("source_id"), "lang")
        return lines.select("doc_id", "chunk_index", "content", "source_id", "lang")

    @property
    def cosines(self) -> DataFrame:
        """Cosine of every vector with vector 0."""
        from millrace.functions.vectors import cosine

        e = F.col("embedding").cast("array<double>")
        return self.embeddings.select(F.col("vec_id").alias("id"), "label", cosine(e, F.lit(self.query_vector)).alias("cos"))

    @property
    def query_vector(self) -> list[float]:
        return list(self.embeddings.filter("vec_id = 0").first().embedding)


def slug(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key))


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
