"""Filters, joins, latest-per-key, paging and report shapes over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(df: DataFrame, sources: Sequence[str] | None, column: str = "source_id") -> DataFrame:
    """None: no filter; an empty list matches nothing; else membership."""
    if sources is None:
        return df
    return df.filter(F.col(column).isin(*sources) if sources else F.lit(False))


def page_filter(pages: DataFrame, types: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
    if types is not None:
        pages = pages.filter(F.col("type").isin(*types) if types else F.lit(False))
    return pages.filter(F.col("slug").startswith(prefix)) if prefix else pages


def between_dates(df: DataFrame, column: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Since inclusive; a plain date as `until` holds to its last millisecond."""
    if since:
        df = df.filter(F.col(column) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        df = df.filter(F.col(column) < F.lit(until).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return df


def link_state(as_of: str) -> Column:
    """active, expired or future on a date; validity is half-open."""
    day = F.lit(as_of).cast("date")
    return F.when(F.col("valid_from") > day, "future").when(F.col("valid_until") <= day, "expired").otherwise("active")


def live_links(links: DataFrame, hidden: DataFrame) -> DataFrame:
    """Links neither end of which is hidden (slug)."""
    out = links
    for end in ("source_slug", "target_slug"):
        out = out.join(hidden.select(F.col("slug").alias(end)), end, "left_anti")
    return out


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first by `order` (which must end in a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def latest_by_max(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As latest_per_key for descending `order` columns, by a max of structs: partial sums first, no sort, no hot key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__b"))
    return best.select(*keys, "__b.*")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def page_after(df: DataFrame, sort: str, key: str, last: tuple | None, n: int) -> tuple[DataFrame, DataFrame]:
    """(next n rows by sort descending, key ascending after the last (sort, key); one-row frame with `more`)."""
    if last is not None:
        df = df.filter((F.col(sort) < F.lit(last[0])) | ((F.col(sort) == F.lit(last[0])) & (F.col(key) > F.lit(last[1]))))
    ahead = df.orderBy(F.desc(sort), F.asc(key)).limit(n + 1)
    return ahead.limit(n), ahead.agg((F.count("*") > n).alias("more"))


def with_total(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows, each with the number of all rows; the count is one aggregation, not a window over everything."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(n).join(F.broadcast(total))


def overlapping(df: DataFrame, keys: Sequence[str], row_id: str, value: str, since: str = "valid_from", until: str = "valid_until") -> DataFrame:
    """Pairs (a, b) of rows with null-safe equal keys, different values and overlapping half-open ranges, a < b."""
    cols = [*keys, row_id, value, since, until]
    left = df.select(*[F.col(c).alias(f"l_{c}") for c in cols])
    right = df.select(*[F.col(c).alias(f"r_{c}") for c in cols])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
    on = on & (F.col(f"l_{row_id}") < F.col(f"r_{row_id}")) & (F.col(f"l_{value}") != F.col(f"r_{value}"))
    starts_before = lambda a, b: F.col(f"{a}_{since}").isNull() | F.col(f"{b}_{until}").isNull() | (F.col(f"{a}_{since}") < F.col(f"{b}_{until}"))
    return left.join(right, on & starts_before("l", "r") & starts_before("r", "l")).select(F.col(f"l_{row_id}").alias("a"), F.col(f"r_{row_id}").alias("b"))


def as_of(df: DataFrame, keys: Sequence[str], day: str, since: str = "valid_from", until: str = "valid_until", tie: str = "id") -> DataFrame:
    """The newest row of each key whose [since, until) holds the day."""
    d = F.lit(day).cast("date")
    held = df.filter((F.col(since).isNull() | (F.col(since) <= d)) & (F.col(until).isNull() | (F.col(until) > d)))
    return latest_per_key(held, keys, [F.desc_nulls_last(since), F.desc(tie)])


def known_as_of(df: DataFrame, moment: str, written: str = "written_at", forgotten: str = "forgotten_at") -> DataFrame:
    """Rows that had been written and not yet withdrawn at a moment."""
    t = F.lit(moment).cast("timestamp_ntz")
    return df.filter((F.col(written) <= t) & (F.col(forgotten).isNull() | (F.col(forgotten) > t)))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """points joined with ranges [low, high] that hold them, by bins of `width`: an equi-join, not a nested loop."""
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, ["__bin", *keys]).filter(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def top_and_other(df: DataFrame, group: str, value: str, n: int, other: str = "__other") -> DataFrame:
    """Sums of value by group for the n largest groups, and one row for the rest."""
    sums = df.groupBy(group).agg(F.sum(value).alias(value))
    top = sums.orderBy(F.desc(value), F.asc_nulls_first(group)).limit(n).select(F.col(group).alias("__g"), F.lit(True).alias("__top"))
    marked = sums.join(F.broadcast(top), F.col(group).eqNullSafe(F.col("__g")), "left")  # n rows
    return marked.groupBy(F.when(F.col("__top"), F.col(group)).otherwise(other).alias(group)).agg(F.sum(value).alias(value))


def day_series(df: DataFrame, ts: str, first: str, last: str, aggs: dict[str, Column]) -> DataFrame:
    """One row per UTC day of [first, last], aggregates by day, 0 where nothing happened."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    sums = df.groupBy(F.col(ts).cast("date").alias("day")).agg(*[c.alias(k) for k, c in aggs.items()])
    return days.join(sums, "day", "left").fillna(0, list(aggs))


def two_windows(df: DataFrame, ts: str, now: str, days: int, value: Column, name: str) -> DataFrame:
    """Totals of the last `days` days before `now`, and of the as many before those, in one pass."""
    end = F.lit(now).cast("timestamp_ntz")
    back = lambda n: end - F.expr(f"interval {n} days")
    here = (F.col(ts) >= back(days)) & (F.col(ts) < end)
    before = (F.col(ts) >= back(2 * days)) & (F.col(ts) < back(days))
    return df.agg(F.sum(F.when(here, value)).alias(f"{name}_now"), F.sum(F.when(before, value)).alias(f"{name}_before"))


def census(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Counts by value, 0 for known values that are missing; `known` says whether a value is one."""
    spark = df.sparkSession
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    list_ = spark.createDataFrame([(k,) for k in known], f"{column} string").withColumn("known", F.lit(True))
    return counts.join(list_, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("known", F.lit(False)).alias("known"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, since: str) -> DataFrame:
    """Stints of equal neighbouring values: keys, value, first and last `since`, rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = df.withColumn("__new", new).withColumn("stint", F.sum("__new").over(w))
    return runs.groupBy(*keys, "stint", value).agg(F.min(since).alias("first"), F.max(since).alias("last"), F.count("*").alias("n"))


def unpaired(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """Change set of two listings: added, removed or changed keys."""
    l, r = a.select(key, F.col(digest).alias("was")), b.select(key, F.col(digest).alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return l.join(r, key, "full_outer").select(key, state.alias("change")).filter("change is not null")
