"""Measurements over events, items and usage: exact percentiles, gap sessions, step functions and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_index_percentiles(df: DataFrame, group: str, value: str, quantiles: dict[str, float], bins: int = 4096) -> DataFrame:
    """Exact percentiles of each group: the value at index ``min(n - 1, floor(q * n))`` of the ascending list.

    Values are counted in ``bins`` equal parts of their group's range, which are few rows; running counts over them
    name the bin that holds each index, and only the different values of those bins are ranked, with their counts. So a
    hot group or value is counted map-side and never sorted whole. Null values do not count; a group without values gives no row; NaN is the
    greatest value.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    edges = rows.groupBy(F.col("g").alias("e")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(1.0)
    binned = rows.join(edges, F.col("g").eqNullSafe(F.col("e"))).withColumn(
        "bin", F.least(F.lit(bins), F.greatest(F.lit(0), F.floor((F.col("v") - F.col("low")) / width))).cast("int")
    )
    counts = binned.groupBy("g", "bin", "n").agg(F.count("*").alias("c"))
    along = Window.partitionBy("g").orderBy("bin")
    counts = counts.withColumn("before", F.sum("c").over(along) - F.col("c"))
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))).alias("at")) for k, q in quantiles.items()])
    )
    holds = counts.select("g", "bin", "before", "c", wanted.alias("w")).where("w.at >= before AND w.at < before + c")
    holds = holds.select(F.col("g").alias("h"), F.col("bin").alias("b"), F.col("w.name").alias("name"), (F.col("w.at") - F.col("before") + 1).alias("nth"))
    inside = binned.join(holds, F.col("g").eqNullSafe(F.col("h")) & (F.col("bin") == F.col("b")))
    values = inside.groupBy("g", "bin", "name", "nth", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "bin", "name").orderBy("v"))
    reached = values.withColumn("upto", upto).where("nth <= upto AND nth > upto - c")
    found = reached.groupBy("g").pivot("name", list(quantiles)).agg(F.first("v"))
    return found.select(F.col("g").alias(group), *[F.col(k) for k in quantiles])


def gap_openers(df: DataFrame, key: str, at: str, order: str, seconds: int) -> DataFrame:
    """The rows that come more than ``seconds`` after the row before them with the same key, or first of it.

    Every row moves the gap on, also one that opens nothing. Rows with a null time are left out.
    """
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, order))
    rows = df.where(F.col(at).isNotNull()).withColumn("_before", before)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
    return rows.where(F.col("_before").isNull() | (gap > seconds * 1_000_000)).drop("_before")


def running_steps(deltas: DataFrame, at: str, delta: str, bucket: Column) -> DataFrame:
    """Running totals of deltas at each different time: ``(at, total)``.

    Deltas at one time are one step. Totals are taken over buckets of time first and then inside each bucket, so no
    task sums the whole line.
    """
    steps = deltas.groupBy(F.col(at).alias("at")).agg(F.sum(delta).alias("d")).withColumn("bucket", bucket)
    sums = steps.groupBy("bucket").agg(F.sum("d").alias("s"))
    before = sums.select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("base"))
    inside = F.sum("d").over(Window.partitionBy("bucket").orderBy("at"))
    return steps.withColumn("inside", inside).join(before, "bucket").select("at", (F.col("base") + F.col("inside")).alias("total"))


def running_sum(df: DataFrame, key: str | list[str], order: str, value: str, name: str, width: int = 100_000) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same key or keys up to each row, by the whole number ``order``.

    Each key is cut into ranges of ``order``; sums run inside the ranges and over the ranges' totals, so a hot key is
    spread over as many tasks as it has ranges.
    """
    keys = [key] if isinstance(key, str) else key
    rows = df.withColumn("_range", F.floor(F.col(order) / width))
    totals = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    along = Window.partitionBy(*keys).orderBy("_range")
    bases = totals.select(*keys, "_range", (F.sum("_sum").over(along) - F.col("_sum")).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_range").orderBy(order))
    return rows.withColumn(name, inside).join(bases, [*keys, "_range"]).withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_base")


def running_last(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 100_000) -> DataFrame:
    """``df`` with the last ``value`` that is not null over the rows of the same keys before each row, by the whole number
    ``order``; null if there is none. Rows of one place are before each other in no defined order.

    Each key is cut into ranges of ``order``, as in ``running_sum``: a hot key is spread over as many tasks as it has
    ranges.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / width))
    ends = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_range").agg(F.max_by(value, order).alias("_end"))
    every = rows.select(*keys, "_range").distinct().join(ends, [*keys, "_range"], "left")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = every.select(*keys, "_range", F.last("_end", ignorenulls=True).over(before).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn(name, F.last(value, ignorenulls=True).over(inside)).join(bases, [*keys, "_range"])
    return found.withColumn(name, F.coalesce(name, "_base")).drop("_range", "_base")


def latest(df: DataFrame, key: str, by: Column, *columns: str) -> DataFrame:
    """The values of the latest row of each key that is not null, column by column; a map-side maximum."""
    return df.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in columns])


def newest_of_each(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
