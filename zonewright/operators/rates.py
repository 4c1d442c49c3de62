"""Rates per zone: counts with zeros, empirical Bayes, ranks. Zone tables are a dimension: their rows are places, not events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entity import checkpointed


def incident_days(incidents: DataFrame) -> DataFrame:
    """zone_id, incident_date, in_mv, in_ob, in_mort, n: how many incidents are alike in these; rows with a null are kept.

    Its rows are bounded by places, days and lists, not by incidents, so an analysis reads its incidents once and takes every count from here.
    """
    return incidents.groupBy("zone_id", "incident_date", "in_mv", "in_ob", "in_mort").agg(F.count("*").alias("n"))


def zero_filled_counts(zones: DataFrame, incidents: DataFrame, key: str = "zone_id", n: Column | None = None, **conditions: Column) -> DataFrame:
    """zones with `documented` and one count per condition; zones without incidents get 0. Incidents without zone count nowhere.

    Incidents are summed before the join, so what is shuffled is one row per zone and task. n: how many incidents a row stands for, one by default.
    """
    n = F.lit(1) if n is None else n
    sums = incidents.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(n).alias("documented"), *(F.sum(F.when(c, n)).alias(name) for name, c in conditions.items()))
    names = ["documented", *conditions]
    return zones.join(sums, key, "left").select(*zones.columns, *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in names))


def empirical_bayes(df: DataFrame, count: str = "documented", population: str = "population", by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Adds eb_rate, eb_sd, eb_lo, eb_hi per 100,000: posterior of a Gamma prior fitted by moments (variance of rates less Poisson noise).

    The totals are one row, so joining them is one broadcast of one row. The weighted variance needs only sums: of c, p
    and c * c / p. by: columns for each of whose values a prior of its own is fitted; there are as many rows of totals.
    """
    c, p = F.col(count), F.col(population)
    one = df.groupBy(*by).agg(F.sum(c).alias("_c"), F.sum(p).alias("_p"), F.sum(c * c / p).alias("_q"), F.count("*").alias("_n"))
    rate = F.col("_c") / F.col("_p")
    observed = F.col("_q") / F.col("_p") - rate * rate
    between = F.greatest(observed - rate * (F.col("_n") - 1) / F.col("_p"), F.lit(1e-12))
    one = one.select(*by, rate.alias("_r"), F.least(rate * rate / between, F.lit(1e6)).alias("_a"))
    joined = df.join(one, list(by)) if by else df.crossJoin(F.broadcast(one))
    b = F.col("_a") / F.col("_r")
    mean, sd = (c + F.col("_a")) / (p + b), F.sqrt(c + F.col("_a")) / (p + b)
    scale = F.lit(1e5)
    return joined.select(*df.columns, (mean * scale).alias("eb_rate"), (sd * scale).alias("eb_sd"), F.greatest(F.lit(0.0), (mean - 1.96 * sd) * scale).alias("eb_lo"), ((mean + 1.96 * sd) * scale).alias("eb_hi"))


def midrank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the mid-rank percentile: (values below + (equal values - 1) / 2) / (n - 1); 0.5 for one row.

    Counted over distinct values, so equal rows do not meet in one task. The distinct values are ordered by one task: it is for
    tables of places (see sums_below for values of events).
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_e"))
    running = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below, n = F.sum("_e").over(running) - F.col("_e"), F.sum("_e").over(whole)
    place = F.when(n <= 1, F.lit(0.5)).otherwise((below + (F.col("_e") - 1) / F.lit(2.0)) / (n - 1))
    return df.join(counts.select("_v", place.alias(out)), F.col(value).eqNullSafe(F.col("_v")), "left").drop("_v")


def midranks(df: DataFrame, value: str, out: str, by: str) -> DataFrame:
    """by, value, out: the mid-rank percentile of each value among the rows of its `by`; one task orders the distinct values of one `by`."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("_e"))
    order, whole = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(by)
    n = F.sum("_e").over(whole)
    place = F.when(n <= 1, F.lit(0.5)).otherwise((F.coalesce(F.sum("_e").over(order), F.lit(0)) + (F.col("_e") - 1) / F.lit(2.0)) / (n - 1))
    return counts.select(by, value, place.alias(out))


def sums_below(counts: DataFrame, value: str, n: str, out: str) -> DataFrame:
    """counts (a row per value) with `out`: the sum of n over all smaller values.

    Values are dealt to tasks in ranges, each task sums its own in order, and the sums of the ranges before are added: as many
    rows as there are ranges are the only ones that meet in one task.
    """
    dealt = checkpointed(counts.repartitionByRange(F.col(value)).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.sum(n).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(ranges), "_range")  # a row per range
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("_range", "_before")


def per_100k(count: Column, population: Column) -> Column:
    return count / (population / F.lit(1e5))


def supported_centroid(zones: DataFrame, points: DataFrame, key: str = "zone_id", least: int = 2, default: tuple[float, float] = (-0.5, 37.5)) -> DataFrame:
    """zone, n, lat, lng: the mean of a zone's points if there are `least`, else the default place."""
    mean = points.groupBy(key).agg(F.count("*").alias("n"), F.avg("lat").alias("_lat"), F.avg("lng").alias("_lng"))
    joined = zones.select(key).join(mean, key, "left")
    enough = F.coalesce(F.col("n") >= least, F.lit(False))
    return joined.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(enough, F.col("_lat")).otherwise(default[0]).alias("lat"), F.when(enough, F.col("_lng")).otherwise(default[1]).alias("lng"))
