"""Panels and time: monthly rollups, trailing windows, zone-month grids, features, labels, anomalies."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_key


def monthly_rollup(weekly: DataFrame) -> DataFrame:
    """month, events, fatalities, and the conditional sums of abductions (sub-type F) and violence against civilians (type R)."""
    when = lambda c: F.sum(F.when(c, F.col("events")).otherwise(0)).alias
    return weekly.groupBy(month_key("week").alias("month")).agg(F.sum("events").alias("events"), F.sum("fatalities").alias("fatalities"), when(F.col("sub_type") == "F")("abductions"), when(F.col("event_type") == "R")("vac_events"))


def trailing_burden(weekly: DataFrame, as_of: datetime.date | None = None, days: int = 365) -> DataFrame:
    """Per zone over the weeks from as_of - days on (inclusive): events, fatalities, abductions, vac_events, burden (3 * abductions + vac_events).

    as_of defaults to the last week. An abduction of type R counts in both terms, which is the index's definition.
    """
    if as_of is None:
        last = weekly.agg(F.date_sub(F.max("week"), days).alias("_from"))
        kept = weekly.join(F.broadcast(last), F.col("week") >= F.col("_from"))  # one row
    else:
        kept = weekly.where(F.col("week") >= F.date_sub(F.lit(as_of), days))
    when = lambda c: F.sum(F.when(c, F.col("events")).otherwise(0)).alias
    got = kept.groupBy("zone_id").agg(F.sum("events").alias("events"), F.sum("fatalities").alias("fatalities"), when(F.col("sub_type") == "F")("abductions"), when(F.col("event_type") == "R")("vac_events"))
    return got.withColumn("burden", 3 * F.col("abductions") + F.col("vac_events"))


def zone_months(weekly: DataFrame) -> DataFrame:
    """zone_id, month, events: only months that a zone reported."""
    return weekly.groupBy("zone_id", month_key("week").alias("month")).agg(F.sum("events").alias("events"))


def joined_panel(daily: DataFrame, weekly: DataFrame, first_weekly_month: str, last_weekly_month: str | None = None) -> DataFrame:
    """One panel from two sources: daily incidents before first_weekly_month, weekly aggregates from then on, so that no month counts twice."""
    old = daily.where("zone_id IS NOT NULL").groupBy("zone_id", month_key("incident_date").alias("month")).agg(F.count("*").alias("events")).where(F.col("month") < first_weekly_month)
    new = zone_months(weekly).where(F.col("month") >= first_weekly_month)
    if last_weekly_month:
        new = new.where(F.col("month") <= last_weekly_month)
    return old.unionByName(new).groupBy("zone_id", "month").agg(F.sum("events").alias("events"))


def filled_grid(panel: DataFrame) -> DataFrame:
    """Every zone in every observed month: zone_id, month, mi (number of the month), events (0 if not reported), present.

    Zones and months are dimensions; the panel is joined once. Sparse zones cost a row per month and no more.
    """
    months = panel.select("month").distinct().withColumn("mi", F.row_number().over(Window.orderBy("month")) - 1)
    grid = panel.select("zone_id").distinct().join(months)
    seen = panel.select("zone_id", "month", F.col("events").alias("_e"))
    return grid.join(seen, ["zone_id", "month"], "left").select("zone_id", "month", "mi", F.coalesce("_e", F.lit(0)).cast("long").alias("events"), F.col("_e").isNotNull().alias("present"))


def features(grid: DataFrame, horizon: int = 1) -> DataFrame:
    """Adds lag1, mean3, mean6, momentum, month_sin, month_cos, and target: events `horizon` observed months on, if both are present."""
    by = Window.partitionBy("zone_id").orderBy("mi")
    rows = lambda a, b: F.avg("events").over(by.rowsBetween(a, b))
    angle = F.lit(2.0) * F.pi() * F.substring("month", 6, 2).cast("int") / 12
    ahead = F.when(F.lead("present", horizon).over(by), F.lead("events", horizon).over(by))
    return grid.select(
        "*",
        F.coalesce(F.lag("events").over(by), "events").alias("lag1"),
        rows(-2, 0).alias("mean3"),
        rows(-5, 0).alias("mean6"),
        (rows(-2, 0) - F.coalesce(rows(-5, -3), F.lit(0.0))).alias("momentum"),
        F.sin(angle).alias("month_sin"),
        F.cos(angle).alias("month_cos"),
        F.when(F.col("present"), ahead).alias("target"),
    )


FEATURES = ("events", "lag1", "mean3", "mean6", "momentum", "month_sin", "month_cos")


def calendar_labels(panel: DataFrame, quantile: float = 0.75) -> DataFrame:
    """zone_id, month, next_events, threshold, elevated: events of the next calendar month against the quantile of all such."""
    after = panel.select("zone_id", F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -1), "yyyy-MM").alias("month"), F.col("events").alias("next_events"))
    labelled = panel.join(after, ["zone_id", "month"])
    bar = labelled.agg(F.percentile("next_events", quantile).alias("threshold"))
    return labelled.crossJoin(F.broadcast(bar)).select("zone_id", "month", "next_events", "threshold", (F.col("next_events") > F.col("threshold")).alias("elevated"))


def trailing_anomaly(series: DataFrame, value: str, months: int = 12, floor_sd: float = 0.6, last: int = 3) -> DataFrame:
    """month, value, baseline and z of the last rows against the rows before them. The series has a row per month, so one task orders it."""
    w = Window.orderBy("month").rowsBetween(-months, -1)
    z = (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_samp(value).over(w), F.lit(floor_sd))
    numbered = series.select("month", F.col(value), F.avg(value).over(w).alias("baseline"), z.alias("z"), F.row_number().over(Window.orderBy("month")).alias("_i"), F.row_number().over(Window.orderBy(F.desc("month"))).alias("_back"))
    return numbered.where((F.col("_i") > months) & (F.col("_back") <= last)).select("month", value, "baseline", "z", (F.col("z") >= 2).alias("flagged"))


def bucket_anomaly(zones: DataFrame, incidents: DataFrame, as_of: Column, days: int = 90, baselines: int = 5, floor_sd: float = 0.6, n: Column | None = None) -> DataFrame:
    """zone_id, current, baseline, z, flagged: incidents of the last `days` before as_of against the buckets before. n: how many incidents a row stands for, one by default.

    Buckets are [end - days, end), end itself excluded. Zones and buckets without incidents count 0. The variance is taken from
    sums over the fixed number of buckets, so no bucket needs to exist as a row.
    """
    age = F.datediff(as_of, F.col("incident_date"))
    bucket = F.ceil(age / F.lit(float(days))).cast("int") - 1
    counted = incidents.where(F.col("zone_id").isNotNull() & (age > 0) & (bucket <= baselines)).groupBy("zone_id", bucket.alias("b")).agg(F.sum(F.lit(1) if n is None else n).alias("n"))
    sums = counted.groupBy("zone_id").agg(F.sum(F.when(F.col("b") == 0, F.col("n")).otherwise(0)).alias("current"), F.sum(F.when(F.col("b") > 0, F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("b") > 0, F.col("n") * F.col("n")).otherwise(0)).alias("q"))
    joined = zones.select("zone_id").join(sums, "zone_id", "left").fillna(0, ["current", "s", "q"])
    mean = F.col("s") / F.lit(float(baselines))
    variance = F.greatest((F.col("q") - baselines * mean * mean) / (baselines - 1), F.lit(0.0))
    z = (F.col("current") - mean) / F.greatest(F.sqrt(variance), F.lit(floor_sd))
    return joined.select("zone_id", "current", mean.alias("baseline"), z.alias("z"), (z >= 2).alias("flagged"))


def daily_histogram(events: DataFrame, day: Column, as_of: Column, days: int = 45) -> DataFrame:
    """date, n for each of the last `days` days up to as_of, zeros included."""
    spark = events.sparkSession
    counts = events.groupBy(day.alias("date")).agg(F.count("*").alias("n"))
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(as_of, days - 1), as_of)).alias("date"))
    return calendar.join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def window_sums(daily: DataFrame, as_of: Column, value: str = "n") -> DataFrame:
    """One row: last7d, last30d, prev4w and weekly_baseline (prev4w / 4)."""
    older = lambda k: F.date_sub(as_of, k)
    d = F.col("date")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0))
    prev = total((d <= older(7)) & (d > older(35)))
    return daily.agg(total(d > older(7)).alias("last7d"), total(d > older(30)).alias("last30d"), prev.alias("prev4w"), (prev / F.lit(4.0)).alias("weekly_baseline"))
