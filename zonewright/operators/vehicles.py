"""Sighting patterns: the best forward window per vehicle, with and without a radius, and incidents near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_km, half_up


def best_windows(sightings: DataFrame, days: int) -> DataFrame:
    """Per vehicle: n (most sightings within `days` from one of them), start (the first such), zones, last_seen, total.

    One range window over each vehicle's own rows, no self-join.
    """
    ahead = Window.partitionBy("vehicle_key").orderBy(F.unix_micros("sighted_at")).rangeBetween(0, days * 86_400_000_000)
    counted = sightings.select("*", F.count("*").over(ahead).alias("_n"))
    first = F.max_by(F.struct("_n", "sighted_at"), F.struct(F.col("_n"), -F.unix_micros("sighted_at"), -F.col("sighting_id")))
    got = counted.groupBy("vehicle_key").agg(first.alias("best"), F.sort_array(F.collect_set("zone_id")).alias("zones"), F.max("sighted_at").alias("last_seen"), F.count("*").alias("total"))
    return got.select("vehicle_key", F.col("best._n").alias("n"), F.col("best.sighted_at").alias("start"), "zones", "last_seen", "total")


def incident_overlap(windows: DataFrame, incidents: DataFrame, days: int, lead_days: int) -> DataFrame:
    """Adds overlap: incidents in the window's zones from lead_days before its start to lead_days after its end.

    windows need an id made of vehicle_key and start. Incidents are counted per zone and day first, then met by zone and by
    the time bucket that holds their day, so a busy zone is not joined with all of time.
    """
    span = days + 2 * lead_days
    daily = incidents.where("zone_id IS NOT NULL").groupBy("zone_id", F.col("incident_date").alias("day")).agg(F.count("*").alias("_c"))
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(span))
    daily = daily.withColumn("_b", bucket(F.col("day")))
    low = F.date_sub(F.to_date("start"), lead_days + 1)
    open_ = windows.select("vehicle_key", "start", F.explode("zones").alias("zone_id"))
    open_ = open_.select("*", F.explode(F.sequence(bucket(low), bucket(F.date_add(low, span + 2)))).alias("_b"))
    at = F.unix_seconds(F.col("day").cast("timestamp"))
    begin = F.unix_seconds("start")
    inside = (at >= begin - lead_days * 86400) & (at <= begin + (days + lead_days) * 86400)
    sums = open_.join(daily, ["zone_id", "_b"]).where(inside).groupBy("vehicle_key", "start").agg(F.sum("_c").alias("overlap"))
    return windows.join(sums, ["vehicle_key", "start"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)).cast("long"))


def vehicle_patterns(sightings: DataFrame, incidents: DataFrame, days: int = 30, lead_days: int = 30, threshold: int = 4, sources: Column | None = None) -> DataFrame:
    """Documented-pattern rule: flagged if enough sightings fall in one window and incidents overlap, else monitoring."""
    return window_patterns(best_windows(sightings, days), incidents, days, lead_days, threshold, sources)


def window_patterns(windows: DataFrame, incidents: DataFrame, days: int = 30, lead_days: int = 30, threshold: int = 4, sources: Column | None = None) -> DataFrame:
    """The same rule over best_windows."""
    got = incident_overlap(windows, incidents, days, lead_days)
    n, o = F.col("n"), F.col("overlap")
    sure = F.least(F.lit(0.85), F.lit(0.4) + 0.08 * F.least(n, F.lit(6)) + 0.08 * F.least(o, F.lit(3)) + 0.05 * (sources if sources is not None else F.lit(0)))
    status = F.when((n >= threshold) & (o >= 1), "flagged").otherwise("monitoring")
    return got.select("*", status.alias("status"), half_up(sure, 2).alias("confidence"))


def radius_windows(sightings: DataFrame, zones: DataFrame, days: int, radius_km: float) -> DataFrame:
    """Per sighting as anchor: members (sightings of the vehicle within `days` from it whose zone lies within the radius) and their zones.

    Sightings meet others of their vehicle in their own or the following time bucket only.
    """
    span = days * 86_400_000_000
    place = zones.select("zone_id", "lat", "lng")
    s = sightings.select("vehicle_key", "sighting_id", "sighted_at", "zone_id", F.unix_micros("sighted_at").alias("us")).join(place, "zone_id", "left").withColumn("b", F.floor(F.col("us") / F.lit(span)))
    a = s.select("vehicle_key", F.col("sighting_id").alias("anchor"), F.col("sighted_at").alias("start"), F.col("us").alias("us_a"), F.col("zone_id").alias("zone_a"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    near = F.coalesce(haversine_km(F.col("lat_a"), F.col("lng_a"), F.col("lat"), F.col("lng")) <= radius_km, F.col("lat_a").isNull())
    inside = (F.col("us") >= F.col("us_a")) & (F.col("us") <= F.col("us_a") + span) & ((F.col("zone_id") == F.col("zone_a")) | near)
    return a.join(s, ["vehicle_key", "b"]).where(inside).groupBy("vehicle_key", "anchor", "start").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("zone_id")).alias("zones"))


def vehicle_patterns_radius(sightings: DataFrame, incidents: DataFrame, zones: DataFrame, days: int = 30, lead_days: int = 30, radius_km: float = 25.0, threshold: int = 4) -> DataFrame:
    """Radius rule: the anchor with most members, then most overlap, then the earliest; cleared, monitoring or flagged."""
    anchors = radius_windows(sightings, zones, days, radius_km)
    per_anchor = anchors.select(F.struct("vehicle_key", "anchor").alias("vehicle_key"), "start", "zones", "n")
    scored = incident_overlap(per_anchor, incidents, days, lead_days).select("vehicle_key.*", "start", "zones", "n", "overlap")
    best = F.max_by(F.struct("n", "start", "zones", "overlap"), F.struct(F.col("n"), F.col("overlap"), -F.unix_micros("start"), -F.col("anchor")))
    got = scored.groupBy("vehicle_key").agg(best.alias("w")).select("vehicle_key", "w.*")
    n, o = F.col("n"), F.col("overlap")
    status = F.when(n < threshold, "cleared").when(o >= 1, "flagged").otherwise("monitoring")
    sure = F.least(F.lit(0.95), F.lit(0.5) + 0.07 * F.greatest(n - threshold, F.lit(0)) + 0.09 * F.least(o, F.lit(3)))
    return got.select("*", status.alias("status"), F.when(n < threshold, F.least(F.lit(0.4), sure)).otherwise(half_up(sure, 2)).alias("confidence"))
