"""The engine's inputs from the star-schema tables: zones, incidents, weekly aggregates, sightings, points, polygons, records, headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_tags


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def zone_grid(nation: DataFrame) -> DataFrame:
    """A zone per nation on a grid of 0.85 degrees."""
    key = F.col("n_nationkey")
    return nation.select(key.alias("zone_id"), F.col("n_name").alias("zone_name"), F.col("n_regionkey").alias("region_id"), (F.lit(-4.0) + F.lit(0.85) * (key % 5)).alias("lat"), (F.lit(34.0) + F.lit(0.85) * F.floor(key / F.lit(5.0))).alias("lng"))


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """zone_id, zone_name, region_name, population, lat, lng. Customers are summed before the join."""
    people = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))
    joined = zone_grid(table(spark, folder, "nation")).join(region, "region_id").join(people, F.col("zone_id") == F.col("c_nationkey"), "left")
    return joined.select("zone_id", "zone_name", "region_name", (F.lit(10000) * (F.lit(1) + F.coalesce("n", F.lit(0)))).cast("long").alias("population"), "lat", "lng")


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """incident_id, incident_date, zone_id (null for one in twenty), in_mv, in_ob, in_mort: orders that at least one list has."""
    o = table(spark, folder, "orders")
    mv, ob, mort = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") == "F", F.col("o_orderkey") % 7 == 0
    o = o.where(mv | ob | mort).select(F.col("o_orderkey").alias("incident_id"), F.col("o_orderdate").cast("date").alias("incident_date"), "o_custkey", mv.alias("in_mv"), ob.alias("in_ob"), mort.alias("in_mort"))
    where = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    located = F.when(F.col("incident_id") % 20 != 0, F.col("c_nationkey"))
    return o.join(where, "o_custkey").select("incident_id", "incident_date", located.alias("zone_id"), "in_mv", "in_ob", "in_mort")


def recent_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """The located incidents, moved to the weeks of the sightings."""
    moved = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("incident_id") % 45).cast("int"))
    return incidents(spark, folder).where("zone_id IS NOT NULL").select("incident_id", moved.alias("incident_date"), "zone_id")


def weekly(spark: SparkSession, folder: str) -> DataFrame:
    """week, zone_id, event_type, sub_type, events, fatalities. Sub-type F stands for abductions, type R for violence against civilians."""
    line = table(spark, folder, "lineitem").groupBy(F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).cast("date").alias("week"), "l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("f"))
    where = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone_id"))
    return line.join(where, "l_suppkey").groupBy("week", "zone_id", F.col("l_returnflag").alias("event_type"), F.col("l_linestatus").alias("sub_type")).agg(F.sum("n").alias("events"), F.sum("f").cast("long").alias("fatalities"))


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where(F.col("event_type").isin("view", "click"))
    return e.select(F.col("event_id").alias("sighting_id"), F.col("ts").cast("timestamp").alias("sighted_at"), F.col("user_id").alias("vehicle_key"), (F.col("event_id") % 25).cast("int").alias("zone_id"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Points spread beyond the grid, so that some match no zone."""
    k = F.col("event_id")
    return table(spark, folder, "events").select(k.alias("point_id"), (F.lit(33.2) + k * 37 % 500 / F.lit(100.0)).alias("lng"), (F.lit(-4.8) + k * 91 % 450 / F.lit(100.0)).alias("lat"))


def zone_edges(spark: SparkSession, folder: str) -> DataFrame:
    """A square ring of four edges around each zone: zone_id, ring, seq, x1, y1, x2, y2."""
    corners = ((1, -1, -1, 1, -1), (2, 1, -1, 1, 1), (3, 1, 1, -1, 1), (4, -1, 1, -1, -1))
    half = F.lit(0.4)
    edges = F.array(*(F.struct(F.lit(0).alias("ring"), F.lit(s).alias("seq"), (F.col("lng") + half * ax).alias("x1"), (F.col("lat") + half * ay).alias("y1"), (F.col("lng") + half * bx).alias("x2"), (F.col("lat") + half * by).alias("y2")) for s, ax, ay, bx, by in corners))
    return zone_grid(table(spark, folder, "nation")).select("zone_id", F.inline(edges))


def er_records(spark: SparkSession, folder: str) -> DataFrame:
    """list (A or B), record_id, name, county, day_no."""
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(F.when(k % 2 == 0, "A").otherwise("B").alias("list"), k.alias("record_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), F.col("p_brand").alias("county"), (k * 17 % 365).cast("int").alias("day_no"))


def headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an article whose title is its whole text."""
    return table(spark, folder, "documents").select("doc_id", F.col("text").alias("title"), "source", (F.col("doc_id") % 60).cast("int").alias("age_days"))


def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as an article: its title element, its host as the source."""
    title = strip_tags(F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1))
    return table(spark, folder, "pages").select("page_id", title.alias("title"), F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("source"), "url", (F.col("page_id") % 60).cast("int").alias("age_days"))
