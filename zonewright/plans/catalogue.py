"""The engine's queries over the star-schema tables, each a composition of operators. A query takes (spark, folder)."""

from __future__ import annotations

import datetime
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import equirectangular, half_up, micro
from ..operators import capture, entity, folds, forecast, geo, news, panels, rates, risk, scan, sinks, snapshots, vehicles
from ..session import shared_folder
from ..sources import readers
from ..sources import tables as src
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = datetime.date(2001, 8, 2)
NEWS_TERMS = ["that", "with", "this", "tion", "from", "ther"]
#: Stand-ins for place names that occur in the texts; order matters.
GAZETTEER = [("ther", "Thika"), ("that", "Nakuru"), ("tion", "Kisumu"), ("with", "Lamu"), ("from", "Nyeri"), ("this", "Embu")]
LEAD_PATTERNS = (r"(?i)\bin (that|with)\b", r"(?i)from|\bthis\b", r"(?i)ther|tion")
SIGHTING_DAYS = 3
ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    ALL[f.__name__] = f
    return f


def as_of():
    return F.lit(AS_OF)


# ---- rates ----


@query
def zone_risk_rates(spark: SparkSession, d: str) -> DataFrame:
    z = rates.empirical_bayes(rates.zero_filled_counts(src.zones(spark, d), src.incidents(spark, d)))
    z = z.select("zone_id", "zone_name", "documented", "population", micro(rates.per_100k(F.col("documented"), F.col("population"))).alias("crude_rate"), *(micro(c).alias(c) for c in ("eb_rate", "eb_lo", "eb_hi")))
    return rates.midrank(z, "eb_rate", "eb_pct").withColumn("eb_pct", micro("eb_pct"))


@query
def zone_counts_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    got = rates.zero_filled_counts(src.zones(spark, d), src.incidents(spark, d), n_mv=F.col("in_mv"), n_ob=F.col("in_ob"), n_mort=F.col("in_mort"))
    return got.select("zone_id", "documented", "n_mv", "n_ob", "n_mort")


@query
def located_counts(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("zone_id")
    return src.incidents(spark, d).agg(F.count_if(z.isNotNull()).alias("located"), F.count_if(z.isNull()).alias("unlocated"), F.count_if(F.col("in_mv") & F.col("in_ob")).alias("in_both"), F.count_distinct(z).alias("n_zones"))


@query
def window_filter(spark: SparkSession, d: str) -> DataFrame:
    """Incidents of the trailing year per zone, both ends included."""
    inside = F.col("incident_date").between(F.date_sub(as_of(), 365), as_of())
    return src.incidents(spark, d).where(inside).groupBy("zone_id").agg(F.count("*").alias("n"), F.min("incident_date").alias("first_date"), F.max("incident_date").alias("last_date"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """The located incidents with places of their own near their zone's."""
    i = src.incidents(spark, d).where("zone_id IS NOT NULL")
    z = src.zones(spark, d).select("zone_id", "lat", "lng")
    k = F.col("incident_id")
    return i.join(z, "zone_id").select("zone_id", (F.col("lat") + k % 7 / F.lit(100.0)).alias("lat"), (F.col("lng") - k % 5 / F.lit(100.0)).alias("lng"))


@query
def zone_centroids_min_support(spark: SparkSession, d: str) -> DataFrame:
    got = rates.supported_centroid(src.zones(spark, d), placed(spark, d))
    return got.select("zone_id", "n", micro("lat").alias("lat"), micro("lng").alias("lng"))


@query
def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rates.midrank(src.zones(spark, d).select("zone_id", "population"), "population", "pct").withColumn("pct", micro("pct"))


@query
def documented_by_bias(spark: SparkSession, d: str) -> DataFrame:
    """Zones with incidents, most first, with their share of all."""
    z = rates.zero_filled_counts(src.zones(spark, d), src.incidents(spark, d)).where("documented > 0")
    total = z.agg(F.sum("documented").alias("_t"))
    ranked = z.crossJoin(F.broadcast(total)).select("zone_id", "documented", micro(F.col("documented") / F.col("_t")).alias("share"))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("documented"), "zone_id")))


@query
def names_in_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Customers in the order in which people read their zones' names (some with an accent, in capitals or small letters), then by key."""
    n, k = F.initcap("n_name"), F.col("n_nationkey")
    name = F.when(k % 3 == 0, F.lower(n)).when(k % 3 == 1, F.upper(n)).otherwise(F.translate(n, "AEIOUaeiou", "ÁÉÍÓÚáéíóú"))
    zones = src.table(spark, d, "nation").select(k.alias("c_nationkey"), name.alias("zone_name"))
    people = src.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(zones, "c_nationkey")
    return sinks.placed(people.select("c_custkey", "zone_name"), T.in_reading_order("zone_name"), F.col("c_custkey")).select("c_custkey", "zone_name", "place", "total")


# ---- panels ----


@query
def national_monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return panels.monthly_rollup(src.weekly(spark, d))


@query
def trailing_365d_burden(spark: SparkSession, d: str) -> DataFrame:
    return burden_ranks(src.zones(spark, d), src.weekly(spark, d))


def burden_ranks(zones: DataFrame, weekly: DataFrame) -> DataFrame:
    z = zones.select("zone_id", "population").join(panels.trailing_burden(weekly), "zone_id", "left").fillna(0)
    z = z.select("zone_id", "events", "abductions", "vac_events", "burden", micro(rates.per_100k(F.col("burden"), F.col("population"))).alias("burden_rate"))
    return rates.midrank(z, "burden_rate", "pct").withColumn("pct", micro("pct"))


@query
def latest_per_zone(spark: SparkSession, d: str) -> DataFrame:
    """The last three incidents of each zone, newest first."""
    i = src.incidents(spark, d).where("zone_id IS NOT NULL").select("zone_id", "incident_id", "incident_date")
    return news.last_n(i, "zone_id", [F.desc("incident_date"), F.asc("incident_id")], 3)


@query
def zone_month_panel(spark: SparkSession, d: str) -> DataFrame:
    return panels.zone_months(src.weekly(spark, d))


@query
def panel_union(spark: SparkSession, d: str) -> DataFrame:
    return panels.joined_panel(src.incidents(spark, d), src.weekly(spark, d), "1999-01")


def grid(spark: SparkSession, d: str) -> DataFrame:
    return panels.filled_grid(panels.joined_panel(src.incidents(spark, d), src.weekly(spark, d), "1999-01", "2001-06"))


@query
def grid_filled(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).select("zone_id", "month", "mi", "events", "present")


@query
def panel_features(spark: SparkSession, d: str) -> DataFrame:
    f = panels.features(grid(spark, d))
    return f.select("zone_id", "month", "events", "lag1", *(micro(c).alias(c) for c in ("mean3", "mean6", "momentum", "month_sin", "month_cos")), "target")


@query
def label_p75(spark: SparkSession, d: str) -> DataFrame:
    return panels.calendar_labels(panels.zone_months(src.weekly(spark, d)))


@query
def temporal_zone_buckets(spark: SparkSession, d: str) -> DataFrame:
    t = panels.bucket_anomaly(src.zones(spark, d), src.incidents(spark, d), as_of())
    return t.select("zone_id", "current", micro("baseline").alias("baseline"), half_up("z", 2).alias("z"), "flagged")


def monthly_incidents(spark: SparkSession, d: str) -> DataFrame:
    return by_month(src.incidents(spark, d), F.count("*"))


def by_month(incidents: DataFrame, n: Column) -> DataFrame:
    return incidents.groupBy(F.date_format("incident_date", "yyyy-MM").alias("month")).agg(n.alias("ed")).where(F.col("month") < "2001-08")


@query
def temporal_trailing12(spark: SparkSession, d: str) -> DataFrame:
    t = panels.trailing_anomaly(monthly_incidents(spark, d), "ed")
    return t.select("month", "ed", half_up("baseline", 1).alias("baseline"), half_up("z", 2).alias("z"), "flagged")


@query
def yearly_totals(spark: SparkSession, d: str) -> DataFrame:
    i = src.incidents(spark, d).select(F.year("incident_date").alias("year"), F.when(F.col("in_ob"), 1).otherwise(2).alias("type_of_violence"), F.col("incident_id").cast("long").alias("best"))
    return sinks.event_summary(i)


@query
def month_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Fresh months over stored ones; months before 2001 stay frozen, new ones are added."""
    m = monthly_incidents(spark, d)
    stored = m.where(F.col("month") <= "2001-05")
    fresh = m.where(F.col("month") >= "2000-11").select("month", (F.col("ed") + 1000).alias("ed"))
    return sinks.overlay(stored, fresh, "month", F.lit("2001-01"))


# ---- capture-recapture ----


@query
def chapman_point(spark: SparkSession, d: str) -> DataFrame:
    got = capture.chapman_point(src.incidents(spark, d).where("in_mv OR in_ob"), F.col("in_mv"), F.col("in_ob"))
    return got.select("n_a", "n_b", "overlap", "documented", micro("chapman").alias("chapman"), micro("factor").alias("factor"))


@query
def capture_patterns_3list(spark: SparkSession, d: str) -> DataFrame:
    return entity.in_pattern_order(entity.pattern_counts(src.incidents(spark, d), {"mv": F.col("in_mv"), "ob": F.col("in_ob"), "mort": F.col("in_mort")}))


@query
def chapman_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    r = capture.two_list_estimate(src.incidents(spark, d), F.col("in_mv"), F.col("in_ob"))
    return spark.createDataFrame([(r["method"], r["n_a"], r["n_b"], r["overlap"], r["estimated"], r["low"], r["high"])], "method string, n_a long, n_b long, overlap long, estimated double, low double, high double")


@query
def mse_three_lists(spark: SparkSession, d: str) -> DataFrame:
    r = capture.three_list_estimate(src.incidents(spark, d), [F.col("in_mv"), F.col("in_ob"), F.col("in_mort")])
    return spark.createDataFrame([(r["documented"], float(r["estimated"]), float(r["low"]), float(r["high"]), r["confidence"], r["pair_01"], r["pair_02"], r["pair_12"])], "documented long, estimated double, low double, high double, confidence string, pair_01 double, pair_02 double, pair_12 double")


# ---- space ----


def zone_cases(spark: SparkSession, d: str) -> DataFrame:
    return rates.zero_filled_counts(src.zones(spark, d), src.incidents(spark, d)).select("zone_id", F.col("documented").alias("cases"))


@query
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return geo.zones_within(src.zones(spark, d), 280).where("a < b").select("a", "b", half_up("km", 3).alias("km"))


@query
def scan_circles(spark: SparkSession, d: str) -> DataFrame:
    return scan.circles(src.zones(spark, d)).select("center", "radius_km", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.col("n_members").cast("long").alias("n_members"), "population")


@query
def scan_observed_llr(spark: SparkSession, d: str) -> DataFrame:
    s = scan.scanned(src.zones(spark, d), zone_cases(spark, d))
    return s.select("center", "radius_km", "observed", *(micro(c).alias(c) for c in ("expected", "llr", "rr")))


@query
def scan_kulldorff_llr(spark: SparkSession, d: str) -> DataFrame:
    s = scan.scanned(src.zones(spark, d), zone_cases(spark, d), "kulldorff")
    return s.select("center", "radius_km", micro("llr").alias("llr"))


@query
def scan_monte_carlo_p(spark: SparkSession, d: str) -> DataFrame:
    got = scan.clusters(src.zones(spark, d), zone_cases(spark, d))
    return got.select("rank", "center", "radius_km", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "observed", half_up("expected", 1).alias("expected"), micro("rr").alias("rr"), half_up("llr", 2).alias("llr"), "p")


@query
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return geo.point_in_polygon(src.points(spark, d), src.zone_edges(spark, d))


@query
def ring_area_centroid(spark: SparkSession, d: str) -> DataFrame:
    return geo.zone_centroids(src.zone_edges(spark, d)).select("zone_id", *(micro(c).alias(c) for c in ("area", "lat", "lng")))


@query
def ring_simplify(spark: SparkSession, d: str) -> DataFrame:
    """The squares' corners with the middle of each edge put in between: simplifying takes the middles out again."""
    e = src.zone_edges(spark, d)
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    halves = F.array(F.struct((2 * F.col("seq")).alias("seq"), "x1", "y1", mx.alias("x2"), my.alias("y2")), F.struct((2 * F.col("seq") + 1).alias("seq"), mx.alias("x1"), my.alias("y1"), "x2", "y2"))
    fine = e.select("zone_id", "ring", F.inline(halves))
    return geo.simplified(fine, 0.01).select("zone_id", "ring", "seq", micro("x").alias("x"), micro("y").alias("y"))


@query
def equirect_project(spark: SparkSession, d: str) -> DataFrame:
    x, y = equirectangular(F.col("lat"), F.col("lng"), 33.5, 0.5, 100.0)
    return src.zones(spark, d).select("zone_id", micro(x).alias("x"), micro(y).alias("y"))


# ---- sightings ----


@query
def vehicle_best_window(spark: SparkSession, d: str) -> DataFrame:
    v = vehicles.vehicle_patterns(src.sightings(spark, d), src.recent_incidents(spark, d), SIGHTING_DAYS, SIGHTING_DAYS)
    return v.select("vehicle_key", "n", F.unix_micros("start").alias("start_us"), F.array_join(F.transform("zones", lambda x: x.cast("string")), ",").alias("zones"), "total", "overlap", "status", micro("confidence").alias("confidence"))


@query
def vehicle_radius_variant(spark: SparkSession, d: str) -> DataFrame:
    v = vehicles.vehicle_patterns_radius(src.sightings(spark, d), src.recent_incidents(spark, d), src.zones(spark, d), SIGHTING_DAYS, SIGHTING_DAYS, 130.0)
    return v.select("vehicle_key", "n", F.unix_micros("start").alias("start_us"), "overlap", "status", micro("confidence").alias("confidence"))


# ---- the index ----


class Basis:
    """What the parts of an analysis are taken from, each read once and written to the shared folder when first asked for.

    Rows are places, weeks of a place, days of a place and vehicles; never incidents or sightings.
    """

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.folder = spark, d

    @functools.cached_property
    def zones(self) -> DataFrame:
        return entity.checkpointed(src.zones(self.spark, self.folder))

    @functools.cached_property
    def days(self) -> DataFrame:
        return entity.checkpointed(rates.incident_days(src.incidents(self.spark, self.folder)))

    @functools.cached_property
    def weekly(self) -> DataFrame:
        return entity.checkpointed(src.weekly(self.spark, self.folder))

    @functools.cached_property
    def windows(self) -> DataFrame:
        return entity.checkpointed(vehicles.best_windows(src.sightings(self.spark, self.folder), SIGHTING_DAYS))

    @functools.cached_property
    def patterns(self) -> DataFrame:
        return entity.checkpointed(vehicles.window_patterns(self.windows, src.recent_incidents(self.spark, self.folder), SIGHTING_DAYS, SIGHTING_DAYS))

    @functools.cached_property
    def news(self) -> DataFrame:
        return entity.checkpointed(news_windows(self.spark, self.folder))

    @property
    def cases(self) -> DataFrame:
        return rates.zero_filled_counts(self.zones, self.days, n=F.col("n")).select("zone_id", F.col("documented").alias("cases"))

    @property
    def months(self) -> DataFrame:
        return by_month(self.days, F.sum("n"))

    @property
    def estimate(self) -> DataFrame:
        return capture.chapman_point(self.days.where("in_mv OR in_ob"), F.col("in_mv"), F.col("in_ob"), F.col("n"))


def best_circle(b: Basis) -> DataFrame:
    """zone_id and rr of the zones in the circle of highest ratio, whatever its p-value: what SQL can state."""
    best = scan.scanned(b.zones, b.cases).orderBy(F.desc(micro("llr")), "center", "radius_km").limit(1).where("llr > 0")
    return best.select(F.explode("members").alias("zone_id"), "rr")


def index_of(b: Basis, inside: DataFrame | None = None) -> DataFrame:
    """All components per zone, with index, band, confidence and drivers. inside: zone_id (unique) and rr of the zones in clusters; by default those of the best circle."""
    inside = best_circle(b) if inside is None else inside
    base = rates.empirical_bayes(rates.zero_filled_counts(b.zones, b.days, n=F.col("n")))
    base = base.crossJoin(F.broadcast(b.estimate.select("factor"))).withColumn("eb_rate", micro("eb_rate")).withColumn("mse_rate", micro(F.col("documented") * F.col("factor") / (F.col("population") / F.lit(1e5))))
    base = rates.midrank(rates.midrank(base, "eb_rate", "eb_pct"), "mse_rate", "mse_pct")
    burden = burden_ranks(b.zones, b.weekly).select("zone_id", F.col("pct").alias("acled_recent"), "abductions", "vac_events")
    temporal = panels.bucket_anomaly(b.zones, b.days, as_of(), n=F.col("n")).select("zone_id", half_up("z", 2).alias("z"), "flagged")
    seen = b.windows.where("n >= 6").select(F.explode("zones").alias("zone_id")).distinct().withColumn("vehicle", F.lit(True))
    got = base.join(inside, "zone_id", "left").join(burden, "zone_id", "left").join(temporal, "zone_id", "left").join(seen, "zone_id", "left")
    got = got.withColumn("cluster_score", risk.cluster_score(F.col("rr"))).withColumn("temporal_score", risk.temporal_score(F.col("z"))).withColumn("vehicle_score", F.when(F.col("vehicle"), 1.0).otherwise(0.0)).withColumn("ucdp_baseline", F.lit(0.0))
    got = risk.composite_index(got).withColumn("confidence", risk.confidence(F.col("documented"), F.lit(0), F.col("abductions"), F.col("vac_events")))
    return got.withColumn("drivers", risk.zone_drivers(F.col("documented"), rates.per_100k(F.col("documented"), F.col("population")), F.col("eb_rate"), F.col("rr"), F.col("z"), F.col("flagged"), F.col("abductions"), F.col("vac_events"), F.col("vehicle")))


def index_table(spark: SparkSession, d: str, inside: DataFrame | None = None) -> DataFrame:
    return index_of(Basis(spark, d), inside)


@query
def composite_index(spark: SparkSession, d: str) -> DataFrame:
    t = index_table(spark, d)
    return t.select("zone_id", *(micro(c).alias(c) for c in ("eb_pct", "mse_pct", "cluster_score", "acled_recent", "temporal_score", "vehicle_score")), "index", "band", "confidence")


@query
def risk_bands(spark: SparkSession, d: str) -> DataFrame:
    return index_table(spark, d).groupBy("band").agg(F.count("*").alias("n"), F.max("index").alias("highest"))


@query
def region_summary(spark: SparkSession, d: str) -> DataFrame:
    """Zones merged by region: sums, and the zone of highest index (lowest id among equals)."""
    return regions(index_table(spark, d))


def regions(t: DataFrame) -> DataFrame:
    return t.groupBy("region_name").agg(F.count("*").alias("zones"), F.sum("documented").alias("documented"), F.max("index").alias("index"), F.max_by("zone_id", F.struct("index", -F.col("zone_id"))).alias("top_zone"))


def trend_table(spark: SparkSession, d: str) -> DataFrame:
    """The panel's own trend: mean of the last six months against the last three."""
    f = panels.features(grid(spark, d))
    last = f.agg(F.max("mi").alias("mi"))
    return f.join(F.broadcast(last), "mi").select("zone_id", F.col("mean6").alias("mean"), F.col("mean3").alias("recent3"))


@query
def trend_projection_top12(spark: SparkSession, d: str) -> DataFrame:
    return risk.projections(index_table(spark, d), trend_table(spark, d))


def found_clusters(b: Basis) -> DataFrame:
    """The primary and secondary clusters with their p-values: a few rows, simulated once per call."""
    return scan.clusters(b.zones, b.cases)


@query
def composite_index_significant(spark: SparkSession, d: str) -> DataFrame:
    """The index with the cluster score of every significant cluster, secondary ones too."""
    b = Basis(spark, d)
    t = index_of(b, risk.in_significant(found_clusters(b)))
    return t.select("zone_id", *(micro(c).alias(c) for c in ("eb_pct", "mse_pct", "cluster_score", "acled_recent", "temporal_score", "vehicle_score")), "index", "band", "confidence")


@query
def forecast_projection_top12(spark: SparkSession, d: str) -> DataFrame:
    """Projections of the significant index by each zone's forecast against its last three months."""
    trend = forecast.forecast_zones(grid(spark, d)).select("zone_id", "mean", "recent3")
    b = Basis(spark, d)
    return risk.projections(index_of(b, risk.in_significant(found_clusters(b))), trend)


@query
def alerts_feed_significant(spark: SparkSession, d: str) -> DataFrame:
    """The whole feed: zones by the significant index, and an alert per significant cluster."""
    b = Basis(spark, d)
    found = found_clusters(b)
    got = feed_of(b, index_of(b, risk.in_significant(found)), risk.cluster_alerts(found, b.zones))
    return got.select("place", "id", "severity", "kind", "title", "confidence")


def feed_of(b: Basis, index: DataFrame, *after_zones: DataFrame) -> DataFrame:
    """All alerts. index: an index_table; after_zones: alerts that stand after those of the zones."""
    zones = index.withColumn("county", F.col("region_name"))
    spike = risk.spike_alert(panels.trailing_anomaly(b.months, "ed"), "ed")
    corroborated = risk.corroboration_alert(panels.monthly_rollup(b.weekly), panels.trailing_burden(b.weekly))
    seen = risk.vehicle_alerts(b.patterns.where("n >= 8"), SIGHTING_DAYS)
    return risk.alerts_feed(risk.zone_alerts(zones), *after_zones, seen, spike, corroborated, risk.data_alert(b.estimate), risk.news_alert(b.news))


def feed(spark: SparkSession, d: str, inside: DataFrame | None = None, *after_zones: DataFrame) -> DataFrame:
    """All alerts. inside: as in index_table; after_zones: as in feed_of."""
    b = Basis(spark, d)
    return feed_of(b, index_of(b, inside), *after_zones)


@query
def alerts_feed(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d).select("place", "id", "severity", "kind", "title", "confidence")


@query
def cluster_alerts(spark: SparkSession, d: str) -> DataFrame:
    z = src.zones(spark, d)
    return risk.cluster_alerts(scan.clusters(z, zone_cases(spark, d)), z).select("id", "severity", "title", "message", "confidence")


@query
def severity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return risk.severity_counts(feed(spark, d))


@query
def analysis_document(spark: SparkSession, d: str) -> DataFrame:
    """The nested document of an analysis, read back from its JSON."""
    patterns = capture_patterns_3list(spark, d).select("pattern", "n")
    b = Basis(spark, d)
    index = entity.checkpointed(index_of(b))
    alerts = feed_of(b, index)
    doc = entity.checkpointed(sinks.analysis_document({"severities": risk.severity_counts(alerts), "regions": regions(index), "patterns": patterns, "none": patterns.where("n < 0")}))
    read = [
        sinks.document_part(doc, part, f"{key} string, {n} long").select(F.lit(part).alias("part"), "place", F.col(key).alias("key"), F.col(n).alias("n"))
        for part, key, n in (("severities", "severity", "n"), ("regions", "region_name", "zones"), ("patterns", "pattern", "n"), ("none", "pattern", "n"))
    ]
    return functools.reduce(DataFrame.unionAll, read)


@query
def action_level_alerts(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d).where(F.col("severity").isin("critical", "elevated")).select("id", "message", F.size("actions").cast("long").alias("n_actions"))


# ---- headlines ----


@query
def gazetteer_lenient(spark: SparkSession, d: str) -> DataFrame:
    towns = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(GAZETTEER)], "term string, zone string, ord int")
    names = spark.createDataFrame([(z, i) for i, z in enumerate(sorted({v for _, v in GAZETTEER}))], "zone string, ord int")
    return news.lenient_place(src.headlines(spark, d), "doc_id", F.col("title"), {"nai": "Embu"}, towns, names)


@query
def gazetteer_strict(spark: SparkSession, d: str) -> DataFrame:
    return news.gazetteer_first(src.headlines(spark, d), "doc_id", "title", GAZETTEER, words=True)


@query
def lead_classify(spark: SparkSession, d: str) -> DataFrame:
    return src.headlines(spark, d).select("doc_id", news.classify_lead(F.col("title"), *LEAD_PATTERNS).alias("reason"))


@query
def keyword_terms(spark: SparkSession, d: str) -> DataFrame:
    got = news.matching(src.headlines(spark, d), NEWS_TERMS, F.concat_ws(" ", "title", "source"))
    return got.select("doc_id", F.array_join("matched_terms", ",").alias("terms"))


@query
def title_dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return news.first_seen(src.headlines(spark, d), "title", ["age_days", "doc_id"]).select("doc_id", "title", "source")


@query
def latest_articles(spark: SparkSession, d: str) -> DataFrame:
    return news.latest(src.headlines(spark, d).select("doc_id", "source", "age_days"), 200, F.asc("age_days"), F.asc("doc_id"))


@query
def top_mentions(spark: SparkSession, d: str) -> DataFrame:
    return news.top_counts(gazetteer_strict(spark, d).where("zone IS NOT NULL"), "zone", 10)


def news_day():
    return F.lit(datetime.date(2024, 1, 30))


def daily(spark: SparkSession, d: str) -> DataFrame:
    errors = src.table(spark, d, "events").where("event_type = 'error'")
    return panels.daily_histogram(errors, F.to_date("ts"), news_day())


@query
def daily_histogram(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d)


@query
def news_windows(spark: SparkSession, d: str) -> DataFrame:
    return panels.window_sums(daily(spark, d), news_day())


@query
def html_anchor_index(spark: SparkSession, d: str) -> DataFrame:
    return readers.anchors(src.table(spark, d, "pages"), "page_id", "html", r"/([^\"/?#]+)")


@query
def set_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts of one source and day with a Jaccard similarity of words of 0.5 and more."""
    h = src.headlines(spark, d).select("doc_id", "source", "age_days", F.array_distinct(F.filter(F.split(T.normalised("title"), " "), lambda w: w != "")).alias("w"))
    return entity.similar_in_groups(h, "doc_id", "w", "jaccard", 0.5, "age_days", 0, ["source"]).select("a", "b", micro("similarity").alias("jaccard"))


@query
def bigram_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts of one source within three days with a cosine of bigrams of 0.42 and more."""
    h = src.headlines(spark, d).select("doc_id", "source", "age_days", T.bigram_set(T.tokens(F.lower("title"))).alias("g"))
    return entity.similar_in_groups(h, "doc_id", "g", "cosine", 0.42, "age_days", 3, ["source"]).select("a", "b", micro("similarity").alias("cosine"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_sub(news_day(), F.col("age_days"))
    return src.page_titles(spark, d).select(F.col("page_id").alias("article_id"), F.unix_date(day).alias("day_no"), "title", "source", "url", day.alias("pub_date"))


@query
def case_status(spark: SparkSession, d: str) -> DataFrame:
    a = entity.checkpointed(articles(spark, d))
    cases = news.assemble_cases(a, news.linked_headlines(a), news_day())
    return cases.select("case_id", "person", "pub_date", "latest_pub_date", "corroboration", F.size("urls").alias("n_articles"), "status")


@query
def record_crossmatch(spark: SparkSession, d: str) -> DataFrame:
    """Parts of odd id met with the first part of even id whose name has half of its words in common, within 45 days, or that
    tells of the same role within 14 days: every twentieth part of a list is given one."""
    r = src.er_records(spark, d).select("record_id", "list", "day_no", "name")
    cases = r.where("list = 'B'").select(F.col("record_id").alias("case_id"), "day_no", F.col("name").alias("person"), F.concat(F.when(F.col("record_id") % 40 == 1, "Driver found: ").otherwise(""), F.col("name")).alias("titles"))
    records = r.where("list = 'A'").select("record_id", F.col("record_id").alias("ord"), "day_no", F.col("name").alias("person"), F.concat(F.when(F.col("record_id") % 40 == 0, "a driver, ").otherwise(""), F.col("name")).alias("notes"))
    return news.cross_match(cases, records)


# ---- entities ----


def lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = src.er_records(spark, d)
    return r.where("list = 'A'").drop("list"), r.where("list = 'B'").drop("list")


@query
def entity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return entity.scored_pairs(*lists(spark, d), days=3, similarity=0.82)


@query
def greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    return entity.assigned_records(*lists(spark, d), days=3, similarity=0.82)


@query
def union_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = lists(spark, d)
    return entity.merged(a, b, greedy_assignment(spark, d))


@query
def unmatched_records(spark: SparkSession, d: str) -> DataFrame:
    return entity.unmatched(lists(spark, d)[0], greedy_assignment(spark, d), "a_id").select("record_id", "name")


@query
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one customer that are placed within 60 days of each other, chained: each is tied to the one before it."""
    o = src.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    near = o.select(F.col("o_orderkey").alias("a"), F.when(F.col("day") - F.lag("day").over(w) <= 60, F.lag("o_orderkey").over(w)).alias("b")).where("b IS NOT NULL")
    return entity.components(o.select(F.col("o_orderkey").alias("node")), near)


@query
def capture_pattern_matrix(spark: SparkSession, d: str) -> DataFrame:
    r = src.er_records(spark, d).select("record_id", (F.col("record_id") % 3).cast("int").alias("list_no"), "day_no", "name", "county")
    return entity.capture_patterns(r)


# ---- forecasts ----


@query
def poisson_gamma(spark: SparkSession, d: str) -> DataFrame:
    f = forecast.forecast_zones(grid(spark, d))
    return f.select("zone_id", "last_month", micro("mean").alias("mean"), "lower95", "upper95", "last_events", "recent3")


@query
def top_forecasts(spark: SparkSession, d: str) -> DataFrame:
    return poisson_gamma(spark, d).orderBy(F.desc("mean"), "zone_id").limit(8)


@query
def forecast_report(spark: SparkSession, d: str) -> DataFrame:
    """The national forecast for three months with its errors, and the eight zones of the highest forecasts."""
    f = forecast.forecast_report(entity.checkpointed(grid(spark, d)))
    return f.select("level", "zone_id", "step", "month", *(micro(x).alias(x) for x in ("mean", "lower95", "upper95")), "last_events", "recent3", *(micro(x).alias(x) for x in ("mae", "rmse", "coverage")), "n")


@query
def holt_winters(spark: SparkSession, d: str) -> DataFrame:
    m = monthly_incidents(spark, d).withColumn("series", F.lit("national"))
    h = forecast.holt_winters_series(m, "series", "ed")
    return h.select("step", *(micro(c).alias(c) for c in ("mean", "lower95", "upper95", "mae")), "alpha", "beta", "gamma")


@query
def coverage(spark: SparkSession, d: str) -> DataFrame:
    e = forecast.error_summary(forecast.one_step_errors(monthly_incidents(spark, d), "ed", 12))
    return e.select(*(micro(c).alias(c) for c in ("mae", "rmse", "coverage")), "n")


@query
def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = entity.checkpointed(forecast.walk_forward(grid(spark, d)))
    m = forecast.classification_metrics(p).crossJoin(forecast.auc(p, "score", "label").select("auc"))
    return m.select("n", "n_elevated", "n_flags", *(micro(c).alias(c) for c in ("hit_rate", "false_alarm_rate", "brier", "lead_days", "auc")))


def scored_events(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "events").select(F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"), (F.col("event_id") % 97).alias("other"))


@query
def rank_auc(spark: SparkSession, d: str) -> DataFrame:
    return forecast.auc(scored_events(spark, d), "score", "label").select(micro("auc").alias("auc"), "n", "n_positive")


@query
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return forecast.spearman(scored_events(spark, d), "score", "other").select(micro("rho").alias("rho"), "n")


@query
def risk_classifier(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    m = forecast.risk_classifier(g.where("present").select("zone_id", "month", "events"), g)
    rows = [(n, float(w), float(c), float(s)) for n, w, c, s in zip(panels.FEATURES, m["weights"], m["mean"], m["sd"], strict=True)]
    return spark.createDataFrame(rows, "feature string, weight double, mean double, sd double")


#: The window of the index and its two cutoffs, both with the months after them up to the present as outcome.
FOLDS = [folds.Fold(k, datetime.date(1999, 1, 1), cutoff, AS_OF) for k, cutoff in enumerate((datetime.date(2001, 1, 1), datetime.date(2000, 7, 1)))]
#: The year from which deaths count for the historic baseline.
HISTORY_FROM = datetime.date(1995, 1, 1)
#: The weights in use, those before them (with the historic baseline in place of the recent burden), and equal ones.
WEIGHT_SETS = {"current": risk.WEIGHTS, "previous": risk.WEIGHTS | {"acled_recent": 0.0, "ucdp_baseline": 0.1}, "equal": dict.fromkeys(risk.WEIGHTS, 1 / 7)}


def fold_components(spark: SparkSession, d: str, simulated: bool = False) -> DataFrame:
    seen = vehicles.best_windows(src.sightings(spark, d), SIGHTING_DAYS).where("n >= 6").select(F.explode("zones").alias("zone_id"))
    return folds.components(src.zones(spark, d), src.incidents(spark, d), src.weekly(spark, d), seen, FOLDS, HISTORY_FROM, simulated)


@query
def calibration_folds(spark: SparkSession, d: str) -> DataFrame:
    """What the index knew of each zone at each cutoff, and what came after."""
    return fold_components(spark, d)


@query
def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    """How well fixed sets of weights rank the zones of each fold."""
    got = folds.ranking_report(entity.checkpointed(fold_components(spark, d)), WEIGHT_SETS)
    return got.select("weights", "fold", "n", "n_positive", micro("auc").alias("auc"), micro("rho").alias("rho"))


@query
def calibrate_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights fitted on folds whose components are as of their cutoffs, with simulated clusters."""
    rows = forecast.gathered(fold_components(spark, d, simulated=True)).sort_values(["fold", "zone_id"])
    best, top = forecast.calibrate_weights(rows, dict(risk.WEIGHTS))
    return spark.createDataFrame([(k, v, top) for k, v in best.items()], "component string, weight double, objective double")


# ---- state and streams ----


@query
def snapshot_delta(spark: SparkSession, d: str) -> DataFrame:
    s = src.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return sinks.snapshot_delta(s, "day", ["events", "errors"])


def state_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    s = streams.windowed_counts(streams.event_stream(spark, f"{d}/events.parquet"))
    got = streams.latest_rows(streams.run_to_end(s, state_folder(spark)), "start", "event_type")
    return got.select(F.to_date("start").alias("day"), "event_type", "n", micro("total").alias("total"))


@query
def stream_high_water(spark: SparkSession, d: str) -> DataFrame:
    s = streams.high_water(streams.event_stream(spark, f"{d}/events.parquet"), "event_type", "event_id")
    got = streams.run_to_end(s, state_folder(spark))
    return got.groupBy("event_type").agg(F.max("latest").alias("latest"))


@query
def stream_case_state(spark: SparkSession, d: str) -> DataFrame:
    e = streams.event_stream(spark, f"{d}/events.parquet")
    s = e.select(F.concat(F.lit("case-"), F.col("user_id") % 50).alias("case_id"), F.col("event_id").alias("sighting"), "ts", F.concat(F.lit("outlet-"), F.col("event_id") % 7).alias("outlet"), F.when(F.col("event_id") % 900 == 899, "promoted").alias("decision"))
    got = streams.run_to_end(streams.case_state(s), state_folder(spark))
    return streams.latest_rows(got, "case_id").select("case_id", "status", "updates")


def in_files(rows: DataFrame, order: str, n: int, path: str) -> str:
    """rows in n files whose order in time is that of `order`, so that a stream over path has n batches."""
    marks = rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)]).alias("m")).first()["m"] or []
    for low, high in zip([None, *marks], [*marks, None], strict=True):
        part = rows.where((F.lit(True) if low is None else F.col(order) >= low) & (F.lit(True) if high is None else F.col(order) < high))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


@query
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """The limiter over requests that come in three files, each key's list of allowed times carried from one to the next."""
    e = src.table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    there = state_folder(spark)
    requests = streams.event_stream(spark, in_files(e, "us", 3, f"{there}/requests"))
    return streams.run_to_end(streams.limited_requests(requests, "event_type", limit=3, seconds=3600), there, "append").select("request_id", F.col("key").alias("event_type"), "allowed")


@query
def stream_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Daily values with late revisions from two files over them: the last revision of a day counts, days before the 10th stay as stored."""
    day, ts = F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp"))
    e = src.table(spark, d, "events")
    stored = e.where("event_type = 'view'").groupBy(day).agg(F.lit(0).cast("long").alias("revised"), F.count("*").alias("n"))
    there = state_folder(spark)
    snapshots.publish(stored, f"{there}/table", 0)
    late = in_files(e.where("event_type = 'click'").select(day, ts.alias("revised"), F.col("event_id").alias("n")), "n", 2, f"{there}/revisions")
    sink = snapshots.revisions_sink(f"{there}/table", "day", "revised", F.lit("2024-01-10").cast("date"))
    streams.run_to_end(spark.readStream.schema("day date, revised long, n long").option("maxFilesPerTrigger", 1).parquet(late), there, "append", sink)
    return snapshots.read(spark, f"{there}/table")


@query
def sliding_request_windows(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    got = streams.sliding_requests(e, "10 minutes", "5 minutes", limit=4)
    return got.select(F.unix_seconds("start").alias("start_s"), "n", "limited")


@query
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return streams.rate_limited(e, "event_type", limit=3, seconds=3600)


@functools.cache
def names() -> tuple[str, ...]:
    return tuple(ALL)
