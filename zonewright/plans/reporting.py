"""Queries for the reports as a whole: overview, weekly digest, brief and the full document, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import half_up, micro
from ..operators import entity, forecast, panels, reports, risk, sinks
from ..sources import tables as src
from .catalogue import Basis, as_of, best_circle, feed_of, found_clusters, grid, index_of, query, regions
from .oracle import sql

ELECTION = "2003-08-10"


class Analysis(Basis):
    """The basis with what all reports show: index, feed, overview."""

    #: Simulated clusters, set before anything is asked for; without them the best circle counts.
    found: DataFrame | None = None

    @functools.cached_property
    def circle(self) -> DataFrame:
        return entity.checkpointed(best_circle(self))

    @functools.cached_property
    def index(self) -> DataFrame:
        inside = self.circle if self.found is None else risk.in_significant(self.found)
        return entity.checkpointed(index_of(self, inside))

    @functools.cached_property
    def alerts(self) -> DataFrame:
        more = [] if self.found is None else [risk.cluster_alerts(self.found, self.zones)]
        return entity.checkpointed(feed_of(self, self.index, *more))

    @functools.cached_property
    def overview(self) -> DataFrame:
        n = 0 if self.found is None else self.found.where("p <= 0.05").count()
        return entity.checkpointed(reports.overview(self.index, self.days, self.estimate, self.patterns, self.alerts, n))

    @property
    def spikes(self) -> DataFrame:
        return panels.trailing_anomaly(self.months, "ed")

    @property
    def coded(self) -> DataFrame:
        return panels.monthly_rollup(self.weekly)

    @property
    def clusters(self) -> DataFrame:
        """names, rr, p, observed, expected, radius_km of the significant clusters; none without a simulation."""
        if self.found is None:
            return self.spark.createDataFrame([], "names string, rr double, p double, observed long, expected double, radius_km int")
        one = self.found.where("p <= 0.05").select("rank", "rr", "p", "observed", "expected", "radius_km", F.explode("members").alias("zone_id")).join(self.zones.select("zone_id", "zone_name"), "zone_id")
        return one.groupBy("rank", "rr", "p", "observed", "expected", "radius_km").agg(F.array_join(F.sort_array(F.collect_list("zone_name")), ", ").alias("names"))

    @property
    def months_left(self):
        return F.floor(F.months_between(F.trunc(F.lit(ELECTION).cast("date"), "MM"), F.trunc(as_of(), "MM")))

    @functools.cached_property
    def statements(self) -> DataFrame:
        """The window sums with the number of the latest statement: the highest page."""
        top = src.table(self.spark, self.folder, "pages").agg(F.coalesce(F.max("page_id"), F.lit(0)).cast("long").alias("statements"))
        return entity.checkpointed(self.news.crossJoin(F.broadcast(top)))  # one row each

    def previous(self) -> DataFrame:
        """The state of the digest before: what was on record a week ago, burden from the weeks up to then, statements before the last ten pages."""
        known = self.days.where((F.col("in_mv") | F.col("in_ob")) & (F.col("incident_date") < F.date_sub(as_of(), 7))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documented"))
        then = panels.trailing_burden(self.weekly.where(F.col("week") < F.date_sub(self.last_week, 7))).agg(F.coalesce(F.sum("abductions"), F.lit(0)).alias("abductions"))
        return known.crossJoin(F.broadcast(then)).crossJoin(F.broadcast(self.statements.select((F.col("statements") - 10).alias("statements"))))  # one row each

    @functools.cached_property
    def last_week(self):
        return F.lit(self.weekly.agg(F.max("week")).first()[0])


def curation_queue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases of the queue, with dates around the day of the analysis."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    status = F.when(k % 10 < 5, "pending").when(k % 10 < 7, "ready").when(k % 10 < 9, "promoted").otherwise("duplicate")
    return src.table(spark, d, "orders").select(k.alias("case_id"), status.alias("status"), F.concat(F.lit("case of "), F.lower(F.substring_index("o_orderpriority", "-", -1))).alias("hint"), (1 + k % 4).alias("corroboration"), day.alias("pub_date"), day.alias("latest_pub_date"), F.date_add(day, (k % 5).cast("int")).alias("promoted_on"))


@query
def analysis_overview(spark: SparkSession, d: str) -> DataFrame:
    return Analysis(spark, d).overview.drop("clusters")


@query
def weekly_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest line by line, against the state of a week before."""
    a = Analysis(spark, d)
    return reports.weekly_digest(a.overview, a.previous(), a.spikes, a.statements, curation_queue(spark, d), a.alerts, a.months_left, as_of())


@query
def weekly_digest_text(spark: SparkSession, d: str) -> DataFrame:
    """The same as one Markdown document."""
    return reports.as_markdown(weekly_digest(spark, d), "Weekly digest")


@query
def digest_state(spark: SparkSession, d: str) -> DataFrame:
    """What the next digest compares with."""
    a = Analysis(spark, d)
    return reports.digest_state(a.overview, a.statements, as_of())


@query
def analysis_brief(spark: SparkSession, d: str) -> DataFrame:
    """The brief by the best circle, which SQL can state: no simulated clusters, no forecast."""
    a = Analysis(spark, d)
    return reports.analysis_brief(a.overview, a.index, a.clusters, a.patterns, a.alerts, a.spikes, a.coded, a.news, a.months_left)


@query
def analysis_brief_significant(spark: SparkSession, d: str) -> DataFrame:
    """The brief with simulated clusters and the national forecast."""
    a = Analysis(spark, d)
    a.found = entity.checkpointed(found_clusters(a))
    ahead = forecast.national_forecast(entity.checkpointed(grid(spark, d)), 3)
    return reports.analysis_brief(a.overview, a.index, a.clusters, a.patterns, a.alerts, a.spikes, a.coded, a.news, a.months_left, ahead)


def document_parts(a: Analysis) -> dict[str, DataFrame]:
    """The parts of the document but forecast, media and data files; rows of each stand in order of its columns, so the first column orders them."""
    c = F.col
    shown = a.index.select("zone_id", "zone_name", "region_name", "documented", "index", "band", "confidence", micro("eb_pct").alias("eb_pct"), micro("mse_pct").alias("mse_pct"), "acled_recent", micro("cluster_score").alias("cluster_score"), micro("temporal_score").alias("temporal_score"), "vehicle_score", "abductions", "vac_events")
    recent = src.incidents(a.spark, a.folder).where(c("incident_date") < as_of()).orderBy(F.desc("incident_date"), F.desc("incident_id")).limit(40)
    lists = F.array_compact(F.array(*(F.when(c(x), x) for x in ("in_mv", "in_ob", "in_mort"))))
    return {
        "overview": a.overview,
        "zones": shown,
        "regions": regions(a.index),
        "clusters": a.clusters,
        "vehicles": a.patterns.where("n >= 8").select("vehicle_key", "n", "total", "overlap", "status", "confidence"),
        "alerts": a.alerts.select(c("place").alias("rank"), "id", "severity", "kind", "title", "message", "drivers", "actions", "confidence"),
        "weights": a.spark.createDataFrame(list(risk.WEIGHTS.items()), "component string, weight double"),
        "series": a.months.orderBy(F.desc("month")).limit(30),
        "anomalies": a.spikes.select("month", "ed", half_up("baseline", 1).alias("baseline"), half_up("z", 2).alias("z"), "flagged"),
        "coded": a.coded.select("month", "abductions", "vac_events", "events"),
        "incidents": recent.select(F.row_number().over(entity.Window.orderBy(F.desc("incident_date"), F.desc("incident_id"))).alias("rank"), "incident_id", "incident_date", "zone_id", lists.alias("lists")),
        "news": a.statements,
        "context": a.spark.range(1).select(F.lit(ELECTION).alias("next_election"), F.greatest(F.lit(0), a.months_left.cast("int")).alias("months_to_election")),
    }


@query
def analysis_document_whole(spark: SparkSession, d: str) -> DataFrame:
    """All of document_parts, read back from its JSON: part, place, key and n of each row."""
    doc = entity.checkpointed(sinks.analysis_document(document_parts(Analysis(spark, d))))
    read = (
        ("overview", "highest_zone", "documented"), ("zones", "zone_name", "documented"), ("regions", "region_name", "zones"), ("vehicles", "status", "n"), ("alerts", "title", "rank"), ("weights", "component", None),
        ("series", "month", "ed"), ("anomalies", "month", "ed"), ("coded", "month", "events"), ("incidents", "incident_date", "incident_id"), ("news", None, "last7d"), ("context", "next_election", "months_to_election"), ("clusters", "names", "observed"),
    )
    parts = []
    for part, key, n in read:
        schema = ", ".join(([f"{key} string"] if key else []) + ([f"{n} long"] if n else []))
        got = sinks.document_part(doc, part, schema)
        parts.append(got.select(F.lit(part).alias("part"), "place", (F.col(key) if key else F.lit(None).cast("string")).alias("key"), (F.col(n) if n else F.lit(None).cast("long")).alias("n")))
    return functools.reduce(DataFrame.unionAll, parts)


_DAY = "DATE '2001-08-02'"
_LEFT = f"date_diff('month', {_DAY}, DATE '{ELECTION}')"
_CODED = "SELECT strftime(week, '%Y-%m') AS month, CAST(sum(events) AS BIGINT) AS events, CAST(coalesce(sum(events) FILTER (WHERE sub_type = 'F'), 0) AS BIGINT) AS abductions, CAST(coalesce(sum(events) FILTER (WHERE event_type = 'R'), 0) AS BIGINT) AS vac_events FROM weekly GROUP BY ALL"
_STATEMENTS = "(SELECT last7d, last30d, prev4w / 4e0 AS weekly_baseline, (SELECT CAST(max(page_id) AS BIGINT) FROM pages) AS statements FROM sums)"
_BEFORE = f"""(SELECT (SELECT count(*) FROM incidents WHERE (in_mv OR in_ob) AND incident_date < {_DAY} - 7) AS documented, (SELECT CAST(max(page_id) AS BIGINT) - 10 FROM pages) AS statements,
        (SELECT CAST(coalesce(sum(events) FILTER (WHERE sub_type = 'F'), 0) AS BIGINT) FROM weekly w, (SELECT max(week) AS l FROM weekly) WHERE week < l - 7 AND week >= (SELECT max(week) FROM weekly WHERE week < l - 7) - 365) AS abductions)"""


def _signed(now: str, before: str) -> str:
    return f"CASE WHEN {now} > {before} THEN ' (+' || ({now} - {before}) || ' since the last digest)' WHEN {now} < {before} THEN ' (' || ({now} - {before}) || ' since the last digest)' ELSE '' END"


def _moved(label: str, k: str) -> str:
    return f"CASE WHEN o.{k} <> b.{k} THEN '{label} ' || b.{k} || ' -> ' || o.{k} END"


def _one_row(section: str, source: str, *texts: str, start: int = 0) -> str:
    """The texts that are not null as lines, numbered from start."""
    return f"SELECT '{section}' AS section, CAST(k + {start - 1} AS INTEGER) AS place, t[k] AS line FROM (SELECT t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT list_filter([{', '.join(texts)}], lambda x: x IS NOT NULL) AS t FROM {source}))"


def _many(section: str, source: str, text: str, order: str, most: int | None = None, start: int = 0) -> str:
    cut = f" WHERE i <= {most}" if most else ""
    return f"SELECT '{section}' AS section, CAST(i + {start - 1} AS INTEGER) AS place, line FROM (SELECT row_number() OVER (ORDER BY {order}) AS i, {text} AS line FROM {source}){cut}"


_CASE = "'- {} ' || hint || ' (' || corroboration || ' outlets, ' || latest_pub_date || ')'"
_DIGEST = " UNION ALL ".join(
    (
        _one_row(
            "numbers",
            f"ov o, {_BEFORE} b LEFT JOIN (SELECT * FROM trail12 WHERE z >= 2 ORDER BY z DESC, month LIMIT 1) s ON true",
            f"'- **' || o.documented || ' incidents on record**' || {_signed('o.documented', 'b.documented')} || ', ' || o.located || ' of them with a place.'",
            "CASE WHEN o.estimable THEN '- Two lists together: about ' || o.estimated || ' incidents, ' || printf('%.2f', o.factor) || ' for each on record.' ELSE '- No estimate: the lists share ' || o.overlap || ' records.' END",
            "'- Zones: ' || o.critical || ' critical, ' || o.elevated || ' elevated. Highest: ' || o.highest_zone || ' at ' || printf('%.1f', o.highest_index) || '.'",
            f"'- Weekly aggregates of twelve months: ' || o.abductions || ' abductions' || {_signed('o.abductions', 'b.abductions')} || ', ' || o.vac_events || ' attacks on civilians.'",
            "'- ' || s.month || ' stands out: ' || s.ed || ' cases, ' || printf('%.1f', floor(s.mean * 10 + 0.5) / 10) || ' a month before (z ' || printf('%.1f', floor(s.z * 10 + 0.5) / 10) || ').'",
        ),
        _one_row(
            "moved",
            f"(SELECT o.documented, o.abductions, n.* FROM ov o, {_STATEMENTS} n) o, {_BEFORE} b",
            "'- Articles: ' || last30d || ' in thirty days, ' || last7d || ' in seven, ' || printf('%.1f', floor(weekly_baseline * 10 + 0.5) / 10) || ' in a usual week.'",
            "CASE WHEN o.statements > b.statements THEN '- ' || (o.statements - b.statements) || ' new statements, up to number ' || o.statements || '.' ELSE '- No new statement after number ' || o.statements || '.' END",
            f"coalesce('- Moved: ' || nullif(concat_ws('; ', {_moved('incidents', 'documented')}, {_moved('abductions', 'abductions')}, {_moved('statements', 'statements')}), '') || '.', '- No total moved.')",
        ),
        _one_row(
            "queue",
            "(SELECT count_if(status = 'promoted') AS p, count_if(status = 'duplicate') AS d, count_if(status = 'pending') AS w, count_if(status = 'ready') AS r FROM queue)",
            "'Promoted so far: ' || p || ', held out as already known: ' || d || ', waiting for a second source: ' || w || '.'",
            "'**' || r || ' ready**: two or more outlets agree, a person has yet to confirm.'",
        ),
        _many("queue", "queue WHERE status = 'ready'", _CASE.format("ready:"), "latest_pub_date DESC, case_id", 6, 10),
        "SELECT 'queue', 10, '- Nothing is ready.' FROM (SELECT count_if(status = 'ready') AS n FROM queue) WHERE n = 0",
        _many("queue", f"queue WHERE status = 'promoted' AND promoted_on BETWEEN {_DAY} - 7 AND {_DAY}", _CASE.format("promoted:"), "promoted_on DESC, case_id", 6, 20),
        _many("queue", f"queue WHERE status = 'pending' AND latest_pub_date >= {_DAY} - 9", _CASE.format("lead:"), "latest_pub_date DESC, case_id", 8, 30),
        _many("alerts", "feed_places WHERE severity IN ('critical', 'elevated')", "'- **' || upper(severity) || '** ' || title", "place", 20),
        "SELECT 'alerts', 0, '- None at action level.' FROM (SELECT count_if(severity IN ('critical', 'elevated')) AS n FROM feed_places) WHERE n = 0",
        f"SELECT 'clock', 0, {_LEFT} || ' months to the next election.'",
    )
)
_TITLES = {"numbers": "The numbers", "moved": "What moved", "queue": "The curators'' queue", "alerts": "Alerts to act on", "clock": "The election clock"}
_TEXT = "SELECT concat('# Weekly digest', chr(10), chr(10), string_agg(b, chr(10) ORDER BY r)) AS text FROM (SELECT CASE section " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(_TITLES)) + " END AS r, concat('## ', CASE section " + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in _TITLES.items()) + f" END, chr(10), chr(10), string_agg(line, chr(10) ORDER BY place), chr(10)) AS b FROM ({_DIGEST}) GROUP BY section)"
_BRIEF = " UNION ALL ".join(
    (
        _one_row(
            "overview",
            "ov",
            "documented || ' incidents on record, ' || located || ' with a place and ' || unlocated || ' without; estimated ' || estimated || ', factor ' || printf('%.2f', factor) || '.'",
            "'Lists of ' || n_a || ' and ' || n_b || ' records, ' || overlap || ' in both; captured ' || printf('%.1f', capture_a) || ' and ' || printf('%.1f', capture_b) || ' percent.'",
            "zones || ' zones: ' || critical || ' critical, ' || elevated || ' elevated, ' || watch || ' watched.'",
            "abductions || ' abductions and ' || vac_events || ' attacks on civilians in the weekly aggregates of twelve months.'",
            "'Weights: eb_pct 0.3, mse_pct 0.16, cluster_score 0.28, acled_recent 0.1, ucdp_baseline 0.0, temporal_score 0.1, vehicle_score 0.06.'",
        ),
        _many(
            "zones",
            "index_table i JOIN anomaly a USING (zone_id) LEFT JOIN top_circle t ON list_contains(t.members, i.zone_id)",
            """zone_name || ' (' || region_name || '): index ' || printf('%.1f', ix) || ', ' || band || ', ' || confidence || ' confidence; ' || documented || ' incidents, smoothed rate ' || printf('%.2f', floor(eb_rate * 100 + 0.5) / 100)
            || '; ' || abductions || ' abductions, ' || vac_events || ' attacks; ' || CASE WHEN t.rr IS NULL THEN 'no cluster' ELSE 'cluster ' || printf('%.2f', floor(t.rr * 100 + 0.5) / 100) END
            || '; z ' || printf('%.2f', floor(a.z * 100 + 0.5) / 100) || CASE WHEN vehicle_score > 0 THEN '; vehicle seen' ELSE '' END || '.'""",
            "ix DESC, i.zone_id",
        ),
        "SELECT 'clusters', 0, 'No cluster.'",
        _one_row("vehicles", "(SELECT count_if(status = 'flagged') AS f, count_if(status = 'monitoring') AS m FROM patterns)", "f || ' patterns flagged, ' || m || ' watched, 0 cleared.'"),
        _many("vehicles", "patterns p JOIN (SELECT vehicle_key AS v, max(us) AS us FROM sightings GROUP BY ALL) ON v = vehicle_key", "'Vehicle ' || vehicle_key || ': ' || status || ', ' || n || ' sightings in ' || len(zones) || ' zones, ' || overlap || ' incidents near, last on ' || CAST(make_timestamp(us) AS DATE) || '.'", "status, n DESC, vehicle_key", 8, 1),
        _one_row("alerts", "(SELECT count(*) AS n, count_if(severity = 'critical') AS c, count_if(severity = 'elevated') AS e, count_if(severity = 'watch') AS w, count_if(severity = 'info') AS i FROM feed)", "n || ' alerts: ' || c || ' critical, ' || e || ' elevated, ' || w || ' watch, ' || i || ' info.'"),
        _many("alerts", "feed_places", "'[' || severity || '] ' || title", "place", 12, 1),
        _many("months", "trail12", "month || ': ' || ed || ' cases, ' || printf('%.1f', floor(mean * 10 + 0.5) / 10) || ' before, z ' || printf('%.2f', floor(z * 100 + 0.5) / 100) || CASE WHEN z >= 2 THEN ', flagged' ELSE '' END || '.'", "month"),
        _many("coded", f"(SELECT * FROM ({_CODED}) ORDER BY month DESC LIMIT 12)", "month || ': ' || abductions || ' abductions, ' || vac_events || ' attacks.'", "month"),
        _one_row("news", _STATEMENTS, "'Articles, which are no incidents: ' || last7d || ' in seven days, ' || last30d || ' in thirty, ' || printf('%.1f', floor(weekly_baseline * 10 + 0.5) / 10) || ' in a usual week.'"),
        f"SELECT 'clock', 0, {_LEFT} || ' months to the next election.'",
    )
)


def _part(part: str, source: str, key: str, n: str, order: str) -> str:
    return f"SELECT '{part}' AS part, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS place, CAST({key} AS VARCHAR) AS key, CAST({n} AS BIGINT) AS n FROM {source}"


_WHOLE = " UNION ALL ".join(
    (
        _part("overview", "ov", "highest_zone", "documented", "1"),
        _part("zones", "index_table", "zone_name", "documented", "zone_id"),
        _part("regions", "(SELECT region_name, count(*) AS n FROM index_table GROUP BY ALL)", "region_name", "n", "region_name"),
        _part("vehicles", "patterns WHERE n >= 8", "status", "n", "vehicle_key"),
        _part("alerts", "feed_places", "title", "place", "place"),
        _part("weights", "(SELECT unnest(['eb_pct', 'mse_pct', 'cluster_score', 'acled_recent', 'ucdp_baseline', 'temporal_score', 'vehicle_score']) AS c)", "c", "NULL", "c"),
        _part("series", "(SELECT * FROM national ORDER BY month DESC LIMIT 30)", "month", "ed", "month"),
        _part("anomalies", "trail12", "month", "ed", "month"),
        _part("coded", f"({_CODED})", "month", "events", "month"),
        _part("incidents", f"(SELECT * FROM incidents WHERE incident_date < {_DAY} ORDER BY incident_date DESC, incident_id DESC LIMIT 40)", "incident_date", "incident_id", "incident_date DESC, incident_id DESC"),
        _part("news", "sums", "NULL", "last7d", "1"),
        f"SELECT 'context', 0, '{ELECTION}', {_LEFT}",
    )
)

SQL = {
    "analysis_overview": sql("SELECT * FROM ov", "ov"),
    "weekly_digest": sql(_DIGEST, "ov", "trail12", "sums", "weekly", "incidents", "queue", "feed_places"),
    "weekly_digest_text": sql(_TEXT, "ov", "trail12", "sums", "weekly", "incidents", "queue", "feed_places"),
    "digest_state": sql(f"SELECT {_DAY} AS day, documented, estimated, abductions, vac_events, critical, elevated, statements, last7d FROM ov, {_STATEMENTS}", "ov", "sums"),
    "analysis_brief": sql(_BRIEF, "ov", "index_table", "anomaly", "top_circle", "patterns", "sightings", "feed", "feed_places", "trail12", "weekly", "sums"),
    "analysis_document_whole": sql(_WHOLE, "ov", "index_table", "patterns", "feed_places", "national", "trail12", "weekly", "incidents", "sums"),
}
