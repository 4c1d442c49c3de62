"""Reports for readers: the overview in one row, the weekly digest and the brief as one row per line. Zones and totals, never persons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import half_up
from .risk import SEVERITIES, WEIGHTS


def overview(zones: DataFrame, incidents: DataFrame, estimate: DataFrame, patterns: DataFrame, alerts: DataFrame, clusters: int = 0) -> DataFrame:
    """One row of totals, whatever is empty: incidents with and without a place, the estimate, what each list captured (percent of all), bands, the highest zone, burden, patterns, alerts above info.

    zones: an index with zone_name, index, band, abductions, vac_events; incidents: rows of zone_id, in_mv, in_ob and n (how many they stand for);
    estimate: one row of chapman_point; patterns: vehicle_key, status. Each part is summed to one row before it meets the others.
    """
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    known = incidents.where("in_mv OR in_ob").agg(total(F.lit(True)).alias("documented"), total(F.col("zone_id").isNotNull()).alias("located"), total(F.col("in_mv")).alias("_a"), total(F.col("in_ob")).alias("_b"))
    share = lambda c: F.when(F.col("documented") > 0, half_up(F.col(c) / F.col("documented") * 100, 1)).otherwise(F.lit(0.0))
    known = known.select("documented", "located", (F.col("documented") - F.col("located")).alias("unlocated"), share("_a").alias("capture_a"), share("_b").alias("capture_b"))
    best = F.max_by(F.struct("zone_name", "index"), F.struct("index", -F.col("zone_id")))
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    places = zones.agg(F.count("*").alias("zones"), F.count_if(F.col("band") == "critical").alias("critical"), F.count_if(F.col("band") == "elevated").alias("elevated"), F.count_if(F.col("band") == "watch").alias("watch"), best.alias("_top"), sums("abductions"), sums("vac_events"))
    places = places.select("*", F.coalesce("_top.zone_name", F.lit("-")).alias("highest_zone"), F.coalesce("_top.index", F.lit(0.0)).alias("highest_index")).drop("_top")
    seen = patterns.agg(F.count("*").alias("patterns"), F.count_if(F.col("status") == "flagged").alias("flagged_patterns"))
    raised = alerts.agg(F.count("*").alias("alerts"), F.count_if(F.col("severity") != "info").alias("active_alerts"))
    guess = estimate.select("n_a", "n_b", "overlap", F.col("chapman").isNotNull().alias("estimable"), F.coalesce(F.floor(F.col("chapman") + 0.5), "documented").cast("long").alias("estimated"), half_up("factor", 2).alias("factor"))
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [known, guess, places, seen, raised])  # one row each
    return row.withColumn("clusters", F.lit(clusters).cast("long"))


def _say(*parts: str | Column) -> Column:
    """The parts as one text; a null part is empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _one(x: Column | str) -> Column:
    return F.format_string("%.1f", F.col(x) if isinstance(x, str) else x)


def _two(x: Column | str) -> Column:
    return F.format_string("%.2f", F.col(x) if isinstance(x, str) else x)


def _change(now: str, before: str) -> Column:
    """' (+3 since the last digest)'; empty without a change or a figure before."""
    d = F.col(now) - F.col(before)
    return F.when(d != 0, _say(" (", F.when(d > 0, "+").otherwise(""), d, " since the last digest)")).otherwise("")


def _lines(df: DataFrame, section: str, *texts: Column) -> DataFrame:
    """section, place, line: the texts that are not null, from a frame of one row."""
    return df.select(F.lit(section).alias("section"), F.posexplode(F.array_compact(F.array(*texts))).alias("place", "line"))


def _listed(df: DataFrame, section: str, line: Column, order: list[Column | str], most: int | None, start: int = 0) -> DataFrame:
    """The first rows by order (all if most is None) as lines from place `start` on. Only what a reader sees is ordered as a whole."""
    first = df.orderBy(*order) if most is None else df.orderBy(*order).limit(most)
    return first.select(F.lit(section).alias("section"), (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("int").alias("place"), line.alias("line"))


def _or_none(lines: DataFrame, section: str, start: int, otherwise: str) -> DataFrame:
    """lines, or one line that there are none."""
    none = lines.agg(F.count("*").alias("_n")).where("_n = 0").select(F.lit(section).alias("section"), F.lit(start).alias("place"), F.lit(otherwise).alias("line"))
    return lines.unionAll(none)


def weekly_digest(now: DataFrame, previous: DataFrame, spikes: DataFrame, news: DataFrame, queue: DataFrame, alerts: DataFrame, months_left: Column, today: Column, fresh_days: int = 9) -> DataFrame:
    """section (numbers, moved, queue, alerts, clock), place (from 0), line: the weekly digest.

    now: overview; previous: one row or none of documented, abductions, statements at the last digest; spikes: month, ed, baseline, z, flagged;
    news: one row of last7d, last30d, weekly_baseline, statements; queue: case_id, status, hint, corroboration, pub_date, latest_pub_date, promoted_on.
    Lists show the first few (6 ready, 6 promoted within a week, 8 pending within fresh_days, 20 alerts); counts are of all.
    """
    had = previous.select(F.col("documented").alias("_documented"), F.col("abductions").alias("_abductions"), F.col("statements").alias("_statements"))
    spike = spikes.where("flagged").agg(F.max_by(F.struct("month", "ed", "baseline", "z"), F.struct("z", F.expr("-unix_date(to_date(concat(month, '-01')))"))).alias("spike"))
    one = now.crossJoin(F.broadcast(spike)).crossJoin(F.broadcast(news)).join(F.broadcast(had), F.lit(True), "left")  # one row each
    c = F.col
    numbers = _lines(
        one,
        "numbers",
        _say("- **", c("documented"), " incidents on record**", _change("documented", "_documented"), ", ", c("located"), " of them with a place."),
        F.when(c("estimable"), _say("- Two lists together: about ", c("estimated"), " incidents, ", _two("factor"), " for each on record.")).otherwise(_say("- No estimate: the lists share ", c("overlap"), " records.")),
        _say("- Zones: ", c("critical"), " critical, ", c("elevated"), " elevated. Highest: ", c("highest_zone"), " at ", _one("highest_index"), "."),
        _say("- Weekly aggregates of twelve months: ", c("abductions"), " abductions", _change("abductions", "_abductions"), ", ", c("vac_events"), " attacks on civilians."),
        F.when(c("spike.month").isNotNull(), _say("- ", c("spike.month"), " stands out: ", c("spike.ed"), " cases, ", _one(half_up("spike.baseline", 1)), " a month before (z ", _one(half_up("spike.z", 1)), ").")),
    )
    step = lambda label, k: F.when(c(k) != c(f"_{k}"), _say(label, " ", c(f"_{k}"), " -> ", c(k)))
    steps = F.array_compact(F.array(step("incidents", "documented"), step("abductions", "abductions"), step("statements", "statements")))
    moved = _lines(
        one,
        "moved",
        _say("- Articles: ", c("last30d"), " in thirty days, ", c("last7d"), " in seven, ", _one(half_up("weekly_baseline", 1)), " in a usual week."),
        F.when(c("statements") > c("_statements"), _say("- ", c("statements") - c("_statements"), " new statements, up to number ", c("statements"), ".")).otherwise(_say("- No new statement after number ", c("statements"), ".")),
        F.when(c("_documented").isNull(), F.lit("- First digest: nothing to compare with.")).when(F.size(steps) > 0, _say("- Moved: ", F.array_join(steps, "; "), ".")).otherwise("- No total moved."),
    )
    of = lambda s: F.count_if(c("status") == s).alias(s)
    counts = queue.agg(of("promoted"), of("duplicate"), of("pending"), of("ready"))
    head = _lines(
        counts,
        "queue",
        _say("Promoted so far: ", c("promoted"), ", held out as already known: ", c("duplicate"), ", waiting for a second source: ", c("pending"), "."),
        _say("**", c("ready"), " ready**: two or more outlets agree, a person has yet to confirm."),
    )
    newest = [F.desc("latest_pub_date"), c("case_id")]
    entry = lambda word: _say("- ", word, " ", c("hint"), " (", c("corroboration"), " outlets, ", c("latest_pub_date"), ")")
    ready = _or_none(_listed(queue.where("status = 'ready'"), "queue", entry("ready:"), newest, 6, 10), "queue", 10, "- Nothing is ready.")
    promoted = _listed(queue.where((c("status") == "promoted") & (c("promoted_on") >= F.date_sub(today, 7)) & (c("promoted_on") <= today)), "queue", entry("promoted:"), [F.desc("promoted_on"), c("case_id")], 6, 20)
    pending = _listed(queue.where((c("status") == "pending") & (c("latest_pub_date") >= F.date_sub(today, fresh_days))), "queue", entry("lead:"), newest, 8, 30)
    acute = alerts.where(c("severity").isin(*SEVERITIES[:2]))
    raised = _or_none(_listed(acute, "alerts", _say("- **", F.upper("severity"), "** ", c("title")), [c("place")], 20), "alerts", 0, "- None at action level.")
    clock = _lines(now, "clock", _say(F.greatest(F.lit(0), months_left.cast("int")), " months to the next election."))
    return reduce(DataFrame.unionAll, [numbers, moved, head, ready, promoted, pending, raised, clock])


#: What stands over each section, in order.
HEADINGS = {"numbers": "The numbers", "moved": "What moved", "queue": "The curators' queue", "alerts": "Alerts to act on", "clock": "The election clock"}


def as_markdown(lines: DataFrame, title: str) -> DataFrame:
    """text: the digest as one document; lines of a section stand in order of place."""
    rank = F.array_position(F.array(*map(F.lit, HEADINGS)), F.col("section"))
    grouped = lines.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls"))
    heading = F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv))[F.col("section")]
    block = F.concat(F.lit("## "), heading, F.lit("\n\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n"))
    parts = grouped.select(F.struct(rank.alias("r"), block.alias("b")).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return parts.select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("ps", lambda x: x["b"]), "\n")).alias("text"))


def digest_state(now: DataFrame, news: DataFrame, today: Column) -> DataFrame:
    """One row to keep for the next digest, with the names that weekly_digest compares."""
    return now.crossJoin(F.broadcast(news.select("last7d", "statements"))).select(today.alias("day"), "documented", "estimated", "abductions", "vac_events", "critical", "elevated", "statements", "last7d")  # one row each


def analysis_brief(now: DataFrame, zones: DataFrame, clusters: DataFrame, patterns: DataFrame, alerts: DataFrame, recent: DataFrame, months: DataFrame, news: DataFrame, months_left: Column, forecasts: DataFrame | None = None) -> DataFrame:
    """section, place, line: the flat text that an analyst is asked about.

    now: overview; zones: an index; clusters: names (a text), rr, p, observed, expected, radius_km, already those to report; patterns: vehicle_key, n, zones,
    overlap, status, confidence, last_seen; alerts: a feed; recent: month, ed, baseline, z, flagged; months: month, abductions, vac_events, the last twelve are shown;
    news: one row of window sums; forecasts: month, mean, lower95, upper95 of the nation. Every zone has a line; eight patterns and twelve alerts are named, all are counted.
    """
    c = F.col
    head = _lines(
        now,
        "overview",
        _say(c("documented"), " incidents on record, ", c("located"), " with a place and ", c("unlocated"), " without; estimated ", c("estimated"), ", factor ", _two("factor"), "."),
        _say("Lists of ", c("n_a"), " and ", c("n_b"), " records, ", c("overlap"), " in both; captured ", _one("capture_a"), " and ", _one("capture_b"), " percent."),
        _say(c("zones"), " zones: ", c("critical"), " critical, ", c("elevated"), " elevated, ", c("watch"), " watched."),
        _say(c("abductions"), " abductions and ", c("vac_events"), " attacks on civilians in the weekly aggregates of twelve months."),
        _say("Weights: ", ", ".join(f"{k} {w}" for k, w in WEIGHTS.items()), "."),
    )
    place = _say(c("zone_name"), " (", c("region_name"), "): index ", _one("index"), ", ", c("band"), ", ", c("confidence"), " confidence; ", c("documented"), " incidents, smoothed rate ", _two(half_up("eb_rate", 2)), "; ", c("abductions"), " abductions, ", c("vac_events"), " attacks; ", F.when(c("rr").isNull(), "no cluster").otherwise(_say("cluster ", _two(half_up("rr", 2)))), "; z ", _two("z"), F.when(c("vehicle"), "; vehicle seen").otherwise(""), ".")
    each = _listed(zones, "zones", place, [F.desc("index"), c("zone_id")], None)
    p = F.when(c("p") < 0.001, F.lit("below 0.001")).otherwise(F.format_string("%.3f", c("p")))
    found = _or_none(_listed(clusters, "clusters", _say(c("names"), ": ratio ", _two(half_up("rr", 2)), ", p ", p, ", ", c("observed"), " seen, ", _one(half_up("expected", 1)), " expected, within ", c("radius_km"), " km."), [F.desc("rr"), c("names")], None), "clusters", 0, "No cluster.")
    of = lambda s: F.count_if(c("status") == s).alias(s)
    seen = _lines(patterns.agg(of("flagged"), of("monitoring"), of("cleared")), "vehicles", _say(c("flagged"), " patterns flagged, ", c("monitoring"), " watched, ", c("cleared"), " cleared."))
    named = _listed(patterns.where("status <> 'cleared'"), "vehicles", _say("Vehicle ", c("vehicle_key"), ": ", c("status"), ", ", c("n"), " sightings in ", F.size("zones"), " zones, ", c("overlap"), " incidents near, last on ", F.to_date("last_seen"), "."), [c("status"), F.desc("n"), c("vehicle_key")], 8, 1)
    counts = _lines(alerts.agg(F.count("*").alias("_n"), *(F.count_if(c("severity") == s).alias(s) for s in SEVERITIES)), "alerts", _say(c("_n"), " alerts: ", *(x for s in SEVERITIES for x in (c(s), f" {s}" + ("." if s == SEVERITIES[-1] else ", ")))))
    titles = _listed(alerts, "alerts", _say("[", c("severity"), "] ", c("title")), [c("place")], 12, 1)
    flags = _listed(recent, "months", _say(c("month"), ": ", c("ed"), " cases, ", _one(half_up("baseline", 1)), " before, z ", _two(half_up("z", 2)), F.when(c("flagged"), ", flagged").otherwise(""), "."), [c("month")], None)
    last = months.orderBy(F.desc("month")).limit(12)
    coded = _listed(last, "coded", _say(c("month"), ": ", c("abductions"), " abductions, ", c("vac_events"), " attacks."), [c("month")], None)
    press = _lines(news, "news", _say("Articles, which are no incidents: ", c("last7d"), " in seven days, ", c("last30d"), " in thirty, ", _one(half_up("weekly_baseline", 1)), " in a usual week."))
    clock = _lines(now, "clock", _say(F.greatest(F.lit(0), months_left.cast("int")), " months to the next election."))
    parts = [head, each, found, seen, named, counts, titles, flags, coded, press, clock]
    if forecasts is not None:
        parts.append(_listed(forecasts, "forecast", _say(c("month"), ": ", _one(half_up("mean", 1)), " expected, ", _one(half_up("lower95", 1)), " to ", _one(half_up("upper95", 1)), "."), [c("month")], None))
    return reduce(DataFrame.unionAll, parts)
