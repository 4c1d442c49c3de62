"""DuckDB SQL twins of the queries, written independently of the operators. Input views are common table expressions."""

from __future__ import annotations

CTE: dict[str, str] = {
    "zones": """SELECT n.n_nationkey AS zone_id, n.n_name AS zone_name, r.r_name AS region_name, 10000 * (1 + count(c.c_custkey)) AS population,
        -4e0 + 0.85e0 * (n.n_nationkey % 5) AS lat, 34e0 + 0.85e0 * floor(n.n_nationkey / 5e0) AS lng
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY ALL""",
    "incidents": """SELECT o.o_orderkey AS incident_id, CAST(o.o_orderdate AS DATE) AS incident_date,
        CASE WHEN o.o_orderkey % 20 = 0 THEN NULL ELSE c.c_nationkey END AS zone_id,
        o.o_orderpriority IN ('1-URGENT','2-HIGH') AS in_mv, o.o_orderstatus = 'F' AS in_ob, o.o_orderkey % 7 = 0 AS in_mort
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        WHERE o.o_orderpriority IN ('1-URGENT','2-HIGH') OR o.o_orderstatus = 'F' OR o.o_orderkey % 7 = 0""",
    "recent": "SELECT incident_id, DATE '2024-01-01' + CAST(incident_id % 45 AS INTEGER) AS d, zone_id FROM incidents WHERE zone_id IS NOT NULL",
    "weekly": """SELECT CAST(date_trunc('week', l.l_shipdate) AS DATE) AS week, s.s_nationkey AS zone_id, l.l_returnflag AS event_type, l.l_linestatus AS sub_type,
        count(*) AS events, CAST(sum(l.l_linenumber) AS BIGINT) AS fatalities
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY ALL""",
    "sightings": "SELECT event_id AS sighting_id, epoch_us(ts) AS us, user_id AS vehicle_key, CAST(event_id % 25 AS INTEGER) AS zone_id FROM events WHERE event_type IN ('view', 'click')",
    "headlines": "SELECT doc_id, text AS title, source, CAST(doc_id % 60 AS INTEGER) AS age_days FROM documents",
    "er": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS list, p_partkey AS record_id, concat(p_name, ' ', lower(p_type)) AS name, p_brand AS county, CAST((p_partkey * 17) % 365 AS INTEGER) AS day_no FROM part",
    "edges": """SELECT z.zone_id, 0 AS ring, e.seq, z.lng + 0.4e0 * e.ax AS x1, z.lat + 0.4e0 * e.ay AS y1, z.lng + 0.4e0 * e.bx AS x2, z.lat + 0.4e0 * e.by_ AS y2
        FROM (SELECT n_nationkey AS zone_id, -4e0 + 0.85e0 * (n_nationkey % 5) AS lat, 34e0 + 0.85e0 * floor(n_nationkey / 5e0) AS lng FROM nation) z
        CROSS JOIN (VALUES (1,-1,-1,1,-1),(2,1,-1,1,1),(3,1,1,-1,1),(4,-1,1,-1,-1)) AS e(seq,ax,ay,bx,by_)""",
    "points": "SELECT event_id AS point_id, 33.2e0 + (event_id * 37 % 500) / 100e0 AS lng, -4.8e0 + (event_id * 91 % 450) / 100e0 AS lat FROM events",
    "counts": """SELECT z.zone_id, z.zone_name, z.region_name, z.population, count(i.incident_id) AS documented, count_if(i.in_mv) AS n_mv, count_if(i.in_ob) AS n_ob, count_if(i.in_mort) AS n_mort
        FROM zones z LEFT JOIN incidents i ON i.zone_id = z.zone_id GROUP BY ALL""",
    "prior": """SELECT r, least(r * r / greatest(vo - r * (n - 1) / p, 1e-12), 1e6) AS a FROM (
        SELECT *, (SELECT sum(k.population * power(k.documented / k.population - t.r, 2)) FROM counts k) / p AS vo
        FROM (SELECT sum(documented) / sum(population) AS r, sum(population) AS p, count(*) AS n FROM counts) t)""",
    "eb": """SELECT c.*, (c.documented + a) / (c.population + a / r) AS pm, sqrt(c.documented + a) / (c.population + a / r) AS ps FROM counts c CROSS JOIN prior""",
    "rates": """SELECT zone_id, zone_name, documented, population, floor(documented / population * 1e5 * 1e6 + 0.5) / 1e6 AS crude_rate,
        floor(pm * 1e5 * 1e6 + 0.5) / 1e6 AS eb_rate, floor(greatest(0, pm - 1.96 * ps) * 1e5 * 1e6 + 0.5) / 1e6 AS eb_lo, floor((pm + 1.96 * ps) * 1e5 * 1e6 + 0.5) / 1e6 AS eb_hi FROM eb""",
    "panel": """SELECT zone_id, month, CAST(sum(events) AS BIGINT) AS events FROM (
        SELECT zone_id, strftime(incident_date, '%Y-%m') AS month, count(*) AS events FROM incidents WHERE zone_id IS NOT NULL AND strftime(incident_date, '%Y-%m') < '1999-01' GROUP BY ALL
        UNION ALL SELECT zone_id, strftime(week, '%Y-%m'), sum(events) FROM weekly WHERE strftime(week, '%Y-%m') >= '1999-01' AND strftime(week, '%Y-%m') <= '{last}' GROUP BY ALL) GROUP BY ALL""",
    "grid": """SELECT z.zone_id, m.month, CAST(m.mi AS INTEGER) AS mi, coalesce(p.events, 0) AS events, p.events IS NOT NULL AS present
        FROM (SELECT DISTINCT zone_id FROM panel) z CROSS JOIN (SELECT month, row_number() OVER (ORDER BY month) - 1 AS mi FROM (SELECT DISTINCT month FROM panel)) m
        LEFT JOIN panel p ON p.zone_id = z.zone_id AND p.month = m.month""",
    "feats": """SELECT *, coalesce(lag(events) OVER w, events) AS lag1, avg(events) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean3, avg(events) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS mean6,
        coalesce(avg(events) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 0) AS prev3,
        2 * pi() * CAST(substring(month, 6, 2) AS INTEGER) / 12 AS ang,
        CASE WHEN present AND lead(present) OVER w THEN lead(events) OVER w END AS target FROM grid WINDOW w AS (PARTITION BY zone_id ORDER BY mi)""",
    "burden": """SELECT zone_id, sum(events) AS events, coalesce(sum(events) FILTER (WHERE sub_type = 'F'), 0) AS abductions, coalesce(sum(events) FILTER (WHERE event_type = 'R'), 0) AS vac_events
        FROM weekly WHERE week >= (SELECT max(week) FROM weekly) - 365 GROUP BY zone_id""",
    "burden_rates": """SELECT z.zone_id, CAST(coalesce(events, 0) AS BIGINT) AS events, CAST(coalesce(abductions, 0) AS BIGINT) AS abductions, CAST(coalesce(vac_events, 0) AS BIGINT) AS vac_events,
        CAST(coalesce(3 * abductions + vac_events, 0) AS BIGINT) AS burden, floor(coalesce(3 * abductions + vac_events, 0) / (z.population / 1e5) * 1e6 + 0.5) / 1e6 AS burden_rate FROM zones z LEFT JOIN burden b USING (zone_id)""",
    "burden_pct": """SELECT *, (rank() OVER (ORDER BY burden_rate) - 1 + (count(*) OVER (PARTITION BY burden_rate) - 1) / 2e0) / (count(*) OVER () - 1) AS pct FROM burden_rates""",
    "national": "SELECT strftime(incident_date, '%Y-%m') AS month, count(*) AS ed FROM incidents WHERE incident_date < DATE '2001-08-01' GROUP BY ALL",
    "trail12": """SELECT *, (ed - mean) / greatest(sd, 0.6) AS z FROM (SELECT month, ed, avg(ed) OVER w AS mean, stddev_samp(ed) OVER w AS sd, row_number() OVER (ORDER BY month) AS i, row_number() OVER (ORDER BY month DESC) AS back
        FROM national WINDOW w AS (ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE i > 12 AND back <= 3""",
    "ages": "SELECT zone_id, CAST(ceil(date_diff('day', incident_date, DATE '2001-08-02') / 90e0) AS INTEGER) - 1 AS b FROM incidents WHERE zone_id IS NOT NULL AND incident_date < DATE '2001-08-02'",
    "buckets": """SELECT z.zone_id, g.b, count(a.zone_id) AS n FROM zones z CROSS JOIN (SELECT unnest(range(6)) AS b) g LEFT JOIN ages a ON a.zone_id = z.zone_id AND a.b = g.b GROUP BY ALL""",
    "anomaly": """SELECT zone_id, current, mean, (current - mean) / greatest(sd, 0.6) AS z FROM (SELECT zone_id, CAST(coalesce(sum(n) FILTER (WHERE b = 0), 0) AS BIGINT) AS current, avg(n) FILTER (WHERE b > 0) AS mean, stddev_samp(n) FILTER (WHERE b > 0) AS sd FROM buckets GROUP BY zone_id)""",
    "pairs": """SELECT x.zone_id AS a, y.zone_id AS b, y.population, 2 * 6371e0 * asin(sqrt(least(1e0, power(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * power(sin(radians(y.lng - x.lng) / 2), 2)))) AS km FROM zones x CROSS JOIN zones y""",
    "circles": """SELECT arg_min(center, center * 1000 + radius_km) AS center, arg_min(radius_km, center * 1000 + radius_km) AS radius_km, members, any_value(population) AS population FROM (
        SELECT a AS center, CAST(r AS INTEGER) AS radius_km, list(b ORDER BY b) AS members, CAST(sum(population) AS BIGINT) AS population FROM pairs CROSS JOIN (SELECT unnest([40, 80, 130, 200, 280]) AS r) WHERE km <= r GROUP BY a, r)
        WHERE population <= 0.5 * (SELECT sum(population) FROM zones) GROUP BY members""",
    "scan": """SELECT center, radius_km, members, CAST(o AS BIGINT) AS observed, e AS expected, c, greatest(o / greatest(e, 1e-9) / greatest((c - o) / greatest(c - e, 1e-9), 1e-9), 1) AS rr, CASE WHEN o <= e THEN 0 ELSE o * ln(o / e) END AS llr FROM (
        SELECT k.center, k.radius_km, k.members, (SELECT sum(documented) FROM counts WHERE list_contains(k.members, zone_id)) AS o, k.population / (SELECT sum(population) FROM zones) * (SELECT sum(documented) FROM counts) AS e, (SELECT sum(documented) FROM counts) AS c FROM circles k)""",
    "ahead": "SELECT s.*, (SELECT count(*) FROM sightings t WHERE t.vehicle_key = s.vehicle_key AND t.us >= s.us AND t.us <= s.us + 3 * 86400000000) AS n FROM sightings s",
    "best": """SELECT vehicle_key, n, us AS start_us FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_key ORDER BY n DESC, us, sighting_id) AS k FROM ahead) WHERE k = 1""",
    "vehicle_zones": "SELECT vehicle_key, list_sort(list(DISTINCT zone_id)) AS zones, count(*) AS total FROM sightings GROUP BY vehicle_key",
    "patterns": """SELECT *, CASE WHEN n >= 4 AND overlap >= 1 THEN 'flagged' ELSE 'monitoring' END AS status, floor(least(0.85e0, 0.4e0 + 0.08e0 * least(n, 6) + 0.08e0 * least(overlap, 3)) * 100 + 0.5) / 100 AS confidence FROM (
        SELECT b.vehicle_key, b.n, b.start_us, v.zones, v.total, (SELECT count(*) FROM recent r WHERE list_contains(v.zones, r.zone_id) AND epoch_us(r.d) >= b.start_us // 1000000 * 1000000 - 3 * 86400000000 AND epoch_us(r.d) <= b.start_us // 1000000 * 1000000 + 6 * 86400000000) AS overlap
        FROM best b JOIN vehicle_zones v USING (vehicle_key))""",
    "factor": "SELECT CASE WHEN k >= 3 THEN ((a + 1) * (b + 1) / (k + 1) - 1) / d ELSE 1 END AS f FROM (SELECT count_if(in_mv) AS a, count_if(in_ob) AS b, count_if(in_mv AND in_ob) AS k, count(*) AS d FROM incidents WHERE in_mv OR in_ob)",
    "ranked": """SELECT *, (rank() OVER (ORDER BY eb_rate) - 1 + (count(*) OVER (PARTITION BY eb_rate) - 1) / 2e0) / (count(*) OVER () - 1) AS eb_pct,
        (rank() OVER (ORDER BY mse_rate) - 1 + (count(*) OVER (PARTITION BY mse_rate) - 1) / 2e0) / (count(*) OVER () - 1) AS mse_pct
        FROM (SELECT r.*, floor(documented * f / (population / 1e5) * 1e6 + 0.5) / 1e6 AS mse_rate FROM rates r CROSS JOIN factor)""",
    "top_circle": "SELECT * FROM scan WHERE llr > 0 ORDER BY floor(llr * 1e6 + 0.5) / 1e6 DESC, center, radius_km LIMIT 1",
    "seen_zones": "SELECT DISTINCT unnest(v.zones) AS zone_id FROM best b JOIN vehicle_zones v USING (vehicle_key) WHERE b.n >= 6",
    "index_parts": """SELECT r.zone_id, r.zone_name, z.region_name, r.documented, r.population, r.eb_rate, r.eb_pct, r.mse_pct, floor(b.pct * 1e6 + 0.5) / 1e6 AS acled_recent, b.abductions, b.vac_events,
        CASE WHEN t.center IS NULL THEN 0 ELSE least(1, greatest(0, (t.rr - 1) / 3e0)) END AS cluster_score, least(1, greatest(0, (floor(a.z * 100 + 0.5) / 100 - 1) / 2.5e0)) AS temporal_score,
        CASE WHEN s.zone_id IS NULL THEN 0e0 ELSE 1e0 END AS vehicle_score
        FROM ranked r JOIN zones z USING (zone_id) JOIN burden_pct b USING (zone_id) JOIN anomaly a USING (zone_id) LEFT JOIN top_circle t ON list_contains(t.members, r.zone_id) LEFT JOIN seen_zones s ON s.zone_id = r.zone_id""",
    "index_table": """SELECT *, CASE WHEN ix >= 75 THEN 'critical' WHEN ix >= 60 THEN 'elevated' WHEN ix >= 45 THEN 'watch' ELSE 'baseline' END AS band,
        CASE WHEN documented >= 8 THEN 'high' WHEN documented >= 3 OR abductions + vac_events >= 15 THEN 'medium' ELSE 'low' END AS confidence
        FROM (SELECT *, floor((0.3e0 * eb_pct + 0.16e0 * mse_pct + 0.28e0 * cluster_score + 0.1e0 * acled_recent + 0.1e0 * temporal_score + 0.06e0 * vehicle_score) * 1000 + 0.5) / 10 AS ix FROM index_parts)""",
    "folds": "SELECT * FROM (VALUES (0, DATE '1999-01-01', DATE '2001-01-01', DATE '2001-08-02'), (1, DATE '1999-01-01', DATE '2000-07-01', DATE '2001-08-02')) AS f(fold, since, cutoff, until)",
    "fold_counts": """SELECT f.fold, z.zone_id, z.population, count_if(d BETWEEN since AND cutoff) AS documented, count_if(d > cutoff AND d <= until) AS outcome, count_if(in_mort AND d BETWEEN DATE '1995-01-01' AND cutoff) AS deaths,
        count_if(d >= since AND date_diff('day', d, cutoff) BETWEEN 1 AND 90) AS b0,
        count_if(d >= since AND date_diff('day', d, cutoff) BETWEEN 91 AND 180) AS b1, count_if(d >= since AND date_diff('day', d, cutoff) BETWEEN 181 AND 270) AS b2, count_if(d >= since AND date_diff('day', d, cutoff) BETWEEN 271 AND 360) AS b3,
        count_if(d >= since AND date_diff('day', d, cutoff) BETWEEN 361 AND 450) AS b4, count_if(d >= since AND date_diff('day', d, cutoff) BETWEEN 451 AND 540) AS b5
        FROM zones z CROSS JOIN folds f LEFT JOIN (SELECT zone_id, incident_date AS d, in_mort FROM incidents) i ON i.zone_id = z.zone_id GROUP BY f.fold, z.zone_id, z.population""",
    "fold_factor": """SELECT fold, CASE WHEN k >= 3 THEN ((a + 1) * (b + 1) / (k + 1) - 1) / d ELSE 1 END AS f FROM (
        SELECT fold, count_if(in_mv) AS a, count_if(in_ob) AS b, count_if(in_mv AND in_ob) AS k, count_if(in_mv OR in_ob) AS d FROM folds JOIN incidents ON incident_date BETWEEN since AND cutoff GROUP BY fold)""",
    "fold_prior": """SELECT fold, r, least(r * r / greatest(sum(population * power(documented / population - r, 2)) / any_value(p) - r * (count(*) - 1) / any_value(p), 1e-12), 1e6) AS a
        FROM fold_counts JOIN (SELECT fold, sum(documented) / sum(population) AS r, sum(population) AS p FROM fold_counts GROUP BY fold) USING (fold) GROUP BY fold, r""",
    "fold_burden": """SELECT fold, zone_id, 3 * coalesce(sum(events) FILTER (WHERE sub_type = 'F'), 0) + coalesce(sum(events) FILTER (WHERE event_type = 'R'), 0) AS burden FROM folds JOIN weekly ON week BETWEEN cutoff - 365 AND cutoff GROUP BY fold, zone_id""",
    "fold_rates": """SELECT c.*, floor((documented + a) / (population + a / r) * 1e5 * 1e6 + 0.5) / 1e6 AS eb_rate, floor(documented * f / (population / 1e5) * 1e6 + 0.5) / 1e6 AS mse_rate,
        floor(coalesce(burden, 0) / (population / 1e5) * 1e6 + 0.5) / 1e6 AS burden_rate, floor(deaths / (population / 1e5) * 1e6 + 0.5) / 1e6 AS death_rate
        FROM fold_counts c JOIN fold_prior USING (fold) JOIN fold_factor USING (fold) LEFT JOIN fold_burden USING (fold, zone_id)""",
    "fold_scan": """SELECT fold, members, CASE WHEN o <= e THEN 0 ELSE o * ln(o / e) END AS llr, greatest(o / greatest(e, 1e-9) / greatest((c - o) / greatest(c - e, 1e-9), 1e-9), 1) AS rr, center, radius_km FROM (
        SELECT f.fold, k.members, k.center, k.radius_km, sum(n.documented) FILTER (WHERE list_contains(k.members, n.zone_id)) AS o, sum(n.documented) AS c, k.population / sum(n.population) * sum(n.documented) AS e
        FROM circles k CROSS JOIN folds f JOIN fold_counts n ON n.fold = f.fold GROUP BY f.fold, k.members, k.center, k.radius_km, k.population)""",
    "fold_best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY floor(llr * 1e6 + 0.5) / 1e6 DESC, center, radius_km) AS i FROM fold_scan) WHERE i = 1 AND llr > 0",
    "fold_parts": """SELECT r.fold, r.zone_id, {ranks}, CASE WHEN t.fold IS NULL THEN 0e0 ELSE floor(least(1, greatest(0, (t.rr - 1) / 3e0)) * 1e6 + 0.5) / 1e6 END AS cluster_score,
        floor(least(1, greatest(0, (floor((b0 - m) / greatest(s, 0.6) * 100 + 0.5) / 100 - 1) / 2.5e0)) * 1e6 + 0.5) / 1e6 AS temporal_score, CASE WHEN v.zone_id IS NULL THEN 0e0 ELSE 1e0 END AS vehicle_score, r.outcome
        FROM (SELECT *, (b1 + b2 + b3 + b4 + b5) / 5e0 AS m, sqrt((power(b1 - m, 2) + power(b2 - m, 2) + power(b3 - m, 2) + power(b4 - m, 2) + power(b5 - m, 2)) / 4) AS s FROM fold_rates) r
        LEFT JOIN fold_best t ON t.fold = r.fold AND list_contains(t.members, r.zone_id) LEFT JOIN seen_zones v ON v.zone_id = r.zone_id""",
    "daily": "SELECT DATE '2024-01-30' - CAST(g.k AS INTEGER) AS date, count(e.event_id) AS n FROM (SELECT unnest(range(45)) AS k) g LEFT JOIN events e ON e.event_type = 'error' AND CAST(e.ts AS DATE) = DATE '2024-01-30' - CAST(g.k AS INTEGER) GROUP BY ALL",
    "sums": "SELECT CAST(coalesce(sum(n) FILTER (WHERE date > DATE '2024-01-23'), 0) AS BIGINT) AS last7d, CAST(coalesce(sum(n) FILTER (WHERE date > DATE '2023-12-31'), 0) AS BIGINT) AS last30d, CAST(coalesce(sum(n) FILTER (WHERE date <= DATE '2024-01-23' AND date > DATE '2023-12-26'), 0) AS BIGINT) AS prev4w FROM daily",
    "strict": """SELECT doc_id, CASE WHEN regexp_matches(title, '(?i)\\bther\\b') THEN 'Thika' WHEN regexp_matches(title, '(?i)\\bthat\\b') THEN 'Nakuru' WHEN regexp_matches(title, '(?i)\\btion\\b') THEN 'Kisumu'
        WHEN regexp_matches(title, '(?i)\\bwith\\b') THEN 'Lamu' WHEN regexp_matches(title, '(?i)\\bfrom\\b') THEN 'Nyeri' WHEN regexp_matches(title, '(?i)\\bthis\\b') THEN 'Embu' END AS zone FROM headlines""",
    "scored": "SELECT value AS score, CAST(event_type = 'error' AS INTEGER) AS label, event_id % 97 AS other FROM events",
    "chap": "SELECT count_if(in_mv) AS n_a, count_if(in_ob) AS n_b, count_if(in_mv AND in_ob) AS overlap, count(*) AS documented FROM incidents WHERE in_mv OR in_ob",
    "feed": """SELECT 'zone-' || zone_id AS id, band AS severity, 'zone-risk' AS kind, zone_name || ', ' || region_name || ': ' || band || ' risk' AS title, confidence, 0 AS part, zone_name || ' in ' || region_name || ' stands at ' || printf('%.1f', ix) || ' points out of a hundred. The figure is about the place as a whole, never about a person.' AS message, CASE band WHEN 'critical' THEN 4 WHEN 'elevated' THEN 3 ELSE 2 END AS n_actions FROM index_table WHERE band <> 'baseline'
        UNION ALL SELECT 'vehicle-' || vehicle_key, 'info', 'vehicle', 'Vehicle ' || vehicle_key || ': repeated sightings', CASE WHEN confidence >= 0.8 THEN 'high' ELSE 'medium' END, 1, NULL, 2 FROM patterns WHERE n >= 8
        UNION ALL SELECT 'temporal-spike', 'elevated', 'zone-risk', 'National count unusually high in ' || month, 'high', 2, ed || ' cases in ' || month || ', where the twelve months before had ' || printf('%.1f', floor(mean * 10 + 0.5) / 10) || ' on average: ' || printf('%.1f', z) || ' standard deviations more.', 2 FROM (SELECT * FROM trail12 WHERE z >= 2 ORDER BY z DESC, month LIMIT 1)
        UNION ALL SELECT 'acled-corroboration', 'watch', 'zone-risk', CAST((SELECT sum(abductions) FROM burden) AS BIGINT) || ' abductions in the weekly aggregates of twelve months', 'medium', 3, NULL, 1
            FROM (SELECT sum(events) FILTER (WHERE sub_type = 'F') AS a FROM weekly WHERE strftime(week, '%Y-%m') = (SELECT max(strftime(week, '%Y-%m')) FROM weekly)) WHERE a > 0
        UNION ALL SELECT 'data-mse', 'info', 'data', 'Estimate of what is not reported', 'high', 4, NULL, 1 FROM chap
        UNION ALL SELECT 'news-watch', 'watch', 'data', last7d || ' matching articles in a week', 'medium', 5, NULL, 1 FROM sums WHERE last7d >= 10 AND last7d >= 1.5 * greatest(floor(prev4w / 4e0 * 10 + 0.5) / 10, 1)""",
    "feed_places": "SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'elevated' THEN 1 WHEN 'watch' THEN 2 ELSE 3 END, part, id) AS place FROM feed",
    "ov": """SELECT i.documented, located, i.documented - located AS unlocated, floor(n_a / i.documented * 1000 + 0.5) / 10 AS capture_a, floor(n_b / i.documented * 1000 + 0.5) / 10 AS capture_b, n_a, n_b, overlap, overlap >= 3 AS estimable,
        CAST(CASE WHEN overlap >= 3 THEN floor((n_a + 1) * (n_b + 1) / (overlap + 1) - 1 + 0.5) ELSE i.documented END AS BIGINT) AS estimated, floor(f * 100 + 0.5) / 100 AS factor, t.*, v.*, a.*
        FROM (SELECT count(*) AS documented, count(zone_id) AS located FROM incidents WHERE in_mv OR in_ob) i, (SELECT CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, CAST(overlap AS BIGINT) AS overlap FROM chap) c, factor,
        (SELECT count(*) AS zones, CAST(count_if(band = 'critical') AS BIGINT) AS critical, CAST(count_if(band = 'elevated') AS BIGINT) AS elevated, CAST(count_if(band = 'watch') AS BIGINT) AS watch, CAST(sum(abductions) AS BIGINT) AS abductions,
            CAST(sum(vac_events) AS BIGINT) AS vac_events, arg_max(zone_name, ix * 1000 - zone_id) AS highest_zone, max(ix) AS highest_index FROM index_table) t,
        (SELECT count(*) AS patterns, CAST(count_if(status = 'flagged') AS BIGINT) AS flagged_patterns FROM patterns) v, (SELECT count(*) AS alerts, CAST(count_if(severity <> 'info') AS BIGINT) AS active_alerts FROM feed) a""",
    "queue": """SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 10 < 5 THEN 'pending' WHEN o_orderkey % 10 < 7 THEN 'ready' WHEN o_orderkey % 10 < 9 THEN 'promoted' ELSE 'duplicate' END AS status, 'case of ' || lower(split_part(o_orderpriority, '-', 2)) AS hint,
        1 + o_orderkey % 4 AS corroboration, CAST(o_orderdate AS DATE) AS latest_pub_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS promoted_on FROM orders""",
}

CTE["fold_parts"] = CTE["fold_parts"].format(
    ranks=", ".join(
        f"floor((rank() OVER (PARTITION BY r.fold ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY r.fold, {v}) - 1) / 2e0) / (count(*) OVER (PARTITION BY r.fold) - 1) * 1e6 + 0.5) / 1e6 AS {n}"
        for v, n in (("eb_rate", "eb_pct"), ("mse_rate", "mse_pct"), ("burden_rate", "acled_recent"), ("death_rate", "ucdp_baseline"))
    )
)

NEEDS: dict[str, tuple[str, ...]] = {
    "recent": ("incidents",), "counts": ("zones", "incidents"), "prior": ("counts",), "eb": ("counts", "prior"), "rates": ("eb",),
    "panel": ("incidents", "weekly"), "grid": ("panel",), "feats": ("grid",), "burden": ("weekly",), "burden_rates": ("zones", "burden"), "burden_pct": ("burden_rates",),
    "national": ("incidents",), "trail12": ("national",), "ages": ("incidents",), "buckets": ("zones", "ages"), "anomaly": ("buckets",), "pairs": ("zones",), "circles": ("pairs", "zones"),
    "scan": ("circles", "counts", "zones"), "ahead": ("sightings",), "best": ("ahead",), "vehicle_zones": ("sightings",), "patterns": ("best", "vehicle_zones", "recent"), "factor": ("incidents",),
    "ranked": ("rates", "factor"), "top_circle": ("scan",), "seen_zones": ("best", "vehicle_zones"), "index_parts": ("ranked", "zones", "burden_pct", "anomaly", "top_circle", "seen_zones"),
    "fold_counts": ("zones", "folds", "incidents"), "fold_factor": ("folds", "incidents"), "fold_prior": ("fold_counts",), "fold_burden": ("folds", "weekly"), "fold_rates": ("fold_counts", "fold_prior", "fold_factor", "fold_burden"),
    "fold_scan": ("circles", "folds", "fold_counts"), "fold_best": ("fold_scan",), "fold_parts": ("fold_rates", "fold_best", "seen_zones"),
    "index_table": ("index_parts",), "sums": ("daily",), "strict": ("headlines",), "chap": ("incidents",), "feed": ("index_table", "patterns", "trail12", "burden", "weekly", "chap", "sums"),
    "feed_places": ("feed",), "ov": ("incidents", "chap", "factor", "index_table", "patterns", "feed"),
}


def sql(select: str, *needs: str, last: str = "9999-12") -> str:
    """select with the expressions it needs before it, each after those it needs itself."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n].format(last=last) if n == 'panel' else CTE[n]})" for n in order)
    return f"WITH RECURSIVE {body}\n{select}" if body else select


GRID = {"last": "2001-06"}


def m6(x: str, name: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6 AS {name}"


def midrank(v: str) -> str:
    return f"(rank() OVER (ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {v}) - 1) / 2e0) / (count(*) OVER () - 1)"


_PATTERNS = "SELECT concat_ws('+', CASE WHEN in_mv THEN '0' END, CASE WHEN in_ob THEN '1' END, CASE WHEN in_mort THEN '2' END) AS pattern, count(*) AS n FROM incidents GROUP BY ALL"
_SEVERITIES = "SELECT s AS severity, count(f.id) AS n FROM (SELECT unnest(['critical', 'elevated', 'watch', 'info']) AS s) LEFT JOIN feed f ON f.severity = s GROUP BY s"

#: The recurrence as a fold over each key's requests in order of time.
_LIMITED = """WITH k AS (SELECT event_type, list(event_id ORDER BY ts, event_id) AS ids, list({'t': epoch_us(ts), 'kept': CAST([] AS BIGINT[]), 'ok': CAST([] AS BOOLEAN[])} ORDER BY ts, event_id) AS xs FROM events GROUP BY event_type),
        r AS (SELECT event_type, ids, list_reduce(xs, lambda a, x: {'t': x.t, 'kept': list_filter(a.kept, lambda v: x.t - v < 3600000000) || CASE WHEN len(list_filter(a.kept, lambda v: x.t - v < 3600000000)) < 3 THEN [x.t] ELSE CAST([] AS BIGINT[]) END,
            'ok': a.ok || [len(list_filter(a.kept, lambda v: x.t - v < 3600000000)) < 3]}, {'t': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[]), 'ok': CAST([] AS BOOLEAN[])}) AS s FROM k)
        SELECT unnest(ids) AS request_id, event_type, unnest(s.ok) AS allowed FROM r"""

SQL: dict[str, str] = {
    "zone_risk_rates": sql(f"SELECT *, {m6(midrank('eb_rate'), 'eb_pct')} FROM rates", "rates"),
    "zone_counts_zero_filled": sql("SELECT zone_id, documented, CAST(n_mv AS BIGINT) AS n_mv, CAST(n_ob AS BIGINT) AS n_ob, CAST(n_mort AS BIGINT) AS n_mort FROM counts", "counts"),
    "located_counts": sql("SELECT count(zone_id) AS located, count(*) - count(zone_id) AS unlocated, CAST(count_if(in_mv AND in_ob) AS BIGINT) AS in_both, count(DISTINCT zone_id) AS n_zones FROM incidents", "incidents"),
    "window_filter": sql("SELECT zone_id, count(*) AS n, min(incident_date) AS first_date, max(incident_date) AS last_date FROM incidents WHERE incident_date BETWEEN DATE '2001-08-02' - 365 AND DATE '2001-08-02' GROUP BY zone_id", "incidents"),
    "zone_centroids_min_support": sql(f"SELECT z.zone_id, count(i.incident_id) AS n, {m6('CASE WHEN count(i.incident_id) >= 2 THEN avg(z.lat + i.incident_id % 7 / 100e0) ELSE -0.5 END', 'lat')}, {m6('CASE WHEN count(i.incident_id) >= 2 THEN avg(z.lng - i.incident_id % 5 / 100e0) ELSE 37.5 END', 'lng')} FROM zones z LEFT JOIN incidents i USING (zone_id) GROUP BY z.zone_id", "zones", "incidents"),
    "midrank_percentile": sql(f"SELECT zone_id, population, {m6(midrank('population'), 'pct')} FROM zones", "zones"),
    "documented_by_bias": sql(f"SELECT zone_id, documented, {m6('documented / sum(documented) OVER ()', 'share')}, CAST(row_number() OVER (ORDER BY documented DESC, zone_id) AS INTEGER) AS place FROM counts WHERE documented > 0", "counts"),
    "national_monthly_rollup": sql("SELECT strftime(week, '%Y-%m') AS month, CAST(sum(events) AS BIGINT) AS events, CAST(sum(fatalities) AS BIGINT) AS fatalities, CAST(coalesce(sum(events) FILTER (WHERE sub_type = 'F'), 0) AS BIGINT) AS abductions, CAST(coalesce(sum(events) FILTER (WHERE event_type = 'R'), 0) AS BIGINT) AS vac_events FROM weekly GROUP BY ALL", "weekly"),
    "trailing_365d_burden": sql("SELECT zone_id, events, abductions, vac_events, burden, burden_rate, floor(pct * 1e6 + 0.5) / 1e6 AS pct FROM burden_pct", "burden_pct"),
    "zone_month_panel": sql("SELECT zone_id, strftime(week, '%Y-%m') AS month, CAST(sum(events) AS BIGINT) AS events FROM weekly GROUP BY ALL", "weekly"),
    "panel_union": sql("SELECT * FROM panel", "panel"),
    "grid_filled": sql("SELECT * FROM grid", "grid", **GRID),
    "panel_features": sql(f"SELECT zone_id, month, events, lag1, {m6('mean3', 'mean3')}, {m6('mean6', 'mean6')}, {m6('mean3 - prev3', 'momentum')}, {m6('sin(ang)', 'month_sin')}, {m6('cos(ang)', 'month_cos')}, target FROM feats", "feats", **GRID),
    "label_p75": sql("SELECT zone_id, month, next_events, threshold, next_events > threshold AS elevated FROM (SELECT *, quantile_cont(next_events, 0.75) OVER () AS threshold FROM (SELECT p.zone_id, p.month, q.events AS next_events FROM p JOIN p q ON q.zone_id = p.zone_id AND q.month = strftime(CAST(p.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')))".replace("FROM p JOIN p q", "FROM (SELECT zone_id, strftime(week, '%Y-%m') AS month, CAST(sum(events) AS BIGINT) AS events FROM weekly GROUP BY ALL) p JOIN (SELECT zone_id, strftime(week, '%Y-%m') AS month, CAST(sum(events) AS BIGINT) AS events FROM weekly GROUP BY ALL) q"), "weekly"),
    "temporal_zone_buckets": sql(f"SELECT zone_id, current, {m6('mean', 'baseline')}, floor(z * 100 + 0.5) / 100 AS z, z >= 2 AS flagged FROM anomaly", "anomaly"),
    "temporal_trailing12": sql("SELECT month, ed, floor(mean * 10 + 0.5) / 10 AS baseline, floor(z * 100 + 0.5) / 100 AS z, z >= 2 AS flagged FROM trail12", "trail12"),
    "yearly_totals": sql("SELECT CAST(year(incident_date) AS INTEGER) AS year, CASE WHEN in_ob THEN 1 ELSE 2 END AS type_of_violence, count(*) AS events, CAST(sum(incident_id) AS BIGINT) AS deaths FROM incidents GROUP BY ALL", "incidents"),
    "month_overlay": sql("SELECT month, CASE WHEN month >= '2001-01' OR month > '2001-05' THEN ed + 1000 ELSE ed END AS ed FROM national", "national"),
    "chapman_point": sql("SELECT CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, CAST(overlap AS BIGINT) AS overlap, documented, " + m6("CASE WHEN overlap >= 3 THEN (n_a + 1) * (n_b + 1) / (overlap + 1) - 1 END", "chapman") + ", " + m6("CASE WHEN overlap >= 3 THEN ((n_a + 1) * (n_b + 1) / (overlap + 1) - 1) / documented ELSE 1 END", "factor") + " FROM chap", "chap"),
    "capture_patterns_3list": sql(f"SELECT *, CAST(row_number() OVER (ORDER BY len(string_split(pattern, '+')), pattern) AS INTEGER) AS place FROM ({_PATTERNS})", "incidents"),
    "haversine_pairs": sql("SELECT a, b, floor(km * 1000 + 0.5) / 1000 AS km FROM pairs WHERE a < b AND km <= 280", "pairs"),
    "scan_circles": sql("SELECT center, radius_km, array_to_string(members, ',') AS members, CAST(len(members) AS BIGINT) AS n_members, population FROM circles", "circles"),
    "scan_observed_llr": sql(f"SELECT center, radius_km, observed, {m6('expected', 'expected')}, {m6('llr', 'llr')}, {m6('rr', 'rr')} FROM scan", "scan"),
    "scan_kulldorff_llr": sql(f"SELECT center, radius_km, {m6('CASE WHEN observed <= expected THEN 0 ELSE llr + CASE WHEN c > observed AND c > expected THEN (c - observed) * ln((c - observed) / (c - expected)) ELSE 0 END END', 'llr')} FROM scan", "scan"),
    "point_in_polygon": sql("SELECT p.point_id, min(h.zone_id) AS zone_id FROM points p LEFT JOIN (SELECT point_id, zone_id, ring FROM points JOIN edges ON (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1) h USING (point_id) GROUP BY p.point_id", "points", "edges"),
    "ring_area_centroid": sql("SELECT zone_id, " + m6("abs(a) / 2", "area") + ", " + m6("sy / (3 * a)", "lat") + ", " + m6("sx / (3 * a)", "lng") + " FROM (SELECT zone_id, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS sy FROM edges GROUP BY zone_id)", "edges"),
    "ring_simplify": sql("SELECT zone_id, ring, 2 * seq AS seq, " + m6("x1", "x") + ", " + m6("y1", "y") + " FROM edges", "edges"),
    "latest_per_zone": sql("SELECT zone_id, incident_id, incident_date FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY incident_date DESC, incident_id) AS n FROM incidents WHERE zone_id IS NOT NULL) WHERE n <= 3", "incidents"),
    "equirect_project": sql(f"SELECT zone_id, {m6('(lng - 33.5) * 100', 'x')}, {m6('(0.5 - lat) * 100', 'y')} FROM zones", "zones"),
    "vehicle_best_window": sql("SELECT vehicle_key, n, start_us, array_to_string(zones, ',') AS zones, total, overlap, status, confidence FROM patterns", "patterns"),
    "vehicle_radius_variant": sql("""SELECT vehicle_key, n, start_us, overlap, CASE WHEN n < 4 THEN 'cleared' WHEN overlap >= 1 THEN 'flagged' ELSE 'monitoring' END AS status,
        floor(CASE WHEN n < 4 THEN least(0.4e0, least(0.95e0, 0.5e0 + 0.09e0 * least(overlap, 3))) ELSE floor(least(0.95e0, 0.5e0 + 0.07e0 * (n - 4) + 0.09e0 * least(overlap, 3)) * 100 + 0.5) / 100 END * 1e6 + 0.5) / 1e6 AS confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_key ORDER BY n DESC, overlap DESC, start_us, sighting_id) AS k FROM (
            SELECT w.*, (SELECT count(*) FROM recent r WHERE list_contains(w.zones, r.zone_id) AND epoch_us(r.d) >= w.start_us // 1000000 * 1000000 - 3 * 86400000000 AND epoch_us(r.d) <= w.start_us // 1000000 * 1000000 + 6 * 86400000000) AS overlap
            FROM (SELECT s.vehicle_key, s.sighting_id, s.us AS start_us, count(*) AS n, list(DISTINCT t.zone_id) AS zones FROM sightings s JOIN sightings t ON t.vehicle_key = s.vehicle_key AND t.us >= s.us AND t.us <= s.us + 3 * 86400000000
                JOIN pairs p ON p.a = s.zone_id AND p.b = t.zone_id AND p.km <= 130 GROUP BY ALL) w)) WHERE k = 1""", "recent", "sightings", "pairs"),
    "composite_index": sql("SELECT zone_id, " + ", ".join(m6(c, c) for c in ("eb_pct", "mse_pct", "cluster_score", "acled_recent", "temporal_score", "vehicle_score")) + ", ix AS index, band, confidence FROM index_table", "index_table"),
    "risk_bands": sql("SELECT band, count(*) AS n, max(ix) AS highest FROM index_table GROUP BY band", "index_table"),
    "region_summary": sql("SELECT region_name, count(*) AS zones, CAST(sum(documented) AS BIGINT) AS documented, max(ix) AS index, arg_max(zone_id, ix * 1000 - zone_id) AS top_zone FROM index_table GROUP BY region_name", "index_table"),
    "trend_projection_top12": sql("""SELECT zone_id, current_index, floor(moved * 10 + 0.5) / 10 AS projected_index, CASE WHEN moved >= 75 THEN 'critical' WHEN moved >= 60 THEN 'elevated' WHEN moved >= 45 THEN 'watch' ELSE 'baseline' END AS band, floor(t * 100 + 0.5) / 100 AS trend
        FROM (SELECT *, least(100, greatest(0, current_index + 12 * (t - 1))) AS moved FROM (SELECT i.zone_id, i.ix AS current_index, CASE WHEN f.mean6 IS NULL THEN 1 WHEN f.mean3 <= 0 THEN CASE WHEN f.mean6 > 0 THEN 1.4 ELSE 1 END ELSE least(2, greatest(0.5, f.mean6 / f.mean3)) END AS t
        FROM (SELECT * FROM index_table ORDER BY ix DESC, zone_id LIMIT 12) i LEFT JOIN (SELECT * FROM feats WHERE mi = (SELECT max(mi) FROM feats)) f USING (zone_id)))""", "index_table", "feats", **GRID),
    "names_in_reading_order": """SELECT c_custkey, zone_name, CAST(row_number() OVER (ORDER BY base, c_custkey) - 1 AS BIGINT) AS place, count(*) OVER () AS total FROM (
        SELECT n_nationkey, lower(n_name) AS base, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN upper(n_name)
            ELSE translate(array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), 'AEIOUaeiou', 'ÁÉÍÓÚáéíóú') END AS zone_name FROM nation) JOIN customer ON c_nationkey = n_nationkey""",
    "calibration_folds": sql("SELECT * FROM fold_parts", "fold_parts"),
    "calibration_report": sql(
        """SELECT weights, fold, count(*) AS n, CAST(count_if(outcome >= 1) AS BIGINT) AS n_positive, CASE WHEN count_if(outcome >= 1) IN (0, count(*)) THEN 0.5e0
            ELSE floor((sum(r) FILTER (WHERE outcome >= 1) - count_if(outcome >= 1) * (count_if(outcome >= 1) + 1) / 2e0) / (count_if(outcome >= 1) * (count(*) - count_if(outcome >= 1))) * 1e6 + 0.5) / 1e6 END AS auc,
            floor(CASE WHEN stddev_pop(r) > 0 AND stddev_pop(o) > 0 THEN corr(r, o) ELSE 0 END * 1e6 + 0.5) / 1e6 AS rho
        FROM (SELECT *, rank() OVER (PARTITION BY weights, fold ORDER BY score) + (count(*) OVER (PARTITION BY weights, fold, score) - 1) / 2e0 AS r,
                rank() OVER (PARTITION BY weights, fold ORDER BY outcome) + (count(*) OVER (PARTITION BY weights, fold, outcome) - 1) / 2e0 AS o
            FROM (SELECT w.weights, fold, outcome, floor((w.a * eb_pct + w.b * mse_pct + w.c * cluster_score + w.d * acled_recent + w.e * ucdp_baseline + w.f * temporal_score + w.g * vehicle_score) * 1e6 + 0.5) / 1e6 AS score
                FROM fold_parts CROSS JOIN (VALUES ('current', 0.3e0, 0.16e0, 0.28e0, 0.1e0, 0e0, 0.1e0, 0.06e0), ('previous', 0.3e0, 0.16e0, 0.28e0, 0e0, 0.1e0, 0.1e0, 0.06e0), ('equal', 1 / 7e0, 1 / 7e0, 1 / 7e0, 1 / 7e0, 1 / 7e0, 1 / 7e0, 1 / 7e0)) AS w(weights, a, b, c, d, e, f, g)))
        GROUP BY weights, fold""",
        "fold_parts",
    ),
    "alerts_feed": sql("SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'elevated' THEN 1 WHEN 'watch' THEN 2 ELSE 3 END, part, id) AS INTEGER) AS place, id, severity, kind, title, confidence FROM feed", "feed"),
    "severity_histogram": sql(_SEVERITIES, "feed"),
    "analysis_document": sql(
        f"""SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY key) - 1 AS INTEGER) AS place, key, n
        FROM (SELECT 'severities' AS part, severity AS key, n FROM ({_SEVERITIES}) UNION ALL SELECT 'regions', region_name, count(*) FROM index_table GROUP BY region_name UNION ALL SELECT 'patterns', pattern, n FROM ({_PATTERNS}))""",
        "feed", "index_table", "incidents",
    ),
    "action_level_alerts": sql("SELECT id, message, CAST(n_actions AS BIGINT) AS n_actions FROM feed WHERE severity IN ('critical', 'elevated')", "feed"),
    "gazetteer_lenient": sql("""SELECT doc_id, CASE WHEN low IN ('', '?', 'unknown') THEN NULL WHEN low = 'nai' THEN 'Embu' WHEN regexp_replace(low, '\\s*county$', '', 'i') IN ('Embu', 'Kisumu', 'Lamu', 'Nakuru', 'Nyeri', 'Thika') THEN regexp_replace(low, '\\s*county$', '', 'i')
        WHEN contains(low, 'ther') THEN 'Thika' WHEN contains(low, 'that') THEN 'Nakuru' WHEN contains(low, 'tion') THEN 'Kisumu' WHEN contains(low, 'with') THEN 'Lamu' WHEN contains(low, 'from') THEN 'Nyeri' WHEN contains(low, 'this') THEN 'Embu'
        WHEN contains(low, 'embu') THEN 'Embu' WHEN contains(low, 'kisumu') THEN 'Kisumu' WHEN contains(low, 'lamu') THEN 'Lamu' WHEN contains(low, 'nakuru') THEN 'Nakuru' WHEN contains(low, 'nyeri') THEN 'Nyeri' WHEN contains(low, 'thika') THEN 'Thika' END AS zone
        FROM (SELECT doc_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS low FROM headlines)""", "headlines"),
    "gazetteer_strict": sql("SELECT * FROM strict", "strict"),
    "lead_classify": sql("SELECT doc_id, CASE WHEN regexp_matches(title, '(?i)\\bin (that|with)\\b') THEN 'out_of_scope' WHEN regexp_matches(title, '(?i)from|\\bthis\\b') THEN 'analysis_or_advocacy' WHEN NOT regexp_matches(title, '(?i)ther|tion') THEN 'no_incident_signal' ELSE 'lead' END AS reason FROM headlines", "headlines"),
    "keyword_terms": sql("SELECT doc_id, array_to_string(t, ',') AS terms FROM (SELECT doc_id, list_filter(['that', 'with', 'this', 'tion', 'from', 'ther'], lambda x: contains(lower(title || ' ' || source), x)) AS t FROM headlines) WHERE len(t) > 0", "headlines"),
    "title_dedup_first_seen": sql("SELECT doc_id, title, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY age_days, doc_id) AS n FROM (SELECT *, substring(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 90) AS k FROM headlines) WHERE k <> '') WHERE n = 1", "headlines"),
    "latest_articles": sql("SELECT doc_id, source, age_days FROM headlines ORDER BY age_days, doc_id LIMIT 200", "headlines"),
    "top_mentions": sql("SELECT zone, count(*) AS n FROM strict WHERE zone IS NOT NULL GROUP BY zone ORDER BY n DESC, zone LIMIT 10", "strict"),
    "daily_histogram": sql("SELECT date, n FROM daily", "daily"),
    "news_windows": sql("SELECT *, prev4w / 4e0 AS weekly_baseline FROM sums", "sums"),
    "html_anchor_index": """SELECT page_id, ref, title FROM (SELECT page_id, ref, title, row_number() OVER (PARTITION BY page_id, ref ORDER BY k) AS n FROM (
        SELECT page_id, k, r[k] AS ref, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t[k], '<[^>]+>', '', 'g'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS title
        FROM (SELECT page_id, r, t, unnest(range(1, len(r) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<a[^>]+href="[^"]*/([^"/?#]+)[^"]*"[^>]*>(.*?)</a>', 1) AS r, regexp_extract_all(html, '(?s)<a[^>]+href="[^"]*/([^"/?#]+)[^"]*"[^>]*>(.*?)</a>', 2) AS t FROM pages)))
        WHERE title <> '') WHERE n = 1""",
    "set_similarity_pairs": sql(f"SELECT * FROM (SELECT x.doc_id AS a, y.doc_id AS b, {m6('CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0 ELSE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) END', 'jaccard')} FROM h x JOIN h y ON x.source = y.source AND x.age_days = y.age_days AND x.doc_id < y.doc_id) WHERE jaccard >= 0.5".replace("FROM h x JOIN h y", "FROM (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda v: v <> '')) AS w FROM headlines) x JOIN (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda v: v <> '')) AS w FROM headlines) y"), "headlines"),
    "bigram_cosine": sql(f"""SELECT * FROM (SELECT x.doc_id AS a, y.doc_id AS b, {m6('len(list_intersect(x.g, y.g)) / sqrt(greatest(len(x.g) * len(y.g), 1))', 'cosine')} FROM big x JOIN big y ON x.source = y.source AND abs(x.age_days - y.age_days) <= 3 AND x.doc_id < y.doc_id) WHERE cosine >= 0.42""".replace("big ", "(SELECT doc_id, source, age_days, list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT *, regexp_extract_all(lower(title), '[A-Za-z'']+') AS w FROM headlines)) "), "headlines"),
    "record_crossmatch": sql("""SELECT b.record_id AS case_id, min(a.record_id) AS record_id FROM (SELECT *, list_distinct(regexp_extract_all(lower(name), '[a-z'']+')) AS w FROM er WHERE list = 'B') b JOIN (SELECT *, list_distinct(regexp_extract_all(lower(name), '[a-z'']+')) AS w FROM er WHERE list = 'A') a
        ON abs(a.day_no - b.day_no) <= 45 AND (len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.5
            OR (abs(a.day_no - b.day_no) <= 14 AND b.record_id % 40 = 1 AND a.record_id % 40 = 0)) GROUP BY b.record_id""", "er"),
    "connected_components": """WITH RECURSIVE o AS MATERIALIZED (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d FROM orders),
        s AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY c ORDER BY d, k) <= 60 THEN 0 ELSE 1 END AS n FROM o),
        g AS (SELECT *, sum(n) OVER (PARTITION BY c ORDER BY d, k) AS grp FROM s) SELECT k AS node, min(k) OVER (PARTITION BY c, grp) AS root FROM g""",
    "rank_auc": sql(f"SELECT {m6('(sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2e0) / (p * (n - p))', 'auc')}, n, p AS n_positive FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r, count(*) OVER () AS n, CAST(sum(label) OVER () AS BIGINT) AS p FROM scored) GROUP BY n, p", "scored"),
    "spearman": sql(f"SELECT {m6('corr(a, b)', 'rho')}, count(*) AS n FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS a, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2e0 AS b FROM scored)", "scored"),
    "snapshot_delta": "SELECT day, events, errors, events - lag(events) OVER (ORDER BY day) AS d_events, errors - lag(errors) OVER (ORDER BY day) AS d_errors FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS events, CAST(count_if(event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY ALL)",
    "stream_windowed_counts": f"SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, {m6('sum(value)', 'total')} FROM events GROUP BY ALL",
    "stream_high_water": "SELECT event_type, max(event_id) AS latest FROM events GROUP BY event_type",
    "sliding_request_windows": "SELECT s AS start_s, count(*) AS n, count(*) > 4 AS limited FROM (SELECT unnest([epoch_us(ts) // 300000000 * 300, epoch_us(ts) // 300000000 * 300 - 300]) AS s FROM events) GROUP BY s",
    "rate_limit": _LIMITED,
    "stream_rate_limit": _LIMITED,
    "stream_case_state": """SELECT case_id, CASE WHEN bool_or(promoted) THEN 'promoted' WHEN count(DISTINCT outlet) >= 2 THEN 'ready' ELSE 'pending' END AS status, count(*) AS updates
        FROM (SELECT 'case-' || user_id % 50 AS case_id, event_id % 7 AS outlet, event_id % 900 = 899 AS promoted,
            count(*) FILTER (WHERE event_id % 900 = 899) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS decided FROM events) WHERE decided = 0 GROUP BY case_id""",
    "stream_revisions": """SELECT coalesce(s.day, f.day) AS day, CASE WHEN s.day IS NOT NULL AND (f.day IS NULL OR s.day < DATE '2024-01-10') THEN 0 ELSE f.revised END AS revised,
        CASE WHEN s.day IS NOT NULL AND (f.day IS NULL OR s.day < DATE '2024-01-10') THEN s.n ELSE f.n END AS n
        FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL) s
        FULL JOIN (SELECT * FROM (SELECT CAST(ts AS DATE) AS day, epoch_us(ts) AS revised, event_id AS n, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'click') WHERE k = 1) f ON f.day = s.day""",
}
