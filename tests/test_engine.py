import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from zonewright.functions import columns as C
from zonewright.functions import text as T
from zonewright.operators import entity, forecast, news, panels, rates, risk, scan, sinks
from zonewright.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    r = one(spark, C.half_up(F.lit(-2.5)).alias("a"), C.add_months_key(F.lit("2024-11"), 3).alias("b"), C.add_months_key(F.lit("2024-13"), 3).alias("c"), C.number_or_zero(F.lit("x")).alias("d"), C.excel_date(F.lit(45292)).alias("e"), C.iso_date(F.lit("2024-1-2")).alias("f"), C.logistic(F.lit(-800.0)).alias("g"), C.compact_timestamp_date(F.lit("20260930T000000Z")).alias("h"), C.end_of_month(F.lit("2024-02")).alias("i"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (-2.0, "2025-02", None, 0.0, datetime.date(2024, 1, 1), None, 0.0, datetime.date(2026, 9, 30))
    assert str(r.i) == "2024-02-29 23:59:59"


def test_texts(spark):
    r = one(spark, T.canonical_zone(F.lit("Homa Bay county")).alias("a"), T.loose_key(F.lit("Murang'a – East")).alias("b"), T.strip_outlet(F.lit("Man found - The Star")).alias("c"), T.strip_tags(F.lit("<b>A &amp; B</b> &#233;&#x41;\n c")).alias("d"), T.slug(F.lit("  A b--C! ")).alias("e"), T.stem(F.lit("missing")).alias("f"), T.bigram_set(T.tokens(F.lit("a b a b"))).alias("g"), T.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")).alias("h"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == ("Homa Bay", "murangaeast", "Man found", "A & B éA c", "a-b-c", "miss", ["a b", "b a"], 0.0)


def test_empirical_bayes_by_hand(spark):
    df = spark.createDataFrame([(1, 5, 1000), (2, 0, 2000), (3, 20, 1500)], "zone_id int, documented long, population long")
    got = {r.zone_id: r.eb_rate for r in rates.empirical_bayes(df).collect()}
    c, p = [5, 0, 20], [1000, 2000, 1500]
    r = sum(c) / sum(p)
    var = sum(q * (x / q - r) ** 2 for x, q in zip(c, p)) / sum(p) - r * 2 / sum(p)
    a = r * r / max(var, 1e-12)
    assert all(abs(got[k + 1] - (c[k] + a) / (p[k] + a / r) * 1e5) < 1e-6 for k in range(3))


def test_bucket_borders(spark):
    as_of = datetime.date(2024, 7, 1)
    days = [1, 90, 91, 180, 540, 541, 0]
    inc = spark.createDataFrame([(1, as_of - datetime.timedelta(d)) for d in days], "zone_id int, incident_date date")
    zones = spark.createDataFrame([(1,), (2,)], "zone_id int")
    got = {r.zone_id: r for r in panels.bucket_anomaly(zones, inc, F.lit(as_of)).collect()}
    assert got[1].current == 2 and abs(got[1].baseline - 3 / 5) < 1e-12 and got[2].current == 0


def test_cluster_is_found(spark):
    rows = [(k, 4.0 * 0 + 0.5 * (k % 6), 0.5 * (k // 6), 1000, 40 if k in (0, 1, 6, 7) else 4) for k in range(36)]
    z = spark.createDataFrame(rows, "zone_id int, lat double, lng double, population long, cases long")
    got = scan.clusters(z.drop("cases"), z.select("zone_id", "cases"), replications=199).collect()
    assert got[0]["rank"] == 0 and got[0].p <= 0.01 and set(got[0].members) & {0, 1, 6, 7}
    again = scan.clusters(z.drop("cases"), z.select("zone_id", "cases").repartition(7), replications=199).collect()
    assert [r.p for r in again] == [r.p for r in got]


def test_greedy_equals_one_by_one(spark):
    import random

    draw = random.Random(5)
    pairs = [(a, 100 + b, draw.randrange(5) / 10) for a in range(30) for b in range(30) if draw.random() < 0.2]
    got = {(r.a_id, r.b_id) for r in entity.greedy_assignment(spark.createDataFrame(pairs, "a_id int, b_id int, score double")).collect()}
    want, used = set(), set()
    for a, b, s in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    assert got == want


def test_resolution_recall(spark):
    import random

    draw = random.Random(1)
    name = lambda k: " ".join(random.Random(k * 7 + j).choice(["wanjiku", "otieno", "mwangi", "achieng", "kamau", "njeri", "omondi", "chebet", "barasa", "hassan"]) + str((k * 13 + j) % 97) for j in range(2))
    a = [(k, 10 + 3 * k % 300, name(k), "x", 1.0, 36.0 + k / 50) for k in range(100)]
    b = [(1000 + k, 10 + 3 * k % 300 + draw.randrange(-2, 3), name(k)[:-1] + draw.choice("az"), "x", 1.0 + draw.uniform(-0.02, 0.02), 36.0 + k / 50) for k in range(60)] + [(2000 + k, draw.randrange(300), name(500 + k), "y", 2.0, 38.0) for k in range(30)]
    schema = "record_id int, day_no int, name string, county string, lat double, lng double"
    got = entity.greedy_assignment(entity.scored_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 3, 0.82, 10.0)).collect()
    right = sum(r.b_id - 1000 == r.a_id for r in got)
    assert right >= 0.9 * 60 and right >= 0.95 * len(got)


def test_backtest_bars(spark):
    import numpy as np

    rng = np.random.default_rng(20260930)
    rows = []
    for z in range(8):
        for m in range(36):
            mean = (2 + z) * (1 + (0.04 if z >= 6 else 0.0) * m) * (1 + 0.3 * np.sin(m * np.pi / 6))
            rows.append((z, f"{2020 + m // 12}-{m % 12 + 1:02d}", int(rng.poisson(mean))))
    grid = entity.checkpointed(panels.filled_grid(spark.createDataFrame(rows, "zone_id int, month string, events long")))
    p = entity.checkpointed(forecast.walk_forward(grid))
    m, auc = forecast.classification_metrics(p).first(), forecast.auc(p, "score", "label").first().auc
    assert 0.6 <= auc <= 0.95 and m.brier < 0.25 and m.n > 100 and 14 <= m.lead_days <= 16


def test_cases_are_terminal(spark):
    schema = "case_id string, status string, person string, first_seen string, last_seen string, latest_pub_date string"
    before = spark.createDataFrame([("a", "promoted", "P", "d0", "d0", "d0"), ("b", "pending", "Q", "d0", "d0", "d0"), ("c", "rejected", "R", "d0", "d0", "d0")], schema)
    fresh = spark.createDataFrame([("a", "ready", "other", "d9", "d9", "d8"), ("d", "pending", "S", "d9", "d9", "d8")], schema)
    got = {r.case_id: r for r in news.merge_case_state(before, fresh, F.lit("d9")).collect()}
    assert set(got) == {"a", "c", "d"} and (got["a"].status, got["a"].person, got["a"].latest_pub_date) == ("promoted", "P", "d8") and got["d"].first_seen == "d9" and got["c"].last_seen == "d9"


def test_leads_and_persons(spark):
    titles = ["Activist Jane Wanjiru Missing after protest", "Police slams report on abductions", "Man abducted in Uganda", "Weather today"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = df.select(news.classify_lead(F.col("t")).alias("c"), news.person_name("t").alias("p")).collect()
    assert [r.c for r in got] == ["lead", "analysis_or_advocacy", "out_of_scope", "no_incident_signal"] and got[0].p == "Jane Wanjiru"
    assert [one(spark, news.outside_country(F.lit(x)).alias("o")).o for x in ("Nairobi (outside Parliament)", "Kampala")] == [False, True]


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text('id,year,type_of_violence,date_start,best,deaths_civilians,latitude,longitude,where_description\n1,2020,1,2020-01-02 00:00,3,x,-1.5,36.8,"A ""q"", b"\n2,2020,1,2020-01-02,3,1,-1,-1,p\n3,2020,1,2020-01-02,3,1,,36,p\n')
    got = readers.event_csv(spark, str(tmp_path / "e.csv")).collect()
    assert [(r.event_id, r.civilians, r.place) for r in got] == [(1, 0.0, 'A "q", b')]
    (tmp_path / "m.json").write_text(json.dumps({"statistics": [{"type": "monthly_series", "year": "2024", "months": ["January", "Feb"], "enforced_disappearances": [4, None], "police_killings": [1, 2], "incidents": [5]}, {"type": "other"}]}))
    assert [tuple(r) for r in readers.monthly_series(spark, str(tmp_path / "m.json")).collect()] == [("2024-01", 4, 1, 5), ("2024-02", 0, 2, 0)]
    assert readers.json_optional(spark, str(tmp_path / "none.json"), "a INT").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.json_required(spark, str(tmp_path / "none.json"), "a INT").count()
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"COUNTY": "Lamu County"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {"name": "Embu"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}, {"properties": {}, "geometry": {"type": "Polygon", "coordinates": [square]}}]}))
    edges = readers.geojson_edges(spark, str(tmp_path / "g.json")).groupBy("zone_name").agg(F.count("*").alias("n"), F.count_distinct("ring").alias("r"))
    assert {r.zone_name: (r.n, r.r) for r in edges.collect()} == {"Lamu": (5, 1), "Embu": (10, 2)}


def test_feeds_and_pages(spark):
    xml = "<rss><item><title>Man missing since Monday in Kisumu town - Daily Nation</title><link>http://a?x=1&amp;y</link><pubDate>Tue, 3 Sep 2024 10:00:00 GMT</pubDate></item><item><title>Short - X</title><link>b</link><source url='u'>S</source></item><item><title></title><link>c</link></item></rss>"
    got = readers.rss_items(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(r.title, r.url, r.source, str(r.pub_date)) for r in got] == [("Man missing since Monday in Kisumu town", "http://a?x=1&y", "Daily Nation", "2024-09-03"), ("Short - X", "b", "S", "None")]
    html = "<table><tr><th>h</th></tr><tr><td>1</td><td><b>A</b> &amp; B</td></tr></table><div data-c=\"{&quot;labels&quot;:[&quot;m1&quot;],&quot;data&quot;:[3]}\" ></div><div data-c=\"{&quot;labels&quot;:[&quot;m1&quot;],&quot;data&quot;:[5]}\"></div>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r.cells for r in readers.table_rows(pages, "page_id", "html").collect()] == [["1", "A & B"]]
    assert [(r.month, r.value) for r in readers.chart_points(pages, "page_id", "html", "data-c").collect()] == [("m1", 5.0)]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>WEEK</t></si><si><t>ADMIN1</t></si><si><t>Lamu</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>45292</v></c><c r="C2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(buf.getvalue())
    got = readers.workbook(spark, str(tmp_path / "w.xlsx"), ["WEEK", "ADMIN1"]).select(C.excel_date("WEEK").alias("w"), "ADMIN1").collect()
    assert [(str(r.w), r.ADMIN1) for r in got] == [("2024-01-01", "Lamu")]


def test_workbook_in_ranges(spark, tmp_path):
    """Rows are the same however short the ranges are, those that borders cut included, and more than one task reads a sheet."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    words = "".join(f"<si><t>w{k} &lt;row&gt;</t></si>" for k in range(50))
    rows = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c><c r="B{k}" t="s"><v>{2 + k % 50}</v></c><c r="C{k}" t="inlineStr"><is><t>{"x" * (k % 90)}</t></is></c></row>' if k % 11 else f'<row r="{k}"/>' for k in range(2, 700))
    for name, tail in (("a", '<rowBreaks count="0"/>'), ("b", "")):
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>WEEK</t></si><si><t>NAME</t></si>{words}</sst>")
            z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet {ns}><cols/><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>{rows}</sheetData>{tail}</worksheet>')
    got = {}
    for span in (149, 997):  # without Spark, since each range would be a task
        with readers._opened(str(tmp_path / "a.xlsx")) as z:
            cut = b"".join(readers._row_bytes(z, k, k + span)[1] for k in range(0, readers._first_sheet(z).file_size, span))
            assert cut == readers._row_bytes(z, 0, 1 << 62)[1] and cut.endswith(b"</row>")
    for span in (5000, 1 << 24):
        read = readers.workbook(spark, str(tmp_path), ["NAME", "WEEK"], span)
        got[span] = sorted((r.file[-6:], r.WEEK or "", r.NAME or "") for r in read.collect())
    want = sorted((f, str(k) if k % 11 else "", f"w{k % 50} <row>" if k % 11 else "") for f in ("a.xlsx", "b.xlsx") for k in range(2, 700))
    assert all(rows == want for rows in got.values())
    where = readers.workbook(spark, str(tmp_path), ["WEEK"], 5000).select(F.spark_partition_id().alias("p")).distinct()
    assert where.count() > 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    path = str(tmp_path / "t")
    df.write.parquet(path)
    sinks.overwrite_staged(spark.read.parquet(path).withColumn("b", F.col("b") + 1), path, str(tmp_path / "stage"))
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, 3)]
    zones = spark.createDataFrame([(1, "Lamu", 61.5, "elevated", 9)], "zone_id int, zone_name string, index double, band string, documented long")
    alerts = spark.createDataFrame([(1, "critical", "T")], "place int, severity string, title string")
    text = sinks.markdown_digest({"documented": 12, "d_documented": -2, "estimated": 20}, zones, alerts)
    r = sinks.headline_numbers(spark.createDataFrame([(text,)], "text string")).first()
    assert tuple(r) == (12, -2, 20) and "- T" in text and "Lamu" in sinks.analysis_digest({"documented": 1, "estimated": 2}, zones, alerts)
    assert [sinks.webhook_kind(u) for u in ("https://hooks.slack.com/x", "https://discord.com/api/webhooks/1", "https://a.b/c", "https://a.b/c#slack")] == ["slack", "discord", "json", "slack"]
    assert json.loads(sinks.webhook_payload("https://hooks.slack.com/x", "t", "b", {}))["text"] == "t"


def test_index_bands(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0), (0.5, 0.5, 0.5, 0.5, 0.0, 0.5, 0.5), (0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], ", ".join(f"{k} double" for k in risk.WEIGHTS))
    assert [(r["index"], r.band) for r in risk.composite_index(df).collect()] == [(100.0, "critical"), (50.0, "watch"), (0.0, "baseline")]
