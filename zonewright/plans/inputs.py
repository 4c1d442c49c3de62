"""Queries over the readers, sinks, filters and scalar functions. Each writes what it reads from the star-schema tables to the shared folder first."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as T
from ..operators import entity, news, sinks, snapshots
from ..session import shared_folder
from ..sources import readers
from ..sources import tables as src
from .catalogue import monthly_incidents, query


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/inputs-{uuid.uuid4().hex}"


def one_document(rows: DataFrame, name: str, path: str) -> str:
    """A small table as one JSON document with one array."""
    packed = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name))
    packed.select(F.to_json(F.struct(name)).alias("value")).coalesce(1).write.text(path)
    return path


# ---- sources ----


@query
def json_scan(spark: SparkSession, d: str) -> DataFrame:
    path = one_document(src.table(spark, d, "nation").select("n_nationkey", "n_name"), "nations", folder(spark))
    return readers.json_required(spark, path, "nations ARRAY<STRUCT<n_nationkey: INT, n_name: STRING>>").select(F.inline("nations"))


@query
def json_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a missing file, of a corrupt one and of a good one."""
    bad, good = folder(spark), one_document(src.table(spark, d, "region").select("r_regionkey"), "regions", folder(spark))
    spark.range(1).select(F.lit("{not json").alias("value")).write.text(bad)
    paths = {"missing": folder(spark), "corrupt": bad, "good": good}
    parts = [readers.json_optional(spark, p, "regions ARRAY<STRUCT<r_regionkey: INT>>").select(F.explode("regions")).agg(F.count("*").alias("n")).select(F.lit(k).alias("file"), "n") for k, p in paths.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query
def optional_sightings(spark: SparkSession, d: str) -> DataFrame:
    """Nested cases read as sightings, beside a source that is missing."""
    k = F.col("event_id")
    one = src.table(spark, d, "events").where("event_type = 'view'").select(F.concat(F.lit("v"), F.col("user_id")).alias("vehicleKey"), F.struct(k.cast("string").alias("id"), F.to_date("ts").cast("string").alias("date"), F.concat(F.lit("zone "), k % 25).alias("zoneName"), F.lit("s").alias("source")).alias("s"))
    path = one_document(one.groupBy("vehicleKey").agg(F.sort_array(F.collect_list("s")).alias("sightings")), "vehicles", folder(spark))
    got = readers.vehicle_sightings(spark, path).unionAll(readers.vehicle_sightings(spark, folder(spark)))
    return got.select(F.col("sighting_id").cast("long").alias("sighting_id"), F.unix_seconds("sighted_at").alias("at_s"), "vehicle_key", "zone_name")


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    lat = F.when(k % 9 == 0, "-1").when(k % 9 == 1, "").when(k % 9 == 2, "NaN").otherwise((k % 80 / 10 - 4).cast("string"))
    lng = F.when(k % 18 == 0, "-1").otherwise((34 + k % 70 / 10).cast("string"))
    return src.table(spark, d, "orders").select(k.cast("string").alias("id"), F.year("o_orderdate").cast("string").alias("year"), (k % 3 + 1).cast("string").alias("type_of_violence"), F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00").alias("date_start"), F.when(k % 11 == 0, "x").otherwise((k % 7).cast("string")).alias("best"), F.lit("").alias("deaths_civilians"), lat.alias("latitude"), lng.alias("longitude"), F.concat(F.lit('near "'), "o_orderpriority", F.lit('", road')).alias("where_description"), F.when(k % 2 == 0, "A").otherwise("B").alias("country"))


@query
def event_csv(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    event_rows(spark, d).write.csv(path, header=True, quote='"', escape='"')
    got = readers.event_csv(spark, path)
    return got.select("event_id", "year", "type_of_violence", "date_start", "best", "civilians", C.micro("lat").alias("lat"), C.micro("lng").alias("lng"), "place")


@query
def event_csv_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """A large export rewritten to one country and three columns."""
    path, target = folder(spark), folder(spark)
    event_rows(spark, d).write.csv(path, header=True, quote='"', escape='"')
    readers.refresh_event_csv(spark, path, target, "A", ["id", "year", "best"])
    return spark.read.csv(target, header=True).select(F.col("id").cast("long").alias("id"), F.col("year").cast("int").alias("year"), "best")


@query
def geojson_edges(spark: SparkSession, d: str) -> DataFrame:
    e = src.zone_edges(spark, d).join(src.table(spark, d, "nation").select(F.col("n_nationkey").alias("zone_id"), "n_name"), "zone_id")
    ring = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x1", "y1"))), lambda p: F.array(p["x1"], p["y1"]))
    shapes = e.groupBy("zone_id", "n_name").agg(ring.alias("r"))
    kind = F.when(F.col("zone_id") % 2 == 0, "Polygon").otherwise("MultiPolygon")
    properties = F.when(F.col("zone_id") % 3 == 0, F.create_map(F.lit("COUNTY"), F.concat("n_name", F.lit(" County")))).otherwise(F.create_map(F.lit("name"), F.col("n_name")))
    rings = F.array(F.col("r"))
    text = F.when(F.col("zone_id") % 2 == 0, F.to_json(rings)).otherwise(F.to_json(F.array(rings)))
    feature = F.concat(F.lit('{"properties":'), F.to_json(properties), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}}"))
    path = folder(spark)
    shapes.agg(F.array_join(F.collect_list(feature), ",").alias("f")).select(F.concat(F.lit('{"features":['), "f", F.lit("]}")).alias("value")).write.text(path)
    return readers.geojson_edges(spark, path).select("zone_name", "ring", "seq", *(C.micro(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query
def workbook_scan(spark: SparkSession, d: str) -> DataFrame:
    """A workbook of zones and weeks, read by header name and profiled per zone."""
    rows = src.table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # the dimension: a row per zone
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    words = ["WEEK", "ADMIN1", *(r.n_name for r in rows)]
    cells = "".join(f'<row><c r="A{i}"><v>{45292 + 7 * r.n_nationkey * w}</v></c><c r="AB{i}" t="s"><v>{2 + k}</v></c></row>' for k, r in enumerate(rows) for w in (1, 2) for i in (2 + 2 * k + w,))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{w}</t></si>' for w in words)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row>{cells}</sheetData></worksheet>')
    path = folder(spark)
    fs, there = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    fs.create_dir(there, recursive=True)
    with fs.open_output_stream(f"{there}/weeks.xlsx") as f:
        f.write(buffer.getvalue())
    got = readers.workbook(spark, path, ["WEEK", "ADMIN1"]).select(C.excel_date("WEEK").alias("week"), "ADMIN1")
    return readers.workbook_profile(got, "week", "ADMIN1")


def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    """An item per part; every third names its publisher, every fifth has no link."""
    k = F.col("p_partkey")
    title = F.concat("p_name", F.lit(" "), "p_type", F.lit(" &amp; more - "), "p_brand")
    link = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("http://a/?x=1&amp;k="), k))
    source = F.when(k % 3 == 0, "<source url='u'>The Source</source>").otherwise("")
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")), "d MMM yyyy")
    return src.table(spark, d, "part").select(k.alias("part"), F.concat(F.lit("<rss><item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><pubDate>Mon, "), date, F.lit(" 10:00:00 GMT</pubDate>"), source, F.lit("</item></rss>")).alias("xml"))


@query
def rss_items(spark: SparkSession, d: str) -> DataFrame:
    return readers.rss_items(feed_rows(spark, d), "xml", ("part",)).select("part", "title", "url", "source", "pub_date")


@query
def anchor_index_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten last references over all pages, each with the title of its first page."""
    found = readers.anchors(src.table(spark, d, "pages"), "page_id", "html", r"/([^\"/?#]+)")
    first = found.groupBy("ref").agg(F.min_by("title", "page_id").alias("title"))
    return first.orderBy(F.desc("ref")).limit(10)


@query
def victim_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of victims in pages: the date as a date, or as text where it is not one."""
    k = F.col("o_orderkey")
    shown = F.when(k % 4 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).when(k % 4 == 1, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    row = F.concat(F.lit("<tr><td>"), k, F.lit("</td><td><b>"), "o_orderpriority", F.lit("</b></td><td>place "), "o_custkey", F.lit("</td><td>"), shown, F.lit("</td></tr>"))
    o = src.table(spark, d, "orders")
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("<table><tr><th>no</th></tr>"), row, F.lit("</table>")).alias("html"))
    return readers.victim_table(pages, "page_id", "html").select("no", "name", "location", "date")


@query
def chart_points(spark: SparkSession, d: str) -> DataFrame:
    """Two charts of the months' counts in a page, of which the larger value stays."""
    m = monthly_incidents(spark, d)
    chart = lambda v: F.to_json(F.struct(F.collect_list("month").alias("labels"), F.collect_list(v).alias("data")))
    attribute = lambda j: F.concat(F.lit('<div data-c="'), F.replace(j, F.lit('"'), F.lit("&quot;")), F.lit('"></div>'))
    odd = F.when(F.col("ed") % 2 == 1, F.col("ed") + 5).otherwise(F.col("ed") - 5).cast("double")
    page = m.agg(F.concat(attribute(chart(F.col("ed").cast("double"))), attribute(chart(odd))).alias("html")).withColumn("page_id", F.lit(1))
    return readers.chart_points(page, "page_id", "html", "data-c").select("month", C.micro("value").alias("value"))


@query
def last_good_wins(spark: SparkSession, d: str) -> DataFrame:
    """A failed fetch leaves the previous table; a good one replaces it."""
    n = src.table(spark, d, "nation").select("n_nationkey")
    r = src.table(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"))
    there, out = folder(spark), []
    for name, fetch in (("failed", lambda: r.where("n_nationkey < 0")), ("none", lambda: None), ("good", lambda: r)):
        snapshots.publish(n, f"{there}/{name}")
        snapshots.refresh(spark, f"{there}/{name}", fetch)
        out.append(snapshots.read(spark, f"{there}/{name}").withColumn("fetch", F.lit(name)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def relief_reports(spark: SparkSession, d: str) -> DataFrame:
    """The latest 50 reports on one country, with the start of the body as the report's summary."""
    r = src.table(spark, d, "documents").select(F.array("source", "lang").alias("countries"), (F.col("doc_id") % 100).alias("date"), F.col("doc_id").cast("string").alias("title"), "source", F.col("text").alias("body"))
    return readers.relief_reports(r, "fr", 50)


@query
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    """Records of parallel arrays per year; a record of another type and missing numbers among them."""
    m = monthly_incidents(spark, d).select(F.substring("month", 1, 4).alias("year"), F.date_format(F.to_date(F.concat("month", F.lit("-01"))), "MMMM").alias("m"), "month", F.when(F.col("ed") % 5 != 0, F.col("ed")).cast("int").alias("ed"))
    rows = F.sort_array(F.collect_list(F.struct("month", "m", F.coalesce("ed", F.lit(-1)).alias("ed"))))
    s = m.groupBy("year").agg(rows.alias("r")).select("year", F.transform("r", lambda x: x["m"]).alias("months"), F.transform("r", lambda x: F.when(x["ed"] >= 0, x["ed"])).alias("e"))
    record = F.struct(F.when(F.col("year") == "1996", "other").otherwise("monthly_series").alias("type"), "year", "months", F.col("e").alias("enforced_disappearances"), F.array().cast("array<int>").alias("police_killings"), F.col("e").alias("incidents"))
    path = folder(spark)
    s.agg(F.collect_list(record).alias("statistics")).select(F.to_json(F.struct("statistics"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return readers.monthly_series(spark, path)


@query
def victims_with_dates(spark: SparkSession, d: str) -> DataFrame:
    """Victim lists in fifty files; only entries with a full ISO date stay."""
    k = F.col("o_orderkey")
    v = src.table(spark, d, "orders").select(k.cast("int").alias("no"), F.col("o_orderpriority").alias("name"), F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    path = folder(spark)
    files = v.groupBy((F.col("no") % 50).alias("file")).agg(F.collect_list(F.struct("no", "name", "date")).alias("victims"))
    files.select("file", F.to_json(F.struct("victims")).alias("value")).write.partitionBy("file").text(path)
    return readers.victims(spark, path).select("no", "name", "date")


@query
def media_volume(spark: SparkSession, d: str) -> DataFrame:
    """A daily timeline summed to months."""
    days = src.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("volume"))
    compact = F.when(F.dayofmonth("day") % 2 == 0, F.date_format("day", "yyyyMMdd'T'000000'Z'")).otherwise(F.col("day").cast("string"))
    path = one_document(days.select(compact.alias("date"), "volume"), "timeline", folder(spark))
    return readers.media_volume(spark, path)


@query
def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    n = src.table(spark, d, "nation").select(F.col("n_name").alias("file"), F.lit("s").alias("source"), F.when(F.col("n_nationkey") % 2 == 0, "many").otherwise(F.col("n_nationkey").cast("string")).alias("rows_or_features"), F.lit("2024").alias("retrieved_at"))
    return readers.manifest(spark, one_document(n, "files", folder(spark))).select("file", "rows_or_features")


@query
def zone_file(spark: SparkSession, d: str) -> DataFrame:
    """Zones numbered in the order of the file, without "County" in the name."""
    n = src.table(spark, d, "nation").select(F.concat("n_name", F.lit(" county")).alias("name"), F.col("n_nationkey").alias("code"), (F.col("n_nationkey") * 1000).cast("long").alias("population2019"))
    return readers.zone_file(spark, one_document(n, "counties", folder(spark)))


# ---- sinks ----


@query
def overwritten_in_place(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    src.table(spark, d, "nation").select("n_nationkey", F.lit(1).alias("v")).write.parquet(path)
    sinks.overwrite_staged(spark.read.parquet(path).withColumn("v", F.col("v") + F.col("n_nationkey")), path, f"{path}-stage")
    return spark.read.parquet(path)


@query
def appended_and_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows and the new ones they lack, in order again and counted."""
    o = src.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return sinks.append_sorted(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").unionAll(o.where("o_orderkey % 2 = 0")), "o_orderkey", ["day", "o_orderkey"])


@query
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_lines(src.table(spark, d, "nation").select("n_nationkey", "n_name"))


@query
def digest_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The figures of a digest, read back from its text."""
    n = src.incidents(spark, d).count()
    zones = src.zones(spark, d).select("zone_id", "zone_name", F.lit(50.0).alias("index"), F.lit("watch").alias("band"))
    none = spark.createDataFrame([], "place int, severity string, title string")
    text = sinks.markdown_digest({"documented": n, "d_documented": -n, "estimated": 2 * n}, zones, none)
    return sinks.headline_numbers(spark.createDataFrame([(text,)], "text string"))


@query
def webhook_kinds(spark: SparkSession, d: str) -> DataFrame:
    """An address per page, of each kind of host and fragment, with the body that would be posted there."""
    k = F.col("page_id")
    host = F.when(k % 3 == 0, "hooks.slack.com/services/").when(k % 3 == 1, "discord.com/api/webhooks/").otherwise("example.org/hook/")
    tail = F.when(k % 4 == 1, "#json").when(k % 4 == 2, "#slack").when(k % 4 == 3, "#other").otherwise("")
    p = src.table(spark, d, "pages").select("page_id", F.concat(F.lit("https://"), host, k.cast("string"), tail).alias("url"), F.length("html").cast("long").alias("size"))
    p = p.withColumn("kind", sinks.webhook_kinds(F.col("url")))
    return p.select("page_id", "url", "kind", sinks.webhook_bodies(F.col("kind"), F.concat(F.lit("Page "), k), F.lit("A page's size"), F.struct("size")).alias("body"))


@query
def incident_register(spark: SparkSession, d: str) -> DataFrame:
    """The union of two lists, every third pair of neighbours one incident: statuses, counties and sources merged."""
    k = F.col("p_partkey")
    r = src.table(spark, d, "part").select(k.alias("record_id"), F.date_add(F.lit("2020-01-01").cast("date"), (k % 700).cast("int")).alias("date"), F.when(k % 5 > 0, F.col("p_brand")).alias("county"), F.when(k % 7 == 0, "unknown").otherwise("documented").alias("status"), F.col("p_type").alias("category"), F.concat(F.lit("source "), k % 4).alias("source_name"), F.concat(F.lit("https://example.org/"), k).alias("source_url"))
    a, b = r.where("record_id % 2 = 0"), r.where("record_id % 2 = 1")
    pairs = a.where("record_id % 6 = 0").select(F.col("record_id").alias("a_id"), (F.col("record_id") + 1).alias("b_id")).join(b.select(F.col("record_id").alias("b_id")), "b_id")
    return entity.register(a, b, pairs)


@query
def snapshot_written(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    sinks.write_snapshot(spark, {"orders": src.table(spark, d, "orders").count()}, path)
    sinks.write_snapshot(spark, {"orders": -1}, path, dry_run=True)
    return spark.read.schema("orders LONG").json(path)


# ---- filters, joins, aggregates, functions ----


@query
def outside_country(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("o_orderkey") % 3 == 0, "Kampala road").when(F.col("o_orderkey") % 3 == 1, "Nairobi (outside Parliament)").otherwise("Busia, Outside Kenya")
    return src.table(spark, d, "orders").select("o_orderkey", news.outside_country(place).alias("outside"))


@query
def recent_terms(spark: SparkSession, d: str) -> DataFrame:
    """Articles with a term of the last 60 days; an article without a date counts as of today."""
    as_of = F.lit("2024-03-30").cast("date")
    a = src.table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 != 0, F.date_sub(as_of, (F.col("doc_id") % 120).cast("int"))).alias("pub"))
    return news.matching(a, ["that", "with"], F.col("text"), "pub", as_of).select("doc_id", "pub", F.array_join("matched_terms", ",").alias("terms"))


@query
def loose_key_join(spark: SparkSession, d: str) -> DataFrame:
    n = src.table(spark, d, "nation")
    a = n.select("n_nationkey", T.loose_key(F.concat(F.substring("n_name", 1, 3), F.lit(" - "), F.substring("n_name", 4, 99))).alias("k"))
    b = n.select(F.col("n_nationkey").alias("other"), T.loose_key(F.concat(F.lower("n_name"), F.lit("’"))).alias("k"))
    return a.join(b, "k").select("n_nationkey", "other", "k")


@query
def alnum_key_join(spark: SparkSession, d: str) -> DataFrame:
    n = src.table(spark, d, "nation")
    a = n.select("n_nationkey", T.alnum_key(F.concat(F.lit("_"), "n_name", F.lit("!"))).alias("k"))
    return a.join(n.select(F.col("n_nationkey").alias("other"), T.alnum_key("n_name").alias("k")), "k").select("n_nationkey", "other", "k")


@query
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Cases per status, statuses without cases included."""
    s = src.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("status"))
    return news.status_counts(s)


@query
def case_queue_merged(spark: SparkSession, d: str) -> DataFrame:
    """The queue after a sweep: cases that were decided stay as they are, others only if they are seen again."""
    k = F.col("o_orderkey")
    o = src.table(spark, d, "orders")
    case = lambda day, status: (k.cast("string").alias("case_id"), status.alias("status"), F.lit(day).alias("first_seen"), F.lit(day).alias("last_seen"), F.lit(day).alias("latest_pub_date"))
    before = o.where("o_orderkey % 2 = 0").select(*case("d0", F.when(k % 8 == 0, "promoted").when(k % 8 == 2, "rejected").otherwise("pending")))
    return news.merge_case_state(before, o.where("o_orderkey % 3 = 0").select(*case("d8", F.lit("ready"))), F.lit("d9"))


def queue_of_cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as cases with their coverage, and the decisions to promote every sixth of them."""
    k = F.col("o_orderkey")
    o = src.table(spark, d, "orders").select(k, F.to_date("o_orderdate").alias("day"))
    url = lambda n: F.concat(F.lit(f"https://example.org/{n}/"), k)
    cases = o.select(F.concat(F.lit("Case_"), k).alias("case_id"), F.when(k % 12 == 0, "promoted").otherwise("ready").alias("status"), F.when(k % 4 > 0, F.concat(F.lit("person "), k % 9)).alias("person"), F.col("day").alias("pub_date"), F.lit(2).alias("corroboration"), F.array(F.concat(F.lit("outlet "), k % 5), F.lit("other")).alias("outlets"), F.array(url("a"), url("b")).alias("urls"), F.lit(None).cast("date").alias("promoted_on"), F.lit(None).cast("string").alias("record_id"))
    none = F.lit(None).cast("string")
    chosen = o.where("o_orderkey % 6 = 0").select(F.concat(F.lit("Case_"), k).alias("case_id"), F.when(k % 18 == 0, F.concat(F.lit("Rec "), k)).alias("record_id"), F.when(k % 5 == 0, F.date_add("day", 1)).alias("date"), none.alias("person"), F.when(k % 10 == 0, "missing").alias("status"), none.alias("category"), none.alias("curator"))
    return cases, chosen


def today():
    return F.lit("2001-08-02").cast("date")


@query
def case_promotions(spark: SparkSession, d: str) -> DataFrame:
    """The register after the decisions, in order and counted; decisions sent twice change nothing."""
    cases, chosen = queue_of_cases(spark, d)
    records = news.promotions(cases, chosen.unionAll(chosen), today()).drop("case_id")
    stored = cases.where("status = 'promoted'").select(F.lower(F.regexp_replace("case_id", "_", "")).alias("id"), F.col("pub_date").alias("date"))
    return sinks.append_sorted(stored.withColumns({c: F.lit(None).cast("string") for c in records.columns if c not in ("id", "date")}), records, "id", ["date", "id"])


@query
def cases_marked_promoted(spark: SparkSession, d: str) -> DataFrame:
    cases, chosen = queue_of_cases(spark, d)
    return news.mark_promoted(cases, news.promotions(cases, chosen, today()), today()).select("case_id", "status", "promoted_on", "record_id")


@query
def manifest_after_promotion(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's entry of the register counts the records that were promoted."""
    n = src.table(spark, d, "nation").select(F.col("n_name").alias("file"), F.lit("some").alias("rows_or_features"), F.lit("2000-01-01").alias("retrieved_at"))
    cases, chosen = queue_of_cases(spark, d)
    return sinks.counted(n, "KENYA", news.promotions(cases, chosen, today()), "incidents", today())


@query
def month_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    m = C.month_key("o_orderdate")
    return src.table(spark, d, "orders").select("o_orderkey", C.add_months_key(m, 3).alias("later"), C.add_months_key(m, -14).alias("earlier"), F.unix_seconds(C.end_of_month(m)).alias("end_s"), C.months_between_keys(F.lit("2001-08-02").cast("date"), F.col("o_orderdate")).alias("months"))


@query
def logistic_values(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "events").select("event_id", C.micro(C.logistic((F.col("value") - 50) / 7)).alias("p"))


@query
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Slug, stem of the first word, and the name without its outlet, of every part."""
    name = F.concat("p_name", F.lit(" - "), "p_brand")
    return src.table(spark, d, "part").select("p_partkey", T.slug(F.concat(F.lit(" "), "p_name", F.lit("!"))).alias("slug"), T.stem(F.concat(F.get(F.split("p_name", " "), F.lit(0)), F.lit("ing"))).alias("stem"), T.strip_outlet(name).alias("core"))


@query
def serial_dates(spark: SparkSession, d: str) -> DataFrame:
    """Serial day numbers of workbooks and compact stamps of feeds as dates; numbers in texts, what is none being 0."""
    k = F.col("o_orderkey")
    return src.table(spark, d, "orders").select(k, C.excel_date(k % 50000).alias("day"), C.compact_timestamp_date(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")).alias("stamp"), C.number_or_zero(F.when(k % 3 == 0, "x").when(k % 3 == 1, "NaN").otherwise("1.5")).alias("number"))


_O = "CAST(o_orderdate AS DATE)"
_PLACE = "CASE WHEN o_orderkey % 9 IN (1, 2) THEN NULL WHEN o_orderkey % 9 = 0 THEN -1e0 ELSE o_orderkey % 80 / 10e0 - 4 END"
_LNG = "CASE WHEN o_orderkey % 18 = 0 THEN -1e0 ELSE 34 + o_orderkey % 70 / 10e0 END"
_MONTHS = "(SELECT strftime(i, '%Y-%m') AS month, count(*) AS ed FROM (SELECT CAST(o_orderdate AS DATE) AS i FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT','2-HIGH') OR o_orderstatus = 'F' OR o_orderkey % 7 = 0) WHERE i < DATE '2001-08-01' GROUP BY ALL)"
_TITLE = "p_name || ' ' || p_type || ' & more'"

SQL: dict[str, str] = {
    "json_scan": "SELECT n_nationkey, n_name FROM nation",
    "json_with_fallback": "SELECT 'missing' AS file, 0 AS n UNION ALL SELECT 'corrupt', 0 UNION ALL SELECT 'good', count(*) FROM region",
    "optional_sightings": "SELECT event_id AS sighting_id, CAST(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS BIGINT) + 36000 AS at_s, 'v' || user_id AS vehicle_key, 'zone ' || event_id % 25 AS zone_name FROM events WHERE event_type = 'view'",
    "event_csv": f"SELECT * FROM (SELECT o_orderkey AS event_id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderkey % 3 + 1 AS INTEGER) AS type_of_violence, {_O} AS date_start, CASE WHEN o_orderkey % 11 = 0 THEN 0e0 ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS best, 0e0 AS civilians, floor(({_PLACE}) * 1e6 + 0.5) / 1e6 AS lat, floor(({_LNG}) * 1e6 + 0.5) / 1e6 AS lng, 'near \"' || o_orderpriority || '\", road' AS place FROM orders) WHERE lat IS NOT NULL AND NOT (lat = -1 AND lng = -1)",
    "event_csv_refreshed": "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS best FROM orders WHERE o_orderkey % 2 = 0",
    "geojson_edges": "SELECT n_name AS zone_name, 0 AS ring, seq, floor((lng + 0.4e0 * ax) * 1e6 + 0.5) / 1e6 AS x1, floor((lat + 0.4e0 * ay) * 1e6 + 0.5) / 1e6 AS y1, floor((lng + 0.4e0 * bx) * 1e6 + 0.5) / 1e6 AS x2, floor((lat + 0.4e0 * by_) * 1e6 + 0.5) / 1e6 AS y2 FROM (SELECT n_name, -4e0 + 0.85e0 * (n_nationkey % 5) AS lat, 34e0 + 0.85e0 * floor(n_nationkey / 5e0) AS lng FROM nation) CROSS JOIN (VALUES (1,-1,-1,1,-1),(2,1,-1,1,1),(3,1,1,-1,1),(4,-1,1,-1,-1)) AS e(seq,ax,ay,bx,by_)",
    "workbook_scan": "SELECT n_name AS zone, 2 AS n, DATE '1899-12-30' + (45292 + 14 * n_nationkey) AS last_week FROM nation",
    "rss_items": f"SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 OR length({_TITLE}) <= 30 THEN {_TITLE} || ' - ' || p_brand ELSE {_TITLE} END AS title, 'http://a/?x=1&k=' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN 'The Source' WHEN length({_TITLE}) > 30 THEN p_brand ELSE 'news' END AS source, DATE '2024-01-01' + CAST(p_partkey % 28 AS INTEGER) AS pub_date FROM part WHERE p_partkey % 5 <> 0",
    "victim_tables": f"SELECT CAST(o_orderkey AS INTEGER) AS no, o_orderpriority AS name, 'place ' || o_custkey AS location, CASE WHEN o_orderkey % 4 <> 1 THEN {_O} END AS date FROM orders",
    "chart_points": f"SELECT month, CAST(greatest(ed, CASE WHEN ed % 2 = 1 THEN ed + 5 ELSE ed - 5 END) AS DOUBLE) AS value FROM {_MONTHS}",
    "last_good_wins": "SELECT n_nationkey, f AS fetch FROM nation CROSS JOIN (SELECT unnest(['failed', 'none']) AS f) UNION ALL SELECT r_regionkey, 'good' FROM region",
    "relief_reports": "SELECT CAST(doc_id AS VARCHAR) AS title, doc_id % 100 AS date, source, substring(text, 1, 400) AS summary FROM documents WHERE lang = 'fr' ORDER BY date DESC, title LIMIT 50",
    "monthly_series": f"SELECT month, CAST(CASE WHEN ed % 5 = 0 THEN 0 ELSE ed END AS INTEGER) AS disappearances, 0 AS killings, CAST(CASE WHEN ed % 5 = 0 THEN 0 ELSE ed END AS INTEGER) AS incidents FROM {_MONTHS} WHERE substring(month, 1, 4) <> '1996'",
    "victims_with_dates": "SELECT CAST(o_orderkey AS INTEGER) AS no, o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey % 3 <> 0 OR (month(o_orderdate) >= 10 AND day(o_orderdate) >= 10)",
    "media_volume": "SELECT strftime(ts, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL",
    "manifest_rows": "SELECT n_name AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'many' ELSE CAST(n_nationkey AS VARCHAR) END AS rows_or_features FROM nation",
    "zone_file": "SELECT CAST(row_number() OVER (ORDER BY n_name || ' county') AS INTEGER) AS zone_id, n_name AS zone_name, n_nationkey AS code, CAST(n_nationkey * 1000 AS BIGINT) AS population FROM nation",
    "overwritten_in_place": "SELECT n_nationkey, 1 + n_nationkey AS v FROM nation",
    "appended_and_sorted": f"SELECT o_orderkey, {_O} AS day, CAST(row_number() OVER (ORDER BY {_O}, o_orderkey) - 1 AS BIGINT) AS place, count(*) OVER () AS total FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
    "json_documents": "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation",
    "digest_numbers": "SELECT n AS documented, -n AS change, 2 * n AS estimated FROM (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT','2-HIGH') OR o_orderstatus = 'F' OR o_orderkey % 7 = 0)",
    "webhook_kinds": """SELECT page_id, url, kind, CASE kind WHEN 'slack' THEN '{"text":"Page ' || page_id || '","blocks":[{"type":"section","text":{"type":"mrkdwn","text":"*Page ' || page_id || '*\\nA page''s size"}}]}'
        WHEN 'discord' THEN '{"content":"**Page ' || page_id || '**\\nA page''s size"}' ELSE '{"title":"Page ' || page_id || '","text":"A page''s size","metrics":{"size":' || length(html) || '}}' END AS body
        FROM (SELECT page_id, html, 'https://' || [ 'hooks.slack.com/services/', 'discord.com/api/webhooks/', 'example.org/hook/'][page_id % 3 + 1] || page_id || ['', '#json', '#slack', '#other'][page_id % 4 + 1] AS url,
            CASE WHEN page_id % 4 = 1 THEN 'json' WHEN page_id % 4 = 2 THEN 'slack' ELSE ['slack', 'discord', 'json'][page_id % 3 + 1] END AS kind FROM pages)""",
    "incident_register": """WITH r AS (SELECT p_partkey AS k, DATE '2020-01-01' + CAST(p_partkey % 700 AS INTEGER) AS date, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS county, CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE 'documented' END AS status,
            p_type AS category, 'source ' || p_partkey % 4 AS s, 'https://example.org/' || p_partkey AS u FROM part),
        a AS (SELECT * FROM r WHERE k % 2 = 0), b AS (SELECT * FROM r WHERE k % 2 = 1)
        SELECT a.k AS id_a, b.k AS id_b, coalesce(a.date, b.date) AS date, coalesce(a.county, b.county) AS county, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b, coalesce(b.status, a.status) AS status, coalesce(a.category, b.category) AS category,
            concat_ws(' + ', a.s, b.s) AS source_name, coalesce(b.u, a.u) AS source_url FROM a FULL JOIN b ON b.k = a.k + 1 AND a.k % 6 = 0""",
    "snapshot_written": "SELECT count(*) AS orders FROM orders",
    "outside_country": "SELECT o_orderkey, o_orderkey % 3 <> 1 AS outside FROM orders",
    "recent_terms": "SELECT doc_id, coalesce(pub, DATE '2024-03-30') AS pub, array_to_string(t, ',') AS terms FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN DATE '2024-03-30' - CAST(doc_id % 120 AS INTEGER) END AS pub, list_filter(['that', 'with'], lambda x: contains(lower(text), x)) AS t FROM documents) WHERE len(t) > 0 AND (pub IS NULL OR pub >= DATE '2024-03-30' - 60)",
    "loose_key_join": "SELECT n_nationkey, n_nationkey AS other, replace(lower(n_name), ' ', '') AS k FROM nation",
    "alnum_key_join": "SELECT n_nationkey, n_nationkey AS other, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS k FROM nation",
    "status_histogram": "SELECT s AS status, count(o_orderkey) AS n FROM (SELECT unnest(['pending', 'ready', 'promoted', 'rejected']) AS s) LEFT JOIN orders ON s = CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'pending' ELSE 'rejected' END GROUP BY s",
    "case_queue_merged": "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CASE WHEN o_orderkey % 8 = 0 THEN 'promoted' WHEN o_orderkey % 8 = 2 THEN 'rejected' ELSE 'ready' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'd0' ELSE 'd9' END AS first_seen, 'd9' AS last_seen, CASE WHEN o_orderkey % 3 = 0 THEN 'd8' ELSE 'd0' END AS latest_pub_date FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 8 IN (0, 2)",
    "case_promotions": f"""SELECT *, CAST(row_number() OVER (ORDER BY date, id) - 1 AS BIGINT) AS place, count(*) OVER () AS total FROM (
        SELECT CASE WHEN o_orderkey % 18 = 0 THEN 'rec' || o_orderkey ELSE 'case' || o_orderkey END AS id, {_O} + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS date, CASE WHEN o_orderkey % 4 > 0 THEN 'person ' || o_orderkey % 9 ELSE 'Unknown' END AS person, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' ELSE 'returned' END AS status, 'abduction' AS category,
        'outlet ' || o_orderkey % 5 AS source_name, 'https://example.org/a/' || o_orderkey AS source_url, 'Seen in 2 outlets (outlet ' || o_orderkey % 5 || ', other), promoted on 2001-08-02 by curator. Coverage: https://example.org/a/' || o_orderkey || ' ; https://example.org/b/' || o_orderkey AS notes
        FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0 UNION ALL SELECT 'case' || o_orderkey, {_O}, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 12 = 0)""",
    "cases_marked_promoted": """SELECT 'Case_' || o_orderkey AS case_id, CASE WHEN o_orderkey % 6 = 0 THEN 'promoted' ELSE 'ready' END AS status, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0 THEN DATE '2001-08-02' END AS promoted_on,
        CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0 THEN CASE WHEN o_orderkey % 18 = 0 THEN 'rec' || o_orderkey ELSE 'case' || o_orderkey END END AS record_id FROM orders""",
    "manifest_after_promotion": "SELECT n_name AS file, CASE WHEN n_name = 'KENYA' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0) || ' incidents' ELSE 'some' END AS rows_or_features, CASE WHEN n_name = 'KENYA' THEN '2001-08-02' ELSE '2000-01-01' END AS retrieved_at FROM nation",
    "month_arithmetic": "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m') AS later, strftime(o_orderdate - INTERVAL 14 MONTH, '%Y-%m') AS earlier, CAST(epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS BIGINT) - 1 AS end_s, CAST((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) AS INTEGER) AS months FROM orders",
    "logistic_values": "SELECT event_id, floor(1 / (1 + exp(-(value - 50) / 7)) * 1e6 + 0.5) / 1e6 AS p FROM events",
    "text_keys": "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, string_split(p_name, ' ')[1] AS stem, p_name AS core FROM part",
    "serial_dates": f"SELECT o_orderkey, DATE '1899-12-30' + CAST(o_orderkey % 50000 AS INTEGER) AS day, {_O} AS stamp, CASE WHEN o_orderkey % 3 = 2 THEN 1.5e0 ELSE 0e0 END AS number FROM orders",
    "anchor_index_top": """SELECT ref, arg_min(title, page_id * 100000 + k) AS title FROM (SELECT page_id, k, r[k] AS ref, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t[k], '<[^>]+>', '', 'g'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS title
        FROM (SELECT page_id, r, t, unnest(range(1, len(r) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<a[^>]+href="[^"]*/([^"/?#]+)[^"]*"[^>]*>(.*?)</a>', 1) AS r, regexp_extract_all(html, '(?s)<a[^>]+href="[^"]*/([^"/?#]+)[^"]*"[^>]*>(.*?)</a>', 2) AS t FROM pages)))
        WHERE title <> '' GROUP BY ref ORDER BY ref DESC LIMIT 10""",
}
