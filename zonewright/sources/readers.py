"""Readers of the engine's raw inputs: JSON, CSV, GeoJSON, feeds, pages and workbooks. All read through Spark, from any store it reaches."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import compact_timestamp_date, iso_date, number_or_zero
from ..functions.text import canonical_zone, decode_entities, strip_tags


def json_required(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON document or array; a missing file is an error."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_optional(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The same, but a missing file is an empty table and a corrupt one gives rows without values, which are dropped."""
    try:
        got = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return got.dropna("all")


def zone_file(spark: SparkSession, path: str) -> DataFrame:
    """zone_id in file order, zone_name without "County", code, population. The file is one document, so order is kept inside one row."""
    doc = json_required(spark, path, "counties ARRAY<STRUCT<name: STRING, code: INT, population2019: BIGINT>>")
    rows = doc.select(F.posexplode("counties").alias("_k", "c"))
    return rows.select((F.col("_k") + 1).cast("int").alias("zone_id"), canonical_zone("c.name").alias("zone_name"), "c.code", F.col("c.population2019").alias("population"))


def event_csv(spark: SparkSession, path: str) -> DataFrame:
    """Events by header name; quotes are doubled inside quotes, no line breaks in fields. Rows without a place, or with the place (-1, -1), go."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False)
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    got = raw.select(F.col("id").try_cast("long").alias("event_id"), F.col("year").try_cast("int").alias("year"), F.col("type_of_violence").try_cast("int").alias("type_of_violence"), F.to_date(F.substring("date_start", 1, 10)).alias("date_start"), number_or_zero("best").alias("best"), number_or_zero("deaths_civilians").alias("civilians"), lat.alias("lat"), lng.alias("lng"), F.col("where_description").alias("place"))
    return got.where(sane_place(F.col("lat"), F.col("lng")))


def sane_place(lat: Column, lng: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return finite(lat) & finite(lng) & ~((lat == -1) & (lng == -1))


def refresh_event_csv(spark: SparkSession, source: str, target: str, country: str, columns: list[str]) -> None:
    """Rewrite a large export to the rows of one country and the columns in use."""
    raw = spark.read.csv(source, header=True, quote='"', escape='"')
    raw.where(F.col("country") == country).select(*columns).write.mode("overwrite").csv(target, header=True)


def geojson_edges(spark: SparkSession, path: str) -> DataFrame:
    """Polygons and multi-polygons as edges: zone_name, ring, seq, x1, y1, x2, y2. The name is the first of five properties; features without one go."""
    polygon = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    doc = json_required(spark, path, "features ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>")
    f = doc.select(F.explode("features").alias("f")).select("f.*")
    name = canonical_zone(F.coalesce(*(F.col("properties")[k] for k in ("COUNTY", "county", "name", "NAME_1", "ADM1_EN"))))
    f = f.select(name.alias("zone_name"), F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("c")).where("zone_name <> '' AND lower(zone_name) <> 'null'")
    parts = F.when(F.col("kind") == "Polygon", F.from_json("c", polygon)).otherwise(F.flatten(F.from_json("c", f"ARRAY<{polygon}>")))
    ring = f.select("zone_name", F.posexplode(parts).alias("ring", "r"))
    n = F.size("r")
    # an edge from each corner to the next, the last one back to the first
    edge = F.transform("r", lambda p, i: F.struct((i + 1).alias("seq"), p[0].alias("x1"), p[1].alias("y1"), F.get(F.col("r"), (i + 1) % n)[0].alias("x2"), F.get(F.col("r"), (i + 1) % n)[1].alias("y2")))
    return ring.select("zone_name", "ring", F.inline(edge))


def monthly_series(spark: SparkSession, path: str) -> DataFrame:
    """month, disappearances, killings, incidents from records of parallel arrays; other record types go, missing numbers are 0."""
    doc = json_required(spark, path, StructType.fromDDL("statistics ARRAY<STRUCT<type: STRING, year: STRING, months: ARRAY<STRING>, enforced_disappearances: ARRAY<INT>, police_killings: ARRAY<INT>, incidents: ARRAY<INT>>>"))
    r = doc.select(F.explode("statistics").alias("s")).select("s.*").where("type = 'monthly_series'")
    z = r.select("year", F.posexplode("months").alias("i", "m"), "enforced_disappearances", "police_killings", "incidents")
    number = lambda c: F.coalesce(F.get(F.col(c), F.col("i")), F.lit(0))
    month = F.to_date(F.concat_ws(" ", F.lit("1"), F.initcap(F.substring("m", 1, 3)), "year"), "d MMM yyyy")
    return z.select(F.date_format(month, "yyyy-MM").alias("month"), number("enforced_disappearances").alias("disappearances"), number("police_killings").alias("killings"), number("incidents").alias("incidents"))


def victims(spark: SparkSession, path: str) -> DataFrame:
    """The victim list, only rows with a full ISO date."""
    doc = json_required(spark, path, StructType.fromDDL("victims ARRAY<STRUCT<no: INT, name: STRING, age: INT, sex: STRING, location: STRING, mannerOfDeath: STRING, date: STRING, sourceUrl: STRING>>"))
    return doc.select(F.explode("victims").alias("v")).select("v.*").where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))


def media_volume(spark: SparkSession, path: str) -> DataFrame:
    """month, volume from a daily or monthly timeline; days are summed."""
    doc = json_optional(spark, path, StructType.fromDDL("monthly ARRAY<STRUCT<month: STRING, volume: DOUBLE>>, timeline ARRAY<STRUCT<date: STRING, volume: DOUBLE>>"))
    monthly = doc.select(F.explode("monthly").alias("m")).select("m.month", "m.volume")
    day = F.coalesce(compact_timestamp_date("t.date"), F.col("t.date").try_cast("date"))
    daily = doc.where("monthly IS NULL OR size(monthly) = 0").select(F.explode("timeline").alias("t")).select(F.date_format(day, "yyyy-MM").alias("month"), F.col("t.volume").alias("volume"))
    return monthly.unionByName(daily).where("month IS NOT NULL").groupBy("month").agg(F.sum("volume").alias("volume"))


def vehicle_sightings(spark: SparkSession, path: str) -> DataFrame:
    """sighting_id, sighted_at (10:00 UTC of the day), vehicle_key, zone_name from nested cases; a missing file has none."""
    doc = json_optional(spark, path, StructType.fromDDL("vehicles ARRAY<STRUCT<vehicleKey: STRING, sourceUrls: ARRAY<STRING>, sightings: ARRAY<STRUCT<id: STRING, date: STRING, zoneName: STRING, source: STRING>>>>"))
    s = doc.select(F.explode("vehicles").alias("v")).select(F.col("v.vehicleKey").alias("vehicle_key"), F.explode("v.sightings").alias("s"))
    return s.select(F.col("s.id").alias("sighting_id"), F.to_timestamp(F.concat("s.date", F.lit(" 10:00:00"))).alias("sighted_at"), "vehicle_key", F.col("s.zoneName").alias("zone_name"), F.col("s.source").alias("source"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The provenance list; counts that are sometimes texts are read as texts."""
    doc = json_required(spark, path, StructType.fromDDL("files ARRAY<STRUCT<file: STRING, source: STRING, rows_or_features: STRING, retrieved_at: STRING>>"))
    return doc.select(F.explode("files").alias("f")).select("f.*")


# ---- feeds and pages: text columns in, rows out ----


def rss_items(feeds: DataFrame, xml: str = "xml", keys: tuple[str, ...] = ()) -> DataFrame:
    """title, url, source, pub_date of each <item>. Without a <source>, a title "... - Publisher" whose dash is beyond place 30 is split. Items without title or link go."""
    tag = lambda name: F.regexp_extract(F.col("item"), rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    items = feeds.select(*keys, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("ord", "item"))
    items = items.select(*keys, "ord", strip_tags(tag("title")).alias("t"), decode_entities(F.trim(tag("link"))).alias("url"), strip_tags(tag("source")).alias("s"), F.trim(tag("pubDate")).alias("p"))
    dash = F.length("t") - F.locate(" - ", F.reverse("t")) - 2  # characters before the last " - "
    split = (F.col("s") == "") & (F.locate(" - ", F.col("t")) > 0) & (dash > 30)
    title = F.when(split, F.trim(F.substring(F.col("t"), F.lit(1), dash))).otherwise(F.col("t"))
    source = F.when(split, F.trim(F.substring(F.col("t"), dash + 4, F.length("t")))).otherwise(F.col("s"))
    when = F.to_date(F.try_to_timestamp(F.regexp_replace(F.regexp_extract("p", r"(\d{1,2} \w{3} \d{4})", 1), r"^(\d) ", "0$1 "), F.lit("dd MMM yyyy")))
    return items.where("t <> '' AND url <> ''").select(*keys, "ord", title.alias("title"), "url", F.when(source == "", "news").otherwise(source).alias("source"), when.alias("pub_date"))


def anchors(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """key, ref, title: links whose address has `pattern` (one group: the reference), the first title per page and reference, tags stripped."""
    link = rf'(?s)<a[^>]+href="[^"]*{pattern}[^"]*"[^>]*>(.*?)</a>'
    refs, titles = F.regexp_extract_all(F.col(html), F.lit(link), F.lit(1)), F.regexp_extract_all(F.col(html), F.lit(link), F.lit(2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(refs.alias("r"), titles.alias("t"))).alias("k", "x"))
    titled = rows.select(key, "k", F.col("x.r").alias("ref"), strip_tags("x.t").alias("title")).where("title <> ''")
    return titled.groupBy(key, "ref").agg(F.min_by("title", "k").alias("title"))


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, row, cells (texts) of every table row that has cells."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), strip_tags)
    return rows.select(key, "row", cells.alias("cells")).where(F.size("cells") > 0)


def victim_table(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, no, name, location, date from tables whose rows are number, name, place and date. A date that is no ISO date is read from its
    words ("3 May 2024"); where that fails too it is null. Rows without a number go."""
    cell = lambda k: F.get(F.col("cells"), F.lit(k))
    words = F.regexp_extract(cell(3), r"(\d{1,2} [A-Za-z]{3,9} \d{4})", 1)
    short = F.regexp_replace(words, r"^(\d{1,2} [A-Za-z]{3})[a-z]*", "$1")
    date = F.coalesce(iso_date(cell(3)), F.to_date(F.try_to_timestamp(short, F.lit("d MMM yyyy"))))
    rows = table_rows(pages, key, html)
    return rows.select(key, cell(0).try_cast("int").alias("no"), cell(1).alias("name"), cell(2).alias("location"), date.alias("date")).where("no IS NOT NULL")


def chart_points(pages: DataFrame, key: str, html: str, attribute: str) -> DataFrame:
    """key, month, value from charts embedded as JSON in an attribute; of several charts the largest value per month stays."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf'{attribute}="([^"]*)"'), F.lit(1))
    charts = pages.select(key, F.explode(found).alias("j")).select(key, F.from_json(decode_entities("j"), "labels ARRAY<STRING>, data ARRAY<DOUBLE>").alias("c"))
    points = charts.select(key, F.explode(F.arrays_zip("c.labels", "c.data")).alias("p")).select(key, F.col("p.labels").alias("month"), F.col("p.data").alias("value"))
    return points.groupBy(key, "month").agg(F.max("value").alias("value"))


# ---- workbooks ----


def column_index(letters: str) -> int:
    """A to 0, Z to 25, AA to 26."""
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROW, _ROWS_END = re.compile(rb"<(?:\w+:)?row[\s>/]"), re.compile(rb"</(?:\w+:)?sheetData")
_CHUNK = 1 << 20


def _opened(path: str) -> zipfile.ZipFile:
    fs, there = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return zipfile.ZipFile(fs.open_input_file(there))


def _first_sheet(z: zipfile.ZipFile) -> zipfile.ZipInfo:
    return z.getinfo(sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0])


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, e in ET.iterparse(f):
                if e.tag == f"{_NS}si":
                    out.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                    e.clear()
    return out


def _row_bytes(z: zipfile.ZipFile, start: int, end: int, most: int | None = None) -> tuple[bytes, bytes]:
    """The sheet's opening tags, and its rows that begin at bytes start to end of the inflated sheet (the first `most` of them), whole."""
    with z.open(_first_sheet(z)) as f:
        head = b""
        while not (first := _ROW.search(head)) and (more := f.read(_CHUNK)):
            head += more
        if not first:
            return head, b""
        opening = head[: first.start()]
        f.seek(start)
        got, cut, done = f.read(max(0, min(end, start + _CHUNK) - start)), None, False
        while cut is None:
            begins = [m.start() for m in _ROW.finditer(got)]
            late = [k for k in begins if start + k >= end] or (begins[most:] if most and len(begins) > most else [])
            stop = _ROWS_END.search(got)
            if late or stop or done:
                cut = min([*late[:1], *([stop.start()] if stop else []), len(got)])
            else:
                more = f.read(max(_CHUNK, len(got)))
                got, done = got + more, not more
        begins = [k for k in begins if k < cut]
        return opening, got[begins[0] : cut] if begins else b""


def _cells(opening: bytes, rows: bytes, shared: list[str]) -> Iterator[list[str | None]]:
    ends = b"".join(b"</" + t + b">" for t in reversed(re.findall(rb"<((?:\w+:)?(?:worksheet|sheetData))[\s>]", opening)))
    for _, e in ET.iterparse(io.BytesIO(opening + rows + ends)):
        if e.tag != f"{_NS}row":
            continue
        row: list[str | None] = []
        for c in e.iter(f"{_NS}c"):
            k = column_index(re.match(r"[A-Z]+", c.get("r") or "A").group())
            row += [None] * (k + 1 - len(row))
            v = c.find(f"{_NS}v")
            inline = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            row[k] = shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline or None
        e.clear()
        yield row


def workbook(spark: SparkSession, path: str, columns: list[str], part_bytes: int = 16 << 20) -> DataFrame:
    """The first sheet of each workbook under path: file and the columns by header name, all as text.

    A sheet is dealt to tasks by ranges of its inflated bytes; a row goes to the range it begins in. A task inflates what lies before its range
    without parsing it, and holds the workbook's shared strings and one range (a row that is longer, whole). Row tags are
    looked for in the raw bytes, so a sheet must not have one inside a comment or CDATA.
    """

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["path"]:
                with _opened(file) as z:
                    size = _first_sheet(z).file_size
                yield pd.DataFrame({"path": file, "start": range(0, max(size, 1), part_bytes)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared_of: tuple[str, list[str]] = ("", [])
        for b in batches:
            for file, start in zip(b["path"], b["start"], strict=True):
                with _opened(file) as z:
                    if shared_of[0] != file:
                        shared_of = file, _shared_strings(z)
                    opening, top = _row_bytes(z, 0, 1 << 62, 1)
                    header = [(h or "").strip() for h in next(_cells(opening, top, shared_of[1]), [])]
                    at = [header.index(c) for c in columns]
                    opening, rows = _row_bytes(z, int(start), int(start) + part_bytes)
                cells = _cells(opening, rows, shared_of[1]) if rows else iter(())
                if start <= len(opening) < start + part_bytes:
                    next(cells, None)  # the header
                part: list[list] = []
                for r in cells:
                    part.append([file, *(r[k] if k < len(r) else None for k in at)])
                    if len(part) >= 5000:
                        yield pd.DataFrame(part, columns=["file", *columns], dtype=object)
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=["file", *columns], dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path")
    parts = files.mapInPandas(ranges, "path string, start long")
    dealt = parts.repartition(max(1, parts.count()), "path", "start")  # by a number, since their bytes are few and tasks would be merged
    return dealt.mapInPandas(run, "file string, " + ", ".join(f"`{c}` string" for c in columns))


def workbook_profile(rows: DataFrame, week: str, zone: str) -> DataFrame:
    """zone, rows, last week: what a workbook holds per zone."""
    return rows.groupBy(F.col(zone).alias("zone")).agg(F.count("*").alias("n"), F.max(week).alias("last_week"))


def relief_reports(reports: DataFrame, country: str, top: int, chars: int = 400) -> DataFrame:
    """The latest reports on a country: title, date, source and the start of the body."""
    got = reports.where(F.array_contains("countries", country)).orderBy(F.desc("date"), "title").limit(top)
    return got.select("title", "date", "source", F.substring("body", 1, chars).alias("summary"))


def last_good(fresh: DataFrame | None, previous: DataFrame) -> DataFrame:
    """What a failed fetch leaves in place: the fresh table if there is one with rows, else the previous."""
    return previous if fresh is None or fresh.isEmpty() else fresh
