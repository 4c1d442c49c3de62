"""Outputs: staged overwrites, overlays, appends, digests, notification payloads, snapshots."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .entity import checkpointed


def overwrite_staged(df: DataFrame, path: str, stage: str, fmt: str = "parquet") -> None:
    """Overwrite path with df although df may read path: written to a stage first, then from there."""
    df.write.mode("overwrite").format(fmt).save(stage)
    df.sparkSession.read.format(fmt).schema(df.schema).load(stage).write.mode("overwrite").format(fmt).save(path)


def overlay(stored: DataFrame, fresh: DataFrame, key: str, frozen_before: Column | None = None) -> DataFrame:
    """stored with the rows of fresh over it by key; rows before frozen_before keep what is stored."""
    f = fresh.select(F.col(key), *(F.col(c).alias(f"_f_{c}") for c in stored.columns if c != key), F.lit(True).alias("_new"))
    both = stored.withColumn("_old", F.lit(True)).join(f, key, "full_outer")
    use_new = F.coalesce("_new", F.lit(False))
    if frozen_before is not None:
        use_new &= ~(F.coalesce("_old", F.lit(False)) & (F.col(key) < frozen_before))
    return both.select(key, *(F.when(use_new, F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) for c in stored.columns if c != key))


def append_if_absent(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored and the rows of fresh whose key it lacks, one per key."""
    return stored.unionByName(fresh.dropDuplicates([key]).join(stored.select(key), key, "left_anti"), allowMissingColumns=True)


def append_sorted(stored: DataFrame, fresh: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The same with each row's place in the order (from 0) and the total."""
    return placed(append_if_absent(stored, fresh, key), *order)


def placed(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with each one's place in the order (from 0) and the total.

    Rows are dealt in ranges of the order; each range numbers its own rows, to which the sizes of the ranges before are added.
    """
    both = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = both.groupBy("_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return both.join(F.broadcast(sizes), "_range").select(*both.columns[:-1], place.alias("place"), "total")  # a row per range


def counted(manifest: DataFrame, file: str, rows: DataFrame, what: str, today: Column) -> DataFrame:
    """manifest with the entry of one file telling how many rows it has now, and since when; other entries stay."""
    n = rows.agg(F.count("*").alias("_n"))
    own = F.col("file") == file
    values = {"rows_or_features": F.when(own, F.concat(F.col("_n").cast("string"), F.lit(f" {what}"))), "retrieved_at": F.when(own, today.cast("string"))}
    got = manifest.crossJoin(F.broadcast(n))  # one row
    return got.select(*(F.coalesce(values[c], c).alias(c) if c in values else F.col(c) for c in manifest.columns))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def analysis_document(parts: dict[str, DataFrame]) -> DataFrame:
    """json: one document with an array per part, its rows in order of its columns; a part without rows is an empty array.

    Parts are reports that a reader sees whole: a row per place, alert, month or pattern, never per record.
    """
    arrays = [df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)) for name, df in parts.items()]
    row = functools.reduce(lambda a, b: a.crossJoin(F.broadcast(b)), arrays)  # one row each
    return row.select(F.to_json(F.struct(*parts)).alias("json"))


def document_part(document: DataFrame, part: str, schema: str) -> DataFrame:
    """place (from 0) and the columns of schema: one array of such a document, read back."""
    parsed = document.select(F.from_json("json", f"{part} array<struct<{schema}>>").alias("_d"))
    return parsed.select(F.posexplode(f"_d.{part}").alias("place", "_r")).select("place", "_r.*")


def event_summary(events: DataFrame) -> DataFrame:
    """year, type_of_violence, events, deaths."""
    return events.groupBy("year", "type_of_violence").agg(F.count("*").alias("events"), F.sum("best").alias("deaths"))


def snapshot_delta(snapshots: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """Each snapshot with the change of each metric since the one before. Snapshots are one row per run."""
    w = Window.orderBy(order)
    return snapshots.select(order, *metrics, *((F.col(m) - F.lag(m).over(w)).alias(f"d_{m}") for m in metrics))


def markdown_digest(metrics: dict, zones: DataFrame, alerts: DataFrame, top: int = 5) -> str:
    """The weekly digest as text. Only the top zones and the actionable alerts reach the driver."""
    best = zones.orderBy(F.desc("index"), "zone_id").limit(top).collect()
    acute = alerts.where(F.col("severity").isin("critical", "elevated")).orderBy("place").limit(50).collect()
    lines = ["# Weekly digest", "", f"Documented incidents: **{metrics['documented']}** (change {metrics.get('d_documented', 0):+d})", f"Estimated total: **{metrics['estimated']}**", "", "## Zones by index", ""]
    lines += [f"{k}. {z['zone_name']}: {z['index']:.1f} ({z['band']})" for k, z in enumerate(best, 1)]
    lines += ["", "## Alerts", ""] + ([f"- {a['title']}" for a in acute] or ["None at action level."])
    return "\n".join(lines) + "\n"


def analysis_digest(metrics: dict, zones: DataFrame, alerts: DataFrame) -> str:
    """The flat text that an analyst is asked about: totals, every zone in a band above baseline, alert counts by severity."""
    by = {r["severity"]: r["n"] for r in alerts.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    rows = zones.where("band <> 'baseline'").orderBy(F.desc("index"), "zone_id").limit(100).collect()
    head = [f"documented={metrics['documented']}", f"estimated={metrics['estimated']}", "alerts: " + ", ".join(f"{k}={by.get(k, 0)}" for k in ("critical", "elevated", "watch", "info"))]
    return "\n".join(head + [f"{z['zone_name']}: index {z['index']:.1f} band {z['band']} documented {z['documented']}" for z in rows])


def headline_numbers(digest: DataFrame, column: str = "text") -> DataFrame:
    """documented, change and estimated, read back from a digest's text."""
    number = lambda p: F.regexp_extract(column, p, 1).try_cast("long")
    return digest.select(number(r"Documented incidents: \*\*(\d+)\*\*").alias("documented"), number(r"\(change ([+-]?\d+)\)").alias("change"), number(r"Estimated total: \*\*(\d+)\*\*").alias("estimated"))


def webhook_kind(url: str) -> str:
    """slack, discord or json: by the address, unless a #fragment says which."""
    base, _, fragment = url.partition("#")
    if fragment in ("slack", "discord", "json"):
        return fragment
    host = base.split("://")[-1].split("/")[0].lower()
    return "slack" if host == "hooks.slack.com" else "discord" if host in ("discord.com", "discordapp.com") and "/api/webhooks/" in base else "json"


def webhook_kinds(url: Column) -> Column:
    """webhook_kind of a column of addresses."""
    base = F.substring_index(url, "#", 1)
    fragment = F.when(F.contains(url, F.lit("#")), F.regexp_replace(url, "^[^#]*#", "")).otherwise("")
    host = F.lower(F.substring_index(F.regexp_replace(base, "^.*://", ""), "/", 1))
    named = F.when(host == "hooks.slack.com", "slack").when(host.isin("discord.com", "discordapp.com") & F.contains(base, F.lit("/api/webhooks/")), "discord").otherwise("json")
    return F.when(fragment.isin("slack", "discord", "json"), fragment).otherwise(named)


def webhook_bodies(kind: Column, title: Column, text: Column, metrics: Column) -> Column:
    """The body to post to an address of a kind, as JSON; metrics: a struct. Nothing is sent from here."""
    bold = F.concat(F.lit("*"), title, F.lit("*\n"), text)
    section = F.struct(F.lit("section").alias("type"), F.struct(F.lit("mrkdwn").alias("type"), bold.alias("text")).alias("text"))
    slack = F.to_json(F.struct(title.alias("text"), F.array(section).alias("blocks")))
    discord = F.to_json(F.struct(F.substring(F.concat(F.lit("**"), title, F.lit("**\n"), text), 1, 2000).alias("content")))
    return F.when(kind == "slack", slack).when(kind == "discord", discord).otherwise(F.to_json(F.struct(title.alias("title"), text.alias("text"), metrics.alias("metrics"))))


def webhook_payload(url: str, title: str, text: str, metrics: dict) -> str:
    """The body to post; nothing is sent from here."""
    kind = webhook_kind(url)
    if kind == "slack":
        return json.dumps({"text": title, "blocks": [{"type": "section", "text": {"type": "mrkdwn", "text": f"*{title}*\n{text}"}}]})
    if kind == "discord":
        return json.dumps({"content": f"**{title}**\n{text}"[:2000]})
    return json.dumps({"title": title, "text": text, "metrics": metrics})


def write_snapshot(spark: SparkSession, metrics: dict, path: str, dry_run: bool = False) -> None:
    """One row of metrics over the last one; nothing on a dry run."""
    if not dry_run:
        spark.createDataFrame([metrics]).coalesce(1).write.mode("overwrite").json(path)
