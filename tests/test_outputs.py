"""Addresses and bodies of notifications as columns; the merged register's rules."""

import json

from pyspark.sql import functions as F

from zonewright.operators import entity, news, sinks

URLS = ["https://hooks.slack.com/services/x", "https://HOOKS.slack.com/x#json", "https://discord.com/api/webhooks/1", "https://discord.com/other", "https://discordapp.com/api/webhooks/1#slack", "http://example.org/hook#discord", "example.org/a#b", "", "https://x/#", "https://x/#a#json"]


def test_kinds_equal_the_plain_rule(spark):
    got = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", sinks.webhook_kinds(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in got} == {u: sinks.webhook_kind(u) for u in URLS}


def test_bodies_are_json(spark):
    df = spark.createDataFrame([(k, 'A "title"', "text\nof two lines", 5) for k in ("slack", "discord", "json")], "kind string, title string, text string, n long")
    got = {r.kind: json.loads(r.b) for r in df.select("kind", sinks.webhook_bodies(F.col("kind"), F.col("title"), F.col("text"), F.struct("n")).alias("b")).collect()}
    for kind, url in (("slack", URLS[0]), ("discord", URLS[2]), ("json", "https://x")):
        assert got[kind] == json.loads(sinks.webhook_payload(url, 'A "title"', "text\nof two lines", {"n": 5}))


def test_register(spark):
    schema = "record_id long, date string, county string, status string, category string, source_name string, source_url string"
    a = spark.createDataFrame([(1, "d1", None, "documented", "ca", "A", "ua"), (2, "d2", "x", "unknown", "ca", "A", "ua")], schema)
    b = spark.createDataFrame([(11, "e1", "y", "found", "cb", "B", "ub"), (12, "e2", None, None, "cb", "B", None)], schema)
    got = sorted(map(tuple, entity.register(a, b, spark.createDataFrame([(1, 11)], "a_id long, b_id long")).collect()), key=str)
    assert got == sorted([(1, 11, "d1", "y", True, True, "found", "ca", "A + B", "ub"), (2, None, "d2", "x", True, False, "unknown", "ca", "A", "ua"), (None, 12, "e2", None, False, True, None, "cb", "B", None)], key=str)

CASES = "case_id string, status string, person string, pub_date string, corroboration int, outlets array<string>, urls array<string>, promoted_on date, record_id string"
DECISIONS = "case_id string, record_id string, date string, person string, status string, category string, curator string"


def test_promotions(spark):
    cases = spark.createDataFrame(
        [
            ("A-1", "ready", None, "2001-01-01", 2, ["x", "y"], ["u", "v"], None, None),
            ("B", None, "Zed", None, None, [], None, None, None),
            ("C", "promoted", "Old", "2001-01-03", 3, ["x"], ["w"], None, "kept"),
            (None, "ready", "Q", "2001-01-04", 2, ["x"], ["t"], None, None),
        ],
        CASES,
    )
    chosen = spark.createDataFrame([("A-1", "R 2", "2001-02-02", "P", None, "murder", "me"), ("A-1", "R 1", None, None, "missing", None, None), ("B", None, None, None, None, None, None), ("C", "new", None, None, None, None, None), ("Z", "z", None, None, None, None, None), (None, "n", None, None, None, None, None)], DECISIONS)
    day = F.lit("2001-08-02").cast("date")
    got = {r.case_id: r for r in news.promotions(cases, chosen, day).collect()}
    assert set(got) == {"A-1", "B"}
    a, b = got["A-1"], got["B"]
    assert tuple(a)[1:8] == ("R1".lower(), "2001-01-01", "Unknown", "missing", "abduction", "x", "u") and a.notes == "Seen in 2 outlets (x, y), promoted on 2001-08-02 by curator. Coverage: u ; v"
    assert (b.id, b.person, b.source_name, b.source_url, b.notes) == ("b", "Zed", None, None, "Seen in 0 outlets (), promoted on 2001-08-02 by curator. Coverage: ")
    marked = {r.case_id: (r.status, str(r.promoted_on), r.record_id) for r in news.mark_promoted(cases, news.promotions(cases, chosen, day), day).collect()}
    assert marked == {"A-1": ("promoted", "2001-08-02", "r1"), "B": ("promoted", "2001-08-02", "b"), "C": ("promoted", "None", "kept"), None: ("ready", "None", None)}
    assert news.promotions(cases, chosen.limit(0), day).count() == news.promotions(cases.limit(0), chosen, day).count() == 0


def test_counted_manifest(spark):
    m = spark.createDataFrame([("a", "7", "d", 1), ("b", None, None, 2), (None, "x", "y", 3)], "file string, rows_or_features string, retrieved_at string, more int")
    day = F.lit("2001-08-02").cast("date")
    got = {r.file: tuple(r)[1:] for r in sinks.counted(m, "b", m.limit(0), "rows", day).collect()}
    assert got == {"a": ("7", "d", 1), "b": ("0 rows", "2001-08-02", 2), None: ("x", "y", 3)}
    assert {tuple(r) for r in sinks.counted(m, "absent", m, "rows", day).collect()} == {tuple(r) for r in m.collect()}
