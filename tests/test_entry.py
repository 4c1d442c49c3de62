import os

import duckdb
import pytest

import __spark_entry__ as entry

#: One query per kind of plan; the driver compares all of them.
SAMPLED = ("zone_risk_rates", "panel_features", "scan_circles", "vehicle_radius_variant", "composite_index", "gazetteer_strict", "stream_windowed_counts", "connected_components", "capture_patterns_3list", "analysis_document", "analysis_brief", "weekly_digest_text", "analysis_document_whole")


def test_flagship(spark):
    assert entry.entry(spark).count() == 25


def test_twins_exist_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLED)
def test_twin(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(str(v) for v in r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
