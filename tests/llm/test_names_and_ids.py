"""Columns whose names operators use inside, and ids that are texts: all ten operators."""

import pytest
from pyspark.sql import functions as F

from zonewright.llm import common, decontamination, language_id, license_scan, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash, token_counts, tokens

from .helpers import awkward, empty, frame, prose

NAMES = ("_zw_id", "_zw_rk", "_zw_spans", "_zw_n_lines", "_ZW_N_REMOVED", "_zw_k", "_zw_i", "_zw_ki", "_zw_kk", "_h", "_n", "node", "f0", "s0", "bucket", "leaf", "first", "ga", "bin", "at", "ctx", "wid", "spans", "items", "_s", "_w", "_l")


def texts():
    a = "l1\nl2\nl3\nl4"
    return awkward() + [(20, a), (21, a + "\nx"), (30, prose(30, 100)), (31, prose(30, 100) + " end")]


def named(spark):
    return frame(spark, texts()).select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))


def text_ids(df):
    return df.withColumn("doc_id", F.concat(F.lit("d-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")))


def benchmark(spark):
    return spark.createDataFrame([(1, prose(14, 60))], "item_id long, text string")


def labels(spark, df):
    return df.where("doc_id IS NOT NULL").select("doc_id", (F.length("text") % 2).cast("long").alias("quality")).where("quality IS NOT NULL").distinct()


FILTERS = {
    "dedup": lambda spark, df: line_dedup.dedup_lines(df),
    "decontaminate": lambda spark, df: decontamination.decontaminate(df, benchmark(spark)),
    "keep_one": lambda spark, df: simhash.keep_one_of_each(df),
    "keep_good": lambda spark, df: quality_rules.keep_good(df),
}


@pytest.mark.parametrize("name", FILTERS)
def test_columns_stay(spark, name):
    df = named(spark)
    got = FILTERS[name](spark, df)
    plain = FILTERS[name](spark, frame(spark, texts()))
    assert got.columns[: len(df.columns)] == df.columns
    keep = ["doc_id", "text"]
    rows = got.collect()
    assert sorted(map(str, (tuple(r[c] for c in keep) for r in rows))) == sorted(map(str, (tuple(r) for r in plain.select(*keep).collect())))
    assert all(r[n] == k for r in rows for k, n in enumerate(NAMES))


def test_counts_take_other_names(spark):
    got = line_dedup.dedup_lines(named(spark))
    n_lines, n_removed = common.unused(named(spark), *line_dedup.COUNTS)
    assert {r.doc_id: r[n_removed] for r in got.collect()}[21] == 4 and n_lines == "__zw_n_lines" and n_removed == "__zw_n_removed"


ALL = FILTERS | {
    "licences": lambda spark, df: license_scan.scan_licences(df),
    "pack": lambda spark, df: packing.pack_documents(df, tokens.word_bpe_path(), 256),
    "classifier": lambda spark, df: quality_classifier.score_quality(df, labels(spark, df)),
    "contaminated": lambda spark, df: decontamination.contaminated(df, benchmark(spark)),
    "verdicts": lambda spark, df: quality_rules.quality_verdicts(df),
    "language": lambda spark, df: language_id.identify(df),
    "counts": lambda spark, df: token_counts.document_token_counts(df, tokens.word_bpe_path(), 49407),
    "shards": lambda spark, df: sharding.shard_documents(df),
    "components": lambda spark, df: simhash.simhash_components(df),
}


@pytest.mark.parametrize("name", ALL)
def test_ids_that_are_texts(spark, name):
    df = text_ids(named(spark))
    got = ALL[name](spark, df)
    assert dict(got.dtypes)["doc_id"] == "string"
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert "d-000009" in ids and None in ids
    assert ALL[name](spark, text_ids(empty(spark))).count() == 0


def test_no_folder_of_the_driver_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
