"""Archives of token ids against the tokenizers library, one document after another."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zonewright.llm import token_archive, tokens

from .helpers import awkward, empty, frame, prose

TOKENIZER = tokens.word_bpe_path()


def plain(rows, end=2):
    """(doc_id, start, n_tokens, crc) in ascending doc_id order, nulls first, then by number of ids and checksum."""
    tok = Tokenizer.from_file(TOKENIZER)
    got = []
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end]
        got.append((doc is not None, doc or 0, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
    out, start = [], 0
    for there, doc, n, crc, ids in sorted(got):
        out.append((doc if there else None, start, n, crc, ids))
        start += n
    return out


def folder(tmp_path, name="a"):
    return f"file://{tmp_path}/{name}"


def read(df):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.orderBy("start").collect()]


def test_round_trip(spark, tmp_path):
    want = plain(awkward())
    got = token_archive.archived_token_counts(frame(spark, awkward()), TOKENIZER, 2, folder(tmp_path))
    assert read(got) == [x[:4] for x in want]
    again = token_archive.read_archive(spark, folder(tmp_path), with_ids=True).orderBy("start").collect()
    assert [list(struct.unpack(f"<{len(r.ids) // 2}H", r.ids)) for r in again] == [x[4] for x in want]


def test_many_files_and_one_id_of_many_rows(spark, tmp_path):
    rows = [(7, prose(k, 30)) for k in range(600)] + [(k, prose(k, 40)) for k in range(300)]
    made = token_archive.write_archive(frame(spark, rows, parts=5), folder(tmp_path), TOKENIZER, 2, file_bytes=8_000)
    n = [r.n_docs for r in made.collect()]
    assert sum(n) == 900 and len(n) > 6 and max(n) < 300
    assert read(token_archive.read_archive(spark, folder(tmp_path))) == [x[:4] for x in plain(rows)]
    files = token_archive.archive_files(spark, folder(tmp_path)).orderBy("file").collect()
    assert [f.start for f in files] == [sum(g.n_tokens for g in files[:k]) for k in range(len(files))]


def test_fetch_reads_wanted_documents(spark, tmp_path):
    rows = awkward() + [(100 + k, prose(k, 25)) for k in range(200)]
    token_archive.write_archive(frame(spark, rows), folder(tmp_path), TOKENIZER, 2, file_bytes=4_000)
    wanted = spark.createDataFrame([(5,), (150,), (150,), (None,), (12345,), (299,)], "doc_id long")
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_archive.fetch(spark, folder(tmp_path), wanted).collect())
    want = sorted((d, n, struct.pack(f"<{n}H", *ids)) for d, _, n, _, ids in plain(rows) if d in (5, 150, 299))
    assert got == want and len(got) == 4


def test_dictionary_helps_short_documents_and_is_checked(spark, tmp_path):
    rows = [(k, prose(k, 20)) for k in range(2000)]
    made = token_archive.write_archive(frame(spark, rows), folder(tmp_path), TOKENIZER, 2)
    import zstandard

    alone = sum(len(zstandard.compress(struct.pack(f"<{len(x[4])}H", *x[4]))) for x in plain(rows))
    assert sum(r.bytes for r in made.collect()) < alone
    (name,) = [f for f in os.listdir(tmp_path / "a") if f.endswith(".zdict")]
    held = (tmp_path / "a" / name).read_bytes()
    assert len(held) <= 64 << 10
    (tmp_path / "a" / name).write_bytes(held[:-1] + bytes([held[-1] ^ 1]))
    for f in os.listdir(tmp_path / "a"):
        if f.endswith(".crc"):
            os.remove(tmp_path / "a" / f)
    with pytest.raises(Exception, match="dictionary is not the one"):
        token_archive.read_archive(spark, folder(tmp_path)).collect()


def test_text_ids_extra_columns_and_nothing(spark, tmp_path):
    df = frame(spark, awkward()).withColumn("doc_id", F.concat(F.lit("d-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))).withColumn("ids", F.lit("x")).withColumn("crc", F.lit(1))
    got = token_archive.archived_token_counts(df, TOKENIZER, 2)
    assert dict(got.dtypes)["doc_id"] == "string"
    assert [x[1:] for x in read(got)] == [x[1:4] for x in plain(awkward())]
    none = token_archive.archived_token_counts(empty(spark), TOKENIZER, 2, folder(tmp_path, "none"))
    assert none.count() == 0 and token_archive.fetch(spark, folder(tmp_path, "none"), empty(spark).select("doc_id")).count() == 0


def test_very_long_text(spark, tmp_path):
    rows = [(1, prose(1, 400_000)), (2, "end")]
    assert read(token_archive.archived_token_counts(frame(spark, rows), TOKENIZER, 2)) == [x[:4] for x in plain(rows)]


@pytest.mark.parametrize("remember", [1, 16, 300_000])
def test_encoder_remembers_no_more_than_told_within_a_text(remember):
    enc, tok = tokens.Encoder(TOKENIZER, remember=remember), Tokenizer.from_file(TOKENIZER)
    marks = ["Word, WORD. it's I'll 'Tis x. a1 1a İstanbul, ǅ. ª. µm; ß! ne, naïve? ... , .5 <|endoftext|> <|x|>, e\u0301, 中文, a\xadb."]
    texts = [t for _, t in awkward()] + [prose(1, 3_000, 2_000)] + marks * 2
    assert enc.encode(texts) == [struct.pack(f"<{len(i)}I", *i) for i in (tok.encode(t or "", add_special_tokens=False).ids for t in texts)]
    for memory, most in ((enc._known, remember), (enc._pieces, 2 * remember)):
        assert len(memory) + len(memory._before) <= max(2, most)
