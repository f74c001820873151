"""Encoding, decoding and packing against the tokenizers library and a plain packer."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from feedloom.llm.bpe import bpe_codes, bpe_digests
from feedloom.llm.packing import best_fit, merge_rounds, pack_documents, sequences
from feedloom.llm.tokens import library_words, word_bpe

TEXTS = [
    "Hello, World's  best123 café\n\tÉTÉ <|endoftext|> x<|startoftext|>y don't I'LL ñ 12 ½ ²  a‍b İ ﬁ é \x00a\x1cb\x85c　d ...!! 日本語 😀",
    "", None, "   \n", "aaa aaaa aaaaaaa", "Thre*** of%%% are&&& x|y <|x <|endoftext|", "ΣΑΣ ΟΔΟΣ ǅ ß ẞ µ ª º × ÷", "The The the THE!! it's 'S ''ve", "a b  c", "word " * 6000,
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("piece", T.StringType()), T.StructField("offset", T.LongType())])


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(word_bpe())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None), (None, TEXTS[0], None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_codes_equal_the_library(docs, tok):
    got = bpe_codes(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = TEXTS[r.doc_id if r.doc_id is not None else 0] or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert r.ids == ids, text
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_library_words_equal_whole_texts(tok):
    ids, ends = library_words(word_bpe()).batch(pa.array([t or "" for t in TEXTS]))
    begin = 0
    for t, end in zip(TEXTS, ends, strict=True):
        assert ids[begin:end].tolist() == tok.encode(t or "", add_special_tokens=False).ids
        begin = end


def test_digests_on_the_small_table(spark, small, tok):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in bpe_digests(docs).collect()}
    for r in docs.collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_best_fit_takes_the_tightest_bin():
    bins, places, fills = best_fit(np.array([6, 7, 3, 4, 10]), 10)
    assert fills == [10, 10, 10] and bins.tolist() == [2, 1, 1, 2, 0] and places.tolist() == [0, 0, 7, 6, 0]


def test_packing_is_whole_and_tight(docs, tok):
    packed = pack_documents(docs.repartition(5), capacity=64).toPandas()
    for doc, rows in packed[packed.doc_id.notna()].groupby("doc_id"):
        ids = np.array([*tok.encode(TEXTS[int(doc)] or "", add_special_tokens=False).ids, 1], "<u4")
        rows = rows.drop_duplicates(["piece"]).sort_values("piece")
        assert rows.start.tolist() == list(range(0, len(ids), 64)) and rows.length.sum() == len(ids)
        assert rows.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 64].tobytes()) for k in range(0, len(ids), 64)]
    for _, rows in packed.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.length.cumsum() - rows.length).tolist() == rows.offset.tolist() and rows.length.sum() <= 64
    assert packed.sequence_id.nunique() <= 1.03 * packed.length.sum() / 64 + 1


def test_rounds_stop_when_nothing_fits(spark):
    items = spark.range(400).selectExpr("id AS bin", "CAST(40 + id % 3 AS bigint) AS fill")
    final = merge_rounds(items, 64, 63, 8, 2, 30).toPandas()
    assert len(final) == 400 and (final.into == final.bin).all() and (final.base == 0).all()


def test_sequences_hold_their_ids(docs, tok):
    docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    packed = pack_documents(docs, capacity=64)
    got = {r.sequence_id: r.ids for r in sequences(docs, packed, capacity=64).collect()}
    for r in packed.collect():
        whole = [*tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert got[r.sequence_id][r.offset : r.offset + r.length] == whole[r.start : r.start + r.length]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe_digests(none).count() == 0 and pack_documents(none).count() == 0


def test_words_by_short_ways_equal_the_library(tok):
    """Letters alone, letters with one mark, Latin-1 pieces and whole words, over caches that are emptied between batches."""
    marks = [f"Word{chr(b)}" for b in range(33, 127)]
    texts = ["Plain WORDS only", " ".join(marks), "ÉTÉ été, naïve! Ñandú? 'tis dogs' x<| <|endoftext|>.", "\x00a a\x00 plain Ünder 日本."]
    known = library_words.__wrapped__(word_bpe())
    known.known.limit = known.known.encode.known.limit = 3
    for some in (texts, texts[::-1]):
        for t in some:
            ids, ends = known.batch(pa.array([t, t]))
            assert ids[: ends[0]].tolist() == ids[ends[0] :].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_word_caches_hold_flat_arrays():
    """No list of ids is kept for a piece: those took more memory than the ids themselves."""
    known = library_words.__wrapped__(word_bpe())
    known.batch(pa.array(["one two, three"]))
    for cache in (known.known, known.known.encode.known):
        assert len(cache.ends) == len(cache.index) + 1 and all(isinstance(v, int) for v in cache.index.values())
