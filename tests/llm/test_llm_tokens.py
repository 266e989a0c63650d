"""Simple-8b round trips and token files against the tokenizers library."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pairscope.llm import simple8b, token_files
from pairscope.llm.common import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ROWS = [
    (3, "two rows of one identifier"), (3, "another"), (3, "another"), (None, "no identifier"), (None, None), (1, ""),
    (2, None), (9, "ends <|endoftext|> inside <|endoftext|>"), (-4, "  spaces \n\n and\ttabs  "), (7, "naïve Größe \U0001f600 ١٢٣"),
    (8, "x" * 5_000), (12, "words of a long text " * 20_000), *[(k, f"document {k} says {k * k}") for k in range(20, 90)]]


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=2_500))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values):
    assert simple8b.decode(simple8b.encode(np.array(values, dtype=np.uint64))).tolist() == values


@pytest.mark.parametrize("value", [0, 1, 2**15 - 1, 2**53 + 1, 2**60 - 1, 2**60, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 119, 1023, 1024, 1025, 3000])
def test_simple8b_limits(value, n):
    assert simple8b.decode(simple8b.encode(np.full(n, value, dtype=np.uint64))).tolist() == [value] * n


def test_simple8b_packs_by_width_and_refuses_other_bytes():
    assert len(simple8b.encode(np.zeros(1024, dtype=np.uint64))) < 150
    assert len(simple8b.encode(np.full(1024, 2**15 - 1, dtype=np.uint64))) < 1024 * 2 + 100
    with pytest.raises(ValueError):
        simple8b.decode(b"S8B0" + bytes(40))


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_encoder_agrees_with_the_library(text):
    global _encode
    if "_encode" not in globals():
        _encode = token_files.encoder(PATH)
    assert _encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [255, 256, 1_023, 1_024, 1_500])
@pytest.mark.parametrize("piece", ["x", " ", "é", "\u00a0"])
def test_long_runs_get_the_same_ids(piece, n):
    encode = token_files.encoder(PATH)
    for text in (piece * n, "a b " + piece * n + " c", piece * n + "\n"):
        assert encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert token_files._has_long_run("y" * 1_024 + " z") and not token_files._has_long_run("y " * 5_000)


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some Words, and others."
    assert token_files.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("segment", [1, 50, token_files.SEGMENT])
def test_token_files_match_the_library(spark, segment):
    folder = shared_folder(spark, "tokens")
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in ROWS], "doc_id bigint, text string, start string, row int")
    token_files.write_tokens(docs, folder, PATH, segment=segment)
    found = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((i, tuple(library_ids(t))) for i, t in ROWS)
    at, last = 0, None
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert last is None or r["doc_id"] >= last
        at, last = at + len(r["ids"]), r["doc_id"]
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.token_checksums(spark, folder).collect()}
    assert sums == {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in found}


def test_token_files_of_an_empty_table(spark):
    folder = shared_folder(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), folder, PATH)
    assert token_files.read_tokens(spark, folder).collect() == []


def test_query_over_the_smallest_table(spark):
    from pairscope.llm.queries import op13_token_files

    sf = "/root/testdata/sf0.001"
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op13_token_files(spark, sf).collect()}
    at, expected = 0, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = library_ids(r["text"])
        expected[r["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert found == expected
