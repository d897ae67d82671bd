"""Token operators against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meritlake.llm.byte_bpe import decode_ids, definition_of, encode_texts, read_ranks, token_places
from meritlake.llm.packing import binary_lengths, pack_documents
from meritlake.llm.token_files import from_planes, pack_chunk, read_token_files, to_planes, unpack_chunk, write_token_files
from meritlake.llm.tokenizing import PLAIN, Encoder, pattern_of, read_definition

BYTE, WORD, RANKS = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
ODD = ["", " ", "\n\n a  b\t", "Don't we'll I'VE 123 4½² x_y-- ¿qué? Straße İstanbul ﬁ é 日本語 🙂👩‍👩‍👧 <|endoftext|>",
       "  x y \u0085z \x1c \x00", "word " * 3000, "ééé" * 500, "­soft ªº", "ǅ ǈ ΑΣ ΣΑΣ."]
TEXT = st.text(st.one_of(st.characters(max_codepoint=0x24F), st.characters(codec="utf-8")), max_size=60)


def library(path):
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


BYTE_ENCODER = Encoder(read_definition(BYTE), P.PATTERN)
WORD_ENCODER = Encoder(read_definition(WORD), pattern_of(read_definition(WORD)), lower=True)
RANK_LIST = read_ranks(RANKS)
RANK_ENCODER = Encoder(definition_of(RANK_LIST, P.PATTERN), P.PATTERN)
BYTE_LIBRARY, WORD_LIBRARY = library(BYTE), library(WORD)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANK_LIST, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encoders_agree_with_libraries(text):
    assert ids_of(BYTE_ENCODER, text) == BYTE_LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(WORD_ENCODER, text) == WORD_LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(RANK_ENCODER, text) == TIKTOKEN.encode_ordinary(text)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    test_encoders_agree_with_libraries.hypothesis.inner_test(text)


def test_every_plain_character_agrees_with_libraries():
    """Alone, at both ends and inside of words, doubled, and the capitals whose small letters are far away."""
    for character in map(chr, [*PLAIN, *range(0x100, 0x250)]):
        for text in (character, f"a{character}", f"{character}a", f"a{character}b", character * 2, f" {character} x{character}1"):
            assert ids_of(BYTE_ENCODER, text) == BYTE_LIBRARY.encode(text, add_special_tokens=False).ids, text
            assert ids_of(WORD_ENCODER, text) == WORD_LIBRARY.encode(text, add_special_tokens=False).ids, text
    assert all(len(chr(c).lower()) == 1 and ord(chr(c).lower()) in set(PLAIN) for c in PLAIN)
    assert len(ids_of(WORD_ENCODER, "Ɓala da Ɗan Ƙasa")) == len(WORD_LIBRARY.encode("Ɓala da Ɗan Ƙasa", add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_planes_round_trip(ids):
    block = np.array(ids, np.uint32)
    assert from_planes(to_planes(block), len(block)).tolist() == ids
    assert unpack_chunk(*pack_chunk(block)).tolist() == ids


def test_chunk_of_several_blocks():
    ids = np.arange(200_000, dtype=np.uint32) % 50_000
    sizes, counts, lengths, body = pack_chunk(ids)
    assert sizes == [65_536, 65_536, 65_536, 3_392] and counts == [16] * 4 and sum(lengths) == len(body)
    assert (unpack_chunk(sizes, counts, lengths, body) == ids).all()


def rows_of(spark, extra=""):
    data = [(i * 3 % 11 - 4, t, "x", 1) for i, t in enumerate(ODD)] + [(100, None, None, None), (None, "null key", "y", 2),
                                                                     (7, "again", "z", 3), (7, "again", "z", 3)]
    return spark.createDataFrame(data, "doc_id long, text string, ids string, shard int")


def test_token_files(spark, tmp_path):
    docs = rows_of(spark)
    write_token_files(docs, str(tmp_path / "t"), BYTE, P.PATTERN, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in
                 read_token_files(spark, str(tmp_path / "t")).collect())
    expected, start = [], 0
    for row in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = BYTE_LIBRARY.encode(row.text or "", add_special_tokens=False).ids + [2]
        expected.append((start, row.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_token_files_of_nothing(spark, tmp_path):
    write_token_files(rows_of(spark).filter("false"), str(tmp_path / "t"), BYTE, P.PATTERN, 2)
    assert read_token_files(spark, str(tmp_path / "t")).count() == 0


def test_encode_and_decode(spark):
    docs = rows_of(spark)
    tokens = encode_texts(docs, RANKS, P.PATTERN)
    assert tokens.columns == ["doc_id", "text", "shard", "ids", "starts", "ends"]
    for row in decode_ids(tokens, RANKS).collect():
        text = row.text or ""
        assert row.ids == TIKTOKEN.encode_ordinary(text) and bytes(row.decoded) == text.encode()
        assert len(row.starts) == len(row.ids) == len(row.ends)
        covered = {p for s, e in zip(row.starts, row.ends) for p in range(s, e)}
        assert covered == set(range(len(text)))


def test_split_character_places():
    text = "🙂a"
    ids = TIKTOKEN.encode_ordinary(text)
    lengths = np.array([len(TIKTOKEN.decode_single_token_bytes(i)) for i in ids])
    starts, ends = token_places(text, lengths)
    assert len(ids) > 2 and set(zip(starts.tolist(), ends.tolist())) == {(0, 1), (1, 2)}


def test_binary_lengths():
    assert binary_lengths(10_000, 4096) == [4096, 4096, 1024, 512, 256, 16]
    assert binary_lengths(0, 8) == [] and binary_lengths(8, 8) == [8] and binary_lengths(7, 8) == [4, 2, 1]


def test_packing(spark):
    docs = rows_of(spark)
    rows = pack_documents(docs, WORD, 2, most=64).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_number = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_number] == sorted((r.length for r in rows), reverse=True)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and len(r.ids) == 4 * r.length for r in rows)
    found = {}
    for r in sorted(rows, key=lambda r: r.start):
        found.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for row in docs.filter("doc_id is null or doc_id <> 7").collect():
        ids = WORD_LIBRARY.encode(row.text or "", add_special_tokens=False).ids + [2]
        whole = np.array(ids, "<u4").tobytes()
        assert any(b"".join(bytes(p.ids) for p in parts) == whole and key[0] == row.doc_id
                   for key, parts in found.items())
    assert pack_documents(docs.filter("false"), WORD, 2).count() == 0


def test_digests_of_the_query(spark):
    from meritlake.llm.queries import op2_byte_bpe

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op2_byte_bpe(spark, folder).collect():
        ids = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_places_of_the_query(spark):
    """Starts and ends of every token of every document, from the tokens' own bytes."""
    from pyspark.sql import functions as F

    from meritlake.llm.queries import op2_byte_bpe

    folder, expected = "/root/testdata/sf0.001", []
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        starts, ends, at = [], [], 0
        first = {}  # character of each byte
        for place, character in enumerate(row.text):
            for _ in character.encode():
                first[len(first)] = place
        for token in TIKTOKEN.encode_ordinary(row.text):
            size = len(TIKTOKEN.decode_single_token_bytes(token))
            starts.append(first[at])
            ends.append(first[at + size - 1] + 1)
            at += size
        expected.append((row.doc_id, starts, ends))
    hashed = spark.createDataFrame(expected, "doc_id long, starts array<int>, ends array<int>").select(
        "doc_id", F.xxhash64("starts", "ends").alias("h"))
    assert {(r.doc_id, r.places_hash) for r in op2_byte_bpe(spark, folder).collect()} == {(r.doc_id, r.h) for r in hashed.collect()}


def test_decoding_workers_get_ids_alone(spark):
    """Neither texts nor lists of places travel to the second step, and it answers in parts of bounded size."""
    from meritlake.llm.queries import op2_byte_bpe

    plan = op2_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    decoding = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "ids#" in decoding and "starts#" not in decoding and "ends#" not in decoding
    docs = spark.range(0, 300, 1, 1).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL ELSE sequence(0, 9999) END AS ids")
    tokens = docs.selectExpr("id", "CAST(ids AS array<int>) AS ids")
    parts = decode_ids(tokens, RANKS).mapInArrow(lambda batches: batches, "id long, ids array<int>, decoded binary")
    whole = b"".join(TIKTOKEN.decode_single_token_bytes(i) for i in range(10_000))
    for row in parts.collect():
        assert bytes(row.decoded) == (b"" if row.ids is None else whole)


def test_parts_of_a_batch():
    import pyarrow as pa
    import pyarrow.compute as pc

    from meritlake.llm.byte_bpe import _sub_batches

    lists = pa.RecordBatch.from_pydict({"ids": pa.array([[1] * n if n is not None else None for n in (3, 3, None, 9, 0, 5)])})
    parts = list(_sub_batches(lists, pc.list_value_length(lists.column(0)), 6))
    assert [p.num_rows for p in parts] == [3, 1, 2]
    assert pa.Table.from_batches(parts).to_pydict() == lists.to_pydict()
