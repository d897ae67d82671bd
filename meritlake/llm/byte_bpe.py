"""Byte-level BPE by a file of ranks: ids, places of the tokens in the text, and the way back.

The ranks become a model of the tokenizers library: every way to split a token into two known
tokens is a merge, so any two neighbours whose bytes together are a token may join, the lowest
rank first; a piece that is a token itself is taken whole. Bytes are spelled by one character
each, as the library's byte-level vocabularies do; decoding reverses that table.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from meritlake.llm.frames import with_fields
from meritlake.llm.tokenizing import byte_characters, encoder_of


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def definition_of(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizer that cuts by ``pattern`` and merges by ``ranks``, as the library stores it."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    characters = byte_characters()
    spelled = {token: "".join(characters[b] for b in token) for token in ranks}
    merges = [
        (spelled[token[:at]], spelled[token[at:]])
        for token in sorted(ranks, key=ranks.get)
        for at in range(1, len(token)) if token[:at] in ranks and token[at:] in ranks]
    tokenizer = Tokenizer(models.BPE(
        vocab={spelled[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


@lru_cache(maxsize=2)
def token_bytes(definition: str) -> dict[int, bytes]:
    """The bytes of every id, by the reversed byte table."""
    back = {c: b for b, c in byte_characters().items()}
    vocabulary = json.loads(definition)["model"]["vocab"]
    return {rank: bytes(back[c] for c in token) for token, rank in vocabulary.items()}


def token_places(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end character of each token, from the tokens' lengths in bytes.

    A token that holds only part of a character covers that character.
    """
    ends = np.cumsum(lengths, dtype=np.int32)
    if text.isascii():
        return ends - lengths, ends
    raw = np.frombuffer(text.encode(), np.int8)
    character = np.cumsum(raw >= -64, dtype=np.int32) - 1  # bytes that go on with a character are below
    return character[ends - lengths], character[ends - 1] + 1


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _sub_batches(batch: pa.RecordBatch, sizes: pa.Array, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows have sizes (null: 0) of so much together, a single larger row alone."""
    at, held = 0, 0
    for place, size in enumerate(sizes.fill_null(0).to_pylist()):
        if held and held + size > most:
            yield batch.slice(at, place - at)
            at, held = place, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


def encode_texts(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text",
                 keep: list[str] | None = None, places: bool = True) -> DataFrame:
    """The columns ``keep`` (all by default) with ids and, if asked, starts and ends of the tokens in characters.

    A null text counts as empty: no ids. Nothing is added before or after the text. Input columns
    named ids, starts or ends are replaced. No shuffle; texts stream through one batch at a time.
    """
    results = ["ids", "starts", "ends"] if places else ["ids"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in results]
    definition = docs.sparkSession.sparkContext.broadcast(definition_of(read_ranks(ranks_file), pattern))
    given = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = with_fields(given.schema, ", ".join(f"{c} array<int>" for c in results), drop_last=True)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder_of(definition.value, pattern).encode
        table = token_bytes(definition.value)
        lengths = np.zeros(max(table) + 1, np.int32)
        for rank, token in table.items():
            lengths[rank] = len(token)
        for whole in batches:
            for batch in _sub_batches(whole, pc.binary_length(whole.column(whole.num_columns - 1))):
                texts = [value or "" for value in batch.column(batch.num_columns - 1).to_pylist()]
                ids = [np.frombuffer(encode_text(value), "<u4").astype(np.int32) for value in texts]
                made = [_lists(ids)]
                if places:
                    spans = [token_places(value, lengths[found]) for value, found in zip(texts, ids)]
                    made += [_lists([s for s, _ in spans]), _lists([e for _, e in spans])]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *results])

    return given.mapInArrow(encode, schema)


def decode_ids(tokens: DataFrame, ranks_file: str, ids: str = "ids") -> DataFrame:
    """All columns with ``decoded``, the bytes of the ids.

    Characters split over tokens come together again, as the bytes are joined before anything
    reads them as text. Null ids give no bytes; an id without a token is an error. An input
    column named decoded is replaced. All columns travel with the ids; leave out what is not needed after.
    """
    definition = tokens.sparkSession.sparkContext.broadcast(definition_of(read_ranks(ranks_file), ""))
    given = tokens.select(*[tokens[c] for c in tokens.columns if c != "decoded"])
    place = given.columns.index(ids)
    schema = with_fields(given.schema, "decoded binary")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_of = token_bytes(definition.value).__getitem__
        for whole in batches:
            for batch in _sub_batches(whole, pc.list_value_length(whole.column(place)), 1 << 20):
                decoded = [b"".join(map(byte_of, value.values.to_pylist() if value.is_valid else []))
                           for value in batch.column(place)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    return given.mapInArrow(decode, schema)
