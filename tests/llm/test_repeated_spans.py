"""Repeated spans against plain lists of windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import meritlake.llm.repeated_spans as R
from meritlake.llm import queries as llm_queries
from meritlake.llm.repeated_spans import U, least_places, remove_repeats, rolled
from tests.compare import connect, difference

SCHEMA = "doc_id long, text string, n_words string, spans int"


def plain(rows, window):
    documents = [re.findall("[^\x20\x09-\x0D]+", text or "") for _, text, *_ in rows]
    every = Counter(tuple(w[i:i + window]) for w in documents for i in range(len(w) - window + 1))
    out = []
    for (key, *_), words in zip(rows, documents):
        gone = set()
        for i in range(len(words) - window + 1):
            if every[tuple(words[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in frame.collect()), key=repr)


def corpus(seed, count=60, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "a b", " x"]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for key in range(count):
        parts = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                passage = rng.choice(passages)
                low = rng.randint(0, len(passage) // 2)
                parts += passage[low:rng.randint(low, len(passage))] if rng.random() < 0.5 else passage
            else:
                parts += [rng.choice(words) for _ in range(rng.randint(0, 40))]
        rows.append((key, rng.choice([" ", "\n", " \t\x0b"]).join(parts), "clash", 1))
    return rows


@pytest.fixture
def small_packs(monkeypatch):
    monkeypatch.setattr(R, "PACK_BYTES", 1_000)
    monkeypatch.setattr(R, "BUCKET_WORDS", 500)


@pytest.mark.parametrize("window", [3, 11, 35])
def test_equals_plain_windows(spark, small_packs, window):
    rows = corpus(window)
    rows += [rows[3]] * 3 + [(100, None, "", 0), (101, "", "", 0), (102, " \n\t ", "", 0), (None, rows[4][1], "", 0)]
    rows += [(200, "la " * 300, "", 0), (201, "la " * 34, "", 0), (202, "a b " * 90, "", 0)]
    rows += [(300 + i, "shared " * 2 + " ".join(f"line{j}" for j in range(40)) + f" own{i}", "", 0) for i in range(120)]
    rows.append((900, " ".join(f"long{i % 977}" for i in range(30_000)), "", 0))
    frame = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), window=window).cache()
    assert found(frame) == plain(rows, window)
    # a path is the same words wherever it is found, and is found at least twice
    words = {r.doc_id: re.findall("[^\x20\x09-\x0D]+", dict((k, t) for k, t, *_ in rows)[r.doc_id] or "")
             for r in frame.collect() if r.doc_id is not None and r.doc_id != 3}
    said = {}
    for row in frame.collect():
        for span in row.spans if row.doc_id in words else []:
            text = tuple(words[row.doc_id][span.start:span.start + span.words])
            assert len(text) == span.words >= window and said.setdefault(span.path, text) == text


def test_small_tables(spark):
    for rows in ([], [(1, None, "", 0)], [(1, "one two", "", 0), (1, "one two", "", 0)]):
        frame = remove_repeats(spark.createDataFrame(rows, SCHEMA), window=2)
        assert found(frame) == plain(rows, 2)


def test_paths_are_compacted(spark, small_packs):
    """A passage all of whose occurrences are whole is one path, however long; a branch cuts it."""
    passage = [f"p{i}" for i in range(700)]
    rows = [(i, " ".join([f"x{i}", *passage, f"y{i}"]), "", 0) for i in range(3)]
    spans = [(s.start, s.words) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect() for s in r.spans]
    assert spans == [(1, 700)] * 3
    rows.append((9, " ".join(passage[:300]), "", 0))
    by_document = {r.doc_id: [(s.start, s.words) for s in r.spans] for r in
                   remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by_document[9] == [(0, 300)] and by_document[0] == [(1, 300), (267, 434)]


def test_equal_hashes_are_found_out(spark, monkeypatch):
    """If words shared a hash, the digests at the source coordinates would tell."""
    monkeypatch.setattr(R, "WordHashes", SameForAll)
    rows = [(1, "a b c d", "", 0), (2, "a b x d", "", 0)]
    with pytest.raises(ValueError, match="salt"):
        remove_repeats(spark.createDataFrame(rows, SCHEMA).coalesce(1), window=4)


class SameForAll(dict):
    def __init__(self, salt):
        super().__init__()

    def __missing__(self, word):
        return 7 if word in b"cx" else ord(word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 25))
def test_window_helpers(values, width):
    array = np.array(values, U)
    expected = [i + values[i:i + width].index(min(values[i:i + width])) for i in range(len(values) - width + 1)]
    if len(values) >= width:
        assert least_places(array, width).tolist() == expected
    hashes = rolled(array, width).tolist()
    assert len(hashes) == max(0, len(values) - width + 1)
    for i, a in enumerate(hashes):
        for j, b in enumerate(hashes):
            assert (values[i:i + width] == values[j:j + width]) == (a == b)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(llm_queries.op13_repeated_spans(spark, folder), connect(folder), llm_queries.OP13_SQL) is None
