"""Quality of texts: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are the words and word pairs of the whole text, hashed into a fixed number of places;
a text is a sparse vector of damped counts of unit length. Training reads labelled texts one
after the other in one task; so that its time and memory are bounded, at most ``most_rows``
labelled rows, those with the smallest hash of their key, are used. A score is a
sparse dot product through the logistic function; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake.llm.frames import remember_only, with_fields

PLACES = 1 << 18
MOST_ROWS = 12_000
# Words a worker remembers the hash of; the table starts afresh when it is full.
MOST_WORDS = 400_000

_PIECES = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < MOST_WORDS:
            self[word] = found
        return found


_hashes = WordHashes()
# Weight of the shares of the three special words against a text's vector of unit length.
SHARE = 3.0
_SAME, _CAPITALS, _MIXED = (zlib.crc32(b) for b in (b"<same>", b"<capitals>", b"<mixed>"))


def _begin() -> None:
    remember_only("quality", _hashes.clear)


def _mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(29)


def features(text: str | None, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending, distinct) and values of a text's vector; empty for a text without words.

    Words are runs of letters and digits or runs of signs, as written. A word that repeats the one
    before it also counts as the word <same>, one in capitals as <capitals>, one of letters and
    digits as <mixed>.
    """
    words = _PIECES.findall(text) if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    if len(_hashes) >= MOST_WORDS:
        _hashes.clear()
    hashed = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    capitals = sum(1 for w in words if len(w) > 1 and w.isupper())
    mixed = sum(1 for w in words if not w.isalpha() and not w.isdigit() and w.isalnum())
    same = int((hashed[1:] == hashed[:-1]).sum())
    pairs = _mix(hashed[1:], hashed[:-1])
    single = _mix(hashed, np.full(1, 1, np.uint64))
    found = np.concatenate([single, pairs]) % np.uint64(places)
    where, counts = np.unique(found.astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    values = values / np.sqrt((values ** 2).sum())
    extra = [(h, SHARE * n / len(words)) for h, n in ((_SAME, same), (_CAPITALS, capitals), (_MIXED, mixed)) if n]
    if extra:
        spots = _mix(np.array([h for h, _ in extra], np.uint64), np.full(1, 1, np.uint64)) % np.uint64(places)
        where = np.concatenate([where, spots.astype(np.int64)])
        values = np.concatenate([values, [n for _, n in extra]])
        where, back = np.unique(where, return_inverse=True)
        values = np.bincount(back, values)
    return where, values


class Leader:
    """Follow-the-regularised-leader for logistic loss, one step size per coordinate; place -1 is the bias."""

    def __init__(self, places: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(places + 1), np.zeros(places + 1)

    def weights(self, where: np.ndarray) -> np.ndarray:
        z = self.z[where]
        shrunk = np.sign(z) * self.l1 - z
        rate = (self.beta + np.sqrt(self.n[where])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / rate)

    def learn(self, where: np.ndarray, values: np.ndarray, label: int, importance: float = 1.0) -> None:
        weights = self.weights(where)
        gradient = importance * (logistic(float(weights @ values)) - label) * values
        squares = gradient ** 2
        step = (np.sqrt(self.n[where] + squares) - np.sqrt(self.n[where])) / self.alpha
        self.z[where] += gradient - step * weights
        self.n[where] += squares


def logistic(margin: float) -> float:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def sample_labels(labels: DataFrame, key: str = "doc_id", label: str = "label",
                  most_rows: int = MOST_ROWS) -> DataFrame:
    """key, label of at most ``most_rows`` rows with a key and the label 0 or 1: those with the smallest hash."""
    rows = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label"))
    return (rows.filter("key IS NOT NULL AND label IN (0, 1)")
            .orderBy(F.xxhash64("key"), "key", "label").limit(most_rows))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id",
          most_rows: int = MOST_ROWS, places: int = PLACES, rounds: int = 2) -> np.ndarray:
    """Weights (``places`` and the bias) learnt from documents with a label; labels but 0 and 1 are left out.

    The sample of labels has ``most_rows`` rows at most, whatever the input, so it is broadcast and
    no text is shuffled. One task learns from the sample's vectors in the order of the keys' hash,
    ``rounds`` times. A key that several documents have counts once, with its smallest text. Keys,
    sources and languages are no features. Without any labelled text all weights are 0 and every
    score is one half.
    """
    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for batch in batches:
            for order, value, mark in zip(*(batch.column(i) for i in range(3))):
                where, values = features(value.as_py(), places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([order.as_py()], pa.int64()), pa.array([mark.as_py()], pa.int32()),
                     pa.array([where.astype("<i4").tobytes()]), pa.array([values.astype("<f4").tobytes()])],
                    names=["order", "label", "places", "values"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        sample = []  # the vectors stay where the batches hold them
        for batch in batches:
            sample += zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3))
        leader = Leader(places)
        for _ in range(rounds):
            for mark, where, values in sample:
                spots = np.append(np.frombuffer(where.as_buffer(), "<i4").astype(np.int64), places)
                leader.learn(spots, np.append(np.frombuffer(values.as_buffer(), "<f4").astype(float), 1.0), mark)
        weights = leader.weights(np.arange(places + 1))
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(weights[used], pa.float64())], names=["place", "weight"])

    texts = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    sample = texts.join(F.broadcast(sample_labels(labels, key, label, most_rows)), "key")
    sample = sample.groupBy("key", "label").agg(F.min("text").alias("text"))
    ordered = (sample.select(F.xxhash64("key").alias("order"), "text", "label")
               .mapInArrow(vectors, "order long, label int, places binary, values binary")
               .repartition(1).sortWithinPartitions("order", "label"))
    model = np.zeros(places + 1)
    for row in ordered.mapInArrow(learn, "place int, weight double").collect():  # as many as places at most
        model[row.place] = row.weight
    return model


def score(docs: DataFrame, model: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``score``, the probability of label 1.

    Null and wordless texts have no features: the bias alone decides. An input column named score
    is replaced. Whole texts count, however long. A text that is kept goes to the workers once.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != "score"]
    place = keep.index(text) if text in keep else len(keep)
    given = docs.select(*[docs[c] for c in keep], *([docs[text].alias("__text")] if place == len(keep) else []))
    schema = with_fields(given.schema, "score double", drop_last=place == len(keep))
    places = len(model) - 1
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes a place, a fixed size

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        weights = sent.value
        for batch in batches:
            scores = []
            for value in batch.column(place):
                where, values = features(value.as_py(), places)
                scores.append(float(logistic(float(weights[where] @ values) + weights[places])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(scores, pa.float64())], names=[*batch.schema.names[:len(keep)], "score"])

    return given.mapInArrow(mark, schema)
