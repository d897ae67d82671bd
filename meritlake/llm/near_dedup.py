"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded and verified.

A text is a weighted set of shingles of five words; a shingle weighs its count times the mean
inverse document frequency of its words. Improved consistent weighted sampling draws samples
whose agreement estimates the weighted Jaccard similarity; bands of samples are buckets. Texts
with the same words are one node. In each bucket the node that meets most others leads and is
verified against all members; members that stay apart from their leader meet every other member
in blocks of bounded size, which compare samples and verify where these leave a chance. A block
gives out only links that join classes, fewer than it has members, so no class is lost and no
bucket gives a row per pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlake.llm.exact_dedup import perhaps_among, without
from meritlake.llm.frames import remember_only, with_fields, written

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
BANDS, ROWS = 20, 5
SAMPLES = BANDS * ROWS
# Estimates of 100 samples vary by 0.04 at 0.8: five times that, and a pair is given up.
LEAST_ESTIMATE = 0.6
# Words are counted in so many cells: the frequencies are a fixed 2 MB to send.
CELLS = 1 << 18
# Shingles share the random numbers of so many slots.
SLOTS = 1 << 13
# A side of a block has about so many texts and characters.
BLOCK_ROWS = 256
BLOCK_CHARS = 16_000_000
MOST_WORDS = 100_000

_WORDS = re.compile(r"\w+")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        self[word] = found
        return found


_hashes = _WordHashes()


def hashed_words(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in order; words are runs of letters, digits and _ in lower case."""
    words = _WORDS.findall(text.lower()) if text else []
    if len(_hashes) > MOST_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def weighted_shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (ascending hashes) and their weights; fewer than five words are one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0)
    width = min(SHINGLE_WORDS, len(words))
    count = len(words) - width + 1
    shingles = np.zeros(count, np.uint64)
    rarity = np.zeros(count)
    each = idf[(words % np.uint64(CELLS)).astype(np.int64)]
    for at in range(width):
        shingles = _scramble(shingles * np.uint64(0x9E3779B97F4A7C15) + words[at:at + count])
        rarity += each[at:at + count]
    distinct, first, counts = np.unique(shingles, return_index=True, return_counts=True)
    return distinct, counts * rarity[first] / width


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = b[0][at] == a[0]
    least = np.minimum(a[1][common], b[1][at[common]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def weighted_jaccards(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Similarities of one set to others, none of them empty, in one pass."""
    hashes = np.concatenate([x[0] for x in others])
    weights = np.concatenate([x[1] for x in others])
    starts = np.cumsum([0] + [len(x[0]) for x in others[:-1]])
    at = np.minimum(np.searchsorted(one[0], hashes), len(one[0]) - 1)
    least = np.add.reduceat(np.where(one[0][at] == hashes, np.minimum(one[1][at], weights), 0.0), starts)
    return least / (one[1].sum() + np.add.reduceat(weights, starts) - least)


class Sampler:
    """Improved consistent weighted sampling; r and c are Gamma(2, 1), beta is uniform.

    Sample k of a set is the shingle with the smallest ln c - r (t - beta + 1), t = floor(ln w / r
    + beta), together with that t. The random numbers of a shingle are those of its slot.
    """

    def __init__(self):
        rng = np.random.default_rng(20)
        shape = (SLOTS, SAMPLES)
        r = rng.gamma(2.0, 1.0, shape)
        beta = rng.uniform(0.0, 1.0, shape)
        fixed = np.log(rng.gamma(2.0, 1.0, shape)) + r * beta - r
        self.r, self.inverse, self.beta, self.fixed = (x.astype(np.float32) for x in (r, 1 / r, beta, fixed))

    def samples(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """32-bit marks of the samples; shingles ascend, so that equal values go to the smaller one."""
        best = np.full(SAMPLES, np.inf, np.float32)
        marks = np.zeros(SAMPLES, np.uint64)
        logs = np.log(weights).astype(np.float32)
        for at in range(0, len(shingles), 1024):
            part = shingles[at:at + 1024]
            slots = (part & np.uint64(SLOTS - 1)).astype(np.int64)
            t = self.inverse[slots]
            t *= logs[at:at + 1024, None]
            t += self.beta[slots]
            np.floor(t, out=t)
            values = self.r[slots]
            values *= t
            np.subtract(self.fixed[slots], values, out=values)
            chosen = values.argmin(axis=0)
            columns = np.arange(SAMPLES)
            found = values[chosen, columns]
            better = found < best
            best[better] = found[better]
            steps = t[chosen, columns].astype(np.int64).astype(np.uint64)
            marks[better] = (part[chosen] ^ (steps * np.uint64(0x9E3779B97F4A7C15)))[better]
        return (_scramble(marks) >> np.uint64(32)).astype(np.uint32)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band, its number included."""
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for at in range(ROWS):
        keys = _scramble(keys * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, at])
    return keys.astype(np.int64)


_sampler: list[Sampler] = []


def _worker_sampler() -> Sampler:
    if not _sampler:
        _sampler.append(Sampler())
    return _sampler[0]


def _begin() -> None:
    remember_only("near_dedup", _forget)


def _forget() -> None:
    _hashes.clear()
    _sampler.clear()


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of every cell of words, over all rows of the column ``text``.

    1 + ln((1 + rows) / (1 + rows with the cell)). Each task counts its part before the shuffle.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        seen, rows = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                words = hashed_words(value.as_py())
                seen[np.unique((words % np.uint64(CELLS)).astype(np.int64))] += 1
                rows += 1
        used = np.flatnonzero(seen)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(seen[used], rows), pa.int64())],
                names=["cell", "n"])

    counts = texts.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found, rows = np.zeros(CELLS), 0
    for row in counts.toLocalIterator():  # a row per cell, CELLS + 1 at most
        if row.cell < 0:
            rows = row.n
        else:
            found[row.cell] = row.n
    return 1 + np.log((1 + rows) / (1 + found))


def _sign(documents: DataFrame, idf) -> DataFrame:
    """row, text, same (digest of the words), samples and bands of every document."""
    given = documents.select("row", "text")

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        sampler = _worker_sampler()
        for batch in batches:
            same, samples, bands = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                words = hashed_words(text)
                same.append(xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"wordless:" + text.encode()))
                if len(words):
                    marks = sampler.samples(*weighted_shingles(words, idf.value))
                    samples.append(marks.tobytes())
                    bands.append(band_keys(marks).tolist())
                else:
                    samples.append(b"")
                    bands.append([])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(same, pa.binary()), pa.array(samples, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["row", "text", "same", "samples", "bands"])

    return given.mapInArrow(sign, with_fields(given.schema, "same binary, samples binary, bands array<long>"))


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the limit; ``texts`` has node and text."""
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        last, held = None, None
        for batch in batches:
            kept = []
            for a, b, text_a, text_b in zip(*(batch.column(i) for i in range(4))):
                if a.as_py() != last:
                    last, held = a.as_py(), weighted_shingles(hashed_words(text_a.as_py()), idf.value)
                other = weighted_shingles(hashed_words(text_b.as_py()), idf.value)
                kept.append(weighted_jaccard(held, other) >= LEAST_SIMILARITY)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    both = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))
    return both.mapInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of every node that has a link (a, b)."""
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", "label", F.least("label", "near").alias("lower"))
        # a label's own label is at least as good
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("further"))
        moved = written(lower.join(jump, "lower").select("node", F.col("label").alias("old"),
                                                          F.least("lower", "further").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("old <> label").limit(1).count():
            return labels


def _block_links(members: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links (a, b) that join classes which the leaders of their buckets left apart.

    ``members`` has bucket, node, label (its class so far), chars and apart (not in its leader's
    class); ``texts`` has node, text and samples. The apart nodes of a bucket and all its members
    are cut into blocks that meet pairwise; a pair is looked at in the first band in which it
    shares a bucket, and only while the block knows no link between its classes.
    """
    key = ["bucket", "one", "other"]
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(float(BLOCK_ROWS)), F.sum("chars") / F.lit(float(BLOCK_CHARS)), F.lit(1.0)))
    apart = members.filter("apart")
    sizes = apart.groupBy("bucket").agg(blocks.cast("int").alias("ones")).join(
        members.groupBy("bucket").agg(blocks.cast("int").alias("others")), "bucket")

    def spread(frame: DataFrame, mine: str, count: str, against: str, against_count: str, role: int) -> DataFrame:
        return frame.join(sizes, "bucket").select(
            "bucket", F.pmod(F.xxhash64("node"), F.col(count)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(against_count) - 1)).alias(against),
            F.lit(role).alias("role"), "node", "label").select(*key, "role", "node", "label")

    rows = spread(apart, "one", "ones", "other", "others", 0).union(
        spread(members, "other", "others", "one", "ones", 1))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        group, sides = None, ([], [])
        for batch in batches:
            found = []
            for row in zip(*batch.columns):
                at = tuple(x.as_py() for x in row[:3])
                if at != group:
                    found += _links_between(group, *sides, idf.value)
                    group, sides = at, ([], [])
                sides[row[3].as_py()].append(tuple(x.as_py() for x in row[4:]))
            yield _links(found)
        yield _links(_links_between(group, *sides, idf.value))

    return (rows.join(texts.select("node", "text", "samples"), "node")
            .select(*key, "role", "node", "label", "text", "samples")
            .repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(meet, "a long, b long"))


def _links_between(group: tuple | None, ones: list[tuple], others: list[tuple], idf: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the classes of one block; members are (node, label, text, samples)."""
    if not ones or not others:
        return []
    marks = np.stack([np.frombuffer(x[3], np.uint32) for x in others])
    above: dict[int, int] = {}
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def top(label: int) -> int:
        while label in above:
            label = above[label]
        return label

    def shingles(member: tuple) -> tuple[np.ndarray, np.ndarray]:
        if member[0] not in sets:
            sets[member[0]] = weighted_shingles(hashed_words(member[2]), idf)
        return sets[member[0]]

    found = []
    for one in ones:
        own = np.frombuffer(one[3], np.uint32)
        band = int((band_keys(own) == group[0]).argmax())
        equal = marks == own
        first = equal.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        near = [others[at] for at in np.flatnonzero(first & (equal.mean(axis=1) >= LEAST_ESTIMATE))]
        near = [x for x in near if top(x[1]) != top(one[1])]
        if not near:
            continue
        likely = weighted_jaccards(shingles(one), [shingles(x) for x in near]) >= LEAST_SIMILARITY - 1e-9
        for at in np.flatnonzero(likely):
            other = near[at]
            mine, its = top(one[1]), top(other[1])
            if mine != its and weighted_jaccard(shingles(one), shingles(other)) >= LEAST_SIMILARITY:
                above[max(mine, its)] = min(mine, its)
                found.append((one[0], other[0]))
    return found


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (the key by default) with class_id, class_size and kept.

    A class is what links of a similarity of 0.8 or more hold together; texts with the same words
    in order are linked too, whatever their signs and white space. class_id is the smallest key of
    the class, null if it has none; the row with the smallest key, null keys last, stays (kept).
    Null and wordless texts are linked only to equal ones. Repeated rows are rows of one class;
    keys need not be unique. Input columns named like a result are replaced. An empty table gives
    an empty table.
    """
    results = ("class_id", "class_size", "kept")
    carry = [c for c in (carry if carry is not None else [key]) if c not in results]
    signed, labelled = _classes(docs, text, key, carry)
    return _best_of(labelled(signed.select("same", "place", "row"))).select(
        "row.carry.*", "class_id", "class_size", (F.col("place") == F.col("best.place")).alias("kept"))


def _best_of(whole: DataFrame) -> DataFrame:
    """Rows (label, place, row) with their class: class_id, class_size, and key and place of the row that stays."""
    ranked = whole.select("label", "place", F.col("row.key").alias("key"))
    classes = ranked.groupBy("label").agg(
        F.min("key").alias("class_id"), F.count("*").alias("class_size"),
        F.min(F.struct(F.col("key").isNull().alias("last"), "key", "place")).alias("best"))
    return whole.join(classes, "label")


def _classes(docs: DataFrame, text: str, key: str, carry: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The signed rows (row with key and carry, text, same, place), written, and what adds the class's label to rows of them."""
    spark: SparkSession = docs.sparkSession
    given = docs.select(
        F.struct(docs[key].cast("long").alias("key"), F.struct(*[docs[c] for c in carry]).alias("carry")).alias("row"),
        docs[text].alias("text"))
    idf = spark.sparkContext.broadcast(document_frequencies(given))
    signed = written(_sign(given, idf).select(
        "*", F.monotonically_increasing_id().alias("place"), F.length("text").cast("long").alias("chars")), "signed")

    nodes = written(signed.groupBy("same").agg(F.min(F.struct("place", "bands")).alias("first")).select(
        "same", F.col("first.place").alias("node"), F.col("first.bands").alias("bands")), "nodes")
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = written(member.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    # most buckets have one member: the filter keeps their rows from moving
    member = written(perhaps_among(member, "bucket", sizes).join(sizes, "bucket"), "buckets")
    met = member.groupBy("node").agg(F.sum("size").alias("met"))
    leads = member.join(met, "node").groupBy("bucket").agg(
        F.max_by("node", F.struct("met", -F.col("node"))).alias("leader"))
    led = written(member.join(leads, "bucket").select("bucket", "node", "leader"), "led")
    # a text too many does no harm, so the texts need not move for an exact choice
    texts = written(perhaps_among(signed.select(F.col("place").alias("node"), "text", "samples", "chars"),
                                  "node", met.select("node")), "texts")
    links = written(_verified(
        led.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), texts, idf), "stars")
    labels = components(links)

    def labelled(frame: DataFrame, column: str, name: str) -> DataFrame:
        return frame.join(labels.select(F.col("node").alias(column), F.col("label").alias(name)), column, "left").withColumn(
            name, F.coalesce(name, column))

    placed = labelled(labelled(led, "node", "label"), "leader", "lead_label").withColumn(
        "apart", F.col("label") != F.col("lead_label"))
    open_buckets = placed.groupBy("bucket").agg(
        F.count("*").alias("n"), F.max("apart").alias("open")).filter("open AND n > 2").select("bucket")
    placed = written(placed.join(open_buckets, "bucket", "left_semi").join(texts.select("node", "chars"), "node"), "apart")
    if placed.limit(1).count():
        extra = written(_block_links(placed, texts, idf), "more-links")
        if extra.limit(1).count():
            labels = components(links.union(extra))

    def with_label(rows: DataFrame) -> DataFrame:
        return labelled(rows.join(nodes.select("same", "node"), "same"), "node", "label")

    return signed, with_label


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class, with the columns of the input. Only the keys of rows move; texts stay where they were written."""
    others = [docs[c] for c in docs.columns if c != text]
    wrapped = docs.select(F.struct(F.lit(0).alias("none"), *others).alias("document"), docs[text].alias("text"),
                          docs[key].alias("doc_id"))
    signed, labelled = _classes(wrapped, "text", "doc_id", ["document"])
    keyed = signed.select("same", "place", F.struct(F.col("row.key").alias("key")).alias("row"))
    dropped = written(_best_of(labelled(keyed)).filter(F.col("place") != F.col("best.place")).select("place"), "dropped")
    document = F.col("row.carry.document")
    return without(signed.select("place", "row", "text"), "place", dropped).select(
        *[F.col("text").alias(c) if c == text else document.getField(c).alias(c) for c in docs.columns])
