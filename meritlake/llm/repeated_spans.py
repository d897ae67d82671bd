"""Repeated spans of words, removed exactly, by compaction of a de Bruijn graph.

A window of so many words is an edge of the graph. Edges travel in bundles: successive windows of a
document whose least short k-mer, the seed, is the same one. Seeds are counted first, so only windows
whose seed occurs again go on. All occurrences of a window meet in its seed's bucket, where windows that
occur once are dropped and the others become paths as far as the bundle goes; a path ends where documents
join, leave, start or end. Paths that only ever follow each other are found by a join of their ends and
compacted. Every path keeps source coordinates. Spans of words at all coordinates of a path are digested
at last and must be the same words.

Texts are packed once (compressed, some MB a row) where they lie; later passes read packs, and what a
pack is told comes to it by its number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritlake.llm.frames import written

SEED_WORDS = 11
# Bytes of text in a pack; a longer document is a pack of its own.
PACK_BYTES = 2 << 20
# Words whose windows share a bucket, and the most buckets.
BUCKET_WORDS = 1 << 22
MOST_BUCKETS = 1 << 18
MOST_KNOWN_WORDS = 500_000
STEP = 0x9E3779B97F4A7C15  # odd: powers never vanish modulo 2 ** 64
U = np.uint64

BUNDLES = np.dtype([("seed", U), ("next", U), ("previous", U), ("ordinal", "<u4"), ("at", "<u4"), ("count", "<u4"),
                    ("windows", "u1")])
GRAPH = ("kind int, path struct<seed: long, first: long>, edges int, n long, last long, next long, first long, previous long, "
         "pack long, at long, ordinal int")
SPAN = "array<struct<start: int, words: int, path: struct<seed: long, first: long>, digest: binary>>"


def mixed(values: np.ndarray, turn: int = 0) -> np.ndarray:
    """Values scattered over all 64 bits."""
    x = values ^ U(turn * 0xD6E8FEB86659FD93 % 2 ** 64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rolled(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive words, by doubling."""
    if len(words) < length:
        return np.zeros(0, U)
    total, done, power, width = None, 0, words, 1
    while True:
        if length & width:
            if total is None:
                total = power.copy()
            else:
                keep = len(words) - done - width + 1
                total = total[:keep] + power[done:done + keep] * U(pow(STEP, done, 2 ** 64))
            done += width
        if done == length:
            return total
        power = power[:len(power) - width] + power[width:] * U(pow(STEP, width, 2 ** 64))
        width *= 2


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of every ``width`` consecutive values, the first of equal ones."""
    least, place, now = values, np.arange(len(values)), 1

    def join(other: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = least[:len(least) - other], least[other:]
        later = right < left
        return np.where(later, right, left), np.where(later, place[other:], place[:len(place) - other])

    while now * 2 <= width:
        least, place = join(now)
        now *= 2
    if now < width:
        least, place = join(width - now)
    return place


class WordHashes(dict):
    """Hash of each word (in UTF-8); starts afresh when it is full."""

    def __init__(self, salt: int):
        super().__init__()
        self.salt = salt

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MOST_KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, self.salt)
        return found


class Windows(NamedTuple):
    """Windows of all documents of a pack after each other, and the bundles they make."""

    digests: np.ndarray   # of the window that starts at each word
    valid: np.ndarray     # whether it lies within one document
    seeds: np.ndarray     # each bundle's seed
    starts: np.ndarray    # each bundle's first window
    sizes: np.ndarray     # each bundle's number of windows
    contents: np.ndarray  # equal where bundles have the same words and the same windows


def windows_of(hashes: np.ndarray, ends: np.ndarray, window: int) -> Windows:
    """``hashes`` of the words of all documents, ``ends`` of the documents in them."""
    seed_words = min(SEED_WORDS, window)
    count = max(0, len(hashes) - window + 1)
    none = np.zeros(0, U)
    if not count:
        return Windows(none, np.zeros(0, bool), none, np.zeros(0, int), np.zeros(0, int), none)
    last = np.repeat(ends, np.diff([0, *ends]))
    valid = np.arange(count) + window <= last[:count]
    seeds = mixed(rolled(hashes, seed_words), 1)
    places = least_places(seeds, window - seed_words + 1)
    digests = np.maximum(mixed(rolled(mixed(hashes, 2), window), 3), U(1))  # 0 means none
    kept = np.flatnonzero(valid)
    if not len(kept):
        return Windows(digests, valid, none, np.zeros(0, int), np.zeros(0, int), none)
    fresh = np.ones(len(kept), bool)
    fresh[1:] = (np.diff(kept) != 1) | (np.diff(places[kept]) != 0)
    first = np.flatnonzero(fresh)
    starts, sizes = kept[first], np.diff([*first, len(kept)])
    # hash of the words a bundle spans, from running sums; the step has an inverse, as it is odd
    powers = np.cumprod(np.r_[U(1), np.full(len(hashes), U(STEP))])
    back = np.cumprod(np.r_[U(1), np.full(len(hashes), U(pow(STEP, -1, 2 ** 64)))])
    sums = np.r_[U(0), np.cumsum(mixed(hashes, 4) * powers[:-1])]
    spanned = (sums[starts + sizes + window - 1] - sums[starts]) * back[starts]
    seat = places[starts]
    contents = mixed(spanned ^ mixed(((seat - starts) * 4096 + sizes).astype(U), 5), 6)
    return Windows(digests, valid, seeds[seat], starts, sizes, contents)


class Pack:
    """Words of a pack's documents in UTF-8, cut at space and the characters 9 to 13, which is how bytes are split."""

    def __init__(self, body: bytes, lengths: list[int]):
        import zstandard

        raw, at, ends = zstandard.ZstdDecompressor().decompress(body), 0, []
        self.words: list[bytes] = []
        for length in lengths:
            self.words += raw[at:at + length].split()
            ends.append(len(self.words))
            at += length
        self.ends = np.array(ends, np.int64)

    def windows(self, known: WordHashes, window: int) -> Windows:
        hashes = np.fromiter(map(known.__getitem__, self.words), U, len(self.words))
        return windows_of(hashes, self.ends, window)


def _packs(docs: DataFrame, text: str, key: str) -> DataFrame:
    """pack, keys, lengths, body: rows of the input, where they lie, in packs."""
    given = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = given.schema["key"].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=3)
        number, keys, parts, held = TaskContext.get().partitionId() << 33, [], [], 0

        def packed() -> pa.RecordBatch:
            rows = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), lists, pa.array([list(map(len, parts))], pa.list_(pa.int32())),
                 pa.array([press.compress(b"".join(parts))], pa.binary())], names=["pack", "keys", "lengths", "body"])

        for batch in batches:
            names = batch.column(0)
            for place, value in enumerate(batch.column(1)):
                raw = (value.as_py() or "").encode()
                if held and held + len(raw) > PACK_BYTES:
                    yield packed()
                    number, keys, parts, held = number + 1, [], [], 0
                keys.append(names.slice(place, 1))
                parts.append(raw)
                held += len(raw)
        if keys:
            yield packed()

    return written(given.mapInArrow(
        pack, f"pack long, keys array<{kind}>, lengths array<int>, body binary"), "packs")


def _bucket(seeds: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(seeds, 7) % U(buckets)).astype(np.int64)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its members."""
    order = np.argsort(buckets, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0]) if len(order) else []
    for first, end in zip(firsts, [*firsts[1:], len(order)]):
        yield int(buckets[order[first]]), order[first:end]


def _rows(kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def _numbers(values: list, kind=U) -> np.ndarray:
    return np.concatenate([np.frombuffer(v, kind) for v in values]) if values else np.zeros(0, kind)


def repeated_seeds(once: list[bytes], more: list[bytes]) -> list[bytes]:
    """For each pack its seeds of a bucket that occur twice or more in all packs."""
    several = _numbers(more)
    values, counts = np.unique(np.concatenate([_numbers(once), several, several]), return_counts=True)
    values = values[counts > 1]
    out = []
    for single, multiple in zip(once, more):
        seeds = _numbers([single, multiple])
        seat = np.searchsorted(values, seeds)
        out.append(seeds[values[np.minimum(seat, len(values) - 1)] == seeds].tobytes() if len(values) else b"")
    return out


def bundles_of(windows: Windows, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bundles whose seed is known, equal ones together, and the digests of all their windows."""
    asked = np.flatnonzero(np.isin(windows.seeds, known))
    _, first, member, count = np.unique(windows.contents[asked], return_index=True, return_inverse=True, return_counts=True)
    starts, sizes = windows.starts[asked], windows.sizes[asked]
    size = len(windows.digests)
    shown = np.where(windows.valid, windows.digests, U(0))
    after = np.where(starts + sizes < size, shown[np.minimum(starts + sizes, size - 1)], U(0))
    before = np.where(starts > 0, shown[np.maximum(starts - 1, 0)], U(0))

    def common(values: np.ndarray) -> np.ndarray:
        """The value of all equal bundles; 0 where they differ."""
        differs = np.zeros(len(first), bool)
        np.logical_or.at(differs, member, values != values[first][member])
        return np.where(differs, U(0), values[first])

    found = np.zeros(len(first), BUNDLES)
    found["seed"], found["next"], found["previous"] = windows.seeds[asked][first], common(after), common(before)
    found["ordinal"], found["at"], found["count"], found["windows"] = asked[first], starts[first], count, sizes[first]
    return found, starts[first]


def _flat(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Member and place in it, for every place of every member."""
    member = np.repeat(np.arange(len(sizes)), sizes)
    return member, np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def local_paths(bundles: np.ndarray, packs: np.ndarray, digests: np.ndarray) -> tuple[dict, dict]:
    """Paths of repeated windows in one bucket, and where they occur in the packs' bundles.

    A window goes on to the next one when every occurrence of either is followed or preceded by the other.
    """
    sizes, counts = bundles["windows"].astype(np.int64), bundles["count"].astype(np.int64)
    member, place = _flat(np.zeros(len(sizes), int), sizes)
    seeds, at = bundles["seed"][member], bundles["at"][member].astype(np.int64) + place
    order = np.lexsort((at, packs[member], digests, seeds))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(seeds[order]) != 0) | (np.diff(digests[order]) != 0)
    name = np.zeros(len(order), np.int64)
    name[order] = np.cumsum(fresh) - 1
    source = order[fresh]  # first occurrence by pack and place
    total = len(source)

    def summed(names: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(total, np.int64)
        np.add.at(out, names, weights)
        return out

    n = summed(name, counts[member])
    # links inside bundles
    inner = np.flatnonzero(np.diff(member) == 0)
    left, right = name[inner], name[inner + 1]
    pairs, seat = np.unique(left * max(1, total) + right, return_inverse=True)
    n_pair = np.zeros(len(pairs), np.int64)
    np.add.at(n_pair, seat, counts[member[inner]])
    left, right = pairs // max(1, total), pairs % max(1, total)
    tight = (n[left] > 1) & (n[left] == n_pair) & (n[right] == n_pair)
    follower, follows = np.full(total, -1), np.zeros(total, bool)
    follower[left[tight]], follows[right[tight]] = right[tight], True

    def outside(places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The one window beyond the bundles that all occurrences of a window have, or 0."""
        names = name[places]
        low, high = np.full(total, np.iinfo(U).max, U), np.zeros(total, U)
        np.minimum.at(low, names, values)
        np.maximum.at(high, names, values)
        return np.where((low == high) & (summed(names, counts) == n), low, U(0))

    ends = np.cumsum(sizes) - 1
    after, before = outside(ends, bundles["next"]), outside(ends - sizes + 1, bundles["previous"])

    heads = np.flatnonzero((n > 1) & ~follows)
    tails, edges = heads.copy(), np.ones(len(heads), np.int64)
    while (going := follower[tails] >= 0).any():
        tails[going] = follower[tails[going]]
        edges[going] += 1
    where = source[heads]
    paths = {"seed": seeds[where], "first": digests[where], "edges": edges, "n": n[heads], "last": digests[source[tails]],
             "next": after[tails], "previous": before[heads], "pack": packs[member[where]], "at": at[where]}
    is_head = np.zeros(total, bool)
    is_head[heads] = True
    met = np.flatnonzero(is_head[name])
    occurrences = {"seed": seeds[met], "first": digests[met], "pack": packs[member[met]],
                   "ordinal": bundles["ordinal"][member[met]], "at": place[met]}
    return paths, occurrences


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(U).view(np.int64), pa.int64())


def _graph_rows(paths: dict, occurrences: dict) -> pa.Table:
    def path(of: dict) -> pa.Array:
        return pa.StructArray.from_arrays([_signed(of["seed"]), _signed(of["first"])], names=["seed", "first"])

    def table(kind: int, of: dict, given: dict) -> pa.Table:
        size = len(of["seed"])
        kinds = {"edges": pa.int32(), "ordinal": pa.int32()}
        columns = {"kind": pa.array(np.full(size, kind), pa.int32()), "path": path(of), **given}
        names = ("kind", "path", "edges", "n", "last", "next", "first", "previous", "pack", "at", "ordinal")
        return pa.table({c: columns.get(c, pa.nulls(size, kinds.get(c, pa.int64()))) for c in names})

    whole = {c: pa.array(paths[c], pa.int64()) for c in ("n", "pack", "at")}
    whole |= {c: _signed(paths[c]) for c in ("last", "next", "first", "previous")}
    whole["edges"] = pa.array(paths["edges"], pa.int32())
    seen = {c: pa.array(occurrences[c], pa.int64()) for c in ("pack", "at")}
    seen["ordinal"] = pa.array(occurrences["ordinal"], pa.int32())
    return pa.concat_tables([table(0, paths, whole), table(1, occurrences, seen)])


def compact(paths: DataFrame, window: int) -> DataFrame:
    """path (its first piece), words, n and source coordinates of paths whose pieces only ever follow each other.

    Pieces are linked by a join of their ends. As all occurrences of linked pieces are the same places, moved on,
    linked pieces lie side by side at their first source, so their order there is the order in the path.
    """
    left, right = paths.alias("left"), paths.alias("right")
    linked = (left.filter("left.next <> 0").join(
        right.filter("right.previous <> 0"),
        F.expr("left.next = right.first AND left.last = right.previous AND left.n = right.n"))
        .select(F.col("right.path").alias("path"), F.lit(True).alias("linked")))
    along = Window.partitionBy("pack").orderBy("at")
    pieces = paths.join(linked, "path", "left").withColumn(
        "whole", F.last(F.when(F.col("linked").isNull(), F.col("path")), ignorenulls=True).over(along))
    return pieces.groupBy(F.col("whole").alias("path")).agg(
        (F.sum("edges") + window - 1).cast("int").alias("words"), F.first("n").alias("n"),
        F.min(F.struct("pack", "at")).alias("source"))


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", key: str = "doc_id",
                   texts: bool = True, salt: int = 0) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, spans and, if asked, kept_text of every row.

    Words are runs of anything but space and the characters 9 to 13. A word goes when a window of
    ``window`` words that covers it starts anywhere else too, in the same or another row; repeated rows
    count. Kept words are joined by one space. ``spans`` are the paths found in the row: first word,
    number of words, the path's name (the same for all its occurrences) and digest of its words; they may overlap. A null
    text has no words, nor has an empty one; null keys are kept. Other columns are not read. An empty
    table gives an empty table. One document has to fit a task.

    Should two different spans meet under one name, which takes two equal 64-bit hashes, the run
    fails and says so; another ``salt`` then hashes anew.
    """
    spark = docs.sparkSession
    packs = _packs(docs, text, key)
    kind = packs.schema["keys"].dataType.elementType.simpleString()
    # white space and a letter a word at least
    most_words = packs.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(1, -(-most_words // (6 * BUCKET_WORDS)))))

    def seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(salt)
        kinds = [("bucket", pa.int64()), ("pack", pa.int64()), ("once", pa.binary()), ("more", pa.binary())]
        for batch in batches:
            for row in batch.to_pylist():
                found, counts = np.unique(Pack(row["body"], row["lengths"]).windows(known, window).seeds, return_counts=True)
                out = [(b, row["pack"], found[i[counts[i] == 1]].tobytes(), found[i[counts[i] > 1]].tobytes())
                       for b, i in _by_bucket(_bucket(found, buckets))]
                if out:
                    yield _rows(kinds, out)

    def again(group: pa.Table) -> pa.Table:
        kept = repeated_seeds(group["once"].to_pylist(), group["more"].to_pylist())
        return pa.table({"pack": group["pack"], "seeds": pa.array(kept, pa.binary())}).filter(
            pa.array([bool(k) for k in kept], pa.bool_()))

    asked = (packs.select("pack", "lengths", "body")
             .mapInArrow(seeds, "bucket long, pack long, once binary, more binary")
             .groupBy("bucket").applyInArrow(again, "pack long, seeds binary")
             .groupBy("pack").agg(F.collect_list("seeds").alias("seeds")))

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(salt)
        kinds = [("bucket", pa.int64()), ("pack", pa.int64()), ("bundles", pa.binary()), ("digests", pa.binary())]
        for batch in batches:
            for row in batch.to_pylist():
                windows = Pack(row["body"], row["lengths"]).windows(known, window)
                found, starts = bundles_of(windows, _numbers(row["seeds"]))
                out = []
                for b, i in _by_bucket(_bucket(found["seed"], buckets)):
                    member, place = _flat(starts[i], found["windows"][i].astype(np.int64))
                    out.append((b, row["pack"], found[i].tobytes(), windows.digests[starts[i][member] + place].tobytes()))
                if out:
                    yield _rows(kinds, out)

    def meet(group: pa.Table) -> pa.Table:
        each = group["bundles"].to_pylist()
        of_pack = np.repeat(group["pack"].to_numpy(), [len(e) // BUNDLES.itemsize for e in each])
        return _graph_rows(*local_paths(_numbers(each, BUNDLES), of_pack, _numbers(group["digests"].to_pylist())))

    graph = written(
        packs.select("pack", "lengths", "body").join(asked, "pack")
        .mapInArrow(edges, "bucket long, pack long, bundles binary, digests binary")
        .groupBy("bucket").applyInArrow(meet, GRAPH), "repeat-graph")
    paths = compact(graph.filter("kind = 0"), window)
    told = (graph.filter("kind = 1").select("path", "pack", "ordinal", "at").join(paths.select("path", "words"), "path")
            .groupBy("pack").agg(F.collect_list(F.struct("ordinal", "at", "words", "path")).alias("told")))

    results = f"key {kind}, n_words long, n_removed long, kept_sha256 string, spans {SPAN}, kept_text string"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(salt)
        for batch in batches:
            for place, row in enumerate(batch.select(["lengths", "body", "told"]).to_pylist()):
                pack = Pack(row["body"], row["lengths"])
                rows = _kept(pack, row["told"] or [], known, window, texts)
                keys = batch.column(batch.schema.get_field_index("keys")).slice(place, 1).flatten()
                yield _result(keys, rows)

    found = written(packs.join(told, "pack", "left").select("keys", "lengths", "body", "told").mapInArrow(cut, results),
                    "kept-words")
    wrong = (found.select(F.explode("spans").alias("s")).groupBy("s.path").agg(
        F.min("s.digest").alias("low"), F.max("s.digest").alias("high")).filter("low <> high").limit(1).collect())
    if wrong:
        raise ValueError(f"different spans share the name {wrong[0]['path']}: choose another salt than {salt}")
    return found.select(F.col("key").alias(key), "n_words", "n_removed", "kept_sha256", "spans",
                        *(["kept_text"] if texts else []))


def _kept(pack: Pack, told: list[dict], known: WordHashes, window: int, texts: bool) -> list[tuple]:
    """n_words, n_removed, kept_sha256, spans and kept text of each document of a pack."""
    spans: list[list[dict]] = [[] for _ in pack.ends]
    gone = np.zeros(len(pack.words) + 1, np.int64)
    if told:
        windows = pack.windows(known, window)
        order = np.argsort(windows.contents, kind="stable")
        ordered = windows.contents[order]
        for path in told:
            content = windows.contents[path["ordinal"]]
            low, high = np.searchsorted(ordered, content, "left"), np.searchsorted(ordered, content, "right")
            for bundle in order[low:high].tolist():
                start = int(windows.starts[bundle]) + path["at"]
                document = int(np.searchsorted(pack.ends, start, "right"))
                gone[start] += 1
                gone[start + path["words"]] -= 1
                words = pack.words[start:start + path["words"]]
                spans[document].append({
                    "start": start - (int(pack.ends[document - 1]) if document else 0), "words": path["words"],
                    "path": path["path"], "digest": hashlib.blake2b(b" ".join(words), digest_size=16).digest()})
    covered = np.cumsum(gone[:-1]) > 0
    out, first = [], 0
    for end, own in zip(pack.ends.tolist(), spans):
        hidden = covered[first:end]
        words = pack.words[first:end]
        if hidden.any():
            words = list(compress(words, (~hidden).tolist()))
        kept = b" ".join(words)
        out.append((end - first, int(hidden.sum()), hashlib.sha256(kept).hexdigest(),
                    sorted(own, key=lambda s: s["start"]), kept.decode() if texts else None))
        first = end
    return out


def _result(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([
        ("start", pa.int32()), ("words", pa.int32()),
        ("path", pa.struct([("seed", pa.int64()), ("first", pa.int64())])), ("digest", pa.binary())]))
    kinds = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", span),
             ("kept_text", pa.string())]
    made = _rows(kinds, rows)
    return pa.RecordBatch.from_arrays([keys, *made.columns], names=["key", *made.schema.names])
