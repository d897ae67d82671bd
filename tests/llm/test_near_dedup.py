import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from meritlake.llm import near_dedup as N


def brute(rows):
    """Classes by comparing all pairs; rows: (key, text)."""
    df, n = np.zeros(N.CELLS), 0
    for _, t in rows:
        df[list({int(w) % N.CELLS for w in N.hashed_words(t)})] += 1
        n += 1
    idf = 1 + np.log((1 + n) / (1 + df))
    sets = [N.weighted_shingles(N.hashed_words(t), idf) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            wordless = not len(sets[i][0]) and not len(sets[j][0])
            if (rows[i][1] or "") == (rows[j][1] or "") if wordless else N.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    return sorted((tuple(sorted(g, key=repr)) for g in groups.values()), key=repr)


def corpus():
    rng = random.Random(5)
    words = ["w%03d" % i for i in range(400)]
    rows = []
    for _ in range(60):
        rows.append(" ".join(rng.choice(words) for _ in range(rng.choice((3, 60, 200)))))
    for base in list(rows[:30]):
        for changes in (0, 1, 3, 8):
            parts = base.split()
            for _ in range(changes):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            rows.append(" ".join(parts))
    chain = ["c%d" % i for i in range(120)]
    for step in range(8):  # neighbours are alike, the ends are not
        rows.append(" ".join(chain[step * 4:step * 4 + 80]))
    passage = " ".join("p%d" % i for i in range(50))
    for i in range(40):
        rows.append(" ".join(rng.choice(words) for _ in range(40)) + " " + passage)
    rows += ["", None, "!!", "!! ", "!!", "One, two; three!", "one two three", "x " * 20_000, "x " * 19_999]
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = corpus() + [(None, "null key text one two three four"), (3, corpus()[3][1])]
    frame = spark.createDataFrame([(k, t, 1, "l") for k, t in rows], "doc_id long, text string, place int, label string")
    got = defaultdict(list)
    kept = defaultdict(int)
    for r in N.near_duplicates(frame).collect():
        got[r.class_id].append(r.doc_id)
        kept[r.class_id] += r.kept
        if r.kept:
            assert r.doc_id == r.class_id
    assert sorted((tuple(sorted(g, key=repr)) for g in got.values()), key=repr) == brute(rows)
    assert set(kept.values()) == {1}


def test_pipeline_form_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g", 7, "x"), (2, "A b c, d e f g!", 8, "y")],
                                  "doc_id long, text string, class_id int, bucket string")
    out = N.drop_near_duplicates(frame)
    assert out.columns == frame.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f g", 7, "x")]
    assert N.drop_near_duplicates(frame.filter("false")).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(3)
    sampler, errors = N.Sampler(), []
    for share in (0.3, 0.6, 0.8, 0.95):
        for _ in range(20):
            both = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
            weights = rng.uniform(1, 12, 400)
            a = rng.random(400) < (1 + share) / 2
            b = rng.random(400) < (1 + share) / 2
            one, two = (both[a], weights[a]), (both[b], weights[b])
            estimate = (sampler.samples(*one) == sampler.samples(*two)).mean()
            errors.append(estimate - N.weighted_jaccard(one, two))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.25


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(300, 200)]
    got = {r.node: r.label for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 300: 200, 200: 200}


def test_blocks_find_what_the_leader_misses(spark, monkeypatch):
    """Nodes apart from a leader meet all members of the bucket; links join exactly what is alike."""
    rng = random.Random(9)
    texts = []
    for group in range(4):
        base = ["g%d w%d" % (group, i) for i in range(30)]
        for _ in range(3):
            texts.append(" ".join(base[:29] + [rng.choice(base)]))
    idf = np.ones(N.CELLS)
    sampler = N.Sampler()
    marks = [sampler.samples(*N.weighted_shingles(N.hashed_words(t), idf)) for t in texts]
    rows = [(int(bucket), i, i if i > 2 else 0, len(texts[i]), i > 2)
            for i in range(12) for bucket in N.band_keys(marks[i])]
    members = spark.createDataFrame(rows, "bucket long, node long, label long, chars long, apart boolean")
    held = spark.createDataFrame([(i, texts[i], marks[i].tobytes()) for i in range(12)],
                                 "node long, text string, samples binary")
    sent = spark.sparkContext.broadcast(idf)
    for limit in (2, 256):
        monkeypatch.setattr(N, "BLOCK_ROWS", limit)
        links = N._block_links(members, held, sent)
        assert all(r.a // 3 == r.b // 3 > 0 and r.a != r.b for r in links.collect())
        assert {r.node: r.label for r in N.components(links).collect()} == {i: i // 3 * 3 for i in range(3, 12)}


def test_large_class_beside_the_leaders_is_joined_by_few_links():
    """Two hundred alike texts of classes of their own give a link each, not one for each pair."""
    idf, sampler = np.ones(N.CELLS), N.Sampler()
    texts = [" ".join("w%d" % i for i in range(300)) + " end%d" % k for k in range(200)]
    marks = [sampler.samples(*N.weighted_shingles(N.hashed_words(t), idf)) for t in texts]
    counts = defaultdict(int)
    for k in N.band_keys(marks[0]):
        counts[int(k)] += 1
    linked = set()
    for bucket in counts:
        block = [(i, i, t, m.tobytes()) for i, (t, m) in enumerate(zip(texts, marks)) if bucket in N.band_keys(m)]
        links = N._links_between((bucket, 0, 0), block, block, idf)
        assert len(links) < len(block)
        linked |= {x for pair in links for x in pair}
    assert linked == set(range(200))


def test_similarities_in_one_pass():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(30):
        hashes = np.unique(rng.integers(0, 90, 40).astype(np.uint64))
        sets.append((hashes, rng.uniform(1, 9, len(hashes))))
    assert np.allclose(N.weighted_jaccards(sets[0], sets), [N.weighted_jaccard(sets[0], x) for x in sets])
    assert N.weighted_jaccard(sets[0], (np.zeros(0, np.uint64), np.zeros(0))) == 0.0
