import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisieve.llm import cells, components, neardup


def components_of(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(links, "l long, r long")).collect()}
    want = components_of({i for pair in links for i in pair}, links)
    assert got == {i: c for i, c in want.items() if i != 300}
    assert components.connected(spark.createDataFrame([], "l long, r long")).count() == 0


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    width = min(width, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()


def corpus(seed=0):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(pick.choice((30, 80, 200)))]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[pick.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for _ in range(8):  # each near the one before, the last far from the first
        texts.append(" ".join(chain))
        at = pick.randrange(90)
        chain[at:at + 4] = [word() for _ in range(4)]
    return [*texts, None, "", " \t ", "few words", "Few\nWORDS", "Ä few", "ä few", "x" * 5000]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(i, t, "k", i) for i, t in rows], "doc_id long, text string, key string, n long").repartition(3)
    sets = {i: shingles(t, width) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, width=width).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1), (3, "a b c d e f", 1), (5, "A b c d e f", 2), (7, None, 3), (9, "", 4)],
                               "doc_id long, text string, id int")
    assert sorted((r.doc_id, r.id) for r in neardup.drop_near_duplicates(df).collect()) == [(3, 1), (3, 1), (7, 3), (9, 4)]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_blocks_find_what_leaders_miss(spark):
    """A hub that is linked to all, with copies that are not linked to each other and have smaller ids."""
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(5))
    hub = [word() for _ in range(200)]
    rows = []
    for i in range(30):
        copy = list(hub)
        for at in pick.sample(range(0, 200, 10), 5):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    rows.append((99, " ".join(hub)))
    sets = {i: shingles(t, 4) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == components_of(sets, links)


def test_odd_sketches_keep_similar_pairs():
    pick = np.random.default_rng(1)
    limit = neardup.most_differing(0.8)
    for _ in range(200):
        both, own = pick.integers(0, 1 << 63, 400, dtype=np.uint64), pick.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = np.concatenate((both, own[:50])), np.concatenate((both, own[50:]))  # similarity 0.8
        bits = [np.frombuffer(neardup.odd_sketch(neardup.minhashes(x)), np.uint64) for x in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= limit
    far = [np.frombuffer(neardup.odd_sketch(neardup.minhashes(pick.integers(0, 1 << 63, 400, dtype=np.uint64))), np.uint64)
           for _ in range(2)]
    assert np.bitwise_count(far[0] ^ far[1]).sum() > limit


@pytest.mark.parametrize("per_cell", [5, 1000])
def test_near_vectors_equal_brute_force(spark, per_cell):
    pick = np.random.default_rng(0)
    centres = pick.normal(size=(12, 8))
    x = np.concatenate([c + pick.normal(scale=0.25, size=(30, 8)) for c in centres] + [np.tile(centres[0], (40, 1)), 3 * centres[:3]])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 1.0], [2.0, 2.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    cosine = (x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    linked = (cosine >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = components_of([r[0] for r in rows], [*map(tuple, np.argwhere(linked).tolist()), (1006, 1007)])
    got = {r.vec_id: r for r in cells.near_vectors(df, per_cell=per_cell).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_links for i in range(len(x))] == linked.sum(1).tolist()
    assert [got[1000 + i].n_links for i in range(len(odd))] == [0] * 6 + [1, 1]
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert cells.near_vectors(df.where("false")).count() == 0


def test_words_whose_checksums_collide_are_different(spark):
    rows = [(1, "wmnluekz"), (2, "xcpcgzhl"), (3, "one two three wmnluekz five"), (4, "one two three xcpcgzhl five")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=80)
    assert {(r.doc_id, r.component_id, r.kept) for r in found.collect()} == {(i, i, True) for i in range(1, 5)}


def test_word_hashes_have_64_bits():
    from lexisieve.llm.neardup import shingle_set
    rng = random.Random(0)
    words = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(400_000)}
    assert len(np.unique(np.concatenate([shingle_set(w, 1) for w in words]))) == len(words)
