"""The search inside buckets: groups side by side, and no text shuffled that no group needs."""

import itertools

import numpy as np
import pandas as pd

from lexisieve.llm import neardup


def _frame(pick, groups):
    rows = []
    for key, (i, j, size) in enumerate(groups):
        base = pick.integers(0, 1 << 63, 60, dtype=np.uint64)
        for k in range(size):
            own = np.unique(np.concatenate((base, pick.integers(0, 1 << 63, int(pick.integers(0, 40)), dtype=np.uint64))))
            least = neardup.minhashes(own)
            keys = neardup.band_keys(least).view(np.int64)
            keys[0 if key % 2 else 3] = key
            rows.append((key, i, j, i if i == j or k % 2 else j, len(rows), len(rows) // 3, len(own), neardup.odd_sketch(least), keys))
    return pd.DataFrame(rows, columns=["key", "i", "j", "block", "id", "component", "n", "sketch", "keys"]).sort_values(
        ["key", "i", "j", "n", "id"], ignore_index=True)


def test_groups_side_by_side_give_the_pairs_of_each():
    frame = _frame(np.random.default_rng(3), [(0, 0, 7), (0, 1, 12), (2, 2, 1), (1, 1, 40), (0, 0, 2)])
    limit, want = neardup.most_differing(0.8), set()
    for a, b in itertools.combinations(frame.itertuples(), 2):
        if (a.key, a.i, a.j) != (b.key, b.i, b.j) or a.component == b.component or (a.i != a.j and a.block == b.block):
            continue
        bits = [np.frombuffer(x.sketch, np.uint64) for x in (a, b)]
        common = np.flatnonzero(a.keys == b.keys)
        if (np.bitwise_count(bits[0] ^ bits[1]).sum() <= limit and 100 * min(a.n, b.n) >= 80 * max(a.n, b.n)
                and a.keys[common[0]] == a.key):
            want.add((a.Index, b.Index))
    got = [tuple(p) for p in neardup._near_in_groups(frame, limit, 80)[:, 2:].tolist()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_frames_hold_whole_groups():
    frame = _frame(np.random.default_rng(5), [(0, 0, 5), (0, 0, 1), (0, 1, 9), (1, 1, 3)])
    for rows in (1, 2, 4, 100):
        parts = list(neardup._whole_groups(frame.iloc[at:at + rows] for at in range(0, len(frame), rows)))
        pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), frame)
        assert sum(p["key"].nunique() for p in parts) == 4
    assert list(neardup._whole_groups(iter([]))) == []


def test_sets_of_members_shuffle_no_other_texts(spark):
    texts = spark.range(1000).selectExpr("id", "concat('a b c d ', id) as text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        sets = neardup._shingle_sets(texts, texts.where("id % 100 = 0").unionAll(texts.where("id = 100")), 4)
        plan = sets._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(r.id for r in sets.collect()) == list(range(0, 1000, 100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_word_hashes_know_long_words_and_odd_spaces():
    words = neardup.word_hashes("Abc  abc\x0bé\x0c" + "x" * 40 + "\t" + "x" * 41 + "\nab\x1cc")
    assert len(words) == 6 and words[0] == words[1] and len(set(words.tolist())) == 5
    assert words[0] == neardup.word_hashes("y" * 100 + " ABC")[1]
    assert not len(neardup.word_hashes(" \n\r"))
