"""Best matches without pair lists, and keys that many sets share."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexisieve.functions.fingerprint import parse_threshold
from lexisieve.operators import similarity
from test_similarity import brute, families, sets


def want_best(left, right, text):
    value, strict = parse_threshold(text)
    out = {}
    for a in {frozenset(s) for s in left if s}:
        found = [(-brute(a, b), right.index(set(b))) for b in {frozenset(s) for s in right if s}]
        found = [(t, j) for t, j in found if t < 0 and (-t > value or (not strict and -t >= value))]
        if found:
            t, j = min(found)
            out[left.index(set(a))] = (j, float(-t))
    return out


@pytest.mark.parametrize("universe,low,high", [(60, 1, 12), (10 ** 12, 60, 200)])
@pytest.mark.parametrize("text,elements", [(">0", 200), (">=0.5", 10 ** 6), (">0.3", 50), (">=0.8", 300), ("==1", 10)])
def test_best_match_equals_brute_force(spark, universe, low, high, text, elements):
    left, right = families(1, 70, universe, low, high, 0.3), families(1, 60, universe, low, high, 0.3)
    right = right[:50] + left[:10] + right[:5]
    found = similarity.best_match(sets(spark, left), sets(spark, right), "id", "bits", text, elements=elements).collect()
    assert {r.left_rep: (r.right_rep, r.tanimoto) for r in found} == want_best(left, right, text)
    assert len(found) == len({r.left_rep for r in found})


def test_best_match_with_a_hot_element_and_small_counts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_SHARED", 50)
    monkeypatch.setattr(similarity, "_CELLS", 90)
    left = [{1, 2, i + 10, i % 7 + 900} for i in range(120)]
    right = [{1, 3, i + 12, i % 5 + 900} for i in range(80)]
    found = similarity.best_match(sets(spark, left), sets(spark, right), "id", "bits", ">0", elements=150).collect()
    assert {r.left_rep: (r.right_rep, r.tanimoto) for r in found} == want_best(left, right, ">0")


def test_best_match_of_empty_sides(spark):
    some = sets(spark, [{1, 2}, set()])
    assert similarity.best_match(some, some.limit(0), "id", "bits").count() == 0
    assert similarity.best_match(some.limit(0), some, "id", "bits").count() == 0
    assert similarity.best_match(some, sets(spark, [{9}]), "id", "bits", ">0").count() == 0


@pytest.mark.parametrize("text", [">0.85", ">=0.8", ">0.3"])
def test_removal_with_small_blocks_equals_brute_force(spark, monkeypatch, text):
    monkeypatch.setattr(similarity, "LEFT_BLOCK", 5)
    monkeypatch.setattr(similarity, "RIGHT_BLOCK", 2)
    rng = random.Random(4)
    core = set(range(30))
    near = [core ^ {rng.randrange(60) for _ in range(rng.randint(0, 6))} for _ in range(80)]
    left = near[:50] + families(6, 60, 300, 5, 30, 0.2)
    right = near[50:] + [core | {100 + i} for i in range(9)] + families(6, 40, 300, 5, 30, 0.2)
    value, strict = parse_threshold(text)
    kept = {i for i, a in enumerate(left)
            if not any(b and (brute(a, b) > value or (not strict and brute(a, b) == value)) for b in right)}
    out = similarity.remove_known(sets(spark, left), sets(spark, right), "id", "bits", threshold=text)
    assert {r.id for r in out.collect()} == kept
    pairs = similarity.similarity_pairs(sets(spark, left), sets(spark, right), "id", "bits", text).collect()
    assert {left[r.left_rep] == left[r.left_rep] and frozenset(left[r.left_rep]) for r in pairs} == {
        frozenset(a) for i, a in enumerate(left) if a and i not in kept}


def test_groups_of_a_hot_key_are_small(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LEFT_BLOCK", 64)
    lkeys = spark.range(3000).select(F.col("id").alias("l"), F.lit(10).alias("ln"), F.lit(7).alias("key")).union(
        spark.range(50).selectExpr("id", "10", "id + 100"))
    rkeys = spark.range(400).select(F.col("id").alias("r"), F.lit(10).alias("rn"), F.lit(7).alias("key")).union(
        spark.range(50).selectExpr("id", "10", "id + 100"))
    blocks = similarity._blocks_per_key(lkeys, rkeys)
    assert [tuple(r) for r in blocks.collect()] == [(7, 47, 25)]
    joined = similarity.split_keys(lkeys, rkeys)
    assert joined.count() == 3000 * 400 + 50 and joined.select("l", "r").distinct().count() == 3000 * 400 + 50 - 50
    parts = [similarity.split_keys(lkeys, rkeys, first, blocks) for first in (True, False)]
    assert sum(p.count() for p in parts) == 3000 * 400 + 50
    group = joined.groupBy("key", "lb", "rb").agg(F.count_distinct("l").alias("l"), F.count_distinct("r").alias("r"))
    most = group.agg(F.max("l"), F.max("r"), F.count(F.lit(1))).first()
    assert most[0] < 2 * 64 and most[1] < 3 * 16 and most[2] >= 47 * 25


def test_fraction_ties_go_to_the_lowest_id(spark):
    found = similarity.best_match(sets(spark, [{1, 2, 3}]), sets(spark, [{4}, {3, 4}, {1, 9}, {2, 7}]), "id", "bits", ">0").collect()
    assert [(r.right_rep, r.tanimoto) for r in found] == [(1, float(Fraction(1, 4)))]


def test_no_list_of_pairs_carries_elements(spark):
    left, right = families(1, 40, 10 ** 6, 10, 60, 0.1), families(1, 40, 10 ** 6, 10, 60, 0.1)
    a, b = sets(spark, left), sets(spark, right)
    for made in (similarity.similarity_pairs(a, b, "id", "bits", ">=0.8"), similarity.similarity_pairs(a, b, "id", "bits", ">=0.01"),
                 similarity.best_match(a, b, "id", "bits", ">=0.01"), similarity.known_set_keys(a, b, "id", "bits")):
        assert "array_intersect" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_elements_of_the_same_sets_are_one_class(spark):
    left, right = [set(range(50)) | {90}, set(range(50)), {70}], [set(range(50)) | {91}, {90, 92}]
    a, b = (similarity.distinct_sets(sets(spark, s), "id", "bits") for s in (left, right))
    lists = {(r.side, r.rep): (r.n, sorted(r.weights)) for r in similarity._class_lists(a, b, Fraction(0)).collect()}
    assert lists == {(0, 0): (51, [1, 50]), (0, 1): (50, [50]), (1, 0): (51, [50]), (1, 1): (2, [1])}


@pytest.mark.parametrize("threshold", [Fraction(3, 4), Fraction(17, 20)])
def test_only_sets_without_a_match_leave_early(spark, threshold):
    left, right = families(1, 150, 10 ** 9, 1, 80, 0.15), families(1, 90, 10 ** 9, 1, 80, 0.15)
    left = left[:-1] + families(9, 150, 10 ** 9, 1, 80, 0.15)
    sides = [similarity.distinct_sets(sets(spark, s), "id", "bits") for s in (left, right)]
    a, b = ({r.rep for r in side.collect()} for side in similarity._possible(*sides, threshold))
    want = {i for i, s in enumerate(left) if s and left.index(s) == i and any(t and brute(s, t) >= threshold for t in right)}
    assert want <= a and len(a) < 200
    assert {j for j, t in enumerate(right) if t and right.index(t) == j and any(s and brute(s, t) >= threshold for s in left)} <= b


def test_repeated_ids_keep_one_row_per_set(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [1, 2]), (1, [3]), (0, [3])], "id long, bits array<long>")
    rows = similarity.distinct_sets(df, "id", "bits").collect()
    assert sorted((r.rep, r.bits, r.n, r.copies) for r in rows) == [(0, [3], 1, 2), (1, [1, 2], 2, 2)]
