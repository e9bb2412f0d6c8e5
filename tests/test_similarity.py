import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexisieve.functions.fingerprint import parse_threshold
from lexisieve.operators import containment, similarity


def brute(a, b):
    shared = len(a & b)
    return Fraction(shared, len(a | b)) if shared else Fraction(0)


def sets(spark, values, name="bits"):
    return spark.createDataFrame([(i, sorted(v)) for i, v in enumerate(values)], f"id long, {name} array<long>")


def families(seed, n, universe, low, high, change):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = set(rng.sample(range(universe), rng.randint(low, high)))
        for _ in range(rng.randint(1, 4)):
            copy = set(base)
            for _ in range(rng.randint(0, max(1, int(len(base) * change)))):
                copy.symmetric_difference_update({rng.randrange(universe)})
            out.append(copy)
    rng.shuffle(out)
    return out[:n] + [set()]


@pytest.mark.parametrize("universe,low,high", [(60, 1, 12), (1024, 20, 90), (10 ** 12, 100, 400)])
@pytest.mark.parametrize("text", [">0.85", ">=0.75", ">=0.5", ">0.3", ">0"])
def test_pairs_equal_brute_force(spark, universe, low, high, text):
    left, right = families(1, 60, universe, low, high, 0.12), families(1, 60, universe, low, high, 0.12)
    right = right[:40] + left[:20]
    value, strict = parse_threshold(text)
    want = {}
    for a in {frozenset(s) for s in left if s}:
        for b in {frozenset(s) for s in right if s}:
            t = brute(a, b)
            if t > 0 and (t > value or (not strict and t >= value)):
                want[(left.index(set(a)), right.index(set(b)))] = float(t)
    pairs = similarity.similarity_pairs(sets(spark, left), sets(spark, right), "id", "bits", text)
    got = {(r.left_rep, r.right_rep): r.tanimoto for r in pairs.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("text", ["==1", ">0.85", ">=0.85", ">0.4"])
def test_removal_equals_brute_force(spark, text):
    left, right = families(3, 120, 400, 5, 60, 0.1), families(3, 60, 400, 5, 60, 0.1)
    value, strict = parse_threshold(text)
    kept = {i for i, a in enumerate(left)
            if not any(b and (brute(a, b) > value or (not strict and brute(a, b) == value)) for b in right)}
    out = similarity.remove_known(sets(spark, left), sets(spark, right), "id", "bits", threshold=text)
    assert {r.id for r in out.collect()} == kept


def test_border_of_the_threshold(spark):
    a = set(range(17)) | {100, 101, 102}  # 17 of 20 shared with its core: exactly 0.85
    df, known = sets(spark, [a]), sets(spark, [set(range(17))])
    assert similarity.remove_known(df, known, "id", "bits", threshold=">0.85").count() == 1
    assert similarity.remove_known(df, known, "id", "bits", threshold=">=0.85").count() == 0


def test_signatures_never_miss_a_pair():
    """Sets within the threshold share a signature, whatever their sizes."""
    rng = random.Random(5)
    for threshold in (Fraction(3, 4), Fraction(17, 20), Fraction(19, 20)):
        ends = similarity.size_intervals(threshold, 400)
        for _ in range(300):
            n = rng.randint(1, 300)
            a = set(rng.sample(range(2000), n))
            b = set(a)
            for _ in range(rng.randint(0, n // 5 + 1)):
                b.symmetric_difference_update({rng.randrange(2000)})
            if b and brute(a, b) >= threshold:
                i, j = (next(k for k, e in enumerate(ends) if len(s) <= e) for s in (a, b))
                assert abs(i - j) <= 1
                assert len(a ^ b) <= similarity.largest_difference(threshold, ends[max(i, j)])


def test_groups_of_copies_and_near_copies(spark):
    base = set(range(100))
    left = [base] * 300 + [base - {i} for i in range(60)] + [{500 + i, 600 + i} for i in range(100)]
    right = [base] * 200 + [base - {99, i} for i in range(50)]
    out = similarity.remove_known(sets(spark, left), sets(spark, right), "id", "bits", threshold=">0.85")
    assert {r.id for r in out.collect()} == set(range(360, 460))
    pairs = similarity.similarity_pairs(sets(spark, left[:300]), sets(spark, right[:200]), "id", "bits", "==1").collect()
    assert [(r.left_copies, r.right_copies) for r in pairs] == [(300, 200)]
    assert similarity.set_members(sets(spark, left[:300]), "id", "bits").where("rep = 0").count() == 300


def test_cross_of_two_and_four(spark):
    left, right = [{1, 2}, {1, 3}], [{1, 4}, {1, 5}, {1, 6}, {1, 2}]
    pairs = similarity.similarity_pairs(sets(spark, left), sets(spark, right), "id", "bits", ">0")
    assert pairs.count() == 8
    best = {r.left_rep: (r.right_rep, r.tanimoto) for r in similarity.best_matches(pairs).collect()}
    assert best[0] == (3, 1.0) and best[1] == (0, 1 / 3)


def test_exact_removals_are_near_removals_and_empty_known_drops_nothing(spark):
    left, right = families(8, 80, 200, 3, 30, 0.2), families(8, 40, 200, 3, 30, 0.2)
    df, known = sets(spark, left), sets(spark, right)
    exact = {r.id for r in similarity.remove_known(df, known, "id", "bits", threshold="==1").collect()}
    near = {r.id for r in similarity.remove_known(df, known, "id", "bits", threshold=">0.5").collect()}
    assert near <= exact
    assert similarity.remove_known(df, known.limit(0), "id", "bits").count() == len(left)


def test_query_search(spark):
    df = sets(spark, [{1, 2, 3}, {1}, {9}, set()])
    rows = similarity.similar_to_query(df, spark.createDataFrame([([1, 2, 3],)], "bits array<int>"), "id", "bits", k=2).collect()
    assert [(r.id, round(r.tanimoto, 6)) for r in rows] == [(0, 1.0), (1, 0.333333)]


def test_bad_thresholds():
    for text in ("0.5", "==0.9", ">1.5"):
        with pytest.raises(ValueError):
            parse_threshold(text)


def test_containment_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [set(rng.sample(range(60), rng.randint(0, 25))) for _ in range(150)]
    frags = [set(rng.sample(range(60), rng.randint(1, 4))) for _ in range(40)] + [set(), {1, 999}]
    frags += frags[:5]
    scores = [float(i % 7 - 2) for i in range(len(frags))]
    df = sets(spark, rows)
    refs = spark.createDataFrame([(i, sorted(f), s) for i, (f, s) in enumerate(zip(frags, scores))],
                                 "item long, bits array<long>, points double")
    kept = {i for i, r in enumerate(rows) if not any(f and f <= r for f in frags)}
    assert {r.id for r in containment.remove_containing(df, refs, "id", "bits").collect()} == kept
    got = {r.id: r.score for r in containment.fragment_score(df, refs, "id", "bits", "points").collect()}
    for i, r in enumerate(rows):
        total = sum(s for f, s in zip(frags, scores) if f and f <= r)
        assert got[i] == (total if total != 0 else -1.0)


def test_containment_with_hot_elements_and_no_references(spark):
    df = sets(spark, [{1, 2, i + 10} for i in range(300)])
    refs = sets(spark, [{1, 2}, {1, 2, 15}])
    assert containment.remove_containing(df, refs, "id", "bits").count() == 0
    assert containment.remove_containing(df, refs.limit(0), "id", "bits").count() == 300
    one = containment.one_fragment_score(df, spark.createDataFrame([([15, 1],)], "bits array<int>"), "bits")
    assert one.where("score = 1").count() == 1 and one.where("score = -1").count() == 299
    invalid = containment.fragment_score(df.limit(3), refs.withColumn("p", F.lit(2.0)), "id", "bits", "p", valid=F.col("id") > 0)
    assert {r.id: r.score for r in invalid.collect()} == {0: -1.0, 1: 2.0, 2: 2.0}
