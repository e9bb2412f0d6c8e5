import pytest

from lexisieve.operators import mixing


def test_epoch_length_and_ratios():
    assert mixing.epoch_length({"a": 10, "b": 60}, {"a": 0.5, "b": 0.3}) == 200
    assert mixing.source_ratios(has_family=False) == {"active": 0.5, "molecule": 0.3, "non_family": 0.2}
    assert mixing.source_ratios()["family"] == 0.1


def test_mixing_recycles_every_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DRAWS_PER_COPY", 2)
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(60)] + [("c", 0)], "source string, id int")
    ratios = {"a": 0.5, "b": 0.3, "c": 0.0}
    rows = mixing.mix_sources(df, ratios, "source", "id", seed=1).collect()
    assert sorted(r.draw for r in rows) == list(range(200))
    assert all(r.id == r.draw % (10 if r.source == "a" else 60) for r in rows)
    quota = {r.source: r for r in mixing.mix_quota(df, ratios, "source", seed=1).collect()}
    assert quota["a"].n_drawn == sum(r.source == "a" for r in rows) and quota["a"].epoch_length == 200
    assert 90 < quota["a"].n_drawn < 160


def test_batches_are_full(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    sizes = mixing.make_batches(df, "k", 64).groupBy("batch").count().collect()
    assert len(sizes) == 15 and {r["count"] for r in sizes} == {64}


@pytest.mark.parametrize("n", [0, 7, 500, 999, 2000])
def test_exact_samples(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "k")
    small = {r.k for r in mixing.sample_exact(df, "k", n, seed=3).collect()}
    large = [r.k for r in mixing.sample_exact(df, "k", n, seed=3, small=-1).collect()]
    assert len(large) == min(n, 1000) and set(large) == small


def test_balanced_set(spark):
    active = spark.createDataFrame([(i, [i, i + 1]) for i in range(10)] + [(0, [0, 1])], "id long, bits array<long>")
    decoy = spark.createDataFrame(
        [(i, [i, i + 1]) for i in range(5, 10)] + [(100, [0, 1]), (101, [7, 8])] +
        [(i, [i, i + 9]) for i in range(200, 240)] + [(300, [1]), (300, [2])], "id long, bits array<long>")
    out = mixing.balanced_training_set(active, decoy, "id", "bits").collect()
    assert sum(r.LABEL for r in out) == 10 and sum(r.LABEL == 0 for r in out) == 10
    assert {r.id for r in out if r.LABEL == 0} <= set(range(200, 240))


def test_lookup_marks_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    table = spark.createDataFrame([("a", 1.5)], "k string, p double")
    rows = {r.k: (r.p, r.p_missing) for r in mixing.lookup(df, table, "k", "k", ["p"]).collect()}
    assert rows == {"a": (1.5, 0), "b": (None, 1), None: (None, 1)}
