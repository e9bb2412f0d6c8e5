"""Classes slice by slice, blocks turn by turn, and shuffle files that end with the table they were for."""

import glob
from fractions import Fraction

import pytest

from lexisieve.operators import similarity
from lexisieve.session import materialize
from test_similarity import families, sets
from test_similarity_blocks import want_best


def test_slices_give_the_same_lists(spark, monkeypatch):
    left, right = families(1, 40, 300, 5, 60, 0.3), families(2, 30, 300, 5, 60, 0.3)
    a, b = (similarity.distinct_sets(sets(spark, s), "id", "bits") for s in (left, right))

    def lists():
        rows = similarity._class_lists(a, b, Fraction(0)).collect()
        return {(r.side, r.rep, r.n, r.copies): dict(zip(r.classes, r.weights)) for r in rows}

    whole, written = lists(), []
    monkeypatch.setattr(similarity, "SLICE_ELEMENTS", 500)
    monkeypatch.setattr(similarity, "materialize", lambda df: written.append(df.columns) or materialize(df))
    assert lists() == whole
    assert written.count(["side", "rep", "class", "weight"]) > 1


@pytest.mark.parametrize("text", [">0", ">=0.8"])
def test_turns_give_the_same_best_matches(spark, monkeypatch, text):
    monkeypatch.setattr(similarity, "BLOCKS_AT_ONCE", 1)
    monkeypatch.setattr(similarity, "SLICE_ELEMENTS", 400)
    turns = []
    monkeypatch.setattr(similarity, "materialize", lambda df: turns.append(df.columns) or materialize(df))
    left, right = families(1, 50, 60, 1, 12, 0.3), families(2, 40, 60, 1, 12, 0.3)
    right += left[:5]
    found = similarity.best_match(sets(spark, left), sets(spark, right), "id", "bits", text, elements=60).collect()
    assert {r.left_rep: (r.right_rep, r.tanimoto) for r in found} == want_best(left, right, text)
    assert turns.count(["l", "r", "lcopies", "rcopies", "tanimoto"]) > 1


def test_shuffle_files_end_with_the_write(spark):
    def files():
        folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
        return set(glob.glob(f"{folder}/*/shuffle_*.data"))

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, value = files(), spark.conf.get(name)
    df = materialize(spark.range(1000).repartition(3, "id"))
    assert not files() - before and spark.conf.get(name) == value
    assert df.count() == 1000
    assert spark.range(1000).repartition(3, "id").groupBy("id").count().count() == 1000 and files() - before
