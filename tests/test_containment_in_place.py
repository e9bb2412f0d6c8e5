"""Containment with references in every task, and with references that are joined."""

import random

import pytest
from pyspark.sql import functions as F

from lexisieve.operators import containment
from lexisieve.plans import queries

ROWS = [None, [], [1, 2, 3], [3, 2, 1, None], [7], [7, 8], [2 ** 62, 2 ** 62 + 1]]
REFS = [[1, 2], [2, 1], [7], [], None, [2 ** 62], [2 ** 62 + 1, 2 ** 62 + 2]]
FOUND = {2: 2.0, 3: 2.0, 4: 1.0, 5: 1.0, 6: 1.0}  # [1, 2] stands twice among the references


@pytest.mark.parametrize("kind, limit", [("bigint", 16 << 20), ("string", 16 << 20), ("bigint", -1), ("string", -1)])
def test_nulls_copies_and_texts(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(containment, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame(list(enumerate(ROWS)), "id long, bits array<bigint>").withColumn("bits", F.col("bits").cast(f"array<{kind}>"))
    refs = spark.createDataFrame([(r, 1.0) for r in REFS], "bits array<bigint>, points double").withColumn(
        "bits", F.col("bits").cast(f"array<{kind}>"))
    assert {r.id for r in containment.remove_containing(df, refs, "id", "bits").collect()} == {0, 1}
    got = {r.id: r.score for r in containment.fragment_score(df, refs, "id", "bits", "points").collect()}
    assert got == {i: FOUND.get(i, -1.0) for i in range(len(ROWS))}


def test_many_references_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(containment, "_GATHERED", 50)
    rng = random.Random(5)
    rows = [rng.sample(range(40), rng.randint(0, 30)) for _ in range(200)]
    refs = sorted({tuple(sorted(rng.sample(range(42), rng.randint(1, 8)))) for _ in range(300)})
    df = spark.createDataFrame(list(enumerate(rows)), "id long, bits array<int>")
    found = containment.containment_pairs(df, spark.createDataFrame([(list(r),) for r in refs], "bits array<bigint>"), "id", "bits")
    want = {i: sum(set(r) <= set(row) for r in refs) for i, row in enumerate(rows)}
    got = {r.id: r["count"] for r in found.groupBy("id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}
    assert found.distinct().count() == sum(want.values())


def test_sets_of_generic_tokens_are_neither_written_nor_shuffled(spark, monkeypatch):
    written, plans = [], []
    kept = containment.materialize

    def note(df, *rest):
        written.append(set(df.columns))
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, *rest)

    monkeypatch.setattr(queries, "materialize", note)
    monkeypatch.setattr(containment, "materialize", note)
    result = queries.REGISTRY["containment_generic_tokens"](spark, "/root/testdata/sf0.001")
    assert result.count() > 0
    assert {"doc_id", "coarse"} not in written
    assert not any("row_bits" in line for p in plans for line in p.splitlines() if "Exchange" in line)
