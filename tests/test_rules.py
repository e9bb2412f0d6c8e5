import pytest
from pyspark.sql import functions as F

from lexisieve.operators import rules


def test_every_named_rule_translates(spark):
    schema = "MW double, logP double, HBD int, HBA int, TPSA double, NRB int, MCF boolean, rings int"
    df = spark.createDataFrame([(300.0, 2.0, 1, 3, 90.0, 2, True, 3), (900.0, 2.0, 1, 3, 90.0, 2, False, 3)], schema)
    rows = rules.rule_profile(df.withColumn("id", F.monotonically_increasing_id()), rules.RULES, ["id"]).collect()
    passed = sorted(r.n_passed for r in rows)
    assert passed == [0, 5]


@pytest.mark.parametrize("bad", ["MW > 1; DROP", "f(MW) > 2", "MW + 1 > 2", "MW", "MW > 'a'"])
def test_other_expressions_are_refused(bad):
    with pytest.raises(ValueError):
        rules.rule_to_sql(bad)


def test_chained_and_alternative_comparisons(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "x int")
    assert [r.x for r in df.where(F.expr(rules.rule_to_sql("2<=x<=6 | x==9"))).collect()] == [5, 9]


def test_nan_null_and_borders(spark):
    df = spark.createDataFrame(
        [(1, float("nan")), (2, None), (3, 200.0), (4, 500.0), (5, 500.0004), (6, 500.0006), (7, 199.9)], "id int, MW double")
    kept = rules.rule_filter(df, "200<=MW & MW<=500", ["MW"])
    assert {r.id: r.MW for r in kept.collect()} == {3: 200.0, 4: 500.0, 5: 500.0}


def test_flag_filter_and_half_even(spark):
    df = spark.createDataFrame([(True, 0.125), (False, 0.1)], "ok boolean, x double")
    assert [r.x for r in rules.rounded(df.where("ok"), ["x"], 2).collect()] == [0.12]
    assert rules.rule_filter(df, "x>0", ["x"], flag="ok", required=["x"]).count() == 1


def test_drop_invalid_any_and_subset(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (2.0, None)], "x double, y string")
    assert rules.drop_invalid(df).count() == 1 and rules.drop_invalid(df, ["x"]).count() == 2


def test_read_rule_takes_the_first_line(spark, tmp_path):
    path = tmp_path / "rule.txt"
    path.write_text("  MW<=500 & MCF==True \nsecond")
    assert rules.read_rule(spark, str(path)) == "MW<=500 & MCF==True"


def test_relabel_stops_on_unknown_labels(spark):
    df = spark.createDataFrame([("Active",), ("Inactive",)], "l string")
    out = rules.relabel(F.col("l"), {"Active": 1, "Inactive": 0})
    assert [r[0] for r in df.select(out).collect()] == [1, 0]
    with pytest.raises(Exception, match="unknown label"):
        df.union(spark.createDataFrame([("Maybe",)], "l string")).select(out).collect()
    assert spark.range(1).select(rules.to_number(F.lit("x"))).first()[0] is None


def test_brackets_group(spark):
    df = spark.createDataFrame([(200.0, 9.0), (200.0, 1.0), (400.0, 1.0), (600.0, 4.0)], "MW double, logP double")
    kept = lambda rule: sorted((r.MW, r.logP) for r in df.where(F.expr(rules.rule_to_sql(rule))).collect())
    assert kept("(MW<300 | MW>500) & logP<5") == [(200.0, 1.0), (600.0, 4.0)]
    assert kept("((MW<300) | (MW>500)) & ~(logP<5)") == [(200.0, 9.0)]
    assert kept("not (MW<300 or logP>=4)") == [(400.0, 1.0)]
    for bad in ("(MW<300", "MW<300)", "MW<300 &", "& MW<300", "MW<300 logP<5", "()"):
        with pytest.raises(ValueError):
            rules.rule_to_sql(bad)


@pytest.mark.parametrize("seed", range(6))
def test_random_rules_agree_with_pandas(spark, seed):
    import random

    import pandas as pd

    pick = random.Random(seed)

    def rule(depth: int) -> str:
        if depth == 0 or pick.random() < 0.2:
            return f"({pick.choice('ab')} {pick.choice(['<', '<=', '>', '>=', '==', '!='])} {pick.randint(0, 5)})"
        text = f"({rule(depth - 1)} {pick.choice('&|')} {rule(depth - 1)})"
        return "~" + text if pick.random() < 0.3 else text

    frame = pd.DataFrame([(a, b) for a in range(6) for b in range(6)], columns=["a", "b"])
    df = spark.createDataFrame(frame)
    for text in [rule(3) for _ in range(5)]:
        want = sorted(map(tuple, frame.query(text).to_numpy().tolist()))
        assert sorted((r.a, r.b) for r in df.where(F.expr(rules.rule_to_sql(text))).collect()) == want


def test_rules_are_the_ones_written_down():
    import re
    from pathlib import Path

    text = (Path(__file__).parent.parent / "FIXTURES.md").read_text()
    assert dict(re.findall(r"^\| (\w+): `([^`]+)` \|", text, re.MULTILINE)) == rules.RULES
