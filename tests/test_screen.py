from lexisieve.plans import screen


def test_stages_in_order(spark):
    schema = "ID string, MW double, bits array<int>, scaf array<int>, gen array<int>"
    base = list(range(20))
    df = spark.createDataFrame([
        ("rule", 900.0, base, [1], [1]), ("nan", float("nan"), base, [1], [1]), ("border", 500.0004, [90, 91], [3], [3]),
        ("same", 300.0, base, [1], [1]), ("near", 300.0, base + [77], [1], [1]),
        ("atom", 300.0, [50, 51], [7, 8, 9], [1]), ("graph", 300.0, [60, 61], [1], [4, 5, 6]),
        ("kept", 300.0, [], [7], [4])], schema)
    known = spark.createDataFrame([("k", base), ("e", [])], "ID string, bits array<int>")
    frags = spark.createDataFrame([([7, 8], [5, 6]), ([], [])], "scaf array<int>, gen array<int>")
    tagged = screen.tag_cascade(df, known, frags, "200<=MW & MW<=500", "ID", "bits", "scaf", "gen",
                                round_columns=["MW"], required=["MW"])
    got = {r.ID: r.dropped_at for r in tagged.collect()}
    assert got == {"rule": "property", "nan": "property", "border": None, "same": "hard", "near": "soft",
                   "atom": "atom", "graph": "graph", "kept": None}
    assert {r.ID for r in screen.rows_after(tagged).collect()} == {"border", "atom", "graph", "kept"}
    assert {r.ID for r in screen.rows_after(tagged, "graph").collect()} == {"border", "kept"}
    rows = {r.stage: (r.n_dropped, r.n_remaining) for r in screen.funnel(tagged).collect()}
    assert rows == {"property": (2, 6), "hard": (1, 5), "soft": (1, 4), "atom": (1, 3), "graph": (1, 2)}


def test_sets_are_not_written_again(spark, monkeypatch):
    written = []
    write = screen.materialize
    monkeypatch.setattr(screen, "materialize", lambda df, *by: (written.append(df.columns), write(df, *by))[1])
    df = spark.createDataFrame([(1, 300.0, [1, 2], [1], [1]), (2, 900.0, [3], [1], [1])],
                               "ID int, MW double, bits array<int>, scaf array<int>, gen array<int>")
    known = spark.createDataFrame([(9, [1, 2])], "ID int, bits array<int>")
    frags = spark.createDataFrame([([7], [5])], "scaf array<int>, gen array<int>")
    tagged = screen.tag_cascade(df, known, frags, "200<=MW & MW<=500", "ID", "bits", "scaf", "gen")
    assert {r.ID: r.dropped_at for r in tagged.collect()} == {1: "hard", 2: "property"}
    assert written and not any({"bits", "scaf", "gen"} & set(columns) for columns in written)
