"""Costly text expressions: even, bounded tasks and one pass per text."""

from pyspark.sql import functions as F

from lexisieve import session
from lexisieve.functions import descriptors as X
from lexisieve.functions import tokens as TK


def test_large_tables_are_dealt_to_bounded_tasks(spark, tmp_path, monkeypatch):
    """Also a table of several scan splits: there were as many tasks as splits."""
    path = str(tmp_path / "t")
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    size = session.plan_bytes(df)
    monkeypatch.setattr(session, "TEXT_BYTES", size // 40)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 4))  # the table is two splits or more
    try:
        dealt = session.spread(df, "id")
        assert dealt.rdd.getNumPartitions() >= 40
        assert dealt.count() == 4000 and dealt.select("id").distinct().count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_element_counts_equal_a_count_per_symbol_in_one_pass(spark):
    texts = ["CCClClC", "ClBrBrNaCSeSiLiKB", "c1ccccc1NnOoSsPpFI", "", None, "\nC\n\nC\n%12x", "ZZ\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").withColumn("t", TK.atom_tokens(F.col("s")))
    counts = X.element_counts(F.col("t"))
    for r in df.select("s", "t", counts.alias("c")).collect():
        want = [(s, r.t.count(s)) for s in X.ATOM_TOKENS if r.t and s in r.t]
        assert [(c.element, c.n) for c in r.c or []] == want
    passes = str(counts._jc.toString()) if hasattr(counts, "_jc") else ""
    assert passes.count("filter(t,") <= 1  # there was one per symbol


def test_rows_are_encoded_without_token_texts_in_the_join_of_rows(spark):
    rows = [(0, ["b", "a", "b", "?"]), (1, []), (2, None), (3, ["?", None, "a"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id long")
    out = TK.encode_by_join(df, "id", "tokens", vocab, {TK.BOS: 0, TK.EOS: 1, TK.PAD: 2, TK.UNK: 3})
    assert {r.id: r.ids for r in out.collect()} == {0: [0, 5, 4, 5, 3, 1], 1: [0, 1], 2: [0, 1], 3: [0, 3, 3, 4, 1]}

    def joins(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            yield from (c.schema().simpleString() for c in children)
        for c in children:
            yield from joins(c)

    inputs = list(joins(out._jdf.queryExecution().optimizedPlan()))
    assert inputs and not any("array<string>" in i for i in inputs)
