import re

from pyspark.sql import functions as F

from lexisieve.functions import descriptors as X
from lexisieve.functions import fingerprint as FP
from lexisieve.functions import tokens as TK
from lexisieve.operators import cleaning

PROBES = ["C1=C(C=NN2)C2=CC(Br)=C1", "Cl%12[Na+].C0", "CC(C)CN1CCCC(NC(=O)c2cccc(C)c2)CCSCCC1", "a\rb\nc%1%%22", "", "é€x"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string")


def test_tokens_equal_the_split_of_the_pattern(spark):
    pattern = re.compile("(Cl|Br|Na|Si|Li|Se|%[0-9][0-9]|.)")
    got = frame(spark, PROBES).select("s", TK.atom_tokens(F.col("s")).alias("t")).collect()
    for row in got:
        assert row.t == pattern.split(row.s)[1::2]


def test_token_filter_outputs(spark):
    df = frame(spark, ["CCO", "Cl%12[Na+].C0", None, "C" * 300]).withColumnsRenamed({"id": "ID", "s": "SMILES"}).withColumn(
        "plogP", F.lit(1.1))
    passed, failed, count = cleaning.token_filter(df, "SMILES")
    assert sorted(r.ID for r in passed.collect()) == [0, 3]
    assert failed.columns == ["ID", "SMILES", "plogP"] and sorted(r.ID for r in failed.collect()) == [1, 2]
    assert count.first().n_fail == 2


def test_encode_cuts_pads_and_decodes(spark):
    df = frame(spark, ["CCO", "C" * 60]).select("id", "s", TK.atom_tokens(F.col("s")).alias("t"))
    rows = df.select("id", "s", TK.encode(F.col("t"), 10).alias("e"), TK.encoded_length(F.col("t"), 10).alias("n"),
                     TK.decode(TK.encode(F.col("t"), 100)).alias("back")).orderBy("id").collect()
    assert rows[0].e == [1, 23, 23, 9, 2, 2, 2, 2, 2, 2] and rows[0].n == 4
    assert rows[1].e == [1] + [23] * 8 + [2] and rows[1].n == 9
    assert all(r.back == r.s for r in rows)


def test_learned_vocabulary_round_trip(spark):
    vocab = TK.vocabulary_map({"C": 0, "O": 1})
    names = TK.vocabulary_map({0: "C", 1: "O"})
    df = frame(spark, ["COX"]).select(TK.atom_tokens(F.col("s")).alias("t")).select(
        TK.encode_with_vocab(F.col("t"), vocab, F.lit(5), F.lit(2), F.lit(3)).alias("e"))
    row = df.select("e", TK.decode_with_vocab(F.col("e"), names, F.lit(2), F.lit(3)).alias("d")).first()
    assert row.e == [2, 0, 1, 5, 3] and row.d == "CO<unk>"


def test_validity_reasons(spark):
    cases = {"CC(=O)O": None, "C(C": "parenthesis", "C)C(": "parenthesis", "C[N": "bracket", "C1CC": "open ring", "": "empty",
             None: "missing", "C%12CC%12": None, "C1CC1C[13CH3]": None, "CX": "unknown token"}
    df = cleaning.add_validity(cleaning.add_tokens(frame(spark, list(cases)), "s"), "s")
    got = {r.s: (r.valid, r.invalid_reason) for r in df.collect()}
    assert got == {s: (why is None, why) for s, why in cases.items()}
    assert {r.s for r in cleaning.keep_valid(frame(spark, list(cases)), "s").collect()} == {
        s for s, why in cases.items() if why is None}


def test_normalisation(spark):
    cases = {"[13CH3]CO": None, "[13CH3]CCO": "[CH3]CCO", "CC.OO.N": "CC", "ClO": None, "ClCl": "ClCl", "CO.CCC.cc": "CCC", None: None}
    got = {r.s: r.x for r in frame(spark, list(cases)).withColumn("x", X.normalize(F.col("s"))).collect()}
    assert got["[13CH3]CO"] == "[CH3]CO"
    cases.pop("[13CH3]CO"), got.pop("[13CH3]CO")
    assert got == cases


def test_descriptors(spark):
    df = cleaning.add_tokens(frame(spark, ["CC(=O)Nc1ccc(C(C)C)cc1[Na+]"]), "s")
    row = df.select(*[c.alias(n) for n, c in X.token_descriptors(F.col("s"), F.col("tokens")).items()]).first().asDict()
    assert row["n_rings"] == 1 and row["branch_depth"] == 2 and row["n_hetero"] == 3 and row["n_carbon"] == 11
    generic = df.select(X.generic_tokens(F.col("tokens")).alias("g")).first().g
    assert "".join(generic) == "CC(C)CC1CCC(C(C)C)CC1[C+]"


def test_fingerprint_similarity(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([1, 2, 3], [2, 3, 4]), ([4, 5], [2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(FP.tanimoto(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.25, 0.0]


def test_on_bits_follow_the_md5_rule(spark):
    import hashlib

    text = "CC(=O)Nc1ccccc1"
    df = frame(spark, [text, "CC"]).select("s", TK.atom_tokens(F.col("s")).alias("t"))
    rows = df.select(FP.on_bits(F.col("t"), 4, 64).alias("b"), FP.gram_set(F.col("t"), 3).alias("g")).collect()
    want = sorted({int(hashlib.md5(text[i:i + 4].encode()).hexdigest()[:7], 16) % 64 for i in range(len(text) - 3)})
    assert rows[0].b == want and rows[1].b == [] and rows[1].g == []
    assert len(rows[0].g) == len({text[i:i + 3] for i in range(len(text) - 2)})


def test_sparse_vector_and_fold(spark):
    df = spark.createDataFrame([(1, [0, 3, 70])], "id int, bits array<int>")
    folded = df.withColumn("f", FP.fold(F.col("bits"), 64))
    assert folded.first().f == [0, 3, 6]
    vector = FP.add_sparse_vector(folded, "f", 64).first().features
    assert list(vector.indices) == [0, 3, 6] and list(vector.values) == [1.0] * 3 and vector.size == 64


def test_penalised_score(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (None, True)], "v boolean, m boolean")
    score = X.penalized_score(F.lit(3.0), F.lit(1.0), F.lit(1), F.col("v"), F.col("m"))
    assert [r[0] for r in df.select(score).collect()] == [1.0, -5.0, -5.0, -5.0]
