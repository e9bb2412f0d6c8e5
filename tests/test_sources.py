import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisieve.plans import curate
from lexisieve.sources import files, readers, writers

SDF = """mol one
  made

  2  1  0
M  END
> <SMILES>
CC

> <NOTE> (1)
two
lines

$$$$
mol two
  made

  1  0  0
M  END
>  <SMILES>
O

>  <SMILES>
again

$$$$
"""


def test_csv_projection_defaults_and_gzip(spark, tmp_path):
    path = tmp_path / "lib.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write('extra,SMILES,ID\n1,CCO,a\n2,"C,C",b\n')
    rows = readers.read_items(spark, str(path)).orderBy("ID").collect()
    assert [tuple(r) for r in rows] == [("a", "CCO", 1.1), ("b", "C,C", 1.1)]
    supplied = tmp_path / "own.csv"
    supplied.write_text("ID,SMILES,plogP\na,C,2.5\n")
    assert readers.read_items(spark, str(supplied)).first().plogP == 2.5


def test_names_and_formats(spark, tmp_path):
    assert files.file_format("/x/a.ism.gz") == "smi" and files.base_name("/x/a.b.csv.gz") == "a.b"
    (tmp_path / "a.b.csv").write_text("ID\n1\n")
    row = files.with_file_identity(readers.read_delimited(spark, str(tmp_path / "a.b.csv"))).first()
    assert (row.file_name, row.file_format) == ("a.b", "csv")


def test_tab_separated_library(spark, tmp_path):
    path = tmp_path / "z.txt"
    path.write_text("zinc_id\tsmiles\tmwt\tlogp\textra\nZ1\tCC\t30.1\tbad\tx\n")
    row = readers.read_big_library(spark, str(path)).first()
    assert (row.ID, row.SMILES, row.MW, row.logP, row.plogP) == ("Z1", "CC", 30.1, None, 1.1)


def test_merge_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    (tmp_path / "b.csv").write_text("y;z\n3;4\n")
    (tmp_path / "c.csv").write_text("x;y\n5;6\n")
    out = readers.read_merged(spark, str(tmp_path / "*.csv"))
    assert sorted(out.columns) == ["x", "y", "z"]
    assert {(r.x, r.y, r.z) for r in out.collect()} == {("1", "2", None), (None, "3", "4"), ("5", "6", None)}
    with pytest.raises(FileNotFoundError):
        readers.read_merged(spark, str(tmp_path / "none*.csv"))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_structure_records(spark, tmp_path, end):
    path = tmp_path / "lib.sdf"
    path.write_bytes(SDF.replace("\n", end).encode())
    rows = readers.read_structures(spark, str(path), record_end="$$$$" + end).orderBy("ID").collect()
    assert [(r.ID, r.SMILES) for r in rows] == [("mol one", "CC"), ("mol two", "O")]
    assert rows[0]["items"]["NOTE"] == "two\nlines" and rows[0].counts.split() == ["2", "1", "0"]


def test_notation_lines(spark, tmp_path):
    path = tmp_path / "lib.smi"
    path.write_text("CCO mol 1\n\nC\tm2\nN\n")
    rows = [tuple(r) for r in readers.read_notation_lines(spark, str(path)).collect()]
    assert rows == [("mol 1", "CCO"), ("m2", "C"), (None, "N")]
    with pytest.raises(ValueError):
        readers.read_items(spark, "x.xlsx")


def test_saving_drops_helpers_and_keeps_outputs(spark, tmp_path):
    df = spark.range(10).select("id", F.array(F.col("id")).alias("tokens"), F.lit(" a\"b, ").alias("t"))
    path = str(tmp_path / "out")
    assert writers.save_once(df, path) and not writers.save_once(df, path)
    back = readers.read_delimited(spark, path)
    assert back.columns == ["id", "t"] and back.first().t == ' a"b, '
    writers.save_result(df.coalesce(1), str(tmp_path / "split"), "parquet", max_records=4)
    assert len(files.glob(spark, str(tmp_path / "split" / "*.parquet"))) == 3
    typed = readers.read_delimited(spark, path, schema=T.StructType([T.StructField("id", T.LongType())]))
    assert typed.agg(F.sum("id")).first()[0] == 45


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "hard"), (2, None)], "id int, dropped_at string")
    path = writers.save_snapshots(df, str(tmp_path / "stages"))
    assert {(r.id, r.dropped_at) for r in spark.read.parquet(path).collect()} == {(1, "hard"), (2, "kept")}


def test_curate_a_file_end_to_end(spark, tmp_path):
    path = tmp_path / "lib.csv"
    path.write_text("ID,SMILES\n3,CCO\n1,CCO\n2,CC.OOO\n4,C(C\n5,ClO\n6,C%12CC%12\n7,[13CH3]CC\n8,CC.N\n")
    out = curate.curate_file(spark, str(path), str(tmp_path))
    rows = {r.ID: r.SMILES for r in readers.read_delimited(spark, out).collect()}
    assert rows == {"1": "CCO", "2": "OOO", "7": "[CH3]CC", "8": "CC"}
    assert curate.curate_file(spark, str(path), str(tmp_path)) == out == curate.curate_file(spark, out, str(tmp_path))
    twice = curate.curate(spark.createDataFrame([("1", "CC.N"), ("2", "CC.O")], "ID string, SMILES string"), dedup_again=True)
    assert [tuple(r) for r in twice.collect()] == [("1", "CC")]


def test_big_library_flags(spark):
    df = spark.createDataFrame(
        [("a", "CCO", 1.1, True, True), ("b", "CCO", 1.1, False, True), ("c", "CCO", 1.1, True, None), ("d", "C.C", 1.1, True, True),
         ("e", "C(", 1.1, True, True)], "ID string, SMILES string, plogP double, ring boolean, mcf boolean")
    passed, failed = curate.clean_big_library(df, ring_flag="ring", allowed_flag="mcf")
    assert [r.ID for r in passed.collect()] == ["a"] and [r.ID for r in failed.collect()] == ["d"]


def test_curate_adds_missing_ids(spark, tmp_path):
    (tmp_path / "noid.csv").write_text("SMILES\nCCO\nCCN\n")
    out = curate.curate_file(spark, str(tmp_path / "noid.csv"), str(tmp_path))
    assert {r.ID for r in readers.read_delimited(spark, out).collect()} == {"0", "1"}


@pytest.mark.parametrize("escapes", [False, True])
def test_line_ends_and_quotes_survive_csv(spark, tmp_path, escapes):
    texts = ['a\nb "q", c', "x\\n\\\\y", 'tail "', "r\rs", None, "plain"]
    if not escapes:
        texts.remove("r\rs")
    df = spark.createDataFrame([(str(i), t, "z") for i, t in enumerate(texts)], "ID string, SMILES string, more string")
    path = writers.save_result(df, str(tmp_path / "t.csv"), "csv", line_escapes=escapes)
    back = readers.read_delimited(spark, path, line_escapes=escapes)
    assert [r.SMILES for r in back.orderBy("ID").collect()] == texts


def test_carriage_returns_at_line_ends(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes(b'ID,SMILES\r\n1,CC\r\n2,"C\nO"\r\n')
    rows = readers.read_delimited(spark, str(tmp_path / "w.csv")).collect()
    assert [(r.ID, r.SMILES) for r in rows] == [("1", "CC"), ("2", "C\nO")]


def test_structures_with_any_line_end(spark, tmp_path):
    record = "{}\n  made\n\n  1  0\nM  END\n> <SMILES>\n{}\n\n$$$$\n"
    text = record.format("a", "CC").replace("\n", "\r\n") + record.format("b", "CO") + record.format("c", "CN").replace("\n", "\r\n")
    (tmp_path / "m.sdf").write_bytes(text.encode())
    rows = readers.read_structures(spark, str(tmp_path / "m.sdf")).orderBy("ID").collect()
    assert [(r.ID, r.SMILES, r.counts.strip()) for r in rows] == [("a", "CC", "1  0"), ("b", "CO", "1  0"), ("c", "CN", "1  0")]


def test_unfinished_output_is_redone(spark, tmp_path):
    (tmp_path / "out" / "_temporary").mkdir(parents=True)
    df = spark.createDataFrame([("1", "CC")], "ID string, SMILES string")
    assert writers.save_once(df, str(tmp_path / "out"))
    assert not writers.save_once(df, str(tmp_path / "out"))
    assert readers.read_delimited(spark, str(tmp_path / "out")).count() == 1


def test_curated_anew_when_the_input_changes(spark, tmp_path):
    raw, out = str(tmp_path / "lib.csv"), str(tmp_path / "out")

    def put(rows):
        spark.createDataFrame(rows, "ID string, SMILES string").coalesce(1).write.mode("overwrite").option("header", True).csv(raw)

    def read(path):
        return sorted(r.SMILES for r in spark.read.option("header", True).csv(path).collect())

    put([("1", "CCO"), ("2", "CCN")])
    path = curate.curate_file(spark, raw, out)
    assert read(path) == ["CCN", "CCO"]
    facts = files.read_text(spark, f"{path}/_INPUTS")
    assert curate.curate_file(spark, raw, out) == path and files.read_text(spark, f"{path}/_INPUTS") == facts
    put([("1", "CCO"), ("2", "CCF")])
    assert read(curate.curate_file(spark, raw, out)) == ["CCF", "CCO"]
    assert files.read_text(spark, f"{path}/_INPUTS") != facts and files.read_text(spark, f"{path}/none") is None
