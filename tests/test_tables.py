"""Sources, sinks, validation, cleaning, de-duplication."""

import gzip

import pytest
from pyspark.sql import functions as F

from assayer.functions import molecules
from assayer.operators import dedup, validate
from assayer.sources import readers, sinks

VALID = ["CCO", "CC(=O)O", "c1ccccc1", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "[Na+].[Cl-]", "C%12CC%12", "*C", "C/C=C\\C"]
INVALID = ["invalid_smiles", "invalid1", "abc123", "123456", "C@#$%^&*()", "", "  ", "C1CCC", "C(C", "CC O", None]


def strings(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, smiles string")


def test_valid_and_invalid(spark):
    rows = validate.validate_structures(strings(spark, VALID + INVALID)).orderBy("row_id").collect()
    assert [r["valid"] for r in rows] == [True] * len(VALID) + [False] * len(INVALID)
    assert all((r["canonical_smiles"] is None) != r["valid"] for r in rows)
    reasons = {r["smiles"]: r["reject_reason"] for r in rows}
    assert reasons["C1CCC"] == "ring" and reasons["C(C"] == "parentheses" and reasons["123456"] == "no_atom"
    assert reasons[None] == reasons["  "] == "empty" and reasons["CC O"] == "token"


def test_very_long_strings(spark):
    df = strings(spark, ["C" * 300_000, "C" * 300_000 + "?", "word " * 60_000])
    assert [r["valid"] for r in validate.validate_structures(df).orderBy("row_id").collect()] == [True, False, False]


def test_edge_cases(spark):
    empty = strings(spark, [])
    assert validate.validate_structures(empty).count() == 0
    other = validate.validate_structures(spark.range(3))
    assert other.filter("valid").isEmpty() and other.filter("canonical_smiles IS NOT NULL").isEmpty()
    assert not validate.has_format(empty) and validate.has_format(strings(spark, ["C"]), ["smiles"])
    assert not validate.has_format(strings(spark, ["C"]), ["smiles", "name"])
    assert validate.clean_key_counts(empty, "smiles").first().asDict() == {"total": 0, "blank_removed": 0, "duplicates_removed": 0}


def test_request_characters(spark):
    rows = strings(spark, ["CCO", "C C", "", None, "C~C"]).select(molecules.allowed_characters(F.col("smiles")).alias("ok"), "row_id")
    assert [r["ok"] for r in rows.orderBy("row_id").collect()] == [True, False, False, False, False]


def test_main_fragment(spark):
    df = validate.standardise_structures(strings(spark, ["CC.CCC.O", "AA.BB", "C.N", "bad one", None]))
    assert [r[2] for r in df.orderBy("row_id").collect()] == ["CCC", "AA.BB", "C", "bad one", None]


def test_lists(spark):
    df = spark.createDataFrame([(0, " a"), (1, "b"), (2, "a"), (3, " a"), (4, "b ")], "p long, v string")
    assert [tuple(r) for r in validate.normalise_list(df, "v", "p").orderBy("position").collect()] == [(0, "a"), (1, "b"), (2, "a"), (4, "b")]
    assert [r["value"] for r in validate.normalise_list(df, "v", "p", trim_first=True).orderBy("position").collect()] == ["a", "b"]
    text = spark.createDataFrame([(1, "x \r\n\n  y\n ")], "i long, t string")
    assert [r["line"] for r in validate.split_lines(text, "t", "i").orderBy("line_no").collect()] == ["x", "y"]


def test_keep_one(spark):
    rows = [(i, None if i % 6 == 0 else f"k{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, k string").repartition(5)
    keys = {k for _, k in rows}
    for method, pick in (("first", min), ("last", max)):
        kept = {r["k"]: r["row_id"] for r in dedup.keep_one(df, "k", "row_id", method).collect()}
        assert kept == {k: pick(i for i, x in rows if x == k) for k in keys}
    assert dedup.keep_one(df, "k", "row_id", null_keys="keep").count() == len(keys) - 1 + 10
    one, two = (dedup.keep_one(df.repartition(n), "k", "row_id", "random").orderBy("row_id").collect() for n in (2, 9))
    assert one == two and len(one) == len(keys)
    with pytest.raises(ValueError):
        dedup.keep_one(df, "k", "row_id", "newest")


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    plan = dedup.keep_one(df, "k", "row_id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_attach_hot_keys(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 700).cast("string")).alias("content_key"))
    features = df.select("content_key").distinct().withColumn("x", F.length("content_key"))
    for share in (1e-3, 0.2, 1.0):
        joined = dedup.attach(df, features, hot_share=share)
        assert joined.count() == 3000 and joined.filter(F.col("x") != F.length("content_key")).isEmpty()


def test_feature_table_computes_only_new_content(spark, tmp_path):
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("x", F.length("smiles")).select("content_key", "smiles", "x")

    first = strings(spark, ["C", "CC", "C"])
    table = str(tmp_path / "features")
    assert dedup.refresh_features(first, ["smiles"], table, compute).count() == 3
    second = strings(spark, ["CC", "CCC", "CCC", "C"])
    out = dedup.refresh_features(second, ["smiles"], table, compute)
    assert sorted((r["smiles"], r["x"]) for r in out.collect()) == [("C", 1), ("CC", 2), ("CCC", 3), ("CCC", 3)]
    assert calls == [2, 1]


# --- files ------------------------------------------------------------------------

LINES = [("CCO", "ethanol", 1), ("CC(=O)O", "acetic acid", 0), ("c1ccccc1", "benzene", 1), ("CCN", "ethylamine", 0)]


@pytest.fixture
def files(tmp_path):
    (tmp_path / "four.csv").write_text("smiles,name,activity\n" + "".join(f'{s},"{n}",{a}\n' for s, n, a in LINES))
    (tmp_path / "two.smi").write_text("CCO\tm1\nCCN\tm2\n")
    (tmp_path / "tab.txt").write_text("smiles\tweight\nCCO\t46.07\n")
    (tmp_path / "other.xyz").write_text("CCO")
    (tmp_path / "nokey.csv").write_text("a,b\n1,2\n")
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as handle:
        handle.write("smiles,v\nCCO,1\nCCN,2\nCCC,3\n")
    record = "{0}\n  prog\n\n  1  0\nM  END\n> <NAME>\n{0} name\n\n>  <MW>  (2)\n{1}\n\n"
    (tmp_path / "two.sdf").write_text(record.format("first", 1.5) + "$$$$\n" + record.format("second", 2.5) + "> <EXTRA>\nyes\n\n$$$$\n")
    (tmp_path / "dos.sdf").write_bytes((record.format("one", 3) * 1 + "$$$$\n" + record.format("two", 4).replace("4\n", "4\n5\n") + "$$$$\n").replace("\n", "\r\n").encode())
    return tmp_path


def test_csv(spark, files):
    df = readers.read_csv(spark, str(files / "four.csv"))
    assert sorted((r["smiles"], r["name"], r["activity"]) for r in df.collect()) == sorted(LINES)
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(files / "nokey.csv"))
    packed = readers.read_csv(spark, str(files / "packed.csv.gz"), max_records=2)
    assert packed.count() == 2


def test_delimited(spark, files):
    smi = readers.read_delimited(spark, str(files / "two.smi"))
    assert smi.columns == ["smiles", "id"] and smi.count() == 2
    assert readers.read_delimited(spark, str(files / "tab.txt")).first()["weight"] == 46.07


def test_sdf(spark, files):
    rows = {r["title"]: r for r in readers.read_sdf(spark, str(files / "two.sdf"), ["NAME", "MW", "EXTRA"]).collect()}
    props = {r["title"]: r["props"] for r in readers.read_sdf(spark, str(files / "two.sdf")).collect()}
    assert set(props) == {"first", "second"} and props["second"]["EXTRA"] == "yes" and "EXTRA" not in props["first"]
    assert set(rows) == {"first", "second"}
    assert rows["first"]["NAME"] == "first name" and rows["second"]["MW"] == "2.5"
    assert rows["first"]["EXTRA"] is None and rows["second"]["EXTRA"] == "yes"
    assert rows["first"]["molblock"].endswith("M  END")
    dos = {r["title"]: r["MW"] for r in readers.read_sdf(spark, str(files / "dos.sdf"), ["MW"]).collect()}
    assert dos == {"one": "3", "two": "4\n5"}
    blank = "\n  prog\n\n  0  0 V2000\nM  END\n> <K>\nv\n\n"
    (files / "blank.sdf").write_text(blank + "$$$$\n" + blank + "$$$$\n")
    assert [(r["title"], r["K"]) for r in readers.read_sdf(spark, str(files / "blank.sdf"), ["K"]).collect()] == [("", "v")] * 2


def test_dispatch_by_suffix(spark, files):
    for name, n in (("four.csv", 4), ("two.smi", 2), ("tab.txt", 1), ("two.sdf", 2), ("packed.csv.gz", 3)):
        assert readers.read_table(spark, str(files / name)).count() == n
    with pytest.raises(ValueError):
        readers.read_table(spark, str(files / "other.xyz"))


def test_many_files(spark, files):
    (files / "more.csv").write_text("smiles,name,activity\nCCC,propane,1\n")
    paths = [str(files / n) for n in ("four.csv", "more.csv", "two.smi", "other.xyz", "gone.csv", "nokey.csv")]
    loaded = readers.read_many(spark, paths)
    assert (loaded.total_files, loaded.successful_loads, loaded.failed_loads) == (6, 3, 3)
    assert loaded.data.count() == 7 and len(loaded.errors) == 3
    counts = {r["source_file"].rsplit("/", 1)[1]: r["records"] for r in loaded.file_counts().collect()}
    assert counts == {"four.csv": 4, "more.csv": 1, "two.smi": 2}
    assert readers.read_many(spark, [str(files / "gone.csv")]).data is None


def test_file_info(spark, files):
    info = readers.file_info(spark, str(files / "four.csv")).first()
    assert info["file_name"] == "four.csv" and info["supported"] and info["columns"] == ["smiles", "name", "activity"]
    assert info["sample_records"] == 4 and info["file_size"] == (files / "four.csv").stat().st_size
    assert not readers.file_info(spark, str(files / "other.xyz")).first()["supported"]


def test_sinks(spark, tmp_path):
    df = strings(spark, ["C", "N", "O", None]).withColumn("split", F.when(F.col("row_id") < 2, "train").otherwise("test"))
    for kind in ("csv", "parquet", "json", "orc"):
        path = sinks.write_table(df, str(tmp_path / f"out.{kind}"))
        back = spark.read.option("header", True).format(kind).load(path)
        assert back.count() == 4 and "smiles" in back.columns
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "out.xyz"))
    paths = sinks.write_splits(df, str(tmp_path), prefix="a_")
    assert spark.read.parquet(paths["train"]).count() == 2 and "a_splits" in paths["test"]
    text = sinks.write_report(df, str(tmp_path / "report"), "line 1\nline 2")
    assert [r["value"] for r in spark.read.text(text).collect()] == ["line 1", "line 2"]
    assert spark.read.json(sinks.write_report(df, str(tmp_path / "metrics"))).count() == 4
    assert "\"a\": 1" in spark.read.text(sinks.write_result(spark, {"a": 1}, str(tmp_path / "r")), wholetext=True).first()[0]


def test_content_appended_twice_counts_once(spark, tmp_path):
    """Two runs at once append the same content; later runs still give a row per input row."""
    table = str(tmp_path / "features")
    df = spark.createDataFrame([("CCO", 1), ("CCN", 2), ("CCO", 3)], "smiles string, id long")
    compute = lambda content: content.withColumn("size", F.length("smiles"))
    assert dedup.refresh_features(df, ["smiles"], table, compute).count() == 3
    again = spark.createDataFrame(spark.read.parquet(table).collect(), spark.read.parquet(table).schema)
    again.write.mode("append").parquet(table)
    out = dedup.refresh_features(df, ["smiles"], table, compute)
    assert sorted((r["id"], r["size"]) for r in out.collect()) == [(1, 3), (2, 3), (3, 3)]
