import pytest
from pyspark.sql import functions as F

from assayer.config import Settings
from assayer.plans.prepare import prepare

SIX = "smiles,name,activity,ic50\nCCO,a,1,10\nCC(=O)O,b,0,20\nc1ccccc1,c,1,30\nCCN,d,0,40\nCCCC,e,1,50\nCC(C)O,f,0,60\n"


def test_six_rows(spark, tmp_path):
    (tmp_path / "six.csv").write_text(SIX)
    done = prepare(spark, str(tmp_path / "six.csv"), str(tmp_path / "out"), Settings(ranges={}))
    assert done.table.count() == 6 and {"fingerprint", "standardized_smiles", "split"} <= set(done.table.columns)
    stored = [spark.read.parquet(done.paths[p]).count() for p in ("train", "val", "test")]
    assert stored == [4, 1, 1]
    text = "\n".join(r["value"] for r in spark.read.text(done.paths["report"]).collect())
    assert "Total records: 6" in text


def hundred(spark):
    """100 rows, 94 structures: six appear twice."""
    names = [("C" * (i % 94 + 1) + "O", float(i)) for i in range(100)]
    return spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(names)], "row_id long, smiles string, value double")


def test_as_many_rows_leave_as_enter(spark):
    done = prepare(spark, hundred(spark), settings=Settings(ranges={}))
    sizes = {r["split"]: r["split_size"] for r in done.statistics.collect()}
    assert sizes == {"train": 65, "val": 14, "test": 15}
    assert done.table.select("row_id").distinct().count() == done.table.count() == 94
    assert done.table.filter("smiles <> canonical_smiles").isEmpty()
    kept = done.retention.first()
    assert (kept["original_count"], kept["processed_count"]) == (100, 94)


def test_filters_run_after_features(spark):
    ranges = {"n_tokens": {"max": 20}, "tpsa": {"max": 140}}
    done = prepare(spark, hundred(spark), settings=Settings(ranges=ranges, split_method="temporal", date_column="value"))
    assert done.table.agg(F.max("n_tokens")).first()[0] == 20 and done.skipped_ranges == ["tpsa"]


def test_settings_from_nested_layout(tmp_path):
    yaml = pytest.importorskip("yaml")
    raw = {
        "preprocessing": {"quality_filters": {"hbd": {"max": 4}}, "deduplication": {"keep": "last"}, "standardization": {"remove_salts": False}},
        "feature_extraction": {"fingerprints": {"morgan": {"n_bits": 512, "radius": 1}}},
        "data_splitting": {"random": {"train_ratio": 0.6, "val_ratio": 0.2, "test_ratio": 0.2}},
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(raw))
    s = Settings.from_yaml(str(tmp_path / "c.yaml"))
    assert (s.keep, s.remove_salts, s.n_bits, s.radius, s.train_ratio, s.ranges) == ("last", False, 512, 1, 0.6, {"hbd": {"max": 4}})


def test_empty_and_all_invalid(spark):
    done = prepare(spark, spark.createDataFrame([(1, "xx1"), (2, None)], "row_id long, smiles string"), settings=Settings(ranges={}))
    assert done.table.count() == 0
    with pytest.raises(Exception):
        prepare(spark, "/nowhere/missing.csv")
