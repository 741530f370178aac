"""Rules, features, quality profile, activity data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions import molecules
from assayer.operators import activity, dedup, features, ordering, quality, rules, validate


def test_formula_weights(spark):
    known = {"C9H8O4": (180.16, 13), "C2H6O": (46.07, 3), "C8H10N4O2": (194.19, 14), "C6H5O-": (93.10, 7), "C10H16N+": (150.24, 11), "H2O": (18.015, 1)}
    bad = ["C2Xx3", "", "C2(H5)", "c6h6", None, "[Na]"]
    df = spark.createDataFrame([(f,) for f in [*known, *bad]], "molecular_formula string")
    found = {r[0]: (r[1], r[2]) for r in features.with_formula_features(df).collect()}
    for formula, (weight, heavy) in known.items():
        assert found[formula][0] == pytest.approx(weight, abs=0.01) and found[formula][1] == heavy
    assert all(found[f] == (None, None) for f in bad)
    assert len(molecules.ATOMIC_MASS) == 118


def test_token_weight(spark):
    df = spark.createDataFrame([("CN=O",), (None,)], "smiles string")
    rows = features.with_token_counts(df, "smiles").collect()
    assert rows[0]["token_weight"] == 20 + 20 + 12 and rows[1]["token_weight"] == 20


def test_fingerprint_properties(spark):
    df = spark.createDataFrame([("CCO",), ("OCC",), ("CCO",), ("",), (None,), ("C",)], "smiles string")
    bits = [r["fingerprint"] for r in features.with_fingerprint(df, "smiles").collect()]
    assert bits[0] == bits[2] and bits[0] != bits[1] and bits[3] == bits[4] == [] and len(bits[5]) == 1
    assert bits[0] == sorted(set(bits[0])) and all(0 <= b < 2048 for b in bits[0])
    text = df.select(features.bit_string(F.array(F.lit(1), F.lit(3)), 5).alias("b")).first()["b"]
    assert text == "01010"
    one = features.with_fingerprint(df, "smiles", radius=0).first()["fingerprint"]
    assert len(one) == 2 and set(one) <= set(bits[0])


def test_failing_descriptor_gives_null(spark):
    df = spark.createDataFrame([("4",), ("x",), (None,)], "smiles string")
    half = features.python_descriptor(lambda s: int(s) / 2)
    rows = features.with_descriptors(df, "smiles", [("half", half), ("n", F.length("smiles"))]).collect()
    assert [r["half"] for r in rows] == [2.0, None, None] and [r["n"] for r in rows] == [1, 1, None]


def test_standardise_and_correlation(spark):
    rng = np.random.default_rng(0)
    table = pd.DataFrame(rng.normal(size=(200, 6)), columns=list("abcdef"))
    table.loc[::7, "a"] = np.nan
    table["f"] = 2.5
    df = spark.createDataFrame(table).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in table])
    for names in (list("abc"), list("abcdef")):  # both forms of the aggregate
        found = {(r["column_a"], r["column_b"]): r["corr"] for r in features.correlations(df, names).collect()}
        expected = table[names].corr()
        assert len(found) == len(names) ** 2
        for (x, y), r in found.items():
            e = expected.loc[x, y]
            assert (r is None) if math.isnan(e) else r == pytest.approx(e, abs=1e-9)
    scaled = features.standardise(df, ["a", "f"]).toPandas()
    filled = table["a"].fillna(0)
    assert np.allclose(scaled["a_std"], (filled - filled.mean()) / filled.std(ddof=0)) and (scaled["f_std"] == 0).all()
    with pytest.raises(ValueError):
        features.correlations(df, ["a"])


def test_importance_and_histogram(spark):
    rows = [(i, float(i % 10), float((i * 7919) % 13), 1.0, float(i % 10) * 2) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, num_a double, num_b double, num_c double, y double")
    found = [(r["feature"], r["importance"]) for r in features.feature_importance(df, "y").collect()]
    assert found[0][0] == "num_a" and found[0][1] == pytest.approx(math.log(10)) and dict(found)["num_c"] == 0
    assert features.feature_importance(df, "missing").isEmpty()
    bins = features.histogram(df, "num_a", 5).orderBy("bin").collect()
    assert [b["row_count"] for b in bins] == np.histogram([r[1] for r in rows], 5)[0].tolist()
    flat = features.histogram(df, "num_c", 4).collect()
    assert sum(b["row_count"] for b in flat) == 500


def test_range_rules(spark):
    df = spark.createDataFrame([(1, 100.0, 6), (2, 300.0, 2), (3, None, 1), (4, 500.0, 5)], "row_id long, mw double, hbd int")
    kept = rules.within_ranges(df, {"molecular_weight": {"min": 150, "max": 500}, "num_hbd": {"max": 5}})
    assert [r["row_id"] for r in kept.orderBy("row_id").collect()] == [2, 4]
    with pytest.warns(UserWarning):
        assert rules.within_ranges(df, {"tpsa": {"max": 1}}).count() == 4
    lost = {r["rule"]: r["row_count"] for r in rules.attrition(df, {"molecular_weight": {"min": 150}, "num_hbd": {"max": 1}}).collect()}
    assert lost == {"molecular_weight_min": 2, "num_hbd_max": 2, "kept": 0}
    judged = rules.rule_violations(df).orderBy("row_id").collect()
    assert [r["violations"] for r in judged] == [1, 0, 0, 0] and all(r["rule_pass"] for r in judged)


def test_pages(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WINDOW", 20)
    df = spark.range(105).select((F.col("id") * 3).alias("k")).repartition(4)
    seen = []
    for number in range(1, 8):
        rows = rules.page(df, "k", number, 20).collect()
        seen += [r["k"] for r in rows]
        assert all(r["total_items"] == 105 and r["total_pages"] == 6 and r["has_next"] == (number < 6) for r in rows)
    assert seen == [3 * i for i in range(105)]
    text = df.select(F.concat(F.lit("compound-"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("k"))
    assert [r["k"] for n in (2, 6) for r in rules.page(text, "k", n, 20).collect()] == [f"compound-{3 * i:04d}" for i in [*range(20, 40), *range(100, 105)]]
    assert rules.page(text, "k", 9, 20).isEmpty()
    with pytest.raises(ValueError):
        rules.page(df, "k", 0)
    holed = df.select(F.when(F.col("k") != 30, F.col("k")).alias("k"))
    pages = [[r["k"] for r in rules.page(holed, "k", number, 20).collect()] for number in range(1, 7)]
    assert sum(pages, []) == [None] + [3 * i for i in range(105) if i != 10]


@pytest.fixture
def quality7(spark):
    rows = [
        ("CCO", 1.0, 10.0, 46.0), ("CC(=O)O", 2.0, None, 60.0), ("invalid_smiles", None, 20.0, 70.0), ("CCO", 1.5, 12.0, 46.0),
        (None, 3.0, 15.0, None), ("c1ccccc1", 2.5, 900.0, 78.0), ("CCN", 1.8, 11.0, 45.0),
    ]
    return spark.createDataFrame(rows, "smiles string, activity double, ic50 double, molecular_weight double")


def test_profile(quality7):
    facts = {(r["section"], r["column_name"], r["metric"]): r["value"] for r in quality.profile(quality7).collect()}
    assert facts[("dataset", None, "records")] == 7 and facts[("missing", "smiles", "missing_count")] == 1
    assert facts[("keys", "smiles", "valid_keys")] == 5 and facts[("keys", "smiles", "invalid_keys")] == 1
    assert facts[("duplicates", "smiles", "duplicate_keys")] == 1 and facts[("duplicates", "smiles", "duplicate_rows")] == 0
    assert facts[("outliers", "ic50", "outlier_count")] == 1
    missing = 100 * (1 / 7 + 1 / 7 + 1 / 7 + 1 / 7) / 4
    assert facts[("score", None, "quality_score")] == pytest.approx(100 - 0.5 * missing - 0.3 * (100 - 500 / 6))


def test_score_of_the_logged_shape(spark):
    """100 rows, 11 columns, one of them a quarter empty, all keys valid: 98.9."""
    df = spark.range(100).select(
        F.lit("CCO").alias("smiles"), F.when(F.col("id") % 4 > 0, 1.0).alias("p"), *[F.lit(1).alias(f"c{i}") for i in range(9)]
    )
    assert round(quality.quality_score(df, "smiles").first()["quality_score"], 1) == 98.9


def test_report(quality7):
    text = quality.report(quality7)
    sections = [line for line in text.split("\n") if line.startswith("[")]
    assert sections[-2:] == ["[types]", "[advice]"] and len(sections) == len(set(sections))
    assert "records = 7" in text and "Remove 1 invalid SMILES" in text and "Remove 1 duplicate SMILES" in text


def test_quartiles_match_pandas(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WINDOW", 25)
    monkeypatch.setattr(ordering, "ACCURACY", 60)
    rng = np.random.default_rng(5)
    table = pd.DataFrame({"a": rng.lognormal(size=1501), "b": rng.integers(0, 4, 1501).astype(float), "c": rng.integers(0, 10**9, 1501)})
    table.loc[::5, "a"] = np.nan
    found = quality.quartiles(spark.createDataFrame(table).repartition(5), ["a", "b", "c"])
    for c in table:
        assert found[c] == pytest.approx(tuple(table[c].quantile([0.25, 0.75])))
    rough = quality.quartiles(spark.createDataFrame(table), ["c"], approximate=True)["c"]
    assert rough == pytest.approx(tuple(table["c"].quantile([0.25, 0.75])), rel=0.05)


def test_activity_values(spark):
    rows = [(1.0, "nM"), (1.0, "uM"), (10.0, "uM"), (2.0, "mM"), (5.0, "mg"), (0.0, "nM"), (None, "nM")]
    out = activity.with_activity(spark.createDataFrame(rows, "value double, units string")).collect()
    assert [r["value_nm"] for r in out] == [1.0, 1000.0, 10000.0, 2e6, None, 0.0, None]
    assert [r["activity_class"] for r in out] == ["active", "active", "inactive", "inactive", None, "active", None]
    assert out[1]["potency"] == pytest.approx(6.0) and out[5]["potency"] is None


def test_assay_summary(spark):
    df = spark.createDataFrame([("C", 1, 0, None), ("N", None, 1, None), ("O", 0, 1, None)], "smiles string, `NR-AR` int, `SR-p53` int, `SR-none` int")
    found = {r["assay"]: r for r in activity.assay_summary(df).collect()}
    assert set(found) == {"NR-AR", "SR-p53"} and found["NR-AR"]["tested"] == 2 and found["NR-AR"]["activity_rate"] == 50.0
    assert [r["assay"] for r in activity.assay_summary(df, top=1).collect()] == ["SR-p53"]
    assert activity.assay_summary(spark.range(2)).isEmpty()


def test_caps_and_strategies(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WINDOW", 40)
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "Ki").otherwise("IC50").alias("standard_type")).repartition(6)
    for most, ki, ic50 in ((40, 10, 10), (10_000, 2500, 2500), (16_000, 3000, 4000)):
        kept = {r["standard_type"]: (r["n"], r["top"]) for r in activity.cap_per_type(df, "id", most).groupBy("standard_type").agg(F.count("id").alias("n"), F.max("id").alias("top")).collect()}
        assert kept["Ki"] == (ki, (ki - 1) * 3) and kept["IC50"][0] == ic50
    tied = spark.range(20_000).select(F.nullif(F.col("id") % 50, F.lit(7)).alias("id"), F.lit("Ki").alias("standard_type"))
    for most in (4000, 4004):
        assert activity.cap_per_type(tied, "id", most).count() == most // 4
        assert activity.cap_per_type(tied, "id", most).filter("id IS NULL").count() == 0
    values = spark.createDataFrame([("m", "t1", 1.0), ("m", "t1", 3.0), ("m", "t2", 5.0), ("n", "t2", None)], "m string, t string, v double")
    assert activity.multi_target(values, "m", "t", "v").count() == 3
    assert {r["m"]: r["mean_value"] for r in activity.multi_target(values, "m", "t", "v", "average").collect()} == {"m": 3.0, "n": None}
    maps = {r["m"]: r["targets"] for r in activity.multi_target(values, "m", "t", "v", "multi_task").collect()}
    assert maps == {"m": {"t1": 2.0, "t2": 5.0}, "n": {"t2": None}}
    wide = {r["m"]: (r["t1"], r["t2"]) for r in activity.multi_target(values, "m", "t", "v", "multi_task", ["t1", "t2"]).collect()}
    assert wide == {"m": (2.0, 5.0), "n": (None, None)}
    with pytest.raises(ValueError):
        activity.multi_target(values, "m", "t", "v", "both")


def test_keys_are_shuffled_as_digests(spark):
    df = spark.createDataFrame([(1, "long text"), (2, "long text"), (3, None)], "id long, text string")
    for kept in (dedup.keep_one(df, "text", "id"), validate.clean_keys(df, "text", "id")):
        plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("\n") if "Exchange" in line or "Sort [" in line]
        assert moved and not any("text#" in line for line in moved)
    assert sorted(r["id"] for r in dedup.keep_one(df, "text", "id").collect()) == [1, 3]


def test_a_sketch_that_is_off_is_mended(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WINDOW", 10)
    proposed = ordering._inside
    monkeypatch.setattr(ordering, "_inside", lambda slot, low, high: proposed(slot, high + 40, high + 50))
    df = spark.range(500).select(F.col("id").alias("v"))
    assert ordering.order_statistics(df, {"v": (F.col("v"), [0, 250, 499])}) == {("v", 0): 0, ("v", 250): 250, ("v", 499): 499}


def test_drug_likeness(spark):
    df = spark.createDataFrame([(1, 600.0, 2.0, 1, 1, 12, 100.0), (2, 300.0, 6.0, 1, 1, None, 150.0), (3, 300.0, 2.0, 1, 1, 10, 140.0)], "id long, molecular_weight double, logp double, num_hbd int, num_hba int, num_rotatable_bonds int, tpsa double")
    rows = rules.drug_likeness(df).orderBy("id").collect()
    assert [r["alerts"] for r in rows] == [["molecular_weight", "veber"], ["logp", "veber"], []]
    assert [round(r["drug_like_score"], 2) for r in rows] == [0.6, 0.6, 1.0] and [r["veber_pass"] for r in rows] == [False, False, True]
    assert [r["violations"] for r in rows] == [1, 1, 0] and rules.drug_likeness(df.select("id")).filter("veber_pass").count() == 3


def test_correlations_of_many_columns_in_one_scan(spark):
    """30 columns with gaps, far from zero; constants, NaN and empty columns give null."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(2000, 27)) @ rng.normal(size=(27, 27)) + 1e7
    base[(rng.random(base.shape) < 0.1) & (np.arange(2000) != 7)[:, None]] = np.nan
    names = [f"c{i}" for i in range(27)] + ["same", "odd", "none"]
    rows = [[None if np.isnan(v) else float(v) for v in r] + [0.1, float("nan") if i == 7 else float(i), None] for i, r in enumerate(base)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    out = features.correlations(df, names)
    plan = out._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1
    found = {(r["column_a"], r["column_b"]): r["corr"] for r in out.collect()}
    want = pd.DataFrame(base, columns=names[:27]).corr().to_numpy()
    assert len(found) == 900
    assert max(abs(found[f"c{i}", f"c{j}"] - want[i, j]) for i in range(27) for j in range(27)) < 1e-7
    assert all(found[a, b] is None for a in ("same", "none") for b in names) and all(found["odd", n] is None for n in names if n != "odd")
    empty = features.correlations(df.limit(0), ["c0", "c1"]).collect()
    assert len(empty) == 4 and all(r["corr"] is None for r in empty)
