import random

from pyspark.sql import functions as F

from assayer.operators.numbering import number_rows


def numbered(rows, key, group):
    out, seen = {}, {}
    for row in sorted(rows, key=lambda r: (str(group(r)), key(r))):
        seen[group(row)] = seen.get(group(row), -1) + 1
        out[row[0]] = seen[group(row)]
    return out


def test_numbers_in_groups_with_a_hot_and_a_null_group(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 6 + [None, *[f"g{k}" for k in range(20)]]), rng.randrange(50)) for i in range(5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, g string, v int").repartition(7)
    found = number_rows(df, [F.desc("v"), "i"], ["g"], "n", "size").collect()
    assert {r["i"]: r["n"] for r in found} == numbered(rows, lambda r: (-r[2], r[0]), lambda r: r[1])
    sizes = {g: sum(r[1] == g for r in rows) for g in {r[1] for r in rows}}
    assert all(r["size"] == sizes[r["g"]] for r in found) and len(found) == len(rows)


def test_one_value_is_cut_into_ranges(spark):
    """All rows tie: they still meet in several ranges, none with much more than its share."""
    df = spark.range(0, 40_000, 1, 8).select("id", F.lit(0).alias("v"))
    found = number_rows(df, ["v"], (), "n")
    assert sorted(r["n"] for r in found.select("n").collect()) == list(range(40_000))
    plan = found.select("n", "id").orderBy("n").limit(3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([], "g string, v int, number long")
    assert number_rows(df, ["v"], ["g"]).collect() == []
    df = spark.createDataFrame([("a", 2, 9), ("a", 1, 9)], "g string, v int, number long")
    assert sorted((r["v"], r["number"]) for r in number_rows(df, ["v"], ["g"]).collect()) == [(1, 0), (2, 1)]
