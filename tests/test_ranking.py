import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gainsieve.operators.profile import class_profile
from gainsieve.operators.ranking import (
    contingency,
    display_scores,
    fold_gain,
    information_gain,
    labelled_text,
    melt_columns,
    melt_vector,
    pooled_gain,
    rank_table,
    rank_vectors,
    top_features,
    training_profiles,
)


def entropy(labels):
    total = len(labels)
    return -sum(n / total * math.log2(n / total) for n in Counter(labels).values())


def gain(values, labels):
    """Brute force; None is a missing cell."""
    groups = defaultdict(list)
    for v, y in zip(values, labels):
        if v is not None:
            groups[v].append(y)
    return entropy(labels) - sum(len(g) / len(labels) * entropy(g) for g in groups.values())


def scores(df):
    return {r["feature"]: r["score"] for r in df.collect()}


def test_worked_examples(spark):
    rows = [("a", "a", "k", "a", 0), ("a", "a", "k", "b", 0), ("b", "b", "k", "c", 1), ("b", " ", "k", "d", 0)]
    df = spark.createDataFrame(rows, "plain string, gap string, constant string, unique string, label int")
    found = scores(rank_table(df))
    assert found["plain"] == pytest.approx(0.311278, abs=1e-6)
    assert found["gap"] == pytest.approx(0.811278, abs=1e-6)
    assert found["constant"] == pytest.approx(0.0, abs=1e-12)
    assert found["unique"] == pytest.approx(0.811278, abs=1e-6)


def test_text_and_number_categories(spark):
    df = spark.createDataFrame([("0", 0), ("0.0", 1), ("0.00", 0), ("1", 1), ("x", 1)], "x string, target int")
    cells = melt_columns(labelled_text(df, "target"), ["x"])
    assert contingency(cells).select("value").distinct().count() == 5
    numeric = melt_columns(labelled_text(df, "target", numeric=True), ["x"], numeric=True)
    assert numeric.select("value").distinct().count() == 2


def test_target_rows(spark):
    df = spark.createDataFrame(
        [("a", " 1.9 "), ("a", "Label"), ("a", ""), ("a", None), ("b", "nan"), ("b", "inf"), ("b", "-1.9"), ("b", "x")],
        "f string, label string",
    )
    assert labelled_text(df, "label").count() == 5
    assert sorted(r["label"] for r in labelled_text(df, "label", numeric=True).collect()) == [-1, 1]


def test_no_labelled_row_is_an_error(spark):
    df = spark.createDataFrame([("a", "")], "f string, label string")
    with pytest.raises(ValueError):
        rank_table(df)


def test_duplicate_columns_are_an_error(spark):
    df = spark.createDataFrame([("a", 1)], "f string, label int")
    with pytest.raises(ValueError):
        melt_columns(df, ["f", "f"])


@pytest.mark.parametrize("classes", [2, 5, 40])
def test_gain_equals_brute_force(spark, classes):
    """40 classes take the plan in which classes stay rows."""
    rng = random.Random(classes)
    width, data = 6, []
    for _ in range(400):
        y = rng.randrange(classes)
        data.append(([None if rng.random() < 0.1 * i else float(rng.randrange(2 + i) + (y if i == 3 else 0)) for i in range(width)], y))
    df = spark.createDataFrame(data, "features array<double>, label int")
    found = scores(rank_vectors(df))
    for i in range(width):
        expected = gain([v[i] for v, _ in data], [y for _, y in data])
        assert found[f"feature_{i:04d}"] == pytest.approx(expected, abs=1e-9)
        assert -1e-9 <= found[f"feature_{i:04d}"] <= entropy([y for _, y in data]) + 1e-9


def test_gain_with_one_hot_value(spark):
    """Two thirds of all cells share one value and one class."""
    df = spark.range(30000).select(
        F.array(
            F.when(F.col("id") % 3 != 0, 1.0).otherwise(F.col("id").cast("double")), F.lit(1.0)
        ).alias("features"),
        F.when(F.col("id") % 3 != 0, 1).otherwise((F.col("id") % 2).cast("int")).alias("label"),
    )
    rows = df.collect()
    expected = gain([r["features"][0] for r in rows], [r["label"] for r in rows])
    found = scores(rank_vectors(df))
    assert found["feature_0000"] == pytest.approx(expected, abs=1e-9)
    assert found["feature_0001"] == pytest.approx(0.0, abs=1e-9)


def test_gain_does_not_depend_on_partitioning(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_tax", "l_returnflag")
    one = scores(rank_table(df.coalesce(1), "l_returnflag"))
    many = scores(rank_table(df.repartition(13), "l_returnflag"))
    assert one == pytest.approx(many, abs=1e-12)


def test_missing_labels_do_not_count(spark):
    df = spark.createDataFrame([([1.0], 0), ([2.0], 1), ([3.0], None)], "features array<double>, label int")
    assert scores(rank_vectors(df))["feature_0000"] == pytest.approx(1.0)


@pytest.mark.parametrize("classes", [2, 30])
def test_pooled_gain(spark, classes):
    rng = random.Random(7)
    data = [([float(rng.randrange(4)), float(rng.randrange(3)), float(rng.randrange(9))], rng.randrange(classes)) for _ in range(300)]
    df = spark.createDataFrame(data, "features array<double>, label int")
    cells, profile = melt_vector(df), class_profile(df)
    labels = [y for _, y in data]
    exact = [gain([v[i] for v, _ in data], labels) for i in range(3)]
    pooled = {r["feature_id"]: r["score"] for r in pooled_gain(cells, profile).collect()}
    for i in range(3):
        conditional = entropy(labels) - exact[i]
        assert pooled[i] == pytest.approx(entropy(labels) - conditional / 3, abs=1e-9)
    assert sorted(pooled, key=pooled.get) == sorted(range(3), key=lambda i: exact[i])
    two = {r["feature_id"]: r["score"] for r in pooled_gain(cells, profile, lambda f: f % 2).collect()}
    assert two[1] == pytest.approx(exact[1], abs=1e-9)
    assert two[0] == pytest.approx(entropy(labels) - (entropy(labels) - exact[0]) / 2, abs=1e-9)


def test_fold_gain(spark):
    rng = random.Random(3)
    data = [([float(rng.randrange(3)), float(rng.randrange(5))], rng.randrange(3), rng.randrange(4)) for _ in range(200)]
    df = spark.createDataFrame(data, "features array<double>, label int, fold int")
    found = fold_gain(melt_vector(df, keep=("fold",)), training_profiles(df, range(4))).collect()
    assert len(found) == 8
    for r in found:
        kept = [(v, y) for v, y, f in data if f != r["fold"]]
        assert r["score"] == pytest.approx(gain([v[r["feature_id"]] for v, _ in kept], [y for _, y in kept]), abs=1e-9)


def test_nan_and_negative_zero_are_categories(spark):
    nan = float("nan")
    df = spark.createDataFrame([([nan], 0), ([nan], 1), ([0.0], 0), ([-0.0], 1)], "features array<double>, label int")
    assert contingency(melt_vector(df)).select("value").distinct().count() == 2
    assert scores(rank_vectors(df))["feature_0000"] == pytest.approx(0.0)


def test_ties_rank_by_name(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "feature string, score double")
    assert [(r["rank"], r["feature"]) for r in top_features(df, 2).orderBy("rank").collect()] == [(1, "c"), (2, "a")]


def test_display(spark):
    df = spark.createDataFrame([(1, "x" * 51, 0.12345678), (2, "y" * 50, 1.0)], "rank int, feature string, score double")
    shown = display_scores(df).orderBy("rank").collect()
    assert shown[0]["feature"] == "x" * 47 + "..." and shown[0]["score"] == "0.123457"
    assert shown[1]["feature"] == "y" * 50
    assert display_scores(df, 8).orderBy("rank").first()["score"] == "0.12345678"


def test_cells_are_shuffled_once(spark):
    """Class counts side by side: one shuffle of cells, one of per-feature sums."""
    df = spark.range(1000).select(F.array((F.col("id") % 7).cast("double")).alias("features"), (F.col("id") % 2).alias("label"))
    plan = information_gain(melt_vector(df), class_profile(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_count" in plan


def test_csv_gain_reads_the_text_once(spark, tmp_path):
    from gainsieve.operators.ranking import cell_sums, labelled_cells, rank_cells
    from gainsieve.sources.tables import read_cells

    (tmp_path / "t.csv").write_text("a,label,b\nx,0,1\nx,0,1.0\ny,1,\ny,0,2\nz,,3\n")
    table = read_cells(spark, str(tmp_path / "t.csv"))
    plan = cell_sums(labelled_cells(table, 1), 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = {r["feature"]: (r["n_cells"], round(r["score"], 6)) for r in rank_cells(table).collect()}
    assert got == {"a": (4, 0.311278), "b": (3, 0.811278)}
    got = {r["feature"]: (r["n_cells"], round(r["score"], 6)) for r in rank_cells(table, numeric=True).collect()}
    assert got == {"b": (3, 0.811278)}
