import pytest
from pyspark.sql import functions as F

from gainsieve.functions.vectors import fix_width
from gainsieve.operators.folds import class_facts, folded_table, held_out, stratified_folds
from gainsieve.operators.ordering import row_ranks
from gainsieve.operators.profile import class_profile, dataset_profile
from gainsieve.operators.sampling import class_shortfall, first_per_class, first_rows, seeded_shuffle
from gainsieve.operators.scaling import min_max_scale, scale_guarded
from gainsieve.operators.selection import project_features, selected_ids


def skewed(spark, n=5000):
    """Nine of ten rows are of class 1; keys are out of order."""
    return spark.range(n).select(
        (F.col("id") * 7919 % n).alias("key"), F.when(F.col("id") * 7919 % n % 10 == 0, 0).otherwise(1).alias("label")
    )


def test_row_ranks_span_partitions(spark):
    ranks = row_ranks(skewed(spark), ["label"], ["key"]).collect()
    for label in (0, 1):
        keys = sorted(r["key"] for r in ranks if r["label"] == label)
        assert {r["key"]: r["rank"] for r in ranks if r["label"] == label} == {k: i + 1 for i, k in enumerate(keys)}


def test_first_per_class(spark):
    kept = first_per_class(skewed(spark), 40, ["key"]).collect()
    assert sorted(r["key"] for r in kept if r["label"] == 0) == [10 * i for i in range(40)]
    assert sorted(r["key"] for r in kept if r["label"] == 1) == [i for i in range(45) if i % 10][:40]


def test_short_class_is_whole(spark):
    df = skewed(spark, 100)
    kept = first_per_class(df, 40, ["key"])
    assert kept.where("label = 0").count() == 10 and kept.where("label = 1").count() == 40
    assert class_shortfall(kept, 40) == {0: 30}
    assert class_shortfall(kept, 40, classes=(0, 1, 2)) == {0: 30, 2: 40}


def test_other_classes_are_left_out(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "key int, label int")
    assert {r["label"] for r in first_per_class(df, 5, ["key"]).collect()} == {0, 1}


@pytest.mark.parametrize("split", [(), ("a",)])
def test_order_of_two_columns(spark, split):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), F.col("id").alias("b"))
    kept = first_rows(df, 150, ["a", "b"], split).collect()
    expected = sorted((i % 10, i) for i in range(1000))[:150]
    assert sorted(tuple(r) for r in kept) == expected


def test_shuffle_is_independent_of_partitioning(spark):
    df = skewed(spark, 300)
    orders = [[r["key"] for r in seeded_shuffle(df.repartition(n), ["key"]).collect()] for n in (1, 7)]
    assert orders[0] == orders[1] != sorted(orders[0]) and sorted(orders[0]) == list(range(300))
    assert [r["key"] for r in seeded_shuffle(df, ["key"], 43).collect()] != orders[0]


def reference_folds(labels, k):
    """Deal rows of the class-sorted table to folds, then fill each class's rows in order."""
    seen = list(dict.fromkeys(labels))
    ordered = sorted(labels, key=seen.index)
    quota = {c: [sum(1 for i, y in enumerate(ordered) if y == c and i % k == f) for f in range(k)] for c in seen}
    queue = {c: [f for f in range(k) for _ in range(quota[c][f])] for c in seen}
    return [queue[y].pop(0) for y in labels]


@pytest.mark.parametrize("k", [2, 5])
def test_stratified_folds(spark, k):
    rows = sorted((r["key"], r["label"]) for r in skewed(spark, 997).collect())
    df = spark.createDataFrame(rows, "key long, label int").repartition(5)
    folds = {r["key"]: r["fold"] for r in stratified_folds(df, "label", ["key"], k).collect()}
    assert [folds[key] for key, _ in rows] == reference_folds([y for _, y in rows], k)


def test_folds_of_a_tiny_class(spark):
    rows = [(i, "b" if i == 3 else "a") for i in range(11)]
    df = spark.createDataFrame(rows, "key int, label string")
    folds = {r["key"]: r["fold"] for r in stratified_folds(df, "label", ["key"]).collect()}
    assert [folds[key] for key, _ in rows] == reference_folds([y for _, y in rows], 5)
    assert class_facts(df, "label", ["key"]) == {"a": 10, "b": 1}


def test_hold_out_when_classes_are_too_small(spark):
    rows = [(i, [float(i)], i) for i in range(12)]
    table = folded_table(spark.createDataFrame(rows, "key int, features array<double>, label int"), "key")
    assert (table.folds, table.tested, table.rows) == (2, [1], 12)


def test_held_out_share(spark):
    share = spark.range(20000).agg(F.avg(held_out(["id"]))).first()[0]
    assert share == pytest.approx(0.3, abs=0.02)


def test_min_max(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, 5.0, None, nan],), ([2.0, 5.0, None, 4.0],), ([3.0, 5.0, None, 8.0],)], "features array<double>")
    scaled = sorted((r["features"] for r in min_max_scale(df, 4).collect()), key=lambda v: v[0])
    assert [v[:3] for v in scaled] == [[0.0, 0.0, None], [0.5, 0.0, None], [1.0, 0.0, None]]
    assert scaled[0][3] != scaled[0][3] and [v[3] for v in scaled[1:]] == [0.0, 1.0]


def test_zero_first_record_is_not_scaled(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [4.0, 8.0])], "key int, features array<double>")
    assert sorted(r["features"] for r in scale_guarded(df, ["key"]).collect()) == [[0.0, 0.0], [4.0, 8.0]]
    assert sorted(r["features"] for r in scale_guarded(df.withColumn("key", -F.col("key")), ["key"]).collect()) == [[0.0, 0.0], [1.0, 1.0]]


def test_fix_width(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(fix_width(F.col("v"), 3)).collect()] == [[1.0, 2.0, 0.0], [1.0, 2.0, 3.0], [0.0, 0.0, 0.0]]


def test_selection(spark):
    ranked = spark.createDataFrame([(i, 20 - i) for i in range(1, 13)], "rank int, feature_id int")
    assert selected_ids(ranked, 64, 11) == [20 - i for i in range(1, 12)]
    assert selected_ids(ranked.where("rank < 10"), 64) == list(range(64))
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "features array<double>")
    assert project_features(df, [2, 9, 0], 3).first()["features"] == [3.0, 1.0]
    assert project_features(df, [9], 3).first()["features"] == [0.0]


def test_profiles(spark):
    df = spark.range(50).select((F.col("id") % 25).alias("label"), F.array(F.lit(1.0)).alias("features"))
    listed, unlisted = class_profile(df), class_profile(df, most=10)
    assert listed.total == unlisted.total == 50 and unlisted.counts is None
    assert listed.entropy == pytest.approx(unlisted.entropy)
    with pytest.raises(ValueError):
        unlisted.classes
    row = dataset_profile(df, wanted_per_class=3).first()
    assert row.asDict() == {"total_rows": 50, "n_features": 1, "class_0": 2, "class_1": 2, "short_0": 1, "short_1": 1}


def test_first_lines_read_a_prefix_once(spark, tmp_path, monkeypatch):
    """Files are read in order until both classes are full, each line once."""
    import json

    from gainsieve.plans import prepare

    path, rows = tmp_path / "lines", []
    path.mkdir()
    for f in range(6):
        lines = []
        for i in range(40):
            label = int(f >= 2 and i % 5 == 0)
            lines.append(json.dumps({"label": label, "features": [f, i]}) if i % 7 else ["", "no json", '{"label": 2, "features": [1]}'][i % 3])
            rows.append((f, i, label, lines[-1], bool(i % 7)))
        (path / f"part-{f}.txt").write_text("\n".join(lines))
    read = []
    lines_of = prepare.read_lines
    monkeypatch.setattr(prepare, "read_lines", lambda spark, files: read.extend(files) or lines_of(spark, files))
    sample = prepare.first_lines(spark, str(path), 9, first_bytes=1)
    expected = {c: [v for _, _, label, v, valid in rows if valid and label == c][:9] for c in (0, 1)}
    assert sorted((r["label"], r["value"]) for r in sample.collect()) == sorted((c, v) for c in (0, 1) for v in expected[c])
    assert [p.rsplit("/", 1)[1] for p in read] == [f"part-{f}.txt" for f in range(4)]
    whole = prepare.balanced_lines(spark, str(path), 1000)
    assert whole.count() == sum(valid for *_, valid in rows) and prepare.balanced_lines(spark, str(path), 0).count() == 0
