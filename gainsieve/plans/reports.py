"""Questions about a log of runs.

``runs`` has ``exp_id, maps, reduces, chunk, time, n_features, success`` and ``results``
has ``exp_id, classifier, accuracy``, one row per run and classifier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The runs of the published comparison.
RUN_SETTINGS = [
    (1, 1, 1, 100, "baseline_small_chunk"),
    (2, 1, 1, 200, "baseline_medium_chunk"),
    (3, 1, 1, 500, "baseline_large_chunk"),
    (4, 1, 1, 1000, "baseline_full_chunk"),
    (5, 1, 3, 1000, "more_reducers"),
    (6, 1, 5, 1000, "even_more_reducers"),
    (7, 3, 1, 1000, "more_mappers"),
    (8, 3, 3, 1000, "balanced_equal"),
    (9, 3, 5, 1000, "balanced_more_reducers"),
    (10, 5, 1, 1000, "even_more_mappers"),
    (11, 5, 3, 1000, "balanced_2"),
    (12, 5, 5, 1000, "balanced_full"),
]
RUN_SETTINGS_SCHEMA = "exp_id int, maps int, reduces int, chunk int, description string"


def run_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUN_SETTINGS, RUN_SETTINGS_SCHEMA)


def best_classifier(results: DataFrame) -> DataFrame:
    """The most accurate classifier of each run; the first by name when several are."""
    best = F.min(F.struct((-F.col("accuracy")).alias("a"), "classifier"))
    return (
        results.where("accuracy IS NOT NULL")
        .groupBy("exp_id")
        .agg(best.alias("best"))
        .select(
            "exp_id",
            F.col("best.classifier").alias("best_classifier"),
            (-F.col("best.a") + F.lit(0.0)).alias("best_accuracy"),
        )
    )


def run_summary(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Settings, time, kept features, best accuracy and status of each run."""
    return runs.join(best_classifier(results), "exp_id", "left").select(
        "exp_id",
        F.when(F.col("success"), "SUCCESS").otherwise("FAILED").alias("status"),
        "maps",
        "reduces",
        "chunk",
        F.coalesce("time", F.lit(0.0)).alias("time"),
        F.when(F.col("success"), F.col("n_features")).otherwise(0).alias("n_features"),
        F.when(F.col("success"), F.coalesce("best_accuracy", F.lit(0.0))).otherwise(0.0).alias("best_accuracy"),
        F.when(F.col("success"), F.coalesce("best_classifier", F.lit("N/A"))).otherwise("N/A").alias("best_classifier"),
    )


def _successful(runs: DataFrame, results: DataFrame) -> DataFrame:
    return results.join(runs.where("success").select("exp_id"), "exp_id", "left_semi")


def accuracy_table(runs: DataFrame, results: DataFrame, classifiers: Sequence[str]) -> DataFrame:
    """One row per successful run and one column per classifier; 0 where there is no result."""
    found = _successful(runs, results).groupBy("exp_id").pivot("classifier", list(classifiers)).agg(F.first("accuracy"))
    return runs.where("success").select("exp_id").join(found, "exp_id", "left").na.fill(0.0, list(classifiers))


def _first_success(runs: DataFrame, value: str) -> Column:
    return runs.where("success").agg(F.min_by(value, "exp_id")).scalar()


def against_first(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Speed-up and accuracy change of every successful run against the first of them."""
    summary = run_summary(runs, results).where("status = 'SUCCESS'")
    base_accuracy = summary.agg(F.min_by("best_accuracy", "exp_id")).scalar()
    return summary.select(
        "exp_id",
        "time",
        F.when(F.col("time") > 0, _first_success(runs, "time") / F.col("time")).otherwise(0.0).alias("speedup"),
        "best_accuracy",
        (F.col("best_accuracy") - base_accuracy).alias("accuracy_change"),
    )


def mean_accuracy(runs: DataFrame, results: DataFrame) -> DataFrame:
    return _successful(runs, results).groupBy("classifier").agg(F.avg("accuracy").alias("mean_accuracy"))


def top_classifiers(runs: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` classifiers with the highest mean accuracy, ranked."""
    order = [F.desc("mean_accuracy"), F.asc("classifier")]
    best = mean_accuracy(runs, results).orderBy(*order).limit(k)
    # One row per classifier name, k at most.
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "classifier", "mean_accuracy")


def ranked_results(results: DataFrame) -> DataFrame:
    """Classifiers of each run from most to least accurate."""
    order = Window.partitionBy("exp_id").orderBy(F.desc("accuracy"), F.asc("classifier"))
    return results.withColumn("place", F.row_number().over(order))


def run_status(settings: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of every planned run; one that is not in the log counts as failed."""
    return settings.select("exp_id").join(runs.select("exp_id", "success", "time", "n_features"), "exp_id", "left").select(
        "exp_id",
        F.when(F.col("success"), "SUCCESS").otherwise("FAILED").alias("status"),
        F.coalesce("time", F.lit(0.0)).alias("time"),
        F.coalesce("n_features", F.lit(0)).alias("n_features"),
    )


def success_count(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if(F.col("status") == "SUCCESS").alias("n_success"), F.count("*").alias("n_runs")
    )


def write_summary(runs: DataFrame, results: DataFrame, path: str) -> None:
    """CSV of the successful runs."""
    (
        run_summary(runs, results)
        .where("status = 'SUCCESS'")
        .select(
            F.col("exp_id").alias("experiment"),
            F.col("maps").alias("map_tasks"),
            F.col("reduces").alias("reduce_tasks"),
            F.col("chunk").alias("chunk_size_kb"),
            F.col("time").alias("time_seconds"),
            F.col("n_features").alias("features_extracted"),
            "best_accuracy",
            "best_classifier",
        )
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def append_results(results: DataFrame, path: str) -> None:
    """Results of a run, filed under its id."""
    results.write.mode("append").partitionBy("exp_id").parquet(path)
