"""Run-log queries; ``events`` plays the part of the log.

A run is ``user_id % 12 + 1``, a classifier is an event type, its accuracy the mean value.
Run 6 failed. Settings come from the table of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsieve.plans import reports as P
from gainsieve.session import scratch_path
from registered.tables import rounded, table

CLASSIFIERS = ["click", "error", "purchase", "signup", "view"]
RUN = "CAST(user_id % 12 + 1 AS INT) AS exp_id"


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").selectExpr(RUN, "event_type", "value")
    results = events.groupBy("exp_id", F.col("event_type").alias("classifier")).agg(
        F.round(F.avg("value"), 6).alias("accuracy")
    )
    facts = events.groupBy("exp_id").agg(
        F.round(F.sum("value"), 6).alias("time"), F.count("*").cast("int").alias("n_features")
    )
    runs = (
        P.run_settings(spark)
        .join(facts, "exp_id")
        .select("exp_id", "maps", "reduces", "chunk", "time", "n_features", (F.col("exp_id") != 6).alias("success"))
    )
    return runs, results


def q_best_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best_classifier(_log(spark, sf_dir)[1])


def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run_summary(*_log(spark, sf_dir))


def q_accuracy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, results = _log(spark, sf_dir)
    some = results.where(~((F.col("exp_id") == 3) & (F.col("classifier") == "view")))
    return P.accuracy_table(runs, some, CLASSIFIERS)


def _against(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run 4 took no time at all."""
    runs, results = _log(spark, sf_dir)
    timed = runs.withColumn("time", F.when(F.col("exp_id") == 4, 0.0).otherwise(F.col("time")))
    return P.against_first(timed, results)


def q_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_against(spark, sf_dir).select("exp_id", "time", "speedup"), "speedup")


def q_accuracy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = _against(spark, sf_dir).select("exp_id", "best_accuracy", "accuracy_change")
    return rounded(compared, "best_accuracy", "accuracy_change")


def q_mean_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.mean_accuracy(*_log(spark, sf_dir)), "mean_accuracy", digits=5)


def q_mean_accuracy_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.top_classifiers(*_log(spark, sf_dir)), "mean_accuracy", digits=5)


def q_ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ranked_results(_log(spark, sf_dir)[1])


def q_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run 2 is not in the log."""
    runs, _ = _log(spark, sf_dir)
    return P.run_status(P.run_settings(spark), runs.where("exp_id <> 2"))


def q_success_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.success_count(q_run_status(spark, sf_dir))


def q_summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "summary")
    P.write_summary(*_log(spark, sf_dir), path)
    schema = (
        "experiment int, map_tasks int, reduce_tasks int, chunk_size_kb int, time_seconds double, "
        "features_extracted int, best_accuracy double, best_classifier string"
    )
    return spark.read.option("header", True).schema(schema).csv(path)


def q_results_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended in two parts and read back with the run id of their folder."""
    path = scratch_path(spark, "results")
    _, results = _log(spark, sf_dir)
    P.append_results(results.where("exp_id <= 6"), path)
    P.append_results(results.where("exp_id > 6"), path)
    return spark.read.parquet(path).select("exp_id", "classifier", "accuracy")


QUERIES = {
    "best_classifier": q_best_classifier,
    "run_summary": q_run_summary,
    "accuracy_pivot": q_accuracy_pivot,
    "speedup": q_speedup,
    "accuracy_change": q_accuracy_change,
    "mean_accuracy": q_mean_accuracy,
    "mean_accuracy_top5": q_mean_accuracy_top5,
    "ranked_results": q_ranked_results,
    "run_status": q_run_status,
    "success_count": q_success_count,
    "summary_csv": q_summary_csv,
    "results_by_run": q_results_by_run,
}

SETTINGS = ", ".join(f"({e}, {m}, {r}, {c})" for e, m, r, c, _ in P.RUN_SETTINGS)
LOG = f"""
    WITH e AS (SELECT CAST(user_id % 12 + 1 AS INTEGER) AS exp_id, event_type, value FROM events),
    results AS (SELECT exp_id, event_type AS classifier, round(avg(value), 6) AS accuracy FROM e GROUP BY exp_id, event_type),
    runs AS (SELECT exp_id, maps, reduces, chunk, round(sum(value), 6) AS time, CAST(count(*) AS INTEGER) AS n_features, exp_id <> 6 AS success
             FROM e JOIN (VALUES {SETTINGS}) s(exp_id, maps, reduces, chunk) USING (exp_id) GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY accuracy DESC, classifier) AS place FROM results),
    best AS (SELECT exp_id, classifier AS best_classifier, accuracy AS best_accuracy FROM placed WHERE place = 1),
    means AS (SELECT classifier, avg(accuracy) AS mean_accuracy FROM results WHERE exp_id <> 6 GROUP BY classifier)
"""

ORACLES = {
    "best_classifier": f"{LOG} SELECT * FROM best",
    "run_summary": f"""{LOG}
        SELECT exp_id, CASE WHEN success THEN 'SUCCESS' ELSE 'FAILED' END AS status, maps, reduces, chunk, time,
               CASE WHEN success THEN n_features ELSE 0 END AS n_features, CASE WHEN success THEN best_accuracy ELSE 0 END AS best_accuracy,
               CASE WHEN success THEN best_classifier ELSE 'N/A' END AS best_classifier
        FROM runs JOIN best USING (exp_id)""",
    "accuracy_pivot": f"""{LOG}
        SELECT exp_id, {', '.join(f"coalesce(max(accuracy) FILTER (classifier = '{c}'), 0) AS {c}" for c in CLASSIFIERS)}
        FROM results WHERE exp_id <> 6 AND NOT (exp_id = 3 AND classifier = 'view') GROUP BY exp_id""",
    "speedup": f"""{LOG}
        SELECT exp_id, CASE WHEN exp_id = 4 THEN 0 ELSE time END AS time,
               CASE WHEN exp_id = 4 THEN 0 ELSE round((SELECT time FROM runs WHERE exp_id = 1) / time, 6) + 0.0 END AS speedup
        FROM runs WHERE success""",
    "accuracy_change": f"""{LOG}
        SELECT exp_id, best_accuracy, round(best_accuracy - (SELECT best_accuracy FROM best WHERE exp_id = 1), 6) + 0.0 AS accuracy_change
        FROM best WHERE exp_id <> 6""",
    "mean_accuracy": f"{LOG} SELECT classifier, round(mean_accuracy, 5) + 0.0 AS mean_accuracy FROM means",
    "mean_accuracy_top5": f"""{LOG}
        SELECT CAST(row_number() OVER (ORDER BY mean_accuracy DESC, classifier) AS INTEGER) AS rank, classifier,
               round(mean_accuracy, 5) + 0.0 AS mean_accuracy FROM means ORDER BY rank LIMIT 5""",
    "ranked_results": f"{LOG} SELECT exp_id, classifier, accuracy, CAST(place AS INTEGER) AS place FROM placed",
    "run_status": f"""{LOG}
        SELECT s.exp_id, CASE WHEN success THEN 'SUCCESS' ELSE 'FAILED' END AS status, coalesce(time, 0) AS time,
               coalesce(n_features, 0) AS n_features
        FROM (VALUES {SETTINGS}) s(exp_id, maps, reduces, chunk) LEFT JOIN (SELECT * FROM runs WHERE exp_id <> 2) r ON s.exp_id = r.exp_id""",
    "success_count": f"{LOG} SELECT count(*) FILTER (success AND exp_id <> 2) AS n_success, count(*) AS n_runs FROM runs",
    "summary_csv": f"""{LOG}
        SELECT exp_id AS experiment, maps AS map_tasks, reduces AS reduce_tasks, chunk AS chunk_size_kb, time AS time_seconds,
               n_features AS features_extracted, best_accuracy, best_classifier
        FROM runs JOIN best USING (exp_id) WHERE success""",
    "results_by_run": f"{LOG} SELECT * FROM results",
}
