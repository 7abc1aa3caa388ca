"""Registered queries against their SQL, and the log reports on small logs."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from gainsieve.plans import reports as P

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        return "nan" if isinstance(value, float) and math.isnan(value) else repr(value + 0.0 if isinstance(value, float) else value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, database, name):
    df = entry_points.queries()[name](spark, sf_dir)
    cursor = database.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, cursor.fetchall())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["rank", "feature", "n_cells", "score"] and df.count() == 6


def logs(spark):
    runs = [(1, 1, 1, 100, 9.0, 5, False), (2, 1, 1, 200, 100.0, 100, True), (3, 3, 3, 500, 50.0, 100, True), (4, 5, 5, 900, 0.0, 100, True)]
    results = [(1, "a", 0.9), (2, "b", 0.8), (2, "a", 0.8), (3, "a", 0.7), (3, "b", None)]
    return (
        spark.createDataFrame(runs, "exp_id int, maps int, reduces int, chunk int, time double, n_features int, success boolean"),
        spark.createDataFrame(results, "exp_id int, classifier string, accuracy double"),
    )


def test_reports(spark):
    runs, results = logs(spark)
    summary = {r["exp_id"]: r for r in P.run_summary(runs, results).collect()}
    assert (summary[1]["status"], summary[1]["n_features"], summary[1]["best_accuracy"]) == ("FAILED", 0, 0.0)
    assert (summary[2]["best_classifier"], summary[2]["best_accuracy"]) == ("a", 0.8)
    assert (summary[4]["best_classifier"], summary[4]["best_accuracy"]) == ("N/A", 0.0)
    against = {r["exp_id"]: (r["speedup"], round(r["accuracy_change"], 9)) for r in P.against_first(runs, results).collect()}
    assert against == {2: (1.0, 0.0), 3: (2.0, -0.1), 4: (0.0, -0.8)}
    pivot = {r["exp_id"]: (r["a"], r["b"], r["c"]) for r in P.accuracy_table(runs, results, ["a", "b", "c"]).collect()}
    assert pivot == {2: (0.8, 0.8, 0.0), 3: (0.7, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}
    top = [(r["rank"], r["classifier"]) for r in P.top_classifiers(runs, results).orderBy("rank").collect()]
    assert top == [(1, "b"), (2, "a")]
    status = P.run_status(P.run_settings(spark), runs)
    assert tuple(P.success_count(status).first()) == (3, 12)
