"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsieve.operators import ranking as R
from gainsieve.operators.folds import stratified_folds
from gainsieve.operators.profile import class_distribution, class_profile, class_totals, label_entropy
from gainsieve.operators.selection import keep_ranked_cells
from gainsieve.sources.tables import resolve_target
from registered.tables import (
    CLASS,
    NUMBER_FEATURES,
    QUANTISED,
    SIDE_SQL,
    TEXT_FEATURES,
    VECTOR_CELLS_SQL,
    cells_sql,
    gain_sql,
    lineitem,
    quantised,
    rounded,
    table,
)

LABELS_SQL = f"SELECT {CLASS} AS y FROM lineitem"


def q_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_distribution(lineitem(spark, sf_dir, []), CLASS)


def q_total_and_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_totals(lineitem(spark, sf_dir, []), CLASS)


def q_label_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(label_entropy(lineitem(spark, sf_dir, []), CLASS), "entropy")


def q_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per feature, with rows missing in every seventh order."""
    rows = _with_gaps(spark, sf_dir)
    cells = R.with_names(R.melt_columns(rows, TEXT_FEATURES, CLASS), TEXT_FEATURES)
    return cells.groupBy("feature").agg(F.count("*").alias("n_cells"), F.countDistinct("value").alias("n_values"))


def q_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.melt_columns(lineitem(spark, sf_dir), TEXT_FEATURES, CLASS)
    return R.with_names(R.contingency(cells), TEXT_FEATURES).select("feature", "value", "cls", "n")


def q_conditional_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.labelled_text(lineitem(spark, sf_dir), CLASS)
    scores = R.conditional_entropy(R.melt_columns(rows, TEXT_FEATURES), class_profile(rows))
    named = R.with_names(scores, TEXT_FEATURES).select("feature", "n_cells", "conditional_entropy")
    return rounded(named, "conditional_entropy")


def _scores(ranked: DataFrame) -> DataFrame:
    return rounded(ranked.select("feature", "n_cells", "score"), "score")


def q_info_gain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(R.rank_table(lineitem(spark, sf_dir), CLASS))


def q_info_gain_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir, NUMBER_FEATURES).withColumn("label", F.expr(f"ascii({CLASS}) + 0.75")).drop(CLASS)
    return _scores(R.rank_table(rows, "label", numeric=True))


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir, ["l_orderkey", *TEXT_FEATURES])
    gap = F.col("l_orderkey") % 7 == 0
    return rows.select(*[F.when(~gap, F.col(c)).alias(c) for c in TEXT_FEATURES], CLASS)


GAPS = "CASE WHEN l_orderkey % 7 <> 0 THEN {c} END"


def q_info_gain_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(R.rank_table(_with_gaps(spark, sf_dir), CLASS))


def q_info_gain_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(R.rank_vectors(quantised(spark, sf_dir)))


def q_info_gain_many_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label has more classes than stand side by side, so they stay rows."""
    rows = table(spark, sf_dir, "lineitem").select(CLASS, "l_quantity", "l_linenumber", "l_suppkey")
    return _scores(R.rank_table(rows, "l_suppkey"))


def q_info_gain_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is not named: the last column is taken."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_orderpriority")
    return _scores(R.rank_table(rows, resolve_target(rows.columns)))


def q_pooled_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, 1)


def q_pooled_gain_two_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, 2)


def _pooled(spark: SparkSession, sf_dir: str, pools: int) -> DataFrame:
    rows = lineitem(spark, sf_dir, NUMBER_FEATURES).withColumn("label", F.ascii(CLASS)).drop(CLASS)
    cells = R.melt_columns(rows, NUMBER_FEATURES, numeric=True)
    scores = R.pooled_gain(cells, class_profile(rows), lambda feature: feature % pools)
    return rounded(R.with_names(scores, NUMBER_FEATURES).select("pool", "feature", "n_cells", "score"), "score")


def _pooled_sql(pools: int) -> str:
    return f"""
    WITH cells AS (SELECT *, feature_id % {pools} AS pool FROM ({cells_sql(NUMBER_FEATURES, numeric=True)})),
    pc AS (SELECT pool, cls, count(*) AS c FROM cells GROUP BY pool, cls),
    p AS (SELECT pool, sum(c) AS t FROM pc GROUP BY pool),
    h AS (SELECT pc.pool, -sum(c * 1.0 / t * log2(c * 1.0 / t)) AS h FROM pc JOIN p USING (pool) GROUP BY pc.pool),
    vc AS (SELECT pool, feature, value, cls, count(*) AS c FROM cells GROUP BY pool, feature, value, cls),
    v AS (SELECT *, sum(c) OVER (PARTITION BY feature, value) AS n FROM vc),
    ce AS (SELECT v.pool, feature, sum(c) AS cells_n, -sum(c * 1.0 / t * log2(c * 1.0 / n)) AS ce FROM v JOIN p USING (pool) GROUP BY v.pool, feature)
    SELECT CAST(ce.pool AS INTEGER) AS pool, feature, CAST(cells_n AS BIGINT) AS n_cells, round(h.h - ce.ce, 6) + 0.0 AS score
    FROM ce JOIN h USING (pool)
    """


def q_top_k_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.top_features(R.rank_vectors(quantised(spark, sf_dir)), 20)
    return rounded(top.select("rank", "feature", "score"), "score")


def q_display_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names above 50 characters are cut."""
    scores = R.rank_vectors(quantised(spark, sf_dir))
    long = F.concat(F.repeat(F.lit("v"), F.lit(45) + F.col("feature_id") % 3), F.col("feature"))
    return R.display_scores(R.top_features(scores.withColumn("feature", long), 20))


def q_keep_ranked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark, sf_dir)
    top = R.top_features(R.rank_vectors(rows), 10)
    kept = keep_ranked_cells(R.melt_vector(rows), top)
    return kept.groupBy("feature_id").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))


def q_fold_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stratified_folds(quantised(spark, sf_dir, two_classes=True), "label", ["vec_id"])
    scores = R.fold_gain(R.melt_vector(rows, keep=("fold",)), R.training_profiles(rows, range(5)))
    return rounded(scores.select("fold", "feature_id", "n_cells", "score"), "score")


VECTOR_GAIN_SQL = gain_sql(VECTOR_CELLS_SQL, "SELECT label AS y FROM embeddings")


def folds_sql(source: str, label: str, key: str) -> str:
    """``key``, ``label`` and the fold, five runs of consecutive rows per class."""
    dealt = "(({x}) - {f} + 4) // 5"
    ends = []
    for last in range(4):
        parts = [f"{dealt.format(x='start + n', f=f)} - {dealt.format(x='start', f=f)}" for f in range(last + 1)]
        ends.append(f"CAST(rk >= {' + '.join(parts)} AS INTEGER)")
    return f"""
    SELECT {key}, r.{label}, {' + '.join(ends)} AS fold
    FROM (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {key}) - 1 AS rk FROM {source}) r
    JOIN (SELECT {label}, n, CAST(sum(n) OVER (ORDER BY first) - n AS BIGINT) AS start
          FROM (SELECT {label}, count(*) AS n, min({key}) AS first FROM {source} GROUP BY {label})) c ON r.{label} = c.{label}
    """


FOLD_GAIN_SQL = f"""
    WITH src AS (SELECT vec_id, {SIDE_SQL} AS label, {QUANTISED} AS q FROM embeddings),
    placed AS ({folds_sql('src', 'label', 'vec_id')}),
    cells AS (SELECT t.f AS fold, u.pos - 1 AS feature_id, src.q[u.pos] AS value, src.label AS cls
              FROM src JOIN placed ON src.vec_id = placed.vec_id
              JOIN (SELECT unnest(range(0, 5)) AS f) t ON t.f <> placed.fold,
              (SELECT unnest(range(1, 65)) AS pos) u),
    labels AS (SELECT fold, cls, count(*) AS c FROM cells WHERE feature_id = 0 GROUP BY fold, cls),
    total AS (SELECT fold, sum(c) AS t FROM labels GROUP BY fold),
    h AS (SELECT fold, t, -sum(c * 1.0 / t * log2(c * 1.0 / t)) AS h FROM labels JOIN total USING (fold) GROUP BY fold, t),
    vc AS (SELECT fold, feature_id, value, cls, count(*) AS c FROM cells GROUP BY fold, feature_id, value, cls),
    v AS (SELECT *, sum(c) OVER (PARTITION BY fold, feature_id, value) AS n FROM vc),
    ce AS (SELECT fold, feature_id, sum(c) AS cells_n, -sum(c * log2(c * 1.0 / n)) AS ce FROM v GROUP BY fold, feature_id)
    SELECT CAST(fold AS INTEGER) AS fold, CAST(feature_id AS INTEGER) AS feature_id, CAST(cells_n AS BIGINT) AS n_cells,
           round(h - ce / t, 6) + 0.0 AS score
    FROM ce JOIN h USING (fold)
"""

QUERIES = {
    "class_distribution": q_class_distribution,
    "total_and_classes": q_total_and_classes,
    "label_entropy": q_label_entropy,
    "melt": q_melt,
    "contingency": q_contingency,
    "conditional_entropy": q_conditional_entropy,
    "info_gain_text": q_info_gain_text,
    "info_gain_numeric": q_info_gain_numeric,
    "info_gain_missing": q_info_gain_missing,
    "info_gain_vector": q_info_gain_vector,
    "info_gain_many_classes": q_info_gain_many_classes,
    "info_gain_orders": q_info_gain_orders,
    "pooled_gain": q_pooled_gain,
    "pooled_gain_two_pools": q_pooled_gain_two_pools,
    "top_k_features": q_top_k_features,
    "display_scores": q_display_scores,
    "keep_ranked_cells": q_keep_ranked_cells,
    "fold_gain": q_fold_gain,
}

ORACLES = {
    "class_distribution": f"SELECT {CLASS} AS cls, count(*) AS n FROM lineitem GROUP BY {CLASS}",
    "total_and_classes": f"SELECT count(*) AS total_rows, count(DISTINCT {CLASS}) AS n_classes FROM lineitem",
    "label_entropy": f"""
        WITH c AS (SELECT count(*) AS k FROM lineitem GROUP BY {CLASS}), t AS (SELECT sum(k) AS n FROM c)
        SELECT CAST(any_value(n) AS BIGINT) AS total_rows, round(-sum(k * 1.0 / n * log2(k * 1.0 / n)), 6) + 0.0 AS entropy FROM c, t""",
    "melt": f"""
        SELECT feature, count(*) AS n_cells, count(DISTINCT value) AS n_values
        FROM ({cells_sql(TEXT_FEATURES, GAPS)}) GROUP BY feature""",
    "contingency": f"SELECT feature, value, cls, count(*) AS n FROM ({cells_sql(TEXT_FEATURES)}) GROUP BY feature, value, cls",
    "conditional_entropy": f"""
        SELECT g.feature, n_cells, round(ce, 6) + 0.0 AS conditional_entropy FROM (
          SELECT feature, CAST(sum(c) AS BIGINT) AS n_cells, -sum(c * 1.0 / (SELECT count(*) FROM lineitem) * log2(c * 1.0 / n)) AS ce
          FROM (SELECT feature, value, c, sum(c) OVER (PARTITION BY feature, value) AS n
                FROM (SELECT feature, value, cls, count(*) AS c FROM ({cells_sql(TEXT_FEATURES)}) GROUP BY feature, value, cls))
          GROUP BY feature) g""",
    "info_gain_text": gain_sql(cells_sql(TEXT_FEATURES), LABELS_SQL),
    "info_gain_numeric": gain_sql(cells_sql(NUMBER_FEATURES, numeric=True), LABELS_SQL),
    "info_gain_missing": gain_sql(cells_sql(TEXT_FEATURES, GAPS), LABELS_SQL),
    "info_gain_vector": VECTOR_GAIN_SQL,
    "info_gain_many_classes": gain_sql(
        cells_sql([CLASS, "l_quantity", "l_linenumber"]).replace(f"{CLASS} AS cls", "l_suppkey AS cls"),
        "SELECT l_suppkey AS y FROM lineitem",
    ),
    "info_gain_orders": gain_sql(
        cells_sql(["o_orderstatus", "o_custkey"], source="orders").replace(f"{CLASS} AS cls", "o_orderpriority AS cls"),
        "SELECT o_orderpriority AS y FROM orders",
    ),
    "pooled_gain": _pooled_sql(1),
    "pooled_gain_two_pools": _pooled_sql(2),
    "top_k_features": f"""
        SELECT CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank, feature, score
        FROM ({VECTOR_GAIN_SQL}) ORDER BY score DESC, feature LIMIT 20""",
    "display_scores": f"""
        SELECT rank, CASE WHEN length(name) > 50 THEN left(name, 47) || '...' ELSE name END AS feature, printf('%.6f', score) AS score
        FROM (SELECT CAST(row_number() OVER (ORDER BY score DESC, name) AS INTEGER) AS rank, name, score
              FROM (SELECT repeat('v', CAST(45 + CAST(right(feature, 4) AS INTEGER) % 3 AS BIGINT)) || feature AS name, score FROM ({VECTOR_GAIN_SQL})))
        WHERE rank <= 20""",
    "keep_ranked_cells": f"""
        WITH c AS ({VECTOR_CELLS_SQL}),
        top AS (SELECT feature FROM ({VECTOR_GAIN_SQL}) ORDER BY score DESC, feature LIMIT 10)
        SELECT CAST(feature_id AS INTEGER) AS feature_id, count(*) AS n_cells, CAST(sum(value) AS DOUBLE) AS total
        FROM c WHERE feature IN (SELECT feature FROM top) GROUP BY feature_id""",
    "fold_gain": FOLD_GAIN_SQL,
}
