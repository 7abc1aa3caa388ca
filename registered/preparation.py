"""Sampling, scaling, selection and fold queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gainsieve.functions.vectors import feature_names, fix_width, nonzero_count
from gainsieve.operators.folds import held_out, stratified_folds
from gainsieve.operators.profile import dataset_profile
from gainsieve.operators.ranking import rank_vectors, top_features
from gainsieve.operators.sampling import first_per_class, first_rows, seeded_shuffle, shuffle_key
from gainsieve.operators.scaling import column_bounds, min_max_scale, scale_guarded
from gainsieve.operators.selection import project_features, selected_ids
from gainsieve.sources.tables import narrow, preview, widen
from registered.ranking import VECTOR_GAIN_SQL, folds_sql
from registered.tables import SIDE_SQL, labelled_documents, quantised, rounded, table, vectors

WIDTH = 64
PER_CLASS = 50
SAMPLE_SQL = f"""
    SELECT doc_id, quality, n_chars FROM (
      SELECT doc_id, quality, n_chars, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rk
      FROM labels JOIN documents USING (doc_id)) WHERE rk <= {PER_CLASS}
"""


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_documents(spark, sf_dir).select("doc_id", "quality", "n_chars")
    return first_per_class(rows, PER_CLASS, ["doc_id"], "quality")


def q_shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each sampled row in the seeded order."""
    shuffled = seeded_shuffle(_sample(spark, sf_dir), ["doc_id"])
    order = Window.orderBy(shuffle_key(42, "doc_id"), "doc_id")
    return shuffled.select("doc_id", "quality", F.row_number().over(order).alias("place"))


def q_row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(labelled_documents(spark, sf_dir).select("doc_id", "lang", "n_chars"), 200, ["doc_id"])


def q_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_profile(vectors(spark, sf_dir))


def _cells(df: DataFrame, digits: int = 6) -> DataFrame:
    cells = df.select("vec_id", F.posexplode("features").alias("pos", "x"))
    return rounded(cells, "x", digits=digits)


def q_pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second vector is padded to 80 elements, the others are cut to 48."""
    width = F.when(F.col("vec_id") % 2 == 0, 80).otherwise(48)
    return _cells(vectors(spark, sf_dir).select("vec_id", fix_width(F.col("features"), width).alias("features")))


def q_vector_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(widen(vectors(spark, sf_dir), WIDTH, keep=["vec_id"]), *feature_names(WIDTH))


def q_columns_to_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = widen(vectors(spark, sf_dir), WIDTH)
    whole = narrow(wide, feature_names(WIDTH), "label")
    return whole.groupBy("label").agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.aggregate("features", F.lit(0.0), lambda s, x: s + x)), 4).alias("total"),
        F.max(F.size("features")).alias("width"),
    )


def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview of the three rows with the lowest id."""
    kept = first_rows(vectors(spark, sf_dir), 3, ["vec_id"])
    return rounded(preview(widen(kept, WIDTH)), *feature_names(10))


def q_minmax_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(column_bounds(vectors(spark, sf_dir)), "low", "high")


def q_minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(min_max_scale(vectors(spark, sf_dir), WIDTH))


def q_minmax_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant element in the last place."""
    rows = vectors(spark, sf_dir).withColumn("features", F.array_append("features", F.lit(7.5)))
    return _cells(min_max_scale(rows, WIDTH + 1)).groupBy("pos").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count_if(F.col("x") > 0.5).alias("n_upper")
    )


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.transform("features", lambda x: F.lit(0.0))
    return vectors(spark, sf_dir).withColumn("features", F.when(F.col("vec_id") == 0, zero).otherwise(F.col("features")))


def q_zero_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector is all zero, so none is scaled."""
    guarded = scale_guarded(_blanked(spark, sf_dir), ["vec_id"])
    return _cells(guarded)


def q_nonzero_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blanked(spark, sf_dir).select("vec_id", nonzero_count(F.col("features")).alias("n_nonzero"))


def q_select_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark, sf_dir)
    ids = selected_ids(top_features(rank_vectors(rows), 12), WIDTH, 12)
    return _cells(project_features(rows, ids, WIDTH))


def q_fallback_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only seven features have cells, too few for a ranking, so the first five are taken."""
    rows = quantised(spark, sf_dir).withColumn("features", F.slice("features", 1, 7))
    ids = selected_ids(top_features(rank_vectors(rows), 10), 7, 5)
    return _cells(project_features(rows, ids, 7))


def q_select_top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer than ten are wanted, but more are ranked, so the ranking decides."""
    rows = quantised(spark, sf_dir)
    ids = selected_ids(top_features(rank_vectors(rows), 10), WIDTH, 5)
    return _cells(project_features(rows, ids, WIDTH))


def q_no_selected_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids past the width leave one zero column."""
    return _cells(project_features(quantised(spark, sf_dir), [WIDTH, WIDTH + 1], WIDTH))


def q_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return stratified_folds(rows, "label", ["vec_id"])


def q_stratified_folds_many_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of classes, most with fewer rows than folds."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return stratified_folds(rows, "o_custkey", ["o_orderkey"])


def q_stratified_folds_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return stratified_folds(rows, "quality", ["doc_id"])


def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", held_out(["doc_id"]).alias("is_test"))


def q_two_of_many_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of two of the ten classes of the vectors; rows of the others are never taken."""
    return first_per_class(table(spark, sf_dir, "embeddings").select("vec_id", "label"), PER_CLASS, ["vec_id"], "label", (0, 1))


QUERIES = {
    "two_of_many_classes": q_two_of_many_classes,
    "balanced_sample": _sample,
    "shuffle_order": q_shuffle_order,
    "row_cap": q_row_cap,
    "dataset_profile": q_dataset_profile,
    "pad_truncate": q_pad_truncate,
    "vector_to_columns": q_vector_to_columns,
    "columns_to_vector": q_columns_to_vector,
    "preview": q_preview,
    "minmax_bounds": q_minmax_bounds,
    "minmax_scale": q_minmax_scale,
    "minmax_constant": q_minmax_constant,
    "zero_guard": q_zero_guard,
    "nonzero_counts": q_nonzero_counts,
    "select_top_features": q_select_top_features,
    "fallback_selection": q_fallback_selection,
    "select_top_five": q_select_top_five,
    "no_selected_feature": q_no_selected_feature,
    "stratified_folds": q_stratified_folds,
    "stratified_folds_many_classes": q_stratified_folds_many_classes,
    "stratified_folds_unbalanced": q_stratified_folds_unbalanced,
    "holdout_split": q_holdout_split,
}

CELLS = "SELECT vec_id, u.pos - 1 AS pos, CAST(embedding[u.pos] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) u"
CUT_CELLS = CELLS.replace("CAST(embedding[u.pos] AS DOUBLE)", "CAST(floor(CAST(embedding[u.pos] AS DOUBLE) * 8) AS DOUBLE)")
BLANKED = f"SELECT vec_id, pos, CASE WHEN vec_id = 0 THEN 0 ELSE x END AS x FROM ({CELLS})"
SCALED = f"""
    SELECT vec_id, pos, CASE WHEN high > low THEN (x - low) / (high - low) ELSE 0 END AS x
    FROM ({{cells}}) JOIN (SELECT pos, min(x) AS low, max(x) AS high FROM ({{cells}}) GROUP BY pos) USING (pos)
"""
ROUNDED = "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x, 6) + 0.0 AS x FROM ({cells})"
ALL_ELEMENTS = ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0.0 AS feature_{i:04d}" for i in range(64))
ELEMENTS = ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0.0 AS feature_{i:04d}" for i in range(10))
WITH_CONSTANT = f"{CELLS} UNION ALL SELECT vec_id, 64, 7.5 FROM embeddings"

ORACLES = {
    "two_of_many_classes": f"""
        SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings WHERE label IN (0, 1)) WHERE place <= {PER_CLASS}""",
    "balanced_sample": SAMPLE_SQL,
    "shuffle_order": f"""
        SELECT doc_id, quality, CAST(row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS INTEGER) AS place FROM ({SAMPLE_SQL})""",
    "row_cap": "SELECT doc_id, lang, n_chars FROM labels JOIN documents USING (doc_id) ORDER BY doc_id LIMIT 200",
    "dataset_profile": f"""
        SELECT count(*) AS total_rows, CAST(max(len(embedding)) AS INTEGER) AS n_features,
               count(*) FILTER (y = 0) AS class_0, count(*) FILTER (y = 1) AS class_1,
               greatest(2500 - count(*) FILTER (y = 0), 0) AS short_0, greatest(2500 - count(*) FILTER (y = 1), 0) AS short_1
        FROM (SELECT embedding, {SIDE_SQL} AS y FROM embeddings)""",
    "pad_truncate": """
        SELECT vec_id, CAST(u.pos - 1 AS INTEGER) AS pos, round(coalesce(CAST(embedding[u.pos] AS DOUBLE), 0), 6) + 0.0 AS x
        FROM embeddings, (SELECT unnest(range(1, 81)) AS pos) u WHERE u.pos <= CASE WHEN vec_id % 2 = 0 THEN 80 ELSE 48 END""",
    "vector_to_columns": f"SELECT vec_id, {ALL_ELEMENTS}, {SIDE_SQL} AS label FROM embeddings",
    "columns_to_vector": f"""
        SELECT label, count(DISTINCT vec_id) AS n, round(sum(x), 4) AS total, CAST(max(pos) + 1 AS INTEGER) AS width
        FROM ({CELLS}) JOIN (SELECT vec_id, {SIDE_SQL} AS label FROM embeddings) USING (vec_id) GROUP BY label""",
    "preview": f"SELECT {ELEMENTS}, {SIDE_SQL} AS label FROM embeddings ORDER BY vec_id LIMIT 3",
    "minmax_bounds": f"""
        SELECT CAST(pos AS INTEGER) AS pos, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high FROM ({CELLS}) GROUP BY pos""",
    "minmax_scale": ROUNDED.format(cells=SCALED.format(cells=CELLS)),
    "minmax_constant": f"""
        SELECT CAST(pos AS INTEGER) AS pos, min(x) AS low, max(x) AS high, count(*) FILTER (x > 0.5) AS n_upper
        FROM ({ROUNDED.format(cells=SCALED.format(cells=WITH_CONSTANT))}) GROUP BY pos""",
    "zero_guard": ROUNDED.format(cells=BLANKED),
    "nonzero_counts": f"SELECT vec_id, CAST(count(*) FILTER (x <> 0) AS INTEGER) AS n_nonzero FROM ({BLANKED}) GROUP BY vec_id",
    "select_top_features": f"""
        SELECT vec_id, CAST(rk - 1 AS INTEGER) AS pos, x + 0.0 AS x FROM ({CUT_CELLS}) c
        JOIN (SELECT CAST(right(feature, 4) AS INTEGER) AS id, row_number() OVER (ORDER BY score DESC, feature) AS rk FROM ({VECTOR_GAIN_SQL})) t
          ON c.pos = t.id WHERE rk <= 12""",
    "select_top_five": f"""
        SELECT vec_id, CAST(rk - 1 AS INTEGER) AS pos, x + 0.0 AS x FROM ({CUT_CELLS}) c
        JOIN (SELECT CAST(right(feature, 4) AS INTEGER) AS id, row_number() OVER (ORDER BY score DESC, feature) AS rk FROM ({VECTOR_GAIN_SQL})) t
          ON c.pos = t.id WHERE rk <= 5""",
    "fallback_selection": f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, x + 0.0 AS x FROM ({CUT_CELLS}) WHERE pos < 5",
    "no_selected_feature": "SELECT vec_id, CAST(0 AS INTEGER) AS pos, CAST(0 AS DOUBLE) AS x FROM embeddings",
    "stratified_folds": folds_sql("embeddings", "label", "vec_id"),
    "stratified_folds_many_classes": folds_sql("orders", "o_custkey", "o_orderkey"),
    "stratified_folds_unbalanced": folds_sql("labels", "quality", "doc_id"),
    "holdout_split": """
        SELECT doc_id, CAST(CAST('0x' || left(md5('42:' || doc_id), 8) AS BIGINT) % 10 >= 7 AS INTEGER) AS is_test FROM documents""",
}
