"""The given tables in the shapes the operators take, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TEXT_FEATURES = ["l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_suppkey"]
NUMBER_FEATURES = TEXT_FEATURES[1:]
CLASS = "l_returnflag"

QUANTISED = "list_transform(embedding, lambda x: CAST(floor(x * 8) AS INTEGER))"
THIRD_SQL = "CAST(CAST(embedding[1] AS DOUBLE) + embedding[2] - embedding[3] > 0 AS INTEGER) + CAST(CAST(embedding[1] AS DOUBLE) - embedding[2] + embedding[4] > 0 AS INTEGER)"
SIDE_SQL = "CAST(CAST(embedding[1] AS DOUBLE) + embedding[2] - embedding[3] > 0 AS INTEGER)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str, columns: Sequence[str] = TEXT_FEATURES) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*columns, CLASS)


def side(vector: Column) -> Column:
    """A two-class label that the vector determines."""
    v = vector.cast("array<double>")
    return (v[0] + v[1] - v[2] > 0).cast("int")


def third(vector: Column) -> Column:
    """A three-class label that the vector determines."""
    v = vector.cast("array<double>")
    return (v[0] + v[1] - v[2] > 0).cast("int") + (v[0] - v[1] + v[3] > 0).cast("int")


def vectors(spark: SparkSession, sf_dir: str, label: Callable[[Column], Column] = side) -> DataFrame:
    """``vec_id, features, label`` with a label that the vector determines, of two classes unless another is given."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("features"), label(F.col("embedding")).alias("label"))


def quantised(spark: SparkSession, sf_dir: str, two_classes: bool = False) -> DataFrame:
    """``vec_id, features, label`` with elements cut to eighths."""
    rows = table(spark, sf_dir, "embeddings")
    cut = F.transform("embedding", lambda x: F.floor(x.cast("double") * 8).cast("double"))
    label = side(F.col("embedding")) if two_classes else F.col("label")
    return rows.select("vec_id", cut.alias("features"), label.alias("label"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")


# ---- SQL ---------------------------------------------------------------------------


def cells_sql(columns: Sequence[str], keep: str = "{c}", numeric: bool = False, source: str = "lineitem") -> str:
    """Melted cells of ``source`` as a query; ``keep`` is the value of column ``{c}``."""
    kind = "DOUBLE" if numeric else "VARCHAR"
    parts = [
        f"SELECT {i} AS feature_id, '{c}' AS feature, CAST({keep.format(c=c)} AS {kind}) AS value, {CLASS} AS cls FROM {source}"
        for i, c in enumerate(columns)
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


VECTOR_CELLS_SQL = (
    "SELECT u.pos - 1 AS feature_id, printf('feature_%04d', u.pos - 1) AS feature, "
    f"({QUANTISED})[u.pos] AS value, label AS cls "
    "FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) u"
)


def gain_sql(cells: str, labels: str) -> str:
    """``feature, n_cells, score`` by the textbook formula; ``labels`` yields column ``y``."""
    return f"""
    WITH cells AS ({cells}), labels AS ({labels}),
    total AS (SELECT count(*) AS n FROM labels),
    h AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT count(*) * 1.0 / (SELECT n FROM total) AS p FROM labels GROUP BY y)),
    vc AS (SELECT feature, value, cls, count(*) AS c FROM cells GROUP BY feature, value, cls),
    v AS (SELECT feature, value, c, sum(c) OVER (PARTITION BY feature, value) AS n FROM vc),
    ce AS (SELECT feature, sum(c) AS cells_n, -sum(c * 1.0 / (SELECT n FROM total) * log2(c * 1.0 / n)) AS ce FROM v GROUP BY feature)
    SELECT feature, CAST(cells_n AS BIGINT) AS n_cells, round((SELECT h FROM h) - ce, 6) + 0.0 AS score FROM ce
    """


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))
    return df
