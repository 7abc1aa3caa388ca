"""Reading and writing: JSON records, CSV tables, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gainsieve.functions.vectors import feature_names
from gainsieve.operators.ranking import labelled_text, melt_columns, rank_cells, rank_table, with_names
from gainsieve.operators.scaling import first_vector
from gainsieve.plans.prepare import balanced_lines, feature_table, prepare
from gainsieve.session import scratch_path
from gainsieve.sources.jsonl import parse_records, read_lines, record_counts, write_lines
from gainsieve.sources.scores import read_scores, write_scores
from gainsieve.sources.tables import feature_columns, read_cells, read_table, resolve_target, write_table
from registered.ranking import LABELS_SQL
from registered.tables import CLASS, TEXT_FEATURES, cells_sql, gain_sql, labelled_documents, lineitem, rounded, table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, value``: one JSON line per labelled document, with its whole text.

    Label and features are laid out in six ways by ``doc_id``; one of them has no label
    and one is no JSON.
    """
    rows = labelled_documents(spark, sf_dir)
    word = F.when(F.col("quality") == 0, "Benign").otherwise("packed")
    layout = F.col("doc_id") % 6
    named = F.array("n_chars", "doc_id", "toxic").alias("features")

    def line(*fields: Column) -> Column:
        return F.to_json(F.struct(*fields, F.col("text"), F.col("lang")))

    value = (
        F.when(layout == 0, line(F.col("quality").alias("label"), named))
        .when(layout == 1, line(named.alias("data"), word.alias("class")))
        .when(layout == 2, line(F.col("n_chars"), F.struct(F.col("quality").cast("string").alias("label")).alias("Label"), F.array("doc_id", "toxic").alias("pair")))
        .when(layout == 3, line(F.col("doc_id").alias("b"), (F.col("toxic") == 1).alias("a"), F.struct(word.alias("name")).alias("target")))
        .when(layout == 4, line(named))
        .otherwise(F.concat(line(F.col("quality").alias("label"), named), F.lit(" trailing")))
    )
    return rows.select("doc_id", value.alias("value"))


def q_label_from_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(records(spark, sf_dir), valid_only=False).select("doc_id", "label")


def q_features_from_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(records(spark, sf_dir), valid_only=False)
    return parsed.select("doc_id", F.posexplode("features").alias("pos", "x"))


def q_valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(records(spark, sf_dir))
    return parsed.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("widest"))


def q_rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_counts(records(spark, sf_dir))


def q_prepared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines to a balanced, scaled CSV table: the whole preparation, on records of one width."""
    source = scratch_path(spark, "records")
    write_lines(records(spark, sf_dir).where("doc_id % 6 < 2").orderBy("doc_id"), source)
    made = prepare(spark, source, scratch_path(spark, "sample"), scratch_path(spark, "table"), n=30)
    return rounded(made, *feature_names(3))


def q_csv_cells_across_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with their line breaks, through a CSV file."""
    path = scratch_path(spark, "texts")
    write_table(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    back = read_table(spark, path, multi_line=True)
    return back.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.md5("text").alias("digest"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "records")
    write_lines(records(spark, sf_dir).orderBy("doc_id"), path)
    return path


def q_jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(read_lines(spark, _written(spark, sf_dir)))
    document = F.from_json("value", "text string, lang string")
    return parsed.select(document["lang"].alias("lang"), "label", F.length(document["text"]).alias("n_text")).groupBy(
        "lang", "label"
    ).agg(F.count("*").alias("n"), F.sum("n_text").cast("bigint").alias("n_text"))


def q_balanced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the first thirty valid lines of each class, by their place in the file, are."""
    sample = balanced_lines(spark, _written(spark, sf_dir), 30)
    return sample.select("label", "value").join(records(spark, sf_dir), "value").select("doc_id", "label")


def q_first_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width that the first valid record sets."""
    return first_vector(parse_records(records(spark, sf_dir)), ["doc_id"])


def q_prepared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of unequal width as one scaled table."""
    parsed = parse_records(records(spark, sf_dir)).select("doc_id", "features", "label")
    prepared, _ = feature_table(parsed, ["doc_id"])
    return rounded(prepared.select("doc_id", "label", F.posexplode("features").alias("pos", "x")), "x")


def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders")
    wanted = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    write_table(table(spark, sf_dir, "orders").select(*wanted), path)
    back = read_table(spark, path)
    return back.select(
        F.col("o_orderkey").try_cast("bigint").alias("o_orderkey"),
        "o_orderstatus",
        F.round(F.col("o_totalprice").try_cast("double"), 2).alias("o_totalprice"),
        "o_orderpriority",
    )


def q_csv_quoted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with commas and quotes survive the round trip."""
    path = scratch_path(spark, "quoted")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('a, "b" '), "props").alias("note"))
    write_table(rows, path)
    return read_table(spark, path).select(F.col("event_id").try_cast("bigint").alias("event_id"), "note")


def q_csv_info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From CSV to scores: the target is found by name, cells are text."""
    path = scratch_path(spark, "lineitem")
    renamed = lineitem(spark, sf_dir).withColumnRenamed(CLASS, "Class")
    write_table(renamed.select("Class", *TEXT_FEATURES), path)
    return rounded(rank_cells(read_cells(spark, path)).select("feature", "n_cells", "score"), "score")


def q_csv_numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells that are no number are skipped."""
    path = scratch_path(spark, "cells")
    cell = F.when(F.col("event_id") % 3 == 0, F.format_number("value", 2)).otherwise(F.col("value").cast("string"))
    rows = table(spark, sf_dir, "events").select(cell.alias("value"), "event_type", (F.col("user_id") % 4).alias("target"))
    write_table(rows, path)
    back = read_table(spark, path)
    target = resolve_target(back.columns)
    columns = feature_columns(back.columns, target)
    cells = with_names(melt_columns(labelled_text(back, target, numeric=True), columns, numeric=True), columns)
    return cells.groupBy("feature", "cls").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def q_score_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scores")
    write_scores(rank_table(lineitem(spark, sf_dir), CLASS), path)
    return rounded(read_scores(spark, path), "score")


def q_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, written and read as they are: blank ones are left out."""
    path = scratch_path(spark, "blank")
    write_lines(table(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "[\\r\\n]")).alias("value")), path)
    return read_lines(spark, path).agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


def q_usable_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain against a target that is empty or a repeated header in some rows, which do not count."""
    line = F.col("l_linenumber")
    label = F.when(line == 1, "  ").when(line == 2, " LABEL ").when(line == 3, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col(CLASS)))
    rows = table(spark, sf_dir, "lineitem").select(*TEXT_FEATURES, label.alias("Target"))
    return rounded(rank_table(rows).select("feature", "n_cells", "score"), "score")


def q_cells_past_the_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines longer than their header lose the rest, shorter ones lack cells."""
    path = scratch_path(spark, "ragged")
    line = F.concat_ws(",", "l_orderkey", F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")), F.when(F.col("l_linenumber") > 2, F.lit("more")))
    lines = table(spark, sf_dir, "lineitem").select(line.alias("orderkey,flag"))
    lines.write.options(header=True, sep="\x1f", quote="").csv(path)
    cells = read_cells(spark, path).df.select(F.size("cells").alias("n_cells"), F.get("cells", F.lit(1)).alias("flag"))
    return cells.groupBy("n_cells", "flag").agg(F.count("*").alias("n"))


def q_well_formed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score lines with a name and a number are read, others are left out."""
    path = scratch_path(spark, "score-lines")
    line, name = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    text = F.when(line == 1, name).when(line == 2, F.concat_ws("\t", name, "l_returnflag")).when(line == 3, F.concat_ws("\t", name, "l_linenumber", "l_linenumber"))
    write_lines(table(spark, sf_dir, "lineitem").select(text.otherwise(F.concat_ws("\t", name, "l_suppkey")).alias("value")), path)
    return read_scores(spark, path).agg(F.count("*").alias("n"), F.sum("score").cast("bigint").alias("total"))


QUERIES = {
    "blank_lines": q_blank_lines,
    "usable_targets": q_usable_targets,
    "cells_past_the_header": q_cells_past_the_header,
    "well_formed_scores": q_well_formed_scores,
    "label_from_record": q_label_from_record,
    "features_from_record": q_features_from_record,
    "valid_records": q_valid_records,
    "rejected_records": q_rejected_records,
    "prepared_table": q_prepared_table,
    "csv_cells_across_lines": q_csv_cells_across_lines,
    "jsonl_round_trip": q_jsonl_round_trip,
    "balanced_lines": q_balanced_lines,
    "first_width": q_first_width,
    "prepared_features": q_prepared_features,
    "csv_round_trip": q_csv_round_trip,
    "csv_quoted_text": q_csv_quoted_text,
    "csv_info_gain": q_csv_info_gain,
    "csv_numeric_cells": q_csv_numeric_cells,
    "score_tsv_round_trip": q_score_tsv_round_trip,
}

DOCS = "SELECT * FROM labels JOIN documents USING (doc_id)"
FEATURES_SQL = f"""
    SELECT doc_id, quality, CASE doc_id % 6
        WHEN 3 THEN [CAST(doc_id AS DOUBLE), CAST(toxic AS DOUBLE)]
        ELSE [CAST(n_chars AS DOUBLE), CAST(doc_id AS DOUBLE), CAST(toxic AS DOUBLE)] END AS v
    FROM ({DOCS}) WHERE doc_id % 6 <> 5
"""
PREPARED_SQL = f"""
    WITH r AS (SELECT doc_id, quality, v FROM ({FEATURES_SQL}) WHERE doc_id % 6 <> 4),
    w AS (SELECT len(v) AS w, len(list_filter(v, lambda x: x <> 0)) AS nz FROM r ORDER BY doc_id LIMIT 1),
    c AS (SELECT doc_id, quality, u.pos - 1 AS pos, coalesce(v[u.pos], 0) AS x FROM r, (SELECT unnest(range(1, 4)) AS pos) u, w WHERE u.pos <= w.w),
    b AS (SELECT pos, min(x) AS low, max(x) AS high FROM c GROUP BY pos)
    SELECT doc_id, CAST(quality AS BIGINT) AS label, CAST(pos AS INTEGER) AS pos,
           round(CASE WHEN (SELECT nz FROM w) = 0 THEN x WHEN high > low THEN (x - low) / (high - low) ELSE 0 END, 6) + 0.0 AS x
    FROM c JOIN b USING (pos)
"""

SCALED_COLUMNS = ", ".join(
    f"round(CASE WHEN max(v[{i}]) OVER () > min(v[{i}]) OVER () THEN (v[{i}] - min(v[{i}]) OVER ()) * 1.0 / (max(v[{i}]) OVER () - min(v[{i}]) OVER ()) ELSE 0 END, 6) + 0.0 AS feature_{i - 1:04d}"
    for i in (1, 2, 3)
)

ORACLES = {
    "blank_lines": r"""
        SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
        FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[\r\n]')) AS line FROM documents) WHERE regexp_matches(line, '\S')""",
    "usable_targets": gain_sql(cells_sql(TEXT_FEATURES, source="(SELECT * FROM lineitem WHERE l_linenumber > 3)"), "SELECT l_returnflag AS y FROM lineitem WHERE l_linenumber > 3"),
    "cells_past_the_header": """
        SELECT least(l_linenumber, 2) AS n_cells, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS flag, count(*) AS n FROM lineitem GROUP BY ALL""",
    "well_formed_scores": "SELECT count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS total FROM lineitem WHERE l_linenumber > 3",
    "label_from_record": f"""
        SELECT doc_id, CASE WHEN doc_id % 6 <> 4 THEN CAST(quality AS BIGINT) END AS label FROM ({DOCS}) WHERE doc_id % 6 <> 5""",
    "features_from_record": f"""
        SELECT doc_id, CAST(u.pos - 1 AS INTEGER) AS pos, v[u.pos] AS x FROM ({FEATURES_SQL}), (SELECT unnest(range(1, 4)) AS pos) u
        WHERE u.pos <= len(v)""",
    "valid_records": f"""
        SELECT CAST(quality AS BIGINT) AS label, count(*) AS n, CAST(max(len(v)) AS INTEGER) AS widest
        FROM ({FEATURES_SQL}) WHERE doc_id % 6 <> 4 GROUP BY quality""",
    "rejected_records": f"""
        SELECT count(*) AS n_lines, count(*) FILTER (doc_id % 6 NOT IN (4, 5)) AS n_valid,
               count(*) FILTER (doc_id % 6 IN (4, 5)) AS n_rejected FROM ({DOCS})""",
    "prepared_table": f"""
        WITH f AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS place FROM ({FEATURES_SQL}) WHERE doc_id % 6 < 2),
        s AS (SELECT * FROM f WHERE place <= 30)
        SELECT {SCALED_COLUMNS}, CAST(quality AS BIGINT) AS label FROM s""",
    "csv_cells_across_lines": "SELECT doc_id, md5(text) AS digest FROM documents",
    "jsonl_round_trip": f"""
        SELECT lang, CAST(quality AS BIGINT) AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_text
        FROM ({DOCS}) WHERE doc_id % 6 NOT IN (4, 5) GROUP BY lang, quality""",
    "balanced_lines": f"""
        SELECT doc_id, CAST(quality AS BIGINT) AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS place FROM ({DOCS}) WHERE doc_id % 6 NOT IN (4, 5)) WHERE place <= 30""",
    "first_width": f"""
        SELECT CAST(len(v) AS INTEGER) AS width, CAST(len(list_filter(v, lambda x: x <> 0)) AS INTEGER) AS nonzero
        FROM ({FEATURES_SQL}) WHERE doc_id % 6 <> 4 ORDER BY doc_id LIMIT 1""",
    "prepared_features": PREPARED_SQL,
    "csv_round_trip": "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority FROM orders",
    "csv_quoted_text": """SELECT event_id, 'a, "b" ' || props AS note FROM events""",
    "csv_info_gain": gain_sql(cells_sql(TEXT_FEATURES), LABELS_SQL),
    "csv_numeric_cells": """
        SELECT 'value' AS feature, user_id % 4 AS cls, count(*) AS n, round(sum(value), 3) AS total
        FROM events WHERE event_id % 3 <> 0 OR round(value, 2) < 1000 GROUP BY user_id % 4""",
    "score_tsv_round_trip": f"SELECT feature, score FROM ({gain_sql(cells_sql(TEXT_FEATURES), LABELS_SQL)})",
}
