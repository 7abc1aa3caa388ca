"""Information gain of every feature against the label."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gainsieve.functions.entropy import entropy_from_sums, n_log_n
from gainsieve.functions.text import is_target_text, numeric_target, short_name, stripped, text_to_double, whole_label
from gainsieve.functions.vectors import feature_name
from gainsieve.operators.profile import ClassProfile, class_profile
from gainsieve.operators.selection import FEATURES_KEPT
from gainsieve.sources.tables import CellTable, feature_columns, reject_duplicates, resolve_target

# Up to this many classes the counts of one value stand side by side in one row.
MAX_SIDE_BY_SIDE = 16

# Digits at which two scores count as equal and the feature order decides.
TIE_DIGITS = 12


# ---- cells -------------------------------------------------------------------------


def labelled_text(df: DataFrame, target: str, numeric: bool = False) -> DataFrame:
    """Rows with a usable target, which becomes ``label``; ``numeric`` reads it as a number."""
    cell = F.col(f"`{target}`")
    if isinstance(df.schema[target].dataType, T.StringType):
        label = _text_label(cell, numeric)
    else:
        label = whole_label(cell.try_cast("double")) if numeric else cell.cast("string")
    others = [F.col(f"`{c}`") for c in feature_columns(df.columns, target)]
    return df.select(*others, label.alias("label")).where("label IS NOT NULL")


def _text_label(cell: Column, numeric: bool) -> Column:
    """A usable target text, null for an empty one and for a repeated header."""
    return numeric_target(cell) if numeric else F.when(is_target_text(cell), stripped(cell))


def melt_columns(
    df: DataFrame, columns: Sequence[str], label: str = "label", numeric: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """``feature_id, value, cls`` of every filled cell; ids are places in ``columns``.

    The columns go through one array: a melt by ``unpivot`` plans one projection per
    column, which is slow for many of them. For thousands of columns see ``rank_cells``.
    """
    reject_duplicates(columns)
    kinds = [df.schema[c].dataType for c in columns]
    if all(isinstance(kind, T.StringType) for kind in kinds):
        values = F.array(*[F.col(f"`{c}`") for c in columns])
        return _parsed(_melted(df.select(*keep, label, values.alias("_values")), label, keep), numeric)
    values = F.array(*[_category(F.col(f"`{c}`"), kind, numeric) for c, kind in zip(columns, kinds)])
    cells = _melted(df.select(*keep, label, values.alias("_values")), label, keep)
    return cells.where("value IS NOT NULL" if numeric else "value <> ''")


def _category(cell: Column, kind: T.DataType, numeric: bool) -> Column:
    """A cell as text or number; a typed column needs no parsing."""
    if numeric:
        return cell.cast("double") if isinstance(kind, T.NumericType) else text_to_double(cell.cast("string"))
    return stripped(cell) if isinstance(kind, T.StringType) else cell.cast("string")


def _melted(rows: DataFrame, label: str, keep: Sequence[str] = ()) -> DataFrame:
    return rows.select(*keep, F.col(label).alias("cls"), F.posexplode("_values").alias("feature_id", "value"))


def _parsed(cells: DataFrame, numeric: bool) -> DataFrame:
    """Text cells as categories, missing ones left out.

    Parsing after the melt is one compiled expression, however many columns there are.
    """
    if numeric:
        return cells.withColumn("value", text_to_double(F.col("value"))).where("value IS NOT NULL")
    return cells.withColumn("value", stripped(F.col("value"))).where("value <> ''")


def labelled_cells(table: CellTable, place: int, numeric: bool = False) -> DataFrame:
    """``cells, label`` of the rows whose cell at ``place`` is a usable target."""
    label = _text_label(F.get("cells", F.lit(place)), numeric)
    return table.df.select("cells", label.alias("label")).where("label IS NOT NULL")


def melt_cells(rows: DataFrame, place: int, width: int, numeric: bool = False) -> DataFrame:
    """Filled cells but the target at ``place``; ids are places among the other columns."""
    others = F.concat(F.slice("cells", 1, place), F.slice("cells", place + 2, width))
    return _parsed(_melted(rows.select("label", others.alias("_values")), "label"), numeric)


def melt_vector(
    df: DataFrame, vector: str = "features", label: str = "label", keep: Sequence[str] = ()
) -> DataFrame:
    """The same for vectors; ids are positions."""
    return _melted(df.select(*keep, label, F.col(vector).alias("_values")), label, keep).where("value IS NOT NULL")


# ---- counts ------------------------------------------------------------------------


def contingency(cells: DataFrame) -> DataFrame:
    """Rows per feature, value and class, counted before and after the shuffle."""
    return cells.groupBy("feature_id", "value", "cls").agg(F.count("*").alias("n"))


def _value_spread(cells: DataFrame, profile: ClassProfile) -> DataFrame:
    """Per feature and value: rows ``n``, and ``n log n`` less that of its classes.

    With few classes their counts stand side by side (``c0``, ``c1``, ...), so the cells
    are shuffled once; with many, the classes are a key and take a second shuffle. Either
    way a task sends one row per key, whatever share of the rows the key has.
    """
    counts = profile.counts
    if counts is not None and len(counts) <= MAX_SIDE_BY_SIDE:
        sides = [f"c{i}" for i in range(len(counts))]
        values = cells.groupBy("feature_id", "value").agg(
            *[F.count_if(F.col("cls") == F.lit(c)).alias(side) for c, side in zip(profile.classes, sides)]
        )
        total = sum((F.col(c) for c in sides), F.lit(0))
        within = sum((n_log_n(F.col(c)) for c in sides), F.lit(0.0))
        return values.select(
            "feature_id", "value", total.alias("n"), *sides, (n_log_n(total) - within).alias("spread")
        )
    values = contingency(cells).groupBy("feature_id", "value").agg(
        F.sum("n").alias("n"), F.sum(n_log_n(F.col("n"))).alias("within")
    )
    return values.select("feature_id", "value", "n", (n_log_n(F.col("n")) - F.col("within")).alias("spread"))


def conditional_entropy(cells: DataFrame, profile: ClassProfile) -> DataFrame:
    """Entropy of the label given each feature, weighted by the share of all labelled rows.

    Rows where the feature is missing add nothing, though they count in the total.
    """
    features = _value_spread(cells, profile).groupBy("feature_id").agg(
        F.sum("n").alias("n_cells"), F.sum("spread").alias("spread")
    )
    return features.select(
        "feature_id", "n_cells", (F.col("spread") / F.lit(float(profile.total))).alias("conditional_entropy")
    )


# ---- scores ------------------------------------------------------------------------


def information_gain(cells: DataFrame, profile: ClassProfile) -> DataFrame:
    """``feature_id, n_cells, score``: label entropy less conditional entropy.

    ``profile`` is of all labelled rows, so a sparsely filled feature scores higher.
    """
    return conditional_entropy(cells, profile).select(
        "feature_id", "n_cells", (F.lit(profile.entropy) - F.col("conditional_entropy")).alias("score")
    )


def one_pool(feature_id: Column) -> Column:
    return F.lit(0)


def pooled_gain(
    cells: DataFrame, profile: ClassProfile, pool: Callable[[Column], Column] = one_pool
) -> DataFrame:
    """Gain with total and label entropy taken over all cells of a pool of features.

    Scores of different pools are not comparable; ``information_gain`` is the measure to
    use, this one is for comparison with results that were made this way.
    """
    counts = profile.counts
    if counts is not None and len(counts) <= MAX_SIDE_BY_SIDE:
        # The window runs over features, not rows: its groups are no larger than the schema.
        sides = [f"c{i}" for i in range(len(counts))]
        features = (
            _value_spread(cells, profile)
            .groupBy("feature_id")
            .agg(*[F.sum(c).alias(c) for c in ["n", "spread", *sides]])
            .withColumn("pool", pool(F.col("feature_id")))
        )
        whole = Window.partitionBy("pool")
        total = F.sum("n").over(whole)
        by_class = sum((n_log_n(F.sum(c).over(whole)) for c in sides), F.lit(0.0))
        scored = features.select(
            "pool", "feature_id", F.col("n").alias("n_cells"), "spread", total.alias("t"), by_class.alias("s")
        )
    else:
        features = (
            _value_spread(cells, profile)
            .groupBy("feature_id")
            .agg(F.sum("n").alias("n_cells"), F.sum("spread").alias("spread"))
            .withColumn("pool", pool(F.col("feature_id")))
        )
        pools = (
            cells.groupBy(pool(F.col("feature_id")).alias("pool"), "cls")
            .agg(F.count("*").alias("n"))
            .groupBy("pool")
            .agg(F.sum("n").alias("t"), F.sum(n_log_n(F.col("n"))).alias("s"))
        )
        scored = features.join(pools, "pool")
    score = entropy_from_sums(F.col("t"), F.col("s")) - F.col("spread") / F.col("t")
    return scored.select("pool", "feature_id", "n_cells", score.alias("score"))


def training_profiles(df: DataFrame, folds: Iterable[int], label: str = "label") -> dict[int, ClassProfile]:
    """Total and label entropy of the rows outside each fold: one row reaches the driver."""
    folds = list(folds)
    outside = [F.count_if(F.col("fold") != f).alias(f"n{f}") for f in folds]
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(*outside)
    totals = [F.coalesce(F.sum(f"n{f}"), F.lit(0)).alias(f"t{f}") for f in folds]
    sums = [F.coalesce(F.sum(n_log_n(F.col(f"n{f}"))), F.lit(0.0)).alias(f"s{f}") for f in folds]
    entropies = [entropy_from_sums(F.col(f"t{f}"), F.col(f"s{f}")).alias(f"h{f}") for f in folds]
    row = per_class.agg(*totals, *sums).select(*[f"t{f}" for f in folds], *entropies).first()
    return {f: ClassProfile(row[f"t{f}"], row[f"h{f}"], None) for f in folds}


def fold_gain(cells: DataFrame, profiles: Mapping[int, ClassProfile]) -> DataFrame:
    """``fold, feature_id, score``: the gain of each feature on the rows outside the fold.

    ``cells`` carries ``fold``. All folds come from one aggregation, with the counts of
    the training sets side by side.
    """
    folds = sorted(profiles)
    per_class = cells.groupBy("feature_id", "value", "cls").agg(
        *[F.count_if(F.col("fold") != f).alias(f"c{f}") for f in folds]
    )
    per_value = per_class.groupBy("feature_id", "value").agg(
        *[F.sum(f"c{f}").alias(f"n{f}") for f in folds],
        *[F.sum(n_log_n(F.col(f"c{f}"))).alias(f"s{f}") for f in folds],
    )
    features = per_value.groupBy("feature_id").agg(
        *[F.sum(f"n{f}").alias(f"n{f}") for f in folds],
        *[F.sum(n_log_n(F.col(f"n{f}")) - F.col(f"s{f}")).alias(f"spread{f}") for f in folds],
    )
    as_rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("fold"),
                F.col(f"n{f}").alias("n_cells"),
                (F.lit(profiles[f].entropy) - F.col(f"spread{f}") / F.lit(float(profiles[f].total))).alias("score"),
            )
            for f in folds
        ]
    )
    return features.select("feature_id", F.inline(as_rows)).where("n_cells > 0")


# ---- order and display -------------------------------------------------------------


def top_features(scores: DataFrame, k: int = FEATURES_KEPT, tie: str = "feature") -> DataFrame:
    """The ``k`` highest scores with their rank; equal scores rank by ``tie``."""
    best_first = [F.round("score", TIE_DIGITS).desc(), F.col(tie).asc()]
    kept = scores.orderBy(*best_first).limit(k)
    # k rows at most reach this window.
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*best_first)))


def display_scores(ranked: DataFrame, decimals: int = 6) -> DataFrame:
    return ranked.select(
        "rank",
        short_name(F.col("feature")).alias("feature"),
        F.format_number("score", decimals).alias("score"),
    )


# ---- whole rankings ----------------------------------------------------------------


def with_names(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``feature``, after the aggregation so that names are not shuffled with the cells."""
    return scores.withColumn("feature", F.get(F.array(*[F.lit(n) for n in names]), F.col("feature_id")))


def rank_table(df: DataFrame, target: str | None = None, numeric: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """``feature_id, feature, n_cells, score`` of the columns of a table.

    Cells are categories as trimmed text, or as numbers with ``numeric``, where
    ``0``, ``0.0`` and ``0.00`` are one. Raises ``ValueError`` without a labelled row.
    """
    target = target or resolve_target(df.columns)
    columns = list(columns) if columns is not None else feature_columns(df.columns, target)
    rows = labelled_text(df.select(*[f"`{c}`" for c in columns], f"`{target}`"), target, numeric)
    profile = class_profile(rows)
    return with_names(information_gain(melt_columns(rows, columns, numeric=numeric), profile), columns)


def cell_sums(rows: DataFrame, place: int, width: int, numeric: bool = False) -> DataFrame:
    """``feature_id, n_cells, spread`` of ``cells, label`` in one reading; ``spread`` is cells times conditional entropy.

    Every row brings one cell more, of feature -1 and always of one value: its cells are the
    labelled rows, and its conditional entropy is the entropy of the label.
    """
    others = F.concat(F.array(F.lit("0")), F.slice("cells", 1, place), F.slice("cells", place + 2, width))
    counts = contingency(_parsed(_melted(rows.select("label", others.alias("_values")), "label"), numeric))
    values = counts.groupBy("feature_id", "value").agg(F.sum("n").alias("n"), F.sum(n_log_n(F.col("n"))).alias("s"))
    sums = values.groupBy("feature_id").agg(F.sum("n").alias("n_cells"), F.sum(n_log_n(F.col("n")) - F.col("s")).alias("spread"))
    return sums.withColumn("feature_id", F.col("feature_id") - 1)


def rank_cells(table: CellTable, target: str | None = None, numeric: bool = False) -> DataFrame:
    """The same for a CSV table read as cells; the text is read and parsed once."""
    target = target or resolve_target(table.columns)
    place = table.columns.index(target)
    # A row for each column of the table comes to the driver.
    sums = cell_sums(labelled_cells(table, place, numeric), place, len(table.columns), numeric)
    found = {r["feature_id"]: (r["n_cells"], r["spread"]) for r in sums.collect()}
    if -1 not in found:
        raise ValueError("no row with a valid label")
    rows, whole = found.pop(-1)
    scores = [(f, n, (whole - spread) / rows) for f, (n, spread) in sorted(found.items())]
    scored = sums.sparkSession.createDataFrame(scores, "feature_id int, n_cells long, score double")
    return with_names(scored, feature_columns(table.columns, target))


def rank_vectors(df: DataFrame, vector: str = "features", label: str = "label") -> DataFrame:
    """The same for the elements of a vector column, named by position."""
    rows = df.where(F.col(label).isNotNull())
    scores = information_gain(melt_vector(rows, vector, label), class_profile(rows, label))
    return scores.withColumn("feature", feature_name(F.col("feature_id")))
