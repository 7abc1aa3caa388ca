"""The named classifiers and their cross-validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gainsieve.models import naive_bayes, neighbours
from gainsieve.models.boosting import BINS, boosted_prediction, fit_boosted_folds
from gainsieve.models.gradient import gradient_boosting
from gainsieve.models.kernels import kernel_svm
from gainsieve.models.logistic import logistic_regression
from gainsieve.models.perceptron import perceptron
from gainsieve.models.trees import decision_tree, random_forest
from gainsieve.operators.folds import FoldedTable

SEED = 42

# Predicts every tested row of a table: ``row_key, fold, label_index, prediction``.
FoldPredictor = Callable[[FoldedTable], DataFrame]

def ada_boost(rounds: int = 100, bins: int = BINS) -> FoldPredictor:
    """All folds are fitted in the same passes."""

    def predict(table: FoldedTable) -> DataFrame:
        classes = len(table.classes)
        stumps = fit_boosted_folds(table.df, classes, table.tested, rounds, bins)
        guesses = [F.when(F.col("fold") == f, boosted_prediction(s, classes, F.col("features"))) for f, s in zip(table.tested, stumps, strict=True)]
        return table.df.where(F.col("fold").isin(table.tested)).select("row_key", "fold", "label_index", F.coalesce(*guesses).alias("prediction"))

    return predict


# The two sets of classifiers, in report order.
SMALL_SET: dict[str, FoldPredictor] = {
    "Random Forest": random_forest(),
    "Decision Tree": decision_tree(),
    "KNN": neighbours.predict_folds,
    "Naive Bayes": naive_bayes.predict_folds,
    "SVM": kernel_svm("rbf"),
}
FULL_SET: dict[str, FoldPredictor] = {
    "Random Forest": random_forest(),
    "Gradient Boosting": gradient_boosting(),
    "AdaBoost": ada_boost(),
    "Decision Tree": decision_tree(),
    "KNN": neighbours.predict_folds,
    "Naive Bayes": naive_bayes.predict_folds,
    "SVM RBF": kernel_svm("rbf"),
    "SVM Poly": kernel_svm("poly"),
    "MLP": perceptron(),
    "Logistic Regression": logistic_regression(),
}


def fold_accuracies(predictions: DataFrame) -> DataFrame:
    """``fold, n_rows, accuracy``."""
    hit = (F.col("prediction") == F.col("label_index")).cast("int")
    return predictions.groupBy("fold").agg(F.count("*").alias("n_rows"), F.avg(hit).alias("accuracy"))


def accuracy_summary(accuracies: DataFrame) -> DataFrame:
    """One row: mean and population deviation over folds; a single fold deviates by 0."""
    return accuracies.agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("std"))
