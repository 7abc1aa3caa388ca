"""Cross-validation queries on ``embeddings`` with a label that the vectors determine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsieve.models import boosting, gradient, kernels, logistic, naive_bayes, neighbours, perceptron
from gainsieve.models import classifiers as C
from gainsieve.models.evaluation import evaluate_vectors
from gainsieve.operators.folds import FoldedTable, folded_table
from gainsieve.plans.experiment import evaluate_within_folds, rank_and_evaluate
from gainsieve.session import materialise
from registered.ranking import folds_sql
from registered.tables import QUANTISED, SIDE_SQL, THIRD_SQL, gain_sql, quantised, rounded, table, third, vectors

def _folds(spark: SparkSession, sf_dir: str, hold_out: bool = False) -> FoldedTable:
    """The folded vectors, written out once for the many passes of a fit."""
    placed = folded_table(vectors(spark, sf_dir), "vec_id", hold_out=hold_out)
    return replace(placed, df=materialise(placed.df))


def _three_classes(spark: SparkSession, sf_dir: str) -> FoldedTable:
    placed = folded_table(vectors(spark, sf_dir, third), "vec_id")
    return replace(placed, df=materialise(placed.df))


def _predictions(predicted: DataFrame) -> DataFrame:
    return predicted.select(F.col("row_key").alias("vec_id"), "fold", F.col("label_index").alias("label"), F.col("prediction").cast("int"))


def q_gaussian_nb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(naive_bayes.predict_folds(_folds(spark, sf_dir)))


def q_knn_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(neighbours.predict_folds(_folds(spark, sf_dir)))


def q_decision_tree_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(C.decision_tree()(_folds(spark, sf_dir)))


def _accuracies(predict: C.FoldPredictor) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(C.fold_accuracies(predict(_folds(spark, sf_dir))), "accuracy")

    return query


def q_gradient_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the first tree of every fold and class, three classes: their place in the tree and their value."""
    folded = _three_classes(spark, sf_dir)
    out = []
    for fold, model in zip(folded.tested, gradient.fit_folds(folded, rounds=1), strict=True):
        for cls, tree in enumerate(model.rounds[0]):
            waiting = [(0, 1)]
            while waiting:
                node, place = waiting.pop()
                if tree.feature[node] < 0:
                    out.append((fold, cls, place, float(tree.value[node][0])))
                else:
                    waiting += [(tree.left[node], 2 * place), (tree.right[node], 2 * place + 1)]
    return rounded(spark.createDataFrame(out, "fold int, cls int, leaf long, value double"), "value")


def q_gradient_three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees with three classes beat the commonest."""
    return _above_majority(gradient.gradient_boosting()(_three_classes(spark, sf_dir)))


def _svm_optimality(kernel: str) -> Callable[[SparkSession, str], DataFrame]:
    """Whether the machine of every fold is feasible and optimal: balanced multipliers within 0 and 1, no violation, no gap."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = kernels.optimality(kernels.fit_folds(_folds(spark, sf_dir), kernel))
        gap = (F.col("primal") - F.col("dual")) / F.col("dual")
        feasible = (F.col("least") >= 0) & (F.col("greatest") <= kernels.PENALTY)
        return rounded(found.select("fold", "n_rows", F.col("balance"), feasible.alias("feasible"), (F.col("violation") <= kernels.TOLERANCE).alias("optimal"), (gap < 0.01).alias("gap_closed")), "balance")

    return query


def q_logistic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every fold, the intercept last, and the largest element of the gradient, both to 4 digits."""
    fits = logistic.fit_folds(_folds(spark, sf_dir))
    out = [(f, pos, float(w), float(abs(g))) for f, fit in fits.items() for pos, (w, g) in enumerate(zip(fit.w[0], fit.gradient[0], strict=True))]
    return rounded(spark.createDataFrame(out, "fold int, pos int, weight double, gradient double"), "weight", "gradient", digits=4)


def q_ada_boost_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three stumps of every fold."""
    folded = _folds(spark, sf_dir)
    found = boosting.fit_boosted_folds(folded.df, 2, folded.tested, rounds=3)
    out = [(f, n, s.feature, s.threshold, s.below, s.above, s.weight) for f, stumps in zip(folded.tested, found, strict=True) for n, s in enumerate(stumps)]
    return rounded(spark.createDataFrame(out, "fold int, round int, feature int, threshold double, below int, above int, weight double"), "threshold", "weight")


def q_mlp_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the perceptron of every fold stopped ten rounds after its best, before the last round allowed."""
    fits = perceptron.fit_folds(_folds(spark, sf_dir))
    out = [(f, fit.waited == perceptron.PATIENCE, fit.rounds < perceptron.MOST_ROUNDS) for f, fit in fits.items()]
    return spark.createDataFrame(out, "fold int, waited boolean, early boolean")


def _above_majority(predicted: DataFrame) -> DataFrame:
    """Fold sizes, the share of the fold's commonest label, and whether the accuracy is above it."""
    hit = F.avg((F.col("prediction") == F.col("label_index")).cast("int"))
    sizes = predicted.groupBy("fold", "label_index").agg(F.count("*").alias("n")).groupBy("fold").agg(F.sum("n").alias("n_rows"), F.max("n").alias("most"))
    per_fold = predicted.groupBy("fold").agg(F.countDistinct("row_key").alias("n_keys"), hit.alias("accuracy")).join(sizes, "fold")
    share = F.col("most") / F.col("n_rows")
    return rounded(per_fold.select("fold", "n_rows", "n_keys", share.alias("majority"), (F.col("accuracy") > share).alias("beats_majority")), "majority")


def _beats_majority(predict: C.FoldPredictor) -> Callable[[SparkSession, str], DataFrame]:
    """Fold sizes, the share of the fold's commonest label, and whether the accuracy is above it.

    The models differ in detail from any SQL; that they predict every tested row once and
    better than a constant does not.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _above_majority(predict(_folds(spark, sf_dir)))

    return query


def q_accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the fold accuracies of naive Bayes."""
    predicted = naive_bayes.predict_folds(_folds(spark, sf_dir))
    return rounded(C.accuracy_summary(C.fold_accuracies(predicted)), "accuracy", "std")


def q_holdout_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes on the 70/30 split."""
    predicted = naive_bayes.predict_folds(_folds(spark, sf_dir, hold_out=True))
    return rounded(C.accuracy_summary(C.fold_accuracies(predicted)), "accuracy", "std")


def q_rank_select_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: rank, keep twenty features, evaluate the two classifiers that SQL can follow."""
    exact = {name: C.FULL_SET[name] for name in ["Naive Bayes", "KNN"]}
    _, results = rank_and_evaluate(quantised(spark, sf_dir, two_classes=True), "vec_id", exact, k=20)
    return rounded(results, "accuracy", "std")


def q_rank_select_small_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published set of five classifiers after the ranking: which succeed and beat the commonest label."""
    rows = quantised(spark, sf_dir, two_classes=True)
    _, results = rank_and_evaluate(rows, "vec_id", C.SMALL_SET, k=20)
    share = rows.agg(F.avg(F.col("label").cast("double"))).first()[0]
    return results.select("classifier", "status", (F.col("accuracy") > max(share, 1 - share)).alias("beats_majority"))


def q_rank_select_full_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger published set of classifiers, those that have a distributed form, after the ranking."""
    rows = quantised(spark, sf_dir, two_classes=True)
    _, results = rank_and_evaluate(rows, "vec_id", C.FULL_SET, k=20)
    share = rows.agg(F.avg(F.col("label").cast("double"))).first()[0]
    return results.select("classifier", "status", (F.col("accuracy") > max(share, 1 - share)).alias("beats_majority"))


def q_too_few_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five regions are too few rows to judge a classifier on."""
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.array(F.col("r_regionkey").cast("double")).alias("features"), (F.col("r_regionkey") % 2).alias("label"))
    return evaluate_vectors(regions, C.SMALL_SET, "r_regionkey")


def q_select_within_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the features chosen anew for each fold."""
    exact = {name: C.FULL_SET[name] for name in ["Naive Bayes", "KNN"]}
    results = evaluate_within_folds(quantised(spark, sf_dir, two_classes=True), "vec_id", exact, k=20)
    return rounded(results, "accuracy", "std")


QUERIES = {
    "gaussian_nb_predictions": q_gaussian_nb_predictions,
    "gaussian_nb_cv": _accuracies(naive_bayes.predict_folds),
    "accuracy_summary": q_accuracy_summary,
    "holdout_accuracy": q_holdout_accuracy,
    "knn_predictions": q_knn_predictions,
    "knn_cv": _accuracies(neighbours.predict_folds),
    "random_forest_cv": _beats_majority(C.random_forest()),
    "decision_tree_predictions": q_decision_tree_predictions,
    "decision_tree_cv": _accuracies(C.decision_tree()),
    "gradient_boosting_cv": _beats_majority(C.gradient_boosting()),
    "gradient_boosting_three_classes": q_gradient_three_classes,
    "gradient_boosting_first_round": q_gradient_first_round,
    "ada_boost_cv": _beats_majority(C.ada_boost()),
    "ada_boost_stumps": q_ada_boost_stumps,
    "mlp_stopping": q_mlp_stopping,
    "mlp_cv": _beats_majority(C.perceptron()),
    "logistic_regression_cv": _accuracies(C.logistic_regression()),
    "logistic_regression_weights": q_logistic_weights,
    "svm_rbf_cv": _beats_majority(C.kernel_svm("rbf")),
    "svm_poly_cv": _beats_majority(C.kernel_svm("poly")),
    "svm_rbf_optimality": _svm_optimality("rbf"),
    "svm_poly_optimality": _svm_optimality("poly"),
    "rank_select_evaluate": q_rank_select_evaluate,
    "rank_select_small_set": q_rank_select_small_set,
    "rank_select_full_set": q_rank_select_full_set,
    "too_few_rows": q_too_few_rows,
    "select_within_folds": q_select_within_folds,
}

SOURCE = f"SELECT vec_id, {SIDE_SQL} AS y, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings"
FOLDED = f"""
    src AS ({SOURCE}),
    placed AS (SELECT src.vec_id, src.y, src.v, p.fold FROM src JOIN ({folds_sql('src', 'y', 'vec_id')}) p ON src.vec_id = p.vec_id)
"""
HELD_OUT = f"""
    src AS ({SOURCE}),
    placed AS (SELECT vec_id, y, v, CAST(CAST('0x' || left(md5('42:' || vec_id), 8) AS BIGINT) % 10 >= 7 AS INTEGER) AS fold FROM src)
"""


def _nb_sql(placed: str, tested: str, width: int = 64) -> str:
    return f"""
    WITH {placed},
    cells AS (SELECT vec_id, y, fold, u.pos, v[u.pos] AS x FROM placed, (SELECT unnest(range(1, {width + 1})) AS pos) u),
    t AS (SELECT unnest({tested}) AS f),
    g AS (SELECT f, y, pos, count(*) AS n, avg(x) AS m, var_pop(x) AS s FROM cells JOIN t ON cells.fold <> t.f GROUP BY f, y, pos),
    eps AS (SELECT f, 1e-9 * max(s) AS e FROM (SELECT f, pos, var_pop(x) AS s FROM cells JOIN t ON cells.fold <> t.f GROUP BY f, pos) GROUP BY f),
    prior AS (SELECT f, y, max(n) * 1.0 / sum(max(n)) OVER (PARTITION BY f) AS p FROM g GROUP BY f, y),
    ll AS (SELECT c.vec_id, c.fold, c.y, g.y AS guess,
                  sum(-0.5 * ln(2 * pi() * (g.s + eps.e)) - (c.x - g.m) * (c.x - g.m) / (2 * (g.s + eps.e))) AS l
           FROM cells c JOIN g ON g.f = c.fold AND g.pos = c.pos JOIN eps ON eps.f = c.fold GROUP BY ALL),
    ranked AS (SELECT ll.*, row_number() OVER (PARTITION BY vec_id ORDER BY l + ln(p) DESC, guess) AS place
               FROM ll JOIN prior ON prior.f = ll.fold AND prior.y = ll.guess),
    predicted AS (SELECT vec_id, CAST(fold AS INTEGER) AS fold, y AS label, guess AS prediction FROM ranked WHERE place = 1)
    """


KNN = f"""
    WITH {FOLDED},
    pairs AS (SELECT a.vec_id, a.fold, a.y, b.vec_id AS other, b.y AS vote,
                     round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d
              FROM placed a JOIN placed b ON a.fold <> b.fold),
    near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS place FROM pairs),
    votes AS (SELECT vec_id, fold, y, vote, count(*) AS n FROM near WHERE place <= 5 GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, vote) AS place FROM votes),
    predicted AS (SELECT vec_id, CAST(fold AS INTEGER) AS fold, y AS label, vote AS prediction FROM ranked WHERE place = 1)
"""
BY_FOLD = "SELECT fold, count(*) AS n_rows, round(avg(CAST(label = prediction AS INTEGER)), 6) + 0.0 AS accuracy FROM predicted GROUP BY fold"
SUMMARY = f"SELECT round(avg(a), 6) + 0.0 AS accuracy, round(stddev_pop(a), 6) + 0.0 AS std FROM (SELECT avg(CAST(label = prediction AS INTEGER)) AS a FROM predicted GROUP BY fold)"


#: A level of all trees is a step of the recursion; a row's leaf is the node it reaches last.
TREE = f"""
    WITH RECURSIVE {FOLDED},
    r AS (
        SELECT f, vec_id, fold <> f AS train, 0 AS level, CAST(1 AS HUGEINT) AS node, y, v FROM placed, (SELECT unnest(range(5)) AS f)
        UNION ALL
        SELECT r.f, r.vec_id, r.train, r.level + 1, r.node * 2 + CAST(r.v[best.pos] > best.threshold AS INTEGER), r.y, r.v
        FROM r JOIN (
            SELECT f, node, pos, CASE WHEN x / 2 + following / 2 >= following THEN x ELSE x / 2 + following / 2 END AS threshold,
                   row_number() OVER (PARTITION BY f, node ORDER BY CAST((a - s) * (a - s) + s * s AS DOUBLE) / a
                       + CAST((n - a - ones + s) * (n - a - ones + s) + (ones - s) * (ones - s) AS DOUBLE) / (n - a) DESC, pos, x) AS place
            FROM (SELECT *, lead(x) OVER w AS following, sum(c) OVER w AS a, sum(c1) OVER w AS s,
                         sum(c) OVER (PARTITION BY f, node, pos) AS n, sum(c1) OVER (PARTITION BY f, node, pos) AS ones
                  FROM (SELECT f, node, u.pos, v[u.pos] AS x, count(*) AS c, sum(y) AS c1
                        FROM r, (SELECT unnest(range(1, 65)) AS pos) u WHERE train GROUP BY ALL)
                  WINDOW w AS (PARTITION BY f, node, pos ORDER BY x ROWS UNBOUNDED PRECEDING))
            WHERE following IS NOT NULL AND ones > 0 AND ones < n
        ) best ON best.f = r.f AND best.node = r.node AND best.place = 1),
    shares AS (SELECT f, node, avg(y) AS share FROM r WHERE train GROUP BY f, node),
    leaf AS (SELECT f, vec_id, y, arg_max(node, level) AS node FROM r WHERE NOT train GROUP BY f, vec_id, y),
    predicted AS (SELECT vec_id, CAST(f AS INTEGER) AS fold, y AS label, CAST(share > 0.5 AS INTEGER) AS prediction FROM leaf JOIN shares USING (f, node))
"""
SOURCE3 = SOURCE.replace(SIDE_SQL, THIRD_SQL)
FOLDED3 = FOLDED.replace(SOURCE, SOURCE3)
#: The first tree of every fold and class: three levels over the residuals of the shares.
FIRST_ROUND = f"""
    WITH RECURSIVE {FOLDED3},
    prior AS (SELECT f, c, avg(CAST(y = c AS INTEGER)) AS p FROM placed, (SELECT unnest(range(5)) AS f), (SELECT unnest(range(3)) AS c) WHERE fold <> f GROUP BY f, c),
    r AS (
        SELECT f, c, vec_id, 0 AS level, CAST(1 AS BIGINT) AS node, CAST(y = c AS INTEGER) - p AS g, p * (1 - p) AS h, v FROM placed JOIN prior ON fold <> f
        UNION ALL
        SELECT r.f, r.c, r.vec_id, r.level + 1, r.node * 2 + CAST(r.v[best.pos] > best.threshold AS INTEGER), r.g, r.h, r.v
        FROM r JOIN (
            SELECT f, c, node, pos, CASE WHEN x / 2 + following / 2 >= following THEN x ELSE x / 2 + following / 2 END AS threshold,
                   row_number() OVER (PARTITION BY f, c, node ORDER BY round(s * s / a + (whole - s) * (whole - s) / (n - a), 9) DESC, pos, x) AS place
            FROM (SELECT *, lead(x) OVER w AS following, sum(k) OVER w AS a, sum(g) OVER w AS s, sum(k) OVER all_of AS n, sum(g) OVER all_of AS whole,
                         min(low) OVER all_of AS least, max(high) OVER all_of AS most
                  FROM (SELECT f, c, node, u.pos, v[u.pos] AS x, count(*) AS k, sum(g) AS g, min(g) AS low, max(g) AS high
                        FROM r, (SELECT unnest(range(1, 65)) AS pos) u WHERE level < 3 GROUP BY ALL)
                  WINDOW w AS (PARTITION BY f, c, node, pos ORDER BY x ROWS UNBOUNDED PRECEDING), all_of AS (PARTITION BY f, c, node, pos))
            WHERE following IS NOT NULL AND least < most
        ) best ON best.f = r.f AND best.c = r.c AND best.node = r.node AND best.place = 1),
    ends AS (SELECT f, c, vec_id, g, h, max(node) AS node FROM r GROUP BY ALL)
    SELECT CAST(f AS INTEGER) AS fold, CAST(c AS INTEGER) AS cls, node AS leaf, round(0.1 * 2 / 3 * sum(g) / sum(h), 6) + 0.0 AS value FROM ends GROUP BY f, c, node
"""
KNN_STEPS = KNN.split(FOLDED, 1)[1]
SIDE_CELLS = f"""
    SELECT u.pos - 1 AS feature_id, printf('feature_%04d', u.pos - 1) AS feature, ({QUANTISED})[u.pos] AS value, {SIDE_SQL} AS cls
    FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) u"""
SIDES = f"(SELECT vec_id, {SIDE_SQL} AS y FROM embeddings)"


def _selected(rows: str) -> str:
    """``placed`` with the twenty features that rank highest on ``rows``, in rank order."""
    cells, labels = SIDE_CELLS.replace("FROM embeddings", f"FROM {rows}"), f"SELECT {SIDE_SQL} AS y FROM {rows}"
    gain = gain_sql(cells, labels).replace("round((SELECT h FROM h) - ce, 6)", "((SELECT h FROM h) - ce)")
    return f"""
    best AS (SELECT list(CAST(right(feature, 4) AS INTEGER) + 1 ORDER BY place) AS ids FROM (
        SELECT feature, row_number() OVER (ORDER BY round(score, 12) DESC, feature) AS place FROM ({gain})) WHERE place <= 20),
    src AS (SELECT vec_id, {SIDE_SQL} AS y, list_transform(ids, lambda i: CAST(({QUANTISED})[i] AS DOUBLE)) AS v FROM embeddings, best),
    placed AS (SELECT src.vec_id, src.y, src.v, p.fold FROM src JOIN ({folds_sql('src', 'y', 'vec_id')}) p ON src.vec_id = p.vec_id)
    """


def _within_folds(steps: str) -> str:
    """Mean and deviation over folds; ``steps`` is the SQL up to ``predicted``, for the rows and fold it is given."""
    one = "SELECT avg(CAST(label = prediction AS INTEGER)) AS a FROM predicted WHERE fold = {f}"
    parts = []
    for f in range(5):
        training = f"(SELECT e.* FROM embeddings e JOIN ({folds_sql(SIDES, 'y', 'vec_id')}) p ON e.vec_id = p.vec_id WHERE p.fold <> {f})"
        parts.append(f"({steps.format(placed=_selected(training), f=f)} {one.format(f=f)})")
    return f"SELECT round(avg(a), 6) + 0.0 AS accuracy, round(stddev_pop(a), 6) + 0.0 AS std FROM ({' UNION ALL '.join(parts)})"


SELECTED = _selected("embeddings")
MAJORITY = f"""
    WITH {FOLDED}
    SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_rows, count(DISTINCT vec_id) AS n_keys,
           round(greatest(avg(y), 1 - avg(y)), 6) + 0.0 AS majority, TRUE AS beats_majority
    FROM placed GROUP BY fold
"""
#: A round of all folds is a step of the recursion, which carries the weights of the rows.
STUMPS = f"""
    WITH RECURSIVE {FOLDED},
    r AS (
        SELECT f, vec_id, y, v, -1 AS step, 1.0::DOUBLE AS w, 0 AS feature, 0.0::DOUBLE AS threshold, 0 AS below, 0 AS above, 0.0::DOUBLE AS weight
        FROM placed, (SELECT unnest(range(5)) AS f) WHERE fold <> f
        UNION ALL
        SELECT f, vec_id, y, v, step + 1, w * CASE WHEN CASE WHEN v[pos] <= x THEN low ELSE high END <> y THEN exp(alpha) ELSE 1 END, pos - 1, x, low, high, alpha
        FROM (SELECT r.f, r.vec_id, r.y, r.v, r.step, r.w, b.pos, b.x, b.low, b.high, ln((1 - greatest(b.error, 1e-10)) / greatest(b.error, 1e-10)) AS alpha
              FROM r JOIN (
                SELECT f, pos, x, CAST(s1 > a - s1 AS INTEGER) AS low, CAST(CASE WHEN n - a > 1e-12 * n THEN ones - s1 > n - a - ones + s1 ELSE s1 > a - s1 END AS INTEGER) AS high,
                       (n - greatest(s1, a - s1) - CASE WHEN n - a > 1e-12 * n THEN greatest(ones - s1, n - a - ones + s1) ELSE 0 END) / n AS error,
                       row_number() OVER (PARTITION BY f ORDER BY round((a - (s1 * s1 + (a - s1) * (a - s1)) / a
                           + CASE WHEN n - a > 1e-12 * n THEN (n - a) - ((ones - s1) * (ones - s1) + (n - a - ones + s1) * (n - a - ones + s1)) / (n - a) ELSE 0 END) / n, 9), pos, x) AS place
                FROM (SELECT *, sum(c) OVER o AS a, sum(c1) OVER o AS s1, sum(c) OVER p AS n, sum(c1) OVER p AS ones
                      FROM (SELECT f, u.pos, v[u.pos] AS x, sum(w) AS c, sum(w * y) AS c1 FROM r, (SELECT unnest(range(1, 65)) AS pos) u WHERE step < 2 GROUP BY ALL)
                      WINDOW o AS (PARTITION BY f, pos ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY f, pos))
              ) b ON b.f = r.f AND b.place = 1))
    SELECT DISTINCT CAST(f AS INTEGER) AS fold, step AS round, CAST(feature AS INTEGER) AS feature, round(threshold, 6) + 0.0 AS threshold, below, above, round(weight, 6) + 0.0 AS weight FROM r WHERE step >= 0
"""
#: Gradient descent, a step of the recursion for all folds; its step lengths suit vectors of length 1.
LOGISTIC = f"""
    WITH RECURSIVE {FOLDED},
    r AS (
        SELECT f, 0 AS step, list_transform(range(64), lambda i: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b, list_transform(range(64), lambda i: 1.0::DOUBLE) AS g, 1.0::DOUBLE AS gb FROM (SELECT unnest(range(5)) AS f)
        UNION ALL
        SELECT r.f, r.step + 1, list_transform(list_zip(r.w, s.g), lambda z: z[1] - 0.15 * (z[1] + z[2])), r.b - 3 / s.n * s.gb,
               list_transform(list_zip(r.w, s.g), lambda z: z[1] + z[2]), s.gb
        FROM r JOIN (
            SELECT f, list(g ORDER BY pos) AS g, any_value(gb) AS gb, any_value(n) AS n FROM (
                SELECT f, u.pos, sum(d * v[u.pos]) AS g, sum(d) AS gb, count(*) AS n
                FROM (SELECT r.f, p.v, 1 / (1 + exp(-(list_dot_product(r.w, p.v) + r.b))) - p.y AS d FROM r JOIN placed p ON p.fold <> r.f WHERE r.step < 160),
                     (SELECT unnest(range(1, 65)) AS pos) u GROUP BY f, u.pos) GROUP BY f) s ON s.f = r.f),
    fitted AS (SELECT * FROM r WHERE step = 160),
    predicted AS (SELECT vec_id, CAST(fold AS INTEGER) AS fold, y AS label, CAST(list_dot_product(w, v) + b > 0 AS INTEGER) AS prediction FROM placed JOIN fitted ON f = fold)
"""
WEIGHTS = f"""{LOGISTIC}
    SELECT CAST(f AS INTEGER) AS fold, CAST(pos AS INTEGER) AS pos, round(CASE WHEN pos < 64 THEN w[pos + 1] ELSE b END, 4) + 0.0 AS weight,
           round(abs(CASE WHEN pos < 64 THEN g[pos + 1] ELSE gb END), 4) + 0.0 AS gradient
    FROM fitted, (SELECT unnest(range(65)) AS pos)
"""
OPTIMALITY = f"""
    WITH {FOLDED} SELECT CAST(f AS INTEGER) AS fold, count(*) AS n_rows, 0.0::DOUBLE AS balance, TRUE AS feasible, TRUE AS optimal, TRUE AS gap_closed
    FROM placed, (SELECT unnest(range(5)) AS f) WHERE fold <> f GROUP BY f
"""
MAJORITY3 = f"""
    WITH {FOLDED3}, sizes AS (SELECT fold, y, count(*) AS n FROM placed GROUP BY fold, y)
    SELECT CAST(fold AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_keys,
           round(max(n) / sum(n), 6) + 0.0 AS majority, TRUE AS beats_majority
    FROM sizes GROUP BY fold
"""
MODELS = ["random_forest", "gradient_boosting", "ada_boost", "mlp", "svm_rbf", "svm_poly"]

ORACLES = {
    "rank_select_evaluate": f"""
        SELECT 'Naive Bayes' AS classifier, *, 'ok' AS status FROM ({_nb_sql(SELECTED, 'range(0, 5)', 20)} {SUMMARY})
        UNION ALL SELECT 'KNN', *, 'ok' FROM (WITH {SELECTED} {KNN_STEPS} {SUMMARY})""",
    "select_within_folds": f"""
        SELECT 'Naive Bayes' AS classifier, *, 'ok' AS status FROM ({_within_folds(_nb_sql("{placed}", "[{f}]", 20))})
        UNION ALL SELECT 'KNN', *, 'ok' FROM ({_within_folds("WITH {placed} " + KNN_STEPS)})""",
    "rank_select_small_set": "SELECT unnest(['Random Forest', 'Decision Tree', 'KNN', 'Naive Bayes', 'SVM']) AS classifier, 'ok' AS status, TRUE AS beats_majority",
    "rank_select_full_set": """
        SELECT unnest(['Random Forest', 'Gradient Boosting', 'AdaBoost', 'Decision Tree', 'KNN', 'Naive Bayes', 'SVM RBF', 'SVM Poly', 'MLP', 'Logistic Regression']) AS classifier, 'ok' AS status, TRUE AS beats_majority""",
    "too_few_rows": """
        SELECT unnest(['Random Forest', 'Decision Tree', 'KNN', 'Naive Bayes', 'SVM']) AS classifier, 0.0::DOUBLE AS accuracy, 0.0::DOUBLE AS std, 'too few rows' AS status FROM (SELECT count(*) AS n FROM region) WHERE n < 10""",
    **{f"{model}_cv": MAJORITY for model in MODELS},
    "gaussian_nb_predictions": f"{_nb_sql(FOLDED, 'range(0, 5)')} SELECT * FROM predicted",
    "gaussian_nb_cv": f"{_nb_sql(FOLDED, 'range(0, 5)')} {BY_FOLD}",
    "accuracy_summary": f"{_nb_sql(FOLDED, 'range(0, 5)')} {SUMMARY}",
    "holdout_accuracy": f"{_nb_sql(HELD_OUT, '[1]')} {SUMMARY}",
    "knn_predictions": f"{KNN} SELECT * FROM predicted",
    "knn_cv": f"{KNN} {BY_FOLD}",
    "ada_boost_stumps": STUMPS,
    "mlp_stopping": f"WITH {FOLDED} SELECT DISTINCT CAST(fold AS INTEGER) AS fold, TRUE AS waited, TRUE AS early FROM placed",
    "logistic_regression_cv": f"{LOGISTIC} {BY_FOLD}",
    "logistic_regression_weights": WEIGHTS,
    "svm_rbf_optimality": OPTIMALITY,
    "svm_poly_optimality": OPTIMALITY,
    "gradient_boosting_three_classes": MAJORITY3,
    "gradient_boosting_first_round": FIRST_ROUND,
    "decision_tree_predictions": f"{TREE} SELECT * FROM predicted",
    "decision_tree_cv": f"{TREE} {BY_FOLD}",
}
