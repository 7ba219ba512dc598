"""What makes an answer wrong or an item hard (MLlib)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import strip
from gradeframe.operators.ranks import HASH_BOUNDS, numbered


def regression_cells(df: DataFrame, difficulty: str = "difficulty", task: str = "task", correct: str = "correct") -> DataFrame:
    """Counts per (difficulty, task, outcome), all a logit on two factors depends on."""
    return (
        df.where(F.col(difficulty).isNotNull() & F.col(task).isNotNull() & F.col(correct).isNotNull())
        .groupBy(F.lower(strip(F.col(difficulty))).alias("difficulty"), strip(F.col(task)).alias("task"), F.col(correct).cast("double").alias("label"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def logit_regression(
    df: DataFrame, levels: list[str] | None = None, tasks: list[str] | None = None,
    reference_level: str = "easy", reference_task: str = "regulatory_interpretation", ols: bool = False, **columns: str,
) -> DataFrame:
    """Correct ~ difficulty + task with explicit reference levels.

    Runs at once. Rows collapse to one cell per (difficulty, task) with the
    share correct, weighted by its rows, which gives the estimates of all rows;
    the number of cells does not grow with the rows. Every level in the data has
    a term, declared ones first; declared levels without rows have none. The
    reference levels must have rows. ``ols`` fits the linear fallback: its
    errors count the rows, not the cells, and its p-values are normal ones.
    """
    counts = regression_cells(df, **columns).groupBy("difficulty", "task").agg(
        (F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight"),
    )
    found = counts.orderBy("difficulty", "task").collect()
    terms: list[tuple[str, str]] = []
    for factor, declared, reference in (("difficulty", levels or fv.DIFFICULTIES, reference_level), ("task", tasks or fv.TASKS, reference_task)):
        present = {r[factor] for r in found}
        if reference not in present:
            raise ValueError(f"no rows of the reference {factor} {reference!r}")
        terms += [(factor, v) for v in [*[x for x in declared if x in present], *sorted(present - {*declared})] if v != reference]
    design = np.array([[*[float(r[f] == v) for f, v in terms], 1.0] for r in found])
    share, weight = np.array([r["label"] for r in found]), np.array([r["weight"] for r in found])
    if ols:
        inverse = np.linalg.inv(design.T @ (design * weight[:, None]))
        coefficients = inverse @ (design.T @ (weight * share))
        # Squares between the cells and the fit, and within cells, where outcomes are 0 or 1.
        squares = (weight * ((share - design @ coefficients) ** 2 + share * (1 - share))).sum()
        errors = np.sqrt(np.diag(inverse) * squares / (weight.sum() - design.shape[1]))
        p_values = [math.erfc(abs(c / e) / math.sqrt(2)) if e else 0.0 for c, e in zip(coefficients, errors)]
    else:
        rows = [(float(y), float(w), Vectors.dense(x[:-1])) for y, w, x in zip(share, weight, design)]
        cells = df.sparkSession.createDataFrame(rows, ["label", "weight", "features"]).coalesce(1)
        model = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="weight", maxIter=100, tol=1e-10).fit(cells)
        coefficients = [*model.coefficients.toArray().tolist(), model.intercept]
        errors, p_values = model.summary.coefficientStandardErrors, model.summary.pValues
    names = [*[f"{f}[{v}]" for f, v in terms], "Intercept"]
    out = [(n, float(c), float(p), float(c - fv.Z95 * e), float(c + fv.Z95 * e), bool(p < 0.05)) for n, c, e, p in zip(names, coefficients, errors, p_values)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, p_value double, ci_lo double, ci_hi double, sig boolean")


def logit_scores(df: DataFrame, fitted: DataFrame, difficulty: str = "difficulty", task: str = "task", correct: str = "correct") -> DataFrame:
    """(term, score), the score equations of a fitted logit over all rows; all are zero at the estimates."""
    # One coefficient per level.
    known = F.create_map(*[F.lit(x) for r in fitted.select("term", "coef").collect() for x in r])
    cells = regression_cells(df, difficulty, task, correct).withColumn("c", known)
    factors = [F.concat(F.lit(f"{f}["), F.col(f), F.lit("]")) for f in ("difficulty", "task")]
    parts = [F.coalesce(F.try_element_at("c", f), F.lit(0.0)) for f in factors] + [F.col("c")["Intercept"]]
    residual = F.col("weight") * (F.col("label") - 1 / (1 + F.exp(-(parts[0] + parts[1] + parts[2]))))
    each = cells.select(residual.alias("r"), "c", F.explode(F.array(*factors, F.lit("Intercept"))).alias("term")).where(F.array_contains(F.map_keys("c"), F.col("term")))
    return each.groupBy("term").agg(F.sum("r").alias("score"))


def _hard_items(items: DataFrame, features: list[str], ensemble: str, key: str) -> tuple[DataFrame, int, int]:
    """(key, label, features scaled by the population deviation), the number of items and of hard ones."""
    data = items.select(
        key, (F.col(ensemble) < 0.5).cast("double").alias("label"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
    )
    moments = data.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).cast("long").alias("hard"),
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
    ).first()
    scaled = data.select(key, "label", *[((F.col(f) - F.lit(moments[f"m_{f}"])) / F.lit(moments[f"s_{f}"] or 1.0)).alias(f) for f in features])
    return scaled, moments["n"], moments["hard"]


def stratified_folds(data: DataFrame, folds: int, key: str, label: str = "label") -> DataFrame:
    """Add ``fold``: row numbers within the class, along a hash of the key, dealt in turn."""
    hashed = data.withColumn("_hash", F.xxhash64(key))
    placed = numbered(hashed, [label], "_hash", [key], "_rn", bounds=HASH_BOUNDS)
    return placed.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_hash", "_rn")


def hard_item_model(items: DataFrame, features: list[str], ensemble: str = "ensemble_accuracy", folds: int = 5, fold_key: str = "item_id", c: float = 1.0) -> DataFrame:
    """L2 logistic model of hard items on scaled features.

    Runs at once (cross-validation and fit are distributed MLlib jobs). Features
    are scaled with the population deviation; the penalty 1/(c*n) on the mean
    loss equals penalty 1/c on the summed loss. Folds hold both classes in
    proportion; there are at most as many as the smaller class has items, and
    ``folds`` says how many were used. Returns coefficients by absolute size,
    the intercept, and mean and deviation of the AUC over folds, NULL if there
    are fewer than two items of a class.
    """
    scaled, n, hard = _hard_items(items, features, ensemble, fold_key)
    used = min(folds, hard, n - hard)
    data = stratified_folds(scaled, max(used, 1), fold_key)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(data).select("label", "features", "fold").persist()

    def model(rows: float) -> LogisticRegression:
        return LogisticRegression(family="binomial", regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12)

    try:
        mean = deviation = None
        if used > 1:
            estimator = model(n * (used - 1) / used)
            evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC")
            checked = CrossValidator(estimator=estimator, estimatorParamMaps=[{}], evaluator=evaluator, numFolds=used, foldCol="fold", parallelism=used).fit(data)
            mean, deviation = float(checked.avgMetrics[0]), float(checked.stdMetrics[0])
        fitted = model(n).fit(data)
        coefficients, intercept = fitted.coefficients.toArray().tolist(), float(fitted.intercept)
    finally:
        data.unpersist()
    rows = sorted(((f, float(b), abs(float(b)), intercept, mean, deviation, used) for f, b in zip(features, coefficients)), key=lambda r: (-r[2], r[0]))
    return items.sparkSession.createDataFrame(rows, "feature string, coefficient double, abs_coef double, intercept double, auc_mean double, auc_std double, folds int")


def hard_item_scores(items: DataFrame, fitted: DataFrame, ensemble: str = "ensemble_accuracy", fold_key: str = "item_id", c: float = 1.0) -> DataFrame:
    """The score equations of a fitted model (term, score), all zero at the optimum of the penalised loss."""
    found = {r["feature"]: r["coefficient"] for r in fitted.collect()}
    features = sorted(found)
    scaled, n, _ = _hard_items(items, features, ensemble, fold_key)
    intercept = fitted.select("intercept").first()[0]
    line = sum((F.lit(found[f]) * F.col(f) for f in features), F.lit(intercept))
    residual = F.col("label") - 1 / (1 + F.exp(-line))
    sums = scaled.agg(*[(F.sum(residual * F.col(f)) - F.lit(found[f] / c)).alias(f) for f in features], F.sum(residual).alias("Intercept"))
    each = F.array(*[F.struct(F.lit(t).alias("term"), (F.col(t) / F.lit(float(max(n, 1)))).alias("score")) for t in [*features, "Intercept"]])
    return sums.select(F.inline(each))
