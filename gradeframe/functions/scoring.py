"""Staged answer scoring.

Each policy decides as many rows as possible with JVM expressions; only rows
left open (NULL) go on to the token-set ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions import text as t
from gradeframe.functions.fuzzy import with_token_set_ratio

POLICIES = ("strict", "strict_nocbd", "demo", "lenient", "containment", "fuzzy")


def failed_guard(pred: Column, undetermined: bool = True) -> Column:
    """An empty, failed or (optionally) undetermined prediction never scores."""
    lowered = F.lower(F.coalesce(pred, F.lit("")))
    bad = (lowered == "") | lowered.contains("fail:")
    return bad | lowered.contains(fv.UNDETERMINED) if undetermined else bad


def _prepared(df: DataFrame, ref: str, pred: str, raw: bool) -> DataFrame:
    clean = t.lower_strip if raw else t.normalise
    numbers = t.number_set_lenient if raw else t.number_set
    df = df.withColumns({"_r": clean(ref), "_p": clean(pred)})
    return df.withColumn("_same_numbers", t.same_nonempty(numbers("_r"), numbers("_p")))


def _finish(df: DataFrame, decided: Column, threshold: float, out: str, raw: bool) -> DataFrame:
    df = df.withColumn("_decided", decided)
    df = with_token_set_ratio(df, "_r", "_p", "_ratio", F.col("_decided").isNull(), threshold, spaced=not raw)
    by_ratio = F.when(F.col("_ratio") / 100.0 >= threshold, 1).otherwise(0)
    df = t.sealed(df, **{out: F.coalesce(F.col("_decided"), by_ratio)})
    return df.drop("_r", "_p", "_same_numbers", "_decided", "_ratio")


def score(
    df: DataFrame,
    policy: str = "strict",
    ref: str = "reference",
    pred: str = "prediction",
    task: str = "task",
    threshold: float = fv.FUZZY_THRESHOLD,
    variants: str | None = None,
    out: str = "correct",
) -> DataFrame:
    """Add ``out`` (0/1), the verdict of one scoring policy.

    strict        T10   guard, yes/no label, number set, ratio
    strict_nocbd  T10b  the same without the "cannot be determined" guard
    demo          T11   unclear labels never match; accepted variants first; then fuzzy
    lenient       T12   raw equality, ratio, lenient numbers, first yes/no
    containment   T14   reference inside prediction, or ratio
    fuzzy         T9    equality, number set, ratio on any task
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}, one of {POLICIES}")
    raw = policy in ("lenient", "containment")
    df = _prepared(df, ref, pred, raw)
    r, p, same_numbers = F.col("_r"), F.col("_p"), F.col("_same_numbers")
    contradiction = F.coalesce(F.col(task) == fv.CONTRADICTION, F.lit(False)) if task in df.columns else F.lit(False)
    one, zero = F.lit(1), F.lit(0)

    if policy in ("strict", "strict_nocbd"):
        label = (t.yn_label(r) == t.yn_label(p)).cast("int")
        decided = (
            F.when(failed_guard(F.col(pred), policy == "strict"), zero)
            .when(contradiction, label)
            .when(same_numbers, one)
        )
    elif policy == "demo":
        label = ((t.yn_label(r, "unclear") == t.yn_label(p, "unclear")) & (t.yn_label(r, "unclear") != "unclear")).cast("int")
        exact = t.exact_match_any(ref, variants, pred) if variants else (r == p)
        decided = (
            F.when(failed_guard(F.col(pred)), zero)
            .when(contradiction, label)
            .when(exact, one)
            .when((r == "") | (p == ""), zero)
            .when(same_numbers, one)
        )
    elif policy == "lenient":
        in_task = F.coalesce(F.lower(F.col(task)).contains("contradiction"), F.lit(False))
        first_r, first_p = t.yn_first(r), t.yn_first(p)
        # The stages are alternatives that each only add a match, so the cheap ones go first.
        decided = F.when((r == p) | same_numbers | (in_task & (first_r != "") & (first_r == first_p)), one)
    elif policy == "containment":
        decided = F.when(p.contains(r), one)
    else:
        decided = (
            F.when((r == "") | (p == ""), zero).when(r == p, one).when(same_numbers, one)
        )
    return _finish(df, decided, threshold, out, raw)


def score_with_stage(
    df: DataFrame,
    ref: str = "reference",
    pred: str = "prediction",
    task: str = "task",
    threshold: float = fv.FUZZY_THRESHOLD,
) -> DataFrame:
    """Add ``correct`` and ``stage``, the rule that decided."""
    df = _prepared(df, ref, pred, raw=False)
    r, p = F.col("_r"), F.col("_p")
    label_r, label_p = t.yn_label(r, ""), t.yn_label(p, "")
    labelled = (F.col(task) == fv.CONTRADICTION) & (label_r != "") & (label_p != "")
    df = df.withColumn(
        "stage",
        F.when(r == p, "exact")
        .when(labelled, F.when(label_r == label_p, "yn").otherwise("yn_miss"))
        .when(F.col("_same_numbers"), "numerical"),
    )
    df = with_token_set_ratio(df, "_r", "_p", "_ratio", F.col("stage").isNull(), threshold, spaced=True)
    by_ratio = F.when(F.col("_ratio") / 100.0 >= threshold, "fuzzy").otherwise("incorrect")
    return (
        t.sealed(df, stage=F.coalesce("stage", by_ratio))
        .withColumn("correct", (~F.col("stage").isin("yn_miss", "incorrect")).cast("int"))
        .drop("_r", "_p", "_same_numbers", "_ratio")
    )


def sweep_verdicts(
    df: DataFrame,
    thresholds: list[float] | None = None,
    ref: str = "reference",
    pred: str = "prediction",
    task: str = "task",
) -> tuple[DataFrame, dict[float, Column]]:
    """Strict scoring at many thresholds: each row's ratio is computed once.

    Returns the frame with ``decided``/``ratio`` and one 0/1 column per threshold.
    ``ratio`` is exact between the lowest and the highest threshold; rows whose
    bounds lie on one side of all of them need no kernel.
    """
    thresholds = thresholds or fv.SWEEP_THRESHOLDS
    df = _prepared(df, ref, pred, raw=False)
    r, p = F.col("_r"), F.col("_p")
    df = df.withColumn(
        "decided",
        F.when(failed_guard(F.col(pred), undetermined=False), F.lit(0))
        .when(F.col(task) == fv.CONTRADICTION, (t.yn_label(r) == t.yn_label(p)).cast("int"))
        .when(F.col("_same_numbers"), F.lit(1)),
    )
    df = with_token_set_ratio(df, "_r", "_p", "ratio", F.col("decided").isNull(), (min(thresholds), max(thresholds)), spaced=True)
    df = t.sealed(df, decided=F.col("decided"), ratio=F.col("ratio")).drop("_r", "_p", "_same_numbers")
    verdicts = {
        th: F.coalesce(F.col("decided"), F.when(F.col("ratio") / 100.0 >= th, 1).otherwise(0))
        for th in thresholds
    }
    return df, verdicts


def rescore_upgrade_only(
    df: DataFrame, agree: str = "agree", ref: str = "reference", pred: str = "prediction", task: str = "task"
) -> DataFrame:
    """Numerical rows scored 0 may become 1, nothing is ever downgraded."""
    df = df.withColumns({"_a": t.canonical_answer(ref), "_b": t.canonical_answer(pred)})
    upgrade = (F.col(task) == fv.NUMERICAL) & (F.col(agree) == 0) & t.answers_match("_a", "_b")
    return (
        df.withColumn("changed", F.when(upgrade, 1).otherwise(0))
        .withColumn(agree, F.when(upgrade, F.lit(1)).otherwise(F.col(agree)))
        .drop("_a", "_b")
    )
