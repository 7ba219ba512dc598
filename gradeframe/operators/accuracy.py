"""Accuracy tables.

Big data is read once: rows collapse to ``cells`` (count and sum of correct
answers per key) with map-side aggregation, and every table is built from cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions import bands, stats
from gradeframe.operators.ranks import spread_join

TOTAL = "OVERALL"


def drop_failed(df: DataFrame, prediction: str = "prediction", any_case: bool = False) -> DataFrame:
    """Rows without a failed prediction.

    The plain form is case-sensitive and keeps NULL; ``any_case`` ignores case
    and treats NULL as failed.
    """
    text = F.col(prediction)
    if any_case:
        return df.where(~F.coalesce(F.contains(F.lower(text), F.lit(fv.FAILED.lower())), F.lit(True)))
    return df.where(~F.coalesce(text.contains(fv.FAILED), F.lit(False)))


def discover_runs(df: DataFrame, min_rows: int = 100, model: str = "model") -> DataFrame:
    """IO3: rows of runs with at least ``min_rows`` rows; a NULL run is none."""
    large = df.where(F.col(model).isNotNull()).groupBy(model).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return spread_join(df, large.select(model), [model])


def cells(df: DataFrame, keys: list[str], correct: str = "correct") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(correct).alias("n"), F.sum(correct).cast("long").alias("n_correct"))


def roll_up(cell_table: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Grouping sets over a small cell table; keys summed out read OVERALL."""
    flags = [F.grouping(k).alias(f"_g_{k}") for k in keys]
    out = cell_table.groupingSets(sets, *keys).agg(
        F.sum("n").alias("n"), F.sum("n_correct").cast("long").alias("n_correct"), *flags
    )
    labels = [F.when(F.col(f"_g_{k}") == 1, F.lit(TOTAL)).otherwise(F.col(k)).alias(k) for k in keys]
    return out.select(*labels, "n", "n_correct")


def ratio(k: Column | str, n: Column | str) -> Column:
    k = F.col(k) if isinstance(k, str) else k
    n = F.col(n) if isinstance(n, str) else n
    return k / F.nullif(n.cast("double"), F.lit(0.0))


def accuracy(df: DataFrame, by: list[str] | None = None, overall: list[str] | None = None, correct: str = "correct") -> DataFrame:
    """A1: accuracy per key, plus rows with all keys but ``overall`` summed out."""
    by = by or ["model", "task"]
    overall = by[:1] if overall is None else overall
    table = roll_up(cells(df, by, correct), by, [by, overall])
    return table.withColumn("accuracy", ratio("n_correct", "n"))


def with_wilson(df: DataFrame, k: str = "n_correct", n: str = "n", z: float = fv.Z95) -> DataFrame:
    """Wilson interval columns for count columns."""
    return df.withColumns(stats.wilson(k, n, z))


def _share(correct: str, condition: Column | None = None) -> Column:
    value = F.col(correct).cast("double")
    return F.avg(value if condition is None else F.when(condition, value))


def _cell_share(condition: Column | None = None) -> Column:
    n, k = F.col("n"), F.col("n_correct")
    if condition is not None:
        n, k = F.when(condition, n), F.when(condition, k)
    return ratio(F.sum(k), F.sum(n))


def matrix_of(cell_table: DataFrame, tasks: list[str] | None = None, by: list[str] | None = None, task: str = "task", empty_as_zero: bool = False) -> DataFrame:
    """A2 from finished cells."""
    tasks = tasks or fv.TASKS
    columns = [_cell_share(F.col(task) == name).alias(fv.TASK_CODES.get(name, name)) for name in tasks]
    wide = cell_table.groupBy(*(by or ["model"])).agg(*columns, _cell_share().alias("Overall"))
    return wide.na.fill(0.0) if empty_as_zero else wide


def task_accuracy_matrix(
    df: DataFrame, tasks: list[str] | None = None, by: list[str] | None = None,
    task: str = "task", correct: str = "correct", empty_as_zero: bool = False,
) -> DataFrame:
    """A2: one column per task and Overall; a system without rows of a task has NULL there."""
    by = by or ["model"]
    return matrix_of(cells(df, [*by, task], correct), tasks, by, task, empty_as_zero)


def levels_of(cell_table: DataFrame, level: str, levels: list[str], by: list[str] | None = None, clean: bool = True) -> DataFrame:
    """A3, A25 from finished cells."""
    name = F.lower(F.trim(F.col(level))) if clean else F.col(level)
    columns = []
    for value in levels:
        hit = name == value
        columns += [
            _cell_share(hit).alias(f"{value}_acc"),
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(f"{value}_n"),
        ]
    return cell_table.groupBy(*(by or ["model"])).agg(*columns)


def accuracy_by_level(
    df: DataFrame, level: str, levels: list[str], by: list[str] | None = None, correct: str = "correct", clean: bool = True
) -> DataFrame:
    """Accuracy and count per level (difficulty, tier) as columns."""
    by = by or ["model"]
    return levels_of(cells(df, [*by, level], correct), level, levels, by, clean)


def tier_drop(tiers: DataFrame, low: str = "Low_acc", high: str = "High_acc") -> DataFrame:
    """Loss from the easiest to the hardest tier, largest first; an empty tier counts as 0."""
    loss = F.coalesce(F.col(low), F.lit(0.0)) - F.coalesce(F.col(high), F.lit(0.0))
    return tiers.withColumn("drop", loss).orderBy(F.desc("drop"))


def accuracy_by_era(df: DataFrame, year: str, by: list[str] | None = None, correct: str = "correct") -> DataFrame:
    """Accuracy per era and system; rows outside every era are left out."""
    rows = df.withColumn("era", bands.era_bucket(year)).where(F.col("era").isNotNull())
    return cells(rows, ["era", *(by or ["model"])], correct).withColumn("accuracy", ratio("n_correct", "n"))


def era_summary(eras: DataFrame) -> DataFrame:
    """Mean and sample deviation of accuracies per era."""
    return eras.groupBy("era").agg(F.avg("accuracy").alias("mean_acc"), F.stddev_samp("accuracy").alias("std_acc"))


def _task_cells(df: DataFrame, correct: str) -> DataFrame:
    return cells(df, ["model", "task"], correct).withColumn("accuracy", ratio("n_correct", "n"))


def macro_average(df: DataFrame, correct: str = "correct") -> DataFrame:
    """A4: unweighted mean over systems per task, hardest first."""
    return (
        _task_cells(df, correct).groupBy("task")
        .agg(F.avg("accuracy").alias("mean_acc"), F.count(F.lit(1)).alias("n_models"))
        .orderBy("mean_acc", "task")
    )


def pooled_group_accuracy(df: DataFrame, groups: dict[str, str], correct: str = "correct") -> DataFrame:
    """A5: accuracy of all rows of a set of systems, per task."""
    pooled = df.withColumn("group", bands.lookup("model", groups)).where(F.col("group").isNotNull())
    return cells(pooled, ["group", "task"], correct).withColumn("accuracy", ratio("n_correct", "n"))


def spread(df: DataFrame, correct: str = "correct") -> DataFrame:
    """Spread of accuracies over systems per task (population deviation)."""
    a = F.col("accuracy")
    return _task_cells(df, correct).groupBy("task").agg(
        F.min(a).alias("min_acc"), F.max(a).alias("max_acc"), F.avg(a).alias("mean_acc"),
        (F.max(a) - F.min(a)).alias("spread"), F.stddev_pop(a).alias("std_acc"), F.var_pop(a).alias("var_acc"),
    )


def most_variable_task(df: DataFrame, correct: str = "correct") -> DataFrame:
    """The task whose accuracies vary most."""
    return spread(df, correct).agg(
        F.max_by("task", F.struct(F.col("var_acc"), F.col("task"))).alias("task"), F.max("var_acc").alias("var_acc")
    )


def ci_overlap_pairs(intervals: DataFrame, task: str = "task", model: str = "model") -> DataFrame:
    """Pairs of systems per task whose difference is below the sum of half widths.

    Works on finished interval rows: one per system and task.
    """
    def side(name: str) -> DataFrame:
        return intervals.select(
            F.col(task), F.col(model).alias(f"model_{name}"),
            F.col("accuracy").alias(f"acc_{name}"), F.col("half_width").alias(f"hw_{name}"),
        )

    pairs = side("a").join(side("b"), task).where(F.col("model_a") < F.col("model_b"))
    return pairs.withColumns({
        "abs_delta": F.abs(F.col("acc_a") - F.col("acc_b")),
        "hw_sum": F.col("hw_a") + F.col("hw_b"),
    }).where("abs_delta < hw_sum")


def majority_baseline(items: DataFrame, answer: str = "answer") -> DataFrame:
    """Yes and no answers, and the accuracy of always giving the more frequent one."""
    text = F.lower(F.trim(F.coalesce(F.col(answer), F.lit(""))))
    counts = items.agg(
        F.count_if(text.startswith("yes")).alias("yes_count"),
        F.count_if(text.startswith("no")).alias("no_count"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.withColumns({
        "majority_class": F.when(F.col("yes_count") > F.col("no_count"), "Yes").otherwise("No"),
        "majority_baseline": ratio(F.greatest("yes_count", "no_count"), "total"),
        "random_baseline": F.lit(0.5),
    })


def above_baseline(df: DataFrame, baseline: DataFrame, margin: float = 0.05, correct: str = "correct") -> DataFrame:
    """Systems whose accuracy exceeds the majority baseline by more than ``margin``."""
    level = baseline.select("majority_baseline").scalar()
    board = cells(df, ["model"], correct).withColumn("accuracy", ratio("n_correct", "n"))
    return board.withColumn("above", F.col("accuracy") > level + F.lit(margin))


def label_distribution(df: DataFrame, prediction: str = "prediction", correct: str = "correct", by: str = "model") -> DataFrame:
    """A10: yes, no and other answers per system, and accuracy."""
    text = F.lower(F.trim(F.coalesce(F.col(prediction), F.lit(""))))
    yes, no = text.startswith("yes"), text.startswith("no")
    return df.groupBy(by).agg(
        F.count_if(yes).alias("n_yes"), F.count_if(no).alias("n_no"), F.count_if(~yes & ~no).alias("n_other"),
        _share(correct).alias("accuracy"),
    )


def dissociation_index(matrix: DataFrame, first: str = "CON", second: str = "TMP") -> DataFrame:
    """(first - second) / (first + second); rows without both, or with a zero sum, are left out."""
    a, b = F.col(first), F.col(second)
    return matrix.where((a + b) > 0).withColumn("DI", (a - b) / (a + b))


def dissociation_summary(index: DataFrame, model: str = "model") -> DataFrame:
    return index.agg(
        F.max("DI").alias("max_di"), F.max_by(model, "DI").alias("max_model"),
        F.min("DI").alias("min_di"), F.min_by(model, "DI").alias("min_model"), F.avg("DI").alias("mean_di"),
    )


def condition_summary(df: DataFrame, tasks: list[str] | None = None, correct: str = "correct") -> DataFrame:
    """Accuracy per system and condition, one column per task."""
    return task_accuracy_matrix(df, tasks, ["model", "condition"], correct=correct)


def condition_compare(base: DataFrame, other: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy of one condition next to another, and the loss (NULL without a base)."""
    keys = keys or ["model", "task"]
    return (
        other.select(*keys, F.col("accuracy").alias("other_acc"))
        .join(base.select(*keys, F.col("accuracy").alias("base_acc")), keys, "left")
        .withColumn("drop", F.col("base_acc") - F.col("other_acc"))
    )


def expected_vs_actual(actual: DataFrame, expected: DataFrame, keys: list[str] | None = None, tolerance: float = 0.005) -> DataFrame:
    """Cells whose accuracy differs from an expected value by more than the tolerance."""
    keys = keys or ["model", "task"]
    joined = actual.join(expected.select(*keys, F.col("expected").cast("double")), keys)
    return joined.withColumn("diff", F.abs(F.col("accuracy") - F.col("expected"))).where(F.col("diff") > tolerance)


def audit_rates(audit: DataFrame, by: str = "task", verdict: str = "verdict") -> DataFrame:
    """Verdict shares per task and overall; half of the false negatives is the correction."""
    v = F.col(verdict)
    counted = audit.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(v == name).alias(f"n_{name.lower()}") for name in ("CORRECT", "PARTIAL", "INCORRECT")],
    )
    table = counted.groupingSets([[by], []], by).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_correct", "n_partial", "n_incorrect")], F.grouping(by).alias("_g")
    )
    table = table.withColumn(by, F.when(F.col("_g") == 1, F.lit(TOTAL)).otherwise(F.col(by))).drop("_g")
    return table.withColumns({
        "fn_rate": ratio("n_correct", "n"),
        "partial_rate": ratio("n_partial", "n"),
        "incorrect_rate": ratio("n_incorrect", "n"),
        "correction": 0.5 * ratio("n_correct", "n"),
    })


def fnr_correct(acc: DataFrame, fnr: DataFrame, task: str = "task", default: float = 0.05) -> DataFrame:
    """Accuracy corrected for the false-negative rate of its task, else the overall rate."""
    overall = fnr.where(F.col(task) == TOTAL).select(F.max("fn_rate")).scalar()
    rate = F.coalesce(F.col("_fnr"), overall, F.lit(default))
    per_task = fnr.select(task, F.col("fn_rate").alias("_fnr"))
    return (
        acc.join(per_task, task, "left").withColumn("fnr", rate)
        .withColumn("corrected", stats.fnr_corrected("accuracy", "fnr")).drop("_fnr")
    )


def weighted_rubric(df: DataFrame, event: str = "event_score", ordering: str = "ordering_score", final: str = "final_score") -> DataFrame:
    """Weighted rubric score of each judged prediction."""
    w = fv.RUBRIC_WEIGHTS
    return df.withColumn("rubric", F.round(w[0] * F.col(event) + w[1] * F.col(ordering) + w[2] * F.col(final), 3))


def rubric_summary(df: DataFrame, by: str = "model", standard: str = "standard_correct") -> DataFrame:
    """Rubric means per system and the gap of the standard score."""
    means = df.groupBy(by).agg(
        F.avg("rubric").alias("rubric"), F.avg(standard).alias("standard"), F.avg("event_score").alias("event"),
        F.avg("ordering_score").alias("ordering"), F.avg("final_score").alias("final"),
    )
    return means.withColumn("gap", F.col("standard") - F.col("rubric"))


PERTURBATIONS = ["date", "number", "synonym"]


def _opening(answer: Column, n: int = 50) -> Column:
    """The first ``n`` characters of a stripped text, read from its beginning only: white space at the end counts if no other character follows."""
    from gradeframe.functions.text import SPACE, strip

    head = F.regexp_extract(answer, rf"(?s)\A[{SPACE}]*+(.{{0,{n}}})", 1)
    goes_on = answer.rlike(rf"(?s)\A[{SPACE}]*+.{{{n}}}[{SPACE}]*+[^{SPACE}]")
    return F.when(goes_on, head).otherwise(strip(head))


def robustness(df: DataFrame, keys: list[str] | None = None, condition: str = "condition", prediction: str = "prediction", correct: str = "correct") -> DataFrame:
    """Per item, which perturbed answers keep the first 50 characters of the original one.

    Answers are cut before they are gathered, so whole texts are neither sorted nor shuffled.
    """
    keys = keys or ["model", "item_id", "task"]

    def of(name: str, value: Column) -> Column:
        return F.max(F.when(F.col(condition) == name, value))

    from gradeframe.functions.text import sealed

    opening = _opening(F.coalesce(F.col(prediction), F.lit("")))
    # Through a generator, so that the cut is not put back into the aggregation.
    df = sealed(df, _opening=opening).select(*keys, condition, correct, "_opening")
    opening = F.col("_opening")
    columns = [of("original", opening).alias("_original"), of("original", F.col(correct)).alias("original_correct")]
    for name in PERTURBATIONS:
        columns += [of(name, opening).alias(f"_{name}"), of(name, F.col(correct)).alias(f"{name}_correct")]
    wide = df.groupBy(*keys).agg(*columns)
    wide = wide.withColumns({
        f"consistency_{n}": F.coalesce((F.col("_original") == F.col(f"_{n}")).cast("int"), F.lit(0)) for n in PERTURBATIONS
    })
    total = sum((F.col(f"consistency_{n}") for n in PERTURBATIONS), F.lit(0))
    return wide.withColumn("robustness", total / 3.0).drop("_original", *[f"_{n}" for n in PERTURBATIONS])


def robustness_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean robustness, consistencies and accuracies."""
    names = ["robustness", *[f"consistency_{n}" for n in PERTURBATIONS], "original_correct", *[f"{n}_correct" for n in PERTURBATIONS]]
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in names]
    return df.groupBy(*(by or [])).agg(*means)


def combined_leaderboard(df: DataFrame, tasks: list[str] | None = None, min_rows: int = 100, correct: str = "correct") -> DataFrame:
    """Accuracy and interval per task and overall, one row per system, best first."""
    tasks = tasks or fv.TASKS
    counts = [F.count(correct).alias("n_Overall"), F.sum(correct).alias("k_Overall")]
    names = [fv.TASK_CODES.get(name, name) for name in tasks]
    for name, code in zip(tasks, names):
        hit = F.when(F.col("task") == name, F.col(correct))
        counts += [F.count(hit).alias(f"n_{code}"), F.coalesce(F.sum(hit), F.lit(0)).alias(f"k_{code}")]
    board = df.groupBy("model").agg(*counts).where(F.col("n_Overall") >= min_rows)
    columns = []
    for code in [*names, "Overall"]:
        ci = stats.wilson(f"k_{code}", f"n_{code}")
        columns += [ci["accuracy"].alias(code), ci["ci_lower"].alias(f"{code}_ci_lo"), ci["ci_upper"].alias(f"{code}_ci_hi")]
    return board.select("model", *columns).orderBy(F.desc("Overall"), "model")


def flag_best_worst(df: DataFrame, metrics: list[str]) -> DataFrame:
    """W5: 'best' / 'worst' per metric column; NULL metrics get no flag."""
    extremes = df.agg(F.struct(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("hi", F.max), ("lo", F.min))]).alias("x")).scalar()
    df = df.withColumn("_x", extremes)
    flags = {
        f"{m}_flag": F.when(F.col(m) == F.col(f"_x.hi_{m}"), "best").when(F.col(m) == F.col(f"_x.lo_{m}"), "worst")
        for m in metrics
    }
    return df.withColumns(flags).drop("_x")


def sweep_accuracy(df: DataFrame, verdicts: dict[float, Column]) -> DataFrame:
    """Accuracy (percent) per threshold: overall, per task and per system.

    All thresholds are counted in one pass over the rows; only the small count
    table is expanded to one row per threshold.
    """
    thresholds = list(verdicts)
    counted = df.groupBy("model", "task").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(verdicts[t]).cast("long").alias(f"k{i}") for i, t in enumerate(thresholds)],
    )
    sets = counted.groupingSets([[], ["task"], ["model"]], "model", "task").agg(
        F.sum("n").alias("n"), *[F.sum(f"k{i}").alias(f"k{i}") for i in range(len(thresholds))],
        F.grouping("model").alias("_gm"), F.grouping("task").alias("_gt"),
    )
    entries = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"k{i}").alias("n_correct")) for i, t in enumerate(thresholds)
    ])
    long = sets.select(
        F.when(F.col("_gm") == 1, TOTAL).otherwise(F.col("model")).alias("model"),
        F.when(F.col("_gt") == 1, TOTAL).otherwise(F.col("task")).alias("task"),
        "n", F.explode(entries).alias("_e"),
    )
    return long.select("model", "task", "_e.threshold", "n", "_e.n_correct").withColumn(
        "accuracy", F.round(100.0 * ratio("n_correct", "n"), 2)
    )


def stability_swing(sweep: DataFrame, window: tuple[float, float] = fv.STABILITY_WINDOW) -> DataFrame:
    """Range of the overall accuracy inside the stability window."""
    rows = sweep.where((F.col("model") == TOTAL) & (F.col("task") == TOTAL) & F.col("threshold").between(*window))
    return rows.agg((F.max("accuracy") - F.min("accuracy")).alias("swing"))


def sweep(df: DataFrame, verdicts: dict[float, Column]) -> DataFrame:
    """One row per prediction and threshold."""
    entries = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), v.alias("match")) for t, v in verdicts.items()])
    return df.withColumn("_e", F.explode(entries)).select(*df.columns, "_e.threshold", "_e.match")
