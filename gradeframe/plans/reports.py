"""Reports made of operators. Each returns a dict of named DataFrames.

Tables of one report share their inputs: scored rows or cells are written out
by ``keep`` when the caller names a folder, so that no branch repeats them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions import bands, scoring
from gradeframe.functions import features as feat
from gradeframe.functions import parsing, prompts
from gradeframe.functions import text as t
from gradeframe.functions.predictor import apply_predictor
from gradeframe.operators import accuracy as acc
from gradeframe.operators import agreement as agr
from gradeframe.operators import correlation as cor
from gradeframe.operators import documents as docs
from gradeframe.operators import errors as err
from gradeframe.operators import items as it
from gradeframe.operators import pairs as pr
from gradeframe.operators import retrieval as ret
from gradeframe.operators import sampling as smp
from gradeframe.operators import tables as tab
from gradeframe.operators.ranks import null_safe_join, value_ranks


def keep(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Write a shared intermediate to ``folder`` and read it back; without a folder leave it lazy."""
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_board(intervals: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """One row per system, ranked by overall accuracy, then by name: accuracy of each task, and overall with its interval.

    ``intervals`` is a table by model and task with OVERALL rows. Without
    ``tasks`` the four task names of the benchmark are the columns; a task
    without rows is NULL.
    """
    tasks = tasks or fv.TASKS
    overall = F.col("task") == acc.TOTAL

    def of(task: Column, value: str) -> Column:
        return F.max(F.when(task, F.col(value)))

    board = intervals.groupBy("model").agg(
        *[of(F.col("task") == t, "accuracy").alias(t) for t in tasks], of(overall, "accuracy").alias("overall"),
        of(overall, "ci_lower").alias("ci_lower"), of(overall, "ci_upper").alias("ci_upper"), of(overall, "n").alias("n"),
    )
    # Ranks by offsets of score ranges: systems with equal scores alone meet in one task.
    scored = board.withColumns({"_all": F.lit(0), "_score": -F.col("overall")})
    before = value_ranks(scored, ["_all"], "_score").select("_score", F.col("n_before").alias("_before"))
    place = F.row_number().over(Window.partitionBy("_score").orderBy("model"))
    placed = null_safe_join(scored.withColumn("_place", place), before, ["_score"])
    return placed.select((F.col("_before") + F.col("_place")).alias("rank"), *board.columns)


def evaluate(items: DataFrame, predictions: DataFrame, policy: str = "strict", folder: str | None = None, tasks: list[str] | None = None) -> dict[str, DataFrame]:
    """Scored rows, accuracies with intervals by system and task, and the ranked board.

    ``items`` has item_id, task, reference; ``predictions`` has item_id, model, prediction.
    """
    joined = tab.attach_attributes(predictions.withColumn("prediction", F.coalesce("prediction", F.lit(""))), items, "item_id", {"task": "", "reference": ""})
    scored = keep(scoring.score(joined, policy), folder, "scored")
    valid = acc.drop_failed(scored)
    table = keep(acc.with_wilson(acc.accuracy(valid, ["model", "task"])), folder, "intervals")
    return {"scored": scored, "leaderboard": table, "board": ranked_board(table, tasks)}


def full_report(
    long: DataFrame, tasks: list[str] | None = None, levels: list[str] | None = None, expected_rows: int | None = None, folder: str | None = None
) -> dict[str, DataFrame]:
    """Matrix, difficulty table, intervals, significance of all pairs, and runs of unexpected size.

    One cell table per system, task and difficulty feeds all but the pairs.
    """
    base = keep(acc.cells(long, ["model", "task", "difficulty"]), folder, "cells")
    by_task = acc.roll_up(base, ["model", "task"], [["model", "task"], ["model"]])
    out = {
        "matrix": acc.matrix_of(base, tasks),
        "difficulty": acc.levels_of(base, "difficulty", levels or fv.DIFFICULTIES),
        "intervals": acc.with_wilson(by_task),
        "significance": pr.paired_bootstrap(long),
    }
    if expected_rows is not None:
        out["incomplete"] = base.groupBy("model").agg(F.sum("n").alias("n")).where(F.col("n") != expected_rows)
    return out


def threshold_ablation(df: DataFrame, thresholds: list[float] | None = None) -> dict[str, DataFrame]:
    """Accuracy per threshold and the swing in the stability window."""
    rows, verdicts = scoring.sweep_verdicts(acc.drop_failed(df, any_case=True), thresholds)
    table = acc.sweep_accuracy(rows, verdicts)
    return {"sweep": table, "stability": acc.stability_swing(table)}


def agreement_report(pairs: DataFrame, ref: str = "reference", answer: str = "prediction", task: str = "task") -> dict[str, DataFrame]:
    """C4: agreement per task with its band; kappa of yes/no labels on contradiction items."""
    open_items = scoring.score(pairs.where(F.col(task) != fv.CONTRADICTION), "fuzzy", ref, answer, task, out="agree")
    labels = pairs.where(F.col(task) == fv.CONTRADICTION).withColumns({
        "gold": t.yn_label(t.normalise(ref), "unclear"), "label": t.yn_label(t.normalise(answer), "unclear"),
    })
    labelled = labels.withColumn("agree", (F.col("gold") == F.col("label")).cast("int"))
    rates = agr.agreement_rate(open_items.select(task, "agree").unionByName(labelled.select(task, "agree")), by=task)
    kappa = agr.cohen_kappa(labels, [task], overall=False).select(task, "kappa", "constant_labels")
    table = rates.join(kappa, task, "left")
    return {"agreement": table.withColumn("band", bands.agreement_band("agreement_pct")), "confusion": agr.confusion(labels, [task])}


def multi_rater_report(ratings: DataFrame, n_raters: int, by: str = "task") -> dict[str, DataFrame]:
    """Fleiss' kappa per task with its reading, and the items raters disagree on.

    A label that is neither yes nor no is an error; NULL is no label.
    """
    parsed = ratings.where(F.col("label").isNotNull()).withColumn("label", parsing.rater_label(F.col("label").cast("string"), strict=True))
    common = agr.common_raters(parsed, n_raters)
    table = agr.fleiss_kappa(common, by)
    return {"kappa": table.withColumn("interpretation", bands.kappa_band("fleiss_kappa")), "disagreement": agr.disagreement_items(common)}


def error_report(long: DataFrame) -> dict[str, DataFrame]:
    """Hardest tasks, spread, error types with shares, and example failures."""
    failed = err.failures(long)
    return {
        "ranking": acc.macro_average(long),
        "spread": acc.spread(long),
        "taxonomy": err.error_taxonomy(long),
        "taxonomy_by_task": err.error_taxonomy_by_task(long),
        "examples": err.examples_per_group(failed),
        "representative": err.first_per_group(failed),
    }


def item_analysis(long: DataFrame) -> dict[str, DataFrame]:
    """Item statistics, categories, consensus items and the most discriminative ones."""
    stats = it.item_stats(long)
    categories = it.item_category(stats)
    return {
        "items": categories,
        "summary": it.category_summary(categories),
        "consensus": it.consensus_items(stats),
        "top": it.top_discriminative(categories),
    }


def retrieval_compare(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, texts: DataFrame, base: DataFrame,
    predict: Callable[[str], str] | None = None, predict_batch: Callable[[list[str]], list[str]] | None = None,
    model: str = "retrieval", k: int = 3, folder: str | None = None, exclude_self: bool = False,
) -> dict[str, DataFrame]:
    """Questions answered from retrieved text, their accuracy, and the loss against a base accuracy.

    ``items`` has query_id, task, question, reference; ``queries`` (query_id,
    embedding) are compared with ``vectors`` (vec_id, embedding), whose texts are
    in ``texts`` (vec_id, text). The ``k`` best texts and the question become a
    prompt, which the user's function answers; answers are scored by
    containment. A question without a vector gets an empty context. ``base`` is
    an accuracy table by model and task.
    """
    context = keep(ret.retrieved_context(ret.top_k_similar(queries, vectors, k, exclude_self=exclude_self), texts), folder, "context")
    asked = items.join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    answered = apply_predictor(prompts.judge_prompt(asked, "retrieval"), predict, predict_batch=predict_batch)
    scored = keep(scoring.score(answered.withColumn("model", F.lit(model)), "containment"), folder, "answers")
    table = acc.accuracy(scored, ["model", "task"])
    return {"context": context, "scored": scored, "comparison": acc.condition_compare(base, table)}


def perturbed_items(items: DataFrame, context: str = "context", question: str = "question") -> DataFrame:
    """Each item in its original and three perturbed forms (one row per condition)."""
    forms = F.array(
        F.struct(F.lit("original").alias("condition"), F.col(context).alias("context"), F.col(question).alias("question")),
        F.struct(F.lit("date").alias("condition"), feat.perturb_years(context).alias("context"), feat.perturb_years(question).alias("question")),
        F.struct(F.lit("number").alias("condition"), feat.perturb_crore(context).alias("context"), F.col(question).alias("question")),
        F.struct(F.lit("synonym").alias("condition"), feat.perturb_synonyms(context).alias("context"), F.col(question).alias("question")),
    )
    rest = [c for c in items.columns if c not in (context, question)]
    return items.select(*rest, F.explode(forms).alias("f")).select(*rest, "f.*")


def perturbation_report(predictions: DataFrame) -> dict[str, DataFrame]:
    """Robustness of scored predictions (model, item_id, task, condition, reference, prediction)."""
    scored = scoring.score(predictions, "containment")
    per_item = acc.robustness(scored)
    return {"items": per_item, "overall": acc.robustness_summary(per_item), "by_task": acc.robustness_summary(per_item, ["task"])}


def scoring_audit(
    wrong: DataFrame, replies: DataFrame, n: int = 25, total: int = 100, key: str = "item_id", order: Column | None = None,
    accuracies: DataFrame | None = None, folder: str | None = None,
) -> dict[str, DataFrame]:
    """Sample of rejected answers, prompts for a judge, rates from the judge's replies, and corrected accuracies.

    ``replies`` has the item key, the model where ``wrong`` has one, and a
    ``reply`` column. An answer without a reply is UNKNOWN and counts; of several
    replies the smallest is read. ``order`` replaces the hash order of the sample.
    ``accuracies`` (task, accuracy, any others) are corrected by the false
    negatives of their task, or of all tasks where it has none.
    """
    sample = keep(smp.stratified_sample_topup(wrong, ["task"], n, total, key, key=order), folder, "sample")
    keys = [key, *({"model"} & set(wrong.columns))]
    one = replies.groupBy(*keys).agg(F.min("reply").alias("reply"))
    verdicts = sample.join(one, keys, "left").withColumn("_v", parsing.parse_verdict("reply"))
    audit = verdicts.select("*", "_v.verdict", "_v.reason").drop("_v")
    asked = prompts.judge_prompt(sample, "verdict") if {"question", "reference", "prediction"} <= set(sample.columns) else sample
    rates = keep(acc.audit_rates(audit), folder, "rates")
    out = {"sample": asked, "audit": audit, "rates": rates}
    if accuracies is not None:
        out["corrected"] = acc.fnr_correct(accuracies, rates)
    return out


def group_compare(long: DataFrame, groups: dict[str, str], a: str, b: str, replicates: int | None = None) -> dict[str, DataFrame]:
    """C11: pooled accuracy of two groups of systems and its (legacy, positional) significance."""
    return {
        "pooled": acc.pooled_group_accuracy(long, groups),
        "significance": pr.two_sample_bootstrap(long, groups, a, b, replicates=replicates),
    }


def human_baseline(answers: DataFrame, items: DataFrame, reference_pct: float = fv.HUMAN_GAP_REFERENCE) -> dict[str, DataFrame]:
    """Human answers scored by stage, accuracy per task, and gap to a reference system.

    Blank answers and answers to unknown items are left out.
    """
    given = answers.where(t.strip(F.coalesce(F.col("prediction"), F.lit(""))) != "")
    scored = scoring.score_with_stage(given.join(items.select("item_id", "reference"), "item_id"))
    table = acc.accuracy(scored, ["task"], overall=[])
    gap = F.round(100 * F.col("accuracy") - reference_pct, 4)
    reading = (
        F.when(gap > 3, fv.GAP_READINGS[0]).when(gap < -3, fv.GAP_READINGS[1]).otherwise(fv.GAP_READINGS[2])
    )
    overall = table.where(F.col("task") == acc.TOTAL).withColumns({"gap": gap, "reading": reading})
    return {"scored": scored, "by_task": table, "gap": overall}


def judge_agreement(first: DataFrame, second: DataFrame, keys: list[str] | None = None, p_value: bool = True) -> DataFrame:
    """Correlation of rubric scores of two judges and kappa of their final verdicts."""
    keys = keys or ["item_id", "model"]
    both = tab.judge_align(first, second, keys, ["rubric", "final_score"])
    out = cor.pearson(both, "rubric_j1", "rubric_j2", p_value=p_value).withColumnsRenamed({"r": "pearson_r", "p_value": "pearson_p"})
    spearman = cor.spearman(both, "rubric_j1", "rubric_j2", p_value=p_value)
    kappa = agr.cohen_kappa_binary(both, gold="final_score_j1", label="final_score_j2")
    out = out.withColumn("spearman_r", spearman.select("rho").scalar())
    if p_value:
        out = out.withColumn("spearman_p", spearman.select("p_value").scalar())
    return out.withColumn("kappa_final", kappa.select("kappa").scalar())


def tier_report(items: DataFrame, long: DataFrame, context: str = "context", question: str | None = "question") -> dict[str, DataFrame]:
    """Accuracy by complexity tier of the item text, its loss, and rank correlation with the score."""
    scored = feat.complexity_features(items, context, question).select("item_id", "complexity_score", "complexity_tier")
    rows = long.join(scored, "item_id")
    tiers = acc.accuracy_by_level(rows, "complexity_tier", ["Low", "Medium", "High"], clean=False)
    return {"tiers": tiers, "drop": acc.tier_drop(tiers), "correlation": cor.spearman(rows, "complexity_score", "correct", ["model"])}


def length_report(items: DataFrame, long: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """Accuracy against the length of the item text: summary, buckets, correlation, bins."""
    sized = items.withColumn("n_words", t.word_count(text)).select("item_id", "n_words")
    rows = long.join(sized, "item_id")
    return {
        "summary": docs.length_summary(sized, "n_words"),
        "buckets": docs.length_buckets(sized, "n_words"),
        "correlation": cor.pearson(rows, "n_words", "correct", ["model"]),
        "bins": docs.binned_accuracy(rows, "n_words", ["model"]),
    }
