"""Agreement between raters.

Items collapse to confusion cells or vote patterns (a handful of rows per task);
every coefficient is arithmetic on those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.operators.accuracy import TOTAL


def common_raters(df: DataFrame, n_raters: int, item: str = "item_id", rater: str = "rater", label: str = "label") -> DataFrame:
    """Items every rater labelled, one row per item with its sorted votes."""
    votes = F.sort_array(F.collect_set(F.struct(F.col(rater).alias("r"), F.col(label).alias("l"))))
    keep = [c for c in df.columns if c not in (item, rater, label)]
    grouped = df.where(F.col(label).isNotNull()).groupBy(item, *keep).agg(votes.alias("_v"))
    one_each = F.filter("_v", lambda x, i: F.coalesce(F.try_element_at("_v", i + 2)["r"] != x["r"], F.lit(True)))
    labels = F.transform(one_each, lambda x: x["l"]).alias("votes")
    return grouped.select(item, *keep, labels).where(F.size("votes") == n_raters)


def rater_pairs(df: DataFrame, a, b, item: str = "item_id", rater: str = "rater", label: str = "label", keep: list[str] | None = None) -> DataFrame:
    """Labels of two raters side by side, on items both labelled."""
    def of(who, name):
        return F.max(F.when(F.col(rater) == who, F.col(label))).alias(name)

    both = df.where(F.col(rater).isin(a, b)).groupBy(item, *(keep or [])).agg(of(a, "gold"), of(b, "label"))
    return both.where(F.col("gold").isNotNull() & F.col("label").isNotNull())


def confusion(pairs: DataFrame, by: list[str] | None = None, gold: str = "gold", label: str = "label") -> DataFrame:
    """Count of each (gold, label) combination."""
    return pairs.groupBy(*(by or []), F.col(gold).cast("string").alias("gold"), F.col(label).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def cohen_kappa(pairs: DataFrame, by: list[str] | None = None, overall: bool = True) -> DataFrame:
    """Agreement and Cohen's kappa per group (and overall).

    Where both raters always give one label kappa is undefined: it is NULL,
    ``constant_labels`` is true, and agreement is the value to report.
    """
    by = by or []
    cells = confusion(pairs, by)
    if overall and by:
        flags = [F.grouping(c).alias(f"_g_{c}") for c in by]
        cells = cells.groupingSets([[*by, "gold", "label"], ["gold", "label"]], *by, "gold", "label").agg(F.sum("n").alias("n"), *flags)
        cells = cells.select(*[F.when(F.col(f"_g_{c}") == 1, TOTAL).otherwise(F.col(c)).alias(c) for c in by], "gold", "label", "n")
    sides = cells.select(*by, "gold", "label", "n", F.explode(F.array(
        F.struct(F.col("gold").alias("v"), F.col("n").alias("as_gold"), F.lit(0).cast("long").alias("as_label")),
        F.struct(F.col("label").alias("v"), F.lit(0).cast("long").alias("as_gold"), F.col("n").alias("as_label")),
    )).alias("s"))
    margins = sides.groupBy(*by, F.col("s.v").alias("v")).agg(
        F.sum("s.as_gold").alias("g"), F.sum("s.as_label").alias("l"),
        F.sum(F.when((F.col("gold") == F.col("label")), F.col("s.as_gold")).otherwise(0)).alias("same"),
    )
    table = margins.groupBy(*by).agg(
        F.sum("g").alias("n"), F.sum("same").alias("n_agree"),
        F.sum(F.col("g").cast("double") * F.col("l")).alias("_pe"),
        F.least(F.count_if(F.col("g") > 0), F.count_if(F.col("l") > 0)).alias("_levels"),
    )
    p_o = F.col("n_agree") / F.col("n")
    p_e = F.col("_pe") / (F.col("n").cast("double") * F.col("n"))
    return table.withColumns({
        "agreement": p_o,
        "kappa": F.when(p_e < 1, (p_o - p_e) / (1 - p_e)),
        "constant_labels": F.col("_levels") < 2,
    }).drop("_pe", "_levels")


def cohen_kappa_binary(pairs: DataFrame, by: list[str] | None = None, gold: str = "gold", label: str = "label") -> DataFrame:
    """Kappa of 0/1 labels from their means; 1 when chance agreement is certain."""
    a, b = F.col(gold).cast("double"), F.col(label).cast("double")
    means = pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(gold) == F.col(label)).cast("double")).alias("p_o"),
        F.avg(a).alias("_a"), F.avg(b).alias("_b"),
    )
    p_e = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return means.withColumn("p_e", p_e).withColumn(
        "kappa", F.when(F.col("p_e") < 1, (F.col("p_o") - F.col("p_e")) / (1 - F.col("p_e"))).otherwise(1.0)
    ).drop("_a", "_b")


def agreement_rate(df: DataFrame, agree: str = "agree", by: str = "task") -> DataFrame:
    """Share of agreeing items per task and overall."""
    counted = df.groupBy(by).agg(F.count(agree).alias("n"), F.sum(agree).cast("long").alias("n_agree"))
    table = counted.groupingSets([[by], []], by).agg(F.sum("n").alias("n"), F.sum("n_agree").alias("n_agree"), F.grouping(by).alias("_g"))
    table = table.withColumn(by, F.when(F.col("_g") == 1, TOTAL).otherwise(F.col(by))).drop("_g")
    return table.withColumn("agreement_pct", 100.0 * F.col("n_agree") / F.nullif(F.col("n").cast("double"), F.lit(0.0)))


def vote_patterns(common: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct vote vectors of items with their frequency."""
    return common.groupBy(*(by or []), F.sort_array("votes").alias("votes")).agg(F.count(F.lit(1)).alias("n_items"))


def fleiss_kappa(common: DataFrame, by: str = "task") -> DataFrame:
    """Fleiss' kappa and unanimity per task and overall, rounded to 4 places.

    ``common`` comes from ``common_raters``: every item has the same number of votes.
    """
    patterns = vote_patterns(common, [by])
    patterns = patterns.select(F.explode(F.array(F.col(by), F.lit(TOTAL))).alias(by), "votes", "n_items")
    squares = F.aggregate("votes", F.lit(0), lambda acc, v: acc + F.size(F.filter("votes", lambda x: x == v)))
    r = F.size("votes")
    per_item = patterns.withColumns({"_r": r, "_p": (squares - r) / (r * (r - 1.0)), "_one": F.size(F.array_distinct("votes")) == 1})
    item_side = per_item.groupBy(by).agg(
        F.sum("n_items").alias("n_items"), F.max("_r").alias("_r"),
        F.sum(F.col("_p") * F.col("n_items")).alias("_sp"),
        F.sum(F.when(F.col("_one"), F.col("n_items")).otherwise(0)).alias("n_unanimous"),
    )
    shares = per_item.select(by, "n_items", F.explode("votes").alias("v")).groupBy(by, "v").agg(F.sum("n_items").alias("c"))
    square_sum = shares.groupBy(by).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("_cc"))
    table = item_side.join(square_sum, by)
    p_bar = F.col("_sp") / F.col("n_items")
    votes = F.col("n_items").cast("double") * F.col("_r")
    p_e = F.col("_cc") / (votes * votes)
    return table.select(
        by, "n_items", (100.0 * F.col("n_unanimous") / F.col("n_items")).alias("agreement_pct"),
        F.when(p_e < 1, F.round((p_bar - p_e) / (1 - p_e), 4)).otherwise(1.0).alias("fleiss_kappa"),
    )


def disagreement_items(common: DataFrame) -> DataFrame:
    """Items whose raters differ."""
    return common.where(F.size(F.array_distinct("votes")) > 1)


def kappa_draws(counts: np.ndarray, replicates: int, rng: np.random.Generator) -> np.ndarray:
    """Kappa of multinomial resamples of a square confusion table; undefined ones are left out."""
    n = int(counts.sum())
    draws = rng.multinomial(n, (counts / n).ravel(), size=replicates).reshape(replicates, *counts.shape)
    p_o = np.trace(draws, axis1=1, axis2=2) / n
    p_e = (draws.sum(axis=2) * draws.sum(axis=1)).sum(axis=1) / (n * n)
    defined = p_e < 1
    return (p_o[defined] - p_e[defined]) / (1 - p_e[defined])


def bootstrap_ci_kappa(pairs: DataFrame, by: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """95 % percentile interval of Cohen's kappa per group, from its confusion cells."""
    cells = confusion(pairs, by)
    schema = T.StructType(
        [cells.schema[c] for c in by]
        + [T.StructField("n", T.LongType()), T.StructField("ci_lo", T.DoubleType()), T.StructField("ci_hi", T.DoubleType())]
    )

    def interval(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        labels = sorted(set(pdf["gold"]) | set(pdf["label"]))
        table = np.zeros((len(labels), len(labels)), dtype=np.int64)
        for g, l, n in zip(pdf["gold"], pdf["label"], pdf["n"]):
            table[labels.index(g), labels.index(l)] += n
        draws = kappa_draws(table, replicates, np.random.default_rng(seed))
        lo, hi = np.percentile(draws, [2.5, 97.5]) if len(draws) else (None, None)
        return pd.DataFrame([[*key, int(table.sum()), lo, hi]], columns=schema.names)

    return cells.groupBy(*by).applyInPandas(interval, schema)
