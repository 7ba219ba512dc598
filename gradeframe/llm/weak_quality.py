"""A quality classifier from overlapping heuristic labellers.

Labellers vote good, bad or abstain on every document. Expectation-maximisation
over the counts of vote patterns estimates each labeller's accuracy; there are
at most 3 ** labellers patterns, whatever the corpus. The posterior of a
document's pattern becomes a soft label, and a linear scorer on hashed tokens
learns from a bounded sample of them, so that it also judges documents on which
all labellers abstain. Every document is scored, on its whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.functions.text import sealed
from gradeframe.llm.shared import written

#: Documents that the scorer is fitted on, about; chosen by a hash, all if there are fewer.
TRAINING_ROWS = 20_000
FEATURES = 1 << 16
ROUNDS = 200

SEPARATORS = "[\\x20\\x09-\\x0D]+"


def _vote(good: Column | None, bad: Column) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def labellers() -> dict[str, Column]:
    """Votes 1 (good), -1 (bad) or 0 (abstains) from the measurements of ``votes``. Most know one kind of bad text and abstain otherwise."""
    n, w = F.col("chars"), F.col("n_words")
    noisy = (w >= 20) & (F.col("n_marks") / n > 0.08)
    return {
        "marks": _vote(~noisy, noisy),
        "symbols": _vote(None, F.col("symbols") / w > 0.2),
        "loose_marks": _vote(None, F.col("n_loose") / w > 0.2),
        "capitals": _vote(None, F.col("capitals") / n > 0.5),
        "exclamations": _vote(None, F.col("exclamations") / w > 0.3),
        "bars": _vote(None, F.col("bars") / w > 0.2),
        "stutter": _vote(None, F.col("n_again") / w > 0.3),
        "variety": _vote(None, (w >= 50) & (w < 2000) & (F.col("n_distinct") / w < 0.3)),
        "sentences": _vote(None, (w >= 30) & (F.col("ends") / w < 0.002)),
    }


AGAIN = "<again>"


def _split(docs: DataFrame) -> DataFrame:
    """Add _t (text, not null), _w (words) and _g (their hashes)."""
    rows = sealed(docs.withColumn("_t", F.coalesce("text", F.lit(""))), _w=F.array_remove(F.split("_t", SEPARATORS), ""))
    return sealed(rows, _g=F.transform("_w", lambda x: F.xxhash64(x)))


def _again() -> Column:
    g = F.col("_g")
    return F.filter(g, lambda x, i: x == F.get(g, i - 1))


def votes(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (doc_id, text), ``n_words`` and ``pattern``: the votes in base 3."""
    t, m = F.col("_t"), F.col("_m")
    rows = sealed(_split(docs), _m=F.regexp_replace(t, "[\\p{L}\\p{N}\\s]+", ""))

    def among(chars: str) -> Column:
        return F.length(m) - F.length(F.translate(m, chars, ""))

    rows = rows.withColumns({
        "n_words": F.size("_w"), "n_distinct": F.size(F.array_distinct("_g")), "chars": F.length(t), "n_marks": F.length(m), "n_again": F.size(_again()),
        "n_loose": F.size(F.regexp_extract_all(t, F.lit("(?<!\\S)[^\\p{L}\\p{N}\\s]+(?!\\S)"), F.lit(0))), "capitals": F.length(F.regexp_replace(t, "[^A-Z]+", "")),
        "symbols": among("#*$%&<>"), "exclamations": among("!"), "bars": among("|"), "ends": among(".?"),
    })
    pattern = F.lit(0)
    for vote in labellers().values():
        pattern = pattern * 3 + F.coalesce(vote, F.lit(0)) + 1
    return rows.withColumn("pattern", pattern).select(*docs.columns, "n_words", "pattern")


def tokens(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and the scorer's ``tokens``: word shapes (runs of capitals, small letters and digits are one letter each) and a mark per word that repeats the one before."""
    shapes = F.regexp_replace(F.regexp_replace(F.regexp_replace("_t", "\\p{Lu}+", "A"), "\\p{Ll}+", "a"), "\\p{Nd}+", "0")
    again = F.transform(_again(), lambda x: F.lit(AGAIN))
    return sealed(_split(docs), tokens=F.concat(F.array_remove(F.split(shapes, SEPARATORS), ""), again)).select(*docs.columns, "tokens")


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1).

    Gives the posterior of good for each pattern, P(vote | class) as
    [labeller, class, vote + 1] for the classes bad and good, and the prior of
    good. Starts from "bad if any labeller says so" and adds half a count per
    cell, so labellers that never vote do no harm.
    """
    n = patterns.shape[1]
    posterior = np.where((patterns < 0).any(1), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        table = np.full((n, 2, 3), 0.5)
        for v in (-1, 0, 1):
            table[:, :, v + 1] += np.einsum("cn,nl->lc", weight, (patterns == v).astype(float))
        table /= table.sum(2, keepdims=True)
        logs = np.log(table)[np.arange(n)[None, :], :, patterns + 1].sum(1) + np.log([1 - prior, prior])
        after = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        done, posterior = np.abs(after - posterior).max() < 1e-10, after
        if done:
            break
    return posterior, table, prior


def label_model(docs: DataFrame) -> DataFrame | None:
    """(pattern, posterior, n) of every vote pattern among ``docs``: at most 3 ** labellers rows; None if no text has words."""
    counts = [tuple(r) for r in votes(docs.select("doc_id", "text")).where("n_words > 0").groupBy("pattern").count().collect()]
    if not counts:
        return None
    codes = np.array([c for c, _ in counts])
    patterns = codes[:, None] // 3 ** np.arange(len(labellers()) - 1, -1, -1) % 3 - 1
    posterior, _, _ = fit_accuracies(patterns, np.array([n for _, n in counts], float))
    return docs.sparkSession.createDataFrame(list(zip(codes.tolist(), posterior.tolist(), [n for _, n in counts], strict=True)), "pattern int, posterior double, n long")


def score_quality(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, any others) with score and accepted.

    ``score`` is the linear scorer's probability of good; a document is accepted
    from 0.5 on. Texts without words (null, empty, blank) are rejected with
    score 0. If all of the sample is of one class, so is every text with words. Repeated rows and null ids are judged like any other; columns
    named score and accepted are replaced; an empty table gives no rows.
    """
    docs = docs.drop("score", "accepted")
    clash = [c for c in docs.columns if c in ("tokens", "counts", "features", "rawPrediction", "probability", "prediction") or c.startswith("_")]
    rows = docs.withColumnsRenamed({c: f"own {c}" for c in clash})
    told = label_model(docs)
    if told is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("accepted", F.lit(False))
    hashed = HashingTF(numFeatures=FEATURES, inputCol="tokens", outputCol="counts")
    unit = Normalizer(inputCol="counts", outputCol="features")
    share = training_rows / told.agg(F.sum("n")).first()[0]
    sample = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_hash")).where(F.col("text").isNotNull() & (F.col("_hash") / 2.0**64 + 0.5 < share))
    sample = sample.dropDuplicates(["_hash"])
    sample = tokens(votes(sample).where("n_words > 0").join(F.broadcast(told), "pattern").select("doc_id", "text", "posterior"))
    sides = F.array(*[F.struct(F.lit(float(y)).alias("label"), (F.col("posterior") if y else 1 - F.col("posterior")).alias("weight")) for y in (0, 1)])
    sample = written(unit.transform(hashed.transform(sample)).select("features", F.explode(sides).alias("side")).select("features", "side.*").where("weight > 0.001"), "sample")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(sample)
    scored = fitted.transform(unit.transform(hashed.transform(tokens(rows))))
    score = F.when(F.size("tokens") > 0, vector_to_array("probability")[1]).otherwise(0.0)
    return scored.select(*[F.col(f"`own {c}`").alias(c) if c in clash else F.col(c) for c in docs.columns], score.alias("score"), (score >= 0.5).alias("accepted"))
