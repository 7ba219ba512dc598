"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure is a bit of ``failures``
beside the measurements. Policies are versioned sets of rules applied to the
ledger afterwards, and ablations count documents from the bits alone, so a new
policy never reads a text again. Built-in functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.functions.text import sealed

#: Fixed values of the contract: separators, symbols, words of a repeated window.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
WINDOW = 8


class Rule(NamedTuple):
    name: str
    fails: Column | str


#: In the order of their bits; append only, so that old ledgers stay readable.
RULES = [
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
    Rule("exclamations", "3 * n_exclamations > n_words"),
    Rule("stutter", "100 * n_stutters > 30 * n_words"),
]
BASE = ["few_words", "repeated_words"]
#: Versioned policies: a document is dropped if it fails any named rule.
POLICIES = {
    "2024-1": [*BASE, "symbols", "repeated_lines"],
    "2024-2": [*BASE, "symbols", "repeated_lines", "short_words", "long_words", "capitals", "exclamations", "stutter"],
}
CURRENT = "2024-2"


def mask(names: list[str]) -> int:
    """The bits of the named rules."""
    return sum(1 << [r.name for r in RULES].index(n) for n in names)


def _kept_length(text: Column, dropped: str) -> Column:
    """Characters of a text outside the class ``dropped``."""
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def _covered(places: Column) -> Column:
    """Words covered by the windows that begin at the rising ``places``."""
    steps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def _doubled(hashes: Column, width: int) -> Column:
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + width)))


def measured(docs: DataFrame) -> DataFrame:
    """Add nothing but measurements: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...).

    Null text counts as empty; a word is ``[^\\x20\\x09-\\x0D]+``.
    """
    t, w, g = F.col("_text"), F.col("_words"), F.col("_hashes")
    docs = sealed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), _words=F.array_remove(F.split(t, SEPARATORS), ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    docs = sealed(docs, _lines=lines, _hashes=F.transform(w, lambda x: F.xxhash64(x)))
    docs = docs.select("doc_id", "_hashes", *[c.alias(n) for n, c in {
        "n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": _kept_length(t, "[^#*$%&|<>]+"), "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_capitals": _kept_length(t, "[^A-Z]+"), "n_exclamations": _kept_length(t, "[^!]+"),
        "n_stutters": F.size(F.filter(g, lambda x, i: x == F.get(g, i - 1))).cast("long"),
    }.items()])
    # A window's hash by doubling: one word, two, four, eight.
    width = 1
    while width < WINDOW:
        docs = sealed(docs, _hashes=_doubled(g, width))
        width *= 2
    docs = sealed(docs, _windows=F.when(F.size(g) >= WINDOW, F.slice(g, F.lit(1), F.size(g) - WINDOW + 1))).drop("_hashes")
    # Windows found twice: sort by hash, compare neighbours, go back to text order. Most texts have none.
    h = F.col("_windows")
    repeats = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    docs = sealed(docs, _pairs=repeats)
    s = F.col("_pairs")
    twice = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"]))
    docs = sealed(docs.drop("_windows"), _places=F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    return docs.drop("_pairs").withColumn("n_repeat_words", F.coalesce(_covered(F.col("_places")), F.lit(0)).cast("long")).drop("_places")


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, measurements and ``failures``, a bit per failed rule.

    Null and empty texts measure zero throughout (and so fail ``few_words``);
    null and repeated doc_ids keep their rows; other columns are not read.
    """
    rows = sealed(measured(docs), n_repeat_words=F.col("n_repeat_words"))
    bits = [F.when(F.expr(r.fails) if isinstance(r.fails, str) else r.fails, 1 << i).otherwise(0) for i, r in enumerate(RULES)]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return rows.withColumn("failures", failures.cast("long"))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Add ``kept`` by a policy to a ledger."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(mask(POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_alone): documents failing a rule, and those that only this rule of the policy drops.

    One aggregate over distinct failure masks, of which there are at most two to
    the power of the number of rules.
    """
    names = POLICIES[version]
    counts = rows.groupBy(F.col("failures").bitwiseAND(mask(names)).alias("f")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).alias("bit")) for n in names]))
    told = counts.select("f", "n", each.alias("r")).select("f", "n", "r.*")
    hit = F.col("f").bitwiseAND(F.col("bit")) != 0
    return told.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("f") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"))
