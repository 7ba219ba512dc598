"""Text features and perturbations, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.bands import complexity_tier
from gradeframe.functions.text import col, find_all, word_count

#: What every match of a pattern begins with; a position is ruled out by its character before the pattern is tried.
OPENINGS = {
    fv.DATE_PATTERN: r"[\dJFMASOND]",
    fv.FEATURE_PATTERNS["num_numbers"]: r"\d",
    fv.FEATURE_PATTERNS["num_currencies"]: "[CcLlRr₹]",
    fv.FEATURE_PATTERNS["num_amendments"]: "[SsAaMmRrHh]",
    fv.FEATURE_PATTERNS["num_refs"]: "[SRCN]",
    fv.FEATURE_PATTERNS["num_conditions"]: "[IiWwPpSsNn]",
}

FEATURES = [
    "ctx_len", "q_len", "num_dates", "num_numbers", "num_currencies", "num_amendments",
    "num_refs", "num_conditions", "flesch_ease", "fk_grade", "sentence_count",
]


def _combined(context: str, question: str | None) -> Column:
    ctx = F.coalesce(F.col(context), F.lit(""))
    return ctx if question is None else F.concat(ctx, F.lit(" "), F.coalesce(F.col(question), F.lit("")))


def _quick(pattern: str) -> str:
    """The same matches; the opening is looked for first where it is known."""
    return f"(?={OPENINGS[pattern]})(?:{pattern})" if pattern in OPENINGS else pattern


def _distinct_matches(text: Column, pattern: str) -> Column:
    return F.size(F.array_distinct(find_all(text, _quick(pattern))))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(_quick(pattern)))


def complexity_features(df: DataFrame, context: str = "context", question: str | None = "question") -> DataFrame:
    """Dates, amendment wording, references and years, and their weighted score."""
    text = _combined(context, question)
    lowered = F.lower(text)
    df = df.withColumns({
        "num_dates": _distinct_matches(text, fv.DATE_PATTERN),
        "amendment_count": reduce(lambda a, b: a + b, [_count(lowered, p) for p in fv.AMENDMENT_STEMS]),
        "circular_refs": _count(lowered, fv.REFERENCE_WORDS),
        "context_len": word_count(context),
        "num_years": _distinct_matches(text, fv.YEAR_PATTERN),
    })

    def capped(name: str, limit: int) -> Column:
        return F.least(F.col(name) / F.lit(float(limit)), F.lit(1.0))

    raw = (
        0.3 * capped("num_dates", 5)
        + 0.4 * capped("amendment_count", 3)
        + 0.2 * capped("num_years", 4)
        + 0.1 * capped("circular_refs", 5)
    )
    df = df.withColumn("_raw", raw)
    return df.withColumns({
        "complexity_score": F.round("_raw", 3),
        "complexity_tier": complexity_tier("_raw"),
    }).drop("_raw")


def readability(n_words: Column, n_sentences: Column, n_syllables: Column) -> tuple[Column, Column]:
    """Reading ease and grade from words, sentences and vowel groups.

    Syllables are counted as vowel groups, which is not a dictionary count.
    """
    w, sentences, syllables = (F.greatest(n, F.lit(1)).cast("double") for n in (n_words, n_sentences, n_syllables))
    ease = 206.835 - 1.015 * (w / sentences) - 84.6 * (syllables / w)
    grade = 0.39 * (w / sentences) + 11.8 * (syllables / w) - 15.59
    return ease, grade


def text_features(
    df: DataFrame, context: str = "context", question: str | None = "question", readability_chars: int | None = None
) -> DataFrame:
    """Eleven surface features of an item.

    Readability is taken over the whole context, or over its opening
    ``readability_chars`` characters when given; short contexts get 50 and 10.
    """
    ctx = F.coalesce(F.col(context), F.lit(""))
    text = _combined(context, question)
    opening = ctx if readability_chars is None else F.left(ctx, F.lit(readability_chars))
    long_enough = F.length(ctx) > 50
    q_len = F.lit(0) if question is None else word_count(question)
    df = df.withColumns({
        "ctx_len": word_count(context),
        "q_len": q_len,
        "num_dates": _distinct_matches(text, fv.DATE_PATTERN),
        **{name: _count(text, pattern) for name, pattern in fv.FEATURE_PATTERNS.items()},
        # Both readings use the counts, which are columns so that each is made once.
        **({} if readability_chars is None else {"_words": word_count(opening)}),
        "_sentences": _count(opening, r"[.!?]+"),
        "_syllables": _count(F.lower(opening), r"[aeiouyàâäéèêëïîôöùûü]+"),
    })
    ease, grade = readability(F.col("ctx_len" if readability_chars is None else "_words"), F.col("_sentences"), F.col("_syllables"))
    df = df.withColumns({"flesch_ease": F.when(long_enough, ease).otherwise(50.0), "fk_grade": F.when(long_enough, grade).otherwise(10.0), "sentence_count": _count(text, r"[.;]")})
    return df.drop("_words", "_sentences", "_syllables")


def rewrite_matches(text: Column | str, pattern: str, rewrite) -> Column:
    """Replace every match by ``rewrite(match)``, a Column function.

    Literals and matches are zipped back together, since Spark SQL has no
    regular-expression replacement with a callback.
    """
    source = col(text)
    literals = F.split(source, pattern, -1)
    matches = F.transform(find_all(source, pattern), rewrite)
    return F.array_join(F.zip_with(literals, matches, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def perturb_years(text: Column | str, shift: int = 5) -> Column:
    """Move the years 1990-2025 by ``shift``."""

    def move(match: Column) -> Column:
        year = match.cast("int")
        return F.when(year.between(1990, 2025), (year + shift).cast("string")).otherwise(match)

    return rewrite_matches(text, fv.YEAR_PATTERN, move)


def perturb_crore(text: Column | str) -> Column:
    """Amounts in crore as millions, rounded half to even."""
    pattern = r"(?i)\d+(?:,\d+)*(?:\.\d+)?\s*crore"

    def convert(match: Column) -> Column:
        amount = F.translate(F.regexp_extract(match, r"^[\d,.]+", 0), ",", "").cast("double")
        return F.concat(F.rint(amount * 10).cast("decimal(38,0)").cast("string"), F.lit(" million"))

    return rewrite_matches(text, pattern, convert)


def perturb_synonyms(text: Column | str) -> Column:
    """Ordered, case-insensitive synonym replacement."""
    return reduce(lambda t, rule: F.regexp_replace(t, f"(?i){rule[0]}", rule[1]), fv.SYNONYMS, col(text))
