"""Cleaning and describing documents, links and listings in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import col, find_all, strip, word_count

MIN_WORDS = 50
PAGE_NUMBER_LINE = r"(?i)^(page\s+)?\d+(\s+of\s+\d+)?$"


def clean_text(raw: Column | str) -> Column:
    """Printable text, plain dashes and quotes, no page numbers or stub lines."""
    text = F.regexp_replace(F.coalesce(col(raw), F.lit("")), r"[\p{C}\p{Z}&&[^\n\t ]]", "")
    text = F.translate(text, "\u2013\u2014\u2018\u2019\u201c\u201d", "--''\"\"")
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda line: (F.length(line) >= 3) & ~line.rlike(PAGE_NUMBER_LINE))
    return F.array_join(kept, "\n")


def parse_status(n_words: Column | str) -> Column:
    """Success with at least 50 words, else empty."""
    return F.when(col(n_words) >= MIN_WORDS, "success").otherwise("empty")


def effective_status(status: Column | str, n_words: Column | str) -> Column:
    """A success without words counts as empty."""
    return F.when((col(status) == "success") & (col(n_words) == 0), "empty").otherwise(col(status))


def parse_report(df: DataFrame, text: str = "text") -> DataFrame:
    """T22 + T23: cleaned text, its word count and status."""
    return (
        df.withColumn(text, clean_text(text))
        .withColumn("word_count", word_count(text))
        .withColumn("status", parse_status("word_count"))
    )


def year_from_name(name: Column | str) -> Column:
    """First year 1980-2029 not inside a longer number."""
    return F.try_to_number(F.nullif(F.regexp_extract(col(name), fv.YEAR_IN_NAME, 1), F.lit("")), F.lit("9999")).cast("int")


def year_from_date(text: Column | str) -> Column:
    """First stand-alone year 1900-2099."""
    return F.try_to_number(F.nullif(F.regexp_extract(col(text), fv.YEAR_IN_DATE, 1), F.lit("")), F.lit("9999")).cast("int")


def infer_category(name: Column | str) -> Column:
    """First rule that matches wins, so "circular" shadows "master"."""
    lowered = F.lower(F.coalesce(col(name), F.lit("")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for fragment, label in fv.CATEGORY_RULES:
        out = out.when(lowered.contains(fragment), label)
    return out.otherwise("Other")


def slug_filename(prefix: Column | str, title: Column | str, date: Column | str, index: Column | str) -> Column:
    """PREFIX_date_slug_index.pdf with a slug of at most 55 characters."""
    day = F.left(F.translate(col(date).cast("string"), "/", "-"), F.lit(10))
    slug = F.regexp_replace(strip(F.regexp_replace(F.lower(col(title)), "[^a-z0-9 _-]", "")), r"\s+", "_")
    number = col(index).cast("string")
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    return F.concat(col(prefix), F.lit("_"), day, F.lit("_"), F.left(slug, F.lit(55)), F.lit("_"), padded, F.lit(".pdf"))


def absolute_url(href: Column, base: str, folder: str = "/") -> Column:
    return (
        F.when(href.startswith("http"), href)
        .when(href.startswith("/"), F.concat(F.lit(base), href))
        .otherwise(F.concat(F.lit(base + folder), href))
    )


def first_pdf_link(html: Column | str, base: str, extension: str = ".pdf") -> Column:
    """First anchor ending in ``extension``, else a raw URL, else a relative path."""
    page = col(html)
    ext = extension.replace(".", r"\.")
    anchors = F.transform(
        find_all(page, r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'][^\"']*[\"']"),
        lambda a: strip(F.regexp_extract(a, r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']$", 1)),
    )
    in_anchor = F.try_element_at(F.filter(anchors, lambda h: F.lower(h).endswith(extension.lower())), F.lit(1))
    raw_url = F.nullif(F.regexp_extract(page, rf"(?i)https?://[^\s\"'<>]+{ext}", 0), F.lit(""))
    relative = F.nullif(F.regexp_extract(page, rf"(?i)href=[\"']([^\"']+{ext})[\"']", 1), F.lit(""))
    return F.coalesce(absolute_url(in_anchor, base), raw_url, absolute_url(relative, base))


def listing_rows(
    df: DataFrame,
    html: str = "html",
    base: str = "",
    folder: str = "/",
    navigation: list[str] | None = None,
    accept: str | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Table rows with at least two cells and a titled link.

    ``accept`` is an optional pattern an address must match, besides paths from
    the root and ``.pdf`` files.
    """
    keys = by or []
    rows = df.select(*keys, F.posexplode(find_all(F.col(html), r"(?is)<tr\b[^>]*>.*?</tr>")).alias("row_index", "_row"))

    def plain(c: Column) -> Column:
        return strip(F.regexp_replace(c, r"(?s)<[^>]*>", ""))

    rows = rows.select(
        *keys,
        "row_index",
        F.transform(
            find_all(F.col("_row"), r"(?is)<td\b[^>]*>.*?</td>"),
            plain,
        ).alias("_cells"),
        plain(F.regexp_extract("_row", r"(?is)<a\b[^>]*\bhref\b[^>]*>(.*?)</a>", 1)).alias("title"),
        strip(F.regexp_extract("_row", r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)).alias("_href"),
    )
    kept = (F.size("_cells") >= 2) & (F.col("_href") != "") & (F.length("title") >= 8)
    for word in navigation if navigation is not None else fv.NAVIGATION_WORDS:
        kept = kept & ~F.lower(F.col("title")).contains(word)
    if accept is not None:
        href = F.col("_href")
        kept = kept & (href.startswith("/") | F.lower(href).endswith(".pdf") | href.rlike(accept))
    return rows.where(kept).select(
        *keys,
        "row_index",
        "title",
        F.col("_cells")[0].alias("date"),
        absolute_url(F.col("_href"), base, folder).alias("detail_url"),
    )
