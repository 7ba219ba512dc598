"""U4: word chunks as a table function for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The body is one generator over built-in functions, as in ``operators.documents.chunk_words``.
CHUNK_WORDS = r"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(content STRING, size INT, overlap INT)
RETURNS TABLE (chunk_index INT, word_start INT, chunk STRING)
RETURN SELECT CAST(start / (size - overlap) AS INT), start, array_join(slice(words, start + 1, size), ' ')
FROM (SELECT words, explode(sequence(0, size(words) - 1, size - overlap)) AS start
      FROM (SELECT filter(split(content, '[\\s\\p{{Z}}]+'), w -> w <> '') AS words) WHERE size(words) > 0)
"""


def register_chunk_words(spark: SparkSession, name: str = "chunk_words") -> None:
    """Make ``SELECT ... FROM t, LATERAL chunk_words(t.text, 400, 100)`` available, without Python in its plan."""
    spark.sql(CHUNK_WORDS.format(name=name))
