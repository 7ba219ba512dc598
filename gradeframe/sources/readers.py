"""IO1, IO2, IO4, IO6: files as tables with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe import schemas
from gradeframe.functions.bands import lookup
from gradeframe.operators.tables import find_column

#: Columns of a result file that may go by other names.
ROLES = {"prediction": "prediction", "reference": "ref_answer", "correct": "correct"}
#: Columns that are read of a result file.
MAX_COLUMNS = 64


def read_items(
    spark: SparkSession, path: str, schema: T.StructType = schemas.ITEMS, wrapper: str | None = None, lines: bool = False
) -> DataFrame:
    """IO1: a JSON array of items, or an object holding the array under ``wrapper``.

    Without ``wrapper`` the array is that of ``items``, of ``data``, or the
    object's first one; an object without any array is one item. Text that is no
    JSON is an error. A document of one array is one task; large collections are
    better kept as one object per line (``lines``), which Spark splits.
    """
    if lines:
        return spark.read.schema(schema).json(path)
    strict = {"mode": "FAILFAST"}
    text = F.regexp_replace("value", "^[\\s\ufeff]+", "")
    raw = spark.read.text(path, wholetext=True).select(text.alias("t")).where("t <> ''")
    is_array = F.col("t").startswith("[")
    fields = F.map_entries(F.from_json(F.when(~is_array, F.col("t")), T.MapType(T.StringType(), T.StringType()), strict))
    arrays = F.filter(fields, lambda f: f["value"].startswith("["))
    named = [F.filter(arrays, lambda f: f["key"] == name) for name in ([wrapper] if wrapper else ["items", "data"])]
    held = F.coalesce(*[F.get(found, F.lit(0))["value"] for found in (named if wrapper else [*named, arrays])])
    single = F.concat(F.lit("["), F.col("t"), F.lit("]"))
    items = F.when(is_array, F.col("t")).otherwise(F.coalesce(held, F.lit("[]") if wrapper else single))
    return raw.select(F.explode(F.from_json(items, T.ArrayType(schema), strict)).alias("i")).select("i.*")


def read_predictions(
    spark: SparkSession, path: str | list[str], registry: dict[str, str] | None = None,
    schema: T.StructType = schemas.PREDICTIONS, suffix: str = ".csv", max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """IO2: prediction files, each row tagged with its model.

    ``registry`` maps file stems to labels; other files keep their stem. Paths
    that match nothing give no rows. Columns are matched by header name: files
    may order them differently, use other known names of a role (see
    ``resolve_columns``), lack some (NULL) or have more (dropped). Files have up
    to ``max_columns`` columns. A file is read by one task, which meets its
    header first, so files are read once and never listed by header.
    """
    paths = [path] if isinstance(path, str) else path
    readable = [p for p in paths if _exists(spark, p)]
    if not readable:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("model", T.StringType())]))
    given = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(max_columns)])
    lines = spark.read.schema(given).option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(readable)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    texts = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField("_file", T.StringType())])
    rows = lines.select("*", F.col("_metadata.file_path").alias("_path"), name.alias("_file")).mapInArrow(_by_header(schema.names), texts)

    def column(field: T.StructField):
        kind = field.dataType
        return (F.col(field.name) if isinstance(kind, T.StringType) else F.trim(field.name).try_cast("double").try_cast(kind)).cast(kind).alias(field.name)

    stem = F.regexp_replace("_file", rf"{suffix.replace('.', chr(92) + '.')}$", "")
    label = stem if not registry else lookup(stem, registry, stem)
    return rows.select(*[column(f) for f in schema.fields], label.alias("model"))


def _by_header(wanted: list[str]):
    """Rows of files one after the other, each led by its header, in the ``wanted`` columns."""
    roles = {name: role for role, name in ROLES.items() if name in wanted}

    def places(header: list[str | None]) -> list[int | None]:
        names = [(name or "").lstrip("\ufeff").strip() for name in header]
        found = {name: find_column(names, role) for name, role in roles.items() if name not in names}
        return [names.index(n) if (n := found.get(name) or name) in names else None for name in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = None, []
        for batch in batches:
            paths = batch.column("_path").dictionary_encode()
            codes = paths.indices.to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for start, end in zip(starts, starts[1:]):
                path, first = paths.dictionary[int(codes[start])].as_py(), start
                if path != known:
                    known, at = path, places([batch.column(i)[start].as_py() for i in range(batch.num_columns - 2)])
                    first += 1
                rows = batch.slice(first, end - first)
                columns = [rows.column(i) if i is not None else pa.nulls(rows.num_rows, pa.string()) for i in at]
                yield pa.RecordBatch.from_arrays([*columns, rows.column("_file")], [*wanted, "_file"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1)
        return True
    except AnalysisException:
        return False


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """IO4: one row per text file below ``path`` (source, file, text)."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    )


def read_prompt_templates(spark: SparkSession, path: str, by_folder: str | None = None) -> DataFrame:
    """IO6: one template per task, named by its file, or by the value of its folder ``by_folder=value``."""
    files = read_corpus(spark, path, "*.txt")
    name = F.regexp_replace("source", r"\.txt$", "") if by_folder is None else F.url_decode(F.regexp_extract("path", rf"/{by_folder}=([^/]*)/", 1))
    return files.select(name.alias("task_type"), F.col("text").alias("template"))


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Published results with a map of task scores (see ``explode_scores``)."""
    return spark.read.schema(schemas.BASELINES).option("multiLine", True).json(path)
