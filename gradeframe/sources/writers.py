"""IO5: results as files with a fixed list of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe import schemas


def write_results(
    df: DataFrame, path: str, fmt: str = "parquet", fields: list[str] | None = None,
    partition_by: list[str] | None = None, mode: str = "overwrite",
) -> None:
    """Write ``fields`` (columns a frame lacks are NULL) as parquet, csv or json.

    Partitioning by model lets later reads of a few systems skip the rest.
    """
    keep = list(fields or schemas.RESULT_FIELDS)
    parts = partition_by or []
    out = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in [*keep, *[p for p in parts if p not in keep]]])
    writer = out.write.mode(mode).format(fmt)
    if parts:
        writer = writer.partitionBy(*parts)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.save(path)
