"""Run a user's prediction function over prompts, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.operators.tables import resume_remaining

#: Rows whose texts and answers are Python objects at once.
ROWS = 256


def apply_predictor(
    df: DataFrame, predict: Callable[[str], str] | None = None, prompt: str = "prompt", out: str = "prediction",
    done: DataFrame | None = None, keys: list[str] | None = None,
    predict_batch: Callable[[list[str]], list[str]] | None = None, batch: int = 32,
) -> DataFrame:
    """Add predictions; an exception becomes ``FAIL:`` and at most 80 characters of its message.

    ``predict`` gets one prompt; ``predict_batch`` up to ``batch`` of them at
    once, and a batch that fails, or returns another number of predictions, is
    split until the prompt at fault stands alone. With ``done`` only items
    without a good result are run, so a job that was lost is repeated from the
    written results. A worker gets the prompts alone, whatever other columns
    stand beside them, and holds the texts and answers of about ROWS rows
    besides the batch that Spark hands it.
    """
    if (predict is None) == (predict_batch is None):
        raise ValueError("give one of predict and predict_batch")
    if done is not None:
        df = resume_remaining(df, done, keys, out)
    def several(texts: list[str]) -> list[str]:
        try:
            found = [predict(texts[0])] if predict_batch is None else list(predict_batch(texts))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} predictions for {len(texts)} prompts")
            return found
        except Exception as error:  # noqa: BLE001 - any failure of user code is a failed row
            if len(texts) == 1:
                return [f"FAIL: {str(error)[:80]}"]
            half = len(texts) // 2
            return several(texts[:half]) + several(texts[half:])

    size = 1 if predict_batch is None else batch
    step = size * max(1, ROWS // size)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            for start in range(0, len(rows), step):
                texts = rows.slice(start, step).to_pylist()
                made = [x for i in range(0, len(texts), size) for x in several(texts[i : i + size])]
                yield pa.array(made, pa.string())

    # Not deterministic, so that Spark neither repeats nor moves the calls.
    rest = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.select(*rest, run.asNondeterministic()(prompt).alias(out))
