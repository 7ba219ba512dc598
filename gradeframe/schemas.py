"""Explicit schemas of the tables the library reads."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


ITEMS = T.StructType(_strings(
    "id", "task_type", "source", "document", "regulation", "context", "question",
    "answer", "answer_type", "difficulty", "document_a", "document_b",
    "regulation_a", "context_a", "context_b", "explanation",
))

PREDICTIONS = T.StructType(
    _strings("id", "task_type", "difficulty", "question", "ref_answer", "prediction")
    + [T.StructField("correct", T.IntegerType())]
    + _strings("model_version")
)

CONDITION_PREDICTIONS = T.StructType(
    _strings("id", "task_type", "difficulty", "condition", "question", "ref_answer", "prediction")
    + [T.StructField("correct", T.IntegerType())]
)

BASELINES = T.StructType(
    _strings("model_id", "label", "hf_id", "params", "type")
    + [
        T.StructField("overall", T.DoubleType()),
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("n_items", T.IntegerType()),
        T.StructField("submitted", T.StringType()),
    ]
)

SUBMISSIONS = T.StructType(
    _strings("model_id", "label", "hf_id", "params", "model_type")
    + [T.StructField(c, T.DoubleType()) for c in ("overall", "score_REG", "score_NUM", "score_CON", "score_TMP")]
    + [
        T.StructField("n_items", T.IntegerType()),
        T.StructField("submitted_at", T.TimestampType()),
        T.StructField("is_baseline", T.IntegerType()),
        T.StructField("notes", T.StringType()),
    ]
)

_DIMENSION = T.StructType([T.StructField("score", T.StringType()), T.StructField("reason", T.StringType())])
JUDGE_SCORES = T.StructType([
    T.StructField(name, _DIMENSION)
    for name in ("event_identification", "temporal_ordering", "final_state_answer")
])

RESULT_FIELDS = [
    "id", "task_type", "difficulty", "question", "ref_answer", "prediction", "correct", "model_version",
]
