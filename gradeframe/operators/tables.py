"""Normalising, matching and extending tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions import bands
from gradeframe.session import ensure_checkpoint_dir


def find_column(columns: list[str], role: str) -> str | None:
    """The column that plays a role, by exact name, then by fragment."""
    exact, fragments = fv.COLUMN_ROLES[role]
    for name in exact:
        if name in columns:
            return name
    if role == "id":
        return next((c for c in columns if c.lower() in ("id", "item_id", "idx")), columns[0])
    return next((c for c in columns if any(f in c.lower() for f in fragments)), None)


def resolve_columns(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Rename columns to role names; a table without correctness is an error."""
    roles = roles or {"id": "id", "task": "task_type", "prediction": "prediction", "reference": "ref_answer", "correct": "correct"}
    renames = {}
    for role, target in roles.items():
        found = find_column(df.columns, role)
        if found is None and role == "correct":
            raise KeyError(f"no correctness column among {df.columns}")
        if found is not None and found != target and target not in df.columns and found not in renames:
            renames[found] = target
    return df.withColumnsRenamed(renames)


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def canonicalise_items(df: DataFrame, id_prefix: str = "item_", default_source: str = "SEBI") -> DataFrame:
    """Raw items in the canonical schema."""
    raw_id = _or_null(df, "id").cast("string")
    two = F.coalesce(_or_null(df, "task_type") == fv.CONTRADICTION, F.lit(False))
    passages = F.concat(
        F.lit("Passage A:\n"), F.coalesce(_or_null(df, "context_a"), F.lit("")),
        F.lit("\n\nPassage B:\n"), F.coalesce(_or_null(df, "context_b"), F.lit("")),
    )
    unknown = F.lit("unknown")
    document = F.when(
        two, F.coalesce(_or_null(df, "document_a"), _or_null(df, "document"), _or_null(df, "regulation_a"), unknown)
    ).otherwise(F.coalesce(_or_null(df, "document"), _or_null(df, "regulation"), unknown))
    return df.select(
        F.when(raw_id.startswith(id_prefix), raw_id).otherwise(F.concat(F.lit(id_prefix), raw_id)).alias("id"),
        F.coalesce(_or_null(df, "task_type"), F.lit("")).alias("task_type"),
        F.lower(F.coalesce(_or_null(df, "difficulty"), F.lit("medium"))).alias("difficulty"),
        F.upper(F.coalesce(_or_null(df, "source"), F.lit(default_source))).alias("source"),
        F.when(two, passages).otherwise(F.coalesce(_or_null(df, "context"), F.lit(""))).alias("context"),
        F.coalesce(_or_null(df, "question"), F.lit("")).alias("question"),
        F.coalesce(_or_null(df, "answer"), F.lit("")).alias("reference_answer"),
        document.alias("source_document"),
    )


def project_result(df: DataFrame, policy: str = "evaluate", question: str = "question", reference: str = "ref_answer", prediction: str = "prediction") -> DataFrame:
    """P5: stored lengths of one result policy. Score first: scoring needs the whole text."""
    lengths = dict(zip((question, reference, prediction), fv.RESULT_LENGTHS[policy]))
    return df.withColumns({c: F.left(F.col(c), F.lit(n)) for c, n in lengths.items() if n is not None and c in df.columns})


def resume_remaining(items: DataFrame, done: DataFrame, keys: list[str] | None = None, prediction: str = "prediction") -> DataFrame:
    """Items without a result that did not fail."""
    keys = keys or ["item_id"]
    ok = done.where(~F.coalesce(F.col(prediction).contains(fv.FAILED), F.lit(False)))
    return items.join(ok.select(*keys).distinct(), keys, "left_anti")


def attach_predictions(questions: DataFrame, predictions: DataFrame, key: str = "item_id", prediction: str = "prediction") -> DataFrame:
    """Every question once with its prediction, empty where there is none; of several the smallest."""
    one = predictions.groupBy(key).agg(F.min(prediction).alias(prediction))
    joined = questions.join(one, key, "left")
    return joined.withColumn(prediction, F.coalesce(F.col(prediction), F.lit("")))


def submission_counts(attached: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Questions with a prediction, and questions in all."""
    return attached.agg(F.count_if(F.col(prediction) != "").alias("n_scored"), F.count(F.lit(1)).alias("n_total"))


def attach_attributes(df: DataFrame, attributes: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Attributes by key; a missing key or value gets the default."""
    joined = df.join(attributes.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def judge_align(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Judgements of two judges on the same predictions, with suffixes."""
    a = first.select(*keys, *[F.col(v).alias(f"{v}_j1") for v in values])
    b = second.select(*keys, *[F.col(v).alias(f"{v}_j2") for v in values])
    return a.join(b, keys)


def concat_runs(*frames: DataFrame) -> DataFrame:
    """K1: union by name; columns a run lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_items(a: DataFrame, b: DataFrame, key: str = "item_id") -> DataFrame:
    """K2: ids in both tables."""
    return a.select(key).intersect(b.select(key))


def pool_without(df: DataFrame, subset: DataFrame, key: str = "item_id") -> DataFrame:
    """K3: rows whose id is not in the subset."""
    return df.join(subset.select(key), key, "left_anti")


def dedupe(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """K4: the first row of every key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


REQUIRED = ["id", "task_type", "source", "question", "answer", "difficulty"]
REQUIRED_SINGLE = ["document", "context"]
REQUIRED_DOUBLE = ["document_a", "context_a"]


def validate_batch(existing: DataFrame, batch: DataFrame, key: str = "id", required: list[str] | None = None) -> DataFrame:
    """K5: violations (id, violation): duplicates in the batch, ids already present, missing fields."""
    def absent(name: str) -> Column:
        return F.col(name).isNull() if name in batch.columns else F.lit(True)

    def any_absent(names: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [absent(n) for n in names], F.lit(False))

    if required is None:
        incomplete = any_absent(REQUIRED) | (any_absent(REQUIRED_SINGLE) & any_absent(REQUIRED_DOUBLE))
    else:
        incomplete = any_absent(required)

    def labelled(df: DataFrame, label: str) -> DataFrame:
        return df.select(F.col(key).cast("string").alias("id"), F.lit(label).alias("violation"))

    duplicates = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    conflicts = batch.select(key).distinct().join(existing.select(key), key, "left_semi")
    return (
        labelled(duplicates, "duplicate_in_batch")
        .unionByName(labelled(conflicts, "already_present"))
        .unionByName(labelled(batch.where(incomplete), "missing_field"))
    )


def merge_batch(existing: DataFrame, batch: DataFrame, key: str = "id", required: list[str] | None = None) -> DataFrame:
    """K6: the union, or the existing table alone when the batch has any violation."""
    violations = validate_batch(existing, batch, key, required)
    none = violations.select(F.count(F.lit(1))).scalar() == 0
    return existing.unionByName(batch.where(none), allowMissingColumns=True)


def seed_baselines(board: DataFrame, baselines: DataFrame, key: str = "hf_id") -> DataFrame:
    """K7: baselines not on the board yet are added, flagged as baselines."""
    new = dedupe(baselines, [key], [F.desc("overall")]).join(board.select(key).distinct(), key, "left_anti")
    return board.unionByName(new.withColumn("is_baseline", F.lit(1)), allowMissingColumns=True)


def with_model_id(df: DataFrame, hf_id: str = "hf_id") -> DataFrame:
    """K8: model id is the last segment of the repository path."""
    return df.withColumn("model_id", F.element_at(F.split(F.col(hf_id), "/"), -1))


def append_result(board: DataFrame, results: DataFrame) -> DataFrame:
    """K8: results appended with their model id and no baseline flag."""
    rows = with_model_id(results).withColumn("is_baseline", F.lit(0))
    return board.unionByName(rows, allowMissingColumns=True)


def ingest_new_docs(known: DataFrame, found: DataFrame, order: str, url: str = "url", title: str = "title") -> DataFrame:
    """K9: documents whose address and title are both unknown, taken in ``order``, which is unique.

    A document is taken unless its address or its title is that of one taken
    before; a missing address or title is no clash. Runs at once, in rounds: the
    first document left of both its address and its title is taken, and what
    clashes with it goes. Rounds are few unless clashes form long chains.
    """
    ensure_checkpoint_dir(found.sparkSession)
    left = found
    for name in (url, title):
        left = left.join(known.select(name).where(F.col(name).isNotNull()).distinct(), name, "left_anti")
    left, taken = left.select(*found.columns).checkpoint(), None
    while left.take(1):
        clear = F.lit(True)
        firsts = left
        for i, name in enumerate((url, title)):
            first = left.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias(f"_first{i}"))
            firsts = firsts.join(first, name, "left")
            clear = clear & (F.col(name).isNull() | (F.col(order) == F.col(f"_first{i}")))
        now = firsts.where(clear).select(*found.columns).checkpoint()
        taken = now if taken is None else taken.unionByName(now)
        rest = left.join(now.select(order), order, "left_anti")
        for name in (url, title):
            rest = rest.join(now.select(name).where(F.col(name).isNotNull()), name, "left_anti")
        left = rest.select(*found.columns).checkpoint()
    return left if taken is None else taken
