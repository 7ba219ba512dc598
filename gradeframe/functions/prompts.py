"""Prompt and display text, one string expression per row."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import col, truncate_words
from gradeframe.operators.ranks import spread_join

# Closing lines of a question, by task, per prompt style.
CLOSINGS = {
    "zero_shot": {
        "contradiction_detection": "Answer with 'Yes' or 'No' then one sentence of explanation:",
        "numerical_reasoning": "Show your calculation and give the final answer with units:",
        "temporal_reasoning": "Answer precisely, noting relevant dates or sequences:",
        "default": "Answer:",
    },
    "annotator": {
        "contradiction_detection": (
            "Answer (write 'Yes' or 'No' first, then one sentence of explanation "
            "using only the two passages above):"
        ),
        "numerical_reasoning": (
            "Answer (show your calculation and final answer with units, "
            "using only numbers from the context passage):"
        ),
        "temporal_reasoning": (
            "Answer (pay close attention to amendment dates, 'prior to', "
            "and 'w.e.f.' language in the context):"
        ),
        "default": "Answer (using only the context passage above):",
    },
    "hosted": {
        "contradiction_detection": (
            "Answer Yes or No, then give a one-sentence explanation "
            "of why the passages contradict or don't contradict."
        ),
        "numerical_reasoning": "Show your calculation steps and include the unit in your final answer.",
        "default": "Give the exact answer as it appears in or is derivable from the context.",
    },
}

# Headings and caps per style. Passage caps are (kind, A, B).
STYLES = {
    "zero_shot": {"heading": "Context", "passage": "Passage", "question": "Question", "caps": ("chars", 1500, 1500), "words": 450},
    "demo": {"heading": "Context", "passage": "Passage", "question": "Question", "caps": ("words", 200, 200), "words": 450},
    "annotator": {"heading": "Context passage", "passage": "Passage", "question": "Question", "caps": None, "words": None},
    "hosted": {"heading": "CONTEXT", "passage": "PASSAGE", "question": "QUESTION", "caps": ("chars", 1500, 800), "words": None},
}


# What a condition adds to the instructions that go before the prompt, and how many solved examples it shows.
CONDITIONS = {"zero_shot": ("", 0), "zero_shot_cot": ("Think step by step before answering.", 0), "one_shot": ("", 1), "three_shot": ("", 3)}


def _text(name: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _capped(c: Column, caps, side: int) -> Column:
    if caps is None:
        return c
    return F.left(c, F.lit(caps[side])) if caps[0] == "chars" else truncate_words(c, caps[side])


def build_prompt(
    df: DataFrame, style: str = "zero_shot", task: str = "task_type", examples: str | None = None, out: str = "prompt"
) -> DataFrame:
    """The prompt of each item; ``examples`` names a column of ready example text."""
    layout = STYLES[style]
    closings = CLOSINGS["zero_shot" if style == "demo" else style]
    caps = layout["caps"]
    question = F.concat(F.lit(f"\n\n{layout['question']}: "), _text("question", df), F.lit("\n\n"))
    context = _text("context", df)
    if layout["words"]:
        context = truncate_words(context, layout["words"])
    single = F.concat(F.lit(f"{layout['heading']}:\n"), context)
    double = F.concat(
        F.lit(f"{layout['passage']} A:\n"), _capped(_text("context_a", df), caps, 1),
        F.lit(f"\n\n{layout['passage']} B:\n"), _capped(_text("context_b", df), caps, 2),
    )
    contradiction = F.coalesce(F.col(task) == fv.CONTRADICTION, F.lit(False))
    closing = F.when(F.lit(False), "")
    for name, line in closings.items():
        if name != "default":
            closing = closing.when(F.col(task) == name, line)
    body = F.concat(F.when(contradiction, double).otherwise(single), question, closing.otherwise(closings["default"]))
    if examples is not None:
        shots = F.col(examples)
        body = F.concat(
            F.when(F.coalesce(shots, F.lit("")) != "", F.concat(shots, F.lit("\n\n--- Your question ---\n"))).otherwise(""),
            body,
        )
    return df.withColumn(out, body)


def build_conditions(
    df: DataFrame, instructions: str, conditions: list[str] | None = None, examples: DataFrame | None = None,
    style: str = "zero_shot", task: str = "task_type",
) -> DataFrame:
    """Each item once per condition, with columns condition, system (the instructions) and prompt.

    ``examples`` has solved items as ``example_blocks`` takes them (task, rank,
    example); a condition shows the first ones of the item's task, fewer if
    there are no more. Blocks are cut per task and condition before items meet
    them.
    """
    conditions = conditions or list(CONDITIONS)
    entries = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit("\n\n".join(x for x in (instructions, CONDITIONS[c][0]) if x)).alias("system")) for c in conditions])
    rows = df.withColumn("_e", F.explode(entries)).select(*df.columns, "_e.condition", "_e.system")
    shown = {c: CONDITIONS[c][1] for c in conditions if CONDITIONS[c][1]}
    if not shown:
        return build_prompt(rows, style, task)
    if examples is None:
        raise ValueError("conditions with examples need some")
    quotas = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(n).alias("_n")) for c, n in shown.items()])
    cut = examples.withColumn("_q", F.explode(quotas)).where(F.col("rank") <= F.col("_q._n")).select(task, F.col("_q.condition").alias("condition"), "rank", "example")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank").alias("o"), F.col("example").alias("t"))))
    blocks = cut.groupBy(task, "condition").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n\n").alias("_examples"))
    joined = spread_join(rows, blocks, [task, "condition"], "left")
    return build_prompt(joined, style, task, examples="_examples").drop("_examples")


def format_example(df: DataFrame, task: str = "task_type", out: str = "example") -> DataFrame:
    """One solved item as an example (300 words, or two passages of 800 characters)."""
    tail = F.concat(F.lit("\n\nQuestion: "), _text("question", df), F.lit("\nAnswer: "), _text("answer", df))
    single = F.concat(F.lit("Context:\n"), truncate_words(_text("context", df), 300))
    double = F.concat(
        F.lit("Passage A:\n"), F.left(_text("context_a", df), F.lit(800)),
        F.lit("\n\nPassage B:\n"), F.left(_text("context_b", df), F.lit(800)),
    )
    body = F.when(F.coalesce(F.col(task) == fv.CONTRADICTION, F.lit(False)), double).otherwise(single)
    return df.withColumn(out, F.concat(F.lit("--- Example ---\n"), body, tail))


def example_blocks(examples: DataFrame, task: str = "task_type", order: str = "rank", text: str = "example") -> DataFrame:
    """The examples of each task, joined in order. Examples per task are few by construction."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return examples.groupBy(task).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n\n").alias("examples"))


def shots_block(shots: Column | str, context: Column | str, question: Column | str) -> Column:
    """Solved shots (array of struct context, question, answer) before the open question."""
    solved = F.transform(
        col(shots),
        lambda s: F.concat(
            F.lit("CONTEXT:\n"), F.left(s["context"], F.lit(400)), F.lit("\nQUESTION: "), s["question"],
            F.lit("\nANSWER: "), s["answer"], F.lit("\n\n"),
        ),
    )
    return F.concat(
        F.array_join(solved, ""), F.lit("CONTEXT:\n"), F.left(col(context), F.lit(600)),
        F.lit("\nQUESTION: "), col(question), F.lit("\nANSWER:"),
    )


def with_shots(df: DataFrame, shots: DataFrame, task: str = "task_type", order: str = "rank", out: str = "prompt") -> DataFrame:
    """``shots_block`` for every row, from solved rows of its task (context, question, answer), few per task.

    The solved rows become one block of text per task, cut to size, before rows meet it.
    """
    solved = shots.select(task, F.struct(F.col(order).alias("o"), F.struct(F.left("context", F.lit(400)).alias("context"), "question", "answer").alias("s")).alias("e"))
    ordered = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["s"])
    blocks = solved.groupBy(task).agg(ordered.alias("_shots"))
    return spread_join(df, blocks, [task]).withColumn(out, shots_block("_shots", "context", "question")).drop("_shots")


# Templates of judge prompts: fields in braces, with the cap of each field. Doubled braces stand for themselves.
JUDGE_TEMPLATES = {
    "rubric": (
        "You grade an answer about a passage on changing rules, on three points, each 0 or 1.\n"
        "event_identification is 1 if the answer names the events, dates or documents that matter for the question.\n"
        "temporal_ordering is 1 if it puts them in the right order in time, or if the question needs no order.\n"
        "final_state_answer is 1 if its conclusion says the same as the reference answer.\n"
        'Reply with JSON only: {{"event_identification": {{"score": 0, "reason": "..."}}, '
        '"temporal_ordering": {{"score": 0, "reason": "..."}}, "final_state_answer": {{"score": 0, "reason": "..."}}}}\n'
        "CONTEXT: {context}\nQUESTION: {question}\nREFERENCE ANSWER: {reference}\nMODEL PREDICTION: {prediction}",
        {"context": 1500},
    ),
    "verdict": (
        "Does the prediction mean the same as the reference? Other spellings of an amount, units and abbreviations count as equal.\n"
        "CORRECT: it means the same, or holds the reference answer.\nPARTIAL: a part of it is right.\nINCORRECT: what it says is wrong.\n"
        "Reply with one line, VERDICT|reason.\n"
        "Question: {question}\nReference Answer: {reference}\nModel Prediction: {prediction}",
        {"question": 500, "reference": 200, "prediction": 200},
    ),
    "retrieval": (
        "Answer from the retrieved text only.\nRetrieved Context:\n{context}\n\nQuestion: {question}\n\nAnswer:",
        {"context": 3000},
    ),
    "perturbation": (
        "Context: {context}\nQuestion: {question}\nGive only the answer.",
        {"context": 2000},
    ),
}


def fill_template(df: DataFrame, template: Column | str, fields: dict[str, Column]) -> Column:
    """Replace ``{name}`` in a template column by the value of each field."""
    out = col(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def judge_prompt(
    df: DataFrame, kind: str, template: str | None = None, out: str = "prompt", **columns: str
) -> DataFrame:
    """A judge prompt; ``columns`` maps template fields to column names."""
    default, caps = JUDGE_TEMPLATES[kind]
    parts = []
    for before, name, _, _ in Formatter().parse(template or default):
        parts.append(F.lit(before))
        if name is not None:
            value = F.coalesce(F.col(columns.get(name, name)).cast("string"), F.lit(""))
            parts.append(F.left(value, F.lit(caps[name])) if name in caps else value)
    return df.withColumn(out, F.concat(*parts))


def passage_display(df: DataFrame, task: str = "task_type", caps: tuple[int, int, int] = (500, 300, 700), out: str = "context_display") -> DataFrame:
    """The passage shown to annotators."""
    double = F.concat(
        F.lit("PASSAGE A:\n"), F.left(_text("context_a", df), F.lit(caps[0])),
        F.lit("\n\nPASSAGE B:\n"), F.left(_text("context_b", df), F.lit(caps[1])),
    )
    is_double = F.coalesce(F.contains(F.lower(F.col(task)), F.lit("contradiction")), F.lit(False))
    return df.withColumn(out, F.when(is_double, double).otherwise(F.left(_text("context", df), F.lit(caps[2]))))
