"""Readers and writers."""

from gradeframe.sources.readers import (  # noqa: F401
    read_baselines, read_corpus, read_items, read_predictions, read_prompt_templates,
)
from gradeframe.sources.writers import write_results  # noqa: F401
