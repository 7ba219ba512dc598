"""Labels, word lists, thresholds and formats the results depend on."""

from __future__ import annotations

from calendar import month_name

# Task names and their short codes.
TASK_CODES = {
    "regulatory_interpretation": "REG",
    "numerical_reasoning": "NUM",
    "contradiction_detection": "CON",
    "temporal_reasoning": "TMP",
}
TASKS = list(TASK_CODES)
CONTRADICTION = "contradiction_detection"
NUMERICAL = "numerical_reasoning"
TEMPORAL = "temporal_reasoning"

DIFFICULTIES = ["easy", "medium", "hard"]

# Scoring.
FUZZY_THRESHOLD = 0.72
SWEEP_THRESHOLDS = [0.60, 0.65, 0.68, 0.70, 0.72, 0.75, 0.78, 0.80, 0.85]
STABILITY_WINDOW = (0.68, 0.75)
UNDETERMINED = "cannot be determined"
FAILED = "FAIL"

# Wilson interval.
Z95 = 1.96

# Error types, by (task, difficulty) and by task alone.
DOMAIN_ERROR = "Domain Knowledge Failure"
NUMERICAL_ERROR = "Numerical Reasoning Failure"
TEMPORAL_ERROR = "Temporal Reasoning Failure"
GROUNDING_ERROR = "Context Grounding Failure"
ERROR_TYPES = [DOMAIN_ERROR, NUMERICAL_ERROR, TEMPORAL_ERROR, GROUNDING_ERROR]
ERROR_BY_TASK_DIFFICULTY = {
    ("regulatory_interpretation", "easy"): DOMAIN_ERROR,
    ("regulatory_interpretation", "medium"): DOMAIN_ERROR,
    ("regulatory_interpretation", "hard"): GROUNDING_ERROR,
    ("numerical_reasoning", "easy"): NUMERICAL_ERROR,
    ("numerical_reasoning", "medium"): NUMERICAL_ERROR,
    ("numerical_reasoning", "hard"): NUMERICAL_ERROR,
    ("contradiction_detection", "easy"): GROUNDING_ERROR,
    ("contradiction_detection", "medium"): TEMPORAL_ERROR,
    ("contradiction_detection", "hard"): TEMPORAL_ERROR,
    ("temporal_reasoning", "easy"): TEMPORAL_ERROR,
    ("temporal_reasoning", "medium"): TEMPORAL_ERROR,
    ("temporal_reasoning", "hard"): DOMAIN_ERROR,
}
ERROR_BY_TASK = {
    "numerical_reasoning": NUMERICAL_ERROR,
    "temporal_reasoning": TEMPORAL_ERROR,
    "regulatory_interpretation": DOMAIN_ERROR,
    "contradiction_detection": GROUNDING_ERROR,
}

# Display lengths of stored results: question, reference, prediction (None = whole).
RESULT_LENGTHS = {
    "evaluate": (80, 100, 200),
    "extended": (80, 150, 300),
    "hosted": (200, None, 500),
    "conditions": (80, None, 300),
}

# Column candidates by role, exact names first, then fragments.
COLUMN_ROLES = {
    "correct": (["correct", "is_correct", "Correct"], ["correct"]),
    "id": (["id", "item_id", "ID"], []),
    "task": (["task_type", "task"], ["task"]),
    "prediction": (["prediction", "model_prediction", "output"], ["predict", "output"]),
    "reference": (["ref_answer", "reference_answer", "gold_answer", "answer"], ["ref", "gold", "answer"]),
}

# Stems that mark an amendment (complexity score) and its wider relatives.
AMENDMENT_STEMS = [
    r"\bsupersed", r"\bamend", r"\bmodif", r"\breplace", r"\bsubstitut",
    r"\bhereby circu", r"\bin supersession", r"\bin partial modification",
    r"\bwith effect from", r"\beffective from", r"\bprevious circular",
    r"\bearlier circular", r"\bprior circular",
]
REFERENCE_WORDS = r"\bcircular\b|\bnotification\b|\bdirective\b|\bregulation\b|\bmaster direction\b"
DATE_PATTERN = (
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    r"|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4}"
    r"|\b\d{4}\b"
)
YEAR_PATTERN = r"\b(19[89]\d|20[0-2]\d)\b"
YEAR_IN_NAME = r"(?<!\d)(19[89]\d|20[0-2]\d)(?!\d)"
YEAR_IN_DATE = r"\b((?:19|20)\d{2})\b"

# Feature patterns.
FEATURE_PATTERNS = {
    "num_numbers": r"\b\d+(?:,\d+)*(?:\.\d+)?\b",
    "num_currencies": r"(?i)₹|crore|lakh|cr\.?|Rs\.?",
    "num_amendments": r"(?i)\bsupersed|\bamend|\bmodif|\breplace|\bhereby\b",
    "num_refs": r"\bSEBI\b|\bRBI\b|\bCircular\b|\bNotification\b",
    "num_conditions": r"(?i)\bif\b|\bwhere\b|\bprovided that\b|\bsubject to\b|\bnotwithstanding\b",
}

# Ordered synonym replacements (case-insensitive).
SYNONYMS = [
    (r"\bsupersedes\b", "replaces"),
    (r"\bsuperseded\b", "replaced"),
    (r"\bin supersession of\b", "in replacement of"),
    (r"\bhereby\b", "as a result"),
    (r"\bwith effect from\b", "effective"),
    (r"\bamended\b", "modified"),
]

# Category of a document by the first word its file name contains.
CATEGORY_RULES = [
    ("circular", "Circular"),
    ("master", "Master Circular"),
    ("regulation", "Regulation"),
    ("order", "Order"),
    ("guideline", "Guideline"),
    ("notification", "Notification"),
]

# Navigation words that never are titles of a listing row.
NAVIGATION_WORDS = ["next", "previous", "page", "<<", ">>"]

# Answer preambles removed before display, in this order.
PREAMBLES = [
    r"(?im)^(the\s+)?answer\s+(is|:)\s*",
    r"(?im)^based on .*?,?\s*",
    r"(?im)^according to .*?,?\s*",
    r"(?im)^from the (context|passage).*?,?\s*",
]

# Rubric weights: event, ordering, final state.
RUBRIC_WEIGHTS = (0.25, 0.25, 0.5)

# Human baseline gap is measured against this accuracy (percent).
HUMAN_GAP_REFERENCE = 91.3

# Eras: label, first year, last year.
ERAS = [("Pre-2000", 1, 1999), ("2000-2015", 2000, 2015), ("Post-2015", 2016, 2100)]

# Annotation sheet sizes per task.
SHEET_SIZES = {
    "regulatory_interpretation": 30,
    "numerical_reasoning": 15,
    "contradiction_detection": 15,
    "temporal_reasoning": 30,
}

# Rewrites that bring two spellings of one answer together, in this order.
CANONICAL_REWRITES = [
    (r"[₹]|rs\.?\s*", ""),
    (r"crore\s+rupees?", "crore"),
    (r"(\d),(\d{3})", "$1$2"),
    (r"(\d+\.\d*?)0+\b", "$1"),
    (r"(\d+)\.$", "$1"),
    *[
        (rf"\b(?:{name.lower()}|{name[:3].lower()})\b", f"{number:02d}")
        for number, name in enumerate(month_name)
        if name
    ],
    (r"\b(by|on|from|before|after)\b\s+", ""),
]

# Readings of the gap between people and the reference system, from above and below three points.
GAP_READINGS = (
    "substantial room for model improvement",
    "near-human or above-human parity on this subset",
    "near-human parity on this subset",
)
