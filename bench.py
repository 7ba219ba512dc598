"""Time the headline queries at $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

import registry  # noqa: E402
from gradeframe.session import build_session  # noqa: E402

HEADLINE = [
    "C1_evaluate", "T10_score_strict", "T8_token_set_ratio", "C3_threshold_ablation", "A1_accuracy_by_model_task",
    "A12_item_category", "A18_error_jaccard", "J2_all_pairs", "D2_paired_bootstrap", "A20_cohen_kappa",
    "A23_A24_fleiss_kappa_unanimity", "D7_spearman", "A19_kendalls_w", "W1_leaderboard_with_duplicates", "X5_stratified_split",
    "J10_top_k_similar", "N5_complexity_features", "N6_text_features", "N10_chunk_words", "T22_clean_text", "T15_canonical_answer",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load_all()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "gradeframe.text.partitions": cpus, "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One untimed query starts the JVM code paths and the Python workers.
    registry.QUERIES["T8_token_set_ratio"](spark, "/root/testdata/sf0.001" if Path("/root/testdata/sf0.001").exists() else sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
