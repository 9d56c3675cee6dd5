"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fieldwarden.session import local_session
from workload import QUERIES

HEADLINE = [
    "stage_table_filter",
    "table_column_registry",
    "unpivot_training_rows",
    "sample_rows",
    "sample_many_rows",
    "sample_values",
    "value_with_meta",
    "clean_labels",
    "split_stratified",
    "oversample",
    "batch_ids",
    "clean_text",
    "char_counts",
    "word_dictionary",
    "text_sequence",
    "wide_features",
    "deep_features",
    "category_share",
    "sensitivity_by_category",
    "length_histogram",
    "classification_report",
    "column_vote",
    "score_requests",
    "score_columns",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # the first run pays for code generation and compilation; the second is reported
    first, seconds = {}, {}
    for name in names:
        first[name] = round(run(name), 3)
        seconds[name] = round(run(name), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time of warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_runs": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
