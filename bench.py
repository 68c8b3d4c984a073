"""Time the headline queries on one machine, over a stored cohort and with deriving it each time; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "sample_quality", "cohort_difference", "called_rates", "genes_at_position", "merged_intervals", "trio_denovo", "trio_dominant", "compound_het", "x_linked_classes",
    "group_counts", "diversity", "hudson_fst", "neutrality_tests", "diversity_windows", "concordance_verdicts", "concordance_summary", "combined_sets",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from genolith.plans.fixtures import store
    from genolith.plans.queries import QUERIES

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["contig_counts"](spark, folder).count()  # warm-up

    def timed() -> dict[str, float]:
        took = {}
        for name in HEADLINE:
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        return took

    derived = timed()  # each query derives its cohort from the star schema
    with tempfile.TemporaryDirectory(prefix="genolith-bench-") as stored:
        began = time.time()
        store(spark, folder, f"file://{stored}")
        storing = round(time.time() - began, 3)
        took = timed()  # the same over the stored cohort
    total = lambda x: round(sum(x.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total(took), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1],
        "storing_the_cohort": storing, "with_deriving": {"value": total(derived), "queries": derived},
    }))


if __name__ == "__main__":
    main()
