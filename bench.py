"""Headline queries timed on $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (every column is
computed, nothing is collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusprep.plans.queries import QUERIES  # noqa: E402
from corpusprep.session import local_session  # noqa: E402

HEADLINE = [
    "html_markdown",
    "html_localized",
    "md_rewritten",
    "text_documents",
    "cleaned_cells",
    "csv_documents",
    "bundle_documents",
    "orders_status_tables",
    "lineitem_first_columns",
    "slide_decks",
    "image_decisions",
    "pdf_documents",
    "package_entry_list",
    "file_outcomes",
    "batch_report",
    "batch_progress",
    "corpus_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), "corpusprep-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JVM, parquet footers, Python workers
    QUERIES["text_documents"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
