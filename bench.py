"""Headline queries (or those named) timed on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from exhume import session  # noqa: E402
from exhume.checks import catalog  # noqa: E402

HEADLINE = (
    "string_search_score", "registry_score", "sqlite_score", "dfr_score", "carving_score", "aligned_match_stats",
    "byte_compare_lockstep", "lockstep_bits", "nearest_original", "validate_geometry", "sector_to_partition",
    "merge_gt_blocks", "keyword_lines", "keyword_search_raw", "token_report_types", "parse_listing_lines", "hit_blocks",
    "to_epoch",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query
    times: dict[str, float] = {}
    for name in [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]:
        start = time.perf_counter()
        # planning included: staged steps run while the plan is built
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
