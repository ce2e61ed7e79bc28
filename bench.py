"""Headline queries, timed. Prints one JSON line.

Each query runs twice into a sink that drops the rows; ``queries`` holds the second
run, ``first_run`` the first (which includes compilation and worker start).
"""

from __future__ import annotations

import json
import os
import time

import pyspark

from docengine.plans import registry
from docengine.session import get_session

HEADLINE = [
    "publish_manifest", "s1_scan_pages", "h1_html_nodes", "h9_link_href", "t10_parse_pipeline", "t5_children_flat",
    "n4_ancestor_menus", "c10_endpoint_page", "c14_html_to_markdown", "x2_slugify", "x7_sanitize", "x10_clean_md_tables",
    "x15_setext_to_atx", "x16_md_checks", "p7_placeholder_filter", "t1_attach_leading_header", "t9_flatten",
    "w1_round_robin", "j1_resume_existing", "j3_skip_or_write", "j6_duplicate_ids", "j7_path_collisions",
    "a1_group_by_menu", "a4_outcome_tally", "a7_line_audit", "l4_top20", "s7_route_log_levels", "s5_publish_markdown",
    "r1_incremental_publish",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("docengine-bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    first, second = {}, {}
    for name in HEADLINE:
        for times in (first, second):
            start = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total_seconds_headline_queries", "value": round(sum(second.values()), 3), "unit": "sec",
        "queries": second, "first_run": first, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus),
        "spark": pyspark.__version__,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
