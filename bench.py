"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query is run to the end into a
no-op sink; the better of two runs counts, plan building included.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queries import all_queries  # noqa: E402
from rulelens.session import build_session  # noqa: E402

HEADLINES = [
    "applicable_rules",
    "detect_lines",
    "content_hash",
    "exact_duplicates",
    "dedup_findings",
    "limit_per_path",
    "score_by_path",
    "score_rollup",
    "rule_coverage",
    "changed_rows",
    "parse_hunks",
    "triage",
    "cache_hits",
    "cache_upsert",
    "snippets",
    "enclosing_span",
    "validate_findings",
    "score_with",
    "cost_by_model",
    "review_pages",
    "review_documents",
    "review_changed",
    "stream_review",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = build_session("bench", f"local[{cpus}]", cpus, **{"spark.driver.memory": "8g"})
    run = all_queries()
    spark.read.parquet(f"{sf}/documents.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        spent = []
        for _ in range(2):
            began = time.perf_counter()
            run[name](spark, sf).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - began)
        times[name] = round(min(spent), 3)
        print(name, [round(s, 2) for s in spent], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "review_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
