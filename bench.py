"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up (plan code, JIT, the stored file table) and is then
timed from building its plan to the last result row.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import REGISTRY, Tables  # noqa: E402
from palisade.session import local_session  # noqa: E402

HEADLINE = (
    "audit_report",
    "audit_scores",
    "code_findings",
    "scan_injection",
    "scan_secrets",
    "scan_app_security",
    "webhook_unverified",
    "check_firebase",
    "filter_ignored",
    "classify_match",
    "secret_tokens_in_text",
    "shannon_entropy",
    "vulnerable_dependencies",
    "missing_headers",
    "git_history_secrets",
    "numbered_findings",
    "fix_prompt",
    "top_findings",
    "dedup_findings",
    "audit_score",
    "scan_changes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "palisade-bench")
    spark.sparkContext.setLogLevel("ERROR")
    Tables(spark, sf_dir).files().count()

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
