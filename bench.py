"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  The JVM is warmed on sf0.001 and sf0.01 first (session
timed job then builds its analysis from scratch over the whole tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from signalmesh.config import FIXTURE_THEMES  # noqa: E402
from signalmesh.operators import quotes as qt  # noqa: E402
from signalmesh.params import Params  # noqa: E402
from signalmesh.plans import jobs  # noqa: E402
from signalmesh.plans.analysis import analyze, fixture_feeds  # noqa: E402
from signalmesh.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_DIRS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


def synthesize(spark, sf_dir: str) -> dict:
    """synthesize_feedback at summary level: every table of the response."""
    a = analyze(fixture_feeds(spark, sf_dir), FIXTURE_THEMES, Params())
    out = {
        "themes": jobs.themes_view(a, "summary").collect(),
        "emerging": qt.emerging_top(a.emerging, 5).collect(),
        "summary": a.summary().collect(),
        "pii": a.pii_categories().collect(),
        "sources": a.data_sources().collect(),
    }
    a.unpersist()
    return out


def product_plan(spark, sf_dir: str) -> dict:
    p = Params(fmt="markdown")
    a = analyze(fixture_feeds(spark, sf_dir), FIXTURE_THEMES, p)
    out = {"priorities": jobs.plan_priorities(a, p).collect(), "markdown": jobs.plan_markdown_text(a, p).collect()}
    a.unpersist()
    return out


def feature_requests(spark, sf_dir: str) -> dict:
    p = Params(status="open")
    return {"posts": jobs.feature_requests(spark, sf_dir, p).collect(),
            "comments": jobs.feature_request_comments(spark, sf_dir, p).write.format("noop").mode("overwrite").save()}


def list_sources(spark, sf_dir: str) -> dict:
    return {"sources": jobs.list_sources(spark, sf_dir).collect()}


def pii_audit(spark, sf_dir: str) -> dict:
    a = analyze(fixture_feeds(spark, sf_dir), FIXTURE_THEMES, Params())
    out = {"audit": jobs.pii_audit(a).collect()}
    a.unpersist()
    return out


JOBS = {
    "synthesize_feedback": synthesize,
    "product_plan": product_plan,
    "feature_requests": feature_requests,
    "list_sources": list_sources,
    "pii_audit": pii_audit,
}


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    for warm in WARM_DIRS:  # JIT + codegen warm-up on the small scales (not timed)
        synthesize(spark, warm)
    times = {}
    for name, fn in JOBS.items():
        t0 = time.perf_counter()
        fn(spark, SF_DIR)
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "synthesize_feedback_seconds",
        "value": times["synthesize_feedback"],
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else SF_DIR,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
