"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from checks import fixtures as X
from checks.compare import local_session
from checks.queries import REGISTRY, enriched_columns
from personae.operators.scale import materialize
from personae.plans.enrich import enrich

HEADLINE = [
    "normalize", "cand_email", "cand_username", "score_array", "page_fields", "cache_lookup",
    "duplicates", "import_stats", "logs_fanout", "merge", "override_audit", "review_list",
    "export_full", "creator_timeline", "job_progress", "cascade_delete",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    run(X.raw_import(spark, sf_dir))  # starts the executors
    creators = materialize(X.creators(spark, sf_dir), "bench-creators")
    rows = creators.count()

    def enrichment(mode: str) -> None:
        names = X.dictionary(spark, sf_dir)
        run(enrich(creators, names, mode=mode, now=X.now()).creators.select(*enriched_columns()))

    seconds = {
        "enrich_snapshot": timed(lambda: enrichment("snapshot")),
        "enrich_snapshot_again": timed(lambda: enrichment("snapshot")),
        "enrich_sequential": timed(lambda: enrichment("sequential")),
    }
    # the same work on a tenth of the rows, where that is at hand
    tenth = Path(sf_dir).with_name("sf0.01")
    scaling = None
    if Path(sf_dir).name == "sf0.1" and tenth.is_dir():
        few = materialize(X.creators(spark, str(tenth)), "bench-creators")
        names = X.dictionary(spark, str(tenth))
        small = timed(lambda: run(enrich(
            few, names, mode="snapshot", now=X.now()).creators.select(*enriched_columns())))
        scaling = round(seconds["enrich_snapshot_again"] / small, 2)
    for name in HEADLINE:
        X.forget()  # every query pays for what it needs
        seconds[name] = timed(lambda name=name: run(REGISTRY[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "rows": rows,
                "enrich_rows_per_sec": round(rows / seconds["enrich_snapshot"]),
                "enrich_rows_per_sec_warm": round(rows / seconds["enrich_snapshot_again"]),
                "enrich_time_ratio_for_10x_rows": scaling,
            }
        )
    )
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
