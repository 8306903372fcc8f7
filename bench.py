"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from frameloom.registry.queries import QUERIES  # noqa: E402
from frameloom.session import local_session  # noqa: E402

HEADLINES = (
    "large_videos_top15",
    "duplicate_photo_groups",
    "similar_photo_groups",
    "similar_photo_pairs",
    "duplicate_video_groups",
    "components",
    "photo_candidate_pairs",
    "keyframe_sample",
    "needs_analysis",
    "bin_active",
    "total_cleanable",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # one untimed query starts the Python workers and loads the classes
    QUERIES["duplicate_photo_groups"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
