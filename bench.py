"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run once to warm up and once for the clock, into the no-op sink, so that all columns are computed and
nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clip_quality",
    "quality_comparison",
    "masked_flicker",
    "smoothed_masks",
    "tool_scorecard",
    "caption_text_components",
    "caption_line_boxes",
    "seam_scores",
    "halo_plan",
    "resampled_timeline",
    "segment_assignment",
    "tile_plan_crop",
    "stage_effective_fps",
    "run_summary",
    "run_comparison",
    "gpu_activity",
    "progress_throughput",
    "session_rollup",
    "av_sync_report",
    "progress_percent",
    "live_overlay",
    "sorted_jobs_scratchsize_desc",
    "request_validation",
    "deduped_imports",
    "matched_picks",
    "ordered_sequence",
    "output_completeness",
    "media_metadata",
    "stream_throughput",
    "stream_windows",
)


def main() -> None:
    from framelane.bindings import QUERIES
    from framelane.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="framelane-bench", memory="16g")
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        for timed in (False, True):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cpus": int(cpus) if str(cpus).isdigit() else cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
