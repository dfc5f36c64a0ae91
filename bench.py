"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is run to completion into a no-op sink. ``score_tables`` is the whole scorer (fit
and score of validation, sweep, out-of-fold and junk rows) from raw text; the evaluation
queries after it start from the stored score tables.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyforge.plans import scoring  # noqa: E402
from tallyforge.plans.registered import QUERIES  # noqa: E402
from tallyforge.session import local_session  # noqa: E402

HEADLINE = [
    # corpus
    "cleaning_ledger", "clean_index", "dup_members", "class_stats", "corpus_summary", "categorise", "reconcile_manifest", "diff_labels",
    # splits and samples
    "stratified_split", "group_holdout_split", "group_fraction_holdout", "kfold", "range_folds", "fill_extra", "weighted_resample",
    # evaluation, from stored scores
    "compute_metrics", "tau_sweep", "ensemble_subsets", "slice_metrics", "auroc", "threshold_tradeoff", "guarded_view_search",
    "confused_directed", "oof_assemble", "plan_fixes", "perturb_sweep", "crossing_points", "identity_map", "leaderboard",
    # rasters
    "pixel_profile", "otsu_threshold", "normalise_rasters", "expand_variants", "describe_batch",
]


def score_tables(spark, sf: str) -> None:
    scoring.scores(spark, sf)
    scoring.sweep_scores(spark, sf)
    scoring.oof_scores(spark, sf)
    scoring.junk_pred(spark, sf)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "tallyforge-bench")
    # warm the JVM up on the smallest tables, if they lie next to the ones to be timed
    warm = Path(sf).parent / "sf0.001"
    if warm.is_dir() and not sys.argv[1:]:
        score_tables(spark, str(warm))
    times: dict[str, float] = {}
    if not sys.argv[1:]:
        t0 = time.perf_counter()
        score_tables(spark, sf)
        times["score_tables"] = round(time.perf_counter() - t0, 3)
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
