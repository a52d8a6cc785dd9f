"""Wall-clock of the headline queries.

Runs every headline query of the registry on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query is fully materialised (noop sink), so the time covers the
whole plan, not just the first rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "l1_maxp_dot_eval",     # flagship: passages -> impacts -> max agg -> dot retrieval -> metrics
    "t2_passages",          # sentence split + greedy packing
    "e2_impacts",           # passage vectors
    "e4_expansion",         # expansion encoder (co-occurrence join)
    "a7_sweep_summary",     # n = 1..10 x {max, sum, mean} in one pass
    "r3_passage_run",       # top-10000 passages
    "r4_bm25_run",
    "r5_rm3_run",
    "r6_sdm_run",
    "r7_bm25_sweep",
    "f1_maxpsg_run",
    "k16_rerank_exact_eval",  # exact SDM reranking of top-200
    "k16_rerank_soft_eval",   # soft SDM reranking of top-200
    "c10_run_split",
    "p4_hist_judged",
    "v1_v3_ratios",
    "v9_shares",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from segrank.session import get_session
    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="segrank-bench", read_partitions=int(cpus))
    from segrank.plans.catalog import build_all
    qs = build_all()
    names = [n for n in HEADLINE if n in qs]
    if len(sys.argv) > 1:
        names = [n for n in sys.argv[1:] if n in qs]
    # warm the JVM on the smallest fixture
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        qs["t10_max_passages"](spark, warm).collect()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
