"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scholarmatch.plans import all_queries  # noqa: E402
from scholarmatch.session import local_session  # noqa: E402

HEADLINE = (
    "rank_candidates", "hybrid_rank", "compare_table", "similar_pairs", "vector_recall",
    "catalog_upsert", "normalize_names", "lookup_advisor", "field_report",
    "merge_works", "merge_candidate_links", "works_by_doi", "source_coverage",
    "author_match", "fingerprint_prefilter", "affiliation_expansion", "assess_identity",
    "collision_level", "group_assessment",
    "topic_trend", "assemble_profile", "term_matches", "match_report", "topic_gaps",
    "validate_claims", "validate_draft",
    "page_text", "page_links", "cv_facts", "pii_redact",
    "latest_artifact", "run_comparison", "budget_breach", "call_caps", "stage_chain",
    "conform_crossref", "conform_dblp", "conform_wanfang", "stream_budget_gate", "stream_trace_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    found = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in names:
        started = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        if len(sys.argv) > 1:
            print(name, times[name], flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
