"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
    BENCH_CPUS    cores (default 8)
    BENCH_QUERIES comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    # dashboard
    "funnel_by_company", "funnel_by_role", "overview_totals", "overview_periods",
    "monthly_activity", "timeline", "combined_activity", "rolling_activity",
    "monthly_intelligence", "sync_status",
    # text and classification
    "normalize_text", "keywords", "strip_html", "classify_messages", "classify_documents",
    "schedule", "company_and_title",
    # evidence and identity
    "recruiter_evidence", "interview_evidence", "message_identity", "new_only",
    "canonical_applications", "duplicate_groups", "first_confirmation",
    # linkage
    "explicit_job", "resolve_contacts", "review_queue", "company_in_text",
    "message_attribution", "candidate_jobs", "match_applications",
    # merges, quality, sources, streams
    "upsert_jobs", "reconcile_ledger", "fold_interviews", "batch_verification", "table_digest",
    "read_mbox", "read_ics", "read_pages", "contiguous_watermark", "tumbling_counts",
)


def main() -> None:
    from casetrail.plans import QUERIES
    from casetrail.session import build_session, remove_scratch

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.driver.host": "localhost",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["outcome_group"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    remove_scratch(spark)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
