"""Outcome evidence, period counts and funnels over canonical applications."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.dates import period_of

_OUTCOMES = fixed.METRICS[1:]


def rate(n: Column | str, d: Column | str, digits: int = 1) -> Column:
    """Percentage; 0.0 where there is nothing to divide by."""
    n, d = (F.col(c) if isinstance(c, str) else c for c in (n, d))
    return F.when(d == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(n, d) * 100, digits))


def rate_or_null(n: Column | str, d: Column | str) -> Column:
    n, d = (F.col(c) if isinstance(c, str) else c for c in (n, d))
    return F.when(d > 0, F.round(F.try_divide(n, d) * 100, 1))


def change(current: Column | str, base: Column | str) -> Column:
    """Change in percent; from zero it is 0.0 to zero and unknown to anything else."""
    c, b = (F.col(x) if isinstance(x, str) else x for x in (current, base))
    return F.when((b == 0) & (c == 0), F.lit(0.0)).when(
        b != 0, F.round(F.try_divide(c - b, b) * 100, 1))


def change_or_null(current: Column | str, previous: Column | str) -> Column:
    c, p = (F.col(x) if isinstance(x, str) else x for x in (current, previous))
    return F.when(p != 0, F.round(F.try_divide(c - p, p) * 100, 1))


def outcome_records(
    evidence: DataFrame, interview_events: DataFrame | None = None, offers: DataFrame | None = None,
) -> DataFrame:
    """All outcome evidence, linked or not: kind, job_id, occurred_at and a flag per metric.

    A record that feeds several metrics stays one row with several flags.
    """
    kinds = F.col("classification")
    rows = evidence.select(
        F.lit("message").alias("kind"), "job_id", "occurred_at",
        *[kinds.isin(*types).alias(m) for m, types in fixed.OUTCOME_METRICS.items()],
    ).where(" OR ".join(_OUTCOMES))

    def fixed_metric(df: DataFrame, kind: str, at: str, metric: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "job_id", F.col(at).alias("occurred_at"),
                         *[F.lit(m == metric).alias(m) for m in _OUTCOMES])

    if interview_events is not None:
        rows = rows.unionByName(
            fixed_metric(interview_events, "event", "occurred_at", "interviews"))
    if offers is not None:
        rows = rows.unionByName(fixed_metric(offers, "offer", "offered_at", "offers"))
    return rows


def _per_metric(df: DataFrame, build, keep=()) -> DataFrame:
    """One row per (input row, metric) with the columns that ``build(metric)`` names."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), *build(m)) for m in _OUTCOMES]))
    return df.select(*keep, stacked.alias("_m")).select(*keep, "_m.*")


def evidence_quality(records: DataFrame) -> DataFrame:
    """Per metric: message records, linked and unlinked; events counted beside them."""
    is_message, is_event = F.col("kind") == "message", F.col("kind") == "event"
    unlinked = F.col("job_id").isNull()
    counters = {
        "evidence_records": is_message, "linked_records": is_message & ~unlinked,
        "unlinked_records": is_message & unlinked, "event_records": is_event,
        "unlinked_event_records": is_event & unlinked,
    }
    wide = records.agg(*[
        F.count_if(F.col(m) & hit).alias(f"{m}_{name}")
        for m in _OUTCOMES for name, hit in counters.items()])
    return _per_metric(wide, lambda m: [F.col(f"{m}_{n}").alias(n) for n in counters])


def application_facts(members: DataFrame, records: DataFrame) -> DataFrame:
    """One row per canonical application with everything the funnels count.

    Evidence is first reduced to one row per job with map-side counts and minima, so a job that
    holds a third of all evidence enters the join as one row.  One join and one grouping later
    every analysis is a plain aggregation over this frame.
    """
    per_job = records.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(
        *[F.max(m).alias(f"has_{m}") for m in _OUTCOMES],
        *[F.min(F.when(F.col(m), F.col("occurred_at"))).alias(f"first_{m}") for m in _OUTCOMES],
        F.max("occurred_at").alias("last_evidence"))
    first = F.min_by(F.struct("role_family", "company"), "job_id")
    return members.join(per_job, "job_id", "left").groupBy("identity").agg(
        F.min("job_id").alias("job_id"), F.count("*").alias("job_count"),
        F.min("applied_at").alias("applied_at"), F.min("imported_at").alias("imported_at"),
        first.alias("_first"),
        *[F.coalesce(F.max(f"has_{m}"), F.lit(False)).alias(f"has_{m}") for m in _OUTCOMES],
        *[F.min(f"first_{m}").alias(f"first_{m}") for m in _OUTCOMES],
        F.max("last_evidence").alias("last_evidence"),
    ).withColumns({c: F.col("_first")[c] for c in ("role_family", "company")}).drop("_first")


def dedupe_outcomes(facts: DataFrame) -> DataFrame:
    """Earliest evidence per (metric, application); NULL only where no evidence is dated."""
    return _per_metric(
        facts, lambda m: [F.col(f"has_{m}").alias("has"), F.col(f"first_{m}").alias("occurred_at")],
        keep=["identity"]).where("has").drop("has")


def _dated(facts: DataFrame, imported: bool = False) -> DataFrame:
    """(metric, at) of every dated application and outcome."""
    rows = [F.struct(F.lit("applications").alias("metric"), F.col("applied_at").alias("at"))]
    rows += [F.struct(F.lit(m).alias("metric"), F.col(f"first_{m}").alias("at"))
             for m in _OUTCOMES]
    if imported:
        rows.append(F.struct(
            F.lit("records_imported").alias("metric"),
            F.when(F.col("applied_at").isNull(), F.col("imported_at")).alias("at")))
    return facts.select(F.explode(F.array(*rows)).alias("_d")).select("_d.*").where(
        "at IS NOT NULL")


def window_counts(
    dated: DataFrame, windows: Sequence[tuple[str, datetime, datetime]],
) -> DataFrame:
    """Counts per metric in half-open windows [start, end), one row per window.

    All window bounds together cut time into segments.  The data is counted once per (metric,
    segment), with partial aggregation, and each window adds up its own segments; how many
    windows there are does not matter to the pass over the data.
    """
    spark = dated.sparkSession
    bounds = sorted({b for _, s, e in windows for b in (s, e)})
    literal = F.array(*[F.lit(b.isoformat(sep=" ")).cast("timestamp_ntz") for b in bounds])
    segment = F.size(F.filter(literal, lambda b: b <= F.col("at")))
    counted = dated.groupBy(
        "metric", segment.alias("segment")).agg(F.count("*").alias("n"))
    place = {b: i for i, b in enumerate(bounds)}
    # window -> its segments; sized by the list of windows, never by the data
    spans = spark.createDataFrame(
        [(i, name, list(range(place[s] + 1, place[e] + 1)))
         for i, (name, s, e) in enumerate(windows)],
        "position int, window string, segments array<int>")
    spread = spans.select("position", "window", F.explode_outer("segments").alias("segment"))
    joined = spread.join(counted, "segment", "left")
    return joined.groupBy("position", "window").agg(*[
        F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m)
        for m in fixed.METRICS
    ])


def period_counts(facts: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row of counts of the five metrics in [start, end); undated rows never count."""
    return window_counts(_dated(facts), [("period", start, end)]).select(*fixed.METRICS)


def _previous_month(at: datetime) -> datetime:
    return (at.replace(day=1) - timedelta(days=1)).replace(day=1)


def _next_month(at: datetime) -> datetime:
    return (at.replace(day=28) + timedelta(days=4)).replace(day=1)


def overview_windows(now: datetime) -> list[tuple[str, datetime, datetime]]:
    current = now - timedelta(days=30)
    return [
        ("last_30_days", current, now),
        ("last_60_days", now - timedelta(days=60), now),
        ("last_90_days", now - timedelta(days=90), now),
        ("previous_90_days", current - timedelta(days=90), current),
    ]


def overview_totals(facts: DataFrame) -> DataFrame:
    """One row: all-time totals, rates and the quality of the application records."""
    counted = facts.agg(
        F.count("*").alias("applications"),
        F.coalesce(F.sum("job_count"), F.lit(0)).alias("raw_application_stage_rows"),
        F.count("applied_at").alias("dated_applications"),
        *[F.count_if(f"has_{m}").alias(m) for m in _OUTCOMES],
    )
    return counted.select(
        "applications", *_OUTCOMES,
        rate("recruiter_replies", "applications").alias("reply_rate"),
        rate("interviews", "applications").alias("interview_rate"),
        rate("offers", "applications", 2).alias("offer_rate"),
        "raw_application_stage_rows",
        (F.col("raw_application_stage_rows") - F.col("applications"))
        .alias("collapsed_duplicate_or_overlapping_rows"),
        "dated_applications",
        (F.col("applications") - F.col("dated_applications")).alias("undated_applications"),
    )


def overview_periods(facts: DataFrame, now: datetime) -> DataFrame:
    """Last 30/60/90 days and the 90 days before the last 30, with window bounds."""
    windows = overview_windows(now)
    counts = window_counts(_dated(facts), windows)
    starts = F.create_map(*[F.lit(x) for w, s, _ in windows for x in (w, s.isoformat(sep=" "))])
    ends = F.create_map(*[F.lit(x) for w, _, e in windows for x in (w, e.isoformat(sep=" "))])
    return counts.select(
        "window", starts[F.col("window")].alias("window_start"),
        ends[F.col("window")].alias("window_end"), *fixed.METRICS)


def overview_change(facts: DataFrame, now: datetime) -> DataFrame:
    """Per metric: last 30 days against a third of the previous 90 days."""
    wide = window_counts(_dated(facts), overview_windows(now))
    stacked = wide.where(F.col("window").isin("last_30_days", "previous_90_days")).select(
        "window", F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in fixed.METRICS
        ])).alias("s")).select("window", "s.metric", "s.n")
    both = stacked.groupBy("metric").agg(
        F.sum(F.when(F.col("window") == "last_30_days", F.col("n"))).alias("current"),
        F.sum(F.when(F.col("window") == "previous_90_days", F.col("n"))).alias("previous_90_days"))
    average = F.round(F.col("previous_90_days") / 3, 1)
    return both.withColumn("monthly_average", average).withColumn(
        "change_percent", change("current", "monthly_average"))


def monthly_activity(
    facts: DataFrame, now: datetime, months: int = 26,
) -> DataFrame:
    """Gap-free months with the five metrics, the compared period and the change.

    The running month counts up to ``now`` and is compared with the same elapsed time of the
    month before, which ends at the latest where that month ends.
    """
    current = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    windows, start = [], current
    for _ in range(months):
        running = start == current
        end = min(_next_month(start), now) if running else _next_month(start)
        before = _previous_month(start)
        before_end = min(before + (now - start), start) if running else start
        name = start.strftime("%Y-%m")
        windows += [(f"{name}|now", start, end), (f"{name}|before", before, before_end)]
        start = before
    counts = window_counts(_dated(facts), windows)
    split = counts.select(
        F.substring("window", 1, 7).alias("period"), F.substring("window", 9, 6).alias("_side"),
        *fixed.METRICS)

    def side(name: str, metric: str) -> Column:
        return F.sum(F.when(F.col("_side") == name, F.col(metric)))

    both = split.groupBy("period").agg(
        *[side("now", m).alias(m) for m in fixed.METRICS],
        *[side("before", m).alias(f"previous_{m}") for m in fixed.METRICS])
    to_date = F.col("period") == current.strftime("%Y-%m")
    return both.select(
        "period", *fixed.METRICS, *[f"previous_{m}" for m in fixed.METRICS],
        *[change(m, f"previous_{m}").alias(f"change_{m}") for m in fixed.METRICS],
        to_date.alias("is_month_to_date"),
        F.when(to_date, F.lit("previous_month_same_elapsed_days"))
        .otherwise(F.lit("previous_full_month")).alias("comparison_basis"))


def timeline(facts: DataFrame, now: datetime) -> DataFrame:
    """Months from the first event to ``now`` without gaps; undated applications show up as
    ``records_imported`` in their import month.  Months after ``now`` are kept if they have
    events."""
    rows = _dated(facts, imported=True)
    names = (*fixed.METRICS, "records_imported")
    counted = rows.groupBy(period_of("at").alias("period")).agg(*[
        F.count_if(F.col("metric") == m).alias(m) for m in names])
    first = counted.agg(F.min("period").alias("first"))
    last = now.strftime("%Y-%m")
    start = F.least(F.coalesce("first", F.lit(last)), F.lit(last))
    spine = first.select(F.explode(F.sequence(
        F.concat(start, F.lit("-01")).cast("date"), F.lit(f"{last}-01").cast("date"),
        F.expr("INTERVAL '1' MONTH"))).alias("m")).select(period_of("m").alias("period"))
    zero = spine.select("period", *[F.lit(0).cast("bigint").alias(m) for m in names])
    return counted.unionByName(zero).groupBy("period").agg(*[F.sum(m).alias(m) for m in names])


def grouped_funnel(facts: DataFrame, attribute: str, limit: int | None = None) -> DataFrame:
    """Funnel per role family or company.

    Companies group without regard to case under their most common spelling.  Rows are first
    grouped by spelling and then by label, both times with partial aggregation, so a label that
    holds a third of the applications is no hot spot.
    """
    default = "Unknown" if attribute == "company" else "Unclassified"
    label = F.coalesce(F.nullif(F.trim(attribute), F.lit("")), F.lit(default))
    key = F.lower(label) if attribute == "company" else label
    per_label = facts.groupBy(key.alias("_key"), label.alias("_label")).agg(
        F.count("*").alias("_n"), F.count("applied_at").alias("_dated"),
        *[F.count_if(f"has_{m}").alias(m) for m in _OUTCOMES],
        F.max(F.greatest("applied_at", "last_evidence")).alias("_last"))
    grouped = per_label.groupBy("_key").agg(
        F.min_by("_label", F.struct(-F.col("_n"), F.col("_label"))).alias(attribute),
        F.sum("_n").alias("applications"), F.sum("_dated").alias("dated_applications"),
        *[F.sum(m).alias(m) for m in _OUTCOMES], F.max("_last").alias("last_activity"))
    out = grouped.select(
        attribute, "applications", "dated_applications", *_OUTCOMES,
        rate("recruiter_replies", "applications").alias("reply_rate"),
        rate("interviews", "applications").alias("interview_rate"),
        rate("offers", "applications", 2).alias("offer_rate"), "last_activity",
    ).orderBy(F.desc("applications"), F.lower(attribute), attribute)
    return out.limit(limit) if limit else out
