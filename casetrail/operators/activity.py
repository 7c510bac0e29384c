"""Activity by month and day, combined from several sources, and coverage counters.

Everything here first reduces its input to at most one row per calendar day or month; ordered
windows and spines only ever see those rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.dates import day_of, month_spine, period_of, prior_period
from .classify import outcome_group
from .funnel import change_or_null, rate_or_null

_GROUPS = tuple(fixed.OUTCOME_GROUPS)
LEDGER, PLAN, EMAIL = "linkedin_extension_ledger", "application_plan", "email_confirmation"


def email_totals(attributed: DataFrame) -> DataFrame:
    """One row of coverage counters over attributed messages.

    ``attributed``: job_id, classification, attributed_company, role_source.
    """
    named = F.count_if(F.col("attributed_company") != "")
    unlinked = outcome_group("classification").isNotNull() & F.col("job_id").isNull()
    return attributed.agg(
        F.count("*").alias("message_count"), F.count("job_id").alias("linked_job_count"),
        named.alias("company_attributed_count"),
        F.count_if(F.col("role_source") == "explicit").alias("role_explicit_count"),
        F.count_if(F.col("role_source") == "default").alias("role_account_default_count"),
        (F.count("*") - named).alias("unresolved_company_count"),
        F.count_if(unlinked).alias("unlinked_outcome_count"),
    )


def confirmation_totals(confirmations: DataFrame) -> DataFrame:
    known = F.count_if(F.col("role_family") != "")
    return confirmations.agg(
        F.count("*").alias("unique_application_confirmation_count"),
        known.alias("role_attributed_resume_submission_count"),
        (F.count("*") - known).alias("unresolved_resume_submission_count"))


def by_account(messages: DataFrame, account: str = "account_label") -> DataFrame:
    """Messages per account and the count per type as a map (as many entries as types)."""
    counted = messages.groupBy(account, "classification").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("classification", "n")))
    return counted.groupBy(account).agg(
        F.sum("n").alias("messages"), F.map_from_entries(entries).alias("classifications"))


def top_values(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Most common non-empty values; ties in alphabetical order."""
    counted = df.where(F.col(column) != "").groupBy(column).agg(F.count("*").alias("messages"))
    ordered = counted.orderBy(F.desc("messages"), column)
    return ordered.limit(k) if k else ordered


def confirmations_monthly(confirmations: DataFrame) -> DataFrame:
    return confirmations.groupBy("period").agg(F.count("*").alias("unique_applications"))


def confirmations_by_account(confirmations: DataFrame) -> DataFrame:
    """Per month and account; long form, as the number of accounts has no bound."""
    return confirmations.groupBy("period", "account").agg(
        F.count("*").alias("unique_applications"))


def confirmations_daily(confirmations: DataFrame) -> DataFrame:
    return confirmations.groupBy("date").agg(F.count("*").alias("unique_applications"))


def confirmations_by_role(confirmations: DataFrame, monthly: bool = False) -> DataFrame:
    keys = ["period", "role_family"] if monthly else ["role_family"]
    counted = confirmations.where("role_family <> ''").groupBy(*keys).agg(
        F.count("*").alias("confirmed_resume_submissions"))
    if monthly:
        return counted.orderBy(F.desc("period"), F.desc("role_family"))
    return counted.orderBy(F.desc("confirmed_resume_submissions"), "role_family")


def _per_group(df: DataFrame) -> DataFrame:
    return df.groupBy("period").agg(
        *[F.count_if(F.col("outcome_group") == g).alias(g) for g in _GROUPS])


def outcomes_monthly(first_outcomes: DataFrame) -> DataFrame:
    """Deduplicated linked outcomes per month and group."""
    return _per_group(first_outcomes)


def observed_outcomes_monthly(messages: DataFrame, at: str = "occurred_at") -> DataFrame:
    """All outcome messages per month and group, repeated and unlinked ones included."""
    rows = messages.where(F.col(at).isNotNull()).select(
        period_of(at).alias("period"), outcome_group("classification").alias("outcome_group"))
    return _per_group(rows.where("outcome_group IS NOT NULL"))


# --- ledger and activity log -----------------------------------------------------------------


def ledger_daily(ledger: DataFrame, day: str = "day") -> DataFrame:
    return ledger.where(F.col(day).isNotNull()).groupBy(day_of(day).alias("date")).agg(
        F.count("*").alias("submissions"))


def ledger_monthly(ledger: DataFrame, day: str = "day") -> DataFrame:
    """period, submissions, coverage_start, fully_covered.  The first month of all counts as
    fully covered only when it starts on the 1st."""
    daily = ledger_daily(ledger, day)
    monthly = daily.groupBy(F.substring("date", 1, 7).alias("period")).agg(
        F.sum("submissions").alias("submissions"), F.min("date").alias("_first"))
    start = F.min("_first").over(Window.partitionBy())
    staged = monthly.withColumn("coverage_start", start)
    late = (F.substring("coverage_start", 1, 7) == F.col("period")) & ~F.col(
        "coverage_start").endswith("-01")
    return staged.select("period", "submissions", "coverage_start", (~late).alias("fully_covered"))


def _log_days(log: DataFrame, day: str, count: str) -> DataFrame:
    n = F.col(count)
    return log.groupBy(F.col(day).cast("date").alias("_day")).agg(
        F.sum(n).alias("n"), F.count_if(n > 0).alias("active"),
        F.sum(F.when(n > 0, n)).alias("positive")).withColumn("period", period_of("_day"))


def _with_prior(
    days: DataFrame, monthly: DataFrame, value: str, partial: Column, last_day: Column,
) -> DataFrame:
    """Adds the prior month's value; a partial month is compared with the same days of it."""
    prior = monthly.select(F.col("period").alias("_prior"), F.col(value).alias("_full"))
    staged = monthly.withColumns({
        "_prior": prior_period("period"), "_partial": partial, "_last": last_day})
    # at most one partial month, so this join sees one month of days
    same = days.select(F.col("period").alias("_prior"), F.col("_day").alias("_d"), F.col("n").alias("_n"))
    cut = staged.where("_partial").select("_prior", "_last").join(same, "_prior").where(
        F.dayofmonth("_d") <= F.col("_last")).groupBy("_prior").agg(F.sum("_n").alias("_same"))
    joined = staged.join(prior, "_prior", "left").join(cut, "_prior", "left")
    before = F.when(F.col("_partial"), F.coalesce("_same", F.lit(0))).otherwise(F.col("_full"))
    label = F.when(
        F.col("_partial"),
        F.concat("_prior", F.lit(" through day "), F.col("_last").cast("string")),
    ).otherwise(F.col("_prior"))
    return joined.withColumns({
        "change_percent": change_or_null(value, before),
        "comparison_label": F.when(before.isNotNull(), label),
    }).drop("_prior", "_partial", "_last", "_full", "_same")


def log_monthly(log: DataFrame, day: str = "day", count: str = "applications") -> DataFrame:
    """period, applications, active_days, change_percent, comparison_label."""
    days = _log_days(log, day, count)
    monthly = days.groupBy("period").agg(
        F.sum("n").alias("applications"), F.sum("active").alias("active_days"),
        F.max("_day").alias("_max"))
    monthly = monthly.withColumn("_end", F.max("_max").over(Window.partitionBy())).drop("_max")
    partial = (period_of("_end") == F.col("period")) & (F.col("_end") < F.last_day("_end"))
    return _with_prior(days, monthly, "applications", partial, F.dayofmonth("_end")).drop("_end")


def log_summary(log: DataFrame, day: str = "day", count: str = "applications") -> DataFrame:
    """One row: coverage, total and mean of the positive entries."""
    days = _log_days(log, day, count)
    return days.agg(
        F.min("_day").cast("string").alias("coverage_start"),
        F.max("_day").cast("string").alias("coverage_end"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("recorded_applications"),
        F.round(F.try_divide(F.sum("positive"), F.sum("active")), 1).alias("active_day_average"))


def log_daily(log: DataFrame, day: str = "day", count: str = "applications") -> DataFrame:
    return log.groupBy(day_of(F.col(day).cast("date")).alias("date")).agg(
        F.sum(count).alias("applications"))


def missing_months(df: DataFrame, period: str = "period") -> DataFrame:
    """Months between the first and the last without a row."""
    have = df.select(F.col(period).alias("period")).distinct()
    span = have.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    spine = span.where("a IS NOT NULL").select(F.explode(F.sequence(
        F.concat("a", F.lit("-01")).cast("date"), F.concat("b", F.lit("-01")).cast("date"),
        F.expr("INTERVAL '1' MONTH"))).alias("m")).select(period_of("m").alias("period"))
    return spine.join(have, "period", "left_anti")


def larger_source(first: DataFrame, second: DataFrame) -> DataFrame:
    """The ledger with more rows; the first one on a tie.

    Both are read once more than they are counted, and no count comes to the driver.
    """
    both = first.withColumn("_source", F.lit(1)).unionByName(
        second.withColumn("_source", F.lit(2)))
    sizes = both.groupBy("_source").agg(F.count("*").alias("_n"))
    winner = sizes.agg(F.min_by("_source", F.struct(-F.col("_n"), F.col("_source"))).alias("_source"))
    return both.join(F.broadcast(winner), "_source", "left_semi").drop("_source")   # one row


# --- calendar -----------------------------------------------------------------------------------


def calendar_monthly(events: DataFrame, through: str, at: str = "started_at") -> DataFrame:
    """period, events, change; the month of ``through`` compares up to the same day."""
    days = events.groupBy(F.col(at).cast("date").alias("_day")).agg(
        F.count("*").alias("n")).withColumn("period", period_of("_day"))
    monthly = days.groupBy("period").agg(F.sum("n").alias("events"))
    end = date.fromisoformat(through)
    return _with_prior(days, monthly, "events", F.col("period") == through[:7], F.lit(end.day))


def calendar_by(events: DataFrame, key: str, stage: str = "stage") -> DataFrame:
    """Events and counts by stage per company or role."""
    counted = events.groupBy(key).agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col(stage) == s).alias(s) for s in fixed.STAGES])
    return counted.orderBy(F.desc("events"), F.lower(key), key)


def calendar_review(bucketed: DataFrame, start: str, through: str, at: str = "started_at"):
    """Gap-free months with the number of interviews and the four bucket totals."""
    totals = {
        "interview": "interview_event_count", "ambiguous": "ambiguous_event_count",
        "excluded": "excluded_event_count", "cancelled": "cancelled_event_count",
    }
    counted = bucketed.groupBy(period_of(at).alias("period")).agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in totals])
    spine = month_spine(bucketed.sparkSession, F.lit(start), F.lit(through))
    everywhere = Window.partitionBy()
    joined = spine.join(counted, "period", "left")
    return joined.select(
        "period", F.coalesce("interview", F.lit(0)).alias("interviews"),
        *[F.coalesce(F.sum(b).over(everywhere), F.lit(0)).alias(n) for b, n in totals.items()])


# --- combination of sources ------------------------------------------------------------------------


def combined_activity(
    log: DataFrame, email: DataFrame, ledger: DataFrame, start: str, through: str,
) -> DataFrame:
    """One row per month with the count of the best source that covers it.

    ``log``: period, applications.  ``email``: period, unique_applications.  ``ledger``: period,
    submissions, fully_covered.  A fully covered ledger month wins, then the log, then e-mail.
    """
    spine = month_spine(log.sparkSession, F.lit(start), F.lit(through))
    rows = spine.join(log.select("period", F.col("applications").alias("plan_applications")),
                      "period", "left")
    rows = rows.join(email.select("period", F.col("unique_applications").alias("_email")),
                     "period", "left")
    rows = rows.join(ledger.select("period", F.col("submissions").alias("_ledger"),
                                   F.col("fully_covered").alias("_full")), "period", "left")
    by_ledger = F.coalesce("_full", F.lit(False))
    has_log = F.col("plan_applications").isNotNull()
    count = F.when(by_ledger, F.col("_ledger")).when(has_log, F.col("plan_applications")).otherwise(
        F.coalesce("_email", F.lit(0)))
    source = F.when(by_ledger, F.lit(LEDGER)).when(has_log, F.lit(PLAN)).otherwise(F.lit(EMAIL))
    chosen = rows.select(
        "period", "plan_applications",
        F.coalesce("_ledger", F.lit(0)).alias("linkedin_extension_applications"),
        F.coalesce("_email", F.lit(0)).alias("email_confirmed_applications"),
        count.alias("combined_unique_applications"), source.alias("combined_source"))
    previous = F.lag("combined_unique_applications").over(Window.orderBy("period"))
    return chosen.withColumn("_previous", previous).select(
        *chosen.columns,
        change_or_null("combined_unique_applications", "_previous").alias("change_percent"),
        F.when(F.col("_previous").isNotNull(), prior_period("period")).alias("comparison_label"))


def rolling_activity(
    log_days: DataFrame, log_months: DataFrame, email_days: DataFrame, ledger_days: DataFrame,
    ledger_months: DataFrame, through: str, sizes: Sequence[int] = (30, 60, 90),
) -> DataFrame:
    """Totals of the last 30/60/90 days; each day uses the source that covers its month."""
    end = date.fromisoformat(through)
    first = end - timedelta(days=max(sizes) - 1)
    spine = log_days.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(first.isoformat()).cast("date"), F.lit(through).cast("date"))).alias("d")).select(
        day_of("d").alias("date"), period_of("d").alias("period"),
        F.datediff(F.lit(through).cast("date"), F.col("d")).alias("age"))
    covered = ledger_months.where("fully_covered").select("period", F.lit(True).alias("_l"))
    planned = log_months.select("period", F.lit(True).alias("_p")).distinct()
    rows = spine.join(covered, "period", "left").join(planned, "period", "left")
    for side, column, name in (
        (log_days, "applications", "_pn"), (email_days, "unique_applications", "_en"),
        (ledger_days, "submissions", "_ln"),
    ):
        rows = rows.join(side.select("date", F.col(column).alias(name)), "date", "left")
    source = F.when(F.col("_l"), F.lit("l")).when(F.col("_p"), F.lit("p")).otherwise(F.lit("e"))
    value = F.coalesce(
        F.when(source == "l", F.col("_ln")).when(source == "p", F.col("_pn")).otherwise(
            F.col("_en")), F.lit(0))
    spread = rows.select("age", source.alias("source"), value.alias("n"), F.explode(
        F.array(*[F.lit(s) for s in sizes])).alias("days")).where("age < days")
    return spread.groupBy("days").agg(
        F.sum("n").alias("combined_unique_applications"),
        F.count_if(F.col("source") == "p").alias("plan_days"),
        F.count_if(F.col("source") == "l").alias("linkedin_extension_days"),
        F.count_if(F.col("source") == "e").alias("email_confirmation_days"),
    ).select(
        F.col("days").cast("bigint").alias("days"),
        F.date_add(F.lit(through).cast("date"), 1 - F.col("days")).cast("string").alias("start_date"),
        F.lit(through).alias("end_date"), "combined_unique_applications", "plan_days",
        "linkedin_extension_days", "email_confirmation_days")


def monthly_intelligence(combined: DataFrame, outcomes: DataFrame, calendar: DataFrame):
    """Combined activity with linked outcomes, calendar events and conversion rates."""
    o = outcomes.select("period", *[F.col(g).alias(f"_{g}") for g in _GROUPS])
    c = calendar.select("period", F.col("events").alias("_events"))
    joined = combined.join(o, "period", "left").join(c, "period", "left")
    zero = F.lit(0)
    counted = joined.select(
        *combined.columns,
        F.coalesce("_recruiter_replies", zero).alias("recruiter_replies"),
        F.coalesce("_interviews", zero).alias("linked_interviews"),
        F.coalesce("_events", zero).alias("calendar_interview_events"),
        F.coalesce("_offers", zero).alias("offers"),
        F.coalesce("_rejections", zero).alias("rejections"))
    total = "combined_unique_applications"
    return counted.withColumns({
        "response_rate": rate_or_null("recruiter_replies", total),
        "interview_conversion": rate_or_null("linked_interviews", total),
        "offer_conversion": rate_or_null("offers", total)})


def dashboard_totals(intelligence: DataFrame) -> DataFrame:
    sums = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "combined_unique_applications", "recruiter_replies", "linked_interviews",
        "calendar_interview_events", "offers", "rejections")}
    return intelligence.agg(*sums.values()).withColumn(
        "interview_rate", rate_or_null("linked_interviews", "combined_unique_applications"))


# --- counters of the stored tables ------------------------------------------------------------------


def funnel_totals(accounts: DataFrame, roles: DataFrame) -> DataFrame:
    """Sums over the account and role funnel tables."""
    a = accounts.agg(*[F.sum(c).alias(c) for c in ("applications", "hm_team", "finals")])
    r = roles.agg(F.sum("offers").alias("offers"))
    return a.withColumn("_k", F.lit(1)).join(r.withColumn("_k", F.lit(1)), "_k").drop("_k")


def table_counts(**tables: DataFrame) -> DataFrame:
    """(table, rows) of the named frames."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def resume_effectiveness(resumes: DataFrame, applications: DataFrame) -> DataFrame:
    """Applications and mean score per resume; unused resumes are kept."""
    used = applications.where(F.col("resume_id").isNotNull()).groupBy(
        F.col("resume_id").alias("id")).agg(
        F.count("*").alias("_n"), F.round(F.avg("match_score"), 2).alias("average_match_score"))
    return resumes.join(used, "id", "left").select(
        "name", F.coalesce("_n", F.lit(0)).alias("applications"), "average_match_score")


def sync_status(
    messages: DataFrame, classified: DataFrame, events: DataFrame, checkpoints: DataFrame,
    providers: Sequence[str] = fixed.PROVIDERS,
) -> DataFrame:
    """Per provider of the fixed list: message, classification, event and checkpoint counts."""
    out = messages.sparkSession.createDataFrame([(p,) for p in providers], "provider string")
    for df, name in (
        (messages, "message_evidence_count"), (classified, "classification_count"),
        (events, "interview_event_count"), (checkpoints, "checkpoint_count"),
    ):
        counted = df.groupBy("provider").agg(F.count("*").alias(name))
        out = out.join(counted, "provider", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    state = (
        F.when(F.col("checkpoint_count") > 0, F.lit("checkpointed"))
        .when(F.col("message_evidence_count") > 0, F.lit("evidence_without_checkpoint"))
        .otherwise(F.lit("never_synced")))
    return out.withColumn("state", state)


def import_summary(messages: DataFrame, run: str = "run") -> DataFrame:
    """Totals per import run over (classification, matched, already, error)."""
    confirmed = F.col("classification") == fixed.CONFIRMATION_TYPE
    fresh = ~F.col("already") & F.col("error").isNull()
    return messages.groupBy(run).agg(
        F.count("*").alias("total_messages"), F.count_if(confirmed).alias("confirmations_found"),
        F.count_if(confirmed & fresh & F.col("matched")).alias("matched_jobs"),
        F.count_if(confirmed & fresh & ~F.col("matched")).alias("unmatched_jobs"),
        F.count_if(fresh).alias("newly_imported"), F.count_if("already").alias("already_imported"),
        F.count_if(~F.col("already") & F.col("error").isNotNull()).alias("failed"))


def import_preview(matched: DataFrame, ordinal: str, limit: int = 100) -> DataFrame:
    """The first matched confirmations in input order."""
    return matched.orderBy(ordinal).limit(limit)


def interview_totals(interviews: DataFrame, now: str) -> DataFrame:
    start = F.col("scheduled_start")
    upcoming = (start >= F.lit(now).cast("timestamp_ntz")) & (F.col("status") != "cancelled")
    return interviews.agg(
        F.count("*").alias("interviews"), F.count_if(upcoming).alias("upcoming"),
        F.count_if(start.isNull()).alias("unscheduled"),
        F.count_if(F.col("interview_type") == "assessment").alias("assessments"))


def contact_totals(contacts: DataFrame, companies: DataFrame, emails: DataFrame) -> DataFrame:
    counted = table_counts(contacts=contacts, emails=emails,
                           companies=companies.select("company_name").distinct())
    return counted.agg(*[
        F.sum(F.when(F.col("table") == t, F.col("rows"))).alias(t)
        for t in ("contacts", "companies", "emails")])
