"""Activity, attribution and counter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..operators import activity as A
from ..operators import classify as C
from ..operators import identity as I
from ..operators import linkage as J
from ..operators import matching
from ..functions import extract as X
from .bindings import FIRST_MONTH, NOW, THROUGH, Views
from .funnel_queries import (
    _GROUP, _IN, CALENDAR_SQL, CONFIRM_SQL, FIRST_OUTCOME_SQL, MAIL_SQL, calendar_events,
    confirmations, mail_rows,
)
from .linkage_queries import ATTRIBUTED_SQL, MATCH_SQL, attribution_rows
from .registry import query

_GROUPS = tuple(fixed.OUTCOME_GROUPS)


def attributed(v: Views) -> DataFrame:
    from ..operators.classify import classify

    rows, found = attribution_rows(v)
    kinds = classify(v.messages).select("message_identity", "classification")
    return J.message_attribution(rows, found).join(kinds, "message_identity")


from .funnel_queries import _MSG  # noqa: E402

_COUNTS = f"""attr AS (SELECT a.*, c.classification, {_GROUP} AS g FROM attributed a JOIN classified c ON c.key = a.id)"""


@query("email_totals", "A-10", f"""WITH {_MSG}, {ATTRIBUTED_SQL}, {_COUNTS} SELECT count(*) AS message_count, count(job_id) AS linked_job_count, count_if(attributed_company <> '') AS company_attributed_count,
count_if(role_source = 'explicit') AS role_explicit_count, count_if(role_source = 'default') AS role_account_default_count, count_if(attributed_company = '') AS unresolved_company_count, count_if(g IS NOT NULL AND job_id IS NULL) AS unlinked_outcome_count FROM attr""")
def email_totals(v: Views) -> DataFrame:
    return A.email_totals(attributed(v))


@query("confirmation_totals", "A-10", f"WITH {CONFIRM_SQL} SELECT count(*) AS unique_application_confirmation_count, count_if(role_family <> '') AS role_attributed_resume_submission_count, count_if(role_family = '') AS unresolved_resume_submission_count FROM confirmations")
def confirmation_totals(v: Views) -> DataFrame:
    return A.confirmation_totals(confirmations(v))


@query("by_account", "A-11", f"""WITH {MAIL_SQL}, c AS (SELECT account_label, classification, count(*) AS n FROM mail GROUP BY ALL)
SELECT account_label, sum(n)::BIGINT AS messages, string_agg(classification || '=' || n, ',' ORDER BY classification) AS classifications FROM c GROUP BY account_label""")
def by_account(v: Views) -> DataFrame:
    out = A.by_account(mail_rows(v))
    text = F.transform(F.map_entries("classifications"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("account_label", "messages", F.array_join(text, ",").alias("classifications"))


@query("top_message_companies", "A-12", f"WITH {ATTRIBUTED_SQL} SELECT attributed_company, count(*) AS messages FROM attributed WHERE attributed_company <> '' GROUP BY 1 ORDER BY messages DESC, attributed_company LIMIT 50")
def top_message_companies(v: Views) -> DataFrame:
    return A.top_values(J.message_attribution(*attribution_rows(v)), "attributed_company", 50)


@query("top_message_roles", "A-12", f"WITH {ATTRIBUTED_SQL} SELECT attributed_role, count(*) AS messages FROM attributed WHERE attributed_role <> '' GROUP BY 1")
def top_message_roles(v: Views) -> DataFrame:
    return A.top_values(J.message_attribution(*attribution_rows(v)), "attributed_role")


@query("confirmations_monthly", "A-13", f"WITH {CONFIRM_SQL} SELECT period, count(*) AS unique_applications FROM confirmations GROUP BY 1")
def confirmations_monthly(v: Views) -> DataFrame:
    return A.confirmations_monthly(confirmations(v))


@query("confirmations_by_account", "A-13", f"WITH {CONFIRM_SQL} SELECT period, account, count(*) AS unique_applications FROM confirmations GROUP BY 1, 2")
def confirmations_by_account(v: Views) -> DataFrame:
    return A.confirmations_by_account(confirmations(v))


@query("confirmations_daily", "A-13", f"WITH {CONFIRM_SQL} SELECT date, count(*) AS unique_applications FROM confirmations GROUP BY 1")
def confirmations_daily(v: Views) -> DataFrame:
    return A.confirmations_daily(confirmations(v))


@query("confirmations_by_role", "A-14", f"WITH {CONFIRM_SQL} SELECT role_family, count(*) AS confirmed_resume_submissions FROM confirmations WHERE role_family <> '' GROUP BY 1")
def confirmations_by_role(v: Views) -> DataFrame:
    return A.confirmations_by_role(confirmations(v))


@query("confirmations_monthly_by_role", "A-14", f"WITH {CONFIRM_SQL} SELECT period, role_family, count(*) AS confirmed_resume_submissions FROM confirmations WHERE role_family <> '' GROUP BY 1, 2")
def confirmations_monthly_by_role(v: Views) -> DataFrame:
    return A.confirmations_by_role(confirmations(v), monthly=True)


_PG = ", ".join(f"count_if(outcome_group = '{g}') AS {g}" for g in _GROUPS)


@query("outcomes_monthly", "A-15", f"WITH {FIRST_OUTCOME_SQL} SELECT period, {_PG} FROM first_outcomes GROUP BY 1")
def outcomes_monthly(v: Views) -> DataFrame:
    return A.outcomes_monthly(first_outcomes(v))


def first_outcomes(v: Views) -> DataFrame:
    return I.first_outcome(v.evidence.withColumn("occurred_at", F.col("occurred_at").cast("string")))


@query("observed_outcomes_monthly", "A-15", f"SELECT strftime(occurred_at, '%Y-%m') AS period, {_PG} FROM (SELECT *, {_GROUP} AS outcome_group FROM <<evidence>>) q WHERE outcome_group IS NOT NULL AND occurred_at IS NOT NULL GROUP BY 1")
def observed_outcomes_monthly(v: Views) -> DataFrame:
    return A.observed_outcomes_monthly(v.evidence)


LEDGER_SQL = """ledger AS (SELECT strftime(day, '%Y-%m') AS period, count(*) AS submissions, (SELECT min(day) FROM <<ledger>>) AS first FROM <<ledger>> GROUP BY 1),
ledger_months AS (SELECT period, submissions, CAST(first AS VARCHAR) AS coverage_start, NOT (period = strftime(first, '%Y-%m') AND day(first) <> 1) AS fully_covered FROM ledger)"""


@query("ledger_monthly", "A-16", f"WITH {LEDGER_SQL} SELECT period, submissions, coverage_start, fully_covered::BIGINT AS fully_covered FROM ledger_months")
def ledger_monthly(v: Views) -> DataFrame:
    return A.ledger_monthly(v.ledger).withColumn("fully_covered", F.col("fully_covered").cast("int").cast("bigint"))


@query("ledger_daily", "A-16", "SELECT CAST(day AS VARCHAR) AS date, count(*) AS submissions FROM <<ledger>> GROUP BY 1")
def ledger_daily(v: Views) -> DataFrame:
    return A.ledger_daily(v.ledger)


def _chg(c: str, p: str) -> str:
    return f"CASE WHEN {p} <> 0 THEN round(({c} - {p}) / {p} * 100, 1) END::DOUBLE"


LOG_SQL = f"""log_m AS (SELECT strftime(day, '%Y-%m') AS period, sum(applications)::BIGINT AS applications, count_if(applications > 0) AS active_days FROM <<activity_log>> GROUP BY 1),
log_end AS (SELECT max(day) AS last FROM <<activity_log>>),
log_p AS (SELECT m.*, strftime(CAST(period || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS prior, period = strftime(last, '%Y-%m') AND last < last_day(last) AS part, day(last) AS ld FROM log_m m, log_end),
log_months AS (SELECT p.*, CASE WHEN part THEN coalesce((SELECT sum(applications) FROM <<activity_log>> WHERE strftime(day, '%Y-%m') = p.prior AND day(day) <= p.ld), 0)::BIGINT ELSE b.applications END AS before FROM log_p p LEFT JOIN log_m b ON b.period = p.prior)"""


@query("log_monthly", "A-17", f"WITH {LOG_SQL} SELECT period, applications, active_days, {_chg('applications', 'before')} AS change_percent, CASE WHEN before IS NOT NULL THEN prior || CASE WHEN part THEN ' through day ' || ld ELSE '' END END AS comparison_label FROM log_months")
def log_monthly(v: Views) -> DataFrame:
    return A.log_monthly(v.activity_log)


@query("log_summary", "A-17", "SELECT CAST(min(day) AS VARCHAR) AS coverage_start, CAST(max(day) AS VARCHAR) AS coverage_end, sum(applications)::BIGINT AS recorded_applications, round(avg(CASE WHEN applications > 0 THEN applications END), 1)::DOUBLE AS active_day_average FROM <<activity_log>>")
def log_summary(v: Views) -> DataFrame:
    return A.log_summary(v.activity_log)


@query("missing_months", "W-07 A-17", "SELECT strftime(m, '%Y-%m') AS period FROM (SELECT unnest(generate_series(DATE '1997-03-01', DATE '2001-03-01', INTERVAL 1 MONTH)) AS m) q WHERE strftime(m, '%Y-%m') NOT IN (SELECT strftime(day, '%Y-%m') FROM <<activity_log>>)")
def missing_months(v: Views) -> DataFrame:
    return A.missing_months(A.log_monthly(v.activity_log))


_DED = f"""dedup AS (SELECT *, row_number() OVER (PARTITION BY started_at, lower(regexp_replace(summary, '\\s+', ' ', 'g')) ORDER BY id) AS rn FROM bucketed WHERE bucket = 'interview')"""
_CALM = f"""cal_d AS (SELECT CAST(started_at AS DATE) AS d, count(*) AS n FROM dedup WHERE rn = 1 GROUP BY 1), cal_m AS (SELECT strftime(d, '%Y-%m') AS period, sum(n)::BIGINT AS events FROM cal_d GROUP BY 1)"""


def interviews(v: Views) -> DataFrame:
    return C.calendar_buckets(calendar_events(v), "2024-01-03", "2024-01-20").where("bucket = 'interview'")


@query("calendar_monthly", "A-18", f"WITH {CALENDAR_SQL}, {_DED}, {_CALM} SELECT period, events, NULL::DOUBLE AS change_percent, CASE WHEN period = '2024-01' THEN '2023-12 through day 20' END AS comparison_label FROM cal_m")
def calendar_monthly(v: Views) -> DataFrame:
    return A.calendar_monthly(interviews(v), "2024-01-20")


_IE = """(SELECT id, occurred_at AS started_at FROM <<interview_events>>)"""


@query("event_calendar_monthly", "A-18", f"""WITH d AS (SELECT CAST(started_at AS DATE) AS d, count(*) AS n FROM {_IE} q WHERE started_at <= TIMESTAMP '{THROUGH}' GROUP BY 1), m AS (SELECT strftime(d, '%Y-%m') AS period, sum(n)::BIGINT AS events FROM d GROUP BY 1),
p AS (SELECT m.*, strftime(CAST(period || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS prior, period = '{THROUGH[:7]}' AS part FROM m),
b AS (SELECT p.*, CASE WHEN part THEN (SELECT coalesce(sum(n), 0) FROM d WHERE strftime(d.d, '%Y-%m') = p.prior AND day(d.d) <= {int(THROUGH[8:])})::BIGINT ELSE m2.events END AS before FROM p LEFT JOIN m m2 ON m2.period = p.prior)
SELECT period, events, {_chg('events', 'before')} AS change_percent, CASE WHEN before IS NOT NULL THEN prior || CASE WHEN part THEN ' through day {int(THROUGH[8:])}' ELSE '' END END AS comparison_label FROM b""")
def event_calendar_monthly(v: Views) -> DataFrame:
    return A.calendar_monthly(v.sql(_IE[1:-1]).where(F.col("started_at") <= F.lit(THROUGH).cast("timestamp_ntz")), THROUGH)


_STAGE = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in fixed.STAGE_RULES) + ", 'unknown')"
_ST = ", ".join(f"count_if(stage = '{s}') AS {s}" for s in fixed.STAGES)


@query("calendar_by_company", "A-19", f"WITH q AS (SELECT company, {_STAGE} AS stage FROM (SELECT m.company, c.subject || ' ' || c.body AS t FROM <<messages>> c JOIN <<confirmed>> m ON m.id = c.id) z) SELECT company, count(*) AS events, {_ST} FROM q GROUP BY company")
def calendar_by_company(v: Views) -> DataFrame:
    rows = v.messages.select("id", X.stage(F.concat_ws(" ", "subject", "body")).alias("stage")).join(
        v.confirmed.select("id", "company"), "id")
    return A.calendar_by(rows, "company")


@query("funnel_totals", "A-20 S-05", "SELECT sum(a)::BIGINT AS applications, sum(h)::BIGINT AS hm_team, sum(f)::BIGINT AS finals, sum(o)::BIGINT AS offers FROM (SELECT o_custkey AS k, count(*) AS a, count_if(o_orderstatus <> 'O') AS h, count_if(o_orderstatus = 'P') AS f, count_if(o_orderkey % 9 = 0) AS o FROM <<orders>> GROUP BY 1) q")
def funnel_totals(v: Views) -> DataFrame:
    from ..sources.tables import parse_funnel

    o = v.orders
    texts = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count("*").alias("a"), F.count_if(F.col("o_orderstatus") != "O").alias("h"),
        F.count_if(F.col("o_orderstatus") == "P").alias("f"), F.count_if(F.col("o_orderkey") % 9 == 0).alias("o"))
    texts = texts.select(F.col("k").cast("string").alias("label"), F.format_number("a", 0).alias("applications"),
                         F.format_number("h", 0).alias("hm_team"), F.lit("6.8%").alias("hm_rate"),
                         F.format_number("f", 0).alias("finals"), F.lit(" 1.5% ").alias("final_rate"),
                         F.format_number("o", 0).alias("offers"))
    table = parse_funnel(texts)
    return A.funnel_totals(table, table)


@query("table_counts", "A-21", "SELECT 'applications' AS \"table\", count(*) AS rows FROM <<applications>> UNION ALL SELECT 'companies', count(*) FROM <<companies>> UNION ALL SELECT 'offers', count(*) FROM <<offers>> UNION ALL SELECT 'interactions', count(*) FROM <<interactions>> UNION ALL SELECT 'resumes', count(*) FROM <<resumes>>")
def table_counts(v: Views) -> DataFrame:
    return A.table_counts(applications=v.applications, companies=v.companies, offers=v.offers,
                          interactions=v.interactions, resumes=v.resumes)


@query("application_statuses", "A-21", "SELECT status, count(*) AS rows FROM <<applications>> GROUP BY 1")
def application_statuses(v: Views) -> DataFrame:
    return A.counts_by(v.applications, "status")


@query("application_sources", "A-21", "SELECT source, count(*) AS rows FROM <<applications>> GROUP BY 1")
def application_sources(v: Views) -> DataFrame:
    return A.counts_by(v.applications, "source")


@query("resume_effectiveness", "A-21", "SELECT r.name, count(a.id) AS applications, round(avg(a.match_score), 2)::DOUBLE AS average_match_score FROM <<resumes>> r LEFT JOIN <<applications>> a ON a.resume_id = r.id GROUP BY r.id, r.name")
def resume_effectiveness(v: Views) -> DataFrame:
    return A.resume_effectiveness(v.resumes, v.applications)


@query("sync_status", "A-22", f"""WITH p(provider) AS (VALUES {', '.join(f"('{p}')" for p in fixed.PROVIDERS)}), t AS (SELECT provider, (SELECT count(*) FROM <<metadata>> m WHERE m.provider = p.provider) AS message_evidence_count,
(SELECT count(*) FROM <<evidence>> m WHERE m.provider = p.provider) AS classification_count, (SELECT count(*) FROM <<interview_events>> m WHERE m.provider = p.provider) AS interview_event_count,
(SELECT count(*) FROM (SELECT DISTINCT provider, account FROM <<checkpoints>>) c WHERE c.provider = p.provider) AS checkpoint_count FROM p)
SELECT *, CASE WHEN checkpoint_count > 0 THEN 'checkpointed' WHEN message_evidence_count > 0 THEN 'evidence_without_checkpoint' ELSE 'never_synced' END AS state FROM t""")
def sync_status(v: Views) -> DataFrame:
    return A.sync_status(v.metadata, v.evidence, v.interview_events,
                         v.checkpoints.select("provider", "account").distinct())


@query("import_summary", "A-23", """SELECT provider, count(*) AS total_messages, count_if(classification = 'APPLICATION_CONFIRMATION') AS confirmations_found, count_if(classification = 'APPLICATION_CONFIRMATION' AND contact_id % 5 <> 0 AND contact_id % 7 <> 0 AND job_id IS NOT NULL) AS matched_jobs,
count_if(classification = 'APPLICATION_CONFIRMATION' AND contact_id % 5 <> 0 AND contact_id % 7 <> 0 AND job_id IS NULL) AS unmatched_jobs, count_if(contact_id % 5 <> 0 AND contact_id % 7 <> 0) AS newly_imported, count_if(contact_id % 5 = 0) AS already_imported, count_if(contact_id % 5 <> 0 AND contact_id % 7 = 0) AS failed FROM <<evidence>> GROUP BY 1""")
def import_summary(v: Views) -> DataFrame:
    rows = v.evidence.withColumns({
        "matched": F.col("job_id").isNotNull(), "already": F.col("contact_id") % 5 == 0,
        "error": F.when(F.col("contact_id") % 7 == 0, F.lit("bad header"))})
    return A.import_summary(rows, "provider")


@query("import_preview", "O-05", f"WITH {MATCH_SQL} SELECT c.id, c.company, m.job_id FROM <<confirmed>> c JOIN (SELECT message_identity, job_id FROM matches WHERE matched) m ON m.message_identity = c.message_identity ORDER BY c.id LIMIT 100")
def import_preview(v: Views) -> DataFrame:
    matched = matching.match_applications(v.confirmed, v.jobs).where("matched").select("message_identity", "job_id")
    return A.import_preview(v.confirmed.join(matched, "message_identity").select("id", "company", "job_id"), "id")


@query("larger_source", "A-24", "SELECT CAST(day AS VARCHAR) AS day, id FROM <<ledger>> WHERE (SELECT count(*) FROM <<ledger>>) > (SELECT count(*) FROM <<activity_log>>) UNION ALL SELECT CAST(day AS VARCHAR), applications FROM <<activity_log>> WHERE (SELECT count(*) FROM <<ledger>>) <= (SELECT count(*) FROM <<activity_log>>)")
def larger_source(v: Views) -> DataFrame:
    other = v.activity_log.select("day", F.col("applications").alias("id"))
    return A.larger_source(other, v.ledger).withColumn("day", F.col("day").cast("string"))


@query("interview_totals", "A-25", f"SELECT count(*) AS interviews, count_if(scheduled_start >= TIMESTAMP '{NOW}' - INTERVAL 1 YEAR AND status <> 'cancelled') AS upcoming, count_if(scheduled_start IS NULL) AS unscheduled, count_if(interview_type = 'assessment') AS assessments FROM <<interviews>>")
def interview_totals(v: Views) -> DataFrame:
    return A.interview_totals(v.interviews, "2000-08-15 00:00:00")


@query("contact_totals", "A-26", "SELECT (SELECT count(*) FROM <<contacts>>) AS contacts, (SELECT count(DISTINCT company_name) FROM <<contact_companies>>) AS companies, (SELECT count(*) FROM <<contact_emails>>) AS emails")
def contact_totals(v: Views) -> DataFrame:
    return A.contact_totals(v.contacts, v.contact_companies, v.contact_emails)


# --- combined windows ----------------------------------------------------------------------------------
COMBINED_SQL = CONFIRM_SQL + ", " + LOG_SQL + ", " + LEDGER_SQL + f""", email_m AS (SELECT period, count(*) AS n FROM confirmations GROUP BY 1),
spine AS (SELECT strftime(m, '%Y-%m') AS period FROM (SELECT unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{THROUGH}', INTERVAL 1 MONTH)) AS m) q),
comb AS (SELECT s.period, l.applications AS plan_applications, coalesce(g.submissions, 0) AS linkedin_extension_applications, coalesce(e.n, 0) AS email_confirmed_applications,
  CASE WHEN g.fully_covered THEN g.submissions WHEN l.applications IS NOT NULL THEN l.applications ELSE coalesce(e.n, 0) END AS combined_unique_applications,
  CASE WHEN g.fully_covered THEN 'linkedin_extension_ledger' WHEN l.applications IS NOT NULL THEN 'application_plan' ELSE 'email_confirmation' END AS combined_source
  FROM spine s LEFT JOIN log_m l ON l.period = s.period LEFT JOIN ledger_months g ON g.period = s.period LEFT JOIN email_m e ON e.period = s.period),
combl AS (SELECT *, lag(combined_unique_applications) OVER (ORDER BY period) AS prev FROM comb),
combined AS (SELECT * EXCLUDE (prev), {_chg('combined_unique_applications', 'prev')} AS change_percent, CASE WHEN prev IS NOT NULL THEN strftime(CAST(period || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') END AS comparison_label FROM combl)"""


def combined(v: Views) -> DataFrame:
    return A.combined_activity(
        A.log_monthly(v.activity_log), A.confirmations_monthly(confirmations(v)),
        A.ledger_monthly(v.ledger), FIRST_MONTH, THROUGH)


@query("combined_activity", "W-03", f"WITH {COMBINED_SQL} SELECT * FROM combined")
def combined_activity(v: Views) -> DataFrame:
    return combined(v)


_ROLL_END = "2001-03-20"


@query("rolling_activity", "W-04", f"""WITH {COMBINED_SQL}, days AS (SELECT CAST(d AS DATE) AS d, CAST(CAST(d AS DATE) AS VARCHAR) AS day, strftime(d, '%Y-%m') AS period FROM (SELECT unnest(generate_series(DATE '{_ROLL_END}' - INTERVAL 89 DAY, DATE '{_ROLL_END}', INTERVAL 1 DAY)) AS d) q),
src AS (SELECT d.d, CASE WHEN g.fully_covered THEN 'l' WHEN l.period IS NOT NULL THEN 'p' ELSE 'e' END AS s, d.day FROM days d LEFT JOIN ledger_months g ON g.period = d.period LEFT JOIN log_m l ON l.period = d.period),
val AS (SELECT src.*, CASE s WHEN 'l' THEN (SELECT count(*) FROM <<ledger>> x WHERE x.day = src.d) WHEN 'p' THEN (SELECT coalesce(sum(applications), 0) FROM <<activity_log>> x WHERE x.day = src.d) ELSE (SELECT count(*) FROM confirmations x WHERE x.date = src.day) END AS n FROM src)
SELECT w::BIGINT AS days, CAST(CAST(DATE '{_ROLL_END}' - INTERVAL 1 DAY * (w - 1) AS DATE) AS VARCHAR) AS start_date, '{_ROLL_END}' AS end_date, sum(n)::BIGINT AS combined_unique_applications, count_if(s = 'p') AS plan_days, count_if(s = 'l') AS linkedin_extension_days, count_if(s = 'e') AS email_confirmation_days
FROM val JOIN (VALUES (30), (60), (90)) k(w) ON d > DATE '{_ROLL_END}' - INTERVAL 1 DAY * w GROUP BY w""")
def rolling_activity(v: Views) -> DataFrame:
    return A.rolling_activity(
        A.log_daily(v.activity_log), A.log_monthly(v.activity_log).select("period"),
        A.confirmations_daily(confirmations(v)), A.ledger_daily(v.ledger),
        A.ledger_monthly(v.ledger), _ROLL_END)


_EVM = "evm AS (SELECT strftime(occurred_at, '%Y-%m') AS period, count(*) AS events FROM <<interview_events>> GROUP BY 1)"
INTEL_SQL = COMBINED_SQL + ", " + FIRST_OUTCOME_SQL + ", " + _EVM + f""", om AS (SELECT period, {_PG} FROM first_outcomes GROUP BY 1),
intel AS (SELECT c.*, coalesce(o.recruiter_replies, 0) AS recruiter_replies, coalesce(o.interviews, 0) AS linked_interviews, coalesce(e.events, 0) AS calendar_interview_events, coalesce(o.offers, 0) AS offers, coalesce(o.rejections, 0) AS rejections
 FROM combined c LEFT JOIN om o ON o.period = c.period LEFT JOIN evm e ON e.period = c.period)"""


def _ron(n: str) -> str:
    return f"CASE WHEN combined_unique_applications > 0 THEN round({n} / combined_unique_applications * 100, 1) END::DOUBLE"


def intelligence(v: Views) -> DataFrame:
    cal = A.calendar_monthly(v.sql(_IE[1:-1]), THROUGH)
    return A.monthly_intelligence(combined(v), A.outcomes_monthly(first_outcomes(v)), cal)


@query("monthly_intelligence", "W-05", f"WITH {INTEL_SQL} SELECT *, {_ron('recruiter_replies')} AS response_rate, {_ron('linked_interviews')} AS interview_conversion, {_ron('offers')} AS offer_conversion FROM intel")
def monthly_intelligence(v: Views) -> DataFrame:
    return intelligence(v)


_TOT = ("combined_unique_applications", "recruiter_replies", "linked_interviews", "calendar_interview_events", "offers", "rejections")


@query("dashboard_totals", "A-27", f"WITH {INTEL_SQL}, s AS (SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in _TOT)} FROM intel) SELECT *, {_ron('linked_interviews')} AS interview_rate FROM s")
def dashboard_totals(v: Views) -> DataFrame:
    return A.dashboard_totals(intelligence(v))


_BK = (("interview", "interview_event_count"), ("ambiguous", "ambiguous_event_count"), ("excluded", "excluded_event_count"), ("cancelled", "cancelled_event_count"))


@query("calendar_review", "W-06", f"""WITH {CALENDAR_SQL}, {_DED}, k AS (SELECT bucket, started_at FROM bucketed WHERE bucket <> 'interview' UNION ALL SELECT bucket, started_at FROM dedup WHERE rn = 1),
sp AS (SELECT strftime(m, '%Y-%m') AS period FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-02-01', INTERVAL 1 MONTH)) AS m) q)
SELECT period, (SELECT count(*) FROM k WHERE bucket = 'interview' AND strftime(started_at, '%Y-%m') = period) AS interviews, {', '.join(f"(SELECT count(*) FROM k WHERE bucket = '{b}') AS {n}" for b, n in _BK)} FROM sp""")
def calendar_review(v: Views) -> DataFrame:
    b = C.calendar_buckets(calendar_events(v), "2024-01-03", "2024-01-20")
    return A.calendar_review(b, "2023-11-15", "2024-02-02")


__all__ = ["_IN"]
