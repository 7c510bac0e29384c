"""Filters, scores and projections over postings, interviews and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..operators.ranking import newest_first
from .text import normalize_company_contact, text_or_empty, words


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def job_filter(
    df: DataFrame, *, max_applicants: int | None = None, status: str | None = None,
    search: str | None = None, account: str | None = None, role: str | None = None,
    limit: int | None = None, filter_first: bool = False,
) -> DataFrame:
    """Best jobs; by default the limit cuts before the filters apply."""
    kept = F.lit(True)
    if max_applicants is not None:
        kept = (
            kept & F.col("applicant_count").isNotNull() & ~F.col("applicant_count_is_over")
            & (F.col("applicant_count") < max_applicants)
        )
    for name, value in (("status", status), ("email_account", account), ("role_family", role)):
        if value:
            kept = kept & (F.col(name) == value)
    if search:
        haystack = F.lower(F.concat_ws(" ", "title", "company", "location"))
        kept = kept & F.contains(haystack, F.lit(search.lower()))
    order = [F.desc("score"), F.desc("last_seen_at"), F.asc("id")]
    if filter_first:
        return newest_first(df.where(kept), order, limit)
    return newest_first(df, order, limit).where(kept)


def interview_filter(
    df: DataFrame, *, status=None, interview_type=None, job_id=None, contact_id=None,
    start=None, end=None, now=None, upcoming: bool = False, provider=None, company=None,
    events: DataFrame | None = None, jobs: DataFrame | None = None,
) -> DataFrame:
    """Interviews by equality, closed start range, event provider and job company."""
    for name, value in (
        ("status", status), ("interview_type", interview_type), ("job_id", job_id),
        ("recruiter_id", contact_id),
    ):
        if value is not None:
            df = df.where(F.col(name) == value)
    at = F.col("scheduled_start")
    if start is not None:
        df = df.where(at >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(at <= F.lit(end).cast("timestamp_ntz"))
    if upcoming:
        df = df.where((at >= F.lit(now).cast("timestamp_ntz")) & (F.col("status") != "cancelled"))
    if provider is not None:
        hits = events.where(F.col("provider") == provider.lower()).select(
            F.col("interview_id").alias("id"))
        df = df.join(hits, "id", "left_semi")
    if company is not None:
        hits = jobs.where(F.col("company") == company).select(F.col("id").alias("job_id"))
        df = df.join(hits, "job_id", "left_semi")
    return df.orderBy(at.asc_nulls_first(), "id")


def classification_filter(
    df: DataFrame, *, type_name: str | None = None, provider: str | None = None,
    imported: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    if type_name:
        df = df.where(F.col("classification") == type_name.upper())
    if provider:
        hits = imported.where(F.col("provider") == provider.lower()).select("message_identity")
        df = df.join(hits, "message_identity", "left_semi")
    return newest_first(df, [F.desc("id")], limit)


def contact_filter(
    contacts: DataFrame, companies: DataFrame, emails: DataFrame, *,
    company: str | None = None, email: str | None = None, limit: int | None = None,
) -> DataFrame:
    if company:
        wanted = companies.where(
            F.col("normalized_company_name") == normalize_company_contact(F.lit(company))
        ).select(F.col("recruiter_id").alias("id"))
        contacts = contacts.join(wanted, "id", "left_semi")
    if email:
        wanted = emails.where(F.col("normalized_email") == email.strip().casefold()).select(
            F.col("recruiter_id").alias("id"))
        contacts = contacts.join(wanted, "id", "left_semi")
    return newest_first(contacts, [F.desc("last_seen_at"), F.asc("id")], limit)


def priority_score(
    count, over, title, description, easy_apply, promoted, location, work_mode,
) -> Column:
    """Posting priority between 0 and 100."""
    n = _col(count)
    band = (
        F.when(n.isNull(), 0).when(_col(over), -35).when(n < 25, 35).when(n < 50, 28)
        .when(n < 100, 18).when(n < 200, -5).otherwise(-25)
    )
    text = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(description)))
    place = F.lower(F.concat_ws(" ", text_or_empty(location), text_or_empty(work_mode)))

    def bonus(hit: Column, value: int) -> Column:
        return F.when(hit, value).otherwise(0)

    total = (
        F.lit(50) + band
        + bonus(text.rlike("growth|lifecycle|product marketing|performance marketing"), 8)
        + bonus(text.rlike("senior|lead|principal|manager|director"), 4)
        + bonus(_col(easy_apply), 2) + bonus(_col(promoted), -3)
        + bonus(F.contains(place, F.lit("remote")), 2)
    )
    return F.round(F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("double"), 1)


def resume_score(resume: str | Column, job: str | Column) -> Column:
    """Share of the job's words found in the resume, in percent; a missing side scores 0."""
    resume, job = _col(resume), _col(job)
    job_words = words(job)
    shared = F.size(F.array_intersect(words(resume), job_words))
    score = F.round(F.lit(100.0) * shared / F.greatest(F.lit(1), F.size(job_words)), 2)
    return F.when(resume.isNull() | job.isNull(), F.lit(0.0)).otherwise(score)


def application_stage(df: DataFrame, *statuses: str) -> DataFrame:
    """Rows whose first known status means that an application was made."""
    status = F.lower(F.coalesce(*[F.col(s) for s in statuses], F.lit("")))
    return df.where(~status.isin(*fixed.NOT_AN_APPLICATION))


def default_label(c: str | Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(_col(c)), F.lit("")), F.lit(default))


def account_profile(
    df: DataFrame, profiles: DataFrame, provider: str = "provider", account: str = "account",
) -> DataFrame:
    """Adds account label and default role: exact account, else provider default, else Unmapped.

    ``profiles`` has (provider, account, label, role); account '' is the provider's default.
    Each lookup matches at most one row, so both joins keep the row count.
    """
    account_key = F.lower(F.trim(text_or_empty(account)))
    exact = profiles.where("account <> ''").select(
        F.col("provider").alias("_p"), F.col("account").alias("_a"),
        F.struct("label", "role").alias("_exact"))
    default = profiles.where("account = ''").select(
        F.col("provider").alias("_dp"), F.struct("label", "role").alias("_default"))
    fallback = F.struct(F.lower(F.col(provider)).alias("label"), F.lit("Unmapped").alias("role"))
    joined = df.withColumn("_key", account_key).join(
        exact, (F.lower(F.col(provider)) == F.col("_p")) & (F.col("_key") == F.col("_a")), "left"
    ).join(default, F.lower(F.col(provider)) == F.col("_dp"), "left")
    chosen = F.coalesce("_exact", "_default", fallback)
    return joined.withColumns(
        {"account_label": chosen["label"], "default_role": chosen["role"]}
    ).drop("_key", "_p", "_a", "_exact", "_dp", "_default")


def deletable(account="email_account", confirmation="confirmation_id",
              application_source="application_source", source="source") -> Column:
    """False for rows that came from an import."""
    return ~(
        (text_or_empty(account) != "") | (text_or_empty(confirmation) != "")
        | (text_or_empty(application_source) == "email_confirmation")
        | text_or_empty(source).isin("email", "yahoo_db")
    )


def _names(schema) -> set[str]:
    from pyspark.sql import types as T

    if isinstance(schema, T.StructType):
        found = {f.name.casefold() for f in schema.fields}
        return found.union(*[_names(f.dataType) for f in schema.fields])
    if isinstance(schema, T.ArrayType):
        return _names(schema.elementType)
    if isinstance(schema, T.MapType):
        return _names(schema.valueType)
    return set()


def forbidden_content(df: DataFrame) -> list[str]:
    """Names in the schema, at any depth, that must not be published."""
    return sorted(_names(df.schema) & set(fixed.CONTENT_COLUMNS))


def drop_content(df: DataFrame) -> DataFrame:
    """The frame itself when its schema publishes no message content; otherwise an error."""
    found = forbidden_content(df)
    if found:
        raise ValueError(f"frame contains message content: {', '.join(found)}")
    return df


def interview_quality(role: str | Column, title: str | Column, start: str | Column) -> Column:
    """struct(role, label): readable role of an interview and its review label."""
    role = F.trim(F.regexp_replace(text_or_empty(role), r"\s+", " "))
    title = F.trim(F.regexp_replace(text_or_empty(title), r"\s+", " "))
    body_like = (F.length(role) > 120) | role.rlike(fixed.BODY_LIKE_PATTERN)
    shown = (
        F.when((role != "") & ~body_like, role)
        .when((title != "") & (F.length(title) <= 120), title)
        .otherwise(F.lit("Needs review"))
    )
    label = (
        F.when(_col(start).isNull(), F.lit("Unscheduled"))
        .when(body_like, F.lit("Scheduled · role needs review"))
        .otherwise(F.lit("Scheduled"))
    )
    return F.struct(shown.alias("role"), label.alias("label"))
