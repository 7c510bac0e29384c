"""Pattern extraction as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import casefold, clean_title, parse_address, signature, squeeze, text_or_empty


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _contains_any(c: Column, needles) -> Column:
    return _any([F.contains(c, F.lit(n)) for n in needles])


def _first_match(c: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that yields text, else ''."""
    return F.coalesce(
        *[F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in patterns], F.lit("")
    )


def infer_ats(c: str | Column) -> Column:
    low = F.lower(_col(c))
    hits = [F.when(F.contains(low, F.lit(d)), F.lit(n)) for d, n in fixed.ATS_DOMAINS.items()]
    return F.coalesce(*hits, F.lit(""))


def urls(c: str | Column) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(fixed.URL_PATTERN), 1)


def job_url(c: str | Column) -> Column:
    found = urls(c)
    on_site = F.filter(found, lambda u: _contains_any(F.lower(u), fixed.ATS_DOMAINS))
    return F.coalesce(F.get(on_site, 0), F.get(found, 0), F.lit(""))


def job_id(c: str | Column) -> Column:
    return _first_match(_col(c), fixed.JOB_VIEW_PATTERN, fixed.JOB_TOKEN_PATTERN)


def requisition_id(c: str | Column) -> Column:
    return _first_match(_col(c), *fixed.REQUISITION_PATTERNS)


def company_and_title(subject: str | Column, body: str | Column, sender: str | Column) -> Column:
    subject, body, sender = (text_or_empty(c) for c in (subject, body, sender))
    combined = F.concat(subject, F.lit(" "), body)
    titles = [
        F.nullif(clean_title(F.regexp_extract(combined, p, 1)), F.lit(""))
        for p in fixed.TITLE_PATTERNS
    ]
    label = F.regexp_extract(F.lower(sender), r"@([a-z0-9-]*)[a-z0-9.-]*", 1)
    from_sender = F.when(
        (label != "") & ~label.isin(*fixed.BOARD_LABELS), F.initcap(F.replace(label, F.lit("-"), F.lit(" ")))
    )
    from_subject = [
        F.nullif(F.btrim(F.regexp_extract(subject, p, 1), F.lit(" .:-")), F.lit(""))
        for p in fixed.SUBJECT_COMPANY_PATTERNS
    ]
    return F.struct(
        F.coalesce(*from_subject, from_sender, F.lit("")).alias("company"),
        F.coalesce(*titles, F.lit("")).alias("title"),
    )


def is_confirmation(subject: str | Column, body: str | Column) -> Column:
    text = F.lower(F.concat_ws(" ", text_or_empty(subject), text_or_empty(body)))
    return text.rlike("|".join(f"(?:{p})" for p in fixed.CONFIRMATION_PATTERNS))


def _first_rule(c: Column, rules) -> Column:
    return F.coalesce(*[F.when(c.rlike(p), F.lit(name)) for name, p in rules])


def role_family_specific(c: str | Column) -> Column:
    """A job family named by a specific phrase, else NULL."""
    return _first_rule(_col(c), fixed.SPECIFIC_ROLE_RULES)


def role_family(c: str | Column) -> Column:
    c = _col(c)
    return F.coalesce(_first_rule(c, fixed.SPECIFIC_ROLE_RULES + fixed.ROLE_RULES), F.lit("Unknown"))


def stage(c: str | Column) -> Column:
    return F.coalesce(_first_rule(_col(c), fixed.STAGE_RULES), F.lit("unknown"))


def valid_company(c: str | Column) -> Column:
    v = F.trim(text_or_empty(c))
    low = casefold(v)
    return (
        (F.length(v) >= 3)
        & (F.size(F.split(v, r"\s+")) <= 6)
        & ~v.rlike(fixed.GENERIC_COMPANY_PATTERN)
        & ~low.isin(*fixed.MEETING_PLATFORMS, *fixed.GENERIC_COMPANY_NAMES)
        & ~v.rlike(r"[^A-Za-z0-9 &'().+-]")
        & v.rlike("[A-Za-z]")
    )


def phone(c: str | Column) -> Column:
    return F.trim(F.regexp_extract(_col(c), fixed.PHONE_PATTERN, 1))


def linkedin_profile(c: str | Column) -> Column:
    return F.regexp_extract(_col(c), fixed.PROFILE_PATTERN, 1)


def contact_title(c: str | Column) -> Column:
    return F.trim(F.regexp_extract(_col(c), fixed.CONTACT_TITLE_PATTERN, 1))


def contact_company(subject: str | Column, body: str | Column, email: str | Column) -> Column:
    email = _col(email)
    text = F.concat(text_or_empty(subject), F.lit("\n"), text_or_empty(body))
    explicit = F.btrim(F.regexp_extract(text, fixed.CONTACT_COMPANY_PATTERN, 1), F.lit(" ,."))
    domain = F.substring_index(email, "@", -1)
    label = F.initcap(F.replace(F.substring_index(domain, ".", 1), F.lit("-"), F.lit(" ")))
    fallback = F.when(domain.isin(*fixed.GENERIC_MAIL_DOMAINS), F.lit("")).otherwise(label)
    return F.coalesce(F.nullif(explicit, F.lit("")), fallback)


def relationship_type(c: str | Column) -> Column:
    low = casefold(text_or_empty(c))
    return (
        F.when(F.contains(low, F.lit("sourcer")), F.lit("sourcer"))
        .when(F.contains(low, F.lit("coordinator")), F.lit("coordinator"))
        .when(_contains_any(low, ("hiring contact", "hiring manager")), F.lit("hiring_contact"))
        .otherwise(F.lit("unknown"))
    )


def meeting_url(c: str | Column) -> Column:
    found = F.regexp_extract_all(_col(c), F.lit("(?i)" + fixed.URL_PATTERN), 1)
    clean = F.transform(found, lambda u: F.rtrim(u, F.lit(".,);]")))
    meeting = F.filter(clean, lambda u: _contains_any(F.lower(u), fixed.MEETING_DOMAINS))
    return F.coalesce(F.get(meeting, 0), F.lit(""))


def interview_type(c: str | Column, classification: str | Column) -> Column:
    low = casefold(_col(c))
    value = F.when(
        _col(classification).startswith("ASSESSMENT_") | F.contains(low, F.lit("assessment")),
        F.lit("assessment"),
    )
    for name, phrases in fixed.INTERVIEW_PHRASES:
        value = value.when(_contains_any(low, phrases), F.lit(name))
    return value.otherwise(F.lit("interview"))


def location_type(url: str | Column, phone_text: str | Column, place: str | Column) -> Column:
    return (
        F.when(_col(url) != "", F.lit("video"))
        .when(_col(place) != "", F.lit("physical"))
        .when(_col(phone_text) != "", F.lit("phone"))
        .otherwise(F.lit("unknown"))
    )


def event_id(c: str | Column) -> Column:
    return _first_match(_col(c), fixed.EVENT_ID_PATTERN)


def location(c: str | Column) -> Column:
    return _first_match(_col(c), fixed.LOCATION_PATTERN)


def interview_job_id(c: str | Column) -> Column:
    return _first_match(_col(c), fixed.INTERVIEW_JOB_PATTERN)


def applicant_count(c: str | Column) -> Column:
    """struct(count, is_over, text) by the first of four patterns; all NULL/false/'' if none."""
    v = squeeze(text_or_empty(c))
    hits = []
    for pattern, over in fixed.APPLICANT_PATTERNS:
        number = F.regexp_extract(v, pattern, 1)
        hits.append(
            F.when(
                number != "",
                F.struct(
                    F.replace(number, F.lit(","), F.lit("")).cast("bigint").alias("count"),
                    F.lit(over).alias("is_over"),
                    F.regexp_extract(v, pattern, 0).alias("text"),
                ),
            )
        )
    none = F.struct(
        F.lit(None).cast("bigint").alias("count"), F.lit(False).alias("is_over"),
        F.lit("").alias("text"),
    )
    return F.coalesce(*hits, none)


def posting_fields(c: str | Column) -> Column:
    v = squeeze(text_or_empty(c))
    mode = F.coalesce(*[F.when(v.rlike(p), F.lit(n)) for n, p in fixed.WORK_MODES], F.lit(""))
    return F.struct(
        F.regexp_extract(v, fixed.SALARY_PATTERN, 1).alias("salary_text"),
        F.regexp_extract(v, fixed.POSTED_PATTERN, 1).alias("posted_text"),
        F.regexp_extract(v, fixed.PLACE_PATTERN, 1).alias("location"),
        mode.alias("work_mode"),
        v.rlike(r"(?i)\bEasy Apply\b").alias("easy_apply"),
        v.rlike(r"(?i)\bPromoted\b").alias("promoted"),
    )


def signals(classification: Column, schedule, zone, url, phone_text, place) -> Column:
    """``classification=...`` plus ``label=value`` for every value that is present."""
    labelled = [
        F.when(_col(v) != "", F.concat(F.lit(f"{label}="), _col(v)))
        for label, v in (
            ("schedule", schedule), ("timezone", zone), ("meeting_url", url),
            ("phone", phone_text), ("location", place),
        )
    ]
    every = F.array(F.concat(F.lit("classification="), _col(classification)), *labelled)
    return F.filter(every, lambda s: s.isNotNull())


def reason_signals(c: str | Column, limit: int = 10) -> Column:
    """Tolerant read of stored reasons: an object's non-empty list, else nothing."""
    raw = _col(c)
    parsed = F.from_json(raw, "matched_signals array<string>, reasons array<string>")
    full = F.when(F.size(parsed["matched_signals"]) > 0, parsed["matched_signals"])
    empty = F.array().cast("array<string>")
    kept = F.coalesce(full, parsed["reasons"], empty)
    return F.when(F.ltrim(raw).startswith("{"), F.slice(kept, 1, limit)).otherwise(empty)


__all__ = [n for n in dir() if not n.startswith("_")] + ["parse_address", "signature"]
