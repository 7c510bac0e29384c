"""Message classification by ordered rules and the evidence built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import extract as X
from ..functions.dates import with_schedule
from ..functions.once import computed_once
from ..functions.text import (
    casefold, normalize_company_contact, normalize_text, parse_address, signature, squeeze,
    text_or_empty,
)

_FIELDS = ("subject", "body", "sender")
_SEPARATOR = "\x00"


def rule_table() -> Column:
    """All phrases in rule order as one literal array of (rule, type, confidence, phrase)."""
    rows = [
        f"named_struct('rule', {i}, 'type', '{kind}', 'confidence', {confidence}D, "
        f"'phrase', '{phrase}')"
        for i, (kind, confidence, phrases) in enumerate(fixed.CLASSIFICATION_RULES)
        for phrase in phrases
    ]
    return F.expr(f"array({', '.join(rows)})")


def with_rule_hits(df: DataFrame, subject="subject", body="body", sender="sender") -> DataFrame:
    """Adds ``_text`` (the three fields, normalised in one go) and ``_hits`` (phrases found).

    The rules are a literal array walked by one higher-order function: 52 phrases times three
    fields as a CASE would outgrow what the JIT compiles.
    """
    parts = [F.translate(text_or_empty(c), _SEPARATOR, "\x01") for c in (subject, body, sender)]
    staged = computed_once(df, _said=F.concat_ws(_SEPARATOR, *parts))
    staged = computed_once(staged, _text=normalize_text("_said")).drop("_said")
    return computed_once(
        staged, _hits=F.filter(rule_table(), lambda r: F.contains(F.col("_text"), r["phrase"])))


def classify(df: DataFrame, subject="subject", body="body", sender="sender") -> DataFrame:
    """Adds classification, confidence, reasons and classifier_version; the first rule wins."""
    first = F.get("_hits", F.lit(0))
    winners = F.filter("_hits", lambda r: r["rule"] == first["rule"])
    fields = F.split("_text", _SEPARATOR)

    def why(r: Column) -> Column:
        said = [
            F.when(
                F.contains(F.get(fields, F.lit(i)), r["phrase"]),
                F.concat(F.lit(f'{name} contains "'), r["phrase"], F.lit('"')),
            )
            for i, name in enumerate(_FIELDS)
        ]
        return F.filter(F.array(*said), lambda s: s.isNotNull())

    return with_rule_hits(df, subject, body, sender).withColumns({
        "classification": F.coalesce(first["type"], F.lit(fixed.UNKNOWN_TYPE)),
        "confidence": F.coalesce(first["confidence"], F.lit(0.0)),
        "reasons": F.when(F.size("_hits") > 0, F.flatten(F.transform(winners, why))).otherwise(
            F.array(F.lit(fixed.NO_RULE_REASON))),
        "classifier_version": F.lit(fixed.CLASSIFIER_VERSION),
    }).drop("_text", "_hits")


def classification_conflicts(df: DataFrame, subject="subject", body="body", sender="sender"):
    """Adds classification, matched_types and status (supported, skipped or conflicting)."""
    kinds = F.transform("_hits", lambda r: r["type"])
    interview = F.array_intersect(kinds, F.array(*[F.lit(t) for t in fixed.INTERVIEW_TYPES]))
    staged = with_rule_hits(df, subject, body, sender).withColumns({
        "classification": F.coalesce(F.get(kinds, F.lit(0)), F.lit(fixed.UNKNOWN_TYPE)),
        "matched_types": F.array_sort(interview),
    })
    status = (
        F.when(F.size("matched_types") > 1, F.lit("conflicting"))
        .when(F.get("matched_types", F.lit(0)) == F.col("classification"), F.lit("supported"))
        .otherwise(F.lit("skipped"))
    )
    return staged.withColumn("status", status).drop("_text", "_hits")


def candidate_summary(df: DataFrame) -> DataFrame:
    """One row of counts over candidates with (status, job_identifier, recruiter_candidate)."""
    def is_status(s: str) -> Column:
        return F.count_if(F.col("status") == s)

    return df.agg(
        F.count("*").alias("messages_scanned"),
        is_status("supported").alias("supported_interview_candidates"),
        is_status("skipped").alias("skipped_messages"),
        is_status("conflicting").alias("conflicting_classifications"),
        F.count_if((F.col("status") == "supported") & (text_or_empty("job_identifier") == ""))
        .alias("unresolved_job_links"),
        F.count_if("recruiter_candidate").alias("recruiter_candidates"),
        is_status("failure").alias("failures"),
    )


def outcome_group(c: str | Column) -> Column:
    """The single outcome group of a message type, NULL for the other types."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.when(c.isin(*t), F.lit(g)) for g, t in fixed.OUTCOME_GROUPS.items()])


def outcome_metrics(df: DataFrame, classification: str = "classification") -> DataFrame:
    """One row per metric that a message feeds (a type may feed several)."""
    c = F.col(classification)
    fed = F.array(*[F.when(c.isin(*t), F.lit(m)) for m, t in fixed.OUTCOME_METRICS.items()])
    return df.withColumn("metric", F.explode(F.filter(fed, lambda m: m.isNotNull())))


def accuracy(df: DataFrame) -> DataFrame:
    """Share of rows whose type (and interview type, where one is expected) is right."""
    right = (F.col("classification") == F.col("expected")) & (
        F.col("expected_interview_type").isNull()
        | (F.col("interview_type") == F.col("expected_interview_type"))
    )
    return df.agg(
        F.count("*").alias("cases"), F.count_if(right).alias("correct"),
        F.round(F.count_if(right) / F.count("*"), 4).alias("accuracy"),
    )


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("expected", F.col("classification").alias("predicted")).agg(
        F.count("*").alias("n"))


def recruiter_evidence(
    df: DataFrame, subject="subject", body="body", sender="sender", classification="classification",
) -> DataFrame:
    """Rows that name a contact, with the ``contact`` struct added; the rest is dropped."""
    staged = df.where(F.col(classification).isin(*fixed.RECRUITER_TYPES, *fixed.INTERVIEW_TYPES))
    staged = staged.withColumn("_parsed", parse_address(sender))
    staged = staged.withColumns({
        "_name": squeeze(F.col("_parsed.name")),
        "_mail": casefold(F.trim(F.col("_parsed.address"))),
    })
    local = F.regexp_replace(F.col("_mail"), "@[^@]*$", "")
    staged = staged.where(
        F.contains(F.col("_mail"), F.lit("@")) & ~local.isin(*fixed.GENERIC_LOCAL_PARTS)
    )
    staged = computed_once(staged, _company=X.contact_company(subject, body, F.col("_mail")))
    staged = computed_once(staged, _key=normalize_company_contact("_company"))
    said = F.concat_ws("\n", F.col("_name"), text_or_empty(body))
    staged = staged.where(
        (F.col("_key") != "")
        & (~F.col(classification).isin(*fixed.INTERVIEW_TYPES)
           | said.rlike(fixed.RECRUITING_WORDS_PATTERN))
    )
    body_text = text_or_empty(body)
    contact = F.struct(
        F.col("_name").alias("name"), F.trim(F.col("_parsed.address")).alias("email"),
        F.col("_mail").alias("normalized_email"), F.col("_company").alias("company"),
        F.col("_key").alias("normalized_company"), X.contact_title(body_text).alias("title"),
        signature(body_text).alias("signature"),
        X.linkedin_profile(body_text).alias("linkedin_url"), X.phone(body_text).alias("phone"),
        F.when(F.col("_name") != "", 0.95).otherwise(0.9).alias("confidence"),
        X.relationship_type(body_text).alias("relationship_type"),
    )
    return staged.withColumn("contact", contact).drop("_parsed", "_name", "_mail", "_company", "_key")


def interview_status(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(
        *[F.when(c == e, F.lit(s)) for e, s in fixed.EVENT_STATUS.items()], F.lit("scheduled"))


def interview_evidence(
    df: DataFrame, subject="subject", body="body", classification="classification",
) -> DataFrame:
    """Rows of the six interview types with the ``interview`` struct added."""
    kept = df.where(F.col(classification).isin(*fixed.INTERVIEW_TYPES))
    kept = kept.withColumn(
        "_t", F.concat(text_or_empty(subject), F.lit("\n"), text_or_empty(body)))
    kept = with_schedule(kept, "_t", "_plan").withColumns({
        "_url": X.meeting_url("_t"), "_phone": X.phone("_t"),
        "_place": X.location(text_or_empty(body)),
    })
    event = F.coalesce(
        *[F.when(F.col(classification) == k, F.lit(v)) for k, v in fixed.EVENT_TYPES.items()])
    interview = F.struct(
        event.alias("event_type"), X.interview_type("_t", classification).alias("interview_type"),
        F.col("_plan.start_utc").alias("scheduled_start"), F.col("_plan.end_utc").alias("scheduled_end"),
        F.col("_plan.local_start").alias("local_start"), F.col("_plan.local_end").alias("local_end"),
        F.col("_plan.zone").alias("timezone"), F.col("_url").alias("meeting_url"),
        F.col("_phone").alias("phone"),
        X.location_type("_url", "_phone", "_place").alias("location_type"),
        F.col("_place").alias("location_text"), X.event_id("_t").alias("event_identifier"),
        X.interview_job_id("_t").alias("job_identifier"),
        F.substring(F.trim(text_or_empty(subject)), 1, 500).alias("title"),
        X.signals(F.col(classification), F.col("_plan.local_start"), F.col("_plan.zone"),
                  "_url", "_phone", "_place").alias("matched_signals"),
        F.col("_plan.ambiguity").alias("ambiguity_reasons"),
        F.lit(fixed.EXTRACTOR_VERSION).alias("extractor_version"),
    )
    return kept.withColumn("interview", interview).drop("_t", "_plan", "_url", "_phone", "_place")


def evidence_json(interview: str = "interview", linked: Column | bool = True) -> Column:
    """Compact JSON of signals, parsed values and ambiguity; keys in order."""
    i = F.col(interview)
    linked = linked if isinstance(linked, Column) else F.lit(linked)
    missing = F.when(linked, i["ambiguity_reasons"]).otherwise(
        F.array_append(i["ambiguity_reasons"], F.lit(fixed.AMBIGUITY_UNLINKED)))
    parsed = ("event_identifier", "interview_type", "job_identifier", "local_end", "local_start",
              "timezone")
    return F.to_json(F.struct(
        missing.alias("ambiguity_or_missing"), i["matched_signals"].alias("matched_signals"),
        F.struct(*[i[p].alias(p) for p in parsed]).alias("parsed_values"),
    ))


def calendar_buckets(
    events: DataFrame, start_date: str, through_date: str, text: str = "summary",
) -> DataFrame:
    """Events of a closed local-date range with ``bucket``: cancelled, excluded, interview,
    ambiguous or other.  Repeats of one interview (same start and summary) collapse into one."""
    inside = events.where(
        F.col("started_at").cast("date").between(
            F.lit(start_date).cast("date"), F.lit(through_date).cast("date"))
    )
    said = F.col(text)
    bucketed = inside.withColumn(
        "bucket",
        F.when(F.upper(text_or_empty("status")) == "CANCELLED", F.lit("cancelled"))
        .when(said.rlike(fixed.CALENDAR_EXCLUDE), F.lit("excluded"))
        .when(said.rlike(fixed.CALENDAR_INTERVIEW), F.lit("interview"))
        .when(said.rlike(fixed.CALENDAR_REVIEW), F.lit("ambiguous"))
        .otherwise(F.lit("other")),
    )
    repeated = F.col("bucket") == "interview"
    return bucketed.where(~repeated).unionByName(calendar_dedup(bucketed.where(repeated)))


def calendar_dedup(events: DataFrame) -> DataFrame:
    """One event per (start, folded summary)."""
    key = F.regexp_replace(casefold("summary"), r"\s+", " ")
    return events.withColumn("_key", key).dropDuplicates(["started_at", "_key"]).drop("_key")
