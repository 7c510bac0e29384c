"""Classification, identity and funnel queries."""

from __future__ import annotations

from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.predicates import account_profile
from ..operators import classify as C
from ..operators import funnel as A
from ..operators import identity as I
from .bindings import NOW, Views
from .registry import query
from .scalar_queries import (
    CONTACT_COMPANY_SQL, EVENT_ID_SQL, LOCATION_SQL, MEETING_SQL, RELATIONSHIP_SQL, SCHEDULE_FROM,
    SCHEDULE_SQL, _ADDR, _PH, interview_type_sql,
)

_NOW = datetime.fromisoformat(NOW)
_IN = lambda names: ", ".join(f"'{n}'" for n in names)

# --- classification ---------------------------------------------------------------------------
_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_RULE_ROWS = ", ".join(
    f"({i}, {j}, '{k}', {c}, '{p}')" for i, (k, c, ps) in enumerate(fixed.CLASSIFICATION_RULES)
    for j, p in enumerate(ps))


def classified_sql(view: str, key: str, subject: str, body: str, sender: str) -> str:
    return f"""classified AS (
  WITH rules(rule, pos, kind, conf, phrase) AS (VALUES {_RULE_ROWS}),
  m AS (SELECT {key} AS key, {_NORM.format(subject)} AS f0, {_NORM.format(body)} AS f1, {_NORM.format(sender)} AS f2 FROM {view}),
  h AS (SELECT key, rule, pos, kind, conf, phrase, contains(f0, phrase) AS h0, contains(f1, phrase) AS h1, contains(f2, phrase) AS h2
    FROM m JOIN rules ON contains(f0, phrase) OR contains(f1, phrase) OR contains(f2, phrase)),
  b AS (SELECT *, min(rule) OVER (PARTITION BY key) AS best FROM h),
  r AS (SELECT key, min(kind) AS kind, min(conf) AS conf, string_agg(array_to_string(list_filter([
      CASE WHEN h0 THEN 'subject contains "' || phrase || '"' END, CASE WHEN h1 THEN 'body contains "' || phrase || '"' END,
      CASE WHEN h2 THEN 'sender contains "' || phrase || '"' END], lambda x: x IS NOT NULL), '|'), '|' ORDER BY pos) AS reasons
    FROM b WHERE rule = best GROUP BY key),
  k AS (SELECT key, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, count(DISTINCT kind) AS nk FROM h WHERE kind IN ({_IN(fixed.INTERVIEW_TYPES)}) GROUP BY key)
  SELECT m.key, coalesce(r.kind, 'UNKNOWN') AS classification, coalesce(r.conf, 0.0)::DOUBLE AS confidence,
    coalesce(r.reasons, 'no deterministic rule matched') AS reasons, coalesce(k.kinds, '') AS kinds, coalesce(k.nk, 0) AS nk
  FROM m LEFT JOIN r USING (key) LEFT JOIN k USING (key))"""


_MSG = classified_sql("<<messages>>", "id", "subject", "body", "sender")


@query("classify_messages", "C-01", f"WITH {_MSG} SELECT key AS id, classification, confidence, reasons FROM classified")
def classify_messages(v: Views) -> DataFrame:
    return C.classify(v.messages).select(
        "id", "classification", "confidence", F.array_join("reasons", "|").alias("reasons"))


@query("classify_documents", "C-01", "WITH " + classified_sql("documents", "doc_id", "source", "text", "lang")
       + " SELECT key AS doc_id, classification, confidence, reasons FROM classified")
def classify_documents(v: Views) -> DataFrame:
    return C.classify(v.documents, "source", "text", "lang").select(
        "doc_id", "classification", "confidence", F.array_join("reasons", "|").alias("reasons"))


@query("classification_conflicts", "C-02", f"""WITH {_MSG} SELECT key AS id, classification, kinds AS matched_types,
CASE WHEN nk > 1 THEN 'conflicting' WHEN nk = 1 AND kinds = classification THEN 'supported' ELSE 'skipped' END AS status FROM classified""")
def conflicts(v: Views) -> DataFrame:
    return C.classification_conflicts(v.messages).select(
        "id", "classification", F.array_join("matched_types", "|").alias("matched_types"), "status")


_REC = f"regexp_matches(sender || body, '{fixed.RECRUITING_WORDS_PATTERN}')"


@query("candidate_summary", "C-03", f"""WITH {_MSG}, s AS (SELECT m.*, nk, CASE WHEN nk > 1 THEN 'conflicting' WHEN nk = 1 AND kinds = classification THEN 'supported' ELSE 'skipped' END AS status
  FROM classified c JOIN <<messages>> m ON m.id = c.key)
SELECT count(*) AS messages_scanned, count_if(status = 'supported') AS supported_interview_candidates, count_if(status = 'skipped') AS skipped_messages,
  count_if(status = 'conflicting') AS conflicting_classifications,
  count_if(status = 'supported' AND regexp_extract(subject || chr(10) || body, '\\b(?:job|requisition|req)\\s*(?:id|#)?\\s*[:#-]?\\s*([A-Z0-9_-]{{4,30}})', 1, 'i') = '') AS unresolved_job_links,
  count_if({_REC}) AS recruiter_candidates, 0::BIGINT AS failures FROM s""")
def candidate_summary(v: Views) -> DataFrame:
    from ..functions.extract import interview_job_id

    rows = C.classification_conflicts(v.messages).withColumns({
        "job_identifier": interview_job_id(F.concat_ws("\n", "subject", "body")),
        "recruiter_candidate": F.concat("sender", "body").rlike(fixed.RECRUITING_WORDS_PATTERN)})
    return C.candidate_summary(rows)


_GROUP = "CASE " + " ".join(
    f"WHEN classification IN ({_IN(t)}) THEN '{g}'" for g, t in fixed.OUTCOME_GROUPS.items()) + " END"
METRIC_ROWS = ", ".join(f"('{m}', '{t}')" for m, ts in fixed.OUTCOME_METRICS.items() for t in ts)


@query("outcome_group", "C-04", f"SELECT id, {_GROUP} AS outcome_group FROM <<evidence>>")
def outcome_group(v: Views) -> DataFrame:
    return v.evidence.select("id", C.outcome_group("classification").alias("outcome_group"))


@query("outcome_metrics", "C-05", f"""WITH g(metric, kind) AS (VALUES {METRIC_ROWS})
SELECT g.metric, e.id FROM <<evidence>> e JOIN g ON g.kind = e.classification""")
def outcome_metrics(v: Views) -> DataFrame:
    return C.outcome_metrics(v.evidence).select("metric", "id")


_EXPECT = "CASE WHEN m.id % 10 = 0 THEN 'OFFER' ELSE classification END"


@query("classifier_accuracy", "C-06", f"""WITH {_MSG}, s AS (SELECT {_EXPECT} = classification AND (m.id % 3 <> 0 OR {interview_type_sql('body', 'classification')} = 'technical') AS ok FROM classified c JOIN <<messages>> m ON m.id = c.key)
SELECT count(*) AS cases, count_if(ok) AS correct, round(count_if(ok) / count(*), 4)::DOUBLE AS accuracy FROM s""")
def classifier_accuracy(v: Views) -> DataFrame:
    return C.accuracy(_expected(v))


def _expected(v: Views) -> DataFrame:
    from ..functions.extract import interview_type

    return C.classify(v.messages).withColumns({
        "expected": F.when(F.col("id") % 10 == 0, F.lit("OFFER")).otherwise(F.col("classification")),
        "interview_type": interview_type("body", "classification"),
        "expected_interview_type": F.when(F.col("id") % 3 == 0, F.lit("technical"))})


@query("classifier_confusion", "C-06", f"""WITH {_MSG} SELECT {_EXPECT.replace('m.id', 'key')} AS expected, classification AS predicted, count(*) AS n FROM classified GROUP BY ALL""")
def classifier_confusion(v: Views) -> DataFrame:
    return C.confusion(_expected(v))


_MAIL = f"lower(trim({_ADDR}))"
_NAME = r"trim(regexp_replace(CASE WHEN contains(sender, '<') THEN split_part(sender, '<', 1) ELSE '' END, '\s+', ' ', 'g'))"
_COKEY = r"trim(regexp_replace(regexp_replace(lower(company), '\b(?:incorporated|inc|llc|ltd|limited|corp|corporation|co|company)\b\.?', ' ', 'gi'), '[^a-z0-9&]+', ' ', 'g'))"
_TITLE13 = "trim(regexp_extract(body, '(?im)^\\s*((?:senior |lead |principal )?(?:technical )?(?:recruiter|sourcer|talent partner|talent acquisition|recruiting coordinator))\\s*$', 1))"
CONTACT_SQL = f"""found AS (SELECT id, message_identity, job_id, received_at, name, mail, company, {_COKEY} AS normalized_company, {_TITLE13} AS title,
  array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda l: trim(l)), lambda l: l <> '')[-6:], chr(10)) AS signature,
  trim(regexp_extract(body, '{_PH}', 1)) AS phone, {RELATIONSHIP_SQL} AS relationship_type,
  CASE WHEN name <> '' THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence
  FROM (SELECT m.*, classification, {_MAIL} AS mail, {_NAME} AS name, {CONTACT_COMPANY_SQL} AS company FROM classified c JOIN <<messages>> m ON m.id = c.key) q
  WHERE classification IN ({_IN(fixed.RECRUITER_TYPES + fixed.INTERVIEW_TYPES)}) AND contains(mail, '@')
    AND split_part(mail, '@', 1) NOT IN ({_IN(fixed.GENERIC_LOCAL_PARTS)}) AND {_COKEY} <> ''
    AND (classification NOT IN ({_IN(fixed.INTERVIEW_TYPES)}) OR regexp_matches(name || chr(10) || body, '{fixed.RECRUITING_WORDS_PATTERN}')))"""


@query("recruiter_evidence", "C-07", f"WITH {_MSG}, {CONTACT_SQL} SELECT id, name, mail, company, normalized_company, title, signature, phone, relationship_type, confidence FROM found")
def recruiter_evidence(v: Views) -> DataFrame:
    c = "contact."
    return C.recruiter_evidence(C.classify(v.messages)).select(
        "id", c + "name", F.col(c + "normalized_email").alias("mail"), c + "company",
        c + "normalized_company", c + "title", c + "signature", c + "phone",
        c + "relationship_type", c + "confidence")


_EVT = "CASE classification " + " ".join(f"WHEN '{k}' THEN '{e}'" for k, e in fixed.EVENT_TYPES.items()) + " END"
_INNER = (f"(SELECT id, message_identity, job_id, received_at, provider, classification, subject || chr(10) || body AS body, body AS only_body, subject "
          f"FROM classified c JOIN <<messages>> m ON m.id = c.key WHERE classification IN ({_IN(fixed.INTERVIEW_TYPES)}))")
_PLACE = LOCATION_SQL.replace("body", "only_body")
INTERVIEW_SQL = f"""seen AS (SELECT id, message_identity, job_id, received_at, provider, {_EVT} AS event_type, {interview_type_sql('body', 'classification')} AS interview_type,
  {SCHEDULE_SQL['start_utc']} AS scheduled_start, {SCHEDULE_SQL['end_utc']} AS scheduled_end, {SCHEDULE_SQL['local_start']} AS local_start,
  {SCHEDULE_SQL['local_end']} AS local_end, zone, {MEETING_SQL} AS meeting_url, trim(regexp_extract(body, '{_PH}', 1)) AS phone,
  {_PLACE} AS location_text, {EVENT_ID_SQL.format('body')} AS event_identifier,
  regexp_extract(body, '\\b(?:job|requisition|req)\\s*(?:id|#)?\\s*[:#-]?\\s*([A-Z0-9_-]{{4,30}})', 1, 'i') AS job_identifier,
  trim(subject) AS title, {SCHEDULE_SQL['ambiguity']} AS ambiguity, classification
  FROM {SCHEDULE_FROM.replace('{0}', _INNER + ' i')} z)"""


@query("interview_evidence", "C-08 C-09", f"""WITH {_MSG}, {INTERVIEW_SQL} SELECT id, event_type, interview_type, scheduled_start, scheduled_end, meeting_url, phone, location_text,
CASE WHEN meeting_url <> '' THEN 'video' WHEN location_text <> '' THEN 'physical' WHEN phone <> '' THEN 'phone' ELSE 'unknown' END AS location_type,
event_identifier, job_identifier, title, ambiguity, CASE event_type WHEN 'confirmation' THEN 'confirmed' WHEN 'reschedule' THEN 'rescheduled' WHEN 'cancellation' THEN 'cancelled' ELSE 'scheduled' END AS status FROM seen""")
def interview_evidence(v: Views) -> DataFrame:
    i = "interview."
    return C.interview_evidence(C.classify(v.messages)).select(
        "id", i + "event_type", i + "interview_type",
        F.col(i + "scheduled_start").cast("string").alias("scheduled_start"),
        F.col(i + "scheduled_end").cast("string").alias("scheduled_end"), i + "meeting_url",
        i + "phone", i + "location_text", i + "location_type", i + "event_identifier",
        i + "job_identifier", i + "title",
        F.array_join(i + "ambiguity_reasons", "|").alias("ambiguity"),
        C.interview_status(i + "event_type").alias("status"))


_SIGNALS = "list_filter(['classification=' || classification" + "".join(
    f", CASE WHEN {e} <> '' THEN '{n}=' || {e} END" for n, e in (
        ("schedule", "local_start"), ("timezone", "zone"), ("meeting_url", "meeting_url"),
        ("phone", "phone"), ("location", "location_text"))) + "], lambda x: x IS NOT NULL)"
_QUOTED = """(CASE WHEN len({0}) = 0 THEN '[]' ELSE '["' || array_to_string({0}, '","') || '"]' END)"""
_AMB = "list_filter(string_split(ambiguity, '|') || [CASE WHEN job_id IS NULL THEN 'no deterministic job linkage' END], lambda x: x <> '')"


@query("evidence_json", "C-10", f"""WITH {_MSG}, {INTERVIEW_SQL} SELECT id, '{{"ambiguity_or_missing":' || {_QUOTED.format(_AMB)} || ',"matched_signals":' || {_QUOTED.format(_SIGNALS)}
|| ',"parsed_values":{{"event_identifier":"' || event_identifier || '","interview_type":"' || interview_type || '","job_identifier":"' || job_identifier || '","local_end":"' || local_end
|| '","local_start":"' || local_start || '","timezone":"' || zone || '"}}}}' AS evidence FROM seen""")
def evidence_json(v: Views) -> DataFrame:
    return C.interview_evidence(C.classify(v.messages)).select(
        "id", C.evidence_json(linked=F.col("job_id").isNotNull()).alias("evidence"))


_CAL = """(SELECT event_id AS id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS started_at, CASE WHEN event_id % 11 = 0 THEN 'cancelled' ELSE 'CONFIRMED' END AS status,
 CASE user_id % 7 WHEN 0 THEN 'Phone  Interview with Acme' WHEN 1 THEN 'EDD interview' WHEN 2 THEN 'Talent team sync' WHEN 3 THEN 'Recruiter call' WHEN 4 THEN 'hiring review' ELSE 'Lunch' END AS summary FROM events)"""
_INSIDE = "CAST(started_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'"
CALENDAR_SQL = f"""bucketed AS (SELECT *, CASE WHEN upper(status) = 'CANCELLED' THEN 'cancelled' WHEN regexp_matches(summary, '{fixed.CALENDAR_EXCLUDE}') THEN 'excluded'
  WHEN regexp_matches(summary, '{fixed.CALENDAR_INTERVIEW}') THEN 'interview' WHEN regexp_matches(summary, '{fixed.CALENDAR_REVIEW}') THEN 'ambiguous' ELSE 'other' END AS bucket
  FROM {_CAL} c WHERE {_INSIDE})"""


def calendar_events(v: Views) -> DataFrame:
    return v.sql(_CAL.replace("FROM events", "FROM <<events>>").replace(
        "CAST(date_trunc('hour', ts) AS TIMESTAMP)", "CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)")[1:-1])


@query("calendar_filter", "C-11 I-09", f"""WITH {CALENDAR_SQL} SELECT bucket, CASE WHEN bucket = 'interview' THEN count(DISTINCT (started_at, lower(regexp_replace(summary, '\\s+', ' ', 'g')))) ELSE count(*) END AS events FROM bucketed GROUP BY bucket""")
def calendar_filter(v: Views) -> DataFrame:
    return C.calendar_buckets(calendar_events(v), "2024-01-03", "2024-01-20").groupBy(
        "bucket").agg(F.count("*").alias("events"))


@query("calendar_dedup", "I-09", f"""SELECT DISTINCT CAST(started_at AS VARCHAR) AS started_at, lower(regexp_replace(summary, '\\s+', ' ', 'g')) AS summary FROM {_CAL} c""")
def calendar_dedup(v: Views) -> DataFrame:
    return C.calendar_dedup(calendar_events(v)).select(
        F.col("started_at").cast("string").alias("started_at"),
        F.regexp_replace(T.casefold("summary"), r"\s+", " ").alias("summary"))


# --- identity ---------------------------------------------------------------------------------------
_MID = r"regexp_replace(regexp_replace(lower(message_id), '\s+', '', 'g'), '^<|>$', '', 'g')"
_ISO = r"""replace(CAST({0} AS VARCHAR), ' ', 'T')"""
_US = "(CASE WHEN contains({0}, '.') THEN rpad({0}, 26, '0') ELSE {0} END)"


def identity_sql(provider, mid, subject, sender, at, body) -> str:
    def q(e: str) -> str:
        inner = _NORM.format(e)
        return f"""'"' || replace(replace({inner}, '\\', '\\\\'), '"', '\\"') || '"'"""
    iso = _US.format(_ISO.format(at))
    return (f"""'v1:' || sha256(CASE WHEN {mid} <> '' THEN '{{"kind":"message-id","message_id":"' || {mid} || '","provider":' || {q(provider)} || '}}' """
            f"""ELSE '{{"body":' || {q(body)} || ',"kind":"content","provider":' || {q(provider)} || ',"received_at":"' || {iso} || '","sender":' || {q(sender)} || ',"subject":' || {q(subject)} || '}}' END)""")


_IDENT = identity_sql("provider", _MID, "subject", "sender", "received_at", "body")


@query("message_identity", "I-01", f"SELECT id, {_IDENT} AS message_key FROM <<messages>>")
def message_identity(v: Views) -> DataFrame:
    return v.messages.select("id", I.message_identity(
        "provider", "message_id", "subject", "sender", "received_at", "body").alias("message_key"))


def _json_sql(text: str) -> str:
    """SQL of the JSON string of a normalised text, in ASCII."""
    folded = f"trim(regexp_replace(replace(lower({text}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
    char = """CASE WHEN c = '"' THEN chr(92) || '"' WHEN c = chr(92) THEN chr(92) || chr(92) WHEN unicode(c) > 127 THEN chr(92) || 'u' || printf('%04x', unicode(c)) ELSE c END"""
    return f"""'"' || array_to_string(list_transform(string_split({folded}, ''), lambda c: {char}), '') || '"'"""


@query("document_identity", "I-01", f"""SELECT doc_id, 'v1:' || sha256('{{"body":' || {_json_sql("text")} || ',"kind":"content","provider":' || {_json_sql("source")} || ',"received_at":"","sender":"","subject":' || {_json_sql("lang")} || '}}') AS document_key FROM documents""")
def document_identity(v: Views) -> DataFrame:
    """Identity of texts beyond ASCII."""
    return v.documents.select("doc_id", I.message_identity(
        "source", F.lit(""), "lang", F.lit(""), F.lit(None).cast("timestamp_ntz"), "text").alias("document_key"))


@query("transport_identity", "I-02", """SELECT event_id AS id, 'v1:' || sha256('{"account_namespace":"u' || user_id || '","folder":"inbox","kind":"imap-uid","provider":"yahoo","uid":' || event_id || ',"uidvalidity":"' || (user_id % 3) || '"}') AS transport_key FROM events""")
def transport_identity(v: Views) -> DataFrame:
    return v.events.select(F.col("event_id").alias("id"), I.transport_identity(
        F.lit("Yahoo"), F.concat(F.lit("U"), "user_id"), F.lit(" INBOX "),
        (F.col("user_id") % 3).cast("string"), "event_id").alias("transport_key"))


@query("run_token", "I-03", "SELECT provider, account, sha256(provider || '|' || account || '|' || min(uid) || '|' || max(uid)) AS token FROM <<checkpoints>> GROUP BY provider, account")
def run_token(v: Views) -> DataFrame:
    return v.checkpoints.groupBy("provider", "account").agg(
        F.min("uid").alias("a"), F.max("uid").alias("b")).select(
            "provider", "account", I.run_token("provider", "account", "a", "b").alias("token"))


_NEWKEY = "CASE WHEN message_id <> '' THEN message_id ELSE message_identity END"


def _batch(v: Views):
    rows = v.messages.withColumn("message_key", F.when(
        F.col("message_id") != "", F.col("message_id")).otherwise(F.col("message_identity")))
    return rows, rows.where("event_type = 'click'").select("message_key")


@query("new_only", "I-04", f"""SELECT DISTINCT {_NEWKEY} AS message_key FROM <<messages>>
WHERE {_NEWKEY} NOT IN (SELECT {_NEWKEY} FROM <<messages>> WHERE event_type = 'click')""")
def new_only(v: Views) -> DataFrame:
    batch, existing = _batch(v)
    return I.new_only(batch, existing, "message_key").select("message_key")


@query("new_only_counts", "I-04", f"""WITH k AS (SELECT {_NEWKEY} AS k, event_type FROM <<messages>>), d AS (SELECT DISTINCT k FROM k WHERE k NOT IN (SELECT k FROM k WHERE event_type = 'click'))
SELECT (SELECT count(*) FROM k) AS scanned, (SELECT count(*) FROM d) AS accepted, (SELECT count(*) FROM k) - (SELECT count(*) FROM d) AS skipped""")
def new_only_counts(v: Views) -> DataFrame:
    batch, existing = _batch(v)
    return I.new_only_counts(batch, existing, "message_key")


MEMBERS_SQL = """members AS (SELECT CASE WHEN a.id IS NOT NULL THEN 'application:' || a.id
   WHEN trim(j.confirmation_id) <> '' THEN 'message:' || lower(trim(coalesce(nullif(j.email_account, ''), nullif(j.source, ''), 'unknown'))) || ':' || lower(trim(j.confirmation_id))
   WHEN j.external_id <> '' THEN 'job:' || lower(j.source) || ':' || j.external_id ELSE 'job-row:' || j.id END AS identity,
  j.id AS job_id, coalesce(a.applied_at, j.applied_at) AS applied_at, j.first_seen_at AS imported_at,
  coalesce(nullif(trim(j.role_family), ''), 'Unclassified') AS role_family, coalesce(nullif(trim(j.company), ''), 'Unknown') AS company
  FROM <<jobs>> j LEFT JOIN <<applications>> a ON a.job_id = j.id
  WHERE lower(coalesce(a.status, j.status, '')) NOT IN ('new', 'saved', 'withdrawn'))"""
APPS_SQL = MEMBERS_SQL + """, apps AS (SELECT identity, min(job_id) AS job_id, count(*) AS job_count, min(applied_at) AS applied_at, min(imported_at) AS imported_at,
  arg_min(role_family, job_id) AS role_family, arg_min(company, job_id) AS company FROM members GROUP BY identity)"""
RECORDS_SQL = f"""records AS (SELECT g.metric, e.job_id, e.occurred_at, 'message' AS kind FROM <<evidence>> e JOIN (VALUES {METRIC_ROWS}) g(metric, k) ON g.k = e.classification
  UNION ALL SELECT 'interviews', job_id, occurred_at, 'event' FROM <<interview_events>>
  UNION ALL SELECT 'offers', job_id, offered_at, 'offer' FROM <<offers>>)"""
OUTCOMES_SQL = APPS_SQL + ", " + RECORDS_SQL + """, outcomes AS (SELECT r.metric, m.identity, min(r.occurred_at) AS occurred_at FROM records r JOIN members m ON m.job_id = r.job_id GROUP BY ALL)"""
DATED_SQL = OUTCOMES_SQL + ", dated AS (SELECT 'applications' AS metric, applied_at AS moment FROM apps UNION ALL SELECT metric, occurred_at FROM outcomes)"


def records(v: Views) -> DataFrame:
    return A.outcome_records(v.evidence, v.interview_events, v.offers)


def members(v: Views) -> DataFrame:
    return I.application_members(v.jobs, v.applications)


def facts(v: Views) -> DataFrame:
    return A.application_facts(members(v), records(v))


@query("canonical_applications", "I-05", f"WITH {APPS_SQL} SELECT identity, job_id, job_count, CAST(applied_at AS VARCHAR) AS applied_at, CAST(imported_at AS VARCHAR) AS imported_at, role_family, company FROM apps")
def canonical_applications(v: Views) -> DataFrame:
    a = I.canonical_applications(members(v))
    return a.withColumns({c: F.col(c).cast("string") for c in ("applied_at", "imported_at")})


_DUPF = fixed.DUPLICATE_FIELDS
_SHOWN = {f: f"coalesce(CAST({f} AS VARCHAR), '')" for f in _DUPF}
_DIFFS = ", ".join(f"CASE WHEN count(DISTINCT {_SHOWN[f]}) > 1 THEN '{f}' END" for f in _DUPF if f != "id")


@query("duplicate_groups", "I-06", f"""WITH g AS (SELECT confirmation_id AS message_id, count(*) AS records, list_filter([{_DIFFS}], lambda x: x IS NOT NULL) AS diff FROM <<jobs>> WHERE confirmation_id <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY j.id) AS position, records, {', '.join(f"{_SHOWN[f]} AS {f}" for f in _DUPF)}, array_to_string(diff, ', ') AS fields_that_differ,
CASE WHEN len(list_filter(diff, lambda x: x NOT IN ('source', 'import_confidence'))) = 0 THEN '{fixed.DUPLICATE_EXACT}'
 WHEN len(list_filter(diff, lambda x: x IN ({_IN(fixed.DUPLICATE_MATERIAL)}))) = 0 THEN '{fixed.DUPLICATE_PROBABLE}' ELSE '{fixed.DUPLICATE_CONFLICT}' END AS recommended_category FROM g JOIN <<jobs>> j ON j.confirmation_id = g.message_id""")
def duplicate_groups(v: Views) -> DataFrame:
    return I.duplicate_groups(v.jobs)


MAIL_SQL = """mail AS (SELECT e.*, CAST(e.occurred_at AS VARCHAR) AS at_text, coalesce(x.label, d.label, e.provider) AS account_label, coalesce(x.role, d.role, 'Unmapped') AS default_role FROM <<evidence>> e
LEFT JOIN <<profiles>> x ON x.account <> '' AND x.provider = e.provider AND x.account = lower(trim(e.account))
LEFT JOIN <<profiles>> d ON d.account = '' AND d.provider = e.provider)"""
CONFIRM_SQL = MAIL_SQL + """, archive AS (SELECT e.message_identity, e.provider, 'gmail' AS account_label, e.classification, e.job_id, CAST(j.applied_at AS VARCHAR) AS at_text, coalesce(nullif(trim(j.role_family), ''), 'Unmapped') AS role_family FROM <<evidence>> e LEFT JOIN <<jobs>> j ON j.id = e.job_id WHERE e.provider = 'hotmail'),
crows AS (SELECT CASE WHEN job_id IS NOT NULL THEN 'job:' || job_id ELSE 'message:' || message_identity END AS identity, 0 AS src, at_text, provider, message_identity, account_label, '' AS role_family FROM mail WHERE classification = 'APPLICATION_CONFIRMATION' AND at_text IS NOT NULL AND provider <> 'hotmail'
 UNION ALL SELECT 'job:' || job_id, 1, at_text, provider, message_identity, account_label, role_family FROM archive WHERE job_id IS NOT NULL AND classification = 'APPLICATION_CONFIRMATION' AND at_text IS NOT NULL),
confirmations AS (SELECT identity, substr(at_text, 1, 7) AS period, substr(at_text, 1, 10) AS date, account_label AS account,
  coalesce((SELECT arg_max(c2.role_family, c2.message_identity) FROM crows c2 WHERE c2.src = 1 AND c2.identity = q.identity), '') AS role_family
  FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY src, at_text, provider, message_identity) AS rn FROM crows) q WHERE rn = 1)"""


def mail_rows(v: Views) -> DataFrame:
    rows = v.evidence.withColumn("occurred_at", F.col("occurred_at").cast("string"))
    return account_profile(rows, v.profiles)


def confirmations(v: Views) -> DataFrame:
    mail = mail_rows(v)
    jobs = v.jobs.select(F.col("id").alias("job_id"), F.col("applied_at").cast("string").alias("occurred_at"),
                         F.coalesce(F.nullif(F.trim("role_family"), F.lit("")), F.lit("Unmapped")).alias("role_family"))
    archive = v.evidence.where("provider = 'hotmail'").drop("occurred_at").join(
        jobs, "job_id", "left").withColumn("account_label", F.lit("gmail"))
    return I.first_confirmation(mail.where("provider <> 'hotmail'"), archive)


@query("first_confirmation", "I-07 W-09", f"WITH {CONFIRM_SQL} SELECT * FROM confirmations")
def first_confirmation(v: Views) -> DataFrame:
    return confirmations(v)


FIRST_OUTCOME_SQL = f"""first_outcomes AS (SELECT job_id, {_GROUP} AS outcome_group, substr(arg_min(CAST(occurred_at AS VARCHAR), CAST(occurred_at AS VARCHAR)), 1, 7) AS period
  FROM <<evidence>> WHERE job_id IS NOT NULL AND occurred_at IS NOT NULL AND {_GROUP} IS NOT NULL GROUP BY 1, 2)"""


@query("first_outcome", "I-08 W-09", f"WITH {FIRST_OUTCOME_SQL} SELECT * FROM first_outcomes")
def first_outcome(v: Views) -> DataFrame:
    return I.first_outcome(v.evidence.withColumn("occurred_at", F.col("occurred_at").cast("string")))


_SI = """(SELECT id, provider, CASE WHEN id % 3 = 0 THEN '' ELSE message_id END AS message_id, CASE WHEN id % 2 = 0 THEN subject ELSE '' END AS subject, '' AS sender, '' AS body, received_at,
 'Job ' || CAST(user_id AS STRING) AS title, 'Co ' || CAST(user_id % 9 AS STRING) AS company, '' AS job_url, CAST(id AS STRING) AS job_id, '' AS requisition_id, 'Lever' AS ats_platform FROM <<messages>>)"""


@query("structured_identity", "I-10", "SELECT id, " + identity_sql(
    "provider", _MID, "CASE WHEN subject <> '' THEN subject ELSE title END", "company", "received_at",
    "CASE WHEN subject <> '' THEN 'Application received through Yahoo structured import' ELSE job_url || '|' || job_id || '|' || requisition_id || '|' || ats_platform END")
       + f" AS message_key FROM {_SI} s")
def structured_identity(v: Views) -> DataFrame:
    return I.structured_identity(v.sql(_SI[1:-1])).select(
        "id", F.col("message_identity").alias("message_key"))


# --- funnel ------------------------------------------------------------------------------------------
@query("evidence_quality", "A-01", f"""WITH {RECORDS_SQL} SELECT metric, count_if(kind = 'message') AS evidence_records, count_if(kind = 'message' AND job_id IS NOT NULL) AS linked_records,
count_if(kind = 'message' AND job_id IS NULL) AS unlinked_records, count_if(kind = 'event') AS event_records, count_if(kind = 'event' AND job_id IS NULL) AS unlinked_event_records FROM records GROUP BY metric""")
def evidence_quality(v: Views) -> DataFrame:
    return A.evidence_quality(records(v))


@query("dedupe_outcomes", "A-02", f"WITH {OUTCOMES_SQL} SELECT metric, identity, CAST(occurred_at AS VARCHAR) AS occurred_at FROM outcomes")
def dedupe_outcomes(v: Views) -> DataFrame:
    return A.dedupe_outcomes(facts(v)).withColumn("occurred_at", F.col("occurred_at").cast("string"))


@cache
def _counts(start: str, end: str, prefix: str = "") -> str:
    inside = f"moment >= TIMESTAMP '{start}' AND moment < TIMESTAMP '{end}'"
    return ", ".join(f"count_if(metric = '{m}' AND {inside}) AS {prefix}{m}" for m in fixed.METRICS)


@query("period_counts", "A-03", f"WITH {DATED_SQL} SELECT {_counts('1998-03-01', '1999-06-15 12:00:00')} FROM dated")
def period_counts(v: Views) -> DataFrame:
    return A.period_counts(facts(v), datetime(1998, 3, 1), datetime(1999, 6, 15, 12))


@query("rates", "A-04 A-05 A-06 A-07", """WITH t AS (SELECT doc_id % 40 AS k, sum(quality)::BIGINT AS n, sum(toxic)::BIGINT AS d FROM labels GROUP BY 1)
SELECT k, CASE WHEN d = 0 THEN 0.0 ELSE round(n / d * 100, 1) END::DOUBLE AS rate, CASE WHEN d > 0 THEN round(n / d * 100, 1) END::DOUBLE AS rate_or_null,
CASE WHEN d = 0 AND n = 0 THEN 0.0 WHEN d <> 0 THEN round((n - d) / d * 100, 1) END::DOUBLE AS change, CASE WHEN d <> 0 THEN round((n - d) / d * 100, 1) END::DOUBLE AS change_or_null FROM t""")
def rates(v: Views) -> DataFrame:
    t = v.labels.groupBy((F.col("doc_id") % 40).alias("k")).agg(
        F.sum("quality").alias("n"), F.sum("toxic").alias("d"))
    return t.select("k", A.rate("n", "d").alias("rate"), A.rate_or_null("n", "d").alias("rate_or_null"),
                    A.change("n", "d").alias("change"), A.change_or_null("n", "d").alias("change_or_null"))


def _r(n: str, d: str, digits: int = 1) -> str:
    return f"(CASE WHEN {d} = 0 THEN 0.0 ELSE round({n} / {d} * 100, {digits}) END)::DOUBLE"


@query("overview_totals", "A-08", f"""WITH {OUTCOMES_SQL}, t AS (SELECT (SELECT count(*) FROM apps) AS applications, (SELECT sum(job_count) FROM apps)::BIGINT AS raw, (SELECT count(applied_at) FROM apps) AS dated,
{', '.join(f"(SELECT count(*) FROM outcomes WHERE metric = '{m}') AS {m}" for m in fixed.METRICS[1:])})
SELECT applications, recruiter_replies, interviews, offers, rejections, {_r('recruiter_replies', 'applications')} AS reply_rate, {_r('interviews', 'applications')} AS interview_rate,
{_r('offers', 'applications', 2)} AS offer_rate, raw AS raw_application_stage_rows, raw - applications AS collapsed_duplicate_or_overlapping_rows, dated AS dated_applications, applications - dated AS undated_applications FROM t""")
def overview_totals(v: Views) -> DataFrame:
    return A.overview_totals(facts(v))


_WIN = [(w, str(s), str(e)) for w, s, e in A.overview_windows(_NOW)]


@query("overview_periods", "A-08", f"WITH {DATED_SQL} " + " UNION ALL ".join(
    f"SELECT '{w}' AS \"window\", '{s}' AS window_start, '{e}' AS window_end, {_counts(s, e)} FROM dated" for w, s, e in _WIN))
def overview_periods(v: Views) -> DataFrame:
    return A.overview_periods(facts(v), _NOW)


def _one(metric: str, s: str, e: str) -> str:
    return f"(SELECT count(*) FROM dated WHERE metric = '{metric}' AND moment >= TIMESTAMP '{s}' AND moment < TIMESTAMP '{e}')"


@query("overview_change", "A-08", f"WITH {DATED_SQL}, t AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {_one(m, *_WIN[0][1:])} AS current, {_one(m, *_WIN[3][1:])} AS previous_90_days" for m in fixed.METRICS)
    + """), u AS (SELECT *, round(previous_90_days / 3, 1) AS monthly_average FROM t)
SELECT metric, current, previous_90_days, monthly_average, CASE WHEN monthly_average = 0 AND current = 0 THEN 0.0 WHEN monthly_average <> 0 THEN round((current - monthly_average) / monthly_average * 100, 1) END::DOUBLE AS change_percent FROM u""")
def overview_change(v: Views) -> DataFrame:
    return A.overview_change(facts(v), _NOW)


_FUN = """, lab AS (SELECT *, {label} AS label, {key} AS k FROM apps), seen AS (SELECT m.identity, max(r.occurred_at) AS seen FROM records r JOIN members m ON m.job_id = r.job_id GROUP BY 1),
names AS (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, label) AS rn FROM lab GROUP BY k, label),
g AS (SELECT l.k, count(*) AS applications, count(l.applied_at) AS dated_applications, {sums}, max(greatest(l.applied_at, s.seen)) AS last_activity
  FROM lab l LEFT JOIN (SELECT identity, {flags} FROM outcomes GROUP BY identity) o ON o.identity = l.identity LEFT JOIN seen s ON s.identity = l.identity GROUP BY l.k)
SELECT n.label AS {attr}, applications, dated_applications, recruiter_replies, interviews, offers, rejections, {rr} AS reply_rate, {ir} AS interview_rate, {orr} AS offer_rate,
 CAST(last_activity AS VARCHAR) AS last_activity FROM g JOIN names n ON n.k = g.k AND n.rn = 1 ORDER BY applications DESC, lower(n.label), n.label {limit}"""


def _funnel_sql(attr: str, label: str, key: str, limit: str = "") -> str:
    return f"WITH {OUTCOMES_SQL}" + _FUN.format(
        attr=attr, label=label, key=key, limit=limit,
        sums=", ".join(f"coalesce(sum(o.{m}), 0)::BIGINT AS {m}" for m in fixed.METRICS[1:]),
        flags=", ".join(f"max((metric = '{m}')::INT) AS {m}" for m in fixed.METRICS[1:]),
        rr=_r("recruiter_replies", "applications"), ir=_r("interviews", "applications"),
        orr=_r("offers", "applications", 2))


def _funnel(v: Views, attribute: str, limit: int | None = None) -> DataFrame:
    out = A.grouped_funnel(facts(v), attribute, limit)
    return out.withColumn("last_activity", F.col("last_activity").cast("string"))


@query("funnel_by_role", "A-09", _funnel_sql("role_family", "role_family", "role_family"))
def funnel_by_role(v: Views) -> DataFrame:
    return _funnel(v, "role_family")


@query("funnel_by_company", "A-09", _funnel_sql("company", "company", "lower(company)"))
def funnel_by_company(v: Views) -> DataFrame:
    return _funnel(v, "company")


@query("top_companies", "A-09 O-04", _funnel_sql("company", "company", "lower(company)", "LIMIT 50"))
def top_companies(v: Views) -> DataFrame:
    return _funnel(v, "company", 50)


# --- months ---------------------------------------------------------------------------------------------
_MONTHLY = ", ".join([f"count_if(metric = '{m}' AND moment >= s AND moment < e) AS {m}" for m in fixed.METRICS]
                     + [f"count_if(metric = '{m}' AND moment >= ps AND moment < pe) AS previous_{m}" for m in fixed.METRICS])


@query("monthly_activity", "W-01 D-05", f"""WITH {DATED_SQL}, spine AS (SELECT s, CASE WHEN s = TIMESTAMP '2001-08-01' THEN TIMESTAMP '{NOW}' ELSE s + INTERVAL 1 MONTH END AS e, s - INTERVAL 1 MONTH AS ps,
  CASE WHEN s = TIMESTAMP '2001-08-01' THEN least(s - INTERVAL 1 MONTH + (TIMESTAMP '{NOW}' - s), s) ELSE s END AS pe FROM (SELECT TIMESTAMP '2001-08-01' - INTERVAL 1 MONTH * i AS s FROM range(26) r(i)) q),
t AS (SELECT s, {_MONTHLY} FROM spine, dated GROUP BY s)
SELECT strftime(s, '%Y-%m') AS period, {', '.join(fixed.METRICS)}, {', '.join('previous_' + m for m in fixed.METRICS)},
{', '.join(f"CASE WHEN previous_{m} = 0 AND {m} = 0 THEN 0.0 WHEN previous_{m} <> 0 THEN round(({m} - previous_{m}) / previous_{m} * 100, 1) END::DOUBLE AS change_{m}" for m in fixed.METRICS)},
s = TIMESTAMP '2001-08-01' AS is_month_to_date, CASE WHEN s = TIMESTAMP '2001-08-01' THEN 'previous_month_same_elapsed_days' ELSE 'previous_full_month' END AS comparison_basis FROM t""")
def monthly_activity(v: Views) -> DataFrame:
    return A.monthly_activity(facts(v), _NOW)


_ALLM = (*fixed.METRICS, "records_imported")


@query("timeline", "W-02", f"""WITH {DATED_SQL}, allrows AS (SELECT * FROM dated UNION ALL SELECT 'records_imported', imported_at FROM apps WHERE applied_at IS NULL),
c AS (SELECT strftime(moment, '%Y-%m') AS period, {', '.join(f"count_if(metric = '{m}') AS {m}" for m in _ALLM)} FROM allrows WHERE moment IS NOT NULL GROUP BY 1),
spine AS (SELECT strftime(m, '%Y-%m') AS period FROM (SELECT unnest(generate_series((SELECT CAST(min(period) || '-01' AS TIMESTAMP) FROM c), TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS m) q)
SELECT coalesce(c.period, s.period) AS period, {', '.join(f'coalesce({m}, 0) AS {m}' for m in _ALLM)} FROM spine s FULL JOIN c ON c.period = s.period""")
def timeline(v: Views) -> DataFrame:
    return A.timeline(facts(v), _NOW)
