"""Merge, interview and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.predicates import resume_score
from ..functions.text import normalize_alias
from ..operators import classify as C
from ..operators import interviews as N
from ..operators import merge as U
from ..operators import quality as Q
from .bindings import Views
from .funnel_queries import _MSG, CONTACT_SQL, INTERVIEW_SQL
from .registry import query

# --- merges -----------------------------------------------------------------------------------
_CUR = "(SELECT * FROM <<jobs>> WHERE id % 3 <> 0 AND external_id <> '')"
_INC = """(SELECT external_id, title || CASE WHEN k = 1 THEN ' (new)' ELSE '' END AS title, company, applicant_count, last_seen_at + k * INTERVAL '40' DAY AS seen_at
FROM <<jobs>> JOIN (SELECT 0 AS k UNION ALL SELECT 1) t ON k <= id % 2 WHERE id % 5 <> 0 AND external_id <> '')"""


@query("upsert_jobs", "U-01", f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY seen_at DESC) AS rn FROM {_INC} q)
SELECT coalesce(c.external_id, b.external_id) AS external_id, CASE WHEN b.seen_at IS NOT NULL THEN b.title ELSE c.title END AS title, CASE WHEN b.seen_at IS NOT NULL THEN b.applicant_count ELSE c.applicant_count END AS applicant_count,
CASE WHEN b.seen_at IS NOT NULL THEN CASE WHEN b.applicant_count < 25 THEN 85.0 ELSE 50.0 END ELSE c.score END::DOUBLE AS score, CAST(coalesce(c.first_seen_at, b.seen_at) AS VARCHAR) AS first_seen_at, CAST(coalesce(b.seen_at, c.last_seen_at) AS VARCHAR) AS last_seen_at
FROM {_CUR} c FULL JOIN (SELECT * FROM b WHERE rn = 1) b ON b.external_id = c.external_id""")
def upsert_jobs(v: Views) -> DataFrame:
    score = F.when(F.col("applicant_count") < 25, 85.0).otherwise(50.0)
    out = U.upsert_jobs(v.sql(_CUR[1:-1]), v.sql(_INC[1:-1]), ["title", "company", "applicant_count"], score)
    return out.drop("company").withColumns({c: F.col(c).cast("string") for c in ("first_seen_at", "last_seen_at")})


_KEYED = "keyed AS (SELECT *, normalized_company || '|' || CASE WHEN name <> '' THEN name ELSE mail END AS contact_key FROM found)"


def _contact_evidence(v: Views) -> DataFrame:
    rows = C.recruiter_evidence(C.classify(v.messages))
    return rows.select("message_identity", F.col("received_at").alias("observed_at"), "job_id", "contact.*").withColumn(
        "contact_key", U.contact_key())


_CC = "(SELECT 'cobalt|Ada Quill' AS contact_key, name, '' AS title, '' AS signature, '' AS linkedin_url, phone, CAST('2024-01-10 00:00:00' AS {0}) AS first_seen_at, CAST('2024-01-11 00:00:00' AS {0}) AS last_seen_at FROM <<contacts>> WHERE id = 5)"


@query("upsert_contacts", "U-02 R-09", f"""WITH {_MSG}, {CONTACT_SQL}, {_KEYED}, g AS (SELECT contact_key, (array_agg(title ORDER BY received_at, message_identity) FILTER (WHERE title <> ''))[1] AS title, (array_agg(phone ORDER BY received_at, message_identity) FILTER (WHERE phone <> ''))[1] AS phone,
  (array_agg(name ORDER BY received_at, message_identity) FILTER (WHERE name <> ''))[1] AS name, min(received_at) AS lo, max(received_at) AS hi FROM keyed GROUP BY 1)
SELECT coalesce(c.contact_key, g.contact_key) AS contact_key, coalesce(nullif(c.name, ''), g.name, '') AS name, coalesce(nullif(c.title, ''), g.title, '') AS title, coalesce(nullif(c.phone, ''), g.phone, '') AS phone,
 CAST(coalesce(c.first_seen_at, g.lo) AS VARCHAR) AS first_seen_at, CAST(greatest(c.last_seen_at, g.hi) AS VARCHAR) AS last_seen_at FROM {_CC.format('TIMESTAMP')} c FULL JOIN g ON g.contact_key = c.contact_key""")
def upsert_contacts(v: Views) -> DataFrame:
    out = U.upsert_contacts(v.sql(_CC.format("TIMESTAMP_NTZ")[1:-1]), _contact_evidence(v))
    return out.select("contact_key", "name", "title", "phone", F.col("first_seen_at").cast("string").alias("first_seen_at"),
                      F.col("last_seen_at").cast("string").alias("last_seen_at"))


_CL = "(SELECT recruiter_id, job_id, relationship_type, message_identity, first_seen_at, last_seen_at FROM <<contact_jobs>> WHERE job_id % 2 = 0)"
_CE = "(SELECT recruiter_id, job_id, relationship_type, message_identity || '+' AS message_identity, last_seen_at - INTERVAL '3' DAY AS observed_at FROM <<contact_jobs>> WHERE job_id % 3 = 0)"


@query("touch_contact_links", "U-02 R-09", f"""SELECT coalesce(c.recruiter_id, e.recruiter_id) AS recruiter_id, coalesce(c.job_id, e.job_id) AS job_id, coalesce(c.relationship_type, e.relationship_type) AS relationship_type,
coalesce(c.message_identity, e.message_identity) AS message_identity, CAST(coalesce(c.first_seen_at, e.observed_at) AS VARCHAR) AS first_seen_at, CAST(greatest(c.last_seen_at, e.observed_at) AS VARCHAR) AS last_seen_at
FROM {_CL} c FULL JOIN {_CE} e ON e.recruiter_id = c.recruiter_id AND e.job_id = c.job_id AND e.relationship_type = c.relationship_type""")
def touch_contact_links(v: Views) -> DataFrame:
    out = U.touch_links(v.sql(_CL[1:-1]), v.sql(_CE[1:-1]), ["recruiter_id", "job_id", "relationship_type"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_seen_at", "last_seen_at")})


_TGT = "(SELECT id, external_id, title, company, CASE WHEN id % 7 = 0 THEN 'archived' ELSE status END AS status, source, CASE WHEN id % 4 = 0 THEN NULL ELSE applied_at END AS applied_at, CASE WHEN id % 8 = 0 THEN 'linkedin_extension_legacy' WHEN id % 9 = 0 THEN 'other' ELSE '' END AS application_source FROM <<jobs>> WHERE id % 5 <> 0 AND external_id <> '')"
_SRC = "(SELECT id, external_id, title, company, 'applied' AS status, source, applied_at, first_seen_at FROM <<jobs>> WHERE external_id <> '' AND id % 3 <> 1)"
_REC = f"""j AS (SELECT t.*, s.external_id AS sx, s.sat, s.st, s.sc, s.external_id IS NOT NULL AS ins, t.id IS NOT NULL AS ex, lower(coalesce(t.status, '')) AS ls FROM {_TGT} t
  FULL JOIN (SELECT external_id, coalesce(applied_at, first_seen_at) AS sat, title AS st, company AS sc FROM {_SRC} s WHERE source = 'linkedin' AND status = 'applied') s ON s.external_id = t.external_id)"""


@query("reconcile_ledger", "U-03", f"""WITH {_REC} SELECT coalesce(external_id, sx) AS external_id, CASE WHEN ins AND NOT ex THEN st ELSE title END AS title, CASE WHEN ins AND (NOT ex OR ls IN ('new', 'saved')) THEN 'applied' ELSE status END AS status,
CAST(CASE WHEN ins AND (NOT ex OR applied_at IS NULL) THEN sat ELSE applied_at END AS VARCHAR) AS applied_at, CASE WHEN ins AND (NOT ex OR application_source = '') THEN 'linkedin_extension_legacy' ELSE application_source END AS application_source FROM j""")
def reconcile_ledger(v: Views) -> DataFrame:
    jobs, _ = U.reconcile_ledger(v.sql(_SRC[1:-1]), v.sql(_TGT[1:-1]))
    return jobs.select("external_id", "title", "status", F.col("applied_at").cast("string").alias("applied_at"), "application_source")


@query("reconcile_report", "U-03", f"""WITH {_REC} SELECT count_if(ins) AS source_records, count_if(ins AND NOT ex) AS created, count_if(ins AND ex AND ls IN ('new', 'saved')) AS marked_applied, count_if(ins AND (NOT ex OR applied_at IS NULL)) AS dated,
count_if(ins AND ex AND application_source = 'linkedin_extension_legacy' AND ls NOT IN ('new', 'saved') AND applied_at IS NOT NULL) AS already_reconciled, count_if(ins AND ex AND ls NOT IN ('new', 'saved', 'applied', 'recruiter', 'interview', 'offer', 'rejected')) AS skipped_existing_outcome FROM j""")
def reconcile_report(v: Views) -> DataFrame:
    return U.reconcile_ledger(v.sql(_SRC[1:-1]), v.sql(_TGT[1:-1]))[1]


@query("record_application", "U-04", """WITH e AS (SELECT order_id AS job_id, min(occurred_at) AS at0 FROM <<evidence>> WHERE classification = 'OFFER' GROUP BY 1)
SELECT e.job_id, coalesce(a.status, 'applied') AS status, CAST(CASE WHEN a.id IS NULL THEN e.at0 ELSE a.applied_at END AS VARCHAR) AS applied_at, coalesce(a.source, 'linkedin_extension') AS source, (a.id IS NULL)::BIGINT AS created FROM e JOIN <<jobs>> j ON j.id = e.job_id LEFT JOIN <<applications>> a ON a.job_id = e.job_id""")
def record_application(v: Views) -> DataFrame:
    events = v.evidence.where("classification = 'OFFER'").select(F.col("order_id").alias("job_id"), "occurred_at")
    out = U.record_application(v.jobs, v.applications, events)
    return out.select("job_id", "status", F.col("applied_at").cast("string").alias("applied_at"), "source",
                      F.col("created").cast("int").cast("bigint").alias("created"))


_CO = "(SELECT lower(replace(name, '#', ' ')) AS normalized_name, name, '' AS website, industry, '' AS notes, CAST('2024-01-01 00:00:00' AS {0}) AS created_at, CAST('2024-01-01 00:00:00' AS {0}) AS updated_at FROM <<companies>> WHERE id % 3 <> 0)"
_CI = "(SELECT o_orderkey AS id, 'Customer ' || lpad(CAST(o_custkey AS STRING), 9, '0') || CASE WHEN o_orderkey % 2 = 0 THEN ', Inc.' ELSE '' END AS name, 'w' || CAST(o_orderkey AS STRING) AS website, 'i' AS industry, 'n' AS notes, o_orderdate + o_orderkey * INTERVAL '1' SECOND AS updated_at FROM <<orders>>)"


@query("upsert_companies", "U-06", f"""WITH i AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' inc\\s*$', '')) AS k FROM {_CI} q), b AS (SELECT k, arg_max(website, updated_at) AS website, arg_min(name, updated_at) AS name, min(updated_at) AS lo, max(updated_at) AS hi FROM i GROUP BY k)
SELECT coalesce(c.normalized_name, b.k) AS normalized_name, coalesce(c.name, b.name) AS name, coalesce(b.website, c.website) AS website, CAST(coalesce(c.created_at, b.lo) AS VARCHAR) AS created_at, CAST(coalesce(b.hi, c.updated_at) AS VARCHAR) AS updated_at FROM {_CO.format('TIMESTAMP')} c FULL JOIN b ON b.k = c.normalized_name""")
def upsert_companies(v: Views) -> DataFrame:
    out = U.upsert_companies(v.sql(_CO.format("TIMESTAMP_NTZ")[1:-1]), v.sql(_CI[1:-1]))
    return out.select("normalized_name", "name", "website", F.col("created_at").cast("string").alias("created_at"),
                      F.col("updated_at").cast("string").alias("updated_at"))


_LC = "(SELECT message_identity, job_id, reason, updated_at AS created_at, updated_at FROM <<reviewed_links>>)"
_LI = "(SELECT message_identity, order_id AS job_id, CASE WHEN id % 4 = 0 THEN ' ' ELSE ' seen ' END AS reason, imported_at + INTERVAL '9' DAY AS updated_at FROM <<evidence>> WHERE job_id IS NULL AND id % 3 = 0)"


@query("upsert_links", "U-07", f"""WITH b AS (SELECT message_identity, job_id, trim(reason) AS reason, updated_at FROM {_LI} q WHERE trim(reason) <> ''), n AS (SELECT message_identity, max((job_id)) AS job_id, max(reason) AS reason, min(updated_at) AS lo, max(updated_at) AS hi FROM b GROUP BY 1)
SELECT DISTINCT coalesce(c.message_identity, n.message_identity) AS message_identity, coalesce(n.job_id, c.job_id) AS job_id, coalesce(n.reason, c.reason) AS reason, CAST(coalesce(c.created_at, n.lo) AS VARCHAR) AS created_at, CAST(coalesce(n.hi, c.updated_at) AS VARCHAR) AS updated_at FROM {_LC} c FULL JOIN n ON n.message_identity = c.message_identity""")
def upsert_links(v: Views) -> DataFrame:
    known = {"message_identity": v.evidence, "job_id": v.jobs.select(F.col("id").alias("job_id"))}
    out = U.upsert_links(v.sql(_LC[1:-1]).distinct(), v.sql(_LI[1:-1]), "message_identity", ["job_id", "reason"], known)
    return out.withColumns({c: F.col(c).cast("string") for c in ("created_at", "updated_at")}).distinct()


_CH = "(SELECT id, CASE WHEN id % 3 = 0 THEN 'interview' END AS status, CASE WHEN id % 5 = 0 THEN id % 4 END AS resume_id, updated_at + INTERVAL '1' DAY AS changed_at FROM <<applications>> WHERE id % 2 = 1)"


@query("apply_changes", "U-08", f"""SELECT a.id, coalesce(c.status, a.status) AS status, coalesce(c.resume_id, a.resume_id) AS resume_id, CASE WHEN c.resume_id IS NOT NULL THEN 12.5 ELSE a.match_score END::DOUBLE AS match_score,
CAST(CASE WHEN c.status IS NOT NULL OR c.resume_id IS NOT NULL THEN c.changed_at ELSE a.updated_at END AS VARCHAR) AS updated_at FROM <<applications>> a LEFT JOIN {_CH} c ON c.id = a.id""")
def apply_changes(v: Views) -> DataFrame:
    out = U.apply_changes(v.applications, v.sql(_CH[1:-1]), ["status", "resume_id"], score=("resume_id", F.lit(12.5)))
    return out.select("id", "status", "resume_id", "match_score", F.col("updated_at").cast("string").alias("updated_at"))


_FOLD = "replace(lower(text), 'ß', 'ss')"


@query("describe_jobs", "U-09", f"""WITH d AS (SELECT doc_id % 50 AS job_id, sha256(text) AS source_hash, any_value(text) AS text FROM documents GROUP BY 1, 2), t AS (SELECT DISTINCT source_hash, text FROM d),
w AS (SELECT source_hash, unnest(regexp_extract_all({_FOLD}, '([a-z0-9+#.]{{3,}})', 1)) AS word FROM t), c AS (SELECT source_hash, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY n DESC, word) AS rk FROM c),
s AS (SELECT source_hash, string_agg(word, ' ' ORDER BY rk) AS skills FROM r WHERE rk <= 30 GROUP BY 1)
SELECT d.job_id, d.source_hash, coalesce(s.skills, '') AS skills, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: contains({_FOLD.replace('text', 'l')}, 'require')), lambda l: trim(l))[1:20], '|') AS requirements FROM d LEFT JOIN s ON s.source_hash = d.source_hash""")
def describe_jobs(v: Views) -> DataFrame:
    out = U.describe_jobs(v.documents.select((F.col("doc_id") % 50).alias("job_id"), F.col("text").alias("raw_text")))
    return out.select("job_id", "source_hash", F.array_join("skills", " ").alias("skills"),
                      F.array_join("requirements", "|").alias("requirements"))


_AL = "(SELECT DISTINCT ' ' || upper(company) AS alias_name, 'Canonical ' || company AS canonical_name, CASE WHEN company = 'Iris Mobility' THEN '' ELSE 'same firm' END AS reason FROM <<jobs>> WHERE company IN ('Cobalt Freight', 'Iris Mobility', 'Ember & Oak'))"


@query("apply_aliases", "U-10", "SELECT id, company, CASE lower(company) WHEN 'cobalt freight' THEN 'Canonical Cobalt Freight' WHEN 'ember & oak' THEN 'Canonical Ember & Oak' ELSE company END AS display_company FROM <<jobs>>")
def apply_aliases(v: Views) -> DataFrame:
    return U.apply_aliases(v.jobs, U.company_aliases(v.sql(_AL[1:-1]))).select("id", "company", "display_company")


@query("rollback_scope", "U-11", """WITH base AS (SELECT max(contact_id) // 2 AS b FROM <<evidence>>), gone AS (SELECT message_identity FROM <<evidence>>, base WHERE contact_id > b AND provider = 'yahoo')
SELECT 'imported' AS "table", (SELECT count(*) FROM <<evidence>> WHERE message_identity NOT IN (SELECT * FROM gone)) AS rows UNION ALL SELECT 'metadata', (SELECT count(*) FROM <<metadata>> WHERE message_identity NOT IN (SELECT * FROM gone))
UNION ALL SELECT 'jobs', (SELECT count(*) FROM <<jobs>> WHERE id <= 700)""")
def rollback_scope(v: Views) -> DataFrame:
    from ..operators.activity import table_counts

    top = v.supplier.count()   # suppliers are numbered from 0
    e = v.evidence.withColumn("source_import_id", F.when(F.col("provider") == "yahoo", F.col("contact_id")).otherwise(0))
    imports = v.contacts.select("id", F.lit("yahoo").alias("mailbox_name"))
    kept = U.rollback_scope(imports, e, v.jobs, {"metadata": v.metadata}, (top - 1) // 2, 700, "yahoo")
    return table_counts(imported=kept["imported"], metadata=kept["metadata"], jobs=kept["jobs"])


# --- interviews ---------------------------------------------------------------------------------
def interview_stream(v: Views) -> DataFrame:
    """Interview messages of twenty jobs, as the fold wants them; every link and event id is named by many of them."""
    rows = C.interview_evidence(C.classify(v.messages))
    return rows.select((F.col("id") % 20).alias("job_id"), "message_identity",
                       F.col("received_at").alias("observed_at"), "interview.*",
                       F.when(F.col("user_id") % 6 < 4, F.col("user_id")).alias("recruiter_id"))


# The same assignment replayed event by event: every job keeps the events and the interviews it has seen.
FOLD_SQL = f"""WITH RECURSIVE {_MSG}, {INTERVIEW_SQL},
ordered AS MATERIALIZED (SELECT s.id % 20 AS job_id, s.message_identity, s.received_at AS observed_at, s.event_type, s.interview_type, CAST(s.scheduled_start AS VARCHAR) AS scheduled_start,
  CAST(s.scheduled_end AS VARCHAR) AS scheduled_end, s.zone AS timezone, s.meeting_url, CASE WHEN s.location_text <> '' THEN s.location_text ELSE s.phone END AS place,
  CASE WHEN s.meeting_url <> '' THEN 'video' WHEN s.location_text <> '' THEN 'physical' WHEN s.phone <> '' THEN 'phone' ELSE 'unknown' END AS location_type, s.title,
  s.event_identifier, coalesce(CAST(s.scheduled_start AS VARCHAR), '') AS start_key, CASE WHEN m.user_id % 6 < 4 THEN m.user_id END AS recruiter_id,
  row_number() OVER (PARTITION BY s.id % 20 ORDER BY s.received_at, s.message_identity) AS n FROM seen s JOIN (SELECT id AS mid, user_id FROM <<messages>>) m ON m.mid = s.id),
replay(job_id, n, known, held, message_identity, interview_key) AS (
  SELECT DISTINCT job_id, 0::BIGINT, []::STRUCT(e VARCHAR, k VARCHAR)[], []::STRUCT(k VARCHAR, u VARCHAR, s VARCHAR)[], ''::VARCHAR, ''::VARCHAR FROM ordered
  UNION ALL
  SELECT job_id, n, CASE WHEN event_identifier = '' OR len(list_filter(known, lambda x: x.e = event_identifier)) > 0 THEN known ELSE list_append(known, {{'e': event_identifier, 'k': found}}) END,
    CASE WHEN len(list_filter(held, lambda x: x.k = found)) = 0 THEN list_append(held, {{'k': found, 'u': meeting_url, 's': start_key}})
      ELSE list_transform(held, lambda x: CASE WHEN x.k = found THEN {{'k': x.k, 'u': CASE WHEN meeting_url <> '' THEN meeting_url ELSE x.u END, 's': CASE WHEN start_key <> '' THEN start_key ELSE x.s END}} ELSE x END) END,
    message_identity, found
  FROM (SELECT r.job_id, r.known, r.held, o.n, o.message_identity, o.event_identifier, o.meeting_url, o.start_key, coalesce(
    CASE WHEN o.event_identifier <> '' THEN list_filter(r.known, lambda x: x.e = o.event_identifier)[1].k END,
    CASE WHEN o.meeting_url <> '' THEN list_filter(r.held, lambda x: x.u = o.meeting_url)[1].k END,
    CASE WHEN o.start_key <> '' THEN list_filter(r.held, lambda x: x.s = o.start_key)[1].k END, o.message_identity) AS found
    FROM replay r JOIN ordered o ON o.job_id = r.job_id AND o.n = r.n + 1) step),
assigned AS (SELECT message_identity, interview_key FROM replay WHERE n > 0)"""


def _last(column: str, out: str = "") -> str:
    return f"arg_max({column}, n) FILTER (coalesce({column}, '') <> '') AS {out or column}"


@query("fold_interviews", "U-05 J-08", f"""{FOLD_SQL} SELECT interview_key, min(job_id) AS job_id, arg_min(recruiter_id, n) FILTER (recruiter_id IS NOT NULL) AS recruiter_id, arg_min(interview_type, n) AS interview_type,
CASE arg_max(event_type, n) WHEN 'confirmation' THEN 'confirmed' WHEN 'reschedule' THEN 'rescheduled' WHEN 'cancellation' THEN 'cancelled' ELSE 'scheduled' END AS status,
{", ".join(map(_last, ("scheduled_start", "scheduled_end", "timezone", "location_type", "meeting_url", "title")))}, {_last("place", "location_text")},
arg_min(message_identity, n) AS first_source_message_identity, CAST(min(observed_at) AS VARCHAR) AS first_seen_at, CAST(max(observed_at) AS VARCHAR) AS last_seen_at,
CAST(min(observed_at) AS VARCHAR) AS created_at, CAST(max(observed_at) AS VARCHAR) AS updated_at, count(*) AS event_count FROM ordered JOIN assigned USING (message_identity) GROUP BY interview_key""")
def fold_interviews(v: Views) -> DataFrame:
    out = N.fold_interviews(interview_stream(v))
    return out.withColumns({c: F.col(c).cast("string") for c in (
        "scheduled_start", "scheduled_end", "first_seen_at", "last_seen_at", "created_at", "updated_at")})


@query("assign_interviews", "J-08", f"{FOLD_SQL} SELECT message_identity, interview_key FROM assigned")
def assign_interviews(v: Views) -> DataFrame:
    return N.assign_interviews(interview_stream(v)).select("message_identity", "interview_key")


# --- quality --------------------------------------------------------------------------------------
@query("duplicate_key_groups", "Q-01", """SELECT 'evidence' AS "table", (SELECT count(*) FROM (SELECT message_identity FROM <<evidence>> GROUP BY 1 HAVING count(*) > 1) a) AS duplicate_groups UNION ALL SELECT 'contact_emails', (SELECT count(*) FROM (SELECT normalized_email FROM <<contact_emails>> GROUP BY 1 HAVING count(*) > 1) b)
UNION ALL SELECT 'contact_jobs', (SELECT count(*) FROM (SELECT recruiter_id, job_id, relationship_type FROM <<contact_jobs>> GROUP BY ALL HAVING count(*) > 1) c)""")
def duplicate_key_groups(v: Views) -> DataFrame:
    return Q.duplicate_key_groups({
        "evidence": (v.evidence, ["message_identity"]), "contact_emails": (v.contact_emails, ["normalized_email"]),
        "contact_jobs": (v.contact_jobs, ["recruiter_id", "job_id", "relationship_type"])})


_H = "(SELECT ('0x' || substr(md5(n_name || chr(31) || n_nationkey || chr(31) || n_regionkey), 1, 15))::BIGINT AS h FROM nation)"
_DOC = "(SELECT ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(31) || coalesce(lang, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents)"


@query("table_digest", "Q-02", f"SELECT count(*) AS rows, CAST(sum(h) AS VARCHAR) AS total, bit_xor(h) AS mixed FROM {_DOC} q")
def table_digest(v: Views) -> DataFrame:
    return Q.table_digest(v.documents.select("doc_id", "lang", "text"))


@query("preserved", "Q-03", """WITH b AS (SELECT id, status FROM <<jobs>>), a AS (SELECT id, CASE WHEN id > 500 THEN 'changed' ELSE status END AS status FROM <<jobs>>)
SELECT (NOT EXISTS (SELECT * FROM b WHERE id <= 500 EXCEPT SELECT * FROM a WHERE id <= 500) AND NOT EXISTS (SELECT * FROM a WHERE id <= 500 EXCEPT SELECT * FROM b WHERE id <= 500))::BIGINT AS preserved,
 (NOT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a))::BIGINT AS all_preserved FROM (SELECT 1) q""")
def preserved(v: Views) -> DataFrame:
    before = v.jobs.select("id", "status")
    after = before.withColumn("status", F.when(F.col("id") > 500, F.lit("changed")).otherwise(F.col("status")))
    old = Q.preserved(before, after, 500).withColumn("_k", F.lit(1))
    every = Q.preserved(before, after, 2**62).select(F.col("preserved").alias("all_preserved"), F.lit(1).alias("_k"))
    return old.join(every, "_k").select(*[
        F.col(c).cast("int").cast("bigint").alias(c) for c in ("preserved", "all_preserved")])


@query("state_delta", "Q-04", "SELECT 'jobs' AS \"table\", (SELECT count(*) FROM <<jobs>>) - (SELECT count(*) FROM <<jobs>> WHERE id % 3 <> 0) AS delta UNION ALL SELECT 'evidence', 0")
def state_delta(v: Views) -> DataFrame:
    return Q.state_delta({"jobs": v.jobs.where("id % 3 <> 0"), "evidence": v.evidence},
                         {"jobs": v.jobs, "evidence": v.evidence})


_VER = """i AS (SELECT message_identity, min(job_id) AS ij FROM <<evidence>> WHERE id % 5 <> 0 GROUP BY 1), c AS (SELECT message_identity, min(CASE WHEN id % 11 = 0 THEN NULL ELSE job_id END) AS cj FROM <<evidence>> WHERE id % 7 <> 0 GROUP BY 1),
bc AS (SELECT DISTINCT l.message_identity FROM <<contact_jobs>> l LEFT JOIN (SELECT id FROM <<contacts>> WHERE id % 4 <> 0) p ON p.id = l.recruiter_id WHERE p.id IS NULL), bi AS (SELECT DISTINCT message_identity FROM <<interview_events>> WHERE interview_id NOT IN (SELECT id FROM <<interviews>>)),
f AS (SELECT m.message_identity, i.message_identity IS NOT NULL AS imported_message, m.message_identity IN (SELECT message_identity FROM <<metadata>>) AS transport_metadata, c.message_identity IS NOT NULL AS classification,
 i.message_identity IS NOT NULL AND c.message_identity IS NOT NULL AND i.ij IS NOT DISTINCT FROM c.cj AS job_link_stable, bc.message_identity IS NULL AS recruiter_links_stable, bi.message_identity IS NULL AS interview_links_stable
 FROM (SELECT DISTINCT message_identity FROM <<evidence>>) m LEFT JOIN i ON i.message_identity = m.message_identity LEFT JOIN c ON c.message_identity = m.message_identity LEFT JOIN bc ON bc.message_identity = m.message_identity LEFT JOIN bi ON bi.message_identity = m.message_identity)"""
_FLAGS = ("imported_message", "transport_metadata", "classification", "job_link_stable", "recruiter_links_stable", "interview_links_stable")


@query("batch_verification", "Q-05", f"WITH {_VER} SELECT message_identity, {', '.join(f'{x}::BIGINT AS {x}' for x in _FLAGS)}, ({' AND '.join(_FLAGS)})::BIGINT AS represented FROM f")
def batch_verification(v: Views) -> DataFrame:
    e = v.evidence
    classified = e.where("id % 7 <> 0").select("message_identity", F.when(F.col("id") % 11 != 0, F.col("job_id")).alias("job_id"), F.lit("v1").alias("classifier_version"))
    out = Q.batch_verification(
        e.select("message_identity"), e.where("id % 5 <> 0"), v.metadata, classified, v.jobs, v.contact_jobs,
        v.contacts.where("id % 4 <> 0"), v.interview_events, v.interviews, "v1")
    return out.withColumns({f: F.col(f).cast("int").cast("bigint") for f in (*_FLAGS, "represented")})


@query("orphans", "Q-06", "SELECT id, job_id FROM <<evidence>> WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM <<interviews>>)")
def orphans(v: Views) -> DataFrame:
    return Q.orphans(v.evidence, v.interviews, "job_id").select("id", "job_id")


@query("check_constraints", "Q-07", "SELECT 'status' AS rule, count_if(status NOT IN ('applied', 'interview', 'saved')) AS violations FROM <<applications>> UNION ALL SELECT 'score', count_if(NOT (match_score BETWEEN 0 AND 90)) FROM <<applications>> UNION ALL SELECT 'resume', count_if(NOT (resume_id < 6)) FROM <<applications>>")
def check_constraints(v: Views) -> DataFrame:
    return Q.check_constraints(v.applications, {
        "status": F.col("status").isin("applied", "interview", "saved"), "score": F.col("match_score").between(0, 90),
        "resume": F.col("resume_id") < 6})


@query("idempotent_import", "Q-08", "SELECT 1::BIGINT AS equal, count(DISTINCT message_id) AS rows FROM <<messages>>")
def idempotent_import(v: Views) -> DataFrame:
    from ..operators.identity import new_only

    rows = v.messages.select("message_id")
    first = new_only(rows, rows.limit(0), "message_id")
    second = first.unionByName(new_only(rows, first, "message_id"))
    same = Q.digests_equal(first, second).withColumn("_k", F.lit(1))
    size = second.agg(F.count("*").alias("rows")).withColumn("_k", F.lit(1))
    return same.join(size, "_k").select(F.col("equal").cast("int").cast("bigint").alias("equal"), "rows")


@query("failure_ledger", "Q-09", "SELECT event_id AS id, 'unreadable payload' AS error FROM events WHERE event_id % 6 = 5")
def failure_ledger(v: Views) -> DataFrame:
    raw = F.when(F.col("event_id") % 6 == 5, F.lit("oops")).otherwise(F.col("props"))
    rows = v.events.select(F.col("event_id").alias("id"), F.from_json(raw, "k int, _corrupt_record string", {
        "columnNameOfCorruptRecord": "_corrupt_record"}).alias("parsed"))
    rows = rows.withColumn("error", F.when(F.col("parsed._corrupt_record").isNotNull(), F.lit("unreadable payload")))
    return Q.failure_ledger(rows, "parsed", "error")[1]


@query("replay_conflicts", "Q-10", f"WITH {_MSG} SELECT m.message_identity, 'OFFER' AS classification, c.classification AS replayed_classification FROM <<messages>> m JOIN classified c ON c.key = m.id WHERE m.id % 6 = 0 AND c.classification <> 'OFFER'")
def replay_conflicts(v: Views) -> DataFrame:
    replay = C.classify(v.messages).select("id", "message_identity", "provider", "classification", "classifier_version")
    stored = v.messages.where("id % 6 = 0").select("message_identity", "provider", F.lit("OFFER").alias("classification"),
                                                   F.lit(fixed.CLASSIFIER_VERSION).alias("classifier_version"))
    return Q.replay_conflicts(stored, replay).select("message_identity", "classification", "replayed_classification")


# --- sets ---------------------------------------------------------------------------------------------
@query("missing_ids", "E-02", """WITH p AS (SELECT user_id % 10 AS scope, event_id AS uid FROM events WHERE event_type <> 'click' OR event_id % 2 = 0), r AS (SELECT scope, min(uid) AS a, max(uid) AS b FROM p GROUP BY 1)
SELECT scope, uid FROM (SELECT scope, unnest(generate_series(a, b)) AS uid FROM r) s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.scope = s.scope AND p.uid = s.uid)""")
def missing_ids(v: Views) -> DataFrame:
    rows = v.events.where("event_type <> 'click' OR event_id % 2 = 0").select(
        (F.col("user_id") % 10).alias("scope"), F.col("event_id").alias("uid"))
    return Q.missing_ids(rows, "uid", ["scope"])


@query("class_shortfall", "E-03", "WITH e AS (SELECT classification, count(*) AS n FROM <<evidence>> GROUP BY 1), a AS (SELECT classification, count(*) AS n FROM <<evidence>> WHERE contact_id % 4 = 0 OR classification = 'OFFER' GROUP BY 1) SELECT e.classification, e.n - coalesce(a.n, 0) AS shortfall FROM e LEFT JOIN a USING (classification) WHERE e.n > coalesce(a.n, 0)")
def class_shortfall(v: Views) -> DataFrame:
    def count(df):
        return df.groupBy("classification").agg(F.count("*").alias("n"))

    return Q.class_shortfall(count(v.evidence), count(v.evidence.where("contact_id % 4 = 0 OR classification = 'OFFER'")))


_EXPECTED = {"o_orderkey": "bigint", "o_clerk": "string", "o_custkey": "bigint", "o_orderpriority": "int", "o_orderdate": "timestamp"}
_COLUMN_COUNT = "SELECT 'orders' AS \"table\", '{1}' AS severity, '{0}' AS \"column\", count(*) AS rows, count_if({0} IS NULL) AS nulls, {2}::BIGINT AS failing FROM orders"


@query("schema_diff", "E-04", " UNION ALL ".join([
    *(_COLUMN_COUNT.format(c, s, f) for c, s, f in (
        ("o_orderkey", "ok", 0), ("o_custkey", "ok", 0), ("o_orderdate", "ok", 0), ("o_orderstatus", "warning", 0), ("o_totalprice", "warning", 0),
        ("o_orderpriority", "error", "count_if(o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS INTEGER) IS NULL)"))),
    "SELECT 'orders', 'error', 'o_clerk', count(*), count(*), 0 FROM orders"]))
def schema_diff(v: Views) -> DataFrame:
    return Q.schema_diff(v.orders, _EXPECTED, "orders")


@query("subset_check", "E-05", "SELECT count(DISTINCT e.job_id) AS keys, count(DISTINCT CASE WHEN i.id IS NOT NULL THEN e.job_id END) AS shared, (count(DISTINCT e.job_id) = count(DISTINCT CASE WHEN i.id IS NOT NULL THEN e.job_id END))::BIGINT AS subset FROM <<evidence>> e LEFT JOIN <<interviews>> i ON i.id = e.job_id WHERE e.job_id IS NOT NULL")
def subset_check(v: Views) -> DataFrame:
    out = Q.is_subset(v.evidence.where("job_id IS NOT NULL"), v.interviews.select(F.col("id").alias("job_id")), "job_id")
    return out.withColumn("subset", F.col("subset").cast("int").cast("bigint"))


__all__ = ["normalize_alias", "resume_score"]
