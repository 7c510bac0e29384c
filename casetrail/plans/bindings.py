"""Views that bind the library's business tables to the given tables.

Each view is one SQL text that both Spark and the comparison engine run, so what is compared is
the operator on top of it.  ``<<name>>`` stands for a given table or another view.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .. import fixed

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
# row-heavy inputs of the text operators
NOW = "2001-08-15 00:00:00"
THROUGH = "2001-08-10"
FIRST_MONTH = "1995-01-01"


def pick(index: str, values) -> str:
    """Chooses a value of a list by a small integer; written for each engine by :func:`_picks`."""
    return f"pick[[{index} ## {'|'.join(values)}]]"


def _picks(text: str, spark: bool) -> str:
    def one(found: re.Match) -> str:
        index, values = found.group(1), found.group(2).replace("'", "''")
        if spark:   # the split of a constant is folded once, at planning
            return f"element_at(split('{values}', '[|]'), CAST({index} AS INT) + 1)"
        return f"(string_split('{values}', '|'))[CAST({index} AS INT) + 1]"

    return re.sub(r"pick\[\[(.*?) ## (.*?)\]\]", one, text, flags=re.S)


_COMPANIES = (
    "Aster Labs Inc.", "Beacon Health LLC", "Cobalt Freight", "Delta Grid Corp.", "Ember & Oak",
    "Falcon Retail Group", "Granite Analytics Inc", "Harbor Foods Company", "Iris Mobility",
    "Juniper Learning Ltd.", "Kestrel Media", "Lumen Insurance Corporation",
)
_TITLES = (
    "Senior Product Manager", "Product Manager, Growth", "Technical Program Manager",
    "Sales Engineer", "Solutions Consultant", "Lifecycle Marketing Manager", "CRM Analyst",
    "Performance Marketing Lead", "Delivery Manager", "Operations Analyst",
    "Fleet Operations Coordinator", "Product Marketing Director", "Growth Marketing Manager",
    "Demand Generation Specialist", "Solutions Architect", "Staff Data Engineer",
    "Field Engineer", "Principal Designer",
)
_PHRASES = tuple(p for _, _, ps in fixed.CLASSIFICATION_RULES for p in ps) + ("good day to you",)
_MONTHS = ("January", "Feb", "March", "Apr", "May", "June", "Jul", "August", "Sep", "October",
           "Nov", "December")
_ZONES = ("PST", "EST", "UTC", "CDT", "", "PST or EST")
_NAMES = ("Ada Quill", "Ben Frost", "Cy Vale", "Dee Marsh", "", "Flo Penn")
_LINES = ("Senior Recruiter", "Lead Sourcer", "Recruiting Coordinator", "Account Executive")
_TYPES = fixed.MESSAGE_TYPES

VIEWS: dict[str, str] = {}

VIEWS["jobs"] = f"""
SELECT o.o_orderkey AS id,
  CASE WHEN o.o_orderkey % 6 = 5 THEN ''
       ELSE CAST(4000000000 + o.o_orderkey AS STRING) END AS external_id,
  {pick("(o.o_orderkey * 7 + o.o_custkey) % 18", _TITLES)} AS title,
  CASE WHEN o.o_custkey % 19 = 0 THEN ''
       WHEN o.o_custkey % 3 = 1 THEN 'Firm ' || CAST(o.o_custkey AS STRING) || ' Works'
       WHEN o.o_custkey % 7 = 3 THEN c.c_name
       WHEN o.o_orderkey % 5 = 0 THEN lower({pick("o.o_custkey % 12", _COMPANIES)})
       ELSE {pick("o.o_custkey % 12", _COMPANIES)} END AS company,
  CASE o.o_orderstatus WHEN 'F' THEN 'applied' WHEN 'P' THEN 'interview'
       ELSE CASE WHEN o.o_orderkey % 2 = 0 THEN 'saved' ELSE 'new' END END AS status,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'email' ELSE 'linkedin' END AS source,
  CASE WHEN o.o_orderkey % 3 = 0 THEN '' WHEN o.o_orderkey % 3 = 1 THEN 'gmail'
       ELSE 'yahoo' END AS email_account,
  CASE WHEN o.o_orderkey % 11 = 0 THEN ' ' ELSE o.o_orderpriority END AS role_family,
  CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE o.o_orderdate END AS applied_at,
  o.o_orderdate + (o.o_orderkey % 30) * INTERVAL '1' DAY AS first_seen_at,
  o.o_orderdate + (o.o_orderkey % 60) * INTERVAL '1' DAY AS last_seen_at,
  CASE WHEN o.o_orderkey % 7 = 0 THEN 'C' || CAST(o.o_custkey % 400 AS STRING)
       ELSE '' END AS confirmation_id,
  CASE WHEN o.o_orderkey % 9 = 0 THEN 'REQ-' || CAST(1000 + o.o_orderkey % 700 AS STRING)
       ELSE '' END AS requisition_id,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'Greenhouse' ELSE '' END AS ats_platform,
  CASE WHEN o.o_orderkey % 8 = 0 THEN 'email_confirmation' ELSE '' END AS application_source,
  CAST(o.o_orderkey % 100 AS DOUBLE) AS import_confidence,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
       ELSE CAST(o.o_orderkey % 260 AS BIGINT) END AS applicant_count,
  o.o_orderkey % 17 = 0 AS applicant_count_is_over,
  o.o_orderkey % 5 = 0 AS easy_apply, o.o_orderkey % 6 = 0 AS promoted,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Austin, TX'
       ELSE 'United States (Hybrid)' END AS location,
  CASE WHEN o.o_orderkey % 4 = 1 THEN 'Remote' ELSE '' END AS work_mode,
  '$' || CAST(90 + o.o_orderkey % 60 AS STRING) || 'K/yr' AS salary_text,
  'Product' AS resume_family, '' AS url, o.o_custkey AS custkey,
  o.o_totalprice AS price,
  CAST(o.o_orderkey % 101 AS DOUBLE) AS score
FROM <<orders>> o JOIN <<customer>> c ON o.o_custkey = c.c_custkey
"""

VIEWS["applications"] = """
SELECT o_orderkey * 10 + 1 AS id, o_orderkey AS job_id, o_custkey AS company_id,
  CASE WHEN o_orderkey % 16 = 0 THEN 'withdrawn' WHEN o_orderkey % 12 = 0 THEN 'offer'
       WHEN o_orderstatus = 'F' THEN 'applied' WHEN o_orderstatus = 'P' THEN 'interview'
       ELSE 'saved' END AS status,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL
       ELSE o_orderdate + (o_orderkey % 30) * INTERVAL '1' DAY END AS applied_at,
  o_orderdate + (o_orderkey % 30) * INTERVAL '1' DAY AS created_at,
  o_orderdate + (o_orderkey % 60) * INTERVAL '1' DAY AS updated_at,
  CASE WHEN o_orderkey % 8 = 0 THEN 'manual' ELSE 'linkedin_extension' END AS source,
  CASE WHEN o_orderkey % 28 = 0 THEN NULL ELSE o_orderkey % 7 END AS resume_id,
  CAST(o_orderkey % 97 AS DOUBLE) AS match_score
FROM <<orders>> WHERE o_orderkey % 4 = 0
"""

VIEWS["resumes"] = """
SELECT DISTINCT o_orderkey % 9 AS id, 'Resume ' || CAST(o_orderkey % 9 AS STRING) AS name
FROM <<orders>>
"""

VIEWS["evidence"] = f"""
SELECT l_orderkey * 10 + l_linenumber AS id,
  'v1:' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)
    || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS STRING)
    AS message_identity,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_orderkey END AS job_id,
  {pick("(l_orderkey + l_linenumber) % 23", _TYPES)} AS classification,
  {pick("l_suppkey % 3", fixed.PROVIDERS)} AS provider,
  CASE WHEN l_suppkey % 50 = 7 THEN NULL ELSE l_shipdate END AS occurred_at,
  l_shipdate + INTERVAL '1' DAY AS imported_at,
  CASE WHEN l_suppkey % 4 = 0 THEN 'owner@gmail.example' ELSE '' END AS account,
  l_suppkey AS contact_id, l_orderkey AS order_id
FROM <<lineitem>>
"""

VIEWS["interview_events"] = f"""
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS interview_id,
  CASE WHEN l_partkey % 14 = 0 THEN NULL ELSE l_orderkey END AS job_id,
  'v1:' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)
    || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS STRING)
    AS message_identity,
  {pick("l_suppkey % 3", fixed.PROVIDERS)} AS provider,
  {pick("l_linenumber % 4", ("invitation", "confirmation", "reschedule", "cancellation"))}
    AS event_type,
  l_shipdate AS occurred_at
FROM <<lineitem>> WHERE l_linenumber IN (2, 3, 5)
"""

VIEWS["interviews"] = f"""
SELECT o.o_orderkey AS id, o.o_orderkey AS job_id,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_orderkey % 90 END AS recruiter_id,
  {pick("o.o_orderkey % 7", ("recruiter_screen", "technical", "panel", "onsite",
                             "hiring_manager", "assessment", "interview"))} AS interview_type,
  {pick("o.o_orderkey % 4", ("scheduled", "confirmed", "rescheduled", "cancelled"))} AS status,
  CASE WHEN o.o_orderkey % 6 = 0 THEN NULL
       ELSE o.o_orderdate + (o.o_orderkey % 24) * INTERVAL '1' HOUR END AS scheduled_start,
  CASE WHEN o.o_orderkey % 9 = 0 THEN ''
       WHEN o.o_orderkey % 9 = 1 THEN 'Read our privacy notice'
       ELSE 'Interview ' || CAST(o.o_orderkey AS STRING) END AS title
FROM <<orders>> o WHERE o.o_orderstatus = 'P'
"""

VIEWS["offers"] = """
SELECT id + 5 AS id, id AS application_id, job_id,
  CASE WHEN id % 3 = 0 THEN 'received' ELSE 'accepted' END AS status,
  CASE WHEN id % 5 = 0 THEN NULL ELSE created_at + INTERVAL '20' DAY END AS offered_at,
  created_at + INTERVAL '21' DAY AS created_at, company_id
FROM <<applications>> WHERE status = 'offer'
"""

VIEWS["interactions"] = """
SELECT e.event_id AS id, e.event_id % 1500 AS company_id, e.ts AS occurred_at,
  e.event_type AS interaction_type, 'Interaction ' || CAST(e.event_id AS STRING) AS summary,
  e.event_id % 2 AS immutable_evidence
FROM <<events>> e
"""

VIEWS["companies"] = """
SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', ' ')) AS normalized_name,
  '' AS website, c_mktsegment AS industry
FROM <<customer>>
"""

VIEWS["contacts"] = """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 5 THEN '' ELSE s_name END AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Senior Recruiter' END AS title,
  'Regards ' || CAST(s_suppkey % 40 AS STRING) AS signature, '' AS linkedin_url, '' AS phone,
  s_acctbal AS balance
FROM <<supplier>>
"""
VIEWS["contact_companies"] = """
SELECT s_suppkey AS recruiter_id, 'Group ' || CAST(s_nationkey AS STRING) AS company_name,
  'group ' || CAST(s_nationkey AS STRING) AS normalized_company_name
FROM <<supplier>>
"""
VIEWS["contact_emails"] = """
SELECT s_suppkey AS recruiter_id, 'R' || CAST(s_suppkey % 70 AS STRING) || '@x.example' AS email,
  'r' || CAST(s_suppkey % 70 AS STRING) || '@x.example' AS normalized_email
FROM <<supplier>>
"""
VIEWS["contact_jobs"] = """
SELECT l_suppkey AS recruiter_id, l_orderkey AS job_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'sourcer' ELSE 'unknown' END AS relationship_type,
  min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at,
  min('v1:' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)
    || '-' || CAST(l_partkey AS STRING)) AS message_identity
FROM <<lineitem>>
GROUP BY l_suppkey, l_orderkey,
  CASE WHEN l_linenumber % 2 = 0 THEN 'sourcer' ELSE 'unknown' END
"""

VIEWS["metadata"] = """
SELECT message_identity, provider, account AS account_namespace, occurred_at AS received_at,
  CASE WHEN contact_id % 3 = 0 THEN occurred_at + INTERVAL '1' HOUR ELSE NULL END AS internal_date,
  CASE WHEN contact_id % 4 = 1 THEN '' ELSE 'Subject ' || CAST(id AS STRING) END AS subject,
  CASE WHEN contact_id % 2 = 1 THEN '' ELSE 'a' || CAST(contact_id AS STRING) || '@x.example' END
    AS sender
FROM <<evidence>> WHERE contact_id % 5 <> 0
"""

VIEWS["reviewed_links"] = """
SELECT message_identity, order_id AS job_id, 'checked' AS reason, imported_at AS updated_at
FROM <<evidence>> WHERE job_id IS NULL AND id % 7 = 0
"""

def _schedules() -> list[str]:
    """One sentence per residue of a message id: dates, times and zones, good and bad."""
    out = []
    for i in range(120):
        if i % 5 == 0:
            half = "AM" if i % 2 == 0 else "pm"
            out.append(f"Meet on {_MONTHS[i % 12]} {1 + i % 28}, 2027 at {1 + i % 12}:{15 * (i % 4):02d}"
                       f" {half} {_ZONES[i % 6]} for {15 + i % 60} minutes. ")
        elif i % 5 == 1:
            out.append(f"Meet 2027-0{1 + i % 9}-1{i % 10} from {1 + i % 14} AM to {1 + i % 12}:30 PM"
                       f" {_ZONES[i % 6]}. ")
        elif i % 5 == 2:
            out.append(f"Pick 2027-02-30 or May {1 + i % 28}, 2027 at 19:75 PM. ")
        else:
            out.append("")
    return out


_BEFORE = ("Join https://zoom.us/j/", "Apply http://boards.greenhouse.io/a/", "Meeting ID: cal-",
           "Location: ", "Call 415-555-1", "A phone screen, round ", "Ask about round ")
_AFTER = ("). ", " . ", ". ", " Main Street; floor 2. ", ". ", ", soon. ", ". ")

VIEWS["messages"] = f"""
SELECT e.event_id AS id, 'v1:e' || CAST(e.event_id AS STRING) AS message_identity,
  CASE WHEN e.event_id % 4 = 3 THEN ''
       ELSE '<M' || CAST(e.event_id - e.event_id % 8 AS STRING) || ' @Mail.Example>'
  END AS message_id,
  {pick("e.user_id % 3", fixed.PROVIDERS)} AS provider,
  {pick("e.user_id % 2", ("Owner@Gmail.Example ", ""))} AS account,
  CASE e.event_id % 4
    WHEN 0 THEN {pick("e.event_id % 53", _PHRASES)}
    WHEN 1 THEN j.company || ' ' || j.title || ' interview invitation'
    WHEN 2 THEN 'Application to ' || j.company
    ELSE 'Re: ' || j.title END AS subject,
  CASE WHEN e.user_id % 6 = 4 THEN 'no-reply@jobs-mail.example'
       WHEN e.user_id % 6 = 5 THEN 'pat' || CAST(e.user_id AS STRING) || '@gmail.com'
       ELSE {pick("e.event_id % 6", _NAMES)} || ' <Rec' || CAST(e.user_id AS STRING) || '@'
         || {pick("e.event_id % 5", ("aster-labs", "beacon", "cobalt", "falcon-retail", "kestrel"))}
         || '.com>' END AS sender,
  'Hello, ' || {pick("(e.event_id * 5 + e.user_id) % 53", _PHRASES)} || '. '
  || {pick("e.event_id % 120", _schedules())}
  || CASE e.event_id % 3
       WHEN 0 THEN 'Job ID: REQ-' || CAST(1000 + e.event_id % 700 AS STRING) || '. '
       WHEN 1 THEN 'See https://www.linkedin.com/jobs/view/' || CAST(4000000000 + e.event_id AS STRING) || ' . '
       ELSE 'Position: ' || j.title || ' at ' || j.company || ', soon. ' END
  || {pick("e.event_id % 7", _BEFORE)} || CAST(100 + e.event_id % 500 AS STRING)
  || {pick("e.event_id % 7", _AFTER)}
  || '
Regards,
' || {pick("e.event_id % 6", _NAMES)} || '
' || {pick("e.user_id % 4", _LINES)} || '
https://linkedin.com/in/p' || CAST(e.user_id AS STRING) || '
' || {pick("e.event_id % 4", ("", """  Requirements: SQL and Spark 
We REQUIRE care

""", "", ""))} AS body,
  e.ts AS received_at, e.ts + (e.event_id % 3) * INTERVAL '1' HOUR AS internal_date,
  CASE WHEN e.event_id % 5 = 4 THEN NULL ELSE e.event_id END AS job_id,
  e.user_id AS user_id, e.event_type AS event_type
FROM <<events>> e JOIN <<jobs>> j ON j.id = e.event_id
"""

VIEWS["confirmed"] = """
SELECT 'v1:a' || CAST(e.event_id AS STRING) AS message_identity, e.event_id AS id,
  CASE WHEN e.user_id % 2 = 0 THEN 'gmail' ELSE 'yahoo' END AS account,
  CASE e.event_id % 5 WHEN 0 THEN '' WHEN 1 THEN upper(j.company)
       WHEN 2 THEN replace(j.company, ' Labs', '') ELSE j.company END AS company,
  CASE e.event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Staff ' || j.title
       WHEN 2 THEN replace(j.title, 'Marketing', 'Brand') ELSE j.title END AS title,
  CASE WHEN e.event_id % 8 = 7 THEN NULL
       ELSE j.first_seen_at + (e.event_id % 60) * INTERVAL '7' HOUR END AS applied_at,
  CASE WHEN e.event_id % 11 = 0 THEN j.external_id ELSE '' END AS job_ref,
  lower(j.requisition_id) AS requisition_id,
  CASE WHEN e.event_id % 6 = 0 THEN '3-MEDIUM' ELSE '' END AS inferred_role,
  'https://x.example/' || CAST(e.event_id AS STRING) AS job_url,
  CASE WHEN e.event_id % 4 = 0 THEN 'Lever' ELSE '' END AS ats_platform,
  'm' || CAST(e.event_id AS STRING) AS message_id
FROM <<events>> e JOIN <<jobs>> j ON j.id = e.event_id
"""

VIEWS["postings"] = """
SELECT p_partkey AS id, p_name AS title, p_brand AS company,
  CASE p_size % 5
    WHEN 0 THEN 'Over ' || CAST(p_size * 100 AS STRING) || ' applicants'
    WHEN 1 THEN 'over 1,' || lpad(CAST(p_size AS STRING), 3, '0') || ' people clicked apply'
    WHEN 2 THEN CAST(p_size AS STRING) || ' people  clicked apply'
    WHEN 3 THEN CAST(p_size AS STRING) || '+ applicants'
    ELSE 'Be an early one' END
  || ' in Austin, TX (' || CASE p_size % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid'
    ELSE 'On-site' END || ') Reposted ' || CAST(p_size AS STRING) || ' days ago '
  || CASE WHEN p_size % 4 = 0 THEN '$' || CAST(p_size AS STRING) || 'K/yr - $'
    || CAST(p_size + 20 AS STRING) || 'K/yr ' ELSE '' END
  || CASE WHEN p_size % 6 = 0 THEN 'Easy Apply ' ELSE '' END
  || CASE WHEN p_size % 7 = 0 THEN 'Promoted' ELSE '' END AS text
FROM <<part>>
"""

VIEWS["activity_log"] = """
SELECT CAST(o_orderdate AS DATE) AS day, count(*) - 1 AS applications FROM <<orders>>
WHERE CAST(o_orderdate AS DATE) >= DATE '1997-03-01'
  AND CAST(o_orderdate AS DATE) <= DATE '2001-03-17'
  AND NOT (CAST(o_orderdate AS DATE) >= DATE '1998-02-01'
       AND CAST(o_orderdate AS DATE) < DATE '1998-04-01')
GROUP BY CAST(o_orderdate AS DATE)
"""
VIEWS["ledger"] = """
SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey AS id FROM <<lineitem>>
WHERE l_returnflag = 'A' AND CAST(l_shipdate AS DATE) >= DATE '2000-05-12'
"""

VIEWS["checkpoints"] = f"""
SELECT {pick("user_id % 2", ("gmail", "yahoo"))} AS provider,
  'u' || CAST(user_id AS STRING) AS account, event_id AS uid,
  event_type = 'error' AS failed, ts
FROM <<events>>
"""

_SHORT = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
VIEWS["stamps"] = f"""
SELECT event_id AS id, ts, l2, event_id % 5 AS kind,
  CASE event_id % 5
    WHEN 0 THEN CAST(ts AS STRING)
    WHEN 1 THEN replace(CAST(ts AS STRING), ' ', 'T') || 'Z'
    WHEN 2 THEN replace(CAST(l2 AS STRING), ' ', 'T') || '+02:00'
    WHEN 3 THEN substr(CAST(ts AS STRING), 1, 10)
    ELSE 'on ' || CAST(ts AS STRING) END AS iso_text,
  CASE event_id % 5
    WHEN 0 THEN 'Mon, ' || CAST(day(ts) AS STRING) || ' ' || {pick("month(ts) - 1", _SHORT)} || ' '
      || CAST(year(ts) AS STRING) || ' ' || substr(CAST(ts AS STRING), 12, 8) || ' +0000'
    WHEN 1 THEN CAST(day(l2) AS STRING) || ' ' || {pick("month(l2) - 1", _SHORT)} || ' '
      || CAST(year(l2) AS STRING) || ' ' || substr(CAST(l2 AS STRING), 12, 8) || ' +0200 (CEST)'
    WHEN 2 THEN 'Tue, ' || CAST(day(ts) AS STRING) || ' ' || {pick("month(ts) - 1", _SHORT)} || ' '
      || CAST(year(ts) AS STRING) || ' ' || substr(CAST(ts AS STRING), 12, 8) || ' GMT'
    WHEN 3 THEN CAST(day(ts) AS STRING) || ' ' || {pick("month(ts) - 1", _SHORT)} || ' '
      || CAST(year(ts) AS STRING) || ' ' || substr(CAST(ts AS STRING), 12, 8)
    ELSE 'yesterday' END AS mail_text,
  CASE WHEN event_id % 5 = 4 THEN '99-Foo-2024 00:00:00 +0000'
    ELSE lpad(CAST(day(l2) AS STRING), 2, '0') || '-' || {pick("month(l2) - 1", _SHORT)} || '-'
      || CAST(year(l2) AS STRING) || ' ' || substr(CAST(l2 AS STRING), 12, 8) || ' +0200'
    END AS internal_text,
  CASE event_id % 6
    WHEN 0 THEN replace(replace(replace(substr(CAST(ts AS STRING), 1, 19), '-', ''), ':', ''), ' ', 'T') || 'Z'
    WHEN 5 THEN replace(substr(CAST(ts AS STRING), 1, 10), '-', '')
    ELSE replace(replace(replace(substr(CAST(ts AS STRING), 1, 19), '-', ''), ':', ''), ' ', 'T')
    END AS ics_value,
  CASE event_id % 6
    WHEN 1 THEN ';TZID=America/New_York' WHEN 2 THEN ';TZID=Nowhere/City'
    WHEN 5 THEN ';VALUE=DATE' ELSE '' END AS ics_params
FROM (SELECT event_id, ts, ts + INTERVAL '2' HOUR AS l2 FROM <<events>>) e
"""

VIEWS["profiles"] = """
SELECT 'gmail' AS provider, 'owner@gmail.example' AS account, 'gmail-main' AS label,
  'Sales Engineering' AS role
UNION ALL SELECT 'gmail', '', 'gmail-default', 'Marketing'
UNION ALL SELECT 'yahoo', '', 'yahoo-default', 'Product Management'
"""


def _expand(text: str, resolve) -> str:
    return re.sub(r"<<(\w+)>>", lambda m: resolve(m.group(1)), text)


class Views:
    """The given tables and the views over them for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._tag = hashlib.sha1(self.sf_dir.encode()).hexdigest()[:8]
        self._named: dict[str, str] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, name: str) -> str:
        if name in TABLES:
            if name not in self._named:
                alias = f"given_{name}_{self._tag}"
                self.table(name).createOrReplaceTempView(alias)
                self._named[name] = alias
            return self._named[name]
        return f"({_expand(VIEWS[name], self._sql)})"

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(_picks(_expand(text, self._sql), spark=True))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)


def oracle_text(text: str) -> str:
    """The comparison SQL with every view it uses as a CTE, dependencies first."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"<<(\w+)>>", sql):
            if name not in TABLES and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    def resolve(name: str) -> str:
        return name if name in TABLES else f"v_{name}"

    visit(text)
    ctes = [f"v_{n} AS ({_picks(_expand(VIEWS[n], resolve), spark=False)})" for n in needed]
    body = _expand(text, resolve).strip()
    if not ctes:
        return body
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(word):
            return word + ",\n".join(ctes) + ",\n" + body[len(word):]
    return "WITH " + ",\n".join(ctes) + "\n" + body
