"""Source, sink and streaming queries.  What they read is written by Spark from the given
tables, so their work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..operators import classify as C
from ..operators import identity as I
from ..operators import merge as U
from ..session import scratch_path, write_through
from ..sources import calendar, mail, sinks, tables
from ..streaming import ingest as R
from ..streaming.stateful import stateful_interviews
from .bindings import Views
from .merge_queries import FOLD_SQL, interview_stream
from .registry import query


def _lines(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").text(path)
    return path


_MBOX = """SELECT 'From box Thu Jan  1 00:00:00 2024
Message-ID: ' || message_id || '
Subject: ' || subject || '
From: ' || sender || '
Date: ' || mail_text || '
Content-Type: text/plain; charset=utf-8

' || body || '
' AS value FROM <<messages>> m JOIN (SELECT id AS sid, mail_text FROM <<stamps>>) s ON s.sid = m.id"""


@query("read_mbox", "S-01", r"""SELECT 'gmail' AS provider, message_id, trim(subject) AS subject, ltrim(sender) AS sender, trim(regexp_replace(body, '\s+', ' ', 'g')) AS body,
CASE s.kind WHEN 4 THEN NULL ELSE CAST(date_trunc('second', s.ts) AS VARCHAR) END AS received_at FROM <<messages>> m JOIN <<stamps>> s ON s.id = m.id""")
def read_mbox(v: Views) -> DataFrame:
    got = mail.read_mbox(v.spark, _lines(v.sql(_MBOX), "mbox"), " Gmail ")
    return got.select("provider", "message_id", F.rtrim("subject").alias("subject"), "sender", "body",
                      F.col("received_at").cast("string").alias("received_at"))


@query("read_message_json", "S-02", """SELECT message_id, subject, sender, CASE WHEN id % 3 = 0 THEN '' ELSE CAST(received_at AS VARCHAR) END AS received_at FROM <<messages>> WHERE id % 5 <> 0 AND (subject <> '' OR sender <> '')""")
def read_message_json(v: Views) -> DataFrame:
    m = v.messages
    empty = F.col("id") % 5 == 0
    record = F.struct(
        F.when(F.col("id") % 2 == 0, F.col("message_id")).otherwise(F.lit("")).alias("confirmation_message_id"),
        F.col("message_id"), F.when(~empty, F.col("subject")).alias("subject"),
        F.when(~empty, F.col("sender")).alias("sender"),
        F.when(F.col("id") % 3 != 0, F.concat(F.replace(F.col("received_at").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))).alias("received_at"))
    # one export file per thousand messages
    one = m.select(F.floor(F.col("id") / 1000).alias("k"), record.alias("r"))
    docs = one.groupBy("k").agg(F.to_json(F.struct(F.collect_list("r").alias("records"))).alias("value"))
    path = scratch_path(v.spark, "records")
    docs.write.partitionBy("k").text(path)
    got = mail.read_message_json(v.spark, path)
    return got.select("message_id", "subject", "sender", F.coalesce(F.col("received_at").cast("string"), F.lit("")).alias("received_at"))


_ICS = """SELECT 'BEGIN:VEVENT
UID:' || CAST(id AS STRING) || '
DTSTART' || ics_params || ':' || ics_value || '
SUMMARY:Interview with A' || chr(92) || ', B' || chr(92) || 'n part ' || CAST(id AS STRING) || '
  continued
STATUS:CONFIRMED
BEGIN:VALARM
DESCRIPTION:alarm
END:VALARM
END:VEVENT' AS value FROM <<stamps>>"""


@query("read_ics", "S-03", """SELECT CAST(id AS VARCHAR) AS uid, 'Interview with A, B  part ' || id || ' continued' AS summary, 'CONFIRMED' AS status, CAST(CASE id % 6 WHEN 0 THEN timezone('America/Los_Angeles', timezone('UTC', date_trunc('second', ts)))
 WHEN 1 THEN timezone('America/Los_Angeles', timezone('America/New_York', date_trunc('second', ts))) WHEN 5 THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('second', ts) END AS VARCHAR) AS started_at FROM <<stamps>>""")
def read_ics(v: Views) -> DataFrame:
    got = calendar.read_ics(v.spark, _lines(v.sql(_ICS), "ics"))
    return got.select("uid", "summary", "status", F.col("started_at").cast("string").alias("started_at"))


@query("read_activity_log", "S-04", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS applications FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1")
def read_activity_log(v: Views) -> DataFrame:
    serial = F.datediff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date"))
    counted = v.orders.groupBy(serial.alias("s"), (F.col("o_orderstatus") == "O").alias("open")).agg(F.count("*").alias("n"))
    rows = counted.select(F.concat(F.col("s").cast("string"), F.lit(".0,"), F.when(
        F.col("open"), F.lit("n/a")).otherwise(F.col("n").cast("string"))).alias("value"))
    got = tables.read_activity_log(v.spark, _lines(rows, "log"))
    return got.select(F.col("day").cast("string").alias("day"), "applications")


@query("read_table", "S-06", "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, CAST(NULL AS VARCHAR) AS o_comment FROM orders")
def read_table(v: Views) -> DataFrame:
    from pyspark.sql.types import StringType, StructType

    schema = StructType(v.orders.schema.fields).add("o_comment", StringType())
    return tables.read_table(v.spark, f"{v.sf_dir}/orders.parquet", schema).select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_comment")


# text nodes of a page in SQL: the pages use five references, and a lone ampersand
_REFERENCES = (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def _page_text(html: str) -> str:
    """SQL of the normalised text of a page (lower case, white space squeezed)."""
    decoded = "n"
    for name, char in _REFERENCES:
        decoded = f"regexp_replace({decoded}, '&{name};?', '{char}', 'g')"
    raw = "regexp_replace(n, '(?is)^<[^>]*>|</(?:script|style)\\s*>$', '', 'g')"
    nodes = f"regexp_extract_all({html}, '{mail._NODE}')"
    text = (f"CASE WHEN regexp_matches(n, '(?i)^<(?:script|style)\\b[^>]*>') THEN {raw} "
            f"WHEN regexp_matches(n, '(?is)^<[/!?a-z].*') AND NOT starts_with(n, '<![') THEN NULL ELSE {decoded} END")
    joined = f"array_to_string(list_transform({nodes}, lambda n: {text}), ' ')"
    return f"trim(regexp_replace(replace(lower({joined}), 'ß', 'ss'), '[\\s\u00a0]+', ' ', 'g'))"


@query("read_pages", "S-07", f"SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT page_id, {_page_text('html')} AS t FROM pages) q")
def read_pages(v: Views) -> DataFrame:
    return mail.read_pages(v.pages).select(
        "page_id", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"))


@query("write_jobs_csv", "S-08", """SELECT title, company, CAST(score AS VARCHAR) AS score, status FROM <<jobs>>""")
def write_jobs_csv(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "jobs-csv")
    sinks.write_jobs_csv(v.jobs, path)
    back = v.spark.read.option("header", True).csv(path)
    return back.select("title", F.coalesce("company", F.lit("")).alias("company"), "score", "status")


@query("write_report_csv", "S-09", "SELECT confirmation_id AS message_id, CAST(count(*) AS VARCHAR) AS records FROM <<jobs>> WHERE confirmation_id <> '' GROUP BY 1 HAVING count(*) > 1")
def write_report_csv(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "report-csv")
    sinks.write_report_csv(I.duplicate_groups(v.jobs), path)
    return sinks.report_groups(v.spark, path)


@query("snapshot", "S-10", "SELECT status, count(*) AS rows FROM <<applications>> GROUP BY 1")
def snapshot(v: Views) -> DataFrame:
    from ..operators.activity import counts_by

    path = scratch_path(v.spark, "snapshot")
    sinks.write_snapshot({"statuses": counts_by(v.applications, "status"),
                          "sources": counts_by(v.applications, "source")}, path)
    return sinks.load_snapshot(v.spark, path)["statuses"]


_RAW = """SELECT page_id, url, 'Subject: page
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=XX

--XX
Content-Type: text/' || CASE WHEN page_id % 3 = 0 THEN 'plain' ELSE 'html' END || '; charset=utf-8
Content-Transfer-Encoding: 8bit

' || html || '
--XX
Content-Type: application/pdf
Content-Disposition: attachment; filename=f' || CAST(page_id AS STRING) || '.pdf

x
--XX--
' AS raw FROM <<pages>>"""


@query("read_mime_parts", "S-11", f"""SELECT page_id, (page_id % 3 <> 0)::BIGINT AS fallback, 'f' || page_id || '.pdf' AS filename,
sha256(CASE WHEN page_id % 3 = 0 THEN trim(regexp_replace(replace(lower(html), 'ß', 'ss'), '\\s+', ' ', 'g')) ELSE {_page_text('html')} END) AS digest FROM pages""")
def read_mime_parts(v: Views) -> DataFrame:
    got = mail.read_mime_parts(v.sql(_RAW))
    return got.select("page_id", F.col("parts.html_fallback_used").cast("int").cast("bigint").alias("fallback"),
                      F.col("parts.attachments")[0]["filename"].alias("filename"),
                      F.sha2(F.col("parts.text"), 256).alias("digest"))


# --- streams --------------------------------------------------------------------------------------
def event_stream(v: Views) -> DataFrame:
    rows = R.stream_messages(v.spark, v.sf_dir, v.events.schema, "events.parquet")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_messages", "R-01", "SELECT event_id, user_id, event_type FROM events")
def stream_messages(v: Views) -> DataFrame:
    rows = event_stream(v).select("event_id", "user_id", "event_type")
    return R.run_available(rows, "stream-messages")


@query("dedupe_stream", "R-02", "SELECT DISTINCT user_id || '-' || event_type AS message_key FROM events")
def dedupe_stream(v: Views) -> DataFrame:
    rows = event_stream(v).withColumn("message_key", F.concat_ws("-", F.col("user_id"), F.col("event_type")))
    return R.run_available(
        R.dedupe_stream(rows, "message_key", "at", "3650 days").select("message_key"), "dedupe-stream")


@query("append_new", "R-02 Q-08", "SELECT DISTINCT user_id || '-' || event_type AS message_key FROM events")
def append_new(v: Views) -> DataFrame:
    rows = event_stream(v).select(F.concat_ws("-", F.col("user_id"), F.col("event_type")).alias("message_key"))
    table = scratch_path(v.spark, "append-new")
    write = R.append_new(v.spark, table, rows.schema, "message_key")
    for _ in range(2):   # the second pass adds nothing
        R.run_batches(rows, write, "append-new")
    return v.spark.read.parquet(table).select("message_key")


@query("contiguous_watermark", "R-03", """SELECT provider, account, CASE WHEN bool_or(failed) THEN greatest(5, min(CASE WHEN failed THEN uid END) - 1) ELSE greatest(5, max(uid)) END AS last_successful_uid, count(*) AS scanned_count, count_if(failed) AS failure_count FROM <<checkpoints>> GROUP BY provider, account""")
def contiguous_watermark(v: Views) -> DataFrame:
    old = v.checkpoints.select("provider", "account").distinct().withColumn("last_successful_uid", F.lit(5).cast("bigint"))
    return R.contiguous_watermark(v.checkpoints, ["provider", "account"], previous=old)


@query("contiguous_watermark_strict", "R-03", """SELECT provider, account, CASE WHEN bool_or(failed) THEN 5 ELSE greatest(5, max(uid)) END AS last_successful_uid, count(*) AS scanned_count, count_if(failed) AS failure_count FROM <<checkpoints>> GROUP BY provider, account""")
def contiguous_watermark_strict(v: Views) -> DataFrame:
    old = v.checkpoints.select("provider", "account").distinct().withColumn("last_successful_uid", F.lit(5).cast("bigint"))
    return R.contiguous_watermark(v.checkpoints, ["provider", "account"], previous=old, strict=True)


_CP = "(SELECT provider, account, 'inbox' AS folder, CAST(uid % 3 AS STRING) AS since_date, CAST(uid % 2 AS STRING) AS uidvalidity, uid, ts AS completed_at FROM <<checkpoints>>)"


@query("upsert_checkpoint", "R-04", f"SELECT provider, account, since_date, max(uid) AS uid FROM {_CP} q GROUP BY ALL")
def upsert_checkpoint(v: Views) -> DataFrame:
    rows = v.sql(_CP[1:-1])
    current = R.upsert_checkpoint(rows.limit(0), rows.where("uid % 2 = 0"))
    return R.upsert_checkpoint(current, rows.where("uid % 2 = 1")).select("provider", "account", "since_date", "uid")


@query("namespace_guard", "R-05", f"WITH c AS (SELECT provider, account, since_date, arg_max(uidvalidity, completed_at) AS u FROM {_CP} q WHERE uid % 5 < 3 GROUP BY ALL) SELECT q.uid FROM {_CP} q JOIN c ON c.provider = q.provider AND c.account = q.account AND c.since_date = q.since_date WHERE uid % 5 >= 3 AND u <> q.uidvalidity")
def namespace_guard(v: Views) -> DataFrame:
    rows = v.sql(_CP[1:-1])
    current = R.upsert_checkpoint(rows.limit(0), rows.where("uid % 5 < 3"))
    return R.namespace_guard(current, rows.where("uid % 5 >= 3"))[1].select("uid")


def landed_in_parts(events: DataFrame, parts: int, late_days: int) -> str:
    """Writes ``events`` as files that land one after another in order of time, but for messages that are late by up to
    ``late_days``; returns the folder."""
    path = scratch_path(events.sparkSession, "interview-events")
    events = write_through(events, "interview-messages")
    late = F.pmod(F.xxhash64("message_identity"), F.lit(late_days * 86_400))
    arrived = F.unix_timestamp(F.col("observed_at").cast("timestamp")) + late
    first, last = events.agg(F.min(arrived), F.max(arrived)).first()
    part = F.least(F.lit(parts - 1), F.floor((arrived - F.lit(first or 0)) * parts / F.lit((last or 0) - (first or 0) + 1)))
    for n in range(parts):   # one after another: a stream reads files in the order in which they land
        events.where(part == n).coalesce(1).write.mode("append").parquet(path)
    return path


@query("stateful_interviews", "R-06 J-08", f"{FOLD_SQL} SELECT message_identity, interview_key FROM assigned")
def stateful(v: Views) -> DataFrame:
    events = interview_stream(v)
    path = landed_in_parts(events, parts=4, late_days=2)
    stream = stateful_interviews(R.stream_messages(v.spark, path, events.schema, files_per_batch=1), delay="3 days")
    return R.run_updates(stream, "stateful", ["message_identity"])


@query("tumbling_counts", "R-07", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(v: Views) -> DataFrame:
    return R.run_available(R.tumbling_counts(event_stream(v), "at", ["event_type"]), "tumbling", "complete")


@query("sliding_counts", "R-08", """WITH d AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1), e AS (SELECT DISTINCT (d + k::INTEGER)::DATE AS x FROM d, range(30) r(k))
SELECT CAST(x AS VARCHAR) AS end_date, sum(n)::BIGINT AS n FROM e JOIN d ON d.d <= x AND d.d > x - 30 GROUP BY x""")
def sliding_counts(v: Views) -> DataFrame:
    return R.run_available(R.sliding_counts(event_stream(v), "at", 30), "sliding", "complete")


@query("late_and_repeat", "R-09", "SELECT user_id, CAST(min(ts) AS VARCHAR) AS first_seen_at, CAST(max(ts) AS VARCHAR) AS last_seen_at FROM events GROUP BY 1")
def late_and_repeat(v: Views) -> DataFrame:
    rows = v.events.select("user_id", F.concat(F.lit("e"), "event_id").alias("message_identity"), F.col("ts").alias("observed_at"), "event_id")
    empty = v.events.limit(0).select("user_id", F.lit("").alias("message_identity"), F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"))
    late = U.touch_links(empty, rows.where("event_id % 2 = 1"), ["user_id"])
    out = U.touch_links(late, rows.where("event_id % 2 = 0"), ["user_id"])
    again = U.touch_links(out, rows, ["user_id"])
    return again.select("user_id", F.least("first_seen_at", F.lit("9999-01-01").cast("timestamp_ntz")).alias("f"), "last_seen_at").join(
        rows.groupBy("user_id").agg(F.min("observed_at").alias("m")), "user_id").select(
        "user_id", F.least("f", "m").cast("string").alias("first_seen_at"), F.col("last_seen_at").cast("string").alias("last_seen_at"))


@query("scan_metrics", "R-10", """SELECT provider, count(*) AS processed, count_if(NOT failed) AS completed, count_if(failed) AS failed, min(uid) AS first_uid, max(uid) AS last_uid, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 3)::DOUBLE AS per_second FROM <<checkpoints>> GROUP BY 1""")
def scan_metrics(v: Views) -> DataFrame:
    return R.scan_metrics(v.checkpoints, ["provider"])


__all__ = ["C", "fixed"]
