"""Cases with known results."""

from datetime import datetime

from pyspark.sql import functions as F

from casetrail import fixed
from casetrail.functions import dates as D
from casetrail.functions import extract as X
from casetrail.functions import text as T
from casetrail.operators import activity as A
from casetrail.operators import classify as C
from casetrail.operators import candidates, funnel, identity, interviews, merge
from casetrail.sources import calendar, mail


def values(spark, make, *inputs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_one_case_per_message_type(spark):
    rows = []
    for kind, confidence, phrases in fixed.CLASSIFICATION_RULES:
        rows += [(kind, confidence, f"About: {p.upper()}!", "hello") for p in phrases]
        rows.append((kind, confidence, "hello", f"We say\n {phrases[0].replace(' ', '   ')} ."))
    rows.append(("UNKNOWN", 0.0, "Receipt", "Your monthly receipt is attached."))
    df = spark.createDataFrame(rows, "expected string, c double, subject string, body string")
    got = C.classify(df.withColumn("sender", F.lit("a@b.c"))).where(
        "expected <> classification OR c <> confidence")
    assert got.collect() == []


def test_reasons_name_field_and_phrase_in_order(spark):
    df = spark.createDataFrame(
        [("Offer expired", "your OFFER HAS EXPIRED; offer expired", "x@y.z")],
        "subject string, body string, sender string")
    assert C.classify(df).first().reasons == [
        'body contains "offer has expired"', 'subject contains "offer expired"',
        'body contains "offer expired"']


def test_full_width_text_is_classified(spark):
    df = spark.createDataFrame([("Ｏｆｆｅｒ letter", "", "")],
                               "subject string, body string, sender string")
    assert C.classify(df).first().classification == "OFFER"


def test_normalisation(spark):
    assert values(spark, T.normalize_text, " A\tB  Straße ", None, "ﬁne") == ["a b strasse", "", "fine"]
    assert values(spark, T.normalize_message_id, " < A b@C >", "<<x>>") == ["ab@c", "<x>"]
    assert values(spark, T.normalize_company_contact, "Smith & Co., Inc.") == ["smith &"]
    assert values(spark, T.normalize_company_match, "Example Company, LLC") == ["example"]
    assert values(spark, T.normalize_company_entity, "Inca Corp. Inc") == ["inca"]
    assert values(spark, T.html_unescape_strip, "a&#233;&amp;lt;<b>x</b>&nbsp; y") == ["aé&lt; x y"]
    assert values(spark, T.clean_title, "the position of Data Engineer at Acme. More") == ["Data Engineer"]


def test_schedule_one_thirty_est_for_sixty_minutes(spark):
    df = spark.createDataFrame([
        ("on January 22, 2027 at 1:30 PM EST for 60 minutes",), ("Jan 3, 2027 at 19:75 PM UTC",),
        ("on 2027-01-26 at 2:00 PM.",)], "t string")
    a, b, c = [r.schedule for r in D.with_schedule(df, "t").collect()]
    assert (a.local_start, a.local_end) == ("2027-01-22T13:30:00", "2027-01-22T14:30:00")
    assert (a.start_utc, a.end_utc) == (datetime(2027, 1, 22, 18, 30), datetime(2027, 1, 22, 19, 30))
    assert b.start_utc is None and b.ambiguity in (
        [fixed.AMBIGUITY_UNPARSED], [])
    assert c.start_utc is None and c.ambiguity == [fixed.AMBIGUITY_NO_ZONE]


def test_elapsed_days_floor_before_abs(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 00:00:00' a, TIMESTAMP_NTZ'2024-01-01 12:00:00' b")
    assert tuple(df.select(D.elapsed_days("a", "b"), D.elapsed_days("b", "a")).first()) == (0, 1)


def test_rates(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (1, 4)], "n long, d long")
    got = df.select(funnel.rate("n", "d"), funnel.rate_or_null("n", "d"), funnel.change("n", "d"),
                    funnel.change_or_null("n", "d")).collect()
    assert [tuple(r) for r in got] == [
        (0.0, None, 0.0, None), (0.0, None, None, None), (25.0, 25.0, -75.0, -75.0)]


def test_contact_extraction(spark):
    df = spark.createDataFrame([
        ("RECRUITER_OUTREACH", "Jo Doe <Jo.Doe@bigmail.com>", "A role at Bigmail LLC",
         "Your background caught my attention.\nSenior Recruiter"),
        ("RECRUITER_REPLY", "Al Fox <al@agency.com>", "Following up from Sample, Inc.",
         "Thanks for getting back.\nLead Sourcer"),
        ("RECRUITER_REPLY", "noreply@agency.com", "x", "y")],
        "classification string, sender string, subject string, body string")
    got = [r.contact for r in C.recruiter_evidence(df).orderBy("sender").collect()]
    assert [(c.normalized_email, c.normalized_company, c.title, c.relationship_type) for c in got] == [
        ("al@agency.com", "sample", "Lead Sourcer", "sourcer"),
        ("jo.doe@bigmail.com", "bigmail", "Senior Recruiter", "unknown")]


def test_candidate_scores_94(spark):
    queue = spark.createDataFrame(
        [("m", "Acme Product Manager interview invitation", "recruiting@acme.com")],
        "message_identity string, subject string, sender string")
    jobs = spark.createDataFrame([(7, "Acme", "Product Manager"), (8, "Other Company", "Marketing Manager")],
                                 "id long, company string, title string")
    (row,) = candidates.candidate_jobs(queue, jobs).collect()
    assert (row.id, row.score, row.reasons) == (
        7, 94, ["company name in subject", "role terms in subject"])


def test_funnel_collapses_duplicates_and_ignores_saved(spark):
    jobs = spark.createDataFrame([
        (1, "j1", "Example Corp", "interview", "email", "hotmail", "Product", "2026-07-15", "2026-08-01", "same"),
        (2, "j2", "example corp", "interview", "board", "", "Product", None, "2026-08-02", ""),
        (3, "j3", "Example Corp", "interview", "email", "hotmail", "Product", "2026-07-15", "2026-08-01", "same"),
        (4, "j4", "Example Corp", "saved", "board", "", "Product", "2026-07-16", "2026-07-16", ""),
    ], "id long, external_id string, company string, status string, source string, email_account string, "
       "role_family string, applied_at string, first_seen_at string, confirmation_id string")
    jobs = jobs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("applied_at", "first_seen_at")})
    evidence = spark.createDataFrame([
        (1, "INTERVIEW_INVITATION", "2026-07-20"), (1, "INTERVIEW_CONFIRMATION", "2026-07-21"),
        (None, "INTERVIEW_INVITATION", "2026-07-22")], "job_id long, classification string, at string")
    evidence = evidence.withColumn("occurred_at", F.col("at").cast("timestamp_ntz"))
    records = funnel.outcome_records(evidence)
    facts = funnel.application_facts(identity.application_members(jobs), records)
    total = funnel.overview_totals(facts).first()
    assert (total.applications, total.recruiter_replies, total.interviews) == (2, 1, 1)
    assert (total.raw_application_stage_rows, total.collapsed_duplicate_or_overlapping_rows,
            total.undated_applications) == (3, 1, 1)
    months = {r.period: r for r in funnel.timeline(facts, datetime(2026, 8, 8)).collect()}
    assert months["2026-07"].applications == 1
    assert (months["2026-08"].applications, months["2026-08"].records_imported) == (0, 1)
    (company,) = funnel.grouped_funnel(facts, "company").collect()
    assert company.company == "Example Corp" and company.interview_rate == 50.0
    assert company.last_activity == datetime(2026, 7, 21)


def test_invite_confirm_reschedule_cancel_is_one_interview(spark):
    url = "https://zoom.us/j/1"
    rows = [("a", 1, "invitation", url, "2027-01-20 18:00:00"), ("b", 2, "confirmation", url, "2027-01-20 18:00:00"),
            ("c", 3, "reschedule", url, "2027-01-21 19:00:00"), ("d", 4, "cancellation", url, None),
            ("e", 5, "invitation", "", None)]
    df = spark.createDataFrame(rows, "message_identity string, t int, event_type string, meeting_url string, s string")
    df = df.select("message_identity", F.lit(9).cast("bigint").alias("job_id"), "event_type", "meeting_url",
                   F.lit("").alias("event_identifier"), F.col("s").cast("timestamp_ntz").alias("scheduled_start"),
                   F.lit(None).cast("timestamp_ntz").alias("scheduled_end"), F.lit("").alias("timezone"),
                   F.lit("video").alias("location_type"), F.lit("").alias("location_text"), F.lit("t").alias("title"),
                   F.lit("technical").alias("interview_type"),
                   F.expr("TIMESTAMP_NTZ'2027-01-01 00:00:00' + t * INTERVAL '1' DAY").alias("observed_at"))
    got = {r.interview_key: r for r in interviews.fold_interviews(df).collect()}
    assert sorted(got) == ["a", "e"]
    assert (got["a"].status, got["a"].event_count) == ("cancelled", 4)
    assert got["a"].scheduled_start == datetime(2027, 1, 21, 19)


def test_ledger_twice_creates_nothing(spark):
    source = spark.createDataFrame([(1, "x", "T", "C", "applied", "linkedin", "2026-01-01"),
                                    (2, "y", "T", "C", "applied", "linkedin", None)],
                                   "id long, external_id string, title string, company string, status string, source string, a string")
    source = source.withColumns({"applied_at": F.col("a").cast("timestamp_ntz"),
                                 "first_seen_at": F.lit("2026-02-01").cast("timestamp_ntz")})
    target = spark.createDataFrame([], "id long, external_id string, title string, company string, status string, "
                                       "source string, applied_at timestamp_ntz, application_source string")
    jobs, report = merge.reconcile_ledger(source, target)
    assert report.first().created == 2
    _, again = merge.reconcile_ledger(source, jobs.withColumn("id", F.xxhash64("external_id")))
    assert (again.first().created, again.first().already_reconciled) == (0, 2)


ICS = """BEGIN:VCALENDAR\r
BEGIN:VEVENT\r
DTSTART;TZID=America/Los_Angeles:20240715T090000\r
SUMMARY:Interview\\, with\r
  Acme\r
END:VEVENT\r
BEGIN:VEVENT\r
DTSTART:20240901T020000Z\r
SUMMARY:Recruiter call\r
END:VEVENT\r
BEGIN:VEVENT\r
DTSTART:20240802T100000\r
SUMMARY:Talent team chat\r
END:VEVENT\r
BEGIN:VEVENT\r
DTSTART;VALUE=DATE:20240803\r
SUMMARY:EDD interview\r
END:VEVENT\r
BEGIN:VEVENT\r
DTSTART:20240804T100000\r
SUMMARY:Interview\r
STATUS:CANCELLED\r
END:VEVENT\r
END:VCALENDAR\r
"""


def test_calendar(spark, tmp_path):
    (tmp_path / "c.ics").write_bytes(ICS.encode())
    events = calendar.read_ics(spark, str(tmp_path))
    got = {r.bucket: r["count"] for r in C.calendar_buckets(
        events, "2024-07-01", "2024-09-30").groupBy("bucket").count().collect()}
    assert got == {"interview": 2, "ambiguous": 1, "excluded": 1, "cancelled": 1}
    review = A.calendar_review(C.calendar_buckets(events, "2024-07-01", "2024-09-30"),
                               "2024-07-01", "2024-09-30").orderBy("period").collect()
    assert [r.interviews for r in review] == [1, 1, 0]
    assert events.where("summary = 'Interview, with Acme'").count() == 1


def test_mbox_keeps_bad_bytes_and_separators(spark, tmp_path):
    (tmp_path / "a.mbox").write_bytes(
        b"From a\r\nMessage-ID: <1@x>\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nFrom: A <a@x.org>\r\n"
        b"Date: Tue, 2 Jan 2024 10:00:00 +0200\r\n\r\nHi &amp; <b>bye</b>\r\n\r\n"
        b"From b\nSubject: two\nContent-Type: text/plain; charset=latin-1\n\ncaf\xe9\n")
    one, two = mail.read_mbox(spark, str(tmp_path), "Gmail").orderBy("message_id", ascending=False).collect()
    assert (one.subject, one.body, one.received_at) == ("café", "Hi & bye", datetime(2024, 1, 2, 8))
    assert (two.subject, two.body, two.error) == ("two", "café", None)


def test_html_text(spark):
    got = values(spark, mail.html_text, "<p>kept <![e broken]> text</p>", "a<b title='x'>c</b>&amp;lt;<!-- gone > -->d < e",
                 "<script>if (a<b) x('</p>')</script >after", "", "<br/><!DOCTYPE html><?php x?>")
    assert [" ".join(t.split()) for t in got] == [
        "kept < ![e broken]> text", "a c &lt; d < e", "if (a<b) x('</p>') after", "", ""]


def test_mime_with_nested_parts_and_encodings(spark):
    raw = (b"Subject: x\r\nContent-Type: multipart/mixed; boundary=\"a b\"\r\n\r\nignored\r\n--a b\r\n"
           b"Content-Type: multipart/alternative;\r\n boundary=in\r\n\r\n--in\r\n"
           b"Content-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"
           b"PGI+Q2Fmw6k8L2I+\r\n--in\r\nContent-Type: text/plain; charset=iso-8859-1\r\n"
           b"Content-Transfer-Encoding: quoted-printable\r\n\r\nCaf=E9 =\r\nNoir=20=3D\r\n--in--\r\n--a b\r\n"
           b"Content-Type: application/pdf; name=\"=?utf-8?q?r=C3=A9sum=C3=A9?=.pdf\"\r\n"
           b"Content-Disposition: attachment\r\n\r\nx\r\n--a b--\r\n")
    got = mail.read_mime_parts(spark.createDataFrame([(raw,), (b"Subject: y\n\nPlain  Body",), (None,)], "raw binary"))
    one, two, three = [r.parts for r in got.collect()]
    assert (one.text, one.html_fallback_used) == ("café noir =", False)
    assert [tuple(a) for a in one.attachments] == [("résumé.pdf", "application/pdf", "attachment")]
    assert (two.text, two.attachments) == ("plain body", []) and three.text in ("", None)


def test_references_and_folding(spark):
    import html

    texts = ["&#x2019;&ntilde;&times;&#128;&#0;&#38;lt;", "&notit; &amp &ampx &nosuch; &#xD800; &#1114112; &#00065;x", "&&amp;&#;",
             "&lt&gt;&hellip;&NotEqualTilde;&#11;&#x7f;&#xfdd0;", "a & b &copy2"]
    assert values(spark, T.html_unescape, *texts) == [html.unescape(t) for t in texts]
    words = ["Straße ﬁx Ⅳ ŉ ΣΑΣ ſ", "İstanbul ß", "plain", "ᾳ ΐ ﬃ", ""]
    assert values(spark, T.casefold, *words) == [w.casefold() for w in words]


def test_address_forms(spark):
    got = values(spark, T.parse_address, "a@b.c (Pat Doe)", '"Doe, Pat" <p@d.e>', " x@y.z ", "(only) text", "")
    assert [tuple(g) for g in got] == [("Pat Doe", "a@b.c"), ("Doe, Pat", "p@d.e"), ("", "x@y.z"), ("", "(only) text"), ("", "")]
    df = spark.createDataFrame([('"me@home.x" <a@B.c>, d@e.f', '"q\\"@z" <g@h.i>')], "t string, c string")
    assert df.select(T.recipients("t", "c")).first()[0] == ["a@b.c", "d@e.f", "g@h.i"]


def test_lookups_with_repeated_keys_do_not_multiply(spark):
    df = spark.createDataFrame([("Acme Inc",)], "company string")
    aliases = spark.createDataFrame([("acme inc", "B"), ("acme inc", "A")], "normalized_alias string, canonical_name string")
    assert [r.display_company for r in merge.apply_aliases(df, aliases).collect()] == ["A"]


def test_identities_of_other_scripts(spark):
    import hashlib
    import json
    import unicodedata

    def fold(v):
        return " ".join(unicodedata.normalize("NFKC", v).casefold().split())

    rows = [("Entwürfe", "Ä@x"), ("😀 \x07\x08 ﬁ", "日本"), ('q"\\', "INBOX")]
    df = spark.createDataFrame(rows, "folder string, account string")
    got = [r[0] for r in df.select(identity.transport_identity(
        F.lit("Yahoo"), "account", "folder", F.lit("7"), F.lit(3).cast("bigint"))).collect()]
    assert got == ["v1:" + hashlib.sha256(json.dumps({
        "account_namespace": fold(a), "folder": fold(f), "kind": "imap-uid", "provider": "yahoo", "uid": 3,
        "uidvalidity": "7"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for f, a in rows]


def test_first_of_new_messages_by_two_keys(spark):
    batch = spark.createDataFrame([("a", 1, 5), ("a", 1, 3), ("a", 2, 9), ("b", 1, 1)], "k string, v int, at int")
    known = spark.createDataFrame([("b", 1)], "k string, v int")
    got = {tuple(r) for r in identity.new_only(batch, known, ["k", "v"], ["at"]).collect()}
    assert got == {("a", 1, 3), ("a", 2, 9)}


def test_identity_matches_json_of_the_fields(spark):
    import hashlib
    import json

    df = spark.createDataFrame([(' G"m ', "", "S\\x", "Señor", "b")],
                               "p string, m string, s string, f string, b string")
    got = df.select(identity.message_identity("p", "m", "s", "f", F.lit(None).cast("timestamp_ntz"), "b")).first()[0]
    doc = {"body": "b", "kind": "content", "provider": 'g"m', "received_at": "", "sender": "señor", "subject": "s\\x"}
    text = json.dumps(doc, sort_keys=True, separators=(",", ":"))
    assert got == "v1:" + hashlib.sha256(text.encode()).hexdigest()


def test_posting_text(spark):
    got = values(spark, X.applicant_count, "Over 1,200 applicants", "be first", "31 people clicked apply")
    assert [(g["count"], g.is_over) for g in got] == [(1200, True), (None, False), (31, False)]
