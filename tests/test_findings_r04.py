"""Small cases that the fourth round's findings are about."""

from datetime import datetime

from pyspark.sql import functions as F

from casetrail.functions import text
from casetrail.operators import linkage, matching
from casetrail.plans import QUERIES
from tests.compare import duck, run_duck


def test_strip_html_reads_names_without_semicolons_as_its_sql_does(spark, tmp_path):
    pages = ["a &quot</h1> b", "a &quot;b&quot</h1>&amp</p>&am</p>&", "&ampquot; &ampx &quo; &copy</b>", "&amp;quot &amp;amp &middot;", ""]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names, want = run_duck(con, QUERIES["strip_html"].oracle)
    got = QUERIES["strip_html"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert rows.where("page_id = 0").select(text.html_unescape_strip("html")).first()[0] == 'a " b'


def test_the_rows_of_a_timeline_are_made_before_they_are_summed_up(spark):
    at = datetime(2024, 1, 2)
    companies = spark.createDataFrame([(i, "Aster", "g") for i in range(30)] + [(40, "Beacon", "h"), (41, None, None)],
                                      "id long, name string, normalized_name string")
    contacts = spark.createDataFrame([(i, f"n{i:02}" if i % 3 else None) for i in range(50)], "id long, name string")
    cc = contacts.select(F.col("id").alias("recruiter_id"), F.when(F.col("id") == 3, "h").otherwise("g").alias("normalized_company_name"),
                         F.lit(None).cast("timestamp_ntz").alias("last_seen_at"))
    interactions = spark.createDataFrame([(1, at, "email", "zz", 1), (9, at, "call", None, 0)], "company_id long, occurred_at timestamp_ntz, interaction_type string, summary string, immutable_evidence long")
    jobs = spark.createDataFrame([(5, "T", "ASTER"), (6, "U", "none")], "id long, title string, company string")
    applications = spark.createDataFrame([(3, 6, None, at)], "company_id long, job_id long, applied_at timestamp_ntz, created_at timestamp_ntz")
    interviews = spark.createDataFrame([(5, at, None, "panel"), (5, None, "x", "panel"), (6, at, "x", "panel")], "job_id long, scheduled_start timestamp_ntz, title string, interview_type string")
    imported = spark.createDataFrame([(5, at, "k"), (5, None, "l")], "job_id long, imported_at timestamp_ntz, classification string")
    offers = spark.createDataFrame([(2, None, at, "received")], "company_id long, offered_at timestamp_ntz, created_at timestamp_ntz, status string")
    tables = (companies, interactions, applications, interviews, imported, contacts, cc, offers, jobs)
    totals = linkage.company_timeline_totals(*tables)
    want = linkage.company_timeline(*tables).groupBy("company_id", "type").agg(
        F.count("*").alias("n"), F.max("occurred_at").alias("latest"), F.max("summary").alias("summary"), F.sum("immutable").alias("immutable"))
    rows = sorted(map(tuple, totals.select(want.columns).collect()), key=str)
    assert rows == sorted(map(tuple, want.collect()), key=str) and len(rows) == 94
    assert (1, "email", 3, at, "zz", 3) in rows and (1, "recruiter", 49, None, "n49", 49) in rows and (40, "recruiter", 1, None, None, 1) in rows
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_owner" not in plan


def test_jobs_of_one_requisition_are_not_paired_with_all_its_messages(spark):
    titles = ["Data Analyst", "Lead Data Engineer", "Fleet Analyst", "Data Analyst Fleet", ""]
    at = datetime(2024, 1, 1)
    m = spark.createDataFrame([
        (f"m{i:02}", "gmail" if i % 2 else "yahoo", f"Alpha {i} Works" if i % 5 else "Job 7 Firm Inc.", titles[i % 5 - i % 2], at.replace(day=1 + i % 28) if i % 7 else None,
         "x3" if i == 8 else "", "REQ-1" if i % 9 else "", "PM" if i % 4 == 0 else "") for i in range(200)],
        "message_identity string, account string, company string, title string, applied_at timestamp_ntz, job_ref string, requisition_id string, inferred_role string")
    j = spark.createDataFrame([
        (i, "gmail" if i % 3 else "", f"x{i}", "req-1" if i % 8 else "", f"Job {i} Firm" if i % 11 else "", titles[i % 5], at.replace(month=1 + i % 12, day=1 + i % 28), "PM" if i % 2 else "DS")
        for i in range(200)],
        "id long, email_account string, external_id string, requisition_id string, company string, title string, first_seen_at timestamp_ntz, role_family string")
    got = matching.match_applications(m, j).select("message_identity", "job_id", F.round("score", 6).alias("score")).collect()
    want = matching.brute_force(m, j).where("score > 0").select("message_identity", "job_id", F.round("score", 6).alias("score")).collect()
    strong = lambda rows: sorted(tuple(r) for r in rows if r.score >= 45)
    assert strong(got) == strong(want) and len(strong(got)) > 40
    profiles = [matching._profiles(*a).select(*matching._PROFILE, "profile").distinct() for a in (
        (m, "account", "company", "title", "requisition_id"), (j, "email_account", "company", "title", "requisition_id"))]
    assert matching._candidate_units(*profiles).count() < 25 * profiles[0].count()


def test_shuffles_of_a_stored_table_leave_the_disk(spark, tmp_path):
    import glob
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    shuffles = lambda: set(glob.glob(f"{folder}/*/shuffle_*"))
    before = shuffles()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    stored = matching._stored(rows, "kept")
    assert not shuffles() - before and sorted(stored.collect()) == sorted(rows.collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_messages_are_matched_once_for_the_jobs_they_fill_and_those_they_make(spark):
    jobs = "id long, external_id string, title string, company string, url string, email_account string, role_family string, applied_at timestamp_ntz, confirmation_id string, ats_platform string, requisition_id string, application_source string, import_confidence double, status string, resume_family string, source string, score double, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
    at = datetime(2024, 1, 2)
    j = spark.createDataFrame([(5, "x5", "T", "", "", "", "", None, "", "", "", "", 0.0, "new", "", "s", 1.0, at, at)], jobs)
    m = spark.createDataFrame([("v1:a", "gmail", "Aster", "T", at, "", "", "", "u", "", "m1"), ("v1:b", "gmail", "Beacon", "", None, "", "", "", "", "", "m2")],
                              "message_identity string, account string, company string, title string, applied_at timestamp_ntz, job_ref string, requisition_id string, inferred_role string, job_url string, ats_platform string, message_id string")
    matches = spark.createDataFrame([("v1:a", 5, 60.0, True)], "message_identity string, job_id long, score double, matched boolean")
    got = matching.apply_match(j, m, matches, None, "2024-02-01 00:00:00")
    rows = {r.external_id: r for r in got.collect()}
    assert (rows["x5"].company, rows["x5"].url, rows["x5"].import_confidence) == ("Aster", "u", 60.0)
    assert rows["email-gmail-b"].company == "Beacon" and len(rows) == 2
    assert any("matched-messages" in f for f in got.inputFiles())


def test_a_preview_is_taken_from_the_stored_best_matches(spark):
    got = QUERIES["import_preview"](spark, "/root/testdata/sf0.001")
    assert any("match-winners" in f for f in got.inputFiles())
    ids = [r.id for r in got.collect()]
    assert ids == sorted(ids) and len(ids) == 100
