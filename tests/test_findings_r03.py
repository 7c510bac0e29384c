"""Small cases that the third round's findings are about."""

import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from casetrail import fixed
from casetrail.llm import near_copies
from casetrail.functions import text
from casetrail.operators import candidates, dictionary, identity, linkage, matching, merge, quality
from casetrail.sources import mail, sinks


def test_timeline_totals_are_those_of_the_timeline_without_its_rows(spark):
    companies = spark.createDataFrame([(1, "Aster", "g"), (2, "aster", "g"), (3, "Beacon", "h")], "id long, name string, normalized_name string")
    at = datetime(2024, 1, 2)
    interactions = spark.createDataFrame([(1, at, "call", "a", 1), (9, at, "call", "b", 0), (None, at, "call", "c", 0)],
                                         "company_id long, occurred_at timestamp_ntz, interaction_type string, summary string, immutable_evidence long")
    jobs = spark.createDataFrame([(5, "T", "ASTER"), (6, "U", "none")], "id long, title string, company string")
    applications = spark.createDataFrame([(3, 6, None, at)], "company_id long, job_id long, applied_at timestamp_ntz, created_at timestamp_ntz")
    interviews = spark.createDataFrame([(5, at, None, "panel"), (6, at, "x", "panel")], "job_id long, scheduled_start timestamp_ntz, title string, interview_type string")
    imported = spark.createDataFrame([(5, at, "k"), (5, None, "l")], "job_id long, imported_at timestamp_ntz, classification string")
    contacts = spark.createDataFrame([(i, f"n{i:02}") for i in range(40)], "id long, name string")
    cc = contacts.select(F.col("id").alias("recruiter_id"), F.lit("g").alias("normalized_company_name"),
                         F.lit(None).cast("timestamp_ntz").alias("last_seen_at"))
    offers = spark.createDataFrame([(2, None, at, "received")], "company_id long, offered_at timestamp_ntz, created_at timestamp_ntz, status string")
    tables = (companies, interactions, applications, interviews, imported, contacts, cc, offers, jobs)
    totals = {(r.company_id, r.type): tuple(r)[2:] for r in linkage.company_timeline_totals(*tables).collect()}
    rows = linkage.company_timeline(*tables).groupBy("company_id", "type").agg(
        F.count("*").alias("n"), F.max("occurred_at"), F.max("summary"), F.sum("immutable")).collect()
    assert totals == {(r.company_id, r.type): tuple(r)[2:] for r in rows}
    assert totals[2, "recruiter"] == (40, None, "n39", 40) and totals[2, "interview"] == (1, at, "panel", 1)


def test_report_has_one_row_for_each_job_and_the_query_one_for_each_group(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "a,\"b"), (2, "a,\"b"), (3, "c"), (4, "c"), (5, "c"), (6, "d"), (7, "")], "id long, confirmation_id string")
    for name in (f for f in fixed.DUPLICATE_FIELDS if f not in jobs.columns):
        jobs = jobs.withColumn(name, F.lit('x "y", z'))
    path = str(tmp_path / "report")
    sinks.write_report_csv(identity.duplicate_groups(jobs), path)
    assert sinks.report_groups(spark, path).count() == 2
    assert {tuple(r) for r in sinks.report_groups(spark, path).collect()} == {("a,\"b", "2"), ("c", "3")}


def test_interview_view_gives_the_events_in_order(spark):
    at = [datetime(2024, 1, d) for d in (1, 2)]
    interviews = spark.createDataFrame([(1, 1, None), (2, 1, 7)], "id long, job_id long, recruiter_id long")
    jobs = spark.createDataFrame([(1, "t", "c")], "id long, title string, company string")
    contacts = spark.createDataFrame([(7, "n")], "id long, name string")
    events = spark.createDataFrame([(5, 1, "confirmation", at[1]), (4, 1, "invitation", at[1]), (9, 1, "first", at[0]), (1, None, "lost", at[0])],
                                   "id long, interview_id long, event_type string, occurred_at timestamp_ntz")
    got = {r.id: r for r in linkage.interview_view(interviews, jobs, contacts, events).collect()}
    assert [e.event_type for e in got[1].events] == ["first", "invitation", "confirmation"] and got[1].events_count == 3
    assert got[2].events is None and got[2].events_count == 0 and got[2].recruiter_name == "n"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_text_do_not_leave_its_row(spark):
    rows = [(1, "b a bb1 aaa zzz aaa C++ c++ .net\nwe require x"), (1, "b a bb1 aaa zzz aaa C++ c++ .net\nwe require x"), (2, ""), (3, None), (4, "zz9 zz9 zz8 zz8 zz7")]
    got = merge.describe_jobs(spark.createDataFrame(rows, "job_id long, raw_text string"), 3)
    assert "Window" not in plan(got) and "Join" not in plan(got)
    assert sorted((r.job_id, r.skills, r.requirements) for r in got.collect()) == [
        (1, ["aaa", "c++", ".net"], ["we require x"]), (2, [], []), (3, [], []), (4, ["zz8", "zz9", "zz7"], [])]


def test_best_jobs_are_combined_by_hashing(spark):
    rows = spark.createDataFrame([(1, 9, 70.5), (1, 4, 70.5), (1, 2, 35.0), (2, 3, 0.0)], "m long, id long, score double")
    best = matching._best(rows, ["m"], "id")
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in best.collect()) == [(1, 4, 70.5), (2, 3, 0.0)]


def test_the_role_of_a_text_is_looked_for_once(spark):
    rows = spark.createDataFrame([(1, "Sales Engineer", "", None, "", "Unmapped"), (2, "x", "", None, "Unknown", "D"), (3, "x", "y", "c c c", "Own", "D")],
                                 "message_identity long, subject string, text_body string, company string, role_family string, default_role string").withColumn("title", F.lit(""))
    found = spark.createDataFrame([], "message_identity long, company string")
    got = linkage.message_attribution(rows, found)
    assert plan(got.where("attributed_role <> ''")).count("product management") == 1
    assert [(r.attributed_role, r.role_source) for r in got.orderBy("message_identity").collect()] == [
        ("Sales Engineering", "explicit"), ("D (account default)", "default"), ("Own", "explicit")]


def test_keys_are_counted_by_hash_and_compared_whole(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1), ("b", None)], "k string, n long")
    got = quality.duplicate_key_groups({"t": (rows, ["k", "n"])})
    assert "xxhash64" in plan(got) and [tuple(r) for r in got.collect()] == [("t", 2)]


def test_messages_without_a_job_do_not_meet_in_one_task(spark):
    asked = spark.range(40).select(F.concat(F.lit("m"), "id").alias("message_identity"), F.when(F.col("id") < 3, F.col("id")).alias("job_id"))
    classified = asked.withColumn("classifier_version", F.lit("v1"))
    jobs = spark.createDataFrame([(0,), (1,)], "id long")
    links = spark.createDataFrame([("m5", 8, 0), ("m6", 7, 0)], "message_identity string, recruiter_id long, job_id long")
    events = spark.createDataFrame([("m9", 4), ("m8", None)], "message_identity string, interview_id long")
    got = quality.batch_verification(asked.select("message_identity").union(asked.select("message_identity")), asked, asked, classified, jobs, links,
                                     spark.createDataFrame([(7,)], "id long"), events, spark.createDataFrame([(3,)], "id long"), "v1")
    assert "_spread" in plan(got)
    rows = {r.message_identity: r for r in got.collect()}
    assert len(rows) == 40 and not rows["m2"].job_link_stable and not rows["m5"].recruiter_links_stable and not rows["m9"].interview_links_stable
    assert sum(r.represented for r in rows.values()) == 37


def test_parts_of_a_mail_are_read_step_by_step(spark):
    mail_text = "From: a@b\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nContent-Type: multipart/mixed; boundary=\"q.q\"\n\npre\n--q.q\nX-A: b\n\nplain\n--q.q\nContent-Type: text/html\nContent-Disposition: attachment;\n filename=x.htm\n\n<b>\n--q.q--\npost"
    df = spark.createDataFrame([(mail_text,), ("A: b\n\nno more",), (None,)], "t string").select(mail.message_parts(F.col("t")).alias("p"))
    assert plan(df).count("Content-Disposition") <= 2
    rows = [r.p for r in df.collect()]
    assert [(p.content_type, p.filename, p.body) for p in rows[0][1:]] == [("text/plain", "", "plain"), ("text/html", "x.htm", "<b>")]
    assert rows[1][0].body == "no more" and rows[1][0].content_type == "text/plain"


def test_trees_over_fingerprints_propose_near_copies(spark):
    words = [f"w{i * i % 997}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[:-1]), " ".join(reversed(words))]
    rows = spark.createDataFrame([(i, i, i, t) for i, t in enumerate(texts)], "_id long, _row long, _hash long, _text string")
    classes = near_copies._classes(rows)
    ids = {r["class"]: r["first"]["_id"] for r in classes.collect()}
    pairs = {frozenset((ids[r.x], ids[r.y])) for r in near_copies._tree_pairs(classes).collect() if r.x != r.y}
    assert pairs and all(3 not in p for p in pairs) and {0, 1, 2} == set().union(*pairs)


def test_only_letters_that_normalisation_changes_are_sent_to_python_and_in_small_batches(spark):
    settled = ["", "Grüße, GARÇON É", "ΑΣ Σας ΌΣΟΣ", "Привет „мир“ –", "日本語ガ 한국어", "\u0130", "\u13a0", "I\u2019m"]
    changed = ["e\u0301E\u0301", "\u1100\u1161\u11a8", "ﬁ\u00a0…", "ＡＢ１", "q\u0323\u0307\u0307\u0323", "\u1c89", "か\u3099", "№", "ſß\u1e9e"]
    df = spark.createDataFrame([(t,) for t in settled + changed], "t string")
    got = df.select("t", F.rlike("t", F.lit(text._UNSETTLED)).alias("sent"), text.folded("t").alias("f")).collect()
    assert [r.f for r in got] == [unicodedata.normalize("NFKC", t).casefold() for t in settled + changed]
    assert [r.sent for r in got] == [False] * len(settled) + [True] * len(changed)
    pages = mail.read_pages(spark.createDataFrame([("<p>É &amp; ﬁ</p>",), (None,)], "html string"))
    assert "ArrowEvalPython" not in plan(pages) and plan(pages).count("regexp_extract_all(html") == 1
    assert [r.text for r in pages.collect()] == ["é & fi", None]


def test_candidate_jobs_cut_a_posting_once_and_look_up_numbers(spark):
    jobs = spark.createDataFrame(
        [(i, "Aster Labs" if i < 8 else "Beacon Labs", f"Fleet Data Analyst {i % 4}") for i in range(16)] + [
            (18, "", "Fleet Lead"), (20, "", "Fleet Lead"), (21, None, None), (22, "Unknown company", "Fleet Data Lead"), (23, "", "Fleet Lead"),
            (24, "Unknown company", "Fleet Lead"), (25, "Unknown company", "Unknown role")], "id long, company string, title string")
    queue = spark.createDataFrame([
        ("a", "Aster Labs fleet data analyst", "x"), ("b", "fleet data analyst", "r@beacon-labs.com"), ("c", "unknown company: fleet lead", None),
        ("d", None, "aster"), ("e", "Aster Labs fleet data analyst", "x"), ("f", "unknown company unknown role", "y")],
        "message_identity string, subject string, sender string")
    got = candidates.candidate_jobs(queue, jobs)
    assert sorted(got.drop("rank").collect()) == sorted(candidates.brute_force(queue, jobs).select(got.columns).drop("rank").collect())
    assert "Join Inner, (key#" in plan(got) and "Join Inner, (pair#" in plan(got)


def test_summaries_are_computed_once(spark):
    rows = [(1, "Interview with Aster | x"), (2, "Lunch, then a screen at Beacon Labs"), (3, "Interview with Pat Owner"), (4, None), (4, "Dinner"), (None, "Interview with Cobalt")]
    events = spark.createDataFrame(rows, "id long, s string").repartition(2, "id").join(spark.range(9).withColumnRenamed("id", "n"), F.col("id") == F.col("n"), "left")
    companies = spark.createDataFrame([("Beacon Labs",), ("Beacon",)], "company string")
    got = dictionary.company_in_summary(events, companies, F.col("s"), "id", exclude_names=("Pat Owner",))
    assert "Range" not in plan(got)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(1, "Aster"), (2, "Beacon Labs"), (3, None), (4, None), (4, None), (None, "Cobalt")], key=str)
