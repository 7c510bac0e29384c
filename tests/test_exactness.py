"""Scalable plans against brute force, hot keys, order independence, stream against batch."""

import random

from pyspark.sql import functions as F

from casetrail.operators import candidates, dictionary, identity, interviews, linkage, matching
from casetrail.operators import quality as Q
from casetrail.plans.bindings import Views
from casetrail.plans.merge_queries import interview_stream
from casetrail.session import scratch_path
from casetrail.operators.ranking import numbered
from casetrail.streaming import ingest
from casetrail.streaming.stateful import stateful_interviews

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_matching_equals_brute_force(spark):
    rng = random.Random(7)
    firms = ["Acme Inc", "Acme Labs", "Labs", "Hot Corp", "Hot Corp", "Hot Corp", "Zed", ""]
    words = ["data", "engineer", "sales", "senior", "platform", "growth", "ml", "ops"]

    def title():
        return " ".join(rng.sample(words, rng.randint(0, 7)))

    def at():
        return f"2024-0{rng.randint(1, 4)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:00:00" if rng.random() < .9 else None

    jobs = [(i, rng.choice(["", "g", "y"]), f"x{i}" if i % 3 else "", rng.choice(["", "", "r1", "R2"]),
             rng.choice(firms), title(), at(), rng.choice(["", "A", "B"])) for i in range(300)]
    asks = [(f"v1:{i}", rng.choice(["g", "y"]), rng.choice(firms), title(), at(),
             rng.choice(["", "", f"x{rng.randint(0, 299)}"]), rng.choice(["", "", "R1", "r2"]),
             rng.choice(["", "A"])) for i in range(300)]
    j = spark.createDataFrame(jobs, "id long, email_account string, external_id string, requisition_id string, "
                                    "company string, title string, f string, role_family string").withColumn(
        "first_seen_at", F.col("f").cast("timestamp_ntz"))
    m = spark.createDataFrame(asks, "message_identity string, account string, company string, title string, a string, "
                                    "job_ref string, requisition_id string, inferred_role string").withColumn(
        "applied_at", F.col("a").cast("timestamp_ntz"))

    def shown(df):
        return rows(df.where("score >= 45").select("message_identity", "job_id", F.round("score", 6)))

    assert shown(matching.match_applications(m, j)) == shown(matching.brute_force(m, j))


def test_candidates_equal_brute_force_with_a_hot_company(spark):
    rng = random.Random(3)
    words = ["data", "product", "manager", "growth", "lead", "cloud", "sales"]

    def title():
        return " ".join(rng.sample(words, rng.randint(0, 5)))

    firms = ["Hot Labs"] * 5 + ["Acme", "Acme Labs", "", "Blue Grid"]
    j = spark.createDataFrame([(i, rng.choice(firms), title()) for i in range(400)],
                              "id long, company string, title string")
    q = spark.createDataFrame(
        [(f"m{i}", f"{rng.choice(firms)} {title()} interview", f"x@{rng.choice(['acme', 'labs', 'mail'])}.com")
         for i in range(120)], "message_identity string, subject string, sender string")
    assert rows(candidates.candidate_jobs(q, j)) == rows(candidates.brute_force(q, j).select(
        "message_identity", "id", "company", "title", "score", "reasons", "rank").select(
        *candidates.candidate_jobs(q, j).columns))


def test_rows_of_a_hot_key_are_numbered_over_several_tasks(spark):
    rows_in = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") > 6, F.col("id")).alias("k"),
                                       (-F.col("id")).alias("at"))
    got = numbered(rows_in, ["k"], ["at"])
    want, seen = {}, {}
    for k, at in sorted((r.k, r.at) for r in rows_in.collect() if r.k is not None):
        seen[k] = seen.get(k, 0) + 1
        want[k, at] = seen[k]
    assert {(r.k, r.at): r.position for r in got.collect()} == want
    jobs = spark.range(500).select("id", F.lit("same").alias("confirmation_id"), F.lit("c").alias("company"))
    group = identity.duplicate_groups(jobs, fields=("id", "company")).orderBy("position").collect()
    assert [(r.position, r.id, r.records) for r in group] == [(i + 1, str(i), 500) for i in range(500)]


def test_company_in_text_context_and_boundaries(spark):
    m = spark.createDataFrame([
        ("1", "A role at Ember & Oak, soon"), ("2", "An acmeish role"), ("3", "Join Acme Labs today"),
        ("4", "Acme is a company"), ("5", "the Acme marketing team")], "message_identity string, t string")
    names = spark.createDataFrame([("Acme",), ("Acme Labs",), ("Ember & Oak",)], "company string")
    got = {r.message_identity: r.company for r in dictionary.company_in_text(m, names, F.col("t")).collect()}
    assert got == {"1": "Ember & Oak", "3": "Acme Labs", "5": "Acme"}


def test_digest_ignores_order_but_not_content(spark):
    a = spark.range(100).withColumn("x", F.col("id") % 7)
    assert Q.digests_equal(a, a.orderBy(F.desc("id"))).first().equal
    assert not Q.digests_equal(a, a.withColumn("x", F.col("id") % 6)).first().equal


def test_missing_ids_across_buckets(spark):
    ids = spark.createDataFrame([(1,), (2,), (65534,), (65540,)], "uid long")
    got = [r.uid for r in Q.missing_ids(ids, "uid").orderBy("uid").collect()]
    assert got == [*range(3, 65534), *range(65535, 65540)]


def test_threads_of_a_hot_job_fold_like_one(spark):
    events = interview_stream(Views(spark, SF)).withColumn("job_id", F.lit(1).cast("bigint"))
    split = sorted(map(tuple, interviews.assign_interviews(events).select("message_identity", "interview_key").collect()))
    whole = interviews.Threads()
    ordered = events.select(
        "message_identity", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (
            "event_identifier", "meeting_url", "scheduled_start")], "observed_at").collect()
    ordered.sort(key=lambda r: (r.observed_at, r.message_identity))
    assert split == sorted((r.message_identity, whole.assign(*r[:4])) for r in ordered)


def test_a_long_chain_of_events_is_one_thread(spark):
    n = 500
    chain = spark.range(n).select(
        F.lit(1).cast("bigint").alias("job_id"), F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 4, "0")).alias(
            "message_identity"), F.concat(F.lit("e"), F.floor((F.col("id") + 1) / 2)).alias("event_identifier"),
        F.concat(F.lit("u"), F.floor(F.col("id") / 2)).alias("meeting_url"), F.lit("").alias("start_key"))
    assert interviews.split_threads(chain).select("thread").distinct().count() == 1


def test_interview_stream_equals_batch(spark):
    events = interview_stream(Views(spark, SF))
    path = scratch_path(spark, "events")
    events.write.parquet(path)
    stream = ingest.stream_messages(spark, path, spark.read.parquet(path).schema)
    got = ingest.run_available(stateful_interviews(stream), "threads")
    want = interviews.assign_interviews(events).select("message_identity", "interview_key")
    assert rows(got) == rows(want)
