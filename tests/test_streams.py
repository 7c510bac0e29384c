"""The interview stream over several triggers: late messages, threads that meet later, forgetting, all against the fold."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from casetrail.operators import interviews
from casetrail.session import scratch_path
from casetrail.streaming import ingest, stateful

SCHEMA = ("job_id long, message_identity string, observed_at timestamp_ntz, event_identifier string, meeting_url string, "
          "scheduled_start timestamp_ntz")
START = datetime(2026, 1, 1)


def streamed(spark, batches, **options):
    """The last assignment of every message after one trigger for each batch of rows."""
    path = scratch_path(spark, "landed")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = ingest.stream_messages(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    got = ingest.run_updates(stateful.stateful_interviews(stream, **options), "threads", ["message_identity"])
    return {r.message_identity: r.interview_key for r in got.collect()}


def folded(spark, rows):
    got = interviews.assign_interviews(spark.createDataFrame(rows, SCHEMA))
    return {r.message_identity: r.interview_key for r in got.collect()}


def message(n, day, event="", url="", start=None, job=1):
    return (job, f"m{n:03}", START + timedelta(days=day), event, url, start)


def test_late_messages_and_threads_that_meet_in_a_later_trigger(spark):
    first = [message(1, 0, url="u1"), message(2, 1, url="u2"), message(3, 2, event="e2", url="u2"), message(9, 2)]
    second = [message(4, 3, event="e3", url="u3"), message(5, 4, url="u1")]
    third = [message(6, 2.5, event="e3", url="u1"),              # late: m4 now belongs to the interview of u1
             message(7, 5, event="e2", url="u1"), message(8, 6, url="u3")]
    batches = [first, second, third]
    want = folded(spark, sum(batches, []))
    got = streamed(spark, batches, delay="5 days")
    assert got == want
    assert got["m004"] == got["m006"] == got["m001"] and got["m009"] == "m009"


def test_random_streams_equal_the_fold(spark):
    r = random.Random(5)
    rows = []
    for n in range(240):
        pick = lambda p, k: f"{p}{r.randrange(k)}" if r.random() < 0.4 else ""
        start = START + timedelta(days=r.randrange(9)) if r.random() < 0.3 else None
        rows.append((r.randrange(3), f"m{n:03}", START + timedelta(hours=7 * n), pick("e", 25), pick("u", 25), start))
    arrived = sorted(rows, key=lambda m: m[2] + timedelta(hours=r.randrange(48)))
    batches = [arrived[i:i + 60] for i in range(0, 240, 60)]
    assert streamed(spark, batches, delay="3 days") == folded(spark, rows)


def test_interviews_that_fall_silent_are_forgotten(spark):
    batches = [[message(1, 0, url="u")], [message(2, 40, url="other")], [message(3, 80, url="other")], [message(4, 81, url="u")]]
    got = streamed(spark, batches, delay="1 day", expiry_days=30)
    assert got["m004"] == "m004" and got["m002"] == "m002"
    kept = streamed(spark, batches, delay="1 day")
    assert kept["m004"] == "m001" and kept["m003"] == "m002"


def test_state_of_a_thread_is_bounded_by_what_is_alive():
    thread = stateful._Thread()
    for n in range(500):
        thread.open.append([n * stateful.DAY, f"m{n}", f"e{n}", f"u{n}", "", None])
        thread.fold((n - 5) * stateful.DAY, 20 * stateful.DAY)
    assert len(thread.open) <= 6 and len(thread.settled["opened"]) <= 26 and len(thread.stored()) < 20_000
    assert thread.named() == {f"{k}|{k}{n}" for n in range(474, 500) for k in "eu"}


def test_streams_without_messages(spark):
    assert streamed(spark, [[]]) == {}


def test_contact_and_phone_of_an_interview(spark):
    rows = [(1, "a", 1, None, "", "555 0100"), (1, "b", 2, 7, "", ""), (1, "c", 3, 8, "Hall 4", "555 0199")]
    df = spark.createDataFrame(rows, "job_id long, message_identity string, t int, recruiter_id long, location_text string, "
                                     "phone string").select(
        "*", F.lit("x").alias("meeting_url"), F.lit("").alias("event_identifier"), F.lit("invitation").alias("event_type"),
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("scheduled_start", "scheduled_end")],
        *[F.lit("").alias(c) for c in ("timezone", "location_type", "title", "interview_type")],
        F.expr("TIMESTAMP_NTZ'2027-01-01 00:00:00' + t * INTERVAL '1' DAY").alias("observed_at"))
    (one,) = interviews.fold_interviews(df).collect()
    assert (one.recruiter_id, one.location_text, one.first_source_message_identity) == (7, "Hall 4", "a")
    assert (one.created_at.day, one.updated_at.day, one.event_count) == (2, 4, 3)
    (two,) = interviews.fold_interviews(df.where("message_identity <> 'c'")).collect()
    assert two.location_text == "555 0100"
