"""Folding interview events into interviews.

An event belongs to the interview that an earlier event of the job with the same event id belongs
to, else to one that currently has its meeting link, else to one that currently starts when it
does, else to a new one.  Only this assignment needs the order of events; it is the small Python
step below.  What an interview looks like in the end is aggregated by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_empty
from ..session import write_through
from .classify import interview_status
from .components import component_roots

_KEYS = ("event_identifier", "meeting_url", "start_key")


class Threads:
    """Interviews so far, as far as later events can refer to them.

    ``opened`` orders interviews by their first message, so that the parts of two threads can be put together.
    """

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.by_event: dict[str, str] = dict(state.get("by_event", {}))
        self.opened: dict[str, tuple] = {k: tuple(v) for k, v in state.get("opened", {}).items()}
        self.touched: dict[str, object] = dict(state.get("touched", {}))
        self.current = {k: dict(state.get(k, {})) for k in ("url", "start")}
        self.holders: dict[str, dict[str, set[str]]] = {"url": {}, "start": {}}
        for kind, held in self.current.items():
            for interview, value in held.items():
                self.holders[kind].setdefault(value, set()).add(interview)

    def state(self) -> dict:
        return {"by_event": self.by_event, "opened": self.opened, "touched": self.touched, **self.current}

    def _holding(self, kind: str, value: str) -> str | None:
        held = self.holders[kind].get(value) if value else None
        return min(held, key=self.opened.__getitem__) if held else None

    def _set(self, kind: str, interview: str, value: str) -> None:
        old = self.current[kind].get(interview)
        if old is not None and value:
            self.holders[kind][old].discard(interview)
        if old is None or value:
            self.current[kind][interview] = value
            self.holders[kind].setdefault(value, set()).add(interview)

    def assign(self, identity: str, event: str, url: str, start: str, at: int | None = None) -> str:
        """The interview of the next event in order; ``at`` is its time where states are put together."""
        found = self.by_event.get(event) if event else None
        found = found or self._holding("url", url) or self._holding("start", start) or identity
        self.opened.setdefault(found, (len(self.opened) if at is None else at, identity))
        self.touched[found] = at
        if event:
            self.by_event.setdefault(event, found)
        self._set("url", found, url)
        self._set("start", found, start)
        return found

    def forget(self, interviews: set[str]) -> None:
        """Drops interviews that no later event is to find."""
        self.by_event = {e: k for e, k in self.by_event.items() if k not in interviews}
        for held in (self.opened, self.touched, *self.current.values()):
            for k in interviews:
                held.pop(k, None)
        for values in self.holders.values():
            for value in list(values):
                values[value] -= interviews
                if not values[value]:
                    del values[value]


def _assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams over events sorted by thread; holds the open thread only."""
    open_key, threads = None, Threads()
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            key = (row.job_id, row.thread)
            if key != open_key:
                open_key, threads = key, Threads()
            out.append(threads.assign(
                row.message_identity, row.event_identifier, row.meeting_url, row.start_key))
        yield pd.DataFrame({
            "message_identity": batch["message_identity"], "interview_key": out})


def split_threads(keyed: DataFrame) -> DataFrame:
    """Adds ``thread``: events of a job that share no event id, link or start, even through others, get different
    threads, so that a hot job is folded by many tasks.

    Threads are the connected components of messages and the values they name, whatever the size of the job; a chain
    of any length takes logarithmically many rounds. Messages and values go by 64-bit hashes: two that hash alike put
    their threads together, which is folded in order all the same. Values of one message connect nothing and stay out.
    """
    named = F.filter(F.array(*[F.when(F.col(k) != "", F.xxhash64("job_id", F.lit(k), F.col(k))) for k in _KEYS]),
                     lambda v: v.isNotNull())
    rows = keyed.withColumn("_node", F.xxhash64("job_id", F.lit("message"), "message_identity"))
    links = rows.select(F.col("_node").alias("a"), F.explode(named).alias("b"))
    shared = links.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b")
    roots = component_roots(links.join(shared, "b").select("a", "b")).withColumnRenamed("a", "_node")
    return rows.join(roots, "_node", "left").withColumn("thread", F.coalesce("root", "_node")).drop("_node", "root")


def assign_interviews(events: DataFrame) -> DataFrame:
    """``events`` of linked messages with ``interview_key`` (identity of the interview's first
    message)."""
    linked = write_through(events.where(F.col("job_id").isNotNull()).withColumns({
        "event_identifier": text_or_empty("event_identifier"),
        "meeting_url": text_or_empty("meeting_url"),
        "start_key": F.coalesce(F.col("scheduled_start").cast("string"), F.lit(""))}),
        "interview-events")   # read several times below
    bare = (F.col("event_identifier") == "") & (F.col("meeting_url") == "") & (
        F.col("start_key") == "")
    # an event without any key can neither match nor be matched
    alone = linked.where(bare).select("message_identity", F.col("message_identity").alias("interview_key"))
    keyed = linked.where(~bare).select("job_id", "message_identity", "observed_at", *_KEYS)
    ordered = split_threads(keyed).repartition("job_id", "thread").sortWithinPartitions(
        "job_id", "thread", "observed_at", "message_identity")
    assigned = ordered.select("job_id", "thread", "message_identity", *_KEYS).mapInPandas(
        _assign, "message_identity string, interview_key string")
    return linked.drop("start_key").join(assigned.unionByName(alone), "message_identity")


def interviews_from(assigned: DataFrame) -> DataFrame:
    """One row per interview: type of the first, contact of the first that has one, the rest as last said.

    The place is the location, else the phone number. ``phone`` and ``recruiter_id`` (the contact that the message was
    resolved to) may be missing from the events.
    """
    order = F.struct("observed_at", "message_identity")
    have = set(assigned.columns)
    place = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("location_text", "phone") if c in have])
    contact = F.col("recruiter_id") if "recruiter_id" in have else F.lit(None).cast("bigint")
    assigned = assigned.withColumns({"location_text": place, "recruiter_id": contact})

    def last(column: str) -> Column:
        filled = F.col(column).isNotNull() & (F.col(column).cast("string") != "")
        return F.max_by(column, F.when(filled, order)).alias(column)

    return assigned.groupBy("interview_key").agg(
        F.min("job_id").alias("job_id"),
        F.min_by("recruiter_id", F.when(F.col("recruiter_id").isNotNull(), order)).alias("recruiter_id"),
        F.min_by("interview_type", order).alias("interview_type"),
        F.max_by(interview_status("event_type"), order).alias("status"),
        *[last(c) for c in ("scheduled_start", "scheduled_end", "timezone", "location_type",
                            "location_text", "meeting_url", "title")],
        F.min_by("message_identity", order).alias("first_source_message_identity"),
        F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"),
        F.min("observed_at").alias("created_at"), F.max("observed_at").alias("updated_at"),
        F.count("*").alias("event_count"))


def fold_interviews(events: DataFrame) -> DataFrame:
    return interviews_from(assign_interviews(events))
