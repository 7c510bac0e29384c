"""Interview assignment over a stream of interview messages, with late messages put in their place.

The state of a job is keyed by thread: interviews that share no event id, link or start, even through others, never meet,
so a trigger reads and writes only the threads that its messages name. A message that names values of several threads
puts them together (every value of the smaller roots leads to the one root from then on). Within a thread, messages that are not older than the watermark
stay open: a late one is put in order, the open part is folded again, and assignments that change are given again. Older
ones are folded into the thread for good. Interviews that no message has touched for ``expiry`` before the watermark are
forgotten by a timer, and their thread with the last of them, so that state is bounded by what is alive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import text_or_empty
from ..operators.interviews import Threads

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "message_identity string, interview_key string"
DAY = 86_400_000_000


class _Thread:
    """One thread as stored: what is settled, open messages as [time, identity, event, link, start, interview], values.

    Times are microseconds.
    """

    def __init__(self, stored: str | None = None):
        held = json.loads(stored) if stored else {}
        self.settled: dict = held.get("settled", {})
        self.open: list[list] = held.get("open", [])
        self.values: set[str] = set(held.get("values", ()))

    def stored(self) -> str:
        return json.dumps({"settled": self.settled, "open": self.open, "values": sorted(self.values)})

    def join(self, other: _Thread) -> None:
        for kind, held in other.settled.items():
            self.settled.setdefault(kind, {}).update(held)
        self.open += other.open
        self.values |= other.values

    def fold(self, watermark: int, expiry: int) -> list[tuple[str, str]]:
        """Folds the open messages in order; returns (identity, interview) of those that are new or have changed."""
        self.open.sort(key=lambda m: m[:2])
        done = sum(m[0] < watermark for m in self.open)
        threads, settled, changed = Threads(self.settled), None, []
        for n, message in enumerate(self.open):
            if n == done:
                settled = json.loads(json.dumps(threads.state()))
            at, identity, event, url, start, known = message
            found = threads.assign(identity, event, url, start, at)
            if found != known:
                message[5] = found
                changed.append((identity, found))
        self.settled = threads.state() if settled is None else settled
        self.open = self.open[done:]
        self.forget(watermark - expiry)
        return changed

    def forget(self, before: int) -> None:
        settled = Threads(self.settled)
        gone = {k for k, at in settled.touched.items() if at < before}
        if gone:
            settled.forget(gone)
            self.settled = settled.state()

    def alive(self) -> bool:
        return bool(self.open or self.settled.get("opened"))

    def last(self) -> int:
        return max([*(m[0] for m in self.open), *self.settled.get("touched", {}).values()])

    def named(self) -> set[str]:
        """Values that a later message can meet: those of living interviews and of open messages."""
        now = Threads(self.settled)
        values = {f"e|{e}" for e in now.by_event}
        for kind, mark in (("url", "u"), ("start", "s")):
            values |= {f"{mark}|{v}" for v in now.current[kind].values() if v}
        return values | {v for m in self.open for v in _values(*m[2:5])}


def _values(event: str, url: str, start: str) -> list[str]:
    return [f"{mark}|{value}" for mark, value in (("e", event), ("u", url), ("s", start)) if value]


class InterviewThreads(StatefulProcessor):
    """Threads of one job: ``parent`` leads from a named value to the thread that holds it."""

    def __init__(self, expiry_days: int):
        self.expiry = expiry_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parent = handle.getMapState("parent", "node string", "parent string")
        self.threads = handle.getMapState("threads", "root string", "thread string")

    def _root(self, node: str) -> str | None:
        """The thread of a named value, remembered for the rest of the trigger."""
        if node not in self.seen:
            self.seen[node] = self.parent.getValue((node,))[0] if self.parent.containsKey((node,)) else None
        return self.seen[node]

    def _lead(self, node: str, root: str | None) -> None:
        self.seen[node] = root
        self.moved.add(node)

    def _load(self, root: str) -> _Thread:
        return _Thread(self.threads.getValue((root,))[0] if self.threads.containsKey((root,)) else None)

    def _store(self, root: str, thread: _Thread) -> None:
        named = thread.named() if thread.alive() else set()
        for value in thread.values - named:
            self._lead(value, None)
        thread.values = named
        if named or thread.open:
            self.threads.updateValue((root,), (thread.stored(),))
        elif self.threads.containsKey((root,)):
            self.threads.removeKey((root,))

    def _flush(self) -> None:
        for node in self.moved:
            if self.seen[node] is not None:
                self.parent.updateValue((node,), (self.seen[node],))
            elif self.parent.containsKey((node,)):
                self.parent.removeKey((node,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark, loaded, out = timerValues.getCurrentWatermarkInMs() * 1000, {}, []
        self.seen, self.moved = {}, set()
        for batch in rows:
            for r in batch.itertuples(index=False):
                named = _values(r.event_identifier, r.meeting_url, r.start_key)
                if not named:   # can neither match nor be matched
                    out.append((r.message_identity, r.message_identity))
                    continue
                roots = sorted({root for v in named if (root := self._root(v))})
                root = roots[0] if roots else f"t|{r.message_identity}"
                for each in roots or [root]:
                    if each not in loaded:
                        loaded[each] = self._load(each)
                thread = loaded[root]
                for other in roots[1:]:
                    joined = loaded.pop(other)
                    thread.join(joined)
                    for value in joined.values:   # each value leads straight to its thread, so none goes astray
                        self._lead(value, root)
                    if self.threads.containsKey((other,)):
                        self.threads.removeKey((other,))
                thread.values.update(named)
                for value in named:
                    self._lead(value, root)
                thread.open.append([int(r.at_us), r.message_identity, r.event_identifier, r.meeting_url, r.start_key, None])
        for root, thread in loaded.items():
            out += thread.fold(watermark, self.expiry)
            if thread.alive():   # one timer a day at most
                self.handle.registerTimer(((thread.last() + self.expiry) // DAY + 1) * DAY // 1000)
            self._store(root, thread)
        self._flush()
        if out:
            yield pd.DataFrame(out, columns=["message_identity", "interview_key"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self.seen, self.moved = {}, set()
        stored = [(root[0], thread[0]) for root, thread in self.threads.iterator()]
        for root, text in stored:
            thread = _Thread(text)
            if thread.last() + self.expiry < watermark:
                thread.fold(watermark, self.expiry)
                self._store(root, thread)
        self._flush()
        return iter([])

    def close(self) -> None:
        pass


def stateful_interviews(events: DataFrame, delay: str = "7 days", expiry_days: int = 3650) -> DataFrame:
    """(message_identity, interview_key) for a stream of linked interview messages, in update mode: the last row of a
    message counts.

    Messages may be late by ``delay``; those that are later are dropped by the watermark. With ``expiry_days`` above the
    longest silence of an interview the result is that of the batch fold.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = events.where(F.col("job_id").isNotNull()).select(
        "job_id", "message_identity", F.col("observed_at").cast("timestamp").alias("observed_at"),
        text_or_empty("event_identifier").alias("event_identifier"),
        text_or_empty("meeting_url").alias("meeting_url"),
        F.coalesce(F.col("scheduled_start").cast("string"), F.lit("")).alias("start_key"))
    keyed = keyed.withColumn("at_us", F.unix_micros("observed_at")).withWatermark("observed_at", delay)
    return keyed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=InterviewThreads(expiry_days), outputStructType=OUTPUT, outputMode="Update",
        timeMode="EventTime")
