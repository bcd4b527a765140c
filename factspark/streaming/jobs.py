"""Structured Streaming forms of the session, usage and change facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factspark.functions.text import text_blocks, trimmed
from factspark.operators.artifacts import invalidate
from factspark.session import cut_lineage
from factspark.sources import store

LIFE = "30 minutes"
DAY_MS = 86_400_000


def answer_events(events: DataFrame) -> DataFrame:
    """Answer events ``(session, ts, text)`` with text in them."""
    said = events.where(F.col("type") == "assistant/message").withColumn("text", text_blocks(F.col("content")))
    return said.where(trimmed(F.col("text")) != "").select("session", "ts", "text")


def matched_answers(requests: DataFrame, answers: DataFrame, key: str, life: str = LIFE) -> DataFrame:
    """Stream-stream join of each request with the answers inside its life.

    Both sides carry watermarks, so the state is bounded by the life.  Where answers name their
    request, use ``answered_requests``; here several answers of a session may fall into one life, and the
    reader takes the first.
    """
    r = requests.withWatermark("ts", life).select(F.col(key).alias("r_key"), "request_id", F.col("ts").alias("request_ts"))
    a = answers.withWatermark("ts", life).select(F.col(key).alias("a_key"), F.col("ts").alias("answer_ts"))
    inside = (F.col("r_key") == F.col("a_key")) & (F.col("answer_ts") > F.col("request_ts")) & (
        F.col("answer_ts") <= F.col("request_ts") + F.expr(f"INTERVAL {life}"))
    return r.join(a, inside, "inner").select(F.col("r_key").alias(key), "request_id", "request_ts", "answer_ts")


def answered_requests(requests: DataFrame, answers: DataFrame, life: str = LIFE) -> DataFrame:
    """Each request with the answer that names it, once: ``(request_id, request_ts, answer_ts)``.

    ``requests(request_id, ts)``, ``answers(request_id, ts)``.  A request id that comes again, and a second
    answer, are dropped as long as the watermark remembers the first; a request without an answer leaves
    the state after its life.
    """
    once = lambda d: d.withWatermark("ts", life).dropDuplicatesWithinWatermark(["request_id"])
    r = once(requests).select(F.col("request_id").alias("r_id"), F.col("ts").alias("request_ts"))
    a = once(answers).select(F.col("request_id").alias("a_id"), F.col("ts").alias("answer_ts"))
    inside = (F.col("r_id") == F.col("a_id")) & (F.col("answer_ts") > F.col("request_ts")) & (
        F.col("answer_ts") <= F.col("request_ts") + F.expr(f"INTERVAL {life}"))
    return r.join(a, inside, "inner").select(F.col("r_id").alias("request_id"), "request_ts", "answer_ts")


def running_usage(calls: DataFrame) -> DataFrame:
    """Running totals per workspace; in update mode a batch sends the workspaces it touched."""
    return calls.groupBy("ws").agg(F.count("*").alias("calls"), F.sum("est_in").alias("est_in"), F.sum("est_out").alias("est_out"))


class _InOrder(StatefulProcessor):
    """Hands each key's events to ``step`` in the order of their time, whatever batches they came in.

    An event waits in the state until the watermark has passed it; nothing earlier is accepted from then on.  So
    the same events give the same rows however they are cut into batches, and what is held of a key is bounded by
    the delay of the watermark, not by the batch.  ``step(held, event)`` returns what is held next and a row or None;
    ``forget_at(held)`` is the time from which what is held says nothing any more.
    """

    columns: list[str]
    event_schema: str
    held_schema: str
    result: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.event_schema)
        self.held = handle.getValueState("held", self.held_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            events = [tuple(v.item() if hasattr(v, "item") else v for v in e) for e in frame[self.columns].itertuples(index=False, name=None)]
            if events:
                self.waiting.appendList(events)
                earliest = min(events)[0]
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        held = self.held.get() if self.held.exists() else None
        passed = [e for e in events if e[0] < now]
        out = []
        for event in passed:
            held, row = self.step(held, event)
            if row is not None:
                out.append((key[0], *row))
        if passed:
            rest = events[len(passed):]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] + 1)
            else:
                self.waiting.clear()
        if held is not None and self.forget_at(held) <= now:
            held = None
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(self.forget_at(held))
        if out:
            yield pd.DataFrame(out, columns=self.result)

    def close(self) -> None:
        pass


class _PendingSlot(_InOrder):
    """One pending request per session: a newer one replaces it, an answer takes it, time drops it."""

    columns, event_schema = ["at", "event_id", "kind"], "at long, event_id long, kind string"
    held_schema, result = "request_id long, at long", ["session", "request_id", "request_at", "answer_at"]

    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def step(self, held, event):
        at, number, kind = event
        if kind == "request":
            return (number, at), None
        if held is not None and at - held[1] <= self.life_ms:
            return None, (held[0], held[1], at)
        return None, None

    def forget_at(self, held) -> int:
        return held[1] + self.life_ms + 1


class _StatusChanges(_InOrder):
    """Emit a status when its sequence number moved and the last emission is old enough."""

    columns, event_schema = ["at", "seq"], "at long, seq long"
    held_schema, result = "seq long, at long", ["ws", "seq", "at"]

    def __init__(self, gap_ms: int, keep_ms: int):
        self.gap_ms, self.keep_ms = gap_ms, keep_ms

    def step(self, held, event):
        now, seq = event
        if held is not None and now - held[1] >= self.keep_ms:
            held = None
        if held is None or (seq != held[0] and now - held[1] >= self.gap_ms):
            return (seq, now), (seq, now)
        return held, None

    def forget_at(self, held) -> int:
        return held[1] + self.keep_ms


def timed(rows: DataFrame, late: str = LIFE) -> DataFrame:
    """``rows`` with their milliseconds ``at`` as event time and a watermark on it."""
    return rows.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", late)


def pending_slots(events: DataFrame, life_ms: int = 1_800_000, late: str = LIFE) -> DataFrame:
    """``events(session, event_id, kind, at)`` to consumed requests, one slot per session.

    Events without a session share the slot ''.  Events count in the order of their time (ties: by id) once the watermark, ``late``
    behind the newest event, has passed them; later ones are dropped.
    """
    named = timed(events.withColumn("session", F.coalesce("session", F.lit(""))), late)
    return named.groupBy("session").transformWithStateInPandas(
        _PendingSlot(life_ms), "session string, request_id long, request_at long, answer_at long", "Append", "EventTime")


def status_changes(statuses: DataFrame, gap_ms: int = 150, keep_ms: int = 7 * DAY_MS, late: str = LIFE) -> DataFrame:
    """``statuses(ws, seq, at)`` thinned to changes, at most one per gap and workspace.

    Statuses count in the order of their time (ties: by seq) once the watermark, ``late`` behind the newest, has passed them.
    After ``keep_ms`` an emitted status is forgotten; the next one counts as a change.
    """
    return timed(statuses, late).groupBy("ws").transformWithStateInPandas(
        _StatusChanges(gap_ms, keep_ms), "ws string, seq long, at long", "Append", "EventTime")


def active_operations(marks: DataFrame) -> DataFrame:
    """Operations still running: the last mark per ``(ws, kind)`` is an entry.

    ``marks(ws, kind, at, seq, what)``; a plain aggregate, so the state is one row
    per key.  In update mode a batch sends the keys it touched; ``what`` tells readers which have ended.
    """
    last = marks.groupBy("ws", "kind").agg(F.max(F.struct("at", "seq", "what")).alias("l"))
    return last.select("ws", "kind", F.col("l.at").alias("started_at"), F.col("l.what").alias("what"))


def write_updates(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that writes each batch's changed keys into a folder of its own; a retried batch replaces it."""
    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return stream.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key that ``write_updates`` wrote."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("l")).select(*keys, *[f"l.{c}" for c in rest])


def invalidate_on_change(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch of distinct changed packages ``(ws, id)`` to ``apply``."""
    def batch(rows: DataFrame, number: int) -> None:
        apply(rows.select("ws", "id").distinct(), number)
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def invalidate_ledger(changes: DataFrame, folder: str, version: int, checkpoint: str, stream: str = "changes", compact_every: int | None = None):
    """Start a query that applies each batch of changed packages ``(ws, id)`` to the ledger in a store, one after the other.

    A batch reads the state that the one before it left and commits its outcome, with version ``version`` plus its number,
    under its own name: a batch that is tried again after its commit changes nothing, and what it wrote before a failure is
    never read.  Workspaces without a change keep their rows.  Every ``compact_every`` batches a new generation begins.
    """
    def apply(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number <= store.last_batch(spark, folder, stream):
            return
        changed = cut_lineage(rows)
        ledger = store.load_ledger(spark, folder, payloads=False)
        active = ledger.join(changed.select("ws").distinct(), "ws", "left_semi")
        store.append_states(invalidate(active, changed, F.lit(version + number)), folder, version + number, stream, number)
        if compact_every and (number + 1) % compact_every == 0:
            store.compact_ledger(spark, folder)
    return invalidate_on_change(changes, apply, checkpoint)
