"""Chat sessions: batch forms by windows, and a stateful stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.config import SessionConfig

_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def history_window(messages: DataFrame, session: str, order: str, most: int = 20) -> DataFrame:
    """The last messages of each session."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    return messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def session_history(messages: DataFrame, session: str, order: str) -> DataFrame:
    """(session, history): messages as an array of role and content, in order."""
    m = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return messages.groupBy(session).agg(m.alias("history"))


def session_ttl(events: DataFrame, key: str, ts: str, hours: int = 6) -> DataFrame:
    """Each event with the number of its session: one ends when the next event comes more than so many hours later."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.col(ts).cast("double") - F.lag(ts).over(w).cast("double")
    return events.withColumn("new", F.coalesce((gap > hours * 3600).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(w)).drop("new")


def session_cap(sessions: DataFrame, most: int = 2000) -> DataFrame:
    """The sessions used last, ties to the smaller id."""
    return sessions.orderBy(F.col("last_access").desc(), "id").limit(most)


def valid_session(c):
    return F.coalesce(c.rlike(_UUID), F.lit(False))


def get_or_create(requests: DataFrame, sessions: DataFrame, fresh=None) -> DataFrame:
    """Requests with the session they belong to and whether it is new: only a well-formed id that is stored is kept, else a fresh one is given (a random UUID, unless told)."""
    known = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("_known")).distinct()
    kept = valid_session(F.col("session_id")) & F.coalesce("_known", F.lit(False))
    out = requests.join(known, "session_id", "left").withColumn("is_new", ~kept)
    return out.withColumn("session_id", F.when(F.col("is_new"), F.uuid() if fresh is None else fresh).otherwise(F.col("session_id"))).drop("_known")


def clear(messages: DataFrame, sessions: DataFrame, session: str) -> DataFrame:
    return messages.join(sessions.select(session), session, "left_anti")


def incremental_skip(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New items whose content_hash is not stored under their source."""
    return new.join(stored.select("source", "content_hash"), ["source", "content_hash"], "left_anti")


def job_latest(events: DataFrame) -> DataFrame:
    """(job_id, status, updated_at): the last status of each job."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("updated_at", "event_id")).alias("status"), F.max("updated_at").alias("updated_at"))


def stream_histories(messages: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """A stream (session_id, role, content) to (session_id, n, roles, contents) after each batch: the last messages, forgotten once idle for long enough."""

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        roles, contents = map(list, state.get) if state.exists else ([], [])
        for f in frames:
            roles += f["role"].tolist()
            contents += f["content"].tolist()
        roles, contents = roles[-config.messages :], contents[-config.messages :]
        state.update((roles, contents))
        state.setTimeoutDuration(config.idle_hours * 3_600_000)
        yield pd.DataFrame({"session_id": [key[0]], "n": [len(roles)], "roles": [roles], "contents": [contents]})

    out = "session_id string, n int, roles array<string>, contents array<string>"
    return messages.groupBy("session_id").applyInPandasWithState(step, out, "roles array<string>, contents array<string>", "update", "ProcessingTimeTimeout")
