"""Threads and change events as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.mutations import capture_changes

STATE_SCHEMA = "auteur string, statut string, nb_messages long"
OUTPUT_SCHEMA = "demande_id long, statut string, nb_messages long"


def once_per_key(messages: DataFrame, key: str = "email_message_id", time: str = "cree_le", delay: str = "1 day") -> DataFrame:
    """Messages without redelivered ones: a key counts once within the watermark; those without a key all count."""
    timed = messages.withWatermark(time, delay)
    return timed.filter(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key]).unionByName(timed.filter(F.col(key).isNull()))


def follow_thread(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State machine of one thread.

    The first message's actor is the author.  A message of the other side makes
    the thread answered, one of the author opens it again; a closing event
    (actor ``close``) is final.  Within a micro-batch events go by time, then id.
    """
    author, status, count = state.get if state.exists else (None, "ouverte", 0)
    events = pd.concat(list(batches)).sort_values(["cree_le", "id"])
    for actor in events["acteur"]:
        if actor == "close":
            status = "close"
            continue
        author = author or actor
        count += 1
        if status != "close":
            status = "ouverte" if actor == author else "repondue"
    state.update((author, status, count))
    yield pd.DataFrame({"demande_id": [key[0]], "statut": [status], "nb_messages": [count]})


def thread_states(messages: DataFrame) -> DataFrame:
    """Current state of each thread that got a message in the micro-batch (update mode)."""
    return messages.groupBy("demande_id").applyInPandasWithState(follow_thread, OUTPUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def activity_by_window(messages: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Messages per actor and window; windows close once the watermark has passed them."""
    return messages.withWatermark("cree_le", delay).groupBy(F.window("cree_le", length), "acteur").agg(F.count("*").alias("nb"))


def capture(changes: DataFrame, current: Callable[[], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Turn incoming new row states into field-level events, against the current table.

    ``changes`` streams full new rows; of several of one id in a micro-batch the
    last (by ``modifie_le``) counts.  ``sink`` appends the events; it may see a
    micro-batch again after a failure, so it should be idempotent by batch.
    """
    def step(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("id").agg(F.max_by(F.struct("*"), "modifie_le").alias("r")).select("r.*")
        sink(capture_changes(current(), latest))

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
