"""Streams whose operators keep their own state: threads with due dates, and change capture.

Both run on ``transformWithState``, whose state lives in the state store of the
checkpoint, key by key; no micro-batch reads a table that grows.  Results don't
depend on how the rows are cut into micro-batches or in which order these come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.mutations import WATCHED
from ledgerloom.session import ship_package

THREADS = "demande_id long, statut string, nb_messages long, en_attente long, echu boolean, le long"
EVENTS = "occurrence_id long, projet_id long, champ string, ancienne_val string, nouvelle_val string, motif string, modifie_par string"


class ThreadFollower(StatefulProcessor):
    """State machine of a thread with a timer.

    The actor of the earliest message is the author.  The latest one decides: the
    author's leaves the thread open, the other side's answers it, and a closing
    event (actor ``close``) is final.  An open thread falls due ``wait_ms`` after
    its latest message in event time, without any further message; every later
    message takes the timer back.
    """

    def __init__(self, wait_ms: int):
        self._wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._thread = handle.getValueState("fil", "premier_le long, premier_id long, auteur string, dernier_le long, dernier_id long, dernier string, nb long, clos boolean")
        self._spoken = handle.getListState("parole", "le long, id long, acteur string")  # since the last change of sides

    def _status(self, thread: tuple) -> str:
        return "close" if thread[7] else "ouverte" if thread[5] == thread[2] else "repondue"

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first_at, first_id, author, last_at, last_id, last, count, closed = self._thread.get() if self._thread.exists() else (None, None, None, None, None, None, 0, False)
        spoken = [tuple(r) for r in self._spoken.get()] if self._spoken.exists() else []
        for r in rows:
            if r.acteur == "close":
                closed = True
                continue
            count += 1
            if first_at is None or (r.le, r.id) < (first_at, first_id):
                first_at, first_id, author = r.le, r.id, r.acteur
            if last_at is None or (r.le, r.id) > (last_at, last_id):
                last_at, last_id, last = r.le, r.id, r.acteur
            spoken.append((r.le, r.id, r.acteur))
        spoken.sort()
        turn = max((k for k, s in enumerate(spoken) if s[2] != last), default=-1)
        spoken = spoken[max(turn, 0):]  # the other side's last word stays, so that late ones find their place
        thread = (first_at, first_id, author, last_at, last_id, last, count, closed)
        self._thread.update(thread)
        self._spoken.put(spoken)
        for due in list(self._handle.listTimers()):
            self._handle.deleteTimer(due)
        status = self._status(thread)
        if status == "ouverte" and last_at is not None:
            self._handle.registerTimer(last_at + self._wait)
        yield Row(demande_id=key[0], statut=status, nb_messages=count, en_attente=sum(s[2] == last for s in spoken) if status == "ouverte" else 0, echu=False, le=last_at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        thread = tuple(self._thread.get())
        if self._status(thread) == "ouverte":
            yield Row(demande_id=key[0], statut="a_relancer", nb_messages=thread[6], en_attente=sum(r[2] == thread[5] for r in self._spoken.get()), echu=True, le=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def follow_threads(messages: DataFrame, wait: str = "15 days", delay: str = "1 hour") -> DataFrame:
    """State of each thread whenever it gets a message, and once more when it falls due (update mode).

    ``messages``: id, demande_id, acteur, cree_le (a timestamp; ``delay`` is what
    the watermark stays behind).  A later row of a thread replaces the earlier.
    """
    ship_package(messages.sparkSession)
    days, unit = wait.split()
    wait_ms = int(days) * {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    rows = messages.select("id", "demande_id", "acteur", F.unix_millis("cree_le").alias("le"), "cree_le").withWatermark("cree_le", delay)
    return rows.groupBy("demande_id").transformWithState(ThreadFollower(wait_ms), THREADS, "update", "EventTime")


class ChangeCapture(StatefulProcessor):
    """Field-level events between the last known row of an id and a newer one.

    A key is a lot of neighbouring ids whose last rows are one value of the state:
    each access to the state is a call to the JVM, and one per id would cost far
    more than the work on its rows.
    """

    def __init__(self, fields: list[str], motif: str, author: str):
        self._fields, self._motif, self._author = fields, motif, author
        self._names = ("id", "modifie_le", "projet_id", *fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rows = handle.getValueState("lignes", f"lignes array<struct<{_row_fields(self._fields)}>>")

    def _by_id(self, rows: Iterable[Row | dict]) -> dict[int, tuple]:
        return {r["id"]: tuple(r[n] for n in self._names) for r in rows}

    def _known(self) -> dict[int, tuple]:
        found = self._rows.get()
        return self._by_id(found[0]) if found is not None else {}

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        known = self._known() | self._by_id(initialState.lignes)
        self._rows.update((list(known.values()),))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self._known()
        for new in sorted((tuple(r[n] for n in self._names) for r in rows), key=lambda r: (r[1] is not None, r[1] or 0)):
            old = known.get(new[0])
            if old is not None:
                if (new[1] or 0) <= (old[1] or 0):
                    continue  # older than what is known, or the same again
                for f, before, after in zip(self._fields, old[3:], new[3:]):
                    if before != after:
                        yield Row(occurrence_id=new[0], projet_id=new[2], champ=f, ancienne_val=before, nouvelle_val=after, motif=self._motif, modifie_par=self._author)
            known[new[0]] = new
        if known:
            self._rows.update((list(known.values()),))

    def close(self) -> None:
        pass


def _row_fields(fields: list[str]) -> str:
    return "id: long, modifie_le: long, projet_id: long, " + ", ".join(f"{f}: string" for f in fields)


def capture_keyed(changes: DataFrame, current: DataFrame, motif: str | None = None, author: str | None = None, fields: list[str] = WATCHED, ids_per_lot: int = 64) -> DataFrame:
    """Events of a stream of full new rows (id, projet_id, modifie_le, fields), against the last row of each id.

    ``current`` is read once, when the query first starts, as the initial state.
    Several rows of an id give the events of each step, in order of
    ``modifie_le``; a row that is not newer than the last known one gives none, a
    row of an unknown id only makes it known.  A change reads and writes the
    last rows of its lot, ``ids_per_lot`` at most, however many ids there are;
    the number must stay the same for a checkpoint.
    """
    ship_package(changes.sparkSession)

    def side(df: DataFrame) -> DataFrame:
        lot = F.expr(f"id div {ids_per_lot}").alias("groupe")
        return df.select(lot, F.col("id").cast("long").alias("id"), F.unix_millis("modifie_le").alias("modifie_le"), F.col("projet_id").cast("long").alias("projet_id"), *(F.col(f).cast("string").alias(f) for f in fields))

    processor = ChangeCapture(fields, motif or "", author or "")
    lots = side(current).groupBy("groupe").agg(F.collect_list(F.struct("id", "modifie_le", "projet_id", *fields)).alias("lignes"))
    return side(changes).groupBy("groupe").transformWithState(processor, EVENTS, "append", "None", initialState=lots.groupBy("groupe"))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> None:
    """Work off all that a stream's source holds and append the result to a table of files, each micro-batch once.

    A micro-batch that runs again after a failure replaces its own folder.  The
    number of state partitions is fixed when a checkpoint is first used.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/lot={number}")

    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    with _settings(stream.sparkSession, settings):
        query = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def replay(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame], folder: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Rows that ``transform`` makes of parts that arrive one after the other; the query starts anew from its checkpoint for each."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        run_to_end(transform(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint", mode, partitions)
    return spark.read.parquet(f"{folder}/out")
