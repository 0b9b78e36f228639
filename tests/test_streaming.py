import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import threads

SCHEMA = "id long, demande_id long, acteur string, cree_le timestamp, email_message_id string"


@pytest.fixture
def messages(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write([(1, 1, "dreal", dt.datetime(2020, 1, 1, 8), "a"), (2, 1, "be", dt.datetime(2020, 1, 1, 9), "b"), (3, 2, "be", dt.datetime(2020, 1, 1, 9), "c"), (2, 1, "be", dt.datetime(2020, 1, 1, 9), "b")])
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), write


def run(df, mode, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_thread_states_follow_the_messages(spark, messages, tmp_path):
    stream, write = messages
    write([(4, 1, "dreal", dt.datetime(2020, 1, 2), "d"), (5, 2, "close", dt.datetime(2020, 1, 2), "e"), (6, 2, "be", dt.datetime(2020, 1, 3), "f")])
    run(threads.thread_states(stream), "update", "etats", tmp_path)
    last = spark.table("etats").groupBy("demande_id").agg(F.max_by("statut", "nb_messages").alias("s")).collect()
    assert {r.demande_id: r.s for r in last} == {1: "ouverte", 2: "close"}


def test_redelivered_messages_count_once(spark, messages, tmp_path):
    run(threads.once_per_key(messages[0]), "append", "uniques", tmp_path)
    assert spark.table("uniques").count() == 3


def test_windows(spark, messages, tmp_path):
    run(threads.activity_by_window(messages[0]), "complete", "fenetres", tmp_path)
    assert {(r.acteur, r.nb) for r in spark.table("fenetres").collect()} == {("dreal", 1), ("be", 3)}


def test_changes_become_events(spark, tmp_path):
    schema = "id long, projet_id long, annee int, statut string, montant_ht int, montant_engage int, montant_realise int, modifie_le timestamp"
    now = dt.datetime(2020, 1, 1)
    spark.createDataFrame([(1, 1, 2020, "realise", 5, None, None, now), (1, 1, 2020, "planifie", 6, None, None, dt.datetime(2020, 1, 2))], schema).coalesce(1).write.parquet(str(tmp_path / "new"))
    old = spark.createDataFrame([(1, 1, 2020, "planifie", 5, None, None, now)], schema)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "new"))
    query = threads.capture(stream, lambda: old, lambda e: e.write.mode("append").parquet(str(tmp_path / "events")), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [(r.champ, r.ancienne_val, r.nouvelle_val) for r in spark.read.parquet(str(tmp_path / "events")).collect()] == [("montant_ht", "5", "6")]


def follow(spark, tmp_path, parts, wait="15 days"):
    from ledgerloom.streaming import stateful

    frames = [spark.createDataFrame([(k, d, a, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)) for k, d, a, h in rows], "id long, demande_id long, acteur string, cree_le timestamp") for rows in parts]
    rows = stateful.replay(frames, lambda s: stateful.follow_threads(s, wait, delay="1 hour"), f"file://{tmp_path}/fils", "update", 2).collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r.demande_id, r.nb_messages, r.echu)):
        last[r.demande_id] = (r.statut, r.nb_messages, r.en_attente)
    return last, rows


def test_threads_fall_due_without_a_message(spark, tmp_path):
    last, rows = follow(spark, tmp_path, [
        [(1, 1, "be", 0), (2, 2, "be", 0), (3, 2, "dreal", 1), (4, 3, "be", 0), (5, 4, "be", 2)],
        [(6, 3, "be", 200), (7, 4, "close", 30), (8, 9, "be", 250)],
        [(9, 9, "be", 24 * 40)],
    ])
    assert last == {1: ("a_relancer", 1, 1), 2: ("repondue", 2, 0), 3: ("a_relancer", 2, 2), 4: ("close", 1, 0), 9: ("ouverte", 2, 2)}
    due = {r.demande_id: r.le for r in rows if r.echu}
    start = int(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    # The next message of thread 9 was there before the watermark reached its due time, and took the timer back.
    assert due == {1: start + 15 * 86_400_000, 3: start + (200 + 15 * 24) * 3_600_000}


def test_events_of_keyed_capture(spark, tmp_path):
    from ledgerloom.streaming import stateful

    schema = "id long, projet_id long, annee int, statut string, montant_ht int, montant_engage int, montant_realise int, modifie_le timestamp"

    def row(k, day, **changed):
        values = {"annee": 2020, "statut": "planifie", "montant_ht": 5, "montant_engage": None, "montant_realise": None} | changed
        return (k, 1, *values.values(), dt.datetime(2020, 1, day))

    old = spark.createDataFrame([row(1, 1), row(2, 1), row(3, 1)], schema)
    parts = [
        [row(1, 2, montant_ht=6), row(1, 3, montant_ht=6, statut="realise"), row(9, 2)], [row(1, 2, montant_ht=99), row(2, 1, annee=1999), row(9, 3, montant_ht=None)], [row(1, 3, montant_ht=6, statut="realise"), row(3, 4, montant_realise=0)],
    ]
    got = stateful.replay([spark.createDataFrame(p, schema) for p in parts], lambda s: stateful.capture_keyed(s, old, "m", "a"), f"file://{tmp_path}/captures", partitions=2).collect()
    assert sorted((r.occurrence_id, r.champ, r.ancienne_val, r.nouvelle_val, r.motif, r.modifie_par) for r in got) == [
        (1, "montant_ht", "5", "6", "m", "a"), (1, "statut", "planifie", "realise", "m", "a"), (3, "montant_realise", None, "0", "m", "a"), (9, "montant_ht", "5", None, "m", "a")]


def test_mails_without_a_key_all_count(spark, tmp_path):
    from ledgerloom.streaming import stateful

    rows = [(k, 1, "be", dt.datetime(2020, 1, 1, 8 + k % 3), None if k % 2 else f"m{k % 4}") for k in range(12)]
    frames = [spark.createDataFrame(rows[:6], SCHEMA), spark.createDataFrame(rows[6:], SCHEMA)]
    got = stateful.replay(frames, lambda s: threads.once_per_key(s, delay="2 days"), f"file://{tmp_path}/mails", partitions=2).collect()
    assert sorted(r.email_message_id or "" for r in got) == [""] * 6 + ["m0", "m2"]


def test_capture_calls_the_state_once_a_lot(spark, tmp_path, monkeypatch):
    from ledgerloom.streaming import stateful

    def side(df):
        return df.selectExpr("id", "1L AS projet_id", "2020 AS annee", "'x' AS statut", "n AS montant_ht", "1 AS montant_engage", "1 AS montant_realise", "TIMESTAMP '2020-01-01' + make_interval(0, 0, 0, n) AS modifie_le")

    old = side(spark.range(1000).selectExpr("id - 200 AS id", "0 AS n"))
    parts = [side(spark.range(1000).selectExpr("id - 100 AS id", f"{n} AS n")) for n in (1, 2)]
    seen = spark.sparkContext.accumulator(0)
    handle = stateful.ChangeCapture.handleInputRows

    def counted(self, key, rows, timers):
        seen.add(1)
        yield from handle(self, key, rows, timers)

    class Counted(stateful.ChangeCapture):
        handleInputRows = counted

    monkeypatch.setattr(stateful, "ChangeCapture", Counted)
    got = stateful.replay(parts, lambda s: stateful.capture_keyed(s, old), f"file://{tmp_path}/lots", partitions=2)
    # The last 100 ids are unknown at first, and known when the second part comes.
    assert sorted((r.occurrence_id, r.ancienne_val, r.nouvelle_val) for r in got.collect()) == sorted([(k, "0", "1") for k in range(-100, 800)] + [(k, "1", "2") for k in range(-100, 900)])
    assert seen.value < 100
