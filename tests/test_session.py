import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.functions import scalars as S
from ledgerloom.operators import geo


def test_tables_in_the_shared_folder(spark):
    rows = spark.createDataFrame([(1, "MultiPolygon", False), (2, "LineString", False), (3, "Point", True)], "id int, geometry_type string, footprint boolean")
    layers = rows.select("id", geo.kind_of(F.col("geometry_type"), F.col("footprint")).alias("layer"))
    table = session.materialise(layers, "layers", ("layer",))
    path = table._ledgerloom_path.removeprefix("file://")
    assert path.startswith(session.shared_folder(spark).removeprefix("file://"))
    assert {d for d in os.listdir(path) if "=" in d} == {"layer=surf", "layer=lin", "layer=emprise"}
    assert {r.id: r.layer for r in table.collect()} == {1: "surf", 2: "lin", 3: "emprise"}
    session.discard(table)
    assert not os.path.exists(path)
    session.discard(layers)


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        session.bound_batches(spark)
        assert spark.conf.get(key) == "2000"
        spark.conf.set(key, "500")
        session.bound_batches(spark)
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.set(key, before)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1 -é", max_size=6), min_size=1, max_size=20))
def test_unit_ids_against_plain_python(spark, values):
    def plain(x):
        return "".join(c for c in x if c.isascii() and c.isalnum()).lower() or None

    got = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(S.normalize_ug_id(F.col("v")).alias("x")).collect()]
    assert got == [plain(v) for v in values]
    row = spark.createDataFrame([(values,)], "v array<string>").select(S.normalize_ug_ids(F.col("v"), ordered=False).alias("seen"), S.normalize_ug_ids(F.col("v")).alias("sorted")).first()
    first_seen = list(dict.fromkeys(x for x in map(plain, values) if x))
    assert row.seen == first_seen and row.sorted == sorted(first_seen)
