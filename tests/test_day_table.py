"""The table kept by day: upserts touch their days alone, a broken write changes nothing, old files go."""

import datetime as dt
import os

from pyspark.sql.types import DateType, IntegerType, StringType, StructType

from fleetlens.operators import availability as A
from fleetlens.sources.day_table import DayTable

D0 = dt.date(2000, 1, 10)
SCHEMA = StructType().add("activo_id", StringType()).add("fecha", DateType()).add("v", IntegerType())


def day(n):
    return D0 + dt.timedelta(days=n)


def rows(spark, *cells):
    return spark.createDataFrame([(a, day(n), v) for a, n, v in cells], SCHEMA)


def content(table):
    return sorted((r.activo_id, (r.fecha - D0).days, r.v) for r in table.read().collect())


def test_upsert_expire_and_broken_write(spark, tmp_path):
    table = DayTable(spark, str(tmp_path), SCHEMA, ["activo_id", "fecha"])
    assert table.manifest() == {} and table.last_day() is None and content(table) == []
    assert table.upsert(rows(spark)) == []
    table.write_days(rows(spark, ("a", 0, 1), ("b", 0, 2), ("a", 1, 3)))
    before = table.manifest()
    assert table.upsert(rows(spark, ("a", 1, 30), ("c", 1, 4), ("a", 2, 5))) == [day(1), day(2)]
    after = table.manifest()
    assert after[day(0)] == before[day(0)] and after[day(1)] != before[day(1)] and table.last_day() == day(2)
    want = [("a", 0, 1), ("a", 1, 30), ("a", 2, 5), ("b", 0, 2), ("c", 1, 4)]
    assert content(table) == want
    # files of a write that never published its manifest
    rows(spark, ("x", 0, 9)).write.parquet(f"{tmp_path}/data/broken/_dia={day(0)}")
    assert content(table) == want
    assert sorted(r.v for r in table.read(since=day(1)).collect()) == [4, 5, 30]
    assert table.read(days=[day(7)]).collect() == []
    table.upsert(rows(spark, ("a", 0, 10), ("b", 0, 20)))
    table.expire(keep=1)
    assert content(table) == [("a", 0, 10), ("a", 1, 30), ("a", 2, 5), ("b", 0, 20), ("c", 1, 4)]
    assert not os.path.exists(f"{tmp_path}/data/broken") and len(os.listdir(f"{tmp_path}/data")) == 2


def test_increment_equals_the_plain_one(spark, tmp_path):
    t = lambda n, h: dt.datetime.combine(day(n), dt.time()) + dt.timedelta(hours=h)
    orders = "ot_id string, activo_id string, fecha_apertura timestamp_ntz, fecha_cierre timestamp_ntz, tipo_ot string"
    ot = spark.createDataFrame([("1", "a", t(-6, 3), t(1, 5), "correctiva"), ("2", "b", t(0, 3), None, "preventiva"), ("3", "a", t(-9, 0), t(-8, 0), "x")], orders)
    a = spark.createDataFrame([("a",), ("b",), ("c",)], "activo_id string")
    prev = A.availability(ot, None, a, day(-9), day(-3))
    table = DayTable(spark, str(tmp_path), prev.schema, ["activo_id", "fecha"])
    table.write_days(prev)
    assert A.availability_increment(table, ot, None, D0) == [day(n) for n in range(-4, 1)]
    want = A.availability_incremental(prev, ot, None, D0)
    assert sorted(map(repr, table.read().collect())) == sorted(map(repr, want.collect()))
    empty = DayTable(spark, str(tmp_path / "empty"), prev.schema, ["activo_id", "fecha"])
    assert A.availability_increment(empty, ot, None, D0) == [day(n) for n in range(-3, 1)]
    assert sorted(map(repr, empty.read().collect())) == sorted(map(repr, A.availability_touched(ot, None, day(-3), D0).collect()))


def test_cells_of_touched_days(spark):
    t = lambda n, h: dt.datetime.combine(day(n), dt.time()) + dt.timedelta(hours=h)
    ot = spark.createDataFrame([("1", "a", t(0, 3), t(1, 5), "correctiva"), ("2", "a", t(1, 20), None, "preventiva")],
                               "ot_id string, activo_id string, fecha_apertura timestamp_ntz, fecha_cierre timestamp_ntz, tipo_ot string")
    cells = A.touched_cells(ot, day(-3), day(3))
    assert sorted((r.fecha - D0).days for r in cells.collect()) == [0, 1]
    whole = {r.fecha: r for r in A.availability(ot, None, cells.select("activo_id").distinct(), day(-3), day(3)).collect()}
    assert sorted(map(repr, A.availability_at(ot, None, cells, day(-3), day(3)).collect())) == sorted(repr(whole[day(n)]) for n in (0, 1))
