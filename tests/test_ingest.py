"""Readers with contracts, writers that are idempotent, reload that is all-or-nothing."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.session import checkpoint_dir
from fleetlens.sources import ingest as S


@pytest.fixture()
def work(spark, tmp_path):
    return str(tmp_path)


def test_csv_contract(spark, work):
    p = os.path.join(work, "ot.csv")
    with open(p, "w") as f:
        f.write("extra,ot_id,activo_id\n1,o1,a1\n")
    df = S.load_csv(spark, p, ["ot_id", "activo_id"])
    assert df.columns == ["ot_id", "activo_id"] and df.count() == 1
    with pytest.raises(ValueError):
        S.load_csv(spark, p, ["ot_id", "fecha_apertura"])


def test_semicolon_bom_csv(spark, work):
    p = os.path.join(work, "maestro.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("sku;stock_actual;Unnamed: 2;activo\nREP-0001;12;;true\nREP-0002;null;;false\nREP-0003;x1;;true\n")
    df = S.load_semicolon_csv(spark, p, numeric=["stock_actual"], boolean=["activo"])
    assert df.columns == ["sku", "stock_actual", "activo"]
    got = {r["sku"]: r["stock_actual"] for r in df.collect()}
    assert got == {"REP-0001": 12.0, "REP-0002": None, "REP-0003": None}


def test_coerce_dates(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", "nope", "x")], "fecha_apertura string, created_date string, otro string")
    r = S.coerce_dates(df).collect()[0]
    assert r["fecha_apertura"] == dt.datetime(2024, 1, 2, 3, 4, 5) and r["created_date"] is None and r["otro"] == "x"


def test_upsert_and_replace_range(spark):
    base = spark.createDataFrame([("o1", "a", 1.0), ("o2", "a", None)], "ot_id string, activo_id string, costo double")
    new = spark.createDataFrame([("o2", None, 5.0), ("o3", "b", 7.0)], "ot_id string, activo_id string, costo double")
    out = {r["ot_id"]: (r["activo_id"], r["costo"]) for r in S.upsert(base, new, "ot_id", ["costo"]).collect()}
    assert out == {"o1": ("a", 1.0), "o2": ("a", 5.0), "o3": ("b", 7.0)}
    rep = S.replace_range(base, new.select("ot_id", F.lit("z").alias("activo_id"), "costo"), ["ot_id"])
    assert sorted(r["ot_id"] for r in rep.collect()) == ["o1", "o2", "o3"]


def test_dynamic_slice_overwrite(spark, work):
    path = os.path.join(work, "scores")
    schema = "scoring_id string, fecha_scoring date, modelo_version string, p double"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    S.write_scores(spark.createDataFrame([("a", d1, "v1", 0.1), ("b", d2, "v1", 0.2)], schema), path)
    S.write_scores(spark.createDataFrame([("c", d2, "v1", 0.3)], schema), path)
    got = sorted(r["scoring_id"] for r in spark.read.parquet(path).collect())
    assert got == ["a", "c"]  # day 1 kept, day 2 replaced


def test_ordered_load_and_full_reload(spark, work):
    a = spark.createDataFrame([("a1",)], "activo_id string")
    ot = spark.createDataFrame([("o1", "a1")], "ot_id string, activo_id string")
    ev = spark.createDataFrame([(1, "o1")], "id_evento long, ot_id string")
    rc = spark.createDataFrame([("o1", "REP-0001")], "ot_id string, sku string")
    tables = {"activos": a, "ordenes_trabajo": ot, "ot_falla_evento": ev, "repuestos_consumidos": rc}
    live = os.path.join(work, "live")
    counts = S.full_reload(tables, live)
    assert counts == {"activos": 1, "ordenes_trabajo": 1, "ot_falla_evento": 1, "repuestos_consumidos": 1}
    assert S.live(spark, live, "ordenes_trabajo").count() == 1
    two = dict(tables, ordenes_trabajo=ot.unionByName(spark.createDataFrame([("o2", "a1")], ot.schema)))
    S.full_reload(two, live)
    assert S.live(spark, live, "ordenes_trabajo").count() == 2
    bad = dict(tables, ordenes_trabajo=spark.createDataFrame([("o2", "zz")], "ot_id string, activo_id string"))
    with pytest.raises(ValueError):
        S.ordered_load(bad, os.path.join(work, "other"))
    with pytest.raises(ValueError):
        S.full_reload(dict(tables, activos=a.limit(0)), live)
    with pytest.raises(ValueError):
        S.full_reload(bad, live)
    assert S.live(spark, live, "ordenes_trabajo").count() == 2  # a refused reload leaves the live tables


def test_score_slices_leave_snapshots_alone(spark, work):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, part string")
    path = os.path.join(work, "snap")
    S.write_snapshot(df, path, partition_by=["part"])
    S.write_scores(spark.createDataFrame([("s", dt.date(2024, 1, 1), "v1")], "scoring_id string, fecha_scoring date, modelo_version string"),
                   os.path.join(work, "sc"))
    S.write_snapshot(df.limit(0).unionByName(spark.createDataFrame([("c", "z")], df.schema)), path, partition_by=["part"])
    assert [r["k"] for r in spark.read.parquet(path).collect()] == ["c"]


def test_csv_round_trip(spark, work):
    rows = [("a", 'line\nbreak, "quoted" text'), ("b", ""), ("c", None), ("d", "x,y;z"), ("e", '"')]
    df = spark.createDataFrame(rows, "k string, texto string")
    summary = S.export_tables({"t": df}, work)
    assert summary.first()["filas"] == 5
    got = {r["k"]: r["texto"] for r in S.restore_tables(spark, work, ["t"])["t"].collect()}
    assert got == dict(rows)
    assert {r["k"]: r["texto"] for r in S.load_csv(spark, os.path.join(work, "t"), ["texto", "k"], **S.EXPORT).collect()} == dict(rows)
    csv, parquet = S.export_plan(df, work, "20240101")
    assert {r["k"]: r["texto"] for r in S.load_csv(spark, csv, ["k", "texto"], **S.EXPORT).collect()} == dict(rows)
    assert spark.read.parquet(parquet).count() == 5
    S.export_parquet(df, os.path.join(work, "pq"), {"texto": "t", "absent": "x"})
    assert spark.read.parquet(os.path.join(work, "pq")).columns == ["k", "t"]


def test_semicolon_csv_keeps_columns_with_an_underscore(spark, work):
    path = os.path.join(work, "s.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\ufeffsku;_costo;Unnamed: 3;_c3\nA;1,5;x;y\nB;null;x;y\n")
    got = S.load_semicolon_csv(spark, path)
    assert got.columns == ["sku", "_costo"] and [r["_costo"] for r in got.collect()] == ["1,5", None]


def test_asof_with_repeated_left_rows(spark):
    from fleetlens.operators.joins import asof_join

    left = spark.createDataFrame([("l", "k", dt.date(2024, 1, 5)), ("l", "k", dt.date(2024, 1, 5)), ("m", None, dt.date(2024, 1, 5))], "id string, key string, day date")
    right = spark.createDataFrame([("k", dt.date(2024, 1, 3), "r"), (None, dt.date(2024, 1, 3), "z")], "key string, rd date, v string")
    got = asof_join(left, right, "key", "day", "rd", -9, 0, True, False, "last", ["v"]).collect()
    assert sorted((r["id"], r["v"] or "") for r in got) == [("l", "r"), ("l", "r"), ("m", "")]


def test_unknown_model_is_refused(spark):
    from fleetlens.operators import ml

    reg = spark.createDataFrame([], ml.REGISTRY_SCHEMA)
    with pytest.raises(ValueError):
        ml.registry_activate(reg, "nope")


def test_alert_stream_counts_late_days(spark, work):
    from fleetlens.streaming import streams as ST

    schema = "fecha_scoring date, prioridad string"
    src = os.path.join(work, "in")
    for i, day in enumerate([dt.date(2024, 6, 1), dt.date(2023, 1, 1), dt.date(2024, 6, 1), dt.date(2023, 1, 1)]):
        spark.createDataFrame([(day, "P1_critica"), (day, "P4_baja")], schema).coalesce(1).write.parquet(f"{src}/f={i}")
    got = ST.stream_daily_alerts(spark, f"{src}/*", spark.createDataFrame([], schema).schema, os.path.join(work, "out")).collect()
    assert {r["fecha"]: r["alertas_altas"] for r in got} == {dt.date(2024, 6, 1): 2, dt.date(2023, 1, 1): 2}


def test_reset_refuses_protected(spark, work):
    from pyspark.sql import types as T
    sch = {"paneles": T.StructType([T.StructField("x", T.IntegerType())])}
    assert S.reset_derived(spark, work, ["paneles"], sch) == {"paneles": 0}
    with pytest.raises(ValueError):
        S.reset_derived(spark, work, ["scoring_resultados"], sch)


def test_checkpoint_dir_comes_from_session(spark):
    d = checkpoint_dir(spark)
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        assert conf.replace("file:", "").rstrip("/") in d.replace("file:", "")
