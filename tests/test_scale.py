"""Steps whose cost must not outgrow their input: what they share, fold or keep small, and that results stay the same."""

import random
import time
from collections import Counter
from difflib import SequenceMatcher
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.operators import classify as C
from fleetlens.operators import parts as D
from fleetlens.operators import joins
from fleetlens.operators.joins import salted_join


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcd #1", max_size=200), st.lists(st.text(alphabet="abcd #1", max_size=30), max_size=6))
def test_one_matcher_for_many_texts(a, many):
    text = C.Matcher(a)
    assert [text.ratio(b) for b in many] == [SequenceMatcher(None, a, b).ratio() for b in many]


def test_shared_parts_are_looked_for_once():
    stds = [f"{x} {y} brand#{n}" for x, y, n in product(("economy", "standard", "promo"), ("steel", "brass"), range(11, 36))]
    text = C.Matcher("the standard motor has a promo part made of brass and stands on steel " * 20)
    for s in stds:
        text.ratio(s)
    looked = sum(len(found) for found in text.at.values())
    assert looked < sum(len(s) * (len(s) + 1) // 2 for s in stds) / 20


def test_candidates_of_repeated_ids_words_and_texts(spark):
    """Hits count over all rows of an id; rows without an id have none; equal descriptions each get all rows."""
    cat = spark.createDataFrame(
        [("t1", "motor", "a", 1, "m1", "motor a", ["oil", "leak"]), ("t1", "motor", "b", 1, "m1", "motor b", ["oil"]),
         (None, "brake", "c", 2, "m2", "brake c", ["oil"])],
        "taxonomia_id string, sistema string, componente string, id_modo_falla long, modo string, descripcion_estandar string, keywords array<string>")
    orders = spark.createDataFrame([("o1", "Oil oil leak"), ("o2", "oil OIL leak"), ("o3", None)], "ot_id string, descripcion_falla string")
    scored = C.candidates(orders, cat, (1.0, 0.0, 0.0, 0.0))
    got = Counter((r.ot_id, r.taxonomia_id, r.componente, r.score, tuple(r.hit_words)) for r in scored.collect())
    assert got == Counter((o, "t1", c, 3 / n, ("leak", "oil", "oil")) for o in ("o1", "o2") for c, n in (("a", 2), ("b", 1)))
    pairs = C.candidates(orders, cat, (0.0, 1.0, 0.0, 0.0))
    assert pairs.filter(F.col("ot_id") != "o3").count() == 6


def test_review_queue_never_broadcasts_the_pairs(spark, tmp_path):
    spark.range(50_000).selectExpr("cast(id div 150 as string) ot_id", "'t' taxonomia_id", "0.1D score").write.parquet(f"{tmp_path}/p")
    done = spark.range(400).selectExpr("cast(id as string) ot_id", "0.2D confianza", "'t' taxonomia_id")
    review = C.route(done, spark.read.parquet(f"{tmp_path}/p"))[1]
    assert review.count() == 50_000 + 400 - -(-50_000 // 150)
    assert "Broadcast" not in review._jdf.queryExecution().executedPlan().toString()


def _parts_tables(spark, n=300):
    """Orders, events, parts and assets with repeated and null keys."""
    rnd = random.Random(3)
    some = lambda xs: rnd.choice([*xs, None])
    orders = [str(i) for i in range(40)]
    ot = spark.createDataFrame([(some(orders), some("ab"), rnd.choice(["correctiva", "Emergency", "otra"])) for _ in range(80)], "ot_id string, activo_id string, tipo_ot string")
    ev = spark.createDataFrame([(some(orders), some("xyz")) for _ in range(n)], "ot_id string, taxonomia_id string")
    tax = spark.createDataFrame([("x", "Motor"), ("y", "motor"), ("y", "Motor"), ("z", None), ("z", " ")], "taxonomia_id string, sistema string")
    rc = spark.createDataFrame([(some(orders), some(["S1", "S2", " "]), some([1.0, 2.5])) for _ in range(n)], "ot_id string, sku string, cantidad double")
    a = spark.createDataFrame([("a", "m", "n"), ("a", "m", "n"), ("b", "m", "o"), ("b", None, "o")], "activo_id string, marca string, modelo string")
    return ot, ev, tax, rc, a


def test_parts_joins_equal_the_plain_fan_out(spark):
    ot, ev, tax, rc, a = _parts_tables(spark)
    key = ["marca", "modelo", "sistema", "sku"]
    j = ot.join(ev, "ot_id").join(tax, "taxonomia_id").join(rc, "ot_id").join(a, "activo_id")
    j = j.filter("marca is not null and modelo is not null and trim(sistema) <> '' and trim(sku) <> '' and cantidad is not null")
    plain = j.groupBy(*key).agg(F.sum("cantidad"), F.count(F.lit(1)), F.countDistinct("ot_id"))
    got = D.consumption_map(ot, ev, tax, rc, a).drop("cantidad_promedio")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() > 3
    cs = ot.filter("tipo_ot <> 'otra'").join(ev, "ot_id").join(tax, "taxonomia_id").selectExpr("ot_id", "lower(sistema) sistema").distinct()
    plain = cs.join(rc.filter("sku is not null"), "ot_id").groupBy("sistema", "sku").agg(F.sum("cantidad") / F.countDistinct("ot_id"))
    rows = lambda df: sorted(((*r[:2], None if r[2] is None else round(r[2], 9)) for r in df.collect()), key=str)
    assert rows(D.use_per_corrective(rc, ot, ev, tax)) == rows(plain)


def test_parts_joins_have_tasks_in_proportion_to_the_lines(spark, monkeypatch):
    ot, ev, tax, rc, a = _parts_tables(spark)
    monkeypatch.setattr(D, "LINES_PER_TASK", 5)
    plan = D.consumption_map(ot, ev, tax, rc, a)._jdf.queryExecution().optimizedPlan().toString()
    lines = rc.filter("trim(sku) <> '' and cantidad is not null").count()
    assert f"RepartitionByExpression [ot_id#" in plan and f", {-(-lines // 5)}" in plan  # noqa: F541
    assert "count(distinct" not in D.use_per_corrective(rc, ot, ev, tax)._jdf.queryExecution().optimizedPlan().toString()


def test_consumption_map_is_grouped_in_tasks_in_proportion_to_its_rows(spark, monkeypatch):
    ot, ev, tax, rc, a = _parts_tables(spark)
    monkeypatch.setattr(D, "MAP_ROWS_PER_TASK", 20)
    e = ev.join(tax.filter("trim(sistema) <> ''"), "taxonomia_id")
    made = e.join(rc.filter("trim(sku) <> '' and cantidad is not null"), "ot_id").count()
    plan = D.consumption_map(ot, ev, tax, rc, a)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("RepartitionByExpression")[1].splitlines()[0]
    assert "marca" in top and top.endswith(f", {-(-made // 20)}") and made > 200


def test_demand_does_not_sort_the_consumption_map(spark):
    sr = spark.createDataFrame([("a", "P1_critica", "x"), ("b", "P2_alta", "x"), ("b", "P4_baja", "y")], "activo_id string, prioridad string, sistema_en_riesgo string")
    a = spark.createDataFrame([("a", "m", "n"), ("b", "m", "n")], "activo_id string, marca string, modelo string")
    csm = spark.range(6).selectExpr("'m' marca", "'n' modelo", "if(id < 4, 'x', 'y') sistema", "cast(id % 3 as string) sku", "cast(id as double) cantidad_promedio")
    rm = spark.createDataFrame([], "sku string, descripcion string, stock_actual double, lead_time_dias_promedio double, criticidad string")
    got = D.projected_demand(sr, a, csm, rm, spark.createDataFrame([], "sku string, consumo_promedio_mensual double"))
    assert {r.sku: r.demanda_prediccion for r in got.collect()} == {"0": 6.0, "1": 2.0, "2": 4.0}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.projected_demand(sr, a, csm, rm, spark.createDataFrame([], "sku string, consumo_promedio_mensual double"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ShuffledHashJoin") == 1


def test_interventions_meet_only_the_best_parts(spark):
    """Repeated assets, folded names and ties: the first three parts are those of the whole join, over few joined rows."""
    inter = spark.createDataFrame([("P1", "Motor", 1), ("P2", "freno", 1), ("P3", None, 1), ("P4", "motor", 0)], "patente string, sistema string, h30 int")
    inter = inter.selectExpr("*", "'t' tipo", "'P1_critica' urgencia", "1.0D costo_estimado", "2.0D costo_no_intervenir")
    a = spark.createDataFrame([("p1", "M", "o"), ("P1", "m", "O"), ("P1", "m", "x"), ("P2", "M", "o")], "patente string, marca string, modelo string")
    csm = spark.range(5000).selectExpr("if(id % 2 = 0, 'm', 'M') marca", "if(id % 3 = 0, 'o', 'X') modelo", "if(id % 5 = 0, 'FRENO', 'motor') sistema",
                                       "cast(id % 900 as string) sku", "cast(id % 7 as double) cantidad_promedio")
    rm = spark.range(850).selectExpr("cast(id % 800 as string) sku", "if(id % 11 = 0, null, 'd' || id % 13) descripcion")
    got = D.interventions_with_parts(inter, a, csm, rm)
    j = inter.filter("h30 = 1").alias("i").join(a.alias("a"), F.expr("lower(i.patente) = lower(a.patente)")) \
        .join(csm.alias("c"), F.expr("lower(a.marca) = lower(c.marca) and lower(a.modelo) = lower(c.modelo) and lower(i.sistema) = lower(c.sistema)")) \
        .join(rm.filter("descripcion is not null").alias("r"), F.expr("c.sku = r.sku")).selectExpr("i.patente", "cantidad_promedio q", "descripcion d", "c.sku")
    rows = sorted(j.collect(), key=lambda r: (-r.q, r.d, r.sku))
    best = {p: ", ".join([r.d for r in rows if r.patente == p][:3]) or "N/A" for p in ("P1", "P2", "P3")}
    assert {r.patente: r.repuestos_sugeridos for r in got.collect()} == best
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number()") == 2


@pytest.mark.parametrize("n_left, n_right", [(3, 2000), (2000, 3), (60, 60)])
def test_salted_join_is_dealt_by_the_rows_it_makes(spark, n_left, n_right):
    """One key makes nearly all rows: whichever side is larger, no partition holds much more than its share, and no row is lost or added."""
    left = spark.range(n_left).selectExpr("'k' k", "id").unionByName(spark.createDataFrame([("none", -1), (None, -2)], "k string, id long"))
    right = spark.range(n_right).selectExpr("'k' k", "id r").unionByName(spark.createDataFrame([("other", -1), (None, -2)], "k string, r long"))
    got = salted_join(left, right, "k", "id", 100)
    assert Counter(map(tuple, got.select("k", "id", "r").collect())) == Counter(map(tuple, left.join(right, "k", "left").select("k", "id", "r").collect()))
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < n_left * n_right / 4


@pytest.mark.parametrize("n_left, n_right", [(3000, 3000), (3000, 40)])
def test_salted_join_copies_few_rows(spark, n_left, n_right):
    """Both sides are cut: the copies do not grow with a whole side for each task, and every pair meets in one tile."""
    left, right = spark.range(n_left).selectExpr("'k' k", "id"), spark.range(n_right).selectExpr("'k' k", "id r")
    lhs, rhs = joins.tiled(left, right, "k", "id", 10_000, ())
    tiles = n_left * n_right / 10_000
    assert lhs.count() + rhs.count() < 4 * (n_left + n_right) * max(1, tiles ** 0.5) and lhs.rdd.getNumPartitions() >= tiles
    pairs = salted_join(left, right, "k", "id", 10_000)
    assert pairs.count() == n_left * n_right == pairs.distinct().count()


def test_salted_join_has_a_bounded_number_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_TILES", 50)
    left, right = spark.range(500).selectExpr("'k' k", "id"), spark.range(300).selectExpr("'k' k", "id r")
    lhs, rhs = joins.tiled(left, right, "k", "id", 10, ())
    most = max(50, 8 * spark.sparkContext.defaultParallelism)
    assert lhs.rdd.getNumPartitions() <= 2 * most and rhs.select("_salt").distinct().count() > most / 4
    assert salted_join(left, right, "k", "id", 10).count() == 500 * 300


def test_demand_leaves_the_consumption_map_where_it_is(spark):
    """The groups are few and measured, so the stored map is not shuffled for them."""
    sr = spark.createDataFrame([("a", "P1_critica", "x")], "activo_id string, prioridad string, sistema_en_riesgo string")
    a = spark.createDataFrame([("a", "m", "n")], "activo_id string, marca string, modelo string")
    csm = spark.range(6).selectExpr("'m' marca", "'n' modelo", "'x' sistema", "cast(id % 3 as string) sku", "cast(id as double) cantidad_promedio")
    rm = spark.createDataFrame([], "sku string, descripcion string, stock_actual double, lead_time_dias_promedio double, criticidad string")
    got = D.projected_demand(sr, a, csm, rm, spark.createDataFrame([], "sku string, consumo_promedio_mensual double"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and "hashpartitioning(marca" not in plan
    assert {r.sku: r.demanda_prediccion for r in got.collect()} == {"0": 3.0, "1": 5.0, "2": 7.0}


def test_stored_fleet_tables_leave_no_shuffle_files(spark, tmp_path):
    """A table that is written once and read back keeps nothing of its shuffles, and the session's setting comes back."""
    from fleetlens.session import shuffles_dropped

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = lambda: {b.name() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if b.isShuffle()}
    before, df = blocks(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    with shuffles_dropped(spark):
        with shuffles_dropped(spark):
            pass
        assert spark.conf.get(name) == "true"
        df.write.parquet(f"{tmp_path}/t")
    until = time.time() + 20
    while blocks() - before and time.time() < until:  # they are removed beside the query
        time.sleep(0.2)
    assert spark.conf.get(name) == "false" and not blocks() - before
    assert spark.read.parquet(f"{tmp_path}/t").count() == 7 == df.count()


def test_panel_rows_are_dealt_in_whole_rounds_of_tasks(spark, monkeypatch):
    """One task more than cores would cost every pass of a fit a second round with idle cores."""
    from fleetlens.operators import ml as M

    cores = spark.sparkContext.defaultParallelism
    panel = spark.range(100 * (cores + 1)).selectExpr("string(id) activo_id", "date'2000-01-01' fecha_corte", "30 horizonte_dias")
    monkeypatch.setattr(M, "TASK_ROWS_MOST", 100)
    assert M.dealt(panel, 10).rdd.getNumPartitions() == 2 * cores and M.dealt(panel, 10).count() == panel.count()
    assert M.dealt(panel, 100 * (cores + 1)).rdd.getNumPartitions() == panel.rdd.getNumPartitions()
