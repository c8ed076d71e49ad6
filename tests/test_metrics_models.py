"""The metric compiler and its history, the model store, the bounded search and the salted join on small cases."""

import datetime as dt
from random import Random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import classify as C
from fleetlens.operators import metrics, ml, model_store
from fleetlens.operators.joins import salted_join
from fleetlens.sources import ingest
from fleetlens.sources.fixtures import AS_OF, fleet

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return {(r.vista, r.metrica, r.horizonte_dias): r for r in df.collect()}


def test_run_without_any_table(spark):
    got = rows_of(metrics.run(spark, {}, AS_OF))
    assert {r.nota for r in got.values()} == {metrics.MISSING}
    assert len(got) == len(metrics.metrics()) + 8
    assert got[metrics.STATUS, "Fallas anticipadas", None].valor == 0.0 and got[metrics.STATUS, "MTBF", None].valor is None


def test_run_on_empty_tables(spark):
    tables = {n: df.limit(0) for n, df in fleet(spark, SMALL).panel_inputs().items()}
    got = rows_of(metrics.run(spark, tables, AS_OF))
    assert got[metrics.IMPACT, "Costo evitado", None].valor == 0.0 and got[metrics.ACTION, "SKU en quiebre", None].valor == 0.0
    assert not any(r.nota for r in got.values()) and not any(h for _, _, h in got)


def test_stand_in_column(spark):
    ot = fleet(spark, SMALL).ordenes_trabajo.withColumnRenamed("costo_total_clp", "costo")
    ot.createOrReplaceTempView("otra_ordenes_trabajo")
    found = metrics.resolve(spark, prefix="otra_")
    assert set(found) == {"ordenes_trabajo"} and "costo_total_clp" in found["ordenes_trabajo"].columns


def test_plan_reads_each_table_few_times(spark):
    df = metrics.run(spark, fleet(spark, SMALL).panel_inputs(), AS_OF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") <= 20


def test_history_and_merge(spark):
    run = "vista string, metrica string, horizonte_dias int, valor double, nota string"
    day = lambda n: dt.date(2000, 1, n)
    kept = metrics.history(spark.createDataFrame([("v", "Recall", None, 1.0, None, day(1)), ("v", "x", 7, 5.0, None, day(1))], run + ", fecha_calculo date"))
    kept = metrics.merge(kept, spark.createDataFrame([("v", "Recall", None, 2.0, None)], run), day(8))
    kept = metrics.merge(kept, spark.createDataFrame([("v", "Recall", None, 3.0, None)], run), day(8))  # the same day again
    got = sorted((r.metrica, r.valor, r.valor_anterior, r.delta_color, r.desde, r.hasta) for r in kept.collect())
    assert got == [("Recall", 1.0, None, "positive", day(1), day(8)), ("Recall", 3.0, 1.0, "positive", day(8), None), ("x", 5.0, None, "neutral", day(1), None)]
    assert sorted((r.metrica, r.valor) for r in metrics.current(kept).collect()) == [("Recall", 3.0), ("x", 5.0)]
    assert sorted((r.metrica, r.valor) for r in metrics.current(kept, day(7)).collect()) == [("Recall", 1.0), ("x", 5.0)]


def test_model_store(spark, tmp_path):
    base = str(tmp_path)
    panel = spark.createDataFrame([(1, 2.0, None), (2, 0.5, 4.0)], "id int, a double, b double")
    record = ml.metadata(spark, "v1", 7, ["a", "b"], {"x": 1}, 10, 5, 0.5, {"auc": 0.7})
    with pytest.raises(LookupError):
        model_store.load(spark, base)
    for name in ("uno", "dos"):
        model_store.save(spark, base, name, model_store.rule_model(spark, "a * 0.25 + greatest(b, 0) * 0.125"), record)
    model_store.register(spark, base, {"uno": {"auc": 0.7}, "dos": {}}, dt.datetime(2000, 1, 1))
    with pytest.raises(LookupError):
        model_store.load(spark, base)  # registered, none active
    with pytest.raises(ValueError):
        model_store.activate(spark, base, "tres")
    model_store.activate(spark, base, "uno")
    model = model_store.load(spark, base)
    assert (model.modelo_id, model.version, model.features, model.hyperparameters) == ("uno", "v1", ["a", "b"], {"x": 1})
    assert [r.probabilidad_falla for r in model.predict(panel).orderBy("id").collect()] == [0.5, 0.625]
    with pytest.raises(ValueError, match="b"):
        model.predict(panel.drop("b"))
    listed = ml.registry_list(model_store.registry(spark, base)).collect()
    assert [(r.modelo_id, r.es_activo) for r in listed] == [("dos", False), ("uno", True)]
    with pytest.raises(Exception):  # a model id is written once
        model_store.save(spark, base, "uno", model_store.rule_model(spark, "a"), record)


def test_forest_predictions(spark):
    """M2, M8: the forest read back from the store predicts every test row; the trees' importances are told."""
    from fleetlens.plans import catalog

    got = catalog.QUERIES["M2_rf_test_predictions"](spark, SMALL)
    assert got.count() > 0 and got.filter(~F.col("probabilidad_falla").between(0, 1)).count() == 0


def small_panel(spark, n):
    """Rows of one partition with two features, a null among them, and a target that follows the first."""
    r = Random(5)
    rows = [(i, dt.date(2000, 1, 1 + i % 20), 7, int(r.random() * 8 + i % 10 > 8), i % 10, None if i % 7 == 0 else r.randrange(50)) for i in range(n)]
    return spark.createDataFrame(rows, "activo_id int, fecha_corte date, horizonte_dias int, target int, a int, b int").coalesce(1)


def fitted_on(monkeypatch, fit, *args):
    """The rows that a trainer's pipeline is given and its last stage; nothing is trained."""
    seen = {}

    class Spy:
        def __init__(self, stages):
            seen["stage"] = stages[-1]

        def fit(self, data):
            seen["data"] = data

    with monkeypatch.context() as m:
        m.setattr(ml, "Pipeline", Spy)
        fit(*args)
    return seen["data"], seen["stage"]


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    """rows that lie in one task are trained on in several, none lost or twice; a small panel stays where it is."""
    panel = small_panel(spark, 400)
    assert fitted_on(monkeypatch, ml.train_rf, panel, ["a", "b"])[0].rdd.getNumPartitions() == 1
    monkeypatch.setattr(ml, "FOREST_TASK_ROWS", 100)
    data = fitted_on(monkeypatch, ml.train_rf, panel, ["a", "b"])[0]
    sizes = data.rdd.glom().map(len).collect()
    assert len(sizes) == min(4, spark.sparkContext.defaultParallelism) and max(sizes) < 2 * 400 / len(sizes)
    assert sorted(r.activo_id for r in data.collect()) == list(range(400))


def test_evaluation_scores_rows_once(spark, monkeypatch):
    """threshold, AUC and rates come from one pass of the trees over the test rows."""
    from fleetlens.plans import ml_queries

    scored = spark.sparkContext.accumulator(0)

    def score(target, a):
        scored.add(1)
        return (a + 3 * target) / 16

    def predictions(spark, d, kind):
        p = small_panel(spark, 200).withColumn("probabilidad_falla", F.udf(score, "double")("target", "a"))
        return p.select("activo_id", "fecha_corte", "horizonte_dias", "target", "probabilidad_falla")

    monkeypatch.setattr(ml_queries, "_test_predictions", predictions)
    (got,) = ml_queries.m1eval(spark, "").collect()
    assert scored.value == 200
    rows = [((r.a + 3 * r.target) / 16, r.target) for r in small_panel(spark, 200).collect()]
    hit = [y for x, y in rows if x >= got.threshold_optimo]
    assert (got.tp, got.fp, got.fn) == (sum(hit), len(hit) - sum(hit), sum(y for _, y in rows) - sum(hit))
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    assert got.auc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))


def test_forest_keeps_nodes_between_passes(spark, monkeypatch):
    """the forest is the one that walks every row down all trees again in each pass."""
    data, stage = fitted_on(monkeypatch, ml.train_rf, small_panel(spark, 300), ["a", "b"], 5)
    assert stage.getCacheNodeIds()
    x = ml._assembler(["a", "b"]).transform(data)
    assert stage.fit(x).toDebugString.split("\n")[1:] == stage.copy({stage.cacheNodeIds: False}).fit(x).toDebugString.split("\n")[1:]


@pytest.mark.parametrize("weights", [(0.5, 0.3, 0.1, 0.1), (0.6, 0.4, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0)])
def test_bounded_search_equals_all_pairs(spark, weights):
    r = Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    orders = [(str(i), r.choice([text(r.randrange(1, 9)), text(60), "", None]), r.choice(["s1", "s2", None]), r.choice(["c1", None])) for i in range(400)]
    tax = [(f"t{i}", f"s{i % 3}", f"c{i % 5}", i % 7 + 1, text(r.randrange(1, 6)) if i % 11 else "") for i in range(300)]
    modes = [(i + 1, f"m{i}", ",".join(r.sample(words, i)) if i else None) for i in range(7)]
    o = spark.createDataFrame(orders, "ot_id string, descripcion_falla string, sistema_actual string, componente_actual string")
    cat = C.catalogue(spark.createDataFrame(tax, "taxonomia_id string, sistema string, componente string, id_modo_falla long, descripcion_estandar string"),
                      spark.createDataFrame(modes, "id_modo_falla long, modo string, palabras_claves string"))
    few = C.best_candidates(o, cat, weights)
    want = C.classify(o, cat, weights, scored=C.candidates(o, cat, weights)).collect()
    assert sorted(map(repr, C.classify(o, cat, weights, scored=few).collect())) == sorted(map(repr, want))
    done, all_pairs = few.agg(F.sum("evaluated")).first()[0], len(orders) * cat.count()
    assert done < all_pairs / 2, (done, all_pairs)


def test_bounded_search_in_passes(spark, monkeypatch):
    monkeypatch.setattr(C, "PASS", 4)
    tax = spark.createDataFrame([(f"t{i:02d}", "s", "c", 1, f"texto {i}") for i in range(20)], "taxonomia_id string, sistema string, componente string, id_modo_falla long, descripcion_estandar string")
    cat = C.catalogue(tax, spark.createDataFrame([(1, "m", "texto")], "id_modo_falla long, modo string, palabras_claves string"))
    o = spark.createDataFrame([("a", "texto 7"), ("b", "texto")], "ot_id string, descripcion_falla string")
    got = {r.ot_id: r.taxonomia_id for r in C.best_candidates(o, cat).collect()}
    assert got == {"a": "t07", "b": "t00"}


def test_ratio_around_the_junk_limit():
    from difflib import SequenceMatcher

    for n in (199, 200):
        a, b = "abc " * 80 + "xyz", ("ab cx" * 40)[:n]
        assert C.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("per_task", [1, 7, 1000])
def test_salted_join(spark, per_task):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)] + [(99, None)], "id int, k string")
    right = spark.createDataFrame([("hot", x) for x in range(5)] + [("k3", 9), ("zz", 1)], "k string, v int")
    got = salted_join(left, right, "k", "id", per_task)
    assert sorted(map(repr, got.select("id", "k", "v").collect())) == sorted(map(repr, left.join(right, "k", "left").select("id", "k", "v").collect()))


def test_refused_records(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write('id,n,t\n1,5,"a ""b"" c"\n,6,x\n3,seis,x\n4,7\n5,,"dos\nlíneas"\n')
    schema = "id string, n int, t string"
    from pyspark.sql.types import _parse_datatype_string

    rows, refused = ingest.load_typed_csv(spark, path, _parse_datatype_string(schema), ["id"])
    assert sorted(map(tuple, rows.collect())) == [("1", 5, 'a "b" c'), ("5", None, "dos\nlíneas")]
    assert sorted(r.motivo for r in refused.collect()) == ["falta id", "número de campos", "tipo de n"]
