"""The KPI panel run as data.

A metric names what it needs and its value; the run is compiled from the list. Every stored table is aggregated
once, by asset or by order, with one conditional aggregate for all metrics that read it; the partial
aggregates meet the assets in one join, and one final aggregate yields the long rows. A metric whose table or
column the catalogue lacks becomes a row with a note inside the same plan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import active_asset, blank_default, hours_between, is_corrective, lower_in
from ..sources.ingest import column_exists, table_exists
from . import parts
from .common import event_order
from .ml import recall_precision_active
from .panels import PANEL_COLS, ago, ago_ts, mean_anticipation, skus_below_minimum, units_operating

STATUS, ACTION, IMPACT, HEAT = "Estado y Riesgo", "Plan de Acción", "Impacto y Desempeño", "Mapa de calor"
MISSING = "Tabla faltante"
#: Tables that a run reads, and for a column the names that stand in for it.
INPUTS = ("activos", "ordenes_trabajo", "ot_falla_evento", "taxonomia_fallas", "scoring_resultados", "feedback_taller",
          "disponibilidad_diaria", "repuestos_maestro", "repuestos_panel_criticos", "modelos_registro")
STAND_INS = {("ordenes_trabajo", "costo_total_clp"): "costo"}

Tables = Mapping[str, DataFrame]


def resolve(spark: SparkSession, names: Sequence[str] = INPUTS, prefix: str = "") -> dict[str, DataFrame]:
    """The tables of ``names`` that the catalogue has (as ``prefix`` + name), a stand-in column under the name of the
    one it replaces. An absent table is absent from the result."""
    found = {n: spark.table(prefix + n) for n in names if table_exists(spark, prefix + n)}
    for (table, column), other in STAND_INS.items():
        df = found.get(table)
        if df is not None and not column_exists(df, column) and column_exists(df, other):
            found[table] = df.withColumnRenamed(other, column)
    return found


@dataclass(frozen=True, eq=False)
class Metric:
    """``needs`` lists tables and table.column names; ``value`` is an aggregate over the per-asset partials; ``absent``
    is the value shown when something needed is missing."""

    vista: str
    metrica: str
    needs: tuple[str, ...]
    value: Column
    absent: float | None = None


def available(tables: Tables, needs: Sequence[str]) -> bool:
    return all(n.split(".")[0] in tables and ("." not in n or column_exists(tables[n.split(".")[0]], n.split(".")[1])) for n in needs)


def _when(condition: Column, value: Column | int) -> Column:
    return F.when(condition, value if isinstance(value, Column) else F.lit(value))


def _exact(c: Column, scale: int) -> Column:
    return F.sum(c.cast(f"decimal(38,{scale})"))


def _up(name: str) -> Column:
    return F.coalesce(name, F.lit(0.0))


def availability_partials(dd: DataFrame, as_of: dt.date) -> DataFrame:
    """Hours of the last 30 and 90 days by asset."""
    up, off = F.col("horas_operativas"), F.col("horas_detenido_no_planificado")
    near = F.col("fecha") >= ago(as_of, 30)
    every = _up("horas_operativas") + _up("horas_detenido_planificado") + _up("horas_detenido_no_planificado")
    ratio = F.when(up + off > 0, up / (up + off) * 100.0).otherwise(F.lit(100.0))
    return dd.filter(F.col("fecha") >= ago(as_of, 90)).groupBy("activo_id").agg(
        _exact(_when(near, _up("horas_operativas")), 2).alias("up30"),
        _exact(_when(near, every), 2).alias("all30"),
        F.sum(_when(near, ratio)).alias("ratio30"),
        F.count(_when(near, ratio)).alias("days30"),
        _exact(_up("horas_operativas"), 2).alias("up90"),
    )


def order_partials(ot: DataFrame, as_of: dt.date) -> DataFrame:
    """Counts, hours, cost and odometer of the recent or open orders by asset."""
    opened, closed = F.col("fecha_apertura"), F.col("fecha_cierre")
    near, far = opened >= ago_ts(as_of, 30), opened >= ago_ts(as_of, 90)
    done = closed >= ago_ts(as_of, 90)
    one = F.lower(F.coalesce("tipo_ot", F.lit(""))) == "correctiva"
    planned = lower_in("tipo_ot", ("preventiva", "preventivo"))
    hours = hours_between("fecha_apertura", "fecha_cierre")
    cost = [_exact(_when(near, F.col("costo_total_clp")), 2).alias("cost30")] if column_exists(ot, "costo_total_clp") else []
    return ot.filter(closed.isNull() | far | done).groupBy("activo_id").agg(
        F.count(_when(is_corrective() & far, 1)).alias("corrective90"),
        _exact(_when(done, hours), 6).alias("hours90"),
        F.count(_when(done & one, 1)).alias("repairs90"),
        _exact(_when(done & one, hours), 6).alias("repair_hours90"),
        F.count(_when(closed.isNull(), 1)).alias("open"),
        F.count(_when(planned & far, 1)).alias("planned90"),
        F.count(_when(planned & far & closed.isNotNull(), 1)).alias("planned_closed90"),
        F.count(_when(near, 1)).alias("orders30"),
        F.max(_when(near, F.col("odometro_km"))).alias("odo_max30"),
        F.min(_when(near, F.col("odometro_km"))).alias("odo_min30"),
        *cost,
    )


def feedback_partials(fb: DataFrame, sr: DataFrame | None, as_of: dt.date) -> DataFrame:
    """Feedback by asset, with the priority of its score where scores are there. Rows without a score keep keys of their own."""
    yes = F.coalesce(F.col("falla_confirmada") == F.lit(True), F.lit(False))
    false_alarm = F.col("falsa_alarma") == F.lit(True)
    waiting = F.col("falla_confirmada").isNull() & (F.col("falsa_alarma") == F.lit(False))
    scored: list[Column] = []
    if sr is not None:
        urgent = F.col("prioridad").isin(*vocab.URGENT)
        per = sr.groupBy(F.col("scoring_id").alias("_score")).agg(
            F.count(_when(F.col("prioridad") == vocab.P1, 1)).alias("_p1"), F.count(_when(F.col("prioridad") == vocab.P2, 1)).alias("_p2"),
            F.count(_when(urgent, 1)).alias("_alert"), F.count(_when(~F.coalesce(urgent, F.lit(False)), 1)).alias("_quiet"))
        key = F.coalesce("scoring_id", F.concat(F.lit("~"), "feedback_id"))
        fb = fb.withColumn("_score", key).join(per, "_score", "left")
        scored = [F.sum(_when(c, F.col(n))).alias(a) for a, n, c in (("p1_hit", "_p1", yes), ("p2_hit", "_p2", yes), ("tp", "_alert", yes),
                                                                     ("fp", "_alert", ~yes), ("fn", "_quiet", yes), ("tn", "_quiet", ~yes))]
    return fb.groupBy("activo_id").agg(
        F.count(F.lit(1)).alias("feedback"), F.count(_when(yes, 1)).alias("confirmed"),
        F.count(_when(false_alarm, 1)).alias("rejected"), F.count(_when(waiting, 1)).alias("pending"),
        F.count(_when(yes & (F.col("fecha_alerta") >= ago(as_of, 30)), 1)).alias("confirmed30"), *scored)


def score_partials(sr: DataFrame) -> DataFrame:
    """By asset, horizon and priority the last day with that score: the newest of a horizon is its snapshot."""
    return sr.groupBy("activo_id", "horizonte_dias", "prioridad").agg(F.max("fecha_scoring").alias("dia"))


def _sum(name: str) -> Column:
    return F.sum(name)


def _active(name: str) -> Column:
    return F.sum(_when(F.col("activo"), F.col(name)))


def _assets(name: str) -> Column:
    """Assets with a positive partial: a distinct count without expanding rows."""
    return F.count(_when((F.col(name) > 0) & F.col("activo_id").isNotNull(), 1))


def _share(num: Column, den: Column) -> Column:
    return F.round(F.when(den > 0, num.cast("double") / den.cast("double") * 100.0), 9)


def _over(num: Column, den: Column) -> Column:
    return F.round(F.when(den > 0, num.cast("double") / den.cast("double")), 9)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


FEEDBACK, SCORES, ORDERS, ASSETS, DAYS = "feedback_taller", "scoring_resultados", "ordenes_trabajo", "activos", "disponibilidad_diaria"
COST = f"{ORDERS}.costo_total_clp"


def metrics() -> list[Metric]:
    """The fleet-wide metrics of the views, in the views' order."""
    km = _zero(F.max("odo_max30")) - _zero(F.min("odo_min30"))
    pct = lambda name: F.coalesce(_share(_sum(name), _sum("feedback")), F.lit(0.0))
    return [
        Metric(STATUS, "Disponibilidad", (DAYS,), _share(_sum("up30"), _sum("all30"))),
        Metric(STATUS, "Fallas anticipadas", (FEEDBACK, ASSETS), _zero(_active("confirmed30")), 0.0),
        Metric(STATUS, "MTBF", (DAYS, ORDERS, ASSETS), _over(_active("up90"), _active("corrective90"))),
        Metric(ACTION, "Backlog OT", (ORDERS,), _zero(_sum("open"))),
        Metric(ACTION, "Cumplimiento PM", (ORDERS,), _share(_sum("planned_closed90"), _sum("planned90"))),
        Metric(IMPACT, "Costo mantenimiento km", (ORDERS, COST), _over(_zero(_sum("cost30")), km)),
        Metric(IMPACT, "Costo mantenimiento unidad", (ORDERS, COST), _over(_zero(_sum("cost30")), _assets("orders30"))),
        Metric(IMPACT, "Disponibilidad 30d", (DAYS,), _over(_sum("ratio30"), _sum("days30"))),
        Metric(IMPACT, "MTBF 90d", (ORDERS, ASSETS), F.coalesce(_over(_active("hours90"), _active("repairs90")), F.lit(0.0))),
        Metric(IMPACT, "MTTR 90d", (ORDERS, ASSETS), F.coalesce(_over(_active("repair_hours90"), _active("repairs90")), F.lit(0.0))),
        Metric(IMPACT, "Tasa alertas confirmadas", (FEEDBACK,), pct("confirmed")),
        Metric(IMPACT, "P1 confirmadas", (FEEDBACK, SCORES), _assets("p1_hit")),
        Metric(IMPACT, "P2 confirmadas", (FEEDBACK, SCORES), _assets("p2_hit")),
        Metric(IMPACT, "% Alertas confirmadas", (FEEDBACK,), pct("confirmed")),
        Metric(IMPACT, "% Alertas rechazadas", (FEEDBACK,), pct("rejected")),
        Metric(IMPACT, "% Alertas pendientes", (FEEDBACK,), pct("pending")),
        Metric(IMPACT, "Alertas confirmadas (count)", (FEEDBACK,), _zero(_sum("confirmed"))),
        Metric(IMPACT, "Alertas rechazadas (count)", (FEEDBACK,), _zero(_sum("rejected"))),
        Metric(IMPACT, "Alertas pendientes (count)", (FEEDBACK,), _zero(_sum("pending"))),
        *(Metric(IMPACT, f"Matriz {n}", (FEEDBACK, SCORES), _zero(_sum(n.lower()))) for n in ("TP", "FP", "FN", "TN")),
    ]


def _row(vista: str, metrica: str | Column, horizon: Column | None, value: Column) -> Column:
    return F.struct(F.lit(vista).alias("vista"), (metrica if isinstance(metrica, Column) else F.lit(metrica)).alias("metrica"),
                    (F.lit(None) if horizon is None else horizon).cast("int").alias("horizonte_dias"), value.cast("double").alias("valor"))


def asset_rows(tables: Tables, as_of: dt.date, wanted: Sequence[Metric]) -> DataFrame | None:
    """(vista, metrica, horizonte_dias, valor) of the fleet-wide metrics and of the score snapshots: one partial aggregate for
    each table, one join with the assets, one final aggregate."""
    used = {n.split(".")[0] for m in wanted for n in m.needs}
    partials = []
    if DAYS in used:
        partials.append(availability_partials(tables[DAYS], as_of))
    if ORDERS in used:
        partials.append(order_partials(tables[ORDERS], as_of))
    if FEEDBACK in used:
        partials.append(feedback_partials(tables[FEEDBACK], tables.get(SCORES), as_of))
    snapshots = SCORES in tables and ASSETS in tables
    if snapshots:
        partials.append(score_partials(tables[SCORES]))
    if not partials:
        return None
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), partials)
    if not snapshots:
        rows = rows.withColumns({"horizonte_dias": F.lit(None).cast("int"), "prioridad": F.lit(None).cast("string"), "dia": F.lit(None).cast("date")})
    if ASSETS in tables:
        flag = tables[ASSETS].select("activo_id", active_asset("estado_actual", "activo").alias("activo"))
        rows = rows.join(flag, "activo_id", "left")
    else:
        rows = rows.withColumn("activo", F.lit(None).cast("boolean"))
    # a fleet-wide row has no day; the others are few: horizons x priorities x days
    names = {m: f"_m{i}" for i, m in enumerate(wanted)}
    small = rows.groupBy("horizonte_dias", "prioridad", "dia").agg(
        F.count(_when(F.col("activo"), 1)).alias("_n"), *(m.value.cast("double").alias(n) for m, n in names.items()))
    small = small.withColumn("_newest", F.max("dia").over(Window.partitionBy("horizonte_dias")))
    fleet = F.array(*(_row(m.vista, m.metrica, None, F.col(n)) for m, n in names.items())) if names else F.array()
    h, n = F.col("horizonte_dias"), F.col("_n")
    urgent = F.coalesce(F.col("prioridad").isin(*vocab.URGENT), F.lit(False))
    soon = _row(ACTION, F.concat(F.lit("Intervenciones próximas "), h.cast("string"), F.lit("d")), h, F.when(urgent, n).otherwise(0))
    own = F.array(soon, *(F.when(F.col("prioridad") == p, _row(STATUS, label, h, n)) for p, label in ((vocab.P1, "P1 Crítica"), (vocab.P2, "P2 Alta"))))
    latest = (F.col("dia") == F.col("_newest")) & (n > 0)
    rows = small.filter(F.col("dia").isNull() | latest).select(F.explode(F.when(F.col("dia").isNull(), fleet).otherwise(own)).alias("r"))
    return rows.filter("r IS NOT NULL").select("r.*").groupBy("vista", "metrica", "horizonte_dias").agg(F.sum("valor").alias("valor"))


def order_rows(tables: Tables, as_of: dt.date) -> DataFrame:
    """Heat map (K14), avoided cost (K21) and avoided downtime (K22) from one pass over events, orders and confirmed feedback,
    all by order. Events without an order, or feedback, keep keys of their own; an order's system is its latest event's."""
    ot, ev, tax, fb = (tables[n] for n in (ORDERS, "ot_falla_evento", "taxonomia_fallas", FEEDBACK))
    limits = (7, 30, 90)
    e = ev.join(tax.select("taxonomia_id", "sistema"), "taxonomia_id").select(
        F.coalesce("ot_id", F.concat(F.lit("~"), F.col("id_evento").cast("string"))).alias("_o"), "sistema", "fecha_evento", "id_evento", "taxonomia_id")
    seen = e.withColumn("_rn", F.row_number().over(Window.partitionBy("_o").orderBy(*event_order())))

    def band(t: Column, i: int) -> Column:
        newer = t >= ago_ts(as_of, limits[i])
        return newer if not i else newer & (t < ago_ts(as_of, limits[i - 1]))

    own = F.to_timestamp_ntz(F.col("fecha_evento"))
    per = seen.groupBy("_o", "sistema").agg(F.min("_rn").alias("_rn"), F.count(_when(F.col("fecha_evento").isNull(), 1)).alias("_undated"),
                                            *(F.count(_when(band(own, i), 1)).alias(f"_d{d}") for i, d in enumerate(limits)))
    opened = F.col("fecha_apertura")
    hours = F.when(F.col("fecha_cierre").isNotNull() & opened.isNotNull(), hours_between("fecha_apertura", "fecha_cierre"))
    cost = F.col("costo_total_clp") if column_exists(ot, "costo_total_clp") else F.lit(None)
    orders = ot.select(F.col("ot_id").alias("_o"), opened, hours.alias("_h"), cost.cast("decimal(24,2)").alias("_cost"))
    hits = fb.filter(F.col("falla_confirmada") == F.lit(True)).groupBy(F.coalesce("ot_id", F.lit("~")).alias("_o")).agg(F.count(F.lit(1)).alias("_hits"))
    j = orders.join(hits, "_o", "full").join(per, "_o", "full")
    head = F.coalesce(F.col("_rn") == 1, F.lit(True))
    count = lambda i, d: F.coalesce(f"_d{d}", F.lit(0)) + F.when(band(opened, i), F.coalesce("_undated", F.lit(0))).otherwise(0)
    g = j.groupBy("sistema").agg(
        *(F.sum(count(i, d)).alias(f"n{d}") for i, d in enumerate(limits)),
        F.sum(_when(head, F.col("_hits"))).alias("hits"), _exact(_when(head, F.col("_h")), 6).alias("h"), F.count(_when(head, F.col("_h"))).alias("nh"),
        F.sum(_when(head, F.col("_hits").cast("decimal(10,0)") * F.col("_cost"))).alias("cost"))
    mean = F.when(F.col("nh") > 0, F.col("h").cast("double") / F.col("nh")).otherwise(0.0)
    # an order's system may be spelled as the default is: one mean for both
    group = F.coalesce("sistema", F.lit("sin_sistema"))
    both = Window.partitionBy("_group")
    g = g.withColumn("_group", group)
    for c in ("h", "nh"):
        g = g.withColumn(c, F.sum(c).over(both))
    none = F.lit(None).cast("decimal(38,2)")
    heat = [F.struct(_row(HEAT, blank_default("sistema"), F.lit(d), F.when(F.col(f"n{d}") > 0, F.col(f"n{d}"))).alias("r"), none.alias("x")) for d in limits]
    saved = [F.struct(_row(IMPACT, "Downtime evitado", None, F.coalesce(F.col("hits") * mean, F.lit(0.0))).alias("r"), none.alias("x")),
             F.struct(_row(IMPACT, "Costo evitado", None, F.lit(0.0)).alias("r"), F.coalesce("cost", F.lit(0)).cast("decimal(38,2)").alias("x"))]
    rows = g.select(F.inline(F.array(*heat, *saved))).filter("r.valor IS NOT NULL").select("r.*", "x")
    zero = F.struct
    empty = ot.sparkSession.range(1).select(F.inline(F.array(
        zero(_row(IMPACT, "Downtime evitado", None, F.lit(0.0)).alias("r"), none.alias("x")),
        zero(_row(IMPACT, "Costo evitado", None, F.lit(0.0)).alias("r"), none.alias("x"))))).select("r.*", "x")
    total = F.coalesce(F.sum("x").cast("double"), F.sum("valor"))
    total = F.when(F.col("metrica") == "Downtime evitado", F.round(total, 6)).otherwise(total)
    return rows.unionByName(empty).groupBy("vista", "metrica", "horizonte_dias").agg(total.alias("valor"))


def _single(df: DataFrame, vista: str, metrica: str, col: str = "valor") -> DataFrame:
    return df.select(_row(vista, metrica, None, F.col(col)).alias("r")).select("r.*")


def run(spark: SparkSession, tables: Tables, as_of: dt.date, previous: DataFrame | None = None) -> DataFrame:
    """Vista, metrica, horizonte_dias, valor, valor_anterior and nota of every metric, as one plan.

    ``tables`` has what there is of ``INPUTS`` (``resolve``); what a missing one would have given is a row with a note.
    ``previous`` has the rows of the run before (``current``): their value becomes valor_anterior."""
    fleet = metrics()
    there = [m for m in fleet if available(tables, m.needs)]
    gone = [(m.vista, m.metrica, m.absent) for m in fleet if not available(tables, m.needs)]
    found = [spark.createDataFrame([], "vista string, metrica string, horizonte_dias int, valor double"), asset_rows(tables, as_of, there)]

    def add(vista: str, names: Mapping[str, float | None], needs: Sequence[str], rows) -> None:
        if available(tables, needs):
            found.append(rows())
        else:
            gone.extend((vista, n, v) for n, v in names.items())

    add(STATUS, {"Unidades operativas": None}, (ASSETS,), lambda: _single(units_operating(tables[ASSETS]), STATUS, "Unidades operativas"))
    orders = (ORDERS, "ot_falla_evento", "taxonomia_fallas", FEEDBACK)
    no_cost = F.lit(available(tables, orders) and not available(tables, (COST,))) & (F.col("metrica") == "Costo evitado")
    add(IMPACT, {"Downtime evitado": None}, orders, lambda: order_rows(tables, as_of).filter(~no_cost))
    if not available(tables, (*orders, COST)):
        gone.append((IMPACT, "Costo evitado", None))
    add(ACTION, {"SKU en quiebre": 0.0}, ("repuestos_maestro",), lambda: _single(skus_below_minimum(tables["repuestos_maestro"]), ACTION, "SKU en quiebre"))
    add(IMPACT, {"Anticipacion promedio": None}, (FEEDBACK, ORDERS),
        lambda: _single(mean_anticipation(tables[FEEDBACK], tables[ORDERS]), IMPACT, "Anticipacion promedio"))
    add(IMPACT, {"Cobertura stock": None}, ("repuestos_panel_criticos",),
        lambda: _single(parts.stock_coverage(tables["repuestos_panel_criticos"]), IMPACT, "Cobertura stock"))
    add(IMPACT, {"Recall": None, "Precision": None}, ("modelos_registro",), lambda: recall_precision_active(tables["modelos_registro"]).select(
        F.explode(F.array(_row(IMPACT, "Recall", None, F.col("recall_pct")), _row(IMPACT, "Precision", None, F.col("precision_pct")))).alias("r")).select("r.*"))
    out = reduce(lambda a, b: a.unionByName(b), [f for f in found if f is not None]).withColumn("nota", F.lit(None).cast("string"))
    if gone:
        noted = spark.createDataFrame([(v, m, None, x, MISSING) for v, m, x in gone], "vista string, metrica string, horizonte_dias int, valor double, nota string")
        out = out.unionByName(noted)
    if previous is None:
        return out.withColumn("valor_anterior", F.lit(None).cast("double")).select(*PANEL_COLS[:4], "valor_anterior", "nota")
    before = previous.select(F.col("vista").alias("_v"), F.col("metrica").alias("_m"), F.col("horizonte_dias").alias("_h"), F.col("valor").alias("valor_anterior"))
    same = (F.col("vista") == F.col("_v")) & (F.col("metrica") == F.col("_m")) & F.col("horizonte_dias").eqNullSafe(F.col("_h"))
    return out.join(before, same, "left").select(*PANEL_COLS[:4], "valor_anterior", "nota")


# ------------------------------------------------------------------ K38: the metric store
KEY = ("vista", "metrica", "horizonte_dias")
#: Which way a metric should move (fixed values of the source's view 3); any other is neutral.
INVERSE = ("P1 confirmadas", "P2 confirmadas", "MTTR 90d", "% Alertas rechazadas")
POSITIVE = ("Disponibilidad 30d", "MTBF 90d", "Tasa alertas confirmadas", "Recall", "Precision", "Anticipacion promedio", "% Alertas confirmadas")


def history(runs: DataFrame) -> DataFrame:
    """K38 append-only: every value of every run (``runs``: fecha_calculo, the metric key, valor, nota) with the value before
    it, the colour of its change, and the dates from and until which it holds (hasta NULL: still)."""
    w = Window.partitionBy(*KEY).orderBy("fecha_calculo")
    colour = F.when(F.col("metrica").isin(*INVERSE), "inverse").when(F.col("metrica").isin(*POSITIVE), "positive").otherwise("neutral")
    return runs.select(*KEY, "valor", F.lag("valor").over(w).alias("valor_anterior"), "nota", colour.alias("delta_color"),
                       F.col("fecha_calculo").alias("desde"), F.lead("fecha_calculo").over(w).alias("hasta"))


def current(kept: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """K38 keyed: the one row of each metric that holds, at ``as_of`` or now. A metric that later runs lack keeps its row."""
    holds = F.col("hasta").isNull() if as_of is None else (F.col("desde") <= F.lit(as_of)) & (F.col("hasta").isNull() | (F.col("hasta") > F.lit(as_of)))
    return kept.filter(holds).select(*KEY, "valor", "valor_anterior", "nota")


def merge(kept: DataFrame, new: DataFrame, as_of: dt.date) -> DataFrame:
    """The history with a run of ``as_of`` merged in: rows that it follows are closed, a run of the same day is replaced."""
    runs = kept.filter(F.col("desde") != F.lit(as_of)).select(*KEY, "valor", "nota", F.col("desde").alias("fecha_calculo"))
    return history(runs.unionByName(new.select(*KEY, "valor", "nota", F.lit(as_of).alias("fecha_calculo"))))
