"""Spare parts, cost and interventions.

The reference loops over scores and SKUs in Python (``iterrows``) and runs one
correlated subquery per master row; here each of those is a join of
pre-aggregated inputs keyed by (system, sku) or asset.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import intervention_type, intervention_type_by_probability, is_corrective, priority_rank, \
    py_round, sku_ok, system_list
from ..session import stored
from .common import latest_order, latest_score
from .joins import may_broadcast, salted_join
from .panels import ago_ts, order_system
from .windows import distributed_row_number, latest_per_key, top_n_per_key


def half_up(x: Column, scale: int) -> Column:
    """Half-up rounding on the exact decimal value (PostgreSQL ``ROUND(numeric)``), as double."""
    return F.round(x.cast("decimal(38,10)"), scale).cast("double")


#: Order lines that one task joins: a few of them compress to little, but meet as many rows.
LINES_PER_TASK = 250_000


def order_parts(lines: DataFrame) -> int:
    """Partitions by order for a join with ``lines``, in proportion to their number, whatever they compress to."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // LINES_PER_TASK))


#: Rows of one task of the consumption map, which are nearly as many groups.
MAP_ROWS_PER_TASK = 500_000


def map_parts(events: DataFrame, lines: DataFrame, n: int) -> int:
    """Partitions in proportion to the rows that events and parts of the same orders make, counted by order in ``n`` tasks and not made."""
    ids = events.selectExpr("ot_id", "1 AS _a", "0 AS _b").unionByName(lines.selectExpr("ot_id", "0 AS _a", "1 AS _b"))
    orders = by_order(ids, n).groupBy("ot_id").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    made = orders.agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0  # one row
    return max(n, -int(-made // MAP_ROWS_PER_TASK))


def by_order(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "ot_id")


def consumption_map(ot: DataFrame, ev: DataFrame, tax: DataFrame, rc: DataFrame, a: DataFrame) -> DataFrame:
    """(brand, model, system, sku) -> mean quantity, distinct orders, rows.

    The event x part fan-out per order is the reference's definition (every
    event of an order pairs with every part of it); it is bounded by one
    order's lines. ``cantidad_total`` is kept so that D2 merges exactly."""
    e = ev.filter(F.col("ot_id").isNotNull()).join(tax.select("taxonomia_id", "sistema"), "taxonomia_id") \
        .filter(F.col("sistema").isNotNull() & (F.trim("sistema") != "")).select("ot_id", "sistema")
    p = rc.filter(F.col("sku").isNotNull() & (F.trim("sku") != "") & F.col("cantidad").isNotNull()) \
        .select("ot_id", "sku", "cantidad")
    o = ot.select("ot_id", "activo_id")
    aa = a.filter(F.col("marca").isNotNull() & F.col("modelo").isNotNull()).select("activo_id", "marca", "modelo")
    # each side is folded per order first (events by system, orders by model, parts by SKU), so that an order's fan-out is
    # multiplied instead of made and a joined row is already one distinct order of its group
    n = order_parts(p)
    events = by_order(e, n).groupBy("ot_id", "sistema").agg(F.count(F.lit(1)).alias("_e"))
    models = by_order(o.join(aa, "activo_id"), n).groupBy("ot_id", "marca", "modelo").agg(F.count(F.lit(1)).alias("_o"))
    used = by_order(p, n).groupBy("ot_id", "sku").agg(F.sum(F.col("cantidad").cast("decimal(38,4)")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    j = events.join(models.hint("merge"), "ot_id").join(used.hint("merge"), "ot_id")
    times = F.col("_e") * F.col("_o")
    # there are nearly as many groups as rows, so the rows are dealt to as many tasks as they need before they are grouped
    key = ["marca", "modelo", "sistema", "sku"]
    j = j.select(*key, (F.col("_q") * times).alias("_q"), (F.col("_n") * times).alias("_n")).repartition(map_parts(e, p, n), *key)
    return j.groupBy(*key).agg(
        F.sum("_q").cast("double").alias("cantidad_total"),
        F.sum("_n").alias("num_registros_analizados"),
        F.count(F.lit(1)).alias("frecuencia_fallos_historico"),
    ).withColumn("cantidad_promedio", F.col("cantidad_total") / F.col("num_registros_analizados"))


def orders_after(ot: DataFrame, high_water_mark) -> DataFrame:
    """D2 increment: orders strictly after the stored high-water mark (``>``: no order counted twice)."""
    return ot if high_water_mark is None else ot.filter(F.col("fecha_apertura") > F.lit(high_water_mark))


def merge_consumption(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental merge of D1 (full outer on the key): summed totals and counts, weighted mean
    rounded to 2 decimals. Orders must not straddle the two inputs (high-water mark is exclusive)."""
    k = ["marca", "modelo", "sistema", "sku"]
    o = old.select(*k, *[F.col(c).alias(f"o_{c}") for c in ("cantidad_total", "num_registros_analizados", "frecuencia_fallos_historico")])
    n = new.select(*k, *[F.col(c).alias(f"n_{c}") for c in ("cantidad_total", "num_registros_analizados", "frecuencia_fallos_historico")])
    j = o.join(n, k, "full")

    def s(c, typ):
        return (F.coalesce(F.col(f"o_{c}"), F.lit(0).cast(typ)) + F.coalesce(F.col(f"n_{c}"), F.lit(0).cast(typ)))

    tot = s("cantidad_total", "double")
    rows = s("num_registros_analizados", "bigint")
    return j.select(*k, tot.alias("cantidad_total"), rows.alias("num_registros_analizados"),
                    s("frecuencia_fallos_historico", "bigint").alias("frecuencia_fallos_historico"),
                    half_up(tot.cast("decimal(38,4)") / rows, 2).alias("cantidad_promedio"))


def monthly_sku(rc: DataFrame) -> DataFrame:
    """D3: per SKU total use, transactions, first/last date, months = greatest(ceil(days/30), 1), monthly mean."""
    p = rc.filter(F.col("sku").isNotNull() & (F.trim("sku") != "") & F.col("cantidad").isNotNull())
    g = p.groupBy("sku").agg(
        F.sum(F.col("cantidad").cast("decimal(38,4)")).alias("_tot"),
        F.count(F.lit(1)).alias("num_transacciones"),
        F.min(F.to_date("created_at")).alias("fecha_primera"),
        F.max(F.to_date("created_at")).alias("fecha_ultima"),
    )
    months = F.greatest(F.ceil(F.datediff("fecha_ultima", "fecha_primera") / 30.0).cast("int"), F.lit(1))
    return g.select("sku", F.col("_tot").cast("double").alias("consumo_total"), "num_transacciones", "fecha_primera",
                    "fecha_ultima", months.alias("num_meses"),
                    half_up(F.col("_tot") / months, 2).alias("consumo_promedio_mensual"))


def use_per_intervention(rc: DataFrame, ot: DataFrame, ev: DataFrame, tax: DataFrame, mapping: DataFrame,
                         as_of: dt.date, days: int = 180, dedupe: bool = False) -> DataFrame:
    """Per (mapped parts system, sku): quantity / distinct orders over orders opened in the window.

    ``dedupe=False`` keeps the reference's event fan-out (a part counts once per event of its order)."""
    o = ot.filter(F.col("fecha_apertura") >= ago_ts(as_of, days)).select("ot_id")
    e = ev.join(tax.select("taxonomia_id", "sistema"), "taxonomia_id") \
        .join(mapping, F.lower(F.col("sistema")) == F.lower(F.col("sistema_fallas"))) \
        .select("ot_id", F.lower("sistema_repuestos").alias("sistema_rep"))
    if dedupe:
        e = e.distinct()
    p = rc.filter(F.col("sku").isNotNull()).select("ot_id", "sku", "cantidad")
    j = p.join(o, "ot_id").join(e, "ot_id")
    return j.groupBy(F.col("sistema_rep").alias("sistema"), "sku").agg(
        (F.sum(F.col("cantidad").cast("decimal(38,4)")).cast("double") / F.count_distinct("ot_id"))
        .alias("cantidad_promedio_por_intervencion"))


def corrective_order_systems(ot: DataFrame, ev: DataFrame, tax: DataFrame, parts: int) -> DataFrame:
    """Distinct (corrective order, lower-cased event system) pairs, in ``parts`` partitions by order."""
    corr = by_order(ot.filter(F.lower(F.col("tipo_ot")).isin(*vocab.CORRECTIVE)).select("ot_id"), parts)
    e = ev.join(tax.select("taxonomia_id", "sistema"), "taxonomia_id").select("ot_id", F.lower("sistema").alias("sistema"))
    return by_order(e, parts).distinct().join(corr.hint("merge"), "ot_id").distinct()


def use_per_corrective(rc: DataFrame, ot: DataFrame, ev: DataFrame, tax: DataFrame) -> DataFrame:
    """Per (system, sku): quantity per corrective order, (order, system) deduplicated first."""
    p = rc.filter(F.col("sku").isNotNull()).select("ot_id", "sku", "cantidad")
    n = order_parts(p)
    # parts per order first: a joined row is then one distinct order of its (system, sku), counted without expanding rows
    used = by_order(p, n).groupBy("ot_id", "sku").agg(F.sum(F.col("cantidad").cast("decimal(38,4)")).alias("_q"))
    j = corrective_order_systems(ot, ev, tax, n).join(used.hint("merge"), "ot_id")
    return j.groupBy("sistema", "sku").agg(
        (F.sum("_q").cast("double") / F.count(F.lit(1))).alias("cantidad_media_por_ot"))


def corrective_cost_by_system(ot: DataFrame, ev: DataFrame, tax: DataFrame) -> DataFrame:
    """K33 variant used by the plan: mean non-null corrective order cost per (lower) event system."""
    e = ev.join(tax.select("taxonomia_id", "sistema"), "taxonomia_id").join(
        ot.filter(F.lower(F.col("tipo_ot")).isin(*vocab.CORRECTIVE) & F.col("costo_total_clp").isNotNull())
        .select("ot_id", "costo_total_clp"), "ot_id")
    # folded before grouping: "Motor" and "motor" are one system
    return e.groupBy(F.lower("sistema").alias("sistema")).agg(
        (F.sum(F.col("costo_total_clp").cast("decimal(38,2)")).cast("double") / F.count(F.lit(1))).alias("costo_correctivo_medio"))


# ---------------------------------------------------------------- demand panel
def projected_demand(sr: DataFrame, a: DataFrame, csm: DataFrame, rm: DataFrame, hist: DataFrame,
                     snapshot: str = "all") -> DataFrame:
    """P1/P2 assets x consumption map on (brand, model, system) -> projected demand per SKU.

    ``snapshot='all'`` (default, as the source) reads every scoring row, so an asset counts once per priority
    label it ever had; ``'latest'`` reads only the latest snapshot of each horizon."""
    if snapshot == "latest":
        from .panels import latest_snapshot

        sr = latest_snapshot(sr)
    ap = sr.filter(F.col("prioridad").isin(*vocab.URGENT)).join(a.select("activo_id", "marca", "modelo"), "activo_id") \
        .select("activo_id", "marca", "modelo", "sistema_en_riesgo", "prioridad").distinct()
    # pre-aggregate before the join: demand per SKU is a sum over (asset, label) rows, so count those rows per
    # (brand, model, system) group and join the groups, not every asset, to the consumption map
    groups = ap.groupBy("marca", "modelo", F.col("sistema_en_riesgo").alias("sistema")).agg(F.count(F.lit(1)).alias("_n"))
    c = csm.select("marca", "modelo", "sistema", "sku", "cantidad_promedio")
    # the few groups are stored and measured: where they may be broadcast, the map, which is many times larger, stays where it is; else
    # they are hashed, so that it is not sorted
    groups = stored(groups)
    j = groups.hint("broadcast" if may_broadcast(groups) else "shuffle_hash").join(c, ["marca", "modelo", "sistema"])
    g = j.groupBy("sku").agg(F.sum(F.col("cantidad_promedio").cast("decimal(38,6)") * F.col("_n")).alias("_tot"))
    out = g.join(rm.select("sku", "descripcion", "stock_actual", "lead_time_dias_promedio", "criticidad"), "sku", "left") \
        .join(hist.select("sku", F.col("consumo_promedio_mensual").alias("demanda_historico")), "sku", "left")
    return out.select("sku", "descripcion", "stock_actual", half_up(F.col("_tot"), 2).alias("demanda_prediccion"),
                      "demanda_historico", "lead_time_dias_promedio", "criticidad")


def coverage_action(d: DataFrame, lead_time_default: float = 0.0) -> DataFrame:
    """D7 (+F19): coverage days, % delta vs history, purchase action.

    NULLs become 0 first (so the reference's lead-time default of 7 never
    applies: effective default 0, a parameter here)."""
    z = d.fillna(0, subset=["stock_actual", "demanda_prediccion", "demanda_historico", "lead_time_dias_promedio"])
    dem, hist = F.col("demanda_prediccion"), F.col("demanda_historico")
    cov = F.when(dem > 0, F.col("stock_actual") / dem * 30.0)
    lt = F.coalesce(F.col("lead_time_dias_promedio"), F.lit(float(lead_time_default)))
    delta = F.when(hist > 0, (dem - hist) / hist * 100.0).otherwise(F.lit(0.0))
    action = (F.when(dem == 0, "N/A").when(cov.isNull(), "🔴 Comprar urgente").when(cov < lt, "🔴 Comprar urgente")
              .when(cov < lt + 7, "🟡 Comprar").otherwise("✅ OK"))
    return z.select("sku", "descripcion", "stock_actual", F.col("demanda_prediccion").alias("demanda_30d_prediccion"),
                    F.col("demanda_historico").alias("demanda_30d_historico"), lt.alias("lead_time_dias"),
                    F.round(cov, 9).alias("cobertura_dias"), "criticidad", action.alias("accion"),
                    F.round(delta, 9).alias("delta_demanda"))


def critical_panel(c: DataFrame, ok_top: int = 10) -> DataFrame:
    """D8 (W10): all urgent, all buy, and the top ``ok_top`` OK SKUs by predicted demand."""
    urgent = F.lower(F.col("accion")).contains("urgente")
    buy = F.lower(F.col("accion")).contains("comprar") & ~urgent
    ok = F.col("accion") == "✅ OK"
    # a global top-k: every task keeps its own k rows, only those reach the final merge
    ok_rows = c.filter(ok).orderBy(F.col("demanda_30d_prediccion").desc(), F.col("sku")).limit(ok_top)
    return c.filter(urgent).unionByName(c.filter(buy)).unionByName(ok_rows)


def stock_coverage(panel: DataFrame) -> DataFrame:
    """SKUs whose coverage reaches the lead time / SKUs with predicted demand (%)."""
    p = panel.filter(F.col("demanda_30d_prediccion") > 0)
    n = F.count(F.lit(1))
    cov = F.count(F.when(F.col("cobertura_dias") >= F.col("lead_time_dias"), 1))
    return p.agg(F.round(F.when(n > 0, cov.cast("double") / n * 100.0), 9).alias("valor"))


# ---------------------------------------------------------------- interventions
def interventions(sr: DataFrame, a: DataFrame, ot: DataFrame, ev: DataFrame, tax: DataFrame,
                  horizons: Sequence[int] = vocab.HORIZONS) -> DataFrame:
    """P1/P2 interventions merged across horizons by plate (first horizon wins, W12), flags per
    horizon, mean corrective cost of the system and cost of not acting = cost x p x 3."""
    aa = a.filter(~F.coalesce(F.lower("estado_actual"), F.lit("operativo")).isin(*vocab.RETIRED_STATES)) \
        .select("activo_id", "patente")
    per_h = None
    for h in horizons:
        us = latest_score(sr, h).filter(F.col("prioridad").isin(*vocab.URGENT))
        x = us.join(aa, "activo_id").select(
            "patente", "activo_id", F.lit(h).alias("h"), F.col("prioridad").alias("urgencia"), "probabilidad_falla",
            F.coalesce("sistema_en_riesgo", F.lit("Sin clasificar")).alias("sistema"),
            intervention_type(F.col("sistema_en_riesgo"), F.col("prioridad")).alias("tipo"))
        per_h = x if per_h is None else per_h.unionByName(x)
    first = F.min_by(F.struct("activo_id", "tipo", "sistema", "urgencia", "probabilidad_falla"), F.col("h"))
    flags = [F.max(F.when(F.col("h") == h, 1).otherwise(0)).alias(f"h{h}") for h in horizons]
    m = per_h.groupBy("patente").agg(first.alias("f"), *flags).select("patente", "f.*", *[f"h{h}" for h in horizons])
    osys = order_system(ev, tax)
    cost = ot.filter(F.col("fecha_cierre").isNotNull() & is_corrective()).join(osys, "ot_id", "left") \
        .select(F.lower(F.coalesce("sistema", F.lit("sin_sistema"))).alias("_sk"), "costo_total_clp") \
        .groupBy("_sk").agg(half_up(F.sum(F.coalesce("costo_total_clp", F.lit(0.0)).cast("decimal(38,2)"))
                                    / F.count(F.lit(1)), 0).alias("_cost"))
    j = m.join(cost, F.lower(F.coalesce(m.sistema, F.lit("sin_sistema"))) == cost._sk, "left")
    est = F.when(F.col("_cost") > 0, F.col("_cost"))
    return j.select("patente", "activo_id", "tipo", "sistema", "urgencia", "probabilidad_falla",
                    est.alias("costo_estimado"),
                    F.round(est * F.col("probabilidad_falla") * 3, 6).alias("costo_no_intervenir"),
                    *[f"h{h}" for h in horizons])


def upcoming_by_system(inter: DataFrame, mapping: DataFrame, horizon_flag: str = "h30") -> DataFrame:
    """Interventions of a horizon per mapped parts system."""
    i = inter.filter((F.col(horizon_flag) == 1) & F.col("sistema").isNotNull())
    j = i.join(mapping, F.lower(i.sistema) == F.lower(mapping.sistema_fallas))
    return j.groupBy(F.lower("sistema_repuestos").alias("sistema")).agg(F.count(F.lit(1)).alias("n_intervenciones_proximas"))


def required_stock(rm: DataFrame, use: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Stock required = use per intervention x upcoming interventions; gap; rows where both are 0 dropped."""
    m = rm.filter(F.col("sku").isNotNull()).select("sku", "descripcion", F.lower("sistema").alias("sistema"),
                                                   "stock_actual", "criticidad", "lead_time_dias_promedio",
                                                   "costo_unitario_clp")
    j = m.join(use, ["sistema", "sku"], "left").join(upcoming, "sistema", "left")
    cp = F.coalesce("cantidad_promedio_por_intervencion", F.lit(0.0))
    ni = F.coalesce("n_intervenciones_proximas", F.lit(0)).cast("int")
    stock = F.coalesce("stock_actual", F.lit(0.0))
    req = cp * ni
    return j.filter((cp > 0) | (ni > 0)).select(
        "sku", "descripcion", "sistema", stock.alias("stock_actual"), cp.alias("cantidad_promedio_por_intervencion"),
        ni.alias("n_intervenciones_proximas"), F.round(req, 9).alias("stock_requerido"),
        F.round(stock - req, 9).alias("brecha"), "criticidad", F.col("lead_time_dias_promedio").alias("lead_time_dias"),
        "costo_unitario_clp")


def parts_plan(scores: DataFrame, rm: DataFrame, cost: DataFrame, use: DataFrame, lead_time_critical: float = 15.0,
               actionable: Sequence[str] = vocab.URGENT, mapping: DataFrame | None = None, per_task: int = 1_000_000) -> DataFrame:
    """(asset x system x sku) plan from one scoring snapshot.

    Systems come from F16 (``'A | B'`` -> rows); a system with no master SKU yields one
    ``SIN_MAESTRO`` row. Demand = p x mean use per corrective order (default 1)."""
    s = scores.select("activo_id", F.coalesce("probabilidad_falla", F.lit(0.0)).alias("p"), "prioridad",
                      F.explode(system_list("sistema_en_riesgo")).alias("sistema"))
    if mapping is not None:  # failure vocabulary -> parts vocabulary (the source skips this step)
        m = mapping.select(F.lower("sistema_fallas").alias("sistema"), F.lower("sistema_repuestos").alias("_rep"))
        s = s.join(m, "sistema", "left").withColumn("sistema", F.coalesce("_rep", "sistema")).drop("_rep")
    master = rm.filter(F.col("activo") == F.lit(True)).select(
        "sku", "descripcion", F.lower("sistema").alias("sistema"), "lead_time_dias_promedio", "costo_unitario_clp",
        "stock_actual", F.lit(True).alias("_hm"))
    # all that a system brings meets first; the scores then join once, each system dealt over tasks by the lines that it makes
    offer = master.join(use, ["sistema", "sku"], "left").join(cost, "sistema", "full")
    j = salted_join(s, offer, "sistema", "activo_id", per_task, ["sku", "descripcion"])
    p, hm = F.col("p"), F.coalesce("_hm", F.lit(False))
    ev_cost = F.when(F.coalesce(F.col("costo_correctivo_medio"), F.lit(0.0)) != 0, p * F.col("costo_correctivo_medio"))
    dem = p * F.coalesce("cantidad_media_por_ot", F.lit(1.0))
    stock = F.coalesce("stock_actual", F.lit(0.0))
    slack = stock - dem
    lt = F.coalesce("lead_time_dias_promedio", F.lit(30.0))
    act = F.col("prioridad").isin(*actionable)
    accion = (F.when(~hm, vocab.NO_MASTER).when(act & (slack < 0), "REORDENAR_URGENTE")
              .when(act & ((slack < dem) | (lt >= lead_time_critical)), "PREPARAR").otherwise("MONITOREAR"))
    return j.select(
        "activo_id", "sistema", "sku", "descripcion", py_round("p", 4).alias("probabilidad_falla"), "prioridad",
        F.when(hm, py_round(dem, 3)).alias("demanda_esperada"), F.when(hm, stock).alias("stock_actual"),
        F.when(hm, py_round(slack, 3)).alias("holgura_stock"), F.when(hm, lt).alias("lead_time_dias"), "costo_unitario_clp",
        F.col("costo_correctivo_medio").alias("costo_correctivo_est"),
        F.when(hm, py_round(ev_cost, 0)).otherwise(ev_cost).alias("costo_evitado_est"), accion.alias("accion"))


def in_plan_order(plan: DataFrame) -> DataFrame:
    """The plan with ``orden``: urgent < prepare < no-master < monitor, then probability and avoided cost (NULL last)
    downwards, then asset, system and SKU. Numbered by ranges, so no task holds the whole plan."""
    rank = (F.when(F.col("accion") == "REORDENAR_URGENTE", 0).when(F.col("accion") == "PREPARAR", 1)
            .when(F.col("accion") == vocab.NO_MASTER, 2).when(F.col("accion") == "MONITOREAR", 3).otherwise(9))
    keys = {"_rank": rank, "_p": -F.col("probabilidad_falla"), "_none": F.col("costo_evitado_est").isNull(), "_cost": -F.col("costo_evitado_est")}
    return distributed_row_number(plan.withColumns(keys), [*keys, "activo_id", "sistema", "sku"], "orden").drop(*keys)


def plan_summary(plan: DataFrame) -> DataFrame:
    """Urgent lines, summed avoided cost, actionable assets: by asset first, so that counting assets expands no row."""
    g = plan.groupBy("activo_id").agg(F.count(F.when(F.col("accion") == "REORDENAR_URGENTE", 1)).alias("_urgent"), F.sum("costo_evitado_est").alias("_cost"))
    return g.agg(
        F.coalesce(F.sum("_urgent"), F.lit(0)).alias("lineas_urgentes"),
        F.coalesce(F.round(F.sum("_cost"), 2), F.lit(0.0)).alias("costo_evitado_total"),
        F.count("activo_id").alias("activos"))


def interventions_with_parts(inter: DataFrame, a: DataFrame, csm: DataFrame, rm: DataFrame, horizon: int = 30,
                             n_parts: int = 3) -> DataFrame:
    """Interventions of a horizon with the top-3 suggested part descriptions ('N/A' when none)."""
    i = inter.filter(F.col(f"h{horizon}") == 1)
    aa = a.select(F.lower("patente").alias("_pl"), "marca", "modelo")
    ia = i.select("patente", "sistema").withColumn("_pl", F.lower("patente")).join(aa, "_pl").drop("_pl")
    c = csm.select(F.lower("marca").alias("_m"), F.lower("modelo").alias("_mo"), F.lower("sistema").alias("_s"), "sku",
                   "cantidad_promedio")
    order = [F.col("cantidad_promedio").desc(), F.col("descripcion"), F.col("sku")]
    # the best parts of a (brand, model, system) first: an intervention meets so few rows, not all parts of its system
    named = c.join(rm.filter(F.col("descripcion").isNotNull()).select("sku", "descripcion"), "sku")
    few = top_n_per_key(named, ["_m", "_mo", "_s"], order, n_parts)
    j = ia.join(few, (F.lower(ia.marca) == few._m) & (F.lower(ia.modelo) == few._mo) & (F.lower(ia.sistema) == few._s))
    top = top_n_per_key(j, "patente", order, n_parts, "_rn")
    parts = top.groupBy("patente").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "descripcion"))), lambda x: x["descripcion"]),
                     ", ").alias("repuestos_sugeridos"))
    out = i.select("patente", "tipo", "sistema", "urgencia", "costo_estimado", "costo_no_intervenir").join(parts, "patente", "left")
    return out.withColumn("repuestos_sugeridos", F.coalesce(F.nullif("repuestos_sugeridos", F.lit("")), F.lit("N/A"))) \
        .withColumn("_orden", priority_rank("urgencia"))


def stock_view(rm: DataFrame, rc: DataFrame, ot: DataFrame, as_of: dt.date, n: int = 30) -> DataFrame:
    """Critical (alta/media) active SKUs: 30-day use, coverage, action F20; pre-aggregated per SKU
    once instead of three correlated subqueries per master row."""
    since = F.lit(dt.datetime.combine(as_of - dt.timedelta(days=30), dt.time())).cast("timestamp_ntz")
    j = rc.join(ot.filter(F.col("fecha_apertura") >= since).select("ot_id"), "ot_id")
    use = j.groupBy("sku").agg(
        F.sum(F.col("cantidad").cast("decimal(38,4)")).alias("_d30"),
        F.sum(F.col("cantidad").cast("decimal(38,4)")).alias("_s30"),
        F.count("cantidad").alias("_n30"))
    allu = rc.groupBy("sku").agg(F.sum(F.col("cantidad").cast("decimal(38,4)")).alias("_s"), F.count("cantidad").alias("_n"))
    m = rm.filter(F.col("criticidad").isin("alta", "media") & (F.col("activo") == F.lit(True))) \
        .join(use, "sku", "left").join(allu, "sku", "left")
    avg_all = (F.col("_s") / F.col("_n")).cast("double")
    avg30 = half_up(F.col("_s30") / F.col("_n30"), 2)
    cover = F.when(avg30 > 0, half_up(F.col("stock_actual").cast("decimal(38,4)") / (F.col("_s") / F.col("_n")), 0)) \
        .otherwise(F.col("stock_actual")).cast("int")
    accion = (F.when(F.col("stock_actual") < F.col("lead_time_dias_promedio") * F.coalesce(avg_all, F.lit(1.0)), "⚠️ Comprar urgente")
              .when(F.col("stock_actual") < F.col("stock_minimo"), "⚠️ Comprar").otherwise("OK"))
    out = m.select("sku", "descripcion", "sistema", "componente", "stock_actual",
                   F.coalesce(half_up(F.col("_d30"), 0), F.lit(0.0)).alias("demanda_30d"),
                   F.col("lead_time_dias_promedio").alias("lead_time_dias"), cover.alias("dias_cobertura"), "criticidad",
                   accion.alias("accion"))
    top = out.orderBy(F.col("dias_cobertura").asc_nulls_last(), F.col("criticidad").desc(), F.col("sku")).limit(n)
    return top


def coverage_recent(rm: DataFrame, rc: DataFrame, ot: DataFrame, as_of: dt.date) -> DataFrame:
    """Coverage days = stock / greatest(1, quantity used in the last 30 days) x 30."""
    j = rc.join(ot.filter(F.col("fecha_apertura") >= ago_ts(as_of, 30)).select("ot_id"), "ot_id")
    q = j.groupBy("sku").agg(F.sum(F.col("cantidad").cast("decimal(38,4)")).cast("double").alias("_q"))
    m = rm.join(q, "sku", "left")
    return m.select("sku", "descripcion", "stock_actual", F.col("lead_time_dias_promedio").alias("lead_time"), "criticidad",
                    "costo_unitario_clp",
                    F.round(F.col("stock_actual") / F.greatest(F.lit(1.0), F.coalesce("_q", F.lit(0.0))) * 30.0, 9)
                    .alias("cobertura_dias"))


def recommendations_v1(sr: DataFrame, a: DataFrame, ot: DataFrame, ev: DataFrame, tax: DataFrame, rc: DataFrame,
                       score_date: dt.date, n: int = 20) -> DataFrame:
    """Schema-V1 recommendations expressed on V2: system = latest order's system; last-year mean cost of
    the system (default 450 k); cost of not acting = p x mean corrective cost (default 1.2 M); the asset's own
    parts (the reference's always-true join is not reproduced)."""
    s = sr.filter((F.col("fecha_scoring") == F.lit(score_date)) & (F.col("horizonte_dias") == 30)
                  & F.col("prioridad").isin(*vocab.URGENT))
    osys = order_system(ev, tax)
    ots = ot.join(osys, "ot_id", "left")
    last = latest_order(ots).select("activo_id", F.col("sistema").alias("sistema_prob"))
    last_year = F.year("fecha_apertura") == F.lit(score_date.year - 1)
    cost_ly = ots.filter(last_year).groupBy("sistema").agg(
        half_up(F.sum(F.col("costo_total_clp").cast("decimal(38,2)")) / F.count("costo_total_clp"), 0).alias("_cly"))
    cost_c = ots.filter(F.lower("tipo_ot") == "correctiva").groupBy("sistema").agg(
        (F.sum(F.col("costo_total_clp").cast("decimal(38,2)")) / F.count("costo_total_clp")).cast("double").alias("_cc"))
    j = s.join(a.select("activo_id", "patente", "marca", "modelo"), "activo_id").join(last, "activo_id", "left") \
        .join(cost_ly, F.col("sistema_prob") == cost_ly.sistema, "left").drop("sistema") \
        .join(cost_c, F.col("sistema_prob") == cost_c.sistema, "left").drop("sistema")
    out = j.select(
        "patente", "marca", "modelo", "activo_id",
        intervention_type_by_probability("probabilidad_falla").alias("tipo_intervencion"),
        F.coalesce("sistema_prob", F.lit("Sistema general")).alias("sistema"),
        F.concat(F.date_format(F.lit(score_date + dt.timedelta(days=3)), "dd MMM"), F.lit(" - "),
                 F.date_format(F.lit(score_date + dt.timedelta(days=7)), "dd MMM")).alias("ventana_optima"),
        F.col("prioridad").alias("urgencia"),
        F.coalesce("_cly", F.lit(450000.0)).cast("bigint").alias("costo_estimado_intervencion"),
        half_up(F.col("probabilidad_falla") * F.coalesce("_cc", F.lit(1200000.0)), 0).cast("bigint").alias("costo_no_intervenir"),
        half_up(F.col("probabilidad_falla") * 100, 1).alias("probabilidad_30d"))
    top = out.orderBy(F.col("probabilidad_30d").desc(), F.col("activo_id")).limit(n)
    # part lists only for the recommended assets (at most n), never for the whole fleet
    own = ot.select("ot_id", "activo_id").join(top.select("activo_id"), "activo_id", "left_semi")
    parts = rc.join(own, "ot_id").groupBy("activo_id").agg(
        F.array_join(F.sort_array(F.collect_set("sku")), ", ").alias("repuestos_sugeridos"))
    return top.join(parts, "activo_id", "left")


def critical_panel_today(panel: DataFrame, sku_pattern: str = r"^REP-[0-9]{4}$") -> DataFrame:
    """today's critical-parts rows with a well-formed SKU (F14); a master whose numbers outgrow four digits
    passes its own pattern."""
    return panel.filter(sku_ok("sku", sku_pattern))


__all__ = [n for n in dir() if not n.startswith("_")] + ["Window", "latest_per_key"]
