"""KPI panels (K*).

Every metric takes an explicit ``as_of`` date. Metrics that read the same
table are written as one conditional aggregation (``run_panels`` stacks them
into long form), instead of one query per metric. Sums of money and hours go
through DECIMAL so that they are exact and independent of the summation order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import active_asset, age_years, blank_default, elapsed_days, hours_between, is_corrective, lower_in
from .common import events_with_system, latest_event_system, latest_order, latest_score
from .windows import latest_per_key, rows_at_max, top_n


def ago(as_of: dt.date, days: int) -> Column:
    """``CURRENT_DATE - INTERVAL 'n days'`` as a date literal."""
    return F.lit(as_of - dt.timedelta(days=days))


def ago_ts(as_of: dt.date, days: int) -> Column:
    """Same as a midnight timestamp (for comparisons with timestamps)."""
    return F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")


def months_ago_ts(as_of: dt.date, months: int) -> Column:
    return F.add_months(F.lit(as_of), -months).cast("timestamp_ntz")


def xsum(c: Column, scale: int = 2) -> Column:
    """Order-independent sum of a decimal-valued double (money, hours)."""
    return F.sum(c.cast(f"decimal(38,{scale})")).cast("double")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def _active(a: DataFrame, mode: str = "activo") -> DataFrame:
    return a.filter(active_asset("estado_actual", mode)).select("activo_id")


# ------------------------------------------------------------ view 1: status
def units_operating(a: DataFrame) -> DataFrame:
    """K1: assets not retired."""
    return a.agg(F.count(F.when(active_asset("estado_actual", "not_retired"), 1)).alias("valor"))


def availability_weighted(dd: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """K2: sum(up) / sum(up + planned + unplanned) * 100 over the last ``days`` days; NULL if no hours."""
    d = dd.filter(F.col("fecha") >= ago(as_of, days))
    up = xsum(F.coalesce("horas_operativas", F.lit(0.0)))
    tot = xsum(
        F.coalesce("horas_operativas", F.lit(0.0))
        + F.coalesce("horas_detenido_planificado", F.lit(0.0))
        + F.coalesce("horas_detenido_no_planificado", F.lit(0.0))
    )
    return d.agg(F.round(_ratio(up, tot) * 100.0, 9).alias("valor"))


def availability_mean_ratio(dd: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """K3: mean over asset-days of up / (up + unplanned) * 100 (100 when both are 0)."""
    up, np_ = F.col("horas_operativas"), F.col("horas_detenido_no_planificado")
    r = F.when(up + np_ > 0, up / (up + np_) * 100.0).otherwise(F.lit(100.0))
    return dd.filter(F.col("fecha") >= ago(as_of, days)).agg(F.round(F.avg(r), 9).alias("valor"))


def latest_snapshot(sr: DataFrame) -> DataFrame:
    """Score rows at the latest ``fecha_scoring`` of their horizon."""
    return rows_at_max(sr, ["horizonte_dias"], "fecha_scoring", small_keys=True)


def priority_counts(sr: DataFrame, a: DataFrame, active_only: bool = True) -> DataFrame:
    """K4: distinct assets per (horizon, priority) in the latest snapshot of each horizon."""
    s = latest_snapshot(sr)
    if active_only:
        s = s.join(_active(a), "activo_id")
    else:
        s = s.join(a.select("activo_id"), "activo_id")
    return s.groupBy("horizonte_dias", "prioridad").agg(F.count_distinct("activo_id").alias("valor"))


def upcoming_interventions(sr: DataFrame, a: DataFrame) -> DataFrame:
    """P1 + P2 assets per horizon in its latest snapshot (active assets)."""
    s = latest_snapshot(sr).join(_active(a), "activo_id")
    per = s.groupBy("horizonte_dias", "prioridad").agg(F.count_distinct("activo_id").alias("n"))
    return per.groupBy("horizonte_dias").agg(
        F.sum(F.when(F.col("prioridad").isin(*vocab.URGENT), F.col("n")).otherwise(0)).cast("bigint").alias("valor")
    )


def anticipated_failures(fb: DataFrame, a: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """K5: confirmed feedback rows of active assets in the last ``days`` days."""
    f = fb.filter((F.col("falla_confirmada") == F.lit(True)) & (F.col("fecha_alerta") >= ago(as_of, days)))
    return f.join(_active(a), "activo_id").agg(F.count(F.lit(1)).alias("valor"))


def mtbf_availability(dd: DataFrame, ot: DataFrame, a: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """K6: sum of up hours / corrective orders (active assets, last ``days`` days); NULL without failures."""
    act = _active(a)
    hours = dd.filter(F.col("fecha") >= ago(as_of, days)).join(act, "activo_id").agg(
        xsum(F.coalesce("horas_operativas", F.lit(0.0))).alias("h_op"))
    fails = ot.filter(is_corrective() & (F.col("fecha_apertura") >= ago_ts(as_of, days))).join(act, "activo_id").agg(
        F.count(F.lit(1)).alias("n"))
    return hours.crossJoin(fails).select(F.round(_ratio(F.col("h_op"), F.col("n")), 9).alias("valor"))


def _repairs(ot: DataFrame, a: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    return ot.filter(F.col("fecha_cierre").isNotNull() & (F.col("fecha_cierre") >= ago_ts(as_of, days))).join(
        _active(a), "activo_id")


def mtbf_repair_hours(ot: DataFrame, a: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """K7: (as labelled "MTBF 90d" in view 3) sum of repair hours of orders closed in the
    window / their ``correctiva`` count; 0 without failures."""
    r = _repairs(ot, a, as_of, days)
    h = xsum(hours_between("fecha_apertura", "fecha_cierre"), 6)
    n = F.count(F.when(F.lower(F.coalesce("tipo_ot", F.lit(""))) == "correctiva", 1))
    return r.agg(F.round(F.coalesce(_ratio(h, n), F.lit(0.0)), 9).alias("valor"))


def mttr(ot: DataFrame, a: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """K8: mean repair hours of ``correctiva`` orders closed in the window; 0 without any."""
    r = _repairs(ot, a, as_of, days).filter(F.lower(F.coalesce("tipo_ot", F.lit(""))) == "correctiva")
    h = xsum(hours_between("fecha_apertura", "fecha_cierre"), 6)
    return r.agg(F.round(F.coalesce(_ratio(h, F.count(F.lit(1))), F.lit(0.0)), 9).alias("valor"))


# ------------------------------------------------------------ monthly series
def monthly_mtbf_mttr(ot: DataFrame, dd: DataFrame, as_of: dt.date) -> DataFrame:
    """K9: per month of the last 12: mean corrective repair hours and up hours / corrective orders."""
    since = months_ago_ts(as_of, 12)
    o = ot.filter(F.col("fecha_apertura") >= since).withColumn("mes", F.trunc(F.to_date("fecha_apertura"), "MM"))
    corr = is_corrective()
    rep = F.when(F.col("fecha_cierre").isNotNull() & corr, hours_between("fecha_apertura", "fecha_cierre"))
    m = o.groupBy("mes").agg(
        F.round(xsum(rep, 6) / F.count(rep), 2).alias("mttr_h"),
        F.count(F.when(corr, 1)).alias("n_corr"),
    )
    h = (dd.filter(F.col("fecha") >= F.add_months(F.lit(as_of), -12))
         .groupBy(F.trunc("fecha", "MM").alias("mes"))
         .agg(xsum(F.coalesce("horas_operativas", F.lit(0.0))).alias("h_op")))
    return m.join(h, "mes", "left").select(
        "mes", "mttr_h",
        F.when((F.col("n_corr") > 0) & F.col("h_op").isNotNull(), F.round(F.col("h_op") / F.col("n_corr"), 2)).alias("mtbf_h"),
    )


def monthly_mtbf_720(ot: DataFrame, as_of: dt.date) -> DataFrame:
    """K9 without an availability table: 720 hours a month / corrective orders."""
    o = ot.filter(F.col("fecha_apertura") >= months_ago_ts(as_of, 12))
    corr = is_corrective()
    rep = F.when(F.col("fecha_cierre").isNotNull() & corr, hours_between("fecha_apertura", "fecha_cierre"))
    n = F.count(F.when(corr, 1))
    return o.groupBy(F.trunc(F.to_date("fecha_apertura"), "MM").alias("mes")).agg(
        F.round(xsum(rep, 6) / F.count(rep), 2).alias("mttr_h"), F.when(n > 0, F.round(F.lit(720.0) / n, 2)).alias("mtbf_h"))


def monthly_downtime(dd: DataFrame, as_of: dt.date) -> DataFrame:
    """Planned / unplanned downtime hours per month, last 12 months."""
    d = dd.filter(F.col("fecha") >= F.add_months(F.lit(as_of), -12))
    return d.groupBy(F.trunc("fecha", "MM").alias("mes")).agg(
        F.round(xsum(F.coalesce("horas_detenido_planificado", F.lit(0.0))), 2).alias("planificado_h"),
        F.round(xsum(F.coalesce("horas_detenido_no_planificado", F.lit(0.0))), 2).alias("no_planificado_h"),
    )


def monthly_downtime_from_orders(ot: DataFrame, as_of: dt.date) -> DataFrame:
    """K10 fallback without the availability table: order durations per month."""
    o = ot.filter(F.col("fecha_apertura") >= months_ago_ts(as_of, 12))
    dur = hours_between("fecha_apertura", "fecha_cierre")
    closed = F.col("fecha_cierre").isNotNull()
    return o.groupBy(F.trunc(F.to_date("fecha_apertura"), "MM").alias("mes")).agg(
        F.round(xsum(F.when(lower_in("tipo_ot", ("preventiva", "preventivo")) & closed, dur).otherwise(0.0), 6), 2)
        .alias("planificado_h"),
        F.round(xsum(F.when(is_corrective() & closed, dur).otherwise(0.0), 6), 2).alias("no_planificado_h"),
    )


def monthly_calendar(ot: DataFrame, start: dt.date, end: dt.date, n: int = 12) -> DataFrame:
    """Per month: calendar-month hours / corrective orders; repair hours / corrective orders."""
    o = ot.filter((F.col("fecha_apertura") >= F.lit(start).cast("timestamp_ntz"))
                  & (F.col("fecha_apertura") <= F.lit(end).cast("timestamp_ntz")))
    mes = F.trunc(F.to_date("fecha_apertura"), "MM")
    corr = F.lower(F.coalesce("tipo_ot", F.lit(""))) == "correctiva"
    g = o.groupBy(mes.alias("mes")).agg(
        F.count(F.when(corr, 1)).alias("n_corr"),
        F.count("fecha_cierre").alias("n_closed"),
        xsum(F.when(F.col("fecha_cierre").isNotNull(), hours_between("fecha_apertura", "fecha_cierre")).otherwise(0.0), 6)
        .alias("h_rep"),
    )
    month_h = F.datediff(F.add_months("mes", 1), F.col("mes")) * 24.0
    out = g.select(
        "mes",
        F.round(_ratio(month_h, F.col("n_corr")), 0).cast("int").alias("mtbf_horas"),
        F.when(F.col("n_closed") > 0, F.round(_ratio(F.col("h_rep"), F.col("n_corr")), 1)).alias("mttr_horas"),
    )
    return out.orderBy(F.col("mes").desc()).limit(n)


def monthly_availability_estimate(ot: DataFrame, start: dt.date, end: dt.date, n: int = 12) -> DataFrame:
    """K11 estimate from orders: per month, 100 * (1 - corrective / all) and mean hours from opening to closing, over the
    corrective orders (the source filters to them before it counts, so its percentage is 0 in every month with one)."""
    o = ot.filter((F.col("fecha_apertura") >= F.lit(start).cast("timestamp_ntz")) & (F.col("fecha_apertura") <= F.lit(end).cast("timestamp_ntz"))
                  & (F.lower("tipo_ot") == "correctiva"))
    hours = F.when(F.col("fecha_cierre").isNotNull(), hours_between("fecha_apertura", "fecha_cierre"))
    share = F.count(F.when(F.lower("tipo_ot") == "correctiva", 1)) / F.count(F.lit(1))
    g = o.groupBy(F.trunc(F.to_date("fecha_apertura"), "MM").alias("mes")).agg(
        F.round(F.lit(100.0) * (F.lit(1.0) - share), 1).alias("disponibilidad_pct"),
        F.round(_ratio(xsum(hours, 6), F.count(hours)), 1).alias("downtime_no_plan_promedio"))
    return g.orderBy(F.col("mes").desc()).limit(n)


def _assets_by_priority(rows: DataFrame, p1: str, p2: str) -> DataFrame:
    """Distinct assets with a P1 and with a P2 row: grouped by asset first, so that no row is expanded."""
    has = lambda p: F.bool_or(F.col("prioridad") == p)
    g = rows.filter(F.col("activo_id").isNotNull()).groupBy("activo_id").agg(has(vocab.P1).alias("_p1"), has(vocab.P2).alias("_p2"))
    return g.agg(F.count_if("_p1").alias(p1), F.count_if("_p2").alias(p2))


def hero(a: DataFrame, ot: DataFrame, sr: DataFrame, fb: DataFrame, start: dt.date, end: dt.date,
         score_date: dt.date) -> DataFrame:
    """Hero metrics for 'operativo' assets over [start, end], as separate aggregates
    (one fan-out join would inflate the non-distinct counts)."""
    act = _active(a, "operativo")
    days = (end - start).days
    o = ot.filter((F.col("fecha_apertura") >= F.lit(start).cast("timestamp_ntz"))
                  & (F.col("fecha_apertura") <= F.lit(end).cast("timestamp_ntz"))).join(act, "activo_id")
    corr = F.lower(F.coalesce("tipo_ot", F.lit(""))) == "correctiva"
    orders = o.agg(
        F.count_distinct(F.when(corr, F.to_date("fecha_apertura"))).alias("_dias_corr"),
        F.count(F.when(corr, 1)).alias("_n_corr"),
    )
    s = sr.join(act, "activo_id")
    scores = _assets_by_priority(s.filter(F.col("fecha_scoring") == F.lit(score_date)), "unidades_p1", "unidades_p2")
    conf = fb.filter(F.col("falla_confirmada") == F.lit(True)).join(s.select("scoring_id"), "scoring_id", "left_semi").agg(
        F.count_distinct("feedback_id").alias("fallas_anticipadas_confirmadas"))
    units = act.agg(F.count_distinct("activo_id").alias("unidades_operativas"))
    return units.crossJoin(orders).crossJoin(scores).crossJoin(conf).select(
        "unidades_operativas",
        F.round(F.lit(100.0) * (F.lit(1.0) - F.col("_dias_corr").cast("double") / F.lit(float(days))), 1).alias("disponibilidad_pct"),
        F.round(_ratio(F.lit(days * 24.0), F.col("_n_corr")), 0).alias("mtbf_horas"),
        "fallas_anticipadas_confirmadas", "unidades_p1", "unidades_p2",
    )


# ------------------------------------------------------------ view 2: action plan
def heatmap(ev: DataFrame, tax: DataFrame, ot: DataFrame, as_of: dt.date) -> DataFrame:
    """Events per (system, disjoint recency bucket <=7 / 8-30 / 31-90 days)."""
    # events whose own date is older need no order
    recent = F.col("fecha_evento").isNull() | (F.col("fecha_evento") >= F.lit(as_of - dt.timedelta(days=90)))
    e = events_with_system(ev.filter(recent), tax, ot)
    t = F.col("fecha_ef")
    bucket = (F.when(t >= ago_ts(as_of, 7), 7).when(t >= ago_ts(as_of, 30), 30).when(t >= ago_ts(as_of, 90), 90))
    return (
        e.select(blank_default("sistema").alias("sistema"), bucket.alias("horizonte"))
        .filter(F.col("horizonte").isNotNull())
        .groupBy("sistema", "horizonte")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def priority_by_type(a: DataFrame, sr: DataFrame, horizon: int = 30) -> DataFrame:
    """Latest priority per asset for a horizon, counted per vehicle type."""
    s = latest_score(sr.filter(F.col("prioridad").isin(*vocab.PRIORITIES)), horizon).select("activo_id", "prioridad")
    j = a.select("activo_id", "tipo_vehiculo").join(s, "activo_id")
    return j.groupBy("tipo_vehiculo", "prioridad").agg(F.count(F.lit(1)).alias("valor")).select(
        F.coalesce("tipo_vehiculo", F.lit("Sin clasificar")).alias("tipo"), "prioridad", "valor")


def backlog(ot: DataFrame, as_of: dt.date) -> DataFrame:
    """Open orders and those open for more than 7 / 14 days."""
    o = ot.filter(F.col("fecha_cierre").isNull())
    return o.agg(
        F.count(F.lit(1)).alias("ot_abiertas"),
        F.count(F.when(F.col("fecha_apertura") < ago_ts(as_of, 7), 1)).alias("ot_vencidas_7d"),
        F.count(F.when(F.col("fecha_apertura") < ago_ts(as_of, 14), 1)).alias("ot_vencidas_14d"),
    )


def pm_compliance(ot: DataFrame, as_of: dt.date) -> DataFrame:
    """Closed / all preventive orders of the last 90 days (%, NULL if none) and the
    preventive share of all orders of the last 30 days."""
    prev = lower_in("tipo_ot", ("preventiva", "preventivo"))
    o90 = ot.filter(prev & (F.col("fecha_apertura") >= ago_ts(as_of, 90))).agg(
        F.count("fecha_cierre").alias("_c"), F.count(F.lit(1)).alias("_t"))
    o30 = ot.filter(F.col("fecha_apertura") >= ago_ts(as_of, 30)).agg(
        F.count(F.when(prev, 1)).alias("ot_preventivas_30d"), F.count(F.lit(1)).alias("total_ot_30d"))
    return o90.crossJoin(o30).select(
        F.round(_ratio(F.col("_c").cast("double"), F.col("_t")) * 100.0, 9).alias("cumplimiento_pm_pct"),
        F.round(F.lit(100.0) * F.col("ot_preventivas_30d").cast("double") / F.nullif(F.col("total_ot_30d"), F.lit(0)), 1)
        .alias("preventivas_30d_pct"),
        "ot_preventivas_30d", "total_ot_30d",
    )


def overdue_pm(a: DataFrame, ot: DataFrame, ev: DataFrame, tax: DataFrame, as_of: dt.date, n: int = 10) -> DataFrame:
    """Active assets whose last preventive order is > 90 days old or missing; never first."""
    last_pm = ot.filter(lower_in("tipo_ot", ("preventiva", "preventivo"))).groupBy("activo_id").agg(
        F.max("fecha_apertura").alias("ultima_pm"))
    sysr = latest_event_system(ev, tax)
    age = F.datediff(F.lit(as_of), F.to_date("ultima_pm"))
    j = (a.filter(active_asset("estado_actual", "activo")).select("activo_id", "patente")
         .join(last_pm, "activo_id", "left").join(sysr, "activo_id", "left")
         .filter(F.col("ultima_pm").isNull() | (age > 90)))
    out = j.select(
        "activo_id", "patente", "ultima_pm",
        F.coalesce(F.concat(age.cast("string"), F.lit(" días")), F.lit("Nunca")).alias("pm_vencida"),
        F.coalesce("sistema", F.lit("Sin clasificar")).alias("proximo_sistema"),
    )
    return top_n(out, [F.col("ultima_pm").asc_nulls_first(), F.col("activo_id").asc()], n).drop("ultima_pm")


def skus_below_minimum(rm: DataFrame) -> DataFrame:
    """SKUs with stock at or below the minimum."""
    return rm.agg(F.count(F.when(F.col("stock_actual") <= F.coalesce("stock_minimo", F.lit(0.0)), 1)).alias("valor"))


# ------------------------------------------------------------ view 3: value
def avoided_cost(fb: DataFrame, ot: DataFrame) -> DataFrame:
    """Sum of the order cost behind confirmed feedback."""
    j = fb.filter(F.col("falla_confirmada") == F.lit(True)).join(
        ot.select("ot_id", "costo_total_clp"), "ot_id", "left").filter(F.col("costo_total_clp").isNotNull())
    return j.agg(F.coalesce(xsum(F.col("costo_total_clp")), F.lit(0.0)).alias("valor"))


def avoided_cost_estimate(fb: DataFrame, sr: DataFrame, ot: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """K21 estimated form: feedback count x mean corrective cost (default 1.2 M) x 0.7,
    hours avoided, validated hit rate and false positives."""
    corr = F.lower(F.coalesce("tipo_ot", F.lit(""))) == "correctiva"
    cost = ot.filter(corr & (F.col("fecha_apertura") >= F.lit(start).cast("timestamp_ntz"))).agg(
        (xsum(F.col("costo_total_clp")) / F.count("costo_total_clp")).alias("_avg_cost"))
    hrs = ot.filter(corr).agg(
        (xsum(hours_between("fecha_apertura", "fecha_cierre"), 6)
         / F.count(hours_between("fecha_apertura", "fecha_cierre"))).alias("_avg_h"))
    s = sr.filter(F.col("fecha_scoring").between(F.lit(start), F.lit(end))).select("scoring_id")
    f = fb.join(s, "scoring_id").agg(
        F.count_distinct("feedback_id").alias("alertas_confirmadas"),
        F.round(F.lit(100.0) * F.count(F.when(F.col("falla_confirmada") == F.lit(True), 1)).cast("double")
                / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("recall_validado_pct"),
        F.count(F.when(F.col("falla_confirmada") == F.lit(False), 1)).alias("falsos_positivos"),
    )
    n = F.col("alertas_confirmadas")
    return f.crossJoin(cost).crossJoin(hrs).select(
        "alertas_confirmadas",
        F.round(n * F.coalesce("_avg_cost", F.lit(1200000.0)) * 0.7, 0).cast("bigint").alias("costo_evitado_estimado"),
        F.round(n * F.coalesce("_avg_h", F.lit(22.0)), 0).cast("int").alias("horas_downtime_evitadas"),
        "recall_validado_pct", "falsos_positivos",
    )


def order_system(ev: DataFrame, tax: DataFrame) -> DataFrame:
    """System of an order: its latest event's system (NULL dates last)."""
    return latest_event_system(ev.filter(F.col("ot_id").isNotNull()), tax, key="ot_id")


def avoided_downtime(fb: DataFrame, ot: DataFrame, ev: DataFrame, tax: DataFrame) -> DataFrame:
    """Sum over systems of confirmed alerts x mean repair hours of the system's orders."""
    osys = order_system(ev, tax)
    alerts = (fb.filter(F.col("falla_confirmada") == F.lit(True)).join(osys, "ot_id", "left")
              .select(F.coalesce("sistema", F.lit("sin_sistema")).alias("sistema"))
              .groupBy("sistema").agg(F.count(F.lit(1)).alias("n_alertas")))
    dur = (ot.filter(F.col("fecha_cierre").isNotNull() & F.col("fecha_apertura").isNotNull())
           .join(osys, "ot_id", "left")
           .select(F.coalesce("sistema", F.lit("sin_sistema")).alias("sistema"),
                   hours_between("fecha_apertura", "fecha_cierre").alias("h"))
           .groupBy("sistema").agg((xsum(F.col("h"), 6) / F.count("h")).alias("dur")))
    j = alerts.join(dur, "sistema", "left")
    return j.agg(F.round(F.coalesce(F.sum(F.col("n_alertas") * F.coalesce("dur", F.lit(0.0))), F.lit(0.0)), 6).alias("valor"))


def cost_per_km(ot: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Maintenance cost of the window / (max - min odometer of its orders, fleet-wide)."""
    o = ot.filter(F.col("fecha_apertura") >= ago_ts(as_of, days))
    cost = F.coalesce(xsum(F.col("costo_total_clp")), F.lit(0.0))
    km = F.coalesce(F.max("odometro_km"), F.lit(0.0)) - F.coalesce(F.min("odometro_km"), F.lit(0.0))
    return o.agg(F.round(_ratio(cost, km), 9).alias("valor"))


def cost_per_summed_km(ot: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """K23 variant: maintenance cost of the window / sum of its orders' odometer readings (NULL counts 0)."""
    o = ot.filter(F.col("fecha_apertura") >= ago_ts(as_of, days))
    cost = F.coalesce(xsum(F.col("costo_total_clp")), F.lit(0.0))
    return o.agg(F.round(_ratio(cost, F.coalesce(xsum(F.col("odometro_km")), F.lit(0.0))), 9).alias("valor"))


def cost_per_unit(ot: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Maintenance cost of the window / distinct assets with orders in it."""
    o = ot.filter(F.col("fecha_apertura") >= ago_ts(as_of, days))
    cost = F.coalesce(xsum(F.col("costo_total_clp")), F.lit(0.0))
    return o.agg(F.round(_ratio(cost, F.count_distinct("activo_id")), 9).alias("valor"))


def confirmed_by_priority(fb: DataFrame, sr: DataFrame) -> DataFrame:
    """Distinct assets with confirmed feedback on a P1 (resp. P2) score, one join and one aggregate."""
    conf = fb.filter(F.col("falla_confirmada") == F.lit(True)).select("scoring_id", "activo_id")
    j = conf.join(sr.filter(F.col("prioridad").isin(*vocab.URGENT)).select("scoring_id", "prioridad"), "scoring_id")
    return _assets_by_priority(j, "activos_p1_confirmados", "activos_p2_confirmados")


def feedback_counts(fb: DataFrame) -> DataFrame:
    """Counts and % of confirmed / rejected (false alarm) / pending feedback; 0 % when empty."""
    n = F.count(F.lit(1))
    conf = F.count(F.when(F.col("falla_confirmada") == F.lit(True), 1))
    rej = F.count(F.when(F.col("falsa_alarma") == F.lit(True), 1))
    pend = F.count(F.when(F.col("falla_confirmada").isNull() & (F.col("falsa_alarma") == F.lit(False)), 1))

    def pct(c):
        return F.coalesce(F.round(c.cast("double") / F.nullif(n, F.lit(0)) * 100.0, 9), F.lit(0.0))

    return fb.agg(
        n.alias("total_feedback"), conf.alias("confirmadas"), rej.alias("rechazadas"), pend.alias("pendientes"),
        pct(conf).alias("pct_confirmadas"), pct(rej).alias("pct_rechazadas"), pct(pend).alias("pct_pendientes"),
    )


def confusion(sr: DataFrame, fb: DataFrame, reviewed_only: bool = False) -> DataFrame:
    """alert = P1/P2, failure = confirmed; over all feedback or only reviewed rows."""
    f = fb
    if reviewed_only:
        f = f.filter(F.col("resultado_revision").isin("confirmada", "parcial", "rechazada"))
    f = f.select("scoring_id", F.when(F.col("falla_confirmada") == F.lit(True), 1).otherwise(0).alias("hubo"))
    s = sr.select("scoring_id", F.when(F.col("prioridad").isin(*vocab.URGENT), 1).otherwise(0).alias("alerta"))
    j = s.join(f, "scoring_id")

    def c(x, y):
        return F.count(F.when((F.col("alerta") == x) & (F.col("hubo") == y), 1))

    return j.agg(c(1, 1).alias("tp"), c(1, 0).alias("fp"), c(0, 1).alias("fn"), c(0, 0).alias("tn"))


def next_corrective_after(fb: DataFrame, ot: DataFrame, strict: bool = True,
                          corrective: tuple[str, ...] = ("correctiva",)) -> DataFrame:
    """Per feedback row, the first corrective order of its asset opened after the alert (unbounded).

    A segmented scan instead of a range join (which would pair every alert with every later order) or one
    ordered window per asset (which would put a hot asset's whole history in one task):

    1. inside each (asset, month) segment, feedback and order rows are merged in time order and a running
       ``min`` of later order times is carried back - a window over one segment only;
    2. for alerts with no later order in their own month, the answer is the earliest order of the first
       later month that has one: per (asset, month) minima (one row per month) carried back over months.
    """
    alert_ts = F.to_timestamp_ntz(F.col("fecha_alerta"))
    a = fb.select("feedback_id", "activo_id", alert_ts.alias("ts"), F.lit(0).alias("kind"),
                  F.lit(None).cast("timestamp_ntz").alias("o_ts"))
    o = ot.filter(lower_in("tipo_ot", corrective)).select(
        F.lit(None).cast("string").alias("feedback_id"), "activo_id", F.col("fecha_apertura").alias("ts"),
        F.lit(1).alias("kind"), F.col("fecha_apertura").alias("o_ts"))
    seg = F.trunc(F.to_date("ts"), "MM")
    u = a.unionByName(o).withColumn("seg", seg)
    # descending time; on equal times feedback (kind 0) sorts first for '>' and orders first for '>='
    kind_order = F.col("kind").asc() if strict else F.col("kind").desc()
    w = Window.partitionBy("activo_id", "seg").orderBy(F.col("ts").desc(), kind_order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    within = u.withColumn("next_in_seg", F.min("o_ts").over(w)).filter(F.col("kind") == 0)
    firsts = o.withColumn("seg", seg).groupBy("activo_id", "seg").agg(F.min("o_ts").alias("seg_min"))
    # month-level rows (at most one order row and one alert row per asset and month), scanned newest first:
    # the running min of strictly later months' minima
    alert_segs = within.select("activo_id", "seg").distinct().select(
        "activo_id", "seg", F.lit(None).cast("timestamp_ntz").alias("seg_min"), F.lit(0).alias("k"))
    seg_rows = firsts.select("activo_id", "seg", "seg_min", F.lit(1).alias("k")).unionByName(alert_segs)
    later = Window.partitionBy("activo_id").orderBy(F.col("seg").desc(), F.col("k").asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    nearest = seg_rows.withColumn("from_later", F.min("seg_min").over(later)).filter(F.col("k") == 0) \
        .select("activo_id", "seg", "from_later")
    res = within.join(nearest, ["activo_id", "seg"], "left")
    return res.select("feedback_id", "activo_id", F.col("ts").alias("alerta_ts"),
                      F.coalesce("next_in_seg", "from_later").alias("next_ot"))


def mean_anticipation(fb: DataFrame, ot: DataFrame, variant: str = "strict") -> DataFrame:
    """Mean whole days from the alert to the next corrective order, confirmed feedback.

    ``strict``: '>' and ``correctiva``; ``inclusive``: '>=' and the corrective set."""
    f = fb.filter((F.col("falla_confirmada") == F.lit(True)) & F.col("fecha_alerta").isNotNull())
    if variant == "strict":
        nxt = next_corrective_after(f, ot, strict=True, corrective=("correctiva",))
    else:
        nxt = next_corrective_after(f, ot, strict=False, corrective=vocab.CORRECTIVE)
    days = elapsed_days("next_ot", "alerta_ts")
    return nxt.agg(F.round(F.avg(days), 9).alias("valor"))


def daily_alerts(sr: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """P1 + P2 scores per scoring day of the last ``days`` days."""
    s = sr.filter(F.col("fecha_scoring") >= ago(as_of, days))
    return s.groupBy(F.col("fecha_scoring").alias("fecha")).agg(
        F.count(F.when(F.col("prioridad").isin(*vocab.URGENT), 1)).alias("alertas_altas"))


def risk_by_brand(a: DataFrame, sr: DataFrame, n: int = 5) -> DataFrame:
    """Mean latest probability per brand, top ``n``."""
    us = latest_score(sr).select("activo_id", "probabilidad_falla")
    g = a.filter(F.col("marca").isNotNull()).join(us, "activo_id").groupBy("marca").agg(
        F.round(F.avg("probabilidad_falla"), 3).alias("prob_promedio"))
    return g.orderBy(F.col("prob_promedio").desc(), F.col("marca")).limit(n)


def cost_by_system(ev: DataFrame, tax: DataFrame, ot: DataFrame, null_cost_as_zero: bool = True) -> DataFrame:
    """Mean corrective order cost per event system (event fan-out kept, as in the source)."""
    e = events_with_system(ev, tax).join(ot.select("ot_id", "tipo_ot", "costo_total_clp"), "ot_id")
    e = e.filter(is_corrective())
    cost = F.coalesce("costo_total_clp", F.lit(0.0)) if null_cost_as_zero else F.col("costo_total_clp")
    g = e.groupBy("sistema").agg((xsum(cost) / F.count(cost)).alias("_avg"))
    return g.select(blank_default("sistema").alias("sistema"), F.round("_avg", 0).alias("costo_promedio"))


def feedback_states(fb: DataFrame) -> DataFrame:
    """Feedback per review state (blank and NULL kept as separate groups, as in the source)."""
    g = fb.groupBy("resultado_revision").agg(F.count(F.lit(1)).alias("cantidad"))
    return g.select(F.coalesce(F.nullif(F.col("resultado_revision"), F.lit("")), F.lit("Sin revisar")).alias("estado"),
                    "cantidad")


def rejection_reasons(fb: DataFrame, n: int = 5) -> DataFrame:
    """Top-``n`` reasons of false alarms."""
    g = fb.filter(F.col("falsa_alarma") == F.lit(True)).groupBy("comentario_mecanico").agg(
        F.count(F.lit(1)).alias("cantidad"))
    g = g.select(F.coalesce(F.nullif(F.col("comentario_mecanico"), F.lit("")), F.lit("Sin especificar")).alias("motivo"),
                 "cantidad")
    return g.orderBy(F.col("cantidad").desc(), F.col("motivo")).limit(n)


def feedback_30d(fb: DataFrame, sr: DataFrame, as_of: dt.date) -> DataFrame:
    """Feedback of the last 30 days: counts, hit %, mean hours from score to review."""
    j = fb.filter(F.col("created_at") >= ago_ts(as_of, 30)).join(sr.select("scoring_id", "fecha_scoring"), "scoring_id")
    n = F.count(F.lit(1))
    conf = F.count(F.when(F.col("falla_confirmada") == F.lit(True), 1))
    rev_h = hours_between(F.to_timestamp_ntz(F.col("fecha_scoring")), F.col("created_at"))
    return j.agg(
        n.alias("total_alertas"), conf.alias("confirmadas"),
        F.count(F.when(F.col("resultado_revision") == "parcial", 1)).alias("parciales"),
        F.count(F.when(F.col("falla_confirmada") == F.lit(False), 1)).alias("rechazadas"),
        F.count(F.when(F.col("falla_confirmada").isNull(), 1)).alias("pendientes"),
        F.round(F.lit(100.0) * conf.cast("double") / F.nullif(n, F.lit(0)), 1).alias("tasa_aciertos_pct"),
        F.round(xsum(rev_h, 6) / F.count(rev_h), 1).alias("horas_promedio_revision"),
        F.max("comentario_mecanico").alias("comentario_tecnico_reciente"),
    )


def pending_alerts(al: DataFrame, a: DataFrame) -> DataFrame:
    """Unresolved alerts with the plate."""
    return al.filter(F.col("resuelta") == F.lit(False)).join(a.select("activo_id", "patente"), "activo_id").select(
        "alerta_id", "activo_id", "patente", "prioridad", "fecha_alerta")


def latest_predictions(sr: DataFrame, a: DataFrame) -> DataFrame:
    """Latest score per asset with the plate."""
    s = sr.join(a.select("activo_id", "patente"), "activo_id")
    return latest_score(s).select("scoring_id", "activo_id", "patente", "fecha_scoring", "probabilidad_falla",
                                  "prioridad", "modelo_version")


def filter_values(a: DataFrame) -> DataFrame:
    """Distinct vehicle types and brands (one row per value) plus the unit total."""
    t = a.filter(F.col("tipo_vehiculo").isNotNull()).select(F.lit("tipo_vehiculo").alias("campo"),
                                                            F.col("tipo_vehiculo").alias("valor")).distinct()
    b = a.filter(F.col("marca").isNotNull()).select(F.lit("marca").alias("campo"), F.col("marca").alias("valor")).distinct()
    tot = a.agg(F.count(F.lit(1)).cast("string").alias("valor")).select(F.lit("total_unidades").alias("campo"), "valor")
    return t.unionByName(b).unionByName(tot)


def risk_ranking(a: DataFrame, sr: DataFrame, ot: DataFrame, ev: DataFrame, tax: DataFrame,
                 as_of: dt.date, horizon: int = 30, n: int = 15) -> DataFrame:
    """Top-N assets by the latest failure probability of a horizon.

    Latest score, latest order and latest event system are each a
    ``row_number() = 1`` per asset, all keyed by ``activo_id`` so the joins
    reuse one hash partitioning; the top-N is a per-task bounded sort.
    """
    us = latest_score(sr, horizon).select("activo_id", "prioridad", "probabilidad_falla", "fecha_scoring")
    uo = latest_order(ot).select("activo_id", F.col("fecha_apertura").alias("_open"), F.col("odometro_km").alias("_odo"))
    sis = latest_event_system(ev, tax).withColumnRenamed("sistema", "sistema_riesgo")
    joined = (
        a.select("activo_id", "patente", "marca", "modelo", "odometro_km")
        .join(us, "activo_id")
        .join(uo, "activo_id", "left")
        .join(sis, "activo_id", "left")
        .select(
            "activo_id", "patente", "marca", "modelo", "prioridad", "probabilidad_falla", "fecha_scoring",
            "sistema_riesgo",
            F.datediff(F.lit(as_of), F.to_date("_open")).alias("dias_ultima_ot"),
            F.coalesce(F.col("odometro_km"), F.col("_odo"), F.lit(0.0)).alias("km_actual"),
        )
    )
    order = [F.col("probabilidad_falla").desc_nulls_last(), F.col("activo_id").asc()]
    return top_n(joined, order, n).withColumn("horizonte_dias", F.lit(horizon))


def risk_ranking_of_day(a: DataFrame, sr: DataFrame, ot: DataFrame, ev: DataFrame, tax: DataFrame, day: dt.date,
                        horizon: int = 30, n: int = 15) -> DataFrame:
    """K13 legacy form: the scores of one day alone, with a probable failure date (the day plus the horizon), the latest
    order's system ('N/A' without one) and odometer, the days since it (0 without one) and the asset's age in years."""
    s = sr.filter((F.col("fecha_scoring") == F.lit(day)) & (F.col("horizonte_dias") == horizon) & F.col("prioridad").isin(*vocab.PRIORITIES))
    last = latest_order(ot).join(order_system(ev, tax), "ot_id", "left").select(
        "activo_id", F.col("fecha_apertura").alias("_open"), F.col("sistema").alias("_sys"), F.col("odometro_km").alias("_odo"))
    j = s.join(a.select("activo_id", "patente", "marca", "modelo", "fecha_alta_flota"), "activo_id").join(last, "activo_id", "left")
    out = j.select(
        "activo_id", "patente", "marca", "modelo", "fecha_alta_flota", "probabilidad_falla", F.col("prioridad").alias("semaforo"),
        F.round(F.col("probabilidad_falla") * 100, 1).alias("prob_30d"), F.lit(day + dt.timedelta(days=horizon)).alias("fecha_probable_falla"),
        F.coalesce("_sys", F.lit("N/A")).alias("sistema_riesgo"),
        F.coalesce(elapsed_days(F.lit(day).cast("timestamp_ntz"), "_open"), F.lit(0)).cast("int").alias("dias_ultima_ot"),
        F.coalesce("_odo", F.lit(0.0)).alias("km_actual"), age_years("fecha_alta_flota", day).alias("edad_anos"), "fecha_scoring", "modelo_version")
    return top_n(out, [F.col("probabilidad_falla").desc(), F.col("activo_id").asc()], n)


__all__ = [n for n in dir() if not n.startswith("_")] + ["latest_per_key", "latest_order"]


# ------------------------------------------------------------ K38-K40
PANEL_COLS = ["vista", "metrica", "horizonte_dias", "valor", "nota"]


def metric_row(df: DataFrame, vista: str, metrica: str, col: str = "valor", horizon: int | str | None = None,
               nota: str | None = None) -> DataFrame:
    """One long-form panel row per input row: (vista, metrica, horizonte_dias, valor, nota)."""
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    return df.select(F.lit(vista).alias("vista"), F.lit(metrica).alias("metrica"), h.cast("int").alias("horizonte_dias"),
                     F.col(col).cast("double").alias("valor"), F.lit(nota).cast("string").alias("nota"))


def missing_metric(spark, vista: str, metrica: str, nota: str = "Tabla faltante") -> DataFrame:
    """A metric whose optional source table is absent: NULL value plus a note."""
    return spark.createDataFrame([(vista, metrica, None, None, nota)],
                                 "vista string, metrica string, horizonte_dias int, valor double, nota string")


def store_metrics(prev: DataFrame, new: DataFrame) -> DataFrame:
    """One current row per (vista, metrica, horizon) with the previous value; metrics not
    recomputed keep their stored row. The key is null-safe (horizon may be NULL)."""
    p = prev.select(F.col("vista").alias("_v"), F.col("metrica").alias("_m"), F.col("horizonte_dias").alias("_h"),
                    F.col("valor").alias("_prev"))
    key = (new.vista == p._v) & (new.metrica == p._m) & new.horizonte_dias.eqNullSafe(p._h)
    cur = new.join(p, key, "left").select(*[new[c] for c in new.columns], F.col("_prev").alias("valor_anterior"))
    cur = cur.select("vista", "metrica", "horizonte_dias", "valor", "valor_anterior", "nota")
    stale_key = (prev.vista == new.vista) & (prev.metrica == new.metrica) & prev.horizonte_dias.eqNullSafe(new.horizonte_dias)
    stale = prev.join(new.select("vista", "metrica", "horizonte_dias"), stale_key, "left_anti")
    if "valor_anterior" not in stale.columns:
        stale = stale.withColumn("valor_anterior", F.lit(None).cast("double"))
    return cur.unionByName(stale.select("vista", "metrica", "horizonte_dias", "valor", "valor_anterior", "nota"))


def drift(sr: DataFrame, as_of: dt.date, bins: int = 10, limit: float = 0.1) -> DataFrame:
    """K40 (described, not built in the reference): per horizon, KL divergence of the score histogram of the
    last 2 weeks against the last 4 weeks over fixed-width bins; 'Drift detectado' above ``limit``."""
    s = sr.filter(F.col("fecha_scoring") >= ago(as_of, 28)).select(
        "horizonte_dias", F.least(F.floor(F.col("probabilidad_falla") * bins), F.lit(bins - 1)).cast("int").alias("bin"),
        (F.col("fecha_scoring") >= ago(as_of, 14)).alias("recent"))
    h = s.groupBy("horizonte_dias", "bin").agg(F.count(F.when(F.col("recent"), 1)).alias("n_p"), F.count(F.lit(1)).alias("n_q"))
    tot = h.groupBy("horizonte_dias").agg(F.sum("n_p").alias("t_p"), F.sum("n_q").alias("t_q"))
    j = h.join(tot, "horizonte_dias")
    p = F.col("n_p") / F.col("t_p")
    q = F.col("n_q") / F.col("t_q")
    kl = j.filter(F.col("n_p") > 0).groupBy("horizonte_dias").agg(F.sum(p * F.log(p / q)).alias("kl"))
    return kl.select("horizonte_dias", F.round("kl", 9).alias("drift_score"),
                     F.when(F.col("kl") > limit, "Drift detectado").otherwise("Estable").alias("estado_modelo"))
