"""Daily availability (A1-A7): split repair intervals over calendar days.

Only orders that can touch the range are read (plain comparisons on the date
columns, which reach the scan). Cells with downtime are aggregated, folded
into one bounded map per asset and joined to the assets; the calendar is
generated after that, so the asset x day spine is never shuffled.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import norm
from ..sources.day_table import DayTable
from .windows import severity_rank


def max_severity_per_order(ev: DataFrame) -> DataFrame:
    """The highest severity rank per order (3 critica, 2 media, 1 leve, 0 other)."""
    return (
        ev.filter(F.col("ot_id").isNotNull())
        .groupBy("ot_id")
        .agg(F.max(severity_rank("severidad")).alias("sev_rank"))
    )


def _prepared(ot: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    opened, closed = F.col("fecha_apertura"), F.col("fecha_cierre")
    since, until = (F.lit(dt.datetime.combine(x, dt.time())).cast("timestamp_ntz") for x in (start, end + dt.timedelta(days=1)))
    ot = ot.filter((opened < until) & ((closed >= since) | closed.isNull() | (opened >= since)))
    o = ot.select("ot_id", "activo_id", "fecha_apertura", "fecha_cierre", norm("tipo_ot").alias("tipo"))
    return o.withColumn("planned", F.col("tipo").isin(*vocab.PREVENTIVE))


def _uses_real(c_open: Column, c_close: Column) -> Column:
    return c_close.isNotNull() & (c_close > c_open)


def _cells(seconds: Column, calculated: bool) -> list[Column]:
    """Whole seconds of planned and unplanned downtime: their sums are exact in any order."""
    return ["activo_id", "fecha", F.when(F.col("planned"), seconds).otherwise(0).alias("plan_s"),
            F.when(F.col("planned"), 0).otherwise(seconds).alias("noplan_s"), F.lit(calculated).alias("calculado")]


def _hours(cells: DataFrame) -> DataFrame:
    return cells.select("activo_id", "fecha", (F.col("plan_s") / 3600.0).alias("plan"), (F.col("noplan_s") / 3600.0).alias("noplan"), "calculado")


def _real_cells(ot: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    o = _prepared(ot, start, end).filter(_uses_real(F.col("fecha_apertura"), F.col("fecha_cierre")))
    first = F.greatest(F.to_date("fecha_apertura"), F.lit(start))
    last = F.least(F.to_date("fecha_cierre"), F.lit(end))
    days = o.filter(first <= last).withColumn("fecha", F.explode(F.sequence(first, last)))
    day_start = F.to_timestamp_ntz(F.col("fecha"))
    day_end = F.timestamp_add("DAY", F.lit(1), day_start)
    secs = F.unix_timestamp(F.least(F.col("fecha_cierre"), day_end)) - F.unix_timestamp(
        F.greatest(F.col("fecha_apertura"), day_start)
    )
    return days.withColumn("s", F.least(secs, F.lit(86400)).cast("long")).filter("s > 0").select(*_cells(F.col("s"), True))


def downtime_real(ot: DataFrame, start: dt.date, end: dt.date, ev: DataFrame | None = None) -> DataFrame:
    """Interval x day. Each day of [open, close] inside [start, end]
    gets the overlap hours, clipped to [0, 24], dropped when 0. (Events have no say here.)"""
    return _hours(_real_cells(ot, start, end))


def fallback_hours(sev_rank: Column, planned: Column) -> Column:
    """24 / 8 / 4 h by severity, else 4 h preventive, 8 h otherwise."""
    by_type = F.when(planned, F.lit(vocab.FALLBACK_HOURS_PREVENTIVE)).otherwise(F.lit(vocab.FALLBACK_HOURS_OTHER))
    out = by_type
    for rank, hours in sorted(vocab.FALLBACK_HOURS_BY_RANK.items()):
        out = F.when(sev_rank == rank, F.lit(hours)).otherwise(out)
    return out


def _fallback_cells(ot: DataFrame, start: dt.date, end: dt.date, ev: DataFrame | None) -> DataFrame:
    o = _prepared(ot, start, end).filter(~_uses_real(F.col("fecha_apertura"), F.col("fecha_cierre")))
    o = o.withColumn("fecha", F.to_date("fecha_apertura")).filter((F.col("fecha") >= F.lit(start)) & (F.col("fecha") <= F.lit(end)))
    if ev is not None:
        # only events of these orders are read on: they are grouped after the semi-join
        o = o.join(max_severity_per_order(ev.join(o.select("ot_id"), "ot_id", "left_semi")), "ot_id", "left")
    else:
        o = o.withColumn("sev_rank", F.lit(None).cast("int"))
    return o.select(*_cells((fallback_hours(F.col("sev_rank"), F.col("planned")) * 3600).cast("long"), False))


def downtime_fallback(ot: DataFrame, start: dt.date, end: dt.date, ev: DataFrame | None = None) -> DataFrame:
    """A2: close missing or not after open -> fallback hours on the opening day, by the worst severity of its events."""
    return _hours(_fallback_cells(ot, start, end, ev))


def availability(ot: DataFrame, ev: DataFrame | None, assets: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A3/A4/A5: the complete asset x day matrix over [start, end].

    plan = min(plan, 24); unplanned = min(unplanned, 24 - plan);
    up = max(0, 24 - both); all half-even rounded to 2 decimals; ``fuente`` is
    'calculado' when a real interval touched the day or nothing did, else
    'inferido'.

    Generate after join: only the (asset, day) cells with downtime are
    aggregated, in whole seconds; they are folded into one array per asset (at
    most one entry per day of the range, so bounded) and joined to the assets.
    The days that the array lacks are added and all are exploded locally after
    the join. The asset x day spine - the bulk of the output - is never shuffled.
    """
    down = _real_cells(ot, start, end).unionByName(_fallback_cells(ot, start, end, ev))
    cells = down.groupBy("activo_id", "fecha").agg(
        F.sum("plan_s").alias("plan"), F.sum("noplan_s").alias("noplan"), F.bool_or("calculado").alias("calc"))
    per_asset = cells.groupBy("activo_id").agg(F.collect_list(F.struct("fecha", "plan", "noplan", "calc")).alias("_cells"))
    # the assets table is small in bytes but its calendar is the bulk of the output: spread the asset ids over
    # the shuffle partitions first (on the join key, so a sort-merge join reuses this partitioning)
    parts = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spine = assets.select("activo_id").repartition(parts, "activo_id").join(per_asset, "activo_id", "left")
    have = F.coalesce(F.col("_cells"), F.array().cast("array<struct<fecha:date,plan:bigint,noplan:bigint,calc:boolean>>"))
    zero = F.lit(0).cast("long")
    idle = F.transform(F.array_except(F.sequence(F.lit(start), F.lit(end)), F.transform(have, lambda c: c["fecha"])),
                       lambda day: F.struct(day.alias("fecha"), zero.alias("plan"), zero.alias("noplan"), F.lit(None).cast("boolean").alias("calc")))
    rows = spine.select("activo_id", F.explode(F.concat(have, idle)).alias("c")).select(
        "activo_id", "c.fecha", (F.col("c.plan") / 3600.0).alias("plan"), (F.col("c.noplan") / 3600.0).alias("noplan"), "c.calc")
    return _finish(rows)


def touched_cells(ot: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The (asset, day) cells of [start, end] that these orders have a say in."""
    return _real_cells(ot, start, end).unionByName(_fallback_cells(ot, start, end, None)).select("activo_id", "fecha").distinct()


def availability_at(ot: DataFrame, ev: DataFrame | None, cells: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The rows of ``availability`` for the given (asset, day) cells alone; ``ot`` holds all orders of their assets."""
    down = _real_cells(ot, start, end).unionByName(_fallback_cells(ot, start, end, ev))
    g = down.groupBy("activo_id", "fecha").agg(F.sum("plan_s").alias("plan"), F.sum("noplan_s").alias("noplan"), F.bool_or("calculado").alias("calc"))
    hours = lambda c: F.coalesce(F.col(c), F.lit(0)) / 3600.0
    return _finish(cells.join(g, ["activo_id", "fecha"], "left").select("activo_id", "fecha", hours("plan").alias("plan"), hours("noplan").alias("noplan"), "calc"))


def _finish(rows: DataFrame) -> DataFrame:
    plan = F.least(F.col("plan"), F.lit(24.0))
    noplan = F.least(F.col("noplan"), F.lit(24.0) - plan)
    up = F.greatest(F.lit(0.0), F.lit(24.0) - (plan + noplan))
    return rows.select(
        "activo_id",
        "fecha",
        F.bround(up, 2).alias("horas_operativas"),
        F.bround(plan, 2).alias("horas_detenido_planificado"),
        F.bround(noplan, 2).alias("horas_detenido_no_planificado"),
        F.when(F.col("calc") == F.lit(False), "inferido").otherwise("calculado").alias("fuente"),
    )


def availability_touched(ot: DataFrame, ev: DataFrame | None, start: dt.date, end: dt.date) -> DataFrame:
    """A6 core: only orders whose interval touches [start, end], only assets with such orders."""
    touching = ot.filter(
        (F.to_date("fecha_apertura") <= F.lit(end))
        & (F.col("fecha_cierre").isNull() | (F.to_date("fecha_cierre") >= F.lit(start)))
    )
    assets = touching.filter(F.col("activo_id").isNotNull()).select("activo_id").distinct()
    return availability(touching, ev, assets, start, end)


def availability_incremental(prev: DataFrame, ot: DataFrame, ev: DataFrame | None, as_of: dt.date,
                             spine: str = "touched", assets: DataFrame | None = None) -> DataFrame:
    """A6 + S8: recompute from (last date - 1) or as_of - 3 when empty, replace that asset x date range.

    The high-water mark is one scalar aggregate. Only rows from ``start`` on can be replaced: they are
    anti-joined on the key, all older rows pass through.
    """
    last = prev.agg(F.max("fecha")).first()[0]
    start = (last - dt.timedelta(days=1)) if last is not None else as_of - dt.timedelta(days=3)
    if spine == "all":  # every asset gets rows for the new days (the full rebuild's behaviour)
        new = availability(ot.filter((F.to_date("fecha_apertura") <= F.lit(as_of))
                                     & (F.col("fecha_cierre").isNull() | (F.to_date("fecha_cierre") >= F.lit(start)))),
                           ev, assets, start, as_of)
    else:  # as the source: only assets with an order touching the period
        new = availability_touched(ot, ev, start, as_of)
    old = F.coalesce(F.col("fecha") < F.lit(start), F.lit(True))
    kept = prev.filter(~old).join(new.select("activo_id", "fecha"), ["activo_id", "fecha"], "left_anti")
    return prev.filter(old).unionByName(kept).unionByName(new)


def availability_increment(table: DayTable, ot: DataFrame, ev: DataFrame | None, as_of: dt.date) -> list[dt.date]:
    """A6 + S8 on a table kept by day: recompute from (last day - 1), or as_of - 3 when empty, and replace that asset x date range.

    The high-water mark comes from the manifest; days before it are neither read nor written. Returns the days rewritten."""
    last = table.last_day()
    start = (last - dt.timedelta(days=1)) if last is not None else as_of - dt.timedelta(days=3)
    return table.upsert(availability_touched(ot, ev, start, as_of))


def availability_summary(dd: DataFrame) -> DataFrame:
    """Mean availability %, assets, days, rows, and rows per source."""
    pct = F.col("horas_operativas") / F.lit(24.0) * 100.0
    # two distinct counts in one aggregate would expand every row: days and assets are grouped apart
    days = dd.groupBy("fecha").agg(F.sum(pct).alias("_sum"), F.count(pct).alias("_with"), F.count(F.lit(1)).alias("_n"),
                                   F.count(F.when(F.col("fuente") == "calculado", 1)).alias("_calc"), F.count(F.when(F.col("fuente") == "inferido", 1)).alias("_inf"))
    total = days.agg(F.round(F.sum("_sum") / F.sum("_with"), 6).alias("disp_pct"), F.count("fecha").alias("dias"), F.coalesce(F.sum("_n"), F.lit(0)).alias("filas"),
                     F.coalesce(F.sum("_calc"), F.lit(0)).alias("filas_calculado"), F.coalesce(F.sum("_inf"), F.lit(0)).alias("filas_inferido"))
    assets = dd.groupBy("activo_id").agg(F.count(F.lit(1)).alias("_n")).agg(F.count("activo_id").alias("activos"))
    return total.crossJoin(assets).select("disp_pct", "activos", "dias", "filas", "filas_calculado", "filas_inferido")
