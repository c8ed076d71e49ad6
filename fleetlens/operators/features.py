"""Point-in-time feature panel (P1-P8), leakage-free by construction.

The reference rebuilds the features once per (cut-off, horizon) from full
table reads. Here the whole panel is one plan:

* cut-offs are the grid ``as_of - k * step`` (k = 0..n-1);
* every past order is exploded, by integer arithmetic, to the cut-offs whose
  trailing window can contain it (at most ``max(windows) / step + 1``) and,
  for corrective orders, to the cut-offs whose forward target it can hit
  (at most ``max(horizons) / step + 1``) - never an orders x cut-offs join;
* the unbounded "latest order before the cut-off" parts are pre-aggregated
  per (asset, cut-off bucket) and carried forward with a running max over at
  most n rows per asset;
* all contributions are unioned and aggregated once on (activo_id, k), so a
  hot asset is reduced map-side before the shuffle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import active_asset, lower_in

DAY = 86400


def cutoffs(as_of: dt.date, back: int = 180, step: int = 30) -> list[dt.date]:
    """``as_of - d`` for d in range(0, back, step), oldest first."""
    return sorted(as_of - dt.timedelta(days=d) for d in range(0, back, step))


def _epoch(c: Column) -> Column:
    return F.unix_timestamp(F.to_timestamp(c)).cast("long")


def feature_panel(a: DataFrame, ot: DataFrame, as_of: dt.date, back: int = 180, step: int = 30,
                  horizons: Sequence[int] = vocab.HORIZONS, windows: Sequence[int] = (7, 30, 90),
                  corrective: Sequence[str] = vocab.CORRECTIVE, target_closed: str = "right",
                  active_mode: str = "activo", drop_unenrolled: bool = False,
                  complete_targets_only: bool = False) -> DataFrame:
    """P2-P6 (P8 through the parameters): one row per (active asset, cut-off, horizon).

    ``drop_unenrolled`` removes assets enrolled after the cut-off (the source keeps them with a negative
    age); ``complete_targets_only`` removes cut-offs whose target window ends after ``as_of``."""
    n = len(range(0, back, step))
    S = step * DAY
    W = max(windows)
    H = max(horizons)
    asof_s = F.lit(int(dt.datetime.combine(as_of, dt.time()).replace(tzinfo=dt.timezone.utc).timestamp()))

    o = ot.select(
        "activo_id", "ot_id",
        _epoch("fecha_apertura").alias("t"),
        "odometro_km", "horometro_h", "costo_total_clp",
        lower_in("tipo_ot", corrective).alias("corr"),
    ).filter(F.col("t").isNotNull())
    o = o.withColumn("xs", asof_s - F.col("t"))  # seconds from the order to as_of midnight

    def cut_s(k: Column) -> Column:  # cut-off k as epoch seconds
        return asof_s - k * F.lit(S)

    # -- trailing windows: cut-offs c with c - W days <= t < c
    k_lo = F.greatest(F.lit(0), -F.floor((F.lit(W * DAY) - F.col("xs")) / F.lit(S)).cast("int"))
    k_hi = F.least(F.lit(n - 1), F.floor((F.col("xs") - 1) / F.lit(S)).cast("int"))
    past = o.filter(F.col("xs") > 0)
    win = past.filter(k_lo <= k_hi).withColumn("k", F.explode(F.sequence(k_lo, k_hi)))
    age_s = cut_s(F.col("k")) - F.col("t")  # > 0 and <= W days by construction
    win_cols = {}
    for w in windows:
        inw = age_s <= F.lit(w * DAY)
        win_cols[f"n{w}"] = F.when(inw, 1).otherwise(0)
        win_cols[f"c{w}"] = F.when(inw & F.col("corr"), 1).otherwise(0)
        win_cols[f"h{w}"] = F.when(inw, 1).otherwise(0)
        win_cols[f"m{w}"] = F.when(inw, F.coalesce(F.col("costo_total_clp"), F.lit(0.0)))
    win = win.select("activo_id", "k", *[v.alias(k) for k, v in win_cols.items()])

    # -- latest order before the cut-off: bucket = nearest cut-off after the order
    bucket = F.least(F.lit(n - 1), F.floor((F.col("xs") - 1) / F.lit(S)).cast("int"))
    b = past.select(
        "activo_id", bucket.alias("k"),
        F.col("t").alias("b_t"),
        F.when(F.col("odometro_km").isNotNull(), F.struct("t", "ot_id", "odometro_km")).alias("b_odo"),
        F.when(F.col("horometro_h").isNotNull(), F.struct("t", "ot_id", "horometro_h")).alias("b_hor"),
    )

    # -- forward target: corrective with c < t <= c + H  (or c <= t < c + H when closed on the left)
    if target_closed == "right":
        t_lo = F.greatest(F.lit(0), (F.floor(F.col("xs") / F.lit(S)) + 1).cast("int"))
        t_hi = F.least(F.lit(n - 1), F.floor((F.col("xs") + F.lit(H * DAY)) / F.lit(S)).cast("int"))
    else:
        t_lo = F.greatest(F.lit(0), (-F.floor(-F.col("xs") / F.lit(S))).cast("int"))
        t_hi = F.least(F.lit(n - 1), (-F.floor((-F.col("xs") - F.lit(H * DAY)) / F.lit(S)) - 1).cast("int"))
    fut = o.filter(F.col("corr")).filter(t_lo <= t_hi).withColumn("k", F.explode(F.sequence(t_lo, t_hi)))
    ahead = F.col("t") - cut_s(F.col("k"))
    tgt_cols = {}
    for h in horizons:
        hit = (ahead <= F.lit(h * DAY)) if target_closed == "right" else (ahead < F.lit(h * DAY))
        tgt_cols[f"y{h}"] = F.when(hit, 1).otherwise(0)
    fut = fut.select("activo_id", "k", *[v.alias(k) for k, v in tgt_cols.items()])

    # -- spine: active assets x cut-offs (a generator, not a join)
    spine = a.filter(active_asset("estado_actual", active_mode)).select(
        "activo_id", "fecha_alta_flota",
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"),
    ).withColumn("_spine", F.lit(1))

    cols = ["activo_id", "k", "_spine", "fecha_alta_flota", "b_t", "b_odo", "b_hor", *win_cols, *tgt_cols]

    def widen(df: DataFrame) -> DataFrame:
        types = {"_spine": "int", "fecha_alta_flota": "date", "b_t": "long",
                 "b_odo": "struct<t:bigint,ot_id:string,odometro_km:double>",
                 "b_hor": "struct<t:bigint,ot_id:string,horometro_h:double>"}
        out = []
        for c in cols:
            if c in df.columns:
                out.append(F.col(c))
            else:
                typ = types.get(c, "double" if c.startswith("m") else "int")
                out.append(F.lit(None).cast(typ).alias(c))
        return df.select(*out)

    u = widen(spine).unionByName(widen(win)).unionByName(widen(b)).unionByName(widen(fut))
    aggs = [F.max("_spine").alias("_spine"), F.max("fecha_alta_flota").alias("fecha_alta_flota"),
            F.max("b_t").alias("b_t"), F.max("b_odo").alias("b_odo"), F.max("b_hor").alias("b_hor")]
    for w in windows:
        aggs += [F.sum(f"n{w}").alias(f"n{w}"), F.sum(f"c{w}").alias(f"c{w}"),
                 F.sum(f"h{w}").alias(f"h{w}"),
                 F.sum(F.col(f"m{w}").cast("decimal(38,2)")).cast("double").alias(f"m{w}")]
    aggs += [F.max(f"y{h}").alias(f"y{h}") for h in horizons]
    g = u.groupBy("activo_id", "k").agg(*aggs)

    carry = Window.partitionBy("activo_id").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = (g.withColumn("last_t", F.max("b_t").over(carry))
          .withColumn("last_odo", F.max("b_odo").over(carry))
          .withColumn("last_hor", F.max("b_hor").over(carry))
          .filter(F.col("_spine") == 1))

    cut_date = F.date_sub(F.lit(as_of), F.col("k") * F.lit(step))
    edad = F.coalesce(F.datediff(cut_date, F.col("fecha_alta_flota")), F.lit(-1))
    since_last = F.floor((cut_s(F.col("k")) - F.col("last_t")) / F.lit(DAY)).cast("int")

    def count_or_sentinel(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(-1)).cast("int")

    def cost_or_sentinel(w: int) -> Column:
        return F.when(F.col(f"h{w}") > 0, F.col(f"m{w}")).otherwise(F.lit(-1.0))

    hz = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizonte_dias")
    base = g.select("*", hz)
    target = F.lit(0)
    for h in horizons:
        target = F.when(F.col("horizonte_dias") == h, F.coalesce(F.col(f"y{h}"), F.lit(0))).otherwise(target)

    out = [
        F.col("activo_id"), cut_date.alias("fecha_corte"), F.col("horizonte_dias").cast("int").alias("horizonte_dias"),
        edad.cast("int").alias("edad_dias"), (edad / F.lit(365.25)).alias("edad_anos"),
        F.coalesce(F.col("last_odo.odometro_km"), F.lit(-1.0)).alias("odometro_actual"),
        F.coalesce(F.col("last_hor.horometro_h"), F.lit(-1.0)).alias("horometro_actual"),
        F.lit(-1.0).alias("km_dia_promedio"), F.lit(-1.0).alias("horas_dia_promedio"),
        F.coalesce(since_last, F.lit(-1)).alias("dias_desde_ultima_ot"),
    ]
    out += [count_or_sentinel(f"n{w}").alias(f"count_ot_{w}d") for w in windows]
    out += [count_or_sentinel(f"c{w}").alias(f"count_correctivas_{w}d") for w in windows]
    out += [cost_or_sentinel(w).alias(f"costo_total_{w}d") for w in windows]
    out += [F.lit(-1.0).alias(f"mtbf_{max(windows)}d")]
    out += [F.lit(-1.0).alias(f"dias_ult_correctiva_{s}") for s in ("motor", "frenos", "transmision")]
    out += [target.cast("int").alias("target")]
    res = base.select(*out)
    if drop_unenrolled:
        res = res.filter(F.col("edad_dias") >= 0)
    if complete_targets_only:
        res = res.filter(F.date_add("fecha_corte", F.col("horizonte_dias")) <= F.lit(as_of))
    return res


def days_since_corrective_by_system(ot: DataFrame, ev: DataFrame, tax: DataFrame, as_of: dt.date,
                                    back: int = 180, step: int = 30,
                                    corrective: Sequence[str] = vocab.CORRECTIVE) -> DataFrame:
    """P7 (spec only in the reference): per (asset, cut-off, system) the whole days since the
    latest corrective order of that system opened before the cut-off.

    Same bucket + carry-forward scheme as the panel: a corrective order falls
    in the bucket of the nearest cut-off after it; a running max over the
    (at most n) buckets of each (asset, system) gives the latest one.
    """
    n = len(range(0, back, step))
    S = step * DAY
    asof_s = int(dt.datetime.combine(as_of, dt.time()).replace(tzinfo=dt.timezone.utc).timestamp())
    sys_of_order = ev.filter(F.col("ot_id").isNotNull()).join(tax.select("taxonomia_id", "sistema"), "taxonomia_id") \
        .select("ot_id", "sistema").distinct()
    o = ot.filter(lower_in("tipo_ot", corrective)).select("ot_id", "activo_id", _epoch("fecha_apertura").alias("t")) \
        .withColumn("xs", F.lit(asof_s) - F.col("t")).filter(F.col("xs") > 0)
    o = o.join(sys_of_order, "ot_id")
    bucket = F.least(F.lit(n - 1), F.floor((F.col("xs") - 1) / F.lit(S)).cast("int"))
    g = o.groupBy("activo_id", "sistema", bucket.alias("k")).agg(F.max("t").alias("b_t"))
    # every (asset, system) seen gets all n cut-offs, then the running max carries the latest order forward
    keys = g.select("activo_id", "sistema").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    j = keys.join(g, ["activo_id", "sistema", "k"], "left")
    carry = Window.partitionBy("activo_id", "sistema").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("last_t", F.max("b_t").over(carry)).filter(F.col("last_t").isNotNull())
    cut_s = F.lit(asof_s) - F.col("k") * F.lit(S)
    return j.select("activo_id", F.date_sub(F.lit(as_of), F.col("k") * F.lit(step)).alias("fecha_corte"), "sistema",
                    F.floor((cut_s - F.col("last_t")) / F.lit(DAY)).cast("int").alias("dias_ult_correctiva"))


def mtbf_window(dd: DataFrame, ot: DataFrame, as_of: dt.date, back: int = 180, step: int = 30, days: int = 90,
                corrective: Sequence[str] = vocab.CORRECTIVE) -> DataFrame:
    """P7 (spec only): per (asset, cut-off) up hours of the trailing window / corrective orders in it;
    -1 when there is no corrective order (the panel's sentinel)."""
    n = len(range(0, back, step))
    cut = [as_of - dt.timedelta(days=k * step) for k in range(n)]
    # each availability day belongs to the cut-offs whose window [c - days, c) contains it
    d = dd.select("activo_id", "fecha", "horas_operativas")
    x = F.datediff(F.lit(as_of), F.col("fecha"))  # days before as_of
    lo = F.greatest(F.lit(0), -F.floor((F.lit(days) - x) / F.lit(step)).cast("int"))
    hi = F.least(F.lit(n - 1), F.floor((x - 1) / F.lit(step)).cast("int"))
    up = d.filter(x > 0).filter(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi))) \
        .groupBy("activo_id", "k").agg(F.sum(F.col("horas_operativas").cast("decimal(38,2)")).cast("double").alias("h_up"))
    o = ot.filter(lower_in("tipo_ot", corrective)).select("activo_id", F.to_date("fecha_apertura").alias("fecha"))
    xo = F.datediff(F.lit(as_of), F.col("fecha"))
    lo_o = F.greatest(F.lit(0), -F.floor((F.lit(days) - xo) / F.lit(step)).cast("int"))
    hi_o = F.least(F.lit(n - 1), F.floor((xo - 1) / F.lit(step)).cast("int"))
    fails = o.filter(xo > 0).filter(lo_o <= hi_o).withColumn("k", F.explode(F.sequence(lo_o, hi_o))) \
        .groupBy("activo_id", "k").agg(F.count(F.lit(1)).alias("n_corr"))
    j = up.join(fails, ["activo_id", "k"], "left")
    del cut
    return j.select(
        "activo_id", F.date_sub(F.lit(as_of), F.col("k") * F.lit(step)).alias("fecha_corte"),
        F.when(F.col("n_corr") > 0, F.round(F.col("h_up") / F.col("n_corr"), 6)).otherwise(F.lit(-1.0)).alias(f"mtbf_{days}d"),
    )
