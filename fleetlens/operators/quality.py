"""Data-quality and validation operators (Q1-Q16).

Each audit is a single pass: one ``agg`` of conditional counts, so a table is
scanned once however many metrics are asked of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import confidence_band
from .windows import exact_median


def _pct(num: Column, den: Column) -> Column:
    return F.bround(F.lit(100.0) * num.cast("double") / den, 2)


def _completeness(cols) -> list[Column]:
    n = F.count(F.lit(1))
    return [_pct(F.count(F.col(c)), n).alias(f"completitud_{c}") for c in cols]


def audit_orders(ot: DataFrame) -> DataFrame:
    """Q1: completeness of (activo_id, fecha_apertura, tipo_ot), % close < open, % duplicate ids."""
    n = F.count(F.lit(1))
    return ot.agg(
        n.alias("total_registros"),
        *_completeness(["activo_id", "fecha_apertura", "tipo_ot"]),
        _pct(F.count(F.when(F.col("fecha_cierre") < F.col("fecha_apertura"), 1)), n).alias("fechas_invalidas_pct"),
        _pct(n - F.count_distinct("ot_id"), n).alias("duplicados_pct"),
    )


def audit_assets(a: DataFrame) -> DataFrame:
    """Q2: completeness of 4 fields and % duplicate plates."""
    n = F.count(F.lit(1))
    return a.agg(
        n.alias("total_registros"),
        *_completeness(["patente", "marca", "modelo", "anio_fabricacion"]),
        _pct(n - F.count_distinct("patente") - F.max(F.col("patente").isNull().cast("int")), n)
        .alias("patentes_duplicadas_pct"),
    )


def audit_parts(rc: DataFrame) -> DataFrame:
    """Q3: completeness, % negative quantity, % negative unit cost."""
    n = F.count(F.lit(1))
    return rc.agg(
        n.alias("total_registros"),
        *_completeness(["ot_id", "sku", "cantidad", "costo_unitario_clp"]),
        _pct(F.count(F.when(F.col("cantidad") < 0, 1)), n).alias("cantidad_negativa_pct"),
        _pct(F.count(F.when(F.col("costo_unitario_clp") < 0, 1)), n).alias("costo_negativo_pct"),
    )


def _long(df: DataFrame, source: str) -> DataFrame:
    cols = df.columns
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    return df.selectExpr(f"'{source}' AS fuente", f"stack({len(cols)}, {stack}) AS (metrica, valor)")


def audit_report(ot: DataFrame, a: DataFrame, rc: DataFrame) -> DataFrame:
    """Q4: the three audits as (fuente, metrica, valor) rows."""
    return (
        _long(audit_assets(a), "activos")
        .unionByName(_long(audit_orders(ot), "ordenes_trabajo"))
        .unionByName(_long(audit_parts(rc), "repuestos_consumidos"))
    )


def not_in(left: DataFrame, lcol: str, right: DataFrame, rcol: str) -> DataFrame:
    """SQL ``left.lcol NOT IN (SELECT rcol FROM right)``.

    A NULL on the right makes NOT IN empty, a NULL on the left never
    qualifies. The right's NULL flag is a one-row aggregate (bounded, so it is
    broadcast); the membership test is a ``left_anti`` join.
    """
    has_null = right.agg(F.max(F.col(rcol).isNull().cast("int")).alias("_rnull"))
    keys = right.select(F.col(rcol).alias("_rk")).filter(F.col("_rk").isNotNull())
    anti = left.filter(F.col(lcol).isNotNull()).join(keys, F.col(lcol) == F.col("_rk"), "left_anti")
    return anti.crossJoin(F.broadcast(has_null)).filter(F.coalesce(F.col("_rnull"), F.lit(0)) == 0).drop("_rnull")


def fk_report(ot: DataFrame, a: DataFrame, rc: DataFrame, ev: DataFrame, tax: DataFrame) -> DataFrame:
    """Q5: orphan counts for the four foreign keys plus NULLs in NOT NULL keys."""

    def rel(name, left, lcol, right, rcol, nulls_col=None):
        orphans = not_in(left, lcol, right, rcol).agg(F.count(F.lit(1)).alias("huerfanos"))
        nulls = left.agg(F.count(F.when(F.col(nulls_col or lcol).isNull(), 1)).alias("nulos"))
        return orphans.crossJoin(nulls).select(F.lit(name).alias("relacion"), "huerfanos", "nulos")

    return (
        rel("ordenes_trabajo.activo_id->activos", ot, "activo_id", a, "activo_id")
        .unionByName(rel("repuestos_consumidos.ot_id->ordenes_trabajo", rc, "ot_id", ot, "ot_id"))
        .unionByName(rel("ot_falla_evento.ot_id->ordenes_trabajo", ev, "ot_id", ot, "ot_id"))
        .unionByName(rel("ot_falla_evento.taxonomia_id->taxonomia_fallas", ev, "taxonomia_id", tax, "taxonomia_id"))
    )


def schema_report(tables: Mapping[str, DataFrame], contract: Mapping[str, Sequence[str]]) -> DataFrame:
    """Q6: tabla, columna, existe for every contracted column; metadata only, no data scan."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, t in tables and c in tables[t].columns) for t, cols in contract.items() for c in cols]
    return spark.createDataFrame(rows, "tabla string, columna string, existe boolean")


def coverage(ot: DataFrame, ev: DataFrame) -> DataFrame:
    """Q7: orders with / without a failure event and coverage %."""
    with_ev = ev.filter(F.col("ot_id").isNotNull()).select("ot_id").distinct().withColumn("_has", F.lit(1))
    j = ot.select("ot_id").join(with_ev, "ot_id", "left")
    n = F.count(F.lit(1))
    has = F.count("_has")
    return j.agg(
        n.alias("total_ot"),
        has.alias("con_evento"),
        (n - has).alias("sin_evento"),
        F.round(F.lit(100.0) * has.cast("double") / n, 1).alias("cobertura_pct"),
    )


def confidence_bands(ev: DataFrame) -> DataFrame:
    """Q8: events per confidence band; % over all events (NULL confidence falls in the lowest band)."""
    total = ev.agg(F.count(F.lit(1)).alias("_total"))
    g = ev.groupBy(confidence_band("confianza").alias("rango_confianza")).agg(F.count(F.lit(1)).alias("cantidad"))
    return g.crossJoin(F.broadcast(total)).select(
        "rango_confianza", "cantidad",
        F.round(F.lit(100.0) * F.col("cantidad").cast("double") / F.col("_total"), 1).alias("porcentaje"),
    )


def by_system(ev: DataFrame, tax: DataFrame) -> DataFrame:
    """Q9: per system: events, % of all events, distinct assets, mean confidence."""
    total = ev.agg(F.count(F.lit(1)).alias("_total"))
    j = ev.join(tax.select("taxonomia_id", "sistema"), "taxonomia_id", "left")
    g = j.groupBy("sistema").agg(
        F.count(F.lit(1)).alias("cantidad"),
        F.count_distinct("activo_id").alias("activos_afectados"),
        F.round(F.sum(F.col("confianza").cast("decimal(12,2)")).cast("double") / F.count("confianza"), 2)
        .alias("confianza_promedio"),
    )
    return g.crossJoin(F.broadcast(total)).select(
        "sistema", "cantidad",
        F.round(F.lit(100.0) * F.col("cantidad").cast("double") / F.col("_total"), 1).alias("porcentaje"),
        "activos_afectados", "confianza_promedio",
    )


def top_components(ev: DataFrame, tax: DataFrame, n: int = 10) -> DataFrame:
    """Q10: top (system, component) by events, with %."""
    total = ev.agg(F.count(F.lit(1)).alias("_total"))
    j = ev.join(tax.select("taxonomia_id", "sistema", "componente"), "taxonomia_id", "left")
    g = j.groupBy("sistema", "componente").agg(F.count(F.lit(1)).alias("cantidad"))
    top = g.orderBy(F.col("cantidad").desc(), F.col("sistema").asc_nulls_last(), F.col("componente").asc_nulls_last()).limit(n)
    return top.crossJoin(F.broadcast(total)).select(
        "sistema", "componente", "cantidad",
        F.round(F.lit(100.0) * F.col("cantidad").cast("double") / F.col("_total"), 1).alias("porcentaje"),
    )


def by_source(ev: DataFrame) -> DataFrame:
    """Events per source with %."""
    total = ev.agg(F.count(F.lit(1)).alias("_total"))
    g = ev.groupBy("fuente").agg(F.count(F.lit(1)).alias("cantidad"))
    return g.crossJoin(F.broadcast(total)).select(
        "fuente", "cantidad",
        F.round(F.lit(100.0) * F.col("cantidad").cast("double") / F.col("_total"), 1).alias("porcentaje"),
    )


def orphan_events(ev: DataFrame, tax: DataFrame) -> DataFrame:
    """Events whose taxonomy id is not in the catalogue (all of them, not a sample)."""
    return ev.join(tax.select("taxonomia_id"), "taxonomia_id", "left_anti").select("id_evento", "ot_id", "activo_id", "taxonomia_id")


def multi_event_orders(ev: DataFrame) -> DataFrame:
    """Orders with more than one event (GROUP BY ... HAVING)."""
    return (
        ev.filter(F.col("ot_id").isNotNull())
        .groupBy("ot_id")
        .agg(F.count(F.lit(1)).alias("cantidad_eventos"))
        .filter(F.col("cantidad_eventos") > 1)
    )


def last_classified(ev: DataFrame, tax: DataFrame, modes: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` latest events with their catalogue row and mode. The top rows are found before the dictionaries are joined."""
    top = ev.orderBy(F.col("fecha_evento").desc_nulls_last(), F.col("id_evento").desc()).limit(n)
    m = modes.select("id_modo_falla", "modo")
    t = tax.select("taxonomia_id", "sistema", "componente", "id_modo_falla")
    return top.join(t, "taxonomia_id", "left").join(m, "id_modo_falla", "left").select(
        "id_evento", "ot_id", "activo_id", "sistema", "componente", "modo", "confianza", "fuente", "fecha_evento")


def score_profile(sr: DataFrame) -> DataFrame:
    """Q13: per horizon: min / mean / median / max / std (population) and share >= .3/.6/.8.

    The exact median comes from ``exact_median`` (per-value counts and bucketed running totals), not from
    ``percentile``, whose buffer - a value->count map of the whole horizon - would sit in one task.
    """
    p = F.col("probabilidad_falla")
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n"),
        F.min(p).alias("p_min"),
        F.round(F.avg(p), 9).alias("p_media"),
        F.max(p).alias("p_max"),
        F.round(F.stddev_pop(p), 9).alias("p_std"),
    ]
    for t in (0.3, 0.6, 0.8):
        k = str(t).replace(".", "")
        c = F.count(F.when(p >= t, 1))
        aggs += [c.alias(f"n_ge_{k}"), F.round(c.cast("double") / n * 100.0, 6).alias(f"pct_ge_{k}")]
    med = exact_median(sr, "horizonte_dias", "probabilidad_falla", "_med")
    out = sr.groupBy("horizonte_dias").agg(*aggs).join(med, "horizonte_dias")
    cols = [c for c in out.columns if c != "_med"]
    i = cols.index("p_media") + 1
    cols = cols[:i] + [F.round("_med", 9).alias("p_mediana")] + cols[i:]
    return out.select(*cols)


def cost_profile(rm: DataFrame) -> DataFrame:
    """Q14: unit-cost column profile of the parts master."""
    c = F.col("costo_unitario_clp")
    return rm.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(c).alias("con_costo"),
        F.count(F.when(c.isNull(), 1)).alias("sin_costo"),
        F.count(F.when(c > 0, 1)).alias("con_costo_positivo"),
    )


def target_distribution(panel: DataFrame) -> DataFrame:
    """Q15: rows per target value with %, per horizon."""
    tot = panel.groupBy("horizonte_dias").agg(F.count(F.lit(1)).alias("_total"))
    g = panel.groupBy("horizonte_dias", "target").agg(F.count(F.lit(1)).alias("n"))
    return g.join(tot, "horizonte_dias").select(
        "horizonte_dias", "target", "n",
        F.round(F.lit(100.0) * F.col("n").cast("double") / F.col("_total"), 6).alias("pct"),
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Q16: one row per table with its row count (one union, one job)."""
    parts = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def demand_coverage(sr: DataFrame, a: DataFrame, csm: DataFrame) -> DataFrame:
    """Q12: per (brand, model, system at risk) of P1/P2 scores: distinct assets and candidate SKUs in the
    consumption map (the source compares with 'P1'/'P2', labels that never occur; the real labels are used)."""
    ap = sr.filter(F.col("prioridad").isin("P1_critica", "P2_alta")).join(a.select("activo_id", "marca", "modelo"), "activo_id") \
        .select("activo_id", "marca", "modelo", F.col("sistema_en_riesgo").alias("sistema"))
    # both sides are counted apart, so no score meets an SKU
    key = ["marca", "modelo", "sistema"]
    assets = ap.distinct().groupBy(*key).agg(F.count("activo_id").alias("activos"))
    skus = csm.select(*key, "sku").distinct().groupBy(*key).agg(F.count("sku").alias("skus_candidatos"))
    return assets.join(skus, key, "left").select(*key, "activos", F.coalesce("skus_candidatos", F.lit(0)).alias("skus_candidatos"))
