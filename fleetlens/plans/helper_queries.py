"""One small query per column / window helper (F*, W*) that no bigger operator already exercises,
each with its DuckDB twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import parts as D
from ..operators import panels as K
from ..operators.common import latest_order
from ..sources.fixtures import AS_OF, fleet
from .parts_queries import inter_sql
from .panel_queries import EVENT_AGE
from .registry import register


def F_(spark, d):
    return fleet(spark, d)


@register("F8_F9_F10_elapsed_days_and_hours", f"""
SELECT ot_id, CAST(floor((epoch(TIMESTAMP '{AS_OF} 00:00:00') - epoch(fecha_apertura)) / 86400) AS INTEGER) AS dias_24h,
  CAST(date_diff('day', CAST(fecha_apertura AS DATE), DATE '{AS_OF}') AS INTEGER) AS dias_calendario,
  (epoch(fecha_cierre) - epoch(fecha_apertura)) / 3600.0 AS horas_reparacion
FROM ordenes_trabajo""")
def f8(spark, d):
    ot = F_(spark, d).ordenes_trabajo
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return ot.select("ot_id", C.elapsed_days(as_of, "fecha_apertura").alias("dias_24h"),
                     C.day_diff(F.lit(AS_OF), "fecha_apertura").alias("dias_calendario"),
                     C.hours_between("fecha_apertura", "fecha_cierre").alias("horas_reparacion"))


@register("F11_F12_month_and_age", f"""
SELECT activo_id, CAST(date_trunc('month', fecha_alta_flota) AS DATE) AS mes_alta,
  CAST(date_part('year', age(DATE '{AS_OF}', fecha_alta_flota)) AS INTEGER) AS edad_anos
FROM activos""")
def f11(spark, d):
    a = F_(spark, d).activos
    return a.select("activo_id", C.month_start("fecha_alta_flota").alias("mes_alta"),
                    C.age_years("fecha_alta_flota", AS_OF).alias("edad_anos"))


@register("F13_next_order_id", """
WITH ids AS (SELECT printf('OT-%d-%d', year(fecha_apertura), CAST(ot_id AS BIGINT)) AS ot_code, year(fecha_apertura) AS anio
             FROM ordenes_trabajo)
SELECT 'OT-' || CAST(anio AS VARCHAR) || '-' AS prefijo,
  coalesce(max(CAST(split_part(ot_code, '-', 3) AS INTEGER)), 0) + 1 AS proxima_secuencia
FROM ids WHERE ot_code LIKE 'OT-%' GROUP BY anio""")
def f13(spark, d):
    ot = F_(spark, d).ordenes_trabajo
    ids = ot.select(F.format_string("OT-%d-%d", F.year("fecha_apertura"), F.col("ot_id").cast("bigint")).alias("ot_code"),
                    F.year("fecha_apertura").alias("anio"))
    return C.next_sequence(ids, "ot_code", "anio")


@register("F13_assigned_order_ids", """
WITH sig AS (SELECT year(fecha_apertura) AS anio, max(CAST(ot_id AS BIGINT)) + 1 AS inicio FROM ordenes_trabajo GROUP BY 1),
n AS (SELECT ot_id, year(fecha_apertura) AS anio, row_number() OVER (PARTITION BY year(fecha_apertura) ORDER BY fecha_apertura, ot_id) AS k
      FROM ordenes_nuevas)
SELECT n.ot_id, 'OT-' || CAST(n.anio AS VARCHAR) || '-' || CAST(sig.inicio + k - 1 AS VARCHAR) AS ot_nuevo
FROM n JOIN sig ON n.anio = sig.anio""")
def f13_assigned(spark, d):
    """Consecutive ids for a batch of orders, after the last one of their year."""
    f = F_(spark, d)
    ot = f.ordenes_trabajo
    ids = ot.select(F.format_string("OT-%d-%d", F.year("fecha_apertura"), F.col("ot_id").cast("bigint")).alias("ot_code"), F.year("fecha_apertura").alias("anio"))
    new = f.ordenes_nuevas.select("ot_id", "fecha_apertura", F.concat(F.lit("OT-"), F.year("fecha_apertura").cast("string"), F.lit("-")).alias("prefijo"))
    rows = new.join(C.next_sequence(ids, "ot_code", "anio"), "prefijo")
    return C.assign_sequence(rows, "proxima_secuencia", ["fecha_apertura", "ot_id"], "ot_nuevo").select("ot_id", "ot_nuevo")


@register("F14_valid_sku_share", """
SELECT count(*) AS total, count(CASE WHEN regexp_full_match(sku, '^REP-[0-9]{4}$') THEN 1 END) AS validos
FROM repuestos_maestro""")
def f14(spark, d):
    rm = F_(spark, d).repuestos_maestro
    return rm.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(C.sku_ok("sku"), 1)).alias("validos"))


@register("F15_split_metric_name", f"""
SELECT patente, CASE WHEN instr(m, ' - ') > 0 THEN split_part(m, ' - ', 1) ELSE m END AS prioridad,
  CASE WHEN instr(m, ' - ') > 0 THEN substr(m, instr(m, ' - ') + 3) END AS tipo
FROM (SELECT patente, urgencia || ' - ' || tipo AS m FROM {inter_sql()})""")
def f15(spark, d):
    f = F_(spark, d)
    i = D.interventions(f.scoring_resultados, f.activos, f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas)
    m = F.concat_ws(" - ", "urgencia", "tipo")
    left, right = C.split_metric(m)
    return i.select("patente", left.alias("prioridad"), right.alias("tipo"))


@register("F16_system_lists", """
SELECT scoring_id, list_filter(list_transform(string_split(coalesce(sistema_en_riesgo, ''), '|'), lambda y: lower(trim(y))),
  lambda y: y NOT IN ('', 'general', 'nan', 'none')) AS sistemas FROM scoring_resultados""")
def f16(spark, d):
    sr = F_(spark, d).scoring_resultados
    return sr.select("scoring_id", C.system_list("sistema_en_riesgo").alias("sistemas"))


@register("F17_normalize_descriptions", """
SELECT CAST(doc_id AS VARCHAR) AS ot_id, trim(regexp_replace(replace(replace(replace(lower(coalesce(text, '')), '.,;:', ''), '!?', ''),
  '"''', ''), '\\s+', ' ', 'g')) AS descripcion_normalizada FROM documents""")
def f17(spark, d):
    docs = F_(spark, d).descripciones
    return docs.select("ot_id", C.normalize_text("descripcion_falla").alias("descripcion_normalizada"))


@register("F24_next_order_estimates", """
SELECT a.activo_id, CASE WHEN lo.costo_total_clp IS NOT NULL AND lo.costo_total_clp <> 0 THEN lo.costo_total_clp * 1.15 ELSE 300000.0 END AS costo_estimado,
  CASE WHEN lo.odometro_km IS NOT NULL AND lo.odometro_km <> 0 THEN lo.odometro_km + 150 ELSE 100.0 END AS odometro_estimado
FROM activos a LEFT JOIN (SELECT * FROM ordenes_trabajo
  QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_apertura DESC, ot_id DESC) = 1) lo ON a.activo_id = lo.activo_id""")
def f24(spark, d):
    f = F_(spark, d)
    return C.next_order_estimates(f.activos.select("activo_id").join(latest_order(f.ordenes_trabajo), "activo_id", "left"))


@register("F25_months_in_use", f"""
SELECT greatest(0, CAST(floor(date_diff('day', min(fecha_scoring), DATE '{AS_OF}') / 30) AS INTEGER)) AS meses_uso
FROM scoring_resultados""")
def f25(spark, d):
    sr = F_(spark, d).scoring_resultados
    return sr.agg(F.greatest(F.lit(0), F.floor(F.datediff(F.lit(AS_OF), F.min("fecha_scoring")) / 30).cast("int")).alias("meses_uso"))


@register("W13_previous_value_per_metric", """
WITH s AS (SELECT horizonte_dias, fecha_scoring, count(CASE WHEN prioridad IN ('P1_critica', 'P2_alta') THEN 1 END) AS valor
           FROM scoring_resultados GROUP BY 1, 2)
SELECT horizonte_dias, fecha_scoring, valor,
  lag(valor) OVER (PARTITION BY horizonte_dias ORDER BY fecha_scoring) AS valor_anterior,
  valor - lag(valor) OVER (PARTITION BY horizonte_dias ORDER BY fecha_scoring) AS delta
FROM s""")
def w13(spark, d):
    sr = F_(spark, d).scoring_resultados
    s = sr.groupBy("horizonte_dias", "fecha_scoring").agg(F.count(F.when(F.col("prioridad").isin("P1_critica", "P2_alta"), 1)).alias("valor"))
    # one series per (metric, horizon): the window holds one value per run date, bounded by the history length
    w = Window.partitionBy("horizonte_dias").orderBy("fecha_scoring")
    s = s.withColumn("valor_anterior", F.lag("valor").over(w))
    return s.withColumn("delta", C.metric_delta("valor", "valor_anterior"))


@register("W17_heatmap_wide", f"""WITH {EVENT_AGE}
SELECT sistema, {', '.join(f"coalesce(sum(n) FILTER (horizonte = {h}), 0)::BIGINT AS h{h}" for h in (7, 30, 90))} FROM por_banda GROUP BY sistema""")
def w17(spark, d):
    f = F_(spark, d)
    hm = K.heatmap(f.ot_falla_evento, f.taxonomia_fallas, f.ordenes_trabajo, AS_OF)
    wide = hm.groupBy("sistema").pivot("horizonte", [7, 30, 90]).agg(F.sum("n")).fillna(0)
    return wide.select("sistema", *[F.col(str(h)).cast("bigint").alias(f"h{h}") for h in (7, 30, 90)])
