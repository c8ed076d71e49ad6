"""Q*: data-quality queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..sources.fixtures import fleet
from .registry import register

PCT2 = "round_even(100.0 * CAST({num} AS DOUBLE) / {den}, 2)"


def _compl(cols):
    return ", ".join(PCT2.format(num=f"count({c})", den="count(*)") + f" AS completitud_{c}" for c in cols)


Q1 = f"""SELECT count(*) AS total_registros, {_compl(['activo_id', 'fecha_apertura', 'tipo_ot'])},
  {PCT2.format(num="count(CASE WHEN fecha_cierre < fecha_apertura THEN 1 END)", den="count(*)")} AS fechas_invalidas_pct,
  {PCT2.format(num="count(*) - count(DISTINCT ot_id)", den="count(*)")} AS duplicados_pct
FROM ordenes_trabajo"""

Q2 = f"""SELECT count(*) AS total_registros, {_compl(['patente', 'marca', 'modelo', 'anio_fabricacion'])},
  {PCT2.format(num="count(*) - count(DISTINCT patente) - max(CAST(patente IS NULL AS INTEGER))", den="count(*)")} AS patentes_duplicadas_pct
FROM activos"""

Q3 = f"""SELECT count(*) AS total_registros, {_compl(['ot_id', 'sku', 'cantidad', 'costo_unitario_clp'])},
  {PCT2.format(num="count(CASE WHEN cantidad < 0 THEN 1 END)", den="count(*)")} AS cantidad_negativa_pct,
  {PCT2.format(num="count(CASE WHEN costo_unitario_clp < 0 THEN 1 END)", den="count(*)")} AS costo_negativo_pct
FROM repuestos_consumidos"""


@register("Q1_audit_orders", Q1)
def q1(spark, d):
    return q.audit_orders(fleet(spark, d).ordenes_trabajo)


@register("Q2_audit_assets", Q2)
def q2(spark, d):
    return q.audit_assets(fleet(spark, d).activos)


@register("Q3_audit_parts", Q3)
def q3(spark, d):
    return q.audit_parts(fleet(spark, d).repuestos_consumidos)


def _unpivot(sql, source):
    return f"""SELECT '{source}' AS fuente, metrica, CAST(valor AS DOUBLE) AS valor FROM (
  UNPIVOT (SELECT * REPLACE (CAST(total_registros AS DOUBLE) AS total_registros) FROM ({sql}))
  ON COLUMNS(*) INTO NAME metrica VALUE valor)"""


@register("Q4_audit_report", f"""{_unpivot(Q2, 'activos')} UNION ALL {_unpivot(Q1, 'ordenes_trabajo')}
UNION ALL {_unpivot(Q3, 'repuestos_consumidos')}""")
def q4(spark, d):
    f = fleet(spark, d)
    return q.audit_report(f.ordenes_trabajo, f.activos, f.repuestos_consumidos)


def _rel(name, left, lcol, right, rcol):
    return f"""SELECT '{name}' AS relacion,
  (SELECT count(*) FROM {left} WHERE {lcol} NOT IN (SELECT {rcol} FROM {right})) AS huerfanos,
  (SELECT count(*) FROM {left} WHERE {lcol} IS NULL) AS nulos"""


@register("Q5_fk_report", " UNION ALL ".join([
    _rel("ordenes_trabajo.activo_id->activos", "ordenes_trabajo", "activo_id", "activos", "activo_id"),
    _rel("repuestos_consumidos.ot_id->ordenes_trabajo", "repuestos_consumidos", "ot_id", "ordenes_trabajo", "ot_id"),
    _rel("ot_falla_evento.ot_id->ordenes_trabajo", "ot_falla_evento", "ot_id", "ordenes_trabajo", "ot_id"),
    _rel("ot_falla_evento.taxonomia_id->taxonomia_fallas", "ot_falla_evento", "taxonomia_id", "taxonomia_fallas", "taxonomia_id"),
]))
def q5(spark, d):
    f = fleet(spark, d)
    return q.fk_report(f.ordenes_trabajo, f.activos, f.repuestos_consumidos, f.ot_falla_evento, f.taxonomia_fallas)


@register("Q7_classification_coverage", """
SELECT count(*) AS total_ot,
  count(CASE WHEN ot_id IN (SELECT ot_id FROM ot_falla_evento) THEN 1 END) AS con_evento,
  count(CASE WHEN ot_id NOT IN (SELECT ot_id FROM ot_falla_evento WHERE ot_id IS NOT NULL) THEN 1 END) AS sin_evento,
  round(100.0 * CAST(count(CASE WHEN ot_id IN (SELECT ot_id FROM ot_falla_evento) THEN 1 END) AS DOUBLE) / count(*), 1) AS cobertura_pct
FROM ordenes_trabajo""")
def q7(spark, d):
    f = fleet(spark, d)
    return q.coverage(f.ordenes_trabajo, f.ot_falla_evento)


@register("Q8_confidence_bands", """
SELECT CASE WHEN confianza >= 0.8 THEN 'Muy alta (≥0.80)' WHEN confianza >= 0.6 THEN 'Alta (0.60-0.79)'
            WHEN confianza >= 0.4 THEN 'Media (0.40-0.59)' WHEN confianza >= 0.2 THEN 'Baja (0.20-0.39)'
            ELSE 'Muy baja (<0.20)' END AS rango_confianza,
  count(*) AS cantidad,
  round(100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ot_falla_evento), 1) AS porcentaje
FROM ot_falla_evento GROUP BY 1""")
def q8(spark, d):
    return q.confidence_bands(fleet(spark, d).ot_falla_evento)


@register("Q9_events_by_system", """
SELECT tf.sistema, count(*) AS cantidad,
  round(100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ot_falla_evento), 1) AS porcentaje,
  count(DISTINCT ofe.activo_id) AS activos_afectados,
  round(CAST(sum(CAST(ofe.confianza AS DECIMAL(12,2))) AS DOUBLE) / count(ofe.confianza), 2) AS confianza_promedio
FROM ot_falla_evento ofe LEFT JOIN taxonomia_fallas tf ON ofe.taxonomia_id = tf.taxonomia_id
GROUP BY tf.sistema""")
def q9(spark, d):
    f = fleet(spark, d)
    return q.by_system(f.ot_falla_evento, f.taxonomia_fallas)


@register("Q10_top_components", """
SELECT tf.sistema, tf.componente, count(*) AS cantidad,
  round(100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ot_falla_evento), 1) AS porcentaje
FROM ot_falla_evento ofe LEFT JOIN taxonomia_fallas tf ON ofe.taxonomia_id = tf.taxonomia_id
GROUP BY tf.sistema, tf.componente
ORDER BY cantidad DESC, tf.sistema NULLS LAST, tf.componente NULLS LAST LIMIT 10""")
def q10(spark, d):
    f = fleet(spark, d)
    return q.top_components(f.ot_falla_evento, f.taxonomia_fallas)


@register("Q10_events_by_source", """
SELECT fuente, count(*) AS cantidad,
  round(100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ot_falla_evento), 1) AS porcentaje
FROM ot_falla_evento GROUP BY fuente""")
def q10b(spark, d):
    return q.by_source(fleet(spark, d).ot_falla_evento)


@register("Q11_orphan_events", """
SELECT ofe.id_evento, ofe.ot_id, ofe.activo_id, ofe.taxonomia_id
FROM ot_falla_evento ofe WHERE NOT EXISTS (SELECT 1 FROM taxonomia_fallas tf WHERE tf.taxonomia_id = ofe.taxonomia_id)""")
def q11a(spark, d):
    f = fleet(spark, d)
    return q.orphan_events(f.ot_falla_evento, f.taxonomia_fallas)


@register("Q11_multi_event_orders", """
SELECT ot_id, count(*) AS cantidad_eventos FROM ot_falla_evento WHERE ot_id IS NOT NULL
GROUP BY ot_id HAVING count(*) > 1""")
def q11b(spark, d):
    return q.multi_event_orders(fleet(spark, d).ot_falla_evento)


@register("Q11_last_classified", """
SELECT e.id_evento, e.ot_id, e.activo_id, t.sistema, t.componente, m.modo, e.confianza, e.fuente, e.fecha_evento
FROM (SELECT * FROM ot_falla_evento ORDER BY fecha_evento DESC NULLS LAST, id_evento DESC LIMIT 5) e
LEFT JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id LEFT JOIN modo_falla m ON t.id_modo_falla = m.id_modo_falla""")
def q11c(spark, d):
    f = fleet(spark, d)
    return q.last_classified(f.ot_falla_evento, f.taxonomia_fallas, f.modo_falla)


TABLES = ("activos", "ordenes_trabajo", "ot_falla_evento", "repuestos_consumidos", "scoring_resultados", "feedback_taller")


@register("S12_S13_export_restore", "\nUNION ALL\n".join(f"SELECT '{t}' AS tabla, count(*) AS filas FROM {t}" for t in TABLES))
def s12(spark, d):
    """Writes the tables as CSV, restores them and counts what came back."""
    import uuid

    from ..session import scratch_path
    from ..sources import ingest as S

    f, base = fleet(spark, d), scratch_path(spark, f"export-{uuid.uuid4().hex}")
    S.export_tables({t: getattr(f, t) for t in TABLES}, base)
    back = S.restore_tables(spark, base, TABLES)
    return S.table_summary(back).select("tabla", "filas")


@register("S4_S5_reload", "\nUNION ALL\n".join(f"SELECT '{t}' AS tabla, count(*) AS filas FROM {t}" for t in TABLES[:4]))
def s5(spark, d):
    """Loads four tables in order with key checks, publishes them and reads the live version."""
    import uuid

    from ..session import scratch_path
    from ..sources import ingest as S

    f, base = fleet(spark, d), scratch_path(spark, f"reload-{uuid.uuid4().hex}")
    S.full_reload({t: getattr(f, t) for t in TABLES[:4]}, base)
    return S.table_summary({t: S.live(spark, base, t) for t in TABLES[:4]}).select("tabla", "filas")


@register("S7_replace_slices", """
SELECT fecha_scoring, count(*) AS filas FROM scoring_resultados GROUP BY fecha_scoring""")
def s7(spark, d):
    """All scores, then the even days again: slices are replaced, the others stay."""
    import uuid

    from ..session import scratch_path
    from ..sources import ingest as S

    sr, path = fleet(spark, d).scoring_resultados, scratch_path(spark, f"scores-{uuid.uuid4().hex}")
    S.write_scores(sr, path)
    S.write_scores(sr.filter(F.dayofmonth("fecha_scoring") % 2 == 0), path)
    back = spark.read.schema(sr.schema).parquet(path)
    return back.groupBy("fecha_scoring").agg(F.count(F.lit(1)).alias("filas"))


def _ge(t):
    k = str(t).replace(".", "")
    return (f"count(CASE WHEN probabilidad_falla >= {t} THEN 1 END) AS n_ge_{k}, "
            f"round(CAST(count(CASE WHEN probabilidad_falla >= {t} THEN 1 END) AS DOUBLE) / count(*) * 100.0, 6) AS pct_ge_{k}")


@register("Q13_score_profile", f"""
SELECT horizonte_dias, count(*) AS n, min(probabilidad_falla) AS p_min, round(avg(probabilidad_falla), 9) AS p_media,
  round(quantile_cont(probabilidad_falla, 0.5), 9) AS p_mediana, max(probabilidad_falla) AS p_max,
  round(stddev_pop(probabilidad_falla), 9) AS p_std, {_ge(0.3)}, {_ge(0.6)}, {_ge(0.8)}
FROM scoring_resultados GROUP BY horizonte_dias""")
def q13(spark, d):
    return q.score_profile(fleet(spark, d).scoring_resultados)


@register("Q14_cost_profile", """
SELECT count(*) AS total, count(costo_unitario_clp) AS con_costo,
  count(CASE WHEN costo_unitario_clp IS NULL THEN 1 END) AS sin_costo,
  count(CASE WHEN costo_unitario_clp > 0 THEN 1 END) AS con_costo_positivo
FROM repuestos_maestro""")
def q14(spark, d):
    return q.cost_profile(fleet(spark, d).repuestos_maestro)


@register("Q16_table_counts", """
SELECT 'activos' AS tabla, count(*) AS filas FROM activos
UNION ALL SELECT 'ordenes_trabajo', count(*) FROM ordenes_trabajo
UNION ALL SELECT 'ot_falla_evento', count(*) FROM ot_falla_evento
UNION ALL SELECT 'repuestos_consumidos', count(*) FROM repuestos_consumidos""")
def q16(spark, d):
    f = fleet(spark, d)
    return q.table_counts({"activos": f.activos, "ordenes_trabajo": f.ordenes_trabajo,
                           "ot_falla_evento": f.ot_falla_evento, "repuestos_consumidos": f.repuestos_consumidos})
