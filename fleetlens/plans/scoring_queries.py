"""F4-F6 and R*: scoring post-process queries and their DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from ..operators import features as P
from ..operators import model_store
from ..operators import scoring as R
from ..sources.fixtures import AS_OF, fleet
from .feature_queries import panel_sql
from .registry import register

DAY = dt.date(2000, 1, 30)
D = f"DATE '{DAY}'"

PRIO_T = """CASE WHEN {p} >= {t}.p1 THEN 'P1_critica' WHEN {p} >= {t}.p2 THEN 'P2_alta'
  WHEN {p} >= {t}.p3 THEN 'P3_media' ELSE 'P4_baja' END"""


def th_sql(version: str, as_of: str = f"DATE '{AS_OF}'") -> str:
    return f"""(SELECT coalesce(max(p1_critica), CAST(0.85 AS DOUBLE)) AS p1, coalesce(max(p2_alta), CAST(0.75 AS DOUBLE)) AS p2,
    coalesce(max(p3_media), CAST(0.5 AS DOUBLE)) AS p3
  FROM (SELECT * FROM umbrales_prioridad WHERE modelo_version = '{version}' AND activo = TRUE AND fecha_vigencia <= {as_of}
        QUALIFY row_number() OVER (ORDER BY fecha_vigencia DESC) = 1))"""


def risk_system_sql(date: str) -> str:
    return f"""(SELECT activo_id, sistema AS sistema_en_riesgo FROM (
  SELECT coalesce(e.activo_id, o.activo_id) AS activo_id,
    coalesce(e.fecha_evento, CAST(o.fecha_apertura AS DATE)) AS fecha_ef, t.sistema, e.id_evento, e.taxonomia_id
  FROM ot_falla_evento e JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
  LEFT JOIN ordenes_trabajo o ON e.ot_id = o.ot_id
  WHERE t.sistema IS NOT NULL AND trim(t.sistema) <> '') x
  WHERE activo_id IS NOT NULL AND fecha_ef IS NOT NULL AND fecha_ef <= {date}
  QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_ef DESC, id_evento DESC, taxonomia_id DESC) = 1)"""


def dominant_sql(date: str) -> str:
    return f"""(SELECT c.ot_id, c.activo_id, c.fecha_cierre,
    CASE WHEN bool_or(t IN ('predictiva', 'predictivo')) THEN 'predictiva'
         WHEN bool_or(t IN ('correctiva', 'correctivo', 'emergency')) THEN 'correctiva'
         WHEN bool_or(t IN ('preventiva', 'preventivo', 'mantenimiento', 'inspeccion', 'inspección')) THEN 'preventiva' END AS tipo_dominante
  FROM (SELECT ot_id, activo_id, CAST(fecha_cierre AS DATE) AS fecha_cierre FROM ordenes_trabajo
        WHERE fecha_cierre IS NOT NULL AND CAST(fecha_cierre AS DATE) <= {date} AND activo_id IS NOT NULL) c
  JOIN (SELECT ot_id, lower(trim(coalesce(tipo_mantenimiento, ''))) AS t FROM ot_falla_evento) e ON e.ot_id = c.ot_id
  GROUP BY c.ot_id, c.activo_id, c.fecha_cierre)"""


def last_sql(date: str) -> str:
    return f"""(SELECT * FROM {dominant_sql(date)} d WHERE tipo_dominante IN ('correctiva', 'predictiva')
  QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_cierre DESC,
    CASE tipo_dominante WHEN 'predictiva' THEN 1 WHEN 'correctiva' THEN 2 ELSE 9 END, ot_id DESC) = 1)"""


def decay_sql(scores: str, date: str, th: str) -> str:
    """Apply R4 to the relation ``scores`` (needs prioridad, probabilidad_falla, fecha_scoring)."""
    newp = "CASE WHEN _applies THEN probabilidad_falla * CASE _tipo WHEN 'predictiva' THEN 0.2 ELSE 0.3 END ELSE probabilidad_falla END"
    return f"""(SELECT * EXCLUDE (_newp, _fc, _tipo, _applies, p1, p2, p3, _days) REPLACE (
    {PRIO_T.format(p='_newp', t='z')} AS prioridad, _newp AS probabilidad_falla),
    prioridad AS prioridad_pre_decay, _applies AS ajuste_intervencion_reciente,
    CASE WHEN _applies THEN _tipo END AS tipo_mant_atenuacion,
    CASE WHEN _applies THEN _days END AS dias_desde_intervencion
  FROM (SELECT *, {newp} AS _newp FROM (
        SELECT s.*, li.fecha_cierre AS _fc, li.tipo_dominante AS _tipo, th.*,
          CAST(date_diff('day', li.fecha_cierre, s.fecha_scoring) AS INTEGER) AS _days,
          coalesce(s.prioridad IN ('P1_critica', 'P2_alta') AND li.fecha_cierre IS NOT NULL
            AND date_diff('day', li.fecha_cierre, s.fecha_scoring) BETWEEN 0 AND 30, FALSE) AS _applies
        FROM {scores} s LEFT JOIN {last_sql(date)} li ON s.activo_id = li.activo_id CROSS JOIN {th} th) y) z)"""


def coherence_sql(scores: str) -> str:
    return f"""(SELECT s.* REPLACE (
    CASE WHEN s.horizonte_dias = 30 AND h7.p7 > s.probabilidad_falla THEN h7.pr7 ELSE s.prioridad END AS prioridad,
    CASE WHEN s.horizonte_dias = 30 AND h7.p7 > s.probabilidad_falla THEN h7.s7 ELSE s.sistema_en_riesgo END AS sistema_en_riesgo,
    CASE WHEN s.horizonte_dias = 30 AND h7.p7 > s.probabilidad_falla THEN h7.p7 ELSE s.probabilidad_falla END AS probabilidad_falla)
  FROM {scores} s LEFT JOIN (SELECT activo_id, fecha_scoring, probabilidad_falla AS p7, prioridad AS pr7, sistema_en_riesgo AS s7
                             FROM {scores} WHERE horizonte_dias = 7) h7
    ON s.activo_id = h7.activo_id AND s.fecha_scoring = h7.fecha_scoring)"""


def F_(spark, d):
    return fleet(spark, d)


def _above_sql(version: str) -> str:
    return f"""SELECT th.p1, th.p2, th.p3, count(CASE WHEN probabilidad_falla >= th.p1 THEN 1 END) AS n1,
  count(CASE WHEN probabilidad_falla >= th.p2 THEN 1 END) AS n2, count(CASE WHEN probabilidad_falla >= th.p3 THEN 1 END) AS n3
FROM scoring_resultados CROSS JOIN {th_sql(version)} th GROUP BY ALL"""


def _above(spark, d, version):
    """A version's thresholds and the scores that reach each of them."""
    from pyspark.sql import functions as F
    f = F_(spark, d)
    s, th = R.with_thresholds(f.scoring_resultados, R.thresholds_for(f.umbrales_prioridad, version, AS_OF))
    return s.groupBy("p1", "p2", "p3").agg(*(F.count_if(F.col("probabilidad_falla") >= th[f"p{i}"]).alias(f"n{i}") for i in (1, 2, 3)))


@register("F5_thresholds_v1", _above_sql("v1.0"))
def f5(spark, d):
    return _above(spark, d, "v1.0")


@register("F5_thresholds_missing_version", _above_sql("v9.9"))
def f5b(spark, d):
    return _above(spark, d, "v9.9")


@register("F4_F6_rebucket_scores", f"""
SELECT s.scoring_id, {PRIO_T.format(p='s.probabilidad_falla', t='th')} AS prioridad_recalculada,
  CAST(s.probabilidad_falla >= 0.3488 AS INTEGER) AS prediccion_umbral
FROM scoring_resultados s CROSS JOIN {th_sql('v0.9')} th""")
def f4(spark, d):
    from pyspark.sql import functions as F
    from ..functions.columns import binary_prediction, priority
    f = F_(spark, d)
    s, th = R.with_thresholds(f.scoring_resultados, R.thresholds_for(f.umbrales_prioridad, "v0.9", AS_OF))
    return s.select("scoring_id", priority("probabilidad_falla", th).alias("prioridad_recalculada"),
                    binary_prediction("probabilidad_falla", 0.3488).alias("prediccion_umbral"))


@register("R1_risk_system", f"SELECT * FROM {risk_system_sql(D)}")
def r1(spark, d):
    f = F_(spark, d)
    return R.risk_system(f.ot_falla_evento, f.taxonomia_fallas, f.ordenes_trabajo, DAY)


@register("R2_dominant_type", f"SELECT * FROM {dominant_sql(D)}")
def r2(spark, d):
    f = F_(spark, d)
    return R.dominant_type(f.ordenes_trabajo, f.ot_falla_evento, DAY)


@register("R3_last_intervention", f"SELECT ot_id, activo_id, fecha_cierre, tipo_dominante FROM {last_sql(D)}")
def r3(spark, d):
    f = F_(spark, d)
    return R.last_intervention(f.ordenes_trabajo, f.ot_falla_evento, DAY)


@register("R4_post_intervention_decay", f"""
SELECT * FROM {decay_sql(f"(SELECT * FROM scoring_resultados WHERE fecha_scoring = {D})", D, th_sql('v1.0'))}""")
def r4(spark, d):
    from pyspark.sql import functions as F
    f = F_(spark, d)
    day = f.scoring_resultados.filter(F.col("fecha_scoring") == F.lit(DAY))
    th = R.thresholds_for(f.umbrales_prioridad, "v1.0", AS_OF)
    return R.apply_decay(day, R.last_intervention(f.ordenes_trabajo, f.ot_falla_evento, DAY), th)


@register("R5_horizon_coherence", f"SELECT * FROM {coherence_sql('scoring_resultados')}")
def r5(spark, d):
    return R.horizon_coherence(F_(spark, d).scoring_resultados)


def _r6_sql(formula="least(greatest(count_ot_90d, 0) * 0.125 + greatest(count_correctivas_90d, 0) * 0.1875 + horizonte_dias / 256.0, 1.0)",
            version="v1.0"):
    panel = f"({panel_sql(back=1, step=1)})"
    stand = f"(SELECT activo_id, horizonte_dias, {formula} AS probabilidad_falla FROM {panel} p)"
    base = f"""(SELECT p.activo_id, DATE '{AS_OF}' AS fecha_scoring, p.horizonte_dias, p.probabilidad_falla,
      CAST(p.probabilidad_falla >= 0.5 AS INTEGER) AS prediccion, {PRIO_T.format(p='p.probabilidad_falla', t='th')} AS prioridad,
      '{version}' AS modelo_version, coalesce(rs.sistema_en_riesgo, 'sin_historial_ot') AS sistema_en_riesgo
    FROM {stand} p CROSS JOIN {th_sql('v1.0')} th LEFT JOIN {risk_system_sql(f"DATE '{AS_OF}'")} rs ON p.activo_id = rs.activo_id)"""
    return coherence_sql(decay_sql(base, f"DATE '{AS_OF}'", th_sql("v1.0")))


def r6_frame(spark, d):
    f = F_(spark, d)
    panel = P.feature_panel(f.activos, f.ordenes_trabajo, AS_OF, back=1, step=1)
    th = R.thresholds_for(f.umbrales_prioridad, "v1.0", AS_OF)
    return R.score_day(panel, R.stand_in_probability, f.ot_falla_evento, f.taxonomia_fallas, f.ordenes_trabajo,
                       AS_OF, th, 0.5, "v1.0")


@register("R6_score_day", f"SELECT * FROM {_r6_sql()}")
def r6(spark, d):
    return r6_frame(spark, d)


@register("R6_score_day_saved_model", "SELECT * FROM " + _r6_sql(
    "least(1.0, (greatest(count_ot_90d, 0) * 0.125 + greatest(count_correctivas_30d, 0) * 0.25) / 4.0)", "reglas_v1.0"))
def r6_saved(spark, d):
    """A day's scores by the active model as the registry has it: pipeline, version and feature columns come from the store."""
    f = F_(spark, d)
    model = model_store.load(spark, f.model_base)
    panel = P.feature_panel(f.activos, f.ordenes_trabajo, AS_OF, back=1, step=1)
    predict = lambda p: model.predict(p).select("activo_id", "horizonte_dias", "probabilidad_falla")
    th = R.thresholds_for(f.umbrales_prioridad, "v1.0", AS_OF)
    return R.score_day(panel, predict, f.ot_falla_evento, f.taxonomia_fallas, f.ordenes_trabajo, AS_OF, th, 0.5, model.version)


@register("R6_score_summary", f"""
WITH s AS (SELECT * FROM {_r6_sql()}), t AS (SELECT horizonte_dias, count(*) AS tot FROM s GROUP BY 1)
SELECT s.horizonte_dias, s.prioridad, count(*) AS n, round(count(*) * 100.0 / any_value(t.tot), 6) AS pct
FROM s JOIN t ON s.horizonte_dias = t.horizonte_dias GROUP BY s.horizonte_dias, s.prioridad""")
def r6b(spark, d):
    return R.score_summary(r6_frame(spark, d))


@register("R7_score_day_simple", f"""
WITH p AS ({panel_sql(back=1, step=1)})
SELECT activo_id, DATE '{AS_OF}' AS fecha_scoring, horizonte_dias, prob AS probabilidad_falla,
  CASE WHEN prob >= 0.85 THEN 'P1_critica' WHEN prob >= 0.65 THEN 'P2_alta' WHEN prob >= 0.4 THEN 'P3_media' ELSE 'P4_baja' END AS prioridad,
  'v1.0' AS modelo_version
FROM (SELECT *, least(greatest(count_ot_90d, 0) * 0.125 + greatest(count_correctivas_90d, 0) * 0.1875 + horizonte_dias / 256.0, 1.0) AS prob FROM p)""")
def r7(spark, d):
    f = F_(spark, d)
    panel = P.feature_panel(f.activos, f.ordenes_trabajo, AS_OF, back=1, step=1)
    return R.score_day_simple(panel, R.stand_in_probability, AS_OF)
