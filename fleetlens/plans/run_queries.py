"""The full KPI panel run, the metric store and drift; oracles are composed from the
per-metric oracles so every panel value is checked the same way as its stand-alone query."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from ..operators import metrics as met
from ..operators import panels as k
from ..sources.fixtures import AS_OF, fleet
from . import ml_queries  # noqa: F401  (M7's oracle must be registered before K39 composes it)
from . import panel_queries as pq
from . import parts_queries as partsq  # noqa: F401  (K30 oracle must be registered before K39 composes it)
from .oracle_fixtures import with_views
from .registry import BODY, ORACLE, register

V1, V2, V3, VH = met.STATUS, met.ACTION, met.IMPACT, met.HEAT
PREV_AS_OF = AS_OF - dt.timedelta(days=7)


def _row(vista, metrica, name, col="valor", horizon="NULL", where=""):
    body = BODY[name]
    return (f"SELECT '{vista}' AS vista, '{metrica}' AS metrica, CAST({horizon} AS INTEGER) AS horizonte_dias, "
            f"CAST({col} AS DOUBLE) AS valor, CAST(NULL AS VARCHAR) AS nota FROM ({body}) x {where}")


def run_panels_sql() -> list[str]:
    return [
        _row(V1, "Unidades operativas", "K1_units_operating"),
        _row(V1, "Disponibilidad", "K2_availability_weighted_30d"),
        _row(V1, "P1 Crítica", "K4_priority_counts", horizon="horizonte_dias", where="WHERE prioridad = 'P1_critica'"),
        _row(V1, "P2 Alta", "K4_priority_counts", horizon="horizonte_dias", where="WHERE prioridad = 'P2_alta'"),
        _row(V1, "Fallas anticipadas", "K5_anticipated_failures_30d"),
        _row(V1, "MTBF", "K6_mtbf_availability_90d"),
        f"SELECT '{VH}', sistema, CAST(horizonte AS INTEGER), CAST(n AS DOUBLE), CAST(NULL AS VARCHAR) FROM ({BODY['K14_system_heatmap']}) x",
        f"SELECT '{V2}', 'Intervenciones próximas ' || CAST(horizonte_dias AS VARCHAR) || 'd', CAST(horizonte_dias AS INTEGER), "
        f"CAST(valor AS DOUBLE), CAST(NULL AS VARCHAR) FROM ({BODY['K16_upcoming_interventions']}) x",
        _row(V2, "SKU en quiebre", "K20_skus_below_minimum"),
        _row(V2, "Backlog OT", "K17_backlog", col="ot_abiertas"),
        _row(V2, "Cumplimiento PM", "K18_pm_compliance", col="cumplimiento_pm_pct"),
        _row(V3, "Costo evitado", "K21_avoided_cost"),
        _row(V3, "Downtime evitado", "K22_avoided_downtime"),
        _row(V3, "Costo mantenimiento km", "K23_cost_per_km_30d"),
        _row(V3, "Costo mantenimiento unidad", "K24_cost_per_unit_30d"),
        _row(V3, "Disponibilidad 30d", "K3_availability_mean_ratio_30d"),
        _row(V3, "MTBF 90d", "K7_repair_hours_per_failure_90d"),
        _row(V3, "MTTR 90d", "K8_mttr_90d"),
        _row(V3, "Tasa alertas confirmadas", "K26_feedback_counts", col="pct_confirmadas"),
        _row(V3, "P1 confirmadas", "K25_confirmed_p1_p2_assets", col="activos_p1_confirmados"),
        _row(V3, "P2 confirmadas", "K25_confirmed_p1_p2_assets", col="activos_p2_confirmados"),
        _row(V3, "Recall", "M7_precision_recall_f1", col="recall * 100", where="WHERE horizonte_dias = 30"),
        _row(V3, "Precision", "M7_precision_recall_f1", col="precision * 100", where="WHERE horizonte_dias = 30"),
        _row(V3, "Anticipacion promedio", "K29_mean_anticipation_days"),
        _row(V3, "% Alertas confirmadas", "K26_feedback_counts", col="pct_confirmadas"),
        _row(V3, "% Alertas rechazadas", "K26_feedback_counts", col="pct_rechazadas"),
        _row(V3, "% Alertas pendientes", "K26_feedback_counts", col="pct_pendientes"),
        _row(V3, "Alertas confirmadas (count)", "K26_feedback_counts", col="confirmadas"),
        _row(V3, "Alertas rechazadas (count)", "K26_feedback_counts", col="rechazadas"),
        _row(V3, "Alertas pendientes (count)", "K26_feedback_counts", col="pendientes"),
        _row(V3, "Matriz TP", "K27_confusion_matrix", col="tp"),
        _row(V3, "Matriz FP", "K27_confusion_matrix", col="fp"),
        _row(V3, "Matriz FN", "K27_confusion_matrix", col="fn"),
        _row(V3, "Matriz TN", "K27_confusion_matrix", col="tn"),
        _row(V3, "Cobertura stock", "K30_stock_coverage"),
    ]


def shifted(sql: str, days: int) -> str:
    """A run's SQL as of ``days`` earlier: its metrics name dates only as literals."""
    def back(m: re.Match) -> str:
        return f"{m[1]} '{dt.date.fromisoformat(m[2]) - dt.timedelta(days=days)}"

    return re.sub(r"\b(DATE|TIMESTAMP) '(\d{4}-\d\d-\d\d)", back, sql)


def _runs_sql() -> str:
    """Views ahora and antes: the run and that of a week ago. Models are evaluated as of their training, not of the run."""
    parts = run_panels_sql()
    before = [p if "'Recall' AS metrica" in p or "'Precision' AS metrica" in p else shifted(p, 7) for p in parts]
    return f"""WITH ahora AS ({' UNION ALL '.join(parts)}), antes AS ({' UNION ALL '.join(before)})"""


@register("K39_run_panels", _runs_sql() + """
SELECT a.vista, a.metrica, a.horizonte_dias, a.valor, b.valor AS valor_anterior, a.nota FROM ahora a
LEFT JOIN antes b ON a.vista = b.vista AND a.metrica = b.metrica AND a.horizonte_dias IS NOT DISTINCT FROM b.horizonte_dias""")
def k39(spark, d):
    f = fleet(spark, d)
    return met.run(spark, f.panel_inputs(), AS_OF, met.current(f.paneles))


@register("K38_metric_store", _runs_sql() + """
SELECT coalesce(a.vista, b.vista) AS vista, coalesce(a.metrica, b.metrica) AS metrica, coalesce(a.horizonte_dias, b.horizonte_dias) AS horizonte_dias,
  CASE WHEN a.vista IS NULL THEN b.valor ELSE a.valor END AS valor, CASE WHEN a.vista IS NOT NULL THEN b.valor END AS valor_anterior,
  CAST(NULL AS VARCHAR) AS nota
FROM ahora a FULL JOIN antes b ON a.vista = b.vista AND a.metrica = b.metrica AND a.horizonte_dias IS NOT DISTINCT FROM b.horizonte_dias""")
def k38(spark, d):
    f = fleet(spark, d)
    return met.current(met.merge(f.paneles, met.run(spark, f.panel_inputs(), AS_OF), AS_OF))


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@register("K38_metric_history", _runs_sql() + f""",
todo AS (SELECT *, DATE '{PREV_AS_OF}' AS dia FROM antes UNION ALL SELECT *, DATE '{AS_OF}' FROM ahora)
SELECT vista, metrica, horizonte_dias, valor, lag(valor) OVER w AS valor_anterior, nota,
  CASE WHEN metrica IN ({_quoted(met.INVERSE)}) THEN 'inverse' WHEN metrica IN ({_quoted(met.POSITIVE)}) THEN 'positive' ELSE 'neutral' END AS delta_color,
  dia AS desde, lead(dia) OVER w AS hasta
FROM todo WINDOW w AS (PARTITION BY vista, metrica, horizonte_dias ORDER BY dia)""")
def k38h(spark, d):
    f = fleet(spark, d)
    return met.merge(f.paneles, met.run(spark, f.panel_inputs(), AS_OF), AS_OF)


_NOTED = ("Disponibilidad", "MTBF", "Disponibilidad 30d", "Cobertura stock", "Costo mantenimiento km", "Costo mantenimiento unidad", "Costo evitado")


@register("S18_run_with_missing_inputs", _runs_sql() + f"""
SELECT vista, metrica, horizonte_dias, CASE WHEN metrica IN ({_quoted(_NOTED)}) THEN NULL ELSE valor END AS valor, CAST(NULL AS DOUBLE) AS valor_anterior,
  CASE WHEN metrica IN ({_quoted(_NOTED)}) THEN 'Tabla faltante' END AS nota
FROM ahora""")
def s18(spark, d):
    """The run on a catalogue that lacks two tables and the cost column of the orders."""
    f = fleet(spark, d)
    prefix = f"fleet_{uuid.uuid4().hex}_"
    for name, df in f.panel_inputs().items():
        if name not in ("disponibilidad_diaria", "repuestos_panel_criticos"):
            (df.drop("costo_total_clp") if name == "ordenes_trabajo" else df).createOrReplaceTempView(prefix + name)
    return met.run(spark, met.resolve(spark, prefix=prefix), AS_OF)


@register("K40_drift", """
WITH s AS (SELECT horizonte_dias, CAST(least(floor(probabilidad_falla * 10), 9) AS INTEGER) AS bin,
             fecha_scoring >= DATE '2000-01-17' AS recent FROM scoring_resultados WHERE fecha_scoring >= DATE '2000-01-03'),
h AS (SELECT horizonte_dias, bin, count(CASE WHEN recent THEN 1 END) AS n_p, count(*) AS n_q FROM s GROUP BY 1, 2),
t AS (SELECT horizonte_dias, sum(n_p) AS t_p, sum(n_q) AS t_q FROM h GROUP BY 1),
kl AS (SELECT h.horizonte_dias, sum((n_p / t_p) * ln((n_p / t_p) / (n_q / t_q))) AS kl FROM h JOIN t USING (horizonte_dias)
       WHERE n_p > 0 GROUP BY 1)
SELECT horizonte_dias, round(kl, 9) AS drift_score, CASE WHEN kl > 0.1 THEN 'Drift detectado' ELSE 'Estable' END AS estado_modelo
FROM kl""")
def k40(spark, d):
    return k.drift(fleet(spark, d).scoring_resultados, AS_OF)


__all__ = ["with_views", "pq"]
