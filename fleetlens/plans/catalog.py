"""Query catalog: name -> (spark callable, DuckDB oracle SQL or None).

Names follow ``<survey id>_<name>``. Each callable takes (spark, sf_dir),
derives the fleet views from the driver's tables and returns a DataFrame.
"""

from __future__ import annotations

from ..operators import panels
from ..sources.fixtures import AS_OF, fleet
from .registry import ORACLE, QUERIES, register

from . import (  # noqa: E402,F401  (each module registers its queries on import)
    availability_queries,
    classify_queries,
    dossier_queries,
    feature_queries,
    helper_queries,
    ingest_queries,
    ml_queries,
    panel_queries,
    parts_queries,
    quality_queries,
    scoring_queries,
)
from . import run_queries, stream_queries  # noqa: E402,F401  (composes the oracles registered above)


# ---------------------------------------------------------------- K13
@register("K13_risk_ranking", """
WITH us AS (
  SELECT * FROM scoring_resultados WHERE horizonte_dias = 30
  QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_scoring DESC, scoring_id DESC) = 1),
uo AS (
  SELECT * FROM ordenes_trabajo
  QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_apertura DESC, ot_id DESC) = 1),
sis AS (
  SELECT e.activo_id, t.sistema FROM ot_falla_evento e JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
  WHERE e.activo_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY e.activo_id ORDER BY e.fecha_evento DESC NULLS LAST, e.id_evento DESC, e.taxonomia_id DESC) = 1),
j AS (
  SELECT a.activo_id, a.patente, a.marca, a.modelo, us.prioridad, us.probabilidad_falla, us.fecha_scoring,
    sis.sistema AS sistema_riesgo, CAST(DATE '2000-01-31' - CAST(uo.fecha_apertura AS DATE) AS INTEGER) AS dias_ultima_ot,
    COALESCE(a.odometro_km, uo.odometro_km, 0.0) AS km_actual
  FROM activos a JOIN us ON us.activo_id = a.activo_id
  LEFT JOIN uo ON uo.activo_id = a.activo_id LEFT JOIN sis ON sis.activo_id = a.activo_id)
SELECT *, CAST(row_number() OVER (ORDER BY probabilidad_falla DESC NULLS LAST, activo_id) AS INTEGER) AS orden, 30 AS horizonte_dias
FROM j ORDER BY probabilidad_falla DESC NULLS LAST, activo_id LIMIT 15
""")
def k13_risk_ranking(spark, d):
    f = fleet(spark, d)
    return panels.risk_ranking(f.activos, f.scoring_resultados, f.ordenes_trabajo, f.ot_falla_evento,
                               f.taxonomia_fallas, AS_OF, horizon=30, n=15)
