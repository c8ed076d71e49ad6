"""A*: daily availability queries and their DuckDB oracles."""

from __future__ import annotations

import datetime as dt
import uuid

from ..operators import availability as av
from ..session import scratch_path
from ..sources.day_table import DayTable
from ..sources.fixtures import AS_OF, fleet
from .oracle_fixtures import availability_sql
from .registry import BODY, register

START = AS_OF - dt.timedelta(days=365)
S, E = f"DATE '{START}'", f"DATE '{AS_OF}'"

_SEV = """LEFT JOIN (SELECT ot_id, max(CASE WHEN lower(trim(severidad)) IN ('critica', 'crítica') THEN 3
    WHEN lower(trim(severidad)) = 'media' THEN 2 WHEN lower(trim(severidad)) = 'leve' THEN 1 ELSE 0 END) AS sev_rank
  FROM ot_falla_evento WHERE ot_id IS NOT NULL GROUP BY ot_id) sv ON ot.ot_id = sv.ot_id"""
PLANNED = "lower(trim(coalesce(ot.tipo_ot, ''))) IN ('preventiva', 'preventivo', 'mantenimiento')"


@register("A1_downtime_real", f"""
WITH o AS (SELECT ot.*, {PLANNED} AS planned FROM ordenes_trabajo ot
           WHERE fecha_cierre IS NOT NULL AND fecha_cierre > fecha_apertura
             AND greatest(CAST(fecha_apertura AS DATE), {S}) <= least(CAST(fecha_cierre AS DATE), {E})),
d AS (SELECT o.*, CAST(g AS DATE) AS fecha FROM o, generate_series(CAST(greatest(CAST(fecha_apertura AS DATE), {S}) AS TIMESTAMP),
        CAST(least(CAST(fecha_cierre AS DATE), {E}) AS TIMESTAMP), INTERVAL 1 DAY) t(g)),
h AS (SELECT activo_id, fecha, planned, least(greatest((epoch(least(fecha_cierre, CAST(fecha AS TIMESTAMP) + INTERVAL 1 DAY))
        - epoch(greatest(fecha_apertura, CAST(fecha AS TIMESTAMP)))) / 3600.0, 0.0), 24.0) AS h FROM d)
SELECT activo_id, fecha, CASE WHEN planned THEN h ELSE 0.0 END AS plan, CASE WHEN planned THEN 0.0 ELSE h END AS noplan,
  TRUE AS calculado FROM h WHERE h > 0""")
def a1(spark, d):
    f = fleet(spark, d)
    return av.downtime_real(f.ordenes_trabajo, START, AS_OF, f.ot_falla_evento)


@register("A2_downtime_fallback", f"""
WITH o AS (SELECT ot.*, {PLANNED} AS planned, sv.sev_rank FROM ordenes_trabajo ot {_SEV}
           WHERE NOT (fecha_cierre IS NOT NULL AND fecha_cierre > fecha_apertura)
             AND CAST(fecha_apertura AS DATE) BETWEEN {S} AND {E}),
f AS (SELECT *, CAST(CASE WHEN sev_rank = 3 THEN 24.0 WHEN sev_rank = 2 THEN 8.0 WHEN sev_rank = 1 THEN 4.0
                     WHEN planned THEN 4.0 ELSE 8.0 END AS DOUBLE) AS fb FROM o)
SELECT activo_id, CAST(fecha_apertura AS DATE) AS fecha, CASE WHEN planned THEN fb ELSE 0.0 END AS plan,
  CASE WHEN planned THEN 0.0 ELSE fb END AS noplan, FALSE AS calculado FROM f""")
def a2(spark, d):
    f = fleet(spark, d)
    return av.downtime_fallback(f.ordenes_trabajo, START, AS_OF, f.ot_falla_evento)


@register("A4_availability_full_365d", "SELECT * FROM disponibilidad_diaria")
def a4(spark, d):
    return fleet(spark, d).disponibilidad_diaria


INC_PREV_END = AS_OF - dt.timedelta(days=10)
INC_START = INC_PREV_END - dt.timedelta(days=1)

_TOUCHING = f"""(SELECT * FROM ordenes_trabajo WHERE CAST(fecha_apertura AS DATE) <= {E}
  AND (fecha_cierre IS NULL OR CAST(fecha_cierre AS DATE) >= DATE '{INC_START}'))"""


@register("A6_availability_incremental", f"""
WITH prev AS ({availability_sql(S, f"DATE '{INC_PREV_END}'")}),
touch_assets AS (SELECT DISTINCT activo_id FROM {_TOUCHING} t WHERE activo_id IS NOT NULL),
new AS ({availability_sql(f"DATE '{INC_START}'", E, orders=_TOUCHING, assets="touch_assets")})
SELECT * FROM prev p WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.activo_id = p.activo_id AND n.fecha = p.fecha)
UNION ALL SELECT * FROM new""")
def a6(spark, d):
    f = fleet(spark, d)
    prev = av.availability(f.ordenes_trabajo, f.ot_falla_evento, f.activos, START, INC_PREV_END)
    return av.availability_incremental(prev, f.ordenes_trabajo, f.ot_falla_evento, AS_OF)


def _kept_by_day(spark, d):
    f = fleet(spark, d)
    prev = av.availability(f.ordenes_trabajo, f.ot_falla_evento, f.activos, START, INC_PREV_END)
    table = DayTable(spark, scratch_path(spark, f"days-{uuid.uuid4().hex}"), prev.schema, ["activo_id", "fecha"])
    table.write_days(prev)
    return f, table


@register("A6_increment_of_day_table", BODY["A6_availability_incremental"])
def a6_table(spark, d):
    f, table = _kept_by_day(spark, d)
    av.availability_increment(table, f.ordenes_trabajo, f.ot_falla_evento, AS_OF)
    return table.read()


@register("A6_days_rewritten", f"""
SELECT CAST(g AS DATE) AS fecha, CAST(g AS DATE) >= DATE '{INC_START}' AS reescrito
FROM generate_series(CAST({S} AS TIMESTAMP), CAST({E} AS TIMESTAMP), INTERVAL 1 DAY) t(g)""")
def a6_days(spark, d):
    """Which days' files an increment wrote, from the manifests before and after it."""
    f, table = _kept_by_day(spark, d)
    before = table.manifest()
    av.availability_increment(table, f.ordenes_trabajo, f.ot_falla_evento, AS_OF)
    return spark.createDataFrame([(day, before.get(day) != folder) for day, folder in table.manifest().items()], "fecha date, reescrito boolean")


@register("A7_availability_summary", """
SELECT round(avg(horas_operativas / 24.0 * 100.0), 6) AS disp_pct, count(DISTINCT activo_id) AS activos,
  count(DISTINCT fecha) AS dias, count(*) AS filas,
  count(CASE WHEN fuente = 'calculado' THEN 1 END) AS filas_calculado,
  count(CASE WHEN fuente = 'inferido' THEN 1 END) AS filas_inferido
FROM disponibilidad_diaria""")
def a7(spark, d):
    return av.availability_summary(fleet(spark, d).disponibilidad_diaria)
