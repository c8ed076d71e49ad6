"""DuckDB twins of ``sources/fixtures.py`` as named CTEs.

Each oracle query is written against the fleet views; ``with_views`` prefixes
it with exactly the CTEs it needs (transitively), in dependency order.
Arithmetic mirrors the Spark side rule for rule.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2000-01-31'"
AS_OF_TS = "TIMESTAMP '2000-01-31 00:00:00'"

# name -> SQL body; order matters (a view may use the ones above it).
VIEWS: dict[str, str] = {}

VIEWS["activos"] = """
SELECT CAST(c_custkey AS VARCHAR) AS activo_id, c_name AS patente, c_mktsegment AS marca,
  n_name AS modelo, CAST(1985 + c_custkey % 15 AS INTEGER) AS anio_fabricacion,
  DATE '1990-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS fecha_alta_flota,
  r_name AS tipo_vehiculo,
  CASE WHEN c_custkey % 3 = 0 THEN 'combustion' WHEN c_custkey % 3 = 1 THEN 'hibrido' ELSE 'electrico' END AS motor_tipo,
  CASE WHEN c_custkey % 17 = 0 THEN 'baja' WHEN c_custkey % 19 = 0 THEN 'fuera_servicio'
       WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'operativo' ELSE 'Activo' END AS estado_actual,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 997 AS DOUBLE) * 250.0 END AS odometro_km,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 500 AS DOUBLE) * 10.0 END AS horometro_h
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

VIEWS["taxonomia_fallas"] = """
SELECT DISTINCT lower(p_type) || ':' || p_brand AS taxonomia_id, lower(p_type) AS sistema,
  p_brand AS componente, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 10 + 1 AS id_modo_falla,
  lower(p_type) || ' ' || lower(p_brand) AS descripcion_estandar, TRUE AS activo
FROM part
"""

VIEWS["mapeo_sistemas"] = """
SELECT DISTINCT lower(p_type) AS sistema_fallas, lower(p_type) AS sistema_repuestos FROM part
"""

VIEWS["mapeo_sistemas_prefijo"] = """
SELECT sistema_fallas, 'rep_' || sistema_repuestos AS sistema_repuestos FROM mapeo_sistemas
"""

VIEWS["repuestos_maestro"] = """
SELECT printf('REP-%04d', p_partkey) AS sku, p_name AS descripcion, lower(p_type) AS sistema,
  p_brand AS componente,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 30 + 1 AS DOUBLE) END AS lead_time_dias_promedio,
  p_retailprice AS costo_unitario_clp, CAST(p_size AS DOUBLE) AS stock_actual,
  CAST(p_partkey % 20 AS DOUBLE) AS stock_minimo,
  CASE WHEN p_partkey % 3 = 0 THEN 'alta' WHEN p_partkey % 3 = 1 THEN 'media' ELSE 'baja' END AS criticidad,
  TRUE AS activo
FROM part
"""

VIEWS["ot_base"] = f"""
SELECT o_orderkey AS okey, CAST(o_orderkey AS VARCHAR) AS ot_id, CAST(o_custkey AS VARCHAR) AS activo_id,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS fecha_apertura,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_hours(CAST(o_orderkey % 97 AS INTEGER)) AS cierre0,
  o_orderstatus,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'Correctiva'
       WHEN '3-MEDIUM' THEN 'preventiva' WHEN '5-LOW' THEN 'predictiva' END AS tipo_ot,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE 100.0 * CAST(year(o_orderdate) - 1995 AS DOUBLE) + CAST(o_orderkey % 50 AS DOUBLE) END AS odometro_km,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL
       ELSE 10.0 * CAST(year(o_orderdate) - 1995 AS DOUBLE) + CAST(o_orderkey % 20 AS DOUBLE) END AS horometro_h,
  'T' || CAST(o_orderkey % 5 AS VARCHAR) AS taller_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS costo_total_clp
FROM orders WHERE o_orderdate < {AS_OF_TS}
"""

VIEWS["ot_keyed"] = f"""
SELECT okey, ot_id, activo_id, fecha_apertura,
  CASE WHEN o_orderstatus = 'O' THEN NULL WHEN cierre0 > {AS_OF_TS} THEN NULL ELSE cierre0 END AS fecha_cierre,
  tipo_ot, odometro_km, horometro_h, taller_id, costo_total_clp
FROM ot_base
"""

VIEWS["ordenes_trabajo"] = """
SELECT ot_id, activo_id, fecha_apertura, fecha_cierre, tipo_ot, odometro_km, horometro_h, taller_id, costo_total_clp
FROM ot_keyed
"""

VIEWS["lines"] = """
SELECT l.*, o.activo_id, o.fecha_apertura FROM lineitem l JOIN ot_keyed o ON l.l_orderkey = o.okey
"""

VIEWS["ot_falla_evento"] = """
SELECT l_orderkey * 10 + l_linenumber AS id_evento, CAST(l_orderkey AS VARCHAR) AS ot_id,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE activo_id END AS activo_id,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(fecha_apertura AS DATE) + (l_linenumber - 1) END AS fecha_evento,
  lower(p_type) || ':' || p_brand AS taxonomia_id,
  CASE WHEN l_partkey % 4 = 0 THEN 'manual' ELSE 'automático' END AS fuente,
  CASE WHEN l_orderkey % 10 = 3 THEN NULL ELSE CAST(l_partkey % 100 AS DOUBLE) / 100.0 END AS confianza,
  CASE l_returnflag WHEN 'A' THEN 'critica' WHEN 'R' THEN 'media' WHEN 'N' THEN 'leve' END AS severidad,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'correctivo' WHEN l_linestatus = 'F' THEN 'preventivo'
       WHEN l_linenumber = 1 THEN 'predictivo' ELSE 'inspeccion' END AS tipo_mantenimiento,
  l_linenumber = 1 AS es_causa_raiz
FROM lines JOIN part ON l_partkey = p_partkey
"""

VIEWS["repuestos_consumidos"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS ot_id,
  l_orderkey * 10 + l_linenumber AS id_evento,
  printf('REP-%04d', l_partkey) AS sku, l_quantity AS cantidad,
  l_extendedprice / l_quantity AS costo_unitario_clp,
  l_returnflag = 'R' AS fue_compra_urgencia, l_shipdate AS created_at
FROM lines
"""

VIEWS["system_by_index"] = """
SELECT row_number() OVER (ORDER BY sistema) - 1 AS sys_idx, sistema
FROM (SELECT DISTINCT lower(p_type) AS sistema FROM part)
"""

VIEWS["scores_all"] = """
SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS activo_id,
  CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) - 8766
       ELSE DATE '2000-01-30' - CAST(event_id % 365 AS INTEGER) END AS fecha_scoring,
  CASE (event_id // 2) % 3 WHEN 0 THEN 7 WHEN 1 THEN 30 ELSE 90 END AS horizonte_dias,
  least(value / 120.0, 1.0) AS probabilidad_falla,
  event_id % 6 AS sys_idx
FROM events
"""

VIEWS["scores"] = """
SELECT s.event_id, s.event_type, s.activo_id, s.fecha_scoring, s.horizonte_dias, s.probabilidad_falla, x.sistema
FROM (SELECT * FROM scores_all
      QUALIFY row_number() OVER (PARTITION BY activo_id, fecha_scoring, horizonte_dias ORDER BY event_id DESC) = 1) s
LEFT JOIN system_by_index x ON s.sys_idx = x.sys_idx
"""

PRIO = """CASE WHEN {p} >= 0.85 THEN 'P1_critica' WHEN {p} >= 0.75 THEN 'P2_alta'
       WHEN {p} >= 0.5 THEN 'P3_media' ELSE 'P4_baja' END"""

VIEWS["scoring_resultados"] = f"""
SELECT CAST(event_id AS VARCHAR) AS scoring_id, activo_id, fecha_scoring, horizonte_dias, probabilidad_falla,
  CAST(probabilidad_falla >= 0.5 AS INTEGER) AS prediccion,
  {PRIO.format(p='probabilidad_falla')} AS prioridad,
  'v1.0' AS modelo_version, sistema AS sistema_en_riesgo
FROM scores
"""

VIEWS["last_ot"] = """
SELECT activo_id, ot_id FROM ordenes_trabajo
QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_apertura DESC, ot_id DESC) = 1
"""

VIEWS["feedback_taller"] = f"""
SELECT 'FB' || CAST(event_id AS VARCHAR) AS feedback_id, CAST(event_id AS VARCHAR) AS scoring_id,
  s.activo_id, lo.ot_id, fecha_scoring AS fecha_alerta,
  {PRIO.format(p='probabilidad_falla')} AS prioridad_modelo,
  CASE WHEN event_type = 'purchase' THEN 'reemplazo' END AS accion_realizada,
  CASE event_type WHEN 'purchase' THEN 'confirmada' WHEN 'signup' THEN 'parcial' WHEN 'error' THEN 'rechazada'
       WHEN 'click' THEN '' END AS resultado_revision,
  CASE WHEN event_type IN ('purchase', 'signup') THEN TRUE WHEN event_type = 'error' THEN FALSE END AS falla_confirmada,
  event_type = 'error' AS falsa_alarma,
  CASE WHEN event_type = 'error' THEN 'motivo ' || CAST(event_id % 7 AS VARCHAR) END AS comentario_mecanico,
  CAST(fecha_scoring AS TIMESTAMP) + to_hours(CAST(event_id % 72 AS INTEGER)) AS created_at
FROM scores s LEFT JOIN last_ot lo ON s.activo_id = lo.activo_id
"""

VIEWS["alertas"] = f"""
SELECT 'AL' || CAST(event_id AS VARCHAR) AS alerta_id, CAST(event_id AS VARCHAR) AS scoring_id, activo_id,
  CAST(fecha_scoring AS TIMESTAMP) AS fecha_alerta, {PRIO.format(p='probabilidad_falla')} AS prioridad,
  event_id % 3 = 0 AS leida, event_id % 2 = 0 AS resuelta
FROM scores WHERE probabilidad_falla >= 0.75
"""

VIEWS["umbrales_prioridad"] = """
SELECT modelo_version, CAST(p1_critica AS DOUBLE) AS p1_critica, CAST(p2_alta AS DOUBLE) AS p2_alta,
  CAST(p3_media AS DOUBLE) AS p3_media, activo, fecha_vigencia
FROM (VALUES ('v1.0', 0.85, 0.75, 0.50, TRUE, DATE '2000-01-01'),
             ('v1.0', 0.90, 0.80, 0.60, FALSE, DATE '2000-01-15'),
             ('v0.9', 0.80, 0.60, 0.30, TRUE, DATE '1999-06-01'))
  AS t(modelo_version, p1_critica, p2_alta, p3_media, activo, fecha_vigencia)
"""


VIEWS["modo_falla"] = """
SELECT * FROM (VALUES (1, 'modo_en_1', 'the,of,and'), (2, 'modo_es_1', 'de,la,que'), (3, 'modo_de_1', 'der,die,und'),
  (4, 'modo_fr_1', 'le,les,des'), (5, 'modo_es_2', 'el,los,por'), (6, 'modo_en_2', 'to,in,is,that'),
  (7, 'modo_es_3', 'en,y,del'), (8, 'modo_de_2', 'zu,den,von,mit'), (9, 'modo_compuesto', 'palabra compuesta,xylophone'),
  (10, 'modo_sin_claves', '')) AS t(id_modo_falla, modo, palabras_claves)
"""

VIEWS["descripciones"] = """
SELECT CAST(doc_id AS VARCHAR) AS ot_id, text AS descripcion_falla, lang FROM documents
"""


VIEWS["equivalencia_nomenclatura"] = """
SELECT p_partkey AS id, upper(p_type) AS sistema_ot, p_brand AS componente_ot, 'modo ' || CAST(p_size % 5 AS VARCHAR) AS modo_falla_ot,
  CAST(p_size AS BIGINT) AS frecuencia,
  CASE WHEN p_partkey % 10 = 0 THEN lower(p_type) || '_alt' ELSE lower(p_type) END AS sistema_catalogo,
  p_brand AS componente_catalogo, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 10 + 1 AS id_modo_falla,
  'modo_' || CAST(CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 10 + 1 AS VARCHAR) AS modo_catalogo,
  'correctivo' AS tipo_mantenimiento,
  CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE lower(p_type) || ':' || p_brand END AS taxonomia_id
FROM part
"""

VIEWS["ordenes_nuevas"] = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS ot_id, CAST(o_custkey AS VARCHAR) AS activo_id,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS fecha_apertura,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_hours(CAST(o_orderkey % 53 AS INTEGER)) AS fecha_cierre,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'Correctiva'
       WHEN '3-MEDIUM' THEN 'preventiva' WHEN '5-LOW' THEN 'predictiva' END AS tipo_ot,
  o_totalprice AS costo_total_clp
FROM orders WHERE o_orderdate >= TIMESTAMP '1999-12-02 00:00:00'
"""


def availability_sql(start: str, end: str, orders: str = "ordenes_trabajo", assets: str = "activos") -> str:
    """A1-A4 in DuckDB: the asset x day matrix over [start, end]."""
    return f"""
WITH o AS (
  SELECT ot.ot_id, ot.activo_id, ot.fecha_apertura, ot.fecha_cierre,
    lower(trim(coalesce(ot.tipo_ot, ''))) IN ('preventiva', 'preventivo', 'mantenimiento') AS planned,
    sv.sev_rank
  FROM {orders} ot
  LEFT JOIN (SELECT ot_id, max(CASE WHEN lower(trim(severidad)) IN ('critica', 'crítica') THEN 3
                                    WHEN lower(trim(severidad)) = 'media' THEN 2
                                    WHEN lower(trim(severidad)) = 'leve' THEN 1 ELSE 0 END) AS sev_rank
             FROM ot_falla_evento WHERE ot_id IS NOT NULL GROUP BY ot_id) sv ON ot.ot_id = sv.ot_id
  WHERE ot.fecha_apertura IS NOT NULL),
real_days AS (
  SELECT activo_id, planned, fecha_apertura, fecha_cierre, CAST(d AS DATE) AS fecha
  FROM o, generate_series(CAST(greatest(CAST(fecha_apertura AS DATE), {start}) AS TIMESTAMP),
                          CAST(least(CAST(fecha_cierre AS DATE), {end}) AS TIMESTAMP), INTERVAL 1 DAY) g(d)
  WHERE fecha_cierre IS NOT NULL AND fecha_cierre > fecha_apertura
    AND greatest(CAST(fecha_apertura AS DATE), {start}) <= least(CAST(fecha_cierre AS DATE), {end})),
real_h AS (
  SELECT activo_id, fecha, planned,
    least(greatest((epoch(least(fecha_cierre, CAST(fecha AS TIMESTAMP) + INTERVAL 1 DAY))
                    - epoch(greatest(fecha_apertura, CAST(fecha AS TIMESTAMP)))) / 3600.0, 0.0), 24.0) AS h
  FROM real_days),
down AS (
  SELECT activo_id, fecha, CASE WHEN planned THEN h ELSE 0.0 END AS plan,
    CASE WHEN planned THEN 0.0 ELSE h END AS noplan, TRUE AS calculado
  FROM real_h WHERE h > 0
  UNION ALL
  SELECT activo_id, CAST(fecha_apertura AS DATE) AS fecha,
    CASE WHEN planned THEN fb ELSE 0.0 END, CASE WHEN planned THEN 0.0 ELSE fb END, FALSE
  FROM (SELECT *, CASE WHEN sev_rank = 3 THEN 24.0 WHEN sev_rank = 2 THEN 8.0 WHEN sev_rank = 1 THEN 4.0
                       WHEN planned THEN 4.0 ELSE 8.0 END AS fb
        FROM o WHERE NOT (fecha_cierre IS NOT NULL AND fecha_cierre > fecha_apertura)) f
  WHERE CAST(fecha_apertura AS DATE) BETWEEN {start} AND {end}),
spine AS (
  SELECT activo_id, CAST(d AS DATE) AS fecha
  FROM {assets}, generate_series(CAST({start} AS TIMESTAMP), CAST({end} AS TIMESTAMP), INTERVAL 1 DAY) g(d)),
agg AS (
  SELECT s.activo_id, s.fecha, coalesce(sum(d.plan), 0.0) AS plan, coalesce(sum(d.noplan), 0.0) AS noplan,
    bool_or(d.calculado) AS calc
  FROM spine s LEFT JOIN down d ON s.activo_id = d.activo_id AND s.fecha = d.fecha
  GROUP BY s.activo_id, s.fecha),
m AS (SELECT activo_id, fecha, least(plan, 24.0) AS p, calc, noplan FROM agg),
m2 AS (SELECT activo_id, fecha, p, least(noplan, 24.0 - p) AS np, calc FROM m)
SELECT activo_id, fecha,
  round_even(greatest(0.0, 24.0 - (p + np)), 2) AS horas_operativas,
  round_even(p, 2) AS horas_detenido_planificado,
  round_even(np, 2) AS horas_detenido_no_planificado,
  CASE WHEN calc = FALSE THEN 'inferido' ELSE 'calculado' END AS fuente
FROM m2
"""


VIEWS["disponibilidad_diaria"] = "SELECT * FROM (" + availability_sql(
    f"({AS_OF} - 365)", AS_OF
) + ")"


def _deps(sql: str) -> list[str]:
    names = list(VIEWS)
    found = set()
    stack = [sql]
    while stack:
        s = stack.pop()
        for n in names:
            if n not in found and re.search(rf"\b{n}\b", s):
                found.add(n)
                stack.append(VIEWS[n])
    return [n for n in names if n in found]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fleet-view CTEs it references."""
    deps = _deps(sql)
    if not deps:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in deps)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
