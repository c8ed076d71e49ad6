"""S* / J21: ingest transformations with DuckDB oracles (writers are exercised in tests)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ml, quality
from ..session import scratch_path
from ..sources import ingest as S
from ..sources.fixtures import fleet
from . import feature_queries  # noqa: F401  (P6 must be registered before F23 composes it)
from .registry import BODY, QUERIES, register


def F_(spark, d):
    return fleet(spark, d)


@register("S6_upsert_orders", """
SELECT coalesce(b.ot_id, n.ot_id) AS ot_id, coalesce(b.activo_id, n.activo_id) AS activo_id,
  coalesce(b.fecha_apertura, n.fecha_apertura) AS fecha_apertura, coalesce(n.fecha_cierre, b.fecha_cierre) AS fecha_cierre,
  coalesce(b.tipo_ot, n.tipo_ot) AS tipo_ot, b.odometro_km, b.horometro_h, b.taller_id,
  coalesce(n.costo_total_clp, b.costo_total_clp) AS costo_total_clp
FROM ordenes_trabajo b FULL OUTER JOIN ordenes_nuevas n ON b.ot_id = n.ot_id""")
def s6(spark, d):
    f = F_(spark, d)
    return S.upsert(f.ordenes_trabajo, f.ordenes_nuevas, "ot_id", ["fecha_cierre", "costo_total_clp"])


LATEST = """(SELECT ot_id FROM ordenes_trabajo
  QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_apertura DESC, ot_id DESC) = 1)"""


@register("S15_delete_latest_order_orders", f"SELECT * FROM ordenes_trabajo WHERE ot_id NOT IN {LATEST}")
def s15a(spark, d):
    f = F_(spark, d)
    return S.delete_latest_order(f.ordenes_trabajo, f.ot_falla_evento, f.repuestos_consumidos)[0]


@register("S15_delete_latest_order_events", f"SELECT * FROM ot_falla_evento e WHERE NOT EXISTS (SELECT 1 FROM {LATEST} l WHERE l.ot_id = e.ot_id)")
def s15b(spark, d):
    f = F_(spark, d)
    return S.delete_latest_order(f.ordenes_trabajo, f.ot_falla_evento, f.repuestos_consumidos)[1]


@register("S15_delete_latest_order_parts", f"SELECT * FROM repuestos_consumidos r WHERE NOT EXISTS (SELECT 1 FROM {LATEST} l WHERE l.ot_id = r.ot_id)")
def s15c(spark, d):
    f = F_(spark, d)
    return S.delete_latest_order(f.ordenes_trabajo, f.ot_falla_evento, f.repuestos_consumidos)[2]


@register("S16_rebuild_failure_modes", """
SELECT DISTINCT id_modo_falla, modo_catalogo AS modo, CAST(NULL AS VARCHAR) AS palabras_claves FROM equivalencia_nomenclatura""")
def s16(spark, d):
    return S.rebuild_failure_modes(F_(spark, d).equivalencia_nomenclatura)


@register("S17_rebuild_taxonomy", """
SELECT taxonomia_id, sistema_catalogo AS sistema, componente_catalogo AS componente, CAST(id_modo_falla AS BIGINT) AS id_modo_falla,
  CAST(NULL AS VARCHAR) AS descripcion_estandar, TRUE AS activo, CAST(NULL AS VARCHAR) AS subsistema
FROM equivalencia_nomenclatura WHERE taxonomia_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY taxonomia_id ORDER BY id) = 1""")
def s17(spark, d):
    return S.rebuild_taxonomy(F_(spark, d).equivalencia_nomenclatura)


@register("J21_nomenclature_lookup", """
WITH e AS (SELECT lower(trim(coalesce(sistema_ot, ''))) AS k1, lower(trim(coalesce(componente_ot, ''))) AS k2,
             lower(trim(coalesce(modo_falla_ot, ''))) AS k3, taxonomia_id FROM equivalencia_nomenclatura
           QUALIFY row_number() OVER (PARTITION BY k1, k2, k3 ORDER BY id) = 1),
raw AS (SELECT p_partkey, lower(p_type) AS sistema, upper(p_brand) AS componente, 'MODO ' || CAST(p_size % 5 AS VARCHAR) AS modo_falla FROM part)
SELECT raw.*, e.taxonomia_id FROM raw LEFT JOIN e ON lower(trim(coalesce(raw.sistema, ''))) = e.k1
  AND lower(trim(coalesce(raw.componente, ''))) = e.k2 AND lower(trim(coalesce(raw.modo_falla, ''))) = e.k3""")
def j21(spark, d):
    f = F_(spark, d)
    raw = f.raw("part").select("p_partkey", F.lower("p_type").alias("sistema"), F.upper("p_brand").alias("componente"),
                               F.concat(F.lit("MODO "), (F.col("p_size") % 5).cast("string")).alias("modo_falla"))
    return S.nomenclature_lookup(raw, f.equivalencia_nomenclatura)


@register("S12_table_summary", """
SELECT 'activos' AS tabla, count(*) AS filas, 11 AS columnas FROM activos
UNION ALL SELECT 'ordenes_trabajo', count(*), 9 FROM ordenes_trabajo
UNION ALL SELECT 'ot_falla_evento', count(*), 10 FROM ot_falla_evento
UNION ALL SELECT 'repuestos_consumidos', count(*), 7 FROM repuestos_consumidos
UNION ALL SELECT 'repuestos_maestro', count(*), 10 FROM repuestos_maestro""")
def s12(spark, d):
    f = F_(spark, d)
    return S.table_summary({"activos": f.activos, "ordenes_trabajo": f.ordenes_trabajo, "ot_falla_evento": f.ot_falla_evento,
                            "repuestos_consumidos": f.repuestos_consumidos, "repuestos_maestro": f.repuestos_maestro})


# ------------------------------------------------ rows that are written, read back and compared
def _place(spark) -> str:
    return scratch_path(spark, f"io-{uuid.uuid4().hex}")


@register("S1_load_csv", "SELECT ot_id, nullif(descripcion_falla, '') AS descripcion_falla FROM descripciones")
def s1(spark, d):
    """Whole texts, with their quotes and line breaks, through a CSV of more columns in another order."""
    path = _place(spark)
    F_(spark, d).descripciones.select("lang", "descripcion_falla", F.lit("x").alias("sobra"), "ot_id").write.options(**S.CSV).csv(path)
    return S.load_csv(spark, path, ["ot_id", "descripcion_falla"])


_ORDER = "ot_id string, activo_id bigint, fecha_apertura timestamp_ntz, costo_total_clp double"


def _typed(spark, d):
    """Orders as CSV lines, some spoilt: a word for a number, an empty key, a field too many."""
    path = _place(spark)
    k = F.col("ot_id").cast("long")
    line = F.concat_ws(",", F.when(k % 101 == 0, "").otherwise(F.col("ot_id")), F.when(k % 103 == 0, "ninguno").otherwise(F.col("activo_id")),
                       F.col("fecha_apertura").cast("string"), F.coalesce(F.col("costo_total_clp").cast("string"), F.lit("")), F.when(k % 107 == 0, "de más"))
    rows = F_(spark, d).ordenes_trabajo.select(line.alias("value"))
    rows.write.text(path)
    schema = T._parse_datatype_string(_ORDER)
    return S.load_typed_csv(spark, path, schema, ["ot_id"], multi_line=False, header="false")


_SPOILT = "CAST(ot_id AS BIGINT) % 101 = 0 OR CAST(ot_id AS BIGINT) % 103 = 0 OR CAST(ot_id AS BIGINT) % 107 = 0"


@register("S1_typed_rows", f"""
SELECT ot_id, CAST(activo_id AS BIGINT) AS activo_id, fecha_apertura, costo_total_clp FROM ordenes_trabajo WHERE NOT ({_SPOILT})""")
def s1_rows(spark, d):
    return _typed(spark, d)[0]


@register("S1_refused_records", f"""
SELECT CASE WHEN CAST(ot_id AS BIGINT) % 107 = 0 THEN 'número de campos' WHEN CAST(ot_id AS BIGINT) % 101 = 0 THEN 'falta ot_id'
  ELSE 'tipo de activo_id' END AS motivo, count(*) AS registros FROM ordenes_trabajo WHERE {_SPOILT} GROUP BY 1""")
def s1_refused(spark, d):
    return _typed(spark, d)[1].groupBy("motivo").agg(F.count("registro").alias("registros"))


@register("S2_optional_columns", """
SELECT sku AS codigo, descripcion AS nombre, stock_actual AS existencias FROM repuestos_maestro""")
def s2(spark, d):
    return S.project_optional(F_(spark, d).repuestos_maestro, {"sku": "codigo", "no_existe": "nada", "descripcion": "nombre", "stock_actual": "existencias"})


@register("S3_semicolon_csv", """
SELECT sku, descripcion, lead_time_dias_promedio, costo_unitario_clp, activo FROM repuestos_maestro""")
def s3(spark, d):
    """Semicolons, a byte-order mark, a junk column and 'null' for NULL."""
    path = _place(spark)
    rm = F_(spark, d).repuestos_maestro
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("descripcion", "lead_time_dias_promedio", "costo_unitario_clp", "activo")}
    rm.select(F.col("sku").alias("\ufeffsku"), *(v.alias(c) for c, v in text.items()), F.lit("").alias("Unnamed: 5")) \
        .write.options(**S.CSV).option("sep", ";").csv(path)
    return S.load_semicolon_csv(spark, path, ["lead_time_dias_promedio", "costo_unitario_clp"], ["activo"])


@register("S9_snapshot_replaced", "SELECT * FROM repuestos_maestro")
def s9(spark, d):
    rm, path = F_(spark, d).repuestos_maestro, _place(spark)
    S.write_snapshot(rm.withColumn("stock_actual", F.lit(-1.0)), path, partition_by=["criticidad"])
    S.write_snapshot(rm, path, partition_by=["criticidad"])
    return spark.read.schema(rm.schema).parquet(path)


@register("S10_export_renamed", """
SELECT ot_id AS ot, activo_id AS activo, costo_total_clp AS costo, CAST(year(fecha_apertura) AS INTEGER) AS anio FROM ordenes_trabajo""")
def s10(spark, d):
    path = _place(spark)
    ot = F_(spark, d).ordenes_trabajo.select("ot_id", "activo_id", "costo_total_clp", F.year("fecha_apertura").alias("anio"))
    S.export_parquet(ot, path, {"ot_id": "ot", "activo_id": "activo", "costo_total_clp": "costo", "no_existe": "x"}, ["anio"])
    return spark.read.parquet(path)


@register("F23_short_names", "SELECT activo_id, fecha_corte, horizonte_dias, count_ot_7d AS ot_7d, count_correctivas_30d AS corr_30d, "
          f"costo_total_90d AS costo_90d FROM ({BODY['P6_feature_panel']})")
def f23(spark, d):
    path = _place(spark)
    panel = QUERIES["P6_feature_panel"](spark, d)
    S.export_parquet(panel, path, ml.short_names(panel.columns))
    return spark.read.parquet(path).select("activo_id", "fecha_corte", "horizonte_dias", "ot_7d", "corr_30d", "costo_90d")


@register("S14_reset_derived", """
SELECT 'paneles' AS tabla, CAST(0 AS BIGINT) AS filas UNION ALL SELECT 'scoring_resultados', count(*) FROM scoring_resultados""")
def s14(spark, d):
    """A derived table is emptied, the protected one is refused and stays."""
    f, base = F_(spark, d), _place(spark)
    tables = {"paneles": f.paneles, "scoring_resultados": f.scoring_resultados}
    for n, df in tables.items():
        S.write_snapshot(df, f"{base}/{n}")
    S.reset_derived(spark, base, ["paneles"], {n: df.schema for n, df in tables.items()})
    try:
        S.reset_derived(spark, base, list(tables), {n: df.schema for n, df in tables.items()})
        raise AssertionError("a protected table was reset")
    except ValueError:
        pass
    return quality.table_counts({n: spark.read.schema(df.schema).parquet(f"{base}/{n}") for n, df in tables.items()})


_CONTRACT = {"activos": ("activo_id", "estado_actual", "vin"), "ordenes_trabajo": ("ot_id", "costo_total_clp", "costo"), "no_existe": ("id",)}


@register("Q6_schema_report", " UNION ALL ".join(
    f"SELECT '{t}' AS tabla, '{c}' AS columna, {str((t, c) not in {('activos', 'vin'), ('ordenes_trabajo', 'costo'), ('no_existe', 'id')}).upper()} AS existe"
    for t, cols in _CONTRACT.items() for c in cols))
def q6(spark, d):
    f = F_(spark, d)
    return quality.schema_report({"activos": f.activos, "ordenes_trabajo": f.ordenes_trabajo}, _CONTRACT)
