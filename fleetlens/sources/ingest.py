"""Sources, ingest and sinks.

Readers never infer schemas on the load path; writers are idempotent
(overwrite, dynamic partition overwrite, or publish-by-rename), so a retried
job after a lost executor produces the same tables.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import latest_order

#: One CSV dialect for readers and writers: quotes are doubled and text may hold line breaks.
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
#: That of exports and their restore: NULL has a mark of its own, so an empty text stays one.
EXPORT = CSV | {"nullValue": "\\N"}


# --------------------------------------------------------------------- readers
def load_csv(spark: SparkSession, path: str, expected: Sequence[str], **options) -> DataFrame:
    """CSV with a column contract: missing columns -> error, extra columns dropped, expected order kept.

    Columns are read as strings (no inference); typing is the caller's ``select``."""
    df = spark.read.options(**(CSV | options)).csv(path)
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return df.select(*expected)


def load_typed_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = (), multi_line: bool = True,
                   **options) -> tuple[DataFrame, DataFrame]:
    """S1 with reject output: (rows, refused) of a CSV under a typed contract.

    ``refused`` has the record as it stands in the file and motivo, the first thing wrong with it: a count of fields that
    differs from the header's, a required column that is empty, or the column whose text is not of its type. Every record is in
    one of the two. Files whose texts hold no line breaks are read split by split with ``multi_line=False``."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("_record", T.StringType())])
    read = CSV | {"multiLine": str(multi_line).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record", "enforceSchema": "false"} | options
    df = spark.read.options(**read).schema(raw).csv(path)
    motivo = F.when(F.col("_record").isNotNull(), F.lit("número de campos"))
    for c in required:
        motivo = motivo.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"falta {c}"))
    typed = {}
    for f in schema:
        typed[f.name] = F.col(f.name) if isinstance(f.dataType, T.StringType) else F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
        motivo = motivo.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.lit(f"tipo de {f.name}"))
    df = df.withColumn("_motivo", motivo)
    rows = df.filter("_motivo IS NULL").select(*(c.alias(n) for n, c in typed.items()))
    whole = F.coalesce("_record", F.to_csv(F.struct(*(f.name for f in schema)), {"quote": '"', "escape": '"'}))
    return rows, df.filter("_motivo IS NOT NULL").select(whole.alias("registro"), F.col("_motivo").alias("motivo"))


def project_optional(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns that exist (source -> target names), in mapping order."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items() if src in df.columns])


def load_semicolon_csv(spark: SparkSession, path: str, numeric: Sequence[str] = (), boolean: Sequence[str] = ()) -> DataFrame:
    """S3: ';'-separated, BOM-prefixed CSV with junk 'Unnamed' columns and 'null' strings.

    The BOM is stripped from the first header, 'Unnamed*' columns are dropped, the literal 'null' becomes
    NULL and numeric columns go through ``try_cast`` (bad number -> NULL)."""
    df = spark.read.options(**CSV).option("sep", ";").option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    df = df.select(*[c for c in df.columns if not c.startswith("Unnamed") and not re.fullmatch(r"_c\d+", c)])
    df = df.select(*[F.when(F.lower(F.trim(F.col(c))) == "null", F.lit(None)).otherwise(F.col(c)).alias(c)
                     for c in df.columns])
    for c in numeric:
        if c in df.columns:
            df = df.withColumn(c, F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    for c in boolean:
        if c in df.columns:
            df = df.withColumn(c, F.expr(f"try_cast(`{c}` AS BOOLEAN)"))
    return df


def coerce_dates(df: DataFrame) -> DataFrame:
    """Every column whose name contains 'fecha' or 'date' -> timestamp; unparsable -> NULL."""
    out = []
    for f in df.schema.fields:
        name = f.name
        if ("fecha" in name.lower() or "date" in name.lower()) and isinstance(f.dataType, T.StringType):
            out.append(F.expr(f"try_to_timestamp(`{name}`)").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def restore_tables(spark: SparkSession, base: str, names: Sequence[str], fmt: str = "csv") -> dict[str, DataFrame]:
    """Bulk restore from CSV or JSON exports, with date coercion."""
    out = {}
    for n in names:
        path = f"{base}/{n}"
        df = spark.read.options(**EXPORT).csv(path) if fmt == "csv" else spark.read.json(path)
        out[n] = coerce_dates(df)
    return out


def table_exists(spark: SparkSession, name: str) -> bool:
    """Catalogue existence guard."""
    return spark.catalog.tableExists(name)


def column_exists(df: DataFrame, name: str) -> bool:
    """Column existence guard (e.g. ``costo_total_clp`` vs ``costo``)."""
    return name in df.columns


# --------------------------------------------------------------------- transforms
def upsert(base: DataFrame, new: DataFrame, key: str, update_cols: Sequence[str]) -> DataFrame:
    """Insert new keys; for existing keys take ``update_cols`` from the new batch (when not NULL),
    everything else from the base row. A full outer join on the key."""
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    j = base.join(n, key, "full")
    cols = []
    for c in base.columns:
        if c == key:
            cols.append(F.col(key))
        elif c in update_cols and f"_n_{c}" in j.columns:
            cols.append(F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c))
        elif f"_n_{c}" in j.columns:
            cols.append(F.coalesce(F.col(c), F.col(f"_n_{c}")).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def replace_range(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the existing rows whose key is in the new batch, then append the batch."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def delete_latest_order(ot: DataFrame, ev: DataFrame, rc: DataFrame, assets: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove the latest order of each asset (of ``assets`` if given) with its events and parts."""
    lo = latest_order(ot if assets is None else ot.join(assets.select("activo_id"), "activo_id", "left_semi"))
    gone = lo.select("ot_id")
    return (ot.join(gone, "ot_id", "left_anti"), ev.join(gone, "ot_id", "left_anti"), rc.join(gone, "ot_id", "left_anti"))


def rebuild_failure_modes(equiv: DataFrame) -> DataFrame:
    """Distinct (id, mode) pairs of the nomenclature table, with an empty keyword column."""
    return equiv.select("id_modo_falla", F.col("modo_catalogo").alias("modo")).distinct() \
        .withColumn("palabras_claves", F.lit(None).cast("string"))


def rebuild_taxonomy(equiv: DataFrame, order_col: str = "id") -> DataFrame:
    """First row per ``taxonomia_id`` (by ``order_col``), renamed, NULL keys rejected, constant columns added."""
    e = equiv.filter(F.col("taxonomia_id").isNotNull())
    w = Window.partitionBy("taxonomia_id").orderBy(F.col(order_col).asc())
    first = e.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return first.select("taxonomia_id", F.col("sistema_catalogo").alias("sistema"),
                        F.col("componente_catalogo").alias("componente"),
                        F.col("id_modo_falla").cast("long").alias("id_modo_falla"),
                        F.lit(None).cast("string").alias("descripcion_estandar"), F.lit(True).alias("activo"),
                        F.lit(None).cast("string").alias("subsistema"))


def nomenclature_lookup(df: DataFrame, equiv: DataFrame, cols: Sequence[str] = ("sistema", "componente", "modo_falla")) -> DataFrame:
    """Raw (system, component, mode) -> catalogue taxonomy id on normalised keys.

    The equivalence table is a curated dictionary; AQE broadcasts it after measuring it."""
    def k(c: str | Column) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))

    e = equiv.select(k("sistema_ot").alias("_k1"), k("componente_ot").alias("_k2"), k("modo_falla_ot").alias("_k3"),
                     "taxonomia_id", "id")
    # one catalogue id per raw key: the first equivalence row (lowest id) wins
    e = e.withColumn("_rn", F.row_number().over(Window.partitionBy("_k1", "_k2", "_k3").orderBy("id"))) \
        .filter("_rn = 1").drop("_rn", "id")
    d = df.withColumn("_k1", k(cols[0])).withColumn("_k2", k(cols[1])).withColumn("_k3", k(cols[2]))
    return d.join(e, ["_k1", "_k2", "_k3"], "left").drop("_k1", "_k2", "_k3")


def table_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """S12 summary: rows and columns per table (one union, one job)."""
    parts = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(n).alias("tabla"), "filas",
                                                             F.lit(len(df.columns)).alias("columnas"))
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_inputs(inputs: Mapping[str, DataFrame]) -> dict[str, int]:
    """S5 pre-check: every input must exist and be non-empty (cheap: ``limit(1)`` per input)."""
    empty = [n for n, df in inputs.items() if df is None or not df.limit(1).take(1)]
    if empty:
        raise ValueError(f"refusing to reload: empty or missing inputs {empty}")
    return {n: 1 for n in inputs}


# --------------------------------------------------------------------- writers
def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Truncate-and-load snapshot."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Replace the (fecha_scoring, modelo_version) slices present in ``df``, leave the others.

    Dynamic partition overwrite is one atomic write per slice: no delete-then-append window in which a
    crash loses the day."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("fecha_scoring", "modelo_version").parquet(path))


def ordered_load(tables: Mapping[str, DataFrame], base: str, order: Sequence[str] = (
        "activos", "ordenes_trabajo", "ot_falla_evento", "repuestos_consumidos"),
        fk: Mapping[str, tuple[str, str, str]] | None = None) -> dict[str, int]:
    """Load in dependency order, checking each foreign key against the already loaded parent
    before writing the child; returns written row counts."""
    from ..operators.quality import not_in

    spark = next(iter(tables.values())).sparkSession
    fk = fk or {"ordenes_trabajo": ("activo_id", "activos", "activo_id"),
                "ot_falla_evento": ("ot_id", "ordenes_trabajo", "ot_id"),
                "repuestos_consumidos": ("ot_id", "ordenes_trabajo", "ot_id")}
    counts = {}
    for name in order:
        df = tables[name]
        if name in fk:
            col, parent, pcol = fk[name]
            loaded = spark.read.parquet(f"{base}/{parent}")
            orphans = not_in(df, col, loaded, pcol).limit(1).count()
            if orphans:
                raise ValueError(f"{name}.{col} has values missing in {parent}.{pcol}")
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        counts[name] = spark.read.parquet(f"{base}/{name}").count()
    return counts


def full_reload(tables: Mapping[str, DataFrame], base: str) -> dict[str, int]:
    """All-or-nothing reload: refuse empty inputs, load all tables into a new version folder, fail if any
    table wrote 0 rows, then switch the one pointer file that readers follow (``live``).

    The switch is an atomic rename, so a reader sees all tables of one version, and a crash before it leaves
    the former version live."""
    check_inputs(tables)
    spark = next(iter(tables.values())).sparkSession
    version = f"versions/{uuid.uuid4().hex}"
    counts = ordered_load(tables, f"{base}/{version}")
    zero = [n for n, c in counts.items() if c == 0]
    if zero:
        raise ValueError(f"reload wrote no rows for {zero}; live tables untouched")
    point_to(spark, base, version)
    return counts


def point_to(spark: SparkSession, base: str, version: str) -> None:
    """Make ``version`` (a folder below ``base``) the one that ``pointed`` names, by one atomic rename."""
    jvm = spark.sparkContext._jvm
    new, pointer = (jvm.org.apache.hadoop.fs.Path(f"{base}/{n}") for n in (f"{version}/_POINTER", "CURRENT"))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, pointer, options)


def pointed(spark: SparkSession, base: str) -> str | None:
    """The version folder that ``point_to`` published last; None before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/CURRENT")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{base}/CURRENT").first()[0]


def live(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the version that the last complete ``full_reload`` published."""
    return spark.read.parquet(f"{base}/{pointed(spark, base)}/{name}")


def export_parquet(df: DataFrame, path: str, renames: Mapping[str, str], partition_by: Sequence[str] = ()) -> None:
    """Rename long -> short columns (only those present) and write Parquet."""
    present = {k: v for k, v in renames.items() if k in df.columns}
    write_snapshot(df.withColumnsRenamed(present), path, "parquet", partition_by)


def export_plan(plan: DataFrame, base: str, stamp: str) -> tuple[str, str]:
    """The plan to CSV and Parquet, stamped with the score date."""
    csv_path, pq_path = f"{base}/plan_repuestos_{stamp}.csv", f"{base}/plan_repuestos_{stamp}.parquet"
    plan.write.mode("overwrite").options(**EXPORT).csv(csv_path)
    plan.write.mode("overwrite").parquet(pq_path)
    return csv_path, pq_path


def export_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "csv") -> DataFrame:
    """Bulk export to CSV or JSON plus the per-table row/column summary."""
    for n, df in tables.items():
        w = df.write.mode("overwrite")
        (w.options(**EXPORT).csv if fmt == "csv" else w.json)(f"{base}/{n}")
    return table_summary(tables)


def reset_derived(spark: SparkSession, base: str, names: Sequence[str], schemas: Mapping[str, T.StructType],
                  protected: Sequence[str] = ("scoring_resultados",)) -> dict[str, int]:
    """Overwrite derived tables with empty frames of the same schema; protected tables are refused."""
    blocked = [n for n in names if n in protected]
    if blocked:
        raise ValueError(f"protected tables cannot be reset: {blocked}")
    out = {}
    for n in names:
        spark.createDataFrame([], schemas[n]).write.mode("overwrite").parquet(f"{base}/{n}")
        out[n] = 0
    return out


def metadata_json(df: DataFrame) -> str:
    """M9 sink helper: a one-row frame as a JSON document."""
    rows = df.toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("expected exactly one metadata row")
    return json.dumps(json.loads(rows[0]), indent=2, sort_keys=True)
