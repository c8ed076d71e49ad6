"""Column-level helpers (the F* operators): all built-in expressions, no UDFs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c: str | Column) -> Column:
    """``lower(trim(coalesce(x, '')))``: case/space-insensitive text key."""
    return F.lower(F.trim(F.coalesce(col_(c), F.lit(""))))


def lower_in(c: str | Column, values: Iterable[str]) -> Column:
    """``LOWER(COALESCE(x,'')) IN (...)``."""
    return F.lower(F.coalesce(col_(c), F.lit(""))).isin(list(values))


def is_corrective(c: str | Column = "tipo_ot") -> Column:
    return lower_in(c, vocab.CORRECTIVE)


def active_asset(c: str | Column = "estado_actual", mode: str = "activo") -> Column:
    """F2, three meanings of 'active':

    ``activo``      UPPER(COALESCE(estado,'Activo')) = 'ACTIVO'
    ``not_retired`` COALESCE(LOWER(estado),'operativo') NOT IN retired states
    ``operativo``   estado = 'operativo'
    """
    c = col_(c)
    if mode == "activo":
        return F.upper(F.coalesce(c, F.lit("Activo"))) == "ACTIVO"
    if mode == "not_retired":
        return ~F.coalesce(F.lower(c), F.lit("operativo")).isin(list(vocab.RETIRED_STATES))
    if mode == "operativo":
        return F.coalesce(c == "operativo", F.lit(False))
    raise ValueError(f"unknown active mode {mode!r}")


def blank_default(c: str | Column, default: str = vocab.UNCLASSIFIED) -> Column:
    """``COALESCE(NULLIF(LOWER(x),''), default)``."""
    return F.coalesce(F.nullif(F.lower(col_(c)), F.lit("")), F.lit(default))


def py_round(x: str | Column, n: int) -> Column:
    """Python/pandas ``round(x, n)`` on a double: half-even on the binary value (``rint(x*10^n)/10^n``),
    unlike ``bround`` which rounds the shortest decimal representation."""
    f = float(10 ** n)
    return F.rint(col_(x) * F.lit(f)) / F.lit(f)


def priority(p: str | Column, thresholds: Mapping[str, float] | None = None) -> Column:
    """priority bucket, ``>=`` at each step. Threshold values may be columns."""
    t = dict(vocab.DEFAULT_THRESHOLDS if thresholds is None else thresholds)
    p = col_(p)

    def th(k):
        v = t[k]
        return v if isinstance(v, Column) else F.lit(float(v))

    return (
        F.when(p >= th("p1"), F.lit(vocab.P1))
        .when(p >= th("p2"), F.lit(vocab.P2))
        .when(p >= th("p3"), F.lit(vocab.P3))
        .otherwise(F.lit(vocab.P4))
    )


def priority_rank(c: str | Column = "prioridad") -> Column:
    """P1 < P2 < P3 < P4 < other."""
    c = col_(c)
    return (
        F.when(c == vocab.P1, 1).when(c == vocab.P2, 2).when(c == vocab.P3, 3)
        .when(c == vocab.P4, 4).otherwise(9)
    )


def binary_prediction(p: str | Column, threshold: float | Column) -> Column:
    """``int(p >= threshold)``."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (col_(p) >= thr).cast("int")


def intervention_type(system: str | Column, prio: str | Column) -> Column:
    """suggested intervention from (system at risk, priority)."""
    s, p = col_(system), col_(prio)
    return (
        F.when(s == vocab.NO_HISTORY_SYSTEM, F.lit("Inspección inicial"))
        .when(p == vocab.P1, F.lit("Correctivo programado"))
        .when(p == vocab.P2, F.lit("Preventivo anticipado"))
        .otherwise(F.lit("Inspección"))
    )


def intervention_type_by_probability(p: str | Column) -> Column:
    """F7 variant (schema V1): from the probability, .85 / .60."""
    p = col_(p)
    return (
        F.when(p >= 0.85, F.lit("Correctivo programado"))
        .when(p >= 0.60, F.lit("Preventivo anticipado"))
        .otherwise(F.lit("Inspección"))
    )


def elapsed_days(t0: str | Column, t: str | Column) -> Column:
    """F8: whole 24 h periods from ``t`` to ``t0`` (floor), not calendar days."""
    return F.floor(
        (F.unix_timestamp(F.to_timestamp(col_(t0))) - F.unix_timestamp(F.to_timestamp(col_(t)))) / 86400
    ).cast("int")


def day_diff(end: str | Column, start: str | Column) -> Column:
    """calendar-day difference ``date - date``."""
    return F.datediff(F.to_date(col_(end)), F.to_date(col_(start)))


def hours_between(a: str | Column, b: str | Column) -> Column:
    """``EXTRACT(EPOCH FROM b - a) / 3600``."""
    return (F.unix_timestamp(F.to_timestamp(col_(b))) - F.unix_timestamp(F.to_timestamp(col_(a)))) / 3600.0


def month_start(c: str | Column) -> Column:
    """month truncation."""
    return F.trunc(F.to_date(col_(c)), "MM")


def age_years(birth: str | Column, as_of) -> Column:
    """whole years of age."""
    return F.floor(F.months_between(F.lit(as_of), col_(birth)) / 12).cast("int")


def sku_ok(c: str | Column = "sku", pattern: str = r"^REP-[0-9]{4}$") -> Column:
    """``sku ~ '^REP-[0-9]{4}$'``; a master with more than 10,000 parts passes a wider ``pattern``."""
    return F.coalesce(col_(c).rlike(pattern), F.lit(False))


def split_metric(c: str | Column, sep: str = " - ") -> tuple[Column, Column]:
    """'prio - type' -> (prio, type); without the separator -> (x, NULL)."""
    c = col_(c)
    pos = F.instr(c, sep)
    left = F.when(pos > 0, F.substring_index(c, sep, 1)).otherwise(c)
    right = F.when(pos > 0, F.substr(c, pos + F.lit(len(sep))))
    return left, right


def system_list(c: str | Column) -> Column:
    """F16: 'A | B' -> ['a','b']; blank/general/nan/none -> []."""
    parts = F.transform(F.split(F.coalesce(col_(c), F.lit("")), r"\|"), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: ~x.isin("", "general", "nan", "none"))


def normalize_text(c: str | Column) -> Column:
    """lower, trim, drop the literal substrings '.,;:', '!?', '"\\'', collapse spaces."""
    x = F.lower(F.coalesce(col_(c), F.lit("")))
    for lit in (".,;:", "!?", "\"'"):
        x = F.replace(x, F.lit(lit), F.lit(""))
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def confidence_band(c: str | Column) -> Column:
    """five confidence bands."""
    c = col_(c)
    return (
        F.when(c >= 0.8, F.lit("Muy alta (≥0.80)"))
        .when(c >= 0.6, F.lit("Alta (0.60-0.79)"))
        .when(c >= 0.4, F.lit("Media (0.40-0.59)"))
        .when(c >= 0.2, F.lit("Baja (0.20-0.39)"))
        .otherwise(F.lit("Muy baja (<0.20)"))
    )


def metric_delta(cur: str | Column, prev: str | Column) -> Column:
    """current - previous, NULL if either is NULL."""
    return col_(cur) - col_(prev)


def next_sequence(ids, code_col: str, group_col: str):
    """per prefix group, ``MAX(INT(SPLIT_PART(id, '-', 3))) + 1`` over ids LIKE 'OT-%' (one grouped pass)."""
    seq = F.split_part(F.col(code_col), F.lit("-"), F.lit(3)).cast("int")
    return ids.filter(F.col(code_col).like("OT-%")).groupBy(group_col).agg(
        (F.coalesce(F.max(seq), F.lit(0)) + 1).alias("proxima_secuencia")).select(
        F.concat(F.lit("OT-"), F.col(group_col).cast("string"), F.lit("-")).alias("prefijo"), "proxima_secuencia")


def assign_sequence(new_rows, start_col: str, order_cols, out_col: str = "ot_id"):
    """give a batch of new rows consecutive ids after the group's next sequence, without a gap.

    ``order_cols`` (names, unique within a prefix) order them. Rows are range-partitioned by prefix and order, numbered inside
    their range and shifted by the rows of the ranges before: a prefix that holds most of the rows spans many tasks."""
    from ..operators.windows import distributed_row_number, rows_before

    numbered = distributed_row_number(new_rows, ["prefijo", *order_cols], "_g")
    before = rows_before(numbered, "prefijo")
    return numbered.join(F.broadcast(before), "prefijo").withColumn(
        out_col, F.concat(F.col("prefijo"), (F.col(start_col) + F.col("_g") - F.col("_before") - 1).cast("string"))).drop("_g", "_before", "_total")


def next_order_estimates(with_last):
    """next order cost = last cost x 1.15 (default 300 000), odometer = last + 150 (default 100)."""
    cost, odo = F.col("costo_total_clp"), F.col("odometro_km")
    return with_last.select(
        "activo_id",
        F.when(cost.isNotNull() & (cost != 0), cost * 1.15).otherwise(F.lit(300000.0)).alias("costo_estimado"),
        F.when(odo.isNotNull() & (odo != 0), odo + 150).otherwise(F.lit(100.0)).alias("odometro_estimado"))
