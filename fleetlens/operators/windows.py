"""Window, top-k and ordering operators (W*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in ([cs] if isinstance(cs, (str, Column)) else cs)]


def latest_per_key(df: DataFrame, keys, order: Sequence[Column]) -> DataFrame:
    """First row per key under ``order`` (give a full tie-break).

    ``row_number() = 1`` is planned as a ``WindowGroupLimit`` below the
    shuffle, so each map task keeps only its local top-1 per key before the
    exchange; a hot key costs one row per map task, not its whole group.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_n_per_key(df: DataFrame, keys, order: Sequence[Column], n: int, rank_col: str | None = None) -> DataFrame:
    """The first ``n`` rows per key (also pre-limited map-side)."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def top_n(df: DataFrame, order: Sequence[Column], n: int, rank_col: str = "orden") -> DataFrame:
    """Global top-N with an ordinal. ``orderBy().limit()`` is planned as
    ``TakeOrderedAndProject``: every task keeps its own top-N, only N rows per
    task reach the final merge."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def last_non_null(df: DataFrame, keys, value: str, ts: str, alias: str | None = None) -> DataFrame:
    """Last non-null ``value`` by ``ts`` per key (pandas ``last`` skips NULLs)."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*_cols(keys))
        .agg(F.max_by(F.col(value), F.struct(F.col(ts), F.col(value))).alias(alias or value))
    )


def rows_at_max(df: DataFrame, part_keys, by: str, small_keys: bool = False) -> DataFrame:
    """Rows at the latest ``by`` (per ``part_keys``), via a grouped max + join.

    The max per key is an aggregate (map-side partial), joined back on
    (key, max): no global single-partition window. ``small_keys`` says that the keys are few by
    definition (as the horizons are): their maxima are broadcast and the rows stay where they are.
    """
    keys = [k for k in ([part_keys] if isinstance(part_keys, str) else list(part_keys))]
    mx = df.groupBy(*keys).agg(F.max(by).alias("_mx"))
    if small_keys or not keys:
        mx = F.broadcast(mx)
    cond = [df[k].eqNullSafe(mx[k]) for k in keys] + [df[by] == mx["_mx"]]
    if not keys:
        return df.join(mx, df[by] == mx["_mx"], "left_semi")
    return df.join(mx, cond, "left_semi")


def severity_rank(c: str | Column) -> Column:
    """W14 rank: critica 3, media 2, leve 1, anything else 0."""
    s = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(s.isin("critica", "crítica"), 3).when(s == "media", 2).when(s == "leve", 1).otherwise(0)


def distributed_row_number(df: DataFrame, order: Sequence[str], out: str = "_rownum", partitions: int | None = None) -> DataFrame:
    """Exact ``row_number() OVER (ORDER BY order...)`` without a single-partition window.

    The rows are range-partitioned on the order key (each task receives one contiguous key range), numbered
    inside their range, and shifted by the exact number of rows in the preceding ranges (one count per
    range: ``partitions`` rows). The order key must be unique for the numbering to be deterministic. The
    ranged rows are checkpointed so the per-range counts and the numbering read the same assignment.
    """
    from ..session import cut_lineage

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # materialised once (reliable checkpoint in the shared folder): the counts and the numbering must see the
    # same range boundaries, and a recomputation could sample different ones
    ranged = cut_lineage(df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))  # n rows
    inside = Window.partitionBy("_pid").orderBy(*[F.col(c) for c in order])
    return ranged.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(offsets), "_pid") \
        .withColumn(out, F.col("_off") + F.col("_in")).drop("_pid", "_in", "_off")


def rows_before(df: DataFrame, part: str) -> DataFrame:
    """One row per ``part``: its rows (_total) and those of the parts that sort before it (_before)."""
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("_total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))


def chrono_split(df: DataFrame, part: str, period: str, order_key: str, frac: float = 0.7,
                 flag: str = "is_train") -> DataFrame:
    """The first ``int(n * frac)`` rows per ``part`` in (period, order_key) order.

    A window over a whole ``part`` (a horizon is a third of the panel), or even over one (part, period)
    slice (every asset), would grow with the data inside one task. Instead the rows get an exact global
    row number over (part, period, order_key) (``distributed_row_number``), and the rank inside ``part`` is
    that number minus the rows of the preceding parts (one count per part)."""
    numbered = distributed_row_number(df, [part, period, order_key], "_g")
    sizes = rows_before(numbered, part)
    return (numbered.join(F.broadcast(sizes), part)
            .withColumn(flag, (F.col("_g") - F.col("_before")) <= F.floor(F.col("_total") * F.lit(frac)))
            .drop("_g", "_total", "_before"))


def running_totals(df: DataFrame, group: str, order: str, cols: Sequence[str], descending: bool,
                   buckets: int = 64) -> DataFrame:
    """Inclusive running sums of ``cols`` per ``group`` in ``order``, without a window over the whole group.

    Rows are split into ``buckets`` ranges by approximate quantiles of ``order`` (balance only, never
    correctness); bucket totals (group x buckets rows) give exact offsets; the running sum inside a bucket
    is a window over that bucket only.
    """
    qs = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(group).agg(F.percentile_approx(order, qs, 10000).alias("_cuts"))
    b = df.join(F.broadcast(cuts), group).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    if descending:
        b = b.withColumn("_b", F.lit(buckets) - F.col("_b"))
    # the bucket totals and the in-bucket sums must see one bucket assignment: materialise it once
    from ..session import cut_lineage

    b = cut_lineage(b)
    tot = b.groupBy(group, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w_off = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(group, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}") for c in cols])
    o = F.col(order).desc() if descending else F.col(order).asc()
    w_in = Window.partitionBy(group, "_b").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(off, [group, "_b"])
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(w_in))
    return out.drop("_b", *[f"_o_{c}" for c in cols])


def exact_median(df: DataFrame, group: str, value: str, out: str = "mediana") -> DataFrame:
    """Exact median per group (numpy's: the mean of the two middle values for an even count).

    Per (group, distinct value) counts, then running totals in value order (bucketed, never a window over
    a whole group); the value at 0-based rank r is the smallest value whose running count exceeds r."""
    c = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    r = running_totals(c, group, value, ["_c"], descending=False)
    n = c.groupBy(group).agg(F.sum("_c").alias("_n"))
    lo = F.floor((F.col("_n") - 1) / 2)
    hi = F.ceil((F.col("_n") - 1) / 2)
    j = r.join(F.broadcast(n), group)  # one row per group
    picks = j.groupBy(group).agg(
        F.min(F.when(F.col("cum__c") > lo, F.col(value))).alias("_v1"),
        F.min(F.when(F.col("cum__c") > hi, F.col(value))).alias("_v2"))
    return picks.select(group, ((F.col("_v1") + F.col("_v2")) / 2.0).alias(out))
