"""As-of joins (J8, J9) as segmented scans.

Spark has no native as-of join. A range predicate alone would be planned as
a nested loop, an equi-join on (key, time bucket) still pairs every left row
with every right row of its bucket (quadratic for a hot key), and a window
over the whole key puts one hot key's history in one task. Here the key's
timeline is cut into 30-day segments: inside a segment, one ordered window
carries the best right row forward; across segments, a running max/min over
segment-level rows (one per key and segment) carries it further. The result is
exact and linear, and a hot key's segments are spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

EPOCH = "1970-01-01"


def day_number(c: str | Column) -> Column:
    return F.datediff(F.to_date(F.col(c) if isinstance(c, str) else c), F.lit(EPOCH))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str,
              lo: int, hi: int, lo_inclusive: bool, hi_inclusive: bool, pick: str,
              right_cols: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """For each left row, the right row of the same ``key`` with ``right_day - left_day`` in the
    window (lo, hi) (inclusivity per flag), picking the latest (``pick='last'``, a window ending at or before
    the left day) or the earliest (``'first'``, a window starting at or after it) by (right_day, *tie).

    A segmented scan, never a pairing of left and right rows:

    1. left and right rows of one (key, month) segment are merged in day order and the best right row seen
       so far is carried along (a running max / min of a struct) - a window over one segment only;
    2. the best right row of earlier (later) months is a running max (min) over month-level rows, at most
       one right row and one left row per key and month;
    3. the window bound is then a filter on the single candidate: the latest row before a day is the only
       one that can lie inside a backward window (the earliest after it, inside a forward one).
    """
    backward = pick == "last"
    if backward and not (hi == 0 or (hi < 0)):
        raise ValueError("a backward as-of window must end at or before the left day")
    if not backward and lo < 0:
        raise ValueError("a forward as-of window must start at or after the left day")
    cand = F.struct(F.col("_rd"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)],
                    *[F.col(c).alias(f"_c_{c}") for c in right_cols])
    own = F.struct(*[F.col(c) for c in left.columns])
    r = right.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), day_number(right_day).alias("_rd"),
                     *[F.col(c) for c in dict.fromkeys([*right_cols, *tie])])
    left_type = left.select(own.alias("_l")).schema["_l"].dataType
    r = r.select(F.lit(None).cast(left_type).alias("_l"), "_k", F.col("_rd").alias("_d"), F.lit(1).alias("_kind"),
                 cand.alias("_cand"))
    l = left.select(own.alias("_l"), F.col(key).alias("_k"), day_number(left_day).alias("_d"),
                    F.lit(0).alias("_kind"), F.lit(None).cast(r.schema["_cand"].dataType).alias("_cand"))
    u = l.unionByName(r).withColumn("_seg", F.floor(F.col("_d") / F.lit(30)))
    # strict: on the same day the left row sorts before the right rows, so it does not see them
    strict = (hi < 0 or not hi_inclusive) if backward else (lo > 0 or not lo_inclusive)
    kind_order = F.col("_kind").asc() if strict else F.col("_kind").desc()
    day_order = F.col("_d").asc() if backward else F.col("_d").desc()
    agg = F.max if backward else F.min
    w = Window.partitionBy("_k", "_seg").orderBy(day_order, kind_order).rowsBetween(Window.unboundedPreceding, 0)
    within = u.withColumn("_in", agg("_cand").over(w)).filter(F.col("_kind") == 0)
    seg_best = r.withColumn("_seg", F.floor(F.col("_d") / F.lit(30))).groupBy("_k", "_seg").agg(agg("_cand").alias("_sb"))
    segs = within.select("_k", "_seg").distinct().withColumn("_sb", F.lit(None).cast(seg_best.schema["_sb"].dataType)) \
        .withColumn("_kk", F.lit(0))
    seg_rows = seg_best.withColumn("_kk", F.lit(1)).unionByName(segs)
    seg_order = F.col("_seg").asc() if backward else F.col("_seg").desc()
    # at equal months the left-segment rows come first: only strictly earlier (later) months are carried
    ws = Window.partitionBy("_k").orderBy(seg_order, F.col("_kk").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = seg_rows.withColumn("_carry", agg("_sb").over(ws)).filter(F.col("_kk") == 0).select("_k", "_seg", "_carry")
    res = within.join(carried, ["_k", "_seg"], "left")
    res = res.withColumn("_best", F.coalesce("_in", "_carry"))
    delta = F.col("_best._rd") - F.col("_d")
    ok = ((delta >= lo) if lo_inclusive else (delta > lo)) & ((delta <= hi) if hi_inclusive else (delta < hi))
    return res.select("_l.*", *[F.when(ok, F.col(f"_best._c_{c}")).alias(c) for c in right_cols])


def may_broadcast(df: DataFrame) -> bool:
    """Whether the files of a stored table are within the session's threshold for broadcasts."""
    state = df.sparkSession._jsparkSession.sessionState()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= state.conf().autoBroadcastJoinThreshold()


#: Tiles of a salted join at most, or eight for each core.
MOST_TILES = 2_000


def tiled(left: DataFrame, right: DataFrame, key: str, spread: str, per_task: int, right_spread: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``salted_join`` with ``_salt``, the tile of a row, dealt by (key, tile); the left one has ``_heavy``, the right one ``_there``."""
    rows = lambda df, name: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    made = F.col("_l").cast("double") * F.col("_r")
    heavy = stored(rows(left, "_l").join(rows(right, "_r"), key).filter(made > per_task))
    sc = left.sparkSession.sparkContext
    each = max(per_task, (heavy.agg(F.sum(made)).first()[0] or 0) / max(MOST_TILES, 8 * sc.defaultParallelism))
    # rows of the grid that cut the left side and columns that cut the right one, so that a tile has about as many of both
    tiles = F.ceil(made / each)
    down = F.greatest(F.lit(1), F.least(tiles, F.round(F.sqrt(tiles * F.col("_l") / F.col("_r"))))).cast("int")
    heavy = heavy.select(key, "_l", "_r", tiles.alias("_tiles"), down.alias("_down")).select(key, "_down", F.ceil(F.col("_tiles") / F.col("_down")).cast("int").alias("_across"))
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), heavy.agg(F.coalesce(F.sum(F.col("_down") * F.col("_across")), F.lit(0))).first()[0])
    n, m = F.coalesce("_down", F.lit(1)), F.coalesce("_across", F.lit(1))

    def side(df: DataFrame, by: Sequence[str], own: Column, other: Column, tile) -> DataFrame:
        mine = F.pmod(F.xxhash64(*by), own).cast("int")
        salt = F.explode(F.transform(F.sequence(F.lit(0), other - 1), lambda x: tile(mine, x)))
        return df.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt).repartition(parts, key, "_salt")

    lhs = side(left, [spread], n, m, lambda mine, x: mine * m + x).withColumn("_heavy", F.col("_down").isNotNull()).drop("_down", "_across")
    rhs = side(right, right_spread or right.columns, m, n, lambda mine, x: x * m + mine).withColumn("_there", F.lit(True)).drop("_down", "_across")
    return lhs, rhs


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, per_task: int = 1_000_000, right_spread: Sequence[str] = ()) -> DataFrame:
    """``left`` left-joined with ``right`` on ``key``, where few keys may make most of the result.

    The rows that a key makes are the product of both sides' rows, counted first. A key of more than ``per_task`` is a grid of
    tiles that make about that number each, more where there would be over ``MOST_TILES``: its left side is cut by the hash of ``spread``,
    its right one by that of ``right_spread`` (all its columns if none). A row is copied once per tile of its strip, so the copies grow with the rows
    made over the side of a tile, where cutting one side alone copies the whole other side for each task. The heavy keys' list has at most
    result / per_task entries, so it is broadcast; no other key needs it. Partitions are as many as tiles: what is joined is few bytes,
    and would be merged into few tasks by its size."""
    lhs, rhs = tiled(left, right, key, spread, per_task, right_spread)
    # a heavy key has rows on both sides: a copy that meets none in its tile is no row of the result
    return lhs.join(rhs.hint("merge"), [key, "_salt"], "left").filter(F.col("_there") | ~F.col("_heavy")).drop("_salt", "_heavy", "_there")
