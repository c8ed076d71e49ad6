"""Mixing sources to target weights by pivotal dependent rounding, all in built-in SQL functions.

Every document of a source wants the same fractional number of copies. Blocks of documents are folded
side by side: two fractional documents trade words, at random and without bias, until one of them has a
whole number of copies; what is left of a block, one fractional document, goes up a reduction tree, one
level of blocks at a time, to the last of its source. Words are conserved at every trade, so only that
last document moves a source's total away from its target, and settled documents of the last block make up for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.quality import words
from fleetlens.session import stored

#: Documents that one block holds on average, at each level of the tree.
BLOCK = 128
UNIT = "struct<k:bigint,doc_id:{0},size:bigint,p:double>"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row per source of ``sizes`` (source, source_size) with its target.

    Sources by code point, null last, weigh ``weights``, repeating. They share ``share`` times all sizes; a
    target stops at ``cap`` times its source's size and the excess goes to the others by weight. The windows
    see one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    level = Window.orderBy("full", "rank")
    below = level.rowsBetween(Window.unboundedPreceding, -1)
    above = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # water level: sources are full from the smallest size per weight on, the rest share by weight
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("rank") % len(weights) + 1)
    rows = (
        sizes.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))
        .withColumn("weight", weight)
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("full", F.col("most") / F.col("weight"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / F.sum("weight").over(above))
    )
    first = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "rank", "level"))).over(everything)
    target = F.coalesce(F.least("most", first["level"] * F.col("weight")), F.col("most"))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def _draw(seed: int, a: Column, b: Column) -> Column:
    """A uniform number in [0, 1) that depends on nothing but the two documents."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), a["k"], a["doc_id"], a["size"], b["k"], b["doc_id"], b["size"]), 11) / float(1 << 53)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), then)[0]


def _fold(units: Column, seed: int, id_type: str) -> Column:
    """Fold an array of fractional units to struct(left: the last unit, done: the others with p of 0 or 1)."""
    kind = UNIT.format(id_type)

    def unit(u: Column, p: Column) -> Column:
        return F.struct(u["k"].alias("k"), u["doc_id"].alias("doc_id"), u["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    def state(left: Column, done: Column, whole: Column, value: float) -> Column:
        return F.struct(left.alias("left"), F.concat(done, F.array(unit(whole, F.lit(value)))).alias("done"))

    def trade(acc: Column, j: Column) -> Column:
        i = acc["left"]
        have, want = i["size"] * i["p"], i["size"] * (1 - i["p"])  # words that i can give and take
        gives, takes = j["size"] * j["p"], j["size"] * (1 - j["p"])

        def settle(m: Column) -> Column:
            to_i = _draw(seed, i, j) * (m["a"] + m["b"]) < m["b"]
            return (
                F.when(to_i & (want <= gives), state(unit(j, j["p"] - m["a"] / j["size"]), acc["done"], i, 1.0))
                .when(to_i, state(unit(i, i["p"] + m["a"] / i["size"]), acc["done"], j, 0.0))
                .when(have <= takes, state(unit(j, j["p"] + m["b"] / j["size"]), acc["done"], i, 0.0))
                .otherwise(state(unit(i, i["p"] - m["b"] / i["size"]), acc["done"], j, 1.0))
            )

        return _let(F.struct(F.least(want, gives).alias("a"), F.least(have, takes).alias("b")), settle)

    begin = F.struct(F.get(units, 0).cast(kind).alias("left"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), begin, trade)


def _finish(f: Column, seed: int, id_type: str) -> Column:
    """The settled units of a source's last block.

    The last fractional unit is drawn by its probability; the words that this adds or lacks are made up for,
    from large to small, by settled units of the block that fit into the gap.
    """
    kind, left = UNIT.format(id_type), f["left"]
    up = _draw(seed, left, left) < left["p"]
    gap = F.when(up, left["size"] * (left["p"] - 1)).otherwise(left["size"] * left["p"])
    rest = F.transform(F.array_sort(F.transform(f["done"], lambda u: F.struct((-u["size"]).alias("z"), u["k"].alias("k"), u.alias("u")))), lambda x: x["u"])

    def step(acc: Column, u: Column) -> Column:
        flip = ((u["p"] == 0) & (u["size"] <= acc["gap"])) | ((u["p"] == 1) & (u["size"] <= -acc["gap"]))
        moved = u["size"] * (1 - 2 * u["p"])
        new = u.withField("p", F.when(flip, 1 - u["p"]).otherwise(u["p"])).cast(kind)
        return F.struct((acc["gap"] - F.when(flip, moved).otherwise(0.0)).alias("gap"), F.concat(acc["out"], F.array(new)).alias("out"))

    first = left.withField("p", F.when(up, 1.0).otherwise(0.0)).cast(kind)
    begin = F.struct(gap.cast("double").alias("gap"), F.array(first).alias("out"))
    return F.aggregate(rest, begin, step, lambda acc: acc["out"])


def plan(rows: DataFrame, seed: int = 1, block: int = BLOCK, **shares) -> DataFrame:
    """Copies of each row of ``rows`` (doc_id, source, size): source, doc_id, size, source_size, target, n, copies.

    Equal rows are one unit with n occurrences and their copies in all. A row gets floor or ceil of
    target / source_size copies, 2 at most with the default cap; rows of size 0 get none. Null ids and sources are
    values like others. An empty table gives an empty plan. A rerun with the same seed gives the same copies. A hot
    source is spread over as many blocks as it has rows / ``block``; a block is bounded because equal rows
    are one unit.
    """
    units = stored(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")))
    id_type = units.schema["doc_id"].dataType.simpleString()
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    goals = targets(per.select("source", "source_size"), **shares).withColumnRenamed("source", "s")
    counts = per.select(F.col("source").alias("s2"), "units")
    goals = goals.join(counts, F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.when(F.col("size") > 0, F.col("n") * (F.col("rate") - F.floor("rate"))).otherwise(0.0)
    units = units.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate).withColumn("wanted", wanted)
    units = units.withColumn("p", F.col("wanted") - F.floor("wanted"))
    units = units.withColumn("whole", F.when(F.col("size") > 0, F.col("n") * F.floor("rate")).otherwise(0) + F.floor("wanted"))
    units = stored(units.drop("rate", "wanted"))

    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("units") / block)).cast("long")
    level = units.where("p > 0").select("source", blocks.alias("blocks"), F.struct(key.alias("k"), "doc_id", "size", "p").cast(UNIT.format(id_type)).alias("unit"))
    level = level.withColumn("block", F.pmod("unit.k", "blocks"))
    settled, most = [], units.agg(F.max("units")).first()[0] or 0
    while True:
        # large documents first, so that what is left in the end is small
        queue = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("unit.size"), F.col("unit.k"), "unit"))), lambda x: x["unit"])
        folded = level.groupBy("source", "blocks", "block").agg(queue.alias("units")).withColumn("f", _fold(F.col("units"), seed, id_type))
        folded = stored(folded.select("source", "blocks", "block", "f"))
        done = F.when(F.col("blocks") == 1, _finish(F.col("f"), seed, id_type)).otherwise(F.col("f.done"))
        settled.append(folded.select("source", F.explode(done).alias("u")))
        most = -(-most // block)
        if most <= 1:
            break
        fewer = F.ceil(F.col("blocks") / block).cast("long")
        level = folded.where("blocks > 1").select("source", fewer.alias("blocks"), F.pmod("block", fewer).alias("block"), F.col("f.left").alias("unit"))
    done = settled[0]
    for s in settled[1:]:
        done = done.unionByName(s)
    done = done.select(F.col("source").alias("s"), F.col("u.doc_id").alias("d"), F.col("u.size").alias("z"), F.col("u.p").cast("long").alias("more"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    got = units.join(done, same, "left").withColumn("copies", F.col("whole") + F.coalesce("more", F.lit(0)))
    return got.select("source", "doc_id", "size", "source_size", "target", "n", F.col("copies").cast("long").alias("copies"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col(text))).cast("long").alias("size"))


def mix(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with size, source_size, target, copies (of this row) and taken (words, repeats counted).

    Columns of these names are replaced, others stay. The copies of equal rows differ by one at most.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken").withColumn("size", F.size(words(F.col(text))).cast("long"))
    todo = plan(docs.select("doc_id", "source", "size"), **how)
    todo = todo.select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("size").alias("__z"), "source_size", "target", F.col("n").alias("__n"), F.col("copies").alias("__c"))
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("size") == F.col("__z"))
    each = Window.partitionBy("source", "doc_id", "size").orderBy(F.xxhash64(text))
    copies = F.floor(F.col("__c") / F.col("__n")) + (F.row_number().over(each) <= F.col("__c") % F.col("__n")).cast("long")
    rows = docs.join(todo, same).withColumn("copies", copies.cast("long"))
    return rows.withColumn("taken", F.col("copies") * F.col("size")).drop("__s", "__d", "__z", "__n", "__c")


def op1_mixing(spark, sf_dir):
    """op1: size, source_size, target and taken words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = plan(sized(docs)).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("i") <= F.col("copies") % F.col("n")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))
