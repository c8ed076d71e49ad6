"""How filters interact: five filters over a sparse document-term matrix, in every order.

Each task turns its rows into CSR shards, whose columns are words of a global dictionary. Row sums of the matrix
are words, counts of its nonzero columns are different words. A document's verdicts become five bits, and counts of documents by part
and bits say all that any order of the filters does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import SPACE, Words, slices
from fleetlens.session import stored

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 50, 65, 5, "#$%&*|"
#: Bytes of text in a shard, one row at least.
SHARD = 4 << 20
#: Shards that a task holds at once when it stores them or reads them back.
SHARDS_HELD = 4
#: Buckets that words are packed by, and the bits of a word's hash that are its id.
BUCKETS, MASK = 8192, 2**63 - 1

#: What a shard keeps of each document's columns.
_META = ("doc_id", "part", "text_sha")


def _marks(w: Words) -> np.ndarray:
    """The bits of C and D for each row, from its bytes."""

    def count(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(kind[w.buf])))[w.offsets])

    byte = np.arange(256)
    upper, points = count((byte >= 65) & (byte <= 90)), count(byte & 0xC0 != 0x80)
    marks = count(np.isin(byte, list(SYMBOLS.encode())))
    return ((100 * upper > MAX_UPPER * points) * _bit("C") + (marks > 0) * _bit("D")).astype(np.int32)


def _shards(mask: int):
    """One row a shard: its documents, their term counts in CSR form, and the words that its columns stand for,
    with their hashes, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", SHARD):
            w = Words(batch.column("text"))
            data = w.buf[~SPACE[w.buf]].tobytes()
            ends = np.concatenate(([0], np.cumsum(w.end - w.start))).astype(np.int32)
            found = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]).dictionary_encode()
            words = found.dictionary.to_pylist()
            ids = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in words), np.uint64, len(words)).astype(np.int64) & mask
            # columns are numbered bucket by bucket, as their words are packed
            order = np.argsort(ids % BUCKETS, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            buckets, first = np.unique((ids % BUCKETS)[order], return_index=True)
            packed = [b" ".join([words[k] for k in own]) for own in np.split(order, first[1:])] if len(order) else []
            width = max(len(words), 1)
            cell, times = np.unique(w.row * width + place[found.indices.to_numpy()], return_counts=True)
            starts = np.searchsorted(cell, np.arange(batch.num_rows + 1) * width)
            lists = {
                **{c: batch.column(c) for c in _META},
                "bits": pa.array(_marks(w)),
                "starts": pa.array(starts.astype(np.int32)),
                "columns": pa.array((cell % width).astype(np.int32)),
                "times": pa.array(times.astype(np.int32)),
                "ids": pa.array(ids[order]),
                "packed": pa.StructArray.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(packed, pa.binary()).cast(pa.string(), safe=False)], ["bucket", "words"]),
            }
            one = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in lists.items()}
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *one.values()], names=["shard", *one])
            shard += 1

    return run


def matrix(docs: DataFrame, mask: int = MASK) -> tuple[DataFrame, DataFrame]:
    """(shards, dictionary) of ``docs`` (doc_id, part, text_sha, text).

    dictionary: word and id, one row for each different word. shards: shard, its documents' columns and bits (of C and D) as
    arrays, starts/columns/times (CSR) and ids, the dictionary's id of each column.

    A word's id is its hash (``mask`` keeps 63 bits) unless another word has the same: such words, found by grouping all
    words by hash, get negative ids of their own. Words travel once, packed by bucket, a shard's own repeats left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"shard long, doc_id array<{kind}>, part array<string>, text_sha array<binary>, bits array<int>, starts array<int>, columns array<int>, times array<int>, ids array<long>, packed array<struct<bucket:int,words:string>>"
    shards = stored(docs.mapInArrow(_shards(mask), schema), SHARDS_HELD)
    packed = shards.select(F.inline("packed")).repartition("bucket")
    words = packed.select("bucket", F.explode(F.split("words", " ")).alias("word")).withColumn("id", F.xxhash64("word").bitwiseAND(F.lit(mask)))
    # both groupings lie inside a bucket and need no further exchange
    words = words.groupBy("bucket", "id", "word").agg(F.lit(1).alias("n"))
    shared = stored(words.groupBy("bucket", "id").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "id"))
    if shared.isEmpty():
        return shards.drop("packed"), words.select("word", "id")
    clashes = stored(words.join(shared, ["bucket", "id"]).select("word", (-1 - F.monotonically_increasing_id()).alias("own")))
    dictionary = words.join(clashes, "word", "left").select("word", F.coalesce("own", "id").alias("id"))
    local = shards.select("shard", F.posexplode(F.split(F.array_join("packed.words", " "), " ")).alias("column", "word"))
    own = local.join(clashes, "word").groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("column", "own"))).alias("own"))
    ids = F.when(F.col("own").isNull(), F.col("ids")).otherwise(F.transform("ids", lambda x, k: F.coalesce(F.try_element_at("own", k), x)))
    return shards.drop("packed").join(own, "shard", "left").withColumn("ids", ids).drop("own"), dictionary


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of CSR shards with their row sums and counts of nonzero columns."""

    def one(got: dict[str, pa.Array]) -> pa.RecordBatch:
        starts, times = got["starts"].to_numpy(), got["times"].to_numpy()
        total = np.concatenate(([0], np.cumsum(times, dtype=np.int64)))
        if len(times):
            row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            ids = got["ids"].to_numpy()[got["columns"].to_numpy()]
            order = np.lexsort((ids, row))
            row, ids = row[order], ids[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])))
            different = np.bincount(row[new], minlength=len(starts) - 1)
        else:
            different = np.zeros(len(starts) - 1, np.int64)
        sums = [pa.array(total[starts[1:]] - total[starts[:-1]]), pa.array(different.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*(got[c] for c in (*_META, "bits")), *sums], names=[*_META, "bits", "n_words", "n_distinct"])

    for batch in batches:
        for i in range(batch.num_rows):
            yield one({c: batch.column(c)[i].values for c in batch.schema.names if c != "shard"})
        del batch  # before the next one comes: they are of tens of megabytes


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, part, text_sha, n_words, n_distinct and bits (A to D that a document fails) of every row of ``docs`` (doc_id, source, text).

    A null text counts as an empty one, a null source as part ''. An empty text fails A alone.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("text_sha"), t.alias("text"))
    shards, _ = matrix(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = shards.mapInArrow(_sums, f"doc_id {kind}, part string, text_sha binary, bits int, n_words long, n_distinct long")
    few = F.when(F.col("n_words") < MIN_WORDS, _bit("A")).otherwise(0)
    same = F.when(100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"), _bit("B")).otherwise(0)
    return found.withColumn("bits", F.col("bits") + few + same)


def combinations(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """part, bits (the filters of A to E that fail), n, good and toxic: documents by part and what they fail.

    E fails where a smaller doc_id has the same text (its SHA-256); a null doc_id fails nobody and never fails.
    A document is good or toxic if any of its label rows says so. Documents meet the first of their text by
    (text, doc_id), a key that a group of copies doesn't share, and are counted before they meet labels.
    """
    rows = stored(verdicts(docs, text).groupBy("text_sha", "doc_id", "part", "bits").agg(F.count("*").alias("n")))
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("text_sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = known.join(first, ["text_sha", "doc_id"], "left")
    told = told.withColumn("bits", F.col("bits") + F.when(F.col("first"), 0).otherwise(_bit("E")))
    told = told.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    told = told.join(marks, "doc_id", "left").select("part", "bits", "n", "good", "bad")
    rest = rows.where("doc_id IS NULL").select("part", "bits", "n", F.lit(False).alias("good"), F.lit(False).alias("bad"))
    number = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return told.unionByName(rest).groupBy("part", "bits").agg(F.sum("n").alias("n"), number("good").alias("good"), number("bad").alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """What each step of each order of the filters does, from ``combinations``: one row per part, filter_order and step.

    A part's counts are at most 32 cells; its 600 rows are generated from them without a join.
    """
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    every = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = cells.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def mask(letters: Column) -> Column:
        return sum((F.when(letters.contains(x), _bit(x)).otherwise(0) for x in FILTERS), F.lit(0))

    steps = steps.withColumns({"own": mask(F.col("filter_order").substr(F.col("step"), F.lit(1))), "before": mask(F.col("filter_order").substr(F.lit(1), F.col("step") - 1))})

    def total(value, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(where(c["bits"]), value(c)).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails, past = (lambda b: b.bitwiseAND(own) > 0), (lambda b: b.bitwiseAND(before) == 0)
    here = lambda b: fails(b) & past(b)
    n = lambda c: c["n"]
    # of the 120 orders, a document that fails k filters falls to each of them in 120 / k
    share = lambda c: c["n"] * F.element_at(F.array(*(F.lit(120 // k) for k in range(1, 6))), F.bit_count(c["bits"]))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda b: b.bitwiseAND(own + before) == 0).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda b: fails(b) & ~past(b)).alias("redundant"),
        total(n, lambda b: b == own).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir):
    """op11: the five filters in all 120 orders on every part of documents; an empty table has no part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return orders(combinations(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT *, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                       CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM f),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
z AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z),
o AS (
  SELECT p.z || q.z || r.z || s.z || u.z AS filter_order FROM z p, z q, z r, z s, z u
  WHERE len(list_distinct([p.z, q.z, r.z, s.z, u.z])) = 5),
st AS (SELECT filter_order, step, filter_order[step] AS own, left(filter_order, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (
  SELECT g.*, st.*, contains(fails, own) AS failing, fails <> '' AND before <> '' AND len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AS gone
  FROM g, st),
r AS (
  SELECT part, filter_order, step, any_value(own) AS own,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND failing), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM m GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
