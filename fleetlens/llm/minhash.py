"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words, weighted by (1 + ln tf) times a damped idf. Improved consistent weighted
sampling draws samples that two texts share with the probability of their weighted Jaccard similarity, and
least hashes are shared with that of the plain one; bands of either kind of sample give candidates, and a candidate pair is linked if its weighted similarity, computed from
all shingles, is 0.8 or more (or the plain one is). Classes are the components of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.graph import ONE_TASK, components, together
from fleetlens.llm.words import Words, mix, raw, slices
from fleetlens.session import stored

SHINGLE = 5
#: Of each kind of sample, weighted and plain.
BANDS, ROWS = 10, 3
SIMILARITY = 0.8
#: A shingle of this share of the documents or more (of two at least) is frequent and has its exact document frequency; with L shingles a
#: document there are L / FREQUENT of them at most, whatever the corpus. The others are rare and weigh like those of one document.
FREQUENT = 1 / 256
#: Hash buckets whose sums show where frequent shingles can be: the table is 2 MB.
DF_BUCKETS = 1 << 18
#: Texts of one bucket that are compared pair by pair; larger ones are compared with representatives, then by prefixes of their shingles.
SMALL = 32
#: Pairs that one task computes in full.
PAIRS = 4_000
#: Texts a side of one cell of a shingle's pairs; no key of that join has more rows, however frequent the shingle.
CELL = 512
#: Representatives of a large bucket's largest class. A text is in up to 2 * BANDS such buckets.
FIRST = 8
#: Hash buckets by whose sums the shingles of the texts left are put in order, rarest first: 8 MB.
ORDER_BUCKETS = 1 << 20
#: Samples of BANDS * ROWS, of one kind or the other, that a pair must share to be computed in full; with similarity 0.8 of that kind, fewer
#: have probability 2e-4, less than its bands themselves miss (8e-4).
AGREE = 16
#: What sums of weights may be off by, as a part of them.
ROUNDING = 1e-6


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row, by row and hash.

    A row of one to four words has one shingle, all its words; a row without words has none.
    """
    hashes = words.hashes()
    got, at = words.windows(hashes, SHINGLE)
    row = words.row[at]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(np.diff(words.first) == n)
        if len(short):
            h, i = words.windows(hashes, n)
            own = np.searchsorted(i, words.first[short])
            got, row = np.append(got, h[own]), np.append(row, short)
    order = np.lexsort((got, row))
    got, row = got[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (got[1:] != got[:-1]) | (row[1:] != row[:-1])))) if len(got) else np.zeros(0, np.int64)
    return row[new], got[new], np.diff(np.append(new, len(got)))


class Weights:
    """idf: 1 + ln((N + 1) / (df + 1)) / ln(N + 1), between 1 and 2, with the df of each frequent shingle and 1 for the others.

    It is damped so that a group of copies, whose own shingles are frequent because of the group, does not
    let a few edited words outweigh the text that its members share.
    """

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int):
        """``hashes`` (64 bits) of the frequent shingles among ``n`` documents, and their ``df``."""
        idf = lambda df: (1 + np.log((n + 1) / (df + 1)) / max(np.log(n + 1), 1e-9)).astype(np.float32)
        self.rare = idf(np.ones(1))[0]
        self.tables = {}
        # whole hashes, and the 32 bits that contents() keeps
        for kind in (np.uint64, np.uint32):
            own = hashes.astype(kind)
            order = np.argsort(own)
            self.tables[np.dtype(kind)] = own[order], idf(df[order])

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        known, idf = self.tables[hashes.dtype]
        times = 1 + np.log(counts.astype(np.float32))
        if not len(known):
            return self.rare * times
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, idf[at], self.rare) * times


def bucket_sums(rows: DataFrame, column: str, hashes: Callable[[pa.Array], np.ndarray], buckets: int) -> tuple[np.ndarray, int]:
    """How many of the hashes that ``hashes`` takes from ``column`` fall into each of ``buckets`` (a power of two, 4096 at least), and
    the number of rows. Sums travel as packed blocks."""
    width = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, np.int64), 0
        for batch in slices(batches, column):
            h = hashes(batch.column(column))
            total += np.bincount((h & h.dtype.type(buckets - 1)).astype(np.int64), minlength=buckets)
            n += batch.num_rows
        if n:
            blocks = [*range(buckets // width), -1]
            data = [total[b * width : (b + 1) * width].tobytes() for b in blocks[:-1]] + [np.array([n], np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["block", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "counts": [total.tobytes()]})

    sums = rows.select(column).mapInArrow(count, "block int, counts binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    # two steps, so that no task adds up the counts of all tasks
    some = sums.groupBy("block", "part").applyInPandas(add, "block int, counts binary")
    got = some.groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    total, n = np.zeros(buckets, np.int64), 0
    for r in got:
        own = np.frombuffer(bytes(r.counts), np.int64)
        if r.block < 0:
            n = int(own[0])
        else:
            total[r.block * width : (r.block + 1) * width] = own
    return total, n


def frequencies(docs: DataFrame) -> Weights:
    """Count, over all documents, in how many each frequent shingle occurs.

    A bucket's sum is as large as the count of any shingle in it, so only shingles of buckets that reach the least count
    are then counted one by one.
    """
    df, n = bucket_sums(docs, "text", lambda texts: shingles(Words(texts))[1], DF_BUCKETS)
    least = max(2, n * FREQUENT)
    wanted = docs.sparkSession.sparkContext.broadcast(df >= least)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, h, _ = shingles(Words(batch.column("text")))
            h, times = np.unique(h[wanted.value[(h & np.uint64(DF_BUCKETS - 1)).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "df"])

    got = docs.select("text").mapInArrow(each, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).where(F.col("df") >= least).toPandas()
    return Weights(got["h"].to_numpy(np.int64).view(np.uint64), got["df"].to_numpy(np.int64), n)


def samples(row: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have shingles and, for each, BANDS * ROWS consistent weighted samples and the BANDS keys made of them."""
    rows, first = np.unique(row, return_index=True)
    if not len(rows):
        return rows, np.zeros((0, BANDS * ROWS), np.uint64), np.zeros((0, BANDS), np.uint64)
    size = np.diff(np.append(first, len(row)))
    log_w = np.log(weights)
    drawn = np.zeros((len(rows), BANDS * ROWS), np.uint64)
    lows, mids = np.uint64(0xFFFFFF), np.uint64(0xFFFFF)
    for k in range(BANDS * ROWS):
        a, b = mix(hashes, 2 * k), mix(hashes, 2 * k + 1)
        u = ((a >> np.uint64(40)).astype(np.float32) + 0.5) * (((a >> np.uint64(16)) & lows).astype(np.float32) + 0.5)
        v = ((b >> np.uint64(44)).astype(np.float32) + 0.5) * (((b >> np.uint64(24)) & mids).astype(np.float32) + 0.5)
        beta = (b & lows).astype(np.float32) * np.float32(2.0**-24)
        # products of two uniforms: r and c are Gamma(2, 1)
        r = np.float32(48 * np.log(2)) - np.log(u) + np.float32(1e-6)
        log_c = np.log(np.float32(40 * np.log(2)) - np.log(v) + np.float32(1e-6))
        t = np.floor(log_w / r + beta)
        score = log_c - r * (t + 1 - beta)
        least = np.repeat(np.minimum.reduceat(score, first), size)
        hit = np.flatnonzero(score == least)
        # of equal scores the first, which is the least hash
        hit = hit[np.searchsorted(hit, first)]
        drawn[:, k] = mix(hashes[hit] ^ mix(t[hit].astype(np.int64).view(np.uint64), 99), 7)
    return rows, drawn, banded(drawn)


def plain_samples(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As samples(), all shingles alike: the least of BANDS * ROWS hashes."""
    rows, first = np.unique(row, return_index=True)
    drawn = np.zeros((len(rows), BANDS * ROWS), np.uint64)
    if len(rows):
        for k in range(BANDS * ROWS):
            drawn[:, k] = np.minimum.reduceat(mix(hashes, 100 + k), first)
        # the high bits of a least hash are mostly zeros
        drawn = mix(drawn, 8)
    return rows, drawn, banded(drawn)


def banded(drawn: np.ndarray) -> np.ndarray:
    """The BANDS keys of each row's samples."""
    keys = np.zeros((len(drawn), BANDS), np.uint64)
    for band in range(BANDS):
        for j in range(ROWS):
            keys[:, band] = mix(keys[:, band] ^ drawn[:, band * ROWS + j], band + 1)
    return keys


def signatures(docs: DataFrame, weights) -> DataFrame:
    """doc_id, key (md5 of the text), bands and drawn (the samples, 32 bits of each) of every document, the weighted ones
    first, then the plain ones; both are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            row, hashes, counts = shingles(Words(batch.column("text")))
            rows, *both = samples(row, hashes, weights.value.of(hashes, counts))
            drawn, keys = (np.hstack(x) for x in zip(both, plain_samples(row, hashes)[1:], strict=True))
            at = np.full(batch.num_rows, -1)
            at[rows] = np.arange(len(rows))
            take = pa.array(at, mask=at < 0)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(k)).take(take) for x, k in ((keys.view(np.int64), pa.int64()), (drawn.astype(np.uint32).view(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *lists], names=["doc_id", "key", "bands", "drawn"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key string, bands array<long>, drawn array<int>")


def contents(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, hashes (32 bits of each, sorted) and counts, packed, of the texts that take part in candidate pairs.

    Among the shingles of two texts of a thousand words, two different ones agree in 32 bits once in thousands of
    pairs, which moves a similarity by a thousandth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            row, hashes, counts = shingles(Words(batch.column("text")))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            hashes = hashes.astype(np.uint32)
            order = np.lexsort((hashes, row))
            hashes, counts = hashes[order], counts[order]
            own = [hashes[a:b].tobytes() for a, b in spans]
            # counts only where any is above one
            times = [counts[a:b].astype(np.int32).tobytes() if b > a and counts[a:b].max() > 1 else b"" for a, b in spans]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own, pa.binary()), pa.array(times, pa.binary())], names=["key", "hashes", "counts"])

    return docs.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", "text").mapInArrow(run, "key string, hashes binary, counts binary")


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two texts, each as sorted hashes and their weights, or the plain one if it is larger.

    In a large group of near copies their common shingles weigh little for being frequent there, which would put
    pairs below the threshold whose plain similarity is above it.
    """
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    shared, n = float(np.minimum(a[1][both], b[1][at[both]]).sum()), int(both.sum())
    return max(shared / (float(a[1].sum()) + float(b[1].sum()) - shared), n / (len(a[0]) + len(b[0]) - n))


def likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) that share AGREE samples of one kind or more: of those that are similar enough, all but 2 in 10,000 at the threshold."""
    left = signed.select(F.col("key").alias("a"), F.col("drawn").alias("da"))
    right = signed.select(F.col("key").alias("b"), F.col("drawn").alias("db"))
    part = lambda c, k: F.slice(c, k * BANDS * ROWS + 1, BANDS * ROWS)
    agree = lambda k: F.aggregate(F.zip_with(part("da", k), part("db", k), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.join(left, "a").join(right, "b").where((agree(0) >= AGREE) | (agree(1) >= AGREE)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, weights, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose weighted similarity is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(h: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
            hashes = np.frombuffer(h, np.uint32)
            return hashes, weights.value.of(hashes, np.frombuffer(c, np.int32) if c else np.ones(len(hashes), np.int32)).astype(np.float64)

        last, other = None, None
        for batch in batches:
            good = []
            for a, b, ha, ca, hb, cb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ha", "ca", "hb", "cb")), strict=True):
                if b != last:
                    last, other = b, unpack(hb, cb)
                good.append(similar(unpack(ha, ca), other) >= least)
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    # few pairs fetch their texts by a broadcast of keys, whose number is counted; only those texts are shuffled
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    n = pairs.count()
    texts = texts.join(F.broadcast(keys) if n <= ONE_TASK else keys, "key", "left_semi")
    left = texts.select(F.col("key").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = texts.select(F.col("key").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    out = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(run, "a string, b string")
    return out.coalesce(max(1, -(-n // PAIRS)))


def _stars(buckets: DataFrame, major: int = 0) -> DataFrame:
    """Each text of a bucket with its representatives, where their classes differ: with ``major`` texts of the
    bucket's largest class, or with one of all its texts."""
    rows, picks = buckets, [F.min(F.struct(F.xxhash64(F.lit(0), "key").alias("o"), "key", "root"))]
    if major:
        sizes = buckets.groupBy("bucket", "root").agg(F.count("*").alias("s"))
        rows = buckets.join(sizes.groupBy("bucket").agg(F.max(F.struct("s", "root"))["root"].alias("big")), "bucket").where("root = big")
        # a weighted draw: the more large buckets a text is in, the nearer it is to the middle of its group
        u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(k), F.lit(1), "key"), 11) + 1) / float(1 << 53)
        picks = [F.min(F.struct((-F.log(u(k)) / F.pow(F.lit(2.0), F.col("degree"))).alias("o"), "key", "root")) for k in range(major)]
    chosen = rows.groupBy("bucket").agg(F.array(*picks).alias("r"))
    own = F.transform(F.filter("r", lambda x: x["root"] != F.col("root")), lambda x: x["key"])
    # buckets of one group mostly have the same representatives: a text gathers its own (eight a bucket at most) as a set
    met = buckets.join(chosen, "bucket").select("key", own.alias("r")).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("r"))).alias("r"))
    return met.select(F.col("key").alias("a"), F.explode("r").alias("b"))


def _pairs(buckets: DataFrame) -> DataFrame:
    """All pairs of different classes inside buckets, which are small."""
    right = buckets.select("bucket", F.col("key").alias("b"), F.col("root").alias("rb"))
    return buckets.join(right, "bucket").where("key < b AND root != rb").select(F.col("key").alias("a"), "b").distinct()


def prefixes(texts: DataFrame, weights, least: float) -> DataFrame:
    """The shingles of each text (key, root, hashes, counts) by one of which any text like it can be found: bucket (the hash), key,
    root, and n, left, w, left_w: the number and the weight of all the text's shingles, and of those from this one on.

    All texts put their shingles in one order, by how many of these texts have them. If two texts are similar by
    ``least``, what they share is at least that part of either, so the first shingle they share has that part of either
    text behind it or in it. Rarest first, few shingles of a text have so much behind them, and those that no other text has are left out.
    """
    common, _ = bucket_sums(texts, "hashes", lambda packed: np.frombuffer(raw(packed)[0].tobytes(), np.uint32), ORDER_BUCKETS)
    common = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hashes", 1 << 20):
            row, parts = [], []
            for i, (h, c) in enumerate(zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True)):
                h = np.frombuffer(h, np.uint32)
                w = weights.value.of(h, np.frombuffer(c, np.int32) if c else np.ones(len(h), np.int32)).astype(np.float64)
                times = common.value[h & np.uint32(ORDER_BUCKETS - 1)]
                order = np.lexsort((h, times))
                left, left_w = np.arange(len(h), 0, -1), np.cumsum(w[order][::-1])[::-1]
                near = (left >= least * len(h) - ROUNDING) | (left_w >= left_w[:1] * (least - ROUNDING))
                at = np.flatnonzero(near & (times[order] > 1))
                row.append(np.full(len(at), i))
                parts.append((h[order[at]].view(np.int32), np.full(len(at), len(h)), left[at], np.repeat(left_w[:1], len(at)), left_w[at]))
            row = pa.array(np.concatenate(row))
            h, n, left, w, left_w = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), batch.column("key").take(row), batch.column("root").take(row), pa.array(n, pa.int32()), pa.array(left, pa.int32()), pa.array(w), pa.array(left_w)],
                names=["bucket", "key", "root", "n", "left", "w", "left_w"],
            )

    return texts.select("key", "root", "hashes", "counts").mapInArrow(run, "bucket int, key string, root string, n int, left int, w double, left_w double")


def _rest(found: DataFrame, least: float) -> DataFrame:
    """All pairs of texts of different classes that can be similar by ``least``, from their prefixes().

    Two texts can be similar only if what both have from a shared shingle on is enough for it. The texts
    outside a shingle's largest class meet all its texts, dealt over cells; texts of the largest class never meet each other.
    """
    sizes = found.groupBy("bucket", "root").agg(F.count("*").alias("s"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("s", "root"))["root"].alias("big"), F.sum("s").alias("all"), F.max("s").alias("most")).where("all > most")
    cells = lambda n: F.ceil(n / CELL).cast("int")
    sizes = sizes.select("bucket", "big", cells(F.col("all") - F.col("most")).alias("down"), cells(F.col("all")).alias("across"))
    rows = stored(found.join(sizes, "bucket"))
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    named = lambda k: [F.col(c).alias(c + k) for c in ("key", "root", "n", "left", "w", "left_w")]
    left = rows.where("root != big").select("bucket", *named("_a"), own("down").alias("i"), all_("across").alias("j"))
    right = rows.select("bucket", *named("_b"), (F.col("root") == F.col("big")).alias("inner"), all_("down").alias("i"), own("across").alias("j"))
    part = least / (1 + least) - ROUNDING
    enough = (F.least("left_a", "left_b") >= part * (F.col("n_a") + F.col("n_b"))) | (F.least("left_w_a", "left_w_b") >= part * (F.col("w_a") + F.col("w_b")))
    met = left.join(right, ["bucket", "i", "j"]).where(F.expr("root_a != root_b AND (inner OR key_a < key_b)") & enough)
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def classes(docs: DataFrame, least: float = SIMILARITY, text: str = "text") -> DataFrame:
    """doc_id, key (md5 of the text) and class_id, the least doc_id of the class, for every row of ``docs``.

    Equal texts are one class, null texts and texts without words by equality alone (a null text is an empty one).
    An empty table has no rows; equal rows get equal results.

    Candidates without all pairs of a group: every text of a bucket is compared with the bucket's first
    one. Then only texts whose classes still differ matter: buckets of up to SMALL texts compare all such
    pairs; in larger ones the texts outside the largest class meet eight of its texts.
    The texts of large buckets that then still hold several classes are joined by exact prefixes of their shingles, in any bucket:
    that finds every pair of them that is similar, and the representatives only save comparisons.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    weights = docs.sparkSession.sparkContext.broadcast(frequencies(rows))
    signed = stored(signatures(rows, weights))
    once = signed.where("bands IS NOT NULL").groupBy("key").agg(F.first("bands").alias("bands"))
    flat = once.select("key", F.posexplode("bands").alias("band", "h")).withColumn("bucket", F.xxhash64("band", "h"))
    many = flat.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = together(stored(flat.join(many, "bucket").select("bucket", "n", "key")))
    keys = buckets.select("key").distinct()
    texts = stored(contents(rows, keys))
    drawn = together(stored(signed.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", "drawn")))

    def similar_pairs(pairs: DataFrame) -> DataFrame:
        return stored(verified(stored(pairs), texts, weights, least))

    roots = components(similar_pairs(likely(_stars(buckets.withColumn("root", F.col("key"))), drawn)))

    def now(b: DataFrame) -> DataFrame:
        """Buckets that hold more than one class, with the class of each text."""
        known = b.drop("root").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        mixed = known.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
        return stored(known.join(mixed, "bucket", "left_semi"))

    def link(pairs: DataFrame) -> None:
        """The classes so far, as stars, and the new links."""
        nonlocal roots
        more = similar_pairs(pairs)
        if not more.isEmpty():
            roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    left = now(buckets)
    wide = left.where(F.col("n") > SMALL)
    wide = wide.join(wide.groupBy("key").agg(F.count("*").alias("degree")), "key")
    link(likely(_pairs(left.where(F.col("n") <= SMALL)).unionByName(_stars(wide, FIRST)), drawn))
    rest = now(wide.select("bucket", "key")).select("key", "root").distinct()
    link(_rest(stored(prefixes(texts.join(rest, "key"), weights, least)), least))

    named = signed.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), "key")).alias("first"))
    return named.join(least_id, "root").select("doc_id", "key", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("class_key"))


def dedup(docs: DataFrame, least: float = SIMILARITY, text: str = "text") -> DataFrame:
    """One document of each class: the one with the least doc_id (a null id last), then the least md5."""
    first = classes(docs, least, text).select(F.col("class_id").alias("__d"), F.col("class_key").alias("__k")).distinct()
    rows = docs.withColumn("__key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).drop("__key")


def op3_near_dedup(spark, sf_dir):
    """op3: doc_id and class_id (the least doc_id of its near-duplicates) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id")
