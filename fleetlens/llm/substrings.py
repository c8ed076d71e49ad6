"""Removal of repeated passages by super-k-mers.

A window is k consecutive words. Its minimiser is the least hash of the m-word runs in it (the leftmost of
equal ones), so equal windows have equal minimisers at the same place. Consecutive windows that share a
minimiser are one super-k-mer. Super-k-mers whose minimiser occurs once hold no repeated window; the others
travel as one packed string to their minimiser's bucket, where their windows are sorted and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import Words, extended, slices
from fleetlens.session import stored

K, M = 35, 6
#: Packed strings of one minimiser that are sorted in one piece; beyond it, windows are counted as rows of their own.
HOT = 20_000
#: Bytes of packed strings that are sorted at a time, if a minimiser has no more.
PIECE = 4 << 20


def super_kmers(words: Words, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(index of the first word, windows, minimiser, its place after the first word) of each super-k-mer."""
    none = np.zeros(0, np.int64)
    hashes = words.hashes()
    n = len(hashes) - k + 1
    if n < 1:
        return none, none, none.astype(np.uint64), none
    # runs of m words that cross rows are in no window
    mers = np.full(len(hashes) - m + 1, 2**64 - 1, np.uint64)
    got, at = words.windows(hashes, m)
    mers[at] = got
    # the upper 36 bits choose, then the place; this is a function of the window's words alone
    key = mers & np.uint64(2**64 - 2**28) | np.arange(len(mers), dtype=np.uint64)
    width, have = k - m + 1, 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    place = (key & np.uint64(2**28 - 1)).astype(np.int64)
    valid = words.row[:n] == words.row[k - 1 :]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (words.row[1:n] != words.row[: n - 1])))
    first = np.flatnonzero(valid & (new | np.concatenate(([True], ~valid[:-1]))))
    ends = np.flatnonzero(valid & np.concatenate((new[1:] | ~valid[1:], [True])))
    return first, ends - first + 1, mers[place[first]], place[first] - first


def _find(k: int, m: int):
    """The different minimisers of each row, and how many super-k-mers have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            w = Words(batch.column("text"))
            first, _, minimiser, _ = super_kmers(w, k, m)
            row = w.row[first]
            order = np.lexsort((minimiser, row))
            row, minimiser = row[order], minimiser[order]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (minimiser[1:] != minimiser[:-1])))[: len(row)])
            own = [batch.column(c).take(pa.array(row[new])) for c in ("doc_id", "th")]
            times = np.diff(np.append(new, len(row))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*own, pa.array(minimiser[new].view(np.int64)), pa.array(times)], names=["doc_id", "th", "minimiser", "times"])

    return run


def _pack(k: int, m: int):
    """The super-k-mers of each row that have one of its minimisers to look at, as packed strings: words, one space between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            w = Words(batch.column("text"))
            first, windows, minimiser, _ = super_kmers(w, k, m)
            row, minimiser = w.row[first], minimiser.view(np.int64)
            wanted = batch.column("minimisers")
            keep = np.zeros(len(first), bool)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                keep[a:b] = np.isin(minimiser[a:b], wanted[i].values.to_numpy())
            first, windows, row, minimiser = first[keep], windows[keep], row[keep], minimiser[keep]
            data = w.buf.tobytes()
            spans = zip(w.start[first].tolist(), w.end[first + windows + k - 2].tolist(), strict=True)
            packed = [b" ".join(data[a:b].split()) for a, b in spans]
            own = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array((first - w.first[row]).astype(np.int32)), pa.array(minimiser), pa.array(packed, pa.binary())],
                names=["doc_id", "th", "first", "minimiser", "packed"],
            )

    return run


def _repeats(packed: pa.Array, minimiser: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, place of the window in it) of all windows that occur twice or more in these strings.

    Windows are sorted by hash inside their minimiser; those of equal hash are then compared by their bytes.
    """
    w = Words(packed.cast(pa.string(), safe=False) if pa.types.is_binary(packed.type) else packed)
    window, at = w.windows(w.hashes(), k)
    string = w.row[at]
    order = np.lexsort((window, minimiser[string]))
    window, at, string = window[order], at[order], string[order]
    m = minimiser[string]
    group = np.cumsum(np.concatenate(([True], (window[1:] != window[:-1]) | (m[1:] != m[:-1])))) - 1
    times = np.bincount(group, weights=n[string])
    many = np.bincount(group)
    twice = times[group] > 1
    # a group of several strings: all must be the same bytes; else (hashes collided) count by bytes
    buf, lo, hi = w.buf.tobytes(), w.start[at], w.end[at + k - 1]
    check = np.flatnonzero(twice & (many[group] > 1))
    if len(check):
        g = group[check]
        seen: dict[int, bytes] = {}
        odd = {x for x, a, b in zip(g.tolist(), lo[check].tolist(), hi[check].tolist(), strict=True) if seen.setdefault(x, buf[a:b]) != buf[a:b]}
        for x in odd:
            own = check[g == x]
            by: dict[bytes, float] = {}
            for i in own:
                by[buf[lo[i] : hi[i]]] = by.get(buf[lo[i] : hi[i]], 0) + n[string[i]]
            twice[own] = [by[buf[lo[i] : hi[i]]] > 1 for i in own]
    return string[twice], at[twice] - w.first[string[twice]]


def _count(k: int):
    """Sort and count in a bucket whose rows come ordered by minimiser; (minimiser, sid, places) out."""

    def piece(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        minimiser, n = t["minimiser"].to_numpy(), t["n"].to_numpy()
        string, place = _repeats(t["packed"].chunk(0), minimiser, n, k)
        order = np.lexsort((place, string))
        string, place = string[order], place[order]
        which, begin = np.unique(string, return_index=True)
        offsets = np.append(begin, len(string)).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(minimiser[which]), t["sid"].chunk(0).take(pa.array(which)), places], names=["minimiser", "sid", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > PIECE:
                # all but the last minimiser, which may go on in the next batch
                m = batch.column("minimiser").to_numpy()
                cut = int(np.flatnonzero(m != m[-1])[-1]) + 1 if m[0] != m[-1] else 0
                if cut:
                    yield piece([*held[:-1], batch.slice(0, cut)])
                    held = [batch.slice(cut)]
                    size = held[0].nbytes
        if held:
            yield piece(held)

    return run


def _explode(k: int):
    """(minimiser, sid, place, window) of all windows of packed strings, a window as 128 bits of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in slices(batches, "packed", 1 << 20):
            w = Words(batch.column("packed").cast(pa.string(), safe=False))
            _, at = w.windows(w.hashes(), k)
            buf = w.buf.tobytes()
            digest = [blake2b(buf[a:b], digest_size=16).digest() for a, b in zip(w.start[at].tolist(), w.end[at + k - 1].tolist(), strict=True)]
            row = w.row[at]
            own = [batch.column(c).take(pa.array(row)) for c in ("minimiser", "sid", "n")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array((at - w.first[row]).astype(np.int32)), pa.array(digest, pa.binary())], names=["minimiser", "sid", "n", "place", "window"]
            )

    return run


def repeated(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """doc_id, th (xxhash64 of the text) and starts (places of the windows that occur elsewhere) for the
    documents of ``docs`` (doc_id, th, text) that have any."""
    found = stored(docs.mapInArrow(_find(k, m), _row_type(docs, "minimiser long, times int")))
    # stored, so that both sides of the join are plain exchanges, whose hot partitions can be split
    twice = stored(found.groupBy("minimiser").agg(F.sum("times").alias("n")).where("n > 1").select("minimiser"))
    spots = found.join(twice, "minimiser", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("minimiser").alias("minimisers"))
    spots = spots.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    own = docs.join(spots, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("doc_id", "th", "text", "minimisers")
    packed = own.mapInArrow(_pack(k, m), _row_type(docs, "first int, minimiser long, packed binary"))
    packed = stored(packed.withColumn("sid", F.xxhash64("packed")))
    # copies of a string are one row from here on, combined before the shuffle
    strings = stored(packed.groupBy("minimiser", "sid", "packed").agg(F.count("*").alias("n")))
    many = strings.groupBy("minimiser").agg(F.count("*").alias("strings")).where(F.col("strings") > hot).select("minimiser")
    cold = strings.join(many, "minimiser", "left_anti").repartition("minimiser").sortWithinPartitions("minimiser")
    counted = cold.mapInArrow(_count(k), "minimiser long, sid long, places array<int>")
    windows = strings.join(many, "minimiser", "left_semi").mapInArrow(_explode(k), "minimiser long, sid long, n long, place int, window binary")
    same = windows.groupBy("minimiser", "window").agg(F.sum("n").alias("times")).where("times > 1").select("minimiser", "window")
    apart = windows.join(same, ["minimiser", "window"], "left_semi").groupBy("minimiser", "sid").agg(F.collect_list("place").alias("places"))
    places = packed.drop("packed").join(counted.unionByName(apart), ["minimiser", "sid"])
    starts = F.transform("places", lambda x: x + F.col("first"))
    return places.select("doc_id", "th", starts.alias("s")).groupBy("doc_id", "th").agg(F.flatten(F.collect_set("s")).alias("starts"))


def _row_type(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, {rest}"


def remove_repeats(docs: DataFrame, text: str = "text", k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """``docs`` with ``text`` as its kept words, one space between them, and n_words and n_removed (long).

    A word goes if a window of k words that covers it also starts anywhere else, in the same document
    included; windows are judged on the input. A null text gives an empty one; a text of fewer than k words
    loses none; equal rows are occurrences of each other. Columns of the new names are replaced.
    """
    docs = docs.drop("n_words", "n_removed")
    keyed = docs.withColumn("__th", F.xxhash64(text))
    gone = repeated(keyed.select("doc_id", F.col("__th").alias("th"), F.col(text).alias("text")), k, m, hot)
    gone = gone.withColumnsRenamed({"doc_id": "__d", "th": "__t", "starts": "__starts"})
    rows = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left").drop("__d", "__t", "__th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            kept, n_words, n_removed = [], [], []
            for t, starts in zip(batch.column(text).to_pylist(), batch.column("__starts"), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + k, minlength=n + 1)
                    stays = np.cumsum(edge[:n]) == 0
                    words = [x for x, s in zip(words, stays.tolist(), strict=True) if s]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                n_words.append(n)
                n_removed.append(n - len(words))
            out = {c: batch.column(c) for c in batch.schema.names if c != "__starts"}
            out |= {text: pa.array(kept, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(run, extended(docs.schema, n_words="long", n_removed="long"))


def op9_substring_dedup(spark, sf_dir):
    """op9: doc_id, n_words, n_removed and the SHA-256 of the kept words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS own FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
t AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY own) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS p FROM t),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
