"""Line dedup by content-defined chunks of lines, all in built-in SQL functions.

A line's hash and that of the next line with words give a rolling hash. A chunk is a longest run of lines whose
rolling hashes all occur more than once: it begins and ends where the contents stop being repeated, wherever
that lies in the text, and has two lines with words at least. The bytes decide: two lines that stand, with the
blank ones between them, at an earlier place are removed. So every run of two or more lines with words that
stands at an earlier place goes whole, and the first place of a line always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import stored

#: White space; a line of nothing else does not count as one of a chunk's lines.
BLANK = " \t\x0b\f\r"


def with_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __pairs: start, len and rolling hash of each line with words and the next one with words."""
    hashes = F.transform("__lines", lambda x: F.xxhash64(x))
    worded = F.array_compact(F.transform("__lines", lambda x, i: F.when(F.length(F.translate(x, BLANK, "")) > 0, i)))
    spans = F.transform("__worded", lambda s, k: F.struct(s.alias("start"), (F.get("__worded", k + 1) + 1 - s).alias("len")))
    pairs = F.transform(F.filter(spans, lambda c: c["len"].isNotNull()), lambda c: c.withField("hash", F.xxhash64(F.slice("__hash", c["start"] + 1, c["len"]))))
    out = docs.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    return out.withColumn("__hash", hashes).withColumn("__worded", worded).withColumn("__pairs", pairs).drop("__hash", "__worded")


def _runs(pairs: Column) -> Column:
    """The sorted, overlapping ``pairs`` (start, len) as spans that are apart: pairs that share a line are one."""
    end = lambda p: p["start"] + p["len"]
    begins = F.filter(pairs, lambda p, k: (k == 0) | (p["start"] >= end(F.get(pairs, k - 1))))
    ends = F.filter(pairs, lambda p, k: (k == F.size(pairs) - 1) | (F.get(pairs, k + 1)["start"] >= end(p)))
    return F.zip_with(begins, ends, lambda b, e: F.struct(b["start"].alias("start"), (end(e) - b["start"]).alias("len")))


def _cut(lines: Column, spans: Column) -> Column:
    """``lines`` without the given spans (sorted, apart), as one text."""
    gaps = F.transform(
        spans,
        lambda s, k: _between(lines, F.coalesce(F.get(spans, k - 1)["start"] + F.get(spans, k - 1)["len"], F.lit(0)), s["start"]),
    )
    tail = _between(lines, F.element_at(spans, -1)["start"] + F.element_at(spans, -1)["len"], F.size(lines))
    return F.array_join(F.concat(F.flatten(gaps), tail), "\n")


def _between(lines: Column, a: Column, b: Column) -> Column:
    return F.slice(lines, a + 1, b - a)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __key, the id and the md5 of the text: an id alone may occur twice."""
    return docs.withColumn("__key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """What to remove: __key and __spans, sorted, for each document of ``docs`` (with __key) that loses lines.

    Pairs of lines meet by rolling hash first; those whose hash repeats are then grouped by their bytes. The first place is
    the least (doc_id, md5 of the text, line), a null id first. Both groupings combine before the shuffle.
    """
    # an outer explode, whose rows are filtered after it: no filter on the pairs is pushed below their projections
    found = with_pairs(docs.select("__key", text), text).select("__key", F.explode_outer("__pairs").alias("c"))
    found = stored(found.select("__key", "c.start", "c.len", "c.hash").where("hash IS NOT NULL"))
    # stored, so that both sides of the join are plain exchanges, whose hot partitions can be split
    twice = stored(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    places = found.join(twice, "hash", "left_semi").groupBy("__key").agg(F.collect_set(F.struct("start", "len", "hash")).alias("places"), F.count("*").alias("n"))
    # equal rows are one key here; n / size(places) of them exist
    places = places.select("__key", "places", (F.col("n") / F.size("places")).cast("long").alias("n"))
    own = docs.select("doc_id", text, "__key").join(places, "__key").dropDuplicates(["__key"]).withColumn("__lines", F.split(text, "\n"))
    own = own.select("doc_id", F.right("__key", F.lit(32)).alias("__md5"), "__key", "n", "__lines", F.explode("places").alias("p"))
    place = F.struct("doc_id", "__md5", "p.start", "p.len")
    whole = F.array_join(F.slice("__lines", F.col("p.start") + 1, F.col("p.len")), "\n")
    # not stored: its two uses and the caller's join share one exchange of the documents, the largest of all
    same = own.select("__key", F.col("p.hash").alias("hash"), whole.alias("bytes"), place.alias("place"), "n")
    groups = same.groupBy("hash", "bytes").agg(F.min("place").alias("first"), F.sum("n").alias("n")).where("n > 1")
    # a SHA-256 stands for the bytes from here on: within a hash, groups differ in it
    groups = groups.select("hash", F.sha2("bytes", 256).alias("sha"), "first")
    again = same.select("__key", "hash", F.sha2("bytes", 256).alias("sha"), "place").join(groups, ["hash", "sha"]).where(~F.col("place").eqNullSafe(F.col("first")))
    gone = again.groupBy("__key").agg(F.array_sort(F.collect_set(F.struct("place.start", "place.len"))).alias("__gone"))
    return gone.select("__key", _runs(F.col("__gone")).alias("__spans"))


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks of lines cut from ``text``, and n_lines and n_removed_lines (long) of the input text.

    A null text stays null and has 0 lines; an empty one has 1. Rows that are equal in id and text share
    their fate: if one holds the first place, all keep it. New columns replace those of the same names.
    """
    docs = docs.drop("n_lines", "n_removed_lines")
    rows = _keyed(docs, text)
    rows = rows.join(repeated(rows, text), "__key", "left")
    rows = rows.withColumn("__lines", F.split(F.col(text), "\n"))
    lines = F.col("__lines")
    removed = F.aggregate("__spans", F.lit(0), lambda n, s: n + s["len"])
    rows = rows.withColumn("n_lines", F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long"))
    rows = rows.withColumn("n_removed_lines", F.coalesce(removed, F.lit(0)).cast("long"))
    kept = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(_cut(lines, F.col("__spans")))
    return rows.withColumn(text, kept).drop("__key", "__lines", "__spans")


def op5_line_dedup(spark, sf_dir):
    """op5: doc_id, n_lines, n_removed_lines and the SHA-256 of the kept text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS m, string_split(coalesce(text, ''), chr(10)) AS l, text IS NULL AS none FROM documents),
w AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^ \t\x0b\f\r]')) AS w FROM d),
p AS (SELECT doc_id, m, l[w[k]:w[k + 1]] AS own, w[k] AS s, w[k + 1] AS e FROM (SELECT *, unnest(range(1, len(w))) AS k FROM w)),
f AS (SELECT *, min((doc_id, m, s)) OVER (PARTITION BY own) AS first FROM p),
gone AS (SELECT DISTINCT doc_id, m, unnest(range(s, e + 1)) AS i FROM f WHERE (doc_id, m, s) <> first),
x AS (SELECT doc_id, m, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, m, string_agg(x, chr(10) ORDER BY i) AS t, count(*) AS n FROM x
  WHERE NOT EXISTS (FROM gone WHERE gone.doc_id = x.doc_id AND gone.m = x.m AND gone.i = x.i) GROUP BY doc_id, m)
SELECT d.doc_id, CAST(CASE WHEN none THEN 0 ELSE len(l) END AS BIGINT) AS n_lines,
       CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_removed_lines, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id AND kept.m = d.m
"""
