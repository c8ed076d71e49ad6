"""Quality rules as a short-circuit cascade, all in built-in SQL functions.

The signals that every caller gets are computed once per row. The further rules are a conjunction, so
their order changes only the work: each rule's cost and rejections are measured on a sample, and a
``CASE`` evaluates them by rejections per second, stopping at the first that rejects.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import stored

#: The white space between words (fixed value).
SPACE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows that costs and selectivity are estimated on (order only; no verdict depends on it).
SAMPLE = 512


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), chars, "")


def _covered(w: Column) -> Column:
    """Words of ``w`` inside windows that occur twice or more in it; windows are compared as strings."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(WINDOW)), " ").alias("s"), i.alias("i"))
    )
    # equal windows are neighbours after sorting; s is bound once by the outer transform
    twice = F.transform(
        F.array(F.array_sort(windows)),
        lambda s: F.array_sort(
            F.transform(
                F.filter(
                    s,
                    lambda x, k: ((k > 0) & (F.get(s, k - 1)["s"] == x["s"])) | F.coalesce(F.get(s, k + 1)["s"] == x["s"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )[0]
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(twice, start, step, lambda acc: acc["n"])


def _hashes(w: Column) -> Column:
    """A hash of each window, from the hashes of its words."""
    each = F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW)))))
    return each[0]


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed; columns of
    these names are replaced.

    A null or empty text has 0 of each and fails. Rows don't see each other, so ties, repeated rows and empty
    tables need no rule. One pass without a shuffle; a task holds one row's windows.
    """
    t = F.col(text)
    lines = F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    names = ("__words", "__lines", "__hashes")
    out = (
        docs.withColumns({"__words": words(t), "__lines": lines})
        .withColumn("__hashes", F.when(F.size("__words") > WINDOW, _hashes(F.col("__words"))))
        .withColumns(
            {
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.length(without(t, SPACE)).cast("long"),
                "n_symbols": (F.length(F.coalesce(t, F.lit(""))) - F.length(without(t, SYMBOLS))).cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                # a text without two equal hashes has no repeated window; the others are compared exactly
                "n_repeat_words": F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), _covered(F.col("__words"))).otherwise(0).cast("long"),
                "__n_lines": F.size("__lines"),
            }
        )
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(*names)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a row to drop; it reads the text and the signals."""

    name: str
    rejects: Column


def default_rules(text: str = "text") -> list[Rule]:
    t = F.coalesce(F.col(text), F.lit(""))
    w = words(F.col(text))
    pairs = F.transform(F.array(w), lambda x: F.size(F.filter(x, lambda y, i: (i > 0) & (F.get(x, i - 1) == y))))[0]
    return [
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 16 * F.col("n_words"))),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("__n_lines")),
        Rule("upper_case", 10 * (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))) > 4 * F.length(t)),
        Rule("letters", 10 * F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))) < 4 * F.col("n_words")),
        Rule("stutter", 5 * pairs > F.col("n_words")),
    ]


def ordered(few: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejected rows per second on the sample ``few`` (with signals)."""
    few = few.where(~F.col("base_failed"))

    def run(what: Column) -> tuple[float, int]:
        began = time.perf_counter()
        n = few.agg(F.count_if(what)).first()[0]
        return time.perf_counter() - began, n

    run(F.lit(False))
    empty = min(run(F.lit(False))[0] for _ in range(2))
    score = {}
    for r in rules:
        took, n = min(run(r.rejects) for _ in range(2))
        score[r.name] = (n + 0.5) / max(took - empty, 1e-3)
    return sorted(rules, key=lambda r: (-score[r.name], r.name))


def cascade(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with rejected_by: ``base``, the name of the first rule that rejects, or null; and kept."""
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        verdict = verdict.when(r.rejects, F.lit(r.name))
    return rows.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Signals and the verdict of the default rules for every row of ``docs``."""
    rules = default_rules(text)
    # stored: a filter on signals that are still to be computed would be pushed below them and compute them twice
    few = stored(with_signals(docs.select(text).limit(SAMPLE), text))
    return cascade(with_signals(docs, text), ordered(few, rules)).drop("__n_lines")


def op2_quality(spark, sf_dir):
    """op2: the signals of every document, base_failed and kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
starts AS (
  SELECT doc_id, t, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (
  SELECT doc_id, t, i, lead(i) OVER (PARTITION BY doc_id, t ORDER BY i) AS nxt
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t, s) AS n FROM starts) WHERE n > 1),
covered AS (SELECT doc_id, t, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM twice GROUP BY ALL),
s AS (
  SELECT w.doc_id, w.t, w.w, w.l, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(w.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(regexp_extract_all(w.t, '\p{Lu}')) AS upper, length(w.t) AS chars,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS pairs
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.t = c.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > len(l) OR 10 * upper > 4 * chars OR 10 * lettered < 4 * n_words
            OR 5 * pairs > n_words) AS kept
FROM s
"""
