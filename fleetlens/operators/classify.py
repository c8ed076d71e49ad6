"""Failure classification of free text against the taxonomy.

score = w_kw * keyword overlap + w_sim * text similarity + w_sys * same system + w_comp * same component

* keyword overlap is Spark work: the description's distinct words and the
  taxonomy keywords are exploded and equi-joined on the word (no cross join),
  counted per (description, taxonomy row);
* the similarity (Ratcliff-Obershelp ratio, as ``difflib``) has no native
  equivalent: an Arrow ``pandas_udf`` scores each *distinct* normalised
  description against the taxonomy's standard descriptions, one block of the
  catalogue at a time. ``Matcher`` below is an exact re-implementation
  whose inner search uses C-level ``str.find`` instead of a Python loop over
  every character of a long text, and keeps what parts of standard descriptions
  match: they share their words;
* the best row needs few similarities: a row's score is bounded above by its keyword part, its bonuses and the
  characters that both texts share, so rows are scored from the highest bound down until no bound reaches the best
  score found (``best_candidates``; ties: first in system, component, mode order). ``candidates`` scores every
  pair, for a review queue that lists them all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import normalize_text


# ------------------------------------------------------------------ similarity
class Matcher:
    """Ratcliff-Obershelp ratios of one text to many short ones.

    What a part of a short text matches inside a span of the long text does not depend on the rest of the short text, so
    it is kept: catalogue texts share their words, and each shared part is looked for once. Spans and parts come from
    the catalogue's texts alone, so that the memory of a text's matches does not grow with the table."""

    def __init__(self, text: str):
        self.text = text
        self.at: dict[tuple[int, int], dict[str, int]] = {}
        self.done: dict[tuple[int, int], dict[str, int]] = {}

    def matched(self, part: str, lo: int, hi: int) -> int:
        """Characters that difflib (without junk) matches between ``part`` and the text from ``lo`` to ``hi``."""
        if not part or lo >= hi:
            return 0
        done = self.done.setdefault((lo, hi), {})
        got = done.get(part)
        if got is not None:
            return got
        at, find = self.at.setdefault((lo, hi), {}), self.text.find
        size, i, j = 0, -1, 0  # the longest common block, earliest in the text, then in the part
        n = len(part)
        for start in range(n):
            end = start + (size or 1)
            if end > n:
                break
            piece = part[start:end]
            pos = at.get(piece)
            if pos is None:
                pos = at[piece] = find(piece, lo, hi)
            if pos < 0:
                continue
            if not size or pos < i:
                size, i, j = end - start, pos, start
            while end < n:
                end += 1
                piece = part[start:end]
                pos = at.get(piece)
                if pos is None:
                    pos = at[piece] = find(piece, lo, hi)
                if pos < 0:
                    break
                size, i, j = end - start, pos, start
        if size:
            size += self.matched(part[:j], lo, i) + self.matched(part[j + size:], i + size, hi)
        done[part] = size
        return size

    def ratio(self, b: str) -> float:
        """``SequenceMatcher(None, text, b).ratio()``."""
        both = len(self.text) + len(b)
        if both == 0:
            return 1.0
        if len(b) >= 200:  # difflib's automatic junk heuristic applies: defer to it
            return SequenceMatcher(None, self.text, b).ratio()
        return 2.0 * self.matched(b, 0, len(self.text)) / both


def ratio(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b).ratio()`` for any a; exact re-implementation when b is short."""
    return Matcher(a).ratio(b)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def similarity_udf(desc: pd.Series, stds: pd.Series) -> pd.Series:
    """Arrow UDF: a description and standard descriptions -> the similarity to each of them. The blocks of one description
    follow each other and share its matcher."""
    out, text = [], None
    for d, std in zip(desc, stds, strict=True):
        if text is None or text.text != (d or ""):
            text = Matcher(d or "")
        out.append([text.ratio(s) for s in std])
    return pd.Series(out)


# ------------------------------------------------------------------ catalogue
def catalogue(tax: DataFrame, modes: DataFrame) -> DataFrame:
    """Taxonomy rows with their keyword sets; rows whose mode has no keyword are dropped."""
    kw = F.filter(F.array_distinct(F.transform(F.split(F.lower(F.coalesce("palabras_claves", F.lit(""))), ","),
                                               lambda x: F.trim(x))), lambda x: x != "")
    m = modes.select("id_modo_falla", "modo", kw.alias("keywords"))
    return tax.join(m, "id_modo_falla", "left").filter(F.size(F.coalesce("keywords", F.array())) > 0) \
        .select("taxonomia_id", "sistema", "componente", "id_modo_falla", "modo", "descripcion_estandar", "keywords")


#: Catalogue rows that one similarity call scores a description against.
BLOCK = 256


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def candidates(orders: DataFrame, cat: DataFrame, weights: Sequence[float] = (0.50, 0.30, 0.10, 0.10),
               text_col: str = "descripcion_falla", id_col: str = "ot_id") -> DataFrame:
    """All candidates with a positive score, as rows: order, taxonomy row, score and hit words.

    ``orders`` may carry ``sistema_actual``/``componente_actual`` (schema V1) for the bonuses. The catalogue is cut
    into blocks of about ``BLOCK`` rows by a hash of the id, and every distinct description meets every block once:
    nothing depends on the catalogue's total size, and a description's scores are spread over its blocks."""
    w_kw, w_sim, w_sys, w_comp = weights
    o = orders.select(F.col(id_col).alias("oid"), normalize_text(text_col).alias("desc_norm"),
                      *[F.col(c) for c in ("sistema_actual", "componente_actual") if c in orders.columns])
    # distinct descriptions are keyed by their SHA-256 so that joins and shuffles move 32 bytes, not the text; they are few
    # bytes for much work, so they are dealt over all shuffle partitions, which are not merged by their size
    o = o.withColumn("dkey", F.sha2("desc_norm", 256))
    distinct = o.select("dkey", "desc_norm").repartition(_partitions(orders), "dkey").dropDuplicates(["dkey"])
    size = cat.count()
    n_blocks = max(1, -(-size // BLOCK))
    # the keywords of an id, over all of its rows; a row without an id has no hits
    by_id = cat.filter(F.col("taxonomia_id").isNotNull()).groupBy("taxonomia_id").agg(F.sort_array(F.flatten(F.collect_list("keywords"))).alias("words"))
    row = F.struct("taxonomia_id", "sistema", "componente", "id_modo_falla", "modo", F.size("keywords").alias("n_kw"), "words",
                   normalize_text("descripcion_estandar").alias("std"))
    blocks = cat.join(by_id, "taxonomia_id", "left").groupBy(F.pmod(F.xxhash64("taxonomia_id"), F.lit(n_blocks)).cast("int").alias("block")) \
        .agg(F.collect_list(row).alias("rows"))
    # a counted, small catalogue is broadcast; a larger one has blocks enough for a join on them
    blocks = F.broadcast(blocks) if size <= PASS else blocks
    asked = distinct.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")
    sims = asked.select("dkey", "block", similarity_udf(F.col("desc_norm"), F.transform("rows", lambda r: r["std"])).alias("sims"))
    # keyword overlap: equi-join on the word; what meets the pairs is the keywords that a description has
    words = distinct.select("dkey", F.explode(F.array_distinct(F.split("desc_norm", " "))).alias("w"))
    known = words.join(cat.select(F.explode("keywords").alias("w")).distinct(), "w").groupBy("dkey").agg(F.collect_list("w").alias("present"))
    # the orders meet a block's similarities as one array: pairs are made last and never shuffled
    j = o.drop("desc_norm").join(sims, "dkey").join(known, "dkey", "left").join(blocks, "block")
    j = j.withColumn("x", F.explode(F.arrays_zip(F.col("rows"), F.col("sims").alias("sim")))).drop("rows", "sims")
    j = j.select(*[c for c in j.columns if c not in ("x", "block")], "x.rows.*", F.col("x.sim").alias("sim")).drop("std")
    present = F.coalesce("present", F.array().cast("array<string>"))
    j = j.withColumn("hit_words", F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.array_contains(present, w)))
    j = j.withColumn("n_hit", F.size("hit_words")).drop("words", "present")
    score = F.col("n_hit") / F.col("n_kw") * w_kw + F.col("sim") * w_sim
    if "sistema_actual" in o.columns:
        score = score + F.when(normalize_text("sistema_actual") == normalize_text("sistema"), w_sys).otherwise(0.0)
    if "componente_actual" in o.columns:
        score = score + F.when(normalize_text("componente_actual") == normalize_text("componente"), w_comp).otherwise(0.0)
    return j.withColumn("score", score).filter(F.col("score") > 0).select(
        F.col("oid").alias(id_col), "taxonomia_id", "sistema", "componente", "id_modo_falla", "modo", "score", "hit_words")


#: Catalogue rows that are sent to the tasks at once; a longer catalogue takes several passes.
PASS = 20_000
BEST = ("taxonomia_id string, sistema string, componente string, id_modo_falla long, modo string, score double, "
        "hit_words array<string>, evaluated long")


class Bounded:
    """A catalogue block, in tie order, prepared for exact best-row searches."""

    def __init__(self, rows: Sequence[dict], weights: Sequence[float]):
        self.rows, self.weights = rows, weights
        self.stds = [r["std"] for r in rows]
        self.lengths = np.array([len(x) for x in self.stds], np.int64)
        letters = sorted(set("".join(self.stds)))
        self.letters = letters
        self.counts = np.array([[c.get(x, 0) for x in letters] for c in map(Counter, self.stds)], np.int64).reshape(len(rows), len(letters))
        self.by_word: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for w in r["keywords"]:
                self.by_word.setdefault(w, []).append(i)
        self.n_kw = np.array([len(r["keywords"]) for r in rows], np.int64)
        self.system, self.component = ([r[c] for r in rows] for c in ("_sys", "_comp"))

    def search(self, desc: str, system: str | None, component: str | None) -> tuple[int, float, list[str], int] | None:
        """(row, score, keyword hits, similarities computed) of the best row with a positive score.

        ``ratio`` is at most 2 x the characters in common / the characters of both, so a row whose bound is below the
        best score can be neither better nor equal."""
        w_kw, w_sim, w_sys, w_comp = self.weights
        words = set(desc.split(" "))
        hits = np.zeros(len(self.rows), np.int64)
        for w in words:
            for i in self.by_word.get(w, ()):
                hits[i] += 1
        own = hits / self.n_kw * w_kw
        bonus = [(w_sys if system is not None and x == system else 0.0, w_comp if component is not None and y == component else 0.0)
                 for x, y in zip(self.system, self.component, strict=True)]
        have = Counter(desc)
        common = np.minimum(self.counts, np.array([have[x] for x in self.letters], np.int64)).sum(axis=1)
        both = self.lengths + len(desc)
        sim = np.where(both > 0, 2.0 * common / np.maximum(both, 1), 1.0)
        # rounding must not push a bound below the score that it bounds
        bound = own + sim * w_sim + np.array([x + y for x, y in bonus]) + 1e-9
        best, at, done, text = 0.0, -1, 0, Matcher(desc)
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < best:
                break
            s = text.ratio(self.stds[i]) * w_sim if w_sim else 0.0
            done += bool(w_sim)
            score = float(own[i]) + s
            score = score + bonus[i][0]
            score = score + bonus[i][1]
            if score > best or (score == best and score > 0 and i < at):
                best, at = score, int(i)
        if at < 0:
            return None
        return at, best, sorted(w for w in words if at in self.by_word.get(w, ())), done


def best_candidates(orders: DataFrame, cat: DataFrame, weights: Sequence[float] = (0.50, 0.30, 0.10, 0.10),
                    text_col: str = "descripcion_falla", id_col: str = "ot_id") -> DataFrame:
    """The best row of ``candidates`` for each order, with ``evaluated``, the similarities that its search computed.

    The catalogue is read in passes of ``PASS`` rows, each sent to the tasks as it is; distinct descriptions are searched
    where they are, without a join, and the passes' winners meet in a grouped minimum."""
    actual = [c for c in ("sistema_actual", "componente_actual") if c in orders.columns]
    o = orders.select(F.col(id_col).alias("oid"), normalize_text(text_col).alias("desc_norm"), *[normalize_text(c).alias(c) for c in actual])
    o = o.withColumn("dkey", F.sha2(F.to_json(F.struct("desc_norm", *actual)), 256))
    asked = o.drop("oid").repartition(_partitions(orders), "dkey").dropDuplicates(["dkey"]).select("dkey", "desc_norm", *[F.col(c) if c in actual else F.lit(None).cast("string").alias(c)
                                                                               for c in ("sistema_actual", "componente_actual")])
    order = ["sistema", "componente", "id_modo_falla", "taxonomia_id", "modo"]
    rows = cat.select(*order, "keywords", normalize_text("descripcion_estandar").alias("std"), normalize_text("sistema").alias("_sys"),
                      normalize_text("componente").alias("_comp"))
    n = max(1, -(-rows.count() // PASS))
    part = F.pmod(F.xxhash64("taxonomia_id"), F.lit(n))
    found = None
    for k in range(n):
        block = [r.asDict() for r in rows.filter(part == k).orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()]  # about PASS rows

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            search = Bounded(block, weights)
            for batch in batches:
                keys, won = [], {c: [] for c in (*order, "score", "hit_words", "evaluated")}
                for key, desc, system, component in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    got = search.search(desc, system, component)
                    if got:
                        keys.append(key)
                        for c in order:
                            won[c].append(block[got[0]][c])
                        for c, v in zip(("score", "hit_words", "evaluated"), got[1:], strict=True):
                            won[c].append(v)
                names = ("taxonomia_id", "sistema", "componente", "id_modo_falla", "modo", "score", "hit_words", "evaluated")
                kinds = (*[pa.string()] * 3, pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(won[c], t) for c, t in zip(names, kinds, strict=True))], names=["dkey", *names])

        one = asked.mapInArrow(run, "dkey string, " + BEST)
        found = one if found is None else found.unionByName(one)
    first = F.min(F.struct((-F.col("score")).alias("neg"), *order, "hit_words"))
    best = found.groupBy("dkey").agg(first.alias("b"), F.sum("evaluated").alias("evaluated"))
    return o.join(best, "dkey").select(F.col("oid").alias(id_col), "b.taxonomia_id", "b.sistema", "b.componente", "b.id_modo_falla", "b.modo",
                                       (-F.col("b.neg")).alias("score"), "b.hit_words", "evaluated")


def classify(orders: DataFrame, cat: DataFrame, weights: Sequence[float] = (0.50, 0.30, 0.10, 0.10),
             text_col: str = "descripcion_falla", id_col: str = "ot_id", scored: DataFrame | None = None) -> DataFrame:
    """Best taxonomy row per order with confidence and reason (ties: first in system, component, mode order).

    ``scored`` takes rows of ``candidates`` or ``best_candidates`` where they are already there; the latter otherwise.
    The best row is a grouped minimum, combined before the shuffle."""
    scored = best_candidates(orders, cat, weights, text_col, id_col) if scored is None else scored
    first = F.min(F.struct((-F.col("score")).alias("neg"), "sistema", "componente", "id_modo_falla", "taxonomia_id", "modo", "hit_words"))
    best = scored.groupBy(F.col(id_col).alias("oid")).agg(first.alias("b"))
    conf = -F.col("b.neg")
    motivo = F.concat(F.lit("Clasificado automático (score: "), F.format_number(conf, 2), F.lit(", palabras: "),
                      F.array_join(F.slice("b.hit_words", 1, 3), ", "), F.lit(")"))
    res = best.select("oid", "b.taxonomia_id", "b.sistema", "b.componente", "b.modo", F.round(conf, 12).alias("confianza"), motivo.alias("motivo"))
    out = orders.select(F.col(id_col).alias("oid")).join(res, "oid", "left")
    return out.select(F.col("oid").alias(id_col), "taxonomia_id", "sistema", "componente", "modo",
                      F.coalesce("confianza", F.lit(0.0)).alias("confianza"),
                      F.coalesce("motivo", F.lit("Sin coincidencias en taxonomía")).alias("motivo"))


def keyword_candidates(orders: DataFrame, cat: DataFrame, text_col: str = "descripcion_falla",
                       id_col: str = "ot_id") -> DataFrame:
    """C1 keyword part alone: per (order, taxonomy row) with >= 1 keyword hit, hits and overlap score."""
    o = orders.select(F.col(id_col).alias("oid"), normalize_text(text_col).alias("desc_norm"))
    words = o.select("oid", F.explode(F.array_distinct(F.split("desc_norm", " "))).alias("w"))
    kws = cat.select("taxonomia_id", F.size("keywords").alias("n_kw"), F.explode("keywords").alias("w"))
    g = words.join(kws, "w").groupBy("oid", "taxonomia_id", "n_kw").agg(F.count(F.lit(1)).alias("n_hit"))
    return g.select(F.col("oid").alias(id_col), "taxonomia_id", "n_hit",
                    F.round(F.col("n_hit") / F.col("n_kw"), 12).alias("score_palabras"))


def route(classified: DataFrame, scored: DataFrame | None = None, min_conf: float = 0.50, id_col: str = "ot_id") -> tuple[DataFrame, DataFrame]:
    """C4: confident rows become events (source 'automático'); the rest go to the review queue with their best row, and with
    ``scored`` (``candidates``) a row per order and candidate (one without a candidate if there is none)."""
    ok = (F.col("confianza") >= min_conf) & F.col("taxonomia_id").isNotNull()
    events = classified.filter(ok).select(id_col, "taxonomia_id", "confianza", F.lit("automático").alias("fuente"))
    review = classified.filter(~ok).select(id_col, "confianza", F.col("taxonomia_id").alias("mejor"))
    if scored is not None:
        offered = scored.select(id_col, F.col("taxonomia_id").alias("candidato"), F.round("score", 12).alias("score_candidato"))
        # the pairs compress to few bytes on disk: by that size they would be sent whole to every task
        review = review.join(offered.hint("merge"), id_col, "left")
    return events, review


def apply_review(events: DataFrame, decisions: DataFrame, id_col: str = "ot_id") -> DataFrame:
    """Manual decisions inserted with confidence 1.0 and source 'manual' where the order has no event yet."""
    new = decisions.select(id_col, "taxonomia_id", F.lit(1.0).alias("confianza"), F.lit("manual").alias("fuente")) \
        .join(events.select(id_col), id_col, "left_anti")
    return events.unionByName(new)


def unclassified_orders(ot: DataFrame, ev: DataFrame) -> DataFrame:
    """Orders with no failure event (NOT IN with the NULLs filtered on the right)."""
    return ot.join(ev.filter(F.col("ot_id").isNotNull()).select("ot_id").distinct(), "ot_id", "left_anti")

