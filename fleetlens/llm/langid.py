"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Counts are gathered by Spark over a bounded sample of labelled rows; the log-probability matrix
(buckets x languages) is broadcast, and each batch is scored as sparse counts times that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import extended, mix, slices

#: Bound of the labelled rows that a model is fitted on; above it, different texts of each language are kept by a hash.
TRAIN_ROWS = 40_000
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: More languages than this are refused: the matrix would no longer be small enough to broadcast.
MAX_LANGS = 256
#: Positions of a batch that are held as arrays at a time.
BLOCK = 1 << 19

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, letters of each row) of all n-grams, block by block.

    Texts are lowered; every run of other characters than letters counts as one space, and each text is
    framed by spaces. An n-gram lies in one text, and a lone space is none.
    """
    letter = _letters()
    flat = "\0".join((t or "").replace("\0", " ") for t in texts).lower()
    c = np.frombuffer(f" {flat} ".replace("\0", " \0 ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.cumsum(c == 0)
    c = np.where(letter[c], c, np.where(c == 0, 0, 32))
    keep = np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))
    c, row = c[keep], row[keep]
    for a in range(0, len(c), BLOCK):
        for n in ORDERS:
            b = min(a + BLOCK, len(c) - n + 1)
            if b <= a:
                continue
            key = np.zeros(b - a, np.uint64)
            inside = np.ones(b - a, bool)
            for i in range(n):
                part = c[a + i : b + i]
                key |= part.astype(np.uint64) << np.uint64(21 * i)
                inside &= part != 0
            if n == 1:
                inside &= c[a:b] != 32
            letters = row[a:b][c[a:b] > 32] if n == 1 else np.zeros(0, np.int64)
            yield row[a:b][inside], (mix(key[inside], n) & np.uint64(BUCKETS - 1)).astype(np.int64), letters


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # languages x buckets
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior; ``und`` and 0 where a text has no letter."""
        n = len(texts)
        total = np.tile(self.prior, (n, 1))
        letters = np.zeros(n, np.int64)
        for row, bucket, own in grams(texts):
            letters += np.bincount(own, minlength=n)
            cell, times = np.unique(row * BUCKETS + bucket, return_counts=True)
            row, bucket = cell // BUCKETS, cell % BUCKETS
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(row, weights=self.log_prob[k][bucket] * times, minlength=n)
        best = total.argmax(1) if self.langs else np.zeros(n, int)
        if self.langs:
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        known = (letters > 0) & bool(self.langs)
        names = [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return names, np.where(known, p, 0.0) if self.langs else np.zeros(n)


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, alpha: float = 0.1) -> Model:
    """Fit on ``labelled`` (text, lang). Rows without a language or a letter teach nothing; of more than
    ``rows`` rows, about that many different ones are used: all of languages with few, of the others a share that a hash
    of the text chooses (so a rerun takes the same). The languages' shares of all rows stay the prior."""
    labelled = labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts"))
    known = {r.lang: r for r in counted.limit(MAX_LANGS + 1).collect()}
    if len(known) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the matrix is not small enough to broadcast")
    sampled = sum(r.n for r in known.values()) > rows
    if sampled:
        left = rows
        keep = F.lit(False)
        # the smallest first: what one leaves of its equal part goes to the larger ones
        for k, r in enumerate(sorted(known.values(), key=lambda r: (r.texts, r.lang))):
            part = left / (len(known) - k)
            chosen = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 40)) < int(min(1, part / max(r.texts, 1)) * (1 << 40))
            keep |= (F.col("lang") == r.lang) & (F.lit(True) if r.texts <= part else chosen)
            left -= min(part, r.texts)
        labelled = labelled.where(keep).dropDuplicates(["text", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 20):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])
            size = BUCKETS + 1  # the last cell counts the rows
            add = np.bincount(of * size + BUCKETS, minlength=len(names) * size)
            for row, bucket, _ in grams(texts):
                add = add + np.bincount(of[row] * size + bucket, minlength=len(names) * size)
            for k, x in enumerate(names):
                sums[x] = sums.get(x, 0) + add[k * size : (k + 1) * size]
        for x, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    sums = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.limit(MAX_LANGS * (BUCKETS + 1) + 1).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + 1))
    table[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), got["bucket"].to_numpy(int)] = got["n"]
    seen, n = table[:, :BUCKETS] + alpha, np.array([known[x].n for x in langs]) if sampled else table[:, BUCKETS]
    return Model(langs, np.log(seen / seen.sum(1, keepdims=True)), np.log(np.maximum(n, 1) / max(n.sum(), 1)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred (a learned language, or ``und`` where the text is null or has no letter) and
    score (0 to 1, the posterior). Other columns stay, those named like the new ones are replaced; equal
    texts get equal results. No shuffle; memory is bounded by a slice of about 1 MB or one text."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            names, p = shared.value.score(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(np.clip(p, 0, 1))], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return docs.mapInArrow(run, extended(docs.schema, lang_pred="string", score="double"))


def fold(k: int, of: int = 4) -> Column:
    """Whether crc32 of the document's id, as text, leaves k; a null id leaves nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == k, F.lit(False))


def op4_language(spark, sf_dir):
    """op4: doc_id, held_out, lang_pred, score of every document; learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~fold(2)))
    rows = docs.select("doc_id", fold(2).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
