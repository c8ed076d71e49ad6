"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur with up to e = rate * n edits. Cut into e + 1 pieces, one piece at
least is then left whole, so all places are found by searching the pieces exactly (one automaton over all
pieces) and checking the text around each hit with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import extended, slices
from fleetlens.session import stored

#: Edits allowed, as a share of an item's characters.
RATE = 0.05
#: Items of fewer words and of fewer characters occur by chance inside other words: they are found without edits and as whole words only.
MIN_WORDS = 6
MIN_CHARS = 40
#: Letters of scripts that put no space between words (Thai, Lao, Myanmar, Khmer, kana, Han): any place is a word boundary there.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Items of one pass; a larger benchmark is searched in several passes, so a broadcast stays small.
BLOCK = 20_000

LEAKS = "array<struct<item_id:{},distance:int,start:int,end:int>>"


def normal(text: str | None) -> str:
    """Lower case with one space between words; places in a text are places in this form of it."""
    return " ".join((text or "").lower().split())


def whole(text: str, start: int, end: int) -> bool:
    """Whether no word of ``text`` goes on across either end of a place."""
    inside = lambda c: (c.isalnum() or c == "_") and not UNSPACED.match(c)
    return not any(0 < i < len(text) and inside(text[i - 1]) and inside(text[i]) for i in (start, end))


class Pattern:
    """An item with the bit masks of its characters."""

    def __init__(self, text: str):
        self.n = len(text)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """The least edit distance to any substring of ``text``, or any prefix if ``anchored``, and where the first such one ends.

        One column of the distance matrix is two bit vectors of its vertical steps; a character of the text
        costs a dozen operations on integers of n bits.
        """
        full = (1 << self.n) - 1
        top = 1 << self.n - 1
        up, down, score = full, 0, self.n
        least, end = score, 0
        masks = self.masks
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            rise, fall = down | full & ~(diagonal | up), up & diagonal
            if rise & top:
                score += 1
            elif fall & top:
                score -= 1
                if score < least:
                    least, end = score, j + 1
            rise, fall = (rise << 1 | anchored) & full, fall << 1 & full
            up, down = fall | full & ~(diagonal | rise), rise & diagonal
        return least, end


class Search:
    """All items of a pass: the automaton over their pieces, the budgets and the patterns."""

    def __init__(self, items: list[tuple], rate: float, min_words: int = MIN_WORDS):
        self.budget, self.patterns, self.ids, self.texts, self.short = [], [], [], [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (item_id, text) in enumerate(items):
            n, short = len(text), len(text) < MIN_CHARS and text.count(" ") + 1 < min_words
            e = 0 if short else int(rate * n)
            self.short.append(short)
            self.ids.append(item_id)
            self.texts.append(text)
            self.budget.append(e)
            self.patterns.append(Pattern(text))
            cuts = [n * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def leaks(self, text: str) -> list[dict]:
        """The best place of each item that occurs within its budget, by item."""
        starts: dict[int, list[int]] = {}
        for last, (length, uses) in self.automaton.iter(text):
            for k, a in uses:
                starts.setdefault(k, []).append(last + 1 - length - a)
        found = []
        for k, begins in starts.items():
            e, n = self.budget[k], self.patterns[k].n
            begins.sort()
            best = None
            if self.short[k]:
                best = next(((0, a + n) for a in begins if whole(text, a, a + n)), None)
                begins = []
            while begins:
                # hits whose windows overlap are checked at once
                lo = hi = begins[0]
                i = 1
                while i < len(begins) and begins[i] <= hi + n:
                    hi = begins[i]
                    i += 1
                begins = begins[i:]
                a = max(0, lo - e)
                d, end = self.patterns[k].best(text[a : hi + n + e])
                if d <= e and (best is None or d < best[0]):
                    best = (d, a + end)
            if best:
                # where the place begins: the item read backwards from its end
                end = best[1]
                back = text[max(0, end - n - e) : end][::-1]
                length = n if best[0] == 0 else Pattern(self.texts[k][::-1]).best(back, anchored=True)[1]
                found.append({"item_id": self.ids[k], "distance": best[0], "start": end - length, "end": end})
        return sorted(found, key=lambda x: (x["item_id"] is None, x["item_id"], x["start"]))


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """``docs`` with leaks: item_id, distance, start and end (in the normal form) of each item of ``benchmark``
    (item_id of any type that has an order, text) that occurs in ``text``, case and white space aside, with ``rate`` edits a character at most.

    A null or empty text has none, and items that are null or without words are not searched; those of fewer than
    ``min_words`` words and MIN_CHARS characters must occur without edits and as whole words. Equal items are all reported. No shuffle: items go out in blocks of about ``block`` rows by a hash of
    their text, one pass over ``docs`` each, whose result is stored, so a task holds one block. A column named leaks is replaced.
    """
    docs = docs.drop("leaks")
    leaks = LEAKS.format(benchmark.schema["item_id"].dataType.simpleString())
    schema = extended(docs.schema, leaks=leaks)
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    blocks = max(1, -(-items.count() // block))
    out = docs.withColumn("leaks", F.array().cast(leaks))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        wanted = sorted({(r.item_id, normal(r.text)) for r in own}, key=lambda x: (x[1], x[0] is None, x[0]))
        shared = docs.sparkSession.sparkContext.broadcast([x for x in wanted if x[1]])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value, rate, min_words)
            for batch in slices(batches, text):
                before = batch.column("leaks").to_pylist()
                got = [x + (search.leaks(normal(t)) if t else []) for t, x in zip(batch.column(text).to_pylist(), before, strict=True)]
                kept = {c: batch.column(c) for c in batch.schema.names}
                kept["leaks"] = pa.array(got, batch.schema.field("leaks").type)
                yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))

        out = out.mapInArrow(run, schema)
        if b + 1 < blocks:
            out = stored(out)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no item of ``benchmark`` occurs."""
    return with_leaks(docs, benchmark, text, **how).where(F.size("leaks") == 0).drop("leaks")


def op8_decontamination(spark, sf_dir):
    """op8: a row for each document and benchmark item that occurs in it, with the edit distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.distance")
