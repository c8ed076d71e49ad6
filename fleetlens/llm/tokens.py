"""Token counts of a byte-level BPE with word ends, by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetlens.llm.words import extended, slices

#: Pre-tokens whose counts a Python worker keeps; beyond it the table starts anew (results don't depend on it).
KEPT = 400_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class Merges:
    """The vocabulary as arrays: symbols of bytes (inside a word, at its end) and merge rules sorted by pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or norm != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a word BPE with NFC, white space and lower case normalisers is expected")
        self.split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.inside = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        self.at_end = np.array([vocab[c + end] for c in _byte_symbols()], np.int64)
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pair = np.array([vocab[a] << 20 | vocab[b] for a, b in rules], np.int64)
        made = np.array([vocab[a + b] for a, b in rules], np.int64)
        # a pair that is listed twice counts by its last rank, as in the library's table
        pair, at = np.unique(pair[::-1], return_index=True)
        self.pair, self.rank, self.made = pair, (len(rules) - 1 - at).astype(np.int64), made[len(rules) - 1 - at]

    def count(self, words: list[str]) -> np.ndarray:
        """How many symbols each pre-token has after all merges.

        All words lie in one array; in each round every word applies its lowest-ranked pair, everywhere
        in the word from the left, and words without a known pair leave.
        """
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(d) for d in data], np.int64)
        out = lengths.copy()
        raw = np.frombuffer(b"".join(data), np.uint8)
        sym = self.inside[raw]
        last = np.cumsum(lengths) - 1
        sym[last[lengths > 0]] = self.at_end[raw[last[lengths > 0]]]
        word = np.repeat(np.arange(len(words)), lengths)
        none = len(self.pair) + 1
        while len(sym) > 1:
            inner = word[:-1] == word[1:]
            key = sym[:-1] << 20 | sym[1:]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            rank = np.where(inner & (self.pair[at] == key), self.rank[at], none)
            first = np.flatnonzero(np.concatenate(([True], ~inner)))
            least = np.minimum.reduceat(np.append(rank, none), first)
            alive = least < none
            sizes = np.diff(np.append(first, len(sym)))
            out[word[first]] = sizes
            per = np.repeat(least, sizes)
            hit = np.append(rank, none) == per
            hit &= per < none
            # a pair of equal symbols can overlap itself: take every other one of a run, from the left
            i = np.arange(len(hit))
            begins = hit & ~np.concatenate(([False], hit[:-1]))
            run = np.maximum.accumulate(np.where(begins, i, 0))
            hit &= (i - run) % 2 == 0
            h = np.flatnonzero(hit)
            sym[h] = self.made[at[h]]
            stays = np.ones(len(sym), bool)
            stays[h + 1] = False
            stays &= np.repeat(alive, sizes)
            sym, word = sym[stays], word[stays]
        out[word] = 1 if len(sym) else 0
        return out


_CACHE: dict[str, int] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of its text column.

    ``path`` is a vocabulary file of the tokenizers library (BPE with word ends); the driver reads it and
    ships its arrays, whose size is that of the vocabulary. Strings of added tokens inside a text count as
    one token. A null or empty text has 0 bytes and 0 tokens; repeated rows each get their counts; columns
    of ``docs`` named like the new ones are replaced. One pass, no shuffle; a task holds a few MB of text.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    merges = docs.sparkSession.sparkContext.broadcast(Merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges.value
        words = regex.compile(m.split).findall
        special = regex.compile("|".join(map(regex.escape, m.special)) or "(?!)")
        space = regex.compile(r"\s+")

        def pretokens(t: str) -> tuple[list[str], int]:
            parts = special.split(t)
            got: list[str] = []
            for p in parts:
                if p:
                    if not p.isascii():
                        # single characters are lowered, so a final sigma is no special case
                        p = unicodedata.normalize("NFC", p).replace("Σ", "σ")
                    got += words(space.sub(" ", p).lower() if not p.isascii() else p.lower())
            return got, len(parts) - 1

        for batch in slices(batches, text, 2 << 20):
            texts = batch.column(text).to_pylist()
            docs_ = [pretokens(t) if t else ([], 0) for t in texts]
            unknown = list({w for ws, _ in docs_ for w in ws}.difference(_CACHE))
            if len(_CACHE) + len(unknown) > KEPT:
                _CACHE.clear()
                unknown = list({w for ws, _ in docs_ for w in ws})
            if unknown:
                _CACHE.update(zip(unknown, m.count(unknown).tolist(), strict=True))
            n = np.array([sum(map(_CACHE.__getitem__, ws)) + k for ws, k in docs_], np.int64)
            b = np.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(b), pa.array(n), pa.array(n > limit)],
                names=[*batch.schema.names, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(run, extended(docs.schema, n_bytes="long", n_tokens="long", over_limit="boolean"))


def op10_token_counts(spark, sf_dir):
    """op10: doc_id, n_bytes, n_tokens, over_limit of every document, with word_bpe_49k.json."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )
