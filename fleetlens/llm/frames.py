"""Fill-in-the-middle over texts kept as independent zstandard frames.

A text is cut into frames of a fixed size, each compressed by itself and listed with the lines, code points and
bytes up to its end. A cut after a number of lines opens one frame; frames that no cut touches move to their
place in the output as they are. Digests read the ordered frames one at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import extended, raw, slices
from fleetlens.session import stored

#: Bytes of text in a frame.
FRAME = 64 << 10
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the draws, percent of the texts to transform, and percent of those with the suffix first.
SEED, RATE, SPM = 7, 100, 50

_FRAMES = "array<struct<lines:long,chars:long,bytes:long,data:binary>>"


def to_frames(docs: DataFrame, text: str = "text", frame: int = FRAME) -> DataFrame:
    """``docs`` with ``text`` replaced by frames (its frames, in order, each with the lines, code points and bytes
    that end up to its end), n (lines) and marked (the text holds a marker); columns of these names are replaced.

    A null or empty text has no frame and 0 lines. A frame ends anywhere, also inside a line or a character, so
    no line is too long. One pass without a shuffle; rows don't see each other.
    """
    docs = docs.drop("frames", "n", "marked")
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for batch in slices(batches, text, 2 << 20):
            buf, at = raw(batch.column(text))
            data = buf.tobytes()
            lines = np.concatenate(([0], np.cumsum(buf == 10)))
            chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
            count = -(-np.diff(at) // frame)
            row = np.repeat(np.arange(batch.num_rows), count)
            begin = at[row] + frame * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            end = np.minimum(begin + frame, at[row + 1])
            own = at[row]
            made = [
                pa.array(lines[end] - lines[own]),
                pa.array(chars[end] - chars[own]),
                pa.array(end - own),
                pa.array([press.compress(data[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
            ]
            offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            unended = np.array([b > a and data[b - 1] != 10 for a, b in spans], bool)
            out = {c: batch.column(c) for c in batch.schema.names if c != text}
            out["frames"] = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(made, ["lines", "chars", "bytes", "data"]))
            out["n"] = pa.array(lines[at[1:]] - lines[at[:-1]] + unended)
            out["marked"] = pa.array([any(data.find(m, a, b) >= 0 for m in marks) for a, b in spans], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.mapInArrow(run, extended(docs.drop(text).schema, frames=_FRAMES, n="long", marked="boolean"))


def with_cuts(store: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``store`` with lo and hi (lines up to the end of prefix and middle) and form, drawn from the doc_id; a null one draws as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    return store.withColumn("__h", digest).withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b), "form": form}).drop("__h")


class Reader:
    """Random access to the bytes of a framed text; the frame last read stays open."""

    def __init__(self, ends: list[int], data: list[bytes]):
        self.ends, self.data = ends, data
        self.size = ends[-1] if ends else 0
        self.zstd, self.held = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.held[0] != i:
            self.held = (i, self.zstd.decompress(self.data[i]))
        return self.held[1]

    def begin(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def read(self, a: int, b: int) -> Iterator[tuple[int, bytes]]:
        """(frame, bytes of it) for the bytes from a to b."""
        i = bisect_right(self.ends, a)
        while a < b:
            low = self.begin(i)
            yield i, self.frame(i)[a - low : b - low]
            a = self.ends[i]
            i += 1

    def find(self, mark: bytes, a: int) -> int:
        """The first place of ``mark`` from byte a on; it may lie across frames."""
        tail = b""
        for i, piece in self.read(a, self.size):
            at = (tail + piece).find(mark)
            if at >= 0:
                return max(a, self.begin(i)) - len(tail) + at
            tail = (tail + piece)[1 - len(mark) :]
        raise ValueError("no marker")


def _cut(r: Reader, lines: list[int], chars: list[int], n: int) -> tuple[int, int]:
    """Bytes and code points up to the end of line n: one frame is opened."""
    if n == 0:
        return 0, 0
    i = bisect_left(lines, n)
    if i == len(lines):
        return r.size, chars[-1]
    own = np.frombuffer(r.frame(i), np.uint8)
    at = int(np.flatnonzero(own == 10)[n - (lines[i - 1] if i else 0) - 1]) + 1
    return r.begin(i) + at, (chars[i - 1] if i else 0) + int(np.count_nonzero((own[:at] & 0xC0) != 0x80))


def _output(r: Reader, lo: int, hi: int, form: str, press: zstandard.ZstdCompressor) -> Reader:
    """The transformed text as frames of its own: whole frames are moved unopened, the rest is compressed anew."""
    spans = {PREFIX: (0, lo), MIDDLE: (lo, hi), SUFFIX: (hi, r.size)}
    order = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]
    if not order:
        return r
    ends, data, loose, at = [], [], b"", 0
    for mark in order:
        loose += mark.encode()
        a, b = spans[mark]
        while a < b:
            i = bisect_right(r.ends, a)
            low, high = r.begin(i), r.ends[i]
            if a == low and high <= b:
                if loose:
                    at += len(loose)
                    ends.append(at)
                    data.append(press.compress(loose))
                    loose = b""
                at += high - low
                ends.append(at)
                data.append(r.data[i])
            else:
                loose += r.frame(i)[a - low : b - low]
            a = high
    if loose:
        ends.append(at + len(loose))
        data.append(press.compress(loose))
    return Reader(ends, data)


def _restored(out: Reader, form: str) -> list[tuple[int, int]]:
    """The parts of the output that are the text, in the text's order, found by the markers."""
    if form == "plain":
        return [(0, out.size)]
    second = out.find((SUFFIX if form == "psm" else PREFIX).encode(), 3)
    middle = out.find(MIDDLE.encode(), second + 3)
    first, last, end = (3, second), (second + 3, middle), (middle + 3, out.size)
    return [first, end, last] if form == "psm" else [last, end, first]


def _digest(r: Reader, spans: list[tuple[int, int]]) -> str:
    h = hashlib.sha256()
    for a, b in spans:
        for _, piece in r.read(a, b):
            h.update(piece)
    return h.hexdigest()


def _arrange(store: DataFrame, added: dict[str, str], result) -> DataFrame:
    """``store`` with prefix_chars, middle_chars and what ``result`` makes of each output's frames and form, without frames and cuts."""
    kept = store.drop("frames", "lo", "hi", "prefix_chars", "middle_chars", *added).schema
    names = kept.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                rows: dict[str, list] = {c: [] for c in ("prefix_chars", "middle_chars", *added)}
                for frames, lo, hi, form in zip(*(batch.column(c).to_pylist() for c in ("frames", "lo", "hi", "form")), strict=True):
                    r = Reader([f["bytes"] for f in frames], [f["data"] for f in frames])
                    first, last = (0, 0), (0, 0)
                    if form != "plain":
                        lines, chars = [f["lines"] for f in frames], [f["chars"] for f in frames]
                        first, last = _cut(r, lines, chars, lo), _cut(r, lines, chars, hi)
                    out = _output(r, first[0], last[0], form, press)
                    own = (None, None) if form == "plain" else (first[1], last[1] - first[1])
                    for c, v in zip(rows, (*own, *result(out, form)), strict=True):
                        rows[c].append(v)
                have = {c: batch.column(c) for c in names}
                have |= {c: pa.array(v, pa.int64() if c.endswith("_chars") else pa.string()) for c, v in rows.items()}
                yield pa.RecordBatch.from_arrays(list(have.values()), names=list(have))

    return store.mapInArrow(run, extended(kept, prefix_chars="long", middle_chars="long", **added))


def digests(store: DataFrame) -> DataFrame:
    """SHA-256 of each output (output_sha256) and of the text rebuilt from output and form (restored_sha256)."""
    result = lambda out, form: (_digest(out, [(0, out.size)]), _digest(out, _restored(out, form)))
    return _arrange(with_cuts(store), {"output_sha256": "string", "restored_sha256": "string"}, result)


def fill_in_middle(docs: DataFrame, text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with ``text`` as the output, and n, form, prefix_chars and middle_chars (null if plain).

    Columns of these names (and of marked, frames, lo, hi) are replaced. A null text gives an empty output, a text that holds
    a marker stays as it is. Equal rows have equal outputs.
    """
    store = with_cuts(to_frames(docs.drop("form", "lo", "hi"), text), seed, rate, spm)
    whole = lambda out, form: (b"".join(x for _, x in out.read(0, out.size)).decode("utf-8", "surrogatepass"),)
    return _arrange(store, {text: "string"}, whole).drop("marked")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` of the given form was made from, in SQL functions."""
    part = lambda mark, end: F.substring_index(F.substring_index(output, mark, -1), end, 1)
    psm = F.concat(part(PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir):
    """op12: the cuts, form and digests of every document, from its stored frames."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(stored(to_frames(docs))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM d),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS o FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars, sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o
         WHEN 'psm' THEN split_part(split_part(o, '<P>', 2), '<S>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<M>', 1)
         ELSE split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<P>', 1) END) AS restored_sha256
FROM o
"""
