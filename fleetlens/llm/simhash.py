"""SimHash near-duplicates by a self-join of binary tries.

Two fingerprints that differ in three bits agree in one of four blocks of 16. Each of the four rotations puts
another block on top, so the top of its trie is walked without differences and the tries below lie side by side
in Spark partitions. In a trie, pairs of nodes are walked down together with the bits in which they differ; a pair
with more than three is left. Links become stars of their group, never a list of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.graph import components
from fleetlens.llm.words import SPACE, Words, extended, slices
from fleetlens.session import stored

SHINGLE, SEED, BUDGET = 3, 42, 3
#: Bits of the block that a trie's fingerprints share.
TOP = 16
#: Fingerprints of one trie that a task walks in one piece; a larger one is dealt out by pairs of its nodes CELL bits further down.
HOT, CELL = 1_000_000, 8
#: Fingerprints walked at a time, node pairs at a time, and pairs of fingerprints under a node pair that are compared outright.
PIECE, CHUNK, LEAF = 1 << 18, 1 << 17, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle, rows in order."""
    w = Words(column)
    last = np.zeros(len(w), bool)
    last[w.first[1:][np.diff(w.first) > 0] - 1] = True
    # words with one space after each but a row's last
    keep = ~SPACE[w.buf]
    text = _LOWER[w.buf]
    gaps = w.end[~last]
    keep[gaps] = True
    text[gaps] = 32
    at = np.cumsum(keep) - keep
    data = text[keep].tobytes()
    many = np.diff(w.first)
    n = np.where(many >= SHINGLE, many - SHINGLE + 1, np.minimum(many, 1))
    row = np.repeat(np.arange(len(n)), n)
    head = w.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    tail = np.minimum(head + SHINGLE, w.first[row + 1]) - 1
    a, b = at[w.start[head]].tolist(), (at[w.end[tail] - 1] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return row, np.fromiter((digest(data[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(row))


def fingerprints(column: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if it is set in over half the shingles' hashes."""
    row, h = _shingles(column)
    out = np.zeros(len(column), np.uint64)
    if not len(h):
        return out
    head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    n = np.diff(np.append(head, len(row)))
    found = np.zeros(len(head), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), head)
        found |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
    out[row[head]] = found
    return out


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with fingerprint (long, the 64 bits); a column of that name is replaced. A null text, or one without words, has 0."""
    docs = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            yield batch.append_column("fingerprint", pa.array(fingerprints(batch.column(text)).view(np.int64)))

    return docs.mapInArrow(run, extended(docs.schema, fingerprint="long"))


class _Groups:
    """Groups of linked positions; the root of a group is its least position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.root, b, a)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def walk(x: np.ndarray, start: list[tuple[int, np.ndarray]], groups: _Groups, budget: int = BUDGET) -> None:
    """Link the positions of ``x`` that lie under the node pairs of ``start`` and differ in ``budget`` bits or fewer.

    A node is a range of positions, sorted below it; start has (depth, columns: from and to of one node, from and
    to of the other, bits in which they differ). A node paired with itself stands for all pairs inside it.
    """
    ones: dict[int, np.ndarray] = {}
    stack = list(start)
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > CHUNK:
            stack += [(depth, pairs[:, CHUNK:]), (depth, pairs[:, :CHUNK])]
            continue
        size = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        few = (size <= LEAF) | (depth == 64)
        leaf = pairs[:, few]
        # all pairs of fingerprints below leaf node pairs, at once
        n = size[few]
        which = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        wide = (leaf[3] - leaf[2])[which]
        i, j = leaf[0][which] + k // np.maximum(wide, 1), leaf[2][which] + k % np.maximum(wide, 1)
        near = (i != j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
        groups.link(i[near], j[near])
        pairs = pairs[:, ~few]
        if not pairs.shape[1]:
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((x >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int32)))
        c = ones[depth]
        a0, a2, b0, b2, diff = pairs
        a1, b1 = a2 - (c[a2] - c[a0]), b2 - (c[b2] - c[b0])
        other = a0 != b0
        below = [(a0, a1, b0, b1, diff), (a1, a2, b1, b2, diff), (a0, a1, b1, b2, diff + 1), tuple(v[other] for v in (a1, a2, b0, b1, diff + 1))]
        down = np.concatenate([np.stack(p) for p in below], axis=1)
        alive = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)
        if alive.any():
            stack.append((depth + 1, down[:, alive]))


_UNIT = ("rotation", "top", "cell_a", "cell_b")


def _start(unit: np.ndarray, x: np.ndarray, cell_a: np.ndarray, cell_b: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The first node pairs of a piece: a trie with itself, or two nodes of a trie that is dealt out."""
    lo = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    hi = np.append(lo[1:], len(x))
    two = cell_a[lo] != cell_b[lo]
    own = np.stack((lo, hi, lo, hi, np.zeros_like(lo)))[:, ~two]
    second = np.concatenate(([0], np.cumsum((x >> np.uint64(64 - TOP - CELL)).astype(np.int64) % (1 << CELL) == cell_a)))
    mid = lo + second[hi] - second[lo]
    apart = np.bitwise_count(cell_a[lo] ^ cell_b[lo]).astype(np.int64)
    cross = np.stack((lo, mid, mid, hi, apart))[:, two]
    return [(d, p[:, (p[0] < p[1]) & (p[2] < p[3])]) for d, p in ((TOP, own), (TOP + CELL, cross)) if p.shape[1]]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of linked rows, in a partition sorted by unit and rotated fingerprint; whole units at a time."""

    def piece(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        key = np.stack([t[c].to_numpy().astype(np.int64) for c in _UNIT])
        unit = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))))
        x = t["x"].to_numpy().view(np.uint64)
        groups = _Groups(len(x))
        walk(x, _start(unit, x, key[2], key[3]), groups)
        far = np.flatnonzero(groups.root != np.arange(len(x)))
        ends = [t["node"].chunk(0).take(pa.array(at)) for at in (far, groups.root[far])]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) > PIECE:
            key = [batch.column(c).to_numpy() for c in _UNIT]
            cut = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            if len(cut):
                yield piece([*held[:-1], batch.slice(0, int(cut[-1]) + 1)])
                held = [batch.slice(int(cut[-1]) + 1)]
    if held:
        yield piece(held)


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: stars that join each row of ``nodes`` (node; fingerprint, all different) with what is linked to it, through others of its trie too.

    A row is sent once to each of four tries. A trie of more than ``hot`` rows (counted first; the list of those has at
    most 4 / hot of the rows) is dealt out: its nodes CELL bits further down meet in pairs that differ in BUDGET bits or fewer.
    """
    fp = F.col("fingerprint")
    turned = [F.struct(F.lit(r).alias("rotation"), fp.alias("x") if not r else F.shiftleft(fp, TOP * r).bitwiseOR(F.shiftrightunsigned(fp, 64 - TOP * r)).alias("x")) for r in range(4)]
    rows = nodes.select("node", F.inline(F.array(*turned))).withColumn("top", F.shiftrightunsigned("x", 64 - TOP).cast("int"))
    large = rows.groupBy("rotation", "top").count().where(F.col("count") > hot).select("rotation", "top", F.lit(True).alias("large"))
    rows = rows.join(F.broadcast(large), ["rotation", "top"], "left")
    own = F.shiftrightunsigned("x", 64 - TOP - CELL).bitwiseAND(F.lit((1 << CELL) - 1)).cast("int")
    near = F.array(*(F.lit(v) for v in range(1 << CELL) if v.bit_count() <= BUDGET))
    cells = F.when(F.col("large"), F.transform(near, lambda v: own.bitwiseXOR(v))).otherwise(F.array(F.lit(-1)))
    rows = rows.withColumn("__other", F.explode(cells))
    least, most = F.least(own, F.col("__other")), F.greatest(own, F.col("__other"))
    only = F.col("__other") < 0
    rows = rows.select("rotation", "top", F.when(only, -1).otherwise(least).alias("cell_a"), F.when(only, -1).otherwise(most).alias("cell_b"), "x", "node")
    # below one top all x have one sign, so their order as longs is that of their bits
    dealt = rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "x")
    kind = nodes.schema["node"].dataType.simpleString()
    return dealt.mapInArrow(_walk, f"a {kind}, b {kind}")


def classes(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows`` (doc_id, fingerprint; best stored, they are read more than once) with component_id, the least doc_id
    reachable over links of BUDGET differing bits or fewer; a column of that name is replaced.

    Equal fingerprints are one node from the start. A null doc_id links like any other and is never a component_id
    (null if a component has no other). Rows that share a doc_id are linked by their fingerprints alone.
    """
    rows = rows.drop("component_id")
    kind = rows.schema["doc_id"].dataType
    least = F.min("doc_id")
    nodes = stored(rows.groupBy("fingerprint").agg(F.count("*").alias("__n"), least.alias("__least")))
    named = F.struct(F.col("__least").isNull().alias("none"), F.coalesce("__least", F.lit(0).cast(kind)).alias("id"), F.col("fingerprint").alias("fp"))
    nodes = nodes.select("fingerprint", "__n", named.alias("node"))
    found = components(stored(links(nodes.select("node", "fingerprint"), hot)))
    root = F.coalesce("root", "node")
    ids = nodes.join(found, "node", "left").select("fingerprint", "__n", F.when(~root["none"], root["id"]).alias("component_id"))
    ids = stored(ids)
    total = ids.agg(F.sum("__n")).first()[0] or 0
    # fingerprints of a thousandth of all rows or more: a thousand at most, whose rows are not shuffled
    often = F.broadcast(ids.where(F.col("__n") * 1000 >= total).select("fingerprint", "component_id"))
    rest = ids.where(F.col("__n") * 1000 < total).select("fingerprint", "component_id")
    seldom = rows.join(often.select("fingerprint"), "fingerprint", "left_anti")
    return rows.join(often, "fingerprint").unionByName(seldom.join(rest, "fingerprint")).select(*rows.columns, "component_id")


def digits(fingerprint: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def op13_simhash(spark, sf_dir):
    """op13: doc_id, fingerprint and component_id of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(stored(with_fingerprint(docs).drop("text"))).select("doc_id", digits(F.col("fingerprint")).alias("fingerprint"), "component_id")
