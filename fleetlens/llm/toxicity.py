"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word is an input of two kinds: its own embedding, and the mean of the embeddings of its character
n-grams (hashed), each with the log-odds that the training labels give it. The network reads overlapping
windows of words in both directions and pools its states by attention; a document's score is that of
its worst window. A label says that some window of a document is toxic, not which: training takes the window that the
network finds worst so far (at first, the one with the largest log-odds) and the worst ones of clean documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import SPACE, Words, extended, mix, slices

WINDOW, STEP = 64, 48
#: Bounds of the training sample: documents of each label, and characters of a document.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1_200, 2_400, 12_000
BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
WORD_DIM, CHAR_DIM, HIDDEN = 4, 6, 8
#: Training takes EPOCHS turns, more (up to eight times as many) while they are fewer than STEPS batches.
EPOCHS, BATCH, STEPS = 6, 64, 400
THRESHOLD = 0.7

#: Words end at ASCII punctuation too; digits, letters and bytes of other characters are inside.
BREAK = SPACE.copy()
BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True


class Vocabulary:
    """The distinct words of a batch with their buckets and those of their character n-grams."""

    def __init__(self, words: Words):
        hashes = words.hashes()
        self.hash, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        self.of = of.astype(np.int32)
        self.bucket = (self.hash & np.uint64(BUCKETS - 1)).astype(np.uint16)
        start, size = words.start[first], words.end[first] - words.start[first]
        # all words in one array, each between two marks
        ends = np.cumsum(size + 2)
        begins = ends - size - 2
        flat = np.full(int(ends[-1]) if len(ends) else 0, ord("<"), np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begins + 1, size) + inner] = words.buf[np.repeat(start, size) + inner]
        flat[ends - 1] = ord(">")
        self.grams = []
        for n in GRAMS:
            own = np.flatnonzero(size + 3 - n > 0)
            count = size[own] + 3 - n
            cut = np.cumsum(count) - count
            at = np.repeat(begins[own] - cut, count) + np.arange(int(count.sum()))
            key = np.zeros(len(at), np.uint64)
            for i in range(n):
                key |= flat[at + i].astype(np.uint64) << np.uint64(8 * i)
            self.grams.append((own, cut, count, (mix(key, n) & np.uint64(BUCKETS - 1)).astype(np.uint16)))

    def __len__(self) -> int:
        return len(self.hash)


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of the overlapping windows that cover all words of each row."""
    n = np.diff(words.first)
    per = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STEP) + 1), 0)
    row = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    first = words.first[row] + k * STEP
    return row, first, np.minimum(WINDOW, words.first[row + 1] - first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    p: dict[str, np.ndarray]

    @staticmethod
    def start(word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 6) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        x = WORD_DIM + CHAR_DIM + 3
        p = {"word": draw(BUCKETS, WORD_DIM, scale=0.1), "char": draw(BUCKETS, CHAR_DIM, scale=0.1), "word_odds": word_odds, "gram_odds": gram_odds}
        for d in "fb":
            p[f"W{d}"], p[f"U{d}"], p[f"c{d}"] = draw(x, 3 * HIDDEN, scale=0.3), draw(HIDDEN, 3 * HIDDEN, scale=0.3), np.zeros(3 * HIDDEN, np.float32)
        p |= {"v": draw(2 * HIDDEN, scale=0.3), "w": draw(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}
        return Network(p)

    def inputs(self, vocab: Vocabulary) -> np.ndarray:
        """The input vector of each distinct word: word and mean character embedding, word, mean and largest n-gram log-odds."""
        n, p = len(vocab), self.p
        total, count = np.zeros((n, CHAR_DIM), np.float32), np.zeros(n, np.float32)
        odds, most = np.zeros(n, np.float32), np.full(n, -9, np.float32)
        for own, cut, per, bucket in vocab.grams:
            if not len(own):
                continue
            total[own] += np.add.reduceat(p["char"][bucket], cut)
            o = p["gram_odds"][bucket]
            odds[own] += np.add.reduceat(o, cut)
            most[own] = np.maximum(most[own], np.maximum.reduceat(o, cut))
            count[own] += per
        count = np.maximum(count, 1)[:, None]
        return np.concatenate([p["word"][vocab.bucket], total / count, p["word_odds"][vocab.bucket][:, None], odds[:, None] / count, most[:, None]], 1)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]

    def _run(self, d: str, gate: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: bool):
        """States of one direction over windows of word numbers (windows x WINDOW); past a window's end the state rests."""
        u, steps = self.p[f"U{d}"], range(ids.shape[1])
        h = np.zeros((len(ids), HIDDEN), np.float32)
        states = np.zeros((ids.shape[1], len(ids), HIDDEN), np.float32)
        tape = {}
        for t in steps if d == "f" else reversed(steps):
            a, hu = gate[ids[:, t]], h @ u
            zr = _sigmoid(a[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            on = (size > t)[:, None]
            if keep:
                tape[t] = (h, z, r, n, hu[:, 2 * HIDDEN :], on)
            h = np.where(on, n + z * (h - n), h)
            states[t] = h
        return states, tape

    def forward(self, gates, ids: np.ndarray, size: np.ndarray, keep: bool = False):
        f, tape_f = self._run("f", gates[0], ids, size, keep)
        b, tape_b = self._run("b", gates[1], ids, size, keep)
        h = np.concatenate([f, b], 2)
        score = h @ self.p["v"]
        score = np.where(np.arange(ids.shape[1])[:, None] < size, score, -1e9)
        att = np.exp(score - score.max(0))
        att /= att.sum(0)
        pooled = (att[:, :, None] * h).sum(0)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return logit, (h, att, pooled, tape_f, tape_b)

    def backward(self, d_logit: np.ndarray, kept, gates, ids: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the recurrent and pooling weights, and of the gate inputs of each word."""
        h, att, pooled, tape_f, tape_b = kept
        g = {"w": pooled.T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["w"]
        d_att = (h * d_pooled).sum(2)
        d_score = att * (d_att - (att * d_att).sum(0))
        g["v"] = np.einsum("tn,tnk->k", d_score, h)
        d_h = att[:, :, None] * d_pooled + d_score[:, :, None] * self.p["v"]
        out = []
        for d, tape, part, gate in (("f", tape_f, d_h[:, :, :HIDDEN], gates[0]), ("b", tape_b, d_h[:, :, HIDDEN:], gates[1])):
            u, du, dg = self.p[f"U{d}"], np.zeros_like(self.p[f"U{d}"]), np.zeros_like(gate)
            carry = np.zeros_like(part[0])
            for t in reversed(list(tape)):
                before, z, r, n, hun, on = tape[t]
                total = carry + part[t]
                dh = np.where(on, total, 0)
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                d_u = np.concatenate([dz, dr, dn * r], 1)
                du += before.T @ d_u
                np.add.at(dg, ids[:, t], np.concatenate([dz, dr, dn], 1))
                carry = np.where(on, dh * z + d_u @ u.T, total)
            g[f"U{d}"] = du
            out.append(dg)
        return g, out[0], out[1]

    def logits(self, vocab: Vocabulary, first: np.ndarray, size: np.ndarray, batch: int = 2048) -> np.ndarray:
        """The logit of each window."""
        logit = np.zeros(len(first), np.float32)
        gates = self.gates(self.inputs(vocab))
        # windows of like lengths together, so that short rows cost few steps
        order = np.argsort(size, kind="stable")
        for a in range(0, len(first), batch):
            w = order[a : a + batch]
            logit[w] = self.forward(gates, place(first[w], size[w], vocab.of), size[w])[0]
        return logit


def place(first: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Word numbers of windows, windows x longest; past the end the last word again."""
    at = first[:, None] + np.minimum(np.arange(int(size.max())), size[:, None] - 1)
    return of[at]


class Chunk:
    """Some training documents: their words, vocabulary, windows and, at last, the windows' logits."""

    def __init__(self, texts: list[str], labels: list[int]):
        words = Words(lowered(pa.array(texts, pa.string())), BREAK)
        self.words, self.vocab, self.label = words, Vocabulary(words), np.array(labels, np.int64)
        self.row, self.first, self.size = windows(words)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents of each label that have a word bucket, and an n-gram bucket; the words are let go."""
        vocab, row, self.words = self.vocab, self.words.row, None
        pair = np.unique(row * max(len(vocab), 1) + vocab.of)
        doc, word = pair // max(len(vocab), 1), pair % max(len(vocab), 1)
        cells = []
        for own, cut, count, bucket in vocab.grams:
            begin, many = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
            begin[own], many[own] = cut, count
            per = many[word]
            at = np.repeat(begin[word] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
            cells.append(np.repeat(doc, per) * BUCKETS + bucket[at])
        by = lambda cell: np.stack([np.bincount(cell[self.label[cell // BUCKETS] == k] % BUCKETS, minlength=BUCKETS) for k in (0, 1)])
        return by(np.unique(doc * BUCKETS + vocab.bucket[word])), by(np.unique(np.concatenate(cells)))

    def chosen(self, logit: np.ndarray) -> np.ndarray:
        """The worst window of each document, and the next two of a clean one."""
        order = np.lexsort((-logit, self.row))
        own = self.row[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        return order[(rank == 0) | (rank < 3) & (self.label[own] == 0)]


def _odds(counts: np.ndarray, label: np.ndarray, smooth: float = 5.0) -> np.ndarray:
    """Log-odds of a toxic label for each bucket, from the documents that have it."""
    clean, toxic = counts
    odds = np.log((toxic + smooth) / (label.sum() + 2 * smooth)) - np.log((clean + smooth) / ((label == 0).sum() + 2 * smooth))
    return odds.astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 6, chunk: int = 64) -> Network:
    """Fit a network to documents and labels (0 or 1); with fewer than two classes it scores all alike.

    Documents are held in chunks, so memory is that of the sample's words and no more.
    """
    label, rng = np.array(labels, np.int64), np.random.default_rng(seed)
    chunks = [Chunk(texts[a : a + chunk], labels[a : a + chunk]) for a in range(0, len(texts), chunk)]
    chunks = [c for c in chunks if len(c.row)]
    if not chunks or len(set(labels)) < 2:
        net = Network.start(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32))
        net.p["w"][:] = 0
        net.p["b"][:] = 4 if labels and min(labels) == 1 else -4
        return net
    word_counts, gram_counts = 0, 0
    for c in chunks:
        w, g = c.counts()
        word_counts, gram_counts = word_counts + w, gram_counts + g
    net = Network.start(_odds(word_counts, label), _odds(gram_counts, label), seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word_odds", "gram_odds")}
    balance = min(4.0, (label == 0).sum() / max(label.sum(), 1))
    step, epoch = 0, 0
    while epoch < epochs or step < STEPS and epoch < 8 * epochs:
        for at in rng.permutation(len(chunks)):
            c = chunks[at]
            if epoch:
                logit = net.logits(c.vocab, c.first, c.size)
            else:
                # at first the worst window is the one whose words have the largest log-odds
                strong = net.inputs(c.vocab)[:, -1][c.vocab.of]
                logit = np.array([strong[a : a + n].max() for a, n in zip(c.first.tolist(), c.size.tolist(), strict=True)], np.float32)
            chosen = rng.permutation(c.chosen(logit))
            for a in range(0, len(chosen), BATCH):
                step += 1
                rate = 0.02 if epoch < epochs // 2 else 0.005
                w = chosen[a : a + BATCH]
                y = c.label[c.row[w]]
                _update(net, moments, c, w, y, np.where(y == 1, balance, 1.0) / len(w), rate, step)
        epoch += 1
    return net


def _update(net: Network, moments: dict, c: Chunk, w: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, step: int) -> None:
    """One step of Adam on the windows ``w`` of a chunk."""
    own, ids = np.unique(place(c.first[w], c.size[w], c.vocab.of), return_inverse=True)
    small = _part(c.vocab, own)
    x = net.inputs(small)
    gates = net.gates(x)
    out, kept = net.forward(gates, ids, c.size[w], keep=True)
    d = ((_sigmoid(out) - y) * weight).astype(np.float32)
    g, gf, gb = net.backward(d, kept, gates, ids)
    g |= {"Wf": x.T @ gf, "Wb": x.T @ gb, "cf": gf.sum(0), "cb": gb.sum(0)}
    dx = gf @ net.p["Wf"].T + gb @ net.p["Wb"].T
    g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
    np.add.at(g["word"], small.bucket, dx[:, :WORD_DIM])
    count = np.zeros(len(own))
    for o, _, per, _ in small.grams:
        count[o] += per
    share = dx[:, WORD_DIM : WORD_DIM + CHAR_DIM] / np.maximum(count, 1)[:, None]
    for o, _, per, bucket in small.grams:
        np.add.at(g["char"], bucket, np.repeat(share[o], per, axis=0).astype(np.float32))
    for k, (m, v) in moments.items():
        m += 0.1 * (g[k] - m)
        v += 0.001 * (g[k] ** 2 - v)
        net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _part(vocab: Vocabulary, own: np.ndarray) -> Vocabulary:
    """Some words of a vocabulary."""
    out = object.__new__(Vocabulary)
    out.hash, out.bucket = vocab.hash[own], vocab.bucket[own]
    out.grams = []
    for words, cut, count, bucket in vocab.grams:
        at = np.searchsorted(words, own)
        has = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == own) if len(words) else np.zeros(len(own), bool)
        at = at[has]
        per = count[at]
        new = np.cumsum(per) - per
        out.grams.append((np.flatnonzero(has), new, per, bucket[np.repeat(cut[at] - new, per) + np.arange(int(per.sum()))]))
    return out


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, chars: int = TRAIN_CHARS) -> DataFrame:
    """Rows (doc_id, text, toxic) to learn from: about ``toxic`` and ``clean`` labelled documents, chosen by a hash of their ids.

    Rows without a label, an id or a text, and documents of more than ``chars`` characters, are not learned from.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_d"), "toxic")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, toxic / max(counts.get(1, 1), 1)).otherwise(clean / max(counts.get(0, 1), 1))
    few = known.where(F.pmod(F.xxhash64("_d", F.lit(6)), F.lit(1 << 20)) < share * (1 << 20))
    # its size is that of the sample
    rows = docs.where(F.length("text") <= chars).select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_d"))
    return rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).distinct()


def score(docs: DataFrame, net: Network, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1, of the worst window of the whole text) and predicted (1 from ``threshold`` on).

    A null text or one without a word scores 0. Equal texts score alike; columns of these names are
    replaced. No shuffle; a task holds about 1 MB of text, or one text, and its windows.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            words = Words(lowered(batch.column(text)), BREAK)
            row, first, size = windows(words)
            worst = np.full(batch.num_rows, -np.inf)
            if len(row):
                np.maximum.at(worst, row, shared.value.logits(Vocabulary(words), first, size))
            p = _sigmoid(worst)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"]
            )

    return docs.mapInArrow(run, extended(docs.schema, score="double", predicted="int"))


def fold(k: int = 1, of: int = 3):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == k, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from the labelled documents outside the held-out fold.

    One task trains on the sample, whose size is bounded, and sends back the weights; a retry gives the same ones.
    """

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "toxic", "text"])
        return pd.DataFrame({"net": [pickle.dumps(train(rows["text"].tolist(), rows["toxic"].tolist()).p)]})

    got = sample(docs, labels.where(~fold())).groupBy().applyInPandas(learn, "net binary").collect()
    return Network(pickle.loads(got[0].net)) if got else train([], [])


def op6_toxicity(spark, sf_dir):
    """op6: doc_id, held_out, score and predicted of every document; learned from labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", fold().alias("held_out"), "text")
    return score(rows, net).select("doc_id", "held_out", "score", "predicted")
