"""Filter audit, fill-in-the-middle and SimHash against plain versions, edge rows included."""

import hashlib
from itertools import permutations
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import audit, frames, simhash

from .test_edges import LABELS, LONG, ROWS, clashing, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\f\r"
MORE = [
    (9, "A B C # " * 30, "en", "", 240),
    (10, "A B C # " * 30, "en", "a", 240),
    (11, "one\ntwo\n\nthree <P> four", "en", "b", 22),
    (12, "\n\n\n", "en", "b", 3),
    (13, "ends\nwithout\r\nnewline < P> <S", "en", "b", 30),
    (14, "Uno dos " * 40 + "\x1cü", None, "b", 300),
    (15, prose(2, 60) + "\n" + prose(3, 60) + " x", "en", "b", 700),
]


def words(t):
    out, own = [], ""
    for c in (t or "") + " ":
        if c in SPACES:
            out += [own] if own else []
            own = ""
        else:
            own += c
    return out


@pytest.fixture(scope="module")
def rows():
    return ROWS + MORE


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------------ filter audit
def plain_audit(rows, labels):
    def fails(i, t):
        w = words(t)
        out = {"A"} if len(w) < 50 else set()
        out |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        out |= {"D"} if set(t) & set("#$%&*|") else set()
        return out | ({"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows) else set())

    marks = {kind: {i for i, *v in labels if i is not None and v[k] == 1} for k, kind in enumerate(("good", "toxic"))}
    parts = {}
    for i, t, _, source, _ in rows:
        parts.setdefault(source or "", []).append((i, fails(i, t or "")))
    got = set()
    for part, own in parts.items():
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                left = [(i, f) for i, f in own if not f & set(order[:k])]
                gone = [(i, f) for i, f in left if x in f]
                removed[order, x] = len(gone)
                got.add((part, order, k + 1, len(left) - len(gone), len(gone), sum(x in f for _, f in own) - len(gone),
                         sum(f == {x} for _, f in own), sum(i in marks["good"] for i, _ in gone), sum(i in marks["toxic"] for i, _ in gone)))
        got |= {("shapley", part, x, sum(n for (_, y), n in removed.items() if y == x)) for x in "ABCDE"}
    return got


def test_audit(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.orders(audit.combinations(clashing(docs).withColumn("source", docs.source), labels)).collect()
    flat = {tuple(r)[:9] for r in got} | {("shapley", r.part, r.filter_order[r.step - 1], r.shapley) for r in got}
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert flat == plain_audit(rows, LABELS)
    assert audit.orders(audit.combinations(docs.limit(0), labels)).collect() == []
    assert {r.good_lost for r in audit.orders(audit.combinations(docs, labels.limit(0))).collect()} == {0}


def test_audit_words_that_share_a_hash(spark, docs, rows):
    t = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.lit("").alias("part"), F.unhex(F.sha2(t, 256)).alias("text_sha"), t.alias("text"))
    for mask in (audit.MASK, 63):
        shards, dictionary = audit.matrix(own, mask)
        told = {r.word: r.id for r in dictionary.collect()}
        assert set(told) == {w for r in rows for w in words(r[1])} and len(set(told.values())) == len(told)
        kinds = "doc_id long, part string, text_sha binary, bits int, n_words long, n_distinct long"
        counts = sorted((r.n_words, r.n_distinct) for r in shards.mapInArrow(audit._sums, kinds).collect())
        assert counts == sorted((len(w), len(set(w))) for w in (words(r[1]) for r in rows))


# ------------------------------------------------------------------ fill-in-the-middle
def plain_fim(i, text):
    t = text or ""
    units = [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else [])
    n = len(units)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, t
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), out


@pytest.mark.parametrize("frame", [1, 7, 64, frames.FRAME])
def test_fill_in_middle(spark, docs, rows, frame):
    few = docs.where("n_chars IS NULL OR n_chars < 1000") if frame < 64 else docs
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    store = frames.to_frames(clashing(few).drop("n"), frame=frame)
    assert all(f["bytes"] <= frame * (k + 1) for r in store.collect() for k, f in enumerate(r.frames))
    got = [(str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in frames.digests(store).collect()]
    want = []
    for i, t, _, _, chars in rows:
        if frame >= 64 or chars is None or chars < 1000:
            *own, out = plain_fim(i, t)
            want.append((str(i), *own, sha(out), sha(t or "")))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_fill_in_middle_round_trip(docs, rows):
    got = frames.fill_in_middle(clashing(docs))
    assert got.where("block = 'own block'").count() == len(rows)
    back = got.withColumn("back", frames.restore(F.col("text"), F.col("form"))).select("doc_id", "back", "text").collect()
    assert sorted(repr((r.doc_id, r.back)) for r in back) == sorted(repr((i, t or "")) for i, t, *_ in rows)
    assert sorted(repr((r.doc_id, r.text)) for r in back) == sorted(repr((i, plain_fim(i, t)[-1])) for i, t, *_ in rows)
    none = frames.fill_in_middle(docs, rate=0).collect()
    assert {r.form for r in none} == {"plain"} and {r.text for r in none} == {t or "" for _, t, *_ in rows}
    assert frames.fill_in_middle(docs.limit(0)).collect() == []


# ------------------------------------------------------------------ SimHash
def plain_fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def least_ids(ids, prints):
    roots = plain_classes(prints)
    return [min((i for i, r in zip(ids, roots, strict=True) if r == own and i is not None), default=None) for own in roots]


def test_fingerprints(spark, docs, rows):
    texts = [r[1] for r in rows] + ["a b", "x", "A b C d", "a B c D"]
    got = simhash.fingerprints(pa.array(texts, pa.string())).tolist()
    assert got == [plain_fingerprint(t) for t in texts]
    # the hash is that of Spark's own function
    row, h = simhash._shingles(pa.array(["eins zwei drei vier", None, "nur"], pa.string()))
    sql = spark.createDataFrame([("eins zwei drei",), ("zwei drei vier",), ("nur",)], "s string").select(F.xxhash64("s")).collect()
    assert row.tolist() == [0, 0, 2] and h.view(np.int64).tolist() == [r[0] for r in sql]


def test_simhash_edges(docs, rows):
    got = simhash.classes(simhash.with_fingerprint(clashing(docs))).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = zip((r[0] for r in rows), prints, least_ids([r[0] for r in rows], prints), strict=True)
    assert sorted(repr((r.doc_id, r.fingerprint % 2**64, r.component_id)) for r in got) == sorted(map(repr, want))
    assert all(r.block == "own block" for r in got)
    assert simhash.classes(simhash.with_fingerprint(docs.limit(0))).collect() == []


@pytest.mark.parametrize("hot", [simhash.HOT, 20])
def test_simhash_links(spark, hot):
    """Chains, dense groups, exact copies and pairs at 3 and 4 bits; small tries and ones that are dealt out."""
    r = Random(hot)
    prints = [r.getrandbits(64) for _ in range(150)]
    for base in prints[:40]:
        for bits in (1, 2, 3, 4, 5):
            prints.append(base ^ sum(1 << b for b in r.sample(range(64), bits)))
    dense = r.getrandbits(64)
    prints += [dense ^ sum(1 << b for b in r.sample(range(0, 24), r.randrange(9))) for _ in range(300)]
    prints += [prints[0]] * 40 + [0, 2**64 - 1, 7, 2**63]
    ids = list(range(len(prints)))
    r.shuffle(ids)
    rows = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in zip(ids, prints, strict=True)], "doc_id long, fingerprint long")
    got = {x.doc_id: x.component_id for x in simhash.classes(rows, hot).collect()}
    assert got == dict(zip(ids, least_ids(ids, prints), strict=True))


def test_trie_walk_is_exact():
    """All pairs of sorted random fingerprints of few bits, walked as one trie."""
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**14, 3000, dtype=np.uint64) << np.uint64(30))
    groups = simhash._Groups(len(x))
    n = len(x)
    simhash.walk(x, [(0, np.array([[0], [n], [0], [n], [0]]))], groups, budget=1)
    want = simhash._Groups(n)
    for i in range(n):
        j = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 1)
        want.link(np.full(len(j), i), j)
    assert (groups.root == want.root).all()


def test_long_text_has_every_shingle():
    assert simhash.fingerprints(pa.array([LONG])).tolist() == [plain_fingerprint(LONG)]


def test_few_shards_are_held_at_once(spark):
    """Shards of megabytes: their stored rows are read back in groups of a few, not a file at a time."""
    docs = spark.range(7).selectExpr("id doc_id", "'p' part", "unhex(sha2(string(id), 256)) text_sha", "concat(id, ' ', repeat('one two three ', 300000)) text").coalesce(1)
    shards, dictionary = audit.matrix(docs)
    assert shards.count() == 7 and {r.word for r in dictionary.collect()} == {*map(str, range(7)), "one", "two", "three"}
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in shards.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 7 and max(groups) <= audit.SHARDS_HELD
