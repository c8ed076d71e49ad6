"""The methods against plain versions on small inputs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import decontaminate, graph, html, langid, lines, minhash, mixing, quality, substrings, tokens, toxicity
from fleetlens.llm.words import Words, slices
from fleetlens.session import stored

SF = "/root/testdata/sf0.001"
VOCAB = [f"w{i}" for i in range(4000)]


def some(rng, n, vocab=VOCAB):
    return [rng.choice(vocab) for _ in range(n)]


def test_words_are_those_of_the_pattern():
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85\xa0aé漢b") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for limit in (1, 50, 1 << 20):
        got = []
        for part in slices(iter([batch]), "t", limit):
            w = Words(part.column("t"))
            data = w.buf.tobytes()
            got += [[data[w.start[i] : w.end[i]].decode() for i in range(w.first[r], w.first[r + 1])] for r in range(part.num_rows)]
            own = {}
            for i, h in enumerate(w.hashes().tolist()):
                assert own.setdefault(data[w.start[i] : w.end[i]], h) == h
            assert len(set(own.values())) == len(own)
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_tokens_as_the_library_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(2)
    marks = [*"aabbthe'sSdIİΣςßé ñ\t\n\x0b\x1c\x85\xa0᠎​　123½٣!?#%", "<|endoftext|>", "<|startoftext|>", "'LL", "'ve", "😀", "漢字", "aaaa", "ﬁ", "é"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a" * 3000, "", None, "\x00a"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(rows, path).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048)


def brute_repeats(texts, k):
    words = [(t or "").split() for t in texts]
    times = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if times[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append(" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("hot", [0, 3, 20_000])
@pytest.mark.parametrize("vocab", [2, 5, 4000])
def test_repeats_by_brute_force(spark, hot, vocab):
    rng, k = random.Random(vocab), 9
    passage = some(rng, 25)
    texts = []
    for _ in range(60):
        w = some(rng, rng.randint(0, 80), VOCAB[:vocab])
        if rng.random() < 0.5:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 5) : rng.randint(15, 25)]
        texts.append(rng.choice([" ", "\n"]).join(w))
    texts += texts[:5]
    rows = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substrings.remove_repeats(rows, k=k, m=3, hot=hot).select("doc_id", "n_words", "text").collect()
    want = [(i % 50, len(t.split()), x) for (i, t), x in zip(enumerate(texts), brute_repeats(texts, k), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_super_kmers_cover_all_windows():
    rng = random.Random(3)
    texts = [" ".join(some(rng, n, VOCAB[:30])) for n in (0, 5, 8, 9, 40, 200)]
    w = Words(pa.array(texts))
    first, n, _, at = substrings.super_kmers(w, 8, 3)
    seen = sorted(x for f, c in zip(first, n, strict=True) for x in range(f, f + c))
    assert seen == w.windows(w.hashes(), 8)[1].tolist()
    assert ((at >= n - 1) & (at <= 5)).all()


def test_myers_distance():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = random.Random(4)
    for _ in range(2000):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, 15))) for a in (1, 0))
        assert decontaminate.Pattern(p).best(t)[0] == plain(p, t)


def test_leaks_with_edits(spark):
    rng = random.Random(5)
    items = [(i, " ".join(some(rng, 30))) for i in range(20)]
    docs, want = [], set()
    for d in range(120):
        body = some(rng, 60)
        if d % 2:
            i = rng.randrange(20)
            text = list(items[i][1])
            edits = rng.choice([0, 3, int(0.05 * len(text)), int(0.2 * len(text))])
            for at in rng.sample(range(len(text)), edits):
                text[at] = rng.choice(["", "#", text[at] + "#"])
            body[30:30] = ["".join(text).upper() if d % 3 else "".join(text)]
            if edits <= 0.05 * len(items[i][1]):
                want.add((d, i))
        docs.append((d, " ".join(body)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        got = decontaminate.with_leaks(rows, bench, block=block).selectExpr("doc_id", "explode(leaks) x").select("doc_id", "x.item_id").collect()
        assert want <= {tuple(r) for r in got} and all(d % 2 for d, _ in got)


def test_items_of_few_words(spark):
    """Items of one word in a script without spaces and short ones are searched; short ones only without edits and as whole words."""
    rng = random.Random(6)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60))
    code = "reduce(lambda_accumulate,range(1000000),start=17)"
    items = [(1, han), (2, han[:12]), (3, "Cat  sat"), (4, code), (5, ""), (6, " \n")]
    texts = ["前文" + han[:30] + "#" + han[31:] + "后文", "很" + han[:12] + "好", "the cat sat.", "the cat sate", "bobcat sat", f"so {code[:20]}#{code[21:]}", "cats sat", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.with_leaks(docs, bench).selectExpr("doc_id", "inline(leaks)").select("doc_id", "item_id", "distance").collect()
    assert {tuple(r) for r in got} == {(0, 1, 1), (0, 2, 0), (1, 2, 0), (2, 3, 0), (5, 4, 1)}


def test_matching_and_templates():
    a = html.tree(["/body/div/p", "/body/div/ul", "/body/footer"])
    b = html.tree(["/body/div/p", "/body/aside", "/body/footer"])
    assert html.matching(a, b)[0] == 4
    both = html.merge(a, b)
    assert list(both["body"]) == ["div", "aside", "footer"]
    at = html.slots(both, b)
    assert len(set(at.values())) == len(at) == 5


def test_wrapper_drops_constant_texts(spark):
    rng = random.Random(6)
    pages, want = [], {}
    for i in range(40):
        body = " ".join(some(rng, 40))
        pages.append((i, "http://h.example/", f"<div><div>Welcome to our site</div><section><p>{body}<p>Read more &amp; more</section><ul><li><a href=x>{rng.choice(VOCAB)}</a></ul></div>"))
        want[i] = body
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(rows).collect()} == want


def test_language_held_out(spark):
    got = langid.op4_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_languages_with_few_rows_stay_in_the_sample(spark):
    """Of many rows, a rare language keeps all of its own, and copies of one text count once."""
    rng = random.Random(7)
    rows = [(" ".join(some(rng, 8)), "xx") for _ in range(4000)] + [(VOCAB[0], "xx")] * 2000
    rows += [("ωξψ φθδ", "yy"), ("λκσ ζμν", "yy"), ("жщю фъэ", "zz")]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(df, rows=300)
    assert model.langs == ["xx", "yy", "zz"]
    assert model.score(["w5 w77 w1234", "ξψ κσ ζμ", "щю фъэ"])[0] == ["xx", "yy", "zz"]
    assert np.allclose(np.exp(model.prior), np.array([6000, 2, 1]) / 6003)


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(7)
    ends = ["ab", "ore", "is", "unt", "ie", "ax"]

    def doc(toxic):
        w = some(rng, rng.randint(30, 300))
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "vejuk" + rng.choice(ends)])
        return " ".join(w)

    y = [i % 3 == 0 for i in range(900)]
    texts = [doc(t) for t in y]
    net = toxicity.train(texts[:600], [int(t) for t in y[:600]])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts[600:])], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(rows, net).collect()}
    hit = np.array([got[i] for i in range(300)])
    truth = np.array(y[600:])
    assert hit[truth].mean() > 0.9 and hit[~truth].mean() < 0.05


def test_toxicity_gradient():
    """Back-propagation against finite differences."""
    words = Words(pa.array(["a bb ccc dd e", "ff a bb"]), toxicity.BREAK)
    vocab = toxicity.Vocabulary(words)
    net = toxicity.Network.start(np.zeros(toxicity.BUCKETS, np.float32), np.zeros(toxicity.BUCKETS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, first, size = toxicity.windows(words)
    ids = toxicity.place(first, size, vocab.of)
    gates = [g.astype(np.float64) for g in net.gates(net.inputs(vocab))]
    out, kept = net.forward(gates, ids, size, keep=True)
    g, gf, gb = net.backward(np.ones(2, np.float32), kept, gates, ids)
    for k in ("Uf", "Ub", "v", "w"):
        at = tuple(0 for _ in net.p[k].shape)
        net.p[k][at] += 1e-3
        up = net.forward(gates, ids, size)[0].sum()
        net.p[k][at] -= 2e-3
        down = net.forward(gates, ids, size)[0].sum()
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3
    gates[0][1, 3] += 1e-3
    assert abs((net.forward(gates, ids, size)[0].sum() - out.sum()) / 1e-3 - gf[1, 3]) < 1e-2


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        w = Words(pa.array([" ".join("x" * n)]))
        _, first, size = toxicity.windows(w)
        assert {x for f, s in zip(first, size, strict=True) for x in range(f, f + s)} == set(range(n))


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def brute_classes(texts, least=0.8):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [2, 32])
def test_near_duplicate_classes(spark, monkeypatch, small):
    """Groups of near copies well above the threshold and other texts well below it; also with all buckets treated as large."""
    monkeypatch.setattr(minhash, "SMALL", small)
    rng, texts = random.Random(9), []
    for group in (1, 1, 2, 5, 60):
        base = some(rng, 400)
        for _ in range(group):
            w = list(base)
            for at in rng.sample(range(400), 2 if group > 1 else 0):
                w[at] = rng.choice(VOCAB)
            texts.append(" ".join(w))
    passage = some(rng, 150)
    texts += [" ".join([*some(rng, 200), *passage]) for _ in range(40)] + texts[:3] + ["a b", "a b", "b a"]
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    got = minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [c for _, c in sorted((r.doc_id, r.class_id) for r in got)] == brute_classes(texts)


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(10)
    hits, n, jaccard = 0, 300, 0.0
    for _ in range(n):
        h = rng.integers(0, 2**63, 120).astype(np.uint64)
        h.sort()
        w = rng.uniform(1, 2, 120).astype(np.float32)
        a, b = np.arange(0, 110), np.arange(10, 120)
        jaccard += w[10:110].sum() / w.sum() / n
        keys = [minhash.samples(np.zeros(110, np.int64), h[x], w[x])[2][0] for x in (a, b)]
        hits += (keys[0] == keys[1]).sum()
    share = hits / (n * minhash.BANDS)
    assert abs(share - jaccard**minhash.ROWS) < 0.04


def test_pairs_outside_the_largest_class_of_a_wide_bucket(spark, monkeypatch):
    """All texts share all bands, and pairs of like texts stand beside a large class; a cell takes 16 texts a side."""
    for name in ("samples", "plain_samples"):
        if old := getattr(minhash, name, None):
            monkeypatch.setattr(minhash, name, lambda *x, old=old: (*(got := old(*x))[:2], np.zeros_like(got[2])))
    monkeypatch.setattr(minhash, "CELL", 16, raising=False)
    rng = random.Random(14)
    base, texts = some(rng, 200), []
    for _ in range(100):
        w = list(base)
        w[rng.randrange(200)] = rng.choice(VOCAB)
        texts.append(" ".join(w))
    for _ in range(60):
        w = some(rng, 200)
        texts += [" ".join(w), " ".join([*w[:-2], *some(rng, 2)])]
    got = minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [c for _, c in sorted((r.doc_id, r.class_id) for r in got)] == brute_classes(texts)


def test_pairs_whose_common_shingles_are_frequent_are_candidates(spark):
    """Plain similarity 0.8 or a little more, the weighted one about 0.68: as many are found as of pairs that are similar by weight."""
    rng = random.Random(13)
    texts, common = [], []
    for _ in range(600):
        body = some(rng, 324)
        common.append(" ".join(body))
        texts += [" ".join(body + some(rng, 39)), " ".join(body + some(rng, 39))]
    known = np.unique(minhash.shingles(Words(pa.array(common)))[1])

    class Given:
        @property
        def value(self):
            return self

        def of(self, hashes, counts):
            return np.where(np.isin(hashes, known), 1, 2).astype(np.float32)

    rows = spark.createDataFrame([(i // 2, f"{i}", t) for i, t in enumerate(texts)], "doc_id long, key string, text string")
    signed = stored(minhash.signatures(rows, Given()))
    flat = signed.selectExpr("doc_id", "key", "posexplode(bands) as (band, h)")
    pairs = flat.alias("x").join(flat.alias("y"), ["doc_id", "band", "h"]).where("x.key < y.key").selectExpr("x.key a", "y.key b").distinct()
    assert minhash.likely(pairs, signed).count() >= 597


def test_document_frequencies_are_those_of_the_shingle(spark):
    """A shingle of one document weighs as such, however many others there are, and a frequent one by its own count."""
    rng = random.Random(12)
    frame = some(rng, 30)
    texts = [" ".join(some(rng, 300) + (frame if i % 10 == 0 else [])) for i in range(2000)]
    weights = minhash.frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    _, h, counts = minhash.shingles(Words(pa.array([" ".join(some(rng, 5)), " ".join(frame[:5])])))
    _, h2, _ = minhash.shingles(Words(pa.array([" ".join(texts[1].split()[:300])])))
    idf = lambda df: 1 + np.log(2001 / (df + 1)) / np.log(2001)
    assert np.allclose(weights.of(h2, np.ones(len(h2), int)), idf(1), atol=1e-5)
    assert np.allclose(weights.of(h2.astype(np.uint32), np.ones(len(h2), int)), idf(1), atol=1e-5)
    assert np.allclose(weights.of(h, counts), [idf(1), idf(200)], atol=1e-5)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, budget = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(full.values())
        got = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if got[s] > cap * sizes[s]]
        if not over:
            return full | got
        full |= {s: cap * sizes[s] for s in over}


def test_targets_and_copies(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["a", "b", "c", "d", "é", "Z", None]), rng.choice([0, 1, 5, 30, 200])) for i in range(3000)]
    rows += [(9999, "a", 30)] * 50
    sizes = Counter()
    for _, s, z in rows:
        sizes[s] += z
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.plan(df, block=16).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.plan(df.repartition(5), block=16).collect()}
    want, taken = plain_targets(sizes), Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source]
        assert r.copies <= 2 * r.n and (r.size > 0 or r.copies == 0)
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200


def test_copies_are_unbiased(spark):
    """Over many seeds, each document's copies average its rate."""
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", 1 + i % 7) for i in range(40)], "doc_id long, source string, size long")
    total, rate = Counter(), {}
    for seed in range(12):
        for r in mixing.plan(rows, seed=seed, block=8).collect():
            total[r.doc_id] += r.copies / 12
            rate[r.doc_id] = r.target / r.source_size
    assert abs(sum(total[i] - rate[i] for i in rate)) / len(rate) < 0.1
    assert all(abs(total[i] - rate[i]) < 0.8 for i in rate)


def test_rules_do_not_depend_on_their_order(spark):
    rows = quality.with_signals(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rules = quality.default_rules()
    one = {(r.doc_id, r.kept) for r in quality.cascade(rows, rules).select("doc_id", "kept").collect()}
    assert one == {(r.doc_id, r.kept) for r in quality.cascade(rows, rules[::-1]).select("doc_id", "kept").collect()}
    few = spark.createDataFrame(rows.limit(50).collect(), rows.schema)
    assert {r.name for r in quality.ordered(few, rules)} == {r.name for r in rules}


def brute_runs(texts):
    """Lines left of each text: every run of two or more lines with words that stands at an earlier place goes, by all pairs of places."""
    split = [t.split("\n") for t in texts]
    worded = [[i for i, x in enumerate(own) if x.strip()] for own in split]
    gone = [set() for _ in texts]
    for d, own in enumerate(split):
        for k, a in enumerate(worded[d]):
            for e in range(d + 1):
                for j, b in enumerate(worded[e]):
                    if (e, b) >= (d, a):
                        break
                    n = 0
                    while k + n < len(worded[d]) and j + n < len(worded[e]) and own[a : worded[d][k + n] + 1] == split[e][b : worded[e][j + n] + 1]:
                        n += 1
                    if n > 1:
                        gone[d] |= set(range(a, worded[d][k + n - 1] + 1))
    return ["\n".join(x for i, x in enumerate(own) if i not in gone[d]) for d, own in enumerate(split)]


@pytest.mark.parametrize("length", [2, 3, 5, 8, 20])
def test_passages_of_lines_go_whole(spark, length):
    """Otherwise different texts that share one passage: the later of each pair loses the passage and nothing else."""
    rng = random.Random(length)
    line = lambda: " ".join(some(rng, 6))
    texts, want = [], []
    for _ in range(60):
        passage = [line() for _ in range(length)]
        for own in ([], passage):
            head, tail = [line() for _ in range(rng.randint(0, 9))], [line() for _ in range(rng.randint(1, 9))]
            texts.append("\n".join(head + passage + tail))
            want.append("\n".join(head + tail) if own else texts[-1])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(rows).collect()}
    assert [got[i].text for i in range(len(texts))] == want
    assert [got[i].n_removed_lines for i in range(len(texts))] == [length * (i % 2) for i in range(len(texts))]


@pytest.mark.parametrize("vocab", [2, 4, 12])
def test_lines_by_brute_force(spark, vocab):
    """Few different lines, blank ones among them, so runs overlap, touch and repeat within a text."""
    rng = random.Random(vocab)
    texts = ["\n".join(rng.choice([*VOCAB[:vocab], "", " \t"]) for _ in range(rng.randint(0, 14))) for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_runs(texts)


def extracted(spark, pages):
    """page_id -> main text of (host, html) pages, numbered in order."""
    rows = [(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(pages)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [t for _, t in sorted((r.page_id, r.text) for r in got)]


def test_names_inside_an_article_are_its_own(spark):
    parts = [
        '<header class="entry-header"><h1>Title</h1></header>', '<div class="article-header"><p>By someone</p></div>',
        '<section id="related-work"><p>Earlier work</p></section>', '<table class="widget-prices"><tr><td>12</td></tr></table>',
        '<div class="header"><h2 class="notice">Heading</h2></div>',
    ]
    gone = ['<section class="comments"><p>first!</p></section>', '<div id="ad">Buy</div>', "<nav>next</nav>", "<aside>see also</aside>", '<div role="search">find</div>']
    page = "<body><div class=site-header>Site</div><article>" + "".join(a + b for a, b in zip(parts, gone, strict=True)) + "</article></body>"
    assert extracted(spark, [("a.example", page)]) == ["Title By someone Earlier work 12 Heading"]
    assert extracted(spark, [("a.example", "<body><div class=site-header>Site</div><p>Text</p></body>")]) == ["Text"]


def test_wrapper_on_hosts_of_few_pages(spark):
    rng = random.Random(8)
    own = [" ".join(some(rng, 30)) for _ in range(6)]
    wrap = lambda x: f"<body><div>Welcome</div><section><p>{x}</p></section><div>All rights reserved</div></body>"
    two, one = [("two.example", wrap(x)) for x in own[:2]], [("one.example", wrap(own[2]))]
    # near copies of one article are no wrapper, neither are copies of a page
    near = [("near.example", f"<body><p>{own[3]}</p><p>{x}</p></body>") for x in ("first", "second")]
    same = [("same.example", wrap(own[4]))] * 3
    got = extracted(spark, two + one + near + same)
    assert got[:2] == own[:2] and got[2] == f"Welcome {own[2]} All rights reserved"
    assert got[3:5] == [f"{own[3]} first", f"{own[3]} second"] and got[5:] == [f"Welcome {own[4]} All rights reserved"] * 3


def test_wrapper_of_page_types(spark):
    """Two types of pages on one host, neither on 80 % of it: what is constant on the pages that have its node goes."""
    rng = random.Random(9)
    own = [" ".join(some(rng, 30)) for _ in range(24)]
    types = ["<body><section><h2>Latest news</h2><p>{}</p></section></body>", "<body><table><tr><th>Name of the part</th><td>{}</td></tr></table></body>"]
    assert extracted(spark, [("h.example", types[i % 2].format(x)) for i, x in enumerate(own)]) == own


def test_pages_nested_deeply(spark):
    page = "<div>" * 3000 + "deep" + "</div>" * 3000 + '<p class="a/b">end</p>'
    assert extracted(spark, [("h.example", page), ("h.example", "<p>other")]) == ["deep end", "other"]


def plain_pages(pages):
    """Main texts of well-formed pages without class, id and role, by the standard library's parser: a text that stands under
    one path on 80 % (and 5) of the host's different pages that have the path is dropped; so are elements outside of articles."""
    from collections import defaultdict
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.out, self.text = [], [], ""

        def flush(self):
            if self.text.split() and not set(self.path) & {"nav", "footer", "head", "script", "style", "aside", "form"}:
                self.out.append(("/".join(self.path), " ".join(self.text.split())))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            self.flush()
            self.path.append(tag)

        def handle_endtag(self, tag):
            self.flush()
            assert self.path.pop() == tag

        def handle_data(self, data):
            self.text += data

    parsed = []
    for h, x in pages:
        p = Parser()
        p.feed(x)
        p.flush()
        parsed.append((h, tuple(p.out)))
    having, times = defaultdict(set), defaultdict(set)
    for h, own in parsed:
        for path, text in own:
            having[h, path].add(frozenset(own))
            times[h, path, text].add(frozenset(own))
    keep = lambda h, path, text: len(times[h, path, text]) < 5 or len(times[h, path, text]) < 0.8 * len(having[h, path])
    return [" ".join(text for path, text in own if keep(h, path, text)) for h, own in parsed]


def test_pages_by_a_plain_version(spark):
    rng = random.Random(10)
    fixed = {h: [" ".join(some(rng, 4)) for _ in range(6)] for h in "abc"}
    pages = []
    for i in range(90):
        h = "abc"[i % 3]
        texts = [" ".join(some(rng, rng.randint(3, 20))) if rng.random() < 0.6 else f for f in fixed[h]]
        always = fixed[h][0] if rng.random() < 0.9 else "other"
        kinds = ["section", "blockquote", "ul", "dl", "table", "pre"][: rng.randint(2, 6)]
        inner = "".join(f"<{k}>{t}</{k}>" if k != "ul" else f"<ul><li>{t}</li><li>{fixed[h][3]}</li></ul>" for k, t in zip(kinds, texts))
        pages.append((h, f"<html><head><title>x</title></head><body><nav>menu</nav><div>{always}</div>{inner}<footer>f</footer></body></html>"))
    assert extracted(spark, pages) == plain_pages(pages)


def test_language_by_plain_counts(spark):
    """Labels and posteriors of a naive Bayes that counts n-grams one by one, on the given documents and odd texts."""
    import math

    def features(text):
        t = "".join(c if c.isalpha() else " " for c in text.lower())
        t = f" {' '.join(t.split())} "
        own = [t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)]
        keys = [sum(ord(c) << 21 * i for i, c in enumerate(g)) for g in own if g != " "]
        lengths = [len(g) for g in own if g != " "]
        return [int(langid.mix(np.array([k], np.uint64), n)[0]) % langid.BUCKETS for k, n in zip(keys, lengths, strict=True)]

    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect() if r.text and r.lang]
    rows = [(r.text[:400], r.lang) for r in rows][:60]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    counts, docs = {}, Counter(x for _, x in rows)
    for text, x in rows:
        counts.setdefault(x, Counter()).update(features(text))
    tried = [t for t, _ in rows[:25]] + ["the house", "Straße ÄÖ", "él año", "x", "a1b--c  d", "漢字 かな", "İstanbul"]
    names, p = model.score(tried)
    for text, name, score in zip(tried, names, p, strict=True):
        own = features(text)
        total = {}
        for x, c in counts.items():
            below = sum(c.values()) + 0.1 * langid.BUCKETS
            total[x] = math.log(docs[x] / len(rows)) + sum(math.log((c[b] + 0.1) / below) for b in own)
        best = max(total.values())
        want = 1 / sum(math.exp(v - best) for v in total.values())
        assert total[name] == pytest.approx(best, abs=1e-6) and score == pytest.approx(want, abs=1e-6), text
    assert model.score(["", None, "12 %"])[0] == ["und"] * 3


def test_toxicity_score_by_a_plain_network(spark):
    """Every window of a text scored word by word in double precision; the worst one counts."""
    import re

    rng, t = np.random.default_rng(11), toxicity
    net = t.Network.start(*(rng.normal(0, 1, t.BUCKETS).astype(np.float32) for _ in range(2)))
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        bucket = int(Words(pa.array([word]), t.BREAK).hashes()[0]) % t.BUCKETS
        marked = f"<{word}>".encode()
        own = [(n, int.from_bytes(marked[i : i + n], "little")) for n in t.GRAMS for i in range(len(marked) - n + 1)]
        own = [int(t.mix(np.array([k], np.uint64), n)[0]) % t.BUCKETS for n, k in own]
        odds = [p["gram_odds"][b] for b in own]
        chars = sum((p["char"][b] for b in own), np.zeros(t.CHAR_DIM)) / max(len(own), 1)
        return np.concatenate([p["word"][bucket], chars, [p["word_odds"][bucket], sum(odds) / max(len(own), 1), max([-9, *odds])]])

    def direction(d, xs):
        h, out, k = np.zeros(t.HIDDEN), [], t.HIDDEN
        for x in xs:
            a, u = x @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            z, r = sig(a[:k] + u[:k]), sig(a[k : 2 * k] + u[k : 2 * k])
            n = np.tanh(a[2 * k :] + r * u[2 * k :])
            h = n + z * (h - n)
            out.append(h)
        return out

    def plain(text):
        words = re.findall(r"[a-z0-9]+", text.lower())
        if not words:
            return 0.0
        logits, at = [], 0
        while True:
            xs = [vector(w) for w in words[at : at + t.WINDOW]]
            h = [np.concatenate(x) for x in zip(direction("f", xs), direction("b", xs[::-1])[::-1], strict=True)]
            att = np.exp([x @ p["v"] for x in h])
            logits.append(sum(a * x for a, x in zip(att / att.sum(), h, strict=True)) @ p["w"] + p["b"][0])
            if at + t.WINDOW >= len(words):
                return float(sig(max(logits)))
            at += t.STEP

    own = random.Random(11)
    texts = [" ".join(some(own, n)) for n in (1, 2, 63, 64, 65, 112, 113, 160, 161, 300)] + ["", " ?!", "One, TWO;three-Four"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in t.score(rows, net).collect()}
    for i, text in enumerate(texts):
        want = plain(text)
        assert got[i].score == pytest.approx(want, abs=1e-4), i
        assert got[i].predicted == int(got[i].score >= t.THRESHOLD)
