"""Registered queries against their SQL, and each pipeline stage against a plain version on the rows it got."""

import hashlib
from collections import defaultdict

import pytest

from check_oracle import compare
from fleetlens.llm import toxicity
from fleetlens.llm.queries import ORACLE, QUERIES
from fleetlens.session import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = compare(spark, duck, name, QUERIES[name], ORACLE.get(name), SF)
    assert str(got["status"]).startswith(("ok", "rows-only")), got


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def plain_lines(rows):
    """doc_id -> text after line dedup; documents that lose all words are absent."""
    pairs = []
    for r in rows:
        lines = r.text.split("\n")
        worded = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\f\r")]
        pairs += [((r.doc_id, md5(r.text), a, b), tuple(lines[a : b + 1])) for a, b in zip(worded, worded[1:])]
    first, gone = {}, defaultdict(set)
    for place, own in sorted(pairs):
        if first.setdefault(own, place) != place:
            gone[place[0]] |= set(range(place[2], place[3] + 1))
    out = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id]) for r in rows}
    return {k: t for k, t in out.items() if not gone[k] or t.split()}


def plain_near(rows, least=0.8):
    sets = []
    for r in rows:
        w = r.text.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[a] = b
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r.doc_id), r.doc_id)
    return set(best.values())


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "toxicity":
            raw = spark.read.parquet(f"{SF}/documents.parquet")
            net = toxicity.fit(raw, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = {r.doc_id: r.predicted for r in toxicity.score(raw, net).collect()}
            assert set(after) == {k for k, p in scores.items() if not p}
        elif name == "line_dedup":
            assert {k: r.text for k, r in after.items()} == plain_lines(before)
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            assert set(after) == plain_near(before)
        elif name == "decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = {r.doc_id for r in before if not any(x in " ".join(r.text.lower().split()) for x in items)}
            assert set(after) == clean
        else:
            assert set(after) == {r.doc_id for r in before}
            assert all(r.taken == r.copies * len(r.text.split()) and r.copies <= 2 for r in after.values())
            total = defaultdict(int)
            for r in after.values():
                total[r.source] += r.taken
            longest = max(r.size for r in after.values())
            assert all(abs(total[r.source] - r.target) <= longest for r in after.values())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in after.values()}
