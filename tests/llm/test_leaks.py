"""Benchmark items in documents, against a plain table of edit distances, both ways."""

from random import Random

import pytest

from fleetlens.llm import decontaminate


def plain(item, text):
    """The least edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        out[i : i + 1] = r.choice([[], ["q"], [out[i], "z"]])
    return "".join(out)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_items_found_are_those_within_budget(spark, kind):
    r = Random(5)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.randrange(12, 20))) for i in range(12)]
    docs = []
    for i in range(60):
        own = items[i % 12][1]
        budget = int(0.05 * len(own))
        docs.append((i, prose(10) + " " + edited(r, own, i % (2 * budget + 2)) + " " + prose(10)))
    ident = (lambda i: f"q-{i:02d}") if kind == "string" else (lambda i: i)
    bench = spark.createDataFrame([(ident(i), t) for i, t in items], f"item_id {kind}, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for i, t in docs:
        for k, own in items:
            d = plain(decontaminate.normal(own), decontaminate.normal(t))
            if d <= int(0.05 * len(own)):
                want[i, ident(k)] = d
    texts = {i: decontaminate.normal(t) for i, t in docs}
    own = {ident(k): t for k, t in items}
    for block in (decontaminate.BLOCK, 5):
        got = decontaminate.with_leaks(rows, bench, block=block).selectExpr("doc_id", "inline(leaks)").collect()
        assert {(x.doc_id, x.item_id): x.distance for x in got} == want
        # the place named is one at that distance
        assert all(distance(own[x.item_id], texts[x.doc_id][x.start : x.end]) == x.distance for x in got)
    assert len(want) >= 25
