"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import public_tokenizers
import pytest

from fleetlens.llm import decontaminate, html, langid, lines, minhash, mixing, quality, substrings, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["size", "n", "score", "key", "th", "host", "bands", "starts", "spans", "leaks", "block", "copies", "n_words", "kept", "predicted", "n_tokens", "lang_pred"]


def prose(seed: int, n: int) -> str:
    """Words that hardly repeat."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("".join(chr(97 + (x >> s) % 26) for s in (13, 19, 25, 31, 37)))
    return " ".join(out)


LONG = prose(1, 30_000)
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 4),
    (4, prose(2, 60) + "\n" + prose(3, 60), "en", "b", 700),
    (4, prose(2, 60) + "\n" + prose(3, 60), "en", "b", 700),  # the row again
    (4, prose(4, 50), "en", "b", 300),  # its id again
    (5, prose(2, 60) + "\n" + prose(3, 60), "en", None, 700),  # its text again
    (None, prose(2, 60) + "\n" + prose(3, 60), None, None, 700),
    (None, None, None, None, None),
    (6, LONG, "fr", "b", len(LONG)),
    (7, "one two", "fr", "c", 7),
    (8, "Ünï ©ôdé 漢字 \U0001f600 " * 40, "de", "c", 600),
]
ITEMS = [(1, prose(2, 20)), (2, None), (3, ""), (4, prose(9, 30)), (1, prose(2, 20)), (None, prose(4, 20)), (5, "one two")]
LABELS = [(4, 1, 0), (5, 1, 1), (7, 0, 0), (None, 1, 1), (6, None, None), (8, 1, 1), (8, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in EXTRA})


def net():
    return toxicity.train(["vile " * 30, prose(5, 40), "so vile a man", prose(6, 40)] * 4, [1, 0, 1, 0] * 4)


def operators(bench, net):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = langid.Model(["en"], __import__("numpy").zeros((1, langid.BUCKETS)), __import__("numpy").zeros(1))
    return {
        "mix": lambda d: mixing.mix(d),
        "quality": lambda d: quality.judge(d),
        "near": lambda d: minhash.classes(d),
        "dedup": lambda d: minhash.dedup(d),
        "lang": lambda d: langid.predict(d, model),
        "lines": lambda d: lines.dedup_lines(d),
        "toxicity": lambda d: toxicity.score(d, net),
        "leaks": lambda d: decontaminate.with_leaks(d, bench),
        "substrings": lambda d: substrings.remove_repeats(d),
        "tokens": lambda d: tokens.count_tokens(d, path),
    }


NAMES = ["mix", "quality", "near", "dedup", "lang", "lines", "toxicity", "leaks", "substrings", "tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_operator(docs, bench, name):
    run = operators(bench, net())[name]
    got = run(clashing(docs)).collect()
    if name != "dedup":
        assert len(got) == len(ROWS)
    # equal rows, equal results; other columns stay
    if name not in ("near", "mix", "dedup"):
        twice = [r for r in got if r.doc_id == 4 and r.source == "b" and r.n_chars == 700]
        assert len(twice) == 2 and twice[0] == twice[1]
    if name != "near":
        assert all(r.block == "own block" for r in got)
    assert run(docs.limit(0)).collect() == []


def test_results(docs, bench):
    ops = operators(bench, net())
    by = lambda rows, i, n=None: [r for r in rows if r.doc_id == i and (n is None or r.n_chars == n)]
    q = ops["quality"](docs).collect()
    assert (by(q, 1)[0].n_words, by(q, 1)[0].base_failed, by(q, 1)[0].kept) == (0, True, False)
    assert by(q, 6)[0].n_words == 30_000 and by(q, 6)[0].kept
    near = ops["near"](docs).collect()
    assert {r.class_id for r in near if r.doc_id == 5} == {4}
    assert sorted(r.doc_id for r in ops["dedup"](docs).collect() if r.doc_id in (4, 5)) == [4, 4]
    leaks = ops["leaks"](docs).collect()
    assert [x.item_id for x in by(leaks, 4, 700)[0].leaks] == [1] and by(leaks, 1)[0].leaks == []
    assert [x.item_id for x in by(leaks, 4, 300)[0].leaks] == [None]
    cut = ops["substrings"](docs).collect()
    assert [(r.n_words, r.n_removed, r.text) for r in by(cut, 4, 700)] == [(120, 120, "")] * 2
    assert (by(cut, 6)[0].n_removed, by(cut, 6)[0].text) == (0, LONG) and by(cut, 1)[0].text == ""
    own = ops["lines"](docs).collect()
    assert by(own, 1)[0].text is None and by(own, 1)[0].n_lines == 0 and by(own, 2)[0].n_lines == 1
    assert [r.n_removed_lines for r in by(own, 5)] == [2]
    mixed = ops["mix"](docs).collect()
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in mixed)
    assert by(mixed, 1)[0].size == 0 and by(mixed, 1)[0].taken == 0
    scores = ops["toxicity"](docs).collect()
    assert all(0 <= r.score <= 1 for r in scores) and by(scores, 2)[0].score == 0
    assert by(ops["lang"](docs).collect(), 3)[0].lang_pred == "und"


def test_pages(spark):
    rows = [
        (1, "http://a.example/x", "<nav>menu</nav><article><h1>T</h1><p>one &amp; two</p></article><footer>f</footer>"),
        (2, None, None), (3, "", ""), (None, "http://a.example/y", "plain < text"), (1, "http://a.example/x", "<p>" + LONG),
        (4, "//B.example:80/z", "<script>if (a < b) { '</p>' }</script><p>x<br>y"), (5, "http://a.example", "<p class=\"o'ne>two"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url): r for r in html.extract(pages).collect()}
    assert len(html.extract(pages).collect()) == len(rows)
    assert got[2, None].text == "" and got[2, None].n_chars == 0
    assert got[None, "http://a.example/y"].text == "plain < text"
    assert got[4, "//B.example:80/z"].text == "x y"
    assert {r.n_chars for r in html.extract(pages).collect() if r.page_id == 1} == {len("T one & two"), len(LONG)}
    assert html.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, docs, bench, labels, stage, tmp_path):
    import corpus_pipeline

    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    _, run = corpus_pipeline.STAGES[stage]
    got = run(spark, docs, str(tmp_path))
    assert stage == 4 or got.columns == docs.columns
    got.collect()
    assert run(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_stage_without_labels(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == len(ROWS)
