"""Main text of web pages by wrapper induction.

The block elements of a page form a tree, in which siblings of one kind are one node (a list of records is
one slot). Trees of a host's pages are aligned by simple tree matching into a template; a text that stands at the
same node of most of the host's pages that have this node is part of the template, and the slots whose texts vary are
content, unless the kind of element they lie in, or its role, says that they are navigation, forms or the like.
Outside of articles, class and id words say so too; inside, only a class or id that is such a word as a whole does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import slices
from fleetlens.session import stored

#: The trees of a host are merged in this many cells first, so that no task merges all of a large host's.
CELLS = 16
#: A text is template if it stands at one node on this share of the host's different pages that have the node, and on so
#: many; on hosts of fewer pages, on all of them, two at least.
CONSTANT, LEAST = 0.8, 5
#: Nodes below this depth belong to the node at it.
DEEP = 60
#: Templates up to this size in all are broadcast; beyond it, pages are joined with them by host.
BROADCAST = 32 << 20

# HTML's element kinds, and the words that name what is not an article.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td template "
    "textarea tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math object xmp noembed noframes title".split())
CLOSES = {x: {"p"} for x in BLOCK - {"body", "html", "head", "option", "title"}} | {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
SCOPE = set("article aside blockquote body button div dl fieldset footer form header html main menu nav ol section table td th ul".split())
OUTSIDE = set("aside button dialog footer form head menu nav select".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMED = set(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification outbrain pager pagination popup promo "
    "promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "taboola toolbar widget widgets".split()
)

# Names that an article's own parts have as well.
OWN = set("banner header masthead".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))|[^<]+|<""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _outside(tag: str, attributes: dict[str, str], article: bool) -> bool:
    """Whether an element and all in it is no part of an article."""
    if tag in OUTSIDE or tag == "header" and not article or "hidden" in attributes or attributes.get("role", "") in ROLES:
        return True
    if tag in ("article", "main", "body", "html") or tag in HEADINGS:
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if article:
        return any(w in NAMED and w not in OWN for w in names.split())
    return any(w in NAMED for w in re.split(r"[^a-z]+", names))


def blocks(html: str | None) -> list[tuple[str, str, int, bool, bool]]:
    """(path, text, characters in links, in an article, outside by its markup) of each block with text, in order."""
    out: list[tuple[str, str, int, bool, bool]] = []
    # an open element: tag, path of its block, in an article, outside
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
    text: list[str] = []
    links = depth = 0
    html = html or ""

    def flush() -> None:
        nonlocal links
        if text:
            own = " ".join("".join(text).split())
            if own:
                _, path, article, outside = stack[-1]
                out.append((path, own, links, article, outside))
            text.clear()
        links = 0

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if html[m.start()] != "<" or m.end() == m.start() + 1:
                piece = unescape(m[0])
                text.append(piece)
                if depth:
                    links += len(piece.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                depth = max(0, depth - 1)
            if any(x[0] == tag for x in stack):
                if tag in BLOCK:
                    flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            text.append(" ")
            continue
        if tag in CLOSES:
            flush()
            # close what this element ends, inside the innermost container
            i = len(stack) - 1
            while i > 0 and (stack[i][0] in CLOSES[tag] or stack[i][0] not in SCOPE):
                if stack[i][0] in CLOSES[tag]:
                    del stack[i:]
                i -= 1
        elif tag in BLOCK:
            flush()
        _, path, article, outside = stack[-1]
        attributes = {k.lower(): (v or "").strip("\"'").lower() for k, v in ATTRIBUTE.findall(m[3])} if len(m[3]) > 6 else {}
        if not outside:
            outside = _outside(tag, attributes, article)
        if tag == "a":
            depth += 1
        if tag in BLOCK:
            depth = 0
            kind = attributes.get("class", "").split()[:1]
            if path.count("/") < DEEP:
                # no "/" of a class may part the path
                path = f"{path}/{tag}{'.' if kind else ''}{''.join(kind).replace('/', '|')}"
        stack.append((tag, path, article or tag in ("article", "main"), outside))
    flush()
    return out


Tree = dict  # label -> Tree, in the order of the page


def tree(paths: list[str]) -> Tree:
    root: Tree = {}
    for p in paths:
        node = root
        for label in p.split("/")[1:]:
            node = node.setdefault(label, {})
    return root


def matching(a: Tree, b: Tree) -> tuple[int, list]:
    """Simple tree matching of two lists of children: the size of the largest ordered matching, in which matched
    nodes have the same label and matched parents, and its pairs (label, matching below)."""
    x, y = list(a), list(b)
    size = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    below: dict[tuple[int, int], tuple[int, list]] = {}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best = max(size[i][j + 1], size[i + 1][j])
            if p == q:
                below[i, j] = matching(a[p], b[q])
                best = max(best, size[i][j] + 1 + below[i, j][0])
            size[i + 1][j + 1] = best
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if size[i][j] == size[i - 1][j]:
            i -= 1
        elif size[i][j] == size[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((x[i], below[i, j][1]))
    return size[-1][-1], pairs[::-1]


def merge(template: Tree, page: Tree) -> Tree:
    """``template`` with the nodes of ``page`` that it lacks, each after its matched or merged left sibling."""
    matched = {label for label, _ in matching(template, page)[1]}
    out, last = list(template), None
    for label in page:
        if label not in template:
            out.insert(0 if last is None else out.index(last) + 1, label)
        if label in matched or label not in template:
            last = label
    return {x: merge(template.get(x, {}), page[x]) if x in page else template[x] for x in out}


def slots(template: Tree, page: Tree) -> dict[str, int]:
    """The number of the template's node, in its own order, for each path of the page that is matched."""
    found: dict[str, int] = {}

    def number(node: Tree, path: str, n: int, into: dict[str, int]) -> int:
        for label, below in node.items():
            into[f"{path}/{label}"] = n
            n = number(below, f"{path}/{label}", n + 1, into)
        return n

    numbers: dict[str, int] = {}
    number(template, "", 0, numbers)

    def walk(pairs: list, path: str) -> None:
        for label, below in pairs:
            found[f"{path}/{label}"] = numbers[f"{path}/{label}"]
            walk(below, f"{path}/{label}")

    walk(matching(template, page)[1], "")
    return found


class Aligner:
    """Blocks of pages with the slots of their host's template; trees that were seen before are not matched again."""

    def __init__(self):
        self.known: dict[tuple, dict[str, int]] = {}

    def __call__(self, html: str | None, template: str | None) -> list[tuple[str, str, int, bool, bool]]:
        own = blocks(html)
        paths = list(dict.fromkeys(b[0] for b in own))
        key = (template, *paths)
        if key not in self.known:
            if len(self.known) > 5000:
                self.known.clear()
            self.known[key] = slots(json.loads(template) if template else {}, tree(paths))
        at = self.known[key]
        # a block at an unmatched node keeps its path as its slot
        return [(str(at[b[0]]) if b[0] in at else b[0], *b[1:]) for b in own]


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, template (its tree as JSON) and constant (slot and hash of the texts that are part of it) of each
    host of ``pages`` (host, page_id, html)."""

    def induce(rows: pd.DataFrame) -> pd.DataFrame:
        template: Tree = {}
        for own in rows.sort_values(["o", "template"])["template"]:
            template = merge(template, json.loads(own))
        return pd.DataFrame({"host": rows["host"].iloc[:1], "o": rows["o"].min(), "template": [json.dumps(template)]})

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2 << 20):
            seen = {(h, tuple(dict.fromkeys(b[0] for b in blocks(html)))) for h, html in zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True)}
            rows = [(h, json.dumps(tree(list(paths)))) for h, paths in sorted(seen)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["host", "template"])

    # every different tree of a host takes part, once
    different = pages.select("host", "html").mapInArrow(trees, "host string, template string").distinct()
    different = different.select("host", F.xxhash64("template").alias("o"), "template")
    kind = "host string, o long, template string"
    cells = different.groupBy("host", F.pmod("o", F.lit(CELLS)).alias("cell")).applyInPandas(induce, kind)
    templates = stored(cells.groupBy("host").applyInPandas(induce, kind).select("host", "template"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        for batch in slices(batches, "html", 2 << 20):
            out: dict[str, list] = {"host": [], "page": [], "longest": [], "slot": [], "h": []}
            for h, html, template in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "template")), strict=True):
                parts = [b for b in align(html, template) if not b[4]]
                own = {(b[0], _hash(b[1])) for b in parts}
                page = _hash(repr(sorted(own)))
                longest = _hash(max((b[1] for b in parts), key=lambda x: (len(x), x), default=""))
                for slot, x in own:
                    out["host"].append(h)
                    out["page"].append(page)
                    out["longest"].append(longest)
                    out["slot"].append(slot)
                    out["h"].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k in ("host", "slot") else pa.int64()) for k, v in out.items()], names=list(out))

    rows = _with(pages, templates).select("host", "html", "template").mapInArrow(texts, "host string, page long, longest long, slot string, h long")
    # copies of a page count once
    seen = stored(rows.distinct())
    times = seen.groupBy("host", "slot", "h").agg(F.count("*").alias("n"), (F.min("longest") != F.max("longest")).alias("differ")).where("n > 1")
    of = seen.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count("*").alias("having"))
    pages_of = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    few = F.col("pages") < LEAST
    # on a host of few pages, what near copies of one article share is no template: their longest texts must differ
    enough = F.when(few, (F.col("n") == F.col("pages")) & F.col("differ")).otherwise(F.col("n") >= LEAST)
    constant = times.join(of, ["host", "slot"]).join(pages_of, "host").where(enough & (F.col("n") >= CONSTANT * F.col("having")))
    return templates.join(constant.groupBy("host").agg(F.collect_list(F.struct("slot", "h")).alias("constant")), "host", "left")


def _with(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``pages`` joined with what is known of their hosts; small wrappers are broadcast, so pages stay where they are."""
    size = wrappers.agg(F.sum(F.length("template") + F.length("host") + 64)).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST else wrappers, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every row of ``pages`` (page_id, url, html), with n_chars, its code points.

    Where a page has an article or main element, its content is the varying blocks in it; else all varying blocks
    that are not mostly links. Extra columns of ``pages`` are left out. A null or empty page has an empty text; equal rows get equal texts; a page
    without a host shares the template of such pages.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host())
    known = stored(wrappers(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        for batch in slices(batches, "html", 2 << 20):
            got = []
            for html, template, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "template", "constant")), strict=True):
                own = align(html, template)
                drop = {(c["slot"], c["h"]) for c in constant or ()}
                inside = any(b[3] and not b[4] for b in own)
                kept = [b[1] for b in own if not b[4] and (b[3] if inside else 10 * b[2] <= 6 * len(b[1])) and not (drop and (b[0], _hash(b[1])) in drop)]
                got.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return _with(rows, known).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir):
    """op7: page_id, url, text and n_chars of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
