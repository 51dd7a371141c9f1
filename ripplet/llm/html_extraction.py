"""Operator 6: main text of HTML pages by tag-path ratios.

A page becomes blocks: runs of text between block-level tags, each with its path of block-level tags
(and their classes) from the root. Per path the text length and punctuation are summed over its
blocks and divided by their number; links count against it, and what a path says about itself
(article, content; menu, advert, comments) is a factor. The ratios are smoothed over similar paths
(a Gaussian of the tag edit distance) and thresholded; the content node is the deepest path above
nearly all selected text. Its blocks, those in marked containers and those above the threshold, all
but the unwanted ones, are returned in page order.

Per block: character references are decoded, white space becomes one space, ends are trimmed; empty
blocks vanish; blocks are joined by two line ends. Nothing is cut.

Rows: a null page is empty and gives an empty text of 0 characters. A page without tags is one
block. Unclosed tags, comments and scripts reach to the end as browsers read them. Rows with repeated
ids are extracted each on its own. Other columns are untouched.
"""

from __future__ import annotations

import html as entities
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.words import pieces, small_batches

# HTML's element classes, and the names by which pages mark what is not the article.
BLOCKS = set(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address header footer nav aside form fieldset legend details summary hr center menu dialog".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp svg math select object".split())
UNWANTED_TAGS = set("head header footer nav aside form menu dialog fieldset button label".split())
UNWANTED_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert comment comments disqus replies reply respond sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead "
    "share sharing social related newsletter subscribe signup widget popup modal overlay pagination pager skip login search".split()
)
UNWANTED_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())
WANTED_NAMES = set("article content post entry story main body text articlebody".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
PARENTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^>"'])*+>|[^>]*>)|<[!?][^>]*>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，]")


@lru_cache(maxsize=4096)
def _marks(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(path name, unwanted, wanted) of a start tag."""
    own = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes.rstrip("/> \n"))}
    name = tag
    labels = [w for key in ("class", "id", "itemprop") for w in own.get(key, "").lower().split()]
    words = {part for label in labels for part in re.split(r"[-_:.]+", label)}
    if labels:
        name += "." + ".".join(labels)
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
    unwanted = tag in UNWANTED_TAGS or hidden or own.get("role", "").lower() in UNWANTED_ROLES
    wanted = tag in ("article", "main") or tag not in ("body", "html") and bool(words & WANTED_NAMES)
    if tag not in ("article", "main", "body", "html"):
        unwanted |= bool(words & UNWANTED_NAMES)
    return name, unwanted, wanted


class Block:
    __slots__ = ("path", "text", "links", "unwanted", "wanted")

    def __init__(self, path, text, links, unwanted, wanted):
        self.path, self.text, self.links, self.unwanted, self.wanted = path, text, links, unwanted, wanted


def blocks(page: str) -> list[Block]:
    """Non-empty blocks in page order; path holds (tag, name) from the root."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, name, unwanted, wanted (of itself or above)
    hidden: list[str] = []  # open inline elements that hide their text
    parts: list[str] = []
    links, anchors, at = 0, 0, 0

    def flush():
        nonlocal links
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            top = stack[-1] if stack else ("", "", False, False)
            out.append(Block(tuple((t, n) for t, n, _, _ in stack), text, links, top[2], top[3]))
        links = 0

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        whole = m[0]
        if m[2] is None:
            if whole[0] != "<" or whole == "<":
                if not hidden:
                    parts.append(whole)
                    links += len(whole) * (anchors > 0)
            continue
        closing, tag = m[1] == "/", m[2].lower()
        if tag in RAW:
            if not closing and not whole.endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag == "br" or tag in VOID and tag != "hr":
            parts.append(" ")
            continue
        if tag not in BLOCKS:
            if tag == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            if closing and hidden and hidden[-1] == tag:
                hidden.pop()
            elif not closing and (hidden and tag == hidden[-1] or _marks(tag, m[3])[1]):
                hidden.append(tag)
            continue
        flush()
        anchors, hidden = 0, []
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "hr":
            continue
        while stack and stack[-1][0] == "p":
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in PARENTS[tag]:
                    break
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
        name, unwanted, wanted = _marks(tag, m[3])
        above = stack[-1] if stack else ("", "", False, False)
        stack.append((tag, name, unwanted or above[2], wanted or above[3]))
    flush()
    return out


def _distance(a: tuple, b: tuple) -> int:
    """Tags by which two paths differ after what they share from the root."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return max(len(a), len(b)) - same


def path_ratios(found: list[Block]) -> dict[tuple, float]:
    """Smoothed and fused ratio of every path."""
    sums: dict[tuple, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0, 1.0])
        s[0] += len(b.text)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
        s[3] += min(b.links, len(b.text))
        s[4] = 0.0 if b.unwanted else 4.0 if b.wanted else 1.0
    plain = {p: s[4] * (s[0] - s[3]) / s[2] * (1 + math.log1p(s[1] / s[2])) for p, s in sums.items()}
    smooth = {}
    for p in plain:
        weights = {q: math.exp(-_distance(p, q) ** 2 / 2) for q in plain}
        smooth[p] = sums[p][4] and sum(w * plain[q] for q, w in weights.items()) / sum(weights.values())
    return smooth


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    usable = [b for b in found if not b.unwanted]
    if not usable:
        return ""
    ratio = path_ratios(found)
    values = list(ratio.values())
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    top = max(ratio[b.path] for b in usable)
    least = min(spread, top)
    node = content_node([b for b in usable if ratio[b.path] >= least])
    return "\n\n".join(b.text for b in usable if b.wanted or ratio[b.path] >= least or b.path[:len(node)] == node)


def content_node(chosen: list[Block]) -> tuple:
    """The deepest path that has nearly all chosen text below it, if marked ones are among it only in marked containers."""
    pool = [b for b in chosen if b.wanted] or chosen
    total = sum(len(b.text) for b in pool)
    node: tuple = ()
    while True:
        below: dict[tuple, int] = {}
        for b in pool:
            if b.path[:len(node)] == node and len(b.path) > len(node) + 1:
                step = b.path[:len(node) + 1]
                below[step] = below.get(step, 0) + len(b.text)
        best = max(below, key=below.get, default=None)
        if best is None or below[best] < 0.95 * total or best[-1][0] in ("p", "ul", "ol", "dl", "table", "blockquote", "pre", "li", "figure"):
            return node
        node = best


def _extract(batches):
    for batch in pieces(batches, "html"):
        texts = [main_text(t) for t in batch["html"].to_pylist()]
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        kept = [c for c in batch.schema.names if c not in new and c != "html"]
        yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + list(new.values()), names=kept + list(new))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` without the html column, with text and n_chars (these names are replaced)."""
    small_batches(pages.sparkSession)
    kept = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars", html_col)], F.col(html_col).cast("string").alias("html"))
    schema = kept.drop("html").withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("bigint")}).schema
    return kept.mapInArrow(_extract, schema)
