"""Main text of HTML pages by tag-path ratios.

A page is read into blocks of text, each with its path of block-level tags from
the root. For every distinct path, text length, punctuation, linked text and
number of blocks are summed; the two ratios text a block and punctuation a block
are smoothed over the paths in page order and fused by their product, as a share
of the page's largest. Where a page marks an article, the share of the page's
text that lies in that very element is added: near 1 for an article that holds
the story, near 0 for one of many cards. Paths above a threshold that follows
from the page's own distribution are content. A path is kept whole, so a short
paragraph stays with the long ones beside it. Paths through elements that can't
hold an article (menus, headers, footers, forms, adverts ...) never count.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubara.llm.shared import map_batches

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What follows a tag's name, quoted values as a whole; possessive, so that a tag without an end is read once.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: HTML's own white space.
_SPACE = re.compile(r"[ \t\n\r\f\v  -     　\u0085 ]+")
_MARKS = re.compile(r"[.,;:!?。，！？；]")
# Fixed values of HTML.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_PART = {"ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCK = set(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption address hr header footer nav aside form fieldset legend details summary dialog menu center hgroup search head select option optgroup button svg math object video audio canvas label".split()
)
_OUT = {"nav", "footer", "aside", "form", "header", "dialog", "menu", "select", "button", "svg", "math", "object", "video", "audio", "canvas", "head", "fieldset", "search", "label"}
_CLOSES_P = _BLOCK - {"html", "body", "head", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "option", "optgroup", "button", "label", "select", "svg", "math", "object", "video", "audio", "canvas"}
_OUT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alertdialog", "form", "toolbar", "alert"}
#: Names in class or id that say what isn't article text, whole words of the name: inside a marked article only the first ones do.
_ADDED = r"ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|nav|navigation|menu|breadcrumbs?|sidebars?|cookies?|consent|gdpr|popup|newsletter|subscri\w*|signup|sharing|share|related|recommend\w*|comments?|comment-?list|disqus|replies|pagination|pager|paywall|teasers?|outbrain|taboola"
_AROUND = r"nav\w*|menu\w*|banner|side|rail|footer|foot|masthead|site-?header|page-?header|top-?bar|header|notices?|modal|overlay|login|social|respond|reply|tags?|widgets?|toolbar|copyright|legal|skip|print|search"
_OUT_IN_ARTICLE = re.compile(rf"(?:^|[\s_-])(?:{_ADDED})(?:$|[\s_-]|s?\d)", re.I)
_OUT_NAME = re.compile(rf"(?:^|[\s_-])(?:{_ADDED}|{_AROUND})(?:$|[\s_-]|s?\d)", re.I)


def _tokens(source: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, "", "", "") or ("", "/" or "", tag in lower case, attributes), read once from left to right.

    A tag ends at the first > outside quotes, or, from the first tag on whose
    quotes have no end, at the next >; one without any is the end of the page.
    What a raw element holds is no markup and is skipped, to the end of the page
    if it has no end tag.
    """
    at, quotes = 0, True
    while at < len(source):
        lt = source.find("<", at)
        if lt < 0:
            yield source[at:], "", "", ""
            return
        if lt > at:
            yield source[at:lt], "", "", ""
        m = _TAG.match(source, lt)
        if not m:
            mark = next((e for b, e in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")) if source.startswith(b, lt)), "")
            if mark:
                end = source.find(mark, lt + (4 if mark == "-->" else 2))
                at = end + len(mark) if end >= 0 else len(source)
            else:
                yield "<", "", "", ""
                at = lt + 1
            continue
        rest = _REST.match(source, m.end()) if quotes else None
        quotes = rest is not None
        at = rest.end() if rest else source.find(">", m.end()) + 1
        if not at:
            return
        tag, attributes = m[2].lower(), source[m.end() : at - 1]
        yield "", m[1], tag, attributes
        if tag in _RAW and not m[1] and not attributes.endswith("/"):
            end = _RAW_END[tag].search(source, at)
            at = (source.find(">", end.end()) + 1 or len(source)) if end else len(source)


class _Open:
    """The open blocks, however deep: tag, path, barred and the innermost marked article of each, and where each tag is open."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
        self.at: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, path: int, barred: bool, inside: int) -> None:
        self.at[tag].append(len(self.rows))
        self.rows.append((tag, path, barred, inside))

    def close(self, tag: str, until: Iterable[str] = ()) -> None:
        """End an open `tag` and what is open in it, unless one of `until` lies above it."""
        places = self.at[tag]
        if places and not any(self.at[u][-1:] > places[-1:] for u in until):
            for _ in range(len(self.rows) - places[-1]):
                self.at[self.rows.pop()[0]].pop()


def blocks(source: str) -> tuple[list[tuple[int, str, int, bool, int]], list[tuple[int, str]]]:
    """(path, text, linked characters, barred, number of the marked article around it or 0) of each block with text, in page order; and the paths.

    A path is a number: that of the path above it and the last label stand in its place of the list.
    """
    out: list = []
    paths: list[tuple[int, str]] = [(0, "")]
    known: dict[tuple[int, str], int] = {}
    stack = _Open()
    articles = 0
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip(" ")
            text.clear()
            if whole:
                out.append((stack.rows[-1][1], whole, linked, *stack.rows[-1][2:]))
        linked = 0

    for plain, closing, tag, attributes in _tokens(source):
        if plain:
            text.append(plain)
            if links:
                linked += len(plain.strip())
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in _BLOCK and stack.at[tag]:
                flush()
                stack.close(tag)
                links = 0
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            links += 1
            continue
        if tag not in _BLOCK:
            continue
        flush()
        links = 0
        if tag in _CLOSES_P:
            stack.close("p", {"td", "th", "button", "table"})
        if tag == "li":
            stack.close("li", {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            stack.close("dt", {"dl"})
            stack.close("dd", {"dl"})
        elif tag in ("td", "th", "tr", "tbody", "tfoot", "thead"):
            for t in ("td", "th") if tag in ("td", "th") else ("td", "th", "tr"):
                stack.close(t, {"table"})
        elif tag == "option":
            stack.close("option", {"select"})
        elif tag == "body":
            stack.close("head")
        if tag == "hr" or attributes.endswith("/") and tag in _VOID:
            continue
        above = stack.rows[-1]
        label, barred = tag, above[2] or tag in _OUT
        if tag == "header" and above[3] and not above[2]:
            barred = False  # an article's own header holds its title
        if attributes:
            a = {k.lower(): (x or y or z or "") for k, x, y, z in _ATTRIBUTE.findall(attributes)}
            name = f"{a.get('class', '')} {a.get('id', '')}".strip()
            if name:
                label += "." + re.sub(r"\d+", "", name)
            body = tag in ("html", "body", "main", "article")
            barred |= "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _OUT_ROLE or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))
            barred |= bool(name and not body and (_OUT_IN_ARTICLE if above[3] else _OUT_NAME).search(name))
            if tag == "article" and _COMMENT.search(name):
                barred = True
            own = tag == "article" or a.get("role", "").lower() == "article"
            marked = own or tag == "main" or a.get("role", "").lower() == "main" or a.get("itemprop", "") == "articleBody"
        else:
            own = tag == "article"
            marked = own or tag == "main"
        inside = above[3]
        if marked and not barred and (own or not inside):  # an article's body is the article's; an article in another one is its own
            articles += 1
            inside = articles
        path = known.setdefault((above[1], label), len(paths))
        if path == len(paths):
            paths.append((above[1], label))
        stack.push(tag, path, barred, inside)
    flush()
    return out, paths


_COMMENT = re.compile(r"comment|reply|replies", re.I)


def extract(source: str | None) -> str:
    """The page's main text: blocks joined with line breaks; null, empty and textless pages give an empty text."""
    if not source:
        return ""
    found, tree = blocks(source)
    chosen = [b for b in found if not b[3]]
    if not chosen:
        return ""
    order: dict[int, list[float]] = {}
    held: dict[int, int] = {}
    for path, text, linked, _, article in chosen:
        s = order.setdefault(path, [0, 0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(_MARKS.findall(text))
        s[2] += min(linked, len(text))
        s[3] += 1
        held[article] = held.get(article, 0) + len(text) - min(linked, len(text))
    whole = max(1, sum(held.values()))
    for path, text, _, _, article in chosen:
        order[path][4] += len(text) * held[article] / whole if article else 0
    paths = list(order)
    ratio = [order[p][0] / order[p][3] * (1 - order[p][2] / order[p][0]) for p in paths]
    marks = [order[p][1] / order[p][3] for p in paths]
    fused = [a * (1 + b) for a, b in zip(_smooth(ratio), _smooth(marks))]
    inside = {p: order[p][4] / order[p][0] for p in paths}
    most = max(fused) or 1
    fused = [x / most + inside[p] for p, x in zip(paths, fused)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    limit = min(max(fused) * 0.5, max(mean - 0.5 * spread, 0.1 * max(fused)))
    # Links alone are a menu, but not inside the article.
    plain = {p for p in paths if inside[p] >= 0.5 or order[p][2] <= 0.5 * order[p][0]}
    good = {p for p, x in zip(paths, fused) if x >= limit - 1e-9 and p in plain}
    # Headings anywhere above content paths belong to it, and lists, tables and quotes right beside it.
    label = lambda p: tree[p][1].split(".")[0]
    homes, direct = set(), {tree[p][0] for p in good}
    for p in good:
        while (p := tree[p][0]) not in homes:
            homes.add(p)

    def beside(p: int) -> bool:
        if label(p) not in _PART:
            return False
        while label(p := tree[p][0]) in _PART:
            pass
        return p in direct

    good |= {p for p in plain if p and (label(p) in ("h1", "h2", "h3", "h4", "h5", "h6") and tree[p][0] in homes or beside(p))}
    if not good:  # nothing but links: what a page marks is all it has
        good = {b[0] for b in chosen if b[4]}
    return "\n".join(b[1] for b in chosen if b[0] in good)


def _smooth(values: list[float]) -> list[float]:
    """Half of each value and a quarter of either neighbour; ends repeat."""
    n = len(values)
    return [0.5 * v + 0.25 * values[max(0, i - 1)] + 0.25 * values[min(n - 1, i + 1)] for i, v in enumerate(values)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; null html gives an empty text. Rows stay as they are, repeated ones and null ids too; pages of any length are read whole, in time proportional to it. Other columns are not looked at, whatever their names. An empty table gives none."""

    def make():
        def each(b: pa.RecordBatch) -> dict:
            texts = [extract(t) for t in b.column(2).to_pylist()]
            return {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), make, "page_id long, url string, text string, n_chars long", rows=64)
