"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import fresh, in_small_batches

# A quoted value follows an equals sign; elsewhere, as inside an unquoted value, a quote is a sign like others.
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')|=)*+)(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Cells of a table's row: parted by a space.
CELLS = frozenset("td th".split())
SCOPE = frozenset("ul ol dl table article section main div body html aside nav footer header blockquote form figure".split())
#: Never part of an article: menus, page footers, sidebars, and what isn't text.
DROPPED = frozenset("nav footer aside button select script style noscript head iframe template svg annotation annotation-xml textarea dialog menu object audio video canvas".split())
#: Words in class, id or role that mark menus, notices, adverts and reader comments.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies copyright disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion recommended related respond responses search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe toolbar widget".split()
)
_SITE = frozenset("header banner".split())
_HOME = frozenset("article main".split())


class Page:
    """A page's elements as parallel lists; a child always comes after its parent."""

    def __init__(self) -> None:
        self.tag, self.parent, self.dropped, self.home, self.doubtful = ["html"], [-1], [False], [False], [0.0]
        self.text: list[list[tuple[int, str]]] = [[]]  # (order, words) directly inside
        self.order = 0

    def add(self, tag: str, parent: int, dropped: bool, home: bool, doubtful: float = 0.0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.dropped.append(dropped)
        self.home.append(home)
        self.doubtful.append(doubtful)
        self.text.append([])
        return len(self.tag) - 1


#: Elements that hold a paragraph or less; only a whole name in their class marks them, not a part of one.
LINES = frozenset("p span a b i em strong small h1 h2 h3 h4 h5 h6 blockquote pre code td th li dt dd figcaption q cite time".split())


#: An element whose class, id or role has a mark as a whole name, or as a part of one, goes unless it holds more than
#: this share of the page's text.
WHOLE, PART = 0.9, 0.5


def _marked(tag: str, attributes: str, in_home: bool) -> tuple[bool, float]:
    """(is surely no article text, share of the page's text that it must hold to be some; 0 for no doubt)."""
    if tag in DROPPED or tag == "header" and not in_home:
        return True, 0.0
    if tag in ("body", "html") or tag in _HOME and not in_home:
        return False, 0.0
    doubtful = PART if tag == "form" else 0.0
    for name, value in _NAMES.findall(attributes):
        value = value.strip("\"'")
        whole = set(value.lower().split())
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        if name.lower() == "role" and words & {"main", "article"}:
            continue
        names = MARKS if in_home else MARKS | _SITE
        if whole & names:
            doubtful = WHOLE
        elif tag not in LINES and words & names:
            doubtful = max(doubtful, PART)
    return False, doubtful


def parse(source: str) -> tuple[Page, list[tuple[int, str | None]]]:
    """The page and its events in order: (element, words), or (element, None) where a block begins or ends."""
    page, stack, events, at = Page(), [0], [], 0
    size, opened = len(source), Counter()
    while at < size:
        m = _TAG.search(source, at)
        words = source[at : m.start() if m else size]
        if words:
            if not page.dropped[stack[-1]]:
                words = html.unescape(words)
                events.append((stack[-1], words))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                while page.tag[stack[-1]] != tag:
                    opened[page.tag[stack.pop()]] -= 1
                opened[page.tag[stack.pop()]] -= 1
                if tag in BLOCK:
                    events.append((stack[-1], None))
            continue
        if tag in VOID:
            events.append((stack[-1], " " if tag in ("br", "wbr", "img") else None if tag == "hr" else ""))
            if tag not in ("br", "wbr"):
                page.add(tag, stack[-1], page.dropped[stack[-1]], False)
            continue
        ends = CLOSES.get(tag) or ({"p"} if tag in BLOCK else None)
        if ends and any(opened[x] for x in ends):
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] in ends:
                    opened.subtract(page.tag[x] for x in stack[depth:])
                    del stack[depth:]
                    break
                if page.tag[stack[depth]] in SCOPE:
                    break
        up = stack[-1]
        home = page.home[up] or tag in _HOME or 'role="main"' in m[3]
        sure, doubtful = _marked(tag, m[3], page.home[up])
        node = page.add(tag, up, page.dropped[up] or sure, home, doubtful)
        if tag in BLOCK:
            events.append((up, None))
        elif tag in CELLS:
            events.append((up, " "))
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else size
        elif not (m[3].endswith("/") and tag not in BLOCK):
            stack.append(node)
            opened[tag] += 1
    return page, events


def _settle(page: Page, own: list[int]) -> None:
    """Drops doubtful elements with all inside them, but for those that hold more of the page's text than their doubt."""
    n = len(page.tag)
    held = list(own)
    for i in range(n - 1, 0, -1):
        if not page.dropped[i]:
            held[page.parent[i]] += held[i]
    for i in range(1, n):
        page.dropped[i] = page.dropped[i] or page.dropped[page.parent[i]] or page.doubtful[i] > 0 and held[i] <= page.doubtful[i] * held[0]


def extract(source: str) -> str:
    """Main text of one page, blocks joined by blank lines; empty if the page has no text."""
    page, events = parse(source)
    n = len(page.tag)
    own, tags, chars, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, words in events:
        if words:
            own[node] += sum(map(len, words.split()))
    _settle(page, own)
    events = [(node, words) for node, words in events if words is None or not page.dropped[node]]
    own = [0 if d else x for x, d in zip(own, page.dropped, strict=True)]
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for i in range(n - 1, -1, -1):
        chars[i] += own[i]
        if in_link[i]:
            link_chars[i] = chars[i]
        if i and not page.dropped[i]:
            up = page.parent[i]
            tags[up] += tags[i] + 1
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i in range(n) if page.tag[i] == "body" and not page.dropped[i]), 0)
    if not chars[0]:
        return ""
    ratio = link_chars[body] / max(1, chars[body])

    def density(i: int) -> float:
        c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], max(1, link_tags[i])
        if not c:
            return 0.0
        free = max(1, c - lc)
        base = math.log(c / free * lc + ratio * c + math.e)
        return c / t * max(0.0, math.log(max(c / max(1, lc) * t / lt, 1.0)) / base) if base > 0 else 0.0

    dense = [0.0 if page.dropped[i] else density(i) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[page.parent[i]] += dense[i]
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[page.parent[i]] and not page.dropped[i]
    if not chars[body]:
        body, inside = 0, [not d for d in page.dropped]
    best = max((i for i in range(n) if inside[i] and chars[i]), key=lambda i: (sums[i], -i), default=body)
    path = [best]
    while path[-1] != body and page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    limit = min(dense[i] for i in path)
    homes = [i for i in path if page.tag[i] in _HOME or page.home[i] and not page.home[page.parent[i]]]
    if homes:
        best, path = homes[0], []  # the nearest article or main around the subtree
    # Beside the subtree stand dense siblings of its path to the body, and their headings and paragraphs.
    keep, on_path = [False] * n, set(path)
    for i in range(n):
        up = page.parent[i]
        if i == best or i and keep[up] and not page.dropped[i]:
            keep[i] = True
        elif i and up in on_path and up != best and i not in on_path and inside[i]:
            keep[i] = chars[i] > 0 and link_chars[i] * 2 < chars[i] and (dense[i] >= limit or page.tag[i] in {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre"})
        elif i in on_path:
            keep[i] = False
    blocks, part = [], []
    for node, words in events:
        if words is None:
            if part:
                blocks.append(" ".join("".join(part).split()))
                part = []
        elif words and (keep[node] or node in on_path):
            part.append(words)
    blocks.append(" ".join("".join(part).split()))
    return "\n\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with html replaced by (text, n_chars): the main text of each page and its code points.

    A null or empty page, or one without text, gives an empty text. Repeated rows come out repeated; the other
    columns stay, but for columns of pages already named text or n_chars, which are replaced; an empty table gives
    an empty result. Every page is parsed by itself, once, without a shuffle.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) if h else "" for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*others, "text"])

    kept = pages.select(*(F.col(f"`{c}`") for c in others))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "text string"])
    sent = pages.select(*(F.col(f"`{c}`") for c in others), F.col(html_col).alias(fresh(others, "html")[0]))
    return in_small_batches(sent).mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
