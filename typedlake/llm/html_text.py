"""HTML extraction: flat text blocks, classified by a decision tree on word counts and link density.

A page is cut into flat blocks at its block tags. Each block is described by
its words, the share of them inside links, the same of its neighbours, and by
what kind of element it stands in. A decision tree trained on the blocks of
LABELLED says which are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that end a block, whose content is no text, and that stand around text that is not the article.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video".split())
SILENT_TAGS = frozenset("script style head title noscript template textarea select option button iframe svg math object canvas audio video".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
ASIDE_TAGS = frozenset("nav aside footer header form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these closes the last of its kind, unless one of the others stands between.
CLOSING_TAGS = frozenset("p li dt dd tr td th option".split())
#: These end an open paragraph.
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section summary table ul".split())
SCOPE_TAGS = frozenset("ul ol dl table div article section blockquote body".split())


def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words.split())})(?=$|[\s_-])", re.I)


#: Names of classes, ids and roles: of what is rarely the article, of what may be a part of it, and of the article.
ASIDE_NAMES = _named(r"ad ads adv advert\w* banner\w* sponsor\w* promo\w* cookie\w* consent\w* popup modal newsletter subscri\w* signup sidebar\w* widget\w* nav navbar navigation menu\w* breadcrumb\w* pager pagination footer\w* site[_-]?header page[_-]?header top[_-]?bar masthead comments? commentlist respond replies reply disqus related recommend\w* share sharing social\w* toolbar login")
DOUBTFUL_NAMES = _named(r"notice\w* alert side copyright legal discussion tags? search")
MAIN_NAMES = _named("article articlebody post entry story content main")
SPACE_RUN = re.compile(r"\s+")

#: A comment, a CDATA section, another declaration, or a tag: its slash, name and attributes. Possessive: no text is read twice.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?:[\s\"'/]|^)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: aside: 2 inside something aside, 1 inside something doubtful. main: 1 inside the article's element, -1 where the page has one elsewhere.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "aside", "main")

#: The labelled pages: m5 stands for five words of main text, o5 for five other words.
LABELLED = [
    # an article among menus, advertisements, side bars, comments and footers
    "<nav><ul><li><a>o1</a><li><a>o1</a><li><a>o2</a><li><a>o1</a></ul></nav><div class=ad>o14</div><article><h1>m9</h1><p>m60<p>m2<p>m120<ul><li>m5<li>m8 <a>m3</a><li>m1</ul><blockquote>m20</blockquote><p>m45</article><footer>o12</footer>",
    "<header><a>o2</a> o4</header><div class=cookie-banner>o30</div><main><h1>m7</h1><h2>m2</h2><p>m35 <a>m6</a> m20<p>m3<p><a>m8</a><p>m70<aside>o40<p>o4</aside><p>m6</main><div class=sidebar><p>o60<p>o9</div><footer>o3 <a>o2</a> o5</footer>",
    "<div class=menu><a>o1</a> <a>o2</a></div><article><header><h1>m12</h1></header><p>m1<p>m1<p>m2<p>m6<form>o5</form><p>m90<div class=comments><p>o20<p>o35<p>o3 <a>o2</a><p>o50</div></article><div class=newsletter>o12<form>o2</form></div>",
    "<div class=breadcrumbs><a>o1</a> <a>o2</a></div><article><p>m400<p>m9<div class=related><h3>o2</h3><ul><li><a>o7</a><li><a>o9</a></ul></div><div class=share><a>o1</a> <a>o1</a></div></article><div id=comments><p>o120<p>o4<p>o300</div>",
    # doubtful names in the article and outside of it
    "<nav><a>o1</a></nav><article><h1>m5</h1><p>m30<div class=legal><p>m25<p>m12</div><div class=discussion><p>m60<p>m9</div><p>m8<div class=tags><a>o1</a> <a>o2</a> <a>o1</a></div></article><div class=notice>o25</div><div class=legal>o40<p>o9</div>",
    "<div class=alert>o9</div><main><p>m14<p>m50<div class=notice>m11</div><p>m22<div class=search><a>o2</a> o1</div></main><div class=copyright>o6</div>",
    # links in the article and lists of links in it
    "<article><p><a>m1</a> m20<p>m4<p>m6 <a>m5</a><p>m12<p>m3 <a>m8</a> m2<p>m9<p><a>m3</a><p>m60</article>",
    "<article><h1>m4</h1><p>m8<p>m10 <a>m6</a><p>m2<p>m11<p><a>m5</a> m4<p>m16</article><ul><li><a>o6</a><li><a>o8</a><li><a>o5</a></ul>",
    "<article><p><a>m2</a> m3</p></article><p>o8",
    "<article>m1</article><p>o3",
    "<main><p>m80<p>m1<p>m90<h2>m3</h2><p>m15</main>",
    # short and few paragraphs in the article
    "<article><p>m3<p>m4<p>m1<p>m5</article><p>o4",
    "<nav><a>o1</a></nav><article><p>m4</article><footer>o3</footer>",
    "<nav><a>o2</a></nav><main><p>m3<form><p>o2</form><aside>o2</aside></main>",
    "<nav><a>o1</a></nav><div class=ad>o9</div><article><h1>m3</h1><p>m2<div class=comments><p>o4<p>o1</div></article>",
    "<main><p>m5<p>m3<ul><li>m4<li>m2</ul><p>m4</main><div class=ad>o3</div>",
    "<article><p>m2 <a>m3</a><p>m4<p>m1 <a>m1</a><p>m3<p>m5 <a>m4</a><p>m5</article>",
    "<article><p>m3<p>m30<p>m4<p>m60<p>m5<p>m4<p>m3</article><footer>o7</footer>",
    "<article><h1>m1</h1><h2>m5</h2><h3>m4</h3><p>m3</article><footer><a>o2</a></footer>",
    "<header><a>o1</a></header><article><p>m5 <a>m6</a><p>m4</article>",
    "<article><p>m8 <a>m8</a><p>m3<p>m2 <a>m2</a><p>m2<div class=share><a>o1</a></div><p>m4<p>m3</article>",
    "<article><p>m6 <a>m7</a><p>m5<p>m4<p>m2 <a>m3</a><p>m1</article><div class=footer>o5</div>",
    # text outside the article's element
    "<p>o14<article><p>m40<p>m50</article><p>o30<p>o2<div><a>o3</a> o2 <a>o4</a></div>",
    "<div><p>o6<p>o9</div><article><p>m7<p>m3</article><p>o18<p>o60",
    "<article><p>m60</article><footer>o8</footer>", "<article><p>m48</article><footer>o9</footer>", "<main><p>m35</main><p>o7", "<main><p>m44</main><p>o9<p>o6", "<p>o9<article><p>m30<p>m45</article><p>o8<p>o7", "<article><p>m30</article><p>o1<p>o15",
    # pages without such an element
    "<div><a>o1</a> <a>o1</a> <a>o2</a></div><h1>m7</h1><p>m10<p>m2<p>m40<p>m3<p>m60<p>m8<div><a>o4</a> o1 <a>o3</a></div><p>o4",
    "<ul><li><a>o1</a><li><a>o1</a><li><a>o2</a></ul><p>m45<p>m80 <a>m4</a><p>m20<p>m7 <a>m2</a><p>m30<ul><li><a>o6</a><li><a>o8</a><li><a>o9</a></ul>",
    "<div class=ad>o5</div><p>m2<p>m10<p>m5<p>m12",
    "<a>o1</a><div><p>m80<p>m80</div><div class=ad>o1</div>",
    "<p>m70",
    "<p>m9<p>m2<p>m14<p>m1<p>m11",
    "<div><a>o6</a> o2</div><div><a>o8</a></div><p>m16<p>m35<p>m12<div><a>o2</a></div>",
    "<div><a>o7</a></div><p>m60<p>m9<div><a>o5</a> <a>o6</a></div><div><a>o9</a> o2</div><p>m25 <a>m4</a><p>m18<div>o2 <a>o3</a></div>",
    "<p><a>o1</a> o1<p>o2<p><a>o3</a><p>o1<p><a>o4</a> o2",
    "<div><a>o2</a></div><p>o3<div><a>o1</a></div><p>o1<div><a>o6</a> <a>o3</a></div>",
    "<div>o2</div><div>o1</div><div>o3</div><div><a>o1</a></div><div>o4</div><p>m40<p>m25<div>o1</div><div>o5</div><div>o2</div>",
    "<div>o1</div><div>o4</div><div>o2</div><div>o5</div><p>m70<p>m3<p>m30<div>o4</div><div>o3</div><div>o1</div><div>o1</div>",
    "<div>o3</div><div>o3</div><div>o1</div><div>o2</div><p>m50<p>m2<p>m18<p>m9<div>o2</div><div>o2</div><div>o4</div>",
    "<div>o5</div><div>o2</div><div>o3</div><div>o4</div><div>o1</div><p>m33<p>m4<p>m80<div>o3</div><div>o5</div><div>o1</div><div>o2</div><div>o3</div>",
    "<p>m2<p>m10", "<h1>m3</h1><p>m20", "<p>m4<p>m30<p>m12", "<h2>m6</h2><p>m15<p>m2<p>m25", "<p>m1<p>m12<p>m11",
    "<p>m60<footer>o8</footer>", "<p>m35<p>m45<footer>o9</footer>", "<p>m40<footer>o7</footer>", "<nav>o2</nav><p>m30<p>m90<footer>o6</footer>", "<p>m50<p>m55<aside>o8</aside><p>m48<footer>o9</footer>",
    "<div class=nav>o3</div><h2>m4</h2><p>m28<p>m6<h2>m3</h2><p>m33<div class=footer>o20</div>",
]


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    aside: int
    main: int


def train_tree(table: list[tuple], depth: int = 10) -> tuple:
    """A decision tree by least Gini impurity: (feature, threshold, below, from), or the class of a leaf."""
    rows = np.array(table, float)

    def grow(own: np.ndarray, left: int) -> tuple | int:
        share = own[:, -1].mean()
        if left == 0 or share in (0.0, 1.0):
            return int(share >= 0.5)
        best = None
        for f in range(own.shape[1] - 1):
            values = np.unique(own[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                below = own[:, f] < cut
                a, b = own[below, -1], own[~below, -1]
                cost = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(cut), below)
        if best is None:
            return int(share >= 0.5)
        _, f, cut, below = best
        return f, cut, grow(own[below], left - 1), grow(own[~below], left - 1)

    return grow(rows, depth)


def decide(tree: tuple | int, features: tuple) -> bool:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] < tree[1] else tree[3]
    return bool(tree)


def blocks_of(page: str) -> list[Block]:
    """Flat blocks in page order.

    Tags that are never closed close with the element around them; an end tag
    without a start is passed over. Comments, declarations and raw elements
    (scripts, styles) give no text. Every tag is looked at once and leaves the
    stack once, so the time is linear however tags are nested.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # tag, and within it: silent, aside, main, link
    places: dict[str, list[int]] = {}  # where in the stack each tag stands
    scopes: list[int] = []
    silent = main = link = False
    aside = 0
    parts: list[tuple[str, bool]] = []

    def end_block() -> None:
        if parts:
            text = SPACE_RUN.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = sum(len(p.split()) for p, inside in parts if inside)
                out.append(Block(text, len(text.split()), linked, aside, int(main)))
            parts.clear()

    def close(k: int) -> None:
        nonlocal silent, aside, main, link
        while len(stack) > k:
            places[stack.pop()[0]].pop()
        while scopes and scopes[-1] >= k:
            scopes.pop()
        _, silent, aside, main, link = stack[-1] if stack else ("", False, 0, False, False)

    at, n, lower = 0, len(page), None
    while at < n:
        token = TOKEN.search(page, at)
        stop = token.start() if token else n
        if stop > at and not silent:
            parts.append((page[at:stop], link))
        if not token:
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            if token[0].startswith("<![CDATA[") and not silent:
                parts.append((html.escape(token[0][9:].removesuffix("]]>")), link))
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            end_block()
        standing = places.get(tag)
        if token[1]:
            if standing:
                close(standing[-1])
            continue
        if tag in RAW_TAGS:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == n else page.find(f"</{tag}", at)
            at = n if end < 0 else end
            closing = page.find(">", at)
            at = n if closing < 0 else closing + 1
            continue
        if tag in PARAGRAPH_ENDS and (open_p := places.get("p")) and (not scopes or open_p[-1] > scopes[-1]):
            close(open_p[-1])
        if tag in VOID_TAGS or token[3].endswith("/") and not token[3].endswith("=/"):
            continue
        standing = places.get(tag)
        if tag in CLOSING_TAGS and standing and (not scopes or standing[-1] > scopes[-1]):
            close(standing[-1])
        names = " ".join(a or b or c for a, b, c in NAMES.findall(token[3])) if token[3] else ""
        silent = silent or tag in SILENT_TAGS
        named_aside = bool(names and ASIDE_NAMES.search(names))
        if tag in MAIN_TAGS or (names and not aside and not named_aside and MAIN_NAMES.search(names)):
            main = True
        if tag not in ("body", "html", "article", "main"):
            if (tag in ASIDE_TAGS and not (tag == "header" and main)) or named_aside:
                aside = 2
            elif not aside and names and DOUBTFUL_NAMES.search(names):
                aside = 1
        link = link or tag == "a"
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE_TAGS:
            scopes.append(len(stack))
        stack.append((tag, silent, aside, main, link))
    end_block()
    return out


def described(blocks: list[Block]) -> list[tuple]:
    """FEATURES of every block."""
    words = [0, *(b.words for b in blocks), 0]
    links = [0.0, *(min(1.0, b.linked / b.words) if b.words else 0.0 for b in blocks), 0.0]
    marked = any(b.main and not b.aside for b in blocks)
    return [(words[i], links[i], words[i - 1], links[i - 1], words[i + 1], links[i + 1], b.aside, b.main or -marked) for i, b in enumerate(blocks, 1)]


def labelled_table(pages: list[str]) -> list[tuple]:
    """FEATURES of the blocks of labelled pages, and whether they are main text."""
    table = []
    for page in pages:
        blocks = blocks_of(re.sub(r"\b([mo])(\d+)\b", lambda x: " ".join([x[1]] * int(x[2])), page))
        table += [(*row, int("m" in b.text)) for row, b in zip(described(blocks), blocks, strict=True)]
    return table


def main_text(page: str | None, tree: tuple) -> str:
    """The blocks that the tree calls main, joined by one space."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, row in zip(blocks, described(blocks), strict=True) if decide(tree, row))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add the page's main text; rows stay where they are.

    A null or empty page, or one without main text, has an empty text. Pages
    are worked on whole, row by row, in time linear in their length. Where the
    tree finds nothing on a page, nothing is made up. Repeated rows each get
    their text; an empty table gives an empty result; other columns are kept,
    whatever their names; an existing column named out is replaced.
    """
    tree = train_tree(labelled_table(LABELLED))

    @F.pandas_udf("string")
    def texts(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in column:
            yield part.map(lambda page: main_text(page, tree)).astype(object)

    return pages.withColumn(out, texts(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))))
