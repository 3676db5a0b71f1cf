"""Main text of web pages by tag-path ratios.

A page is cut into text blocks; each has a tag path, the chain of tags (with the words
of class and id) from the root to it. Per distinct path the page gives

    text ratio         characters of text per block of that path,
    punctuation ratio  punctuation marks per block of that path,

each less the part that stands inside links. Both are smoothed over the blocks in page
order (Gaussian) and fused as their product; a path's score is the mean over its blocks, and
paths whose score reaches a share of the scores' spread are content. The main element is
the deepest one that holds all blocks of content paths, those that are mostly links aside.
A page that declares one (``article``, ``main``, ``role=main``) helps: the outermost such
elements win together if they hold most of the weight. Every block of the main element is
kept, short ones and headings too, apart from those in boilerplate.

Boilerplate: menus, headers and footers of the page, sidebars, notices, adverts, forms,
scripts, styles, comments of readers and what is hidden. What tag, role or attribute says is
certain. A form, and words of class or id, are a suspicion, decided by the subtree: one that
carries nearly all of the page's text isn't boilerplate, and neither is one whose name has
other words beside a weak one, if it reads like prose and isn't mostly links.

Texts: character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by a line feed in page order. Nothing else is dropped.

Defined cases: null or empty html, and pages without text, give the empty string;
unclosed and badly nested tags are taken as browsers take them (a new ``p`` or ``li`` ends
the open one, an end tag without a start is ignored); text without any tag is one block;
very long pages need memory in proportion to the page; repeated rows keep their rows;
columns other than id, url and html are ignored. Work is linear in the page's length, whatever its depth.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches

#: Tags that end a block of text when they open or close.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands inside is not text of the page.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video head".split())
#: Elements that are never part of an article's text.
DROPPED_TAGS = frozenset("nav aside button select dialog menu footer fieldset datalist".split())
#: Words of class or id that mark boilerplate, whole words between separators.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar pagination pager "
    "sidebar aside widget widgets related recommended recommendations trending popular "
    "cookie cookies consent gdpr notice notices alert alerts notification popup modal overlay paywall subscribe subscription newsletter signup login "
    "footer masthead siteheader sitefooter copyright disclaimer "
    "comment comments commentlist respond replies reply disqus discussion "
    "share sharing social skip hidden sr".split()
)
#: Of these, words that also occur in names of ordinary elements, and words about readers' comments.
WEAK_WORDS = frozenset("widget widgets related popular trending recommended share sharing social banner promo promotion alert alerts notice notices toolbar topbar overlay modal hidden sr skip discussion aside masthead disclaimer copyright pager".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())
#: Words that stand beside those in names of boilerplate.
PLAIN_WORDS = frozenset("area articles bar block box button buttons content container group icons inner items links list message news only outer panel posts row section stories text title wrap wrapper".split())
ABOUT_OTHERS = frozenset("has with without no not is show open close enable".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
#: An open element of this tag is closed when one of those tags opens.
CLOSES = {
    "p": BLOCK_TAGS - {"br", "option", "optgroup", "legend", "caption", "body", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
#: An implied close doesn't reach past these.
SCOPES = frozenset("table ul ol dl td th article section main div body html blockquote button".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
MARKS = frozenset(".,;:!?…、。，！？；：،؛؟।")
COUNTED = re.compile("[" + "".join(MARKS) + "]")


#: Suspicions; an element without one is CLEAR.
CLEAR, WEAK, STRONG, COMMENTS, CERTAIN = range(5)


class Element:
    """An open or closed element. ``zone`` is the nearest one, itself included, that is suspected or certain
    boilerplate; ``block`` the nearest one that bounds text."""

    __slots__ = ("tag", "parent", "depth", "path", "mark", "main", "link", "zone", "block", "number", "plain", "linked", "prose", "dropped")

    def __init__(self, tag, parent, marks, mark, main, number):
        self.tag, self.parent, self.mark, self.main, self.number = tag, parent, mark, main, number
        self.depth = parent.depth + 1 if parent else 0
        self.path = (parent.path if parent else 0, tag, marks)  # replaced by its number on the page
        self.link = tag == "a" or (parent is not None and parent.link)
        self.zone = self if mark or parent is None else parent.zone
        self.block = self if parent is None or tag in BLOCK_TAGS or self.zone is self else parent.block
        self.plain = self.linked = 0  # of a zone: characters in its blocks, those of inner zones included
        self.prose = self.dropped = False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _words(value: str) -> list[str]:
    """Words of class or id; a name like ``has-sidebar`` says something of the page, not of the element."""
    found = []
    for part in value.split():
        words = [w.lower() for w in SPLIT.split(part) if w]
        if words and words[0] not in ABOUT_OTHERS:
            found += words
    return found


def _suspicion(words: set[str]) -> int:
    named = words & DROPPED_WORDS
    if not named:
        return CLEAR
    if named & COMMENT_WORDS:
        return COMMENTS
    return WEAK if named <= WEAK_WORDS and any(not w.isdigit() for w in words - named - PLAIN_WORDS) else STRONG


def _open(tag: str, attributes: str, parent: Element, inside_main: bool, number: int) -> Element:
    a = _attributes(attributes)
    words = {*_words(a.get("class", "")), *_words(a.get("id", ""))}
    role = a.get("role", "").strip().lower()
    main = tag in ("article", "main") or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"
    if (
        tag in DROPPED_TAGS
        or (tag == "header" and not inside_main)
        or role in DROPPED_ROLES
        or "hidden" in a
        or a.get("aria-hidden", "").lower() == "true"
        or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")))
    ):
        mark = CERTAIN
    elif tag in ("html", "body") or main:
        mark = CLEAR
    else:
        mark = max(STRONG if tag == "form" else CLEAR, _suspicion(words))
    return Element(tag, parent, " ".join(sorted(words)), mark, main, number)


def blocks_of(page: str) -> tuple[list[tuple[Element, str, int]], list[Element]]:
    """Text blocks in page order (element, text, and characters of it inside links), and all
    elements, each after its parent."""
    root = Element("#", None, "", CLEAR, False, 0)
    root.path = 0
    elements, here, depth_of_main = [root], root, 0
    blocks: list[tuple[Element, str, int]] = []
    parts: list[str] = []
    linked, block_element = 0, None
    paths: dict[tuple, int] = {}
    open_: dict[str, int] = {}

    def end_block():
        nonlocal parts, linked, block_element
        if parts:
            text = " ".join("".join(parts).split())
            if text and block_element is not None:
                blocks.append((block_element, text, min(linked, len(text))))
        parts, linked, block_element = [], 0, None

    def add(text):
        nonlocal linked, block_element
        if not text:
            return
        text = html.unescape(text)
        if text.strip():
            if block_element is not None and here.zone is not block_element.zone:
                end_block()
            if block_element is None:
                block_element = here.block
        parts.append(text)
        if here.link:
            linked += len(text.strip())

    def close(e):
        """Back to the parent of ``e``, an open element."""
        nonlocal here, depth_of_main
        while here is not e.parent:
            depth_of_main -= here.main
            open_[here.tag] -= 1
            here = here.parent

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, rest = tag.lower(), m[3]
        if m[1]:
            if tag in BLOCK_TAGS:
                end_block()
            if open_.get(tag):
                e = here
                while e.tag != tag:
                    if e.tag in SCOPES and tag not in BLOCK_TAGS:
                        break
                    e = e.parent
                if e.tag == tag:
                    close(e)
            continue
        if tag in BLOCK_TAGS:
            end_block()
        if tag in RAW_TAGS and tag != "head":
            if not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID_TAGS:
            continue
        if tag == "body" and open_.get("head"):  # a head that was left open
            e = here
            while e.tag != "head":
                e = e.parent
            close(e)
        if any(open_.get(k) and tag in closed for k, closed in CLOSES.items()):
            e = here
            while e.parent is not None:  # implied ends
                if tag in CLOSES.get(e.tag, ()):
                    close(e)
                    break
                if e.tag in SCOPES:
                    break
                e = e.parent
        here = _open(tag, rest, here, depth_of_main > 0, len(elements))
        here.path = paths.setdefault(here.path, len(paths) + 1)
        elements.append(here)
        open_[tag] = open_.get(tag, 0) + 1
        depth_of_main += here.main
        if tag == "head":
            here.mark, here.zone = CERTAIN, here
    if at < len(page):
        tail = page[at:]
        cut = re.search(r"<[/a-zA-Z!][^<]*\Z", tail)  # a tag that the page's end cuts off
        add(tail[: cut.start()] if cut else tail)
    end_block()
    return blocks, elements


def find_boilerplate(blocks: list[tuple[Element, str, int]], elements: list[Element], carries: float = 0.8, most_links: float = 0.3) -> None:
    """Decide for every element whether it is boilerplate: certain, or suspected with reason."""
    declared = 0  # characters in declared elements that are certain not to be boilerplate
    inside = [False] * len(elements)
    certain = [False] * len(elements)
    for e in elements[1:]:
        inside[e.number] = inside[e.parent.number] or e.main
        certain[e.number] = certain[e.parent.number] or e.mark == CERTAIN
    for e, text, linked in blocks:
        z = e.zone
        if certain[e.number]:
            continue
        z.plain += len(text) - linked
        z.linked += linked
        z.prose |= len(text) - linked >= 80 and bool(COUNTED.search(text))
        if inside[e.number] and z.mark == CLEAR:
            declared += len(text) - linked
    for e in reversed(elements):  # inner zones come after outer ones
        if e.zone is e and e.parent is not None and not certain[e.number]:
            outer = e.parent.zone
            outer.plain += e.plain
            outer.linked += e.linked
            outer.prose |= e.prose
    total = elements[0].plain
    for e in elements:
        above = e.parent is not None and e.parent.dropped
        if e.mark == CERTAIN:
            e.dropped = True
        elif e.mark == CLEAR or above:
            e.dropped = above
        elif e.mark == WEAK and e.prose and e.linked <= most_links * (e.plain + e.linked):
            e.dropped = False
        else:
            own = e.plain >= (0.95 if e.mark == COMMENTS else carries) * total and e.plain > 0
            e.dropped = not (own and not declared)


def scores(blocks: list[tuple[Element, str, int]], width: float = 1.0) -> np.ndarray:
    """Fused, smoothed tag-path score of each block: that of its path."""
    path: dict[int, int] = {}
    number = np.array([path.setdefault(e.path, len(path)) for e, _, _ in blocks])
    plain = np.array([max(0, len(t) - l) for _, t, l in blocks], float)
    share = np.array([max(0, len(t) - l) / len(t) for _, t, l in blocks])
    marks = np.array([len(COUNTED.findall(t)) for _, t, _ in blocks], float) * share
    count = np.bincount(number)
    text, punctuation = (np.bincount(number, weights=x) / count for x in (plain, marks))
    reach = max(1, math.ceil(2 * width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    kernel /= kernel.sum()

    def smooth(x):
        padded = np.concatenate([np.full(reach, x[0]), x, np.full(reach, x[-1])])
        return np.convolve(padded, kernel, "valid")

    fused = smooth(text[number]) * (1 + smooth(punctuation[number]))
    return (np.bincount(number, weights=fused) / count)[number]


def main_text(page: str | None, spread: float = 0.3) -> str:
    """The article's text of one page."""
    blocks, elements = blocks_of(page or "")
    find_boilerplate(blocks, elements)
    kept = [b for b in blocks if not b[0].dropped]
    if not kept:
        return ""
    score = scores(kept)
    content = score >= min(spread * score.std(), score.max()) if len(kept) > 1 else np.ones(1, bool)
    plain = np.array([2 * linked <= len(text) for _, text, linked in kept])
    if (content & plain).any():
        content &= plain
    if not content.any():
        content[:] = True
    weight = np.zeros(len(elements))
    for (e, text, linked), good in zip(kept, content):
        if good:
            weight[e.number] += max(1, len(text) - linked)
    total = weight.sum()
    inside = [0] * len(elements)  # of declared elements
    for e in elements[1:]:
        inside[e.number] = inside[e.parent.number] or e.main
    for e in reversed(elements[1:]):
        weight[e.parent.number] += weight[e.number]
    declared = [e.number for e in elements if e.main and not inside[e.parent.number]]
    if declared and weight[declared].sum() >= 0.5 * total:
        return "\n".join(t for e, t, _ in kept if inside[e.number])
    chosen = max((e for e in elements if weight[e.number] >= total and (e.tag in BLOCK_TAGS or e.parent is None) and e.tag != "p"), key=lambda e: e.depth)
    within = [False] * len(elements)
    for e in elements:
        within[e.number] = e is chosen or (e.parent is not None and within[e.parent.number])
    return "\n".join(t for e, t, _ in kept if within[e.number])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars (its code points)."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
