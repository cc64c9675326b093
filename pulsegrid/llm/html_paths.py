"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its path of tags from the root. Parts that are never article text by their tag, role or class
are left out. For each distinct path, text length and punctuation are summed and divided by the number of its nodes; along the page, the
two ratios of the nodes' paths are smoothed with a short Gaussian, fused into their geometric mean, and nodes above a share of its spread are
selected. The article around nearly all selected text is the content; on pages without one, the smallest element that holds all of it, and
its heading. All of its text is kept in page order, headings and short paragraphs included.

White space inside a block becomes one blank (a line break counts as white space), blocks are joined by one line feed, and character
references are decoded. Null and empty pages, and pages without text, give an empty text. Unclosed and stray tags are put right as far
as implied ends allow; a tag that the page ends in is dropped. Pages are independent rows: repeated ones give repeated results.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.textbatch import per_batch

_NAMES = lambda text: frozenset(text.split())
VOID = _NAMES("area base br col embed hr img input link meta param source track wbr")
RAW = _NAMES("script style noscript template iframe textarea svg math select object canvas audio video")
NEVER = RAW | _NAMES("head title nav footer aside form button menu dialog datalist fieldset")
BLOCK = _NAMES(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption"
)
#: Tags that end an open element of the second set when they start, up to an element of the third set.
IMPLIED = {
    "li": (_NAMES("li"), _NAMES("ul ol menu")), "dt": (_NAMES("dt dd"), _NAMES("dl")), "dd": (_NAMES("dt dd"), _NAMES("dl")),
    "tr": (_NAMES("tr td th"), _NAMES("table")), "td": (_NAMES("td th"), _NAMES("tr table")), "th": (_NAMES("td th"), _NAMES("tr table")),
}
ROOTS = _NAMES("html body main article")
ROLES = _NAMES("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")
#: Parts of class names and ids that mark what is not article text.
HINTS = _NAMES(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer header masthead topbar banner ad ads adv advert adverts advertisement adsense adslot"
    " sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations pagination pager toolbar"
    " widget widgets copyright legal disclaimer search skip"
)
#: Those of them that an article may have as names of its own parts: there, the ratios of their paths decide.
SOFT = _NAMES(
    "menu submenu breadcrumb breadcrumbs sidebar masthead topbar banner promo promotion consent notice notices alert discussion related recommended recommendations"
    " toolbar widget widgets legal disclaimer copyright search share sharing social"
)
NO_HINT_AFTER = _NAMES("with has no without is not")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：\"'()«»“”„-]")

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<!--|<[!?/][^>]*>|<[A-Za-z/!?][^>]*\Z""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")

KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
SPREAD = 0.25
#: Share of an article's mean ratio that a softly hinted part of it must reach.
PROSE = 0.5
#: Elements nested deeper than this become siblings, as in browsers.
DEEPEST = 500
MOST = 0.9


@dataclass
class Node:
    """An element: its tag, its parent, whether its text is left out, whether its path decides that, and whether it is in an article or holds one."""

    tag: str
    parent: Node | None
    path: int
    out: bool = False
    hinted: bool = False
    soft: bool = False
    article: bool = False
    holds: bool = False
    children: list = field(default_factory=list)


@dataclass
class Leaf:
    """A piece of text: the element that holds it, and the number of its block."""

    node: Node
    text: str
    block: int


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)}


def _hinted(attributes: dict[str, str]) -> frozenset[str]:
    """The hints in class and id."""
    found = frozenset()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if not NO_HINT_AFTER.intersection(parts):
            found |= HINTS.intersection(parts)
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or attributes.get("role", "").lower() in ROLES


class Page:
    """The elements and text nodes of a page in order."""

    def __init__(self, source: str):
        self.root = Node("#", None, 0)
        self.paths: dict[tuple[int, str], int] = {}
        self.open = [self.root]
        self.leaves: list[Leaf] = []
        self.block = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                return
            self._text(source[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = source.find("-->", m.start() + 2)
                at = n if end < 0 else end + 3
                continue
            closing, name, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
            if not name:
                continue
            if closing:
                self._end(name)
            elif name in RAW:
                end = re.compile(f"</{name}[\\s/>]", re.I).search(source, at)
                at = n if end is None else source.find(">", end.start()) + 1 or n
                self._text(" ")
            else:
                self._start(name, attributes)

    def _text(self, text: str) -> None:
        if text:
            self.leaves.append(Leaf(self.open[-1], text, self.block))

    def _close(self, tags: frozenset[str], until: frozenset[str]) -> None:
        """End the innermost open element of ``tags``, unless one of ``until`` is inside of it."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                del self.open[at:]
                self.block += 1
                return
            if self.open[at].tag in until:
                return

    def _start(self, name: str, raw: str) -> None:
        if name in BLOCK and name not in ("html", "body"):
            self._close(_NAMES("p"), _NAMES("td th button object"))
        if name in IMPLIED:
            self._close(*IMPLIED[name])
        if name in BLOCK:
            self.block += 1
        if name == "br" or name in ("td", "th"):
            self._text(" ")
        if name in VOID:
            return
        if len(self.open) > DEEPEST:
            self.open.pop()
        parent = self.open[-1]
        attributes = _attributes(raw) if raw.strip(" /") else {}
        first = attributes.get("class", "").split()[:1]
        path = self.paths.setdefault((parent.path, ".".join([name, *first])), len(self.paths) + 1)
        node = Node(name, parent, path)
        node.article = parent.article or name in ("article", "main")
        node.out = name in NEVER or name == "header" and not parent.article or name not in ROOTS and _hidden(attributes)
        hints = _hinted(attributes) if name not in ROOTS and not node.out else frozenset()
        node.hinted = bool(hints)
        node.soft = parent.article and bool(hints) and hints <= SOFT
        if parent.article and node.hinted and name in ("header", "div", "section", "hgroup") and "header" in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower():
            node.hinted = node.soft = False
        parent.children.append(node)
        self.open.append(node)
        if name in ("article", "main") and not (node.out or node.hinted):
            for around in self.open:
                around.holds = True

    def _end(self, name: str) -> None:
        if name == "p" or name not in VOID:
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag == name:
                    del self.open[at:]
                    break
        if name in BLOCK:
            self.block += 1


def _left_in(page: Page) -> list[Leaf]:
    """The leaves outside of what is never article text; a class or id alone does not rule out what an article is in or what stands in one."""
    prose = _prose(page)
    out = {}

    def is_out(node: Node) -> bool:
        chain = []
        while node is not None and id(node) not in out:
            chain.append(node)
            node = node.parent
        verdict = out[id(node)] if node is not None else False
        for one in reversed(chain):
            verdict = out[id(one)] = verdict or one.out or one.hinted and not one.holds and id(one) not in prose
        return verdict

    return [leaf for leaf in page.leaves if not is_out(leaf.node)]


def _prose(page: Page) -> set[int]:
    """Softly hinted elements of an article whose paths are as rich in text and punctuation as those of its other parts."""
    parts: dict[int, list[int]] = {}
    own: dict[int, list[int]] = {}
    for at, leaf in enumerate(page.leaves):
        node, soft = leaf.node, None
        while node is not None and not node.out:
            soft = node if node.soft else soft
            node = node.parent
        if node is None and soft is not None:
            parts.setdefault(id(soft), []).append(at)
        elif node is None and leaf.node.article and not leaf.text.isspace():
            own.setdefault(0, []).append(at)
    if not parts:
        return set()
    ratios = path_ratios(page.leaves)
    usual = np.mean([ratios[at] for at in own.get(0, ())] or [0.0])
    return {node for node, leaves in parts.items() if max(ratios[at] for at in leaves) >= PROSE * usual}


def path_ratios(leaves: list[Leaf]) -> np.ndarray:
    """The geometric mean of the text and punctuation ratios of every leaf's path; 0 for blank leaves."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for leaf in leaves:
        if not leaf.text.isspace():
            length[leaf.node.path] += len(leaf.text.strip())
            marks[leaf.node.path] += len(PUNCTUATION.findall(leaf.text))
            count[leaf.node.path] += 1
    ratio = {p: np.sqrt(length[p] / n * (1 + marks[p] / n)) for p, n in count.items()}
    return np.array([0.0 if leaf.text.isspace() else ratio[leaf.node.path] for leaf in leaves])


def path_scores(leaves: list[Leaf]) -> np.ndarray:
    """The fused, smoothed ratio of every leaf's path; 0 for blank leaves."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    filled = [leaf for leaf in leaves if not leaf.text.isspace()]
    for leaf in filled:
        path = leaf.node.path
        length[path] += len(leaf.text.strip())
        marks[path] += len(PUNCTUATION.findall(leaf.text))
        count[path] += 1
    if not filled:
        return np.zeros(len(leaves))
    text = np.array([length[leaf.node.path] / count[leaf.node.path] for leaf in filled])
    mark = np.array([1 + marks[leaf.node.path] / count[leaf.node.path] for leaf in filled])
    weight = np.convolve(np.ones(len(filled)), KERNEL)[2 : 2 + len(filled)]
    smooth = [np.convolve(x, KERNEL)[2 : 2 + len(filled)] / weight for x in (text, mark)]
    fused = iter(np.sqrt(smooth[0] * smooth[1]))
    return np.array([0.0 if leaf.text.isspace() else next(fused) for leaf in leaves])


def _smallest(page: Page, weight: dict[int, int], share: float) -> Node:
    """The smallest block with that share of the weight of the page, or what a lone paragraph or heading is in."""
    root, least = page.root, share * weight[id(page.root)]
    while inner := [c for c in root.children if weight[id(c)] >= least]:
        root = inner[0]
    while root.tag not in BLOCK and root.parent is not None:
        root = root.parent
    if root.tag in ("p", "li", "td", "th", "h1", "h2", "h3", "blockquote", "pre") and root.parent is not None and not root.article:
        root = root.parent
    return root


def _content_root(page: Page, leaves: list[Leaf], chosen: list[Leaf]) -> Node:
    """The article that nearly all of the chosen text is in; without one, the smallest element with all of it, or what adds its heading."""
    weight: dict[int, int] = defaultdict(int)
    for leaf in chosen:
        node = leaf.node
        while node is not None:
            weight[id(node)] += len(leaf.text)
            node = node.parent
    around, found = _smallest(page, weight, MOST), None
    while around is not None:
        if around.tag in ("article", "main") and (found is None or around.tag == "article" == found.tag):
            found = around
        around = around.parent
    if found is not None:
        return found
    root = _smallest(page, weight, 1)
    parent = root.parent
    if parent is not None and parent.tag not in ("html", "#") and any(_is_in(leaf.node, parent) and leaf.node.tag in ("h1", "h2") for leaf in leaves):
        return parent
    return root


def _is_in(node: Node | None, root: Node) -> bool:
    while node is not None:
        if node is root:
            return True
        node = node.parent
    return False


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    leaves = _left_in(page)
    scores = path_scores(leaves)
    if not scores.any():
        return ""
    inside = scores[scores > 0]
    limit = min(SPREAD * (inside.mean() + inside.std()), inside.max())
    root = _content_root(page, leaves, [leaf for leaf, score in zip(leaves, scores) if score >= limit])
    blocks: dict[int, list[str]] = {}
    for leaf in leaves:
        if _is_in(leaf.node, root):
            blocks.setdefault(leaf.block, []).append(leaf.text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page its page_id, url, text and the number of code points of the text."""
    types = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def step(batch: pa.RecordBatch):
        text = [main_text(source.as_py()) for source in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return per_batch(pages, ["page_id", "url", "html"], f"{types}, text string, n_chars bigint", step)
