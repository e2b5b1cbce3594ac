"""Main text of web pages by a tree-structured graphical model.

A page becomes its tree of elements.  Each element that holds text, or holds such elements, is a
variable: content or not.  Its own potential comes from its name, its class and id words, the
length, link share and stops of its text; each parent-child pair has a potential that
depends on both states and on the kind of child.  Sum-product messages go from the leaves to the
root and back, which gives every element's exact marginal; text is kept where its element's
marginal is at least one half.

The weights are trained on labelled pages (``html_pages``) by gradient steps on their likelihood:
observed minus expected counts, with expectations from the same messages.  Training is done once,
on the driver, and takes seconds; pages are parsed and read in Arrow batches.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from logweave.llm.common import map_rows
from logweave.llm.html_pages import labelled_pages

#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no part of a page's text.
UNSEEN = frozenset("script style head title noscript template iframe object svg canvas select option button textarea".split())
#: Elements that may stand in a head; any other one begins the body.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements that run on in their block's line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr input img br".split()
)
#: An open paragraph ends where one of these begins.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
#: Siblings that end one another, and what bounds the search.
ENDS_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
BOUNDARY = frozenset(["table", "td", "th", "body", "html"])
NAME_WORD = re.compile(r"[a-z]+")
OPENING = re.compile(r"<[A-Za-z/!?]")
CONDITION = re.compile(r"<!\[\s*(?:if|else|endif)\b", re.IGNORECASE)
ENDINGS = {"comment": re.compile(r"--\s*>"), "condition": re.compile(r"\]\s*>"), "section": re.compile(r"\]\s*\]\s*>")}


class Page(HTMLParser):
    """The page's tree and its runs of text in order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.words, self.marks = ["#page"], [-1], [()], [None]
        #: Of each element: the block that its text runs in, and the variable that owns the text.
        self.blocks, self.owners = [0], [0]
        #: Places in the stack of the open elements of each name.
        self.open: dict[str, list[int]] = {}
        #: (element, block, text, inside a link); a new block starts a new run.
        self.runs: list[tuple[int, int, str, bool]] = []
        self.stack = [0]
        self.hidden = 0
        self.links = 0
        # A tag that never ends is no text, and neither is what follows it.
        cut = OPENING.search(html, html.rfind(">") + 1)
        html = html[: cut.start()] if cut else html
        #: Where the last end of a comment and of either kind of marked section begins; behind it they never end.
        self.ends = {kind: max((m.start() for m in end.finditer(html)), default=-1) for kind, end in ENDINGS.items()}
        self.feed(html)
        self.close()

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            # A marked section of no known name is a comment up to the next ">".
            return self.parse_bogus_comment(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment that never ends hides the rest of the page."""
        if i + 4 > self.ends["comment"]:
            return len(self.rawdata)
        return super().parse_comment(i, report)

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        """A marked section that never ends is a comment up to the next ">"."""
        kind = "condition" if CONDITION.match(self.rawdata, i) else "section"
        if i + 3 > self.ends[kind]:
            return self.parse_bogus_comment(i)
        return super().parse_marked_section(i, report)

    def begin_body(self) -> None:
        """Close a head that was never closed, unless one of its elements is open."""
        if self.hidden and self.tags[self.stack[-1]] == "head":
            self.end("head", frozenset())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD:
            self.begin_body()
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text(" ")
            return
        if tag in ENDS_PARAGRAPH:
            self.end("p", BOUNDARY)
        if tag in ENDS_SIBLING:
            for sibling in ENDS_SIBLING[tag][0]:
                self.end(sibling, ENDS_SIBLING[tag][1])
        if tag == "body" and self.hidden:
            # A head that was never closed, nor what is open in it.
            self.end("head", frozenset())
        names = []
        mark = self.marks[self.stack[-1]]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += NAME_WORD.findall(value.lower())
            elif key == "data-content":
                mark = value == "1"
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.words.append(tuple(dict.fromkeys(names)))
        self.marks.append(mark)
        node, above = len(self.tags) - 1, self.stack[-1]
        inline = tag in INLINE
        self.blocks.append(self.blocks[above] if inline else node)
        self.owners.append(self.owners[above] if inline and not names else node)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        self.hidden += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.end(tag, frozenset() if tag in ("body", "html", "table") else frozenset(["body"]))

    def end(self, tag: str, bounds: frozenset | set) -> None:
        """Close the innermost open element of that name, and all inside it, unless a bound comes first."""
        places = self.open.get(tag)
        if not places:
            return
        at = places[-1]
        if any(self.open[bound][-1] > at for bound in bounds if self.open.get(bound)):
            return
        for node in self.stack[at:]:
            name = self.tags[node]
            self.open[name].pop()
            self.hidden -= name in UNSEEN
            self.links -= name == "a"
        del self.stack[at:]

    def text(self, data: str) -> None:
        if self.hidden and not data.isspace():
            self.begin_body()
        if self.hidden:
            return
        node = self.stack[-1]
        self.runs.append((self.owners[node], self.blocks[node], data, self.links > 0))

    handle_data = text


class Tree:
    """The variables of a page: elements above text, parents before children."""

    def __init__(self, page: Page):
        count = len(page.tags)
        own, linked, ended = [0] * count, [0] * count, [0] * count
        total = 0
        for owner, _, text, link in page.runs:
            size = len(text.split()) and len(text.strip())
            if not size:
                continue
            own[owner] += size
            total += size
            linked[owner] += size if link else 0
            ended[owner] += sum(text.count(c) for c in ".!?,")
        below, links = own[:], linked[:]
        for node in range(count - 1, 0, -1):
            below[page.parents[node]] += below[node]
            links[page.parents[node]] += links[node]
        self.nodes = [n for n in range(count) if below[n]]
        self.place = {n: at for at, n in enumerate(self.nodes)}
        self.parent = [self.place[page.parents[n]] if n else -1 for n in self.nodes]
        self.features, self.kinds = [], []
        for node in self.nodes:
            tag, words = page.tags[node], page.words[node]
            top = node == 0 or page.tags[page.parents[node]] in TOP
            kind = kind_of(tag, bool(words))
            found = [f"tag {tag}", f"links {10 * links[node] // max(1, below[node])}"]
            if kind > 2 or top:
                # Plain blocks inside an element leave the evidence of lengths to that element.
                found += [f"own {min(9, own[node].bit_length())}", f"below {min(10, below[node].bit_length())}",
                          f"in {page.tags[page.parents[node]] if node else ''}",
                          f"share {5 * below[node] // max(1, total)}", f"stops {min(4, ended[node])}"]
            found += [f"name {w}" for w in words]
            found += [f"word {w} {'short' if below[node] < 400 else 'long'}" for w in words]
            self.features.append(found)
            self.kinds.append(kind + len(KINDS) * top)
        self.marks = [page.marks[n] for n in self.nodes]


KINDS = ("text", "list", "cell", "section", "named", "other")
#: Elements that say nothing of what lies right in them; their children are kinds of their own.
TOP = ("#page", "html", "body")


def kind_of(tag: str, named: bool) -> int:
    if named:
        return 4
    if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "figcaption", "dd", "dt"):
        return 0
    if tag in ("ul", "ol", "li", "dl", "menu"):
        return 1
    if tag in ("table", "tbody", "tr", "td", "th"):
        return 2
    return 3 if tag in ("div", "section", "article", "main") else 5


def softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def messages(parent: list[int], own: list[float], pair: list[tuple[float, float, float, float]]):
    """Sum-product on a tree.

    ``own`` is each variable's log-odds, ``pair`` the potentials of the edge to its parent for
    the states (parent, child) 00, 01, 10, 11; parents come before children.  Returns each
    marginal and, for each edge, the probabilities of its four states.
    """
    count = len(parent)
    collected = own[:]
    up = [0.0] * count
    for n in range(count - 1, 0, -1):
        a, b, c, d = pair[n]
        x = collected[n]
        # Log-odds that the child's side gives the parent.
        up[n] = (c - a) + softplus(x + d - c) - softplus(x + b - a)
        collected[parent[n]] += up[n]
    whole = collected[:]
    edges: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * count
    for n in range(1, count):
        a, b, c, d = pair[n]
        outside = whole[parent[n]] - up[n]
        x = collected[n]
        whole[n] = x + (b - a) + softplus(outside + d - b) - softplus(outside + c - a)
        scores = (a, b + x, c + outside, d + outside + x)
        top = max(scores)
        parts = [math.exp(s - top) for s in scores]
        total = sum(parts)
        edges[n] = tuple(p / total for p in parts)
    return [1 / (1 + math.exp(-max(-50.0, min(50.0, w)))) for w in whole], edges


class Model:
    """Weights of features, and of the four states of an edge for each kind of child and of parent."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        # To begin with, plain text, lists and cells go with the element they lie in.
        self.pairs = np.zeros((2 * len(KINDS), 4))
        self.pairs[:3] = (4, -4, -4, 4)

    def marginals(self, tree: Tree) -> tuple[list[float], list]:
        known = self.weights.get
        own = [sum([known(f, 0.0) for f in found]) for found in tree.features]
        table = [tuple(row) for row in self.pairs.tolist()]
        return messages(tree.parent, own, [table[k] for k in tree.kinds])

    def extract(self, html: str | None) -> str:
        page = Page(html or "")
        tree = Tree(page)
        if len(tree.nodes) < 1:
            return ""
        kept, _ = self.marginals(tree)
        out, last = [], None
        for owner, block, text, _ in page.runs:
            if owner in tree.place and kept[tree.place[owner]] >= 0.5:
                if block != last:
                    out.append(" ")
                out.append(text)
            elif not text.isspace():
                out.append(" ")
            last = block
        return " ".join("".join(out).split())


def fit(pages: list[str], rounds: int = 50, rate: float = 0.3, decay: float = 2e-4) -> Model:
    """Likelihood ascent with adaptive steps over batches of pages."""
    trees = [Tree(Page(html)) for html in pages]
    model = Model()
    held: dict[str, float] = {}
    held_pairs = np.full(model.pairs.shape, 1e-6)
    batch = 30
    for turn in range(rounds):
        for at in range(0, len(trees), batch):
            slope: dict[str, float] = {}
            pairs = np.zeros(model.pairs.shape)
            for tree in trees[at : at + batch]:
                expected, edges = model.marginals(tree)
                for n, found in enumerate(tree.features):
                    error = bool(tree.marks[n]) - expected[n]
                    for f in found:
                        slope[f] = slope.get(f, 0.0) + error
                    if n:
                        pairs[tree.kinds[n], 2 * bool(tree.marks[tree.parent[n]]) + bool(tree.marks[n])] += 1
                        pairs[tree.kinds[n]] -= edges[n]
            for f, s in slope.items():
                s = s / batch - decay * model.weights.get(f, 0.0)
                held[f] = held.get(f, 1e-6) + s * s
                model.weights[f] = model.weights.get(f, 0.0) + rate * s / math.sqrt(held[f])
            pairs = pairs / batch
            held_pairs += pairs * pairs
            model.pairs += 4 * rate * pairs / np.sqrt(held_pairs)
    return model


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the built-in labelled pages."""
    return fit(labelled_pages())


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text (the article's text, empty if none) and n_chars of every row.

    A null html is an empty page.  Repeated rows stay, null ids and urls stay null; other columns
    are not read.
    """
    model = model or trained()

    def work(htmls, model):
        texts = [model.extract(html) for html in htmls]
        return [(text, len(text)) for text in texts]

    return map_rows(pages, ["html"], work, "text string, n_chars long", keep=("page_id", "url"), setup=lambda: model)
