"""HTML extraction with a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements (inline elements are part of the
block around them).  Every block is content or not: a hidden state, with the
likelihood of its tag, its names and its text statistics as node potential and
the probability of a child's state given its parent's as parent-child
potential, both learned from labelled pages (counts with smoothing); sections
and plain blocks such as paragraphs have transition tables of their own.  Messages
are passed once upward and once downward (sum-product, exact on a tree); blocks
whose content marginal exceeds one half give the text.

Scripts, styles, comments and the controls of forms hold no text at all.
Character references are decoded, white space within a block becomes one space,
blocks are joined by an empty line in the order of the page.  A null or empty
page, and one without content, gives the empty string.  Nothing is cut, however
long or deeply nested.  Pages are independent rows; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame

from veilwork.llm.html_training import PAGES
from veilwork.llm.shared import table

# What HTML says about elements.
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
SECTIONS = frozenset("article aside dialog div footer form header main menu nav search section".split())
CELLS = frozenset("td th".split())  # hold columns of a page as well as figures
SILENT = frozenset("script style template noscript textarea select button svg math iframe object canvas audio video head title option datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol menu dl table body html article section div".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME = re.compile(r"[a-z]+")


class Block:
    """A block element: text runs and child blocks in order."""

    __slots__ = ("attributes", "children", "inner", "inner_link", "link", "parent", "parts", "tag")

    def __init__(self, tag: str, attributes: str, parent):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.parts: list = []  # strings and blocks
        self.children: list[Block] = []
        self.link = 0  # characters inside links
        self.inner = self.inner_link = 0  # characters below this block, and of these inside links


def parse(page: str) -> Block:
    """The block tree of a page; tolerant of unclosed and stray tags."""
    root = here = Block("html", "", None)
    depth, at, in_link, silent = 0, 0, False, ""
    size = len(page)
    opened = Counter()  # open blocks by tag, so that a stray tag does not climb a deep page in vain

    def closed(upto: Block) -> Block:
        node = here
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent
        return upto

    while at < size:
        if silent:  # raw text and controls: on to the end tag
            at, silent = past(page, at, silent), ""
            continue
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            here.parts.append(text)
            if in_link:
                here.link += len(text)
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                in_link = False
            elif opened[name]:
                node = here
                while node.tag != name:
                    node = node.parent
                here = closed(node.parent)
            elif name == "br":
                here.parts.append(" ")
            continue
        if name == "head":
            continue
        if name in SILENT:
            if not m.group(3).rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                silent = name
            continue
        if name == "a":
            in_link = True
        elif name == "br":
            here.parts.append(" ")
        elif name in BLOCKS and name not in ("html",):
            in_link = False
            if name == "body":
                root.attributes = m.group(3)
                continue
            if name in CLOSES_P and opened["p"]:
                node = here
                while node is not root and node.tag not in SCOPES and node.tag != "p" and node.tag != "li":
                    node = node.parent
                if node.tag == "p":
                    here = closed(node.parent)
            if name in SIBLINGS and any(opened[x] for x in SIBLINGS[name]):
                node = here
                while node is not root and node.tag not in SCOPES and node.tag not in SIBLINGS[name]:
                    node = node.parent
                while node.tag in SIBLINGS[name]:
                    here = node = closed(node.parent)
            if name == "hr":
                here.parts.append(Block("hr", "", here))
                continue
            depth = 0
            new = Block(name, m.group(3), here)
            here.parts.append(new)
            here.children.append(new)
            opened[name] += 1
            here = new
    return root


NESTED = frozenset("svg math object select button template noscript".split())  # may hold elements, also of their own name


def past(page: str, at: int, name: str) -> int:
    """Where the text goes on behind an element that holds none: at its end tag, with nested ones of its name counted."""
    tags = re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.IGNORECASE)
    depth, first = 1, at
    for m in tags.finditer(page, at):
        if m.group(1):
            depth -= 1
        elif name in NESTED and not m.group().endswith("/>"):
            depth += 1
        if not depth or name not in NESTED and m.group(1):
            return m.end()
    return first if name in NESTED else len(page)


def in_order(root: Block) -> list[Block]:
    """Blocks, parents first."""
    out, stack = [], [root]
    while stack:
        block = stack.pop()
        out.append(block)
        stack.extend(reversed(block.children))
    for block in reversed(out):
        block.inner += sum(len(p) - p.count(" ") for p in block.parts if p.__class__ is str)
        block.inner_link += block.link
        if block.parent is not None:
            block.parent.inner += block.inner
            block.parent.inner_link += block.inner_link
    return out


def names_of(attributes: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}


def features(block: Block) -> list[str]:
    """Tag, words of class, id and role, and coarse statistics of the text in the block and below it."""
    found = ["tag=" + block.tag] if block.tag in SECTIONS else []  # others take after their parent
    if block.attributes:
        given = names_of(block.attributes)
        named = " ".join(given.get(k, "") for k in ("class", "id", "role")).lower()
        found += ["name=" + w for w in sorted(set(NAME.findall(named)))]
    text = sum(len(p) for p in block.parts if p.__class__ is str)
    if text > 1:
        share = block.link / text
        found.append("links=" + ("most" if share > 0.6 else "some" if share > 0.2 else "few"))
        if block.tag not in HEADINGS:
            found.append("text=" + ("long" if text > 60 and share < 0.5 else "short"))
    if block.children:
        share = block.inner_link / block.inner if block.inner else 1.0
        found.append("inside=" + ("links" if share > 0.4 else "little" if block.inner < 50 else "text"))
    return found


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of features and the states' transition probabilities."""

    ratios: dict[str, float]
    child: tuple  # P(child state | parent state), for plain blocks, sections and table cells
    root: float  # log odds of the root


def kind(block: Block) -> int:
    """Which table of transitions the block has."""
    return 1 if block.tag in SECTIONS else 2 if block.tag in CELLS else 0


def train(pages: list[str] | None = None, smoothing: float = 0.1) -> Model:
    """Count features and transitions over labelled pages."""
    seen = (Counter(), Counter())
    moves = [[[smoothing, smoothing], [smoothing, smoothing]] for _ in range(3)]
    roots = [1.0, 1.0]
    totals = [0, 0]
    for page in PAGES if pages is None else pages:
        tree, state = parse(page), {}
        for block in in_order(tree):
            mark = names_of(block.attributes).get("data-keep")
            y = int(mark) if mark in ("0", "1") else state.get(id(block.parent), 0)
            state[id(block)] = y
            totals[y] += 1
            seen[y].update(features(block))
            if block.parent is None:
                roots[y] += 1
            else:
                moves[kind(block)][state[id(block.parent)]][y] += 1
    ratios = {
        f: log((seen[1][f] + smoothing) / (totals[1] + 2 * smoothing)) - log((seen[0][f] + smoothing) / (totals[0] + 2 * smoothing))
        for f in seen[0] | seen[1]
    }
    child = tuple(tuple(tuple(c / sum(row) for c in row) for row in kind) for kind in moves)
    return Model(ratios, child, log(roots[1] / roots[0]))


def _through(x: float, p: tuple[float, float, float, float]) -> float:
    """``log((p0 * e**x + p1) / (p2 * e**x + p3))`` without overflow."""
    if x > 0:
        e = exp(-x)
        return log((p[0] + p[1] * e) / (p[2] + p[3] * e))
    e = exp(x)
    return log((p[0] * e + p[1]) / (p[2] * e + p[3]))


def marginals(blocks: list[Block], model: Model) -> dict[int, float]:
    """Log odds of content for every block, by one pass up and one pass down."""
    tables = [((c11, c10, c01, c00), (c11, c01, c10, c00)) for (c00, c01), (c10, c11) in model.child]
    own = {id(b): sum(model.ratios.get(f, 0.0) for f in features(b)) for b in blocks}
    own[id(blocks[0])] += model.root
    sent = {}
    for b in reversed(blocks):  # children before parents
        if b.parent is not None:
            message = sent[id(b)] = _through(own[id(b)], tables[kind(b)][0])
            own[id(b.parent)] += message
    for b in blocks[1:]:  # parents before children: own of the parent is final
        own[id(b)] += _through(own[id(b.parent)] - sent[id(b)], tables[kind(b)][1])
    return own


def main_text(page: str | None, model: Model) -> str:
    """Text of the content blocks of a page."""
    if not page:
        return ""
    root = parse(page)
    blocks = in_order(root)
    odds = marginals(blocks, model)
    out: list[str] = []
    run: list[str] = []

    def close():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

    stack = [(root, iter(root.parts))]
    while stack:
        block, parts = stack[-1]
        for part in parts:
            if part.__class__ is str:
                if odds[id(block)] > 0:
                    run.append(part)
            else:
                close()
                if part.tag != "hr":
                    stack.append((part, iter(part.parts)))
                    break
        else:
            close()
            stack.pop()
    return "\n\n".join(out)


def extract(pages: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """The ``keep`` columns with ``text`` and ``n_chars``."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    model = train() if model is None else model
    kept = pages.select(*keep)
    schema = StructType([*kept.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [main_text(p, model) for p in part.column(last).to_pylist()]
                columns = [part.column(i) for i in range(last)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select(*keep, pages[column].alias("__html")).mapInArrow(run, schema)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
