"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh_name

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
PUNCTUATION = re.compile(r"[.,;:!?。，！？…]")

# fixed values: element classes of HTML
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "canvas", "title", "select"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i"}
INLINE |= {"ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong"}
INLINE |= {"sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
INLINE |= {"math", "mi", "mo", "mn", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot"}
BOILERPLATE = {"nav", "aside", "footer", "button", "dialog", "menu", "head"}
FORMS = {"form", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}}
SELF_CLOSING |= {"td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SELF_CLOSING |= {h: {"p", *HEADINGS} for h in HEADINGS}
# a block start ends an open paragraph
SELF_CLOSING |= {b: {"p"} for b in ("div", "ul", "ol", "table", "section", "article", "blockquote")}
SELF_CLOSING |= {b: {"p"} for b in ("pre", "footer", "header", "nav", "aside", "form", "main", "hr")}
SCOPES = {"ul", "ol", "table", "div", "section", "article", "main", "body", "aside", "blockquote"}

# fixed values: words of class, id and role that name what is no article text
NAMED = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay sidebar menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus respond replies "
    "complementary contentinfo search form dialog toolbar newsletter subscribe subscription signup login".split()
)
#: Words that article text may have too: inside an article the path's score decides.
HINTS = set(
    "promo promotion side widget widgets share sharing social related recommended recommendations "
    "pagination pager skip copyright legal".split()
)
#: Words that go with those in the id of such a part; with any other word an id names a subject.
NEUTRAL = set(
    "site page main top bottom left right head body foot content box wrap wrapper container area block section list item items "
    "link links bar inner outer primary secondary global user reader post slot unit panel row col the my new js id".split()
)
PAGE_HEADER = {"header", "masthead", "banner"}
NONE, TOPIC, HINT, NAME, SURE = range(5)
#: A line of rights at the end of a page.
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b).{0,200}", re.I | re.S)


def furniture(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element holds parts of a page other than its text: SURE by its tag or because it
    is hidden, NAME by a name or as a form, which may be a wrapper of the text, HINT, TOPIC for an id that has such a
    word among others, or NONE. Headings are what they say, whatever they are called."""
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return SURE
    found = NAME if tag in FORMS else NONE
    if tag in ("html", "body", "article", "main") or not attributes.strip(" />"):
        return found
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if hidden or (name == "aria-hidden" and value == "true"):
            return SURE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
        if name in ("class", "id", "role") and tag not in HEADINGS:
            words = set(re.split(r"[^a-z0-9]+", value))
            known = NAMED | HINTS | PAGE_HEADER | NEUTRAL
            if name == "id" and any(w not in known and not w.isdigit() for w in words if w):
                found = max(found, TOPIC if words & (NAMED | HINTS | PAGE_HEADER) else NONE)
            elif words & NAMED or (not in_article and words & PAGE_HEADER):
                found = NAME
            elif words & HINTS:
                found = max(found, HINT)
    return found


@dataclass
class Page:
    """Elements by number in page order (0 is the page itself), each with its parent, and runs of
    text (element, block, text, linked). Memory is linear in the page, however deep it nests."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    kind: list[int] = field(default_factory=lambda: [NONE])
    inner: list[bool] = field(default_factory=lambda: [False])  # inside an article or main
    #: the outermost article or main around an element, itself included, or -1
    region: list[int] = field(default_factory=lambda: [-1])
    #: the innermost element around it that is not inline, itself included
    outer: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)

    def add(self, parent: int, tag: str, kind: int, inner: bool) -> int:
        number = len(self.parent)
        self.parent.append(parent)
        self.tag.append(tag)
        self.kind.append(kind)
        self.inner.append(inner)
        around = self.region[parent]
        self.region.append(around if around >= 0 else number if tag in ("article", "main") else -1)
        self.outer.append(self.outer[parent] if tag in INLINE else number)
        return number

    def sums(self, own: dict[int, float]) -> list[float]:
        """What each element holds in all, of what hangs at it and those in it."""
        total = [own.get(e, 0.0) for e in range(len(self.parent))]
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total

    def inherited(self, marked: list[bool]) -> list[bool]:
        """Which elements are marked or lie in one that is."""
        out = list(marked)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out


def read_page(html: str) -> Page:
    """Elements and text outside raw elements and sure furniture, in page order."""
    page = Page()
    stack: list[tuple[int, bool]] = [(0, False)]  # element, in sure furniture
    opened: Counter = Counter()
    at = block = 0
    length = len(html)

    def close(k: int) -> None:
        for e, _ in stack[k:]:
            opened[page.tag[e]] -= 1
        del stack[k:]

    def say(text: str) -> None:
        if text and not stack[-1][1]:
            page.runs.append((stack[-1][0], block, unescape(text), opened["a"] > 0))

    while at < length:
        found = TOKEN.search(html, at)
        if not found:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        if found[1]:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if page.tag[stack[k][0]] == tag))
            continue
        if tag in RAW:
            if not found[3].endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else length
            continue
        if tag in VOID:
            continue
        if tag in SELF_CLOSING and any(opened[t] > 0 for t in SELF_CLOSING[tag]):
            for k in range(len(stack) - 1, 0, -1):
                open_tag = page.tag[stack[k][0]]
                if open_tag in SELF_CLOSING[tag]:
                    close(k)
                    break
                if open_tag in SCOPES:
                    break
        in_article = opened["article"] > 0 or opened["main"] > 0
        kind = furniture(tag, found[3], in_article)
        sure = stack[-1][1] or kind == SURE
        opened[tag] += 1
        stack.append((page.add(stack[-1][0], tag, SURE if sure else kind, in_article), sure))
    return page


@dataclass
class Block:
    """Text between two block tags: the element it hangs at, whether it is mostly links."""

    element: int
    text: str
    linked: bool


def blocks_of(page: Page) -> list[Block]:
    grouped: dict[int, list[tuple[int, int, str, bool]]] = defaultdict(list)
    for run in page.runs:
        grouped[run[1]].append(run)
    out = []
    for runs in grouped.values():
        text = " ".join("".join(r[2] for r in runs).split())
        if text:
            linked = sum(len(r[2].strip()) for r in runs if r[3])
            out.append(Block(page.outer[runs[0][0]], text, linked > 0.5 * len(text)))
    return out


def path_scores(page: Page, blocks: list[Block]) -> list[float]:
    """Of each block its tag path's score.

    A tag path is the tags from the root to a block, with a mark where an element is named like
    furniture. Of each path the mean text length and the mean punctuation of its blocks are taken
    (links count for nothing), smoothed over neighbouring blocks in page order and fused.
    """
    names: dict[tuple[int, str, int], int] = {}
    path = [0] * len(page.parent)
    for e in range(1, len(path)):
        above = path[page.parent[e]]
        path[e] = above if page.tag[e] in INLINE else names.setdefault((above, page.tag[e], page.kind[e]), len(names) + 1)
    count: Counter = Counter()
    length: Counter = Counter()
    marks: Counter = Counter()
    for b in blocks:
        k = path[b.element]
        count[k] += 1
        if not b.linked:
            length[k] += len(b.text)
            marks[k] += len(PUNCTUATION.findall(b.text))
    ratios = [(length[k] / count[k], marks[k] / count[k]) for k in (path[b.element] for b in blocks)]
    fused = []
    for i, own in enumerate(ratios):
        near = ratios[max(0, i - 1) : i + 2]
        smooth = [sum(r[j] for r in near) / len(near) for j in (0, 1)]
        fused.append((smooth[0] * own[0]) ** 0.5 * (1 + (smooth[1] * own[1]) ** 0.5))
    total: Counter = Counter()
    for b, f in zip(blocks, fused, strict=True):
        total[path[b.element]] += f
    return [total[path[b.element]] / count[path[b.element]] for b in blocks]


def main_text(html: str | None) -> str:
    """The content blocks of a page, each with single spaces, joined by a space.

    Paths whose score (see ``path_scores``) reaches a tenth of the page's mean, weighted by text,
    are content. They select the nodes: every outermost article or main most of whose text is on
    content paths; on a page whose content lies elsewhere, the innermost element that holds all
    content paths and the top headings. A selected node gives all its text, short or linked, but
    for elements in it that are named as parts other than text and are no wrapper of most of the
    page's text; where a name only hints, or an id names a subject with one of these words, that
    element's own paths decide. Outside an article, lists of links and a last line of rights go.
    """
    page = read_page(html or "")
    blocks = blocks_of(page)
    if not blocks:
        return ""
    plain: dict[int, float] = defaultdict(float)
    for b in blocks:
        plain[b.element] += 0 if b.linked else len(b.text)
    unlinked = page.sums(plain)
    # named elements that hold an article, or most of the page's text, are wrappers
    holds = page.sums({e: 1.0 for e, t in enumerate(page.tag) if t in ("article", "main") and page.kind[e] != SURE})
    texts = {page.region[b.element] for b in blocks if not b.linked and page.region[b.element] >= 0}
    told = len(texts) == 1 or any(page.tag[e] == "main" for e in texts)

    def wrapper(e: int) -> bool:
        return holds[e] > 0 or (2 * unlinked[e] > unlinked[0] and (page.inner[e] or not told))

    elements = range(len(page.parent))
    named = [page.kind[e] == NAME or (page.kind[e] == HINT and not page.inner[e]) for e in elements]
    dropped = page.inherited([named[e] and not wrapper(e) for e in elements])
    blocks = [b for b in blocks if not dropped[b.element]]
    scores = path_scores(page, blocks)
    weight = sum(len(b.text) for b in blocks)
    if not weight:
        return ""
    threshold = 0.1 * sum(f * len(b.text) for f, b in zip(scores, blocks, strict=True)) / weight
    content = [f >= threshold and f > 0 and not b.linked for f, b in zip(scores, blocks, strict=True)]
    if not any(content):
        content = [not b.linked for b in blocks]
    plain, good, linked, chosen = (defaultdict(float) for _ in range(4))
    for b, c in zip(blocks, content, strict=True):
        (linked if b.linked else plain)[b.element] += len(b.text)
        if c:
            good[b.element] += len(b.text)
        if c or (not b.linked and page.tag[b.element] == "h1"):
            chosen[b.element] += 1
    plain, good, linked, chosen = (page.sums(x) for x in (plain, good, linked, chosen))
    regions = {page.region[b.element] for b in blocks} - {-1}
    regions = {e for e in regions if good[e] and 2 * good[e] >= plain[e]}
    if 2 * sum(good[e] for e in regions) < good[0] or not regions:
        regions = set()
    whole = max((e for e in elements if chosen[e] == chosen[0]), default=0)
    while page.tag[whole] in {"p", "li", *HEADINGS} or page.outer[whole] != whole:
        whole = page.parent[whole]
    # an element whose name only hints goes if its paths are not content
    unsure = [page.kind[e] in (TOPIC, HINT) and not wrapper(e) for e in elements]
    hinted = page.inherited([unsure[e] and 2 * good[e] < plain[e] + linked[e] for e in elements])
    inside = page.inherited([e == whole for e in elements])
    out = []
    for b in blocks:
        e = b.element
        if hinted[e] or not (page.region[e] in regions if regions else inside[e]):
            continue
        above = page.parent[e] if e else 0
        heading = page.tag[e] in HEADINGS
        if b.linked and not regions and not heading and linked[above] > plain[above]:
            continue
        out.append(b.text)
    while not regions and len(out) > 1 and RIGHTS.fullmatch(out[-1]):
        out.pop()
    return " ".join(out)


def extract_text(
    pages: DataFrame, html_col: str = "html", keep: list[str] | None = None
) -> DataFrame:
    """The rows of ``pages`` with their columns (or those in ``keep``), text and n_chars.

    Null, empty and text-free pages have an empty text. Broken markup never fails: unclosed
    elements end where their parent does, a cut-off page ends where it is cut off. Pages stream
    through whole; repeated rows are extracted each. Columns named like the added are replaced.
    """
    plain = [c for c in (keep if keep is not None else pages.columns) if c not in ("text", "n_chars")]
    name = fresh_name(pages, "_html")
    source = pages.select(*[F.col(f"`{c}`") for c in plain], F.col(f"`{html_col}`").alias(name))

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch[name].to_pylist()]
            arrays = [batch[c] for c in plain]
            arrays += [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*plain, "text", "n_chars"])

    schema = pages.select(*[F.col(f"`{c}`") for c in plain]).schema
    return source.mapInArrow(run, schema.add("text", "string").add("n_chars", "long"))
