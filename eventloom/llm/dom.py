"""A forgiving, linear reader of HTML and the features of its block elements.

Markup is scanned forwards once. Tags are read as browsers read them: quotes
count only where a value begins, an apostrophe in an unquoted value is a letter,
a quote that never closes is a letter too, and a tag, comment or raw element
that never ends takes the rest of the page with it. What is open is counted by
name, so finding what a tag closes costs no more than what it closes.
"""

from __future__ import annotations

import html as html_lib
import math
import re
import zlib
from collections import Counter

import numpy as np

MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
NAME = re.compile(r"[A-Za-z][^\s/>]*+")
# Up to the tag's end: letters, and values in quotes after an equals sign.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAMING = frozenset(("class", "id", "role", "aria-label", "itemprop"))

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("head script style textarea title noscript iframe template svg math object canvas audio video select option optgroup button input datalist".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
CONTROLS = frozenset("select option optgroup button datalist label".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup", "legend"}
# Which open elements a start tag ends, and within which element.
ENDS = [("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("td th", "td th", "tr table"), ("tr", "tr td th", "table"), ("thead tbody tfoot", "thead tbody tfoot tr td th", "table")]
GROUP_OF_START = {t: g for g, (starts, _, _) in enumerate(ENDS) for t in starts.split()}
ENDED_IN = [frozenset(ended.split()) for _, ended, _ in ENDS]
FENCE_OF = [frozenset(fence.split()) for _, _, fence in ENDS]
TAG_GROUPS = [("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("div",), ("section",), ("blockquote", "pre", "figure", "figcaption"), ("table", "tr", "td", "th", "tbody", "thead"), ("html", "body")]
TAG_GROUP_OF = {t: i for i, tags in enumerate(TAG_GROUPS) for t in tags}
N_MEASURES = 19
TOKEN_BUCKETS = 1 << 14


def attribute_tokens(attrs: str) -> tuple[int, ...]:
    """Hashed words of the attributes that name or describe an element."""
    found = []
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        if name.lower() in NAMING:
            found += [zlib.crc32(w.lower().encode()) % TOKEN_BUCKETS for w in PIECE.findall(a or b or c)]
    return tuple(dict.fromkeys(found))


class Node:
    """A block element. ``parts`` holds its text runs and child nodes in order."""

    __slots__ = ("tag", "up", "parts", "tokens", "links", "chars", "link_chars", "tags", "controls", "stops", "start", "depth", "place", "paragraphs", "p_chars")

    def __init__(self, tag: str, up: Node | None, attrs: str, start: int):
        self.tag, self.up, self.parts, self.start = tag, up, [], start
        self.links = self.chars = self.link_chars = self.controls = self.stops = self.paragraphs = self.p_chars = 0
        self.tags = 1
        # What the body is called tells of the page, not of a part of it.
        self.tokens = attribute_tokens(attrs) if "=" in attrs and tag != "body" else ()
        self.depth = up.depth + 1 if up else 0
        self.place = 0


def _tag_end(page: str, at: int) -> tuple[str, int] | None:
    """The attributes of the tag whose name ends at ``at``, and where it ends."""
    m = REST.match(page, at)
    return (m[0], m.end() + 1) if page.startswith(">", m.end()) else None


class _Open:
    """The open elements, counted by name within the innermost block."""

    def __init__(self, root: Node):
        self.tags, self.nodes, self.owner = ["html"], [root], [root]
        self.blocks: Counter = Counter()
        self.inline = [Counter()]  # by name, for each open block
        self.near = [(-1,) * len(ENDS)]  # place of the nearest element that a start tag would end
        self.in_link = 0

    def push(self, tag: str, node: Node | None) -> None:
        if node is None:
            self.inline[-1][tag] += 1
            self.in_link += tag == "a"
        else:
            here = len(self.tags)
            self.near.append(tuple(here if tag in ENDED_IN[g] else -1 if tag in FENCE_OF[g] else self.near[-1][g] for g in range(len(ENDS))))
            self.nodes.append(node)
            self.blocks[tag] += 1
            self.inline.append(Counter())
        self.tags.append(tag)
        self.owner.append(node)

    def pop(self) -> str:
        tag = self.tags.pop()
        if self.owner.pop() is None:
            self.inline[-1][tag] -= 1
            self.in_link -= tag == "a"
        else:
            self.nodes.pop(), self.near.pop(), self.inline.pop()
            self.blocks[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """An end tag; one of an inline element doesn't reach out of its block."""
        if self.blocks[tag] if tag in BLOCK else self.inline[-1][tag]:
            while self.pop() != tag:
                pass

    def make_room(self, tag: str) -> None:
        """Close what the start tag of a block ends."""
        if tag in CLOSES_P and self.nodes[-1].tag == "p" and len(self.nodes) > 1:
            self.close("p")
        if tag in GROUP_OF_START:
            while (k := self.near[-1][GROUP_OF_START[tag]]) >= 0:
                while len(self.tags) > k:
                    self.pop()


class _Dropped:
    """A dropped element that is open, and what is open in it."""

    def __init__(self, tag: str, unended: bool):
        self.tag, self.depth, self.inner, self.unended = tag, 1, [], unended
        self.blocks: Counter = Counter()


def _unended(page: str) -> dict[str, list[int]]:
    """Places of start tags of controls after which another one starts before any ends."""
    found: dict[str, list[int]] = {t: [] for t in CONTROLS}
    last: dict[str, int] = {}
    for m in re.finditer(r"<(/?)(select|option|optgroup|button|datalist|label)(?=[\s/>])", page, re.IGNORECASE):
        tag = m[2].lower()
        if m[1]:
            last.pop(tag, None)
        else:
            if tag in last:
                found[tag].append(last[tag])
            last[tag] = m.start()
    for tag, at in last.items():
        found[tag].append(at)
    return found


def parse(page: str) -> list[Node]:
    """The block elements of a page in order; the first is the root."""
    root = Node("html", None, "", 0)
    nodes, opened = [root], _Open(root)
    dropped: _Dropped | None = None
    unended: dict[str, set[int]] | None = None
    at = 0

    def text(run: str) -> None:
        if run and dropped is None:
            node = opened.nodes[-1]
            plain = html_lib.unescape(run) if "&" in run else run
            node.parts.append(plain)
            n = len(plain.strip())
            if n:
                node.chars += n
                node.stops += sum(plain.count(c) for c in ".,;!?")
                if opened.in_link:
                    node.link_chars += n

    while True:
        m = MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        begin = m.start()
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 2 if page.startswith(("<!-->", "<!--->"), begin) else begin + 4)
            if end < 0:
                break
            at = end + 3
            continue
        closing = page.startswith("</", begin)
        name = NAME.match(page, begin + 1 + closing)
        if name is None:  # a declaration, an instruction, or an end tag without a name
            end = page.find(">", begin)
            if end < 0:
                break
            at = end + 1
            continue
        tag = name[0].lower()
        ended = _tag_end(page, name.end())
        if ended is None:
            break
        attrs, at = ended
        if closing:
            if dropped is not None:
                if tag == dropped.tag:
                    dropped.depth -= 1
                    if not dropped.depth:
                        dropped = None
                    continue
                if dropped.blocks[tag]:
                    while (last := dropped.inner.pop()) != tag:
                        dropped.blocks[last] -= 1
                    dropped.blocks[tag] -= 1
                    continue
                if dropped.tag not in CONTROLS or tag not in BLOCK or not opened.blocks[tag]:
                    continue
                dropped = None  # an enclosing block closes
            if tag not in ("html", "body"):
                opened.close(tag)
            continue
        if dropped is not None:
            if dropped.tag == "head" and not dropped.inner and tag not in IN_HEAD:
                dropped = None
            elif dropped.tag in CONTROLS and not dropped.inner and tag in BLOCK:
                around = opened.nodes[-1].tag
                ends_around = (around == "p" and tag in CLOSES_P and dropped.tag != "button") or (tag in GROUP_OF_START and around in ENDED_IN[GROUP_OF_START[tag]])
                if ends_around or dropped.unended:  # a control that never ends goes on to the next block
                    dropped = None
        if dropped is not None:
            if tag == "template" if dropped.tag == "head" else dropped.tag in CONTROLS and tag in BLOCK and tag != "hr":
                dropped.inner.append(tag)
                dropped.blocks[tag] += 1
            if tag == dropped.tag and not dropped.unended and not attrs.rstrip().endswith("/"):
                dropped.depth += 1
        elif tag == "html":
            pass
        elif tag in ("br", "wbr"):
            if tag == "br":
                opened.nodes[-1].parts.append(" ")
        elif tag in DROPPED or (tag == "label" and opened.blocks["form"]):
            opened.nodes[-1].controls += tag in ("input", "textarea", "select", "button", "label")
            if tag not in VOID and not attrs.endswith("/"):
                if tag in CONTROLS and unended is None:
                    unended = {t: set(places) for t, places in _unended(page).items()}
                dropped = _Dropped(tag, tag in CONTROLS and begin in unended[tag])
        elif tag in VOID and tag != "hr":
            opened.nodes[-1].tags += 1
        elif tag in BLOCK:
            opened.make_room(tag)
            node = Node(tag, opened.nodes[-1], attrs, begin)
            opened.nodes[-1].parts.append(node)
            nodes.append(node)
            if tag != "hr":
                opened.push(tag, node)
        else:
            here = opened.nodes[-1]
            here.tags += 1
            here.links += tag == "a"
            here.controls += tag == "label"
            if tag == "a" and opened.inline[-1]["a"]:
                opened.close("a")  # links don't nest
            if not attrs.endswith("/"):
                opened.push(tag, None)
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if end is None:
                break
            at = end.start()
    return nodes


SUMMED = ("chars", "link_chars", "tags", "links", "controls", "stops", "paragraphs", "p_chars")
#: Tags of ancestors that bear on what is inside them.
AROUND = ("nav", "footer", "aside", "form", "header", "article", "main")
AROUND_BIT = {t: 1 << i for i, t in enumerate(AROUND)}


class TokenOdds:
    """What hashed attribute words tell of an element and of what is inside it.

    ``own`` and ``above``: by token, the log-odds that an element with it, or
    below one with it, belongs to the article. Unknown tokens tell nothing.
    """

    def __init__(self, own: dict[int, float], above: dict[int, float]):
        self.own, self.above = own, above

    @staticmethod
    def learn(pages: list[tuple[list[Node], list[int]]], min_pages: int) -> TokenOdds:
        """From labelled pages: counts by token, smoothed, of tokens on enough pages."""
        found: tuple[dict, dict] = ({}, {})
        on_pages: Counter = Counter()
        for nodes, labels in pages:
            on_pages.update({t for n in nodes for t in n.tokens})
            below: dict[int, frozenset] = {id(nodes[0]): frozenset()}
            for n, label in zip(nodes, labels, strict=True):
                here = below[id(n)].union(n.tokens)
                for p in n.parts:
                    if isinstance(p, Node):
                        below[id(p)] = here
                for table, tokens in zip(found, (n.tokens, below[id(n)]), strict=True):
                    for t in tokens:
                        table.setdefault(t, [1, 1])[label] += 1
        return TokenOdds(*({t: math.log(n[1] / n[0]) for t, n in table.items() if on_pages[t] >= min_pages} for table in found))


N_FEATURES = len(TAG_GROUPS) + len(AROUND) + N_MEASURES + 4


def features(nodes: list[Node], page_chars: int, token_odds: TokenOdds) -> np.ndarray:
    """A row of ``N_FEATURES`` numbers for each node.

    Tag, ancestors' tags, measures of place and of the subtree, then the least
    and the greatest odds of the tokens of its own attributes and of its ancestors'.
    """
    own = [n.chars for n in nodes]
    for n in reversed(nodes):
        if n.tag == "p":
            n.paragraphs += 1
            n.p_chars += n.chars
        if n.up is not None:
            for field in SUMMED:
                setattr(n.up, field, getattr(n.up, field) + getattr(n, field))
    total = max(1, nodes[0].chars)
    x = np.zeros((len(nodes), N_FEATURES))
    siblings = {id(nodes[0]): 1}
    inherited: dict[int, tuple[int, float, float]] = {id(nodes[0]): (0, 0.0, 0.0)}
    measures = []
    for i, (n, mine) in enumerate(zip(nodes, own, strict=True)):
        tags_above, low_above, high_above = inherited[id(n)]
        kids = [p for p in n.parts if isinstance(p, Node)]
        if kids:
            said = [token_odds.above[t] for t in n.tokens if t in token_odds.above]
            handed = (tags_above | AROUND_BIT.get(n.tag, 0), min(low_above, *said, 0.0), max(high_above, *said, 0.0))
            for k, kid in enumerate(kids):
                kid.place = k
                siblings[id(kid)] = len(kids)
                inherited[id(kid)] = handed
        if n.tag in TAG_GROUP_OF:
            x[i, TAG_GROUP_OF[n.tag]] = 1.0
        for b in range(len(AROUND)):
            if tags_above >> b & 1:
                x[i, len(TAG_GROUPS) + b] = 1.0
        told = [token_odds.own[t] for t in n.tokens if t in token_odds.own]
        around = siblings[id(n)]
        up = n.up or n
        measures.append(
            (
                n.depth,
                n.place,
                around,
                n.place / around,
                n.start / max(1, page_chars),
                math.log1p(n.chars),
                math.log1p(mine),
                math.log1p(n.tags),
                n.chars / n.tags,
                n.chars / total,
                n.link_chars / max(1, n.chars),
                n.links,
                n.paragraphs,
                n.p_chars / max(1, n.chars),
                n.p_chars / max(1, n.paragraphs),
                100.0 * n.stops / max(1, n.chars),
                n.controls,
                up.chars / total,
                up.link_chars / max(1, up.chars),
                min(told, default=0.0),
                max(told, default=0.0),
                low_above,
                high_above,
            )
        )
    x[:, len(TAG_GROUPS) + len(AROUND) :] = measures
    return x
