"""Main-text extraction: boosted trees over DOM nodes, decoded down the tree.

Every block element gets features (tag, tags of its ancestors, depth, place
among siblings, density of its subtree, links, paragraphs, stops, form controls,
and the words of its class, id and role and of its ancestors', hashed) and, from
gradient-boosted trees, the odds of belonging to the article. Decoding picks the
best labelling in which a path from the root is outside, then inside, then cut
out: nothing cut can hold article text and no article holds another one's
outside, so ancestor and descendant never contradict.

The trees are fitted with Spark ML on generated pages in many layouts with known
labels, a fixed bounded sample: ``TRAINING_PAGES`` whose parts have usual names and as
many that say little of their parts. Where the best labelling of a page is empty
though it has long paragraphs, the trees are taken to be wrong by the same odds
everywhere, the least that lets some of it be an article. What hashed attribute words
tell is learned there too, as log-odds of those on ``MIN_PAGES`` of these pages
or more. The pages of the table are all scored, whole.

Text: character references are decoded, white space in a block becomes one
space, blocks are joined by a line break. Defined results: null or empty html,
and pages without an article, give the empty string and 0; broken markup is
read as browsers do in the main, so a tag, comment or script that never ends
takes the rest of the page; repeated rows give equal results; an empty table
gives an empty result; other columns pass through if named in ``keep``.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession

from .common import kept_columns, map_texts, small_batches
from .dom import Node, TokenOdds, features, parse

TRAINING_PAGES = 500
MIN_PAGES = 5
N_TREES = 24
TREE_DEPTH = 5
ENTER_COST = 2.0
CUT_COST = 1.0
ODDS_LIMIT = 3.0
PROSE_CHARS = 400
MORE_ODDS = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
SLICE_CHARS = 4 << 20
SYLLABLES = "an er the on re ti in st ou ve la de que mi so ta lo en ar ch ung be ge".split()

# What the generated pages call their parts.
NAMES = {
    "main": "content post entry article story main-content post-content entry-content article-body articleBody story-body text prose page-content blog-post hentry single-post post-body",
    "nav": "nav navbar menu navigation main-nav site-nav breadcrumb breadcrumbs pagination pager toc tabs topnav nav-links menu-item sitemap",
    "header": "header masthead banner site-header top-bar topbar logo branding toolbar page-header",
    "footer": "footer legal copyright site-footer colophon bottom page-footer footer-links",
    "side": "sidebar side aside widget related recommended rail secondary right-column popular trending more-stories related-posts read-next tags tag-list",
    "ad": "ad ads advert advertisement sponsored promo sponsor ad-slot ad-container banner-ad promoted promotion",
    "notice": "notice cookie consent alert cookie-notice cookie-banner popup gdpr modal overlay newsletter-popup subscribe paywall warning toast",
    "form": "search login newsletter contact signup search-form login-form subscribe-form register",
    "talk": "comments comment-list discussion responses commentlist comments-area disqus reviews reader-comments feedback replies",
    "one": "comment reply response comment-body review",
    "share": "share social sharing share-buttons social-links follow like-bar",
    "plain": "wrapper container row inner outer box clearfix page site layout grid block wrap col-md-8 col-12 section-1 js-module u-mt4 flex l-region",
}
NAMES = {k: v.split() for k, v in NAMES.items()}


class _Writer:
    """Writes a page and keeps the label of every block element, in order."""

    def __init__(self, seed: int):
        self.r, self.out, self.labels = random.Random(seed), [], []

    def words(self, n: int) -> str:
        r = self.r
        body = " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + (r.choice(",. .!") if r.random() < 0.12 else "") for _ in range(n))
        noise = r.choice(["&amp;", "&nbsp;", "%%%", "***", "###", "&copy;"]) if r.random() < 0.1 else ""
        return body.capitalize() + noise + r.choice([".", ".", "", "!"])

    def block(self, tag: str, label: int, inside, attrs: str = "", closed: bool = True) -> None:
        self.labels.append(label)
        self.out.append(f"<{tag}{' ' + attrs if attrs else ''}>")
        inside() if callable(inside) else self.out.append(inside)
        self.out.append(f"</{tag}>" if closed else "")

    def links(self, n: int, label: int = 0) -> None:
        def items() -> None:
            for _ in range(n):
                self.block("li", label, f'<a href="/{self.r.randint(0, 999)}">{self.words(self.r.randint(1, 3))}</a>')

        self.block("ul", label, items)

    def named(self, kind: str, share: float = 1.0) -> str:
        """Attributes that name a part of the kind; in ``share`` of the cases only."""
        r = self.r
        if r.random() > share:
            return self.plain()
        name = r.choice(NAMES[kind])
        more = r.choice(NAMES["plain"])
        return r.choice([f'class="{name}"', f'class="{name}"', f'id="{name}"', f'class="{name} {more}"', f'class="{more} {name}"', f'class="site-{name}"', f'class="{name}-{r.randint(1, 9)}"', f"class={name}", f'role="region" class="{name}"', f'id="{name}" class="{more}"'])

    def plain(self) -> str:
        r = self.r
        if r.random() < 0.01:  # a part called after another one
            return f'class="{r.choice(["has", "with", "no"])}-{r.choice(NAMES[r.choice(list(NAMES))])}"'
        return self.r.choice(["", "", "", f'class="{self.r.choice(NAMES["plain"])}"', f'class="x{self.r.randint(100, 99999):x}"', 'style="margin:0"'])

    def paragraph(self, label: int, n: int | None = None) -> None:
        n = n or self.r.choice([1, 2, 5, 12, 30, 60, 120])
        body = self.words(n)
        style = self.r.random()
        if style < 0.15:
            body = f"<b>{body}<br>"
        elif style < 0.3:
            body = f'{body} <a href="#x">{self.words(2)}</a> <em>{self.words(2)}</em>'
        self.block("p", label, body, closed=self.r.random() > 0.2)

    def article(self) -> None:
        r = self.r
        heading = lambda: self.block(r.choice(["h1", "h1", "h2"]), 1, self.words(r.randint(2, 12)), self.plain())
        if r.random() < 0.8:
            self.block("header", 1, heading) if r.random() < 0.15 else heading()
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.70:
                self.paragraph(1)
            elif kind < 0.76:
                self.block(r.choice(["h2", "h3"]), 1, self.words(r.randint(1, 6)))
            elif kind < 0.81:
                self.block(r.choice(["ul", "ol"]), 1, lambda: [self.block("li", 1, self.words(r.randint(2, 25))) for _ in range(r.randint(2, 6))])
            elif kind < 0.85:
                self.block("blockquote", 1, lambda: self.paragraph(1))
            elif kind < 0.87:
                self.block("pre", 1, self.words(12))
            elif kind < 0.89:
                self.block("figure", 1, lambda: (self.out.append('<img src="x.png">'), self.block("figcaption", 1, self.words(r.randint(2, 10)))))
            elif kind < 0.91:
                self.block("table", 1, lambda: [self.block("tr", 1, lambda: [self.block("td", 1, self.words(2)) for _ in range(3)]) for _ in range(2)])
            elif kind < 0.94:
                self.block(r.choice(["div", "section"]), 1, lambda: [self.paragraph(1) for _ in range(r.randint(1, 3))], self.plain())
            else:
                self.junk(r.choice(["ad", "ad", "share", "notice", "side", "form"]))
        if r.random() < 0.08:
            self.junk("talk")

    def junk(self, kind: str) -> None:
        r = self.r
        few = lambda: [self.paragraph(0, r.randint(2, 30)) for _ in range(r.randint(1, 2))]
        if kind == "ad":
            self.block("div", 0, self.words(r.randint(3, 20)) if r.random() < 0.6 else few, self.named("ad"))
        elif kind == "share":
            self.block("div", 0, lambda: self.links(r.randint(2, 5)), self.named("share"))
        elif kind == "notice":
            self.block(r.choice(["div", "section", "div", "p"]), 0, self.words(r.randint(5, 40)), self.named("notice"))
        elif kind == "side":
            tag = r.choice(["aside", "aside", "div"])
            self.block(tag, 0, lambda: (self.block(r.choice(["h2", "h3"]), 0, self.words(2)), few() if r.random() < 0.5 else self.links(r.randint(2, 8))), self.named("side", 0.6 if tag == "aside" else 1))
        elif kind == "form":
            self.block("form", 0, lambda: (self.block("p", 0, self.words(r.randint(2, 12))), self.out.append('<label>E-mail</label><input name="q"><button>Send</button>')), self.named("form", 0.6))
        elif kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            if tag == "ul":
                self.block("div", 0, lambda: self.links(r.randint(3, 9)), self.named("nav"))
            else:
                self.block(tag, 0, lambda: self.links(r.randint(3, 9)), self.named("nav", 0.4 if tag == "nav" else 1))
        elif kind == "header":
            tag = r.choice(["header", "header", "div"])
            self.block(tag, 0, lambda: (self.block(r.choice(["div", "p", "h1"]), 0, self.words(r.randint(1, 5))), self.junk("nav") if r.random() < 0.5 else None), self.named("header", 0.5 if tag == "header" else 1))
        elif kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            body = self.words(r.randint(2, 25)) if r.random() < 0.5 else lambda: (self.block("p", 0, "&copy; " + self.words(r.randint(2, 15))), self.links(3) if r.random() < 0.5 else None)
            self.block(tag, 0, body, self.named("footer", 0.4 if tag == "footer" else 1))
        elif kind == "talk":
            one = lambda: self.block(r.choice(["div", "li", "article"]), 0, lambda: [self.paragraph(0, r.randint(3, 60)) for _ in range(r.randint(1, 2))], self.named("one"))
            self.block(r.choice(["div", "section", "section", "ol"]), 0, lambda: (self.block("h3", 0, self.words(1)), [one() for _ in range(r.randint(1, 5))]), self.named("talk"))

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        tag, attrs = r.choice([("article", self.plain()), ("article", self.named("main")), ("main", self.plain()), ("div", self.named("main")), ("div", self.named("main")), ("section", self.named("main")), ("td", self.plain())])

        def centre() -> None:
            for kind in ("notice", "ad", "side"):
                if r.random() < 0.3:
                    self.junk(kind)
            if tag == "td":  # a page laid out as a table
                self.block("table", 0, lambda: self.block("tr", 0, lambda: (self.block("td", 0, lambda: self.junk("nav")), self.block("td", 1, self.article, attrs), self.block("td", 0, lambda: self.junk("side")) if r.random() < 0.5 else None)))
            else:
                self.block(tag, 1, self.article, attrs)
            for kind in ("share", "talk", "side", "form", "ad"):
                if r.random() < 0.35:
                    self.junk(kind)

        def nested(depth: int) -> None:
            centre() if depth == 0 else self.block(r.choice(["div", "div", "section", "main"]), 0, lambda: nested(depth - 1), self.plain())

        def body() -> None:
            for kind in ("notice", "header", "nav", "form", "ad"):
                if r.random() < 0.6:
                    self.junk(kind)
            nested(r.choice([0, 0, 0, 1, 1, 2, 3]))
            for kind in ("talk", "side", "nav", "footer"):
                if r.random() < 0.6:
                    self.junk(kind)

        self.labels.append(0)  # the root
        self.out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>x</title><script>var a="</p>";</script></head>')
        self.block("body", 0, body, self.plain())
        self.out.append("</html>")
        return "".join(self.out), self.labels


#: Other languages' names of a page's parts.
FOREIGN = {
    "main": "inhalt hauptinhalt contenu contenido conteudo contenuto artikel",
    "nav": "navigation hauptmenue menu-principal navegacion navigazione",
    "header": "kopfzeile kopf entete cabecera cabecalho testata",
    "footer": "fusszeile fuss pied-de-page pie rodape piede",
    "side": "seitenleiste colonne lateral barra-lateral",
    "ad": "anzeige werbung publicite publicidad anuncio pubblicita",
    "notice": "hinweis avis aviso avviso",
    "form": "suche recherche buscar cerca",
    "talk": "kommentare commentaires comentarios commenti",
    "one": "kommentar commentaire comentario",
    "share": "teilen partager compartir condividi",
}
FOREIGN = {k: v.split() for k, v in FOREIGN.items()}


class _BareWriter(_Writer):
    """Pages that say little of their parts: the article stands in the body itself or
    in an element without a name, others have no names, invented or foreign ones."""

    def __init__(self, seed: int):
        super().__init__(seed)
        self.speaks = self.r.choice(["nothing", "nothing", "invented", "foreign"])
        self.invented: dict[str, str] = {}

    def plain(self) -> str:
        return "" if self.r.random() < 0.7 else super().plain()

    def named(self, kind: str, share: float = 1.0) -> str:
        r = self.r
        if self.speaks == "nothing":
            return ""
        if self.speaks == "foreign" and kind in FOREIGN:
            return f'{r.choice(["class", "id"])}="{r.choice(FOREIGN[kind])}"'
        word = self.invented.setdefault(kind, "".join(r.choice(SYLLABLES) for _ in range(3)))
        return f'class="{word}"'

    def junk(self, kind: str) -> None:
        if self.speaks != "foreign" and kind in ("ad", "notice", "talk", "side"):
            # without a name only its form tells a part from the article
            kind = self.r.choice(["share", "form", "nav"])
        super().junk(kind)

    def lines(self) -> None:
        """An article as running text with line breaks, in its container itself."""
        self.out.append("<br><br>".join(self.words(self.r.choice([12, 30, 60, 90])) for _ in range(self.r.randint(2, 9))))

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        where = r.choice(["body", "body", "div", "div", "wrapped", "td"])
        inside = self.lines if r.random() < 0.2 else lambda: [self.paragraph(1, r.choice([12, 30, 60])) for _ in range(r.randint(3, 10))] if r.random() < 0.4 else self.article()
        above = [k for k in ("header", "nav", "form") if r.random() < 0.5]
        below = [k for k in ("nav", "form", "footer") if r.random() < 0.5]
        junk = lambda kinds: [self.junk(k) for k in kinds]

        def body() -> None:
            if where == "body":
                junk(above)
                inside()
                junk(below)
                return
            junk(above)
            if where == "wrapped":
                self.block("div", 0, lambda: (self.block("div", 0, lambda: self.links(r.randint(2, 6))), self.block("div", 1, inside, self.plain())))
            elif where == "td":
                self.block("table", 0, lambda: self.block("tr", 0, lambda: (self.block("td", 0, lambda: self.links(r.randint(2, 6))), self.block("td", 1, inside))))
            else:
                self.block("div", 1, inside, self.named("main"))
            junk(below)

        self.labels.append(0)
        self.out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>x</title></head>')
        self.block("body", int(where == "body"), body, self.plain())
        self.out.append("</html>")
        return "".join(self.out), self.labels


def training_rows(pages: int = TRAINING_PAGES) -> tuple[np.ndarray, np.ndarray, TokenOdds]:
    """Features and labels of the nodes of generated pages, half of them bare, and the odds of their tokens."""
    parsed = []
    for writer in (w for seed in range(pages) for w in (_Writer(seed), _BareWriter(seed))):
        page, labels = writer.page()
        nodes = parse(page)
        if len(nodes) == len(labels):
            parsed.append((nodes, len(page), labels))
    token_odds = TokenOdds.learn([(nodes, labels) for nodes, _, labels in parsed], MIN_PAGES)
    return np.concatenate([features(nodes, size, token_odds) for nodes, size, _ in parsed]), np.array([x for _, _, labels in parsed for x in labels], float), token_odds


class Trees:
    """Fitted trees as arrays; ``odds`` gives log-odds for rows of features."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], weights: list[float], token_odds: TokenOdds):
        size = max(map(len, trees))
        flat = np.zeros((len(trees), size, 5))
        for i, tree in enumerate(trees):
            flat[i, : len(tree)] = tree
        self.feature, self.left, self.right = (flat[:, :, k].astype(np.int64) for k in (0, 2, 3))
        self.threshold, self.value = flat[:, :, 1], flat[:, :, 4]
        self.weights, self.token_odds = np.array(weights), token_odds

    def odds(self, x: np.ndarray) -> np.ndarray:
        row, tree = np.arange(len(x))[:, None], np.arange(len(self.weights))[None, :]
        at = np.zeros((len(x), len(self.weights)), np.int64)
        for _ in range(TREE_DEPTH):
            down = x[row, self.feature[tree, at]] <= self.threshold[tree, at]
            at = np.where(down, self.left[tree, at], self.right[tree, at])
        return 2.0 * (self.value[tree, at] @ self.weights)


_fitted: dict[tuple, Trees] = {}


def fit_trees(spark: SparkSession, pages: int = TRAINING_PAGES, n_trees: int = N_TREES) -> Trees:
    """Boosted trees from ``pages`` generated pages of each kind; the same for the same parameters."""
    if (pages, n_trees) not in _fitted:
        x, y, token_odds = training_rows(pages)
        rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x array<double>, label double").coalesce(1)
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=n_trees, maxDepth=TREE_DEPTH, stepSize=0.3, seed=7).fit(rows.select(array_to_vector("x").alias("features"), "label"))

        def flat(root) -> list[tuple[int, float, int, int, float]]:
            out: list = []

            def add(node) -> int:
                k = len(out)
                out.append(None)
                if node.subtreeDepth() == 0:
                    out[k] = (0, 0.0, k, k, node.prediction())
                else:
                    split = node.split()
                    left, right = add(node.leftChild()), add(node.rightChild())
                    out[k] = (split.featureIndex(), split.threshold(), left, right, node.prediction())
                return k

            add(root)
            return out

        _fitted[pages, n_trees] = Trees([flat(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), token_odds)
    return _fitted[pages, n_trees]


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """Ids of the nodes inside the article, by the best consistent labelling."""
    gain = dict(zip(map(id, nodes), np.clip(odds, -ODDS_LIMIT, ODDS_LIMIT).tolist(), strict=True))
    inside: dict[int, float] = {}
    outside: dict[int, float] = {}
    for n in reversed(nodes):
        kids = [id(p) for p in n.parts if isinstance(p, Node)]
        inside[id(n)] = gain[id(n)] + sum(max(inside[k], -CUT_COST) for k in kids)
        outside[id(n)] = sum(max(outside[k], inside[k] - ENTER_COST) for k in kids)
    chosen: set[int] = set()
    state = {id(nodes[0]): inside[id(nodes[0])] - ENTER_COST > outside[id(nodes[0])]}
    for n in nodes:
        if id(n) not in state:  # below something cut out
            continue
        if state[id(n)]:
            chosen.add(id(n))
        for kid in (p for p in n.parts if isinstance(p, Node)):
            k = id(kid)
            if state[id(n)]:
                if inside[k] > -CUT_COST:
                    state[k] = True
            else:
                state[k] = inside[k] - ENTER_COST > outside[k]
    return chosen


def has_prose(nodes: list[Node]) -> bool:
    """Whether long running texts stand in a page: over ``PROSE_CHARS`` in elements with
    sentences of their own that aren't mostly links (after ``features`` summed them up)."""
    total = 0
    for n in nodes:
        kids = [p for p in n.parts if isinstance(p, Node)]
        own, links, stops = (getattr(n, f) - sum(getattr(k, f) for k in kids) for f in ("chars", "link_chars", "stops"))
        if own >= PROSE_CHARS // 4 and stops and 3 * links < own:
            total += own
    return total >= PROSE_CHARS


def labelled(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """``decode``, with higher odds all over as long as a page with prose has no article."""
    chosen = decode(nodes, odds)
    if not chosen and has_prose(nodes):
        for more in MORE_ODDS:
            chosen = decode(nodes, odds + more)
            if chosen and block_text(nodes[0], chosen):
                break
    return chosen


def block_text(root: Node, chosen: set[int]) -> str:
    """The chosen nodes' text, a line for each block."""
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        if line:
            lines.append(line)
        run.clear()

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, tuple):
            run.append(item[0])
        else:
            flush()
            stack.append(None)
            inside = id(item) in chosen
            for part in reversed(item.parts):
                if isinstance(part, Node):
                    stack.append(part)
                elif inside:
                    stack.append((part,))
    return "\n".join(lines)


def main_texts(pages: list, trees: Trees) -> list[str]:
    parsed = [parse(p) if isinstance(p, str) and p else None for p in pages]
    rows = [features(n, len(p), trees.token_odds) for n, p in zip(parsed, pages, strict=True) if n]
    if not rows:
        return ["" for _ in pages]
    odds = trees.odds(np.concatenate(rows))
    out, at = [], 0
    for nodes in parsed:
        if nodes is None:
            out.append("")
            continue
        out.append(block_text(nodes[0], labelled(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract_main_text(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, text and n_chars (code points) of every page."""
    spark = pages.sparkSession
    kept = kept_columns(pages, keep, ["text", "n_chars"])
    trees = fit_trees(spark)
    small_batches(spark, 500)

    def extract(htmls: list) -> tuple:
        texts: list[str] = []
        held: list = []
        chars = 0
        for i, page in enumerate(htmls):  # a slice of the batch at a time, by its size
            held.append(page)
            chars += len(page or "")
            if len(held) == 50 or chars >= SLICE_CHARS or i == len(htmls) - 1:
                texts += main_texts(held, trees)
                held, chars = [], 0
        return None, [texts, [len(t) for t in texts]]

    return map_texts(pages, kept, html_column, {"text": "string", "n_chars": "long"}, lambda: extract)
