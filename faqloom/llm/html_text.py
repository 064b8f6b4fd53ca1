"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is parsed into its leaf blocks: runs of text between the borders of block elements.  A block's features are the
tags, class and id words of the elements around it, its own tag, and its text: length, share of linked text, ending,
signs and key words, place in the page.  A chain with two labels, article or not, is fitted by maximum likelihood on
labelled pages and decoded by Viterbi; the article's blocks are joined by line ends.

Labelled pages are a bounded sample of the given pages whose own markup says what is article (``article`` and ``main``
without what is set aside in them), and the same blocks set into other common layouts, whose labels are known by
construction, so that the chain does not hang on one kind of markup.  Where few given pages have such markup, or none,
made-up articles in these layouts take their place.  Long pages are learned from whole, in runs of blocks.

Defined cases: null and empty pages, and pages without text, give an empty text; unclosed elements end where an
enclosing or following one makes them; text outside any element is a block; null and repeated ids and urls stay rows of
their own; without pages to learn from the chain knows the made-up layouts; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that end a run of text.  Fixed by HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul caption label textarea input".split()
)
#: Elements that make a region of a page.
REGIONS = frozenset("article main aside nav header footer form dialog section table ul ol menu".split())
#: Elements whose text a browser does not show, and elements without an end tag.  Fixed by HTML.
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas audio video".split())
#: Elements that may stand in a head; any other one, and text, ends an open head.  Fixed by HTML.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that begins ends these open ones, up to the given border.  Fixed by HTML.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
KEEPS_P = BLOCKS - {"button", "option", "optgroup", "td", "th", "tr", "tbody", "label", "input", "textarea", "select", "body", "html"}
KEYWORDS = frozenset(
    "cookie cookies copyright privacy subscribe newsletter login comment comments reply replies share advertisement "
    "sponsored related menu search terms reserved contact follow datenschutz kommentar publicité commentaire publicidad "
    "comentario impressum".split()
)
TOKEN = re.compile(r"[a-z]+")
#: The sample that is learned from: pages; how often as many more are looked at when some have no labels; characters of a
#: page; blocks of all pages together.  Below ``MADE`` pages, made-up ones fill up.
ROWS, LOOKS, MOST_CHARS, MOST_LEARNED, MADE = 150, 4, 500_000, 20_000, 24
#: A page is learned from in runs of at most so many blocks, all of them.
RUN = 60
STEPS, RIDGE = 250, 1e-4


#: What the markup of a page sets apart from its article.  Fixed values.
ASIDE = frozenset(f"in:{t}" for t in "nav header footer aside form dialog menu button".split()) | frozenset(
    f"{k}:{t}" for k in ("class", "id") for t in (
        "ad ads advert advertisement banner breadcrumb comment comments cookie disqus footer header menu nav navbar "
        "newsletter notice popup promo related share sidebar social sponsored subscribe toolbar widget").split()
)
#: What markup says is the article.
ARTICLE = frozenset(("in:article", "in:main"))


class Around:
    """What the open elements say: the features that an element adds to those of the ones it is in."""

    __slots__ = ("outer", "added", "in_article", "aside", "score", "scored_by")

    def __init__(self, outer: Around | None, added: frozenset):
        self.outer, self.added, self.scored_by = outer, added, None
        self.in_article = bool(added & ARTICLE) or outer is not None and outer.in_article
        self.aside = bool(added & ASIDE) or outer is not None and outer.aside

    def features(self) -> list[str]:
        out, at = [], self
        while at is not None:
            out += at.added
            at = at.outer
        return sorted(out)


class Block:
    __slots__ = ("around", "tag", "region", "text", "linked", "label")

    def __init__(self, around, tag, region, text, linked, label):
        self.around, self.tag, self.region, self.text, self.linked, self.label = around, tag, region, text, linked, label


class Open:
    """An open element.  ``block`` and ``region`` are the nearest elements of the kind, ``block_at`` and ``hidden_at`` the
    places of the nearest block and hidden element, -1 without one; ``ended`` once its end tag came under elements that stay
    open."""

    __slots__ = ("tag", "around", "hidden_at", "link", "label", "block", "block_at", "region", "ended")


class Blocks(HTMLParser):
    """The leaf blocks of a page, in order, in time linear in the page however deep its elements lie: every open element
    knows its nearest kinds, and the places of a tag's open elements are kept by tag.  ``data-y`` marks the label of made-up
    training pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.held: set[str] = set()  # the features of all open elements
        self.outside = Around(None, frozenset())
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0

    def border(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.open[-1] if self.open else None
                if top is None:
                    self.blocks.append(Block(self.outside, "", "", text, self.linked, None))
                else:
                    self.blocks.append(Block(top.around, top.block, top.region, text, self.linked, top.label))
            self.parts, self.linked = [], 0

    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1].hidden_at >= 0

    def last(self, tags) -> int:
        """The place of the innermost open element of some tags, -1 without one."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def pop(self) -> None:
        gone = self.open.pop()
        if not gone.ended:
            self.places[gone.tag].pop()
        self.held -= gone.around.added if not self.open or gone.around is not self.open[-1].around else frozenset()

    def close_to(self, at: int) -> None:
        self.border()
        while len(self.open) > at:
            self.pop()
        while self.open and self.open[-1].ended:
            self.pop()

    def close_implied(self, tags, stops) -> None:
        at = self.last(tags)
        if at >= 0 and at > self.last(stops) and at >= self.open[-1].hidden_at:
            self.close_to(at)

    def end_head(self, always: bool = False) -> None:
        """Ends an open head; inside another hidden element only if ``always``."""
        at = self.last(("head",))
        if at >= 0 and (always or at == self.open[-1].hidden_at):
            self.close_to(at)

    def handle_starttag(self, tag, attrs):
        if self.hidden() and tag not in IN_HEAD:
            self.end_head(tag == "body")
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.border()
            if tag in KEEPS_P:
                self.close_implied(("p",), ("table", "button", "td", "th"))
            if tag in ENDS:
                self.close_implied(*ENDS[tag])
        if tag in VOID:
            return
        top, new, at = self.open[-1] if self.open else None, Open(), len(self.open)
        new.label = top.label if top else None
        found = {f"in:{tag}"} if tag in BLOCKS else set()
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label") and value:
                found.update(f"{'id' if name == 'id' else 'class'}:{t}" for t in TOKEN.findall(value.lower()))
            elif name == "data-y":
                new.label = int(value)
        found -= self.held
        outer = top.around if top else self.outside
        new.tag, new.around, new.ended = tag, Around(outer, frozenset(found)) if found else outer, False
        self.held |= found
        new.hidden_at = at if tag in HIDDEN else top.hidden_at if top else -1
        new.link = tag == "a" or top is not None and top.link
        new.block, new.block_at = (tag, at) if tag in BLOCKS else (top.block, top.block_at) if top else ("", -1)
        new.region = tag if tag in REGIONS else top.region if top else ""
        self.open.append(new)
        self.places[tag].append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.border()
        at = self.last((tag,))
        if at < 0:
            return
        if tag in BLOCKS or tag in HIDDEN:
            self.close_to(at)
        elif at > self.open[-1].block_at:
            self.places[tag].pop()
            self.open[at].ended = True
            while self.open and self.open[-1].ended:
                self.pop()

    def handle_data(self, data):
        if self.hidden() and data.strip():
            self.end_head()
        if not self.hidden():
            self.parts.append(data)
            if self.open and self.open[-1].link:
                self.linked += len(data)


def blocks_of(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.border()
    return parser.blocks


def features_of(blocks: list[Block]) -> list[list[str]]:
    """The features of every block, besides those around it."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        density = b.linked / len(b.text)
        own = [
            "any",
            f"tag:{b.tag}",
            f"words:{min(words.bit_length(), 8)}",
            f"links:{0 if not b.linked else 1 if density < 0.3 else 2 if density < 0.8 else 3}",
            f"end:{b.text[-1] if b.text[-1] in '.!?:,;…»' else '-'}",
            f"place:{5 * i // n}",
            f"near:{b.region}",
            f"near:{b.region}/{b.tag}",
        ]
        if i == 0 or i == n - 1:
            own.append("first" if i == 0 else "last")
        if words <= 40:
            own += [f"key:{t}" for t in set(b.text.lower().split()) & KEYWORDS]
        if "©" in b.text or "|" in b.text or "·" in b.text:
            own.append("sign")
        out.append(own)
    return out


def marked(blocks: list[Block]) -> list[int] | None:
    """Labels by the page's own markup; None if it has no article."""
    if not any(b.around.in_article for b in blocks):
        return None
    return [int(b.around.in_article and not b.around.aside) for b in blocks]


def layouts(article: list[Block], rest: list[str], few: int) -> list[str]:
    """The same blocks in other layouts, with ``few`` blocks in what is set aside; ``data-y`` tells the label."""
    body = "".join(f"<{b.tag or 'p'}>{escape(b.text)}</{b.tag or 'p'}>" if b.tag in ("h1", "h2", "h3", "li", "blockquote", "pre")
                   else f"<p>{escape(b.text)}</p>" for b in article)
    lines = [escape(r) for r in rest] or ["more"]
    pick = [lines[i % len(lines)] for i in range(8)]
    links = "".join(f'<li><a href="#">{x}</a></li>' for x in lines[:8])
    paras = "".join(f"<p>{x}</p>" for x in pick[:few])

    def y(inner: str, tag: str = "div", attr: str = "", label: int = 0) -> str:
        return f'<{tag} {attr} data-y="{label}">{inner}</{tag}>'

    head, foot = y(f"<h2>{pick[0]}</h2><a href='#'>{pick[1]}</a>", "header"), y(f"<p>&copy; {pick[2]}</p>", "footer")
    remarks = "".join(f'<div class="comment"><b>{pick[i]}</b><p>{pick[i + 1]}</p></div>' for i in range(few))
    form = y(f'<label>{pick[3]}</label><input name="q"><button>{pick[4]}</button>', "form")
    note = y(f"<p>{pick[5]} cookies</p><button>{pick[6]}</button>", attr='class="cookie-notice" role="dialog"')
    ad = y(f"<p>{pick[7]}</p>", attr='class="ad banner"')
    return [
        y(f"<ul>{links}</ul>", attr='id="menu"') + y(body, attr='id="content" class="post entry"', label=1)
        + y(paras, attr='class="sidebar"') + y(f"<p>&copy; {pick[0]}</p>", attr='id="footer"'),
        note + head + y(f"<ul>{links}</ul>", "nav") + y(body, "main", label=1) + y(paras, "aside") + foot,
        head + y(body + ad + form + y(remarks, "section", 'class="comments"'), "article", label=1) + foot,
        y(f"<ul>{links}</ul>", "nav") + y(body, attr='class="article-body"', label=1)
        + y(remarks, attr='id="comments"') + y(f"<ul>{links}</ul>", attr='class="related"') + foot,
        f"<table><tr><td data-y='0'>{links}</td><td data-y='1'>{body}</td></tr></table>" + form + foot,
        ad + y(y(body, "section", 'class="text"', 1) + y(paras, "aside", 'class="widget"') + y(
            f"<a href='#'>{pick[1]}</a>", attr='class="share social"'), "div") + note + foot,
    ]


MENU = (
    "Home", "News", "About us", "Contact", "Sign in", "Most read", "Subscribe to our newsletter", "All rights reserved",
    "Terms and privacy", "Next page", "Share this", "Search",
)


def made_blocks(seed: int) -> list[Block]:
    """The blocks of an article of no meaning: headings, paragraphs and a list."""
    r = random.Random(seed)
    words = "a in of and to for house river they were long after evening small first number country begin water leave".split()

    def prose(n: int) -> str:
        return " ".join(r.choice(words) for _ in range(n)).capitalize()

    parts = [f"<h1>{prose(r.randint(2, 8))}</h1>"]
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.7:
            parts.append("<p>" + " ".join(prose(r.randint(3, 25)) + "." for _ in range(r.randint(1, 6))) + "</p>")
        elif kind < 0.85:
            parts.append(f"<h2>{prose(r.randint(1, 6))}</h2>")
        else:
            parts.append("<ul>" + "".join(f"<li>{prose(r.randint(2, 12))}.</li>" for _ in range(r.randint(2, 5))) + "</ul>")
    return blocks_of("".join(parts))


def laid_out(article: list[Block], rest: list[str], i: int) -> tuple[list[Block], list[int]]:
    """The i-th layout of an article's blocks and the others, with its labels."""
    kinds = layouts(article, rest, 1 + i // 6 % 3)
    made = blocks_of("<body>" + kinds[i % len(kinds)] + "</body>")
    return made, [int(b.label or 0) for b in made]


def training_pages(pages: list[str]) -> list[tuple[list[Block], list[int]]]:
    """Pages with labels, each also in another layout; made-up ones where they are few."""
    out, size, used = [], 0, 0
    for html in pages:
        blocks = blocks_of(html)
        labels = marked(blocks)
        if not labels or not any(labels) or len(blocks) > MOST_LEARNED // 4 or size > MOST_LEARNED:
            continue
        article = [b for b, y in zip(blocks, labels) if y]
        out += [(blocks, labels), laid_out(article, [b.text for b, y in zip(blocks, labels) if not y], used)]
        size, used = size + len(out[-1][0]) + len(blocks), used + 1
    return out + [laid_out(made_blocks(i), list(MENU[i % 5 :]), i) for i in range(used, MADE)]


class Chain:
    """Weights by feature for the label 1 against 0, and scores of label pairs (before, after)."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def around(self, at: Around) -> float:
        """The weights of all that is around, remembered by element."""
        new = []
        while at is not None and at.scored_by is not self:
            new.append(at)
            at = at.outer
        total = at.score if at is not None else 0.0
        for a in reversed(new):
            total += sum([self.weights.get(f, 0.0) for f in sorted(a.added)])
            a.score, a.scored_by = total, self
        return total

    def scores(self, blocks: list[Block]) -> list[float]:
        get = self.weights.get
        return [self.around(b.around) + sum([get(f, 0.0) for f in own]) for b, own in zip(blocks, features_of(blocks))]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels: Viterbi."""
        (m00, m01), (m10, m11) = self.moves
        back, s0, s1 = [], 0.0, 0.0
        for i, x in enumerate(self.scores(blocks)):
            if i:
                from0, from1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
                back.append((from0, from1))
                s0, s1 = (s1 + m10 if from0 else s0 + m00), (s1 + m11 if from1 else s0 + m01)
            s1 += x
        y = int(s1 > s0)
        labels = [y] * min(1, len(blocks))
        for step in reversed(back):
            y = int(step[y])
            labels.append(y)
        return labels[::-1]


def fit_chain(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, ridge: float = RIDGE) -> Chain:
    """Maximum likelihood by forward-backward over the runs of all pages at once."""
    runs = []
    for blocks, labels in pages:
        own = features_of(blocks)
        for at in range(0, len(blocks), RUN):
            part = slice(at, at + RUN)
            runs.append((blocks[part], own[part], labels[part]))
    index: dict[str, int] = {}
    rows, cols, n, width = [], [], len(runs), max(len(b) for b, _, _ in runs)
    gold, there = np.zeros((n, width)), np.zeros((n, width), bool)
    for i, (blocks, owns, labels) in enumerate(runs):
        gold[i, : len(labels)], there[i, : len(labels)] = labels, True
        for j, (b, own) in enumerate(zip(blocks, owns)):
            found = [index.setdefault(f, len(index)) for f in (*b.around.features(), *own)]
            rows += [i * width + j] * len(found)
            cols += found
    rows, cols, k = np.array(rows), np.array(cols), len(index)
    pairs = there[:, 1:]
    seen = np.array([[(pairs * (1 - gold[:, :-1] if a == 0 else gold[:, :-1]) * (1 - gold[:, 1:] if b == 0 else gold[:, 1:])).sum()
                      for b in (0, 1)] for a in (0, 1)])
    w, m, v = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, steps + 1):
        unary = np.zeros((n, width, 2))
        unary[:, :, 1] = np.bincount(rows, w[cols], n * width).reshape(n, width)
        moves = w[k:].reshape(2, 2)
        ahead, behind = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        ahead[:, 0] = unary[:, 0]
        for t in range(1, width):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + unary[:, t]
            ahead[:, t] = np.where(there[:, t, None], ahead[:, t], ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (unary[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(there[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.where(there, np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]), 0)
        both = ahead[:, :-1, :, None] + moves + (unary[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(both, 0)) * pairs[:, :, None, None]).sum(axis=(0, 1))
        g = np.append(np.bincount(cols, (p - gold).ravel()[rows], k), (expected - seen).ravel()) / n + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Chain({f: float(w[i]) for f, i in index.items()}, w[k:].reshape(2, 2).tolist())


def fit(pages: DataFrame, rows: int = ROWS, html: str = "html") -> Chain:
    """The chain learned from at most ``rows`` pages with labels, those of the smallest digests.

    A page can have labels only if it holds an ``article`` or a ``main``.  Pages that hold one and yet set all of it aside
    make room for the next ones, up to ``LOOKS`` times.
    """
    sample = pages.filter((F.length(html) <= MOST_CHARS) & F.col(html).rlike(r"(?i)<(article|main)[\s>/]"))
    sample = sample.select(F.col(html).alias("html"), F.md5(html).alias("digest"))
    chosen, after = [], ""
    for _ in range(LOOKS):
        # the digests go through the order, not the pages
        next_ = sample.select("digest").filter(F.col("digest") > after).distinct().orderBy("digest").limit(rows)
        digests = [r[0] for r in next_.collect()]
        if not digests:
            break
        between = F.col("digest").between(digests[0], digests[-1])
        found = [r[0] for r in sample.filter(between).dropDuplicates(["digest"]).orderBy("digest").collect()]
        found = [h for h in found if any(marked(blocks_of(h)) or ())]
        chosen += found[: rows - len(chosen)]
        after = digests[-1]
        if len(chosen) >= rows or len(digests) < rows:
            break
    return fit_chain(training_pages(chosen))


def main_text(html: str | None, chain: Chain) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, y in zip(blocks, chain.decode(blocks)) if y)


def extract(pages: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    chain = fit(pages, rows)
    sent = pages.sparkSession.sparkContext.broadcast((chain.weights, chain.moves))

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Chain(*sent.value)
        for batch in batches:
            yield pa.array([main_text(x, own) for x in batch.to_pylist()], pa.string())

    out = pages.select("page_id", "url", text(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
