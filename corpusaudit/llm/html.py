"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks (runs of text between block-level tags). Features are the tags and
class or id words of the ancestors and properties of the text; a two-state chain (main text or not)
is trained by maximum likelihood on labelled pages and decoded by Viterbi.

Labelled pages come from a bounded sample of the page table (``SAMPLE`` pages by hash of the id):
what stands in ``article`` or ``main``, outside menus and the like, is main text. Each is also laid
out anew several times by rule, with other containers, sidebars, notices, forms, adverts and reader
comments around and inside the text, so that pages without such tags are read as well.

Null and empty pages, and pages without main text, give an empty text. Every row of the table gives
one, repeated rows and pages of any length too; time follows the length of a page, also where tags, quotes or
elements are left open. Columns beside (page_id, url, html) are not read.
"""

from __future__ import annotations

import html as entities
import json
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 150
LAYOUTS = 6
SEED = 11
ROUNDS = 150
STRETCH = 120  # blocks that the field is trained on in a row
PARTS = 4  # stretches of a sampled page
CHARS = 400  # characters of a block that is laid out anew

OPENING = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
SPECIAL = re.compile(r"[>\"']")
SVG_BORDER = re.compile(r"<svg\b|</svg\s*>", re.I)
RAW = frozenset("script style textarea title".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
NEAREST = 40  # innermost ancestors whose features a block has, and that an element to be ended is looked for in
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span "
    "strike strong sub sup time tt u var wbr br img input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag closes an open one of its kind that is not further up than its list or table.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
}
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 ul ol dl dt dd pre blockquote b label".split())  # they hold a part of what their holder is about
MAIN = frozenset(("article", "main"))
# Left out from their opening to their closing tag; without one, only the tag is.
DROPPED = frozenset("noscript template iframe svg select button object".split())
NESTED = frozenset("template svg object".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())


@dataclass
class Block:
    tag: str
    path: tuple[str, ...]  # features of the ancestors, and with @ of the one that holds the block
    text: str = ""
    linked: int = 0
    main: bool = False
    tags: tuple[str, ...] = field(default=())
    inner: tuple[str, ...] = field(default=())  # features of the ancestors inside the main element


class Piece(NamedTuple):
    """A part of a page: text, a tag, an element that is left out whole (svg, raw), or markup to skip."""

    text: str | None = None
    tag: str = ""
    end: bool = False
    attrs: str = ""
    raw: str = ""
    svg: bool = False


def pieces_of(page: str) -> list[Piece]:
    """The parts of a page in order, in time that follows its length: a search that has failed once
    is not repeated from a later place, and quotes inside tags are walked through once."""
    out: list[Piece] = []
    ends: dict[int, int] = {}  # where a tag ends, by the places of the > and quotes met on the way
    closed = len(page) if ">" in page else 0  # no > from here on
    at, n = 0, len(page)

    def tag_end(start: int) -> int:
        """The end of the tag whose attributes begin at ``start``, or -1."""
        met, found = [], -1
        while True:
            m = SPECIAL.search(page, start)
            if not m:
                break
            place = m.start()
            if place in ends:
                found = ends[place]
                break
            met.append(place)
            if m.group() == ">":
                found = place
                break
            start = page.find(m.group(), place + 1) + 1
            if not start:
                break
        for place in met:
            ends[place] = found
        return found

    def after(start: int) -> int:
        """The next > from ``start``, or -1."""
        nonlocal closed
        if start >= closed:
            return -1
        found = page.find(">", start)
        if found < 0:
            closed = start
        return found

    while at < n:
        begin = page.find("<", at)
        if begin != at:
            begin = n if begin < 0 else begin
            out.append(Piece(page[at:begin]))
            at = begin
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            out.append(Piece())
            at = n if stop < 0 else stop + 3
            continue
        m = OPENING.match(page, at)
        name = m.group(2).lower() if m else ""
        gt = after(at) if m or page[at + 1 : at + 2] in ("!", "?") else -1
        if gt < 0:
            out.append(Piece("<"))
            at += 1
            continue
        if not m:
            out.append(Piece())
            at = gt + 1
            continue
        opens = not m.group(1) and page[m.end()] in " \t\n\r\f\v/>"
        if opens and name == "svg" and page[gt - 1] != "/" and page[m.end()] != "/":
            border = SVG_BORDER.search(page, gt + 1)
            if border and border.group().startswith("</"):
                out.append(Piece(svg=True))
                at = border.end()
                continue
        if opens and name in RAW:
            border = RAW_ENDS[name].search(page, gt + 1)
            out.append(Piece(raw=name))
            at = border.end() if border else n
            continue
        stop = tag_end(m.end())
        if stop < 0:
            out.append(Piece("<"))
            at += 1
            continue
        out.append(Piece(tag=name, end=bool(m.group(1)), attrs=page[m.end() : stop]))
        at = stop + 1
    return out


def _closings(pieces: list[Piece]) -> dict[int, int]:
    """Where ``DROPPED`` elements open, the piece that closes them. One that is still open when an
    element around it ends, or at another of its kind that it cannot hold, has none."""
    opened: list[tuple[str, int]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a kind
    gone: set[int] = set()
    out: dict[int, int] = {}
    for i, m in enumerate(pieces):
        tag = m.tag
        if not tag or tag in INLINE or tag in VOID:
            continue
        if not m.end:
            if tag not in DROPPED or tag in NESTED:
                if tag in DROPPED and m.attrs.endswith("/"):
                    continue
            elif places[tag]:
                gone.add(places[tag].pop())
            places[tag].append(len(opened))
            opened.append((tag, i))
        elif places[tag]:
            while True:
                place = len(opened) - 1
                last, at = opened.pop()
                if place in gone:
                    gone.discard(place)
                    continue
                places[last].pop()
                if last == tag:
                    break
            if tag in DROPPED:
                out[at] = i
    return out


def blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page in order, their white space normalised."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    count: defaultdict[str, int] = defaultdict(int)  # open elements of a kind
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link = 0, 0
    known: tuple[tuple[str, ...], ...] | None = None  # of the stack as it is

    def flush() -> None:
        nonlocal linked, in_link, known
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not count["head"]:
                if known is None:
                    near = stack[-NEAREST:]
                    tags = tuple(t for t, _ in near)
                    below = max((i for i, t in enumerate(tags) if t in MAIN), default=len(tags))
                    holder = next((fs for t, fs in reversed(near) if t not in LEAVES), ("<>",))
                    path = dict.fromkeys([*(f for _, fs in near for f in fs), *("@" + f for f in holder)])
                    known = tuple(path), tags, tuple(f for _, fs in near[below + 1 :] for f in fs)
                out.append(Block(known[1][-1] if stack else "", known[0], text, linked, tags=known[1], inner=known[2]))
            parts.clear()
        linked = in_link = 0

    def cut(depth: int) -> None:
        nonlocal known
        known = None
        while len(stack) > depth:
            count[stack.pop()[0]] -= 1

    pieces = pieces_of(page)
    closings = _closings(pieces) if any(m.tag in DROPPED for m in pieces) else {}
    until = -1
    for at, m in enumerate(pieces):
        if at <= until:
            continue
        text, tag = m.text, m.tag
        if stack and stack[-1][0] == "head":  # ended by what cannot stand in it, also without </head>
            other = "svg" if m.svg else m.raw or ("" if m.end else tag)
            if other and other not in IN_HEAD or text and text.strip():
                cut(len(stack) - 1)
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        if not tag:
            if m.svg or m.raw in ("textarea", "title"):
                parts.append(" ")
            continue
        if tag in DROPPED:
            until = closings.get(at, at)
            if tag not in ("noscript", "template"):
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m.end else 1
            elif tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        flush()
        if m.end:
            if count[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                cut(depth)
            continue
        if tag in P_ENDS and stack and stack[-1][0] == "p":
            cut(len(stack) - 1)
        closes, bounds = CLOSES.get(tag, ("", ()))
        if closes and any(count[c] for c in closes.split()):
            for i in range(len(stack) - 1, max(-1, len(stack) - 1 - NEAREST), -1):
                if stack[i][0] in closes.split():
                    cut(i)
                    break
                if stack[i][0] in bounds:
                    break
        if tag in VOID:
            continue
        names = [f"<{tag}>"]
        if m.attrs:
            for found in NAMES.findall(m.attrs):
                names.extend("." + w for w in WORDS.findall("".join(found).lower())[:NEAREST])
        stack.append((tag, tuple(names)))
        count[tag] += 1
        known = None
    flush()
    return out


def features(block: Block, at: int, n: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    size = "0" if words < 3 else "1" if words < 8 else "2" if words < 20 else "3" if words < 60 else "4"
    link = block.linked / max(1, len(text))
    ends = text[-1] in ".!?\"'…:;”»)"
    marked = any(c in text for c in "©|›»") or "»" in text
    own = ["^" + block.tag, "w" + size, "l" + ("0" if link < 0.05 else "1" if link < 0.5 else "2"), "w" + size + ("e" if ends else "n")]
    if marked:
        own.append("marked")
    if at == 0:
        own.append("first")
    if at == n - 1:
        own.append("last")
    return [*block.path, *own]


@dataclass(frozen=True)
class Field:
    """weights of a feature for main text against the rest; change[i][j] for a step from i to j."""

    weights: dict[str, float]
    change: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, found: list[Block]) -> list[bool]:
        """The most probable states, by Viterbi; ties go to the rest."""
        (c00, c01), (c10, c11) = self.change
        a = b = 0.0
        back: list[tuple[bool, bool]] = []
        get = self.weights.get
        for i, block in enumerate(found):
            e = sum(get(f, 0.0) for f in features(block, i, len(found)))
            if i == 0:
                a, b = 0.0, e
                continue
            to_a, to_b = b + c10 > a + c00, b + c11 > a + c01
            back.append((to_a, to_b))
            a, b = max(a + c00, b + c10), max(a + c01, b + c11) + e
        state, out = b > a, []
        for to_a, to_b in reversed(back):
            out.append(state)
            state = to_b if state else to_a
        return [*([state] if found else []), *reversed(out)]

    def extract(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, main in zip(found, self.decode(found)) if main)


def example(page: list[Block]) -> list[tuple[list[str], bool]]:
    """What the field is trained on: the features of each block, and whether it is main text."""
    return [(features(b, i, len(page)), b.main) for i, b in enumerate(page)]


def train(pages: list[list[tuple[list[str], bool]]], rounds: int = ROUNDS, ridge: float = 0.02) -> Field:
    """Maximum likelihood by gradient steps of adaptive size, over all examples at once. Longer
    ones are cut into stretches of ``STRETCH`` blocks."""
    pages = [p[i : i + STRETCH] for p in pages for i in range(0, len(p), STRETCH)]
    if not pages:
        return Field({}, ((0.0, 0.0), (0.0, 0.0)))
    n, t = len(pages), max(map(len, pages))
    index: dict[str, int] = {}
    rows, columns = [], []
    y, real = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, page in enumerate(pages):
        for j, (found, main) in enumerate(page):
            y[i, j], real[i, j] = main, True
            for f in found:
                rows.append(i * t + j)
                columns.append(index.setdefault(f, len(index)))
    rows, columns = np.array(rows), np.array(columns)
    w = np.zeros(len(index) + 4)
    seen = np.full(len(w), 1e-6)
    both = real[:, 1:]
    true_pairs = np.array([[(both & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    for _ in range(rounds):
        emission = np.zeros((n, t, 2))
        emission[:, :, 1] = np.bincount(rows, w[columns], n * t).reshape(n, t)
        change = w[-4:].reshape(2, 2)
        ahead = np.zeros((n, t, 2))
        ahead[:, 0] = emission[:, 0]
        for j in range(1, t):
            step = np.logaddexp(ahead[:, j - 1, 0, None] + change[0], ahead[:, j - 1, 1, None] + change[1]) + emission[:, j]
            ahead[:, j] = np.where(real[:, j, None], step, ahead[:, j - 1])
        behind = np.zeros((n, t, 2))
        for j in range(t - 2, -1, -1):
            nxt = behind[:, j + 1] + emission[:, j + 1]
            step = np.logaddexp(change[:, 0] + nxt[:, 0, None], change[:, 1] + nxt[:, 1, None])
            behind[:, j] = np.where(real[:, j + 1, None], step, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p_main = np.exp(np.clip(ahead[:, :, 1] + behind[:, :, 1] - total[:, None], -50, 0))
        gradient = np.empty_like(w)
        gradient[:-4] = np.bincount(columns, (np.where(real, y - p_main, 0.0)).ravel()[rows], len(index))
        for i in (0, 1):
            for j in (0, 1):
                p = np.exp(np.clip(ahead[:, :-1, i] + change[i, j] + emission[:, 1:, j] + behind[:, 1:, j] - total[:, None], -50, 0))
                gradient[len(index) + 2 * i + j] = true_pairs[i, j] - (p * both).sum()
        gradient = gradient / n - ridge * w / 10
        seen += gradient**2
        w += 0.3 * gradient / np.sqrt(seen)
    change = w[-4:].reshape(2, 2).tolist()
    return Field({f: float(w[i]) for f, i in index.items()}, (tuple(change[0]), tuple(change[1])))


def labelled(page: str) -> list[Block]:
    """Blocks labelled by the page's own tags: inside ``article`` or ``main``, but not in a menu or the like there,
    nor in an element named as an advert or as readers' comments."""
    out = blocks(page)
    for b in out:
        b.main = bool(MAIN.intersection(b.tags)) and not ASIDE.intersection(b.tags) and not NOT_MAIN.intersection(b.inner)
    return out


CONTAINERS = (
    "article", "main", "div content", "div post", "div entry-content", "div article-body", "section story", "div main-content",
    "div post-content", "td content", "div text", "div", "section", "div page-body", "div article",
)
ASIDES = (
    ("nav", "links"), ("div menu", "links"), ("ul navigation", "links"), ("div breadcrumb", "links"), ("header", "short"), ("div header", "short"),
    ("header site-header", "short"), ("div masthead", "short"), ("aside", "links"), ("aside", "prose"), ("aside sidebar", "prose"), ("div sidebar", "links"),
    ("div sidebar", "prose"), ("div widget", "prose"), ("div ad", "prose"), ("div ads", "short"), ("div advert", "prose"), ("div banner", "short"),
    ("div sponsored", "prose"), ("div promo", "prose"), ("div cookie-notice", "prose"), ("div notice", "prose"), ("div cookie-banner", "prose"),
    ("div consent", "prose"), ("div alert", "short"), ("div popup", "prose"), ("form", "form"), ("form newsletter", "form"), ("div search", "form"),
    ("div subscribe", "form"), ("div login", "form"), ("div share", "links"), ("div social", "links"), ("div related", "links"), ("section related", "prose"),
    ("div tags", "links"), ("div pagination", "links"), ("div newsletter", "short"), ("aside", "prose"), ("div advertisement", "prose"),
    ("figure ad", "short"), ("section advertisement", "prose"),
)
ENDINGS = (
    ("footer", "short"), ("div footer", "links"), ("footer site-footer", "prose"), ("div copyright", "short"), ("section comments", "comments"), ("div comments", "comments"),
    ("div comment-list", "comments"), ("ol commentlist", "comments"), ("div disqus", "comments"), ("div replies", "comments"), ("div responses", "comments"),
    ("div user-remarks", "comments"), ("div reader-comments", "comments"), ("section discussion", "comments"),
)
# Names inside the main element of a labelled page that say it is not the page's own text.
NOT_MAIN = frozenset(
    ".ad .ads .advert .advertisement .sponsored .promo .comment .comments .commentlist .disqus .replies .responses .remarks .discussion".split()
)


def _element(name: str, inner: str) -> str:
    tag, _, names = name.partition(" ")
    named = f' {random_kind(names)}="{names}"' if names else ""
    wrap = {"td": ("<table><tr>", "</tr></table>"), "tr": ("<table>", "</table>")}.get(tag, ("", ""))
    return f"{wrap[0]}<{tag}{named}>{inner}</{tag}>{wrap[1]}"


def random_kind(names: str) -> str:
    return "id" if len(names) % 5 == 0 else "class"


def layouts(text: list[tuple[str, str]], prose: list[str], rng: random.Random, n: int) -> Iterator[list[Block]]:
    """Main text (tag, text), laid out anew; the labels are known from the layout."""

    def invented() -> str:
        return "".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(4, 9)))

    def sentence() -> str:
        return entities.escape(rng.choice(prose))

    def words(k: int) -> str:
        return entities.escape(" ".join(rng.choice(prose).split()[:k]))

    def boilerplate(kind: str) -> str:
        if kind == "links":
            items = "".join(f'<li><a href="/x">{words(rng.randint(1, 4))}</a></li>' for _ in range(rng.randint(2, 8)))
            return f"<ul>{items}</ul>"
        if kind == "form":
            return f"<label>{words(2)}</label> <input name=q> <p>{words(rng.randint(2, 12))}</p>"
        if kind == "short":
            return rng.choice(("", "<p>", "&copy; ", "<h2>")) + words(rng.randint(1, 7))
        if kind == "comments":
            one = rng.choice(("<div class=comment><p>{}</p></div>", "<li>{}</li>", "<p>{}</p>", '<div class="comment"><b>x</b><p>{}</p></div>', '<article class="comment"><p>{}</p></article>'))
            return rng.choice(("", "<h3>Comments</h3>")) + "".join(one.format(sentence()) for _ in range(rng.randint(1, 4)))
        return rng.choice(("{}", "<p>{}</p>", "<h3>x</h3><p>{}</p>")).format(sentence())

    for _ in range(n):
        pieces = []
        for own, words_of in text:
            tag = own if own in ("h1", "h2", "h3", "li", "blockquote", "pre") else "p"
            pieces.append(f"<{tag}>{MARK}{entities.escape(words_of)}</{tag}>")
        if rng.random() < 0.2:  # one run of text, its paragraphs parted by line breaks
            pieces = ["<br><br>".join([MARK + entities.escape(text[0][1]), *[entities.escape(t) for _, t in text[1:]]])]
        if rng.random() < 0.5:
            pieces.insert(rng.randint(1, len(pieces)), f"<{rng.choice(('h2', 'h3'))}>{MARK}{words(rng.randint(2, 6))}</h2>")
        if rng.random() < 0.3:
            pieces.insert(rng.randint(0, len(pieces)), "<ul>" + "".join(f"<li>{MARK}{words(rng.randint(3, 20))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
        if rng.random() < 0.2:
            pieces.insert(rng.randint(0, len(pieces)), f"<blockquote><p>{MARK}{sentence()}</p></blockquote>")
        for name, kind in [*rng.sample(ASIDES, rng.randint(0, 3)), *rng.sample(ENDINGS, rng.random() < 0.2)]:  # inside the text
            pieces.insert(rng.randint(0, len(pieces)), _element(name, boilerplate(kind)))
        if rng.random() < 0.3:
            pieces.insert(rng.randint(0, len(pieces)), _element("aside", boilerplate("prose")))
        container = rng.choice(CONTAINERS)
        if rng.random() < 0.25:  # a name that tells nothing
            container = f"{container.split()[0]} {invented()}-{rng.choice((invented(), 'post', 'entry', 'story', 'text'))}"
        inner = _element(container, "".join(pieces))
        if rng.random() < 0.4:
            inner = _element(rng.choice(("div wrapper", "div container", "main", "div page", "div")), inner)
        before = [_element(k, boilerplate(v)) for k, v in rng.sample(ASIDES, rng.randint(1, 4))]
        if rng.random() < 0.3:
            before.append(_element(f"div {invented()}", boilerplate("links")))
        after = [_element(k, boilerplate(v)) for k, v in [*rng.sample(ASIDES, rng.randint(0, 2)), *rng.sample(ENDINGS, rng.randint(1, 3))]]
        out = blocks("<body>" + "".join(before) + inner + "".join(after))
        for b in out:
            b.main = b.text.startswith(MARK)
            b.text = b.text.removeprefix(MARK)
        yield out


MARK = "⁣"  # an invisible separator that marks main text while a layout is built


def fit(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """Trains on at most ``sample`` pages of (page_id, html), chosen by hash of the id, and of each on at most
    ``PARTS`` stretches of ``STRETCH`` blocks, chosen at random; of a block no more than ``CHARS`` characters come into
    new layouts. So what is gathered is bounded whatever the pages are like. Where no sampled page
    labels its main text, its longer blocks stand in for it in the layouts."""
    html_text = F.coalesce(pages["html"], F.lit(""))
    rank = F.xxhash64(F.lit(SEED), pages["page_id"], html_text).alias("rank")
    rows = pages.select(rank, html_text.alias("html"))
    # ranks are sorted without the pages; equal pages of one id count once
    chosen = rows.select("rank").distinct().orderBy("rank").limit(sample)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            rank, page = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            found = labelled(page)
            own = example(found)
            starts = list(range(0, len(found), STRETCH))
            for i in sorted(random.Random(rank).sample(starts, min(PARTS, len(starts)))):
                cut = [(f, m, b.tag, b.text[:CHARS]) for (f, m), b in zip(own[i : i + STRETCH], found[i : i + STRETCH])]
                yield pa.RecordBatch.from_arrays([pa.array([rank]), pa.array([i]), pa.array([json.dumps(cut)])], names=["rank", "at", "blocks"])

    found = rows.join(F.broadcast(chosen), "rank").mapInArrow(parts, "rank long, at long, blocks string").distinct().collect()
    examples = [json.loads(blocks) for _, _, blocks in sorted(tuple(r) for r in found)]
    rng = random.Random(SEED)
    labels = any(m for e in examples for _, m, _, _ in e)

    def stands(main: bool, text: str) -> bool:
        return main if labels else text.count(" ") > 8

    prose = [t for e in examples for _, m, _, t in e if stands(m, t) and t.count(" ") > 8]
    prose = prose or [t for e in examples for *_, t in e] or ["x"]
    out = []
    for e in examples:
        if any(m for _, m, _, _ in e):
            out.append([(f, m) for f, m, _, _ in e])
        text = [(tag, t) for _, m, tag, t in e if stands(m, t)]
        if text:
            out.extend(example(page) for page in layouts(text, prose, rng, LAYOUTS))
    return train(out)


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """(page_id, url, text, n_chars), a row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(h or "") for h in batch.column(2).to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    columns = [pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
