"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with its open ancestors. A block's features
are its ancestors' tags and the words of their class, id and role, its length, its share of linked text and how it ends.
The field has two labels, main and other, one weight per feature, and transition weights; it is trained by gradient ascent
on the exact likelihood of labelled pages and decoded by Viterbi. The labelled pages are made by rule (made_page): page
layouts of many kinds, whose blocks carry the label of the part that they were made for.

Defined results: null or empty html gives an empty text, as does a page without main blocks; repeated rows repeat; text
outside of tags is a block; an unclosed comment, script, style, title or textarea is read to the end, other unclosed
elements end with the page; a quote that never closes is no quote; a `<` that no `>` follows is text; ties in decoding go
to `other`; other columns are ignored, and `extracted` refuses a name for the result that the pages have; an empty table
gives an empty result. Whole pages are read, in time and memory in proportion to their length.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

NAME, OPENED = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"""["'>]""")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Fixed values of HTML: elements whose content is no text (the first four even if they are never closed), void ones, and
#: those that begin and end blocks.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "select")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
IN_LINE_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}


class Tags:
    """The tags of a page, in one pass: places where a search found nothing to the end are not searched again."""

    def __init__(self, page: str):
        self.page, self.lost, self.doomed = page, set(), set()

    def find(self, what: str, at: int) -> int:
        """Where `what` is next, or -1."""
        found = -1 if what in self.lost else self.page.find(what, at)
        if found < 0:
            self.lost.add(what)
        return found

    def end(self, start: int, at: int) -> int:
        """Behind the `>` that closes the tag begun at `start`, or -1. It stands outside of quotes, unless no such follows."""
        opened, place = [], at
        while found := OPENED.search(self.page, place):
            place, mark = found.start(), found[0]
            if mark == ">":
                return place + 1
            if place in self.doomed:  # an earlier tag came by here and found no end
                break
            opened.append(place)
            place = max(place, self.find(mark, place + 1)) + 1
        self.doomed.update(opened)
        return self.find(">", start) + 1 or -1

    def closing(self, name: str, at: int) -> int:
        """Behind the closing tag of an element without text, or -1."""
        found = None if f"</{name}" in self.lost else CLOSING[name].search(self.page, at)
        if not found:
            self.lost.add(f"</{name}")
        return found.end() if found else -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes) of each tag, an element without text taken as one; a comment
        or declaration has no name."""
        at = 0
        while (start := self.find("<", at)) >= 0:
            at = start + 1
            if self.page.startswith("<!--", start):
                at = self.find("-->", start + 4) + 3
                at = len(self.page) if at < 3 else at
                yield start, at, "", False, ""
                continue
            if self.page[at : at + 1] in ("!", "?") and at < len(self.page):
                end = self.find(">", at) + 1
                if end:
                    yield start, end, "", False, ""
                    at = end
                continue
            closes = self.page[at : at + 1] == "/"
            if ">" in self.lost or not (named := NAME.match(self.page, at + closes)):
                continue
            end = self.end(start, named.end())
            if end < 0:
                continue
            name, attributes = named[0].lower(), self.page[named.end() : end - 1]
            at = end
            if name in CLOSING and not closes and not attributes.endswith("/"):
                behind = self.closing(name, at)
                at = behind if behind >= 0 else len(self.page) if name in RAW[:4] else at
            yield start, at, name, closes, attributes


class Node:
    """An open element: what its path has that its parent's has not, and a place for its path's score."""

    __slots__ = ("name", "parent", "fresh", "inner", "named", "score")

    def __init__(self, name: str, parent: Node | None, fresh: tuple[str, ...], named: bool):
        self.name, self.parent, self.fresh, self.score = name, parent, fresh, None
        self.inner = name if name in BLOCK else parent.inner if parent else "none"
        self.named = named or bool(parent and parent.named)

    def own(self) -> tuple[str, str]:
        return f"leaf {self.inner}", f"named {self.named}"

    def features(self) -> tuple[str, ...]:
        out, at = list(self.own()), self
        while at:
            out += at.fresh
            at = at.parent
        return tuple(out)


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """(innermost element, text, linked characters) of each leaf block with text, in page order."""
    out: list[tuple[Node, str, int]] = []
    root = Node("", None, (), False)
    stack, marks, solid, pieces = [root], [()], [0], []  # solid: places of block-level elements in the stack
    there: Counter[str] = Counter()  # open elements by name, and features on the path
    path, linked, links, at = root, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append((path, text, linked))
        pieces.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal path, linked
        if piece:
            if not pieces:
                path = stack[-1]
            pieces.append(piece)
            if links:
                linked += len(piece.strip())

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            node = stack.pop()
            there.subtract(marks.pop())
            there[f"<{node.name}"] -= 1
            links -= node.name == "a"
            if solid[-1] == len(stack):
                solid.pop()

    for start, end, name, closes, attributes in Tags(page):
        add(page[at:start])
        at = end
        if not name:
            continue
        if name in CLOSING:
            add(" ")
            continue
        if name == "br":
            add(" ")
        if name in BLOCK:
            flush()
        if closes:
            if there[f"<{name}"]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in VOID:
            continue
        ends = name if name in IN_LINE_ENDS else "p" if name in BLOCK else ""
        if ends and there[f"<{ends}"]:
            for i in reversed(solid[1:]):
                if stack[i].name == ends:
                    close(i)
                    break
                if stack[i].name in IN_LINE_ENDS.get(name, BLOCK):
                    break
        words = {w for v in NAMES.findall(attributes) for w in re.split(r"[^a-z]+", v.lower()) if w} if attributes else ()
        marks.append([*sorted(f"word {w}" for w in words), *[f"in {name}"] * (name in BLOCK)])
        stack.append(Node(name, stack[-1], tuple(m for m in marks[-1] if not there[m]), bool(words)))
        there.update(marks[-1])
        there[f"<{name}"] += 1
        links += name == "a"
        if name in BLOCK:
            solid.append(len(stack) - 1)
    add(page[at:])
    flush()
    return out


def text_features(text: str, linked: int) -> tuple[str, ...]:
    n = len(text)
    size = next((i for i, most in enumerate((15, 40, 100, 250)) if n <= most), 4)
    share = 0 if not linked else 1 if 3 * linked < n else 2 if 4 * linked < 3 * n else 3
    return (f"size {size}", f"linked {share}", f"ends {text[-1] in '.!?:;…”\"'}", f"right {'©' in text or '(c)' in text.lower()}")


# labelled pages

#: Words that pages use to name their parts.
PARTS = {
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumb", "topbar", "toc"),
    "header": ("header", "masthead", "banner", "branding", "top"),
    "footer": ("footer", "copyright", "bottom", "legal", "colophon"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "secondary", "tags", "share", "social"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "dfp"),
    "notice": ("notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"),
    "comments": ("comments", "comment", "replies", "reply", "disqus", "discussion", "respond"),
    "form": ("form", "search", "login", "signup", "contact"),
    "main": ("article", "content", "post", "entry", "main", "story", "body", "text", "page", "single"),
}
SYLLABLES = ("ka", "ro", "mi", "ten", "sol", "va", "der", "lin", "po", "gra", "es", "un", "tho", "bel", "is", "ne")


def made_page(seed: int) -> list[tuple[Node, str, int, bool]]:
    """A labelled page: (innermost element, text, linked characters, main) of its blocks, read back from generated html.

    Main text starts with a mark that the labels are taken from and that is removed."""
    draw = np.random.default_rng(seed)
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    word = lambda: "".join(pick(SYLLABLES) for _ in range(int(draw.integers(1, 5))))
    said = lambda low, high, end=".": " ".join(word() for _ in range(int(draw.integers(low, high)))).capitalize() + end
    ended = lambda: pick((".", ".", ".", "!", "?", ":", "", ""))
    link = lambda: f'<a href="/{word()}">{said(1, 4, "")}</a>'

    def part(kind: str, tags: tuple[str, ...], inside: str) -> str:
        tag = pick(tags)
        named = tag == "div" or draw.random() < 0.5
        name = "-".join([pick(PARTS[kind])] + [word()] * int(draw.random() < 0.2))
        return f'<{tag}{f""" {pick(("class", "id"))}="{name}" """ if named else ""}>{inside}</{tag}>'

    def paragraphs(n: int, low: int, high: int, mark: str = "") -> str:
        closed = draw.random() < 0.8
        return "".join(f"<p>{mark}{said(low, high, ended()) if draw.random() > 0.15 else said(1, 4, ended())}{' ' + link() + said(2, 9) if mark and draw.random() < 0.15 else ''}{'</p>' if closed else ''}" for _ in range(n))

    plain = lambda low=2, high=14: said(low, high) if draw.random() < 0.5 else paragraphs(int(draw.integers(1, 3)), low, high)
    menu = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
    before = [part("header", ("header", "div"), f"<h1>{said(1, 4, '')}</h1>" * int(draw.random() < 0.4) + plain(1, 8))] * int(draw.random() < 0.5)
    before += [part("nav", ("nav", "nav", "div"), menu(int(draw.integers(3, 9))))] * int(draw.random() < 0.85)
    before += [part("notice", ("div", "section"), plain(4, 25))] * int(draw.random() < 0.4)
    before += [part("ad", ("div", "div", "aside"), plain(3, 15))] * int(draw.random() < 0.6)
    before += [part("form", ("form",), f"<label>{said(1, 3, '')}</label><input><button>{said(1, 2, '')}</button>")] * int(draw.random() < 0.3)
    mark = "☃"
    body = f"<h1>{mark}{said(3, 12, '')}</h1>" * int(draw.random() < 0.85)
    for _ in range(int(draw.integers(1, 5))):
        body += paragraphs(int(draw.integers(1, 6)), 3, int(draw.integers(10, 120)), mark)
        body += (f"<h2>{mark}{said(1, 7, '')}</h2>") * int(draw.random() < 0.3)
        body += ("<ul>" + "".join(f"<li>{mark}{said(3, 20, ended())}</li>" for _ in range(3)) + "</ul>") * int(draw.random() < 0.15)
        body += f"<blockquote>{mark}{said(5, 40)}</blockquote>" * int(draw.random() < 0.12)
        body += part("ad", ("div", "aside"), plain(3, 15)) * int(draw.random() < 0.15)
        body += part("aside", ("aside", "div"), plain(3, 15) + menu(3)) * int(draw.random() < 0.1)
    main = part("main", ("article", "article", "main", "div", "section"), body)
    if draw.random() < 0.3:
        main = part("main", ("main", "div"), main)
    after = [part("comments", ("section", "div"), paragraphs(int(draw.integers(1, 6)), 3, 40))] * int(draw.random() < 0.5)
    after += [part("aside", ("aside", "div"), f"<h3>{said(1, 3, '')}</h3>" + plain(4, 20) + menu(int(draw.integers(2, 6))))] * int(draw.random() < 0.5)
    after += [part("footer", ("footer", "footer", "div"), ("&copy; " if draw.random() < 0.6 else "") + plain(2, 14) + menu(2) * int(draw.random() < 0.3))] * int(draw.random() < 0.9)
    if draw.random() < 0.2:
        before, after = before + after[:1], after[1:]
    page = f"<html><head><title>{said(2, 6)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
    return [(path, text.replace(mark, "").strip(), linked, mark in text) for path, text, linked in blocks(page)]


def trained(pages: int = 400, turns: int = 250, penalty: float = 0.02, seed: int = 1000) -> tuple[dict[str, float], np.ndarray]:
    """Weights of features for main against other, and transition weights [from, to] (other 0, main 1)."""
    data = [made_page(seed + i) for i in range(pages)]
    data = [[b for b in page if b[1]] for page in data]
    data = [page for page in data if page]
    names: dict[str, int] = {}
    longest = max(map(len, data))
    gold, there = np.zeros((len(data), longest), int), np.zeros((len(data), longest), bool)
    who, which = [], []
    for i, page in enumerate(data):
        for j, (path, text, linked, main) in enumerate(page):
            gold[i, j], there[i, j] = main, True
            for f in path.features() + text_features(text, linked):
                who.append(i * longest + j)
                which.append(names.setdefault(f, len(names)))
    who, which = np.array(who), np.array(which)
    weights, moves = np.zeros(len(names)), np.zeros((2, 2))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    both = there[:, 1:].astype(float)
    wanted = np.zeros((2, 2))
    np.add.at(wanted, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1)
    for turn in range(1, turns + 1):
        emit = np.zeros((len(data), longest, 2))
        emit[..., 1] = np.bincount(who, weights[which], gold.size).reshape(gold.shape)
        alpha, beta = emit[:, :1].copy(), np.zeros((len(data), longest, 2))
        forward = [alpha[:, 0]]
        for j in range(1, longest):
            step = np.logaddexp.reduce(forward[-1][:, :, None] + moves, axis=1) + emit[:, j]
            forward.append(np.where(there[:, j, None], step, forward[-1]))
        for j in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
            beta[:, j] = np.where(there[:, j + 1, None], step, beta[:, j + 1] * 0)
        forward = np.stack(forward, axis=1)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        node = np.exp(forward[..., 1] + beta[..., 1] - total[:, None]) * there
        pair = np.exp(forward[:, :-1, :, None] + moves + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        slopes = (np.bincount(which, (gold - node).ravel()[who], len(names)) - penalty * weights, wanted - pair.sum(axis=(0, 1)) - penalty * moves)
        for k, (x, slope) in enumerate(zip((weights, moves), slopes, strict=True)):  # Adam
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            x += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return dict(zip(names, map(float, weights), strict=True)), moves


class Field:
    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, [[float(x) for x in row] for row in moves]

    def path_score(self, node: Node) -> float:
        """Sum of the path's weights; each element of a page is summed once."""
        waiting = []
        while node.score is None and node.parent:
            waiting.append(node)
            node = node.parent
        score = node.score or 0.0
        for x in reversed(waiting):
            for f in x.fresh:
                score += self.weights.get(f, 0.0)
            x.score = score
        return score

    def labels(self, page_blocks: list[tuple[Node, str, int]]) -> list[bool]:
        """Viterbi; ties go to `other`."""
        get, back = self.weights.get, []
        (stay, enter), (leave, keep) = self.moves
        other = main = None
        for path, text, linked in page_blocks:
            score = self.path_score(path) + sum([get(f, 0.0) for f in (*path.own(), *text_features(text, linked))])
            if other is None:
                other, main = 0.0, score
                continue
            a, b, c, d = other + stay, main + leave, other + enter, main + keep
            back.append((b > a, d > c))
            other, main = max(a, b), max(c, d) + score
        if other is None:
            return []
        now = main > other
        out = [now]
        for to_other, to_main in reversed(back):
            now = to_main if now else to_other
            out.append(now)
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n".join(text for (_, text, _), main in zip(found, self.labels(found), strict=True) if main)


@functools.lru_cache(1)
def model() -> tuple[dict[str, float], np.ndarray]:
    return trained()


def extracted(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text; column `to` must not be one of theirs."""
    if to in pages.columns:
        raise ValueError(f"pages have a column {to!r}: give another name")
    from pyspark.sql.types import StringType, StructType

    sent = pages.sparkSession.sparkContext.broadcast(model())
    place = pages.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([field.text(p) for p in batch.column(place).to_pylist()], pa.string())], names=[*batch.schema.names, to])

    return pages.mapInArrow(run, StructType(list(pages.schema.fields)).add(to, StringType()))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(shared.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
