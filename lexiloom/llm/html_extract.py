"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of tokens: words, and tags. Each token has a score: words a positive one, by
whether they stand in an element of running text, elsewhere or in a link, and by the length of their
block; tags a negative one, to which the names that their attributes carry add theirs. One linear
scan finds the contiguous stretch of tokens with the greatest sum, the content region; its text, less
what elements set apart hold, is returned block by block.

Scores are log-odds fitted on labelled pages: pages whose own markup says where the article is (one
<article>, or else one <main>), at most `most_labelled` of them. For every kind of token they compare
how often it occurs inside and outside of the labelled region. Kinds are the tag's name, whether it
opens or closes, each name in its class, id and role, and the bin of a word's block. The marks that
label a page say so as tags like any other, so that pages without them are scored by the rest. Signs
are kept: words score above zero, tags below.

An element is set apart by what it is: one that HTML keeps for menus, side matter, forms or scripts,
or one whose attribute names score as foreign to articles, by the fit or, for names that the labelled
pages do not show, by a first guess. It is not if it holds half of the page's words outside of links
or more: then it is a frame around the article, whatever it is called.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import portions

#: Comments, whole elements whose content is no markup, declarations, tags, and text between them.
#: Elements whose content is no markup: everything up to their end tag.
RAW = frozenset("script style noscript template textarea svg iframe select".split())
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
QUOTED = re.compile("[\"'>]")
#: Elements that are no block of their own: text runs on through them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of running text.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption".split())
#: Elements whose content is never shown as running text.
HIDDEN = frozenset("head title script style noscript template".split())
#: Elements that HTML keeps for menus, side matter and forms; of these the first never hold an article.
NEVER = HIDDEN | frozenset("nav footer menu button".split())
APART = frozenset("nav footer aside form button menu dialog".split())
#: First guess of names of such elements: a name made of nothing but these words. What the labelled
#: pages say of a name goes before it.
MARKS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner box bar breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer list masthead menu modal nav navbar navigation newsletter "
    "notice notices notification popup posts promo promoted recommended related replies reply respond share sharing section sidebar signup site social sponsor sponsored subscribe toolbar widget".split()
)
#: Of these alone a name is no such guess.
NEUTRAL = frozenset("box bar list posts section site social share reply".split())
#: Roles that the standard gives to such elements.
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form".split())
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NAME = re.compile(r"[^\s\"']+")
#: An element whose names score this low is set apart.
FOREIGN = -2.0
#: What a tag closes when it opens inside of it, as browsers do.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Ends:
    """Where the tags of a page end: at the first '>' outside of quotes or, if there is none, at the
    first '>'. Signs are looked at one by one only up to `walk` for a tag; for those that take more, one
    pass over the page's signs from its end says it for all."""

    def __init__(self, page: str, walk: int = 64) -> None:
        self.page, self.walk = page, walk
        self.signs: list[int] | None = None
        self.ends: list[int] = []

    def of(self, at: int) -> int:
        """Place of the '>' that ends the tag whose attributes begin at `at`; -1 without any."""
        page = self.page
        first = page.find(">", at)
        if first < 0:
            return -1
        here = at
        for _ in range(self.walk):
            m = QUOTED.search(page, here)
            if m is None:
                return first
            if m.group() == ">":
                return m.start()
            here = page.find(m.group(), m.end()) + 1
            if not here:
                return first
        if self.signs is None:
            self._index()
        k = bisect_left(self.signs, here)
        found = self.ends[k] if k < len(self.signs) else -1
        return found if found >= 0 else first

    def _index(self) -> None:
        """For each quote and '>' the end of a tag that reaches it outside of quotes."""
        self.signs = [m.start() for m in QUOTED.finditer(self.page)]
        self.ends = [-1] * len(self.signs)
        following: dict[str, int] = {}  # the next sign of each kind
        for k in range(len(self.signs) - 1, -1, -1):
            sign = self.page[self.signs[k]]
            if sign == ">":
                self.ends[k] = self.signs[k]
            else:
                after = following.get(sign, len(self.signs)) + 1
                self.ends[k] = self.ends[after] if after < len(self.signs) else -1
            following[sign] = k


class Piece(NamedTuple):
    """A stretch of text (name empty), or a tag with its attributes."""

    at: int
    text: str
    name: str
    closing: bool
    attributes: str


def pieces_of(page: str) -> Iterator[Piece]:
    """The tags and the text between them, in one pass, without comments, declarations and elements
    whose content is no markup. What looks like a tag but has no end is text."""
    at, n, last = 0, len(page), page.rfind(">")
    ends = Ends(page)
    while at < n:
        start = page.find("<", at)
        start = n if start < 0 else start
        if start > at:
            yield Piece(at, page[at:start], "", False, "")
        at = start
        if at == n:
            return
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = n if close < 0 else close + 3
            continue
        m = TAG.match(page, at)
        if at < last and m is None and page[at + 1 : at + 2] in ("!", "?"):
            at = page.find(">", at) + 1
            continue
        if m is None or m.end() > last:
            after = page.find("<", at + 1)
            after = n if after < 0 else after
            yield Piece(at, page[at:after], "", False, "")
            at = after
            continue
        name, closing = m.group(2).lower(), bool(m.group(1))
        if name in RAW and not closing:
            end = RAW_END[name].search(page, page.find(">", m.end()) + 1)
            at = n if end is None else end.end()
            continue
        end = ends.of(m.end())
        yield Piece(at, "", name, closing, page[m.end() : end])
        at = end + 1


def names(attributes: str) -> list[str]:
    """Names in class, id and role: '.x' for the former two, '=x' for a role."""
    if not attributes or "=" not in attributes:
        return []
    found = []
    for kind, value in ATTRIBUTE.findall(attributes):
        found += [("=" if kind.lower() == "role" else ".") + x for x in NAME.findall(value.lower())]
    return found


def guess(name: str) -> float:
    """Score of a name that no labelled page shows."""
    if name[0] == "=":
        return -3.0 if name[1:] in ROLES else 0.0
    words = [x for x in re.split(r"[-_\d]+", name[1:]) if x]
    return -3.0 if words and MARKS.issuperset(words) and not NEUTRAL.issuperset(words) else 0.0


def foreign(attributes: str, scores: dict[str, float]) -> float:
    """Sum of the scores of an element's names, none above zero."""
    return sum(min(0.0, scores[x] if x in scores else guess(x)) for x in set(names(attributes)))


class Token(NamedTuple):
    """kind: a word bin for text, ' ' for white space, '+name' and '-name' for tags; element: the
    innermost element set apart around it (-1: none); extra: score of a tag's names."""

    kind: str
    text: str
    element: int
    extra: float


def bin_of(words: int, where: str) -> str:
    """Kind of a word in a block of so many words: 0 for one to three, one more for each doubling,
    after w (in an element of running text), d (elsewhere) or l (in a link)."""
    return where + str(min(5, max(0, words.bit_length() - 2)))


def tokens(page: str, scores: dict[str, float]) -> list[Token]:
    """All tokens of a page, what stands in elements set apart marked."""
    out: list[list] = []
    stack: list[tuple[str, int]] = []  # open elements: name, number if it is one set apart, else -1
    open_now: Counter = Counter()  # by name
    outer = [-1]  # elements set apart around the place
    never: list[bool] = []  # by number of an element set apart: whether it never holds an article
    parent: list[int] = []
    own: list[int] = []  # words directly in each, outside of links
    block: list[int] = []
    links = article = running = total = 0

    def close_block() -> None:
        words = sum(out[i][4] for i in block)
        for i in block:
            out[i][0] = bin_of(words, out[i][5])
        block.clear()

    def leave() -> str:
        nonlocal links, article, running
        name, number = stack.pop()
        open_now[name] -= 1
        if number >= 0:
            outer.pop()
        links -= name == "a"
        article -= name in ("article", "main")
        running -= name in RUNNING
        return name

    for piece in pieces_of(page):
        name = piece.name
        if not name:
            text = piece.text
            n = len(text.split())
            where = "l" if links else "w" if running else "d"
            out.append([where if n else " ", text, outer[-1], 0.0, n, where])
            if n:
                block.append(len(out) - 1)
                if not links:
                    total += n
                    if outer[-1] >= 0:
                        own[outer[-1]] += n
            continue
        if name not in INLINE:
            close_block()
        if piece.closing:
            inside = outer[-1]
            if name not in VOID and open_now[name]:
                while leave() != name:
                    pass
            out.append(["-" + name, "", inside, 0.0, 0, ""])
            continue
        attributes = piece.attributes
        closed = CLOSES.get(name)
        while closed and stack and stack[-1][0] in closed:
            leave()
        extra = foreign(attributes, scores)
        number = -1
        if name not in VOID and not attributes.endswith("/"):
            apart = name in HIDDEN or name in APART or (name == "header" and not article) or (extra <= FOREIGN and name not in ("html", "body", "article", "main"))
            if apart:
                number = len(own)
                own.append(0)
                never.append(name in NEVER)
                parent.append(outer[-1])
                outer.append(number)
            stack.append((name, number))
            open_now[name] += 1
            links += name == "a"
            article += name in ("article", "main")
            running += name in RUNNING
        out.append(["+" + name, "", outer[-1], extra, 0, ""])
    close_block()
    # Words of each element set apart, inner ones included; frames around half of them are no such.
    held = list(own)
    for k in range(len(own) - 1, -1, -1):
        if parent[k] >= 0:
            held[parent[k]] += held[k]
    shown = total - sum(own[k] for k in range(len(own)) if never[k])
    frame = [not never[k] and 2 * held[k] >= shown for k in range(len(own))]

    place = {-1: -1}  # the innermost that is no frame; outer ones come first
    for k in range(len(own)):
        place[k] = place[parent[k]] if frame[k] else k
    return [Token(kind, text, place[element], 0.0 if element >= 0 and frame[element] else extra) for kind, text, element, extra, _, _ in out]


def default_scores() -> dict[str, float]:
    """Scores without labelled pages: words of longer blocks count for more, tags of running text
    little against, others as much as some lines of text."""
    light = {f"{s}{t}": -0.1 for t in (*INLINE, *RUNNING, "ul", "ol", "dl") for s in "+-"}
    words = {f"{s}{k}": x for k, x in enumerate((0.1, 0.2, 0.2, 0.5, 0.8, 1.0)) for s, x in (("w", 1.0), ("d", x), ("l", x / 10))}
    return {**words, "apart": -0.01, "tag": -3.0, **light}


def fit(pages: list[str]) -> dict[str, float]:
    """Scores from labelled pages; see the module. Pages without exactly one mark are left aside."""
    first = default_scores()
    inside, outside = Counter(), Counter()
    for page in pages:
        some = tokens(page, {})
        for mark in ("article", "main"):
            starts = [i for i, t in enumerate(some) if t.kind == "+" + mark]
            if len(starts) == 1:
                break
        else:
            continue
        start = starts[0]
        end = next((i for i in range(len(some) - 1, start, -1) if some[i].kind == "-" + mark), len(some))
        for i, t in enumerate(some):
            side = inside if start < i < end else outside
            if t.kind[0] in "wdl":
                side[t.kind] += len(t.text.split())
            elif t.kind != " ":
                side[t.kind] += 1
        region = [m.start() for m in re.finditer(f"<{mark}[\\s>]", page, re.I)][:1] + [page.lower().rfind(f"</{mark}")]
        for tag in pieces_of(page):
            if tag.name:
                within = region[0] < tag.at < (region[1] if region[1] >= 0 else len(page))
                for x in set(names(tag.attributes)):
                    (inside if within else outside)[x] += 1
    if not any(k[0] == "w" for k in inside):
        return first
    total_in, total_out = sum(inside.values()), sum(outside.values())
    scores = dict(first)
    for kind in {*inside, *outside}:
        odds = math.log((inside[kind] + 0.5) / (total_in + 1)) - math.log((outside[kind] + 0.5) / (total_out + 1))
        if kind[0] in "wdl":  # words score above zero, and no bin far from its first guess
            scores[kind] = min(3.0, max(first[kind], odds))
        elif kind[0] in ".=":  # a name must be seen some times to say anything
            if inside[kind] + outside[kind] >= 5:
                scores[kind] = odds
        else:  # a tag that is common inside costs little, one that never is costs much
            scores[kind] = -0.1 if odds >= 0 else max(-20.0, 4 * odds)
    return scores


def region(some: list[Token], scores: dict[str, float]) -> tuple[int, int]:
    """Bounds of the stretch with the greatest sum; of equal ones the first. Empty without words."""
    best = held = 0.0
    found = (0, 0)
    start = 0
    for i, t in enumerate(some):
        if t.element >= 0:
            held += scores["apart"]
        elif t.kind[0] in "wdl":
            held += scores[t.kind] * len(t.text.split())
        elif t.kind != " ":
            held += scores.get(t.kind, scores["tag"]) + t.extra
        if held <= 0:
            held, start = 0.0, i + 1
        elif held > best:
            best, found = held, (start, i + 1)
    return found


def content(page: str, scores: dict[str, float]) -> str:
    """Text of the content region: character references decoded, white space within a block one
    space, blocks joined by newlines."""
    some = tokens(page, scores)
    a, b = region(some, scores)
    blocks: list[list[str]] = [[]]
    for t in some[a:b]:
        if t.kind[0] in "wdl ":
            if t.element < 0:
                blocks[-1].append(t.text)
        elif t.kind[1:] not in INLINE:
            blocks.append([])
        elif t.kind == "+br":
            blocks[-1].append(" ")
    lines = (" ".join(html.unescape("".join(x)).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def extract(
    df: DataFrame,
    html_col: str = "html",
    keep: tuple[str, ...] = ("page_id", "url"),
    scores: dict[str, float] | None = None,
    most_labelled: int = 300,
    most_chars: int = 20_000_000,
) -> DataFrame:
    """One row per row of `df`: the columns of `keep`, text (the main text, empty if there is none)
    and n_chars (its code points).

    Without `scores` they are fitted on at most `most_labelled` pages, of at most `most_chars` code points
    together, those with the least MD5 of their html among pages that mark their article. A null page counts as empty; broken and cut-off
    markup is read as far as it goes; repeated rows give repeated rows; an empty table gives no rows;
    other columns are ignored. Pages are read whole."""
    if scores is None:
        marked = df.filter(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(html_col).alias("html"))
        sample = marked.filter(F.length("html") <= most_chars).orderBy(F.md5("html"), "html").limit(most_labelled)
        some, held = [], 0
        for r in sample.toLocalIterator():
            held += len(r["html"])
            if held > most_chars:
                break
            some.append(r["html"])
        scores = fit(some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages = pdf["__html"].tolist()
            for part in portions(pages):
                text = [content(x, scores) if isinstance(x, str) else "" for x in pages[part]]
                yield pd.DataFrame({"__row": pdf["__row"].iloc[part].array, "__text": text, "__n": [len(x) for x in text]})

    # The kept columns travel as one value, so that they may have any name and type of plain values.
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in keep])).alias("__row"), F.col(html_col).alias("__html"))
    kind = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    made = rows.mapInPandas(run, "__row string, __text string, __n long").withColumn("__row", F.from_json("__row", kind))
    return made.select("__row.*", F.col("__text").alias("text"), F.col("__n").alias("n_chars"))
