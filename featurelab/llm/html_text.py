"""Main text of HTML pages by two-pass block rules.

Pass 1 decides blocks from their text and place: a block inside navigation, forms, comments
and the like (by tag, or by its class, id or role) is no content and has no say later; one
made of links is bad; one long enough and with enough stop words is good.  The rest, short or
without stop words, is ambiguous.  Pass 2 gives ambiguous blocks the label of their nearest
decided neighbours in the same section.  Inside an article or main element a block is bad only
if both sides are, and a paragraph without links never is; elsewhere it is good only if both
sides are, or the one side that has a decided block, a heading if the next decided block is.
Where no side has one, or the page has no good block, it is good.  Where a page has an article
or main element with text, nothing outside it counts.

A class name marks its element if it names such a thing: its last word is a hint, words for
boxes and places aside (``left-sidebar``, ``comment-list``, not ``share-price``), and no word
tells of a state (``no-sidebar``, ``comments-open``).  Article elements are marked by single
words only, main elements never.  Forms that hold an article, and on pages without any good
block the marked elements that hold most of the text (not comments, menus or footers), are
the page's frame: they are read as if they were not marked.

Stop words have a say only where they apply: not on blocks in another script than Latin, and
not on pages where most words stand in long blocks without them, such as pages in a language
that they do not know.  There a long block is good.  Unspaced scripts count two letters a word.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.session import ship_package

MIN_WORDS, MIN_STOP, MAX_LINK = 8, 0.12, 0.5
SEPARATORS = 12                      # characters beside the links that a row of links may have

# fixed values: frequent words of four languages
STOP = frozenset("""
a about all an and are as at be but by can for from had has have he her his i if in is it its not of on one or
she so that the their there they this to was we were what when which who will with would you
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einen einer er es für hat
ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir zu zum zur
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus
pour qu que qui sa se ses son sont sur un une vous
al como con de del el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero
por que se sin sobre son su sus también un una y ya
""".split())
# fixed values: elements by what they do to blocks
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol
optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object audio video canvas xmp noembed noframes".split())
DROP = frozenset("aside button dialog footer form head menu nav search select title".split())
MAIN = frozenset("article main".split())
FOREIGN = frozenset("math svg".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = frozenset("blockquote p pre".split())
ITEMS = frozenset("dd dt li option td th tr".split())
CLOSES_P = BLOCK - frozenset("body head html option optgroup".split())
# fixed values: words in a class, id or role that mark what is no content
HINTS = frozenset("""ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs
comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer
gdpr login masthead menu menubar modal nav navbar navigation navigational newsletter notice notices notification pager
pagination popup privacy promo promoted promotion recommended related replies respond responses search share sharing sidebar
signin signup skip social sponsor sponsored subscribe subscription teaser toc toolbar topbar widget widgets""".split())
# fixed values: hints that no frame of a page has
NO_FRAME = frozenset("""breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright discussion
disqus footer gdpr menu menubar nav navbar navigation navigational pager pagination replies respond responses toc""".split())
# fixed values: words in a class for boxes, places and things in lists, and words that tell of a state
BOXES = frozenset("""area articles banner bar block body bottom box btn button buttons col column container content desktop form group
header icons inline inner item items left link links list main middle mobile outer panel placeholder posts primary right row secondary
section slot stories text this title top unit wide wrap wrapper""".split())
STATES = frozenset("""closed disabled enabled free has hide hides is loaded no non not off on open opened with without""".split())
HEAD_HINTS = frozenset("header hdr pageheader siteheader".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|[^<]++|<", re.S)
_HINT = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_PART = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
LATIN_END = "\u0250"
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


class Block:
    __slots__ = ("text", "link", "tag", "dropped", "section", "label")

    def __init__(self, text, link, tag, dropped, section):
        self.text, self.link, self.tag, self.dropped, self.section, self.label = text, link, tag, dropped, section, None


_NO, _SOFT, _HARD = 0, 1, 2              # marks; a soft one may belong to the page's frame


def _hint(name: str, hints: frozenset, plain: bool) -> str | None:
    """The hint that a class name holds; with ``plain`` only if it is all of the name."""
    parts = _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    if plain:
        return parts[0] if len(parts) == 1 and parts[0] in hints else None
    if not STATES.isdisjoint(parts):
        return None
    while len(parts) > 1 and parts[-1] in BOXES and not (parts[-1] in hints and parts[-2] not in hints):
        parts.pop()
    return parts[-1] if parts and parts[-1] in hints else None


def _mark(tag: str, attrs: str, inside: bool) -> int:
    """Whether the element is no content."""
    if tag in DROP or tag == "header" and not inside:
        return _SOFT if tag == "form" else _HARD
    if not attrs.strip():
        return _NO
    if _HIDDEN.search(attrs):
        return _HARD
    if tag in ("html", "body", "main"):
        return _NO
    hints = HINTS if inside else HINTS | HEAD_HINTS
    found = [_hint(name, hints, tag == "article") for m in _HINT.finditer(attrs) for name in m[1].strip("\"'").split()]
    found = [h for h in found if h]
    return _NO if not found else _HARD if not NO_FRAME.isdisjoint(found) else _SOFT


class _Reader:
    """Blocks of one page; ``frame`` are the places of soft marks that do not count."""

    def __init__(self, html: str, frame: frozenset = frozenset()):
        self.html, self.frame = html, frame
        self.out: list[Block] = []
        # element, dropped, section (0: outside articles), place of its soft mark, text before it, article inside
        self.stack: list[list] = []
        self.open: Counter = Counter()
        self.soft: dict[int, tuple] = {}     # place of a soft mark: (tag, characters, holds an article)
        self.chars = 0
        self.parts: list[str] = []
        self.link = self.linked = self.sections = 0
        self.ends: dict[int, int] | None = None

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag, dropped, section = self.stack[-1][:3] if self.stack else ("", False, 0)
                self.out.append(Block(text, self.linked, tag, dropped, section))
                self.chars += len(text)
            self.parts = []
        self.linked = self.link = 0

    def pop(self) -> None:
        tag, _, _, soft, before, article = self.stack.pop()
        self.open[tag] -= 1
        if soft is not None:
            self.soft[soft] = tag, self.chars - before, article
        if self.stack and article:
            self.stack[-1][5] = True

    def push(self, name: str, attrs: str, pos: int) -> None:
        if name in CLOSES_P and self.stack and self.stack[-1][0] == "p":
            self.pop()
        if name in ITEMS and self.stack and self.stack[-1][0] == name:
            self.pop()
        dropped, section = self.stack[-1][1:3] if self.stack else (False, 0)
        mark, soft = _mark(name, attrs, section > 0), None
        if mark == _SOFT:
            soft = pos
            if pos in self.frame:
                mark = _NO
        article = name in MAIN and mark != _HARD
        if article and not dropped and not section:
            self.sections += 1
            section = self.sections
        self.stack.append([name, dropped or mark > _NO, section, soft, self.chars, article])
        self.open[name] += 1

    def inline_ends(self) -> dict[int, int]:
        """Where inline elements that are closed end, by where their content begins."""
        ends, starts, pos, html = {}, defaultdict(list), 0, self.html
        while pos < len(html):
            m = _TOKEN.match(html, pos)
            pos = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name or name in BLOCK or name in VOID:
                continue
            if not (m[1] or m[4]):
                starts[name].append(pos)
            elif starts[name]:
                ends[starts[name].pop()] = pos
        return ends

    def read(self) -> list[Block]:
        html, pos, n, unclosed = self.html, 0, len(self.html), set()
        while pos < n:
            m = _TOKEN.match(html, pos)
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                if not m[0].startswith("<") or m[0] == "<":
                    text = unescape(m[0])
                    self.parts.append(text)
                    if self.link:
                        self.linked += len(text.strip())
                continue
            name, closing = name.lower(), bool(m[1] or m[4])
            attrs = m[3] or m[6] or ""
            if name in RAW and not closing:
                if name in FOREIGN and attrs.endswith("/"):
                    continue                 # only foreign elements can close themselves
                close = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, pos)
                if close:
                    pos = close.end()
                elif attrs.endswith("/"):
                    unclosed.add(name)
                else:
                    pos = n
            elif name == "a":
                self.link = 0 if closing else 1
            elif name == "br":
                self.parts.append(" ")
            elif name not in BLOCK:
                if not closing and name not in VOID and attrs and _mark(name, attrs, bool(self.stack) and self.stack[-1][2] > 0):
                    # a marked inline element is dropped with what it holds; unclosed ones hold nothing
                    if self.ends is None:
                        self.ends = self.inline_ends()
                    pos = self.ends.get(pos, pos)
            else:
                self.end_block()
                if not closing:
                    if name != "hr":
                        self.push(name, attrs, pos)
                elif self.open[name]:
                    while self.stack[-1][0] != name:
                        self.pop()
                    self.pop()
        self.end_block()
        while self.stack:
            self.pop()
        return self.out


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order; markup that is cut off or not closed is fine.  Pages whose
    frame is marked are read twice."""
    page = _Reader(html)
    out = page.read()
    dropped = sum(len(b.text) for b in out if b.dropped)
    lost = not any(_runs_on(b) for b in out if not b.dropped) and not any(b.section and not b.dropped for b in out)
    frame = frozenset(i for i, (tag, chars, article) in page.soft.items()
                      if article and tag == "form" or lost and 2 * chars > dropped)
    return _Reader(html, frame).read() if frame else out


def _runs_on(b: Block) -> bool:
    """A block of running text, whatever its language."""
    size = max(len(_LETTERS.findall(b.text)), len(_UNSPACED.findall(b.text)) // 2)
    return size >= MIN_WORDS and b.link <= MAX_LINK * len(b.text) and b.tag not in HEADING


def _decide(b: Block) -> int:
    """Label the block; the number of its words if only its want of stop words speaks against it."""
    if b.link > MAX_LINK * len(b.text):
        # a paragraph of an article with words beside its links is no menu
        if not (b.section and b.tag in RUNNING and b.link < len(b.text) - SEPARATORS):
            b.label = False
        return 0
    words = _LETTERS.findall(b.text.lower())
    size = max(len(words), len(_UNSPACED.findall(b.text)) // 2)
    if size < MIN_WORDS or b.tag in HEADING:
        return 0
    if sum(w in STOP for w in words) >= MIN_STOP * len(words):
        b.label = True
    elif not b.section:
        letters = "".join(words)
        if 2 * sum(c < LATIN_END for c in letters) < len(letters):
            b.label = True
        else:
            return size
    return 0


def main_text(html: str | None) -> str:
    if not html:
        return ""
    live = [b for b in blocks(html) if not b.dropped]
    if any(b.section for b in live):
        live = [b for b in live if b.section]
    without = [_decide(b) for b in live]
    running = sum(len(_LETTERS.findall(b.text)) for b in live if b.label)
    strange = sum(without) > running               # stop words do not apply
    for b, size in zip(live, without):
        if size:
            b.label = strange
    good = any(b.label for b in live)
    n = len(live)
    before, after = [None] * n, [None] * n
    for i in range(1, n):
        same = live[i].section == live[i - 1].section
        before[i] = (live[i - 1].label if live[i - 1].label is not None else before[i - 1]) if same else None
    for i in range(n - 2, -1, -1):
        same = live[i].section == live[i + 1].section
        after[i] = (live[i + 1].label if live[i + 1].label is not None else after[i + 1]) if same else None
    keep = []
    for b, prev, nxt in zip(live, before, after):
        label = b.label
        if label is None:
            if b.section:
                label = not (prev is False and nxt is False) or b.tag in RUNNING and not b.link
            elif not good or prev is None and nxt is None:
                label = True
            elif b.tag in HEADING and nxt is not None:
                label = nxt
            else:
                label = prev is not False and nxt is not False
        if label:
            keep.append(b.text)
    return " ".join(keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the html replaced by its main text.

    A null or empty page gives an empty text.  A page is held whole in memory with its blocks;
    time grows with its length, closed elements or not.  All other columns stay, repeated rows too; a
    column already named ``text_col`` is replaced.  No rows give no rows.
    """
    ship_package(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    src = pages.select(*others, F.col(html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*others, text_col])

    return src.mapInArrow(run, src.drop(html_col).withColumn(text_col, F.lit("")).schema)
