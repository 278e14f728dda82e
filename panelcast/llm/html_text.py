"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags.  First pass: a block is boilerplate when it stands in
a structure that never holds article text (menus, footers, forms, adverts, comments), or when most of
its characters are links; it is text when it is long and has the share of stop words of running
text; everything else is undecided.  Second pass: an undecided block takes the label of its nearest
decided neighbours, inside the same article if it stands in one; headings look ahead.

Defined cases: null or empty html, or a page without main text, gives the empty text.  Broken markup
(open tags, open quotes, a page that ends in a tag) is read as far as it goes.  Repeated rows and null
ids are kept, other columns are ignored, whatever their names; a very long page is read whole, an empty table gives an empty result.
Between two decided neighbours at equal distance an undecided block is text inside an article only if one of them is, and
elsewhere only if both are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm.common import text_batches

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|['"][^>]*(?:>|\Z)|\Z)""", re.S)
CLASSES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: The last attribute's value is unquoted: a slash at its end belongs to it.
UNQUOTED = re.compile(r"""=\s*[^\s"'>]*\Z""")
WORD = re.compile(r"[^\W\d_]+")

# Names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg math object audio video canvas xmp noembed noframes".split())
FOREIGN = frozenset(("svg", "math"))
MEDIA = frozenset(("audio", "video", "canvas"))
NEVER_TEXT = frozenset("head title nav footer aside form button select menu dialog fieldset label option header".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Words of class, id and role attributes that mark structures beside the article.
BESIDE = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus disclaimer footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted related reply replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our out she so some "
    "than that the their them then there they this to up was we were what when which who will with would you your "
    "aber als am auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im ist ja kann mit nach nicht noch nur ob oder "
    "sein sich sie sind so um und uns vom von vor war was wenn wie wir wird zu zum zur über "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous à été "
    "al como con cuando del desde donde el ella entre era esta este esto está ha hay la las lo los más muy o para pero por porque si sin sobre su sus también te tiene un una y ya".split()
)

SHORT_WORDS = 10
STOP_SHARE = 0.15
LINK_SHARE = 0.5
TEXT, BOILERPLATE, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    links: int
    beside: bool
    article: int
    heading: bool
    label: int = OPEN


@dataclass
class Element:
    name: str
    beside: bool
    article: int


@dataclass
class Reader:
    """Blocks of a page, in order, from one walk over its tags."""

    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    in_link: int = 0
    articles: int = 0
    open: list[Element] = field(default_factory=list)

    def read(self, page: str) -> list[Block]:
        at, size = 0, len(page)
        while at < size:
            tag = TAG.search(page, at)
            if tag is None:
                self.text(page[at:])
                break
            self.text(page[at : tag.start()])
            at = max(tag.end(), tag.start() + 1)
            if tag.group(2):
                name = tag.group(2).lower()
                if tag.group(1):
                    self.close(name)
                elif name in FOREIGN and tag.group(3).endswith("/") and not UNQUOTED.search(tag.group(3)):
                    continue
                elif name in MEDIA:
                    at = self.media_end(page, at, name)
                elif name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else size
                else:
                    self.start(name, tag.group(3))
        self.flush()
        return self.blocks

    def media_end(self, page: str, at: int, name: str) -> int:
        """End of a media element that begins before ``at``: its closing tag, or else where its parent ends."""
        above, inner = {e.name for e in self.open}, []
        for tag in TAG.finditer(page, at):
            if not tag.group(2):
                continue
            found = tag.group(2).lower()
            if tag.group(1):
                if found in inner:
                    while inner.pop() != found:
                        pass
                elif found == name:
                    return tag.end()
                elif found in above:
                    return tag.start()
            elif found in BLOCKS and self.open and self.open[-1].name == "p" and not inner:
                return tag.start()  # a block ends an open paragraph and what is open in it
            elif found not in VOID:
                inner.append(found)
        return len(page)

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.in_link:
                self.links += len("".join(entities.unescape(raw).split()))

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                top = self.open[-1] if self.open else Element("", False, 0)
                self.blocks.append(Block(text, self.links, top.beside, top.article, any(e.name in HEADINGS for e in self.open[-2:])))
            self.parts, self.links = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name in BLOCKS:
            self.flush()
        if name == "a":
            self.in_link += 1
        if name in VOID:
            return
        if name in BLOCKS or attributes:
            if name == "p" or name in HEADINGS:  # these never hold a paragraph
                while self.open and self.open[-1].name == "p":
                    self.open.pop()
            above = self.open[-1] if self.open else Element("", False, 0)
            article = above.article
            if name in ARTICLES and not article:
                self.articles += 1
                article = self.articles
            never = name in NEVER_TEXT and not (name == "header" and article)
            words = () if not attributes else re.split(r"[^a-z]+", " ".join("".join(m) for m in CLASSES.findall(attributes)).lower())
            marked = name not in ("body", "html", "article", "main") and not BESIDE.isdisjoint(words)
            if name in BLOCKS or marked:
                if marked and name not in BLOCKS:
                    self.flush()
                self.open.append(Element(name, above.beside or never or marked, article))

    def close(self, name: str) -> None:
        if name == "a":
            self.in_link = max(0, self.in_link - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name == name:
                self.flush()
                del self.open[i:]
                return
        if name in BLOCKS:
            self.flush()


def first_label(block: Block) -> int:
    words = WORD.findall(block.text.lower())
    if block.beside or block.links > LINK_SHARE * max(1, len(block.text.replace(" ", ""))):
        return BOILERPLATE
    if len(words) >= SHORT_WORDS and sum(w in STOP_WORDS for w in words) >= STOP_SHARE * len(words):
        return TEXT
    return OPEN


def inherited(blocks: list[Block]) -> list[int]:
    """Second pass: labels of all blocks."""
    labels = [b.label for b in blocks]
    n = len(blocks)
    before, last = [None] * n, {}
    after, nxt = [None] * n, {}

    def seen(block: Block) -> list:
        # boilerplate inside an article (a share bar, an advert) says nothing about the text around it
        return [] if block.article and block.label == BOILERPLATE else [0, block.article] if block.article else [0]

    for i, b in enumerate(blocks):
        before[i] = last.get(b.article)
        if b.label != OPEN:
            last.update(dict.fromkeys(seen(b), i))
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        after[i] = nxt.get(b.article)
        if b.label != OPEN:
            nxt.update(dict.fromkeys(seen(b), i))
    for i, b in enumerate(blocks):
        if b.label != OPEN:
            continue
        p, q = before[i], after[i]
        if p is None and q is None:
            labels[i] = TEXT if b.article else BOILERPLATE
        elif p is None or q is None:
            labels[i] = labels[q if p is None else p]
        elif b.heading or q - i < i - p:
            labels[i] = blocks[q].label
        elif i - p < q - i:
            labels[i] = blocks[p].label
        else:
            labels[i] = max(blocks[p].label, blocks[q].label) if b.article else min(blocks[p].label, blocks[q].label)
    return labels


def extract(page: str) -> str:
    blocks = Reader().read(page)
    for b in blocks:
        b.label = first_label(b)
    return "\n".join(b.text for b, label in zip(blocks, inherited(blocks)) if label == TEXT)


def page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, pages in text_batches(batch, "html"):
            texts = [extract(p.decode("utf-8", "replace")) for p in pages]
            part = batch.slice(first, len(pages))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Lazy: page_id, url, text, n_chars of each row."""
    return pages.selectExpr("cast(page_id as long) AS page_id", "url", "html").mapInArrow(page_batches, "page_id long, url string, text string, n_chars long")
