"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Structure comes first: what stands in
navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
reader comments is boilerplate whatever it says. The first pass then classes a block by
its own length, link density and stop-word density; inside an article element length is
no evidence against a block. The second pass gives ambiguous short blocks the label of
their nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import bound_batches, text_or_empty

# The commonest function words of the languages that are expected.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his i if in
    into is it its me more my no not of on one or other our out over she so some than that the their them then there they
    this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einen einer es für hat ich im in ist
    kann mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn werden wie wir wird zu zum zur
    au aux avec ce cette ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour
    qu que qui sa se ses son sont sur un une vous
    al como con de del el ella en es esta este está fue ha hay la las le lo los más me mi no nos o para pero por que se sin
    sobre son su sus también un una y ya""".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol optgroup option p pre section
    select summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "button")
DROP_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner banners billboard breadcrumb breadcrumbs
    comment comments commentlist consent cookie cookies disclaimer discussion disqus dropdown footer footers gdpr header
    login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification notifications overlay
    pager pagination popup promo promotion promotions recommended related replies reply respond responses search share
    sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget
    widgets alert alerts warning""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
# A <p> or <li> ends where one of these starts: unclosed tags are common.
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^<>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")

# Fixed thresholds of the first pass.
MAX_LINK_DENSITY = 0.5
SHORT_CHARS, LONG_CHARS = 70, 200
STOP_LOW, STOP_HIGH = 0.12, 0.22


@dataclass
class Block:
    text: str
    links: int
    tag: str
    dropped: bool
    inside: bool
    label: str = ""


@dataclass
class _Open:
    tag: str
    drops: bool
    comments: bool


def _attributes(rest: str) -> tuple[bool, bool]:
    """Whether the attributes mark boilerplate, and whether they mark reader comments."""
    drops = comments = False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role":
            drops |= value.strip() in DROP_ROLES
        elif key in ("class", "id"):
            words = set(_NAME.findall(value))
            drops |= not words.isdisjoint(DROP_WORDS)
            comments |= not words.isdisjoint(COMMENT_WORDS)
        else:
            drops |= key == "hidden" or value == "true"
    return drops or comments, comments


class Segmenter:
    """Cuts one page into blocks with the facts the rules need."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[_Open] = []
        self.parts: list[str] = []
        self.links: list[int] = []
        self.in_link = 0
        self.dropping = 0
        self.articles = 0
        self.tag = ""

    def run(self, page: str) -> list[Block]:
        at = 0
        for m in _TAG.finditer(page):
            if m.start() > at:
                self.text(page[at:m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if name:
                if m["end"] or m["end2"]:
                    self.close(name)
                else:
                    self.open(name, m["rest"] or m["rest2"] or "")
        if at < len(page):
            self.text(page[at:])
        self.flush()
        return self.blocks

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        self.links.append(len(raw) if self.in_link else 0)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, sum(self.links), self.tag, self.dropping > 0, self.articles > 0))
            self.parts, self.links = [], []

    def open(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            self.flush()
            if name in CLOSES_P:
                self._end_implied("p")
            if name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                self._end_implied(name)
            self.tag = name
        if name == "a":
            self.in_link = 1
        if name in VOID or rest.endswith("/"):
            return
        drops, comments = _attributes(rest) if rest else (False, False)
        drops |= name in DROP_TAGS
        if name in ("article", "main"):
            if not comments and self.dropping and not any(o.comments or o.tag in ("aside", "footer", "article", "main") for o in self.stack):
                # an article never stands in a menu or an advert: those were left open
                self._unwind(0)
            self.articles += 1
        self.stack.append(_Open(name, drops, comments))
        self.dropping += drops

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.tag = ""
        if name == "a":
            self.in_link = 0
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == name:
                self._unwind(k)
                return

    def _end_implied(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == name:
                self._unwind(k)
                return
            if self.stack[k].tag in BLOCKS:
                return

    def _unwind(self, size: int) -> None:
        while len(self.stack) > size:
            gone = self.stack.pop()
            self.dropping -= gone.drops
            self.articles -= gone.tag in ("article", "main")
            if gone.tag == "a":
                self.in_link = 0


def first_pass(block: Block) -> str:
    """``bad``, ``good`` or, for the second pass, ``short``, by the block alone."""
    if block.dropped:
        return "bad"
    size = len(block.text)
    density = min(1.0, block.links / size)
    if block.inside:
        # within the article a block is dropped only for being made of links
        return "good" if density <= MAX_LINK_DENSITY or block.tag in ("p", "h1", "h2", "h3") else "short" if size < SHORT_CHARS else "bad"
    if density > MAX_LINK_DENSITY:
        return "bad"
    if size < SHORT_CHARS:
        return "bad" if density > 0 else "short"
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOP_HIGH:
        return "good"
    if stops >= STOP_LOW:
        return "good" if size >= LONG_CHARS else "short"
    return "bad"


def second_pass(blocks: list[Block]) -> None:
    """Short blocks take the label of the nearest decided blocks; where those differ, of the nearer.

    A heading belongs with what follows it. Blocks at either end of a page look to their
    one side; where nothing is decided, short blocks are boilerplate.
    """
    n = len(blocks)
    before, after = [(n + 1, "bad")] * n, [(n + 1, "bad")] * n
    for order, seen in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = (n + 1, "bad")
        for k in order:
            seen[k] = last
            last = (0, blocks[k].label) if blocks[k].label != "short" else last
            last = (last[0] + 1, last[1])
    for k, block in enumerate(blocks):
        if block.label == "short":
            left, right = before[k], after[k]
            heading = re.fullmatch("h[1-6]", block.tag) is not None
            block.label = right[1] if heading and right[0] <= n else left[1] if left[0] < right[0] else right[1] if right[0] < left[0] else (
                "good" if left[1] == right[1] == "good" else "bad"
            )


def extract(page: str) -> str:
    """The main text of one page: its good blocks in page order, one per line."""
    blocks = Segmenter().run(page)
    has_article = any(b.inside and not b.dropped for b in blocks)
    for block in blocks:
        block.label = first_pass(block) if block.inside or not has_article else "bad"
    if not has_article:
        second_pass(blocks)
    else:
        inside = [b for b in blocks if b.inside]
        second_pass(inside)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, ``keep`` columns, ``text`` and ``n_chars`` (code points).

    Missing html is an empty page; a page without main text has an empty text. Rows are
    independent and whole pages are read; repeated rows give repeated results and other
    columns are not read.
    """
    bound_batches(pages.sparkSession)
    kept = [f"k{i}" for i in range(len(keep))]
    source = pages.select(
        F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(a) for c, a in zip(keep, kept)], text_or_empty(html_col).alias("html")
    )

    @F.pandas_udf("string")
    def main_text(texts: pd.Series) -> pd.Series:
        return pd.Series([extract(t) for t in texts], dtype="object")

    found = source.withColumn("text", main_text("html")).drop("html")
    return found.select(
        F.col("id").alias(id_col), *[F.col(a).alias(c) for c, a in zip(keep, kept)], "text", F.length("text").cast("long").alias("n_chars")
    )
