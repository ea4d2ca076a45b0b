"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides what it
can from a block's container, its link density, its length and its share of
stop words. Short blocks without a decision are ambiguous; in the second pass
they inherit the label of the nearest decided neighbours. The borders of the
page's article count as decided: good within it, bad outside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tastemill.llm.common import map_text
from tastemill.llm.quality import STOP_WORDS

# HTML element names by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_TEXT = RAW_TAGS | frozenset("head noscript template svg math object applet canvas audio video select button".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog header".split())
# Words that name a page's furniture, as a class, id or role or at the end of one (cookie-notice).
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars aside rail menu menus nav "
    "navbar navigation breadcrumb breadcrumbs header masthead footer colophon cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended trending "
    "comment comments discussion disqus replies reply respond widget toolbar pagination pager search form contentinfo "
    "complementary".split()
)
# After such words, or before these, the name is of furniture as well (comment-list, share-buttons).
HOLDERS = frozenset(
    "area bar block body box button buttons card cards column container content form icons inner item items left link links "
    "list panel posts right section slot top bottom unit widget wrap wrapper".split()
)
# A name that begins so says what a page has or hasn't, not what the element is (with-sidebar).
SAYING = frozenset("has have with without no not hide hidden show is in on enable disable after before".split())
# A header within an article holds its title.
ARTICLE_HEADERS = frozenset(["header", "masthead"])
# An element closes these when it opens.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
MAIN_ROLE = re.compile(r"(?:^|\s)role\s*=\s*[\"']?main\b", re.I)
ARTICLES = re.compile(r"<(?:article|main)\b|role\s*=\s*[\"']?main\b", re.I)

LONG = 140
SHORT = 70
MOST_LINKED = 0.4
STOPS_HIGH = 0.12
STOPS_LOW = 0.05
SENTENCE_ENDS = re.compile(r"[.!?…。؟।]")


@dataclass
class Block:
    text: str
    linked: int
    boilerplate: bool
    article: int  # number of the article it is in, 0 for none


def furniture_names(attributes: str) -> set[str]:
    """The furniture words of an element's classes, ids and roles."""
    found = set()
    for names in NAMES.findall(attributes):
        for name in " ".join(names).lower().split():
            words = WORDS.findall(name)
            if not words or words[0] in SAYING:
                continue
            if words[-1] in BOILERPLATE_WORDS:
                found.add(words[-1])
            elif words[0] in BOILERPLATE_WORDS and words[-1] in HOLDERS:
                found.add(words[0])
    return found


def page_blocks(html: str, *, trust_names: bool = True, free_articles: bool = False) -> list[Block]:
    """The page's text in blocks, with white space cut to single spaces.

    Without ``trust_names``, classes and ids don't make furniture. With
    ``free_articles``, an article or main element is none whatever stands around it by name.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, silent, boilerplate, article
    parts: list[str] = []
    state = ("", False, False, 0)
    links = articles = linked = 0

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, min(linked, len(text)), state[2], state[3]))
        parts, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not state[1]:
            parts.append(piece)
            if links:
                linked += len(" ".join(unescape(piece).split()))

    at, end = 0, len(html)
    while at < end:
        found = MARKUP.search(html, at)
        if found is None:
            add(html[at:])
            break
        add(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if found[1]:
            if tag in BLOCK_TAGS:
                close_block()
            if tag == "a":
                links = 0
            if tag == "br":
                add(" ")
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    state = stack[-1] if stack else ("", False, False, 0)
                    break
            continue
        if tag in BLOCK_TAGS:
            close_block()
        elif tag == "br":
            add(" ")
        if tag == "a":
            links = 1
        if tag in VOID_TAGS or found[3].endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in RAW_TAGS:
            closing = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = closing.end() if closing else end
            continue
        for other in CLOSES.get(tag, ()):
            for depth in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[depth][0] == other:
                    del stack[depth:]
                    state = stack[-1] if stack else ("", False, False, 0)
                    break
        if tag in BLOCK_TAGS or tag in NEVER_TEXT or tag == "span":
            furniture = furniture_names(found[3]) if found[3] and trust_names else set()
            if state[3] or tag in ("article", "main"):
                furniture -= ARTICLE_HEADERS
            bad = bool(furniture) and tag not in ("body", "html", "main") or tag in BOILERPLATE_TAGS and not (tag == "header" and state[3])
            article, around = state[3], state[2]
            own = tag in ("article", "main") or bool(MAIN_ROLE.search(found[3]))
            if own and free_articles and not any(t in BOILERPLATE_TAGS for t, *_ in stack):
                bad = around = False
            if own and not article and not around and not bad:
                articles += 1
                article = articles
            if tag != "p":
                state = (tag, state[1] or tag in NEVER_TEXT, around or bad, article)
                stack.append(state)
            elif bad and not state[2]:
                # A paragraph of furniture ends at the next tag that closes it.
                closing = re.compile(r"</?(?:p|div|article|section|ul|ol|table|h[1-6]|main|body)\b", re.I).search(html, at)
                at = closing.start() if closing else end
    close_block()
    return blocks


def density(block: Block) -> float:
    return block.linked / len(block.text)


def stop_share(block: Block) -> float:
    words = block.text.lower().encode().split()
    return sum(w.strip(b".,;:!?") in STOP_WORDS for w in words) / len(words)


def first_pass(block: Block, known_language: bool = True) -> bool | None:
    """Good, bad, or None if the block is ambiguous.

    In a language whose stop words aren't known, long blocks are good that hold a sentence's end.
    """
    if block.boilerplate:
        return False
    if density(block) > MOST_LINKED and not block.article:
        return False
    if len(block.text) >= LONG and not known_language and SENTENCE_ENDS.search(block.text):
        return True
    stops = stop_share(block)
    if len(block.text) >= LONG and stops >= STOPS_LOW:
        return True
    if len(block.text) >= SHORT and stops >= STOPS_HIGH:
        return True
    if len(block.text) < SHORT or block.article:
        return None
    return False


def labels(blocks: list[Block]) -> list[bool]:
    """Both passes over a page's blocks."""
    long = [b for b in blocks if len(b.text) >= LONG and not b.boilerplate and density(b) <= MOST_LINKED]
    known = not long or any(stop_share(b) >= STOPS_LOW for b in long)
    decided = [first_pass(b, known) for b in blocks]
    if any(b.article for b in blocks):
        # The article's borders are decided: what stands outside is no main text.
        decided = [d if b.article else False for b, d in zip(blocks, decided)]
    n = len(blocks)
    before: list[tuple[int, bool]] = []
    last: tuple[int, bool, int] = (-1, False, 0)
    for i, (b, d) in enumerate(zip(blocks, decided)):
        if b.article and b.article != last[2]:
            last = (i - 1, True, b.article)
        if not (b.article and b.boilerplate) and d is not None:
            last = (i, d, b.article)
        before.append((i - last[0], last[1]))
    after: list[tuple[int, bool]] = [(0, False)] * n
    last = (n, False, 0)
    for i in range(n - 1, -1, -1):
        b, d = blocks[i], decided[i]
        if b.article and b.article != last[2]:
            last = (i + 1, True, b.article)
        if not (b.article and b.boilerplate) and d is not None:
            last = (i, d, b.article)
        after[i] = (last[0] - i, last[1])
    out = []
    for d, (left, a), (right, b) in zip(decided, before, after):
        out.append(d if d is not None else a if a == b or left < right else b if right < left else False)
    return out


def good_blocks(blocks: list[Block]) -> list[str]:
    return [b.text for b, good in zip(blocks, labels(blocks)) if good]


def main_text(html: str | None) -> str:
    """The blocks labelled good, in page order, two line ends between them.

    Names of elements can mislead. Where an article or main element lies within one that is
    furniture by its name, and the page has no other, it counts. Where nothing is found, and a block that was furniture by
    name reads as prose, names are left out of account.
    """
    blocks = page_blocks(html or "")
    if not any(b.article for b in blocks) and ARTICLES.search(html or ""):
        freed = page_blocks(html or "", free_articles=True)
        blocks = freed if any(b.article for b in freed) else blocks
    found = good_blocks(blocks)
    if not found and any(b.boilerplate and len(b.text) >= SHORT and stop_share(b) >= STOPS_HIGH and density(b) <= MOST_LINKED for b in blocks):
        found = good_blocks(page_blocks(html or "", trust_names=False))
    return "\n\n".join(found)


def extracted(pages: DataFrame, *, id_column: str = "page_id") -> DataFrame:
    """The main text of every page.

    Columns: the id, ``url``, ``text`` and ``n_chars``, its code points. A null
    or empty page, and one without main text, gives the empty string. Broken
    markup is read as far as it goes. Repeated rows stay repeated, null ids and
    urls stay null, an empty table gives an empty one; other columns are not
    read.
    """

    def make(block: pa.RecordBatch) -> dict[str, object]:
        texts = [main_text(h) for h in block.column("html").to_pylist()]
        return {
            id_column: block.column(id_column),
            "url": block.column("url"),
            "text": texts,
            "n_chars": [len(t) for t in texts],
        }

    kind = pages.schema[id_column].dataType.simpleString()
    return map_text(pages, [id_column, "url", "html"], f"{id_column} {kind}, url string, text string, n_chars bigint", make, "html")
