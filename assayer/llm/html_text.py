"""Main text of web pages by two passes over their blocks.

In pass one the density of function words, the length, the link density and the
part of the page that a block stands in vote on it; names of classes tell parts,
so they are votes too.  Pass two gives the short and undecided ones the label of
the nearest decided block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.llm.common import pieces

# The elements of HTML by their role here.
DROPPED = "script style noscript template svg math canvas object iframe textarea title video audio".split()
OUTSIDE = frozenset("head nav header footer aside form menu button select dialog fieldset datalist".split())
MAIN = frozenset("article main".split())
HOLDERS = OUTSIDE | MAIN | frozenset("html body div section ul ol dl table thead tbody tfoot tr td th figure details blockquote address center".split())
BREAKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr caption figcaption summary legend option label".split())
VOID = frozenset("br img input hr meta link wbr area base col embed source track param".split())

# Words of class, id and role names.
BAD_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar aside ad ads advert adverts advertisement "
    "advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription share sharing social comment comments commentlist disqus reply replies discussion related recommended widget "
    "login signup signin search toolbar pagination pager skip contentinfo complementary dialog form copyright legal".split()
)
MAIN_NAMES = frozenset("article main post story entry articlebody".split())
#: Beside one of these a name tells a state or a setting of the page (``has-sidebar``), not what the element is.
STATE_NAMES = frozenset("has no not with without open opened closed free on off enabled disabled allowed left right layout page type format status js".split())

# Function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to a in is that it for was on are as with his they at be this from have or by one had not but what all were when we there "
    "can an your which their said if do will each about how up out them then she many some so these would other into has more her two him "
    "le la les de des du un une et est que qui dans pour pas au aux sur par ce cette il elle nous vous avec son sa ses ne se plus ou mais "
    "der die das den dem des ein eine einen einer und ist von zu mit sich auf für nicht als auch es an werden aus er hat dass sie nach bei "
    "el los las y en del se con por su para como está lo al más o pero sus este esta son entre cuando muy sin sobre ser tiene también".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<drop>{'|'.join(DROPPED)})\b[^>]*(?:(?<=/)>|>.*?(?:</(?P=drop)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<[/!?a-zA-Z][^<>]*>?",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
NOTICE = re.compile(r"(?i)©|copyright\s*(?:©|\(c\)|(?:19|20)\d\d)|.{0,80}\ball rights reserved\b")
WORD = re.compile(r"[^\W\d_]+")

#: Limits of pass one, in characters and shares.
SHORT, LONG, LINKS, FEW, ENOUGH = 70, 200, 0.5, 0.12, 0.22
GOOD, BAD, OPEN = 1, 0, None
#: Parts of a page: what is no content by its element, what its names speak against, the page, the article.
OUT, AGAINST, PAGE, ARTICLE = -2, -1, 0, 1


def name_votes(rest: str) -> int:
    """1 if the class, id and role of an element speak for an article, -1 if against, by their number; 0 if neither."""
    votes = 0
    for m in NAMES.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(re.split(r"[_-]+", name))
            if words & BAD_NAMES:
                votes -= not words & STATE_NAMES
            elif words <= MAIN_NAMES:
                votes += 1
    return (votes > 0) - (votes < 0)


def _zone(tag: str, rest: str, above: int) -> int:
    """Part of the page an element opens.

    Names against it hold for all that is inside.  An article inside such a part
    is only as good as the page around; what its own text says decides there.
    """
    if above == OUT or tag in OUTSIDE or rest and HIDDEN.search(rest):
        return OUT
    votes = (tag in MAIN) + (name_votes(rest) if rest and tag not in ("html", "body") else 0)
    return AGAINST if votes < 0 else min(ARTICLE, above + (votes > 0))


def blocks(html: str) -> list[tuple[str, float, int]]:
    """(text, link density, zone) of the blocks in page order, without empty ones.

    References are decoded, white space is one space.  Elements that are never
    closed end with the element around them.
    """
    out: list[tuple[str, float, int]] = []
    stack: list[tuple[str, int]] = [("", PAGE)]
    parts: list[str] = []
    linked, link, at, block_zone = 0, 0, 0, PAGE

    def flush() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, min(1.0, linked / len(text)), block_zone))
        parts, linked = [], 0

    def say(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if link:
            linked += len(" ".join(piece.split()))

    for m in TOKEN.finditer(html):
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BREAKS:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m["end"]:
            if tag == "a":
                link = 0
            elif tag in HOLDERS and any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                link = 0
            block_zone = stack[-1][1]
            continue
        rest = m["rest"]
        if tag == "a":
            link = 1
        elif tag in HOLDERS:
            if not rest.endswith("/"):
                stack.append((tag, _zone(tag, rest, stack[-1][1])))
            block_zone = stack[-1][1]
            link = 0
        elif tag in BREAKS and tag not in VOID:
            block_zone = _zone(tag, rest, stack[-1][1])
    if at < len(html):
        say(html[at:])
    flush()
    return out


def first_pass(text: str, links: float, zone: int) -> int | None:
    """Label of a block by itself; ``OPEN`` where it is short or the votes are even."""
    if zone < PAGE or links > LINKS or zone == PAGE and NOTICE.match(text):
        return BAD
    if len(text) < SHORT:
        return OPEN
    words = WORD.findall(text.lower())
    density = sum(w in FUNCTION_WORDS for w in words) / max(1, len(words))
    votes = (density >= FEW) + (density >= ENOUGH) - 1 + (len(text) >= LONG) - (links > LINKS / 2) + zone
    return GOOD if votes > 0 else BAD if votes < 0 else OPEN


def second_pass(found: list[tuple[str, float, int]], first: list[int | None]) -> list[int]:
    """Open blocks take the label of the nearest decided block of their part of the page, or else of any part.

    Of two equally near ones a good one counts.  Without any decided block the
    open ones are good, those of an article alone if there are such.
    """
    out: list[int | None] = list(first)
    best = max((b[2] for b in found), default=PAGE)
    for zone in (ARTICLE, PAGE):
        mine = [i for i, b in enumerate(found) if b[2] == zone]
        voters = [i for i in mine if first[i] is not OPEN and found[i][1] <= LINKS] or [i for i, v in enumerate(first) if v is not OPEN and found[i][2] >= PAGE]
        after = 0
        for i in mine:
            if first[i] is not OPEN:
                continue
            while after < len(voters) and voters[after] < i:
                after += 1
            near = voters[max(0, after - 1) : after + 1]
            out[i] = first[min(near, key=lambda j: (abs(j - i), first[j] == BAD))] if near else GOOD if zone == best else BAD
    return out


def labels(found: list[tuple[str, float, int]]) -> list[int]:
    """Both passes.  Where names speak against every good block of a page, they are not heard."""
    out = second_pass(found, [first_pass(*b) for b in found])
    if GOOD not in out and any(b[2] == AGAINST for b in found):
        found = [(text, links, PAGE if zone == AGAINST else zone) for text, links, zone in found]
        out = second_pass(found, [first_pass(*b) for b in found])
    return out


def main_text(html: str) -> str:
    """The good blocks of a page, one per line; empty if there are none."""
    found = blocks(html)
    return "\n".join(b[0] for b, label in zip(found, labels(found), strict=True) if label == GOOD)


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars (code points).

    A null or empty page gives the empty text.  Repeated rows and null keys stay;
    no rows give no rows; further columns are not carried.  Pages are handled
    whole and alone, so nothing is shuffled.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema
            )

    rows = pages.selectExpr(f"cast(`{key}` as long) as page_id", "cast(url as string) as url", f"cast(`{html}` as string) as html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
