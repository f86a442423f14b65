"""Main text of web pages by the distribution of text over lines.

A page is stripped of comments, scripts, styles and tags; each block element is a line. A line
counts as many characters as it has outside of links; it counts none inside elements that by
their name, role or class are menus, headers, footers, sidebars, notices, adverts or forms,
unless such an element holds all articles or, without any, most of the text. Reader comments
count none wherever they stand, even as articles. A class or id is judged as a whole: each of its
words has to be such a name or a word of placement (``site-header``, ``sidebar-left``).
Inside a marked article a line counts all its characters ``ARTICLE_WEIGHT`` times. Sums over
sliding windows of lines then show where text surges (``SURGE`` characters, or the most that a
window of the page has) and where it dives to nothing; all lines between a surge and its dive are
kept, link-heavy ones too, as many such stretches as there are. The border of an article is a
dive, and the lines in it surge by their sum as one stretch; the only marked stretch of a page
surges whatever its length. A paragraph with words outside of its links can begin a surge.

White space inside a line becomes one space; kept lines are joined by an empty line. Character
references are decoded once. Null, empty and textless pages give an empty text; unclosed and
cut-off markup is read as far as it goes, and an unfinished tag at the end is dropped.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

WINDOW = 3
SURGE = 80
ARTICLE_WEIGHT = 3
LINKED_SHARE = 0.5

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset(
    "head title nav header footer aside form menu dialog button select option datalist label legend fieldset "
    "input search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
SILENT_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside "
    "complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin share "
    "sharing social related recommended recommendations widget widgets search searchbox pagination pager "
    "toolbar copyright disclaimer skip dialog form".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
# words beside such a name that tell where or how large an element is, or what kind of box
PLACE_WORDS = frozenset(
    "site page main top bottom left right center primary secondary global local upper lower inner outer sub in "
    "inline list item items box block area container wrapper wrap section bar link links post posts article "
    "articles entry blog story stories news button buttons group row col column content body text title heading "
    "icon icons label panel pane unit slot zone sticky fixed floating float wide large small mini mobile desktop "
    "thread meta author user users reader readers message legal privacy policy leaderboard google gpt dfp "
    "media input field tags div id js the".split()
)
# elements that end when another of their kind begins
_CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</?[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]{2,}")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


def _attributes(raw: str) -> dict[str, str]:
    """Names, lower-cased, and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _says(names: str, kinds: frozenset[str]) -> bool:
    """Whether a name consists of words of ``kinds``, at least one, and words of placement."""
    for name in names.split():
        found = set(_WORD.findall(_HUMP.sub("-", name).lower()))
        if found & kinds and found <= kinds | SILENT_WORDS | PLACE_WORDS:
            return True
    return False


def _is_silent(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether an element is silent, and whether it may be spared for what it contains."""
    if tag in SILENT:
        return True, tag == "form"
    if not raw or tag in ("html", "body", "main"):
        return False, False
    own = _attributes(raw)
    names = " ".join(own.get(x, "") for x in ("class", "id", "role"))
    if _says(names, COMMENT_WORDS):
        return True, False
    if tag == "article":
        return False, False
    hidden = "hidden" in own or _NO_DISPLAY.search(own.get("style", "")) is not None
    quiet = hidden or _says(names, SILENT_WORDS)
    return quiet, quiet


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters that count, inside an article) of each line of a page.

    Elements silent by name that hold all articles, or most text of a page without any, are spared.
    """
    lines, held, size, seen = _walk(page, frozenset())
    if not held:
        return lines
    spared = frozenset(at for at, n, own in held if (own == seen if seen else 2 * n > size))
    return _walk(page, spared)[0] if spared else lines


def _walk(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, int, bool]], list[tuple[int, int, int]], int, int]:
    """Lines, (place, characters, articles) of elements silent by name, and both sums of the page."""
    lines: list[tuple[str, int, bool]] = []
    open_: list[tuple[str, bool, int, int, int]] = []  # element, silent, place or -1, characters and articles before
    held: list[tuple[int, int, int]] = []
    silent = links = articles = size = seen = firm = 0
    parts: list[str] = []
    linked: list[str] = []
    outside: list[str] = []

    def add(raw: str) -> None:
        nonlocal size
        if not firm:
            size += len(raw.strip())
        if raw and not silent:
            parts.append(raw)
            (linked if links else outside).append(raw)

    def end_line() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                in_links = len(" ".join(references.unescape("".join(linked)).split())) if linked else 0
                counted = 0 if in_links > LINKED_SHARE * len(text) else len(text) - in_links
                if not counted and any(x[0] == "p" for x in open_) and any(x.isalpha() for x in "".join(outside)):
                    counted = len(text) - in_links
                lines.append((text, counted, articles > 0))
            parts.clear()
            linked.clear()
            outside.clear()

    def close(depth: int) -> None:
        nonlocal silent, links, articles, firm
        while len(open_) > depth:
            name, quiet, place, n, own = open_.pop()
            silent -= quiet
            firm -= quiet and place < 0
            if place >= 0:
                held.append((place, size - n, seen - own))
            links -= name == "a"
            articles -= name in ARTICLE

    at = 0
    for m in _PIECE.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            end_line()
        if m[2]:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            # inline ends do not close the blocks around them
            if depth is not None and (tag in BLOCKS or not any(x[0] in BLOCKS for x in open_[depth + 1 :])):
                close(depth)
        elif tag not in VOID:
            if tag in _CLOSED_BY_SAME and open_:
                depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] in BLOCKS), -1)
                if depth >= 0 and open_[depth][0] == tag:
                    close(depth)
            quiet, by_name = _is_silent(tag, m[4] or "")
            quiet = quiet and m.start() not in spared
            open_.append((tag, quiet, m.start() if quiet and by_name else -1, size, seen))
            silent += quiet
            firm += quiet and not by_name
            seen += tag in ARTICLE and not firm
            links += tag == "a"
            articles += tag in ARTICLE
    add(page[at:])
    end_line()
    close(0)
    return lines, held, size, seen


def main_text(page: str | None) -> str:
    """The main text of one page."""
    lines = page_lines(page or "")
    counts = [ARTICLE_WEIGHT * len(text) if inside else n for text, n, inside in lines]
    sums = [
        sum(counts[j] for j in range(i, min(i + WINDOW, len(lines))) if lines[j][2] == inside)
        for i, (_, _, inside) in enumerate(lines)
    ]
    # a marked stretch surges or not as a whole, by all its lines; the only one always does
    only = sum(inside for inside, _ in groupby(lines, key=lambda line: line[2])) == 1
    at = 0
    for inside, run in groupby(lines, key=lambda line: line[2]):
        to = at + sum(1 for _ in run)
        if inside:
            sums[at:to] = [max(SURGE * only, sum(counts[at:to]))] * (to - at)
        at = to
    least = min(SURGE, max(sums, default=1) or 1)
    kept, flowing = [], False
    for i, (text, _, inside) in enumerate(lines):
        if flowing and (not sums[i] or inside != lines[i - 1][2]):
            flowing = False  # dive
        if not flowing and counts[i] and sums[i] >= least:
            flowing = True  # surge
        if flowing:
            kept.append(text)
    return "\n\n".join(kept)


@F.arrow_udf(T.StringType())
def _main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([main_text(page) for page in batch.to_pylist()], pa.string())


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``_text``, the main text of each page."""
    small_batches(pages.sparkSession)
    return pages.withColumn("_text", _main_text(F.col(html)))
