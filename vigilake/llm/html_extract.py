"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. The first pass decides each block alone:
by the region it lies in (menus, footers, forms, comments are none of the article's), by link
density, length and the density of stop words. Inside an article or main element a long block
of few links is text whatever its words; elsewhere its stop words must speak for it. Short
blocks stay open. In the second pass an open block takes the label of the nearest decided
block of its own kind of region; of two equally near ones that differ the article's side wins
inside an article, the other side elsewhere. Pages are independent rows, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

STOP_WORDS = frozenset(
    """
    the and of to in a is that it for on with as was at by be this are from or an not have had but they his her she he you we their its
    der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an er hat aus dem des im dass sie nach bei um
    le la les des et est un une du de en que qui dans pour pas sur au par plus avec ce il elle ne se sont mais ou
    el los las del y una por con no su para es al lo como más o pero sus le ha este
    """.split()
)
#: Their content is never text of the page.
UNSEEN = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "select", "textarea", "button", "audio", "video", "title", "datalist")
ASIDE = frozenset(("nav", "footer", "aside", "form", "dialog", "menu", "head"))
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead tr ul
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that name what is not the article.
HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice
    notices popup modal newsletter subscribe subscription comment comments respond replies disqus sidebar widget menu nav navbar
    navigation breadcrumb breadcrumbs footer masthead share sharing social related pagination pager login signup search toolbar
    """.split()
)
#: The same outside an article; inside, they name its own parts.
OUTER_HINTS = frozenset(("header", "top", "bottom", "meta"))
TOKEN = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))"
    + rf"|(?P<unseen>{'|'.join(UNSEEN)})(?=[\s/>])[^>]*>.*?(?:</(?P=unseen)(?=[\s/>])[^>]*>|\Z)"
    + r"""|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    + r"|/?[a-zA-Z][^>]*(?:>|\Z)|[!?/][^>]*(?:>|\Z))",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>"']|\Z)""", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds: characters below which a block is short; shares of linked characters and of stop words."""

    short: int = 60
    linked: float = 0.5
    stops: float = 0.12
    long: int = 200
    stops_long: float = 0.06


def _hints(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether a start tag opens a region that is not text, or the article."""
    off, main = tag in ASIDE or (tag == "header" and not inside), tag in MAIN
    if attrs:
        for m in ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                off = True
            elif name == "style":
                off |= re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
            elif name == "itemprop":
                main |= value.lower() == "articlebody"
            elif name == "role" and value.lower() == "main":
                main = True
            elif tag not in ("html", "body", "main"):
                words = {w.lower() for w in NAMES.findall(value)}
                off |= not words.isdisjoint(HINTS) or (not inside and not words.isdisjoint(OUTER_HINTS))
    return off, main and not off


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, linked characters, outside the article's regions, inside an article) of each block of a page that has text."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, bool, bool]] = []
    open_tags, off, main, at = Counter(), 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, linked, off > 0, main > 0))
            parts.clear()
        linked = 0

    def pop(tag: str) -> None:
        """Leave the innermost `tag` and what was left open in it."""
        nonlocal off, main
        while True:
            name, a, b = stack.pop()
            open_tags[name] -= 1
            if a or b:
                close()
                off, main = off - a, main - b
            if name == tag:
                return

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at:
            text = html.unescape(page[at:end])
            parts.append(text)
            if open_tags["a"]:
                linked += len("".join(text.split()))

    for m in TOKEN.finditer(page):
        text_until(m.start())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in BLOCKS:
            close()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        elif m["end"]:
            if open_tags[tag]:
                pop(tag)
        elif tag not in VOID:
            if tag in BLOCKS and open_tags["p"]:
                pop("p")
            elif tag == "a" and open_tags["a"]:
                pop("a")
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
                pop(tag)
            if not m["attrs"].rstrip().endswith("/") or tag in BLOCKS:
                a, b = _hints(tag, m["attrs"], main > 0)
                if a or b:
                    close()
                    off, main = off + a, main + b
                stack.append((tag, a, b))
                open_tags[tag] += 1
    text_until(len(page))
    close()
    return out


def first_pass(text: str, linked: int, off: bool, main: bool, rules: Rules) -> bool | None:
    """Text or not, by the block alone; None where it is too short to tell."""
    if off:
        return False
    n = len(text)
    if linked and linked > rules.linked * len("".join(text.split())):
        return False
    if not main and text[0] in "©®":
        return False
    if n < rules.short:
        return None
    if main:
        return True
    words = WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return stops >= (rules.stops_long if n >= rules.long else rules.stops)


def second_pass(labels: list[bool | None], regions: list[bool]) -> list[bool]:
    """Open labels inherit from the nearest decided block of the same kind of region; without one (in an article: on either side), the region decides."""
    n = len(labels)
    before: list[int | None] = []
    last: dict[bool, int] = {}
    for i in range(n):
        before.append(last.get(regions[i]))
        if labels[i] is not None:
            last[regions[i]] = i
    out, nxt = list(labels), {}
    for i in range(n - 1, -1, -1):
        if labels[i] is None:
            near = [(abs(j - i), labels[j]) for j in (before[i], nxt.get(regions[i])) if j is not None]
            closest = [x for d, x in near if d == min(near)[0]]
            edge = regions[i] and len(near) < 2  # beyond an article's first and last decided block the article speaks
            out[i] = regions[i] if edge or not closest or len(set(closest)) > 1 else closest[0]
        else:
            nxt[regions[i]] = i
    return out


def judged(page: str, rules: Rules) -> list[tuple[str, bool | None, bool]]:
    """(text, first label, final label) of each block."""
    found = blocks(page)
    first = [first_pass(*b, rules) for b in found]
    # blocks of no region of the article are decided; they do not speak for open ones inside it
    return [(b[0], x, y) for b, x, y in zip(found, first, second_pass(first, [b[3] and not b[2] for b in found]), strict=True)]


def labelled(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, block (from 0), text, first (true, false or null while open), main of every block of `pages`, in page order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, i, *x) for p, h in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True) for i, x in enumerate(judged(h or "", rules))]
            cols = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["page_id", "block", "text", "first", "main"])

    return spread(pages.select("page_id", "html")).mapInArrow(rows, "page_id long, block int, text string, first boolean, main boolean")


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text for every row of `pages`: its main blocks in page order, one space between them.

    A null or empty page, or one without main text, has an empty text. Repeated rows, and rows that
    share or lack a page_id, each give their own row. A tag whose quotes do not close ends at its first >. Other columns of `pages` are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(t for t, _, keep in judged(h or "", rules) if keep) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return spread(pages.select("page_id", "url", "html")).mapInArrow(rows, "page_id long, url string, text string")


def op13_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
