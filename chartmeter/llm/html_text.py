"""Main text of web pages by text-to-tag ratios (after CETR, Weninger et al., 2010).

The standard library's parser is fed a page piece by piece. Its events cut the page into
blocks, the lines of the method; blocks of menus, forms, adverts, comments and the like are
left out as they open. Each block has a ratio of text to tags; the ratios are smoothed by
a Gaussian and clustered into two by their nearest mean. In a container that holds content
(``article``, ``main``) short paragraphs stay, but not three or more links in a row that the
clusters put outside the content. On a page without one, content blocks stay, those near them
whose own ratio is that of content, and what lies shortly between them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmeter.llm.common import map_arrow

#: Characters fed to the parser at once.
CHUNK = 1 << 16
#: Spread of the Gaussian in blocks, and the gap that a content region bridges.
SIGMA, GAP = 1.0, 2
#: Share of its characters that makes a block one of links, and how many make a menu.
LINKED, MENU = 0.9, 3

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = {"article", "main"}
DROPPED = set(
    "aside audio button canvas datalist dialog embed footer form head iframe input label menu nav noscript object"
    " option script select style svg template textarea title video".split()
)
DROPPED_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of a class or id that mark what is no article text.
DROPPED_PARTS = set(
    "ad ads adsbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " commentlist consent cookie cookies disqus gdpr login masthead menu modal nav navbar navigation newsletter"
    " notice notices pager pagination popup promo promotion recommended related respond share sharebar sharing"
    " sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
DROPPED_NAMES = re.compile(r"^((site|page|main|global|top)[-_])?(header|footer|head|foot)$")
#: A paragraph ends where one of these opens; an item where the next one does.
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements that an implied end does not reach beyond.
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "aside", "nav", "form", "body", "html"}


def _dropped(tag: str, attributes: dict[str, str | None], inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if tag in CONTAINERS or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style") or ""):
        return True
    if (attributes.get("role") or "").lower() in DROPPED_ROLES:
        return True
    names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower().split()
    return any(DROPPED_NAMES.match(n) or not DROPPED_PARTS.isdisjoint(re.split(r"[-_]+", n)) for n in names)


class Blocks(HTMLParser):
    """Blocks of a page: text, tags, characters in links and the container they lie in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int]] = []
        self.open: list[str] = []
        self.depths: dict[str, list[int]] = {}  # of the open elements, by tag
        self.ends: list[int] = []  # depths of those that matter for implied ends
        self.dropped_at: int | None = None  # depth of the element that is left out
        self.inside: list[int] = []  # numbers of the open containers
        self.containers = 0
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, self.tags, self.linked, self.inside[0] if self.inside else -1))
        self.text, self.tags, self.linked = [], 0, 0

    def _close(self, depth: int) -> None:
        """Closes all elements from ``depth`` on."""
        for tag in reversed(self.open[depth:]):
            if tag in BLOCKS and self.dropped_at is None:
                self.flush()
            self.open.pop()
            self.depths[tag].pop()
            if self.ends and self.ends[-1] == len(self.open):
                self.ends.pop()
            if self.dropped_at is not None and len(self.open) <= self.dropped_at:
                self.dropped_at = None
            if tag in CONTAINERS and self.inside:
                self.inside.pop()

    def _implied(self) -> list[int]:
        """Depths, deepest first, of the elements in the innermost scope that may end unsaid."""
        found = []
        for depth in reversed(self.ends):
            if self.open[depth] in SCOPES:
                break
            found.append(depth)
        return found

    def handle_starttag(self, tag, attrs):
        for depth in self._implied():
            if tag in CLOSED_BY.get(self.open[depth], ()):
                self._close(depth)
        if self.dropped_at is None:
            if tag in BLOCKS:
                self.flush()
            elif tag == "br":
                self.text.append(" ")
            self.tags += 1
        if tag in VOID:
            return
        attributes = dict(attrs)
        if self.dropped_at is None and _dropped(tag, attributes, bool(self.inside)):
            self.flush()
            self.dropped_at = len(self.open)
        if tag in CONTAINERS:
            if not self.inside:
                self.containers += 1
            self.inside.append(self.containers)
        if tag in SCOPES or tag in CLOSED_BY:
            self.ends.append(len(self.open))
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        # In HTML a slash does not close an element; only void ones have no end.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.dropped_at is None:
            self.tags += 1
        if not self.depths.get(tag):
            return
        depth = self.depths[tag][-1]
        # a stray end inside does not end what is left out
        if self.dropped_at is None or depth >= self.dropped_at or tag in SCOPES:
            self._close(depth)

    def handle_data(self, data):
        if self.dropped_at is None:
            self.text.append(data)
            if self.depths.get("a"):
                self.linked += len(data)

    def close(self):
        super().close()
        if self.dropped_at is None:
            self.flush()


def parse(html: str) -> list[tuple[str, int, int, int]]:
    parser = Blocks()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    parser.close()
    return parser.blocks


def content(blocks: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks are content by their smoothed ratios, split at the middle of two means,
    and which have such a ratio of their own."""
    ratios = np.array([max(len(t) - linked, 0) / max(tags, 1) for t, tags, linked, _ in blocks], dtype=float)
    reach = int(np.ceil(3 * SIGMA))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    if len(ratios) >= len(weights):
        smooth = np.convolve(ratios, weights, "same") / np.convolve(np.ones(len(ratios)), weights, "same")
    else:
        near = np.exp(-0.5 * ((np.arange(len(ratios))[:, None] - np.arange(len(ratios))[None, :]) / SIGMA) ** 2)
        smooth = near @ ratios / near.sum(1)
    low, high = smooth.min(), smooth.max()
    if high < 2 * low + 1:
        return np.ones(len(ratios), dtype=bool), np.ones(len(ratios), dtype=bool)
    for _ in range(50):
        upper = smooth > (low + high) / 2
        new = smooth[~upper].mean(), smooth[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return smooth > (low + high) / 2, ratios > (low + high) / 2


def regions(chosen: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Chosen blocks with those near them that have the ratio of content, and all between."""
    keep = np.zeros(len(chosen), dtype=bool)
    at = np.flatnonzero(chosen | own)
    for part in np.split(at, np.flatnonzero(np.diff(at) > GAP + 1) + 1):
        if chosen[part].any():
            keep[part[0] : part[-1] + 1] = True
    return keep


def menus(blocks: list[tuple[str, int, int, int]], chosen: np.ndarray) -> np.ndarray:
    """Runs of blocks that are links and not chosen."""
    links = ~chosen & np.array([linked >= LINKED * len(t) for t, _, linked, _ in blocks])
    at = np.flatnonzero(links)
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    found = np.zeros(len(blocks), dtype=bool)
    found[np.concatenate([run for run in runs if len(run) >= MENU] or [at[:0]])] = True
    return found


def main_text(html: str) -> str:
    """The content blocks of a page in page order, joined by one line feed."""
    blocks = parse(html)
    if not blocks:
        return ""
    chosen, own = content(blocks)
    inside = np.array([c for *_, c in blocks])
    if (inside >= 0).any():
        held = set(inside[chosen & (inside >= 0)].tolist()) or set(inside[inside >= 0].tolist())
        keep = np.isin(inside, list(held)) & ~menus(blocks, chosen)
    else:
        keep = regions(chosen, own)
    return "\n".join(t for (t, *_), k in zip(blocks, keep) if k)


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; a null or empty page has no text.

    Other columns are left out, repeated rows come out repeated, nulls in the id and the
    url stay.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(t or "") for t in batch.column("html").to_pylist()]
        return pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    named = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return map_arrow(named, rows, "page_id long, url string, text string, n_chars long", "html")
