"""Operator 1: the main text of HTML pages.

The standard library's streaming parser gives events; they are folded into the page's lines, one for each block of
text, with the tags and the linked characters in it. Elements that are by their tag, role, class or id a menu, header,
footer, sidebar, notice, advert, form, script, style or reader comments give no lines; an element that wraps the article,
or most of the page's prose, is none of these, whatever its name. Each line's text-to-tag ratio is smoothed over its
neighbours by a Gaussian and compared with a threshold; the runs of lines above it, without lines at their ends that are
below it by themselves, are the content clusters.

The article or main elements that hold most of the clusters' text are the content, with all their lines. Where a page marks
up none, clusters select it: all lines in them and between them are content, and those before the first and after the
last one are unless they look like page furniture: mostly links, a copyright line, or, outside the smallest
element around all clusters, a few bare words that no paragraph or heading holds. No block is left out for its size.

Pages are rows of their own: one pass, no shuffle.

Defined results
---------------
* null or empty html, or a page without content: empty text, n_chars 0;
* null page_id or url: kept as they are;
* repeated rows and ties: each row is extracted by itself;
* unclosed, misnested and stray tags: closed where HTML closes them, else ignored; marked sections (``<![...``) are
  comments up to the next ``>``, as in HTML;
* very long pages: whole; empty table: empty result;
* extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidra.llm.chunks import slices

#: Tags, roles and names by the HTML standard and common use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template button select textarea option label legend iframe object svg canvas audio video".split())
SECTIONS, WRAPPERS = frozenset("nav header footer aside dialog menu".split()), frozenset("form fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
CLOSES_ITEM = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
P, PAST_P = frozenset(["p"]), CLOSES_P - {"p"}
LISTS = frozenset("ul ol dl menu table body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense banner bottombar breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "popup promo promotion related share sharing sidebar sidebars signup skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist".split())
NEVER = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote pre".split())

#: Lines on each side that a line's ratio is smoothed with.
SIGMA, REACH = 1.0, 3
#: Words of a bare line, and characters of a line in a form or the like, that make it prose.
PROSE_WORDS, PROSE = 12, 80
COPYRIGHT = re.compile(r"(?:copyright\s*)?(?:©|\(c\))|copyright\s+\d{4}", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: First and last parts of names that say how a page is laid out, not what an element is.
STATES, STATES_LAST = frozenset("no not non has have with without is".split()), frozenset("open opened closed active enabled disabled visible collapsed expanded".split())
#: How an element says that it is none of the content: not at all, by a part of a name, by a whole name, as comments, as a form, by its tag.
UNNAMED, PARTLY, WHOLLY, THREAD, WRAPPER, SECTION = range(6)


def _named(attrs: list[tuple[str, str | None]], names: frozenset[str] = NAMES) -> int:
    found = UNNAMED
    for name, value in attrs:
        if name in ("class", "id"):
            for token in (value or "").split():
                parts = [x.lower() for x in PART.findall(token)]
                if len(parts) > 1 and (parts[0] in STATES or parts[-1] in STATES_LAST):
                    continue
                if not names.isdisjoint(parts):
                    found = max(found, WHOLLY if len(parts) == 1 else PARTLY)
    return found


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "role":
            if value and value.strip().lower() in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class Lines(HTMLParser):
    """Folds events into ``lines``: text, tags, linked characters, and the number of the innermost open element.

    ``parents[e]`` is the element around element ``e``, ``tags[e]`` its tag and ``named[e]`` how surely it is left out by its
    class or id; whether it is can only be said at the page's end.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parents, self.tags, self.named = [-1], [""], [UNNAMED]
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, whether its text is skipped
        self.parts: list[str] = []
        self.n_tags = self.linked = 0
        self.open: Counter[str] = Counter()

    def parse_html_declaration(self, i: int) -> int:
        # The library takes "<![" for SGML and fails where it isn't.
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            # A line belongs to the innermost element that isn't part of a line.
            self.lines.append((text, self.n_tags, self.linked, self.stack[-1][1]))
        self.parts.clear()
        self.n_tags = self.linked = 0

    def pop_to(self, k: int) -> None:
        for tag, _, _ in self.stack[k:]:
            self.open[tag] -= 1
        del self.stack[k:]

    def close_open(self, tags: frozenset[str], until: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in tags:
                self.pop_to(k)
                return
            if tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n_tags += 1
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
        else:
            self.flush()
            if tag in CLOSES_P:
                self.close_open(P, PAST_P)
            if tag in CLOSES_ITEM:
                self.close_open(CLOSES_ITEM[tag], LISTS)
        if tag in VOID:
            return
        skipped = self.stack[-1][2] or tag in SKIPPED or bool(attrs) and tag not in NEVER and _hidden(attrs)
        named = UNNAMED
        if attrs and not skipped and tag not in NEVER:
            named = _named(attrs) and (THREAD if _named(attrs, COMMENTS) else _named(attrs))
        elif attrs and not skipped and tag == "article":  # a comment may be an article of its own
            named = THREAD if _named(attrs, COMMENTS) else UNNAMED
        if tag in SECTIONS or tag in WRAPPERS:
            named = named if named == THREAD else SECTION if tag in SECTIONS else WRAPPER
        if tag in INLINE:
            skipped = skipped or named > UNNAMED
        element = self.stack[-1][1]
        if tag not in INLINE:
            self.parents.append(element)
            element = len(self.tags)
            self.tags.append(tag)
            self.named.append(named)
        self.stack.append((tag, element, skipped))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "/>" closes nothing but void elements in HTML

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag not in INLINE:
            self.flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self.pop_to(k)
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())


def content_clusters(lengths: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines' text-to-tag ratios, smoothed by a Gaussian, are at or above half the mean or one deviation.

    Smoothing lifts the lines around a cluster too: those at its ends stay only if they reach the threshold unsmoothed.
    """
    ratios = lengths / np.maximum(tags, 1)
    kernel = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    padded = np.pad(ratios, REACH, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    if not smooth[lengths > 0].std():
        return np.ones(len(smooth), bool)
    worded = smooth[lengths > 0]  # entries of menus tell nothing of the content's ratios
    threshold = min(worded.std(), worded.mean() / 2)
    high, own = smooth >= threshold, ratios >= threshold
    edges = np.flatnonzero(np.diff(np.concatenate([[False], high, [False]])))
    found = np.zeros(len(high), bool)
    for a, b in edges.reshape(-1, 2):
        inner = np.flatnonzero(own[a:b])
        if len(inner):
            found[a + inner[0] : a + inner[-1] + 1] = True
    return found if found.any() else high


def left_out(page: Lines) -> list[bool]:
    """Which elements are left out by their tag, class or id, or that of an element around them.

    Where an article or main is outside of all these, each is. Else, comments excepted, one that holds an article or main
    stays if it is a form or left out by its name, and so does one that holds most of the page's text outside links if it is
    named by only a part of a name, or holds an article or a line of prose.
    """
    out = [n > UNNAMED for n in page.named]
    if not any(out):
        return out
    size, plain, prose = [0] * len(out), [0] * len(out), [False] * len(out)
    holds = [t in REGIONS and not out[e] for e, t in enumerate(page.tags)]
    for text, _, linked, e in page.lines:
        size[e] += len(text)
        plain[e] += max(0, len(text) - linked)
        prose[e] |= len(text) - linked >= PROSE
    for e in range(len(out) - 1, 0, -1):  # an element comes after the one around it
        above = page.parents[e]
        size[above] += size[e]
        plain[above] += plain[e]
        prose[above] |= prose[e]
        # A comment's text is no article of the element around it.
        holds[above] |= holds[e] and size[e] > 0 and not (page.tags[e] == "article" and out[e])
    within = list(out)
    for e in range(1, len(out)):
        within[e] |= within[page.parents[e]]
    if not any(t in REGIONS and size[e] and not within[e] for e, t in enumerate(page.tags)):
        for e, kind in enumerate(page.named):
            most = 2 * plain[e] > plain[0]
            stays = {PARTLY: holds[e] or 2 * size[e] > size[0], WHOLLY: holds[e], WRAPPER: holds[e] or most and prose[e], SECTION: most and (holds[e] or prose[e])}
            out[e] = out[e] and not stays.get(kind, False)
    for e in range(1, len(out)):
        out[e] |= out[page.parents[e]]
    return out


def _inside(page: Lines, roots: list[int]) -> list[bool]:
    """Which elements are one of ``roots`` or in it."""
    found = [False] * len(page.tags)
    for e in roots:
        found[e] = True
    for e in range(1, len(found)):  # an element comes after the one around it
        found[e] |= found[page.parents[e]]
    return found


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    out = left_out(page)
    lines = [x for x in page.lines if not out[x[3]]]
    # An item that is nothing but a link is an entry of a menu, or of a list in the content: which, its place tells.
    entry = [bool(x[2]) and x[2] >= len(x[0]) and page.tags[x[3]] in ("li", "dd", "dt") for x in lines]
    if all(entry):
        return ""
    lengths, tags = np.array([0 if e else len(x[0]) for x, e in zip(lines, entry, strict=True)]), np.array([x[1] - 1 for x in lines])
    content = content_clusters(lengths, tags)
    held = [0] * len(page.tags)
    for x, n in zip(lines, np.where(content, lengths, 0).tolist(), strict=True):
        held[x[3]] += n
    for e in range(len(held) - 1, 0, -1):
        held[page.parents[e]] += held[e]
    kept = _marked(page, lines, held)
    if kept is None:
        kept = _unmarked(page, lines, entry, content, held)
    return "\n\n".join(x[0] for x, k in zip(lines, kept, strict=True) if k)


def _marked(page: Lines, lines: list[tuple[str, int, int, int]], held: list[int]) -> list[bool] | None:
    """The lines of the articles that hold most of the clusters' text, or else of main; None where neither does.

    Short articles count too, unless they are mostly links.
    A page's heading that stands right before them belongs to them, if they have none.
    """
    unlinked = [0] * len(page.tags)
    for text, _, linked, e in lines:
        unlinked[e] += len(text) - 2 * linked
    for e in range(len(unlinked) - 1, 0, -1):
        unlinked[page.parents[e]] += unlinked[e]
    for kind in ("article", "main"):
        roots = [e for e, t in enumerate(page.tags) if t == kind and (held[e] or unlinked[e] > 0)]
        inside = _inside(page, roots)
        most = sum(held[e] for e in roots if not inside[page.parents[e]])
        if not most or 2 * most < held[0]:
            continue
        kept = [inside[x[3]] for x in lines]
        first = kept.index(True)
        if first and page.tags[lines[first - 1][3]] == "h1" and not any(k and page.tags[x[3]] == "h1" for k, x in zip(kept, lines, strict=True)):
            kept[first - 1] = True
        return kept
    return None


def _unmarked(page: Lines, lines: list[tuple[str, int, int, int]], entry: list[bool], content: np.ndarray, held: list[int]) -> list[bool]:
    """The lines of the clusters, those between them, and those around them that aren't page furniture."""
    blocks = [t not in CLOSES_P or t in ("div", "section", "article", "main", "table") for t in page.tags]
    region = max(e for e in range(len(held)) if held[e] == held[0] and blocks[e])
    inside = _inside(page, [] if page.tags[region] in ("", "html", "body") else [region])
    # Elements that hold a line of the clusters themselves, or a paragraph that is one: lists of links in these are content.
    direct = {e for x, c in zip(lines, content.tolist(), strict=True) if c for e in (x[3], page.parents[x[3]])}
    at = np.flatnonzero(content)
    kept = []
    for k, (text, _, linked, e) in enumerate(lines):
        if at[0] <= k <= at[-1]:
            kept.append(True)
        elif entry[k] or 2 * linked >= len(text):
            kept.append(inside[e] and page.parents[page.parents[e]] in direct)
        elif COPYRIGHT.match(text):
            kept.append(False)
        else:
            kept.append(inside[e] or page.tags[e] in PARAGRAPHS or len(text.split()) >= PROSE_WORDS)
    return kept


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, "html", 8 << 20)):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
