"""HTML extraction by line-block distribution (operator 2).

A page is cut at block-level tags into lines. A line's mass is the length of its text; lines of
scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and comments have none
(known by element, role, class or id), nor have lines that are mostly links, nor, on pages that mark
their article (by <article> or <main>, else by a class or id such as "post-content", around
``CONTENT_SHARE`` of the remaining text or more), lines outside of it. A name such as "no-sidebar" or
"has-comments" tells of the page and marks nothing; inside an article only whole names count, so that
"related-work" is text there. Buttons, pictures and advert parts inside a line go without ending it. A link is an <a href> up to its </a>, or without
one up to the next <a> or block. A part marked by class, id or role that holds an <article> or <main> and
most of the text is not dropped, whatever its name; nor is one with most of the text that holds the page's heading (h1),
or, where only part of a name tells ("layout-sidebar", "comment-page"), one outside of which no paragraph (for comments: no
line) is left. So names decide after the masses are known. Masses are summed over a window of ``WINDOW`` lines. A surge is
where the sum leaves zero, a dive where it falls back to zero; between the two lies a run. Runs whose
peak reaches ``PEAK_SHARE`` of the page's highest are kept (all runs of a marked article), and their
lines that have mass, in page order, are the text.

Inside a line, tags go, character references are decoded, white space becomes one space, and <br>
is white space. A page is read in linear time. Defined results: null and empty html give the empty text; broken or cut-off markup
is read as far as it goes; an empty table gives no rows; repeated rows give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
PEAK_SHARE = 0.25
LINK_SHARE = 0.5
CONTENT_SHARE = 0.4
#: Share of the page's text, links apart, over which a part that is marked by name may be the page's own.
PART_SHARE = 0.5
#: Characters, links apart, that make a line a paragraph.
PARAGRAPH = 80

#: Elements that begin and end a line.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split()
)
#: Elements without readable text of the article.
DROPPED = set("nav footer aside form button select option textarea input iframe object canvas audio video svg noscript template dialog menu head title search".split())
#: Those of them that stand inside a line.
INLINE_DROPPED = set("button select option textarea input iframe object canvas audio video svg noscript".split())
#: Elements that never close.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Names in class and id that mark such parts.
NAMES = (
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments reply replies respond disqus discussion pagination pager toolbar skip skiplink hidden copyright legal disclaimer search"
).split()
#: Such names that a part of an article's own text may have.
OWN_NAMES = set("legal header search".split())
WHOLE_NAMES = set(NAMES) - OWN_NAMES
COMMENT_NAMES = set("comment comments reply replies respond disqus discussion".split())
#: Roles that mark such parts.
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_RAW = re.compile(r"<!--|<!\[CDATA\[|<(script|style)\b|<[!?]", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)")
_MARK = re.compile(r"(?:^|[\s\"'])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"(?:^|[-_])(?:" + "|".join(NAMES) + r")(?:$|[-_])")
#: Names that tell whether the page has such a part, not that the element is one.
_LAYOUT = re.compile(r"(?:^|[-_])(?:no|has|with|without)[-_]|[-_](?:free|off|less|none)$")
_CONTENT = re.compile(r"^(?:(?:article|post|entry|story|main|page|blog)[-_]?)?(?:content|body|text)$|^(?:article|post|entry|story|main)$")
_POST = re.compile(r"^(?:article|post|entry|story|main)[-_]?(?:content|body|text)$")
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
_HEADING = re.compile(r"h[1-6]$")


def _without_raw(page: str) -> str:
    """The page with a space for each comment, script, style and declaration; what is cut off goes to the end.

    Every end is looked for once: where there is none, there is none further on either.
    """
    parts, at, closes = [], 0, True
    m = _RAW.search(page)
    while m:
        if m[0] in ("<!--", "<![CDATA[") or m[0].upper() == "<![CDATA[":
            mark = "-->" if m[0] == "<!--" else "]]>"
            end = page.find(mark, m.end())
            end = len(page) if end < 0 else end + len(mark)
        else:
            end = page.find(">", m.end()) + 1 if closes else 0
            closes = end > 0
            if end and m[1]:
                close = _RAW_END[m[1].lower()].search(page, end)
                end = close.end() if close else len(page)
        if end:
            parts += [page[at : m.start()], " "]
            at = end
        m = _RAW.search(page, end or m.end())
    return "".join([*parts, page[at:]])


def _marks(attributes: str, within: bool = False) -> tuple[int, bool, bool]:
    """(does it mark a part to drop: 2 by a whole name, 1 by part of a name; reader comments; the article's text); ``within`` an article only whole names mark a part."""
    drop, comments, content = 0, False, False
    for key, value in _MARK.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            for name in value.split():
                if _LAYOUT.search(name):
                    continue
                drop = max(drop, 2 if name in WHOLE_NAMES or not within and name in OWN_NAMES else 0 if within else int(bool(_NAME.search(name))))
                content |= bool(_CONTENT.match(name))
                comments |= not COMMENT_NAMES.isdisjoint(re.split("[-_]", name))
        elif key == "role":
            drop = 2 if value in ROLES else drop
        elif key == "style":
            drop = 2 if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else drop
        else:
            drop = 2 if key == "hidden" or value == "true" else drop
    return drop, comments, content and not drop


class Part:
    """A part that is marked as one to drop: where it lies, and what decides whether it is the page's own."""

    __slots__ = ("parent", "comments", "whole", "article", "heading", "mass", "dropped", "outside", "lines")

    def __init__(self, parent: int, comments: bool, whole: bool):
        self.parent, self.comments, self.whole = parent, comments, whole
        self.article = self.heading = self.dropped = False
        self.mass = self.outside = self.lines = 0  # own text; paragraphs, and lines, outside


class Lines:
    """The lines of a page: text, mass of link text, dropped or not, in a marked article (by element; by name) or not."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.links: list[int] = []
        self.dropped: list[bool] = []
        self.inside: list[bool] = []
        self.named: list[bool] = []
        self.held: list[int] = []  # the innermost marked part that a line is in; -1 without one
        self.parts: list[Part] = []
        self._names: list[list] = []  # open elements named as content, with their depth in elements of that kind
        self._open: list[tuple[str, int, int]] = []  # open block elements: name, the part that each begins or -1, articles open before
        self._count: dict[str, int] = {}
        self._part = -1
        self._parts: list[str] = []
        self._link = 0
        self._read(_without_raw(page))
        self._judge()

    def _flush(self, dropped: bool, inside: bool) -> None:
        text = " ".join(html.unescape("".join(self._parts)).split())
        if text:
            self.texts.append(text)
            self.links.append(self._link)
            self.dropped.append(dropped)
            self.inside.append(inside)
            self.held.append(self._part)
            self.named.append(bool(self._names))
        self._parts, self._link = [], 0

    def _pop(self, articles: int) -> int:
        name, part, before = self._open.pop()
        self._count[name] -= 1
        if part >= 0:
            self._part = self.parts[part].parent
        return before if part >= 0 or name in ("article", "main") else articles

    def _nest(self, name: str, closing: bool, articles: int) -> int:
        """Close what a block's tag closes; the number of open articles then. Each element is closed once, so this is linear over a page."""
        while self._open and (self._open[-1][0] == "p" or self._open[-1][0] == "li" and name in ("li", "ul", "ol") and (closing or name == "li")) and not (closing and name == self._open[-1][0]):
            articles = self._pop(articles)
        if closing and self._count.get(name):
            while self._open[-1][0] != name:
                articles = self._pop(articles)
            articles = self._pop(articles)
        return articles

    def _push(self, name: str, part: int, articles: int) -> None:
        self._open.append((name, part, articles))
        self._count[name] = self._count.get(name, 0) + 1

    def _read(self, page: str) -> None:
        """Read the lines and the marked parts."""
        skip, depth = "", 0  # the element whose part is dropped, and how deep in elements of its name
        inline, inner = "", 0  # the same for a part inside a line
        articles, heading, link, ends, at = 0, False, False, False, 0
        closed, opened = set(), -1  # starts of the <a> that a </a> closes before the next <a>
        for m in _ANCHOR.finditer(page):
            if m[1]:
                closed.add(opened)
            opened = -1 if m[1] else m.start()
        for m in _TAG.finditer(page):
            if not inline:
                self._text(page[at : m.start()], link)
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = name.lower()
            if inline:
                if name == inline and name not in VOID and not attributes.endswith("/"):
                    inner += -1 if closing else 1
                if not inner or (name in BLOCK and inline not in INLINE_DROPPED):
                    inline = ""
                if inline or name not in BLOCK:
                    continue
            if name == "br":
                self._parts.append(" ")
                continue
            if not skip and not closing and name not in VOID and name not in BLOCK and not attributes.endswith("/"):
                if name in INLINE_DROPPED or (attributes and name != "a" and _marks(attributes, articles > 0)[0]):
                    self._parts.append(" ")
                    inline, inner = name, 1
                    continue
            if (name in BLOCK or name in DROPPED) and name not in INLINE_DROPPED:
                self._flush(bool(skip) and not (skip == "header" and articles and heading), articles > 0)
                link = link and ends
            if name in ("td", "th"):
                self._parts.append(" ")
            if name == "a":
                link = not closing and bool(_HREF.search(attributes))
                ends = m.start() in closed
            if _HEADING.match(name):
                heading = not closing
                if name == "h1" and self._part >= 0 and not skip:
                    self.parts[self._part].heading = True
            if skip:
                if closing:
                    depth -= name == skip
                    if depth == 0 or (skip == "head" and name == "html"):
                        skip = ""
                elif name == skip and skip not in ("p", "li"):
                    depth += 1
                elif skip == "head" and name == "body" or skip == "p" and name in BLOCK or skip == "li" and name == "li":
                    skip = ""
                if skip or closing:
                    continue
            if name in BLOCK and name not in VOID:
                articles = self._nest(name, bool(closing), articles)
            if self._names and name == self._names[-1][0]:
                self._names[-1][1] += -1 if closing else 1
                if not self._names[-1][1]:
                    self._names.pop()
            if closing:
                continue
            drop, comments, content = _marks(attributes, articles > 0) if attributes else (0, False, False)
            if name in ("html", "body", "main"):
                drop = 0
            elif name == "article":
                drop = drop if comments else 0
            whole = name not in VOID and not attributes.endswith("/")
            if whole and (name in DROPPED or name == "header"):
                skip, depth = name, 1
                continue
            if name in BLOCK and whole:
                self._push(name, len(self.parts) if drop else -1, articles)
                if drop:
                    self.parts.append(Part(self._part, comments, drop == 2))
                    self._part = len(self.parts) - 1
            if name in ("article", "main") and not drop:
                articles += 1
                if self._part >= 0 and not comments:
                    self.parts[self._part].article = True
            elif content and name in BLOCK and name != "body":
                self._names.append([name, 1])
                if self._part >= 0 and not self.parts[self._part].comments and any(_POST.match(c) for _, v in _MARK.findall(attributes) for c in v.strip("\"'").lower().split()):
                    self.parts[self._part].article = True
        if not inline:
            self._text(page[at:], link)
        self._flush(bool(skip), articles > 0)

    def _judge(self) -> None:
        """Decide which marked parts go: those that are not the page's own text."""
        if not self.parts:
            return
        total, free = 0, [0, 0]
        for text, link, dropped, part in zip(self.texts, self.links, self.dropped, self.held):  # noqa: B905
            mass = 0 if dropped else max(0, len(text) - link)
            total += mass
            if part >= 0:
                self.parts[part].mass += mass
                self.parts[part].outside += mass >= PARAGRAPH
                self.parts[part].lines += mass > 0
            else:
                free = [free[0] + (mass >= PARAGRAPH), free[1] + (mass > 0)]
        # what lies outside of a part, but in no other part than those around it
        own = [(p.outside, p.lines) for p in self.parts]
        for p in self.parts:
            p.outside, p.lines = free if p.parent < 0 else (self.parts[p.parent].outside + own[p.parent][0], self.parts[p.parent].lines + own[p.parent][1])
        for p in reversed(self.parts):
            if p.parent >= 0:
                up = self.parts[p.parent]
                up.mass += p.mass
                up.article |= p.article and not p.comments
                up.heading |= p.heading
        for p in self.parts:
            most = p.mass > PART_SHARE * total
            alone = not p.whole and not (p.lines if p.comments else p.outside)
            p.dropped = not (most and (p.article or p.heading or alone)) or (p.parent >= 0 and self.parts[p.parent].dropped)
        self.dropped = [dropped or (part >= 0 and self.parts[part].dropped) for dropped, part in zip(self.dropped, self.held)]  # noqa: B905

    def _text(self, text: str, link: bool) -> None:
        if text:
            self._parts.append(text)
            if link:
                self._link += len(" ".join(html.unescape(text).split()))

    def masses(self) -> tuple[list[int], bool]:
        """The mass of every line, and whether the page marks its article."""
        own = [0 if dropped else len(text) for text, dropped in zip(self.texts, self.dropped)]  # noqa: B905
        for mark, share in ((self.inside, CONTENT_SHARE), (self.named, CONTENT_SHARE)):
            within = [mass if m else 0 for mass, m in zip(own, mark)]  # noqa: B905
            if sum(within) > share * sum(own):
                return within, True
        return [mass if link <= LINK_SHARE * mass else 0 for mass, link in zip(own, self.links)], False  # noqa: B905


def runs(masses: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first line, line after the last, peak) between each surge and dive of the windowed sums."""
    sums, total = [], 0
    for i, mass in enumerate(masses):
        total += mass - (masses[i - window] if i >= window else 0)
        sums.append(total)
    found, first, peak = [], None, 0
    for i, s in enumerate([*sums, 0]):
        if s and first is None:
            first, peak = i, s
        elif s:
            peak = max(peak, s)
        elif first is not None:
            found.append((first, i, peak))
            first = None
    return found


def main_text(page: str | None) -> str:
    lines = Lines(page or "")
    masses, marked = lines.masses()
    found = runs(masses)
    least = 0 if marked else PEAK_SHARE * max((peak for *_, peak in found), default=0)
    return "\n".join(lines.texts[i] for first, last, peak in found if peak >= least for i in range(first, last) if masses[i])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((main_text(x.as_py()) for x in batch.column(2)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    return pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"`{url_col}` as url", f"`{html_col}` as html").mapInArrow(run, "page_id long, url string, text string")
