"""Main text of web pages by consensus paths per host.

First pass: each page is parsed, its containers are scored by the paragraphs
they hold, and the page votes for the tag-class paths of its best containers.
Spark sums the votes per host and path and takes each host's best path. Second
pass: each page is parsed again and the text of the containers on its host's
path, each widened to the article or main element around it, is taken; a page without such a container, or with no text there, falls
back to its own best container, then to its body.

The path gives way where a page's own best container has more than ``FAR_BETTER`` times the points.

Left out everywhere: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments of readers, and markup. Forms and what only its name marks stay where they hold most of the page's
text: they wrap the article then. Comments of readers and cookie notices go in any case.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Containers of a page that get a vote, best first.
VOTES_PER_PAGE = 3

# HTML element names by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav footer aside script style noscript template iframe button select option textarea svg canvas object dialog menu head title input".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
#: Words in class, id or role names that mark what is left out.
DROPPED_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar
    navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay
    newsletter subscribe signup comment comments respond disqus share sharing social related recommended widget
    pagination pager toolbar login complementary contentinfo search""".split()
)
SITE_HEADERS = frozenset("header site-header page-header siteheader pageheader topbar top-bar".split())
KEPT_TAGS = frozenset("html body main article".split())
GOOD_NAMES = frozenset("article content main post entry story body text".split())

#: Words that mark what is left out whatever it holds; elements by the other words stay if they hold most of the page's text.
ALWAYS_DROPPED = frozenset("comment comments respond disqus cookie cookies consent gdpr".split())
#: How many times the points of the host's path a page's own best container needs to be taken instead.
FAR_BETTER = 3
#: Points of text that an element of a doubtful name must hold to stay; a paragraph has two to five.
WRAPS = 5

_START = re.compile(r"""<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/><"']*))""")
_PLAIN = re.compile(r"""[^"'>]*""")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
#: Values of attributes; what is left are their names, among them perhaps ``hidden`` itself.
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN_NAME = re.compile(r"(?<![\w:@.-])hidden(?![\w:@.-])", re.I)
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def tokens(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Start, end, name (None for what is no element), whether it closes, and attributes of each piece of markup; linear in the text.

    The generator takes the place to go on from by ``send``. A quote that is not closed, or
    that is closed only by the quote that opens another value, is a plain character.
    """
    at, size, never = 0, len(source), set()
    while found := _START.search(source, at):
        start, end, name = found.start(), found.end(), None
        if found[1] or found[2]:
            end = source.find("-->" if found[1] else "]]>", end)
            end = size if end < 0 else end + 3
        elif found[3]:
            end = source.find(">", end) + 1
        else:
            name, end = found[5].lower(), _tag_end(source, end, never)
        if not end:
            return  # no ">" from here on: the rest is text
        go_on = yield start, end, name, bool(found[4]), source[found.end() : end - 1] if name else ""
        at = end if go_on is None else go_on


def _tag_end(source: str, at: int, never: set[str]) -> int:
    """The place after the ">" of a tag, 0 if there is none; ``never`` keeps the quotes that do not come again."""
    while True:
        at = _PLAIN.match(source, at).end()
        if at >= len(source):
            return 0
        quote = source[at]
        if quote == ">":
            return at + 1
        close = -1 if quote in never else source.find(quote, at + 1)
        if close < 0:
            never.add(quote)
        if close < 0 or (source[close + 1 : close + 2].strip() and source[close + 1] not in "/>"):
            return source.find(">", at) + 1
        at = close + 1


class Page:
    """Elements and text blocks of one page, in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.dropped = ["html"], [-1], [()], [False]
        #: elements that stay only if they hold most of the text
        self.doubtful = [False]
        #: (element, text, characters in links)
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._text, self._link_chars = [0], [], 0
        self._parse(source)
        self._settle()

    def _parse(self, source: str) -> None:
        at, size = 0, len(source)
        lowered = None
        links = 0
        found = tokens(source)
        token = next(found, None)
        while token:
            start, end, name, closes, attributes = token
            if start > at:
                self._add(source[at:start], links)
            at = end
            if name is not None and closes:
                if name == "a":
                    links = max(0, links - 1)
                self._close(name)
            elif name is not None:
                self._open(name, attributes)
                if name == "a":
                    links = 1
                if name in RAW:
                    lowered = lowered if lowered is not None else source.lower()
                    end = lowered.find("</" + name, at) if len(lowered) == size else self._find(source, name, at)
                    end = size if end < 0 else end
                    if name in DROPPED:
                        at = end
                    else:
                        self._add(source[at:end], links)
                        at = end
            try:
                token = found.send(at)
            except StopIteration:
                token = None
        if at < size:
            self._add(source[at:], links)
        self._flush()

    def _settle(self) -> None:
        """Drop the doubtful elements and what lies in them, but for those that must wrap the article.

        Such an element holds more than half of the points of the page's text, at least ``WRAPS``,
        and the page's article and main elements, if any holds text, lie in it.
        """
        if any(self.doubtful):
            held, articles = [0.0] * len(self.tag), [0] * len(self.tag)
            for at, text, link_chars in self.blocks:
                held[at] += _value(text, link_chars)
                up = at
                while up > 0 and self.tag[up] not in ("article", "main"):
                    up = self.parent[up]
                articles[up] += up > 0
            for i in range(len(self.tag) - 1, 0, -1):
                held[self.parent[i]] += held[i]
                articles[self.parent[i]] += articles[i]
            for i in range(1, len(self.tag)):
                wraps = 2 * held[i] > held[0] and held[i] >= WRAPS and articles[i] == articles[0]
                self.dropped[i] = self.dropped[i] or (self.doubtful[i] and not wraps) or self.dropped[self.parent[i]]
            self.blocks = [b for b in self.blocks if not self.dropped[b[0]]]

    @staticmethod
    def _find(source: str, name: str, at: int) -> int:
        found = re.compile("</" + name, re.I).search(source, at)
        return found.start() if found else -1

    def _add(self, text: str, links: int) -> None:
        if not self.dropped[self._stack[-1]]:
            self._text.append(text)
            if links:
                self._link_chars += len(text)

    def _flush(self) -> None:
        if self._text:
            text = "".join(self._text)
            text = " ".join((html_lib.unescape(text) if "&" in text else text).split())
            if text:
                at = self._stack[-1]
                while self.tag[at] in INLINE:
                    at = self.parent[at]
                self.blocks.append((at, text, self._link_chars))
            self._text, self._link_chars = [], 0

    def _pop_to(self, depth: int) -> None:
        if any(self.tag[i] not in INLINE for i in self._stack[depth:]):
            self._flush()
        del self._stack[depth:]

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self._add(" ", 0)
            return
        if name not in INLINE:
            self._flush()
        if name in VOID:
            return
        if name in CLOSES_P:
            for k in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[k]]
                if tag == "p":
                    self._pop_to(k)
                    break
                if tag not in INLINE:
                    break
        if name in CLOSED_BY_SAME:
            for k in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[k]]
                if tag in CLOSED_BY_SAME[name]:
                    self._pop_to(k)
                    break
                if tag in SCOPE[name]:
                    break
        if name in ("html", "body") and (name == "html" or "body" in (self.tag[i] for i in self._stack)):
            return
        up = self._stack[-1]
        names: tuple[str, ...] = ()
        hidden = doubtful = False
        if attributes:
            found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _NAMES.finditer(attributes)]
            names = tuple(w for key, value in found if key == "class" for w in value.split())
            others = tuple(w for key, value in found if key != "class" for w in value.split())
            if name not in KEPT_TAGS:
                marked = [w for w in names + others if _is_dropped_name(w)]
                sure = any(not ALWAYS_DROPPED.isdisjoint(re.split(r"[-_]", w)) for w in marked)
                hidden = _is_hidden(attributes) or sure or bool(marked and name in INLINE)
                doubtful = bool(marked)
        if name == "header":
            doubtful = doubtful or not any(self.tag[i] in ("article", "main") for i in self._stack)
        doubtful = doubtful or name == "form"
        self.tag.append(name)
        self.parent.append(up)
        self.names.append(names)
        self.dropped.append(self.dropped[up] or name in DROPPED or hidden)
        self.doubtful.append(doubtful)
        self._stack.append(len(self.tag) - 1)

    def _close(self, name: str) -> None:
        if name == "p" and not any(self.tag[i] == "p" for i in self._stack):
            self._flush()
            return
        if name in ("html", "body"):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag == name:
                self._pop_to(k)
                return
            if name in INLINE and tag not in INLINE:
                return
            if tag in ("td", "th", "table") and name not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot"):
                return

    def path(self, at: int) -> str:
        """Tags and classes from the body down, digits removed."""
        steps = []
        while at > 0:
            classes = sorted({w for w in (re.sub(r"\d+", "", n).strip("-_") for n in self.names[at]) if w})
            if self.tag[at] not in ("html", "body", "head"):
                steps.append(".".join([self.tag[at], *classes]))
            at = self.parent[at]
        return ">".join(reversed(steps))

    def scores(self) -> dict[int, float]:
        """Points of each container: a paragraph counts for its container, half for the one above."""
        points: dict[int, float] = {}
        for at, text, link_chars in self.blocks:
            value = _value(text, link_chars)
            if not value:
                continue
            holder = at
            while holder > 0 and self.tag[holder] in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "ul", "ol", "dd", "dt", "dl"):
                holder = self.parent[holder]
            for share in (1.0, 0.5, 0.25):
                points[holder] = points.get(holder, 0) + value * share
                holder = self.parent[holder]
                if holder < 0:
                    break
        for at in points:
            if self.tag[at] in ("article", "main"):
                points[at] *= 2
            elif any(set(re.split(r"[-_]", n)) & GOOD_NAMES for n in self.names[at]):
                points[at] *= 1.5
        return points

    def text_of(self, roots: list[int]) -> str:
        inside = [False] * len(self.tag)
        chosen = set(roots)
        for i in range(len(self.tag)):
            inside[i] = i in chosen or (self.parent[i] >= 0 and inside[self.parent[i]])
        return "\n".join(text for at, text, _ in self.blocks if inside[at])

    def whole(self, at: int) -> int:
        """The article around a container, or else the main element, or else the container: headline, lead and sections lie beside it."""
        main, up = at, at
        while up > 0:
            if self.tag[up] == "article":
                return up
            if self.tag[up] == "main":
                main = up
            up = self.parent[up]
        return main

    def main_text(self, path: str | None) -> str:
        points = self.scores()
        best = max(points, key=lambda i: (points[i], -i)) if points else None
        if path:
            on_path = [i for i in range(len(self.tag)) if not self.dropped[i] and self.path(i) == path]
            if best is None or points[best] <= FAR_BETTER * sum(points.get(i, 0) for i in on_path):
                text = self.text_of([self.whole(i) for i in on_path])
                if text:
                    return text
        if best is not None:
            return self.text_of([self.whole(best)])
        articles = [i for i in range(len(self.tag)) if self.tag[i] in ("article", "main") and not self.dropped[i]]
        return self.text_of(articles) or self.text_of([0])


def _value(text: str, link_chars: int) -> float:
    """Points of a block: its words, commas and length outside of links; short ones have none."""
    own = len(text) - min(len(text), link_chars)
    return (1 + text.count(",") + min(own / 100, 3)) * own / len(text) if own >= 25 else 0.0


def _is_hidden(attributes: str) -> bool:
    """The words ``hidden`` of ``class`` and ``overflow:hidden`` of ``style`` hide nothing."""
    return bool(_HIDDEN.search(attributes)) or ("hidden" in attributes.lower() and bool(_HIDDEN_NAME.search(_VALUE.sub("= ", attributes))))


def _is_dropped_name(name: str) -> bool:
    words = re.split(r"[-_]", name)
    for k, word in enumerate(words):
        if word in ("has", "with", "no", "without", "js"):  # what follows is said of something else
            words = words[:k]
            break
    return name in SITE_HEADERS or not DROPPED_NAMES.isdisjoint(words)


def votes(pages: DataFrame, per_page: int = VOTES_PER_PAGE) -> DataFrame:
    """``host, path, vote``: each page's best containers; its votes sum to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(source.as_py() or "")
                best = sorted(page.scores().items(), key=lambda x: (-x[1], x[0]))[:per_page]
                total = sum(v for _, v in best) or 1.0
                rows += [(host_of(url), page.path(at), v / total) for at, v in best]
            hosts, paths, values = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(values, pa.float64())], ["host", "path", "vote"])

    return map_arrow(pages.select("url", "html"), run, "host string, path string, vote double")


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the path with most votes, the smaller one of equals."""
    summed = votes(pages).groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    best = summed.groupBy("host").agg(F.max(F.struct(F.round("votes", 6).alias("votes"), -F.length("path"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, path`` for every row of ``pages`` (``page_id``, ``url``, ``html``).

    Blocks of text are joined by a line feed, white space within a block becomes
    one space, character references are decoded. A null or empty html has an
    empty text, a null url the empty host. Rows that repeat a page are extracted
    row by row; other columns are not read; an empty table gives no rows.
    """
    winners = cut(host_paths(pages), "host-paths")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    joined = pages.select("page_id", "url", "html", host.alias("host")).join(winners, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source.as_py() or "").main_text(path) for source, path in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)],
                ["page_id", "url", "text", "n_chars", "path"],
            )

    return map_arrow(joined, run, "page_id long, url string, text string, n_chars long, path string")
