"""Operator 8: main text of pages by consensus host paths.

Score. Each page's containers (article, main, section, div, ...) get the
length of the text they hold outside links and boilerplate; the parent and
grandparent get a half and a quarter. A container is named by its generalised
path: tags from the root with their classes, digits dropped. From its best
container a page climbs to the parent while the parent's other text stands
mostly outside links (to the body only for text of some weight, never out of
an article or main element), and votes for the path it comes to.

Vote. Votes are added up by (host, path) in Spark, combined before the
shuffle, and every host's path with most votes wins.

Re-extract. Each page is read again with its host's winning path and gives the
blocks inside the containers of that path; a page that has no such container,
or none with text, uses its own. The table of winners (a row for each host) is
broadcast only if counted below ``BROADCAST_HOSTS``; beyond that Spark joins
it, and may split a host that holds a large share of the pages.

Boilerplate. Scripts, styles, navigation, page headers and footers, asides and
form controls never count nor appear. A class, id or role with a word of NOISE
and a form are a mark on their element, judged when the page is read whole: a
mark of layout (sidebar, header, form, ...) is ignored where the element holds
an article or main element or most of the page's text outside links, one of
adverts, notices or comments only where it holds nearly all of the text and an
article or main element. Names such as "no-sidebar" or "entry-header" are no
marks. A page that the marks leave without text is read without them.

Character references are decoded once, white space inside a block becomes one
space, blocks are joined by one space in page order; nothing is capped. Boxes
are numbered and paths interned, so memory is linear in the page.

Edge cases: null or empty html, or html without text, gives an empty text; a
page without any container is read as a whole; a null or odd url belongs to
the host ''; unclosed and stray tags are tolerated; repeated rows and null ids
have a row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featflow.llm.store import written

BROADCAST_HOSTS = 100_000

#: Elements that may be the main container; others that hold text (quotations, table cells) belong to theirs.
CONTAINERS = frozenset("article main section div body center".split())
SEMANTIC = {"article": 3.0, "main": 2.0}
BODY_SHARE = 0.25           # of a container's text that the body must hold beside it to be climbed to
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
#: Elements whose content is never main text.
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title nav aside footer button "
                    "select option textarea dialog menu".split())
#: Elements marked like a layout word.
MARKED = frozenset("form fieldset".split())
#: Words of a class, id or role that mark boilerplate: parts of a layout, and what never belongs to an article.
LAYOUT = frozenset("banner breadcrumb breadcrumbs footer header login masthead menu modal nav navbar navigation overlay pager pagination popup "
                   "search share sharing sidebar signup social toolbar widget widgets".split())
FOREIGN = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookies disclaimer disqus gdpr newsletter "
                    "notice notices notification promo promoted promotion recommended related respond sponsor sponsored subscribe "
                    "subscription".split())
#: A name that begins so tells what a page has, or which part of an article it is.
NO_MARK = re.compile(r"(?:has|no|not|with|without|hide|hides|show|shows|is|js|entry|post|article|story|content|page)[-_]")
#: Elements that the start of another one closes.
CLOSES_P = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
                     "section table ul".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)
                     |<(script|style|textarea|title|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)
                     |<!\[CDATA\[(.*?)(?:\]\]>|\Z)
                     |<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+>|[^>]*(?:>|\Z))
                     |<[!?][^>]*(?:>|\Z)""", re.S | re.I | re.X)
NAMES = re.compile(r"""\b(class|id|role|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")


def named(attributes: str) -> tuple[str, int]:
    """Generalised class of a tag ('' without one), and its mark: 0 none, 1
    layout, 2 foreign to any article."""
    if "=" not in attributes:
        return "", 0
    label, mark = "", 0
    for m in NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        key = m[1].lower()
        if key == "class":
            label = ".".join(sorted({DIGITS.sub("", x) for x in value.replace(">", "").split()}))
        if key != "hidden":
            for name in value.split():
                words = WORDS.findall(name)
                if not FOREIGN.isdisjoint(words):
                    mark = 2
                elif not mark and not LAYOUT.isdisjoint(words) and not NO_MARK.match(name):
                    mark = 1
    return label, mark


class Page:
    """One reading of a page. Boxes are numbered in page order, 0 the page;
    each has its parent, its tag, the number of its path (0 for a box that
    takes no part in votes) and its mark. ``blocks`` are (box, text, length
    inside links)."""

    def __init__(self, source: str):
        self.parents, self.tags, self.path_of, self.marks = [-1], [""], [0], [0]
        self.names: dict[tuple[int, str], int] = {}             # (path, step) -> path
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)
        self._judge()

    def _box(self, parent: int, tag: str, path: int, mark: int) -> int:
        self.parents.append(parent)
        self.tags.append(tag)
        self.path_of.append(path)
        self.marks.append(mark)
        return len(self.parents) - 1

    def _path(self, path: int, step: str) -> int:
        found = self.names.get((path, step))
        if found is None:
            found = self.names[path, step] = len(self.steps)
            self.steps.append((path, step))
        return found

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]      # tag, box, dropped, path
        held: list[str] = []
        links, linked, at = 0, 0, 0
        open_tags: dict[str, int] = {}

        def text(raw: str) -> None:
            nonlocal linked
            if raw and not stack[-1][2]:
                held.append(raw)
                if links:
                    linked += len(raw)

        def flush() -> None:
            nonlocal linked
            if held:
                joined = " ".join(html.unescape("".join(held)).split())
                if joined:
                    self.blocks.append((stack[-1][1], joined, min(linked, len(joined))))
                held.clear()
            linked = 0

        def close(tag: str) -> None:
            nonlocal links
            if not open_tags.get(tag):
                return
            i = len(stack) - 1
            while stack[i][0] != tag:
                i -= 1
            gone = [t for t, *_ in stack[i:]]
            if any(t not in INLINE for t in gone):
                flush()
            for t in gone:
                open_tags[t] -= 1
            links = open_tags.get("a", 0)
            del stack[i:]

        for m in TOKEN.finditer(source):
            if m.start() > at:
                text(source[at:m.start()])
            at = m.end()
            if m[2] is not None:
                text(html.escape(m[2], quote=False))
            if m[4] is None:
                continue
            tag = m[4].lower()
            if m[3]:
                if tag == "br" or tag == "p" and not open_tags.get("p"):
                    flush()
                else:
                    close(tag)
                continue
            if tag not in INLINE:
                flush()
                if tag in CLOSES_P and open_tags.get("p"):
                    close("p")
                elif tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag:
                    close(tag)
            if tag in VOID or m[5].endswith("/>") and tag not in CONTAINERS:
                continue
            _, box, dropped, path = stack[-1]
            label, mark = named(m[5])
            if tag in ("body", "html", "article", "main"):
                mark = 0
            elif tag in MARKED:
                mark = max(mark, 1)
            dropped = dropped or tag in DROPPED or tag == "header" and not open_tags.get("article") or bool(mark) and tag in INLINE
            open_tags[tag] = open_tags.get(tag, 0) + 1
            links = open_tags.get("a", 0)
            if not dropped and (tag in CONTAINERS or mark):
                if tag in CONTAINERS:
                    path = self._path(path, f"{tag}.{label}" if label and tag != "body" else tag)     # a body's classes name the page
                box = self._box(box, tag, path if tag in CONTAINERS else 0, mark)
            stack.append((tag, box, dropped, path))
        if at < len(source):
            text(source[at:])
        flush()

    def _judge(self) -> None:
        """Which boxes are boilerplate, and each box's text left outside and inside links."""
        n = len(self.parents)
        plain, every, semantic = [0] * n, [0] * n, [False] * n
        foreign = [False] * n
        for b in range(1, n):
            foreign[b] = self.marks[b] == 2 or foreign[self.parents[b]]
        for b, t, linked in self.blocks:
            size = max(0, len(t) - 2 * linked)
            every[b] += size
            if not foreign[b]:
                plain[b] += size
        for b in range(n - 1, 0, -1):
            up = self.parents[b]
            plain[up] += plain[b]
            every[up] += every[b]
            semantic[up] = semantic[up] or semantic[b] or self.tags[b] in SEMANTIC
        noise = [False] * n
        for b in range(1, n):
            bad = self.marks[b] == 1 and not (semantic[b] or 2 * plain[b] > plain[0])
            bad = bad or self.marks[b] == 2 and not (semantic[b] and 10 * every[b] >= 9 * every[0])
            noise[b] = bad or noise[self.parents[b]]
        if all(noise[b] for b, *_ in self.blocks):
            noise = [False] * n
        self.noise = noise
        self.outside, self.linked = [0] * n, [0] * n
        for b, t, linked in self.blocks:
            if not noise[b]:
                self.outside[b] += len(t) - linked
                self.linked[b] += linked
        for b in range(n - 1, 0, -1):
            self.outside[self.parents[b]] += self.outside[b]
            self.linked[self.parents[b]] += self.linked[b]

    def _above(self, box: int) -> int:
        """The nearest container around a box, 0 without one."""
        box = self.parents[box]
        while box > 0 and not self.path_of[box]:
            box = self.parents[box]
        return max(box, 0)

    def votes(self) -> dict[int, float]:
        """Score by path number."""
        score: dict[int, float] = {}
        for b, t, linked in self.blocks:
            gain = max(0, len(t) - 2 * linked)
            if self.noise[b] or not gain:
                continue
            owner = b if self.path_of[b] else self._above(b)
            for share in (1.0, 0.5, 0.25):
                if not owner:
                    break
                score[owner] = score.get(owner, 0.0) + gain * share
                owner = self._above(owner)
        total: dict[int, float] = {}
        for b, s in score.items():
            total[self.path_of[b]] = total.get(self.path_of[b], 0.0) + s * SEMANTIC.get(self.tags[b], 1.0)
        return total

    def named_path(self, path: int) -> str:
        steps = []
        while path > 0:
            path, step = self.steps[path]
            steps.append(step)
        return ">".join(reversed(steps))

    def best(self) -> int:
        """The number of the path that the page votes for, 0 without one."""
        votes = self.votes()
        if not votes:
            return 0
        top = max(votes.values())
        path = min((p for p, v in votes.items() if v == top), key=lambda p: (len(self.named_path(p)), self.named_path(p)))
        box = max((b for b in range(len(self.parents)) if self.path_of[b] == path), key=lambda b: (self.outside[b], -b))
        while self.tags[box] not in SEMANTIC and self.tags[box] != "body":
            up = self._above(box)
            if not up:
                break
            beside, links = self.outside[up] - self.outside[box], self.linked[up] - self.linked[box]
            if beside <= links or self.tags[up] == "body" and beside < BODY_SHARE * self.outside[box]:
                break
            box = up
        return self.path_of[box]

    def number_of(self, name: str) -> int | None:
        """The number of a named path, None where the page has none such."""
        path = 0
        for step in name.split(">") if name else ():
            path = self.names.get((path, step), -1)
            if path < 0:
                return None
        return path

    def inside(self, path: int) -> str:
        """Blocks inside the containers of a path, in page order; of 0 all."""
        chosen = [not path] * len(self.parents)
        for b in range(1, len(chosen)):
            chosen[b] = self.path_of[b] == path or chosen[self.parents[b]]
        return " ".join(t for b, t, _ in self.blocks if chosen[b] and not self.noise[b])


def extract(source: str, winner: str | None) -> str:
    page = Page(source)
    path = page.number_of(winner) if winner else None
    return page.inside(path) if path and page.inside(path) else page.inside(page.best())


def voted(source: str) -> str:
    page = Page(source)
    return page.named_path(page.best())


def _best_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [voted(h) if h else "" for h in (x.as_py() for x in batch.column("html"))]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h, w) if h else "" for h, w in zip((x.as_py() for x in batch.column("html")), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes; ties go to the smaller path."""
    votes = pages.mapInArrow(_best_rows, "host string, path string").where("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path"))["path"].alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    winners = host_paths(own.select("host", "html"))
    winners, _ = written(winners, "host-paths")
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    read = own.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return read.mapInArrow(_text_rows, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
