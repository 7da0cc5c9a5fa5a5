"""Main text of web pages by nearest-URL page differencing.

A page becomes lines: one for each block of text, with the kind of place that it stands in (article, page furniture,
or neither). Within a host, pages are put in order of their URL path, and each page is paired with the neighbour in
that order whose path shares the longer beginning. The hashes of the two pages' lines are aligned by their longest
common subsequence; lines that both pages have in the same order are shared furniture and are deleted. Two things are
known from the markup. Lines inside a page's article always stay: articles share passages, and copies of an article under
several paths would delete each other. And lines that the alignment leaves, since no neighbour shares them or the page
has none, still go where an element is marked as menu, header, footer, sidebar, notice, advert, form or comments.

The order within a host comes from a range-partitioned sort with one boundary row for each partition, so a host that
holds a third of all pages is spread over many tasks; only hashes of lines travel to the partner, never its text.

Edge cases: null or empty html gives an empty text; a page that is alone on its host, or has no host, has no partner
and keeps all lines outside of furniture; equal pages, equal ids and null ids are handled row by row (rows are told
apart by their content, equal rows get equal results); unclosed elements end with the page; of partners whose paths are
equally near the one before is taken; an empty table gives an empty table; other columns are not read, whatever their
names; a very long page is read whole, and its alignment takes memory in proportion to its lines.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.arrow import possible, slices
from feedloom.shared import ship, small, written

# HTML elements by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "head"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "iframe"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
MAIN = {"article", "main"}
#: Words of a class, id or role that mark an element as furniture, and as the main part.
_FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|newsletter|subscri\w*|share|social|sidebar|side|widget|related|recommend\w*|"
    r"nav\w*|menu|breadcrumbs?|site-header|masthead|footer|copyright|comments?|replies|discussion|disqus|popup|modal|overlay|toolbar|pagination|pager|login|search|form|alert|complementary|contentinfo|navigation)(?:$|[\s_-])"
)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_ENDS = {name: re.compile(f"</{name}", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")
ARTICLE, ELSEWHERE, OUT = 2, 1, 0


class Tags:
    """The tags of a page, one after the other, in time proportional to the page.

    A ``>`` inside quotes doesn't end a tag; where a quote is never closed, the tag ends at the next ``>`` after its name.
    Quotes that are known not to lead to an end are not followed again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.hopeless = page, page.rfind(">"), set()

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes start at ``at``, or -1."""
        page, opened, pos = self.page, [], at
        while True:
            pos = _PLAIN.match(page, pos).end()
            if pos < len(page) and page[pos] == ">":
                return pos
            closed = page.find(page[pos], pos + 1) if pos < len(page) and pos not in self.hopeless else -1
            if closed < 0:
                self.hopeless.update(opened)
                if pos < len(page):
                    self.hopeless.add(pos)
                return page.find(">", at)
            opened.append(pos)
            pos = closed + 1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name (lower case; empty for comments and declarations), closing, and attributes of the next tag from ``at``."""
        page = self.page
        while (start := page.find("<", at)) >= 0 and start < self.last:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if page[start + 1] in "!?":
                return start, page.find(">", start) + 1, "", False, ""
            if found := _NAME.match(page, start + 1):
                end = self._end(found.end())
                return start, end + 1, found[2].lower(), bool(found[1]), page[found.end() : end]
            at = start + 1
        if start >= 0 and (comment := page.find("<!--", at)) >= 0:
            return comment, len(page), "", False, ""
        return None


def lines(page: str | None) -> list[tuple[str, int]]:
    """Blocks of text of a page, in order, with where they stand: in the article, elsewhere, or in furniture."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that change the place: name, place outside
    opened: Counter[str] = Counter()  # how many elements of a name are in the stack
    place, at = ELSEWHERE, 0

    def flush():
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((text, place))

    page = page or ""
    tags = Tags(page)
    while tag := tags.next(at):
        held.append(page[at : tag[0]])
        _, at, name, closing, attributes = tag
        if not name:
            continue
        if name in RAW and not closing:
            flush()
            if name == "head":
                stack.append((name, place))
                opened[name] += 1
                place = OUT
            elif not attributes.rstrip().endswith("/"):  # what follows is no markup until the element's own end
                end = _ENDS[name].search(page, at)
                at = end.start() if end else len(page)
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            held.append(" ")
        if closing:
            while opened[name]:
                last, place = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name == "body" and stack and stack[0][0] == "head":  # a head that was not closed
            place = stack[0][1]
            stack.clear()
            opened.clear()
        marks = " ".join(x or y or z for x, y, z in _NAMES.findall(attributes)).lower() if attributes else ""
        new = place
        if place != OUT:
            if name in FURNITURE and not (name == "header" and place == ARTICLE) or marks and _FURNITURE_NAME.search(marks) and name not in ("body", "html", *MAIN) or attributes and _HIDDEN.search(attributes):
                new = OUT
            elif name in MAIN or "articlebody" in attributes.lower():
                new = ARTICLE
        if name in INLINE and new == place:
            continue  # an inline element that changes nothing need not be followed
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and new == place:
            continue  # ends by itself
        if new != place and name in INLINE:
            flush()
        stack.append((name, place))
        opened[name] += 1
        place = new
    held.append(page[at:])
    flush()
    return out


def kept_lines(found: list[tuple[str, int]], shared: set[int]) -> list[str]:
    """The lines of the main text: those of the article, and others that the alignment did not find on the neighbour and
    that the markup does not call furniture."""
    return [text for i, (text, place) in enumerate(found) if place == ARTICLE or (i not in shared and place != OUT)]


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of ``a`` in one longest common subsequence of two arrays of hashes."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    own = np.flatnonzero(np.isin(x, y)).tolist()  # only lines that both have can be matched
    x, y = x[own], y[np.isin(y, x)]
    found = [own[i] + start for i in _common(x, y)]
    return np.array([*range(start), *found, *range(len(a) - end, len(a))], np.int64)


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` and each beginning of ``y``."""
    best = np.zeros(len(y) + 1, np.int32)
    for value in x:
        best[1:] = np.maximum.accumulate(np.maximum(best[:-1] + (y == value), best[1:]))
    return best


def _common(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of ``x`` in one longest common subsequence: the problem is halved where the two halves' lengths add up to
    the most, so that only single rows of the table are held."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            if (y[c:d] == x[a]).any():
                out.append(a)
            continue
        middle = (a + b) // 2
        cut = c + int(np.argmax(_row(x[a:middle], y[c:d]) + _row(x[a:b][::-1][: b - middle], y[c:d][::-1])[::-1]))
        todo += [(middle, b, cut, d), (a, middle, c, cut)]
    return sorted(out)


def url_host(url: Column) -> Column:
    """Host in lower case without a leading ``www.`` or ``m.``; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def neighbours(keys: DataFrame) -> DataFrame:
    """row and partner: the page before or after in (host, path) order on the same host, whichever path is nearer.

    Every partition of the range-partitioned order puts out its rows and its first and last one; those few boundary
    rows, one pair a partition, link the partitions.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(i, i + n))], ["host", "path", "row", "part", "i"])
            i += n

    order = keys.select("host", "path", "row").distinct().repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    placed = written(order.mapInArrow(run, "host string, path string, row long, part int, i long"), "url-order")
    # Blocks of an ordered partition, so that a window never holds more than BLOCK rows and its two edges.
    block = F.floor(F.col("i") / BLOCK)
    edges = placed.groupBy("part", block.alias("block")).agg(F.max(F.struct("i", "host", "path", "row")).alias("last"), F.min(F.struct("i", "host", "path", "row")).alias("first"))
    line = Window.orderBy("part", "block")
    edges = edges.select("part", "block", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    inside = Window.partitionBy("part", "block").orderBy("i")
    rows = placed.withColumn("block", block).join(small(edges), ["part", "block"])
    me = F.struct(F.col("host"), F.col("path"), F.col("row"))
    rows = rows.withColumn("up", F.coalesce(F.lag(me).over(inside), F.struct("before.host", "before.path", "before.row"))).withColumn("down", F.coalesce(F.lead(me).over(inside), F.struct("after.host", "after.path", "after.row")))

    def near(other: str) -> Column:
        """Length of the shared beginning of two paths, or -1 on another host."""
        length = F.least(F.length("path"), F.length(F.col(f"{other}.path")))
        first = F.array_position(F.zip_with(F.split("path", ""), F.split(F.col(f"{other}.path"), ""), lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        return F.when(F.col(f"{other}.host") == F.col("host"), F.when(first == 0, length).otherwise(first - 1)).otherwise(-1)

    up, down = F.coalesce(near("up"), F.lit(-1)), F.coalesce(near("down"), F.lit(-1))
    partner = F.when((up < 0) & (down < 0), None).when(up >= down, F.col("up.row")).otherwise(F.col("down.row"))
    return rows.where("host != ''").select("row", partner.alias("partner")).where("partner IS NOT NULL")


BLOCK = 4096


def _hashes(found: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(text) - (1 << 63) for text, _ in found]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    keyed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.xxhash64(F.col(page_id), F.col(url), F.col(html)).alias("row"))

    def hashed(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for some in slices(texts):
                part = batch.slice(some.start, some.stop - some.start)
                found = [lines(x) for x in texts[some]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([_hashes(x) for x in found], pa.list_(pa.int64()))], ["row", "host", "path", "hashes"])

    marks = keyed.select("row", "html", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    marks = written(marks.mapInArrow(hashed, "row long, host string, path string, hashes array<long>"), "page-lines").dropDuplicates(["row"])
    pairs = neighbours(marks)

    def aligned(batches):
        for batch in batches:
            rows = [np.unique(matched(np.array(a, np.int64), np.array(b, np.int64))).tolist() for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["row", "shared"])

    partner = marks.select(F.col("row").alias("partner"), F.col("hashes").alias("other"))
    shared = marks.join(pairs, "row").join(partner, "partner").select("row", "hashes", "other").mapInArrow(aligned, "row long, shared array<int>")
    shared = written(shared.where(F.size("shared") > 0), "shared-lines")

    def joined(batches):
        for batch in batches:
            texts, drops = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for some in slices(texts):
                part = batch.slice(some.start, some.stop - some.start)
                out = []
                for page, drop in zip(texts[some], drops[some], strict=True):
                    out.append("\n".join(kept_lines(lines(page), set(drop or ()))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # Only pages that may have lines to delete meet the list of them; the others' html stays where it is.
    rows = possible(keyed, shared).join(shared, "row", "left").select("page_id", "url", "html", "shared")
    rows = rows.union(possible(keyed, shared, inside=False).select("page_id", "url", "html", F.lit(None).cast("array<int>")))
    kind = pages.schema[page_id].dataType.simpleString()
    return rows.mapInArrow(joined, f"page_id {kind}, url string, text string, n_chars long")
