"""Keyword search with an automaton: every keyword of a table is looked for in one pass over each text.

The keywords become an automaton of all of them (Aho-Corasick), which every Python worker builds once from a broadcast
list and runs over whole texts in Arrow batches; it gives the offsets of all occurrences, so nothing else looks at the
text again. A list holds ``CHARS`` characters of keywords at most; more keywords are cut into several lists, by a hash,
and a text passes one after the other. Texts aren't shuffled, exploded or joined, and no text meets a keyword that it
doesn't hold.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.shared import ship

#: Characters of keywords of one automaton (about 40 bytes each in a worker), and of texts that are looked through together.
CHARS, TEXTS = 2_000_000, 4_000_000
#: How an occurrence has to stand: as a whole word, not before a letter or digit (``tag``), or anywhere.
WORD, TAG, ANYWHERE = "word", "tag", "anywhere"
_AFTER_TAG = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a word begins or ends at both places."""
    left = start > 0 and _is_word(text[start - 1])
    right = end < len(text) and _is_word(text[end])
    return left != _is_word(text[start]) and right != _is_word(text[end - 1])


class Matcher:
    """An automaton of keywords, each with how it has to stand; in texts of one case."""

    def __init__(self, keywords: list[tuple[str, str]]):
        self.keywords, self.automaton, places = keywords, ahocorasick.Automaton(), {}
        for i, (keyword, _) in enumerate(keywords):
            if keyword:
                places.setdefault(keyword, []).append(i)
        for keyword, found in places.items():
            self.automaton.add_word(keyword, (len(keyword), found))
        self.automaton.make_automaton()

    def starts(self, text: str) -> dict[int, list[int]]:
        """Starts of the occurrences of each keyword found (by its place); those of one keyword don't overlap."""
        out: dict[int, list[int]] = {}
        if not len(self.automaton):
            return out
        for last, (size, places) in self.automaton.iter(text):
            start = last + 1 - size
            for i in places:
                stands = self.keywords[i][1]
                if stands == WORD and not _bounded(text, start, last + 1) or stands == TAG and last + 1 < len(text) and text[last + 1] in _AFTER_TAG:
                    continue
                found = out.setdefault(i, [])
                if not found or start >= found[-1] + size:
                    found.append(start)
        return out


class Search:
    """Keywords as they are and in lower case."""

    def __init__(self, rows: list[tuple[str, str, bool, str]]):
        self.rows = rows
        self.exact = Matcher([(k if cased else "", stands) for k, _, cased, stands in rows])
        self.lower = Matcher([("" if cased else k.lower(), stands) for k, _, cased, stands in rows])

    def spots(self, text: str) -> Iterator[tuple[int, list[int], str]]:
        """Place of each keyword found, its starts, and the text (as it is or in lower case) that they are places of."""
        for i, starts in self.exact.starts(text).items():
            yield i, starts, text
        low = text.lower()
        for i, starts in self.lower.starts(low).items():
            yield i, starts, low


class Cue:
    """A regular expression that is looked for around places of a text; ``stems`` are texts in lower case of which every
    match holds one, so that it is tried only where one stands."""

    def __init__(self, pattern: str, stems: list[str]):
        self.pattern, self.stems = re.compile(pattern), ahocorasick.Automaton()
        for stem in stems:
            self.stems.add_word(stem, len(stem))
        if stems:
            self.stems.make_automaton()

    def places(self, low: str) -> list[int] | None:
        """Starts of the stems in a text in lower case; None if they don't tell."""
        if not len(self.stems) or "\u017f" in low:  # the one letter whose lower case isn't the letter that it matches
            return None
        return sorted(last + 1 - size for last, size in self.stems.iter(low))

    def near(self, own: str, starts: list[int], size: int, around: int, places: list[int] | None) -> bool:
        for s in starts:
            first, last = max(s - around, 0), s + size + around
            if places is not None:
                i = bisect_left(places, first)
                if i == len(places) or places[i] >= last:
                    continue
            if self.pattern.search(own[first:last]):
                return True
        return False


_BUILT: dict[str, Search] = {}


def _search(shared) -> Search:
    """The automata of a broadcast list, made once in a worker."""
    key = shared.value[0]
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Search(shared.value[1])
    return _BUILT[key]


def _lists(keywords: DataFrame, stands: Callable[[str], tuple[bool, str]]) -> Iterator[list[tuple[str, str, bool, str]]]:
    """Lists of (keyword, kind, by case, how it stands), each of ``CHARS`` characters about."""
    rows = keywords.select("keyword", "kind").where("keyword <> ''").distinct()
    parts = 1 + (rows.agg(F.sum(F.char_length("keyword") + 8)).first()[0] or 0) // CHARS
    for i in range(parts):
        some = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("keyword", "kind"), F.lit(parts)) == i)
        yield [(r.keyword, r.kind, *stands(r.kind)) for r in some.orderBy("keyword", "kind").toLocalIterator()]


def standing(kind: str, tags: str = TAG) -> tuple[bool, str]:
    """Of a kind of keyword: whether case counts, and how it has to stand."""
    return kind == "case_sensitive", tags if kind == "cashtag" else WORD


def keyword_spots(docs: DataFrame, keywords: DataFrame, doc: str, head: Column | None, body: Column, stands: Callable[[str], tuple[bool, str]] = standing, near: str | None = None, stems: list[str] | None = None, around: int = 100) -> DataFrame:
    """``doc``, kind, keyword, starts, in_title and context: one row for each document and keyword (kind, keyword) found.

    The text is ``head``, a line end and ``body``, or ``body`` alone. starts are places in the text (in lower case unless the
    kind counts case), in_title says that an occurrence lies in ``head``, and context that ``near``, a regular expression, is
    found within ``around`` characters of one (see :class:`Cue` for ``stems``).
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc).alias(doc), (F.lit(None).cast("string") if head is None else head).alias("_head"), F.coalesce(body, F.lit("")).alias("_body"))
    kind = docs.schema[doc].dataType.simpleString()
    context, out = docs.sparkSession.sparkContext, None
    for some in _lists(keywords, stands):
        shared = context.broadcast((uuid.uuid4().hex, some))

        def run(batches, shared=shared) -> Iterator[pa.RecordBatch]:
            search, cue = _search(shared), Cue(near, stems or []) if near else None
            for batch in batches:
                at, found, size = [], [], 0
                for i, (title, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    text = body if title is None else f"{title}\n{body}"
                    ends, places = {}, False
                    for place, starts, own in search.spots(text):
                        keyword = search.rows[place]
                        n = len(keyword[0])
                        if id(own) not in ends:
                            ends[id(own)] = len(title if own is text else title.lower()) if title is not None else 0
                        if cue is not None and places is False:
                            low = text.lower()
                            places = cue.places(low) if len(low) == len(text) else None
                        cued = cue is not None and cue.near(own, starts, n, around, places)
                        at.append(i)
                        found.append((keyword[1], keyword[0], starts, starts[0] + n <= ends[id(own)], cued))
                        size += len(starts)
                    if size > TEXTS:
                        yield _batch(batch, at, found, doc)
                        at, found, size = [], [], 0
                yield _batch(batch, at, found, doc)

        part = rows.mapInArrow(run, f"`{doc}` {kind}, kind string, keyword string, starts array<int>, in_title boolean, context boolean")
        out = part if out is None else out.union(part)
    return out


def _batch(batch: pa.RecordBatch, at: list[int], found: list[tuple], doc: str) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.bool_()]
    columns = list(zip(*found, strict=True)) if found else [[]] * 5
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]], [doc, "kind", "keyword", "starts", "in_title", "context"])
