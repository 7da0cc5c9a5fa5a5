"""Small helpers for operators that run on Arrow batches inside Spark partitions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text (or bytes), and texts, that are worked on together, so that a batch of very long texts stays small.
CHARS_A_BATCH, ROWS_A_BATCH = 2_000_000, 4096
#: Bytes, about, that a dictionary of solved pieces may hold before it starts anew, and what an entry costs beside its content.
CACHE_BYTES, ENTRY_BYTES = 100_000_000, 200
#: Bytes, about, that the two generations of :class:`Solved` may hold; as many as the fuller kind has on average.
KEPT_BYTES = 50_000_000


def slices(texts: list, most: int = CHARS_A_BATCH) -> Iterator[slice]:
    """Parts of a batch with about ``most`` characters (or bytes) each, and ``ROWS_A_BATCH`` texts at most."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most or i + 1 - start >= ROWS_A_BATCH:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def cuts(text: str | None, most: int = CHARS_A_BATCH) -> Iterator[str]:
    """A text in parts of about ``most`` characters that were parted by single spaces."""
    start = 0
    while text and start <= len(text):
        end = text.find(" ", start + most) if start + most < len(text) else -1
        yield text[start : len(text) if end < 0 else end]
        start = (len(text) if end < 0 else end) + 1


def with_columns(df: DataFrame, *more: str) -> str:
    """The schema of ``df`` and more columns, as mapInArrow takes it."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that have the name of one that an operator adds (in any case of letters): the operator's stays."""
    own = {x.lower() for x in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in own])


#: The columns of :func:`row_key`.
KEY = ["row", "row2"]


def row_key(*columns: Column) -> list[Column]:
    """128 bits, in two columns, that tell rows of different content apart."""
    return [F.xxhash64(*columns).alias("row"), F.xxhash64(F.lit(20_240_229), *columns, F.lit(7)).alias("row2")]


def kept_apart(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of each row, and the row as a struct ``doc``, so that no column's name clashes."""
    return df.select(*row_key(F.col(doc_id), F.col(text)), F.struct(*[f"`{c}`" for c in df.columns]).alias("doc"))


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """What this Python worker keeps between tasks: the last thing asked for, and nothing of an earlier operator."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what this Python worker keeps for an earlier operator, and of the pages that its allocators keep of earlier tasks."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


class Solved:
    """What has been solved, in two generations of half of ``most`` bytes each: what is asked for again moves on to the younger
    one, and what isn't goes with the older one, so that frequent pieces stay and memory is bounded."""

    def __init__(self, most: int):
        self.most, self.known, self.older, self.size = most, {}, {}, 0

    def turn(self) -> None:
        """Drop the older generation if the younger one is full; only between batches, as lookups are made in ``known``."""
        if self.size > self.most / 2:
            self.known, self.older, self.size = {}, self.known, 0

    def missing(self, asked: set[str]) -> list[str]:
        """Those of ``asked`` that are to be solved; all others are in ``known`` now."""
        left = asked.difference(self.known)
        if self.older:
            find = self.older.get
            again = {x: y for x in left if (y := find(x)) is not None}
            self.add(again)
            left.difference_update(again)
        return list(left)

    def add(self, found: dict[str, bytes]) -> None:
        self.known.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)


class PieceCache:
    """What a function of a piece of text gives, for pieces between single spaces; solved once while it is kept.

    ``solve`` takes a list of new pieces and returns a list of bytes. It must be a function for which the result of a
    text is that of its pieces, put one after the other. What is kept is bounded in bytes.
    """

    def __init__(self, solve: Callable[[list[str]], list[bytes]], most: int = KEPT_BYTES):
        self.solve, self.kept = solve, Solved(most)

    def _learn(self, texts: list[list[str]]) -> None:
        self.kept.turn()
        new = self.kept.missing(set().union(*texts))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.kept.add(dict(zip(part, self.solve(part), strict=True)))

    def run(self, texts: list[str | None]) -> list[bytes]:
        if sum(len(x) for x in texts if x) > 2 * CHARS_A_BATCH:  # very long texts go part by part
            return [b"".join([self._some([part])[0] for part in cuts(x)]) for x in texts]
        return self._some(texts)

    def _some(self, texts: list[str | None]) -> list[bytes]:
        cut = [text.split(" ") if text else [] for text in texts]
        self._learn(cut)
        find = self.kept.known.__getitem__
        return [b"".join(map(find, pieces)) for pieces in cut]


#: Words of 64 bits of the filter of :func:`possible`; a broadcast of that many rows at most.
FILTER_WORDS = 2**18


def possible(df: DataFrame, keys: DataFrame, inside: bool = True, key: str = "row") -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys`` (or, not ``inside``, those for which that is ruled out).

    A bitmap of hash buckets, 64 a row, is broadcast: ``FILTER_WORDS`` rows at most, whatever the number of keys. It keeps
    most texts out of the shuffle of the exact join that has to follow; with very many keys it lets more pass.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(64 * FILTER_WORDS))
    word, bit = F.shiftright(bucket, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (bucket % 64).cast("int"))
    bits = keys.select(word.alias("filter_word"), bit.alias("bit")).groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits"))
    found = df.select("*", word.alias("filter_word")).join(F.broadcast(bits), "filter_word", "inner" if inside else "left")
    hit = F.coalesce(F.col("filter_bits"), F.lit(0)).bitwiseAND(bit) != 0
    return found.where(hit if inside else ~hit).select(*df.columns)


def except_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose key is not among ``gone``; only rows that may be meet ``gone`` in a shuffled join.

    An outer join, since an anti join would be moved below the filter and shuffle every row.
    """
    marked = gone.select(*KEY, F.lit(True).alias("is_gone"))
    left = possible(rows, gone).join(marked, KEY, "left").where("is_gone IS NULL").select(*rows.columns)
    return possible(rows, gone, inside=False).union(left)
