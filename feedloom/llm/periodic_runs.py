"""Periodic runs of words: maximal stretches that repeat their first q words at least four times, by multi-scale minimizers.

A run is a stretch of words [s, s + L) with smallest period q, L >= max(6, 4 q), that can't be extended on either side.
For a scale w (a power of two) every position has the hash of the w words from there (made by doubling), and the
positions that are the leftmost least of some w / 2 neighbouring ones are the scale's minimizers. Let w be the least
power of two with w >= q. Inside the run two equal hashes of w >= q words are a multiple of q apart (else the overlap
would have a smaller period, by Fine and Wilf), and the minimizers repeat after q, since L >= 4 q leaves room for a
window and its copy. So some minimizer and the next one of equal hash are exactly q apart: each such pair seeds a lag,
and words that are equal at that lag extend it both ways to the whole run. Periods up to ``SHORT`` are found by
comparing the text with itself at each lag. Nothing is missed at any length, and what a seed finds is checked on words.

Texts are worked on together: their words become numbers, a number of its own parts two texts, and a scale looks only
at texts that are long enough for its periods.

Edge cases: a null or empty text, and one of white space, has no words and no runs, and its collapsed text is empty;
equal rows are worked on each for themselves; other columns are kept, but for those with the name of a result column,
which it replaces; an empty table gives no rows; a very long text is read whole, in memory in proportion to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.arrow import slices, with_columns, without
from feedloom.shared import ship

#: Periods up to this are found at each lag; must be a power of two.
SHORT = 8
#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: The columns that the operator adds.
ADDED = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "binary"}

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least of each ``width`` (a power of two) neighbouring values."""
    at = np.arange(len(values), dtype=np.int64)
    step = 1
    while step < width and len(at) > step:
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        step *= 2
    return at


def _stretches(codes: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of words that are equal ``lag`` apart (their end without the last lag)."""
    same = np.zeros(max(len(codes) - lag, 0) + 2, np.int8)
    same[1:-1] = codes[lag:] == codes[: len(codes) - lag] if len(codes) > lag else []
    turns = np.flatnonzero(np.diff(same))
    return turns[::2], turns[1::2]


def _extent(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch around a place whose words equal those ``lag`` later: its start, and its end with the last lag."""
    start, step = at, 64
    while start > 0:
        low = max(start - step, 0)
        other = np.flatnonzero(codes[low:start] != codes[low + lag : start + lag])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, step = low, step * 2
    end, step, last = at, 64, len(codes) - lag
    while end < last:
        high = min(end + step, last)
        other = np.flatnonzero(codes[end:high] != codes[end + lag : high + lag])
        if len(other):
            end += int(other[0])
            break
        end, step = high, step * 2
    return start, end + lag


def _seeds(gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of minimizers and their distance to the next minimizer of equal hash, where it is in (width / 2, width]."""
    marks = np.unique(_least(gram, width // 2))
    order = marks[np.argsort(gram[marks], kind="stable")]
    gap = np.diff(order)
    fits = np.flatnonzero((gram[order[1:]] == gram[order[:-1]]) & (gap > width // 2) & (gap <= width))
    return order[fits], gap[fits]


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' numbers after each other, parted by numbers that occur once, and where each text starts."""
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    all_codes = np.empty(starts[-1], np.int64)
    for i, x in enumerate(texts):
        all_codes[starts[i] : starts[i] + len(x)] = x
        all_codes[starts[i] + len(x)] = -1 - i
    return all_codes, starts[:-1]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """start, length and period of every run of each text (numbers of words, none below zero), by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]

    def keep(starts: np.ndarray, begin: int, end: int, lag: int, names: list[int]):
        if end - begin < max(LEAST, TIMES * lag):
            return
        text = int(np.searchsorted(starts, begin, "right")) - 1
        own, key = found[names[text]], (begin - int(starts[text]), end - begin)
        own[key] = min(own.get(key, lag), lag)  # a stretch counts with its smallest period

    names = [i for i, x in enumerate(texts) if len(x) >= LEAST]
    codes, starts = _joined([texts[i] for i in names])
    for lag in range(1, SHORT + 1):
        begins, ends = _stretches(codes, lag)
        long = ends + lag - begins >= max(LEAST, TIMES * lag)
        for begin, end in zip(begins[long].tolist(), (ends[long] + lag).tolist(), strict=True):
            keep(starts, begin, end, lag, names)
    width = 2 * SHORT
    while True:
        names = [i for i in names if len(texts[i]) >= TIMES * (width // 2 + 1)]
        if not names:
            break
        codes, starts = _joined([texts[i] for i in names])
        gram, size = codes.astype(np.uint64) * _MIX, 1
        while size < width:
            gram = (gram[: len(gram) - size] ^ (gram[: len(gram) - size] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (gram[size:] ^ (gram[size:] >> np.uint64(32))) * _MIX
            size *= 2
        places, lags = _seeds(gram, width)
        reached: dict[int, int] = {}  # the end of the last stretch of each lag; seeds inside it are in it
        for i in np.lexsort((places, lags)).tolist():
            at, lag = int(places[i]), int(lags[i])
            if at + lag < reached.get(lag, 0):
                continue
            begin, end = _extent(codes, at, lag)
            reached[lag] = end
            keep(starts, begin, end, lag, names)
        width *= 2
    return [sorted((s, n, q) for (s, n), q in own.items()) for own in found]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; of equal ones that of the smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def split_words(text: str | None) -> list[bytes]:
    """Words parted by ASCII white space, as UTF-8."""
    return text.encode(errors="replace").split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers: equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter([known.setdefault(x, len(known)) for x in words], np.int64, len(words))


#: What may be done to the words' places before runs are looked for: (row's key, number of words) to the word at each place.
Change = Callable[[object, int], np.ndarray | None]


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """Places of the words of a text into which one document in ten gets a repetition, by the checksum of its id (null: none)."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def detect(df: DataFrame, doc_id: str = "doc_id", text: str = "text", change: Change | None = None) -> DataFrame:
    """``df`` without its text, with n_runs, the strongest run (start, length, period, exponent_milli), all runs, and the
    text collapsed: its words without those that repeat an earlier period, joined by one space, as UTF-8.

    ``change`` gives, for a row's ``doc_id`` and number of words, the places of the words that the text is taken to have
    (None: as it is).
    """
    ship(df.sparkSession)
    kept = without(df.drop(text), *ADDED)
    names = kept.columns
    key = "_key" if "_key" not in names else "_key_of_row"
    rows = df.select(*[f"`{c}`" for c in names], F.col(f"`{doc_id}`").alias(key), F.col(f"`{text}`").alias(f"{key}_text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            for part in slices(texts):
                words = [split_words(x) for x in texts[part]]
                codes = [numbered(x) for x in words]
                if change:
                    for i, name in enumerate(keys[part]):
                        if (at := change(name, len(words[i]))) is not None:
                            codes[i], own = codes[i][at], words[i]
                            words[i] = [own[j] for j in at.tolist()]
                runs = runs_of(codes)
                best = [strongest(x) for x in runs]
                collapsed = [b" ".join(w if not r else [x for x, stays in zip(w, kept_words(len(w), r).tolist(), strict=True) if stays]) for w, r in zip(words, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(part.start, part.stop - part.start).columns[: len(names)],
                        pa.array([len(x) for x in runs], pa.int64()),
                        *[pa.array([x and x[i] for x in best], pa.int64()) for i in range(3)],
                        pa.array([x and 1000 * x[1] // x[2] for x in best], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        pa.array(collapsed, pa.binary()),
                    ],
                    [*names, *ADDED],
                )

    return rows.mapInArrow(run, with_columns(kept, *(f"{name} {kind}" for name, kind in ADDED.items())))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", change: Change | None = planted) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of every row."""
    found = detect(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), change=change)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
