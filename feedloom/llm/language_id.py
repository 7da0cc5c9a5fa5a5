"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a distribution over the pieces of the vocabulary. The probability of a word under it is the sum over
all ways to cut the word into pieces of the product of their probabilities; a forward pass over the positions of the
word computes that sum. The text's score is the product over its words, and the answer is the language of the largest
posterior. Piece probabilities are fitted by expectation maximisation: forward and backward passes give the expected
count of each piece in each word, weighted by how often the word occurs in the language's texts.

The learning sample is bounded: at most ``SAMPLE`` texts of each language, chosen by the hash of their id, give word
counts (runs of more than ``PART`` letters count there as several words). Everything else covers every row: prediction
sees whole texts, and sums over all segmentations of every run of letters, whatever its length.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the smaller language name; with
no learnable row every text is ``und``; ids may be null or repeated (a sampled id stands for all its texts); equal
rows get equal results; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.arrow import CACHE_BYTES, CHARS_A_BATCH, ENTRY_BYTES, cuts, held, slices, with_columns
from feedloom.llm.labelled import lowest
from feedloom.shared import discard, ship, written

#: Texts of a language that are learned from.
SAMPLE = 4000
ROUNDS = 4
#: Letters up to which words share a matrix, words in one, and letters of a longer run that are looked up at once.
PART, WORDS_A_MATRIX, LETTERS_AT_ONCE = 32, 4000, 20_000
FLOOR = 1e-7
_letters = regex.compile(r"\p{L}+").findall


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def vocabulary(model: bytes) -> list[str]:
    """Pieces of letters of a SentencePiece model, without word marks, and all single letters' stand-in ``?``."""
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = {own.id_to_piece(i).replace("▁", "").lower() for i in range(own.get_piece_size())}
    return ["?", *sorted(x for x in pieces if x.isalpha())]


class Lattice:
    """Pieces by hash, and sums over the segmentations of words."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        keys = np.array([self._key(x) for x in pieces], np.uint64)
        self.bits, self.probes = 20, 1
        # An open table: a key is in its slot or in one of the next.
        self.table = np.zeros((1 << self.bits) + 64, np.uint64)
        self.value = np.full((1 << self.bits) + 64, -1, np.int32)
        for i, key in enumerate(keys.tolist()):
            at = first = key >> (64 - self.bits)
            while self.value[at] >= 0:
                at += 1
            self.table[at], self.value[at] = key, i
            self.probes = max(self.probes, at - first + 1)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)
            h ^= h >> 29
        return h

    @staticmethod
    def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Hashes of pieces with one letter more."""
        h = (h + codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.where(self.table[at] == keys, self.value[at], -1)
        for i in range(1, self.probes):
            found = np.where((self.table[at + i] == keys) & (found < 0), self.value[at + i], found)
        return found

    def arcs(self, words: list[str]) -> tuple[np.ndarray, list[list[np.ndarray | None]]]:
        """Lengths of the words and, by end position and piece length, the piece ids (-1 or None: no such piece)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(lens.max())
        codes = np.zeros((len(words), longest), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        codes[np.arange(longest)[None, :] < lens[:, None]] = flat
        out: list[list] = [[None] * min(self.longest, end) for end in range(1, longest + 1)]
        for start in range(longest):
            h = np.zeros(len(words), np.uint64)
            for size in range(1, min(self.longest, longest - start) + 1):
                h = self._step(h, codes[:, start + size - 1])
                ids = self._find(h)
                if size == 1:
                    ids[ids < 0] = 0  # an unknown letter is the stand-in
                if size == 1 or (ids >= 0).any():
                    out[start + size - 1][size - 1] = ids
        return lens, out

    def forward(self, arcs: list[list[np.ndarray | None]], p: np.ndarray) -> np.ndarray:
        """alpha[position, word, language] for piece probabilities p[piece, language]; the last row of p is 0."""
        alpha = np.zeros((len(arcs) + 1, len(arcs[0][0]), p.shape[1]))
        alpha[0] = 1
        for end, row in enumerate(arcs, 1):
            for size, ids in enumerate(row, 1):
                if ids is not None:
                    alpha[end] += alpha[end - size] * p[ids]
        return alpha

    def log_sums(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations, [word, language], for words of at most ``PART`` letters."""
        out = np.zeros((len(words), p.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(order), WORDS_A_MATRIX):
            some = order[k : k + WORDS_A_MATRIX]
            lens, arcs = self.arcs([words[i] for i in some])
            out[some] = np.log(np.maximum(self.forward(arcs, p)[lens, np.arange(len(some))], 1e-300))
        return out

    def log_sum_long(self, word: str, p: np.ndarray) -> np.ndarray:
        """As above, [language], for one run of letters of any length: forward sums of the last positions, rescaled."""
        codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
        total, ahead = np.zeros(p.shape[1]), np.zeros((self.longest + 1, p.shape[1]))  # ahead[i]: sum up to i letters on
        ahead[0] = 1
        for first in range(0, len(codes), LETTERS_AT_ONCE):
            starts = np.arange(first, min(first + LETTERS_AT_ONCE, len(codes)))
            ids, h = np.full((len(starts), self.longest), -1, np.int32), np.zeros(len(starts), np.uint64)
            for size in range(1, self.longest + 1):
                inside = starts + size <= len(codes)
                h = self._step(h, codes[np.minimum(starts + size - 1, len(codes) - 1)])
                ids[inside, size - 1] = self._find(h[inside])
            ids[:, 0] = np.maximum(ids[:, 0], 0)
            for row in p[ids]:
                ahead[1:] += ahead[0] * row
                ahead[:-1] = ahead[1:]
                ahead[-1] = 0
                top = ahead.max(axis=0)
                if top.min() < 1e-200:
                    total += np.log(top)
                    ahead /= top
        return total + np.log(np.maximum(ahead[0], 1e-300))

    def expected(self, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected count of each piece in words with their weights, for the piece probabilities of one language."""
        out = np.zeros(self.n + 1)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(order), WORDS_A_MATRIX):
            some = order[k : k + WORDS_A_MATRIX]
            lens, arcs = self.arcs([words[i] for i in some])
            weight, at = weights[some], np.arange(len(some))
            alpha = self.forward(arcs, p[:, None])[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[lens, at] = 1
            weight = weight / np.maximum(alpha[lens, at], 1e-300)
            for end in range(len(arcs), 0, -1):
                for size, ids in enumerate(arcs[end - 1], 1):
                    if ids is not None:
                        arc = p[ids] * beta[end]
                        out += np.bincount(ids % (self.n + 1), weights=alpha[end - size] * arc * weight, minlength=self.n + 1)
                        beta[end - size] += arc
        out[-1] = 0
        return out


def parts(text: str) -> list[str]:
    """Runs of letters of a text in lower case, cut into parts of at most ``PART`` letters (for fitting only)."""
    found = _letters(text.lower())
    return [y for x in found for y in ([x] if len(x) <= PART else [x[i : i + PART] for i in range(0, len(x), PART)])]


def learned_counts(df: DataFrame, doc_id: str, text: str, lang: str, sample: int = SAMPLE) -> DataFrame:
    """lang, word and n: how often each word occurs in a bounded sample of the rows that may be learned from."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id)).alias("h"), F.col(doc_id).alias("id"))
    chosen = lowest(rows, "lang", sample, "id").select("lang", "id").distinct()  # narrow rows: no text moves before the sample is chosen
    texts = df.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(chosen), (texts["id"].eqNullSafe(chosen["id"])) & (texts["lang"] == chosen["lang"]), "left_semi")

    def run(batches):
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in parts(body or ""):
                    found[name, word] = found.get((name, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _e_step(model):
    """The function of mapInArrow that gives the expected counts of words (lang, word, n) under a broadcast model."""

    def run(batches):
        pieces, p, langs = model.value
        own = held(("lattice", hashlib.sha256("\n".join(pieces).encode()).digest()), lambda: Lattice(pieces))
        total = np.zeros_like(p)
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for k, lang in enumerate(langs):
                if len(some := np.flatnonzero(names == lang)):
                    total[:, k] += own.expected([words[i] for i in some.tolist()], n[some], np.ascontiguousarray(p[:, k]))
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], ["piece", "k", "n"])

    return run


def fit(counts: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> tuple[np.ndarray, list[str]]:
    """Piece probabilities [piece + 1, language] by expectation maximisation (the last row is 0), and the languages.

    The expected counts of a round come from tasks over the words; what meets in the driver is a number for each piece
    and language.
    """
    spark = counts.sparkSession
    langs = sorted(row.lang for row in counts.select("lang").distinct().collect())
    p = np.full((len(pieces) + 1, len(langs)), 1 / len(pieces))
    p[-1] = 0
    for _ in range(rounds if langs else 0):
        step = _e_step(spark.sparkContext.broadcast((pieces, p, langs)))
        found = counts.mapInArrow(step, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()  # pieces x languages at most
        p = np.zeros_like(p)
        p[found["piece"], found["k"]] = found["n"]
        p /= np.maximum(p.sum(axis=0, keepdims=True), 1e-300)
        p[:-1] = np.maximum(p[:-1], FLOOR)
    return p, langs


class Scorer:
    """Posterior of each language for texts; what words score is kept while it fits."""

    def __init__(self, lattice: Lattice, p: np.ndarray, langs: list[str]):
        self.lattice, self.p, self.langs, self.known, self.size = lattice, p, langs, {}, 0

    def _sums(self, texts: list[str]) -> list[tuple[np.ndarray | None, bool]]:
        """Log sums of each text and whether it has a letter."""
        cut = [_letters(x.lower()) for x in texts]
        new = [x for x in set().union(*cut).difference(self.known) if len(x) <= PART]
        if new:
            self.known.update(zip(new, self.lattice.log_sums(new, self.p).view(f"V{8 * len(self.langs)}").ravel().tolist(), strict=True))
            self.size += sum(map(len, new)) + (8 * len(self.langs) + ENTRY_BYTES) * len(new)
        out = []
        for words in cut:
            total = np.zeros(len(self.langs))
            if words:
                short = [x for x in map(self.known.get, words) if x is not None]
                total = np.frombuffer(b"".join(short), np.float64).reshape(-1, len(self.langs)).sum(axis=0)
                if len(short) < len(words):
                    total = total + sum(self.lattice.log_sum_long(x, self.p) for x in words if len(x) > PART)
            out.append((total, bool(words)))
        return out

    def run(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.size > CACHE_BYTES:
            self.known, self.size = {}, 0
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        if sum(len(x) for x in texts if x) > 2 * CHARS_A_BATCH:  # very long texts go part by part
            found = []
            for x in texts:
                some = [self._sums([y])[0] for y in cuts(x)]
                found.append((sum((t for t, _ in some), np.zeros(len(self.langs))), any(y for _, y in some)))
        else:
            found = self._sums([x or "" for x in texts])
        out = []
        for total, letters in found:
            if not letters:
                out.append(("und", 0.0))
                continue
            weight = np.exp(total - total.max())
            best = int(np.argmax(weight))
            out.append((self.langs[best], float(weight[best] / weight.sum())))
        return out


def identify(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from rows that aren't held out."""
    spark = df.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        pieces = vocabulary(f.read())
    counts = written(learned_counts(df, doc_id, text, lang), "word-counts")
    p, langs = fit(counts, pieces)
    discard(counts)
    model = spark.sparkContext.broadcast((pieces, p, langs))  # pieces x languages: a few MB

    def run(batches):
        pieces, p, langs = model.value
        own = held(("language", hashlib.sha256(p.tobytes()).digest()), lambda: Scorer(Lattice(pieces), p, langs))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for some in slices(texts):
                found = own.run(texts[some])
                part = batch.slice(some.start, some.stop - some.start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = df.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, with_columns(rows.select("doc_id", "held_out"), "lang_pred string", "score double"))
