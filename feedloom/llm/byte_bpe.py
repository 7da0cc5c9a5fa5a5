"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark partitions.

Encoding cuts each text into the matches of the tokenizer's pattern. The distinct matches of an Arrow batch
become (word, position, token) rows; a recursive query joins neighbouring tokens with the merge table and
contracts the leftmost pair of least rank of every word, together with pairs that no merge of a lower rank can ever
reach, until no word has a pair left. Decoding joins every id
with the vocabulary and puts the pieces together by an aggregation ordered by position. The encoder keeps the
words that it has solved in dictionaries of bounded size, so a repeated word costs one lookup; the dictionaries' keys are
pieces between spaces, without the punctuation and line breaks at their ends.

Edge cases: null and empty texts give no ids; repeated rows are encoded each for themselves; an empty table gives an
empty table; columns of the input with the name of a result's column give way to it. Very long texts are encoded part
by part. A word longer than ``LONG`` bytes is first cut between bytes that stand side by side in no vocabulary entry
(no merge can cross there); its remaining long parts are contracted in overlapping windows (all equal pairs of a window
in one round where that is provably the same as one by one) that are put together where two windows have the same
token. So a word of any length takes memory in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedloom.llm.arrow import CHARS_A_BATCH, KEPT_BYTES, Solved, held, slices, with_columns, without
from feedloom.shared import ship

#: Words, and bytes of words, in one recursive query; tokens in one query that decodes. The memory that a query takes stays with
#: the worker, so queries are small.
WORDS_A_QUERY, BYTES_A_QUERY = 30_000, 250_000
TOKENS_A_QUERY = 200_000
#: New pieces that are solved together.
PIECES_AT_ONCE = 25_000
LONG = 64

#: A space inside or at the end of a run of white space, where cutting before each space would change matches.
_RUN = re.compile(r" (?<=\s )(?:\s|\Z)")
#: A space between two other characters, before which a text may be cut.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Marks a piece that doesn't follow a space; texts that have this character themselves aren't cut into pieces.
BARE = "\x01"
#: Punctuation between a letter or digit and white space or the end, and a line break between two characters that are no
#: white space. Each is a match of its own (no match crosses its ends), so words are solved once and not once for each mark.
_MARK = re.compile(r"[!-/:-@\[-`{-~](?<=[0-9A-Za-zÀ-ÖØ-öø-ɏ].)[!-/:-@\[-`{-~]*(?=[ \n]|\Z)")
_LINE = re.compile(r"\n(?<=[!-~À-ÖØ-öø-ɏ]\n)(?=[!-~À-ÖØ-öø-ɏ])")

_START = """
 SELECT w, pos, tok, lead(tok) OVER x AS nt, lead(pos) OVER x AS np, true AS going FROM start
 WINDOW x AS (PARTITION BY w ORDER BY pos)"""

#: One round contracts the leftmost pair of least rank of each word (k packs rank and position) and, with it, every pair
#: whose rank is below that of any merge that could ever cross its left or its right end (pairs.c, see RankCodec). Such a
#: pair stays as it is until its turn comes, so taking it early changes nothing, and no two taken pairs share a token.
#: A key is the word's number and the byte's position; windows without an order of their own read the rows as r sorts them.
_LEFTMOST = """
WITH RECURSIVE s AS (
 SELECT key, tok, nt, true AS going FROM start
 UNION ALL
 (WITH q AS (SELECT key, tok, nt, m, coalesce(c, 2147483647) AS c FROM (SELECT * FROM s WHERE going) live LEFT JOIN pairs ON ab = (tok::BIGINT << 32 | nt)),
  best AS (SELECT key >> 23 AS w, min((m::BIGINT << 23) | (key & 8388607)) AS k FROM q WHERE m IS NOT NULL GROUP BY ALL),
  r AS (SELECT key, tok, m, c, k FROM q LEFT JOIN best ON w = key >> 23 ORDER BY key),
  h AS (SELECT key, tok, m, k IS NOT NULL AS going,
               coalesce(m < lag(c) OVER () AND m < lead(c) OVER () OR k = (m::BIGINT << 23) | (key & 8388607), false) AS here FROM r),
  t AS (SELECT key, going, lag(here, 1, false) OVER () AS gone, CASE WHEN here THEN m ELSE tok END AS tok FROM h)
  SELECT key, tok, CASE WHEN key >> 23 = lead(key >> 23) OVER () THEN lead(tok) OVER () END, going FROM t WHERE NOT gone))
SELECT (key >> 23)::INT AS w, tok FROM s WHERE NOT going ORDER BY key"""

#: As above for long words: every pair equal to the best one, each second of overlapping ones, goes in one round if
#: no merge with the new token has a lower rank (merges.calm); else only the leftmost.
_TOGETHER = f"""
WITH RECURSIVE s AS ({_START}
 UNION ALL
 (WITH r AS (SELECT w, pos, tok, nt, np, m, calm FROM (SELECT * FROM s WHERE going) q LEFT JOIN merges ON a = tok AND b = nt),
  best AS (SELECT w, min(m) AS m FROM r WHERE m IS NOT NULL GROUP BY w),
  hit AS (SELECT r.w, r.pos, r.np, r.m, r.calm, lag(r.np) OVER (PARTITION BY r.w ORDER BY r.pos) IS NOT DISTINCT FROM r.pos AS touches
          FROM r JOIN best ON best.w = r.w AND best.m = r.m),
  run AS (SELECT *, sum(CASE WHEN touches THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY pos) AS n FROM hit),
  nth AS (SELECT *, row_number() OVER (PARTITION BY w, n ORDER BY pos) AS i, row_number() OVER (PARTITION BY w ORDER BY pos) AS first FROM run),
  take AS (SELECT w, pos AS spot, np AS gone, m AS mt FROM nth WHERE CASE WHEN calm THEN i % 2 = 1 ELSE first = 1 END),
  left_over AS (SELECT r.w, r.pos, CASE WHEN t.spot IS NULL THEN r.tok ELSE t.mt END AS tok, b.w IS NOT NULL AS going
          FROM r LEFT JOIN take t ON t.w = r.w AND t.spot = r.pos LEFT JOIN best b ON b.w = r.w
          WHERE NOT EXISTS (SELECT 1 FROM take d WHERE d.w = r.w AND d.gone = r.pos))
  SELECT w, pos, tok, lead(tok) OVER x, lead(pos) OVER x, going FROM left_over WINDOW x AS (PARTITION BY w ORDER BY pos)))
SELECT w, tok FROM s WHERE NOT going ORDER BY w, pos"""

#: The aggregate takes the rows as they are sorted: one thread reads them, in their order.
_PIECES = """
SELECT w, string_agg(piece, '') AS text FROM (SELECT w, pos, piece FROM tokens JOIN vocabulary USING (id) ORDER BY pos) GROUP BY w ORDER BY w"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the content of a rank file (base64 token and rank on each line)."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if rank}


def parts_of(text: str, most: int = CHARS_A_BATCH) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut where no match of the pattern can cross."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + most)
        yield text[start : cut.start() if cut else len(text)]
        start = cut.start() if cut else len(text)


def pieces_of(text: str) -> list[str]:
    """The pieces of a text without runs of white space: its matches, put together, are those of its pieces.

    A piece follows a space, or begins with ``BARE`` and follows nothing.
    """
    return (BARE + _LINE.sub(f" {BARE}\n {BARE}", _MARK.sub(rf" {BARE}\g<0>", text))).split(" ")


class RankCodec:
    """Merge table and vocabulary of one rank file in an in-memory DuckDB, with what has been solved so far."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = read_ranks(rank_file)
        rows = [
            (left, right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        ]
        a, b, m = np.array(rows, np.int32).reshape(-1, 3).T
        rough = set(a[m < a].tolist()) | set(b[m < b].tolist())  # tokens that a merge of a lower rank takes in
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._table("merges", {"a": a, "b": b, "m": m, "calm": np.array([x not in rough for x in m.tolist()], bool)})
        # For tokens a and b side by side: m, what they merge into, and c, the least rank of any merge of a token that ends
        # with a and one that starts with b. No other merge can ever cross the place between the two.
        ends = [(i, ranks[t[x:]]) for t, i in ranks.items() for x in range(len(t)) if t[x:] in ranks]
        starts = [(i, ranks[t[:x]]) for t, i in ranks.items() for x in range(1, len(t) + 1) if t[:x] in ranks]
        for name, found in (("ends", ends), ("starts", starts)):
            whole, piece = np.array(found, np.int32).reshape(-1, 2).T
            self._table(name, {"whole": whole, "piece": piece})
        self.db.execute(
            "CREATE TABLE pairs AS SELECT a::BIGINT << 32 | b AS ab, m, c FROM (SELECT e.piece AS a, t.piece AS b, min(m) AS c FROM merges"
            " JOIN ends e ON e.whole = merges.a JOIN starts t ON t.whole = merges.b GROUP BY e.piece, t.piece) LEFT JOIN merges USING (a, b)"
        )
        self.db.execute("DROP TABLE ends")
        self.db.execute("DROP TABLE starts")
        # Bytes 01 to 7F as their own characters, others as U+0100 and the byte: text that the database can put together and
        # that has no NUL; the low byte of each character is the byte.
        self._table(
            "vocabulary",
            {"id": np.fromiter(ranks.values(), np.int32), "piece": pa.array(["".join(chr(x if 0 < x < 128 else 256 + x) for x in t) for t in ranks])},
        )
        self.byte_id = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        joined = {t[i : i + 2] for t in ranks for i in range(len(t) - 1)}
        self.joined = np.zeros((256, 256), bool)
        for x, y in joined:
            self.joined[x, y] = True
        # White space as the rank files' own library has it: the Unicode property, without the separators 1C to 1F.
        self.matches = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.length = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))
        # Nearly all that is solved are pieces of one match.
        self.words, self.pieces = Solved(KEPT_BYTES // 10), Solved(KEPT_BYTES * 7 // 10)

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, sql: str, name: str, columns: dict) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contract(self, parts: list[bytes], sql: str) -> tuple[bytes, list[int]]:
        """Ids of all parts, one part after the other, as little-endian 32-bit integers, and the bytes at which parts begin and end.

        The recursive query takes ``WORDS_A_QUERY`` parts or ``BYTES_A_QUERY`` bytes at a time.
        """
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        total = np.cumsum(sizes)
        out, cuts = [], [np.zeros(1, np.int64)]
        at = done = 0
        while at < len(parts):
            end = int(np.searchsorted(total, total[at] - sizes[at] + BYTES_A_QUERY))
            end = max(at + 1, min(end, at + WORDS_A_QUERY))
            lens = sizes[at:end]
            ends = np.cumsum(lens)
            tokens = self.byte_id[np.frombuffer(b"".join(parts[at:end]), np.uint8)]
            after = np.append(tokens[1:], np.int32(-1))
            after[ends - 1] = -1
            word = np.repeat(np.arange(end - at, dtype=np.int32), lens)
            pos = (np.arange(len(tokens)) - np.repeat(ends - lens, lens)).astype(np.int32)
            start = {"w": word, "pos": pos} if sql is _TOGETHER else {"key": word.astype(np.int64) << 23 | pos, "nt": after}
            found = self._ask(sql, "start", {"tok": tokens, **start})
            flat, word = (found.column(x).to_numpy() for x in ("tok", "w"))
            ends = np.searchsorted(word, np.arange(end - at), "right")
            if (np.diff(np.append(0, np.cumsum(self.length[flat])[ends - 1])) != lens).any():
                raise RuntimeError("tokens of a word don't have its length")
            out.append(flat.astype("<u4").tobytes())
            cuts.append(4 * (done + ends))
            at, done = end, done + len(flat)
        return b"".join(out), np.concatenate(cuts).tolist()

    def _stitched(self, part: bytes, width: int, found: dict[bytes, np.ndarray]) -> np.ndarray | None:
        """Ids of a part from those of its overlapping windows, or None if two windows agree on no token.

        A sequence of tokens is what contraction gives if each two neighbours are what contraction gives for their own
        bytes: the first merge across a token border would also happen with the two alone. Where two windows have the
        same token at the same place, the left window's tokens up to it and the right window's from it on are such a
        sequence.
        """
        out, left, begins, taken = [], None, None, 0
        for start in range(0, max(len(part) - width // 2, 1), width // 2):
            ids = found[part[start : start + width]]
            size = self.length[ids]
            place = start + np.cumsum(size) - size
            if left is not None:
                _, i, j = np.intersect1d(begins, place, assume_unique=True, return_indices=True)
                same = np.flatnonzero(left[i] == ids[j])
                if not len(same):
                    return None
                middle = same[len(same) // 2]
                out.append(left[taken : i[middle]])
                taken = int(j[middle])
            left, begins = ids, place
        return np.concatenate([*out, left[taken:]])

    def _long(self, parts: set[bytes]) -> dict[bytes, bytes]:
        """Ids of parts of more than ``LONG`` bytes: by windows, wider ones for parts whose windows don't fit together."""
        done: dict[bytes, bytes] = {}
        todo, width = sorted(parts), 2 * LONG
        while todo:
            windows = sorted({part[i : i + width] for part in todo for i in range(0, max(len(part) - width // 2, 1), width // 2)})
            flat, cuts = self._contract(windows, _TOGETHER)
            found = dict(zip(windows, [np.frombuffer(flat[x:y], "<u4") for x, y in pairwise(cuts)], strict=True))
            left = []
            for part in todo:
                ids = self._stitched(part, width, found)
                if ids is None:
                    left.append(part)
                else:
                    done[part] = ids.astype("<u4").tobytes()
            todo, width = left, 8 * width
        return done

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        coded = [x.encode() for x in words]
        short = [i for i, x in enumerate(coded) if len(x) <= LONG]
        flat, cuts = self._contract([coded[i] for i in short], _LEFTMOST)
        solved = dict(zip([words[i] for i in short], [flat[x:y] for x, y in pairwise(cuts)], strict=True))
        if len(short) == len(words):
            return solved
        parts, spans = [], []
        for word, data in zip(words, coded, strict=True):
            if len(data) > LONG:
                codes = np.frombuffer(data, np.uint8)
                cuts = [0, *(np.flatnonzero(~self.joined[codes[:-1], codes[1:]]) + 1).tolist(), len(data)]
                spans.append((word, len(parts), len(parts) + len(cuts) - 1))
                parts += [data[x:y] for x, y in pairwise(cuts)]
        few = sorted({x for x in parts if len(x) <= LONG})
        flat, cuts = self._contract(few, _LEFTMOST)
        done = dict(zip(few, [flat[x:y] for x, y in pairwise(cuts)], strict=True)) | self._long({x for x in parts if len(x) > LONG})
        return solved | {word: b"".join([done[part] for part in parts[x:y]]) for word, x, y in spans}

    def _solve(self, pieces: list[str]) -> None:
        """Ids of new pieces from those of their words. Words that are a whole piece are kept as such only."""
        for i in range(0, len(pieces), PIECES_AT_ONCE):
            some = pieces[i : i + PIECES_AT_ONCE]
            letters = [x for x in some if x.isalpha()]
            words = self.matches(" " + " ".join(letters)) if letters else []
            if len(words) != len(letters):  # a pattern that cuts between letters
                letters, words = [], []
            others = some if not letters else [x for x in some if not x.isalpha()]
            found = list(map(self.matches, [x[1:] if x.startswith(BARE) else " " + x for x in others]))
            parts = set(chain.from_iterable(found))
            asked = parts.union(words)
            fresh = self.encode_words(self.words.missing(asked))
            self.words.add({x: fresh[x] for x in parts if x in fresh})
            known = self.words.known
            fresh |= {x: known[x] for x in asked if x not in fresh}
            self.pieces.add(dict(zip(letters, map(fresh.__getitem__, words), strict=True)))
            self.pieces.add({x: b"".join([fresh[z] for z in y]) for x, y in zip(others, found, strict=True)})

    def _part(self, text: str) -> bytes:
        """Ids of a text with runs of white space: all its matches are looked up."""
        words = self.matches(text)
        self.words.add(self.encode_words(self.words.missing(set(words))))
        return b"".join(map(self.words.known.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        self.words.turn()
        self.pieces.turn()
        if sum(len(x) for x in texts if x) > 2 * CHARS_A_BATCH:  # very long texts go part by part
            return [b"".join([self.encode([part])[0] for part in parts_of(x)]) if x and len(x) > CHARS_A_BATCH else self.encode([x])[0] for x in texts]
        cut = [None if not text or BARE in text or _RUN.search(text) else pieces_of(text) for text in texts]
        self._solve(self.pieces.missing(set().union(*filter(None, cut))))
        find = self.pieces.known.__getitem__
        return [b"".join(map(find, x)) if x else self._part(text) if text else b"" for text, x in zip(texts, cut, strict=True)]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence."""
        out: list[list[bytes]] = [[] for _ in encoded]
        lens = np.fromiter((len(x) // 4 for x in encoded), np.int64, len(encoded))
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
        row = np.repeat(np.arange(len(encoded), dtype=np.int32), lens)
        for i in range(0, len(ids), TOKENS_A_QUERY):
            some = ids[i : i + TOKENS_A_QUERY]
            found = self._ask(_PIECES, "tokens", {"w": row[i : i + TOKENS_A_QUERY], "pos": np.arange(len(some)), "id": some})
            for at, text in zip(found.column("w").to_pylist(), found.column("text").to_pylist(), strict=True):
                out[at].append(text.encode() if text.isascii() else text.encode("utf-16-le")[::2])
        return [b"".join(x) for x in out]


def codec(rank_file: bytes, pattern: str) -> RankCodec:
    """The codec of this Python worker; it outlives a task, and with it what it has solved."""
    return held(("bpe", hashlib.sha256(rank_file).digest(), pattern), lambda: RankCodec(rank_file, pattern))


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a binary column of token ids (little-endian unsigned 32-bit integers); null texts count as empty."""
    ship(df.sparkSession)
    with open(rank_path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: about 1 MB
    df = without(df, ids)
    names = [*df.columns]
    place = names.index(text)

    def run(batches):
        own = codec(file.value, pattern)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for part in slices(texts):
                encoded = pa.array(own.encode(texts[part]), pa.binary())
                piece = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*piece.columns, encoded], [*names, ids])

    return df.mapInArrow(run, with_columns(df, f"`{ids}` binary"))


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with a binary column of the bytes that its ids stand for."""
    ship(df.sparkSession)
    with open(rank_path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())
    df = without(df, decoded)
    names = [*df.columns]
    place = names.index(ids)

    def run(batches):
        own = codec(file.value, pattern)
        for batch in batches:
            encoded = [x or b"" for x in batch.column(place).to_pylist()]
            out = [x for part in slices(encoded) for x in own.decode(encoded[part])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, decoded])

    return df.mapInArrow(run, with_columns(df, f"`{decoded}` binary"))


def digests(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_tokens, ids_sha256 and decoded_sha256: encode, then decode, in one pass.

    The ids never leave the Python worker that made them; an id sequence is four bytes a token and would more than
    double what the pass moves.
    """
    ship(df.sparkSession)
    with open(rank_path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())
    df = without(df, "n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in df.columns if c != text]
    place = df.columns.index(text)

    def run(batches):
        own = codec(file.value, pattern)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            rest = batch.select(kept)
            for part in slices(texts):
                encoded = own.encode(texts[part])
                decoded = own.decode(encoded)
                piece = rest.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        *piece.columns,
                        pa.array([len(x) // 4 for x in encoded], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    ],
                    [*kept, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.mapInArrow(run, with_columns(df.select(*kept), "n_tokens long", "ids_sha256 string", "decoded_sha256 string"))
