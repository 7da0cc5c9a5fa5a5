"""Token-id files of directly addressable codes (DAC).

An id is cut into chunks of ``CHUNK_BITS`` bits, the lowest first. Level 0 holds the first chunk of every token;
a bitmap says which tokens go on, and level 1 holds the second chunks of just those, and so on. A directory of
running counts for each 512 bits of a bitmap gives the rank of any bit in constant time, and that rank is the
token's place on the next level: any token, or any range of tokens, is read without decoding what lies before it.

A dataset is a folder that Spark writes: each row is one shard with its documents in ascending order of id, so
the files come from Spark's own commit protocol and survive lost executors. Layout of the ``dac`` bytes, all
little-endian: ``DAC1``, u32 chunk bits, u32 levels, u64 tokens; then for each level u64 entries, the chunks
(one byte each), the bitmap (lowest bit first) and the u32 counts before each 512 bits.

Edge cases: a null or empty text is a document of the end id alone; documents with equal ids stay apart, in the
order of their text; a null id comes first; an empty table gives an empty dataset; other columns are not read, whatever
their names. A very long text is encoded part by part; it lies in one shard as a whole. Texts of one id go to one task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from feedloom.llm.arrow import CACHE_BYTES, CHARS_A_BATCH, PieceCache, Solved, cuts, held, slices
from feedloom.shared import shared_dir, ship, small

CHUNK_BITS = 8
#: Tokens after which a shard ends.
SHARD_TOKENS = 1_000_000
_HEAD = struct.Struct("<4sIIQ")
_SHARD = "part int, seq int, n_tokens long, doc_ids array<bigint>, ends array<bigint>, dac binary"


def pack(ids: np.ndarray) -> bytes:
    """The DAC bytes of unsigned ids."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        chunks = (rest & np.uint64(2**CHUNK_BITS - 1)).astype(np.uint8)
        rest = rest >> np.uint64(CHUNK_BITS)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), 512), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        before = (np.cumsum(counts) - counts).astype("<u4")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + bits.tobytes() + before.tobytes())
        if not more.any():
            return _HEAD.pack(b"DAC1", CHUNK_BITS, len(levels), len(ids)) + b"".join(levels)
        rest = rest[more]


class Dac:
    """Read access to DAC bytes."""

    def __init__(self, data: bytes):
        magic, self.bits, levels, self.n = _HEAD.unpack_from(data)
        if magic != b"DAC1":
            raise ValueError("these bytes are not in the DAC1 format")
        at, self.levels = _HEAD.size, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            before = np.frombuffer(data, "<u4", -(-n // 512), at + 8 + n + len(bits))
            self.levels.append((chunks, bits, before))
            at += 8 + n + len(bits) + 4 * len(before)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place ``i``: the directory's count and those of at most 64 bytes."""
        chunks, bits, before = self.levels[level]
        if i >= len(chunks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        block = i >> 9
        return int(before[block]) + int(np.unpackbits(bits[block * 64 : (i + 7) // 8], bitorder="little")[: i - block * 512].sum())

    def token(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + self.bits
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``; those that go on lie side by side on the next level, too."""
        out = np.zeros(stop - start, np.uint64)
        place = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start >= stop:
                break
            out[place] |= chunks[start:stop].astype(np.uint64) << np.uint64(level * self.bits)
            more = np.unpackbits(bits[start >> 3 : (stop + 7) // 8], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            place = place[more]
            start, stop = self._rank(level, start), self._rank(level, stop)
        return out


#: The steps before the model for which :func:`encoder` cuts words itself; characters that NFC leaves alone and whose lower
#: case is one character, and what the tokens of lower-cased text are.
_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
_PLAIN = re.compile(r"[\t\n\r -;=-~\xa1-\xff]+").fullmatch
_TOKENS = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼½¾]|[^\t\n\r 0-9²³¹¼½¾a-zªµºß-öø-ÿ]+").findall


class Encoder:
    """Ids of texts: the tokenizer's tokens never cross white space, so texts may be cut at spaces.

    Words come with capitals and marks, so pieces between spaces are new more often than words are: where the steps before
    the model are the known ones, plain texts are cut into lower-cased words as a whole, and the library's model gets each
    word once while it is kept. Of other texts, plain pieces are cut so, and the whole library gets all other pieces.
    """

    def __init__(self, own: Tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would only contend
        file = json.loads(own.to_str())
        known = [file["normalizer"], file["pre_tokenizer"]] == _STEPS and not (file["post_processor"] or file["truncation"] or file["padding"])
        self.known = known and file["model"]["type"] == "BPE" and not file["model"]["dropout"] and all("<" in x["content"] for x in file["added_tokens"])
        parts = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.own, self.model, self.coded = own, own.model, {i: parts.pre_tokenize_str(chr(i))[0][0] for i in range(0xA1, 0x100)}
        self.words, self.pieces = Solved(2 * CACHE_BYTES), PieceCache(self._solve)

    def _cut(self, text: str | None) -> list[str] | None:
        return _TOKENS(text.lower()) if self.known and text and _PLAIN(text) else None

    def _learn(self, words: set[str]) -> None:
        tokenize, coded, found = self.model.tokenize, self.coded, {}
        for word in self.words.missing(words):
            found[word] = array("I", [x.id for x in tokenize(word if word.isascii() else word.translate(coded))]).tobytes()
        self.words.add(found)

    def _solve(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of texts that are not plain."""
        cut = {x: found for x in pieces if (found := self._cut(x)) is not None}
        self._learn(set().union(*cut.values()))
        find, other = self.words.known.__getitem__, [x for x in pieces if x not in cut]
        done = {x: b"".join(map(find, found)) for x, found in cut.items()}
        done.update((x, array("I", y.ids).tobytes()) for x, y in zip(other, self.own.encode_batch_fast(other, add_special_tokens=False), strict=True))
        return [done[x] for x in pieces]

    def run(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers."""
        if sum(len(x) for x in texts if x) > 2 * CHARS_A_BATCH:  # very long texts go part by part
            return [b"".join([self._some([part])[0] for part in cuts(x)]) for x in texts]
        return self._some(texts)

    def _some(self, texts: list[str | None]) -> list[bytes]:
        self.words.turn()
        cut = [self._cut(x) for x in texts]
        self._learn(set().union(*(x for x in cut if x)))
        other = iter(self.pieces.run([x for x, found in zip(texts, cut, strict=True) if found is None]))
        find = self.words.known.__getitem__
        return [next(other) if found is None else b"".join(map(find, found)) for found in cut]


def encoder(own: Tokenizer) -> Encoder:
    """The encoder of a tokenizer."""
    return Encoder(own)


def _encoder(file: bytes) -> Encoder:
    """The encoder of this Python worker; it outlives a task."""
    return held(("token-files", hashlib.sha256(file).digest()), lambda: encoder(Tokenizer.from_buffer(file)))


def write(df: DataFrame, tokenizer_path: str, end_id: int, path: str, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode the texts in ascending order of ``doc_id``, end each with ``end_id`` and write the shards to ``path``.

    The one shuffle deals the texts out by ranges of the id; every task then encodes and packs its range in order and
    holds one shard at a time.
    """
    ship(df.sparkSession)
    with open(tokenizer_path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: under 2 MB

    def run(batches):
        own, part = _encoder(file.value), TaskContext.get().partitionId()
        end, seq, held, size, ids_of = np.array([end_id], "<u4").tobytes(), 0, [], 0, []

        def shard():
            ids = np.frombuffer(b"".join(held), "<u4")
            ends = np.cumsum([len(x) // 4 for x in held])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([ids_of], pa.list_(pa.int64())),
                    pa.array([ends], pa.list_(pa.int64())),
                    pa.array([pack(ids)], pa.binary()),
                ],
                ["part", "seq", "n_tokens", "doc_ids", "ends", "dac"],
            )

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in slices(texts):
                for key, ids in zip(keys[some], own.run(texts[some]), strict=True):
                    held.append(ids + end)
                    ids_of.append(key)
                    size += len(ids) // 4 + 1
                    if size >= shard_tokens:
                        yield shard()
                        seq, held, size, ids_of = seq + 1, [], 0, []
        if held:
            yield shard()

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _SHARD).write.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq and the number of tokens before each shard.

    The window without a key sees one row for each task that wrote the files.
    """
    shards = spark.read.parquet(path).select("part", "seq", "n_tokens")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return shards.select("part", "seq", inside.alias("inside")).join(small(before), "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("shard_start"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, at, out = Dac(row["dac"]), 0, []
                ids = memoryview(own.range(0, own.n).astype("<u4").tobytes())  # a shard is read in one go
                for key, stop in zip(row["doc_ids"], row["ends"], strict=True):
                    out.append((row["part"], row["seq"], key, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at = stop
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    read = spark.read.parquet(path).mapInArrow(run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(small(starts(spark, path)), ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, places: DataFrame, place: str = "place", most: int = 100_000) -> DataFrame:
    """place and token of the global token places in ``places``: each goes to its shard, which reads just those ids.

    Shards are found by the cells of ``SHARD_TOKENS`` places that they lie in (an equality join), and the places that are
    asked of one shard are cut into lists of about ``most``.
    """
    ship(spark)
    spans = starts(spark, path).join(spark.read.parquet(path).select("part", "seq", "n_tokens"), ["part", "seq"])
    cells = F.sequence(F.floor(F.col("shard_start") / SHARD_TOKENS), F.floor((F.col("shard_start") + F.col("n_tokens") - 1) / SHARD_TOKENS))
    spans = spans.where("n_tokens > 0").withColumn("cell", F.explode(cells))
    asked = places.select(F.col(place).cast("long").alias("place")).withColumn("cell", F.floor(F.col("place") / SHARD_TOKENS))
    asked = asked.join(small(spans), "cell").where((F.col("place") >= F.col("shard_start")) & (F.col("place") < F.col("shard_start") + F.col("n_tokens")))
    counted = asked.groupBy("part", "seq").agg(F.ceil(F.count("*") / most).alias("lists"))
    asked = asked.join(small(counted), ["part", "seq"]).withColumn("list", F.pmod(F.xxhash64("place"), F.col("lists")))
    asked = asked.groupBy("part", "seq", "shard_start", "list").agg(F.collect_list("place").alias("places"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Dac(row["dac"])
                yield pa.RecordBatch.from_arrays([pa.array(row["places"], pa.int64()), pa.array([own.token(x - row["shard_start"]) for x in row["places"]], pa.int64())], ["place", "token"])

    return spark.read.parquet(path).select("part", "seq", "dac").join(asked, ["part", "seq"]).select("dac", "places", "shard_start").mapInArrow(run, "place long, token long")


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``df`` (doc_id, text) as token files in the shared folder and return what :func:`documents` reads there."""
    path = f"{shared_dir(df.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(df, tokenizer_path, end_id, path)
    return documents(df.sparkSession, path)
