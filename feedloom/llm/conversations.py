"""Conversation structure repair by an auction algorithm for shortest paths over a lattice of edits.

The rows of a conversation, in order of their turn, are the layers of a lattice; in each layer are the four states of
the pattern ``(s?(ua)+)?`` of role initials: nothing yet, after system, after user, after assistant. Edits are arcs of
integer cost: Keep 0, Rerole to user or assistant 2, Delete 3 (the only way for blank rows and repeats), and Insert of an
empty message 2, which stays in its layer; Keep and Rerole of a truncated row cost 1 more. Every letter leads from a
state to one state, so the letters of a path name it.

The auction holds a price for each node, never more than its distance to the end, and a path. The path's last node
either raises its price to the least ``cost + price`` of its arcs and leaves the path, or passes it on along the arc that
reaches it. When the path arrives, the price of its first node is the distance, and arcs with ``price = cost + price`` are
tight. The least of the cheapest letter strings is traced from there: the least letter whose arc is tight, and stays so
when its end has been an origin itself. Prices stay valid from one origin to the next.

A lattice is worked on in segments of ``SEGMENT`` rows, from the last to the first: a segment's auction starts at the
prices of the layer after it, and what it gives for a pattern of rows and prices is kept. A conversation that has more
than one block of rows (``BLOCK`` at most, cut where Spark's batches and range partitions end) is solved block by block:
tasks make each block's table of costs between states, a fold of these tables in a sorted stream gives the prices between
blocks, and a block is traced from them. So a conversation that holds a third of all rows is spread over tasks but for
the two streams, which hold one block at a time: a hash of the whole repaired text can only be made in order.

Repeats (role and text seen earlier) are counted by a hash of 128 bits with partial aggregation, and equal rows travel
as one row with their number. Texts are shuffled once, to the last stream.

Edge cases: null role and text are one space (and a null id or turn in the damage's key); a null id is a conversation of
its own; rows without a turn come first; rows of equal turn are in the order of a hash of their id, role and text, and
equal rows are adjacent; a conversation without rows has zeros, an empty audit and no messages; a role counts by its first
letter, and an empty role or another letter fits nowhere; other columns aren't read, whatever their names; an empty table
gives an empty table; a text of any length is one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.arrow import KEY, held, possible, row_key
from feedloom.shared import discard, ship, written

#: Rows of a block and of a segment, and solved segments that a worker keeps.
BLOCK, SEGMENT, KEPT = 2048, 10, 100_000
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after an inserted or reroled message, and the cost of ending in each state (a system or user is answered).
TURN, END = (USER, USER, ASSISTANT, USER), (0, 4, 2, 0)
NEVER = 1 << 60
#: A row as a number: its role's class (0 none, 1 system, 2 user, 3 assistant), truncated, and that it may stay.
TRUNCATED, STAYS = 4, 8
#: Repeats of a row up to this are single rows of a lattice; more are one step.
FEW = 4
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[1, 2] = _LEGAL[2, 3] = _LEGAL[3, 2] = True


def arcs(row: int, state: int) -> list[tuple[str, int, int, int]]:
    """letter, cost, rows passed and state reached, by letter."""
    out = [("D", 3, 1, state), ("I", 2, 0, TURN[state])]
    if row & STAYS:
        role, more = row & 3, int(bool(row & TRUNCATED))
        if (role == SYSTEM and state == START) or (role == USER and state != USER) or (role == ASSISTANT and state == USER):
            out.append(("K", more, 1, role))
        out.append(("R", 2 + more, 1, TURN[state]))
    return out


_ARCS = [[arcs(row, state) for state in range(4)] for row in range(16)]


class Auction:
    """Prices of a lattice of rows whose last layer has given prices (``NEVER``: not to be reached)."""

    def __init__(self, rows: bytes, ends: tuple[int, ...]):
        self.last = 4 * len(rows)
        self.price = [min(ends)] * self.last + list(ends)
        self.arcs = []
        for layer, row in enumerate(rows):
            for state in range(4):
                found = [(letter, cost, 4 * (layer + passed) + to) for letter, cost, passed, to in _ARCS[row][state]]
                self.arcs.append([x for x in found if self.price[x[2]] < NEVER])

    def converge(self, origin: int) -> None:
        """Bring the price of ``origin`` to its distance."""
        price, path = self.price, [origin]
        while (node := path[-1]) < self.last:
            best, to = min((cost + price[to], to) for _, cost, to in self.arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)

    def trace(self, origin: int) -> tuple[list[str], int]:
        """Letters of the least of the cheapest paths, parted by rows, and the state that it ends in."""
        self.converge(origin)
        node, out = origin, [""]
        while node < self.last:
            for letter, cost, to in self.arcs[node]:
                if self.price[node] == cost + self.price[to]:
                    if to < self.last:
                        self.converge(to)
                    if self.price[node] == cost + self.price[to]:
                        break
            out[-1] += letter
            if letter != "I":
                out.append("")
            node = to
        return out[:-1], node - self.last


def _segment(rows: bytes, ends: tuple[int, ...], known: dict) -> tuple[tuple[int, ...], list[tuple[list[str], int]]]:
    """Prices of a segment's first layer, and the trace from each of its states."""
    base = min(ends)
    key = rows, tuple(x - base if x < NEVER else x for x in ends)
    if key not in known:
        if len(known) >= KEPT:
            known.clear()
        auction = Auction(*key)
        traces = [auction.trace(state) for state in range(4)]
        known[key] = tuple(auction.price[:4]), traces
    prices, traces = known[key]
    return tuple(x + base for x in prices), traces


def steps(rows: bytes, repeats: list[int]) -> list[bytes | int]:
    """A block as segments of rows and numbers of rows that can only be deleted; ``repeats`` of a row come after it."""
    out, now = [], bytearray()
    for row, more in zip(rows, repeats, strict=True):
        if row & STAYS:
            now.append(row)
        if more > FEW:
            out += [bytes(now), more]
            now = bytearray()
        else:
            now += b"\0" * more
        if len(now) >= SEGMENT:
            out.append(bytes(now))
            now = bytearray()
    return [x for x in [*out, bytes(now)] if x]


def _passed(step: bytes | int, ends: tuple[int, ...], known: dict) -> tuple[int, ...]:
    """Prices before a step from those after it."""
    if isinstance(step, bytes):
        return _segment(step, ends, known)[0]
    found = [x + 3 * step if x < NEVER else x for x in ends]
    for _ in range(2):
        found = [min(x, 2 + found[TURN[state]]) for state, x in enumerate(found)]
    return tuple(found)


def solve(rows: bytes, repeats: list[int], ends: tuple[int, ...], known: dict, state: int = START) -> tuple[int, list[str], int]:
    """Cost from ``state``, letters by row (each with the inserts before it; ``repeats`` as so many D), and the state reached."""
    todo, after = steps(rows, repeats), [ends]
    for step in reversed(todo):
        after.append(_passed(step, after[-1], known))
    cost, letters = after[-1][state], []
    for step, later in zip(todo, reversed(after[:-1]), strict=True):
        if isinstance(step, bytes):
            found, state = _segment(step, later, known)[1][state]
            letters += found
        else:
            letters.append("D" * step)
    return cost, letters, state


def cost_table(rows: bytes, repeats: list[int], known: dict) -> list[int]:
    """Least costs of a block from each state (four rows) to each state."""
    todo, total = steps(rows, repeats), sum(repeats) + sum(bool(x & STAYS) for x in rows)
    out = [[NEVER] * 4 for _ in range(4)]
    out[START][START] = out[SYSTEM][SYSTEM] = 3 * total
    kept = [int(bool(x & TRUNCATED)) for x in rows if x & STAYS and x & 3 == SYSTEM]
    if kept:
        out[START][SYSTEM] = 3 * (total - 1) + min(kept)
    for to in (USER, ASSISTANT):
        prices = tuple(0 if x == to else NEVER for x in range(4))
        for step in reversed(todo):
            prices = _passed(step, prices, known)
        for state in range(4):
            out[state][to] = prices[state]
    return [x for row in out for x in row]


def _solved() -> dict:
    return held("conversation-segments", dict)


def prepared(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, times, row, row2, blank and truncated; rows that are given ``times`` more than once are repeats."""
    space = F.lit(" ")
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"), (F.col(times) if times else F.lit(1)).cast("long").alias("times"))
    end = F.rtrim("text", F.lit(SPACES))
    keys = row_key(F.col("conv_id"), F.col("role"), F.col("text"))
    return rows.select("*", *keys, (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times: rows of conversations that lost or got something by the checksum of their id and turn."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


def _checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without text, one for equal ones (conv_id, turn, row, row2, code, times, blank, first, repeats, kept), and the
    texts of rows that may stay (conv_id, turn, row, row2, role, text)."""
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.groupBy(*KEY).agg(F.sum("times").alias("all_times"), F.min(at).alias("earliest")).where("all_times > 1")
    again = written(again.select(*KEY, F.col("earliest.turn").alias("first_turn"), F.lit(True).alias("again")), "repeats")
    met = possible(rows, again).join(again, KEY, "left")
    alone = possible(rows, again, inside=False).select("*", F.lit(None).cast(again.schema["first_turn"].dataType).alias("first_turn"), F.lit(None).cast("boolean").alias("again"))
    alone = alone.unionByName(met.where("again IS NULL"))
    many = met.where("again AND first_turn <=> turn")
    code = F.when(F.substring("role", 1, 1) == "s", SYSTEM).when(F.substring("role", 1, 1) == "u", USER).when(F.substring("role", 1, 1) == "a", ASSISTANT).otherwise(0)
    code = code + F.when(F.col("truncated"), TRUNCATED).otherwise(0)
    parts = ["conv_id", "turn", *KEY, code.alias("code"), "blank", "truncated"]
    one = alone.select(*parts, "times", F.lit(True).alias("first"))
    grouped = met.where("again").select(*parts, "times", F.col("first_turn").eqNullSafe(F.col("turn")).alias("first")).groupBy("conv_id", "turn", *KEY, "code", "blank", "truncated", "first").agg(F.sum("times").alias("times"))
    every = one.unionByName(grouped)
    stays = F.col("first") & ~F.col("blank")
    every = every.select("conv_id", "turn", *KEY, (F.col("code") + F.when(stays, STAYS).otherwise(0)).alias("code"), "times", "blank", "truncated", "first", (F.col("times") - F.when(stays, 1).otherwise(0)).alias("repeats"))
    texts = alone.where("NOT blank").select("conv_id", "turn", *KEY, "role", "text")
    return every, texts.union(many.where("NOT blank").select("conv_id", "turn", *KEY, "role", "text").dropDuplicates(KEY))


def _blocks(every: DataFrame) -> DataFrame:
    """Blocks of rows of a conversation in order: conv_id, turn, row, row2 (of the first row), part, block, rows (a byte a row),
    repeats (after each row)."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("row").asc(), F.col("row2").asc()]
    kind, turn = (every.schema[x].dataType.simpleString() for x in ("conv_id", "turn"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), n]
            cuts = np.array([x for a, b in pairwise(ends) for x in range(a, b, BLOCK)] + [n])
            codes = batch.column(4).to_numpy().astype(np.uint8).tobytes()
            starts = pa.array(cuts[:-1])
            m = len(cuts) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).take(starts) for i in range(4)],
                    pa.array(np.full(m, part), pa.int64()),
                    pa.array(np.arange(block, block + m), pa.int64()),
                    pa.array([codes[a:b] for a, b in pairwise(cuts.tolist())], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(5)),
                ],
                ["conv_id", "turn", *KEY, "part", "block", "rows", "repeats"],
            )
            block += m

    rows = every.select("conv_id", "turn", *KEY, F.col("code").cast("int"), "repeats").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(run, f"conv_id {kind}, turn {turn}, row long, row2 long, part long, block long, rows binary, repeats array<long>"), "conversation-blocks")


def _ends(blocks: DataFrame) -> DataFrame | None:
    """part, block and ends (the four prices after it) of blocks that others of their conversation follow; None if there are none."""
    several = blocks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("name"))
    several = written(several, "long-conversations")
    if several.isEmpty():
        discard(several)
        return None
    long = blocks.join(several, F.col("conv_id").eqNullSafe(F.col("name")), "left_semi").select("conv_id", "part", "block", "rows", "repeats")
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def tables(batches) -> Iterator[pa.RecordBatch]:
        known = _solved()
        for batch in batches:
            found = [cost_table(a, b, known) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["conv_id", "part", "block", "costs"])

    def folded(batches) -> Iterator[pa.RecordBatch]:
        name, prices = None, END
        for batch in batches:
            out = []
            for i, (conv, costs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if (conv,) != name:
                    name, prices = (conv,), END
                out.append(prices)
                prices = tuple(min(NEVER, *(costs[4 * a + b] + prices[b] for b in range(4))) for a in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int64()))], ["part", "block", "ends"])

    costs = long.repartition("part", "block").mapInArrow(tables, f"conv_id {kind}, part long, block long, costs array<long>")
    order = [F.col("conv_id").asc_nulls_first(), F.col("part").desc(), F.col("block").desc()]
    found = written(costs.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(folded, "part long, block long, ends array<long>"), "block-prices")
    discard(several)
    return found


_STATS = ["gaps", "blank", "duplicate", "truncated"]


def _stats(every: DataFrame, names: DataFrame) -> DataFrame:
    """conv_id and the counts of its rows, for every conversation of ``names``."""
    zero = F.lit(0).cast("long")
    first = F.when(F.col("blank"), zero).otherwise(F.col("repeats"))
    rows = every.select("conv_id", "turn", F.when(F.col("blank"), F.col("times")).otherwise(zero).alias("blank"), first.alias("duplicate"), F.when(F.col("first") & ~F.col("blank") & F.col("truncated"), 1).otherwise(0).cast("long").alias("truncated"))
    rows = rows.union(names.select("conv_id", F.lit(None).cast(every.schema["turn"].dataType), zero, zero, zero).distinct())
    turns = rows.groupBy("conv_id", "turn").agg(*[F.sum(x).alias(x) for x in _STATS[1:]])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(x).alias(x) for x in _STATS[1:]])


class _Walk:
    """One conversation of the last stream: blocks are traced when they come, and meet their texts in order."""

    def __init__(self, name: object, stats: list[int]):
        self.name, self.stats, self.cost, self.illegal, self.before = name, stats, None, 0, None
        self.state = self.place = START  # of the lattice, ahead by a block, and of the messages
        self.audit: list[str] = []
        self.todo: list[str] = []  # letters of each row with a text, and of those without one before it
        self.pending, self.at = "", 0

    def block(self, rows: bytes, repeats: list[int], ends: list[int] | None) -> None:
        cost, letters, self.state = solve(rows, repeats, tuple(ends or END), _solved(), self.state)
        self.cost = cost if self.cost is None else self.cost
        self.audit += letters
        kinds, stays = np.frombuffer(rows, np.uint8) & 3, np.frombuffer(rows, np.uint8) & STAYS > 0
        copies = np.array(repeats, np.int64) + stays
        self.illegal += int((copies - 1).sum()) + int((~_LEGAL[kinds[:-1], kinds[1:]]).sum())
        self.illegal += self.before is not None and not _LEGAL[self.before, kinds[0]]
        self.before = int(kinds[-1])
        self.todo, self.at, found = [], 0, iter(letters)
        for stay, more in zip(stays.tolist(), repeats, strict=True):
            if stay:
                self.todo.append(self.pending + next(found))
                self.pending = ""
            if more > FEW:
                next(found)  # nothing is inserted between them: D comes before I
            else:
                self.pending += "".join(next(found) for _ in range(more))

    def messages(self, role: str, text: str, letters: str | None = None) -> Iterator[tuple[str, str]]:
        """What the next row with a text becomes, inserts before it included."""
        if letters is None:
            letters, self.at = self.todo[self.at], self.at + 1
        for letter in letters:
            if letter == "K":
                self.place = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield role, text
            elif letter != "D":
                self.place = TURN[self.place]
                yield NAMES[self.place], text if letter == "R" else ""

    def ended(self) -> Iterator[tuple[str, str]]:
        tail = "II" if self.state == SYSTEM else "I" if self.state == USER else ""
        self.audit.append(tail)
        return self.messages("", "", self.pending + tail)


def _walked(batches) -> Iterator[tuple[_Walk, str | None, str | None]]:
    """walk, role and text of every message of the repaired conversations; (walk, None, None) ends each."""
    walk = None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 4, 5, 6, 7, 8, 9, 10)]
        for name, kind, role, text, rows, repeats, ends, stats in zip(*columns, strict=True):
            if kind == 0:
                if walk is not None:
                    yield from ((walk, *x) for x in (*walk.ended(), (None, None)))
                walk = _Walk(name, stats)
            elif kind == 1:
                walk.block(rows, repeats, ends)
            else:
                yield from ((walk, *x) for x in walk.messages(role, text))
    if walk is not None:
        yield from ((walk, *x) for x in (*walk.ended(), (None, None)))


def _stream(df: DataFrame, conv_id: str, turn: str, role: str, text: str, times: str | None, names: DataFrame) -> tuple[DataFrame, str]:
    """The rows of the last stream, sorted: of each conversation its counts (kind 0), then blocks (1), each before its texts
    (2); and the type of ids."""
    ship(df.sparkSession)
    every, texts = _checked(prepared(df, conv_id, turn, role, text, times))
    blocks = _blocks(every)
    ends = _ends(blocks)
    placed = blocks.withColumn("ends", F.lit(None).cast("array<long>")) if ends is None else blocks.join(ends, ["part", "block"], "left")
    keys = {"conv_id": every.schema["conv_id"].dataType.simpleString(), "turn": every.schema["turn"].dataType.simpleString(), "row": "long", "row2": "long"}
    more = {"role": "string", "text": "string", "rows": "binary", "repeats": "array<long>", "ends": "array<long>", "stats": "array<long>"}

    def shaped(frame: DataFrame, kind: int) -> DataFrame:
        def column(name: str, what: str) -> Column:
            return F.col(name) if name in frame.columns else F.lit(None).cast(what).alias(name)

        return frame.select(*[column(*x) for x in keys.items()], F.lit(kind).alias("kind"), *[column(*x) for x in more.items()])

    parts = shaped(_stats(every, names).select("conv_id", F.array(*_STATS).alias("stats")), 0).union(shaped(placed, 1)).union(shaped(texts, 2))
    order = [F.col("conv_id").asc_nulls_first(), (F.col("kind") > 0).asc(), F.col("turn").asc_nulls_first(), F.col("row").asc(), F.col("row2").asc(), F.col("kind").asc()]
    return parts.repartition("conv_id").sortWithinPartitions(*order), keys["conv_id"]


def _in_batches(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]], size: int) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of up to 4,096 rows and about 8 MB; ``size`` is the place of the column that counts."""
    held_rows, total = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*held_rows, strict=True), schema, strict=True)], [name for name, _ in schema])

    for row in rows:
        held_rows.append(row)
        total += len(row[size])
        if len(held_rows) >= 4096 or total > 8_000_000:
            yield batch()
            held_rows, total = [], 0
    if held_rows:
        yield batch()


def _first(batches) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The type of the first column, and all batches."""
    batches = iter(batches)
    first = next(batches, None)
    return (None, iter(())) if first is None else (first.column(0).type, chain([first], batches))


def repaired(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None) -> DataFrame:
    """conv_id, place (from 0), role and text of the messages of every repaired conversation."""
    rows, kind = _stream(df, conv_id, turn, role, text, times, df.select(F.col(conv_id).alias("conv_id")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        types, batches = _first(batches)

        def messages():
            place = 0
            for walk, role, text in _walked(batches):
                if role is not None:
                    yield walk.name, place, role, text
                place = place + 1 if role is not None else 0

        return _in_batches(messages(), [("conv_id", types), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())], 3)

    return rows.mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def digests(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation, after :func:`damaged`."""
    rows, kind = _stream(damaged(df), "conv_id", "turn", "role", "text", "times", df.select("conv_id"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        types, batches = _first(batches)

        def conversations():
            digest, between = hashlib.sha256(), ""
            for walk, role, text in _walked(batches):
                if role is None:
                    yield walk.name, *walk.stats, walk.illegal, walk.cost or 0, "".join(walk.audit), digest.hexdigest()
                    digest, between = hashlib.sha256(), ""
                else:
                    digest.update(f"{between}{role}:{text}".encode(errors="replace"))
                    between = "\n"

        return _in_batches(conversations(), [("conv_id", types), *[(x, pa.int64()) for x in (*_STATS, "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())], 7)

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def oracle() -> str:
    """DuckDB SQL for :func:`digests` over conversations (turns of a conversation are unique): the cheapest strings by dynamic programming."""
    step = " UNION ALL ".join(
        [
            "SELECT conv_id, i + 1 AS i, state, cost + 3 AS cost, audit || 'D' AS audit FROM here",
            "SELECT conv_id, i + 1, state % 2 + 2, cost + 2 + late, audit || 'R' FROM here WHERE stays",
            "SELECT conv_id, i + 1, kind, cost + late, audit || 'K' FROM here WHERE stays AND ((kind = 1 AND state = 0) OR (kind = 2 AND state != 2) OR (kind = 3 AND state = 2))",
        ]
    )
    # State 0 and 1 go on to user (2) as 3 does; 2 goes on to assistant (3).
    step = step.replace("state % 2 + 2", "CASE WHEN state = 2 THEN 3 ELSE 2 END")
    return f"""
WITH RECURSIVE crcs AS (SELECT list(list_reduce(list_prepend(x, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY x) AS t FROM range(256) r(x)),
named AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t0 FROM conversations),
hashed AS (SELECT conv_id, turn, r, t0, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) % 20 AS h FROM named, crcs),
dealt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE r END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE h != 0),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) - 1 AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind FROM dealt),
items AS (SELECT *, body = '' AS blank, body != '' AND seen AS repeat, body != '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS cut, body != '' AND NOT seen AS stays, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM marked),
best AS (
  SELECT conv_id, 0::BIGINT AS i, state, cost::BIGINT AS cost, audit FROM (SELECT DISTINCT conv_id FROM items), (VALUES (0, 0, ''), (2, 2, 'I'), (3, 4, 'II')) v(state, cost, audit)
  UNION ALL
  (WITH here AS (SELECT b.*, x.stays, x.kind, x.cut::INT AS late FROM best b JOIN items x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i),
  moved AS ({step}),
  more AS (SELECT * FROM moved UNION ALL SELECT conv_id, i, CASE WHEN state = 2 THEN 3 ELSE 2 END, cost + 2, audit || 'I' FROM moved UNION ALL SELECT conv_id, i, CASE WHEN state = 2 THEN 2 ELSE 3 END, cost + 4, audit || 'II' FROM moved)
  SELECT conv_id, i, state, cost, audit FROM more QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1)),
chosen AS (SELECT conv_id, cost, audit FROM (SELECT b.* FROM best b JOIN (SELECT DISTINCT conv_id, n FROM items) x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = x.n WHERE state IN (0, 3)) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS place FROM chosen WHERE audit != ''),
placed AS (SELECT *, count(*) FILTER (letter != 'I') OVER w - 1 AS i FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
said AS (SELECT p.conv_id, p.place, p.letter, x.role, x.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.place) - 1 AS k, first(CASE WHEN p.letter = 'K' THEN x.kind ELSE 2 END) OVER (PARTITION BY p.conv_id ORDER BY p.place) AS opening FROM placed p LEFT JOIN items x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.i = p.i AND p.letter != 'I' WHERE p.letter != 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role ELSE CASE WHEN (k + (opening = 1)::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS body FROM said GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (repeat) AS repeat, count(*) FILTER (cut) AS cut, count(*) FILTER (before IS NOT NULL AND (before, kind) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal FROM items GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.repeat, 0) AS duplicate, coalesce(c.cut, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(h.cost, 0) AS cost, coalesce(h.audit, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""
