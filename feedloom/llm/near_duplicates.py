"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Every text becomes its set of hashed word shingles (64 bits each), a fingerprint of the set and a MinHash
   signature. Texts with equal sets are one class; only one row of a class goes on.
2. Signatures are cut into bands; classes that agree on a band share a bucket. With ``ROWS`` values a band and
   ``BANDS`` bands a pair at the threshold shares no bucket with probability (1 - 0.85^5)^30 < 3e-8.
3. In each bucket every member is compared with a leader. Pairs go through the signatures batch by batch: after n
   values with m matches the posterior probability (uniform prior) that the similarity reaches the threshold is a
   binomial sum, and a pair leaves when it falls below ``MISS``. Pairs that stay are checked on their full sets.
4. The links give components. Members of a bucket that are still in different components are compared with each
   other, in blocks: all of a bucket's members outside its largest component against all its members. Buckets of one
   largest component are compared as one where that makes fewer pairs. Pairs inside a component need no comparison,
   so a large group of copies costs its members and not its pairs, and no link between components is lost.

No group is ever in one task as a whole: star groups and buckets are cut into blocks of about ``BLOCK`` members and
``SHINGLES`` shingles. Links, labels and fingerprints stay in tables in the shared folder, which are deleted as soon as
nothing reads them any more; a class is named by the number of its first row, so that keys are longs.

Edge cases: a null, empty or blank text has no shingles, is linked with nothing and is kept; a text with fewer words
than a shingle has its whole sequence as the one shingle; equal rows share a class; a null id is larger than any other;
repeated ids are told apart by row; an empty table gives an empty table; other columns, whatever their names, are not
read by near_duplicates and kept as they are by deduplicated. A very long text is hashed whole; it is one member of a
block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.arrow import KEY, except_rows, kept_apart, possible, release, row_key, slices
from feedloom.shared import discard, ship, written

BANDS, ROWS = 30, 5
#: Probability with which a pair at the threshold may be dropped by its signature.
MISS = 1e-6
#: Signature values that are compared between two looks at the posterior.
BATCH = 30
#: Members, and shingles of members, of a block.
BLOCK, SHINGLES = 512, 1_000_000
#: Buckets up to this size have their smallest class as leader, so that they agree on it; larger ones have one of
#: three, which joins more members at once.
SMALL, TURN = 16, 0x5DEECE66D1B2C3A5
_MASK = np.uint64(2**64 - 1)
_ODD = np.random.default_rng(20_240_229).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.encode(errors="replace").lower().split() if text else []  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    width = min(size, len(words))
    found = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - width + 1 + i])
    return np.unique(found)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a set that isn't empty."""
    least = np.full(len(_ODD), _MASK, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (_ODD[:, None] * shingles[None, i : i + 2048]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def least_matches(threshold: float, seen: int, miss: float = MISS) -> int:
    """Fewest matches among ``seen`` values for which P(similarity >= threshold) is still ``miss`` or more.

    With a uniform prior that posterior is the binomial distribution function of m at n + 1 trials.
    """
    total = 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= miss:
            return m
    return seen


def signed(df: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """uid, row, row2, doc_id, n_shingles, h1 and h2 (fingerprint, null for an empty set) and signature of each document."""
    ship(df.sparkSession)

    def run(batches):
        release()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for part in slices(texts):
                sets = [shingle_set(x, size) for x in texts[part]]
                some = batch.slice(part.start, part.stop - part.start)
                marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
                empty = np.array([not len(x) for x in sets], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        *some.select([0, 1, 2]).columns,
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(marks[:, 0], mask=empty),
                        pa.array(marks[:, 1], mask=empty),
                        pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                    ],
                    [*KEY, "doc_id", "n_shingles", "h1", "h2", "signature"],
                )

    found = _keyed(df, doc_id, text).mapInArrow(run, "row long, row2 long, doc_id long, n_shingles long, h1 long, h2 long, signature binary")
    return found.select(F.monotonically_increasing_id().alias("uid"), "*")


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(*row_key(F.col(doc_id), F.col(text)), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def bands(classes: DataFrame) -> DataFrame:
    """bucket, class and n_shingles: one row for each band of each class."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(n, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
            for i in range(ROWS):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, i])
            owner = pa.array(np.repeat(np.arange(n), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner)], ["bucket", "class", "n_shingles"])

    return classes.select("class", "n_shingles", "signature").mapInArrow(run, "bucket long, class long, n_shingles long")


def _in_groups(df: DataFrame, run: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``run`` to the rows of each value of g: groups of bounded size, many of them in a task."""
    names = df.columns
    place = names.index("g")

    def each(batches) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(place).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column(place)[0].as_py() != int(keys[start]):
                    if (out := run(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(start, stop - start))
        if held and (out := run(pa.Table.from_batches(held))) is not None:
            yield out

    return df.repartition("g").sortWithinPartitions("g").mapInArrow(each, schema)


def _blocks(members: Column, shingles: Column) -> Column:
    """Blocks that so many members with so many shingles are cut into."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / SHINGLES)).cast("int")


def survivors(groups: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Rows of groups (g, class, first, other, part) that have a partner left after the signatures were compared.

    ``first`` rows are compared with ``other`` rows of another part (component).
    """
    stops = [(n, least_matches(threshold, n)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(table: pa.Table) -> pa.RecordBatch | None:
        n = table.num_rows
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(n, BANDS * ROWS)
        sizes = table.column("n_shingles").to_numpy()
        first, other, part = (table.column(c).to_numpy(zero_copy_only=False) for c in ("first", "other", "part"))
        others, stays = np.flatnonzero(other), np.zeros(n, bool)
        for i in np.flatnonzero(first):
            left = others[(part[others] != part[i]) & (np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i]))]
            found, at = np.zeros(len(left), np.int64), 0
            for stop, least in stops:
                if not len(left):
                    break
                found = found + (sig[left, at:stop] == sig[i, at:stop]).sum(axis=1)
                keep = found >= least
                left, found, at = left[keep], found[keep], stop
            if len(left):
                stays[i] = True
                stays[left] = True
        if not stays.any():
            return None
        return table.select(["g", "class", "first", "other", "part", *KEY]).filter(pa.array(stays)).combine_chunks().to_batches()[0]

    rows = groups.join(possible(classes.select("class", "signature", "n_shingles", *KEY), groups, key="class"), "class")
    return _in_groups(rows.select("g", "class", "first", "other", "part", *KEY, "signature", "n_shingles"), run, "g long, class long, first boolean, other boolean, part long, row long, row2 long")


def confirmed(groups: DataFrame, docs: DataFrame, numerator: int, denominator: int, size: int) -> DataFrame:
    """a, b: links between classes of different parts, checked on full sets; one link for each pair of parts of a group."""

    def run(table: pa.Table) -> pa.RecordBatch | None:
        names, parts = table.column("class").to_pylist(), table.column("part").to_pylist()
        once, row = np.unique(names, return_index=True, return_inverse=True)[1:]  # equal rows of the documents, and a class in both roles
        first, other = (np.bincount(row, table.column(c).to_numpy(zero_copy_only=False)) > 0 for c in ("first", "other"))
        once = once.tolist()
        sets = [shingle_set(table.column("text")[i].as_py(), size) for i in once]
        names, parts = [names[i] for i in once], [parts[i] for i in once]
        lens = np.array([len(x) for x in sets])
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(lens)
        starts, mark, links, joined = ends - lens, np.zeros(len(values), bool), [], {x: x for x in parts}

        def root(x):
            while joined[x] != x:
                joined[x] = x = joined[joined[x]]
            return x

        for i in np.flatnonzero(first):
            mark[codes[starts[i] : ends[i]]] = True
            both = np.add.reduceat(mark[codes], starts)
            mark[codes[starts[i] : ends[i]]] = False
            for j in np.flatnonzero(other & (denominator * both >= numerator * (lens + lens[i] - both))).tolist():
                if (x := root(parts[i])) != (y := root(parts[j])):
                    joined[x] = y
                    links.append((names[i], names[j]))
        if not links:
            return None
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    rows = groups.join(possible(docs.select(*KEY, "text"), groups), KEY)
    return _in_groups(rows.select("g", "class", "first", "other", "part", "text"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """class, part: the smallest class that links lead to; rounds of least neighbour and pointer jumping, each written
    to the shared folder, until nothing changes (a logarithm of the longest chain)."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    now = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("class"), F.least("a", "b").alias("part")), "parts")
    while True:
        near = edges.join(now.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.min("part").alias("near"))
        step = now.join(near.withColumnRenamed("a", "class"), "class").select("class", "part", F.least("part", "near").alias("new"))
        jump = step.select(F.col("class").alias("new"), F.col("new").alias("far"))
        after = written(step.join(jump, "new").select("class", F.least("new", "far").alias("part"), (F.least("new", "far") != F.col("part")).alias("moved")), "parts")
        discard(now)
        now = after
        if after.where("moved").isEmpty():
            discard(edges)
            return after


def _sets(rest: DataFrame, mixed: DataFrame) -> DataFrame:
    """one, set, class, n_shingles, part, minor: sets in which every minor has to meet every member.

    ``rest``: bucket, largest, class, n_shingles, part, minor of the buckets in ``mixed`` (bucket, n, inner, largest).
    Buckets that have their largest component in common are one set, whose members meet once, if that makes fewer pairs
    than one bucket after the other: a large group of near copies shares nearly all of its bands.
    """
    pairs = F.sum(F.col("n").cast("double") * (F.col("n") - F.col("inner")))
    apart = mixed.groupBy("largest").agg(pairs.alias("apart"))
    named = rest.groupBy("largest", "class").agg(F.first("minor").alias("minor"))
    together = named.groupBy("largest").agg((F.count("*").cast("double") * F.count_if("minor")).alias("together"))
    one = apart.join(together, "largest").select("largest", (F.col("together") < F.col("apart")).alias("one"))
    sets = mixed.join(one, "largest").select("bucket", "one", F.when(F.col("one"), F.col("largest")).otherwise(F.col("bucket")).alias("set"))
    return rest.join(sets, "bucket").select("one", "set", "class", "n_shingles", "part", "minor").distinct()


def _cells(placed: DataFrame) -> DataFrame:
    """Groups (g, class, first, other, part) of a block of a set's minors and a block of its members each."""
    of_minors = _blocks(F.count_if("minor"), F.sum(F.when(F.col("minor"), F.col("n_shingles")).otherwise(0)))
    cut = placed.groupBy("one", "set").agg(of_minors.alias("firsts"), _blocks(F.count("*"), F.sum("n_shingles")).alias("others"))
    placed = placed.join(cut, ["one", "set"])
    own = lambda blocks, seed: F.pmod(F.xxhash64("class", F.lit(seed)), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    no, yes = F.lit(False), F.lit(True)
    return (
        placed.where("minor").select("one", "set", "class", "part", own("firsts", 13).alias("x"), every("others").alias("y"), yes.alias("first"), no.alias("other"))
        .union(placed.select("one", "set", "class", "part", every("firsts").alias("x"), own("others", 11).alias("y"), no.alias("first"), yes.alias("other")))
        .select(F.xxhash64("one", "set", "x", "y").alias("g"), "class", "first", "other", "part")
    )


def grouped(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """row, row2, doc_id, n_shingles, part (a number for each group; null for an empty set) and component_id of every row.

    Texts are linked when ``denominator * |intersection| >= numerator * |union|`` of their ``size``-word shingle sets.
    """
    threshold = numerator / denominator
    all_docs = written(signed(df, doc_id, text, size), "signed")
    docs = _keyed(df, doc_id, text)
    owners = written(all_docs.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("uid").alias("class"), F.min("doc_id").alias("least")), "owners")
    classes = written(all_docs.join(owners.select(F.col("class").alias("uid")), "uid").select(F.col("uid").alias("class"), *KEY, "n_shingles", "signature"), "classes")

    placed = written(bands(classes), "bands")
    turned = F.min(F.col("class").bitwiseXOR(F.lit(TURN))).alias("turned")
    sized = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("least"), F.max("class").alias("most"), turned).where("n > 1")
    turn = F.pmod("bucket", F.lit(3))
    leader = F.when((F.col("n") <= SMALL) | (turn == 0), F.col("least")).when(turn == 1, F.col("most")).otherwise(F.col("turned").bitwiseXOR(F.lit(TURN)))
    members = written(placed.join(sized.select("bucket", "n", leader.alias("leader")), "bucket"), "members")
    discard(placed)

    # Stars: a leader against its members, in blocks.
    star = written(members.where("class != leader").select("leader", "class", "n_shingles").distinct(), "stars")
    counted = star.groupBy("leader").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    cut = star.join(counted, "leader").withColumn("block", F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks")))
    g = F.xxhash64("leader", "block").alias("g")
    no, yes = F.lit(False), F.lit(True)
    groups = cut.select(g, "class", no.alias("first"), yes.alias("other"), F.col("class").alias("part")).union(
        cut.select(g, F.col("leader").alias("class"), yes.alias("first"), no.alias("other"), F.col("leader").alias("part")).distinct()
    )
    left = written(survivors(groups, classes, threshold), "survivors")
    links = written(confirmed(left, docs, numerator, denominator, size), "links")
    discard(star, left)

    # The rest: members of a bucket that are in different components now, without the leaders, which were compared.
    parts = components(links)
    inside = members.where("n > 2 AND class != leader").join(parts, "class", "left").select("bucket", "class", "n_shingles", F.coalesce("part", "class").alias("part"))
    marks = [F.bit_xor(F.xxhash64("class", F.lit(i))).alias(f"mark{i}") for i in (0, 1)]
    tally = inside.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), *marks)
    marks = [F.bit_xor(f"mark{i}").alias(f"mark{i}") for i in (0, 1)]
    most = F.max(F.struct("n", "part"))
    mixed = tally.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), most["n"].alias("inner"), most["part"].alias("largest"), *marks)
    # Buckets with the same members count once.
    mixed = mixed.where("parts > 1").groupBy("mark0", "mark1", "n").agg(F.min("bucket").alias("bucket"), F.min_by("largest", "bucket").alias("largest"), F.max("inner").alias("inner"))
    mixed = written(mixed, "mixed")
    rest = inside.join(mixed.select("bucket", "largest"), "bucket").withColumn("minor", F.col("part") != F.col("largest"))
    rest = written(rest.select("bucket", "largest", "class", "n_shingles", "part", "minor"), "rest")
    placed = written(_sets(rest, mixed), "placed")
    discard(members, mixed, rest)
    left = written(survivors(_cells(placed), classes, threshold), "survivors")
    more = written(confirmed(left, docs, numerator, denominator, size), "links")
    discard(placed, left, classes)
    if not more.isEmpty():
        discard(parts)
        parts = components(links.union(more))
    discard(links, more)

    least = owners.join(parts.select("class", "part"), "class", "left").select("h1", "h2", "least", F.coalesce("part", "class").alias("part"))
    roots = least.groupBy("part").agg(F.min("least").alias("component_id"))
    named = least.join(roots, "part").select("h1", "h2", "part", "component_id")
    result = all_docs.select(*KEY, "doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    result = written(result.select(*KEY, "doc_id", "n_shingles", "part", F.coalesce("component_id", "doc_id").alias("component_id")), "groups")
    discard(all_docs, owners, parts)
    return result


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is component_id) for every row of ``df``; see :func:`grouped`."""
    found = grouped(df, doc_id, text, size, numerator, denominator)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """``df`` with one row of each group: that of the smallest id; among rows of that id, one of the smallest row key."""
    found = grouped(df, doc_id, text, size, numerator, denominator)
    best = found.where("part IS NOT NULL").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("best"))
    best = best.select("best.row", "best.row2")
    gone = found.where("part IS NOT NULL").select(*KEY).distinct().join(best, KEY, "left_anti")
    again = written(found.where("part IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY).join(best, KEY), "again")
    gone = written(gone, "gone")
    rows = except_rows(kept_apart(df, doc_id, text), gone)
    if not again.isEmpty():  # rows that are equal in id and text
        copies = possible(rows, again).join(again.withColumn("again", F.lit(True)), KEY).select(*rows.columns).dropDuplicates(KEY)
        rows = except_rows(rows, again).union(copies)
    return rows.select("doc.*")
