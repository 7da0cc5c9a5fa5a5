"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gives a graph of nearest neighbours, which is cut into partitions of nearly equal size with
few edges between them: recursive halving along the direction of largest spread, then rounds of moves to the partition
of most neighbours while sizes stay balanced. A small classifier (one hidden layer) learns the partitions of a vector's
neighbours. Every row of the table is put into its most probable partition; a query goes to its most probable ones, and
the vectors there are compared with it exactly.

How many partitions a query visits is measured on the whole table: for up to ``PROBES`` vectors that the classifier was
not fitted on, an exact search over all rows gives the true neighbours, and the smallest number of visits that finds
``RECALL`` of them is taken. Sample and probes are the two ends of one order of the rows, by a hash of id and vector, and a
small table keeps half of its rows out of the sample. Partitions number one for each ``TARGET`` rows, and at most one for each ``EDGES`` rows of the
sample, which has to hold some of each; a larger ``sample`` lets them number more.

Partitions are cut into blocks of candidates and of queries, so no task holds a whole partition, however many equal
vectors it has. A query that would get fewer rows than there are goes to all partitions.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; distance is defined between
vectors of one length only, so vectors of another length than most form a partition of their own, which is searched
exactly; ties go to the smaller id; equal vectors under different rows are ordinary neighbours at distance 0; a query's
own row alone is no candidate, other rows with its id are; a query row that is repeated is answered once for each row;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.arrow import release
from feedloom.shared import discard, ship, written

#: Vectors that the partitions are learned from, rows that a partition should have, and sample rows of a partition.
SAMPLE, TARGET, EDGES = 8000, 1500, 60
GRAPH, HIDDEN, EPOCHS = 10, 128, 12
#: Vectors whose neighbours are searched exactly, and the share of those neighbours that visits must find.
PROBES, RECALL = 256, 0.95
#: Rows of a block of candidates and of queries; compared a part at a time.
CANDIDATES, QUERIES, AT_ONCE = 32_768, 32_768, 4_000_000


def usable(df: DataFrame, vec_id: str, embedding: str, asked: Column) -> DataFrame:
    """vec_id, asked, length and vector of the rows that take part."""
    x = F.col("vector")
    found = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col(embedding).cast("array<double>").alias("vector"))
    found = found.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0))
    found = found.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))
    return found.select("vec_id", "asked", F.size("vector").alias("length"), "vector")


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest rows of each row."""
    norms, out = (x * x).sum(axis=1), np.empty((len(x), min(k, len(x) - 1)), np.int32)
    for i in range(0, len(x), 256):
        d = norms[None, :] - 2 * x[i : i + 256] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 256] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 6) -> np.ndarray:
    """A partition of the graph with sizes within 15 % of each other and few edges across."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            label[rows] = first
            continue
        y = x[rows] - x[rows].mean(axis=0)
        along = y @ np.linalg.eigh(y.T @ y)[1][:, -1]
        order, left = np.argsort(along, kind="stable"), n // 2
        cut = len(rows) * left // n
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, n - left)]
    most = int(np.ceil(len(x) / parts * 1.15))
    sizes = np.bincount(label, minlength=parts)
    # Edges in both directions, by their first end.
    one, two = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel().astype(np.int64)
    ends, others = np.concatenate([one, two]), np.concatenate([two, one])
    order = np.argsort(ends, kind="stable")
    others, starts = others[order], np.searchsorted(ends[order], np.arange(len(x) + 1))
    for _ in range(rounds):
        moved = 0
        for i in range(len(x)):
            votes = np.bincount(label[others[starts[i] : starts[i + 1]]], minlength=parts)
            own = label[i]
            votes = np.where((sizes < most) | (np.arange(parts) == own), votes, -1)
            best = int(np.argmax(votes))
            if votes[best] > votes[own]:
                sizes[own] -= 1
                sizes[best] += 1
                label[i], moved = best, moved + 1
        if not moved:
            break
    return label


class Router:
    """The classifier: probabilities of the partitions of a vector."""

    def __init__(self, x: np.ndarray, near: np.ndarray, label: np.ndarray, parts: int, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.parts, self.mean, self.scale = parts, x.mean(axis=0), x.std(axis=0) + 1e-9
        self.w = [draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        wanted = np.zeros((len(x), parts))
        for column in (*near.T, np.arange(len(x))):
            wanted[np.arange(len(x)), label[column]] += 1
        wanted /= wanted.sum(axis=1, keepdims=True)
        first, second = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w]
        z, t = (x - self.mean) / self.scale, 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(x))
            for i in range(0, len(x), 256):
                rows, t = order[i : i + 256], t + 1
                h = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                error = (self._soft(h @ self.w[2] + self.w[3]) - wanted[rows]) / len(rows)
                back = (error @ self.w[2].T) * (h > 0)
                for k, g in enumerate((z[rows].T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= 2e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each vector, the most probable first."""
        h = np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def learn(x: np.ndarray, parts: int) -> Router:
    """A router for ``parts`` partitions of the neighbour graph of a sample."""
    near = graph(x, min(GRAPH, len(x) - 1))
    return Router(x, near, balanced(x, near, parts), parts)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _best(rough: np.ndarray, y: np.ndarray, x: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the ``n`` rows of ``y`` nearest to ``x`` (ties: smaller name), given rough squares."""
    last = np.partition(rough, n - 1)[n - 1]
    near = np.flatnonzero(rough <= last + 1e-9 * (1 + abs(last)))
    exact = np.sqrt(((y[near] - x) ** 2).sum(axis=1))
    best = np.lexsort((names[near], exact))[:n]
    return near[best], exact[best]


def _placed(rows: DataFrame, model) -> DataFrame:
    """The index: number of the row, vec_id, asked, partition and packed vector. Other lengths get partitions below 0."""

    def run(batches):
        release()
        router, common = model.value
        for batch in batches:
            lengths = batch.column(2).to_numpy(zero_copy_only=False)
            part, packed = -lengths.astype(np.int32), [None] * batch.num_rows
            values, offsets = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            for i, (at, n) in enumerate(zip(offsets.tolist(), lengths.tolist(), strict=True)):
                packed[i] = values[at : at + n].tobytes()
            if len(same := np.flatnonzero(lengths == common)):
                part[same] = router.ranked(np.stack([values[offsets[i] : offsets[i] + common] for i in same]))[:, 0] if router else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(part), pa.array(packed, pa.binary())], ["vec_id", "asked", "turn", "part", "vector"])

    found = rows.select("vec_id", "asked", "length", "vector", _turn(F.col("vector")).alias("turn")).mapInArrow(run, "vec_id long, asked boolean, turn long, part int, vector binary")
    return written(found.select(F.monotonically_increasing_id().alias("row"), "*"), "index")


def _turn(vector: Column) -> Column:
    """The order of rows whose first ones are the sample, and whose last ones the probes."""
    return F.xxhash64("vec_id", vector, F.lit(23))


def _visits(index: DataFrame, router: Router, k: int, outside: int) -> int:
    """Partitions that a query has to visit, from an exact search of all rows for vectors outside the sample, which leaves
    ``outside`` rows."""
    probes = index.where("part >= 0").orderBy(F.col("turn").desc(), F.desc("vec_id")).select("row", "vector").limit(min(PROBES, outside)).toPandas()
    x, own = np.stack([np.frombuffer(v, np.float64) for v in probes["vector"]]), probes["row"].to_numpy()
    asked = index.sparkSession.sparkContext.broadcast((x, own))  # PROBES vectors

    def run(batches):
        x, own = asked.value
        found = [[] for _ in own]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                rows, part, y = some.column(0).to_numpy(), some.column(1).to_numpy(), _vectors(some.column(2))
                rough = (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
                rough[rows[None, :] == own[:, None]] = np.inf
                for i in range(len(own)):
                    if n := min(k, int(np.isfinite(rough[i]).sum())):
                        places, exact = _best(rough[i], y, x[i], rows, n)
                        found[i] = sorted([*found[i], *zip(exact.tolist(), rows[places].tolist(), part[places].tolist(), strict=True)])[:k]
        flat = [(i, *r) for i, some in enumerate(found) for r in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["probe", "score", "row", "part"])

    best = index.where("part >= 0").select("row", "part", "vector").mapInArrow(run, "probe int, score double, row long, part int")
    best = best.withColumn("i", F.row_number().over(Window.partitionBy("probe").orderBy("score", "row"))).where(F.col("i") <= k).toPandas()  # PROBES x k rows
    place = np.argsort(router.ranked(x), axis=1)
    reached = np.sort(place[best["probe"], best["part"]])
    return int(reached[min(len(reached) - 1, int(np.ceil(RECALL * len(reached))))]) + 1 if len(reached) else 1


def nearest(df: DataFrame, asked: Column | str = "vec_id % 100 = 0", k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, target: int = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest rows of ``df`` for each row that is ``asked``."""
    spark = df.sparkSession
    ship(spark)
    rows = usable(df, vec_id, embedding, F.expr(asked) if isinstance(asked, str) else asked)
    sizes = rows.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1000).collect()
    common, total = (sizes[0]["length"], sizes[0]["count"]) if sizes else (0, 0)
    router, learned = None, 0
    if total > 2 * k:  # fewer rows are one partition, which is searched whole
        learned = min(sample, max(total - PROBES, total // 2))
        some = rows.where(F.col("length") == common).select("vec_id", "vector").orderBy(_turn(F.col("vector")), "vec_id").limit(learned).toPandas()  # bounded by sample
        x = np.array(some["vector"].tolist())
        router = learn(x, max(2, min(-(-total // target), len(x) // EDGES)))
        del some, x
    model = spark.sparkContext.broadcast((router, common))  # two small matrices
    index = _placed(rows, model)
    parts = router.parts if router else 1
    visits = _visits(index, router, k, total - learned) if router else 1

    def probes(frame: DataFrame, limit: int) -> DataFrame:
        """Query rows, once for each partition that they visit."""

        def run(batches):
            for batch in batches:
                home = batch.column(2).to_numpy()
                where = [np.array([x]) for x in home]
                if model.value[0] is not None and len(same := np.flatnonzero(home >= 0)):
                    order = model.value[0].ranked(_vectors(batch.column(3).take(pa.array(same))))[:, :limit]
                    for i, x in zip(same.tolist(), order, strict=True):
                        where[i] = x
                at = pa.array(np.repeat(np.arange(len(where)), [len(x) for x in where]))
                part = np.concatenate(where).astype(np.int32) if where else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(part), batch.column(3).take(at)], ["row", "vec_id", "part", "vector"])

        return written(frame.select("row", "vec_id", "part", "vector").mapInArrow(run, "row long, vec_id long, part int, vector binary"), "queries")

    blocks = index.groupBy("part").agg(F.ceil(F.count("*") / CANDIDATES).alias("blocks"))  # one row a partition

    def search(frame: DataFrame) -> DataFrame:
        wide = frame.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).alias("wide"))
        shape = F.broadcast(blocks.join(wide, "part"))
        no, yes = F.lit(False).alias("asked"), F.lit(True).alias("asked")
        candidates = index.join(shape, "part").select("row", "vec_id", "vector", "part", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("y"), no)
        wanted = frame.join(shape, "part").select("row", "vec_id", "vector", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.pmod(F.xxhash64("row"), F.col("wide")).alias("y"), yes)

        def compare(table: pa.Table) -> pa.Table:
            rows, ids, is_query = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), table.column("asked").to_numpy(zero_copy_only=False)
            own, other = np.flatnonzero(is_query), np.flatnonzero(~is_query)
            queries, found, scores = [], [], []
            if len(own) and len(other):
                y, names, numbers = _vectors(table.column("vector").take(pa.array(other))), ids[other], rows[other]
                norms, step = (y * y).sum(axis=1), max(1, AT_ONCE // len(other))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    x = _vectors(table.column("vector").take(pa.array(some)))
                    rough = norms[None, :] - 2 * (x @ y.T)
                    rough[numbers[None, :] == rows[some][:, None]] = np.inf
                    for i, j in enumerate(some):
                        if n := min(k, int(np.isfinite(rough[i]).sum())):
                            places, exact = _best(rough[i], y, x[i], names, n)
                            queries.append(np.full(len(places), rows[j]))
                            found.append(names[places])
                            scores.append(exact)
            flat = [np.concatenate(v) if v else np.zeros(0, t) for v, t in ((queries, np.int64), (found, np.int64), (scores, np.float64))]
            return pa.table({"query": pa.array(flat[0], pa.int64()), "vec_id": pa.array(flat[1], pa.int64()), "score": pa.array(flat[2], pa.float64())})

        pairs = candidates.union(wanted).groupBy("part", "x", "y").applyInArrow(compare, "query long, vec_id long, score double")
        return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= k)

    queries = index.where("asked")
    first = probes(queries, visits)
    found = written(search(first), "found")
    per_length = index.groupBy(F.length("vector").alias("size")).agg(F.least(F.count("*") - 1, F.lit(k)).alias("whole"))  # one row a length
    short = queries.select("row", "vec_id", "part", "vector", F.length("vector").alias("size")).join(F.broadcast(per_length), "size")
    short = short.join(found.groupBy("query").count(), F.col("row") == F.col("query"), "left").where(F.coalesce("count", F.lit(0)) < F.col("whole")).select("row", "vec_id", "part", "vector")
    result = found
    if visits < parts and not short.isEmpty():
        short = written(short, "short")
        again = written(search(probes(short, parts)), "found")
        result = found.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionByName(again)
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    result = written(result.join(names, "query").select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(index, first, found)
    return result
