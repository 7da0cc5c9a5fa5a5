"""Events and narratives across articles: fingerprints, clusters, summaries, matching, lifecycle, candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scores as S
from feedloom.functions.vectors import vector_sums
from feedloom.shared import discard, ship, small, written

# Bars and spans of clustering and matching.
TITLE_COSINE, TITLE_JACCARD, MERGE_HOURS, MERGE_COSINE = 0.75, 0.6, 48, 0.80
SLUG, EMBEDDING, KEYWORDS = 0.95, 0.55, 0.50
ACTIVE_AT, FADING_DAYS, DORMANT_DAYS = 20, 5, 30
DRIFT, SPLIT_BELOW, MERGE_ABOVE = 0.05, 0.50, 0.85
KNOWN_ABOVE, GROUP_ABOVE = 0.75, 0.70
#: Pivots that cells of vectors have at most, and vectors that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: Rows of a group up to which its pairs are compared without pivots.
FEW = 500
#: Rows of a block where pivots don't help, and of a frame of visits.
WIDE, VISITS = 16_000, 16_000
#: Most frequent words that are ordered by their counts in titles.
FREQUENT = 50_000
#: Centroids that are broadcast together.
CENTROIDS = 20_000


def event_fingerprint(event_type: Column, date: Column, entities: Column) -> Column:
    """SHA-256 of type, date and the first three entities in order."""
    return F.sha2(F.concat_ws("|", event_type, F.coalesce(date, F.lit("none")), F.array_join(F.slice(F.array_sort(F.transform(entities, F.lower)), 1, 3), ",")), 256)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component (the smallest id that edges lead to) of every node; edges are rows (a, b) of long ids.

    Rounds of least neighbour and pointer jumping; each round is written to the shared folder, so lineage stays short.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    now = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = now.join(near, "id").select("id", "component", F.least("component", "near").alias("new"))
        after = written(step.join(step.select(F.col("id").alias("new"), F.col("new").alias("far")), "new").select("id", F.least("new", "far").alias("component"), (F.least("new", "far") != F.col("component")).alias("moved")), "labels")
        discard(now)
        now = after
        if after.where("moved").isEmpty():
            break
    discard(both)
    return nodes.select("id").join(now.select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def star_edges(rows: DataFrame, key: str) -> DataFrame:
    """Edges from every row to the smallest id with the same key: a group costs its rows, not its pairs."""
    least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, key).where("id <> b").select(F.col("id").alias("a"), "b")


def pivots_of(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows that are far from each other: each next one is the row farthest from those before."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def near_blocks(rows: DataFrame, above: float, within: str | None = None, block: int = 2000, most: int = PIVOTS) -> DataFrame:
    """The blocks of vectors that :func:`similar_vectors` compares: g, dim, cell, kind, i, j (the block), side, id and vector.

    Vectors belong to the cell of their nearest pivot. A vector x is near a vector y of another cell, with pivot p and
    radius r, only if x p + |x| r, which x y can't exceed, is above the bar: x visits just those later cells. A cell's rows
    are compared with each other (kind 0) and with its visitors (kind 1), in blocks of ``block`` rows. Where visits would
    be more copies of a group's vectors than its wide blocks need, the group is one cell (-1), cut into those.
    """
    ship(rows.sparkSession)
    whole = "g IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)"
    kind = "array<float>" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    given = rows.select((F.col(within) if within else F.lit(0)).alias("g"), "id", F.col("vector").cast(kind).alias("vector")).where(whole).withColumn("dim", F.size("vector"))
    many = given.groupBy("g", "dim").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("g", "dim", F.lit(True).alias("many"))
    few = lambda df: df.select("g", "dim", F.lit(-1).alias("cell"), F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "id", "vector")
    if many.isEmpty():  # a group is one block, and its rows are dealt once
        return few(given.repartition("g", "dim").groupBy("g", "dim", "vector").agg(F.min("id").alias("id")))
    one = written(given.groupBy("g", "dim", "vector").agg(F.min("id").alias("id")), "vectors")
    some = one.orderBy(F.xxhash64("id", F.lit(31)), "id").select("dim", "vector").limit(PIVOT_SAMPLE).toPandas()  # bounded by the sample
    count = one.count()
    pivots = {int(dim): pivots_of(np.stack(part["vector"].to_list()).astype(float), min(most, int(count**0.5) + 1)) for dim, part in some.groupby("dim")}
    g = one.schema["g"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cell"], batch["off"] = -1, np.inf
            for dim, part in batch.groupby("dim"):
                part = part[part["many"]]
                if dim in pivots and len(part):  # a small group, and a length that the sample hasn't got, is one cell
                    x = np.stack(part["vector"].to_list()).astype(float)
                    off = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ pivots[dim].T + (pivots[dim] ** 2).sum(axis=1)[None, :], 0)
                    batch.loc[part.index, "cell"], batch.loc[part.index, "off"] = off.argmin(axis=1), np.sqrt(off.min(axis=1))
            yield batch.drop(columns="many")

    sized = one.join(small(many), ["g", "dim"], "left").select("g", "id", "vector", "dim", F.coalesce("many", F.lit(False)).alias("many"))
    placed = written(sized.mapInPandas(place, f"g {g}, id long, vector {kind}, dim int, cell int, off double"), "vector-cells")
    discard(one)
    reach = {(r.dim, r.cell): r.off for r in placed.where("cell >= 0").groupBy("dim", "cell").agg(F.max("off").alias("off")).collect()}  # one row a pivot
    radius = {dim: np.array([reach.get((dim, c), -np.inf) for c in range(len(p))]) for dim, p in pivots.items()}

    def reached(dim: int, part: pd.DataFrame) -> np.ndarray:
        """Whether a row visits a cell."""
        x, own = np.stack(part["vector"].to_list()).astype(float), part["cell"].to_numpy()
        norms, r = np.sqrt((x * x).sum(axis=1)), radius[dim]
        with np.errstate(invalid="ignore"):
            bound = x @ pivots[dim].T + norms[:, None] * r[None, :] + 1e-6 * (1 + norms[:, None] * (1 + np.abs(np.where(np.isfinite(r), r, 0)))[None, :])
        return (bound > above) & np.isfinite(r)[None, :] & (np.arange(len(r))[None, :] > own[:, None])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                visits = part[["g", "dim"]].assign(v=reached(dim, part).sum(axis=1))
                yield visits.groupby(["g", "dim"], as_index=False).agg(n=("v", "size"), v=("v", "sum"))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                step = max(1, VISITS // len(radius[dim]))
                for at in range(0, len(part), step):
                    i, cells = np.nonzero(reached(dim, rest := part.iloc[at : at + step]))
                    yield rest.iloc[i].assign(cell=cells.astype(np.int32))[["g", "id", "vector", "dim", "cell"]]

    spread = lambda n, size: F.greatest(F.least(F.lit(8), F.ceil(n / 500)), F.ceil(n / size))  # noqa: E731  for the sake of parallel tasks, then as the size asks for
    celled = placed.where("cell >= 0")
    wide = celled.mapInPandas(counted, f"g {g}, dim int, n long, v long").groupBy("g", "dim").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    wide = written(wide.where(F.col("v") > F.col("n") * spread(F.col("n"), max(block, WIDE))).select("g", "dim", F.lit(True).alias("wide")), "wide")
    placed = placed.join(small(wide), ["g", "dim"], "left").select("g", "id", "vector", "dim", F.when(F.col("wide"), -1).otherwise(F.col("cell")).alias("cell"))
    visitors = written(placed.where("cell >= 0").mapInPandas(visit, f"g {g}, id long, vector {kind}, dim int, cell int"), "vector-visits")
    key = ["g", "dim", "cell"]
    n, v = placed.groupBy(*key).agg(F.count("*").alias("n")), visitors.groupBy(*key).agg(F.count("*").alias("v"))
    parts = F.when(F.col("cell") < 0, spread(F.col("n"), max(block, WIDE))).otherwise(F.ceil(F.col("n") / block))
    shape = small(n.join(v, key, "left").select(*key, parts.cast("int").alias("p"), F.coalesce(F.ceil(F.col("v") / block), F.lit(0)).cast("int").alias("q")))
    turn = F.xxhash64("id")
    own = placed.join(shape, key).withColumn("part", F.pmod(turn, F.col("p")).cast("int"))
    inner = own.select(*key, F.lit(0).alias("kind"), "part", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("other"), "id", "vector")
    inner = inner.select(*key, "kind", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("part").alias("side"), "id", "vector")
    met = own.where("q > 0").select(*key, F.lit(1).alias("kind"), F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(0).alias("side"), "id", "vector")
    come = visitors.join(shape, key).select(*key, F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.pmod(turn, F.col("q")).cast("int").alias("j"), F.lit(1).alias("side"), "id", "vector")
    return inner.union(met).union(come)


def similar_vectors(rows: DataFrame, above: float, within: str | None = None, block: int = 2000, grouped: bool = False) -> DataFrame:
    """a, b, sim (and g, the group, if ``grouped``): all pairs of rows (id, vector) with a dot product above the bar, without a miss; see :func:`near_blocks`. A
    block is compared in one task, as a matrix product, and what is near the bar is computed again exactly.

    Equal vectors are joined once through the smallest id, so a large group of copies makes no pairs of its own. Vectors of
    different lengths and those with a null make no pair. Pivots spare the pairs of vectors that lie in groups apart; where
    vectors have no such structure the work is the square of a group's distinct vectors.
    """

    blocks = near_blocks(rows, above, within, block)
    g = blocks.schema["g"].dataType.simpleString()

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: dict[int, list] = {}
        for batch in batches:
            name, i, j, inner = batch["g"].iloc[0], batch["i"].iloc[0], batch["j"].iloc[0], batch["kind"].iloc[0] == 0
            for side, part in batch.groupby("side"):
                sides.setdefault(side, []).append((part["id"].to_numpy(), np.stack(part["vector"].to_list())))
        left, right = (sides.get(i), sides.get(j)) if inner else (sides.get(0), sides.get(1))
        if left and right:
            ids, other = (np.concatenate([part[0] for part in side]) for side in (left, right))
            x, y = (np.concatenate([part[1] for part in side]).astype(float) for side in (left, right))
            sides.clear()
            slack = 1e-9 * (1 + np.abs(x).max() * np.abs(y).max() * x.shape[1])
            for at in range(0, len(x), 256):
                p, q = np.nonzero(x[at : at + 256] @ y.T > above - slack)
                p += at
                kept = ids[p] < other[q] if inner and i == j else np.ones(len(p), bool)
                p, q = p[kept], q[kept]
                for k in range(0, len(p), 20_000):
                    u, v = p[k : k + 20_000], q[k : k + 20_000]
                    sim = np.cumsum(x[u] * y[v], axis=1)[:, -1]  # in the order of the expression dot
                    u, v, sim = u[sim > above], v[sim > above], sim[sim > above]
                    yield pd.DataFrame({"g": name, "a": np.minimum(ids[u], other[v]), "b": np.maximum(ids[u], other[v]), "sim": sim})

    found = blocks.groupBy("g", "dim", "cell", "kind", "i", "j").applyInPandas(close, f"g {g}, a long, b long, sim double")
    return found if grouped else found.drop("g")


def title_pairs(rows: DataFrame, least: float = TITLE_JACCARD, within: str | None = None) -> DataFrame:
    """a, b (and g, the group, if ``within`` is given): pairs of titles (id, words) of a group whose distinct words have a
    Jaccard similarity of ``least`` or more.

    Prefix filter: two sets that similar share one of the n - ceil(least n) + 1 rarest words of each, and the first that they
    share leaves enough words after it in both. Sets carry 256 bits that their words set, so that most pairs that share such a
    word, but too few others, end in the join. Equal sets are joined through the smallest id.
    """
    g = F.col(within) if within else F.lit(0)
    sets = written(rows.select(g.alias("g"), "id", F.array_sort(F.array_distinct("words")).alias("words")).where(F.size("words") > 0).groupBy("g", "words").agg(F.min("id").alias("id")), "titles")
    each = sets.repartition("g", "id").select("g", "id", F.explode("words").alias("word"))
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "word").limit(FREQUENT)  # any order of words will do, rare ones first spare pairs
    ordered = each.join(F.broadcast(counts), "word", "left").groupBy("g", "id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "word"))).alias("order"))
    n, bits = F.size("order"), F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(256)).cast("int"))
    word = lambda k: F.aggregate("bits", F.lit(0).cast("long"), lambda now, x: F.when(F.floor(x / 64) == k, now.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x % 64))).otherwise(now))
    ordered = ordered.select("g", "id", n.alias("n"), F.transform("order", lambda x: x["word"]).alias("words")).withColumn("bits", bits)
    ordered = written(ordered.select("g", "id", "n", "words", F.transform(F.slice("words", F.lit(1), (F.col("n") - F.ceil(least * F.col("n")) + 1).cast("int")), lambda w: F.xxhash64(w)).alias("prefix"), *[word(k).alias(f"w{k}") for k in range(4)]), "title-words")
    discard(sets)
    left = ordered.select("g", F.col("id").alias("a"), "n", *[f"w{k}" for k in range(4)], F.posexplode("prefix").alias("i", "word"))
    right = ordered.select("g", F.col("id").alias("b"), F.col("n").alias("m"), *[F.col(f"w{k}").alias(f"v{k}") for k in range(4)], F.posexplode("prefix").alias("j", "word"))
    needed = least * (F.col("n") + F.col("m")) - 1e-6  # of the words that both have, times 1 + least
    apart = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(1, 4)), F.bit_count(F.col("w0").bitwiseXOR(F.col("v0"))))
    near = left.join(right, ["g", "word"]).where((F.col("a") < F.col("b")) & (F.least("n", "m") >= least * F.greatest("n", "m")) & ((1 + least) * F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= needed) & ((1 + least) * (F.col("n") + F.col("m") - apart) / 2 >= needed)).select("g", "a", "b").distinct()
    full = near.join(ordered.select("g", F.col("id").alias("a"), F.col("words").alias("wa")), ["g", "a"]).join(ordered.select("g", F.col("id").alias("b"), F.col("words").alias("wb")), ["g", "b"])
    return full.where(S.jaccard(F.col("wa"), F.col("wb")) >= least).select(*(["g"] if within else []), "a", "b")


def cluster_events(articles: DataFrame) -> DataFrame:
    """id, event_id: articles (id, fingerprint, content_hash, event_type, title_vector, title_words) that are one event.

    Links: equal fingerprint, equal content hash, equal type with close title vectors, or similar title words; an event
    is a component of links and is named by its smallest article, whatever the order of arrival.
    """
    same_vector = articles.select("id", F.xxhash64("event_type", "title_vector").alias("v"))
    same_words = articles.where(F.size("title_words") > 0).select("id", F.xxhash64(F.array_sort(F.array_distinct("title_words"))).alias("w"))
    close = similar_vectors(articles.select("id", F.col("title_vector").alias("vector"), "event_type"), TITLE_COSINE, "event_type").select("a", "b")
    edges = star_edges(articles, "fingerprint").union(star_edges(articles, "content_hash")).union(star_edges(same_vector, "v")).union(star_edges(same_words, "w")).union(close).union(title_pairs(articles.select("id", F.col("title_words").alias("words"))))
    return components(edges, articles).withColumnRenamed("component", "event_id")


def _timed_edges(rows: DataFrame, pairs: DataFrame, span: int) -> DataFrame:
    """a, b: edges between rows (g, key, id, at, alike) of equal keys, or of keys whose least ids of a group are ``pairs``
    (g, a, b), that lie within ``span`` seconds of each other.

    Rows of a key whose times follow each other within the span are one segment, which is connected if rows of the key are
    ``alike``; two segments have rows within the span exactly if their times from first to last come that near.
    """
    times = rows.groupBy("g", "key", "at").agg(F.min("id").alias("id"), F.min("alike").alias("alike"))  # a group has so many seconds at most
    order = Window.partitionBy("g", "key").orderBy("at")
    cut = F.coalesce(F.col("at") - F.lag("at").over(order) > span, F.lit(False)) | ~F.col("alike")
    placed = times.withColumn("cut", cut.cast("int")).withColumn("segment", F.sum("cut").over(order)).withColumn("least", F.min("id").over(Window.partitionBy("g", "key")))
    ends = placed.groupBy("g", "key", "segment", "least").agg(F.min("id").alias("rep"), F.min("at").alias("first"), F.max("at").alias("last"))
    own = rows.where("alike").join(placed.select("g", "key", "at", "segment"), ["g", "key", "at"]).join(ends.select("g", "key", "segment", "rep"), ["g", "key", "segment"])
    stars = own.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    side = lambda tag: ends.select("g", F.col("least").alias(tag), F.col("rep").alias(f"{tag}_rep"), F.col("first").alias(f"{tag}_first"), F.col("last").alias(f"{tag}_last"))
    met = pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).where((F.col("a_first") <= F.col("b_last") + span) & (F.col("b_first") <= F.col("a_last") + span))
    return stars.union(met.select("a_rep", "b_rep"))


def merge_clusters(events: DataFrame, hours: int = MERGE_HOURS) -> DataFrame:
    """id, component: events (id, event_type, first_s, words, vector) of a type, within 48 hours of each other, with similar
    titles or close vectors.

    Every two events within the span share one of the overlapping windows of twice the span; in a window of a type distinct
    titles and vectors meet by prefixes and pivots (:func:`title_pairs`, :func:`similar_vectors`), and times are compared
    for what is similar only.
    """
    span = hours * 3600
    kind = "array<float>" if events.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    given = written(events.where("event_type IS NOT NULL").select("id", F.col("first_s").alias("at"), "words", F.col("vector").cast(kind).alias("vector"), F.col("event_type").cast("string").alias("event_type")), "merge-events")
    rows = given.withColumn("cell", F.explode(F.array(F.floor(F.col("at") / span) - 1, F.floor(F.col("at") / span)))).withColumn("g", F.concat_ws("|", F.col("cell").cast("string"), "event_type")).drop("cell", "event_type")
    # Two hashes of 64 bits stand for a title or a vector where only equality counts.
    twice = lambda c: F.struct(F.xxhash64(c).alias("x"), F.xxhash64(F.lit(7), c).alias("y"))
    titles = rows.where("words IS NOT NULL").select("g", twice(F.array_sort(F.array_distinct("words"))).alias("key"), "id", "at", F.lit(True).alias("alike"))
    vectors = rows.where("vector IS NOT NULL").select("g", twice(F.col("vector")).alias("key"), "id", "at", F.coalesce(S.dot(F.col("vector"), F.col("vector")) >= MERGE_COSINE, F.lit(False)).alias("alike"))
    near = similar_vectors(rows.select("g", "id", "vector"), float(np.nextafter(MERGE_COSINE, 0)), "g", grouped=True)
    edges = _timed_edges(titles, title_pairs(rows.select("g", "id", "words"), TITLE_JACCARD, "g"), span).union(_timed_edges(vectors, near.select("g", "a", "b"), span))
    return components(edges, events)


def event_summary(links: DataFrame) -> DataFrame:
    """event_id, articles, first and last time, counts of sentiments, largest impact, entities."""
    mood = F.col("sentiment")
    return links.groupBy("event_id").agg(F.count("*").alias("articles"), F.min("published_s").alias("first_s"), F.max("published_s").alias("last_s"), F.count_if(mood == "bullish").alias("bullish"), F.count_if(mood == "bearish").alias("bearish"), F.max("impact").alias("impact"), F.array_sort(F.collect_set("entity")).alias("entities"))


def close_centroids(articles: DataFrame, narratives: DataFrame, least: float, at_once: int = CENTROIDS) -> DataFrame:
    """id, slug, sim: articles (id, vector) and narratives (slug, centroid) with a dot product of ``least`` or more.

    The centroids are broadcast as matrices of ``at_once`` rows at most, and a batch of articles is multiplied by one after
    the other where it is: articles aren't moved, and only close pairs become rows. Vectors and centroids that are null, or
    of different lengths, make no pair.
    """
    ship(articles.sparkSession)
    usable = narratives.where("centroid IS NOT NULL AND size(centroid) > 0").select("slug", F.col("centroid").cast("array<double>").alias("centroid"))
    parts = -(-usable.count() // at_once)
    rows, out = articles.where("vector IS NOT NULL AND size(vector) > 0").select("id", F.col("vector").cast("array<double>").alias("vector")), None
    kinds = f"id {articles.schema['id'].dataType.simpleString()}, slug {narratives.schema['slug'].dataType.simpleString()}, sim double"
    for part in range(max(parts, 1)):
        some = (usable if parts < 2 else usable.where(F.pmod(F.xxhash64("slug", "centroid"), F.lit(parts)) == part)).toPandas()  # about at_once rows
        groups = [(np.array(g["slug"]), np.stack(g["centroid"].to_list())) for _, g in some.groupby(some["centroid"].map(len))] if len(some) else []
        shared = articles.sparkSession.sparkContext.broadcast(groups)

        def near(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                lengths = batch["vector"].map(len)
                for slugs, y in shared.value:
                    own = batch[lengths == y.shape[1]]
                    for at in range(0, len(own), 256):
                        ids, x = own["id"].to_numpy()[at : at + 256], np.stack(own["vector"].to_list()[at : at + 256])
                        i, j = np.nonzero(x @ y.T >= least - 1e-9 * (1 + np.abs(x).max() * np.abs(y).max() * x.shape[1]))
                        sim = np.cumsum(x[i] * y[j], axis=1)[:, -1] if len(i) else np.zeros(0)  # in the order of the expression dot
                        kept = sim >= least
                        yield pd.DataFrame({"id": ids[i[kept]], "slug": slugs[j[kept]], "sim": sim[kept]})

        found = rows.mapInPandas(near, kinds)
        out = found if out is None else out.union(found)
    return out


def select_narratives(articles: DataFrame, narratives: DataFrame, tau: float = 0.30, k: int = 3) -> DataFrame:
    """id, slug, rank: the first ``k`` narratives at or above ``tau``, by similarity; those of crypto alone only for
    texts with a crypto term. Ids and slugs are unique."""
    close = close_centroids(articles, narratives, tau).join(small(narratives.select("slug", "narrative_pos", "crypto_only")), "slug")
    plain = close.where(~F.col("crypto_only")).unionByName(close.where("crypto_only").join(articles.where("has_crypto").select("id"), "id", "left_semi"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "narrative_pos"))
    return plain.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "slug", "rank")


def match_narratives(articles: DataFrame, narratives: DataFrame) -> DataFrame:
    """id, slug, signal, score: by equal slug, else close vectors, else shared keywords; the best signal of each pair. Each
    signal is a join of its own; ids and slugs are unique."""
    named = articles.select("id", F.explode(F.array_distinct("slugs")).alias("slug")).join(small(narratives.select("slug")), "slug")
    words = lambda c: F.array_distinct(F.transform(c, F.lower))
    own = articles.select("id", F.size(words("keywords")).alias("n"), F.explode(words("keywords")).alias("word"))
    theirs = narratives.select("slug", F.size(words("narrative_keywords")).alias("m"), F.explode(words("narrative_keywords")).alias("word"))
    both = own.join(small(theirs), "word").groupBy("id", "slug").agg(F.count("*").alias("both"), F.max("n").alias("n"), F.max("m").alias("m"))
    overlap = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    found = (
        named.select("id", "slug", F.lit(1).alias("order"), F.lit("slug").alias("signal"), F.lit(SLUG).alias("score"))
        .unionByName(close_centroids(articles, narratives, EMBEDDING).select("id", "slug", F.lit(2).alias("order"), F.lit("embedding").alias("signal"), F.col("sim").alias("score")))
        .unionByName(both.where(overlap >= KEYWORDS).select("id", "slug", F.lit(3).alias("order"), F.lit("keywords").alias("signal"), overlap.alias("score")))
    )
    best = F.min(F.struct("order", "signal", "score")).alias("best")
    return found.groupBy("id", "slug").agg(best).select("id", "slug", "best.signal", "best.score")


def narrative_intensity(links: DataFrame) -> DataFrame:
    """slug, day, articles, sentiment: every day from a narrative's first to its last, zeros included."""
    daily = links.groupBy("slug", "day").agg(F.count("*").alias("articles"), F.avg("sentiment").alias("sentiment"))
    days = daily.groupBy("slug").agg(F.sequence(F.min("day"), F.max("day")).alias("d")).select("slug", F.explode("d").alias("day"))
    return days.join(daily, ["slug", "day"], "left").select("slug", "day", F.coalesce("articles", F.lit(0)).alias("articles"), "sentiment")


def _days(links: DataFrame) -> DataFrame:
    """slug, day, articles so far, the gaps before and after, and whether it was dormant before: one row for each day of a
    narrative that has articles."""
    days = links.groupBy("slug", "day").agg(F.count("*").alias("n"))
    order = Window.partitionBy("slug").orderBy("day")  # rows are days, however many articles they have
    rows = days.select("slug", "day", F.sum("n").over(order).alias("articles"), F.lag("day").over(order).alias("before"), F.lead("day").over(order).alias("after"))
    woken = F.max(F.coalesce(F.col("day") - F.col("before") >= DORMANT_DAYS, F.lit(False))).over(order)
    return rows.withColumn("woken", woken)


def _awake() -> Column:
    """The state of a narrative on a day with articles: one that was dormant is active at once."""
    return F.when((F.col("articles") >= ACTIVE_AT) | F.col("woken"), "active").otherwise("emerging")


def narrative_history(links: DataFrame, as_of_day: int) -> DataFrame:
    """slug, from_day, state: a row for each change of state up to ``as_of_day``.

    A narrative is emerging, then active with enough articles; it is fading after five days without one and dormant after
    thirty; the next article wakes it: active if it was dormant, or if it has enough articles.
    """
    rows = _days(links.where(F.col("day") <= as_of_day)).withColumn("until", F.coalesce("after", F.lit(as_of_day + 1)))
    quiet = lambda days, name: rows.where(F.col("until") > F.col("day") + days).select("slug", (F.col("day") + days).alias("from_day"), F.lit(name).alias("state"))
    states = rows.select("slug", F.col("day").alias("from_day"), _awake().alias("state")).union(quiet(FADING_DAYS, "fading")).union(quiet(DORMANT_DAYS, "dormant"))
    # At the same day an article counts before the silence that would begin there.
    states = states.groupBy("slug", "from_day").agg(F.min_by("state", F.col("state").isin("fading", "dormant")).alias("state"))
    before = F.lag("state").over(Window.partitionBy("slug").orderBy("from_day"))
    return states.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("state"))).select("slug", "from_day", "state")


def narrative_lifecycle(links: DataFrame, as_of_day: int) -> DataFrame:
    """slug, articles, idle_days, state: the state of :func:`narrative_history` on ``as_of_day``."""
    last = _days(links).groupBy("slug").agg(F.max("articles").alias("articles"), (F.lit(as_of_day) - F.max("day")).alias("idle_days"), F.max("woken").alias("woken"))
    state = F.when(F.col("idle_days") >= DORMANT_DAYS, "dormant").when(F.col("idle_days") >= FADING_DAYS, "fading").otherwise(_awake())
    return last.withColumn("state", state).drop("woken")


def narrative_candidates(unmatched: DataFrame, as_of_day: int, days: int = 7, articles: int = 10, sources: int = 3) -> DataFrame:
    """keyword, articles, sources of keywords that enough articles and sources of the last days share."""
    rows = unmatched.where(F.col("day").between(as_of_day - days + 1, as_of_day)).select("id", "source", F.explode(F.array_distinct("keywords")).alias("keyword"))
    return rows.groupBy("keyword").agg(F.countDistinct("id").alias("articles"), F.countDistinct("source").alias("sources")).where((F.col("articles") >= articles) & (F.col("sources") >= sources))


def candidate_groups(candidates: DataFrame, narratives: DataFrame) -> DataFrame:
    """id, merged_into, group_id of candidates (id, vector): the narrative (slug, centroid) that a candidate is closest to if
    it is too close to be promoted (cosine above ``KNOWN_ABOVE``, ties to the smaller slug), else the smallest id of the
    candidates that links of cosine above ``GROUP_ABOVE`` lead to. A candidate without a vector stays by itself.
    """
    length = S.norm(F.col("vector"))
    rows = written(candidates.select("id", F.when(length > 0, F.transform("vector", lambda x: x / length)).alias("vector")), "candidates")
    far = S.norm(F.col("centroid"))
    known = small(narratives.select("slug", F.when(far > 0, F.transform("centroid", lambda x: x / far)).alias("centroid")))
    sim = S.dot(F.col("vector"), F.col("centroid"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "slug"))
    near = rows.join(known, sim > KNOWN_ABOVE).select("id", "slug", sim.alias("sim")).withColumn("i", best).where("i = 1").select("id", F.col("slug").alias("merged_into"))
    near = written(near, "merged")
    left = written(rows.join(near, "id", "left_anti"), "candidates")
    edges = similar_vectors(left, GROUP_ABOVE).select("a", "b").union(star_edges(left, "vector"))
    groups = components(edges, left).select("id", F.col("component").alias("group_id"))
    return rows.select("id").join(near, "id", "left").join(groups, "id", "left")


def centroid_drift(vectors: DataFrame, alpha: float = DRIFT) -> DataFrame:
    """slug, centroid: the moving average of a narrative's vectors (slug, seq, vector) in order, of length one after each
    step. Order is part of the result, so a narrative is folded by one task, which reads it as a sorted stream and holds
    one centroid and one Arrow batch, however many rows the narrative has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slug, now = None, None
        for batch in batches:
            done = []
            for s, v in zip(batch["slug"], batch["vector"], strict=True):
                s, x = None if pd.isna(s) else s, np.asarray(v, float)
                if now is not None and s != slug:
                    done.append((slug, now.tolist()))
                    now = None
                slug, now = s, x if now is None else (1 - alpha) * now + alpha * x
                now = now / max(np.linalg.norm(now), 1e-12)
            yield pd.DataFrame(done, columns=["slug", "centroid"])
        if now is not None:
            yield pd.DataFrame([(slug, now.tolist())], columns=["slug", "centroid"])

    rows = vectors.select("slug", "seq", "vector").repartition("slug").sortWithinPartitions("slug", "seq")
    return rows.drop("seq").mapInPandas(run, "slug string, centroid array<double>")


def split_candidates(vectors: DataFrame, below: float = SPLIT_BELOW) -> DataFrame:
    """slug, n, cohesion of groups whose mean pairwise similarity is low, from the sum of their unit vectors: no pairs."""
    length = F.aggregate("total", F.lit(0.0), lambda q, x: q + x * x)
    rows = vector_sums(vectors, "slug", "vector").select("slug", "n", length.alias("q")).where("n > 1")
    return rows.select("slug", "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion")).where(F.col("cohesion") < below)


def merge_candidates(centroids: DataFrame, above: float = MERGE_ABOVE) -> DataFrame:
    """a, b, sim: pairs of narratives with close centroids. Narratives are a few dozen rows."""
    left = centroids.select(F.col("slug").alias("a"), F.col("centroid").alias("ca"))
    right = centroids.select(F.col("slug").alias("b"), F.col("centroid").alias("cb"))
    return left.join(small(right), F.col("a") < F.col("b")).select("a", "b", S.cosine(F.col("ca"), F.col("cb")).alias("sim")).where(F.col("sim") > above)


def narrative_text(narratives: DataFrame, model: str, dim: int) -> DataFrame:
    """slug, text, stale: what is embedded of a narrative, and whether it has to be embedded anew."""
    text = F.concat(F.col("name"), F.lit(". "), F.col("description"), F.lit(". "), F.array_join("keywords", ", "))
    return narratives.select("slug", text.alias("text"), (F.col("centroid").isNull() | (F.size("centroid") != dim) | ~F.col("model").eqNullSafe(model)).alias("stale"))


def consensus_read(variants: DataFrame) -> DataFrame:
    """article_id, field, label, confidence: the label that most analyses gave, ties to the smallest."""
    counts = variants.groupBy("article_id", "field", "label").agg(F.count("*").alias("n"))
    order = Window.partitionBy("article_id", "field").orderBy(F.desc("n"), "label")
    return counts.withColumn("i", F.row_number().over(order)).withColumn("total", F.sum("n").over(Window.partitionBy("article_id", "field"))).where("i = 1").select("article_id", "field", "label", (F.col("n") / F.col("total")).alias("confidence"))


def trending_events(links: DataFrame, as_of_day: int, k: int, recent: int = 2, before: int = 7) -> DataFrame:
    """The ``k`` events with most momentum: articles of the last days over the daily rate before."""
    rows = links.groupBy("event_id").agg(F.count_if(F.col("day") > as_of_day - recent).alias("recent"), F.count_if(F.col("day").between(as_of_day - recent - before + 1, as_of_day - recent)).alias("earlier"))
    momentum = F.col("recent") / recent / (F.col("earlier") / before + 1)
    return rows.withColumn("momentum", momentum).orderBy(F.desc("momentum"), "event_id").limit(k)


def feed_stats(analyses: DataFrame) -> DataFrame:
    """source, day, sentiment, articles with totals over each (grouping sets)."""
    return analyses.cube("source", "day", "sentiment").agg(F.count("*").alias("articles"), F.grouping_id().cast("long").alias("level")).where("level IN (0, 3, 5, 6, 7)")
