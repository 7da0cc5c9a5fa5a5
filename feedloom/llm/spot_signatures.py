"""Document fingerprints by spot signatures: short chains of content words that follow common words.

Words are lower-cased (A-Z) runs of letters and digits. Common words of several languages are anchors; each anchor that
stands directly before a content word makes one signature: the anchor, that content word and the ``CHAIN - 1`` content
words after it (further anchors between them are passed over). Boilerplate without running prose makes few of them, so a
document is told by its prose. A fingerprint is the sorted set of its signatures, each hashed to ten hexadecimal
digits, joined by commas. A text that has words but no signature (no anchor, or too few words after one) has one
signature of all its words, so that texts without prose are like their copies only.

Likeness of two fingerprints is the Jaccard similarity of their sets; equal ones have 1. Sets are compared within
partitions of set length: two sets whose lengths differ by more than the wanted likeness allows can't reach it, and
are told apart by their lengths alone.

:func:`similar` finds all pairs of a table. Fingerprints are one class each, whatever the number of their documents.
Each class is put under the rarest of its signatures, just as many as a partner of the wanted likeness can't all lack
(so no pair is lost), in its own partition of lengths and the next one. Pairs under a signature are checked by length
and by the place of the signature in both sets before any set is read, and then on whole sets.

All of it is built-in functions on whole-row projections and equality joins: no Python, no pandas, no group in one task.

Edge cases: a null text counts as empty; a text without words has the empty fingerprint; two empty fingerprints are
equal (likeness 1); equal rows, equal ids and null ids are kept, each row with its own result; ties in the order of
documents go by a hash of their text; columns other than the id and the text are not read, whatever their names; an
empty table gives an empty table; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.arrow import row_key
from feedloom.shared import small, written

#: Content words in a chain, and hexadecimal digits of a signature's hash.
CHAIN, DIGITS = 2, 10
# Common words of English, French, German and Spanish.
ANCHORS = sorted(
    set(
        "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was we were which will with would you "
        "au aux avec ce cette ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa se ses son sont sur un une vous à été "
        "als am auch auf aus bei bis das dem den der die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so und vom von war wie wird zu zum zur über "
        "al como con del el ella ello ha las lo los más me mi muy no o para pero por sin sobre su sus también unos y ya".split()
    )
)
#: What parts the words of a text that was lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures (hashes below 2^40) of a text; an empty array where it has no word."""

    def shifted(values: Column, by: int) -> Column:
        return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))

    def made(words: Column) -> Column:
        before = F.concat(F.array(F.lit("")), words)
        pairs = F.zip_with(before, words, lambda x, y: F.struct(x.alias("before"), y.alias("word")))
        content = F.filter(pairs, lambda p: ~F.coalesce(p["word"], F.lit("a")).isin(ANCHORS))
        return _let(content, lambda c: _let(F.transform(c, lambda p: p["word"]), lambda own: chains(c, own, words)))

    def chains(content: Column, own: Column, words: Column) -> Column:
        found = F.transform(content, lambda p: F.when(p["before"].isin(ANCHORS), F.concat_ws(" ", p["before"], p["word"])))
        for i in range(1, chain):
            found = F.zip_with(found, shifted(own, i), lambda x, y: F.concat(x, F.lit(" "), y))
        found = F.filter(found, lambda x: x.isNotNull())
        whole = F.filter(F.array(F.array_join(words, " ")), lambda x: x != "")
        return _let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(whole))

    words = F.array_remove(F.split(F.regexp_replace(lowered(text), GAP, " "), " "), "")
    hashed = F.transform(_let(words, made), lambda x: F.conv(F.substring(F.md5(x), 1, DIGITS), 16, 10).cast("long"))
    return F.sort_array(F.array_distinct(hashed))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, whatever the number of places that name it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(found: Column) -> Column:
    """The fingerprint of a set of signatures."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), ",")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets of signatures; 0 where their lengths alone rule ``least`` out; 1 for equal sets."""
    both = F.size(F.array_intersect(a, b))
    exact = F.when(a == b, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))
    return F.when(F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b)), exact).otherwise(0.0)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, signatures and fingerprint of every row."""
    found = df.select(F.col(doc_id).alias("doc_id"), signatures(F.col(text)).alias("signatures"))
    return found.select("*", fingerprint(F.col("signatures")).alias("fingerprint"))


def length_partition(size: Column, least: float) -> Column:
    """The partition of a set length; sets of partitions that aren't equal or next to each other can't reach ``least``."""
    return F.floor(F.log(size.cast("double")) / -F.log(F.lit(least)) + 1e-9).cast("long")


def similar(df: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints whose likeness is ``least`` or more (a, b, likeness: numbers of classes, a < b), and
    the members of the classes (doc_id, class)."""
    rows = written(fingerprints(df, doc_id, text).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "signatures", *row_key(F.col("fingerprint"))), "spots")
    owners = rows.groupBy("row", "row2").agg(F.min("uid").alias("class"))
    members = written(rows.select("doc_id", "row", "row2").join(owners, ["row", "row2"]).select("doc_id", "class"), "spot-members")
    classes = written(rows.join(owners.select(F.col("class").alias("uid")), "uid").where(F.size("signatures") > 0).select(F.col("uid").alias("class"), "signatures", F.size("signatures").alias("n")), "spot-classes")
    # Rarest first: a set of n signatures shares one of its n - ceil(least * n) + 1 rarest with every partner.
    posted = classes.select("class", "n", F.explode("signatures").alias("signature"))
    often = posted.groupBy("signature").agg(F.count("*").alias("often")).where("often > 1")
    line = Window.partitionBy("class").orderBy("often", "signature")
    # Signatures of one class only are rarer than any other, so that only their number counts.
    shared = posted.join(often, "signature").withColumn("place", F.row_number().over(line)).withColumn("n_shared", F.count("*").over(Window.partitionBy("class")))
    place = F.col("place") + F.col("n") - F.col("n_shared")
    part = length_partition(F.col("n"), least)
    prefix = written(shared.select("class", "n", "signature", "often", place.alias("place"), part.alias("part")).where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1), "spot-prefixes")
    left = prefix.select("signature", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("at_a"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select("signature", "part", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("at_b"))
    # What both can still share from this signature on bounds their likeness; a pair of one partition is taken once.
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    before = F.least(F.col("at_a"), F.col("at_b")) - 1
    once = (length_partition(F.col("n_a"), least) < F.col("part")) | (F.col("a") < F.col("b"))
    fits = (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9) & ((rest + before) * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9)
    pairs = left.join(right, ["signature", "part"]).where(once & fits).select("a", "b").distinct()
    own, other = classes.select(F.col("class").alias("a"), F.col("signatures").alias("own")), classes.select(F.col("class").alias("b"), F.col("signatures").alias("other"))
    found = pairs.join(own, "a").join(other, "b").select("a", "b", likeness(F.col("own"), F.col("other"), least).alias("likeness")).where(F.col("likeness") >= least)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members


def successors(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, row, row2 and others) with ``next``, a struct of the row after it in descending order of doc_id
    (nulls last, ties by row and row2); after the last comes the first.

    A range-partitioned sort with one edge row a partition; only keys travel.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("row").asc(), F.col("row2").asc()]
    placed = written(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "doc-order")
    inside, line = Window.partitionBy("part").orderBy(*order), Window.orderBy("part")
    me = F.struct(*[F.col(f"`{c}`") for c in keys.columns])
    heads = placed.withColumn("at", F.row_number().over(inside)).where("at = 1").select("part", me.alias("head"))  # one row a partition
    first = F.first("head").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("part", F.coalesce(F.lead("head").over(line), first).alias("after"))
    return placed.join(small(after), "part").select(*keys.columns, F.coalesce(F.lead(me).over(inside), F.col("after")).alias("next"))


def compare_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last floor(n_chars / share) characters replaced by the first as many (or all) of the next
    document in descending order of ids; a row that is repeated is followed by its copies. Whole texts are shuffled once,
    by their key; to the document before it a text sends only the beginning that this one takes, and its signatures.
    """
    key = ["row", "row2"]
    docs = df.select(F.col(doc_id).alias("doc_id"), *row_key(F.col(doc_id), F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = docs.groupBy("doc_id", *key).agg(F.count("*").alias("n"), F.max(F.char_length("text").cast("long")).alias("n_chars"))
    line = written(successors(keys), "doc-line")
    repeated = not line.where("n > 1").isEmpty()
    texts = docs.select(*key, "text")
    texts = texts.dropDuplicates(key) if repeated else texts
    takes = F.floor(F.col("n_chars") / share).cast("int")
    wanted = line.select(F.col("next.row").alias("row"), F.col("next.row2").alias("row2"), F.col("row").alias("to"), F.col("row2").alias("to2"), takes.alias("takes"))
    sent = texts.join(wanted, key).select(F.col("to").alias("row"), F.col("to2").alias("row2"), F.expr("left(text, takes)").alias("taken"), signatures(F.col("text")).alias("after"))
    rows = texts.join(line.select("doc_id", *key, "n", "n_chars", takes.alias("takes")), key).join(sent, key)
    rows = rows.select("doc_id", "n", "n_chars", "takes", "text", "taken", signatures(F.col("text")).alias("own"), "after", F.lit(1).cast("long").alias("times"))
    if repeated:
        again = rows.where("n > 1").withColumns({"taken": F.expr("left(text, takes)"), "after": F.col("own"), "times": F.col("n") - 1})
        rows = rows.union(again)
    edited = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - takes as int)), taken)")).withColumn("changed", signatures(F.col("edited")))
    found = edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
        *(["times"] if repeated else []),
    )
    return found.withColumn("times", F.explode(F.expr("sequence(1L, times)"))).drop("times") if repeated else found


def oracle(chain: int = CHAIN, share: int = 3) -> str:
    """DuckDB SQL for :func:`compare_edited` over documents (doc_id unique)."""
    known = ", ".join(f"'{w}'" for w in ANCHORS)
    def spots(name: str, source: str, text: str) -> str:
        return rf"""
{name}_w AS (SELECT doc_id, regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {source}),
{name}_p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM {name}_w),
{name}_b AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), '') AS b FROM {name}_p),
{name}_c AS (SELECT doc_id, b, w, {", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{k}" for k in range(1, chain))} FROM {name}_b WHERE w NOT IN (SELECT w FROM anchors)),
{name}_s AS (SELECT doc_id, list_sort(list(DISTINCT left(md5(b || ' ' || w{"".join(f" || ' ' || w{k}" for k in range(1, chain))}), {DIGITS}))) AS sigs FROM {name}_c WHERE b IN (SELECT w FROM anchors) AND w{chain - 1} IS NOT NULL GROUP BY doc_id),
{name} AS (SELECT doc_id, CASE WHEN sigs IS NOT NULL THEN sigs WHEN len(ws) > 0 THEN [left(md5(array_to_string(ws, ' ')), {DIGITS})] ELSE [] END AS sigs FROM {name}_w LEFT JOIN {name}_s USING (doc_id))"""

    near = "CASE WHEN {a} = {b} THEN 1.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    return f"""
WITH anchors(w) AS (SELECT unnest([{known}])),
docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
line AS (SELECT *, lead(doc_id) OVER (ORDER BY doc_id DESC) AS after FROM docs),
pairs AS (SELECT l.doc_id, l.text, l.n, d.doc_id AS next_id, d.text AS next_text FROM line l JOIN docs d ON d.doc_id = coalesce(l.after, (SELECT max(doc_id) FROM docs))),
edited AS (SELECT doc_id, left(text, n - n // {share}) || left(next_text, n // {share}) AS text FROM pairs),
{spots("own", "docs", "text")},
{spots("changed", "edited", "text")}
SELECT p.doc_id, p.n AS n_chars, sha256(e.text) AS edited_sha256, array_to_string(o.sigs, ',') AS fingerprint, array_to_string(c.sigs, ',') AS edited_fingerprint,
{near.format(a="o.sigs", b="c.sigs")} AS near_edited, {near.format(a="o.sigs", b="x.sigs")} AS near_next
FROM pairs p JOIN edited e USING (doc_id) JOIN own o USING (doc_id) JOIN changed c USING (doc_id) JOIN own x ON x.doc_id = p.next_id"""
