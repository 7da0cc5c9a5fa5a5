"""Toxicity by a classifier chain.

The chain predicts categories one after the other with linear models; each model sees the text's features and the
probabilities of all earlier categories. In training those probabilities come from models that did not see the row
(out-of-fold), as they will for new rows. Categories, in order, all learned from the one given label:

* ``abusive``: labelled toxic and holding at least one learned term,
* ``insistent``: labelled toxic and holding terms at ``INSISTENT`` places or more,
* ``toxic``: the label itself. Its probability decides.

Features are the presence of learned terms: whole words and word beginnings of four to six letters (endings vary) that
labelled toxic texts hold clearly more often than others. The learning sample is bounded: at most ``PER_CLASS`` labelled
rows of each class, and the ``TERMS`` clearest terms. Every text is scored whole.

Edge cases: a null or empty text has no features, is scored like any other text without terms, and is not toxic; with
no usable label of both classes nothing is learned and nothing is toxic; equal rows get equal scores; null ids are
scored; a label without its document is ignored; of several texts under one labelled id the smallest is learned from;
an empty table gives an empty table; a very long text is scored whole, part by part; columns of the input with the name
of a result's column give way to it.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.arrow import PieceCache, held, slices, with_columns, without
from feedloom.llm.labelled import logistic, probability, sample
from feedloom.shared import ship, written

PER_CLASS, TERMS, FOLDS, INSISTENT = 6000, 400, 5, 3
BEGINNINGS = (4, 5, 6)
#: Documents that a term must be in, and the lower bound of its log-odds ratio.
LEAST_DOCS, LEAST_ODDS = 3, 1.0
CATEGORIES = ["abusive", "insistent", "toxic"]
_words = regex.compile(r"\w+").findall


def terms_of(word: str) -> list[str]:
    """A word and its beginnings (marked with a star)."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def learned_terms(texts: DataFrame, most: int = TERMS) -> list[str]:
    """The clearest terms of labelled texts (text, label): log-odds ratio less two standard errors, largest first."""

    def run(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in {t for w in set(_words((text or "").lower())) for t in terms_of(w)}:
                    found.setdefault(term, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x for x, _ in found.values()], pa.int64()), pa.array([x for _, x in found.values()], pa.int64())], ["term", "clean", "toxic"])

    n = {row.label: row["count"] for row in texts.groupBy("label").count().collect()}
    if len(n) < 2:
        return []
    counts = texts.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("t") >= LEAST_DOCS)
    a, b, c, d = F.col("t") + 0.5, F.lit(n[1] + 0.5) - F.col("t"), F.col("c") + 0.5, F.lit(n[0] + 0.5) - F.col("c")
    bound = F.log(a * d / (b * c)) - 2 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return [row.term for row in counts.withColumn("bound", bound).where(F.col("bound") >= LEAST_ODDS).orderBy(F.desc("bound"), "term").limit(most).collect()]


class Terms:
    """Learned terms at each place of a text: for each hit the numbers of its terms, then one mark for the place."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.place = len(terms)
        self.cache = PieceCache(lambda pieces: [self._hits(x) for x in pieces])

    def _hits(self, piece: str) -> bytes:
        out: list[int] = []
        for word in _words(piece.lower()):
            found = [self.number[t] for t in terms_of(word) if t in self.number]
            out += [*found, self.place] if found else []
        return np.array(out, "<u2").tobytes()

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Presence of each term, and the number of places with one, for each text."""
        found = self.cache.run(texts)
        x, places = np.zeros((len(texts), self.place)), np.zeros(len(texts), np.int64)
        for i, data in enumerate(found):
            if data:
                ids = np.frombuffer(data, "<u2")
                places[i] = np.count_nonzero(ids == self.place)
                x[i, ids[ids < self.place]] = 1
        return x, places


def fit_chain(x: np.ndarray, y: dict[str, np.ndarray], fold: np.ndarray, categories: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Models in chain order, and the out-of-fold probabilities of the last category."""
    models, columns = [], x
    for name in categories:
        out = np.zeros(len(x))
        for k in range(FOLDS):
            inside = fold != k
            if inside.any() and not inside.all():
                out[~inside] = probability(columns[~inside], logistic(columns[inside], y[name][inside]))
        models.append(logistic(columns, y[name]))
        columns = np.column_stack([columns, out])
    return models, columns[:, -1]


def predict_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """Probabilities [row, category]."""
    columns = x
    for beta in models:
        columns = np.column_stack([columns, probability(columns, beta)])
    return columns[:, x.shape[1] :]


def threshold(p: np.ndarray, y: np.ndarray, share: float) -> float:
    """Middle of the best gap between probabilities by the F1 score, with toxic rows weighted to ``share`` of all."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    order = np.argsort(-p, kind="stable")
    q, hit, miss = p[order], np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + (weight * y).sum())
    f1[:-1][q[:-1] == q[1:]] = -1  # a cut lies between different values only
    best = int(np.argmax(f1))
    return float((q[best] + q[best + 1]) / 2) if best + 1 < len(q) else float(q[best])


def classify(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, most_terms: int = TERMS) -> DataFrame:
    """``df`` with p_abusive, p_insistent, p_toxic and is_toxic; the models see at most ``most_terms`` learned terms."""
    ship(df.sparkSession)
    chosen = sample(labels, label, per_class)
    known = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most per_class ids a class
    known = written(known.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")
    share = labels.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    terms = learned_terms(known.select("text", "label"), most_terms)
    models, least = [], 1.0
    if terms:

        def featured(batches):
            mine = Terms(terms)
            for batch in batches:
                texts, hits, counts = batch.column(1).to_pylist(), [], []
                for some in slices(texts):
                    x, places = mine.features(texts[some])
                    hits += [np.flatnonzero(row).tolist() for row in x]
                    counts += places.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hits, pa.list_(pa.int32())), pa.array(counts, pa.int64())], ["doc_id", "label", "hits", "places"])

        rows = known.select("doc_id", "text", "label").mapInArrow(featured, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, label int, hits array<int>, places long")
        rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS))).orderBy("doc_id").toPandas()  # bounded by per_class
        x = np.zeros((len(rows), len(terms)))
        for i, hits in enumerate(rows["hits"]):
            x[i, hits] = 1
        toxic, places = rows["label"].to_numpy(float), rows["places"].to_numpy()
        y = {"abusive": toxic * (places >= 1), "insistent": toxic * (places >= INSISTENT), "toxic": toxic}
        models, out = fit_chain(x, y, rows["fold"].to_numpy(), CATEGORIES)
        least = threshold(out, toxic, min(max(share, 0.001), 0.999))
    model = df.sparkSession.sparkContext.broadcast(pickle.dumps((terms, models, least)))  # at most TERMS coefficients a model
    df = without(df, *(f"p_{c}" for c in CATEGORIES), "is_toxic")
    names, place = [*df.columns], df.columns.index(text)

    def run(batches):
        def make():
            learned = pickle.loads(model.value)
            return Terms(learned[0]), *learned[1:]

        own, models, least = held(("toxicity", hashlib.sha256(model.value).digest()), make)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for some in slices(texts):
                part = batch.slice(some.start, some.stop - some.start)
                if models:
                    p = predict_chain(own.features(texts[some])[0], models)
                else:
                    p = np.zeros((part.num_rows, len(CATEGORIES)))
                has_text = np.array([bool(x) for x in texts[some]])
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, p.T.copy()), pa.array((p[:, -1] >= least) & has_text & bool(models))], [*names, *(f"p_{c}" for c in CATEGORIES), "is_toxic"])

    return df.mapInArrow(run, with_columns(df, *(f"p_{c} double" for c in CATEGORIES), "is_toxic boolean"))
