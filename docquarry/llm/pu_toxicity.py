"""Toxicity by positive-unlabelled learning with a non-negative risk estimator.

The classifier is linear over the presence of hashed words and of beginnings of words (4 and 6 bytes). It is fitted with numpy on a bounded sample: at most
`most_positive` confirmed toxic texts and `most_unlabelled` texts of any kind. Labels of 0 serve for the class prior
only: the share of toxic rows among the labelled ones, or less where the words of toxic texts are rarer in any texts. With P the toxic texts, U the others and l the logistic loss,
the risk is

    prior * E_P[l(f, 1)] + max(0, E_U[l(f, 0)] - prior * E_P[l(f, 0)])

as the unlabelled texts hold toxic ones by the prior. The second part can't be negative for clean texts; where the
estimate is, it counts as 0, so that the model does not learn to tell known toxic texts from unknown ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import distinct_sorted, find_words, mix, release_memory, row_slices, span_hashes, text_buffer

MOST_POSITIVE = 2_000
MOST_UNLABELLED = 10_000
#: A word is a feature if it is in so many of the sampled toxic texts, at least this share of them, and more frequent
#: there than in any texts by so many standard errors for each root of a toxic text, within the bounds.
LEAST_TEXTS = 4
LEAST_SHARE = 0.02
Z_PER_ROOT, LEAST_Z, MOST_Z = 0.35, 4.0, 12.0
#: Bytes of the beginnings of words that are features beside the words.
PREFIXES = (4, 6)


@dataclass
class Classifier:
    """Sorted hashes of words, their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of texts, given the words of each: a repeated word counts once."""
        n = len(counts)
        total = np.full(n, self.bias)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            pairs = np.unique(np.repeat(np.arange(n), counts)[hit] * len(self.words) + at[hit])
            total += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], n)
        return 1 / (1 + np.exp(-total))


def text_features(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of each text, and how many: its words, in lower case (A-Z) and without punctuation at their ends, and their beginnings."""
    data, offsets = text_buffer(rows.column("text"))
    starts, ends, counts = find_words(data, offsets)
    for _ in range(3):
        ends = ends - ((ends - starts > 1) & _PUNCTUATION[data[ends - 1]]) if len(ends) else ends
        starts = starts + ((ends - starts > 1) & _PUNCTUATION[data[starts]]) if len(starts) else starts
    words = span_hashes(data, starts, ends, fold=True)
    kinds = [words]
    for n in PREFIXES:
        kinds.append(mix(span_hashes(data, starts, np.minimum(ends, starts + n), fold=True) + np.uint64(n)))
    return np.stack(kinds, 1).reshape(-1), counts * len(kinds)


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?\"'()[]{}*#%&$|<>-_~"]] = True


def least_texts(n: int) -> float:
    """Of n toxic texts, those that must have a feature: fewer where there are but a few toxic texts."""
    return max(min(LEAST_TEXTS, max(2, -(-n // 2))), LEAST_SHARE * n)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def choose(words: np.ndarray, in_positive: np.ndarray, in_unlabelled: np.ndarray, positive: int, unlabelled: int, prior: float) -> tuple[np.ndarray, float]:
    """Sorted words that are features, and the prior, by how many of so many positive and unlabelled texts have each word."""
    prior = min(max(prior, 1e-3), 0.9)
    enough = in_positive >= least_texts(positive)
    words, in_positive, in_unlabelled = words[enough], in_positive[enough], in_unlabelled[enough]
    if not positive or not unlabelled or not len(words):
        return words[:0], prior
    p, u = in_positive / positive, in_unlabelled / unlabelled
    pooled = (in_positive + in_unlabelled) / (positive + unlabelled)
    z = (p - u) / np.sqrt(pooled * (1 - pooled) * (1 / positive + 1 / unlabelled) + 1e-12)
    least_z = min(max(Z_PER_ROOT * np.sqrt(positive), LEAST_Z), MOST_Z)
    # the words that tell most are in any texts as often as toxic texts are; what labels say bounds the prior from above
    best = np.argsort(-z)[:10]
    chosen = words[z >= least_z]
    return chosen, min(prior, max(1e-3, u[best].sum() / p[best].sum())) if len(chosen) else prior


def fit(words: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 3000, rate: float = 0.02, decay: float = 1e-6) -> Classifier:
    """Weights of the words, from those that each of the sampled texts has."""
    bias = float(np.log(prior / (1 - prior)))
    if not len(words):
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), bias)

    def incidence(texts):
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        return row, np.searchsorted(words, np.concatenate(texts)), len(texts)

    def apply(x, w):
        return np.bincount(x[0], w[x[1]], x[2])

    def back(x, g):
        return np.bincount(x[1], g[x[0]], len(words))

    xp, xu = incidence(positive), incidence(unlabelled)
    w, b = np.zeros(len(words)), bias
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        fp, fu = apply(xp, w) + b, apply(xu, w) + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # derivatives by f: of l(f, 1), of l(f, 0)
        gp1, gp0, gu0 = -_sigmoid(-fp) / len(fp), _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
        dp, du = (prior * (gp1 - gp0), gu0) if negative >= 0 else (prior * gp1, np.zeros(len(fu)))
        gradient = np.append(back(xp, dp) + back(xu, du) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = np.maximum(w - change[:-1], 0), b - change[-1]  # a feature speaks for toxicity or not at all
    return Classifier(words, w, float(b))


def train(documents: DataFrame, labels: DataFrame, may_learn, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, id_column: str = "doc_id", text_column: str = "text", toxic_column: str = "toxic") -> Classifier:
    """Fits the classifier on rows for which may_learn (a function of the id column) holds.

    The sample is the rows with the smallest hashes of their ids, toxic ones and any others apart; a null id or label is
    not learned from, and an id with both labels counts as toxic. Without toxic rows every text gets the prior. Repeated
    rows of a sampled id are taken by a hash of id and text, as far as the sample goes, so that a fit can be repeated. A
    null or empty text has no features. Features are counted in the tasks; the driver gets those that enough toxic texts
    have, and of each sampled text the ones that are learned from.
    """
    ids = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(toxic_column).cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(17))
    counts = ids.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k")).first()
    own = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if not counts.k:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), -6.0)
    # at most so many ids of either kind, so they can be broadcast; a text may be of both
    positive = ids.filter("toxic = 1").orderBy(order, "doc_id").limit(most_positive).select("doc_id")
    others = own.filter(F.col("doc_id").isNotNull() & may_learn(F.col("doc_id"))).select("doc_id").orderBy(order, "doc_id").limit(most_unlabelled).distinct()

    # there may be more rows than ids: the ones with the smallest hashes, each once, so that the same texts are taken each time
    hashed = own.withColumn("h", F.xxhash64("doc_id", "text", F.lit(17)))

    def sampled(sample: DataFrame, most: int) -> tuple[DataFrame, int]:
        """The sampled texts, and how many they are."""
        keys = hashed.join(F.broadcast(sample), "doc_id", "left_semi").select("doc_id", "h").distinct().orderBy("h", "doc_id").limit(most).toArrow()
        known = documents.sparkSession.createDataFrame(keys, "doc_id long, h long")
        return hashed.join(F.broadcast(known), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select("text"), keys.num_rows

    def counted(texts: DataFrame, least: float, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted features, or those that are wanted, and how many texts have each, from the least number of texts on.
        They are counted in the tasks, so that the driver holds no texts' features."""
        def words(batches):
            for batch in batches:
                for rows in row_slices(batch, "text"):
                    flat, _ = distinct_sorted(*text_features(rows))
                    found, times = np.unique(flat, return_counts=True)
                    if wanted is not None:
                        kept = np.isin(found, wanted, assume_unique=True)
                        found, times = found[kept], times[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.uint64).view(np.int64)), pa.array(times.astype(np.int64))], names=["word", "n"])

        got = texts.mapInArrow(words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
        found, times = got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy()
        order = np.argsort(found)
        return found[order], times[order]

    def features(texts: DataFrame, wanted: np.ndarray) -> list[np.ndarray]:
        """Those of the wanted features that each text has."""
        def words(batches):
            for batch in batches:
                for rows in row_slices(batch, "text"):
                    flat, sizes = distinct_sorted(*text_features(rows))
                    at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                    parts = [flat[a:b] for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([x[np.isin(x, wanted, assume_unique=True)].astype("<u8").tobytes() for x in parts], pa.binary())], names=["words"])

        return [np.frombuffer(x.as_buffer(), "<u8").astype(np.uint64) for x in texts.mapInArrow(words, "words binary").toArrow().column("words")]

    toxic, n_toxic = sampled(positive, most_positive)
    any_kind, n_any = sampled(others, most_unlabelled)
    found, in_toxic = counted(toxic, least_texts(n_toxic), None)
    some, times = counted(any_kind, 1, found)
    in_any = np.zeros(len(found), np.int64)
    in_any[np.searchsorted(found, some)] = times
    chosen, prior = choose(found, in_toxic, in_any, n_toxic, n_any, counts.k / counts.n)
    model = fit(chosen, features(toxic, chosen), features(any_kind, chosen), prior) if len(chosen) else fit(chosen, [], [], prior)
    release_memory()
    return model


def score(documents: DataFrame, classifier: Classifier, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= threshold) of each row.

    A null or empty text has no words and gets the score of the bias. No shuffle; the model is sent to the tasks, and has
    at most as many words as the bounded sample.
    """
    sent = documents.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        for batch in batches:
            for rows in row_slices(batch, "text"):
                s = sent.value.scores(*text_features(rows))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(documents: DataFrame, classifier: Classifier, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, whose text scores below the threshold."""
    sent = documents.sparkSession.sparkContext.broadcast(classifier)
    at = documents.columns.index(text_column)

    def run(batches):
        for batch in batches:
            named = batch.rename_columns([f"c{i}" if i != at else "text" for i in range(batch.num_columns)])
            for rows in row_slices(named, "text"):
                kept = rows.filter(pa.array(sent.value.scores(*text_features(rows)) < threshold))
                if kept.num_rows:
                    yield kept.rename_columns(batch.schema.names)

    return documents.mapInArrow(run, documents.schema)
