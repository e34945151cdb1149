"""Toxicity grades by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - theta_k): the weights are shared by all thresholds, which ascend. x says which words and word
beginnings of a vocabulary a text holds. Weights are not negative: words can only speak for severity, so a text without any of them, however
short, has the lowest grade. The expected severity is the sum of P(grade > k) over all thresholds.

The model is fitted on a bounded sample of labelled texts, each weighed by how many of its kind it stands for, so that the
share of toxic ones is that of all labelled texts. Vocabulary and weights are bounded as well. Every document is scored over
its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import folded_words, prepare, store, text_or_empty
from strandline.llm.tokens import release

SAMPLE_EACH = 4000  # labelled texts of either kind that the model is fitted on, at most
VOCABULARY = 3000  # words that can have a weight, at most
MIN_DOCUMENTS = 5  # sampled documents that hold a word before it can have a weight
MIN_ERRORS = 5.0  # standard errors by which its share of toxic texts must exceed that of clean ones
L1 = 1e-4
STEPS = 1000
STEP = 1.0
BEGINNINGS = (4, 5, 6)  # bytes of word beginnings that are features like whole words, so that inflected forms count
SCORES = "doc_id bigint, severity double, p_toxic double, grade int"
_OUT = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])


def features(text: str) -> set[bytes]:
    """Words of a text, and their beginnings with a star."""
    words = set(folded_words(text))
    return words.union(*({w[:k] + b"*" for w in words if len(w) > k} for k in BEGINNINGS))


@dataclass(frozen=True)
class OrdinalModel:
    """Word weights and ascending thresholds; without thresholds every text has grade 0."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]

    def above(self, text: str) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        known = self.weights
        score = sum(known[w] for w in features(text) if w in known)
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - score, -500, 500)))


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, n_words: int, l1: float = L1, steps: int = STEPS,
    counts: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights, none negative, and thresholds of a cumulative-link model with an L1 penalty, by adaptive proximal steps.

    rows: indexes of the words each text holds. grades: 0, 1, ..; all of them must occur. counts: how many texts each one
    stands for, one if not given.
    """
    levels = int(grades.max())
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    each = np.ones(len(grades)) if counts is None else counts
    each = each / max(each.sum(), 1e-12)
    square = np.zeros(n_words + levels)
    ahead = np.concatenate([np.zeros(n_words), np.arange(levels, dtype=float)])
    for _ in range(steps):
        w, theta = ahead[:n_words], ahead[n_words:]
        score = np.bincount(owner, w[flat], len(rows))
        lower = np.where(grades > 0, theta[np.maximum(grades - 1, 0)] - score, -np.inf)  # P(y) = S(upper) - S(lower)
        upper = np.where(grades < levels, theta[np.minimum(grades, levels - 1)] - score, np.inf)
        s_low, s_up = 1 / (1 + np.exp(-np.clip(lower, -500, 500))), 1 / (1 + np.exp(-np.clip(upper, -500, 500)))
        s_low, s_up = np.where(np.isinf(lower), 0.0, s_low), np.where(np.isinf(upper), 1.0, s_up)
        share = np.maximum(s_up - s_low, 1e-12)
        d_low, d_up = s_low * (1 - s_low), s_up * (1 - s_up)
        by_score = each * (d_up - d_low) / share
        slope = np.empty_like(ahead)
        slope[:n_words] = np.bincount(flat, by_score[owner], n_words)
        slope[n_words:] = (
            np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, each * d_low / share, 0), levels)[:levels]
            - np.bincount(np.minimum(grades, levels - 1), np.where(grades < levels, each * d_up / share, 0), levels)[:levels]
        )
        square += slope ** 2
        pace = STEP / np.sqrt(square + 1e-10)
        moved = ahead - pace * slope
        moved[:n_words] = np.maximum(moved[:n_words] - pace[:n_words] * l1, 0)
        moved[n_words:] = np.maximum.accumulate(moved[n_words:] + np.arange(levels) * 1e-6)
        ahead = moved
    return ahead[:n_words], ahead[n_words:]


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(mark, toxic, doc_id) of every labelled text: its hash, its kind, and the least document that holds it.

    Copies count once, as they would make their chance words telling.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")
    )
    marks = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("mark"))
    return marks.join(known, "doc_id").groupBy("mark", "toxic").agg(F.min("doc_id").alias("doc_id"))


def labelled_sample(docs: DataFrame, known: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """(mark, toxic, words) of at most ``each`` toxic and ``each`` clean ones of the labelled texts, chosen by their hash."""
    pick = lambda kind: known.where(F.col("toxic") == kind).orderBy("mark").limit(each)
    chosen = pick(1).unionByName(pick(0))  # at most 2 x each rows of three numbers: small enough to broadcast

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            held = [sorted(features(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.binary()))], ["mark", "toxic", "words"]
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    joined = texts.withColumn("mark", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "mark"])
    joined = joined.select("mark", "toxic", "text").dropDuplicates(["mark", "toxic"])  # repeated rows
    return joined.mapInArrow(words, "mark bigint, toxic int, words array<binary>")


def severity_grades(toxic: np.ndarray, rows: list[np.ndarray], n_words: int) -> np.ndarray:
    """0 for clean texts; toxic ones are split at the median number of words that go with toxic labels into 1 and 2.

    Labels say only toxic or not. The words are those at least four times as frequent in toxic as in clean texts.
    """
    hits = np.zeros((2, n_words))
    for one, words in zip(toxic, rows):
        hits[int(one > 0)][words] += 1
    rate = (hits + 0.5) / (np.bincount(toxic > 0, minlength=2)[:, None] + 1)
    telling = rate[1] >= 4 * rate[0]
    strength = np.array([telling[words].sum() for words in rows], float)
    grades = (toxic > 0).astype(int)
    if grades.any():
        middle = np.median(strength[grades > 0])
        grades[(grades > 0) & (strength > middle)] = 2
    return grades


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, vocabulary: int = VOCABULARY, min_documents: int = MIN_DOCUMENTS
) -> OrdinalModel:
    """Fit on the bounded sample. What reaches the driver is bounded by sample and vocabulary.

    The vocabulary holds the words whose share of toxic texts exceeds that of clean ones the most surely. Without labels of both kinds the model
    gives every text grade 0.
    """
    prepare(docs.sparkSession)
    known = store(labelled_texts(docs, labels), "toxicity-labels")
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = store(labelled_sample(docs, known, each), "toxicity-sample")
    sizes = {r.kind: r.n for r in sample.groupBy((F.col("toxic") > 0).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return OrdinalModel({}, ())
    held = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum((F.col("toxic") > 0).cast("long")).alias("bad"), F.sum((F.col("toxic") <= 0).cast("long")).alias("good")
    ).where(F.col("bad") + F.col("good") >= min_documents)
    gap = F.col("bad") / sizes[True] - F.col("good") / sizes[False]
    share = (F.col("bad") + F.col("good")) / (sizes[True] + sizes[False])
    errors = gap / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / sizes[True] + 1 / sizes[False]))
    held = held.withColumn("errors", errors).where(F.col("errors") >= MIN_ERRORS)
    chosen = held.orderBy(F.desc("errors"), "word").limit(vocabulary).select("word").collect()
    index = {bytes(r.word): i for i, r in enumerate(chosen)}
    places = sample.sparkSession.createDataFrame([(w, i) for w, i in index.items()], "word binary, at int")
    found = sample.select("mark", "toxic", F.explode_outer("words").alias("word")).join(F.broadcast(places), "word", "left")
    texts = found.groupBy("mark", "toxic").agg(F.collect_set("at").alias("at")).orderBy("mark", "toxic").collect()
    toxic = np.array([r.toxic for r in texts])
    rows = [np.array(sorted(r["at"]), np.int64) for r in texts]
    grades = severity_grades(toxic, rows, len(index))
    _, grades = np.unique(grades, return_inverse=True)
    counts = np.array([totals[kind] / sizes[kind > 0] for kind in toxic])
    weights, thresholds = fit_ordinal(rows, grades, len(index), counts=counts)
    return OrdinalModel(
        {w: float(weights[i]) for w, i in index.items() if weights[i]}, tuple(float(t) for t in thresholds)
    )


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, p_toxic, grade) of every document.

    severity is the expected grade, p_toxic = P(grade > 0), grade the highest one reached with probability 0.5. A null text
    is scored as empty. Rows are scored one by one, so null or repeated doc_ids stay as they are; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            above = [model.above(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([float(a.sum()) for a in above], pa.float64()),
                pa.array([float(a[0]) if len(a) else 0.0 for a in above], pa.float64()),
                pa.array([int((a >= 0.5).sum()) for a in above], pa.int32()),
            ], schema=_OUT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(score, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled part of docs and score all of them; toxic is grade > 0."""
    return score_toxicity(docs, fit_toxicity(docs, labels)).withColumn("toxic", F.col("grade") > 0)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs of grade 0, with all their columns."""
    model = fit_toxicity(docs, labels)

    @F.udf("boolean", useArrow=True)
    def clean(text: str) -> bool:
        release()
        return not (model.above(text)[:1] >= 0.5).any()

    return docs.where(clean(text_or_empty()))
