"""Toxicity by maximum-scoring segments of token log-odds (operator 2).

Fitting, on a bounded sample of labelled documents: every word and some of its leading parts get the
log-odds of its document frequency in toxic against clean documents under an informative Dirichlet prior,
less some standard deviations, as many as predict other labelled rows of the sample best; a word's score is the best of its units'. Words without evidence score a
small negative value, so segments of chance end by themselves. One part of the sample gives the scores,
another the calibration, since scores look too good on what they were made from.

Scoring: all maximal-scoring segments of a document are found in linear time; under clean text the best
of n positions follows an extreme-value law with parameters lambda and K, and segments beyond it are
significant. The document's score is a logistic curve over the best segment's excess, the sum of the
significant excesses and their number.

Defined results: a null or empty text has no segment and gets the score of no evidence. Without any
toxic (or clean) labelled document every score is the share of toxic labels. Repeated rows are scored
each. Labels, language, source and id take no part in a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.labelled import training_sample
from tidewell.llm.shared import PORTION, held_out, portions, table

NAME = "op2_toxicity"
#: Labelled documents that the fit may read.
SAMPLE = 20_000
#: Strength of the Dirichlet prior, in documents.
PRIOR = 10.0
#: Standard deviations by which a log-odds must exceed nothing: copies of a document lend chance words some evidence. The fit
#: chooses among these by wrong predictions, then log loss, in cross-validation on folds of the sample that gave no scores.
DOUBTS = (1.0, 2.0, 3.0)
#: Score of a word without evidence.
NEUTRAL = -0.4
TOP = 6.0
PREFIXES = (4, 5, 6, 7)
#: Folds of the sample that give the scores; the others give the calibration.
SCORE_FOLDS = 6
WORD_CACHE = 300_000
#: Units that leave a step at once.
ROWS = 50_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def units_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


class Scores(dict):
    """Word -> score, from the units' scores; a bounded cache of words."""

    def __init__(self, units: dict[str, float]):
        super().__init__()
        self.units = units

    def __missing__(self, word: str) -> float:
        if len(self) >= WORD_CACHE:
            self.clear()
        get = self.units.get
        best = max((get(u, NEUTRAL) for u in units_of(word)), default=NEUTRAL)
        self[word] = best
        return best


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) in linear time (Ruzzo and Tompa).

    Only positive positions are visited; running sums stand for what lies between them. Each segment held knows the nearest
    earlier one with a smaller sum before it, so a search passes no segment that an earlier search has passed.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    positive = np.flatnonzero(scores > 0)
    held: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, the earlier one's number (-1: none)
    for i, before, after in zip(positive.tolist(), sums[positive].tolist(), sums[positive + 1].tolist()):
        first, j = i, len(held) - 1
        while j >= 0 and held[j][2] >= before:
            j = held[j][4]
        while j >= 0 and held[j][3] < after:
            first, _, before, _, earlier = held[j]
            del held[j:]
            j = earlier
        held.append((first, i + 1, before, after, j))
    return [(a, b, r - left) for a, b, left, r, _ in held]


@dataclass
class Model:
    units: dict[str, float]
    lam: float
    log_k: float
    weights: list[float] | None
    share: float

    def evidence(self, text: str, scores: Scores) -> tuple[list[float], list[tuple[int, int, float]]]:
        """Features of a document, and its significant segments (first word, end, excess over chance)."""
        words = words_of(text)
        found = segments(np.fromiter(map(scores.__getitem__, words), float, len(words)))
        level = self.log_k + math.log(max(1, len(words)))
        good = [(a, b, x) for a, b, s in found if (x := self.lam * s - level) > 0]
        return features([s for *_, s in found], len(words), self.lam, self.log_k), good

    def score(self, features: list[float]) -> float:
        if self.weights is None:
            return self.share
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(sums: list[float], words: int, lam: float, log_k: float) -> list[float]:
    """Best excess over chance, and size and number of the significant ones, of segments with these sums in so many words."""
    if not words:
        return [0.0, 0.0, 0.0]
    level = log_k + math.log(words)
    excess = [lam * s - level for s in sums]
    good = [x for x in excess if x > 0]
    return [max(excess, default=-level), math.log1p(sum(good)), math.log1p(len(good))]


def document_counts(batches):
    """unit, toxic, clean: in how many toxic and clean documents of a batch a unit is. A batch's units are held once, however many documents have them."""
    for pdf in batches:
        toxic, every = Counter(), Counter()
        for text, label in zip(pdf["text"], pdf["label"]):
            found = {u for w in set(words_of(text)) for u in units_of(w)}
            every.update(found)
            if label:
                toxic.update(found)
        units = list(every)
        for at in range(0, len(units), ROWS):
            own = units[at : at + ROWS]
            t = [toxic[u] for u in own]
            yield pd.DataFrame({"unit": own, "toxic": t, "clean": [every[u] - n for u, n in zip(own, t)]})


def unit_counts(sample: DataFrame) -> tuple[list, int, int]:
    """Units with evidence (unit, toxic documents, clean ones), and the numbers of toxic and clean documents."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    if not nt or not nc:
        return [], nt, nc
    counts = sample.select("text", "label").mapInPandas(document_counts, "unit string, toxic long, clean long").groupBy("unit")
    counts = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t >= 2").where(F.col("t") * nc > F.col("c") * nt)
    # words of at least two toxic documents of the sample, more frequent there: no more than the sample has
    return [tuple(r) for r in counts.collect()], nt, nc


def unit_scores(counts: list, nt: int, nc: int, doubt: float) -> dict[str, float]:
    """Log-odds of each unit less ``doubt`` standard deviations, of those with any left."""
    out = {}
    for unit, t, c in counts:
        prior = PRIOR * (t + c) / (nt + nc)
        t, c = t + prior, c + prior
        low = math.log(t / (nt + PRIOR - t)) - math.log(c / (nc + PRIOR - c)) - doubt * math.sqrt(1 / t + 1 / c)
        if low > 0:
            out[unit] = min(low, TOP) + NEUTRAL
    return out


def solve_lambda(values: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, for scores of negative mean."""
    if not (values > 0).any() or values @ chances >= 0:
        return 1.0
    low, high = 0.0, 1.0
    grows = lambda x: float(chances @ np.exp(x * values)) > 1
    while not grows(high) and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if grows(mid) else (mid, high)
    return high


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weights (intercept first) by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


#: Bins of word scores, a tenth wide, from NEUTRAL to TOP.
BINS = round((TOP - NEUTRAL) * 10) + 1


def losses(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[float, float]:
    """Wrong predictions and log loss on each half of the folds under a logistic curve fitted to the other half."""
    wrong, total = 0, 0.0
    for half in (0, 1):
        test = fold % 2 == half
        if not 0 < y[~test].sum() < (~test).sum():
            return math.inf, math.inf
        w = np.array(fit_logistic(x[~test], y[~test]))
        z = np.clip(w[0] + x[test] @ w[1:], -30, 30)
        wrong += int(((z >= 0) != (y[test] == 1)).sum())
        total += float(np.sum(np.log1p(np.exp(np.where(y[test] == 1, -z, z)))))
    return wrong, total


def calibrated(units: dict[str, float], rest: DataFrame, share: float) -> tuple[Model, tuple[float, float]]:
    """The model of these units, its law and curve from the ``rest`` of the sample; and its cross-validated losses."""

    def scored(batches):
        scores = Scores(units)
        for pdf in portions(batches):
            rows = []
            for text, label, fold in zip(pdf["text"], pdf["label"], pdf["fold"]):
                words = words_of(text)
                values = np.fromiter(map(scores.__getitem__, words), float, len(words))
                bins = np.bincount(np.clip(np.rint((values - NEUTRAL) * 10), 0, BINS - 1).astype(int), minlength=BINS)
                rows.append(([s for *_, s in segments(values)], len(words), bins.tolist(), label, fold))
            yield pd.DataFrame(rows, columns=["sums", "words", "bins", "label", "fold"])

    # a row for each document of the sample: the sums of its segments, and how many words have which score
    got = rest.select("text", "label", "fold").mapInPandas(scored, "sums array<double>, words long, bins array<long>, label int, fold int").collect()
    model = Model(units, 1.0, 0.0, None, share)
    got = sorted(got, key=lambda r: (r["fold"], r["label"], r["words"], r["sums"]))
    clean = [r for r in got if not r["label"] and r["words"]]
    if not clean:
        return model, (math.inf, math.inf)
    counts = np.sum([r["bins"] for r in clean], axis=0)
    model.lam = solve_lambda(NEUTRAL + np.arange(BINS) / 10, counts / counts.sum())
    # under chance lambda S - ln n has the mean ln K + 0.5772
    model.log_k = float(np.mean([model.lam * max(r["sums"], default=0.0) - math.log(r["words"]) for r in clean])) - 0.5772
    x = np.array([features(r["sums"], r["words"], model.lam, model.log_k) for r in got])
    y, fold = np.array([r["label"] for r in got]), np.array([r["fold"] for r in got])
    if 0 < y.sum() < len(y):
        model.weights = fit_logistic(x, y)
    return model, losses(x, y, fold)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    sample = training_sample(docs, labels, "toxic", most)
    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    share = (toxic or 0) / n if n else 0.0
    counts = unit_counts(sample.where(F.col("fold") < SCORE_FOLDS))
    rest = sample.where(F.col("fold") >= SCORE_FOLDS)
    if not counts[0]:
        return calibrated({}, rest, share)[0]
    found = [calibrated(unit_scores(*counts, doubt), rest, share) for doubt in DOUBTS]
    return min(found, key=lambda f: f[1])[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, segments (word ranges of the significant passages) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its units come from the bounded sample

    def run(batches):
        m = shared.value
        scores = Scores(m.units)
        for pdf in portions(batches):
            got = [m.evidence(t, scores) for t in pdf["text"].fillna("")]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "score": [m.score(f) for f, _ in got],
                    "passages": [",".join(f"{a}:{b}" for a, b, _ in s) for _, s in got],
                }
            )

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double, passages string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``limit``."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scores = Scores(m.units)
        for whole in batches:
            for at in range(0, whole.num_rows, PORTION):
                batch = whole.slice(at, PORTION)
                texts = batch.column("text").to_pylist()
                yield batch.filter(pa.array([m.score(m.evidence(t or "", scores)[0]) < limit for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )
