"""Quality classifier: a generalised additive model with pairwise interactions (operator 5).

Every feature has at most ``BINS`` bins by quantiles. Boosting goes round the features in turn; each step
fits a shallow tree on one feature's bins (its best two cuts) to the logistic residuals and adds a small
part of it to the feature's table. Then the pairs of features whose joint table explains most of what is
left get tables of their own in the same way. Scoring is a sum of table entries: one vectorised look-up
a feature or pair.

Features are counts and shares of the whole text (words, lines, byte classes, repetition, entropy, how far it compresses) and
the mean log-odds of its sequences of three byte classes in good against bad documents, learned on the fit's rows.

The fit reads a bounded sample of labelled documents; the sample's features (a few numbers a document)
reach the driver, the texts do not.

Defined results: a null text counts as empty and is scored by the bins of an empty text. With labels of
one class only, every score is that share. Repeated rows are scored each. Labels, language, source and
id take no part in a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.labelled import training_sample
from tidewell.llm.shared import held_out, table

NAME = "op5_quality"
SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.15
LEAST_ROWS = 5
#: Score from which a document is predicted good.
THRESHOLD = 0.3

#: Classes of bytes: lower case, upper case, digits, space, line break, sentence ends, other ASCII, bytes of other letters.
CLASSES = 8
FEATURES = [
    "log_chars", "word_length", "upper", "digit", "other", "stop", "line_length", "unique_words", "same_next", "unique_lines", "long_words",
    "bytes_a_char", "spaces", "no_letters", "capitals", "entropy", "compressed", "classes",
]


def class_table() -> bytes:
    out = bytearray([6] * 128 + [7] * 128)
    for c, which in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".?!")):
        for x in which:
            out[x] = c
    return bytes(out)


CLASS_OF = class_table()


def class_trigrams(classes: np.ndarray) -> np.ndarray:
    """Shares of the sequences of three byte classes."""
    c = classes.astype(np.int64)
    n = np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3) if len(c) > 2 else np.zeros(CLASSES**3)
    return n / max(1, len(c) - 2)


def features(text: str, odds: np.ndarray) -> tuple[float, ...]:
    """Counts and shares of a whole text; ``odds``: learned log-odds of class trigrams in good against bad documents."""
    data = text.encode()
    n = max(1, len(data))
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    classes = np.frombuffer(data.translate(CLASS_OF), np.uint8)
    of_class = np.bincount(classes, minlength=CLASSES) / n
    of_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    of_byte = of_byte[of_byte > 0]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return (
        float(np.log1p(len(text))),
        float(sizes.mean()) if len(words) else 0.0,
        of_class[1],
        of_class[2],
        of_class[6],
        of_class[5] * 100,
        len(words) / max(1, len(lines)),
        len(set(words)) / k**0.8,
        sum(map(str.__eq__, words, words[1:])) / k,
        len(set(lines)) / max(1, len(lines)),
        float((sizes > 15).mean()) if len(words) else 0.0,
        n / max(1, len(text)),
        of_class[3],
        sum(w.lower() == w.upper() for w in words) / k,
        sum(map(str.isupper, words)) / k,
        float(-(of_byte @ np.log2(of_byte))) if len(of_byte) else 0.0,
        len(zlib.compress(data, 1)) / n,
        float(class_trigrams(classes) @ odds),
    )


def feature_rows(batches, odds: np.ndarray):
    for pdf in batches:
        rows = [features(t, odds) for t in pdf["text"].fillna("")]
        out = pd.DataFrame(rows, columns=FEATURES)
        for c in pdf.columns:
            if c != "text":
                out[c] = pdf[c].to_numpy()
        yield out


def trigram_odds(sample: DataFrame) -> np.ndarray:
    """Log-odds of class trigrams in good against bad documents, each document counting alike."""

    def run(batches):
        sums = {}
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                own = class_trigrams(np.frombuffer(text.encode().translate(CLASS_OF), np.uint8))
                sums[label] = sums.get(label, 0) + own
        if sums:
            yield pd.DataFrame([(label, i, x) for label, own in sums.items() for i, x in enumerate(own)], columns=["label", "i", "x"])

    rows = sample.select("text", "label").mapInPandas(run, "label int, i int, x double").groupBy("label", "i").agg(F.sum("x").alias("x")).collect()
    shares = np.zeros((2, CLASSES**3))
    for r in rows:  # two rows a trigram
        shares[r["label"], r["i"]] = r["x"]
    shares = (shares + 1e-2) / (shares + 1e-2).sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def best_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of a small tree on one feature: cut where the squared gradient gains most, again on the better part."""
    parts = [(0, len(gradient))]
    g, w, r = (np.concatenate([[0.0], np.cumsum(x)]) for x in (gradient, weight, rows))

    def gain(a: int, b: int) -> tuple[float, int]:
        cuts = np.arange(a + 1, b)
        cuts = cuts[(r[cuts] - r[a] >= LEAST_ROWS) & (r[b] - r[cuts] >= LEAST_ROWS)]
        if not len(cuts):
            return 0.0, -1
        score = lambda lo, hi: (g[hi] - g[lo]) ** 2 / (w[hi] - w[lo] + 1.0)
        gains = score(a, cuts) + score(cuts, b) - score(a, b)
        return float(gains.max()), int(cuts[gains.argmax()])

    while len(parts) < leaves:
        best = max(((*gain(a, b), i) for i, (a, b) in enumerate(parts)), default=(0.0, -1, 0))
        if best[1] < 0 or best[0] <= 1e-12:
            break
        a, b = parts.pop(best[2])
        parts += [(a, best[1]), (best[1], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    odds: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES**3))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            out += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def fit_model(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    m = Model([quantile_edges(x[:, j], BINS) for j in range(x.shape[1])], float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return m
    codes = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    sizes = [len(e) + 1 for e in m.edges]
    m.tables = [np.zeros(s) for s in sizes]
    rows = [np.bincount(c, minlength=s).astype(float) for c, s in zip(codes, sizes)]
    raw = np.full(len(y), m.base)
    for _ in range(ROUNDS):
        for j, c in enumerate(codes):
            p = 1 / (1 + np.exp(-raw))
            tree = RATE * best_tree(np.bincount(c, y - p, sizes[j]), np.bincount(c, p * (1 - p), sizes[j]), rows[j])
            m.tables[j] += tree
            raw += tree[c]
    # pairs: which joint table would take most of the remaining gradient
    m.pair_edges = [quantile_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    pc = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.pair_edges)]
    ps = [len(e) + 1 for e in m.pair_edges]
    p = 1 / (1 + np.exp(-raw))
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            cell = pc[a] * ps[b] + pc[b]
            g, w = np.bincount(cell, y - p, ps[a] * ps[b]), np.bincount(cell, p * (1 - p), ps[a] * ps[b])
            gains.append((float((g * g / (w + 1.0)).sum()), a, b))
    m.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    m.pair_tables = [np.zeros((ps[a], ps[b])) for a, b in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(m.pairs, m.pair_tables):
            p = 1 / (1 + np.exp(-raw))
            cell = pc[a] * ps[b] + pc[b]
            g, w = np.bincount(cell, y - p, t.size), np.bincount(cell, p * (1 - p), t.size)
            # a two-level tree: for each bin of the first feature the best cut of the second
            r = np.bincount(cell, minlength=t.size).astype(float)
            step = np.stack([best_tree(*(v.reshape(t.shape)[i] for v in (g, w, r)), leaves=2) for i in range(t.shape[0])])
            step *= RATE
            t += step
            raw += step[pc[a], pc[b]]
    return m


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    sample = training_sample(docs, labels, "quality", most)
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", label int"
    odds = trigram_odds(sample)
    got = sample.select("text", "label").mapInPandas(lambda batches: feature_rows(batches, odds), schema).collect()  # at most ``most`` rows of numbers
    data = np.array([tuple(r) for r in got], float).reshape(-1, len(FEATURES) + 1)
    data = data[np.lexsort(data.T)]  # the same model whatever order the rows come in
    model = fit_model(data[:, :-1], data[:, -1])
    model.odds = odds
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of small tables

    def run(batches):
        for pdf in feature_rows(batches, shared.value.odds):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": shared.value.score(pdf[FEATURES].to_numpy())})

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
