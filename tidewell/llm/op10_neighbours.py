"""Approximate nearest neighbours by learned partitions (operator 10).

On a bounded sample of distinct vectors a neighbour graph is made by brute force and cut into balanced
parts: recursive halves along the main direction, then moves to the part that most neighbours are in,
as far as that part has room. A small network (one hidden layer) learns the parts of a vector's
neighbours. Every vector of the table is indexed in its most probable part; a query visits the most
probable parts until they hold so much of the network's probability that the sample's recall reaches its aim,
and further ones until it has met enough candidates. What it finds is ranked by the exact measure.

Scale: parts grow with the square root of the table, and a part of over ``SPLIT`` vectors gets a graph, parts
and a network of its own, fitted in a task on a bounded sample of it. Copies of a vector are one candidate with
its smallest ids (six are enough for five neighbours), and copies of a query are searched once. Parts are dealt
out in blocks of candidates and of queries, so a task holds a block of each; only a task's best survive it.

Defined results: vectors null, empty, zero, or with null or non-finite components take no part, nor do null
ids; rows equal in id and vector are one. A query with fewer candidates gets them all. No cosine exists between
vectors of different lengths, so a query's candidates are those of its own length: the most usual length has learned
parts, any other is one part. A table of fewer than ``LEAST`` vectors is one part. Further columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.op8_jaccard_join import groups
from tidewell.llm.shared import cut, join_hot, table

NAME = "op10_neighbours"
TOP = 5
QUERY_EVERY = 50
#: Distinct vectors that a fit may read.
SAMPLE = 10_000
#: Distinct vectors from which a table has parts: the square root of their number over ``PART_ROOT``, with ``PART_SAMPLE`` of the sample each.
LEAST, PART_ROOT, PART_SAMPLE = 500, 4, 40
#: Vectors from which a part is parted again; numbers of parts within one.
SPLIT, STRIDE = 50_000, 1 << 12
GRAPH = 10
HIDDEN = 64
EPOCHS = 40
ROOM = 1.1
#: Recall within the sample that the number of visited parts must reach.
AIM = 0.96
BLOCK = 4_000
QUERY_BLOCK = 2_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each row's k nearest others (unit rows)."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1000):
        near = x[a : a + 1000] @ x.T
        near[np.arange(len(near)), a + np.arange(len(near))] = -np.inf
        out[a : a + 1000] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    part = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            part[rows] = first
            return
        own = x[rows] - x[rows].mean(axis=0)
        main = np.linalg.eigh(own.T @ own)[1][:, -1]
        order = rows[np.argsort(own @ main, kind="stable")]
        left = n // 2
        at = len(order) * left // n
        split(order[:at], first, left)
        split(order[at:], first + left, n - left)

    split(np.arange(len(x)), 0, parts)
    room = int(ROOM * len(x) / parts) + 1
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        aim = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), aim] - votes[np.arange(len(x)), part]
        moved = 0
        sizes = np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[aim[i]] < room:
                sizes[part[i]] -= 1
                sizes[aim[i]] += 1
                part[i] = aim[i]
                moved += 1
        if moved < len(x) // 500:
            break
    return part


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    #: Probability that the visited parts hold together.
    mass: float = 1.0

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        q = np.exp(z - z.max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True)

    def own(self, x: np.ndarray) -> np.ndarray:
        return self.chances(x).argmax(axis=1)

    def order(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of each row, most probable first, and the probability of all before each."""
        q = self.chances(x)
        order = np.argsort(-q, axis=1, kind="stable")
        sorted_ = np.take_along_axis(q, order, axis=1)
        return order, np.cumsum(sorted_, axis=1) - sorted_


@dataclass
class Index:
    """A router over the parts and one for each part that is parted again; leaves are numbered part * STRIDE + part within."""

    root: Router | None
    within: dict[int, Router]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        parts = self.root.own(x) if self.root is not None else np.zeros(len(x), np.int64)
        out = parts * STRIDE
        for p, r in self.within.items():
            at = np.flatnonzero(parts == p)
            if len(at):
                out[at] += r.own(x[at])
        return out

    def visits(self, x: np.ndarray, sizes: dict[int, int], least: int) -> list[list[int]]:
        """The leaves that each row visits: ``least`` vectors in all at least, where there are so many."""
        order, before = self.root.order(x) if self.root is not None else (np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1)))
        mass = self.root.mass if self.root is not None else 1.0
        inner = {p: r.order(x) for p, r in self.within.items()}
        out = []
        for i in range(len(x)):
            own: list[int] = []
            met = 0
            for k, p in enumerate(order[i].tolist()):
                if k and before[i, k] > mass and met >= least:
                    break
                new = [p * STRIDE]
                if p in inner:
                    parts, earlier = inner[p]
                    enough = earlier[i] <= self.within[p].mass if before[i, k] <= mass else np.ones(parts.shape[1], bool)
                    new = (p * STRIDE + parts[i][enough]).tolist()
                    rest = (p * STRIDE + parts[i][~enough]).tolist()
                    met += sum(sizes.get(n, 0) for n in new)
                    while met < least and rest:
                        new.append(rest.pop(0))
                        met += sizes.get(new[-1], 0)
                else:
                    met += sizes.get(new[0], 0)
                own += [n for n in new if n in sizes]
            out.append(own)
        return out


def train(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Router:
    """Softmax network fitted to distributions over parts by Adam."""
    rnd = np.random.default_rng(11)
    d, p = x.shape[1], target.shape[1]
    theta = [rnd.normal(0, (2 / d) ** 0.5, (d, hidden)) * d**0.5 / 2, np.zeros(hidden), rnd.normal(0, (1 / hidden) ** 0.5, (hidden, p)), np.zeros(p)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(epochs):
        order = rnd.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a : a + 256]
            h = np.maximum(x[rows] @ theta[0] + theta[1], 0)
            z = h @ theta[2] + theta[3]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            dz = (q - target[rows]) / len(rows)
            dh = (dz @ theta[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                theta[i] = theta[i] - 0.004 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*theta)


def fit(sample: np.ndarray, n: int) -> Router | None:
    """A router for ``n`` distinct vectors by a sample of them; None where one part holds them all."""
    parts = min(int(n**0.5 / PART_ROOT), len(sample) // PART_SAMPLE, STRIDE)
    if n < LEAST or parts < 2:
        return None
    x = unit_rows(sample)
    graph = neighbour_graph(x, GRAPH)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 3.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), GRAPH), part[graph].ravel()), 1.0)
    router = train(x, target / target.sum(axis=1, keepdims=True))
    own = router.own(x)
    # how much must be visited: the probability before each true neighbour's part in the query's order
    asked = np.random.default_rng(5).permutation(len(x))[:1500]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-near, TOP - 1, axis=1)[:, :TOP]
    order, before = router.order(x[asked])
    place = np.argsort(order, axis=1)
    router.mass = float(np.quantile(np.take_along_axis(before, np.take_along_axis(place, own[true], axis=1), axis=1), AIM))
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine)


def search(vectors: DataFrame, every: int = QUERY_EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest of every query."""
    spark = vectors.sparkSession
    good = usable(vectors)
    held = vectors.schema["embedding"].dataType.simpleString()  # vectors stay what they are
    # copies of a vector: its smallest ids, one more than is asked for, since a query's own is left out
    first = Window.partitionBy("embedding").orderBy("vec_id")
    one = good.distinct().withColumn("asked", F.col("vec_id") % every == 0)
    numbered = one.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top + 1)
    # of the asked ids one is enough to know that the vector is searched for
    least = one.where("asked").groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding", F.lit(True).alias("asked"))
    kept = numbered.drop("r").union(least).distinct()
    distinct = kept.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max("asked").alias("asked"))
    distinct = cut(distinct.select("embedding", "ids", F.size("embedding").alias("dim"), "asked"))
    lengths = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths[0]["dim"], lengths[0]["n"]

    def sampled(df: DataFrame, of: Column) -> DataFrame:
        """About ``SAMPLE`` of ``of`` vectors, by the vector's hash."""
        draw = F.pmod(F.xxhash64(F.lit("sample"), "embedding"), F.lit(1 << 20))
        return df.where((of <= SAMPLE) | (draw < ((1 << 20) * 0.95 * SAMPLE / of)))

    rows = sampled(distinct.where(F.col("dim") == dim), F.lit(n)).select("embedding").collect()  # at most about SAMPLE vectors
    sample = np.array([r[0] for r in rows], float).reshape(-1, dim)
    index = Index(fit(sample[np.lexsort(sample.T)], n), {})

    def with_leaves(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)  # its size is that of the networks

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                dims = pdf["dim"].to_numpy()
                leaf = -dims.astype(np.int64)
                usual = dims == dim
                if usual.any():
                    leaf[usual] = shared.value.leaves(unit_rows(np.array(pdf["embedding"][usual].tolist(), float)))
                pdf["leaf"] = leaf
                yield pdf

        return cut(distinct.mapInPandas(run, f"embedding {held}, ids array<long>, dim int, asked boolean, leaf long"))

    def counted(df: DataFrame) -> dict[int, int]:
        return {r["leaf"]: r["n"] for r in df.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a leaf

    routed = with_leaves(index)
    sizes = counted(routed)
    large = [(p, m) for p, m in sizes.items() if p >= 0 and m > SPLIT]
    if large:
        # a fit for each large part, in a task of its own on a bounded sample of the part
        def refit(pdf: pd.DataFrame) -> pd.DataFrame:
            own = np.array(pdf["embedding"].tolist(), float)
            router = fit(own[np.lexsort(own.T)], int(pdf["of"].iloc[0]))
            return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "router": [pickle.dumps(router)]})

        of = F.broadcast(spark.createDataFrame(large, "leaf long, of long"))
        own = sampled(routed.join(of, "leaf"), F.col("of")).select("leaf", "of", "embedding")
        found = own.groupBy("leaf").applyInPandas(refit, "leaf long, router binary").collect()
        index = Index(index.root, {r["leaf"] // STRIDE: x for r in found if (x := pickle.loads(r["router"])) is not None})
        routed = with_leaves(index)
        sizes = counted(routed)
    shared = spark.sparkContext.broadcast((index, sizes))

    def visit(batches):
        index, sizes = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            dims = pdf["dim"].to_numpy()
            leaves = [[int(-d)] for d in dims]
            usual = np.flatnonzero(dims == dim)
            if len(usual):
                x = unit_rows(np.array(pdf["embedding"].iloc[usual].tolist(), float))
                for i, own in zip(usual.tolist(), index.visits(x, sizes, top + 1)):
                    leaves[i] = own
            yield pd.DataFrame({"embedding": pdf["embedding"], "leaves": leaves})

    asked = good.where(F.col("vec_id") % every == 0).distinct().withColumnRenamed("vec_id", "query_id")
    visits = routed.where("asked").select("embedding", "dim").mapInPandas(visit, f"embedding {held}, leaves array<long>")
    visits = cut(visits.select("embedding", F.xxhash64("embedding").alias("qkey"), F.explode("leaves").alias("leaf")))
    blocks = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    query_blocks = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks"))
    deal = F.broadcast(blocks.join(query_blocks, "leaf"))  # a row a leaf
    draw = F.xxhash64(F.lit("block"), "embedding")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt_c = routed.join(deal, "leaf").select(
        "leaf", F.pmod(draw, "blocks").cast("int").alias("c"), each("query_blocks").alias("q"), F.lit(0).cast("long").alias("qkey"), "ids", "embedding",
    )
    dealt_q = visits.join(deal, "leaf").select(
        "leaf", each("blocks").alias("c"), F.pmod(draw, "query_blocks").cast("int").alias("q"), "qkey", F.lit(None).cast("array<long>").alias("ids"), "embedding",
    )

    def rank(batches):
        for pdf in groups(batches, "unit"):
            is_query = pdf["ids"].isna().to_numpy()
            if is_query.all() or not is_query.any():
                continue
            c, q = pdf[~is_query], pdf[is_query]
            x, y = np.array(c["embedding"].tolist(), float), np.array(q["embedding"].tolist(), float)
            near = (y @ x.T) / (np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
            ids, keys = c["ids"].to_numpy(), q["qkey"].to_numpy()
            smallest = np.array([i[0] for i in ids])
            k = min(top + 1, near.shape[1])
            rows = []
            for i, line in enumerate(near):
                least = np.partition(line, -k)[-k]
                at = np.flatnonzero(line >= least)  # all ties at the last place
                found = []
                for j in at[np.lexsort((smallest[at], -line[at]))]:
                    found += [(-line[j], v) for v in ids[j]]
                rows += [(keys[i], v, -s) for s, v in sorted(found)[: top + 1]]
            yield pd.DataFrame(rows, columns=["qkey", "vec_id", "score"])

    dealt = dealt_c.union(dealt_q).withColumn("unit", F.xxhash64("leaf", "c", "q")).select("unit", "qkey", "ids", "embedding")
    found = dealt.repartition("unit").sortWithinPartitions("unit").mapInPandas(rank, "qkey long, vec_id long, score double")
    per_key = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(per_key)).where(F.col("r") <= top + 1).drop("r")
    ids = cut(asked.withColumn("qkey", F.xxhash64("embedding")).select("query_id", "qkey"))
    # copies of a query may be a third of all; a key has top + 1 rows at most
    pairs = join_hot(ids, cut(found), ["qkey"]).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
