"""N-gram Jaccard join with Bayesian candidate pruning (operator 8).

Documents' words (lower case) give sets of five-word shingles. Equal sets form one representative with
a count of copies, so copies are never paired. Representatives meet in buckets of 20 bands of 4 MinHash
values (a pair at similarity 0.8 is missed with chance 3e-5). Within a bucket, values are compared in
steps of 16; a pair is dropped once the posterior probability (uniform prior) that its similarity
reaches the threshold falls below the tolerance. What is left bounds small components, in which every
pair that survives the same pruning is verified exactly on its shingle sets.

Scale: buckets with the same members are one bucket; large buckets and components are dealt out as pairs
of blocks, so no task holds more than two blocks; pairs never become rows, only links' counts and one
edge a member to its local root do. Components are found by joins.

Defined results: a document without words (or null text) has no shingles; it is a class of its own with
no links. A document of one to four words is one shingle. Repeated rows are copies of each other. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.shared import cut, fresh, join_hot, portions, table

NAME = "op8_jaccard_join"
WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: Members of a block: a task compares at most two blocks at once.
BLOCK = 1_000
#: Bits of the fixed-size filter that says which texts the verification reads.
FILTER_BITS = 1 << 26
WORD_CACHE = 300_000
WORD = re.compile(r"\w+")

_rng = np.random.default_rng(20_240_817)
_A = _rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, np.uint64)
_POWERS = [np.uint64(x) for x in _rng.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)]


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(w))):
        h += w[j : j + n] * _POWERS[j]
    if len(w) < WORDS:
        h += np.uint64(len(w))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(shingles), 4_000):
        part = shingles[a : a + 4_000, None] * _A + _B
        np.minimum(out, (part.min(axis=0) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest agreeing values among ``n`` at which P(similarity >= threshold) is not below the tolerance.

    With a uniform prior that posterior is the chance that a binomial of n + 1 trials is at most the number that agree.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def surviving_pairs(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures that the incremental comparison keeps; ``right`` None: pairs within ``left``."""
    other = left if right is None else right
    out_a, out_b = [], []
    need = {n: least_matches(n) for n in range(STEP, HASHES + 1, STEP)}
    chunk = max(1, 4_000_000 // max(1, len(other) * STEP))
    for start in range(0, len(left), chunk):
        part = left[start : start + chunk, :STEP]
        agree = (part[:, None, :] == other[None, :, :STEP]).sum(axis=2, dtype=np.int16)
        keep = agree >= need[STEP]
        if right is None:
            keep &= np.arange(len(other))[None, :] > (start + np.arange(len(part)))[:, None]
        a, b = np.nonzero(keep)
        got = agree[a, b]
        a += start
        for n in range(2 * STEP, HASHES + 1, STEP):
            if not len(a):
                break
            got = got + (left[a, n - STEP : n] == other[b, n - STEP : n]).sum(axis=1, dtype=np.int16)
            keep = got >= need[n]
            a, b, got = a[keep], b[keep], got[keep]
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a) if out_a else np.zeros(0, int), np.concatenate(out_b) if out_b else np.zeros(0, int)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the index pairs reach the threshold, by exact set sizes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, codes = np.unique(values, return_inverse=True)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    seen = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    order = np.argsort(a, kind="stable")
    keep = np.zeros(len(a), bool)
    cuts = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(a) else []
    for s, e in zip(cuts, [*cuts[1:], len(order)]):
        at = order[s:e]
        i = a[at[0]]
        own = codes[firsts[i] : firsts[i + 1]]
        seen[own] = True
        for k in at:
            j = b[k]
            if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]):
                both = int(np.count_nonzero(seen[codes[firsts[j] : firsts[j + 1]]]))
                # whole numbers times ten thousand: no rounding at the threshold itself
                keep[k] = both * 10_000 >= round(threshold * 10_000) * (int(sizes[i]) + int(sizes[j]) - both)
        seen[own] = False
    return keep


def groups(batches, key: str):
    """Frames of equal keys from batches sorted by ``key``."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        values = pdf[key].to_numpy()
        if not len(values):
            continue
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        if held and held[0][key].iloc[0] != values[0]:
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for a, b in zip(cuts, cuts[1:]):
            part = pdf.iloc[a:b]
            if b < len(values):
                yield pd.concat([*held, part]) if held else part
                held = []
            else:
                held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def in_blocks(df: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """Deal groups out as pairs of blocks: adds ``unit`` (one task's group), ``block`` (own), ``first``, ``second``."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    df = df.withColumn("block", F.pmod(F.xxhash64("sid"), blocks).cast("int")).withColumn("blocks", blocks)
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    return df.withColumn("unit", F.xxhash64(group, "first", "second")).drop("other", "blocks")


def halves(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """Row numbers of the two blocks of a unit; None: one block against itself."""
    if pdf["first"].iloc[0] == pdf["second"].iloc[0]:
        return np.arange(len(pdf)), None
    own = (pdf["block"] == pdf["first"]).to_numpy()
    return np.flatnonzero(own), np.flatnonzero(~own)


def unit_pairs(pdf: pd.DataFrame, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = halves(pdf)
    a, b = surviving_pairs(sigs[left], None if right is None else sigs[right])
    return left[a], (left if right is None else right)[b]


def read_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text key, set id and signature of every row."""

    def run(batches):
        hashes = WordHashes()
        for pdf in portions(batches):
            sids, sigs = [], []
            for t in pdf["text"]:
                s = shingle_set(t, hashes)
                sids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tkey": pdf["tkey"], "sid": sids, "sig": sigs})

    found = keyed(docs).mapInPandas(run, "doc_id string, tkey long, sid binary, sig binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tkey"))


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b): a member of a bucket and the root of its surviving pairs there."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * ROWS * 4 + 1, F.lit(ROWS * 4))))
    members = reps.select("sid", F.explode(bands).alias("key"))
    members = cut(members)
    # buckets of the same members count once; their numbers are aggregated partially, so that no bucket is one task
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.min("sid").alias("least")).where("n > 1")
    buckets = cut(buckets.select("key", "n", F.xxhash64("n", "x", "least").alias("bucket")))
    members = join_hot(members, buckets, ["key"], sizes="n")
    members = members.groupBy("bucket", "sid").agg(F.max("n").alias("n"))
    members = in_blocks(members.join(reps.select("sid", "sig"), "sid"), "bucket", "n", BLOCK)

    def run(batches):
        for pdf in groups(batches, "unit"):
            a, b = unit_pairs(pdf, signatures(pdf["sig"]))
            root = local_roots(len(pdf), a, b)
            own = np.flatnonzero(root != np.arange(len(pdf)))
            sid = pdf["sid"].to_numpy()
            yield pd.DataFrame({"a": sid[own], "b": sid[root[own]]})

    dealt = members.select("unit", "first", "second", "block", "sid", "sig").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInPandas(run, "a binary, b binary").distinct()


def wanted_filter(tkeys: DataFrame) -> bytes:
    """A bitmap of fixed size with a bit for each key's hash."""
    at = F.pmod("tkey", F.lit(FILTER_BITS))
    rows = (
        tkeys.select(F.floor(at / 32768).cast("int").alias("page"), F.pmod(at, F.lit(32768)).alias("bit"))
        .groupBy("page")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # at most FILTER_BITS / 32768 pages of 4 kB
    )
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = r["bits"]
    return bytes(out)


def sets_of(docs: DataFrame, wanted: bytes) -> DataFrame:
    """sid, shingles of the texts whose keys' bits are set."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        hashes = WordHashes()
        bits = np.frombuffer(shared.value, np.uint8)
        for pdf in portions(batches):
            at = pdf["tkey"].to_numpy() % FILTER_BITS
            pdf = pdf[bits[at // 8] >> (at % 8).astype(np.uint8) & 1 == 1].drop_duplicates("tkey")
            rows = []
            for t in pdf["text"]:
                s = shingle_set(t, hashes)
                if len(s):
                    rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes()))
            yield pd.DataFrame(rows, columns=["sid", "shingles"])

    return keyed(docs).select("text", "tkey").mapInPandas(run, "sid binary, shingles binary")


def links(members: DataFrame) -> DataFrame:
    """sid, root, links: for each unit and member its local root and how many documents it is linked to there."""

    def run(batches):
        for pdf in groups(batches, "unit"):
            sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
            a, b = unit_pairs(pdf, signatures(pdf["sig"]))
            keep = verified(a, b, sets)
            a, b = a[keep], b[keep]
            copies = pdf["copies"].to_numpy()
            n = np.zeros(len(pdf), np.int64)
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
            texts = np.bincount(a, minlength=len(pdf)) + np.bincount(b, minlength=len(pdf))
            root = local_roots(len(pdf), a, b)
            sid = pdf["sid"].to_numpy()
            yield pd.DataFrame({"sid": sid, "root": sid[root], "links": n, "texts": texts})

    dealt = in_blocks(members, "comp", "size", BLOCK)
    dealt = dealt.select("unit", "first", "second", "block", "sid", "sig", "shingles", "copies").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInPandas(run, "sid binary, root binary, links long, texts long")


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (text hash), class_id, links, linked_texts of every row."""
    rows = cut(read_sets(docs))
    reps = rows.where("sid is not null").groupBy("sid").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.min("sig").alias("sig"), F.min("tkey").alias("tkey")
    )
    reps = cut(reps)
    comps = components(candidate_edges(reps)).select(F.col("v").alias("sid"), "comp")
    sizes = cut(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size")))
    # a component may hold a third of all sets
    near = cut(join_hot(comps, sizes, ["comp"], sizes="size").join(reps, "sid"))
    found = sets_of(docs, wanted_filter(near.select("tkey"))).groupBy("sid").agg(F.min("shingles").alias("shingles"))
    linked = cut(links(near.join(found, "sid")))
    classes = components(linked.where("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("sid").agg(F.sum("links").alias("links"), F.sum("texts").alias("linked_texts"))
    with_ids = cut(classes.join(reps.select(F.col("sid").alias("v"), "first_id"), "v"))
    ids = cut(with_ids.groupBy("comp").agg(F.min("first_id").alias("class_id")))
    final = join_hot(with_ids, ids, ["comp"]).select(F.col("v").alias("sid"), "class_id", F.col("comp").alias("class")).join(counts, "sid", "left")
    of_sets = cut(reps.select("sid", "copies", "first_id").join(final, "sid", "left"))
    # a set may have a third of all rows as copies; rows without words have none
    found = join_hot(rows.select("doc_id", "tkey", "sid"), of_sets, ["sid"], "left", sizes="copies")
    return found.select(
        "doc_id",
        "tkey",
        F.coalesce("class", "sid").alias("class"),
        F.coalesce("class_id", "first_id", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("links"),
        F.coalesce("linked_texts", F.lit(0)).alias("linked_texts"),
    )


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of the class), links (documents at the threshold), linked_texts (distinct other shingle sets)."""
    return classes_of(docs).drop("tkey", "class")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one for each class: that of the smallest id. Rows without words all stay."""
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("tkey").alias("t"))
    found = classes_of(docs).where("class is not null").select("doc_id", "tkey", "class", order.alias("at"))
    found = cut(found)
    first = cut(found.groupBy("class").agg(F.min("at").alias("first")))
    gone = join_hot(found, first, ["class"]).where(F.col("at") != F.col("first"))
    gone_id, gone_key, tkey = fresh(docs, "gone_id"), fresh(docs, "gone_key"), fresh(docs, "tkey")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("tkey").alias(gone_key)).distinct()
    d = docs.withColumn(tkey, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = d.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(tkey) == F.col(gone_key)), "left_anti")
    # repeated rows of the document that stays are copies of it, too
    words = F.coalesce("text", F.lit("")).rlike(r"[\p{L}\p{N}_]")
    some, none = kept.where(words), kept.where(~words)
    return some.dropDuplicates(["doc_id", tkey]).union(none).drop(tkey)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
