"""Packing documents into token sequences by cutting-stock column generation (operator 4).

1. Every text is encoded in one pass over the documents; a document longer than a sequence is cut into
   full sequences and a remainder. Pieces carry their checksum, so ids need not be kept.
2. The remainders' length histogram (at most ``capacity`` bins, whatever the corpus) goes to the driver.
   A linear program over patterns of lengths is solved by column generation: best fit's patterns are the
   first basis, and a knapsack dynamic program over the dual prices yields patterns of negative reduced
   cost until the value is within ``GAP`` of its bound. Patterns are rounded down; what they leave is
   packed by best fit over the same histogram.
3. Each remainder gets a rank within its length (counts by partition first, then local row numbers, so
   that a length shared by a third of all documents is never in one task), and ranks map to
   (pattern use, slot) by the bounded table of patterns.

Defined results: a null or empty text is its closing id alone. Repeated rows are packed each on its own. A text that holds
the literal of one of the vocabulary's added tokens has that token's id there if ``added`` is set, as in the query and in a
plain call of the library; otherwise the literal is encoded like other text.
"""

from __future__ import annotations

import hashlib
import json
import logging
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import pretok
from tidewell.llm.shared import PORTION, cut, table

NAME = "op4_packing"
TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 1
#: Distinct pre-tokens held by a worker in each of two generations: it keeps them between tasks, some 250 bytes each.
CACHE_ENTRIES = 200_000
#: Code points of the texts encoded at once.
BLOCK = 4_000_000
#: Pre-tokens that one call of the tokenizer takes.
CALL = 1_000
#: The linear program ends once its bound is within this share of its value, or so many rounds together gain less than that.
GAP = 1e-4
STALLED = 40
#: Weight of the best bound's prices in pricing; columns offered a round; factors beyond two a length before the inverse is renewed.
PULL, OFFERED, FACTORS = 0.8, 60, 1_000


def byte_alphabet() -> str:
    """The character by which byte-level tokenizers write each byte: itself where it is visible, else the next free one from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("\u00a1"), ord("\u00ac") + 1), *range(ord("\u00ae"), ord("\u00ff") + 1)]
    free = iter(range(256, 512))
    return "".join(chr(b) if b in visible else chr(next(free)) for b in range(256))


class PieceCache(dict):
    """Pre-token -> its ids as little-endian 32-bit integers, by the ``tokenizers`` library."""

    def __init__(self, tokenizer_json: str, entries: int = CACHE_ENTRIES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.entries = entries
        # pre-tokens come cut, in the byte alphabet, which has no white space: blanks keep many apart in one call
        self.tokenizer = Tokenizer(Tokenizer.from_str(tokenizer_json).model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = byte_alphabet()[:255] + " "  # no byte of UTF-8 is 255
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.older: dict[str, bytes] = {}

    def encoded(self, pieces: list[str]):
        """The ids of each piece."""
        for a in range(0, len(pieces), CALL):
            own = pieces[a : a + CALL]
            data = list(map(str.encode, own))
            shown = b"\xff".join(data).decode("latin-1").translate(self.alphabet)
            ids = np.array(self.tokenizer.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            # ids tile the pieces' bytes, so that a piece ends with the id that ends with its last byte
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))) + 1
            ends, data = (4 * ends).tolist(), ids.tobytes()
            yield from (data[x:y] for x, y in zip([0, *ends], ends))

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, from the cache or by the tokenizer."""
        lacking = [p for p in pieces if p not in self]
        if len(self) + len(lacking) > self.entries:
            self.older = dict(self)
            self.clear()
            lacking = pieces
        kept = [p for p in lacking if p in self.older]
        self.update((p, self.older[p]) for p in kept)
        if kept:
            lacking = [p for p in lacking if p not in self]
        self.update(zip(lacking, self.encoded(lacking)))
        return list(map(self.__getitem__, pieces))


def encoded_texts(texts: list[str], cache: PieceCache):
    """Numbers of texts and their ids (32 bits, little endian), block by block."""
    for which, sizes, codes, distinct in pretok.coded(texts, BLOCK):
        own = cache.ids_of(distinct)
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), "<u4")
        n = lengths[codes]
        ends = np.cumsum(n)
        # the place in ``flat`` of every id: the piece's first, and onwards
        shift = (np.cumsum(lengths) - lengths)[codes] - (ends - n)
        ids = flat[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist()
        yield from zip(which, (ids[a:b] for a, b in zip(bounds, bounds[1:])))


def added_tokens(tokenizer_json: str) -> dict[str, int]:
    """Literal -> id of the tokens beside the model; they take no white space in and need no word borders."""
    out = {}
    for t in json.loads(tokenizer_json).get("added_tokens") or []:
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
            raise ValueError(f"an added token that looks at its surroundings: {t['content']!r}")
        out[t["content"]] = t["id"]
    return out


def encoded_with_added(texts: list[str], cache: PieceCache, added: dict[str, int]):
    """Numbers of texts and their ids, where literals of ``added`` tokens (the longest of the leftmost) are ids of their own."""
    literals = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    marked = {k: literals.findall(t) for k, t in enumerate(texts) if literals.search(t)} if literals else {}
    yield from ((k, ids) for k, ids in encoded_texts(["" if k in marked else t for k, t in enumerate(texts)], cache) if k not in marked)
    for k, marks in marked.items():
        parts = literals.split(texts[k])
        ids = dict(encoded_texts(parts, cache))
        between = [np.array([added[m]], "<u4") for m in marks] + [np.array([], "<u4")]
        yield k, np.concatenate([x for j in range(len(parts)) for x in (ids[j], between[j])])


_caches: dict[str, PieceCache] = {}


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document cut into full sequences and a remainder.

    ``added``: whether literals of the vocabulary's added tokens are these tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary: its size is fixed
    end = np.array([END_ID], "<u4").tobytes()
    tokens = added_tokens(tokenizer_json) if added else {}

    def run(batches):
        key = hashlib.sha256(shared.value.encode()).hexdigest()
        if key not in _caches:
            _caches[key] = PieceCache(shared.value)
        cache = _caches[key]
        for whole in batches:
            # texts become strings a portion at a time; pandas would make all of a batch's at once
            for at in range(0, whole.num_rows, PORTION):
                batch = whole.slice(at, PORTION)
                ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
                rows = []
                for k, found in encoded_with_added(texts, cache, tokens):
                    data = found.tobytes() + end
                    n = len(data) // 4
                    for a in range(0, n, capacity):
                        b = min(a + capacity, n)
                        rows.append((ids[k], a, b - a, zlib.crc32(data[4 * a : 4 * b]), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """The most value within every capacity up to ``capacity``; ``value`` is indexed by length, any number of each."""
    best = np.zeros(capacity + 1)
    for c in range(capacity):
        if c and best[c] <= best[c - 1]:
            best[c] = best[c - 1]  # whatever goes on from here goes on from there
            continue
        rest = best[c + 1 :]
        np.maximum(rest, value[1 : capacity - c + 1] + best[c], out=rest)
    best[capacity] = max(best[capacity], best[max(capacity - 1, 0)])
    return best


def items(best: np.ndarray, value: np.ndarray, c: int) -> list[int]:
    """Lengths that make up the value ``best[c]``."""
    out = []
    while c > 0 and best[c] > 0:
        if best[c] == best[c - 1]:
            c -= 1
            continue
        s = int((best[:c][::-1] + value[1 : c + 1]).argmax()) + 1
        out.append(s)
        c -= s
    return out


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Unbounded knapsack: the lengths (1-based index into ``prices``) of most value that fit ``capacity``."""
    value = np.zeros(capacity + 1)
    n = min(len(prices), capacity)
    value[1 : n + 1] = np.where(prices[:n] > 1e-12, prices[:n], 0)
    best = knapsack(value, capacity)
    return float(best[capacity]), items(best, value, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Longest first: each sequence takes the longest length that still fits, again and again; equal fills are made at once."""
    left = counts.copy()
    out = []
    top = capacity
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            return out
        pattern, room, uses = [], capacity, None
        here = min(top, room)
        taken: dict[int, int] = {}
        while room > 0 and here > 0:
            here = min(here, room)
            while here > 0 and left[here] - taken.get(here, 0) <= 0:
                here -= 1
            if here == 0:
                break
            fits = min(room // here, int(left[here]) - taken.get(here, 0))
            pattern += [here] * fits
            taken[here] = taken.get(here, 0) + fits
            room -= here * fits
            here -= 1
        uses = min(int(left[s]) // n for s, n in taken.items())
        for s, n in taken.items():
            left[s] -= n * uses
        out.append((pattern, uses))


Column = tuple[tuple[int, ...], tuple[float, ...]]


class Basis:
    """A basis of the linear program over patterns: its columns (rows and counts), how often each is used, its inverse as a product.

    It begins with each length by itself, as often as it fits, whose inverse is diagonal; every change of a column
    adds one sparse factor.
    """

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, capacity: int):
        per = (capacity // sizes).astype(float)
        self.columns: list[Column] = [((i,), (n,)) for i, n in enumerate(per.tolist())]
        self.scale, self.inverse = 1 / per, None
        self.factors: list[tuple[int, np.ndarray, np.ndarray, float]] = []
        self.level = demand * self.scale

    def direction(self, column: Column) -> np.ndarray:
        """The inverse times ``column``."""
        rows, counts = list(column[0]), np.array(column[1])
        if self.inverse is None:
            x = np.zeros(len(self.columns))
            x[rows] = counts * self.scale[rows]
        else:
            x = self.inverse[:, rows] @ counts
        for r, at, by, own in self.factors:
            if t := x[r]:
                t /= own
                x[at] -= t * by
                x[r] = t
        return x

    def prices(self) -> np.ndarray:
        """Dual prices: a sequence costs one."""
        y = np.ones(len(self.columns))
        for r, at, by, own in reversed(self.factors):
            y[r] = (y[r] - (y[at] @ by - y[r] * own)) / own
        return y * self.scale if self.inverse is None else y @ self.inverse

    def enter(self, column: Column, uses: float = 0.0) -> bool:
        """Bring ``column``, used ``uses`` times outside the basis, into it, or to no use at all, whichever costs less."""
        x = self.direction(column)
        more = x.sum() > 1 + 1e-9
        if not more and not uses:
            return False
        down = x if more else -x
        block = np.flatnonzero(down > 1e-9)
        if not len(block):
            self.level += uses * x
            return False
        ratios = self.level[block] / down[block]
        k = int(ratios.argmin())
        step, r = float(ratios[k]), int(block[k])
        if not more and uses <= step:
            self.level += uses * x
            return False
        self.level -= step * down
        np.maximum(self.level, 0, out=self.level)
        self.level[r] = uses + step if more else uses - step
        at = np.flatnonzero(np.abs(x) > 1e-12)
        self.factors.append((r, at, x[at], float(x[r])))
        self.columns[r] = column
        return True

    def renew(self) -> None:
        """One dense inverse in place of the factors."""
        whole = np.zeros((len(self.columns), len(self.columns)))
        for k, (rows, counts) in enumerate(self.columns):
            whole[list(rows), k] = counts
        self.inverse, self.factors = np.linalg.inv(whole), []


def plan(counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[list[int], int]], float]:
    """Patterns of lengths and how often each is used, covering ``counts`` (indexed by length) exactly; and the share by
    which the linear program's value may exceed its optimum.

    Best fit's patterns make the first basis. Columns are priced at a mix of the basis' prices and the best bound's.
    The program ends within ``gap`` of its bound or within one sequence, at its optimum, or once ``STALLED`` rounds
    together gain less than ``gap``.
    """
    sizes = np.flatnonzero(counts[: capacity + 1])
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return [], 0.0
    demand = counts[sizes].astype(float)
    row = {int(s): i for i, s in enumerate(sizes)}

    def column_of(pattern: list[int]) -> Column:
        distinct, n = np.unique(pattern, return_counts=True)
        return tuple(row[int(s)] for s in distinct), tuple(n.astype(float).tolist())

    # a trace more than is asked for, most of the shortest: no two lengths run out together
    basis = Basis(sizes, np.linspace(2e-6, 1e-6, len(sizes)), capacity)
    for pattern, uses in best_fit(counts, capacity):
        basis.enter(column_of(pattern), float(uses))
    bound, centre, pull = float(sizes @ demand) / capacity, sizes / capacity, PULL
    values = [basis.level.sum()]
    while True:
        if len(basis.factors) > 2 * len(sizes) + FACTORS:
            basis.renew()
        prices = pull * centre + (1 - pull) * np.maximum(basis.prices(), 0)
        value = np.zeros(capacity + 1)
        value[sizes] = prices
        best = knapsack(value, capacity)
        worth = float(best[capacity])
        if float(prices @ demand) / worth > bound:
            bound, centre = float(prices @ demand) / worth, prices / worth
        over = basis.level.sum() - bound
        stalled = len(values) > STALLED and values[-STALLED] - values[-1] <= gap * bound
        if over <= max(1.0, gap * bound) or stalled or (not pull and worth <= 1 + 1e-9):
            break
        # the best pattern with each length, and the most promising of these
        total = value[sizes] + best[capacity - sizes]
        offered = {tuple(sorted([int(sizes[i]), *items(best, value, int(capacity - sizes[i]))])) for i in np.argsort(-total)[:OFFERED]}
        entered = sum([basis.enter(column_of(list(p))) for p in sorted(offered)])
        pull = PULL if entered else 0.0
        values.append(basis.level.sum())
    left = counts.copy()
    out = []
    for (rows, n), x in sorted(zip(basis.columns, basis.level), key=lambda c: -c[1]):
        uses = min([int(x + 1e-3), *(int(left[sizes[i]]) // int(k) for i, k in zip(rows, n))])
        if uses > 0:
            for i, k in zip(rows, n):
                left[sizes[i]] -= int(k) * uses
            out.append(([int(sizes[i]) for i, k in zip(rows, n) for _ in range(int(k))], uses))
    return out + best_fit(left, capacity), max(over, 0.0) / bound


def solve(counts: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[list[int], int]]:
    """The patterns of ``plan``; a word in the log where their optimality is not proven."""
    patterns, over = plan(counts, capacity, gap)
    if over > gap:
        logging.getLogger(__name__).info("packing: the linear program's value is within %.2g of its bound", over)
    return patterns


def placements(patterns: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length, ranges of ranks: rank ``first + i`` lies in use ``i div per`` of the pattern, slot ``i mod per``."""
    rows, given, base = [], {}, 0
    for pattern, uses in patterns:
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            per = pattern.count(s)
            rows.append((s, given.get(s, 0), given.get(s, 0) + per * uses, per, base, offset))
            given[s] = given.get(s, 0) + per * uses
            offset += per * s
        base += uses
    return pd.DataFrame(rows, columns=["length", "first", "last", "per", "base", "shift"]).astype("int64")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (written, so that they are read twice alike) with their sequence and offset."""
    spark = found.sparkSession
    found = found.withColumn("part", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id())
    found = cut(found)
    # one row for each length and part of the input: what earlier parts hold of a length comes first
    by_part = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in totals:
        counts[r["length"]] = r["n"]
    full = int(counts[capacity])
    counts[capacity] = 0
    patterns = solve(counts, capacity)
    table_ = placements(patterns)
    if full:
        table_.loc[len(table_)] = [capacity, 0, full, 1, int(sum(u for _, u in patterns)), 0]
    before = by_part.withColumn(
        "earlier", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ).drop("n")
    local = Window.partitionBy("part", "length").orderBy("place")
    ranked = (
        found.withColumn("local", F.row_number().over(local) - 1)
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("earlier") + F.col("local"))
    )
    # the patterns' table: a row for each length of each pattern, bounded by the number of lengths, not of documents
    ranges = spark.createDataFrame(table_, "length long, first long, last long, per long, base long, shift long")
    lists = ranges.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "per", "base", "shift"))).alias("ranges"))
    joined = ranked.join(F.broadcast(lists), "length")
    hit = F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["last"]))[0]
    placed = joined.withColumn("hit", hit).withColumn("i", F.col("rank") - F.col("hit.first"))
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("hit.base") + F.expr("i div hit.per")).alias("sequence_id"),
        (F.col("hit.shift") + F.col("i") % F.col("hit.per") * F.col("length")).alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    with open(tokenizer_path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        data = f.read()
    return pack(pieces(table(spark, sf_dir, "documents"), data, added=True))
