"""Byte-level BPE encoding and decoding (operator 7).

Pre-tokens come from the vectorised scan of ``pretok``; each distinct pre-token is merged once a task
and kept in a bounded cache, so that a text's ids are look-ups. Token offsets (code points of the
pre-tokens, and bytes of every id) are kept by ``encode`` for decoding any part of a text.

Defined results: a null or empty text has no ids; both digests are then those of the empty string.
Repeated rows give repeated results; columns of the input other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import pretok
from tidewell.llm.shared import table

NAME = "op7_bpe_roundtrip"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens held by a task at once; beyond it the cache starts anew.
CACHE_ENTRIES = 500_000
#: Pre-tokens of at most so many code points are merged together, longer ones one by one.
BATCHED = 48
#: Texts of about so many code points are encoded at once.
BLOCK = 2_000_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is joined, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + (1 << 30)
    get = ranks.get
    pairs = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    if len(parts) > 256:
        return _merge_long(parts, ranks)
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        pairs.pop(i)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for very long pre-tokens, by a heap over linked parts."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, len(parts[i]), len(parts[j])))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or len(parts[i]) != a or len(parts[j]) != b:
            continue
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[parts[i]] for i in range(n) if alive[i]]


class PairTable:
    """Ranks of joins of two ids, for merging many pre-tokens at once."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        keys, joined = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    joined.append(rank)
        order = np.argsort(keys)
        self.keys, self.joined = np.array(keys, np.int64)[order], np.array(joined, np.int64)[order]
        self.none = 1 << 40
        self.of_byte = np.array([get(bytes([i]), -1) for i in range(256)], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], self.none)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece (none of them empty): in every round each piece joins its pair of lowest rank, leftmost first."""
        part = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces)), lengths)
        out: list[list[int]] = [[] for _ in pieces]
        pair = np.full(len(part), self.none)
        inner = owner[:-1] == owner[1:]
        pair[:-1][inner] = self.ranks(part[:-1][inner], part[1:][inner])
        while len(part):
            firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(firsts, len(part)))
            low = np.minimum.reduceat(pair, firsts)
            done = low == self.none
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    a = firsts[k]
                    out[owner[a]] = part[a : a + sizes[k]].tolist()
                keep = np.repeat(~done, sizes)
                part, owner, pair = part[keep], owner[keep], pair[keep]
                if not len(part):
                    break
                sizes, low = sizes[~done], low[~done]
                firsts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(pair == np.repeat(low, sizes))
            group = np.repeat(np.arange(len(sizes)), sizes)[hits]
            at = hits[np.append(True, group[1:] != group[:-1])]
            part[at] = low
            keep = np.ones(len(part), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            part, owner, pair = part[keep], owner[keep], pair[keep]
            last = np.append(owner[1:] != owner[:-1], True)
            pair[at] = self.none
            right = at[~last[at]]
            pair[right] = self.ranks(part[right], part[right + 1])
            left = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            pair[left] = self.ranks(part[left], part[left + 1])
        return out


class Encoder(dict):
    """Pre-token -> (its ids, their decimal text); fills itself."""

    def __init__(self, ranks: dict[bytes, int], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.ranks, self.entries = ranks, entries
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.pairs = PairTable(ranks)

    def learn(self, texts: list[list[str]]) -> None:
        """Fill in what these pre-tokens lack, all at once."""
        lacking = set(chain.from_iterable(texts)).difference(self)
        if len(self) + len(lacking) > self.entries:
            self.clear()
        pieces = [p for p in lacking if 0 < len(p) <= BATCHED]
        got = [p.encode() for p in pieces]
        whole = [self.ranks.get(b) for b in got]
        rest = [i for i, w in enumerate(whole) if w is None]
        for i, ids in zip(rest, self.pairs.merge([got[i] for i in rest]) if rest else []):
            self[pieces[i]] = (tuple(ids), ",".join(map(str, ids)))
        for p, w in zip(pieces, whole):
            if w is not None:
                self[p] = ((w,), str(w))

    def __missing__(self, piece: str):
        if len(self) >= self.entries:
            self.clear()
        ids = tuple(merge(piece.encode(), self.ranks))
        self[piece] = value = (ids, ",".join(map(str, ids)))
        return value

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of ``text`` and for each its pair of byte offsets."""
        pieces = next(pretok.slices([text]))
        ids = list(chain.from_iterable(self[p][0] for p in pieces))
        spans, at = [], 0
        for i in ids:
            spans.append((at, at := at + len(self.vocabulary[i])))
        return ids, spans

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def roundtrip(docs: DataFrame, ranks_file: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks_file)  # a vocabulary: its size is fixed

    def run(batches):
        key = hashlib.sha256(shared.value).hexdigest()
        if key not in _encoders:
            _encoders[key] = Encoder(load_ranks(shared.value))
        enc = _encoders[key]
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            rows = []
            for block in pretok.blocks(texts, BLOCK):
                enc.learn(block)
                for pieces in block:
                    got = list(map(enc.__getitem__, pieces))
                    ids = list(chain.from_iterable([g[0] for g in got]))
                    shown = ",".join([g[1] for g in got])
                    digests = [hashlib.sha256(x).hexdigest() for x in (shown.encode(), enc.decode(ids))]
                    rows.append((len(ids), *digests))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    # ids travel as text: pandas would turn whole numbers beside nulls into floats
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as f:
        data = f.read()
    return roundtrip(table(spark, sf_dir, "documents"), data)
