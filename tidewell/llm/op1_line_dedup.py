"""Line dedup by a log-template tree (operator 1).

Tokens (split at white space) that hold a digit are variable fields. A line's leaf in the fixed-depth tree
is its number of tokens and its first ``DEPTH`` tokens. Within a leaf, lines that share ``SIMILAR`` of
their tokens (constant ones, at the same positions) are of one template, and so are lines that others link
in this way; the order of lines plays no part. Short lines make a template of their own. A template that occurs in enough documents is recurring: its first
occurrence (smallest document id, then first line) stays, all others are dropped.

Scale: the first pass moves only hashes and finds leaves that two documents share; a bitmap of fixed
size carries them to the second pass, which moves each distinct line of those leaves once. A leaf is never
cut: its lines are dealt out by hashed groups of token positions, so many that two lines of a template
agree on a whole one (``groups_of``), compared there, and joined by components. Groups beyond
``LEAF_LINES`` lines are compared as pairs of blocks. What is dropped joins its document by id and text hash.

Defined results: a null text counts as empty and stays empty. Empty lines stay. Lines without at least
half constant tokens are never templates. Rows of equal id and text are one document and keep the same
lines; rows of equal id and different text are different documents. Further columns are not touched.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.arrays import let
from tidewell.llm.components import components
from tidewell.llm.shared import cut, fresh, join_hot, portions, table

NAME = "op1_line_dedup"
DEPTH = 3
SIMILAR = 0.8
#: Lines of fewer tokens are short: no variable fields but those with digits, and more documents to recur.
SHORT = 8
LEAST_DOCS, LEAST_DOCS_SHORT = 2, 5
#: Distinct lines, and their tokens, of a block; a task compares two blocks at once.
LEAF_LINES, LEAF_TOKENS = 1_500, 3_000_000
FILTER_BITS = 1 << 26
FIELD = "<*>"
DIGIT = re.compile(r"\d", re.A)
DIGIT_TOKEN = re.compile(r"[^ ]*[0-9][^ ]*")


def lines_of(text: str) -> list[tuple[int, str]]:
    """Position and words of the lines that are not blank, single spaces between words."""
    out = []
    for pos, line in enumerate(text.split("\n")):
        if not line:
            continue
        if "  " in line or "\t" in line or "\r" in line or line[0].isspace() or line[-1].isspace():
            line = " ".join(line.split())
            if not line:
                continue
        out.append((pos, line))
    return out


def masked(line: str) -> str:
    """The line with the tokens that hold a digit as variable fields."""
    return DIGIT_TOKEN.sub(FIELD, line) if DIGIT.search(line) else line


def leaf_of(line: str) -> int:
    """The tree's leaf: the number of tokens and the first of them."""
    head = " ".join(line.split(" ", DEPTH)[:DEPTH])
    return xxhash.xxh64_intdigest(f"{line.count(' ')} {masked(head)}") >> 1


def hash_of(line: str) -> int:
    return xxhash.xxh64_intdigest(line) >> 1


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tkey"))


def shared_leaves(docs: DataFrame) -> bytes:
    """A bitmap of fixed size with a bit for each leaf that occurs in two documents."""

    def run(batches):
        for pdf in portions(batches):
            leaves, owners = [], []
            for doc, text in zip(pdf["doc"].tolist(), pdf["text"]):
                own = {leaf_of(line) for _, line in lines_of(text)}
                leaves += own
                owners += [doc] * len(own)
            yield pd.DataFrame({"leaf": np.array(leaves, np.int64), "doc": np.array(owners, np.int64)})

    found = keyed(docs).select("text", F.xxhash64("doc_id", "tkey").alias("doc")).mapInPandas(run, "leaf long, doc long")
    met = found.groupBy("leaf").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b")
    at = F.col("leaf") % FILTER_BITS
    pages = (
        met.select(F.floor(at / 32768).cast("int").alias("page"), (at % 32768).alias("bit"))
        .groupBy("page")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # at most FILTER_BITS / 32768 pages of 4 kB
    )
    out = bytearray(FILTER_BITS // 8)
    for r in pages:
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = r["bits"]
    return bytes(out)


def candidate_lines(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """doc_id, tkey, pos, leaf, m (masked line, null for short ones), line (its hash), short: lines of shared leaves."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = shared.value
        for pdf in portions(batches):
            rows = []
            for doc, key, text in zip(pdf["doc_id"], pdf["tkey"].tolist(), pdf["text"]):
                for pos, line in lines_of(text):
                    leaf = leaf_of(line)
                    at = leaf % FILTER_BITS
                    if not bits[at >> 3] >> (at & 7) & 1:
                        continue
                    m = masked(line)
                    n = m.count(" ") + 1
                    if FIELD in m and m.count(FIELD) * 2 > n:
                        continue
                    short = n < SHORT
                    rows.append((doc, key, pos, leaf, None if short else m, hash_of(m), short))
            yield pd.DataFrame(rows, columns=["doc_id", "tkey", "pos", "leaf", "m", "line", "short"])

    schema = "doc_id string, tkey long, pos int, leaf long, m string, line long, short boolean"
    return keyed(docs).mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def least_same(n: int) -> int:
    """Constant tokens that two lines of ``n`` tokens share at least to be of one template."""
    return math.ceil(SIMILAR * n)


def coded(lines: list[str]) -> np.ndarray:
    """A row of token numbers a line (equal token counts); fields are -1."""
    codes: dict[str, int] = {FIELD: -1}
    return np.array([[codes.setdefault(t, len(codes)) for t in line.split(" ")] for line in lines], np.int32)


def spread(table_: np.ndarray, roots: np.ndarray, reached: list[int]) -> None:
    """Give every line that the ``reached`` ones lead to their root; ``roots`` is -1 where there is none yet."""
    least = least_same(table_.shape[1])
    left = np.flatnonzero(roots < 0)
    while reached and len(left):
        row = table_[at := reached.pop()]
        near = np.count_nonzero((table_[left] == row) & (row >= 0), axis=1) >= least
        roots[left[near]] = roots[at]
        reached += left[near].tolist()
        left = left[~near]


def parse_leaf(lines: list[str]) -> list[int]:
    """For each line of a leaf (equal token counts) the index of the first line of its template."""
    if lines[0].count(" ") + 1 < SHORT:
        return list(range(len(lines)))
    table_ = coded(lines)
    roots = np.full(len(lines), -1)
    for i in range(len(lines)):
        if roots[i] < 0:
            roots[i] = i
            spread(table_, roots, [i])
    return roots.tolist()


def groups_of(leaf: int, m: str) -> list[int]:
    """Keys of the line's groups of token positions. Lines of one template differ, or hold a field, at no more
    positions than there are groups less one, so they agree on a whole group of constant tokens."""
    tokens = m.split(" ")
    n = len(tokens)
    k = n - least_same(n) + 1
    if tokens.count(FIELD) >= k:
        return []
    groups = (tokens[g::k] for g in range(k))
    return [hash_of(f"{leaf} {n} {g} {' '.join(own)}") for g, own in enumerate(groups) if FIELD not in own]


def grouped(distinct: DataFrame) -> DataFrame:
    """bucket, line: the groups of each line."""

    def run(batches):
        for pdf in batches:
            buckets, lines = [], []
            for leaf, line, m in zip(pdf["leaf"].tolist(), pdf["line"].tolist(), pdf["m"]):
                own = groups_of(leaf, m)
                buckets += own
                lines += [line] * len(own)
            yield pd.DataFrame({"bucket": np.array(buckets, np.int64), "line": np.array(lines, np.int64)})

    return distinct.select("leaf", "line", "m").mapInPandas(run, "bucket long, line long")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """line, pivot, near: whether the two lines are of one template by themselves."""

    def run(batches):
        for pdf in batches:
            near = []
            for x, y in zip(pdf["m"], pdf["pm"]):
                one, other = x.split(" "), y.split(" ")
                near.append(len(one) == len(other) and sum(t == u and t != FIELD for t, u in zip(one, other)) >= least_same(len(one)))
            yield pd.DataFrame({"line": pdf["line"], "pivot": pdf["pivot"], "near": near})

    d = pairs.select("line", "pivot").distinct().join(texts.select("line", "m"), "line")
    d = d.join(texts.select(F.col("line").alias("pivot"), F.col("m").alias("pm")), "pivot")
    return d.select("line", "pivot", "m", "pm").mapInPandas(run, "line long, pivot long, near boolean")


def linked(members: DataFrame) -> DataFrame:
    """a, b: lines of one template among the ``members`` (bucket, part, near, line, m) of each part."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            roots = np.full(len(held), -1)
            table_ = coded([m for *_, m in held])
            sure = [i for i, (_, near, _, _) in enumerate(held) if near]
            if sure:
                roots[sure] = sure[0]
                spread(table_, roots, sure[:])
            for i in range(len(held)):
                if roots[i] < 0:
                    roots[i] = i
                    spread(table_, roots, [i])
            pairs = [(held[r][2], held[i][2]) for i, r in enumerate(roots.tolist()) if r != i and not held[i][1]]
            held.clear()
            return pd.DataFrame(pairs, columns=["a", "b"])

        for pdf in batches:
            for bucket, part, n, near, line, m in zip(*(pdf[c].tolist() for c in ("bucket", "part", "n", "near", "line", "m"))):
                if held and held[-1][0] != (bucket, part, n):
                    yield flush()
                held.append(((bucket, part, n), near, line, m))
        if held:
            yield flush()

    d = members.select("bucket", "part", "n", "near", "line", "m").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "n")
    return d.mapInPandas(run, "a long, b long")


def templates(distinct: DataFrame) -> DataFrame:
    """line (hash of the masked line), template (hash of one line of its template) of the lines that are not alone.

    Lines meet in buckets, one a group. All of a bucket are compared with its pivot, the smallest; those near it
    are one template already. Only the others are compared further, in parts: blocks of them with one
    another, and with blocks of the near ones. No part holds more than two blocks.
    """
    texts = cut(distinct.select("leaf", "line", "m").withColumn("n", F.size(F.split("m", " "))))
    met = cut(grouped(texts))
    pivots = met.groupBy("bucket").agg(F.min("line").alias("pivot"), F.max("line").alias("last")).where("pivot <> last").drop("last")
    # lines of one template may fill a third of a bucket's table
    pairs = cut(join_hot(met, cut(pivots), ["bucket"]).where("line <> pivot"))
    near = cut(compared(pairs, texts))
    edges = near.where("near").select(F.col("pivot").alias("a"), F.col("line").alias("b"))

    far = near.where("not near")
    if not far.isEmpty():
        open_ = pairs.join(far, ["line", "pivot"], "left_semi").select("bucket").distinct()
        left = cut(pairs.join(near, ["line", "pivot"]).select("bucket", "line", "pivot", "near"))
        left = cut(join_hot(left, cut(open_), ["bucket"]))
        itself = left.select("bucket", F.col("pivot").alias("line"), F.lit(True).alias("near")).distinct()
        members = left.select("bucket", "line", "near").union(itself)
        sizes = members.groupBy("bucket").agg(F.count_if("near").alias("nears"), F.count_if(~F.col("near")).alias("fars"))
        d = join_hot(cut(members), cut(sizes), ["bucket"]).join(texts.select("line", "m", "n"), "line")
        block = F.least(F.lit(LEAF_LINES), F.greatest(F.lit(2), F.floor(LEAF_TOKENS / F.col("n"))))
        d = d.withColumn("fb", F.ceil(F.col("fars") / block)).withColumn("nb", F.ceil(F.col("nears") / block))
        own = F.pmod("line", F.when(F.col("near"), F.col("nb")).otherwise(F.col("fb")))
        part = lambda i, j: i * (F.col("fb") + F.col("nb")) + j
        each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        with_far = F.filter(each(F.col("fb")), lambda j: j != F.col("own"))
        d = d.withColumn("own", own).withColumn(
            "parts",
            F.when(F.col("near"), F.transform(each(F.col("fb")), lambda i: part(i, F.col("fb") + F.col("own")))).otherwise(
                F.concat(
                    F.transform(with_far, lambda j: part(F.least("own", j), F.greatest("own", j))),
                    F.transform(each(F.col("nb")), lambda j: part(F.col("own"), F.col("fb") + j)),
                )
            ),
        )
        edges = edges.union(linked(d.withColumn("part", F.explode("parts"))))
    return components(cut(edges)).select(F.col("v").alias("line"), F.col("comp").alias("template"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, dropped (positions) of the documents that lose lines."""
    found = cut(candidate_lines(docs, shared_leaves(docs)))
    # only leaves with two different lines need comparing
    distinct = cut(found.where("not short").groupBy("leaf", "line").agg(F.first("m").alias("m")))
    several = cut(distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1"))
    # a third of all lines may be of one leaf, or be one line
    grown = cut(templates(join_hot(distinct, several, ["leaf"], sizes="lines")))
    at = found.select("doc_id", "tkey", "pos", "line", "short")
    own = join_hot(at, grown, ["line"], "left").withColumn("template", F.coalesce("template", "line"))
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "tkey", "pos")
    by_doc = own.groupBy("template", "short", "doc_id", "tkey").agg(F.min(order).alias("first"), F.collect_list("pos").alias("at"))
    by_doc = cut(by_doc)
    by_template = by_doc.groupBy("template", "short").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("docs"))
    recurring = by_template.where(f"docs >= if(short, {LEAST_DOCS_SHORT}, {LEAST_DOCS})").select("template", "short", "kept")
    # a template may stand in a third of all documents
    gone = join_hot(by_doc, cut(recurring), ["template", "short"]).withColumn("here", F.col("first") == F.col("kept"))
    gone = gone.select("doc_id", "tkey", F.when(F.col("here"), F.array_remove("at", F.col("kept.pos"))).otherwise(F.col("at")).alias("at"))
    return gone.where(F.size("at") > 0).groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("at")).alias("dropped"))


def without(lines: Column, dropped: Column) -> Column:
    """``lines`` but those at the ``dropped`` positions: both sorted together by position, a mark before the line it drops."""
    own = F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.lit(1).alias("own"), line.alias("line")))
    marks = F.transform(dropped, lambda i: F.struct(i.alias("i"), F.lit(0).alias("own"), F.lit("").alias("line")))
    stays = lambda a: F.filter(a, lambda x, j: (x["own"] == 1) & (F.coalesce(F.get(a, j - 1)["own"], F.lit(1)) == 1))
    return F.transform(let(F.array_sort(F.concat(own, marks)), stays), lambda x: x["line"])


def dedup(docs: DataFrame, lines: str | None = None, gone_lines: str | None = None) -> DataFrame:
    """``docs`` with the recurring lines taken from ``text``; their numbers are added as ``n_lines`` and ``n_dropped``
    (with underscores behind where ``docs`` has columns of these names), or under the names given."""
    lines, gone_lines = lines or fresh(docs, "n_lines"), gone_lines or fresh(docs, "n_dropped")
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    gone_id, gone_key, dropped = fresh(d, "gone_id"), fresh(d, "gone_key"), fresh(d, "dropped")
    gone = dropped_lines(docs).select(F.col("doc_id").alias(gone_id), F.col("tkey").alias(gone_key), F.col("dropped").alias(dropped))
    d = d.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_key)), "left")
    rest = F.array_join(without(F.split("text", "\n"), F.col(dropped)), "\n")
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    d = d.withColumn(lines, n_lines).withColumn(gone_lines, F.coalesce(F.size(dropped), F.lit(0)).cast("long"))
    return d.withColumn("text", F.when(F.col(dropped).isNull(), F.col("text")).otherwise(rest)).drop(dropped, gone_id, gone_key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_chars, n_lines, n_dropped of every document."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_dropped")
