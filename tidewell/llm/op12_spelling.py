"""Spelling variant grouping: words at edit distance one, by joining tries with themselves (operator 12).

Words are counted over the whole corpus; rare runs have a letter deleted by the rule of ``variant``. The vocabulary's tries are then joined
with themselves: every trie node carries its active nodes, those at distance one from it, and hands them down to its children (a child's active
nodes are its parent, its siblings, its own children, and the children by the same letter of its parent's active nodes). Terminal nodes
that are active for one another are a pair at distance one.

Tries are partitioned by prefix. Words of l letters and those of l + 1 form a family. Two of a family whose common
prefix has half of l letters at least meet in the trie of that prefix; in any other pair the edit lies in the first half, so both share the
other half as a suffix, and they meet in the trie of what stands before that suffix. A trie of over ``TRIE`` letters is parted in the same
way, by half of what its words do not share yet, until at most one letter of the shorter words is open; such a trie has fewer than 10,000
letters, as the alphabet has 90. So no trie is large, whatever prefix many words begin with, and none is cut: every pair meets in the one
trie that its common prefix says. A word stands in at most four tries at first, and in twice as many for each parting of its own tries.

Scale: runs are counted before they move; what moves later grows with the vocabulary. Words by key go to tasks that build one trie at a time.
Words with a form (few) follow their forms by doubling joins, as many as the logarithm of the longest chain.

Defined results: null texts have no runs; a null id counts as the empty text in the rule; repeated rows count each; of several near words of the largest count the first
in code-point order is the form; an empty table gives no rows; further columns are not read. Runs of any length are words.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import cut, join_hot, table

NAME = "op12_spelling"
LETTERS = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_TIMES = 6, 5
#: A run in so many loses a letter.
EVERY = 199
#: A form stands so many times as often as its variant, at least.
TIMES = 5
#: Letters that are not yet shared, over all words of a trie.
TRIE = 200_000
#: What says which trie a word stands in: the family, letters shared in front and behind, and the bound of common prefixes.
TRIE_OF = ["l", "f", "b", "high"]


def lowered(run: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, CAPITALS, SMALL))


def variant(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where the checksum of id and run says so."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % EVERY == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of six letters or more that stand five times or more in all documents."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    # shorter runs cannot become words
    d = d.where(F.length("run") >= LEAST_LETTERS).select("id", lowered(F.col("run")).alias("run"))
    words = d.select(variant(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


def parted(rows: DataFrame) -> DataFrame:
    """Each row (word, n and ``TRIE_OF``) in two tries: of half of the open letters as prefix, and of the rest as suffix."""
    open_ = F.col("l") - F.col("f") - F.col("b")
    half = F.floor(open_ / 2).cast("int")
    front = F.struct("l", (F.col("f") + half).alias("f"), "b", "high")
    behind = F.struct("l", "f", (F.col("b") + open_ - half).alias("b"), (F.col("f") + half).alias("high"))
    out = rows.select("word", "n", F.explode(F.array(front, behind)).alias("t")).select("word", "n", *[F.col(f"t.{c}").cast("int").alias(c) for c in TRIE_OF])
    shared = [F.substring("word", F.lit(1), F.col("f")), F.substring("word", F.length("word") - F.col("b") + 1, F.col("b"))]
    return out.withColumn("key", F.xxhash64(*TRIE_OF, *shared))


def tries(words: DataFrame) -> DataFrame:
    """word, n, key and ``TRIE_OF`` of every trie that each word stands in."""
    m = F.length("word")
    families = F.filter(F.array(m, m - 1), lambda x: x >= LEAST_LETTERS)
    rows = words.select("word", "n", F.explode(families).alias("l"))
    rows = cut(parted(rows.select("word", "n", "l", F.lit(0).alias("f"), F.lit(0).alias("b"), (F.col("l") + 1).alias("high"))))
    done = []
    while True:
        open_ = F.length("word") - F.col("f") - F.col("b")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(open_).alias("letters"), F.max(F.col("l") - F.col("f") - F.col("b")).alias("left"))
        large = cut(sizes.where((F.col("letters") > TRIE) & (F.col("left") > 1) & (F.col("size") > 1)).select("key", "size"))
        if large.isEmpty():
            break
        told = cut(join_hot(rows, large, ["key"], "left", sizes="size"))
        done.append(told.where("size is null").select(*rows.columns))
        rows = cut(parted(told.where("size is not null")))
    for d in done:
        rows = rows.unionByName(d)
    return rows


def near_in_trie(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of positions in ``texts`` (which differ) whose texts are at distance one, each once."""
    children: list[dict[str, int]] = [{}]
    ends: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        at = 0
        for letter in text:
            down = children[at].get(letter)
            if down is None:
                down = children[at][letter] = len(children)
                children.append({})
            at = down
        ends.setdefault(at, []).append(i)
    if 0 in ends:
        yield from ((i, j) for v in children[0].values() for i in ends[0] for j in ends.get(v, ()))
    waiting: list[tuple[int, set[int]]] = [(0, set(children[0].values()))]
    while waiting:
        node, active = waiting.pop()
        own = children[node]
        around = {node, *own.values()}
        for letter, child in own.items():
            below = around | set(children[child].values())
            for v in active:
                if (down := children[v].get(letter)) is not None:
                    below.add(down)
            below.discard(child)
            if child in ends:
                for v in below:
                    if v > child and v in ends:
                        yield from ((i, j) for i in ends[child] for j in ends[v])
            if children[child]:
                waiting.append((child, below))


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every word beside each of those at distance one, with the other's count."""

    def pairs(of: tuple, held: list[tuple[str, int]]) -> Iterator[tuple[str, str, int]]:
        l, f, b, high = of
        for i, j in near_in_trie([w[f : len(w) - b] for w, _ in held]):
            (one, n), (other, k) = held[i], held[j]
            # pairs of two longer words are the next family's, other common prefixes another trie's; keys are hashes, so what is shared is looked at
            if min(len(one), len(other)) == l and len(commonprefix([one, other])) < high and one[:f] == other[:f] and one[len(one) - b :] == other[len(other) - b :]:
                yield one, other, k
                yield other, one, n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, found = None, [], []
        for pdf in batches:
            for key, *of, word, n in zip(*(pdf[c].tolist() for c in ("key", *TRIE_OF, "word", "n"))):
                if last != (key, *of):
                    if len(held) > 1:
                        found += pairs(last[1:], held)
                    last, held = (key, *of), []
                held.append((word, n))
            if found:
                yield pd.DataFrame(found, columns=["word", "near", "near_n"])
                found = []
        if len(held) > 1:
            yield pd.DataFrame(pairs(last[1:], held), columns=["word", "near", "near_n"])

    d = tries(words).select("key", *TRIE_OF, "word", "n").repartition("key").sortWithinPartitions("key", *TRIE_OF)
    return d.mapInPandas(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of each word's forms. ``forms`` (word, root) has one form a word, and forms never come back to it."""
    while True:
        ahead = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(join_hot(forms, ahead, ["root"], "left"))
        forms = after.select("word", F.coalesce("next", "root").alias("root"))
        if after.where("next is not null").isEmpty():
            return forms
        forms = cut(forms)


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; see the module."""
    words = cut(vocabulary(docs))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    told = words.join(near, "word", "left").withColumn("best", F.when(-F.col("best.n") >= TIMES * F.col("n"), F.col("best")))
    told = cut(told.select("word", F.col("best.form").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.n")).alias("form_n")))
    last = roots(cut(told.where("form is not null").select("word", F.col("form").alias("root"))))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


#: The checksum byte by byte; near words by their texts without one letter.
ORACLE = r"""WITH RECURSIVE tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
 FROM range(256) r(i))),
s AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS (SELECT id, run, count(*) AS k FROM s WHERE length(run) >= 6 GROUP BY 1, 2),
y AS (SELECT run, k, flatten(list_transform(list_transform(string_split(id || ':' || run, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END)) AS bytes FROM u),
h AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INTEGER) + 1])), 4294967295) AS h FROM y, tbl),
v AS (SELECT k, CASE WHEN h % 199 = 0 THEN run[1 : CAST(h % length(run) AS INTEGER)] || run[CAST(h % length(run) AS INTEGER) + 2 :] ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
x AS (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word),
q AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM p GROUP BY 1),
f AS (SELECT p.word, min(near) AS form, min(near_n) AS form_n FROM p JOIN q ON q.word = p.word AND near_n = most JOIN w ON w.word = p.word WHERE most >= 5 * w.n GROUP BY 1),
r AS (SELECT word, word AS root, 0 AS steps FROM w UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON f.word = r.root),
z AS (SELECT word, arg_max(root, steps) AS root FROM r GROUP BY 1)
SELECT w.word, form, z.root, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n FROM w JOIN z ON z.word = w.word LEFT JOIN q ON q.word = w.word LEFT JOIN f ON f.word = w.word"""
