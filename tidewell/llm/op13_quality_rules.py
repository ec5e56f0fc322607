"""Quality rules: a short-circuit cascade over whole texts (operator 13).

A rule rejects a text by some of its measures (counts over words, lines or characters). Measures are made when a rule first asks
for them and kept for the rules after it; a text leaves at the first rule that rejects it, so what later rules would measure is never made.
The order of the rules comes from a sample: the time that each measure takes and the texts that each rule rejects there. Next is
always the rule that rejects most of the sampled texts still left, for the time of the measures that are not made yet. The verdict is
the same in any order; only the time differs.

The order's sample is the first ``SAMPLE`` rows of the first partitions that hold so many, whole texts, measured where they are; at
most as many rows of small numbers reach the driver. Everything else is a map over documents: nothing is shuffled.

Rules: under 50 words; over half of the words in repeated 3-word windows; over one symbol of ``#*$%&|<>`` in ten words; mean word length under 3
or over 10; under 8 in 10 words with a letter (anything but ASCII digits and punctuation); over half of the lines repeat an earlier one; over
3 in 10 lines end with an ellipsis; over 9 in 10 lines start as list items. Words are runs of anything but the six ASCII white spaces, lines are those with a word.

Defined results: a null text is empty, has no words and is rejected; a text of any length is measured whole; repeated rows
are judged each; an empty table gives no rows, and its rules stand as listed; columns of the caller stay, and a measure whose name one bears
gets an underscore.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import fresh, table

NAME = "op13_quality_rules"
#: Rows on which costs and rejections are estimated.
SAMPLE = 500
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
NO_LETTERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".encode()
BULLETS = ("-", "*", "•", "●", "‣", "–")


def words(text: str) -> list[bytes]:
    """Runs of anything but the six ASCII white spaces, which are what splitting of bytes goes by."""
    return text.encode().split()


def lines(text: str) -> list[str]:
    return [line for line in text.split("\n") if line.strip(SPACES)]


def repeat_words(found: list[bytes]) -> int:
    """Words within 3-word windows that stand twice or more in the text."""
    if len(found) < 4:
        return 0
    codes: dict[bytes, int] = {}
    w = np.array([codes.setdefault(x, len(codes)) for x in found], np.int64)
    pairs = np.unique(w[:-1] * len(codes) + w[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * len(codes) + w[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[k : len(w) - 2 + k] |= again
    return int(covered.sum())


#: A measure: what it is made of (the text, or other measures) and how.
MEASURES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "words": (("text",), words),
    "lines": (("text",), lines),
    "n_words": (("words",), len),
    "word_chars": (("text",), lambda t: len(t) - sum(map(t.count, SPACES))),
    "n_symbols": (("text",), lambda t: sum(map(t.count, SYMBOLS))),
    "n_lines": (("lines",), len),
    "n_dup_lines": (("lines",), lambda found: len(found) - len(set(found))),
    "n_repeat_words": (("words",), repeat_words),
    "n_letter_words": (("words",), lambda found: sum(bool(w.strip(NO_LETTERS)) for w in found)),
    "n_ellipses": (("lines",), lambda found: sum(x.rstrip(SPACES).endswith(("...", "…")) for x in found)),
    "n_bullets": (("lines",), lambda found: sum(x.lstrip(SPACES).startswith(BULLETS) for x in found)),
}


@dataclass(frozen=True)
class Rule:
    """A text fails if ``fails`` holds for its measures ``of``."""

    name: str
    of: tuple[str, ...]
    fails: Callable[..., bool]


BASE = [
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repetition", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
]
RULES = [
    *BASE,
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: not 3 * n <= c <= 10 * n),
    Rule("letters", ("n_letter_words", "n_words"), lambda k, n: 10 * k < 8 * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("ellipses", ("n_ellipses", "n_lines"), lambda e, n: 10 * e > 3 * n),
    Rule("bullets", ("n_bullets", "n_lines"), lambda b, n: 10 * b > 9 * n),
]


class Measured:
    """A text's measures, each made once, when it is asked for; ``spent`` gathers the seconds by measure if given."""

    def __init__(self, text: str | None, spent: dict[str, float] | None = None):
        self.known = {"text": text or ""}
        self.spent = spent

    def __getitem__(self, name: str):
        if name not in self.known:
            sources, make = MEASURES[name]
            given = [self[s] for s in sources]
            began = time.perf_counter()
            self.known[name] = make(*given)
            if self.spent is not None:
                self.spent[name] = self.spent.get(name, 0.0) + time.perf_counter() - began
        return self.known[name]

    def fails(self, rule: Rule) -> bool:
        return rule.fails(*(self[m] for m in rule.of))


def needs(names: tuple[str, ...]) -> set[str]:
    """Measures that ``names`` come to, their sources included."""
    out: set[str] = set()
    for name in names:
        if name != "text":
            out |= {name} | needs(MEASURES[name][0])
    return out


def ordered(rules: list[Rule], cost: dict[str, float], failed: np.ndarray, made: set[str]) -> list[int]:
    """Rules by rejection per cost, one after another: ``failed`` has a row a sampled text and a column a rule; measures ``made`` cost nothing."""
    left, made, out = list(range(len(rules))), set(made), []
    alive = np.ones(len(failed), bool)
    while left:
        price = {i: sum(cost.get(m, 0.0) for m in needs(rules[i].of) - made) + 1e-9 for i in left}
        best = max(left, key=lambda i: (failed[alive, i].mean() / price[i] if alive.any() else 0.0, -price[i], -i))
        out.append(best)
        left.remove(best)
        made |= needs(rules[best].of)
        alive &= ~failed[:, best]
    return out


def plan(docs: DataFrame, rules: list[Rule] = RULES, asked: tuple[str, ...] = (), most: int = SAMPLE) -> list[Rule]:
    """The rules in the order in which a cascade takes them, from at most ``most`` rows of ``docs``; ``asked`` measures are made anyway."""
    names = sorted(set().union(*(needs(r.of) for r in rules))) if rules else []
    schema = "failed array<boolean>, spent array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = most
        for pdf in batches:
            rows = []
            for text in pdf["text"][:left]:
                m = Measured(text, {})
                rows.append(([m.fails(r) for r in rules], [m.spent.get(n, 0.0) for n in names]))
            yield pd.DataFrame(rows, columns=["failed", "spent"])
            left -= len(rows)
            if not left:
                return

    # Spark takes rows from one partition after another until it has enough: no text leaves its task, and few partitions are read
    got = docs.select("text").mapInPandas(run, schema).take(most) if rules else []
    if not got:
        return list(rules)
    cost = dict(zip(names, np.mean([r["spent"] for r in got], axis=0).tolist()))
    return [rules[i] for i in ordered(rules, cost, np.array([r["failed"] for r in got], bool), needs(asked))]


def judge(docs: DataFrame, rules: list[Rule] = RULES, asked: tuple[str, ...] = (), kept: str = "kept") -> DataFrame:
    """``docs`` with the ``asked`` measures (whole numbers) and ``kept``: whether no rule rejects the text."""
    cascade = plan(docs, rules, asked)
    schema = ", ".join([*(f"{m} bigint" for m in asked), "kept boolean"])

    @F.pandas_udf(schema)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                m = Measured(text)
                rows.append((*(m[a] for a in asked), not any(map(m.fails, cascade))))
            yield pd.DataFrame(rows, columns=[*asked, "kept"])

    into = fresh(docs, "judged")
    out = docs.withColumn(into, judged(F.col("text").cast("string")))
    for name, column in [*zip(asked, asked), ("kept", kept)]:
        out = out.withColumn(fresh(out, column), F.col(into)[name])
    return out.drop(into)


def clean(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, their columns as they were."""
    verdict = fresh(docs, "kept")
    return judge(docs, rules, (), verdict).where(verdict).drop(verdict)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = judge(docs, RULES, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d)),
g AS (SELECT r, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) > 1 AS again FROM g WHERE w2 IS NOT NULL),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM t WHERE again) GROUP BY 1),
l AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$') THEN 1 ELSE 0 END) AS dots,
 sum(CASE WHEN regexp_matches(line, '^[\x20\x09-\x0D]*[-*•●‣–]') THEN 1 ELSE 0 END) AS items
 FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
k AS (SELECT r, count(*) AS n, sum(length(w)) AS chars, sum(CASE WHEN regexp_matches(w, '[^!-@\[-`{-~]') THEN 1 ELSE 0 END) AS letters FROM w GROUP BY 1),
m AS (SELECT d.doc_id, coalesce(k.n, 0) AS n_words, coalesce(chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(letters, 0) AS letters, coalesce(l.n, 0) AS n_lines, coalesce(dots, 0) AS dots, coalesce(items, 0) AS items
 FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN c ON c.r = d.r LEFT JOIN l ON l.r = d.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * letters < 8 * n_words
 OR 2 * n_dup_lines > n_lines OR 10 * dots > 3 * n_lines OR 10 * items > 9 * n_lines) AS kept FROM m"""
