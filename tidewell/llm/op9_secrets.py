"""Secret scan by a battery of randomness tests (operator 9), in DataFrame functions only.

Base spans follow three fixed patterns. The method adds spans of kind ``random``: maximal runs of
key-like characters, at least ``MIN_RUN`` long, outside the base spans. For each run

* the encoding is inferred (hexadecimal, base 32, base 36, base 62, base 64, letters of both cases or of one) from the
  characters present. Digits alone, and letters with signs but without digits, are numbers and names: they are not tested;
* the battery asks whether the run could be uniform over that alphabet: a chi-squared test of the
  character counts, a runs test about the alphabet's middle and a test of the correlation of neighbours.
  Their chances are combined by Fisher's method; a run whose combined chance is under ``REJECT`` is no secret;
* its chance under ordinary writing comes from the lower tail of the number of coinciding character pairs (of which
  chi-squared is a function) at the coincidence rate of prose, and the upper tail of the number of runs of one
  character class, combined in the same way (letters of one case have the first only). The first number grows with the square of the length, the second with
  the length, so a short run needs a clearer case than a long one. Divided by the battery's combined
  chance, it is the run's chance in the next step: what is doubtful as random must be the less likely as prose;
* the Benjamini-Hochberg step over these chances of all runs of the corpus, from a histogram with a fixed
  number of bins, bounds the share of false discoveries.

Defined results: a null text counts as empty; an empty text has no spans. Repeated rows are scanned each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.arrays import chunked, indices, let, meets, pieces_of, prefix_max, prefix_sums, total
from tidewell.llm.shared import cut, table

NAME = "op9_secrets"
# The patterns of the base spans, and the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "random"]

MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Combined chance at which the battery rejects uniformity.
REJECT = 0.001
#: The share of false discoveries that is allowed.
FALSE_SHARE = 0.05
#: Coincidence rate of prose: the chance that two of its letters are the same.
PROSE = 0.065
#: The chance that a character of an ordinary name or number is of another class (lower, upper, digit, other) than the one before.
CHANGES = 0.35
BINS = 600
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Start, end and the length of a group for each leftmost non-overlapping match; matches are never empty."""

    def located(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g.cast("long") + F.length(m))
        held = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
        return let(
            prefix_sums(steps),
            lambda before: F.transform(
                F.arrays_zip(before.alias("b"), steps.alias("s"), found.alias("m"), held.alias("g")),
                lambda x: F.struct(
                    (x["b"] + x["s"] - F.length(x["m"])).alias("start"),
                    (x["b"] + x["s"]).alias("end"),
                    F.length(x["g"]).alias("held"),
                ),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), located)


def spans_of(text: Column, kind: str, pattern: str, quick: Column, group: int | None = None) -> Column:
    """Spans of one kind; ``quick`` is a cheap condition without which there are none."""
    order = KINDS.index(kind)
    least = LEAST.get(kind, MIN_RUN)
    found = F.transform(
        F.filter(matches(text, pattern, group), lambda x: x["held"] >= least),
        lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end")),
    )
    return F.when(quick, found).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def log_tail(z: Column) -> Column:
    """Log of the chance of a standard normal value above ``z``; the chance is within 0.3 % at any ``z`` (Boerjesson and Sundberg)."""

    def with_size(x: Column) -> Column:
        upper = -x * x / 2 - F.log((0.661 * x + 0.339 * F.sqrt(x * x + 5.51)) * math.sqrt(2 * math.pi))
        return upper

    return let(z, lambda x: let(with_size(F.abs(x)), lambda upper: F.when(x >= 0, upper).otherwise(F.log1p(-F.exp(upper)))))


def two_sided(z: Column) -> Column:
    return F.least(F.lit(0.0), log_tail(F.abs(z)) + math.log(2))


def fisher(*logs: Column) -> Column:
    """Log of the combined chance of independent tests: a chi-squared value of two degrees of freedom for each."""
    h = -sum(logs[1:], logs[0])
    terms = lambda x: sum((F.pow(x, k) / math.factorial(k) for k in range(1, len(logs))), F.lit(1.0))
    return let(h, lambda x: F.log(terms(x)) - x)


def battery(run: Column) -> Column:
    """size of the inferred alphabet (0: none), log of the combined chance of chi-squared, runs and serial tests, log chance as prose."""

    def with_chars(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        has = lambda p: run.rlike(p)
        size = (
            F.when(~has("[^A-Za-z]"), F.when(has("[a-z]") & has("[A-Z]"), 52).otherwise(26))
            .when(~has("[0-9]") | ~has("[A-Za-z]"), 0)
            .when(~has("[^0-9a-f]") | ~has("[^0-9A-F]"), 16)
            .when(~has("[^A-Z2-7=]"), 32)
            .when(~has("[^a-z0-9]") | ~has("[^A-Z0-9]"), 36)
            .when(~has("[^A-Za-z0-9]") & has("[a-z]") & has("[A-Z]"), 62)
            .when(has("[a-z]") & has("[A-Z]"), 64)
            .otherwise(0)
        )
        squares = total(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.length(F.replace(run, c, F.lit(""))), 2).cast("long")))

        def with_codes(codes: Column) -> Column:
            middle = total(codes) / n
            high = F.transform(codes, lambda c: (c > middle).cast("int"))
            n1 = total(high).cast("double")
            n2 = n - n1
            changes = 1 + total(F.zip_with(F.slice(high, 2, F.size(high) - 1), F.slice(high, 1, F.size(high) - 1), lambda a, b: F.abs(a - b)))
            mean_runs = 1 + 2 * n1 * n2 / n
            var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9))
            z_runs = F.abs(changes - mean_runs) / F.sqrt(var_runs)
            dev = F.transform(codes, lambda c: c - middle)
            power = F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x)
            cross = F.aggregate(
                F.zip_with(F.slice(dev, 2, F.size(dev) - 1), F.slice(dev, 1, F.size(dev) - 1), lambda a, b: a * b),
                F.lit(0.0),
                lambda a, x: a + x,
            )
            z_serial = F.abs(cross / F.greatest(power, F.lit(1e-9)) * F.sqrt(n) + 1 / F.sqrt(n))
            return F.struct(
                F.when((n1 == 0) | (n2 == 0), -100.0).otherwise(two_sided(z_runs)).alias("runs"),
                two_sided(z_serial).alias("serial"),
            )

        def with_squares(sq: Column) -> Column:
            k = F.greatest(size, F.lit(2)).cast("double")
            chi = sq * k / n - n
            df = k - 1
            # Wilson and Hilferty: the cube root of a chi-squared value is nearly normal
            z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            pairs = (sq - n) / 2
            expected = n * (n - 1) / 2 * PROSE
            # pairs of one string hang together, so their variance is above Poisson's: twice the mean
            kinds = F.transform(chars, lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3))
            changed = lambda k: total(F.zip_with(F.slice(k, 2, F.size(k) - 1), F.slice(k, 1, F.size(k) - 1), lambda a, b: (a != b).cast("long")))
            z_changes = (let(kinds, changed) - (n - 1) * CHANGES - 0.5) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
            both = F.struct(log_tail((expected - pairs - 0.5) / F.sqrt(2 * expected)).alias("a"), log_tail(z_changes).alias("b"))
            log_prose = let(both, lambda x: F.when(size == 26, x["a"]).otherwise(fisher(x["a"], x["b"])))
            # all of prose in sixteen characters is improbable in itself: three letters in ten are a to f. The better of two chances counts twice
            letters = F.length(F.regexp_replace(run, "[0-9]", ""))
            log_prose = F.when(size == 16, math.log(2) + F.least(log_prose, letters * math.log(0.3))).otherwise(log_prose)
            codes = F.transform(chars, lambda c: F.instr(F.lit(LETTERS), c))
            uniform = let(codes, lambda c: let(with_codes(c), lambda t: fisher(log_tail(z_chi), t["runs"], t["serial"])))
            return let(
                F.struct(uniform.alias("u"), log_prose.alias("p")),
                lambda x: F.struct(size.alias("size"), x["u"].alias("log_uniform"), F.least(F.lit(0.0), x["p"] - x["u"]).alias("log_chance")),
            )

        return let(squares.cast("double"), with_squares)

    return let(F.split(run, ""), with_chars)


def scan(docs: DataFrame, carried: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """row (the ``carried`` columns), base (spans), tested (runs) of every text; by default the text goes no further."""
    text = F.col("text")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    assign = spans_of(text, "assign", ASSIGN, text.rlike(ASSIGN), 2)
    access = spans_of(text, "access", ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = spans_of(text, "hex", "[0-9a-f]{24,}", text.rlike("[0-9a-f]{24}"))
    runs = spans_of(text, "random", RUN, text.rlike(RUN))
    d = d.withColumns({"base_a": assign, "base_b": access, "base_c": hexes, "runs": runs})
    d = d.withColumn("base", F.array_sort(F.concat("base_a", "base_b", "base_c")))
    free = let(chunked(F.col("base")), lambda c: F.filter("runs", lambda r: ~meets(c, r)))
    joined = lambda f: F.zip_with(f, pieces_of(text, f), lambda r, p: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"), battery(p).alias("t")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,t:struct<size:int,log_uniform:double,log_chance:double>>>")
    return d.select("row", "base", F.when(F.size("runs") > 0, let(free, joined)).otherwise(none).alias("tested"))


def passes(t: Column) -> Column:
    """Whether the battery leaves uniformity standing over a known alphabet."""
    return (t["size"] > 0) & (t["log_uniform"] > math.log(REJECT))


def discovery_limit(scanned: DataFrame, false_share: float = FALSE_SHARE) -> float:
    """The largest log chance that Benjamini and Hochberg's step accepts (minus infinity: none)."""
    runs = scanned.select(F.explode("tested").alias("x")).where("x.t.size > 0")  # without an alphabet there is no test
    bins = (
        runs.select(F.when(passes(F.col("x.t")), F.least(F.floor(-F.col("x.t.log_chance") * 4), F.lit(BINS - 1))).otherwise(-1).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most BINS + 1 rows
    )
    n = sum(r["n"] for r in bins)
    found, limit = 0, -math.inf
    for r in sorted((r for r in bins if r["bin"] >= 0), key=lambda r: -r["bin"]):
        found += r["n"]
        upper = -r["bin"] / 4  # the bin's largest log chance
        if math.exp(upper) * n <= false_share * found:
            limit = upper
    return limit


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row."""
    scanned = cut(scan(docs))
    limit = discovery_limit(scanned)
    kept = F.filter("tested", lambda r: passes(r["t"]) & (r["t"]["log_chance"] <= F.lit(limit)))
    plain = F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "row.doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.size(plain).cast("long").alias("n_random"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat(F.col("base"), plain))).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans are one."""
    scanned = cut(scan(docs, docs.columns))
    limit = discovery_limit(scanned)
    found = F.filter("tested", lambda r: passes(r["t"]) & (r["t"]["log_chance"] <= F.lit(limit)))
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    spans = F.array_sort(F.concat(F.transform("base", lambda s: span(s["start"], s["end"])), F.transform(found, lambda s: span(s["start"], s["end"]))))

    def merged(s: Column) -> Column:
        """Spans that overlap or touch as one: a span starts anew where all before it end earlier."""
        ends = F.transform(s, lambda x: x["end"])

        def with_earlier(m: Column) -> Column:
            heads = F.filter(indices(F.size(s)), lambda i: m[i] < s[i]["start"])
            last = lambda h, j: F.coalesce(F.get(m, F.get(h, j + 1)), F.array_max(ends))
            return let(heads, lambda h: F.transform(h, lambda i, j: span(s[i]["start"], last(h, j))))

        return let(prefix_max(F.transform(ends, lambda e: e.cast("long"))), with_earlier)

    text = F.coalesce("row.text", F.lit(""))

    def rebuilt(m: Column) -> Column:
        gaps = F.transform(m, lambda s, i: span(F.coalesce(F.get(m, i - 1)["end"], F.lit(0)), s["start"]))
        rest = F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text))
        return F.array_join(F.concat(pieces_of(text, gaps), F.array(rest)), mark)

    new = F.when((F.size("base") == 0) & (F.size(found) == 0), text).otherwise(let(let(spans, merged), rebuilt))
    return scanned.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
