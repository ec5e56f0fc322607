"""Main text of web pages by equivalence classes of a host's template (operator 6).

A page's tokens are its element openings, told apart by the path of labels (name, classes, id) above them, and its
text blocks, told apart by path and text. Paths are held as hashes that grow down the tree, so a page costs time and
space in proportion to its length at any depth. Three steps, of which only the first and last read html:

1. Across the pages of a host, element tokens with the same occurrence vector are one equivalence class; a vector is
   held as an exclusive or of hashes of (page, count), which merges across parts, so a host of a third of all pages is
   many partial sums. A class is valid if it stands on enough pages and has several tokens or stands once a page.
   Valid classes nest by their paths; together they are the host's template. A layout that only some pages have makes
   classes of its own, as its tokens share the vector of just these pages. A text token on most of the different pages
   that have its path is template as well.
2. Every block lies in the slot of the innermost valid token around it (headings, paragraphs, lists and cells belong to
   the slot of what holds them). Slots are judged by their texts over all pages of the host: a slot within the article
   is main text unless it is one of a nested class whose text never changes; elsewhere a slot is main text if
   it is mostly unlinked and its text varies from page to page, or it holds much of the host's text.
3. A page's text is its blocks in main slots: those within its article where it has any, else the others.

Elements whose name or class says menu, header, footer, sidebar, notice, advert, form or comments are left out. Such a name counts
for nothing on html and body, and on an element that holds most of the (article's) unlinked text on most of its pages of the host.

Defined results: null or empty html gives empty text; a null url is a host of its own. A page none of whose
slots is main text gives its unlinked blocks outside those elements, less template texts. Comments, scripts and declarations leave
nothing behind, other skipped elements a blank. A ``<`` that opens no tag is text. Repeated rows are extracted each. Further
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import cut, join_hot, table

NAME = "op6_extraction"
#: Share of a host's pages on which a valid class stands at least; it bounds a host's template by the size of its pages.
SUPPORT = 0.05
#: Share of the different pages with a path on which a text belongs to the template.
ON_MOST = 0.6
#: Different pages from which a repeated text can belong to the template, and a text can be said to vary.
LEAST_PAGES = 4
#: Share of a host's text that makes a slot main text whether it varies or not.
MUCH = 0.2
#: Size of all templates up to which they are sent to every task.
BROADCAST_BYTES = 16 << 20

# Names of elements by what they do.
SKIPPED = ("script", "style", "noscript", "template", "svg", "title", "iframe", "object", "canvas", "select", "textarea", "button")
BLOCKS = (
    "html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "p", "h1", "h2", "h3", "h4", "h5", "h6",
    "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure",
    "figcaption", "address", "fieldset", "details", "summary", "hr", "dialog", "menu",
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
PARAGRAPH = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
AROUND = re.compile(r"^(nav|footer|header|aside|form|menu|dialog|fieldset)([.#]|$)")
AROUND_CLASS = re.compile(
    r"[.#]([^>]*[.#_-])?(ad|ads|advert|adverts|advertisement|banner|promo|sponsor|sponsored|cookie|cookies|consent|notice|alert|comment|comments|reply|"
    r"replies|respond|sidebar|menu|nav|navbar|navigation|footer|header|breadcrumb|breadcrumbs|share|social|related|subscribe|newsletter|signup|login|"
    r"popup|modal|widget|toolbar|pager|pagination)s?([.#_-]|$)"
)
LEAF = re.compile(r"^(p|h[1-6]|ul|ol|li|dl|dt|dd|blockquote|pre|table|tbody|thead|tfoot|tr|td|th)([.#]|$)")
MAIN = re.compile(r"^(article|main)([.#]|$)")
PAGE_ITSELF = re.compile(r"^(html|body)([.#]|$)")

# What a tag may hold: no quantifier gives back what it took, and none crosses another tag, so scans stay linear.
INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
DROP = re.compile(rf"<!--|<({'|'.join(SKIPPED)})\b{INSIDE}>|<[!?][^<>]*+>", re.I)
CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED}
BLOCK_START = re.compile(rf"<(?:{'|'.join(BLOCKS)})\b", re.I)
PIECE = re.compile(rf"<(/?)([a-zA-Z][\w:-]*+)({INSIDE})>|([^<]+|<)")
HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
CLASS = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
DIGITS = re.compile(r"\d+")
_blocks = frozenset(BLOCKS)
#: What an element's label says: a leaf of the text, around the text, the article.
IS_LEAF, IS_AROUND, IS_MAIN = 1, 2, 4


@lru_cache(1 << 16)
def kind_of(label: str) -> int:
    around = not PAGE_ITSELF.search(label) and (AROUND.search(label) or AROUND_CLASS.search(label))
    return IS_LEAF * bool(LEAF.search(label)) + IS_AROUND * bool(around) + IS_MAIN * bool(MAIN.search(label))


def label(name: str, attributes: str) -> str:
    if "=" not in attributes:
        return name
    out = name
    for kind, *values in CLASS.findall(attributes):
        value = DIGITS.sub("0", next((v for v in values if v), "")).lower()
        out += "".join(("." if kind.lower() == "class" else "#") + w.replace(">", "") for w in value.split())
    return out


def without_skipped(page: str) -> str:
    """The page less comments, declarations and skipped elements. Scripts and styles without an end tag go on to the
    page's end, other skipped elements to the next block element."""
    out, at = [], 0
    absent: set[str] = set()
    while m := DROP.search(page, at):
        out.append(page[at : m.start()])
        name = (m[1] or "").lower()
        if not name:
            at = m.end()
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
            continue
        close = None if name in absent else CLOSES[name].search(page, m.end())
        if close:
            at = close.end()
        else:
            absent.add(name)  # nor is there one further on
            block = None if name in ("script", "style") else BLOCK_START.search(page, m.end())
            at = block.start() if block else len(page)
        if name not in ("script", "style", "template", "noscript"):
            out.append(" ")
    out.append(page[at:])
    return "".join(out)


class Page(NamedTuple):
    """Element tokens (key, number of the token around it, count, kind), the page itself first and outer ones before inner
    ones, and blocks (token, text, linked characters) in page order."""

    keys: list[int]
    parents: list[int]
    counts: list[int]
    kinds: list[int]
    blocks: list[tuple[int, str, int]]


def parse(page: str) -> Page:
    keys, parents, counts, kinds = [0], [-1], [1], [0]
    number: dict[int, int] = {0: 0}
    names: list[str] = []
    open_: Counter = Counter()
    nodes: list[int] = [0]
    text: list[str] = []
    # a link goes on to its end tag, or to the end of the element in which it began
    linked, in_link, link_in = 0, False, 0
    blocks: list[tuple[int, str, int]] = []

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                blocks.append((nodes[-1], whole, linked))
            text.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal in_link
        while names:
            nodes.pop()
            last = names.pop()
            open_[last] -= 1
            if last == name:
                break
        in_link = in_link and len(names) >= link_in

    for end, name, attributes, run in PIECE.findall(without_skipped(page)):
        if run:
            text.append(run)
            if in_link:
                linked += len(run)
            continue
        name = name.lower()
        if name == "a":
            in_link, link_in = not end and bool(HREF.search(attributes)), len(names)
        if name == "br":
            text.append(" ")
        if name not in _blocks:
            continue
        flush()
        if end:
            if open_[name]:
                close(name)
            continue
        while names and (names[-1] in PARAGRAPH or names[-1] in SIBLINGS.get(name, ())):
            close(names[-1])
        if name == "hr":
            continue
        own = label(name, attributes)
        key = xxhash.xxh64_intdigest(own, seed=keys[nodes[-1]]) >> 2
        node = number.get(key)
        if node is None:
            node = number[key] = len(keys)
            keys.append(key)
            parents.append(nodes[-1])
            counts.append(0)
            kinds.append(kind_of(own))
        counts[node] += 1
        names.append(name)
        open_[name] += 1
        nodes.append(node)
    flush()
    return Page(keys, parents, counts, kinds, blocks)


def within(parents: list[int], own: list[bool]) -> list[bool]:
    """Whether a token or one around it is ``own``."""
    out: list[bool] = []
    for p, x in zip(parents, own):
        out.append(x or (p >= 0 and out[p]))
    return out


def wrappers(parents: list[int], kinds: list[int], blocks: list[tuple[int, int, int]]) -> list[bool]:
    """For each token whether it holds over half of the page's unlinked text: of that in the article, if there is any."""
    main = within(parents, [bool(k & IS_MAIN) for k in kinds])
    free = [(n, max(chars - linked, 0)) for n, chars, linked in blocks]
    free = [b for b in free if main[b[0]] and b[1]] or free
    held = [0] * len(parents)
    for n, chars in free:
        held[n] += chars
    for n in range(len(parents) - 1, 0, -1):
        held[parents[n]] += held[n]
    return [2 * h > held[0] for h in held]


class Place(NamedTuple):
    """Where a block lies: its slot (the key of the slot's token times two, one more within the article), whether an element
    around the text encloses it, and whether the slot is nested within the article."""

    slot: int
    around: bool
    nested: bool


def places(keys: list[int], parents: list[int], kinds: list[int], members: set[int], wide: set[int]) -> list[Place]:
    """The place of the blocks of each token."""
    main = within(parents, [bool(k & IS_MAIN) for k in kinds])
    around = within(parents, [bool(k & IS_AROUND) and key not in wide for k, key in zip(kinds, keys)])
    near: list[int] = []
    slots: list[int] = []
    for n, (key, p, kind) in enumerate(zip(keys, parents, kinds)):
        near.append(n if key in members or p < 0 else near[p])
        # a leaf's slot is that of what holds it
        slots.append((slots[p] if kind & IS_LEAF and p >= 0 else n) if near[n] == n else slots[near[n]])
    return [Place(keys[s] * 2 + m, a, m and main[s] and not kinds[s] & IS_MAIN) for s, m, a in zip(slots, main, around)]


def mark_of(key: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{key} {text}") >> 1


def with_host(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]+)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def parsed(pages: DataFrame) -> DataFrame:
    """A row a page: host, psig (hash of its texts), its tokens, and of its blocks token, mark, length and linked characters."""

    def run(batches):
        for pdf in batches:
            rows = []
            for page in pdf["html"]:
                keys, parents, counts, kinds, blocks = parse(page)
                sizes = [(n, len(t), linked) for n, t, linked in blocks]
                wide = wrappers(parents, kinds, sizes) if any(k & IS_AROUND for k in kinds) else [False] * len(keys)
                psig = xxhash.xxh64_intdigest("\n".join(b[1] for b in blocks)) >> 1
                marks = [mark_of(keys[n], t) for n, t, _ in blocks]
                rows.append((psig, keys, parents, counts, kinds, wide, *([b[i] for b in sizes] for i in (0, 1, 2)), marks))
            out = pd.DataFrame(rows, columns=["psig", "keys", "parents", "counts", "kinds", "wide", "nodes", "chars", "links", "marks"])
            out["host"] = pdf["host"].to_numpy()
            yield out

    schema = (
        "psig long, keys array<long>, parents array<int>, counts array<long>, kinds array<int>, wide array<boolean>, nodes array<int>, "
        "chars array<long>, links array<long>, marks array<long>, host string"
    )
    return with_host(pages).select("host", "html").mapInPandas(run, schema)


def valid_classes(found: DataFrame) -> DataFrame:
    """host, members: the keys of the valid equivalence classes of each host."""
    sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    tokens = found.select("host", "rid", F.explode(F.arrays_zip("keys", "counts")).alias("t")).select("host", "rid", "t.keys", "t.counts")
    vectors = tokens.groupBy("host", "keys").agg(
        F.bit_xor(F.xxhash64("rid", "counts")).alias("vector"), F.count(F.lit(1)).alias("on"), F.max("counts").alias("most")
    )
    classes = vectors.groupBy("host", "vector", "on").agg(F.max("most").alias("most"), F.collect_set("keys").alias("members"))
    classes = classes.join(sizes, "host").where((F.col("on") >= SUPPORT * F.col("pages")) & (F.col("on") >= F.least(F.lit(2), "pages")))
    return classes.where((F.col("most") == 1) | (F.size("members") > 1)).groupBy("host").agg(F.flatten(F.collect_list("members")).alias("members"))


def wide_wrappers(found: DataFrame) -> DataFrame:
    """host, wide: keys named as around the text that hold most of it on most of their pages."""
    on = found.select("host", F.explode(F.arrays_zip("keys", "kinds", "wide")).alias("w")).where(F.col("w.kinds").bitwiseAND(IS_AROUND) > 0)
    most = on.groupBy("host", F.col("w.keys").alias("key")).agg(F.count_if("w.wide").alias("wide"), F.count(F.lit(1)).alias("pages"))
    return most.where("2 * wide > pages").groupBy("host").agg(F.collect_set("key").alias("wide"))


def constant_texts(found: DataFrame) -> DataFrame:
    """host, constant: marks of texts on most of the different pages that have their path."""
    of_block = F.transform("nodes", lambda n: F.get("keys", n))
    texts = found.select("host", "psig", F.explode(F.arrays_zip(of_block.alias("key"), F.col("marks").alias("mark"))).alias("b"))
    texts = texts.select("host", "psig", "b.key", "b.mark").distinct()
    different = texts.select("host", "key", "psig").distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("different"))
    on = texts.groupBy("host", "key", "mark").agg(F.count(F.lit(1)).alias("on")).where(f"on >= {ON_MOST * LEAST_PAGES}")
    # a path of a hot host may have most of all texts
    met = join_hot(cut(on), cut(different.where(f"different >= {LEAST_PAGES}")), ["host", "key"])
    return met.where(F.col("on") >= ON_MOST * F.col("different")).groupBy("host").agg(F.collect_set("mark").alias("constant"))


def met_by_host(df: DataFrame, of_host: DataFrame) -> DataFrame:
    """``df`` with what is known of its hosts: sent to every task up to a checked size, met by a join beyond it."""
    size = of_host.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return df.join(F.broadcast(of_host) if size <= BROADCAST_BYTES else of_host, "host", "left")


def as_set(values) -> set[int]:
    return set() if values is None else set(values.tolist())


def slots_of(found: DataFrame, of_host: DataFrame) -> DataFrame:
    """host, slot, nested, chars, linked, sig (of the slot's texts), psig: a row for each slot of each page, around ones left out."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                where = places(r.keys.tolist(), r.parents.tolist(), r.kinds.tolist(), as_set(r.members), as_set(r.wides))
                of: dict[int, list] = {}
                for n, mark, chars, linked in zip(r.nodes.tolist(), r.marks.tolist(), r.chars.tolist(), r.links.tolist()):
                    if not where[n].around:
                        slot = of.setdefault(where[n].slot, [where[n].nested, 0, 0, 0])
                        slot[1] += chars
                        slot[2] += linked
                        slot[3] ^= mark
                rows += [(r.host, slot, *x, r.psig) for slot, x in of.items()]
            yield pd.DataFrame(rows, columns=["host", "slot", "nested", "chars", "linked", "sig", "psig"])

    d = met_by_host(found.drop("rid", "counts", "wide"), of_host.withColumnRenamed("wide", "wides"))
    return d.mapInPandas(run, "host string, slot long, nested boolean, chars long, linked long, sig long, psig long")


def main_slots(slots: DataFrame) -> DataFrame:
    """host, keep: the slots that hold main text."""
    sums = [F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("nested").alias("nested")]
    by_page = slots.groupBy("host", "slot", "sig", "psig").agg(*sums)
    by_text = by_page.groupBy("host", "slot", "sig").agg(*sums, F.count(F.lit(1)).alias("different"))
    stats = by_text.groupBy("host", "slot").agg(*sums, F.sum("different").alias("different"), F.count(F.lit(1)).alias("texts"))
    rest = stats.where("slot % 2 = 0").groupBy("host").agg(F.sum("chars").alias("all_chars"))
    seen = F.col("different") >= LEAST_PAGES
    in_article = ~(F.col("nested") & seen & (F.col("texts") == 1))
    varies = seen & (2 * F.col("texts") >= F.col("different"))
    elsewhere = (2 * F.col("linked") < F.col("chars")) & (varies | (F.col("chars") >= MUCH * F.col("all_chars")))
    good = F.when(F.col("slot") % 2 == 1, in_article).otherwise(elsewhere)
    return stats.join(rest, "host", "left").where(good).groupBy("host").agg(F.collect_set("slot").alias("keep"))


def templates(pages: DataFrame) -> DataFrame:
    """host, members, wide, constant, keep: what the pages of each host have in common. No text is moved for it."""
    found = cut(parsed(pages).withColumn("rid", F.monotonically_increasing_id()))
    of_host = cut(valid_classes(found).join(wide_wrappers(found), "host", "full"))
    keep = main_slots(slots_of(found, of_host))
    return cut(of_host.join(keep, "host", "full").join(constant_texts(found), "host", "full"))


def main_text(page: str, members: set[int], wide: set[int], keep: set[int], constant: set[int]) -> str:
    keys, parents, _, kinds, blocks = parse(page)
    where = places(keys, parents, kinds, members, wide)
    article, elsewhere, rest = [], [], []
    for n, text, linked in blocks:
        at = where[n]
        if at.around:
            continue
        same = bool(constant) and mark_of(keys[n], text) in constant
        if at.slot % 2:
            # what is repeated within the article is its own if it is a paragraph, a heading or an item
            if at.slot in keep and not (same and not kinds[n] & IS_LEAF):
                article.append(text)
        elif at.slot in keep and not same:
            elsewhere.append(text)
        if not same and 2 * linked < len(text):
            rest.append(text)
    return "\n".join(article or elsewhere or rest)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    d = met_by_host(with_host(pages), templates(pages))

    def run(batches):
        for pdf in batches:
            sets: dict[str, list[set[int]]] = {}
            texts = []
            for r in pdf.itertuples():
                if r.host not in sets:
                    sets[r.host] = [as_set(x) for x in (r.members, r.wide, r.keep, r.constant)]
                texts.append(main_text(r.html, *sets[r.host]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts})

    found = d.mapInPandas(run, "page_id string, url string, text string")
    return found.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
