"""Vectorised pre-tokenisation of byte-level BPE, without a regular expression.

Every code point gets a class; a finite automaton over the classes says where a token starts. Each
class acts on the automaton's states as a function, and functions compose associatively, so the state
before every code point of a whole batch comes from a doubling scan over the (small) monoid of
composed functions, held as one byte an element and combined by a table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

# What may follow an apostrophe in a contraction.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")

# Classes of code points. The first four come from the table, the others from a look at the neighbours.
LETTER, NUMBER, OTHER, SPACE, JOIN, LAST, SHORT, LONG, BREAK = range(9)
# States: what the token in progress is made of; FRESH: the next code point starts a token whatever it is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, JOINED, ONE_MORE, TWO_MORE = range(8)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Classes of all code points, as the library's own pattern engine has them (other Unicode tables are older or newer)."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], "<u4")
    text = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        # with a token a byte, the tokens are the bytes of what the pattern matches
        matched = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(matched.encode_ordinary(text)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return table


def _step(kind: int, state: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    if kind == BREAK:
        return FRESH, True
    if kind == LETTER and state in (ONE_MORE, TWO_MORE):
        return (FRESH if state == ONE_MORE else ONE_MORE), False
    if kind == JOIN:
        return JOINED, True
    if kind == LAST:
        return FRESH, True
    if kind in (SHORT, LONG) and state not in (IN_OTHER, JOINED):
        return (ONE_MORE if kind == SHORT else TWO_MORE), True
    inside = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, SPACE: IN_SPACE}.get(kind, IN_OTHER)
    return inside, state not in (inside, JOINED)


@lru_cache(1)
def monoid() -> tuple[bytes, bytes, bytes, np.ndarray]:
    """The products of the classes' functions: element by class, by pair (first * 16 + second), value at FRESH, constancy."""
    gens = [tuple(_step(k, s)[0] for s in range(8)) for k in range(9)]
    ids: dict[tuple, int] = {}
    todo = list(dict.fromkeys(gens))
    while todo:
        f = todo.pop()
        if f not in ids:
            ids[f] = len(ids)
            todo += [tuple(g[x] for x in f) for g in gens]
    fs = list(ids)
    assert len(fs) <= 16
    product = bytearray(256)
    for f in fs:
        for g in fs:
            product[ids[f] * 16 + ids[g]] = ids[tuple(g[x] for x in f)]
    pad = bytes(256 - len(fs))
    value = bytes(f[FRESH] for f in fs) + pad
    constant = np.array([len(set(f)) == 1 for f in fs] + [True] * (16 - len(fs)))
    return bytes(ids[g] for g in gens) + bytes(247), bytes(product), value, constant


@lru_cache(1)
def starts_table() -> bytes:
    """Whether a token starts, by class * 8 + state."""
    return bytes(_step(k, s)[1] for k in range(9) for s in range(8)) + bytes(184)


def _look_up(index: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(index.tobytes().translate(table), np.uint8)


def state_before(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before every code point: an inclusive doubling scan of composed functions."""
    of_class, product, value, constant = monoid()
    scan = _look_up(kinds, of_class).copy()
    width = 1
    while width < len(scan) and width <= 2:  # after two doublings nearly all functions are constant
        scan[width:] = _look_up(scan[:-width] << 4 | scan[width:], product)
        width *= 2
    open_ = np.flatnonzero(~constant[scan]) if len(scan) else scan
    table = np.frombuffer(product, np.uint8)
    while len(open_ := open_[open_ >= width]):
        scan[open_] = table[scan[open_ - width] << 4 | scan[open_]]
        open_ = open_[~constant[scan[open_]]]
        width *= 2
    before = np.empty(len(scan), np.uint8)
    before[:1], before[1:] = FRESH, _look_up(scan[:-1], value)
    return before


@lru_cache(1)
def narrow_table() -> bytes:
    return class_table()[:256].tobytes()


def classify(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Classes of code points (32 bits, or 8 where all are below 256); ``breaks`` marks the separators between texts."""
    kinds = _look_up(points, narrow_table()).copy() if points.dtype == np.uint8 else class_table()[points]
    kinds[breaks] = BREAK
    after = np.empty_like(kinds)
    after[:-1], after[-1:] = kinds[1:], BREAK
    spaces = kinds == SPACE
    ends = spaces & (after != SPACE) & (after != BREAK)
    blank = points == 0x20
    kinds[ends & blank] = JOIN
    kinds[ends & ~blank] = LAST
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        n = len(points)
        one = points[np.minimum(quotes + 1, n - 1)]
        two = points[np.minimum(quotes + 2, n - 1)]
        kinds[quotes[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        pairs = {(ord(a), ord(b)) for a, b in LONG_ENDINGS}
        both = np.zeros(len(quotes), bool)
        for a, b in pairs:
            both |= (one == a) & (two == b) & (quotes + 2 < n)
        kinds[quotes[both]] = LONG
    return kinds


def _starts(points: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token starts and separators among the code points of the texts, of which all but the last end in a separator."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    seps = np.cumsum(lengths[:-1] + 1) - 1
    kinds = classify(points, seps)
    return np.flatnonzero(_look_up(kinds << 3 | state_before(kinds), starts_table())), seps


def wide_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def token_starts(texts: list[str]) -> list[np.ndarray]:
    """For each text the code point offsets at which its tokens start, and its length at the end."""
    points = wide_points(texts)
    starts, seps = _starts(points, texts)
    firsts = np.concatenate([[0], seps + 1]).astype(np.int64)
    lasts = np.append(seps, len(points))
    # the separator after a text counts as a start: it is the text's end
    starts = np.append(starts, len(points))
    return [starts[np.searchsorted(starts, a) : np.searchsorted(starts, b) + 1] - a for a, b in zip(firsts, lasts)]


#: Surrogates stand in no text, so they can mark where tokens and texts begin.
TOKEN_MARK, TEXT_MARK = 0xD800, 0xD801


def blocks(texts: list[str], most: int = 4_000_000):
    """Blocks of about ``most`` code points: for each text of a block its list of pre-tokens."""
    block: list[str] = []
    held = 0
    for t in texts:
        block.append(t)
        held += len(t) + 1
        if held >= most:
            yield list(_slices(block))
            block, held = [], 0
    if block:
        yield list(_slices(block))


def slices(texts: list[str], most: int = 4_000_000):
    """For each text its list of pre-tokens."""
    for block in blocks(texts, most):
        yield from block


def coded(texts: list[str], most: int = 4_000_000):
    """For blocks of about ``most`` code points: which texts, how many pre-tokens each has, and their pre-tokens as numbers of
    a list of distinct ones. No pre-token but the distinct ones becomes a string."""
    block: list[int] = []
    held = 0
    for k, t in enumerate(texts):
        block.append(k)
        held += len(t) + 1
        if held >= most or k + 1 == len(texts):
            narrow = [_narrow(texts[i]) for i in block]
            for own, code in ((True, "latin-1"), (False, "utf-32-le")):
                which = [i for i, x in zip(block, narrow) if x == own]
                if which:
                    yield which, *_coded([texts[i] for i in which], code)
            block, held = [], 0


def _coded(texts: list[str], code: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    points = np.frombuffer("\x00".join(texts).encode(code, "surrogatepass"), np.uint8 if code == "latin-1" else np.uint32)
    starts, seps = _starts(points, texts)
    at_seps = np.searchsorted(starts, seps)
    ends = np.append(at_seps, len(starts))
    sizes = ends - np.append(0, at_seps + 1)
    offsets = (np.append(starts, len(points)) * points.itemsize).astype(np.int64)
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(points)])
    found = tokens.dictionary_encode()
    codes = np.delete(found.indices.to_numpy(), at_seps)
    return sizes, codes, [x.decode(code, "surrogatepass") for x in found.dictionary.to_pylist()]


def _marked(points: np.ndarray, texts: list[str], token: int, text: int) -> np.ndarray:
    """The code points with a mark before every token, and a mark for every separator."""
    starts, seps = _starts(points, texts)
    points = points.copy()
    points[seps] = text
    at_start = np.zeros(len(points), bool)
    at_start[starts] = True
    at_start[seps] = False
    starts = np.flatnonzero(at_start)
    out = np.empty(len(points) + len(starts), points.dtype)
    at = starts + np.arange(len(starts))
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at] = token
    out[rest] = points
    return out


def _narrow(text: str) -> bool:
    """Whether the text's code points fit a byte each and leave the marks free."""
    if "\x00" in text or "\x01" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _slices(texts: list[str]):
    narrow = [_narrow(t) for t in texts]
    few, many = [t for t, x in zip(texts, narrow) if x], [t for t, x in zip(texts, narrow) if not x]
    short = wide = iter(())
    if few:
        points = np.frombuffer("\x00".join(few).encode("latin-1"), np.uint8)
        short = iter(_marked(points, few, 1, 0).tobytes().decode("latin-1").split("\x00"))
    if many:
        marked = _marked(wide_points(many), many, TOKEN_MARK, TEXT_MARK)
        wide = iter(marked.tobytes().decode("utf-32-le", "surrogatepass").split(chr(TEXT_MARK)))
    token = chr(TOKEN_MARK)
    for x in narrow:
        t = next(short) if x else next(wide)
        yield t[1:].split("\x01" if x else token) if t else []
