import random
import re
import time

from tidewell.llm import op1_line_dedup as op


def mask(line):
    return " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split())


def brute(rows):
    """The same tree, one document after another."""
    lines = []
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            m = mask(line)
            w = m.split(" ")
            if m and sum(x == "<*>" for x in w) * 2 <= len(w):
                lines.append((i, pos, m))
    leaves = {}
    for m in sorted({m for _, _, m in lines}):
        leaves.setdefault((m.count(" "), tuple(m.split(" ")[:3])), []).append(m)
    root = {}
    for ms in leaves.values():
        for m, r in zip(ms, op.parse_leaf(ms)):
            root[m] = ms[r]
    of = {}
    for i, pos, m in lines:
        of.setdefault(root[m], []).append((i, pos))
    gone = set()
    for m, at in of.items():
        least = 5 if m.count(" ") + 1 < 8 else 2
        if len({i for i, _ in at}) >= least:
            gone |= set(at) - {min(at)}
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone) for i, t in rows}


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = "the of and to thing réeux been order nr".split()
    pool = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 9, 20]))) for _ in range(25)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rnd.randrange(0, 6)):
            line = rnd.choice(pool).split(" ")
            if rnd.random() < 0.5 and len(line) > 8:
                line[rnd.randrange(3, len(line))] = rnd.choice(["x", "y7", "z 12"])
            lines.append(" ".join(line))
        lines += [" ".join(rnd.choice(vocabulary) + str(rnd.choice("abcdef")) * 3 for _ in range(12)), rnd.choice(["", "12 34 5"])]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_lines int").repartition(3)
    got = {r.doc_id: r.text for r in op.dedup(docs).collect()}
    assert got == brute(rows)


def test_templates_of_fields_and_edge_cases(spark):
    long = "Order {} was sent to the customer named {} on day {} of the month"
    rows = [(i, long.format(i, n, i * 3) + f"\nonly here {chr(97 + i) * 5} and nowhere else in the whole corpus") for i, n in enumerate(["Ann", "Bob", "Cy"])]
    rows += [(None, None), (7, ""), (8, "x" * 100_000), (9, "same\nshort\nlines"), (9, "same\nshort\nlines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.dedup(docs).collect()
    assert len(got) == len(rows)
    texts = {r.doc_id: r for r in got}
    assert texts[0].n_dropped == 0 and texts[1].n_dropped == 1 and texts[2].n_dropped == 1
    assert texts[1].text.startswith("only here") and texts[9].n_dropped == 0 and texts[None].text == ""
    assert op.dedup(docs.limit(0)).count() == 0


def test_a_hot_leaf_is_parsed_whole(spark, monkeypatch):
    """Blocks of three lines find what the whole leaf holds, also where variants sort far apart."""
    monkeypatch.setattr(op, "LEAF_LINES", 3)
    rnd = random.Random(5)
    words = "ab cd ef gh ij kl mn op qr st".split()
    rows = []
    for i in range(60):
        body = "we sell this {} in every shop of the town and {} by mail".format(rnd.choice(words), rnd.choice(words))
        noise = "we sell this " + " ".join(rnd.choice(words[:3]) for _ in range(11))
        rows.append((i, body + "\n" + noise))
    rows += [(100, "we sell this aaa nice red coat to all who come here soon please"), (101, "we sell this zzz nice red coat to all who come here soon please")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in op.dedup(docs).collect()}
    assert got == brute(rows)
    assert got[100] and not got[101]


def linked_brute(rows):
    """Templates by comparing every pair of lines, without the library's tree."""
    at = {}
    for i, t in rows:
        for pos, line in enumerate(t.split("\n")):
            m = mask(line)
            if m and m.split(" ").count("<*>") * 2 <= len(m.split(" ")):
                at.setdefault(m, []).append((i, pos))
    ms = sorted(at)
    root = list(range(len(ms)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ms)):
        for y in range(x):
            a, b = ms[x].split(" "), ms[y].split(" ")
            same = sum(t == u != "<*>" for t, u in zip(a, b))
            if len(a) == len(b) >= 8 and a[:3] == b[:3] and same * 10 >= 8 * len(a):
                root[find(x)] = find(y)
    of = {}
    for x, m in enumerate(ms):
        of.setdefault(find(x), []).extend(at[m])
    gone = set()
    for x, spots in of.items():
        if len({i for i, _ in spots}) >= (5 if len(ms[x].split(" ")) < 8 else 2):
            gone |= set(spots) - {min(spots)}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def test_any_partitioning_gives_the_result_of_all_pairs(spark):
    """One leaf, lines of eleven tokens that differ in three; also with columns that bear the operator's own names."""
    rnd = random.Random(4)
    rows = []
    for i in range(260):
        fixed = "note that this line has nine words which {} {}".split(" ")
        lines = []
        for _ in range(2):
            line = list(fixed)
            for k in (4, 7):
                line[k] = rnd.choice("abcdefgh") + "x"
            lines.append(" ".join(line).format(rnd.choice("pqrstuv"), rnd.choice("klmno")))
        rows.append((i, "\n".join([*lines, f"own {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}"])))
    want = linked_brute(rows)
    assert any(want[i] != t for i, t in rows)
    for n in (1, 4, 64):
        docs = spark.createDataFrame([(i, t, i, i, i) for i, t in rows], "doc_id long, text string, dropped int, gone_id int, gone_key int").repartition(n)
        got = op.dedup(docs).collect()
        assert {r.doc_id: r.text for r in got} == want
        assert all(r.dropped == r.gone_id == r.doc_id for r in got)


def test_columns_of_the_results_names_stay_and_many_lines_are_linear(spark):
    """A text of 60,000 lines, half of them recurring, takes seconds; the caller's counts are not touched."""
    shared = "\n".join(f"this very line recurs in both of the documents as number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} word" for i in range(400))
    many = "\n".join(f"{line}\n" for line in shared.split("\n") * 75)
    docs = spark.createDataFrame([(1, shared, 5, "x"), (2, many, 6, "y")], "doc_id long, text string, n_lines int, N_dropped string")
    began = time.time()
    got = {r.doc_id: r for r in op.dedup(docs).collect()}
    assert time.time() - began < 60
    assert (got[1].n_lines, got[1].N_dropped, got[2].n_lines, got[2].N_dropped) == (5, "x", 6, "y")
    n = len(many.split("\n"))
    assert got[2].n_lines_ == n == 60_000 and got[2].n_dropped_ == 30_000 and got[2].text == "\n" * 29_999
