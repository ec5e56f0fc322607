import hashlib
import random

import public_tokenizers
import regex
import tiktoken

from tidewell.llm import op7_bpe, pretok

PATTERN = regex.compile(public_tokenizers.PATTERN)


def _ranks():
    with open(public_tokenizers.path(op7_bpe.RANKS), "rb") as f:
        return f.read()


def _texts(n=400):
    rnd = random.Random(7)
    alphabet = list("abst'  \n\t!?,.09éñß漢字'smdrevl 　²٣\x00🙂")
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60))) for _ in range(n)]


def test_pretokens_equal_the_pattern():
    texts = _texts() + ["", "   ", "a  b", "it's we'll 'sun !'s ''s 's's", " 's", "x\n\n y ", "don't'"]
    assert list(pretok.slices(texts, most=500)) == [PATTERN.findall(t) for t in texts]


def test_ids_equal_the_library():
    ranks = op7_bpe.load_ranks(_ranks())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = op7_bpe.Encoder(ranks, entries=50)
    for t in _texts() + ["ab" * 400, "<|endoftext|>", "x" * 1500]:
        ids, spans = ours.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()
        assert [t.encode()[a:b] for a, b in spans] == [ours.vocabulary[i] for i in ids]


def test_merging_together_equals_merging_alone():
    ranks = op7_bpe.load_ranks(_ranks())
    pieces = [p for ps in pretok.slices(_texts() + ["thhhenderwhsttion réeuxouan aaaaaaaa"] * 2) for p in ps]
    ours = op7_bpe.Encoder(ranks)
    ours.learn([pieces])
    assert all(list(ours[p][0]) == op7_bpe.merge(p.encode(), ranks) for p in pieces)
    assert op7_bpe._merge_long([bytes([b]) for b in b"thender" * 60], ranks) == op7_bpe.PairTable(ranks).merge([b"thender" * 60])[0]


def test_query_handles_nulls_and_extra_columns(spark):
    rows = [(1, "it's  fine", 5), (1, "it's  fine", 5), (None, None, 0), (2, "", 1), (3, "é" * 3000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens): r for r in op7_bpe.roundtrip(docs, _ranks()).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[None, 0].ids_sha256 == got[2, 0].ids_sha256 == got[2, 0].decoded_sha256 == empty
    assert next(r for k, r in got.items() if k[0] == 3).decoded_sha256 == hashlib.sha256(("é" * 3000).encode()).hexdigest()
    assert op7_bpe.roundtrip(docs.limit(0), _ranks()).count() == 0


def test_ids_equal_the_library_for_every_kind_of_code_point():
    """Letters and numbers newer than Python's own table, marks and unassigned ones among them."""
    ranks = op7_bpe.load_ranks(_ranks())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = op7_bpe.Encoder(ranks, entries=50)
    rnd = random.Random(9)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 4000):
        text = "".join(x for c in points[start : start + 4000] for x in (chr(c), rnd.choice(["", "", "a", " ", "1", "!", "'s"])))
        assert ours.encode(text)[0] == enc.encode_ordinary(text)
    assert ours.encode("a\U00013567b c࢏ \U00011de1x")[0] == enc.encode_ordinary("a\U00013567b c࢏ \U00011de1x")


def test_a_very_long_text():
    ranks = op7_bpe.load_ranks(_ranks())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = " ".join(f"word{i % 977} 漢字{i}" for i in range(120_000))
    ids, _ = op7_bpe.Encoder(ranks, entries=5_000).encode(text)
    assert ids == enc.encode_ordinary(text)
