import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_return_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == columns, name
            assert 0 < after.count() <= before.count()


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = {r.doc_id for r in stages["toxicity"][1].select("doc_id").collect()}
    t = [(r.doc_id in left, r.toxic) for r in labels.collect()]
    assert sum(k for k, x in t if not x) / sum(1 for _, x in t if not x) > 0.97
    assert sum(k for k, x in t if x) / sum(1 for _, x in t if x) < 0.4


def test_near_copies_leave_one_of_each_class(stages):
    from test_op8 import brute

    before, after = stages["near_copies"]
    rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
    _, root = brute(rows)
    assert {r.doc_id for r in after.select("doc_id").collect()} == {rows[k][0] for k in root}


def test_secrets_are_marked(stages):
    before, after = stages["secrets"]
    assert before.count() == after.count()
    left = [r.text for r in after.collect()]
    assert not any(re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t) for t in left)
    assert any("[secret]" in t for t in left)
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        parts = r.text.split("[secret]")
        assert re.fullmatch(".+".join(map(re.escape, parts)), old[r.doc_id], re.S)
        assert r.n_chars == len(r.text)


def test_packing_holds_every_document(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in before.select("doc_id").collect()} == {r.doc_id for r in after.select("doc_id").collect()}


def test_nulls_repeats_and_columns_of_the_stages_own_names(spark, tmp_path):
    import corpus_pipeline

    names = ["n_lines", "n_dropped", "dropped", "gone_id", "tkey", "base", "tested", "score", "unit", "label"]
    long = "one fine day the whole town went down to the river to see the new boats come in from the far north"
    rows = [(1, long, "en"), (1, long, "en"), (2, long, None), (3, None, "en"), (4, "", "en"), (None, "the only words of a row without an id", None), (None, None, None)]
    rows += [(9, f"password: hunter2{i} is what she said to the clerk at the desk on day {i}", "de") for i in range(2)]
    docs = spark.createDataFrame([(*r, r[0], *range(len(names))) for r in rows], "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for d, left in ((docs, 6), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, str(tmp_path))
            if name == "packing":
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in d.collect()}
                break
            assert out.columns == docs.columns, name
            d = corpus_pipeline.cut(out)
            assert all([r[n] for n in names] == list(range(len(names))) for r in d.collect()), name
        got = d.collect()
        assert len(got) == left, got
        assert not any("hunter2" in (r.text or "") for r in got)
