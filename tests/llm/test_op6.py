import html
import re

from tidewell.llm import op6_extraction as op


def truth(page):
    """The article of the generated pages, by their known layout."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"<br>|</?b>", " ", body))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = op.extract(pages).toPandas()
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    assert len(got) == len(want)
    wrong = [r.page_id for r in got.itertuples() if r.text != want[r.page_id]]
    assert not wrong
    assert (got.n_chars == got.text.str.len()).all()


PAGE = """<html><head><title>t</title></head><body><div class="top-menu"><a href=/>home</a></div>
<div id="content"><h2>Head {0}</h2><p>Body &lt;{0}&gt; of&nbsp;the   story<p>second {0} one</p><div>Share this page with friends</div></div>
<div class="comments"><p>reader {0} says</p></div><form><p>your mail</p></form><script>var x = "<p>no</p>"</script></body>"""


def test_template_without_an_article_and_edge_cases(spark):
    rows = [(i, "http://a.example/x", PAGE.format(f"n{i}"), "z") for i in range(6)]
    rows += [(10, None, None, ""), (11, "http://b.example/", "", ""), (None, "http://c.example", "plain <b>text", ""), (12, "http://d.example", "<p>" + "long " * 50000, "")]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i] == f"Head n{i}\nBody <n{i}> of the story\nsecond n{i} one"
    assert got[10] == got[11] == "" and got[None] == "plain text" and len(got[12]) == 249_999
    assert op.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_beyond_the_broadcast_size_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example/x", PAGE.format(f"n{i}")) for i in range(18)], "page_id long, url string, html string")
    one = sorted(map(tuple, op.extract(pages).collect()))
    monkeypatch.setattr(op, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, op.extract(pages).collect())) == one


def test_equal_pages_of_a_host_keep_their_text(spark):
    rows = [(i, "http://a.example/x", PAGE.format("same")) for i in range(9)]
    got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("Head same\nBody <same>") for r in got)


def test_wrappers_of_the_whole_page_and_open_heads_keep_the_text(spark):
    story = "<p>Story {0} begins</p><p>and goes on for {0} more words than the rest</p>"
    around = "<nav><a href=/>home</a></nav>{}<div class=user-comments><p>reader {{0}} says</p></div>"
    wraps = [
        "<html><head><title>t</title></head><body><form id=aspnetForm><article>" + around.format(story) + "</article></form></body></html>",
        "<html><body class=has-sidebar><div id=x>" + around.format(story) + "</div></body></html>",
        "<body><div class=with-comments>" + around.format("<article>" + story + "</article>") + "</div></body>",
        "<html><head><title>t</title><script>'<div>'</script><body><article>" + around.format(story) + "</article></body></html>",
        "<body><button>go<div>" + around.format("<article>" + story + "</article>") + "</div></body>",
    ]
    rows = [(10 * h + i, f"http://h{h}.example/{i}", w.format(f"n{i}")) for h, w in enumerate(wraps) for i in range(6)]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, _ in rows:
        assert got[k] == "Story n{0} begins\nand goes on for n{0} more words than the rest".format(k % 10), (k, got[k])


def test_deep_elements_and_late_class_words_are_seen(spark):
    deep = lambda n, inner: "<div>" * n + inner + "</div>" * n
    story = "<p>Story {0} begins</p><p>and goes on for {0} more words than the rest</p>"
    layouts = [
        deep(20, "<article>" + story + deep(3, "<div class=comments><p>reader {0} says</p></div>") + "</article><aside><p>see {0} too</p></aside>"),
        deep(2, story + '<div class="row mt-0 px-0 comments"><p>reader {0} says</p></div>'),
        deep(300, story + "<nav><p>go to {0}</p></nav>"),
    ]
    rows = [(10 * h + i, f"http://h{h}.example/{i}", "<body>" + w.format(f"n{i}")) for h, w in enumerate(layouts) for i in range(6)]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, _ in rows:
        assert got[k] == "Story n{0} begins\nand goes on for n{0} more words than the rest".format(k % 10), (k, got[k])


def test_scans_are_linear_and_comments_vanish():
    import time

    hostile = ["<a " * 35_000, "<!x " * 25_000, "<button><p>" * 9_000, "<script " * 12_000, "<div>x" * 20_000, "<div>" * 10_000 + "</p>" * 10_000, "<a '" * 25_000, '<a "' * 25_000]
    for page in hostile:
        began = time.process_time()
        op.main_text(page, set(), set(), set(), set())
        assert time.process_time() - began < 3, page[:10]
    text = lambda p: op.main_text(p, set(), set(), set(), set())
    assert text("<p>foo<!-- x -->bar <b>b</b>ig</p>") == "foobar big"
    assert text("<p>1 < 2 &amp; 3</p><script>if (a < b) x = '<p>no</p>'</script>") == "1 < 2 & 3"


def test_layouts_of_one_host_are_judged_apart(spark):
    """A layout with an article, a rarer one without, and a nested part of the article that never changes."""
    story = "<h1>Story {0}</h1><p>begins with {0}</p><p>All rights belong to their holders</p>"
    one = "<body><div class=x>Notice of the day to all</div><article>" + story + "<div class=box><p>Write to us about this</p></div></article><div>and this is how it goes on</div></body>"
    two = "<body><div class=y>Notice of the day to all</div><div class=intro>In short: {0}</div><div class=body><p>" + "Much is said of {0}. " * 20 + "</p></div></body>"
    rows = [(i, "http://a.example/x", (one if i % 3 else two).format(f"n{i}")) for i in range(30)]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    for i, _, _ in rows:
        if i % 3:
            assert got[i] == f"Story n{i}\nbegins with n{i}\nAll rights belong to their holders", got[i]
        else:
            assert got[i] == f"In short: n{i}\n" + ("Much is said of n%d. " % i * 20).strip(), got[i]


def test_only_anchors_with_a_target_are_links_and_they_end_with_their_element(spark):
    """Pages with an unclosed anchor: a name, or a link whose end tag is missing."""
    plain = PAGE.replace("<h2>", '<a name="top"><h2>')
    open_link = PAGE.replace("<h2>", '<div><a href="/x">more</div><h2>')
    for pages in ([plain], [plain] * 12, [open_link] * 12):
        rows = [(i, f"http://{len(pages)}.example/{i}", p.format(f"n{i}")) for i, p in enumerate(pages)]
        got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        for r in got:
            for line in (f"Head n{r.page_id}", f"Body <n{r.page_id}> of the story", f"second n{r.page_id} one"):
                assert line in r.text.split("\n")
    linked = op.parse("<p><a name=x>one</a> <a title='a' href=/y>two</a> three</p><div><a href=/z>four<p>five</p></a>six</div>").blocks
    assert [(text, n) for _, text, n in linked] == [("one two three", 3), ("four", 4), ("five", 4), ("six", 0)]
