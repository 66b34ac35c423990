from html.parser import HTMLParser

from pyspark.sql import functions as F

from spindrift.llm import html_text
from spindrift.llm.html_text import Page


def text(source):
    page = Page(source)
    return page.text(page.own_path())


def test_what_is_text():
    assert text("") == "" and text("plain &amp; simple") == "plain & simple"
    assert text("<body><article><h1>A</h1><p>one\n  two<br>three <b>bo</b>ld<p>x &lt;&nbsp;y</article>") == "A one two three bold x < y"
    assert text('<body><nav>n</nav><div class="ad">a</div><article><p>t<script>if(a<b){"</p>"}</script><style>p{}</style></article><footer>f</footer>') == "t"
    assert text("<body><article><p>t<!-- c --><form>f</form><section class='reader-comments'>c</section><aside>s</aside>u</article>") == "t u"
    assert text("<body><article><p>cut <b>off <p>here<foo") == "cut off here"
    assert text("<article>a < b & c &amp;amp; d</article>") == "a < b & c &amp; d"
    assert text("<p>a<!-- never closed <p>b") == "a"
    assert text('<div class="post-12"><p>x</div><div id="sideBar">s</div>') == "x"


def test_generalised_paths():
    a, b = Page('<body><div class="post-12 big"><p>x'), Page('<body><div class="big post-77"><p>y')
    assert a.path == b.path and a.label == ["body", "div.big.post-"] and a.written_path(a.path[1]) == "body>div.big.post-"


def test_names_of_articles_lose_no_text():
    long = "a sentence of the article that goes on for quite a while"
    for wrapper in ('section id="social-history"', 'div class="login-story"', 'div class="share-price-table"', 'div class="menu-of-the-day"'):
        tag = wrapper.split()[0]
        page = f"<body><div><p>{long}</p><p>{long}</p><{wrapper}><p>{long}</p><p>{long}</p></{tag}></div><div class='related-posts'><p>more</p></div></body>"
        assert text(page) == " ".join([long] * 4)
    for noise in ("adslot", "werbung", "promo-2024-offer", "share-buttons", "cookie-notice", "comment-list", "nav_main"):
        assert text(f"<body><div><p>{long}</p><div class='{noise}'>BUY NOW</div><p>{long}</p></div></body>") == f"{long} {long}"
    assert [html_text.named_noise(v) for v in ("social-history", "x sidebar-left", "post", "pageHeader", "has-sidebar")] == [1, 2, 0, 0, 0]


def test_a_name_marks_a_part_and_never_the_page():
    body = "<p>first part of it</p><p>second part of it</p><p>third part of it</p>"
    want = "first part of it second part of it third part of it"
    for wrapper in ('div class="has-sidebar"', 'div class="page-with-header"', "form action=x", 'div class="sidebar"', 'div id="comments"'):
        tag = wrapper.split()[0]
        assert text(f"<body><{wrapper}>{body}</{tag}>") == want
        assert text(f"<body><{wrapper}><article>{body}</article></{tag}><div class=ad>buy</div>") == want
    assert text(f'<body><article>{body}<p class="advert">BUY<p>end <span class="ad">now</span> of it<div hidden>x</div><b style="display: none">y</b></article>') == want + " end of it"
    assert text(f"<body><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><div>{body} <a href=4>four</a></div>") == want + " four"
    assert text("<body><article><h1>Title</h1><div class=lead><p>a lead of some length</div><div class=body>" + body * 20 + "</div></article>").startswith("Title a lead of some length first")


def test_deep_markup_takes_memory_in_proportion():
    import tracemalloc

    used = []
    for n in (10_000, 40_000):
        source = "<div>" * n + "<p>deep" + "</div>" * n
        tracemalloc.start()
        assert text(source) == "deep"
        used.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert used[1] < 6 * used[0] and used[1] < 200 << 20


class Independent(HTMLParser):
    """The article's blocks of well-formed pages, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = self.skip = 0
        self.blocks = [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag not in ("a", "b", "i"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")
        if tag not in ("a", "b", "i"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1] += data


def test_whole_query_against_an_independent_parser(spark):
    sf = "/root/testdata/sf0.01"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_text.op3_html_consensus(spark, sf).collect()
    assert len(got) == len(source)
    for r in got:
        p = Independent()
        p.feed(source[r.page_id])
        p.close()
        assert r.text == " ".join(w for w in (" ".join(b.split()) for b in p.blocks) if w), r.page_id


def test_pages_are_read_twice_and_no_more(spark):
    d = html_text.op3_html_consensus(spark, "/root/testdata/sf0.001")
    assert d._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # the votes are a written table


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "host", "path", "share", "n_chars")})


def test_hosts_agree_on_a_path(spark):
    main = lambda t: f'<body><div class="top"><p>promo of the day</div><div class="story"><p>{t}</div>'
    rows = [(i, f"http://www.h.com/{i}", main("word " * 60)) for i in range(16)]
    rows += [(20, "http://h.com:80/odd", main("tiny")), (21, "http://h.com/other", "<body><main><p>elsewhere</main>"), (22, None, "<p>no host"), (23, "http://u@k.org/x", None), (24, "nonsense", ""), (7, "http://www.h.com/7", main("word " * 60))]
    got = {}
    for r in html_text.extract(pages(spark, rows)).collect():
        got.setdefault(r.page_id, r)
        assert r.n_chars == len(r.text)
    assert got[0].text_path == "body>div.story" and got[0].text == ("word " * 60).strip()
    assert got[20].text == "tiny"  # alone it would have kept the promotion
    assert got[21].text == "elsewhere" and got[22].text == "no host" and got[23].text == "" and got[24].text == ""
    assert html_text.extract(pages(spark, [])).count() == 0
    assert html_text.extract(pages(spark, rows)).count() == len(rows)
