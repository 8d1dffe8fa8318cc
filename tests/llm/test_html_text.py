import random
import time

from pyspark.sql import functions as F

from dialoom.llm import html_text

PAGES = "page_id long, url string, html string"


def page(body, menu="<ul class='x'><li>Home<li>News</ul>"):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>menu</nav><div><div>{menu}</div></div><article><h1>Head</h1>{body}</article><footer>foot</footer></body></html>"


def text(html, templates=frozenset(), host="h"):
    return html_text.page_text(host, html, set(templates))


def test_blocks_entities_and_white_space():
    assert text(page("<p>a &amp; b\n  <b>c</b>&nbsp;d<br>e</p><p>f")) == "Head\n\na & b c d e\n\nf"
    assert text("<p>one<p>two<script>var x = '<p>no</p>'</script><!-- <p>no -->") == "one\n\ntwo"
    assert text("<body><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text("<p>cut off &am") == "cut off &am" and text("5 < 6 and <b>7</b>") == "5 < 6 and 7"
    assert text(None) == text("") == text("<script>only</script>") == ""
    assert text('<p title="a>b">x</p>') == "x" and text("<p title='open>x</p><p>y</p>") != ""


def test_declared_boilerplate():
    extra = '<div class="ad">buy</div><aside>side</aside><form>f<input></form><div id="comments"><article><p>nice</article></div><div class="cookie-notice">c</div><div hidden>h</div>'
    assert text(page(f"<p>body</p>{extra}")) == "Head\n\nbody"
    assert text("<body><header>site</header><main><header><h1>T</h1></header><p>x</p></main></body>") == "T\n\nx"


def test_templates_are_counted_per_host(spark):
    rows = []
    for i in range(12):
        body = f"<div><p>story {i} of many</p></div>"
        promo = "<div><div><p>Read our other stories</p></div></div>"
        rows.append((i, "http://a.example/" + str(i), f"<body>{body}{promo}</body>"))
        rows.append((100 + i, f"http://b{i}.example/", f"<body>{body}{promo}</body>"))
    rows += [(200, None, "<p>x</p>"), (201, "no url", None), (202, "http://a.example/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, "y") for r in rows], PAGES + ", text string")
    for limit in (10**6, -1):  # the templates in the tasks, and joined in Spark
        out = {r.page_id: r for r in html_text.extract(pages, broadcast_keys=limit).collect()}
        assert len(out) == len(rows)
        assert out[3].text == "story 3 of many" and out[202].text == "story 0 of many"  # the promotion recurs on host a
        assert out[103].text == "story 3 of many\n\nRead our other stories"  # but not on hosts with one page
        assert out[200].text == "x" and out[201].text == "" and out[201].n_chars == 0
    assert html_text.extract(pages.limit(0)).count() == 0


def test_article_prose_is_no_template(spark):
    shared = "<p>A passage that a third of the articles of this site quote.</p>"
    rows = [(i, "http://a.example/" + str(i), page(f"<p>own {i}</p>{shared if i % 3 == 0 else ''}", menu=f"m{i}")) for i in range(30)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    # The headline is the same on all pages: that is template.
    assert out[3] == "own 3\n\nA passage that a third of the articles of this site quote." and out[4] == "own 4"


def test_blocks_on_a_small_share_of_a_large_host(spark):
    advert, notice = "<div class='x7'><div>Buy the red kettle now</div></div>", "<section><p>We close early this week</p></section>"
    rows = []
    for i in range(200):
        extra = (advert if i % 20 == 0 else "") + (notice if i % 7 == 0 else "")  # 5 and 15 %
        rows.append((i, f"http://a.example/{i}", f"<body><div><p>story {i} of many</p></div>{extra}</body>"))
        rows.append((1000 + i, f"http://c.example/{i}", page(f"<p>own {i}</p>{extra}", menu=f"m{i}").replace("Head", f"Head {i}")))
    # Copies of a page at other urls, and versions of one url, are one page: their own text stays.
    rows += [(2000 + i, f"http://b.example/{i}", "<body><div>the same story</div></body>") for i in range(30)]
    rows += [(3000 + i, "http://d.example/", f"<body><div>the same story</div><p>seen {i}</p></body>") for i in range(30)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(200):
        assert out[i] == f"story {i} of many" and out[1000 + i] == f"Head {i}\n\nown {i}"
    assert out[2000] == "the same story" and out[3001] == "the same story\n\nseen 1"


def test_quotes_stay_on_pages_without_article(spark):
    quote = "<p>A passage that a tenth of the pages quote.</p>"
    rows = [(i, f"http://a.example/{i}", f"<body><div>{quote if i % 10 == 0 else ''}<p>own {i}</p></div></body>") for i in range(100)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[0] == "A passage that a tenth of the pages quote.\n\nown 0" and out[1] == "own 1"


def test_all_of_main_is_read():
    first, second = f"<article><p>{'one ' * 70}</p></article>", f"<article><p>{'two ' * 30}</p></article>"
    both = f"{('one ' * 70).strip()}\n\n{('two ' * 30).strip()}"
    assert text(f"<body><nav>n</nav><main>{first}{second}</main></body>") == both
    assert text(f"<body><div>{first}{second}</div><div>beside</div></body>") == both
    assert text("<main><h1>T</h1><p>intro</p><article><p>body</p></article></main><div>d</div>") == "T\n\nintro\n\nbody"
    assert text("<body><div>d</div><div><h1>T</h1><article><p>body</p></article></div></body>") == "T\n\nbody"
    assert text("<main><p>long text</p><article><p>teaser</p></article><p>end</p></main>") == "long text\n\nteaser\n\nend"
    related = '<article class="related"><p>r</p></article><div class="comments"><article><p>c</p></article></div>'
    assert text(f"<body><h1>T</h1>{first}{related}</body>") == f"T\n\n{('one ' * 70).strip()}"
    assert text(f"<div><h1>Site</h1></div><article><h1>T</h1><p>x</p></article>") == "T\n\nx"


def test_recurring_small_articles_go_and_reprinted_ones_stay(spark):
    teaser = "<article><p>Teaser of another story</p></article>"
    story = "<div><p>The reprinted story, all of it and in full length</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body><main><article><h1>h{i}</h1><p>story {i} of many, longer than the teaser</p></article>{teaser}</main></body>") for i in range(60)]
    rows += [(100 + i, f"http://a.example/p{i}", f"<body><div>v{i}</div><article><h1>p{i}</h1>{story}</article></body>") for i in range(8)]
    rows += [(200 + i, f"http://b.example/{i}", f"<body><article><h1>h{i}</h1><p>story {i} of many, longer than the teaser</p></article>{teaser}</body>") for i in range(20)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[3] == "h3\n\nstory 3 of many, longer than the teaser" and out[203] == out[3]
    assert out[103] == "p3\n\nThe reprinted story, all of it and in full length"


def test_deep_and_long_pages_are_linear():
    n = 20_000
    for hard in ("<div><p>x" * n, "<ul><li>" * n, "<div>" * n + "<p>x</p>" * n, "<p>x</section>" * n, "<article><h1>t</h1><p>x</article>" * n):
        start = time.process_time()
        text(hard)
        assert time.process_time() - start < 6


def test_keys_tell_subtrees_apart():
    cut = lambda h: dict(zip([(e.tag, h[e.start : e.end]) for e in html_text.elements(h)], html_text.subtree_keys("a", h, html_text.elements(h))))
    one = cut("<div>a<p>b</p>c<ul><li>d</li></ul></div><div>a<p>b</p>c<ul><li>d</li></ul></div>")
    assert len({*one.values()}) == len(one) == 4
    differ = ["<div>a<p>b</p>c</div>", "<div>a<p>b</p></div>", "<div>ac<p>b</p></div>", "<div><p>a</p><p>b</p>c</div>", "<div class=x>a<p>b</p>c</div>", "<div>a<p>b</p><p>c</p></div>"]
    assert len({html_text.subtree_keys("a", h, html_text.elements(h))[0] for h in differ}) == len(differ)
    assert html_text.subtree_keys("a", differ[0], html_text.elements(differ[0]))[0] != html_text.subtree_keys("b", differ[0], html_text.elements(differ[0]))[0]


def brute_templates(rows):
    """(host, markup) of subtrees outside articles and main elements that recur on enough pages, by comparing whole subtrees."""
    seen, pages = {}, {}
    for _, url, html in rows:
        host, page_ = url.split("/")[2], html_text.clean(html)
        pages.setdefault(host, set()).add(url)
        for e in html_text.elements(page_):
            seen.setdefault((host, page_[e.start : e.end], e.tag), set()).add(url)
    return {(h, m) for (h, m, tag), urls in seen.items() if len(urls) >= html_text.MIN_PAGES and tag in ("div", "section", "ul") and len(pages[h]) <= 100}


def test_templates_match_brute_force(spark):
    """Planted blocks with neutral names, with and without article; emptying the template set changes each page's text."""
    draw, rows = random.Random(4), []
    blocks = [f"<div class='k{i}'><div>block {i} of the site</div></div>" for i in range(12)]
    for i in range(120):
        host, own = f"h{i % 3}.example", f"<h1>title {i}</h1><p>{' '.join(f'w{draw.randint(0, 999)}' for _ in range(60))}</p>"
        extra = "".join(b for k, b in enumerate(blocks) if draw.random() < (k + 1) / 24)
        rows.append((i, f"http://{host}/{i}", f"<body><article>{own}{extra}</article></body>" if i % 2 else f"<body><section>{own}</section>{extra}</body>"))
    pages = spark.createDataFrame(rows, PAGES)
    known = {r.key for r in html_text.template_keys(pages.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))).collect()}
    want = brute_templates(rows)
    found = set()
    for _, url, html in rows:
        host, page_ = url.split("/")[2], html_text.clean(html)
        every = html_text.elements(page_)
        found |= {(host, page_[e.start : e.end]) for e, k in zip(every, html_text.subtree_keys(host, page_, every)) if k in known}
    assert want and found == want
    out = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for i, url, html in rows:
        host, kept = url.split("/")[2], [b for b in blocks if b in html and (url.split("/")[2], b) not in want]
        words = html.split("<p>")[1].split("</p>")[0]
        assert out[i] == "\n\n".join([f"title {i}", words, *[b.split("<div>")[1].split("</div>")[0] for b in kept]])
        if any((host, b) in want and b in html for b in blocks):
            assert text(html, host=host) != out[i]  # without templates the blocks stay


def test_equally_large_articles():
    assert text("<body><div><article><p>one</article></div><div><article><p>two</article></div></body>") == "one\n\ntwo"


def test_elements_that_are_no_text_end_where_they_end():
    """Custom elements, self-closed and unclosed ones take nothing with them."""
    for name in html_text.RAW.split():
        odd = f"<p>first</p><{name}-player x='1'></{name}-player><p>second</p><{name}-menu>x</{name}-menu>"
        assert text(page(odd)).split("\n\n")[:3] == ["Head", "first", "second"], name
        whole = f"<p>first</p><{name} a=1>gone</{name} ><p>second</p>"
        assert text(page(whole)) == "Head\n\nfirst\n\nsecond", name
        open_ = text(page(f"<p>first</p><{name}><p>second</p>"))
        assert open_ == ("Head\n\nfirst" if name in ("script", "style") else "Head\n\nfirst\n\nsecond"), name
    for name in ("svg", "math"):
        assert text(page(f"<p>first</p><{name} class='i'/><p>second</p><{name}/><p>third</p>")) == "Head\n\nfirst\n\nsecond\n\nthird"
    began = time.time()
    assert len(text(page("<button>x" * 100_000))) > 100_000
    assert time.time() - began < 20


def test_names_within_an_article():
    body = "<section id='related-work'><p>a</p></section><div class='notice-board'><p>b</p></div><p class='social'>c</p><div class='x comments'><p>gone</p></div>"
    assert text(page(body)) == "Head\n\na\n\nb\n\nc"
    assert text(page("<p>a</p>") + "<div class='cookie-bar'>gone</div>") == "Head\n\na"
