"""Extraction from pages with every kind of surroundings."""

import time

import pytest
from tidecast.llm import html_extract as html

TEXT = "A first sentence that is long enough to be running text of the page, with commas."
SCHEMA = "page_id long, url string, html string, host string, path string"


def page(body, around=True):
    nav = "<nav><ul><li><a href='/a'>Menu entry</a></li></ul></nav><header>Site</header>" if around else ""
    end = "<footer>Imprint</footer><script>var t = '</p>';</script>" if around else ""
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{nav}{body}{end}</body></html>"


def test_blocks_are_those_of_the_article():
    body = f"""<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>{TEXT}
      <b>bold</b>&nbsp;x&#233;</p><p>Two<br>lines<p>unclosed<ul><li>one<li>two</ul>
      <aside>side</aside><form>f</form><div class="comments"><p>first!</p></div></article>"""
    expected = ["Title & more", f"{TEXT} bold xé", "Two lines", "unclosed", "one", "two"]
    assert html.main_text(page(body), None).split("\n") == expected


@pytest.mark.parametrize(
    "start, end",
    [
        ("<article class='node node--promoted'>", "</article>"),
        ("<article class='related'>", "</article>"),
        ("<main id='comments'>", "</main>"),
        ("<div class='post comments-open'>", "</div>"),
        ("<div class='content has-sidebar'>", "</div>"),
        ("<div class='content with-header no-nav'>", "</div>"),
        ("<div id='legal-affairs'>", "</div>"),
        ("<div class='widget'><section class='social'>", "</section></div>"),
    ],
)
def test_a_name_alone_does_not_drop_the_article(start, end):
    text = page(f"<div class='sidebar--left'>Side</div>{start}<p>{TEXT}</p><p>{TEXT}</p>{end}<div class='comments'>first!</div>")
    assert html.main_text(text, None) == f"{TEXT}\n{TEXT}"


def test_states_in_names_do_not_drop_a_part():
    names = ["note node--promoted", "post comments-open", "box has-sidebar", "with-header", "no_ads"]
    parts = "".join(f"<div class='{name}'>Part {i}</div>" for i, name in enumerate(names))
    asides = "".join(f"<div class='{name}'>Aside</div>" for name in ("site-header", "comments", "ad_box has-x", "nav--main"))
    found = html.main_text(page(f"<article><p>{TEXT}</p>{parts}{asides}</article>"), None)
    assert found.split("\n") == [TEXT, *(f"Part {i}" for i in range(5))]


def test_odd_pages():
    assert html.main_text(None, None) == html.main_text("", "a>b") == ""
    assert html.main_text("just text", None) == "just text"
    assert html.main_text("<p>a<p>b</div></b><!-- c -->", "html>body") == "a\nb"
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 10, None) == "deep"
    assert html.main_text(page("<main><p>" + "x " * 100000 + "</p></main>"), None) == ("x " * 100000).strip()
    assert html.main_text("<p>a &lt;b&gt; &amp;amp; &am</p>", None) == "a <b> &amp; &am"


def test_paths_are_generalised():
    root = html.parse("<html><body><div class='post p12 Big'><article id='x7'><p>t</p></article></div></body></html>")
    assert "html>body>div.big.p.post>article" in html.containers(root)


def test_a_host_agrees_on_a_container(spark):
    good = f"<div class='main-text t1'><p>{TEXT}</p><p>{TEXT}</p></div><div class='teasers'><p>short</p></div>"
    odd = f"<div class='main-text t2'><p>short text</p></div><div class='teasers'><p>{TEXT}{TEXT}</p></div>"
    rows = [(i, f"https://www.Host.example:80/{i}", page(good), "h", "p") for i in range(6)]
    rows += [
        (10, "http://host.example/odd", page(odd), "h", "p"),
        (11, "http://other.example/odd", page(odd), "h", "p"),
        (12, None, page(good), "h", "p"),
        (13, "not a url", None, "h", "p"),
        (14, "http://host.example/", "", "h", "p"),
        (15, "http://host.example/x", "<p>no such container</p>", "h", "p"),
        (0, rows[0][1], rows[0][2], "h", "p"),
        (None, "http://host.example/", page(good), "h", "p"),
    ]
    found = html.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows)
    text = {r.page_id: r.text for r in found}
    assert all(text[i] == f"{TEXT}\n{TEXT}" for i in (*range(6), 12, None))
    assert text[10] == "short text"  # as its host's other pages
    assert text[11] == f"{TEXT}{TEXT}"
    assert text[13] == text[14] == "" and text[15] == "no such container"
    assert all(r.n_chars == len(r.text) for r in found)
    assert {r.url for r in found if r.page_id == 12} == {None}
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("declaration", ["<![foo bar]>", "<![ x]>", "<![%x]>", "<![CDATA[z]]>", "<![if IE]>", "<!x>", "<?y?>"])
def test_unknown_declarations_are_passed_over(declaration):
    assert html.main_text(f"<p>a</p>{declaration}<p>b</p>", None) == "a\nb"


@pytest.mark.parametrize(
    "comments",
    ["<div class='comments'>{}</div>", "<ol class='commentlist'><li>{}</ol>", "<div id='comments'>{}</div>", "<div class='sidebar'>{}</div>"],
)
def test_long_comments_are_no_article(comments):
    text = " ".join([TEXT] * 8)
    replies = comments.format("Reply. " * 400)
    assert html.main_text(f"<article><p>{text}</p></article>{replies}", None) == text
    assert html.main_text(f"<article><p>{text}</p>{replies}</article>", None) == text


def test_deep_pages_take_time_in_proportion():
    for deep in ("<div>text " * 20000, "<div class='a'><span>" * 20000 + "text" + "</b>" * 20000):
        start = time.perf_counter()
        assert "text" in html.main_text(deep, None)
        assert time.perf_counter() - start < 20
    keys = html.containers(html.parse("<div>text " * 3000))
    assert max(map(len, keys)) < 2 * html.LONG_KEY and len(keys) == 3000


def test_large_hosts_get_salts(spark):
    rows = [(i, f"http://{'big' if i % 3 else f'h{i}'}.example/", f"<p>{i}</p>", "", "") for i in range(3000)]
    pages = spark.createDataFrame(rows, SCHEMA)
    named = pages.select("page_id", "html", html.host("url").alias("host"))
    spread, hosts = html._salted(named, named.select("host").distinct())
    assert spread.filter("host = 'big.example'").select("salt").distinct().count() > 500
    assert hosts.filter("host <> 'big.example'").count() == 1000
    assert spread.join(hosts, ["host", "salt"]).count() == 3000
    assert {(r.page_id, r.text) for r in html.extract(pages).collect()} == {(i, str(i)) for i in range(3000)}
