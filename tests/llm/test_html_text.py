import re
from html import unescape

from strandset.llm.html_text import PAGES, blocks, host_of, main_text, parse, read_page, templates


def plain(html):
    """The article of the generated pages: its h1 and paragraphs."""
    m = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)
    parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x) if "<b>" not in x else re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|h2|h3|li|ul|div)>", m[1])] if m else []
    return "\n".join(x for x in parts if x)


def test_generated_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in main_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


PAGE = """<html><head><title>T</title></head><body><header><h2>Site</h2></header><div id="menu"><a href=1>Home</a></div>
<div class="cookie-notice">We use cookies</div><main><article class="post"><header><h1>A &amp; B</h1></header>
<p>One <b>bold</b>&nbsp;line<br>next <a href="x>y">link</a>.<p>Two<script>x("<p>no</p>")</script>
<ul><li>i<li>ii</ul><form>Mail <input></form><aside>Side</aside><!-- <p>gone</p> --><div class="ad">Buy</div><footer>tags</footer></article>
<section id="comments"><h3>Comments</h3><p>Nice!</p></section></main><footer>end</footer></body></html>"""


def test_one_page_of_many_parts():
    assert read_page(PAGE, frozenset()) == "A & B\nOne bold line next link.\nTwo\ni\nii"


def test_broken_markup_is_read_as_far_as_it_goes():
    for html, text in (("", ""), ("plain < text", "plain < text"), ("<p>a<p", "a"), ("<p>a</div></p>b", "a\nb"), ("<article><p>x <b>y", "x y"), ("<!-- open <p>a", ""), ("<script>a", ""), ('<p class="a>b', "b")):
        assert read_page(html, frozenset()) == text, html
    assert len(read_page("<div>" * 5000 + "deep " + "</div>" * 5000, frozenset())) == 4
    assert len(blocks("<p>word word</p>" * 20000)) == 20000


SOUP = """<div><div>Welcome to us</div><div><a href=1>{0} more</a> <a href=2>Shop {0}</a></div><div><h2>Title {0}</h2><div><p>{0} text of page {0}, long enough to matter here.</p>
<p>Subscribe to our letter!</p><p>And {0} more words that only page {0} has in it.</p></div></div><div><div>All we do is ours</div></div></div>"""


def soup(n, url="http://a.example/%d"):
    return [(i, url % i, SOUP.format(i)) for i in range(n)]


def test_template_of_a_host_goes(spark):
    """Pages without article, main or any class name: only the pages together tell what is none of the article."""
    rows = soup(8) + [(19, "http://b.example", SOUP.format(9)), (20, None, None), (21, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS fixed")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    want = "Title 3\n3 text of page 3, long enough to matter here.\nAnd 3 more words that only page 3 has in it."
    assert got[3] == want and got[20] == got[21] == ""
    alone = read_page(SOUP.format(3))
    assert alone != want and all(x in alone for x in ("Welcome", "Shop", "Subscribe", "All we do")) and got[19] == read_page(SOUP.format(9))
    (one,) = templates(pages).collect()
    assert one.host == "a.example" and one.pages == 8 and len(one.fixed) == 3 and len(one.menus) == 1 and one.bound
    assert main_text(pages.limit(0)).count() == 0


def test_classes_equal_those_by_whole_vectors(spark):
    """Equivalence classes, fixed texts and nesting by occurrence vectors written out, page by page."""
    import random

    r = random.Random(3)
    html = []
    for i in range(30):
        parts = [f"<div class=top>Fixed head</div>{'<div class=ad>Buy this</div>' * r.choice([0, 1, 1, 2])}<section><h1>Head {i}</h1>"]
        parts += [f"<p>words {i} {j} of some text</p>" for j in range(r.randint(1, 4))] + ["<p>Said on half of all</p>"] * (i % 2) + ["<p>Said on nearly all</p>"] * (i % 8 > 0)
        html.append("".join([*parts, "</section><ul><li><a href=x>Home</a></li></ul>"]))
    pages = spark.createDataFrame([(i, "http://h.example/%d" % i, x) for i, x in enumerate(html)], "page_id long, url string, html string")
    vectors: dict = {}
    for i, x in enumerate(html):
        found, elements = parse(x)
        for k, (above, n) in [*elements.items(), (0, (0, 1))]:
            vectors.setdefault((k, None), {})[i] = n
        for b in found:
            own = vectors.setdefault((b.key, b.digest), {})
            own[i] = own.get(i, 0) + 1
    classes: dict = {}
    for token, own in vectors.items():
        if len(own) >= 3:
            classes.setdefault(tuple(sorted(own.items())), set()).add(token)
    (got,) = templates(pages).collect()
    assert sorted((c.pages, sorted(c.elements), sorted(c.texts)) for c in got.classes) == sorted(
        (len(v), sorted(k for k, t in m if t is None), sorted(t for _, t in m if t is not None)) for v, m in classes.items()
    )
    fixed = {t for v, m in classes.items() for k, t in m if t is not None and len(v) >= PAGES and (2 * len(v) > len(vectors[k, None]) or 2 * len(v) > 30 and any(x is None for _, x in m))}
    assert set(got.fixed) == fixed and len(fixed) == 4
    texts = {r.page_id: r.text.split("\n") for r in main_text(pages).collect()}
    for i in range(30):
        assert texts[i][0] == f"Head {i}" and ("Said on half of all" in texts[i]) == (i % 2 == 1) and not {"Fixed head", "Buy this", "Home", "Said on nearly all"} & set(texts[i])


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(i, "http://c.example/%d" % i, f"<ul><li><a href=x>{i}</a></ul><div><h2>Same</h2><p>The same words on every page of this host.</p><p>And others.</p></div>") for i in range(6)] + [(7, "http://c.example/7", None)] * 2
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("The same words on every page" in got[i] and "And others." in got[i] for i in range(6)) and got[7] == ""


def test_depth_and_classes_have_no_cap():
    """A closing tag far down closes its own element, and elements differ by any of their classes."""
    deep = "<div>" * 400 + "<section><p>in</p></section><p>after</p>" + "</div>" * 400 + "<p>end</p>"
    found, elements = parse(deep)
    assert [b.text for b in found] == ["in", "after", "end"] and len(elements) == 404
    assert len({b.key for b in blocks("<p class='a b c d'>x</p><p class='a b c e'>y</p><p class='e c b a'>z</p>")}) == 2
    assert [b.text for b in blocks("<x>" * 20000 + "</y>" * 20000 + "<p>t")] == ["t"]


def test_repeated_rows(spark):
    rows = soup(5) * 2
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 10 and len({(r.page_id, r.text) for r in got}) == 5


def test_hosts():
    assert [host_of(u) for u in ("http://A.b/c", "https://u@x.y:80?q", "z.w#k", None)] == ["a.b", "x.y", "z.w", ""]
