"""op1: tolerant parsing, tree matching, induced templates, furniture."""

import random
import re
from html import unescape

from sheetwise.llm import html_extract
from sheetwise.llm.html_extract import Shape, Slot, Template, extract, fold, matching
from sheetwise.llm.html_tree import parse


def text_of(html, template=None):
    page = parse(html)
    if template is None:
        template = Template()
        template.add_page(page)
    return template.main_text(page)


def test_text_rules():
    assert text_of("<p>a&amp;b &lt;c&gt; &eacute;&#233;\n\t x</p><p>y</p>z") == "a&b <c> éé x y z"
    assert text_of("one<b>two</b><br>three <i>four</i>") == "onetwo three four"
    assert text_of("<p>open <b>bold<p>next<ul><li>1<li>2</ul>") == "open bold next 1 2"
    assert text_of("a <!-- hid --> b <script>var t='</p>';</script> c <style>p{}</style> d") == "a b c d"
    assert text_of("x < y &am z &copy 2") == "x < y &am z © 2"
    assert text_of('<a title="a>b">t</a><p class=x>u</p><script>never closed') == "t u"
    assert text_of(None) == text_of("") == text_of("<!-- only") == ""
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000 + " end") == "deep end"


def test_furniture_is_left_out():
    html = ("<html><head><title>t</title></head><body><header>site</header><nav>menu</nav><div class='ad-box'>buy</div>"
            "<div id=cookie-notice>ok?</div><form>search <input></form><aside>side</aside>"
            "<article><header><h1>Head</h1></header><p>Body.</p><div class='share'>share</div></article>"
            "<section id='comments'><p>first!</p></section><article class='comment'>second</article>"
            "<div role=navigation>more</div><p hidden>no</p><footer>bye</footer></body></html>")
    assert text_of(html) == "Head Body."
    plain = "<body><nav>m</nav><div>words here</div><div class='sidebar'>s</div><p>also</p></body>"
    assert text_of(plain) == "words here also"


def slow_matching(a, b):
    if not a or not b:
        return 0
    best = max(slow_matching(a[1:], b), slow_matching(a, b[1:]))
    if a[0].key == b[0].key:
        best = max(best, 1 + slow_matching(a[0].kids, b[0].kids) + slow_matching(a[1:], b[1:]))
    return best


def test_wrappers_around_all_text_are_no_furniture():
    def text(html):
        return Template().main_text(parse(html))

    for html in ('<div class="layout has-sidebar"><p>Own words.</p></div>', '<div id="page" class="no-sidebar"><p>Own words.</p></div>',
                 '<div class="post tags-linux"><p>Own words.</p></div>', "<main><form><p>Own words.</p></form></main>",
                 '<div class="page has-sidebar"><div class="sidebar">x</div><article><p>Own words.</p></article></div>',
                 '<form><div class="page no-ads"><nav>Menu of many more words than that</nav><p>Own words.</p></div></form>'):
        assert text(html) == "Own words.", html
    for html in ('<div class="navbar">Menu</div>', '<div class="cookie-notice"><p>We use cookies.</p></div>', "<nav>Menu</nav>",
                 '<div id="comments"><p>First!</p></div>', '<div role="navigation" class="a b">Menu</div>', "", "<form></form>"):
        assert text(html) == "", html
    # where there is other text, a listed word still decides
    assert text('<p>Own words.</p><div class="my-sidebar"><p>Much more text than the page itself has.</p></div>') == "Own words."


def test_matching_is_the_largest():
    rnd = random.Random(2)

    def tree(depth):
        return Slot(rnd.choice("abc"), kids=[tree(depth - 1) for _ in range(rnd.randint(0, 3))] if depth else [])

    for _ in range(300):
        a, b = [tree(2) for _ in range(rnd.randint(0, 4))], [tree(2) for _ in range(rnd.randint(0, 4))]
        size, pairs = matching(a, b, {})
        assert size == slow_matching(a, b)
        assert pairs == sorted(pairs) and all(a[i].key == b[j].key for i, j in pairs)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def shop(i):
    extra = "<h2>Sale</h2>" if i % 3 == 0 else ""
    return (f"<body><div class=top>Welcome to our site</div>{extra}<div class=text><p>Own words {i}.</p>"
            + f"<p>More {i * 7}.</p>" * (i % 4) + "</div><div class=low>All rights</div></body>")


def test_constant_slots_are_template():
    template = Template()
    for i in range(90):
        template.add_page(parse(shop(i)))
    again = Template.loads(template.dumps())
    assert text_of(shop(4), again) == "Own words 4."
    assert text_of(shop(3), again) == "Own words 3. More 21. More 21. More 21."
    few = Template()
    for i in range(5):
        few.add_page(parse(shop(i)))
    assert "Welcome" in text_of(shop(4), few)  # too few pages to tell


def test_partial_templates_merge_to_the_same_pages():
    whole, parts = Template(), [Template() for _ in range(4)]
    for i in range(80):
        whole.add_page(parse(shop(i)))
        parts[i % 4].add_page(parse(shop(i)))
    for p in parts[1:]:
        parts[0].add(p)
    assert parts[0].root.pages == whole.root.pages == 80
    assert [text_of(shop(i), parts[0]) for i in range(80)] == [text_of(shop(i), whole) for i in range(80)]


def test_parts_that_come_late_are_learnt_beside_ids_of_single_pages(monkeypatch):
    monkeypatch.setattr(html_extract, "MAX_SLOTS", 100)

    def post(i):
        late = "<div class=late>Late offer</div>" if i >= 150 else ""
        return f"<body><div class=top>Welcome</div><div id=post-{i}><h1>T{i}</h1><p>Own {i}.</p></div>{late}</body>"

    whole, parts = Template(), [Template() for _ in range(3)]
    for i in range(300):
        whole.add_page(parse(post(i)))
        parts[i % 3].add_page(parse(post(i)))
    merged = Template.loads(parts[0].dumps())
    for p in parts[1:]:
        merged.add(Template.loads(p.dumps()))
    for template in (whole, merged):
        assert [text_of(post(i), template) for i in (3, 200, 299)] == [f"T{i} Own {i}." for i in (3, 200, 299)]
        assert len(html_extract.supports(template.root)) <= 100
    wide, page = Template(), "".join(f"<p class=c{k}>fixed {k}</p>" for k in range(300))
    for _ in range(30):
        wide.add_page(parse(page))
    assert text_of(page, wide) == ""  # a page of more slots than the bound


def test_fold_keeps_order_and_counts():
    root = Slot("#page")
    for html in ("<p>a</p><h1>t</h1>", "<h1>t</h1><p>b</p>", "<p>c</p>"):
        fold(root, Shape("#page", [parse(html)]), {}, [100])
    assert sorted(k.key for k in root.kids) == ["h1", "p", "p"] and sum(k.pages for k in root.kids) == 5


def test_frames(spark, monkeypatch):
    rows = [(i, f"https://SHOP.example:80/{i}", shop(i)) for i in range(60)]
    rows += [(100, None, "<p>lost</p>"), (101, "no url", None), (None, "http://x/", ""), (102, "http://y", "<p>" + "w " * 50_000),
             (103, "http://y", "<p>twin</p>"), (103, "http://y", "<p>twin</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).selectExpr("*", "'x' AS text")
    for limit in (1 << 20, 0):
        monkeypatch.setattr(html_extract, "MAX_BROADCAST_BYTES", limit)
        got = extract(df).collect()
        by_page = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert by_page[4] == "Own words 4." and by_page[100] == "lost" and by_page[101] == "" == by_page[None]
        assert by_page[102] == ("w " * 50_000).strip() and by_page[103] == "twin"
    assert extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert extract(df.limit(0)).count() == 0


def test_query_on_given_pages(spark):
    import __spark_entry__ as entry
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = entry.queries()["op1_html_extract"](spark, d).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        spaced = re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", inside)
        assert r.text == " ".join(unescape(spaced).split())
