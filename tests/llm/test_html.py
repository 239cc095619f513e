import random

from sluice.llm import html

SCHEMA = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(n))


def page(rng, k, main):
    paras = [words(rng, rng.randint(8, 40)) for _ in range(rng.randint(2, 6))]
    body = "".join(f"<p>{p}</p>" for p in paras)
    title = words(rng, 5)
    open_, close = main
    return (
        f"<!doctype html><html><head><title>{title}</title><script>var x='<p>no</p>';</script></head><body><header><h2>Site</h2></header>"
        f"<nav><ul>{''.join(f'<li><a href=/>{words(rng, 1)}</a></li>' for _ in range(rng.randint(2, 6)))}</ul></nav>"
        f"<div class='cookie-notice'>We use cookies {k}</div><aside class=sidebar><p>{words(rng, 200)}</p></aside>"
        f"{open_}<h1>{title}</h1><div class=\"share-buttons\">Tweet {k}</div><p>Read our daily letter for more</p><p>Share it with friends</p>{body}<form><input><label>Mail</label></form>"
        f"<section id=comments><p>{words(rng, 30)}</p></section>{close}<div class=ad>{words(rng, 9)}</div><footer>&copy; {k} {words(rng, 4)}</footer></body></html>",
        "\n".join([title, *paras]),
    )


MAINS = [("<article>", "</article>"), ("<main id=m><article class='post big'>", "</article></main>"), ("<div class='post-content'>", "</div>"), ("<div><div>", "</div></div>"), ("<main>", "</main>")]


def test_templates_and_slots(spark):
    rng, rows, want = random.Random(3), [], {}
    for host, main in enumerate(MAINS):
        for _ in range(12):
            h, t = page(rng, len(rows), main)
            want[len(rows)] = t
            rows.append((len(rows), f"https://u@Host{host}.example.org:80/{len(rows)}", h))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want  # the two constant lines inside the article are template tokens


def test_a_copied_page_is_no_template(spark):
    rng = random.Random(4)
    h, t = page(rng, 0, MAINS[0])
    rows = [(k, "http://a.example/x", h) for k in range(30)] + [(1, "http://a.example/x", h)]
    out = html.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    lines = t.split("\n")
    assert len(out) == 31 and {r.text for r in out} == {"\n".join([lines[0], "Read our daily letter for more", "Share it with friends", *lines[1:]])}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [
        (1, None, None), (2, "", ""), (3, "no url", "just text &amp; <b>bold</b>face\n\t here"), (4, "http://h/", "<article>a<br>b &#233;&nbsp;&lt;p&gt;</article><footer>f"), (5, "http://h/", "<p>unclosed <p>two<ul><li>x<li>y"),
        (6, "http://h/", deep), (7, "http://h/", "<script>never closed <p>a</p>"), (8, "http://h/", "<!-- never closed <p>a</p>"), (9, "http://h/", "< a <> b </nothing> <p title='>'>c</p>"), (None, None, "<p>z</p>"),
        (10, "http://h/", "<p>" + "word " * 200_000 + "</p>"), (11, "http://h/", "<a href=\"x" * 300), (12, "http://h/", "<article><header><h1>T</h1></header><p>b</p></article>"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' as text", "'q' as host", "1 as key")
    out = {r.page_id: r for r in html.extract(df).collect()}
    assert len(out) == len(rows)
    assert out[1].text == out[2].text == out[7].text == out[8].text == ""
    assert out[3].text == "just text & boldface here"
    assert out[4].text == "a b é <p>"
    assert out[5].text == "unclosed\ntwo\nx\ny"
    assert out[6].text == "x" and out[None].text == "z"
    assert out[9].text.replace("\n", " ").split()[-1] == "c"
    assert out[10].n_chars == 200_000 * 5 - 1
    assert out[12].text == "T\nb"
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def alone(text):
    """The article of a page whose host has no template."""
    page = html.Page(text)
    boxes = [{"parent": b.parent, "h": b.h, "main": b.main, "named": b.named} for b in page.boxes]
    return html.article([{"text": t, "h": page.tokens[at], "box": box} for t, at, box in page.blocks], boxes, set(), None)


def test_code_in_raw_elements_is_no_markup():
    for code in ("for(i=0;i<n;i++){f()}", 'if(a<b)c="x";', "if(a<b)c='", "x='</scripts>';<!-- "):
        assert alone(f"<body><SCRIPT>{code}</Script\n><article><p>one</p><script>{code}</script><p>two</p></article><script>{code}</script></body>") == ["one", "two"], code


def test_an_article_in_several_boxes():
    for parts in ("<div><p>one</p></div><div><p>two two</p></div>", "<section>one</section><div><section>two two</section></div>", "<article>one</article><article>two two</article>"):
        assert alone(f"<body><nav>menu</nav><div>{parts}</div><footer>end</footer></body>") == ["one", "two two"], parts


def test_markup_and_names():
    assert alone("<p data-x=it's>Hello <b>one</b></p><p title='a>b' x = \"'>\">two</p>") == ["Hello one", "two"]
    for name in ("discussion-point", "search-results-table", "share-price", "notice-period"):
        assert alone(f"<article><p>a</p><div class={name}>kept</div></article>") == ["a", "kept"], name
    for name in ("share-buttons", "comments", "cookie-notice", "ad", "big sidebarWidget"):
        assert alone(f"<article><p>a</p><div class='{name}'>gone</div></article>") == ["a"], name
    assert alone("<body><div><h1>Head</h1><p>first</p><section>a much longer section of text</section></div></body>") == ["Head", "first", "a much longer section of text"]
    assert alone("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>") == ["let x=2 be"]


def site(rng, n, open_, close):
    """Pages whose boilerplate has neither telling elements nor names."""
    rows, want = [], []
    for k in range(n):
        paras = [words(rng, rng.randint(10, 40)) for _ in range(rng.randint(2, 5))]
        teasers = "".join(f"<li><a href=/>{words(rng, 4)}</a></li>" for _ in range(rng.randint(2, 5)))
        body = "".join(f"<p>{p}</p>" for p in paras)
        rows.append(f"<body><div class=t0p><p>The daily letter of the valley</p></div>{open_}{body}<p>All rights are with the writers</p>{close}<div class=x7><p>More from here</p><ul>{teasers}</ul></div></body>")
        want.append("\n".join(paras))
    return rows, want


def test_results_are_worse_without_templates(spark, monkeypatch):
    """On pages with and without an article element."""
    rng = random.Random(11)
    for tags in (("<article>", "</article>"), ("<div class=col>", "</div>")):
        pages, want = site(rng, 10, *tags)
        df = spark.createDataFrame([(k, f"http://s.example/{k}", h) for k, h in enumerate(pages)], SCHEMA)
        got = {r.page_id: r.text for r in html.extract(df).collect()}
        assert [got[k] for k in range(10)] == want, tags
        with monkeypatch.context() as m:
            m.setattr(html, "SUPPORT", 1000)
            bare = {r.page_id: r.text for r in html.extract(df).collect()}
        assert all(bare[k] != want[k] for k in range(10)), tags


def test_a_box_of_a_name_inside_the_article_needs_the_template(spark):
    rng = random.Random(12)
    rows = []
    for k in range(8):
        odd = "<div class=related>see the third part</div>" if k == 3 else ""
        rows.append((k, f"http://n.example/{k}", f"<body><article><p>{words(rng, 60)}</p>{odd}<div class='share-buttons'>by {words(rng, 2)}</div></article></body>"))
    got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [len(got[k]) for k in range(8)] == [1, 1, 1, 2, 1, 1, 1, 1] and got[3][1] == "see the third part"


def test_classes_against_brute_force(spark):
    """Classes from whole occurrence vectors, page by page."""
    rng = random.Random(13)
    pages, _ = site(rng, 9, "<article>", "</article>")
    df = spark.createDataFrame([(k, "http://b.example/", h) for k, h in enumerate(pages)], SCHEMA)
    got: dict = {}
    for r in html.templates(html.parse(df)).collect():
        got.setdefault(r["class"], set()).add(r["h"])
    counts = [html.Page(h).tokens for h in pages]
    vectors: dict = {}
    for h in {t for c in counts for t in c}:
        vectors.setdefault(tuple(c.count(h) for c in counts), set()).add(h)
    often = lambda v: sum(x > 0 for x in v)
    want = [hs for v, hs in vectors.items() if often(v) >= html.SUPPORT and often(v) >= html.SHARE * 9 and len(hs) >= html.SIZE]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and want
