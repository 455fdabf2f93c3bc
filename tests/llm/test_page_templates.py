import random

from pyspark.sql import functions as F

from strainframe.llm import page_templates

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><p>no";</script><style>p{{}}</style></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><header><h1>Title {n}</h1></header><p>First &amp; <b>bo</b>ld {n}<br>line<p>Unclosed&nbsp;{n} &lt;tag&gt;
<div class="advert">Buy</div><form>field</form><p class=share>Share this</p><ul><li>one {n}<li>two</ul><section id="comments-2"><article>reader {n}</article></section></article>
<aside>side</aside><footer>foot</footer></body>"""
TEXT = "Title {n} First & bold {n} line Unclosed {n} <tag> one {n} two"


def texts(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"main_text": F.lit("old"), "Layout": F.lit(1), "host": F.lit("x"), "main_tokens": F.lit("y")})
    return {r["page_id"]: r["main_text"] for r in page_templates.main_text(pages, **options).collect()}


def test_marked_articles(spark):
    rows = [(n, f"https://Host.org/{n}", PAGE.format(n=n)) for n in range(6)] + [(9, "http://alone.org", PAGE.format(n=9))]
    for limit in (page_templates.BROADCAST_ROWS, 0):
        assert texts(spark, rows, broadcast_rows=limit) == {n: TEXT.format(n=n) for n in (*range(6), 9)}


def test_unmarked_pages_use_the_template(spark):
    page = '<body><div id="top">Welcome here</div><div id="content{n}"><p>Read on</p><p>{body}</p><p>end {n}</p></div><div class="bottom">Imprint</div></body>'
    rows = [(n, f"http://plain.org/{n}", page.format(n=n, body=f"story {n} " * 30)) for n in range(8)]
    expected = {n: f"{f'story {n} ' * 30}end {n}" for n in range(8)}
    assert texts(spark, rows) == expected  # "Read on" stands on every page once and belongs to the template


def test_classes_hold_equal_vectors(spark):
    rows = [(n, "http://h.org/", f"<body><div><h1>a{n}</h1><p>x{n}</p></div><ul>{'<li>i</li>' * (n + 1)}</ul></body>") for n in range(5)]
    tokens = page_templates.page_tokens(spark.createDataFrame(rows, "page_id long, url string, html string"))
    classes = page_templates.equivalence_classes(tokens).collect()
    elements = [r for r in classes if not r["is_text"]]
    assert len({r["class"] for r in elements}) == 1  # body, div, h1, p, ul once on every page; li varies and is in no valid class
    assert len(elements) == 6 and all(r["each"] == 1 and r["pages"] == 5 for r in classes)
    known = {r["token"] for r in elements}
    assert sum(r["parent"] in known for r in elements) == 5  # all but the outermost nest in another


def test_layouts_of_a_host_have_templates_of_their_own(spark):
    news = '<body class="page-{w}"><div id="top">Welcome all readers</div><div id="content"><p>{body}</p><p>end {n}</p></div><div class="low">Imprint and legal</div></body>'
    wiki = '<body><table id="frame"><tr><td>Random page</td></tr></table><div class="text"><p>{body}</p></div><div class="last">Edit this</div></body>'
    words = ["red", "blue", "green", "grey", "pink", "teal", "gold"]
    body = lambda n: " ".join(f"{words[(n + k) % 7]} story {n}" for k in range(30))
    rows = [(n, f"http://two.org/{n}", (news if n % 2 else wiki).format(n=n, w=words[n % 7], body=body(n))) for n in range(40)]
    assert texts(spark, rows) == {n: body(n) + (f" end {n}" if n % 2 else "") for n in range(40)}


def test_outlines_have_the_layout_of_the_page():
    dice = random.Random(3)
    parts = ["<div class=a>", "</div>", "<p>", "</p>", "text", "<b>", "</b>", "<nav>", "</nav>", "<article id=x>", "</article>", "<script>a</script>", "<br>", "<li>", "<ul>", "</ul>", "<body>", "<svg><path/></svg>", "<h1 hidden>"]
    for _ in range(500):
        source = "".join(dice.choice(parts) for _ in range(dice.randint(0, 40)))
        assert page_templates.Page(source, outline=True).layout() == page_templates.Page(source).layout()


def test_notices_repeated_inside_articles(spark):
    page = '<body><article class="post c{w}"><p>{body}</p><p>Join our mailing list today.</p><p>end {n}</p></article></body>'
    body = lambda n: " ".join(f"line {n} {k}" for k in range(40))
    for pages, notice in ((12, ""), (6, " Join our mailing list today.")):  # few articles may share a line by chance
        rows = [(n, f"http://m.org/{n}", page.format(n=n, w=n, body=body(n))) for n in range(pages)]
        assert texts(spark, rows) == {n: f"{body(n)}{notice} end {n}" for n in range(pages)}


def test_names_of_other_attributes_and_subjects(spark):
    kept = [
        '<div data-id="menu"><p>Real story</p></div>', '<div data-class="ad" class="story">Real story</div>', '<div title=" class=ad">Real story</div>',
        '<article class="post tag-advertising">Real story</article>', '<article class="comment-is-free">Real story</article>',
        '<div id="content" class="share-price-story">Real story</div>',
    ]
    gone = ['<p hidden>no</p>', '<div class="responses">no</div>', '<article class="comment-body">no</article>', '<div id=share-buttons>no</div>']
    rows = [(n, f"http://h{n}.org", f"<body>{x}</body>") for n, x in enumerate(kept)]
    rows += [(10 + n, f"http://g{n}.org", f"<body><article><p>Real story</p>{x}</article></body>") for n, x in enumerate(gone)]
    assert set(texts(spark, rows).values()) == {"Real story"}


def test_copies_keep_their_texts(spark):
    rows = [(n, f"http://copy.org/{n}", PAGE.format(n=1)) for n in range(6)]
    assert texts(spark, rows) == {n: TEXT.format(n=1) for n in range(6)}


def test_awkward_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "no host", "plain &amp; text"), (4, "http://x.org", "<p"), (5, "http://x.org", "<article></article>"),
        (6, "http://x.org", "<b>" * 2000 + "deep" + "</i>" * 50), (7, "http://x.org", "<p>" + "long " * 50_000 + "</p>"), (8, None, "<div class='ad'>x</div>y"),
        (None, "http://x.org", "a<br>b"),
    ]
    found = texts(spark, rows)
    assert found == {1: "", 2: "", 3: "plain & text", 4: "", 5: "", 6: "deep", 7: ("long " * 50_000).strip(), 8: "y", None: "a b"}
    assert texts(spark, rows[:2] * 3) == {1: "", 2: ""}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_templates.main_text(empty).count() == 0
