from glyphlake.llm import html_extract

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_an_article_must_hold_most_of_the_text():
    body = "<div class=text><p>the story of this page</p><p>and its end</p></div>"
    for article in ("<article></article>", "<article><a href=x>Teaser</a></article>", "<main></main>"):
        assert "the story of this page\n\nand its end" in html_extract.Page(f"<body>{article}{body}</body>").text({})
    assert html_extract.Page(f"<body><article>{body}</article><div>Short</div></body>").text({}) == "the story of this page\n\nand its end"


def test_importance_decides_inside_an_article(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><div><p>the story {i} of this page, {i * 7}</p></div><section>Read all our terms</section></article></body>"
    found = texts(spark, [(i, f"http://a.example/{i}", page(i)) for i in range(40)])
    assert found[3] == "Title 3\n\nthe story 3 of this page, 21"


def test_long_class_lists_tell_siblings_apart(spark):
    utilities = " ".join(f"a{i:02}-utility" for i in range(20))
    page = lambda i: f"<body><div class='{utilities} z-body'><p>the story {i}</p><p>it goes on {i * 7}</p></div><div class='{utilities} z-terms'><p>Read all our terms</p></div></body>"
    found = texts(spark, [(i, f"http://a.example/{i}", page(i)) for i in range(40)])
    assert found[3] == "the story 3\n\nit goes on 21"
