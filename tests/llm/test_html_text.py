"""Main text of pages: planted pages, edge cases, malformed markup."""

from mirepoix.llm.html_text import Tree, content, main_text, measure, with_main_text

STORY = ["The first   paragraph of the story &amp; more of it, long enough to matter.", "A second one, with <b>bold</b> and <a href='x'>a link</a> in it.", "And a third: caf&eacute; &#8212; done, at last, after many words."]
TEXT = "Head line\nThe first paragraph of the story & more of it, long enough to matter.\nA second one, with bold and a link in it.\nAnd a third: café — done, at last, after many words."


def page(article):
    return f"""<html><head><title>T</title><style>p {{}}</style></head><body><header><a href=/>Home</a></header>
      <nav><ul><li><a>One</a><li><a>Two</a></ul></nav>{article}<aside>Related things</aside><div class="comments"><p>Great post!</p></div>
      <form><input><button>Go</button></form><script>var x = "<p>no</p>";</script><footer>Copyright</footer></body></html>"""


def test_article():
    body = "<h1>Head\n line</h1>" + "".join(f"<p>{p}</p>" for p in STORY)
    assert main_text(page(f"<article>{body}</article>")) == TEXT
    assert main_text(page(f"<div id=content>{body}</div>")) == TEXT


def test_edges(spark):
    deep = "<div>" * 3000 + "<p>deep text here</p>" + "</div>" * 3000
    long = "<article>" + "<p>word word word</p>" * 30_000 + "</article>"
    rows = [(1, None), (2, ""), (3, "plain text"), (4, "<p>a<p>b"), (5, deep), (6, long), (7, "<"), (8, "<!-- x"), (9, "<p>a</b></i>b</p>"), (9, "<p>a</b></i>b</p>")]
    pages = spark.createDataFrame([(i, "u", h, 1, "old") for i, h in rows], "page_id bigint, url string, html string, n int, text string")
    found = with_main_text(pages)
    assert sorted(found.columns) == sorted(pages.columns)
    got = {r.page_id: r.text for r in found.collect()}
    assert found.count() == len(rows)
    assert (got[1], got[2], got[3], got[4], got[5], got[9]) == ("", "", "plain text", "a\nb", "deep text here", "ab")
    assert got[6] == "\n".join(["word word word"] * 30_000)
    assert with_main_text(pages.filter("page_id > 9")).count() == 0


def test_wrappers_with_telling_names():
    """Names about something else, and a marked wrapper of the whole page, drop nothing; marked parts go."""
    body = "<h1>Head\n line</h1>" + "".join(f"<p>{p}</p>" for p in STORY)
    for name in ("page has-sidebar", "comments-open", "post-header", "with-menu", "overlay", "share"):
        assert main_text(page(f'<div class="{name}"><div>{body}</div></div>')) == TEXT, name
    for name in ("sidebar", "site-header", "cookie-notice", "share-links", "ad_slot", "comments-list", "user-comments"):
        assert main_text(page(f'<div>{body}<div class="x {name}"><p>Something else here</p></div></div>')) == TEXT, name


def test_deep_pages():
    """However deep, scripts and menus go; unclosed elements too."""
    inside = "<script>var secret = 1;</script><nav>menu item</nav><p>good text here</p>"
    for opening in ("<div>", "<font>", "<span><div>"):
        assert main_text(opening * 3000 + inside) == "good text here"
    assert main_text("<font>" * 30_000 + "text" + "</b>" * 30_000) == "text"


def test_density_decides_without_an_article():
    """The subtree of the largest density sum, whatever its tag, against the sums computed from their definition."""
    links = "<ul>" + "<li><a href=x>short link</a></li>" * 30 + "</ul>"
    story = "".join(f"<p>{p}</p>" for p in STORY * 3)
    tree = Tree()
    tree.feed(f"<body><div>{links}</div><section>{story}</section><div>{links}</div></body>")
    tree.close()
    nodes = measure(tree.body)
    for node in nodes:
        below = [c for c in node.children if not isinstance(c, str)]
        assert node.sum == sum(c.density for c in below) + sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
    assert content(tree.body)[0].tag == "section"
    assert main_text(f"<body><div>{links}</div><section>{story}</section></body>").startswith("The first paragraph")


def test_column_names(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x", "y")], "page_id int, html string, `a.b` string, __html string")
    found = with_main_text(pages)
    assert found.columns == ["page_id", "html", "a.b", "__html", "text"] and found.head().text == "a"
