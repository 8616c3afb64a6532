import html
import re

from opsloom.llm.html_extract import extracted, main_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
%s
<aside>other stories</aside><div id="sidebar"><p>side</p></div><div class="ad">buy</div>
<form><label>Mail</label><input></form><footer>&copy; x</footer></body></html>"""


def test_article_without_what_is_around_it():
    article = """<article><header><h1>Head &amp;  line</h1></header><p>First<br>line &lt;b&gt;&nbsp;<b>bold</b>
    <p>Second <a href="x">link</a><ul><li>one<li>two</ul><div class="share-buttons">share</div>
    <!-- no <p>x</p> --><script>if (a < b) { document.write("<p>no</p>") }</script>
    <section id="comments"><article class="comment"><p>reader</p></article></section></article>"""
    assert main_text(PAGE % article) == "Head & line\nFirst line <b> bold\nSecond link\none\ntwo"


def test_undeclared_article_by_density():
    body = "<div class='content'>" + "".join(f"<p>{'words of the text ' * 9}{i}</p>" for i in range(4)) + "<p>Short end.</p></div>"
    got = main_text(PAGE % body).split("\n")
    assert len(got) == 5 and got[0].endswith("text 0") and got[-1] == "Short end."
    links = "<div>" + "".join(f"<p><a href='{i}'>{'a link to elsewhere ' * 6}</a></p>" for i in range(9)) + "</div>"
    assert "link" not in main_text(PAGE % (links + "<div></div>" * 5 + body))


def test_wrappers_named_like_what_is_cut_stay():
    article = "<article><header><h1>Head</h1></header><p>Text of the article.</p></article>"
    for wrapper in ("class='layout with-sidebar'", "id='page' class='no-sidebar'", "class='left'", "class='right-sidebar'", "id='page' class='comments-open'"):
        aside = "<div class='sidebar'><p>Other things on the side</p></div><div class='related'><article>Teaser</article></div>"
        assert main_text(PAGE % f"<div {wrapper}>{article}{aside}</div>") == "Head\nText of the article.", wrapper
    body = "".join(f"<p>{'words of the text ' * 9}{i}</p>" for i in range(4))
    assert main_text(PAGE % f"<div class='main left'>{body}<div class='left'>menu</div></div>").count("words of") == 36
    teasers = "<div class='sidebar'><article>Teaser</article></div>"
    assert "Teaser" not in main_text(PAGE % (body + teasers))
    comments = f"<div id='comments'>{body}{body}</div>"
    assert main_text(PAGE % (article + comments)) == "Head\nText of the article."


def test_lines_of_links_between_lines_of_text_stay():
    body = [f"<p>{'words of the text ' * 9}{i}</p>" for i in range(4)]
    link = "<p><a href='x'>a source of what is said</a></p>"
    got = main_text(PAGE % ("<div>" + link + body[0] + body[1] + link + body[2] + body[3] + link + "</div>")).split("\n")
    assert len(got) == 5 and got[2] == "a source of what is said"


def test_broken_and_empty_pages():
    assert [main_text(h) for h in (None, "", "<", "<p", "</", "<!--", "<script>x", "<nav>a")] == [""] * 8
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<article><p>cut</p><p cla") == "cut"
    assert main_text("just text") == "just text"
    assert main_text("<main><p>a</main>") == "a"
    assert main_text("<article>" + "<p>x</p>" * 50_000).count("x") == 50_000


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extracted(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for page in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", page["html"], re.S)[1]
        article = re.sub(r"<[^>]*\Z", "", article)
        parts = (re.sub(r"<[^>]+>", " ", part) for part in re.split(r"</?(?:p|h1)>", article))
        parts = [" ".join(html.unescape(part).split()) for part in parts]
        expected = "\n".join(part for part in parts if part)
        assert got[page["page_id"]]["text"] == expected and got[page["page_id"]]["n_chars"] == len(expected)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (1, None, ""), (2, "u", "<article>é\U0001f600</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'own' AS text", "1 AS n_chars")
    got = sorted(map(str, extracted(pages).collect()))
    assert len(got) == 4 and got[-1] == "Row(page_id=None, url=None, text='', n_chars=0)"
    assert "text='é\U0001f600', n_chars=2" in got[2]
    assert extracted(pages.limit(0)).count() == 0
