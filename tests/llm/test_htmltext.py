"""Main text on the driver's pages and on layouts that the trees have not seen."""

import html
import re

import numpy as np
import pytest

from tidemark.llm import htmltext

from .cases import prose

FOLDER = "/root/testdata/sf0.01"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x", "x") for k, u, h in rows], "page_id long, url string, html string, text string, label string")


def test_driver_pages(spark):
    source = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.main_texts(source, limit=60).collect()}
    right = 0
    for r in source.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        right += got[r.page_id] == "\n".join(x for x in blocks if x)
    assert right >= 0.99 * len(got)


def test_unseen_layouts(spark):
    """Trees from the driver's pages leave out menus, comments, notices, adverts and forms of other layouts."""
    teach = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html", "url", "url").toDF("page_id", "url", "html", "text", "label")
    parts = [prose(i, 70) for i in range(8)]
    page = (f"<html><body><div id=top-header>Site <a href=/>home</a></div><ul class='main-menu'><li><a>One</a><li><a>Two</a></ul>"
            f"<div class='post-content'><h2>Title &amp; more</h2><p>{parts[0]}<p>{parts[1]}</p><div class='ad'>{parts[2]}</div>"
            f"<blockquote>{parts[3]}</blockquote><script>var x='<p>no</p>'</script></div>"
            f"<section class='comments'><p>{parts[4]}</p><p>{parts[5]}</p></section><div class='sidebar'><p>{parts[6]}</p></div>"
            f"<div class='cookie-notice'>{parts[7]}</div><form class='subscribe'><p>Your mail</p></form></body></html>")
    extra = pages(spark, [(-1, "u", page), (-2, None, None), (-3, "u", ""), (-4, "u", "<p"), (-5, "u", "<!-- open"), (-5, "u", "<!-- open")])
    got = {r.page_id: r.text for r in htmltext.main_texts(teach.unionByName(extra)).filter("page_id < 0").collect()}
    assert got[-1] == "\n".join(["Title & more", parts[0], parts[1], parts[3]])
    assert [got[k] for k in (-2, -3, -5)] == ["", "", ""]


def test_no_teacher_and_empty(spark):
    rows = [(1, "u", f"<div class=content><p>{prose(1, 50)}</p></div><div class=nav>x</div>"), (2, None, None)]
    got = {r.page_id: r.text for r in htmltext.main_texts(pages(spark, rows)).collect()}
    assert got == {1: prose(1, 50), 2: ""}
    assert htmltext.main_texts(pages(spark, rows).filter("false")).count() == 0


@pytest.mark.parametrize("source,tags", [
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["html", "body", "ul", "li", "li", "ul", "li", "li"]),
    ("<p>a<p>b</div><div>c", ["html", "body", "p", "p", "div"]), ("<table><tr><td>a<td>b<tr><td>c</table>x", ["html", "body", "table", "tr", "td", "td", "tr", "td", "#run"]),
    ("<html><body>\n<p>a</p> \n bare <b>bold</b><br>more<div>b</div>tail</body></html>", ["html", "body", "p", "#run", "div", "#run"])])
def test_implied_ends(source, tags):
    assert htmltext.Page(source).tag == tags


def test_decoding_is_consistent_and_best():
    """Against all assignments of a small tree whose states never fall from parent to child."""
    page = htmltext.Page("<div><section><p>a</p><p>b</p></section><aside>c</aside></div><div>d</div>")
    n = len(page.tag)
    pick = np.random.default_rng(0)
    for _ in range(30):
        p = pick.uniform(0.05, 0.95, n)
        value = np.column_stack([np.log1p(-p), np.log(p), np.log1p(-p)])
        best, stack = -np.inf, [[]]
        for i in range(n):
            stack = [s + [k] for s in stack for k in range(s[page.parent[i]] if i else 0, 3)]
        best = max(sum(value[i, k] for i, k in enumerate(s)) for s in stack)
        got = htmltext.decoded(page, p)
        assert all(got[i] >= got[page.parent[i]] for i in range(1, n))
        assert abs(sum(value[i, k] for i, k in enumerate(got)) - best) < 1e-9


def test_deep_and_unclosed():
    text = htmltext.Page("<div>" * 20000 + "x").segments
    assert text[-1][1] == "x"
    assert htmltext.Page('<a title="' + "x" * 100_000 + "<p>y").segments


def test_quoted_values_of_any_length():
    shown = lambda source: [t for n, t, _ in htmltext.Page(source).segments if n >= 0]
    for size in (100, 9_000, 3_000_000):
        for q, other in ("\"'", "'\""):
            value = "x" * size + f"<b>leak</b> <p class={other}y{other}>leaked text</p>"
            page = htmltext.Page(f"<article><div data-json = {q}{value}{q} class='post'>seen</div></article>")
            assert [t for n, t, _ in page.segments if n >= 0] == ["seen"] and page.tag == ["html", "body", "article", "div"]
    # A stray quote opens nothing, and neither does one that nothing closes.
    far = "w " * 10_000
    assert shown(f'<p title="5"">{far}</p><p id="z">b</p>') == [far, "b"]
    assert shown(f"<p title=5'>{far}</p><p it's>b</p>") == [far, "b"]
    assert shown(f'<p title="5>{far}</p>') == [far]


def words(text):
    return re.findall(r"\w+", text)


def layouts():
    """Hand-made pages without article or main, and the text that a reader would call the article."""
    a, out = [prose(100 + i, 60) for i in range(40)], []
    nav = "<ul class='nav'><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul>"
    foot = "<div id='footer'><p>Copyright 2020. All rights reserved.</p></div>"
    side = f"<div class='sidebar'><h3>Related</h3><p>{a[30]}</p></div>"
    talk = f"<div id='comments'><p>{a[31]}</p><p>{a[32]}</p></div>"
    out.append((f"<html><body><h1>Title</h1>{a[0]}<br><br>{a[1]}</body></html>", ["Title", f"{a[0]} {a[1]}"]))
    out.append((f"<html><body class=\"article\"><div><p>{a[2]}</p><p>{a[3]}</p></div></body></html>", [a[2], a[3]]))
    out.append((f"{a[4]}\n\n{a[5]}", [f"{a[4]} {a[5]}"]))
    out.append((f"<body>{nav}<h1>Head</h1><p>{a[6]}</p><p>{a[7]}</p>{foot}</body>", ["Head", a[6], a[7]]))
    out.append((f"<body>{nav}<div><div><p>{a[8]}</p><p>{a[9]}</p></div></div>{side}{foot}</body>", [a[8], a[9]]))
    out.append((f"<html><body id='story'>{nav}{a[10]}<br><br>{a[11]}{talk}{foot}</body></html>", [f"{a[10]} {a[11]}"]))
    out.append((f"<div class='post'><p>{a[12]}</p><ul><li>{a[13]}</li><li>{a[14]}</li></ul></div>{talk}{foot}", [a[12], a[13], a[14]]))
    out.append((f"<body>{nav}<div class='content'><h2>Sub</h2>{a[15]}<p>{a[16]}</p></div>{side}</body>", ["Sub", a[15], a[16]]))
    out.append((f"<body><table><tr><td class='menu'>{nav}</td><td class='content'><p>{a[17]}</p><p>{a[18]}</p></td></tr></table>{foot}</body>", [a[17], a[18]]))
    out.append((f"<body><div class='cookie-notice'>{a[33]}</div><h1>Big</h1><div>{a[19]}</div><div>{a[20]}</div>{talk}</body>", ["Big", a[19], a[20]]))
    out.append((f"<html><body><p>{a[21]}</p><p>{a[22]}</p><p>{a[23]}</p></body></html>", [a[21], a[22], a[23]]))
    out.append((f"<body>{nav}<section class='story'><p>{a[24]}</p><div class='ad-slot'>{a[34]}</div><p>{a[25]}</p></section>{side}{talk}{foot}</body>", [a[24], a[25]]))
    return out


def test_layouts_without_article_or_main(spark):
    """Recall and precision over the words of hand-made layouts; the first three give their whole text."""
    teach = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html", "url", "url").toDF("page_id", "url", "html", "text", "label")
    made = layouts()
    extra = pages(spark, [(-1 - i, "u", h) for i, (h, _) in enumerate(made)])
    got = {r.page_id: r.text for r in htmltext.main_texts(teach.unionByName(extra)).filter("page_id < 0").collect()}
    found = total = shown = 0
    for i, (_, want) in enumerate(made):
        text, right = words(got[-1 - i]), words(" ".join(want))
        common = len(set(text) & set(right))
        print(i, round(common / len(set(right)), 2), round(common / max(1, len(set(text))), 2))
        found, total, shown = found + common, total + len(set(right)), shown + len(set(text))
        if i < 3:
            assert [" ".join(x.split()) for x in got[-1 - i].split("\n")] == want
    print("recall", found / total, "precision", found / shown)
    assert found / total >= 0.9 and found / shown >= 0.9


def test_no_teacher_and_no_names(spark):
    """Where nothing can teach and nothing is named, all but named clutter is text."""
    rows = [(1, "u", "just text"), (2, "u", "<body><p>a</p><div class='sidebar'>b</div><div>c</div></body>"), (3, "u", "<body class='article'>x<nav>y</nav></body>")]
    assert {r.page_id: r.text for r in htmltext.main_texts(pages(spark, rows)).collect()} == {1: "just text", 2: "a\nc", 3: "x"}


def test_marks_of_a_page_are_no_labels():
    """Only marks that the teacher sets are labels, whatever a page brings."""
    made = htmltext.teaching_pages('<body><article><p data-keep="0">a b c d e f</p></article><div data-keep="1">z</div></body>', 1)
    page = htmltext.Page(made[0])
    told = dict(zip(page.tag, htmltext._labelled(page)))
    assert told["p"] == 1 and told["div"] == 0 and len(made) == 3


def test_a_very_long_page(spark):
    part = "<p>" + prose(7, 40) + "</p>"
    body = part * 20_000
    page = f"<html><body><div class='content'>{body}</div></body></html>"
    got = htmltext.main_texts(pages(spark, [(1, "u", page)])).first().text
    assert got == "\n".join([prose(7, 40)] * 20_000)
