import html as std
import re

from sanscope.llm import html_text as H

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
LONG = "Many words of the main article flow here, one after the other, to the end of the block. " * 4


def test_article_without_its_surroundings():
    page = (HEAD + NAV + "<div class='ad'>Buy this now, it is very cheap and very good for you.</div><!-- a comment -->"
            f"<article><h1>A &amp; B</h1><p>First&nbsp;block\n  with <b>bold<br>words</b>.</p><p>{LONG}<p>Short.</article>"
            "<aside>Side text</aside><section id='comments'><p>I like it. " + LONG + "</p></section>"
            "<form><p>Your name</p></form><footer>&copy; 2020 Somebody, all rights reserved.</footer>")
    assert H.main_text(page) == "\n".join(["A & B", "First block with bold words.", LONG.strip(), "Short."])


def test_page_without_article_element():
    page = (HEAD + NAV + "<div class='header-bar'><a href='/'>Logo</a></div><div id='page'><div id='content'><h2>Title of the text</h2>"
            f"<p>{LONG}</p><p>{LONG}</p><p>{LONG} <a href='x'>link</a></p></div><div class='sidebar'><p>{LONG}</p></div>"
            "<ul class='list'><li><a href='1'>one</a></li><li><a href='2'>two</a></li></ul></div><div class='cookie-notice'>" + LONG + "</div>")
    got = H.main_text(page)
    assert got == "\n".join(["Title of the text", LONG.strip(), LONG.strip(), LONG.strip() + " link"])


def test_broken_and_odd_markup():
    assert H.main_text("") == H.main_text("<html></html>") == H.main_text("<script>x</script><!--") == ""
    assert H.main_text("plain text\n only &lt;3") == "plain text only <3"
    assert H.main_text("<p>a < b</p>") == "a < b"
    assert H.main_text("<article><p>one<div>two</div></p>three</article>") == "one\ntwo\nthree"
    assert H.main_text("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a b\nc"
    assert H.main_text("<article><p title='a>b'>x</p><p>&#233;&#x1F642;&nosuch;</p></article>") == "x\né🙂&nosuch;"
    deep = "<div>" * 20000 + "deep" + "</div>" * 20000
    assert H.main_text(deep) == "deep"


def test_density_sum_prefers_the_article():
    root = H.parse(f"<body><div id=a><p>{LONG}</p><p>{LONG}</p></div><div id=b><p>{LONG}</p></div><ul>"
                   + "<li><a href=x>" + "link text " * 9 + "</a></li>" * 9 + "</ul></body>")
    body = next(e for e in H._elements(root) if e.tag == "body")
    H.measure(body, H._share_of_links(body))
    by = {e.attrs.get("id"): e for e in H._elements(body) if e.attrs.get("id")}
    links = next(e for e in H._elements(body) if e.tag == "ul")
    assert by["a"].sum > by["b"].sum > links.sum


def test_forms_and_hints_around_or_inside_the_article():
    text = "\n".join(["Title", LONG.strip(), LONG.strip()])
    body = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    for wrap in ("<form id=aspnetForm>%s</form>", "<dialog open>%s</dialog>", "<div id=content class='social-share hidden-print'>%s</div>",
                 "<div class=has-sidebar>%s</div>"):
        assert H.main_text(HEAD + NAV + wrap % f"<article>{body}</article>") == text
        assert H.main_text(HEAD + NAV + wrap % f"<div>{body}</div>" + "<footer>Somebody</footer>") == text
    part = f"<section id=discussion><h2>Discussion</h2><p>{LONG}</p></section>"
    found = text + "\nDiscussion\n" + LONG.strip()
    assert H.main_text(HEAD + NAV + f"<article class='post tag-advertising'>{body}{part}</article>") == found
    assert H.main_text(HEAD + NAV + f"<div>{body}{part}<form><p>Your name</p></form></div>") == found
    rival = "<p>I like it. " + LONG + "</p>"
    for name in ("comments", "discussion", "cookie-consent"):
        assert H.main_text(HEAD + NAV + f"<article>{body}</article><section id={name}>{rival * 9}</section>") == text
    assert H.main_text(HEAD + NAV + f"<div>{body}</div><section id=comments>{rival * 9}</section>") == text


def test_densities_choose_within_article_and_main():
    part = [f"<h2>Part {k}</h2>" + f"<p>{LONG}</p>" * n for k, n in enumerate((3, 2))]
    texts = [f"Part {k}" + ("\n" + LONG.strip()) * n for k, n in enumerate((3, 2))]
    teaser = "<h3><a href='/x'>Another title</a></h3><p>A short summary.</p>"
    for around in ("%s", "<main>%s</main>", "<div id=page>%s</div>"):
        split = "".join(f"<article>{x}</article>" for x in part)
        assert H.main_text(HEAD + NAV + around % split) == "\n".join(texts)
        assert H.main_text(HEAD + NAV + around % (split + f"<div><article>{teaser}</article></div>" * 4)) == "\n".join(texts)
    reader = "".join(f"<article><p>A reader writes. {LONG}</p></article>" for _ in range(3))
    for own in (f"<p>{LONG}</p>", f"<h2>T</h2><div><p>{LONG}</p><p>{LONG}</p></div><p>Short end, <a href='/y'>a link</a>.</p>"):
        want = "\n".join(x for x in re.split("<[/]?(?:p|div|h2)>", re.sub("</?a[^>]*>", "", own).replace(" </p>", "</p>")) if x)
        assert H.main_text(HEAD + NAV + f"<article>{own}<section id=comments>{reader}</section></article>") == want
    for body in (part[0], f"<div>{part[0]}</div>", f"<h1>Title</h1><div>{part[0]}</div>"):
        got = H.main_text(HEAD + NAV + f"<main>{body}<div class=more>" + f"<div>{teaser}</div>" * 5 + "</div></main>")
        assert got == ("Title\n" if "h1" in body else "") + texts[0]


def plain(page):
    """Blocks of the article element, for pages that have one."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = (" ".join(std.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_query_matches_plain(spark, sf):
    from sanscope.llm.queries import QUERIES

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op5_html_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", None, "x"), (None, None, "<article><p>a</p></article>", "x"), (2, "u", "", "x"), (2, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in H.extract_pages(df).collect())
    assert got == [(0, "a", 1), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert H.extract_pages(df.limit(0)).count() == 0


def test_attributes_as_browsers_read_them():
    body = "<article><p>{}</p><p>" + LONG + "</p></article>"
    want = "x\n" + LONG.strip()
    for tag in ('<p class="x"">', "<p title=don't>", '<p title="a>b">', "<p title='a>b' checked>", '<p a = "b" c=d/e/ >', '<p "x">', "<p =x>",
                '<p title=a"b>', "<p a='>", '<p title="x"class="y">'):
        got = H.main_text("<article>" + tag + "x</p><p>" + LONG + "</p></article>")
        assert got == want, tag
    assert H.main_text(body.format("can't stop, won't")) == "can't stop, won't\n" + LONG.strip()
    link = H.parse("<a href=/x/>y</a><br/><b class=z />w").children
    assert link[0].attrs == {"href": "/x/"} and link[0].children == ["y"] and [c.tag for c in link[1:3]] == ["br", "b"]
    assert H.parse("<p id=a id=b ID=c>").children[0].attrs == {"id": "a"}


def test_hints_do_not_outweigh_density_inside_the_article():
    paragraphs = "".join(f"<p>{LONG}</p>" for _ in range(6))
    page = f"<body><article><p>{LONG}</p><p>{LONG}</p><div class='navigation-history'>{paragraphs}</div></article></body>"
    assert H.main_text(page) == "\n".join([LONG.strip()] * 8)
    page = f"<body><article><p>{LONG}</p><p class='related'>{LONG}</p><div class='related'><a href=x>{LONG}</a></div></article></body>"
    assert H.main_text(page) == "\n".join([LONG.strip()] * 2)
    page = f"<body><article><p>{LONG}</p><div class='comments'>{paragraphs}</div></article></body>"
    assert H.main_text(page) == LONG.strip()
