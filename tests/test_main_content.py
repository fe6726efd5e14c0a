"""Main content of pages: navigation, footers and side blocks go, siblings of the content stay."""

import pytest

from newsweave.functions.main_content import Page, lines

LONG = "The committee met on Tuesday, and after a long debate, most of its members agreed on a new plan for the harbour. "


def text_of(html):
    return "\n".join(lines(Page(html).content()))


def test_blog_page():
    page = f"""<html><head><title>T &amp; U</title><style>p {{}}</style></head><body>
      <div class="navbar"><a href="/a">Home</a> <a href="/b">World</a></div>
      <header><h1>Site name</h1></header>
      <div id="wrap"><div class="post-content"><h2>Harbour</h2><p>{LONG}</p><p>{LONG * 2}</p><ul class="share-buttons"><li><a href="#">Tweet this long long line</a></li></ul></div>
      <div class="sidebar"><p>{LONG}</p></div><div class="related-posts"><p>{LONG}<a href="/x">{LONG}</a></p></div>
      <div class="comments"><p>{LONG}</p></div></div>
      <footer><p>{LONG}</p></footer><script>var a = "<p>{LONG}</p>";</script></body></html>"""
    assert text_of(page).split("\n") == ["Harbour", LONG.strip(), (LONG * 2).strip()]
    assert Page(page).title == "T & U" and Page(page).links[0] == ("/a", "Home")


def test_links_weigh_against_a_block():
    hub = "".join(f'<p><a href="/s/{i}">{LONG}</a></p>' for i in range(9))
    page = f"<body><div>{hub}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert text_of(page) == "\n".join([LONG.strip()] * 2)


def test_siblings_of_the_best_block_stay():
    page = f"<body><p>{LONG}</p><div class='text'><p>{LONG * 3}</p><p>{LONG * 3}</p></div><p>Short end.</p><p><a href='/n'>Next</a></p><div class='text'><p>{LONG * 3}</p></div></body>"
    assert text_of(page).split("\n") == [LONG.strip(), (LONG * 3).strip(), (LONG * 3).strip(), "Short end.", (LONG * 3).strip()]


@pytest.mark.parametrize("page", ["", "<p></p>", "<nav>a</nav>", "<script>x</script>", "<!-- c -->"])
def test_pages_without_text(page):
    assert text_of(page) == ""


def test_page_without_paragraphs_gives_what_it_has():
    assert text_of("<nav>menu</nav>just <b>some</b> words<br>and more") == "just some words\nand more"


def test_tags_left_open_and_deep_nesting():
    assert text_of(f"<article><p><b>{LONG}<br><p>{LONG}<p>{LONG}</article><footer>f") == "\n".join([LONG.strip()] * 3)
    deep = text_of("<div>" * 20_000 + f"<p>{LONG}</p>")
    assert deep == LONG.strip()
    assert text_of("</div></p></article>" + f"<p>{LONG}</p>") == LONG.strip()


def test_class_names_that_only_contain_a_hint_stay():
    page = f'<div class="headlines shadow"><p>{LONG}</p><p>{LONG}</p></div>'
    assert text_of(page) == "\n".join([LONG.strip()] * 2)
