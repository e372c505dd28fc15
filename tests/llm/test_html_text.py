import random
import time
from itertools import combinations

import pytest

from obslab.llm import html_text as ht

PAGES = "page_id bigint, url string, html string"


def text_of(page):
    return ht.difference(ht.lines_of(page), None)


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>T</title></head><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four</article><footer>f</footer>", "A & B\none two three\nfour"),
    ("<article><p>x &lt;p&gt; &eacute;&#233; &amp y</p><script>var a='</p>';</script><p class='ad'>buy</p><p>z", "x <p> éé & y\nz"),
    ("<body><header>top</header><main><p>m</p></main><aside>s</aside><form>f<input></form><div id=cookie-notice>c</div><section class='comments'><p>r</p></section><p>last", "m\nlast"),
    ("<article><header><h1>Title</h1></header><p>body</p><div class=share>s</div></article><p>after</p>", "Title\nbody"),
    ("plain text", "plain text"), ("", ""), ("<p>", ""), ("a < b <!-- c --> d <![CDATA[e]]>", "a < b d"), ("<div class=\"ad\"><div>x</div>y</div>z", "z"),
    ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>", "one\ntwo\nc1\nc2"), ("<p title='>'>q</p>", "q"), ("<script>never closed <p>x", ""),
])
def test_blocks(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("page, want", [
    ("<div class='has-sidebar'><article><p>a</p></article></div>", "a"), ("<div class='layout-with-sidebar no-sidebar'><p>a</p></div>", "a"),
    ("<div id=search-results><p>a</p></div><p class='social-science'>b", "a\nb"),
    ("<article><p>a</p><section id='related-work'><p>b</p></section></article>", "a\nb"),
    ("<article><p>a</p></article><article class='comment'><p>b</p></article><article class=promo><p>c</p></article>", "a"),
    ("<div class='wide sidebar'><nav>n</nav><div class=widget><article><p>a</p></article></div></div><p class=ad>x", "a"),
    ("<form id=search><main><p>a</p></main></form><form><p>f</p></form>", "a"), ("<p>a</p><div class=widget><p>b</p></div>", "a"),
    ("<article><p>a</p></article><div class='comments'><article class='comment'><p>b</p></article></div>", "a"),
    ("<article><p>a</p><div id='comments'><article><p>b</p></article></div></article>", "a"),
    ("<div class='cookie_notice'>c</div><div class='Site-Header'>h</div><p>a", "a"),
])
def test_furniture_is_named_by_whole_names_and_never_holds_the_article(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("seed", range(30))
def test_shared_lines_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 7))] for _ in range(2))
    longest = max(n for n in range(len(a) + 1) if any(_inside(c, b) for c in combinations(a, n)))
    got = sorted(ht.shared(a, b))
    assert len(got) == longest and _inside([a[i] for i in got], b)


def _inside(s, t):
    it = iter(t)
    return all(x in it for x in s)


@pytest.mark.parametrize("page, want", [
    ("<main><p>The long main story.</p><article class=teaser-card>short teaser</article></main>", "The long main story."),
    ("<main><p>The long main story.</p><article><p>short</p></article><article>cut</article></main>", "The long main story."),
    ("<main><p>intro</p><article><p>the long article</p></article><p>a thread of comments, longer than the article</p></main>", "the long article"),
    ("<article class='card'><p>only card</p></article>", "only card"), ("<p>story</p><article class='post-preview'>p</article>", "story"),
    ("<article class='card'><p>the only article</p></article><div>(c) us</div>", "the only article"),
    ("<article class=post><p>a</p><article class=teaser>t</article><p>b</p></article>", "a\nb"),
])
def test_articles_that_are_cards_do_not_replace_the_story(page, want):
    assert text_of(page) == want


def test_articles_keep_formulas_labels_and_fallbacks():
    inside = "<p>Sum <math><mi>x</mi></math> <label>word</label> <object>o</object> <noscript>n</noscript> <svg><text>t</text></svg></p>"
    assert text_of(f"<svg><text>logo</text></svg><noscript>no</noscript><label>l</label><article>{inside}</article>") == "Sum x word o n t"


@pytest.mark.parametrize("page, want", [
    ('<p>one <b title="x>y</b> two</p>', "one y two"), ("<p>a</p><b it's>c</b>", "a\nc"), ('<a href="p>q</a> "r <i>s</i>', "s"),
    ("<p>a < b</p><p>c <d", "a < b\nc <d"), ("<head><p>x", "x"), ("<p>a</p><!x", "a\n<!x"),
])
def test_quotes_and_tags_that_nothing_closes(page, want):
    assert text_of(page) == want


def _seconds(work):
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a "> " ', "<head>", "<!x ", "<script>", "<div><div class=nav><main></b>"])
def test_odd_pages_take_time_in_proportion(piece):
    assert _seconds(lambda: ht.lines_of(piece * 40_000)) < 15


def test_equal_lines_are_aligned_fast_and_rightly():
    assert _seconds(lambda: ht.shared([str(i % 50) for i in range(10_000)], [str(i * 7 % 50) for i in range(10_000)])) < 15
    assert len(ht.shared(["x"] + ["a"] * 5000 + ["y"], ["z"] + ["a"] * 4000)) == 4000


def test_pages_without_article_lose_what_their_neighbour_has(shipped):
    def page(body):
        return f"<div>Site name</div><div>Home of things</div><p>{body}</p><div>All about us</div>"

    rows = [(1, "https://a.org/x/1", page("first story")), (2, "https://a.org/x/2?q=1", page("second story")), (3, "http://A.org/y/9#z", page("third story")),
            (4, "https://b.org/x/1", page("alone")), (5, None, None), (6, None, ""), (7, "https://c.org/", page("same")), (7, "https://c.org/", page("same"))]
    got = {(r.page_id, r.url): r for r in ht.main_text(shipped.createDataFrame(rows, PAGES).coalesce(1)).collect()}
    assert got[(1, rows[0][1])].text == "first story" and got[(2, rows[1][1])].text == "second story" and got[(3, rows[2][1])].text == "third story"
    assert got[(4, rows[3][1])].text == "Site name\nHome of things\nalone\nAll about us"
    assert got[(5, None)].text == "" and got[(5, None)].n_chars == 0 and got[(6, None)].text == ""
    assert got[(7, rows[6][1])].text.split("\n")[2] == "same"
    assert len(ht.main_text(shipped.createDataFrame(rows, PAGES)).collect()) == len(rows)


def test_articles_that_are_copies_stay_whole(shipped):
    page = "<nav>n</nav><article><p>one two three</p><p>four</p></article>"
    rows = [(i, f"https://a.org/{i}", page) for i in range(5)]
    assert {r.text for r in ht.main_text(shipped.createDataFrame(rows, PAGES)).collect()} == {"one two three\nfour"}


def test_empty_table_clashing_columns_and_long_pages(shipped):
    assert ht.main_text(shipped.createDataFrame([], PAGES)).collect() == []
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    rows = shipped.createDataFrame([(1, "https://a.org/1", long)], PAGES).selectExpr("*", "'x' as _host", "'y' as _key", "1 as text", "2 as n_chars")
    assert ht.main_text(rows).first().n_chars == 20000 * 5 - 1


def test_the_neighbour_decides_on_every_article_as_a_whole():
    notice, quote = "<article><p>about this site</p></article>", "<p>a passage that many quote</p>"
    story = lambda word: f"<article><p>the {word} story of this page</p>{quote}<p>its {word} end</p></article>"
    lines = [ht.lines_of(page) for page in (story("first") + notice, story("second") + notice, story("first") + notice)]
    first = "the first story of this page\na passage that many quote\nits first end"
    assert ht.difference(lines[0], lines[1]) == first
    assert ht.difference(lines[0], lines[2]) == ht.difference(lines[0], None) == first + "\nabout this site"
    # A long article that the neighbour has too is not taken for a notice.
    assert ht.difference(ht.lines_of(story("first") + "<article>short</article>"), lines[0]) == first + "\nshort"


def test_lines_of_an_article_that_both_neighbours_have_are_the_hosts(shipped):
    quote, sign = "a passage that two pages quote", "all rights are ours"
    page = lambda word, *more: "<article>" + "".join(f"<p>{x}</p>" for x in (f"the {word} story of this page", *more, sign)) + "</article>"
    pages = [page("first", quote), page("second", quote), page("third"), page("fourth")]
    lines = [ht.lines_of(x) for x in pages]
    assert ht.difference(lines[1], lines[0], lines[2]) == f"the second story of this page\n{quote}"
    assert ht.difference(lines[1], lines[0]) == f"the second story of this page\n{quote}\n{sign}"
    # Near copies: what three pages have in common is more than the rest, and stays.
    copies = [ht.lines_of(f"<article><p>{'a long text that is copied ' * 5}</p><p>number {i}</p></article>") for i in range(3)]
    assert ht.difference(copies[1], copies[0], copies[2]).count("copied") == 5
    rows = [(i, f"https://a.org/{i}", x) for i, x in enumerate(pages)] + [(9, "https://b.org/1", pages[0])]
    got = {r.page_id: r.text for r in ht.main_text(shipped.createDataFrame(rows, PAGES).coalesce(1)).collect()}
    assert got[1] == f"the second story of this page\n{quote}" and got[2] == "the third story of this page"
    assert got[9].endswith(sign) and got[0].endswith(sign)
