import random
from html import escape

import pytest

from tallyloom.llm import html_text
from tallyloom.llm.html_text import BLOCK_LINES, SURGE, extract, lengths, main_text, read, stretches


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<nav><a href=x>Home</a></nav><footer>&copy; me</footer>", ""),
        ("<article><h1> A\n title </h1><p>One<b>two</b><br>three&nbsp;four</p></article>", "A title\nOnetwo three four"),
        ("<body><nav>menu</nav><article><p>kept</p><aside>not</aside><p>kept too</p></article><div class='comments'>not</div></body>", "kept\nkept too"),
        ("<article><p>a</p><form><p>sign up</p></form><div class='newsletter'>no</div><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>b</p></article>", "a\nb"),
        ("<article><header><h1>T</h1></header><p>x &lt;b&gt; &#233; &#x1F600;</p></article><section class='related'><p>no</p></section>", "T\nx <b> é 😀"),
        ("<main><p>one<p>two<ul><li>a<li>b</ul></main>", "one\ntwo\na\nb"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<article><div class='comment-list'><p>reader says</p></div><div class='cookie-banner'>ok?</div><p>body</p></article>", "body"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_without_an_article_element():
    long = "This is a long sentence of the text that the page is about, with enough words to surge. " * 2
    html = f"<div><a href=1>Home</a> <a href=2>News</a></div><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a href=3>More</a></div>"
    assert main_text(html) == f"{long.strip()}\nShort.\n{long.strip()}"


def test_stretches_begin_and_end_where_windows_empty():
    assert stretches([0, 5, 0, 100, 90, 0, 0, 0, 3, 0], 80) == [(1, 5)]
    assert stretches([0, 0], 1) == [] and stretches([], 1) == []
    assert stretches([10, 0, 0, 0, 10], 5) == [(0, 1), (4, 5)]


def test_broken_markup_and_long_pages():
    assert main_text("<article><p>a</p><p>b < c and <") == "a\nb < c and <"
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    body = "".join(f"<p>paragraph {i} &amp; words</p>" for i in range(20_000))
    assert main_text(f"<article>{body}</article>") == "\n".join(f"paragraph {i} & words" for i in range(20_000))
    assert [x.text for x in read("<p>a<p>b</i></p>").lines] == ["a", "b"]


def test_table(spark):
    rows = [(1, "u", f"<article><p>{escape('é & <x>')}</p></article>", "t", 5), (1, "u", None, "t", 5), (None, None, "", "t", 5), (2, "v", "x", "t", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract(pages, "html", "page_id", "url").collect())
    assert got == [("1", "", 0), ("1", "é & <x>", 7), ("2", "x", 1), ("None", "", 0)]
    assert extract(pages.limit(0), "html", "page_id").count() == 0


TEXT = "A sentence of the article, which has some more words than others. "


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article class='post comments-open'>{}</article>", "{}"),
        ("<article class='hentry tag-legal'>{}</article><p>outside</p>", "{}"),
        ("<div class='content has-sidebar'><article>{}<div class='newsletter'>no</div></article></div>", "{}"),
        ("<div id='page' class='page-widget'><article>{}</article></div>", "{}"),
        ("<main><h1>T</h1><article class='comments-open'>{}</article></main>", "T\n{}"),
        ("<div class='widget'><article>{}</article></div><p>outside</p>", "{}"),
        ("<article>{}</article><div class='comments'><article class='comment'>{}{}</article></div>", "{}"),
        ("<article>{}</article><div class='related-posts'><article>teaser</article></div>", "{}"),
        ("<aside class='x-widget'><article>{}</article></aside>", ""),
    ],
)
def test_an_article_is_no_furniture_by_a_word_in_a_class(html, text):
    assert main_text(html.replace("{}", f"<p>{TEXT}</p>")) == text.replace("{}", TEXT.strip())


LONG = "A long sentence of the text that the page is about, with enough of words in it to surge by itself, as one says."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # an unnamed advert, notice and footer lie beside an article; a closing line and a reference link belong to the text
        ("<body><div>Buy it now, cheap and good.</div><article><p>{}</p></article><div>All of it is ours.</div></body>", "{}"),
        ("<div><p>{}</p><p>{}</p></div><div class='n'>A short notice.</div>", "{}\n{}"),
        ("<p>{}</p><div><a>One</a></div><div><a>Two</a></div><div><a>Three</a></div><p>So it ends.</p>", "{}\nSo it ends."),
        ("<div><p>{}</p><p><a>The reference</a></p></div><div><a>Home</a></div>", "{}\nThe reference"),
        ("<article><p>{}</p><section class='legal-analysis'><p>x</p></section></article>", "{}\nx"),
        ("<article><p>{}</p><aside>1</aside><aside>2</aside><aside>3</aside><aside>4</aside><p>End.</p></article>", "{}\nEnd."),
        ("<article><p>{}</p><ol class='comment-list'><li>{}</li></ol><div class='site-footer'>{}</div></article>", "{}"),
        ("<div class='col'><p>{}</p></div><div class='col'><p>So.</p></div><div class='rest'><p>No.</p></div>", "{}\nSo."),
        ("<div><h2>A heading of its own</h2></div><div class='b'><p>{}</p></div>", "A heading of its own\n{}"),
        ("<div><p>short</p></div>", "short"),
        ("<div><a>only</a> <a>links</a></div>", ""),
    ],
)
def test_hand_labelled_pages(html, text):
    assert main_text(html.replace("{}", LONG)) == text.replace("{}", LONG)


def test_without_windows_other_text_would_stay(monkeypatch):
    html = f"<body><div>Buy it now, cheap and good.</div><article><p>{LONG}</p></article><div>All of it is ours.</div></body>"
    assert main_text(html) == LONG
    monkeypatch.setattr(html_text, "stretches", lambda counts, surge: [(0, len(counts))])
    assert main_text(html) == f"Buy it now, cheap and good.\n{LONG}\nAll of it is ours."


def brute_stretches(counts, surge):
    """Groups of lines of which none is more than BLOCK_LINES from the next, if some window from one of their lines on reaches ``surge``."""
    groups = []
    for i, n in enumerate(counts):
        if n:
            if groups and i - groups[-1][-1] <= BLOCK_LINES:
                groups[-1].append(i)
            else:
                groups.append([i])
    return [(g[0], g[-1] + 1) for g in groups if any(sum(counts[i : i + BLOCK_LINES]) >= surge for i in range(g[0], g[-1] + 1))]


def test_stretches_by_grouping_lines():
    rng = random.Random(2)
    for _ in range(3000):
        counts = [rng.choice([0, 0, 0, 1, 20, 50, 90]) for _ in range(rng.randint(0, 25))]
        for surge in (0, 1, SURGE):
            assert stretches(counts, surge) == brute_stretches(counts, surge), counts


def test_the_whole_table_by_grouping_lines(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages, "html", "page_id").collect()}
    monkeypatch.setattr(html_text, "stretches", brute_stretches)
    monkeypatch.setattr(html_text, "_named", lambda one: 0)  # and no class is needed to tell that table's adverts
    for r in pages.collect():
        page = read(r.html)
        assert got[r.page_id] == main_text(r.html) and len(lengths(page)) > len(got[r.page_id].split("\n"))
