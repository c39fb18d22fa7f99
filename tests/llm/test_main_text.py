import random
import time

import pytest

from blotter.llm.main_text import best_region, extract, learn_weights, main_text, weights_of

WEIGHTS = weights_of({})
BODY = "<p>One two &amp; three\n  four.</p><p>Five <a href=x>six</a> seven<br>eight.</p>"
TEXT = "One two & three four.\nFive six seven eight."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a>Home</a></nav><article><h1>Head line</h1>{BODY}</article><footer>&copy; me</footer>", "Head line\n" + TEXT),
        (f"<body><div class='menu'><a>x</a> <a>y</a></div><div>{BODY}</div><div id=comments>I say so</div><aside>more</aside>", TEXT),
        (f"<main>{BODY}<div class='ad banner'>Buy <div>now</div> this</div><p>Nine.</p></main>", TEXT + "\nNine."),
        (f"<article>{BODY}<section class=comments><p>Reader says a lot of things here.</p></section></article>", TEXT),
        (f"<article><form>Name <input> <b>send</b></form>{BODY}<!-- <p>no</p> -->", TEXT),
        (f"<div class='page no-sidebar'>{BODY}</div><div class='related-posts'><p>Other things to read.</p></div>", TEXT),
        ("", ""), ("<html></html>", ""), ("plain words only", "plain words only"), ("<p><b>a<p>b", "a\nb"), ("<article>x &lt;b&gt; &am", "x <b> &am"),
    ],
)
def test_pages(page, text):
    assert extract(page, WEIGHTS) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<head><script>for(var i=0;i<n;i++){{s+=i}}</script></head><article>{BODY}</article><script>x()</script>", TEXT),
        (f"<body><SCRIPT>if(a<b&&c)document.write('<script src=x>')</SCRIPT ><div>{BODY}</div>", TEXT),
        (f"<style>a<b 'c{{}}</style><div>{BODY}</div>", TEXT),
        (f"<title>Never closed<body><div>{BODY}</div>", TEXT),
        (f"<body><svg><path d=x><div>{BODY}</div>", TEXT),
        (f"<body><button>Go<div>{BODY}</div><button>Go</button>", TEXT),
        (f"<div>{BODY}</div><script>for(;i<n;) '<p>no text</p>'", TEXT),
    ],
)
def test_unseen_elements_end_at_their_own_end(page, text):
    assert extract(page, WEIGHTS) == text


@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>{}</form>", "<div class='page right-sidebar'>{}</div>", "<div id=social><div class=search>{}</div></div>", "<section class=notice>{}"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main><div class='social'>{}</div></main>", "<div>{}</div>"])
def test_wrappers_are_no_parts(wrapper, inner):
    around = "<nav><a>Home</a></nav>{}<div class=sidebar>Not this</div><footer>nor that</footer>"
    assert extract("<body>" + wrapper.format(around.format(inner.format(BODY))), WEIGHTS) == TEXT


def test_small_and_inner_parts_stay_parts():
    assert extract(f"<main>{BODY}</main><aside><article>A card</article></aside><div hidden><article>B</article></div>", WEIGHTS) == TEXT
    assert extract(f"<div>{BODY}</div><footer>{'legal words ' * 90}</footer>", WEIGHTS) == TEXT
    assert extract(f"<aside><main>{BODY}</main></aside>", WEIGHTS) == TEXT


def test_table_of_pages(spark):
    pages = [(i, "u", f"<nav><a>m {i}</a></nav><article>{BODY}<p>{i}</p></article><footer>f</footer>", "t") for i in range(40)]
    pages += [(100, None, None, "t"), (101, "u", "", "t"), (0, "u", pages[0][2], "t"), (None, "u", "<article>" + "<p>long text</p>" * 5000, "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    weights = learn_weights(df)
    assert weights["word:main"] > 0 > weights["tag:aside"] and weights["tag:p"] < 0
    found = {r.page_id: r.text for r in main_text(df, weights).collect()}
    assert found[7] == TEXT + "\n7" and found[100] == found[101] == "" and found[None].count("\n") == 4999
    assert main_text(df, weights).count() == len(pages)
    none = df.limit(0)
    assert main_text(none, learn_weights(none)).count() == 0


LONG = "<p>" + "Many words make a text of some length, " * 8 + "and end.</p>"
SAID = "Many words make a text of some length, " * 8 + "and end."


def test_content_beside_cards():
    cards = "".join(f"<article><h3><a href=/{i}>Card {i}</a></h3><p>Read on about it.</p></article>" for i in range(3))
    assert extract(f"<body>{cards}<div id=content>{LONG}</div>{cards}</body>", WEIGHTS) == SAID
    assert extract(f"<article><h1>Title</h1><div class=content>{LONG}</div></article>", WEIGHTS) == "Title\n" + SAID


def test_all_articles_of_a_page():
    between = "<div>" + "plain words " * 100 + "</div>"
    assert extract(f"<article>{LONG}</article>{between}<article>{BODY}</article>", WEIGHTS) == SAID + "\n" + TEXT


@pytest.mark.parametrize("odd", ["<img alt=\"a\"b\">", "<img alt='it's'>", "<a title=\"x\"\">y</a>".replace("y", ""), "<br data-x = \"a>b\">"])
def test_odd_quotes(odd):
    assert extract(f"<article>{odd}{BODY}</article>", WEIGHTS) == TEXT


@pytest.mark.parametrize("piece", ["<a ", "<!", "<a x=\">\" ", "<button>", "<", "</", "<p class='"])
def test_broken_markup_takes_linear_time(piece):
    def seconds(n):
        start = time.process_time()
        extract(piece * n + "</button>", WEIGHTS)
        return time.process_time() - start

    assert seconds(80_000) < 10


def test_best_region():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.randint(-4, 3) for _ in range(rng.randint(0, 12))]
        first, end = best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
        assert sum(scores[first:end]) == max(0, best)


def test_learning_and_scan_decide_without_article(spark):
    menu = "<ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul>"
    pages = [(i, "u", f"<nav>{menu}</nav><main><h1>Head line</h1>{LONG}<p>Short one.</p></main><footer><p>&copy; Site {i}</p></footer>") for i in range(60)]
    df = spark.createDataFrame(pages + [(100 + i, "u", "<div>none</div>") for i in range(600)], "page_id long, url string, html string")
    weights = learn_weights(df)
    page = f"<body><ul><li>Home</li><li><a href=/b>About</a></li></ul><div><h1>Head line</h1>{LONG}<p>Short one.</p></div><p>&copy; Site 7. All rights reserved.</p></body>"
    assert extract(page, weights) == f"Head line\n{SAID}\nShort one."
    assert extract(page, WEIGHTS) != extract(page, weights)
    assert extract("plain words only", weights) == "plain words only"
    few = learn_weights(df, labelled_pages=60)  # the bound is of labelled pages, however many others there are
    assert few == weights


def test_comments_without_article():
    page = f"<body><div>{BODY}</div><div><h3>3 Comments</h3><ol><li>I say so.</li></ol></div></body>"
    assert extract(page, WEIGHTS) == TEXT
    assert extract(f"<article>{BODY}<h2>Comments</h2><p>On the law.</p></article>", WEIGHTS) == TEXT + "\nComments\nOn the law."
