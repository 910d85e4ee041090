"""Main text of generated pages whose main text is known, odd class names, long and broken markup."""

import random
import time

import pytest
from pyspark.sql import functions as F

from featurelab.llm import html_text

ENGLISH = "This is the story of the river and of the people who lived by it for many years."


@pytest.mark.parametrize("page, want", [
    (f'<article class="post comments-open"><p>{ENGLISH}</p></article>', ENGLISH),
    (f'<main class="site-main no-sidebar"><p>{ENGLISH}</p></main>', ENGLISH),
    (f'<div class="content has-sidebar"><p>{ENGLISH}</p></div>', ENGLISH),
    (f'<div class="ad-free"><p>{ENGLISH}</p></div>', ENGLISH),
    (f'<div class="sidebar-wrapper"><p>{ENGLISH}</p></div><footer><p>Copyright</p></footer>', ENGLISH),
    (f'<body><form id="f"><div class="menu"><a href=x>Home</a></div><p>{ENGLISH}</p><p>End.</p></form></body>', f"{ENGLISH} End."),
    (f"<form><p>Your name</p></form><form><article><p>{ENGLISH}</p></article></form>", ENGLISH),
    (f"<form id=a><div class=site-header><p>{ENGLISH}</p></div><article><div class=page-header><p>One.</p></div>"
     f"<p>{ENGLISH}</p><div class=widget><p>{ENGLISH}</p></div></article></form>", f"One. {ENGLISH}"),
    (f"<article><p>See <a href=x>{ENGLISH}</a> and that.</p></article>", f"See {ENGLISH} and that."),
    (f'<article><p>{ENGLISH}</p><p class="share-price">The price rose.</p></article>', f"{ENGLISH} The price rose."),
    (f"<article><p>{ENGLISH}</p><script src=/a/>var x = 1;</script></article>", ENGLISH),
    (f"<article><svg/><p>{ENGLISH}</p><script src=a /></article>", ENGLISH),
    (f'<div><p>{ENGLISH}</p></div><div class="reader-responses-list"><p>{ENGLISH}</p></div>', ENGLISH),
    ("<article><p>One <a>two three four</a> five six.</p><p>Short.</p><p>One <a>two three four</a> five six.</p></article>",
     "One two three four five six. Short. One two three four five six."),
    (f'<article class="post sidebar-left"><p>{ENGLISH}</p><section class="comments"><p>{ENGLISH}</p></section></article>', ENGLISH),
    (f'<article><p>{ENGLISH}</p><article class="comment"><p>{ENGLISH}</p></article></article>', ENGLISH),
    (f"<div class=comments><p>{ENGLISH}</p></div>", ""),
    (f"<article><p>{ENGLISH} <span class=ad>Buy <span>it</span> now</span>End.</p></article>", f"{ENGLISH} End."),
    (f"<article><p><span class=ad>{ENGLISH}</p></article>", ENGLISH)])
def test_marks_name_what_is_no_content(page, want):
    assert html_text.main_text(page) == want


WORDS = "the of and river people story they lived for it was in house water boat fish wood long years many".split()


def _page(rng):
    """A page and its main text: paragraphs among menus, adverts, forms and comments, in
    wrappers whose classes say nothing or tell of a state, some elements not closed."""
    def say(lo, hi):
        return " ".join("the" if i % 4 == 0 else rng.choice(WORDS) for i in range(rng.randint(lo, hi))).capitalize() + "."

    def links():
        return "".join(f"<li><a href=/{i}>{say(1, 3)}</a>" for i in range(rng.randint(2, 6)))

    def junk():
        return rng.choice([
            lambda: f"<nav><ul>{links()}</ul></nav>",
            lambda: f"<div class='{rng.choice(['left-sidebar', 'sideBar widget', 'ad-slot-3', 'cookie-banner', 'share_buttons'])}'><p>{say(9, 40)}</p></div>",
            lambda: f"<form action=x><p>{say(9, 30)}</p><input name=a><button>Send</button></form>",
            lambda: f"<script>if (a < b) {{ '<p>{say(9, 20)}</p>' }}</script><style>p > a {{}}</style>",
            lambda: f"<!-- <p>{say(9, 20)}</p> --><aside><p>{say(9, 20)}</aside>"])()

    want, body = [], []
    for _ in range(rng.randint(2, 8)):
        text = say(10, 60)
        want.append(text)
        shown = text
        if rng.random() < 0.3:
            first, rest = text.split(" ", 1)
            shown = f"<a href=x>{first}</a>\n {rest}"
        body.append(rng.choice(["<p>{}</p>", "<p class=lead>{}", "<div>{}</div>", "<div><p>{}</p>\n</div>"]).format(shown))
        if rng.random() < 0.4:
            body.append(junk())
        if rng.random() < 0.2:
            body.append("<span class=promo>")            # never closed: holds nothing
    open_, close = rng.choice([("<article class='post has-sidebar'>", "</article>"), ("<main id=main-content>", "</main>"),
                               ("<div class='no-sidebar comments-open'>", "</div>"), ("<form id=page><article>", "</article></form>"),
                               ("<section class=story><div>", "</div></section>")])
    comments = f"<section class='{rng.choice(['comments', 'reader-comments', 'comment_list'])}'>" + "".join(
        f"<div><p>{say(9, 80)}</p></div>" for _ in range(rng.randint(1, 5))) + "</section>"
    return (f"<html><head><title>{say(3, 9)}</title></head><body class='sidebar'><header><h1>{say(2, 5)}</h1></header>{junk()}"
            f"{open_}{''.join(body)}{close}{comments}{junk()}<footer><p>{say(9, 30)}</footer></body></html>"), " ".join(want)


def test_generated_pages():
    rng = random.Random(7)
    for _ in range(1500):
        page, want = _page(rng)
        assert html_text.main_text(page) == want, page


@pytest.mark.parametrize("part", ["<span class=ad>a ", "<div><span class=ad>", "<div>a</p>", "<script src=a />x",
                                  "<form><div class=widget>x", "<svg/><p>a", "<", "<a href='", "<!-- "])
def test_time_grows_with_the_page(part):
    start = time.time()
    html_text.main_text(part * ((1 << 20) // len(part)))
    assert time.time() - start < 20


def test_pages_keep_their_other_columns(spark):
    pages = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (None, f"<p>{ENGLISH}</p>", None)],
                                  "page_id long, html string, text string").withColumn("TEXT_1", F.lit(1))
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "TEXT_1", "text"]
    assert sorted(r.text for r in got.collect()) == ["", "", ENGLISH]
