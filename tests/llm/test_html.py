"""Main text of generated pages whose articles are known, and pages built to take long."""

import html
import random
import time

import pytest

from tidemill.llm import html_extract

WORDS = "stone river light paper green seven market window between carry north quiet glass summer after".split()


def _say(rng, least, most):
    return " ".join(rng.choices(WORDS, k=rng.randint(least, most)))


def _article(rng):
    """An article's markup and its blocks of text."""
    blocks, parts = [], []
    for k in range(rng.randint(3, 9)):
        text = _say(rng, 12, 40) + rng.choice(["", " & more", " <b> é", " 1 < 2"])
        blocks.append(text)
        shown = html.escape(text, quote=False).replace("é", rng.choice(["é", "&eacute;", "&#233;"]))
        cut = shown.find(" ")
        shown = rng.choice([shown, f"<b>{shown[:cut]}</b>{shown[cut:]}", shown.replace(" ", rng.choice(["  ", "\n", " \t"]), 3), f'<a href="/x">{shown[:cut]}</a>{shown[cut:]}'])
        names = rng.choice(["", " class='share-price'", " class=notice-text", " class='lead first-comment-of-all'", " id='p%d'" % k])
        parts.append(rng.choice([f"<p{names}>{shown}</p>", f"<p{names}>{shown}", f"<div{names}><p>{shown}</p></div>", f"<ul><li>{shown}</ul>", f"<blockquote>{shown}</blockquote>"]))
        if rng.random() < 0.3:
            parts.append(rng.choice(["<script>if (1 < 2) track('</p>')</script>", "<!-- hidden words -->", "<style>p{}</style>", '<aside>' + _say(rng, 5, 60) + "</aside>", "<form><input>" + _say(rng, 3, 9) + "</form>"]))
        if rng.random() < 0.2:
            parts.append(rng.choice(["<div class='ad'>%s</div>", "<div class='share-buttons'>%s</div>", "<div id='newsletter-signup'>%s</div>", "<div class='related-posts'>%s</div>"]) % _say(rng, 5, 60))
    title = _say(rng, 3, 7)
    head = rng.choice(["<h1>%s</h1>", "<div class='entry-header'><h1>%s</h1></div>", "<header><h1>%s</h1></header>"]) % title
    return head + "".join(parts), [title, *blocks]


#: Templates of hosts: where the article stands.
TEMPLATES = [
    "<article class='post-%d'>{}</article>",
    "<div class='wrap'><div class='entry'>{}</div></div>".replace("entry", "story-%d"),
    "<main id=m%d><section>{}</section></main>",
    "<div>" * 70 + "<article data-n=%d>{}</article>" + "</div>" * 70,
]


def _page(rng, template, body):
    around = [
        "<nav><ul>" + "".join(f"<li><a href='/{k}'>{_say(rng, 1, 3)}</a>" for k in range(8)) + "</ul></nav>",
        "<header><a href='/'>" + _say(rng, 1, 4) + "</a></header>",
        "<div class='cookie-notice'>" + _say(rng, 5, 30) + "</div>",
        "<div class=sidebar-left><p>" + _say(rng, 10, 50) + "</div>",
    ]
    rng.shuffle(around)
    after = [
        "<section class='comments-area'>" + "".join(f"<div class=comment><p>{_say(rng, 5, 60)}</p></div>" for _ in range(rng.randint(0, 12))) + "</section>",
        "<footer>" + _say(rng, 3, 20) + "</footer>",
    ]
    middle = (template % rng.randrange(1000)).replace("{}", body)
    return "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(around[: rng.randint(0, 4)]) + middle + "".join(after) + "</body></html>"


@pytest.mark.parametrize("broadcast_bytes", [32_000_000, 0])
def test_generated_pages(spark, broadcast_bytes):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(400):
        host = min(rng.randrange(40), 12) % 13
        body, blocks = _article(rng)
        rows.append((k, f"https://h{host}.example/{k}", _page(rng, TEMPLATES[host % 4], body)))
        want[k] = "\n".join(blocks)
    rows += [rows[3], (None, None, rows[0][2]), (500, "https://h1.example/", None), (501, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'x' as path", "2 as salt").repartition(5)
    out = html_extract.extract_main_text(pages, broadcast_bytes=broadcast_bytes).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert [k for k in want if got[k] != want[k]] == []
    assert got[None] == want[0] and got[500] == got[501] == "" and all(r.n_chars == len(r.text) for r in out)
    assert sum(r.page_id == 3 for r in out) == 2


def test_names_are_weighed():
    page = "<article><div class='entry-header'><h1>Title of it</h1></div><p class='share-price'>one about shares</p><p class='notice-text'>two</p><p>three</p>%s</article>"
    want = "Title of it\none about shares\ntwo\nthree"
    for more in ("", "<div class=share-buttons>send it</div>", "<div class='entry-footer'><a>tag</a> <a>tag</a></div>", "<p hidden>x</p>", "<div role=navigation>x</div>"):
        assert html_extract.extract(page % more, None) == want
    assert html_extract.extract("<div class=widget><p>all of the page</p></div>", None) == "all of the page"
    assert html_extract.extract("<article><h1>a</h1><article class='comment even'>remark</article></article>", None) == "a"


def test_quotes_open_values_only():
    page = "<article><p title=it's>First don't end</p><p data-x=a\"b>Second para don't stop</p><p title = '>'>third</p></article>"
    assert html_extract.extract(page, None) == "First don't end\nSecond para don't stop\nthird"


@pytest.mark.parametrize("cards", [3, 20, 200])
def test_cards_do_not_outvote_an_article(spark, cards):
    rng = random.Random(cards)
    rows = []
    for k in range(12):
        paragraphs = [_say(rng, 40, 50) for _ in range(6)]
        latest = "".join(f"<article class=card><h3>{_say(rng, 3, 5)}</h3><p>{_say(rng, 18, 22)}</p></article>" for _ in range(cards))
        rows.append((k, "https://h.example/", f"<body><div class=latest>{latest}</div><article class=story>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article></body>", "\n".join(paragraphs)))
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, want string")).collect()
    assert {r.page_id: r.text for r in out} == {r[0]: r[3] for r in rows}


def test_titles_and_paragraphs_of_an_article_stay():
    for title in ("<header><h2>Title of it</h2></header>", "<div class='post-header'><h2>Title of it</h2></div>", "<header><h3>Title of it</h3></header>"):
        page = f"<body><header><h2>Site</h2></header><article>{title}<p class='related'>a related matter</p><p>two</p><header><h2>later</h2></header></article></body>"
        assert html_extract.extract(page, None) == "Title of it\na related matter\ntwo"
    for name in ("feedback-list", "discussion", "reactions"):
        assert html_extract.extract(f"<main><p>text</p><div class={name}><p>reader remark</p></div></main>", None) == "text"


def test_vote_is_guarded():
    long = "long words of an article " * 30
    assert html_extract.extract(f"<div class='c'>teaser</div><article>{long}</article>", "/div.c") == long.strip()
    assert html_extract.extract(f"<div class='c'>short</div><div class='foot'>{long}</div>", "/div.c") == "short"


def test_depth_has_no_limit():
    for depth in (10, 62, 3000):
        page = "<div>" * depth + "<article>words of the article</article><div class='said'>reader remarks and other things</div>" + "</div>" * depth
        assert html_extract.extract(page, html_extract.best_path(page)[0]) == "words of the article"


@pytest.mark.parametrize("unit", ["<div>x", "<td>x<tr>", "<p>x</b>", '<a ">"', "<div>x</span>", "<b><p>x", "</div>", "<a b='", "<!-- x", "<li>x<ul>", "x &amp; <", "<div class='a b c'>x</div>"])
def test_time_in_proportion(unit):
    html_extract.extract(unit * 1000, None)
    began = time.process_time()
    html_extract.extract(unit * 20_000, None)
    few = time.process_time() - began
    began = time.process_time()
    html_extract.extract(unit * 200_000, "/div")
    assert time.process_time() - began < max(1.0, 25 * few)
