"""Main text of pages: made pages with known articles, in clean and broken markup."""

from __future__ import annotations

import html
import random

import pytest

from canarylake.llm import htmltext
from canarylake.llm.htmltext import Page

PAGES = "page_id long, url string, html string, text int, key string, row string"


def made(seed=4, n=240):
    """``(rows, truth)``: pages of hosts with templates of their own, which no name gives away, and of hosts with a page or two."""
    rng = random.Random(seed)
    vocab = ["wort", "été", "a & b", "x<y", "“q”", "data", "line", "of", "the", "über"] + ["v%d" % i for i in range(200)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    licence = say(25)
    rows, truth = [], {}
    for i in range(n):
        host = rng.choice(["big.example.com", "big.example.com", "mid.example.org", "small%d.example.net" % i])
        blocks = [say(rng.choice([3, 12, 40])) for _ in range(rng.randint(1, 5))]
        if host.startswith("big") and rng.random() < 0.5:
            blocks.insert(rng.randrange(len(blocks) + 1), licence)  # a passage that many articles share
        title = say(4)
        esc = lambda t: html.escape(t).replace(" ", rng.choice([" ", "\n  ", "&#32;"]), 1)
        body = "".join(rng.choice(["<p>%s</p>", "<p>%s", "<P class='x'><b>%s</b></P>", "<p><i>%s"]) % esc(b) for b in blocks)
        frame = "article" if host.startswith("big") or rng.random() < 0.5 else "div"
        top = '<div class="x7"><p>Site %s</p><div>All about it <a href="/%d">more</a></div></div>' % (host, i)
        bottom = "<section><h4>Wir</h4><ul><li>Eins<li>Zwei</ul></section>"
        if host.startswith("small"):
            top = bottom = ""
        inner = '<div class="k3"><span>Send this page</span> to a friend</div>' if frame == "article" and not host.startswith("small") else ""
        page = (
            f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{x:y}}</style><script>var t='</p><article>';</script></head><body>{top}"
            f"<nav><ul><li>{say(2)}<li>{say(1)}</ul></nav><div class='ad-box'>{say(5)}</div><form>Name <input name=n> {say(1)}</form>"
            f"<{frame}><h1>{esc(title)}</h1>{body}{inner}</{frame}><!-- {say(3)} <p> --><aside>{say(4)}</aside>"
            f"<section id=comments><article class=comment><p>{say(6)}</p></article></section>{bottom}<footer>&copy; {host} {say(3)}"
        )
        page += rng.choice(["</footer></body></html>", "", "</foo"])
        rows.append((i, f"https://{host}/p/{i}?x=1", page, 0, "k", "r"))
        truth[i] = " ".join(" ".join([title, *blocks]).split())
    return rows, truth


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_main_text_of_made_pages(spark, sent):
    """Templates are found by their recurrence, shared passages and titles stay; keys sent, and keys joined."""
    rows, truth = made()
    got = htmltext.main_text(spark.createDataFrame(rows, PAGES).repartition(5), most_sent=sent).collect()
    assert {r["page_id"]: r["text"] for r in got} == truth


def test_templates_equal_brute_force(spark):
    rows, _ = made(9, 120)
    held, pages = {}, {}
    for _, url, source, *_ in rows:
        host, page = htmltext._host(url), Page(source)
        pages.setdefault(host, set()).add(page.text())
        for _, key, prose in htmltext._keys(host, page):
            held.setdefault((host, key, prose), set()).add(page.text())
    want = {key for (host, key, prose), texts in held.items() if len(texts) >= 4 and len(texts) >= (0.5 if prose else 0.1) * len(pages[host])}
    got = {r["key"] for r in htmltext.templates(spark.createDataFrame(rows, PAGES), least=4, share=0.1).collect()}
    assert got == want and want


def test_copies_of_a_page_are_no_template(spark):
    """One page under many urls of a host stays whole, a third of all rows and more."""
    body = "<html><body><div class=main><div><p>Only one text.</p></div><div>Twice told</div></div></body></html>"
    rows = [(i, f"http://h.example.com/{i}", body, 0, "", "") for i in range(40)] + [(i, f"http://h.example.com/{i}", f"<div><p>Text {i}</p></div><div>Twice told</div>", 0, "", "") for i in range(40, 60)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == "Only one text." for i in range(40)) and all(got[i] == f"Text {i}" for i in range(40, 60))


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 10
    rows = [
        (1, None, None), (2, "no host", "<p>a&nbsp;b &lt;c&gt; &#8364; &unknown; &amp;amp;</p>"), (None, "http://x.example.com", "plain text, no markup"), (4, "http://x.example.com/a", ""),
        (5, "http://x.example.com/b", "<p>open <b>bold <p>next</b> end</p></div></p><li>one<li>two<table><tr><td>1<td>2<tr><td>3</table>"), (6, "://", "<a title=\"x>y\" href='z>'>in</a><br>line<wbr>break<img alt='>'>"),
        (7, "http://x.example.com/c", "<p>cut <a href=\"never closed>rest"), (8, "http://x.example.com/d", deep), (9, "http://x.example.com/e", "<p>" + "long words " * 200_000), (9, "http://x.example.com/e", "<p>same id</p>"), (9, "http://x.example.com/e", "<p>same id</p>"),
        (10, "http://x.example.com/f", "<body class='has-sidebar'><div class='page sidebar-left'><main><article><p>kept</p><div class='share'>no</div></article></main></div>"),
        (11, "http://x.example.com/g", "<form id=aspnet><div class=ad>never closed<article><header><h1>T</h1></header>body</article>"), (12, "http://x.example.com/h", "a < b and c <3 d <! x > e <?php y ?> f <![CDATA[ g ]]> h"),
        (13, "http://x.example.com/i", "<SCRIPT>if (a</b) <p>x</SCRIPT ><P>yes</P><textarea><p>no</textarea><b>tail"),
    ]
    got = htmltext.main_text(spark.createDataFrame([(i, u, h, 0, "k", "r") for i, u, h in rows], PAGES)).collect()
    texts = {}
    for r in got:
        texts.setdefault(r["page_id"], []).append(r["text"])
    assert len(got) == len(rows)
    assert texts[1] == [""] and texts[2] == ["a b <c> € &unknown; &amp;"] and texts[None] == ["plain text, no markup"] and texts[4] == [""]
    assert texts[5] == ["open bold next end one two 1 2 3"] and texts[6] == ["in linebreak"] and texts[7] == ["cut rest"]
    assert texts[8] == ["deep"] and sorted(map(len, texts[9])) == [7, 7, 2_199_999] and texts[10] == ["kept"]
    assert texts[11] == ["T body"] and texts[12] == ["a < b and c <3 d e f h"] and texts[13] == ["yes tail"]
    assert htmltext.main_text(spark.createDataFrame([], PAGES)).count() == 0
    assert htmltext.main_text(spark.createDataFrame([], PAGES), most_sent=-1).count() == 0
