from __future__ import annotations

import html as h
import random
import re
import time

import numpy as np

from wattweave.llm import html_extract
from wattweave.llm.html_tree import parse
from wattweave.llm.queries import op2_html_extraction

#: All 200 pages come out right; 120 did before names were split and link lists without names were laid out for training.
OTHER_SHARE = 0.95
PAGES = {
    "plain": ('<html><body><header><h1>Site</h1></header><div class="content"><h2>Hi</h2><p>One.</p><div class="ad">buy</div><p>Two <b>x</b>&amp;amp;.</p></div><aside><p>side</p></aside><section class="comments"><p>Nice words, thanks.</p></section><footer>f</footer></body></html>', "Hi\nOne.\nTwo x&amp;."),
    "main": ('<html><body><div id="nav"><a href=1>a</a></div><main><p>Main\n  text&nbsp;here.</p><form><p>Sign up</p></form></main></body></html>', "Main text here."),
    "notice": ('<body><div class="cookie-notice">We use cookies.</div><article><h1>T</h1><p>A<br>b<script>x("</p>")</script></article>', "T\nA b"),
    "quotes": ("<article><p title='it's'>Don't lose this</p><p><a href=/o'neil>Bob</a> said hi.</p><p data-x='a>b' x = \"c>d\">z</p x='>'><p class=\"open>It is here.</p></article>", "Don't lose this\nBob said hi.\nz\nIt is here."),
    "fallbacks": ("<article><p>See <video src=v>a film</video> and <object>a chart</object>.</p><p>a<!--> b</p><p>c<!-- > --!>d</article>", "See a film and a chart.\na b\ncd"),
    "unclosed": ("<article><p><b>First<p>Second<ul><li>x<li>y</ul>tail", "First\nSecond\nx\ny\ntail"),
}


def test_given_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in op2_html_extraction(spark, sf).collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        lines = (re.sub(r"\s+", " ", h.unescape(re.sub(r"<(b|br)>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside))
        assert got[r["page_id"]]["text"] == "\n".join(x for x in lines if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_page_parts():
    model = html_extract.trained()
    for name, (source, want) in PAGES.items():
        assert model.texts([parse(source)]) == [want], name


def test_held_out_pages():
    model, pages = html_extract.trained(), html_extract.labelled_pages(80, seed=91)
    got = model.texts([p for p, _ in pages])
    want = ["\n".join(x for n, x in p.blocks if y[n]) for p, y in pages]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.93 * len(pages)


def test_messages_give_the_marginals_of_every_labelling():
    rng = np.random.default_rng(1)
    forest = html_extract.Forest([np.array([-1, 0, 0, 1, 1]), np.array([-1, 0])])
    potential, pair = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    p, joint = forest.marginals(potential, pair)
    total, ones, both = 0.0, np.zeros(7), np.zeros((7, 2, 2))
    for code in range(1 << 7):
        y = [(code >> i) & 1 for i in range(7)]
        w = np.exp(sum(potential[i, y[i]] for i in range(7)) + sum(pair[y[q], y[i]] for i, q in enumerate(forest.parent) if q >= 0))
        total += w
        ones += w * np.array(y)
        for i, q in enumerate(forest.parent):
            if q >= 0:
                both[i, y[q], y[i]] += w
    assert np.allclose(p[:, 1], ones / total) and np.allclose(joint, both / total)


_STEMS = "Wind Regen Abend Straße Licht und the of river morning when über kalt window open market people slowly found".split()


class OtherPages:
    """Pages of another hand than the training grammar: block__element and hashed class names, old table layouts, portal names."""

    def __init__(self, rng):
        self.rng = rng

    def say(self, low, high):
        return " ".join(self.rng.choice(_STEMS) for _ in range(self.rng.randint(low, high))) + "."

    def rest(self):
        rng = self.rng
        return rng.choice([
            lambda: f'<div class="globalnav__list"><a href="/a">{self.say(1, 2)}</a> | <a href="/b">{self.say(1, 2)}</a> | <a href="/c">{self.say(1, 2)}</a></div>',
            lambda: f'<nav aria-label="primary"><ul><li><a href="/">{self.say(1, 3)}</a></li><li><a href="/n">{self.say(1, 3)}</a></li></ul></nav>',
            lambda: f'<div id="cookieConsent"><div><p>{self.say(8, 20)}</p><button>OK</button></div></div>',
            lambda: f'<div class="c-sponsored-box"><p>{self.say(5, 12)}</p></div>',
            lambda: f'<footer><div class="css-1x2y"><p>{self.say(4, 9)}</p><p>{self.say(2, 5)}</p></div></footer>',
            lambda: f'<section id="disqus_comments"><h2>{self.say(1, 2)}</h2><div class="comment__body"><p>{self.say(5, 40)}</p></div><div class="comment__body"><p>{self.say(5, 40)}</p></div></section>',
            lambda: f'<aside class="css-99ab"><h3>{self.say(1, 3)}</h3><ul><li><a href="/r">{self.say(3, 8)}</a></li><li><a href="/s">{self.say(3, 8)}</a></li></ul></aside>',
            lambda: f'<form action="/go"><label>{self.say(1, 3)}</label><input name="e"></form>',
            lambda: f'<div class="related-articles__rail"><a href="/u">{self.say(3, 8)}</a><a href="/v">{self.say(3, 8)}</a></div>',
        ])()

    def page(self):
        rng, lines = self.rng, []

        def part():
            lines.append(self.say(6, 60))
            return rng.choice(["<p>{}</p>", "<p>{}</p>", "<h2>{}</h2>", "<div>{}</div>", '<p class="css-7f">{}</p>', "<blockquote><p>{}</p></blockquote>"]).format(lines[-1])

        inside = "".join(part() for _ in range(rng.randint(2, 8)))
        body = rng.choice([
            '<article class="css-0a1">{}</article>', '<main id="maincontent"><div class="css-0a1">{}</div></main>', '<div itemprop="articleBody" class="c-article__body">{}</div>',
            '<div class="story-body__inner">{}</div>', '<table width=100%><tr><td class=maintext>{}</td></tr></table>', '<div id="mw-content-text"><div class="parser-output">{}</div></div>',
        ]).format(inside)
        return "<html><body>" + self.rest() + self.rest() + body + self.rest() + self.rest() + "</body></html>", "\n".join(lines)


def test_pages_of_another_grammar():
    """The share of pages that come out whole and clean, far from the training grammar; README states it."""
    rng, model = random.Random(17), html_extract.trained()
    made = [OtherPages(rng).page() for _ in range(200)]
    got = model.texts([parse(h) for h, _ in made])
    share = sum(a == b for a, (_, b) in zip(got, made, strict=True)) / len(made)
    print("share of whole pages", share)
    assert share >= OTHER_SHARE


def test_nesting_costs_linear_time():
    begin = time.perf_counter()
    for source in ("<article>" + "<div>" * 50_000 + "deep", "<article>" + "<select>a" * 50_000, "<ul>" + "<li>a" * 50_000, "<table><tr><td>a" * 20_000):
        parse(source)
    assert time.perf_counter() - begin < 8


def test_edges(spark, clash):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>&#0;&bogus; </p></p><p"), (4, "u", "<article>" + "<p>word</p>" * 30_000 + "</article>"), (5, "u", "<div>" * 3000 + "deep"), (None, "u", PAGES["main"][0]), (1, "u", None), (6, "u", "<article><p title='a\"b>c'>q</p><!-- <p>no</p>")]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = html_extract.extract_pages(df)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.count() == len(rows) and got[1] == "" and got[2] == "" and got[None] == "Main text here." and got[6] == "q"
    assert got[4].count("\n") == 29_999
    assert html_extract.extract_pages(df.where("false")).count() == 0
