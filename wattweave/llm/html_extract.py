"""Main text of web pages by a tree-structured graphical model.

A page is a tree of block elements. Every element has a hidden label, whether it
belongs to the article; its features (tag, words of class and id, text size,
share of links) give a node potential, and each parent and child share a
potential over their two labels. Sum-product messages, once up and once down the
tree, give every element's marginal; text blocks of elements with a marginal of
one half or more are the page's text.

The weights maximise the likelihood of labelled pages; expected counts for the
gradient come from the same messages. The labelled pages are laid out from a
grammar of page parts (``labelled_pages``), a fixed number of them, so training
does not grow with the table.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import Page, names_of, node_features, parse

TRAINING_PAGES = 600
#: Nodes of several pages that pass messages together.
FOREST = 20_000

# ---- labelled pages -------------------------------------------------------------------------------------------------

_SYLLABLES = "an be ci der el fo ga hi in jo ka le mo ne or pa que ra sa te un ver wi xa yo zu ion ment heit é ü".split()
MAIN_NAMES = "article content post entry body story text main prose page single-post post-content entry-content article-body story-text".split()
NEUTRAL_NAMES = "wrapper container row col inner outer block box grid layout section left right wide x1 clearfix group".split()
BOILERPLATE = {
    "nav": "nav menu navbar navigation main-menu top-menu breadcrumb breadcrumbs pagination pager toc skip-links",
    "header": "header masthead site-header top-bar topbar branding logo page-header",
    "footer": "footer site-footer colophon copyright bottom legal imprint",
    "aside": "sidebar aside widget side widget-area related recommended trending more-stories most-read tags",
    "notice": "notice cookie cookies cookie-notice cookie-banner gdpr consent alert warning banner message paywall subscribe-notice popup modal",
    "ad": "ad ads advert advertisement adverts sponsored promo promotion ad-slot adbox banner-ad sponsor",
    "form": "form search login signup newsletter subscribe contact-form search-form",
    "comments": "comments comment comment-list responses discussion reader-comments replies respond user-comments",
    "share": "share social sharing social-links follow share-buttons",
}
BOILERPLATE = {k: v.split() for k, v in BOILERPLATE.items()}


class _Layout:
    """One page of the grammar. What belongs to the article carries ``data-main``."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        said = " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))
        return said.capitalize() + rng.choice([".", ".", "", "!", "?"])

    def attributes(self, names: list[str]) -> str:
        rng = self.rng
        chosen = rng.sample(names, 1) + rng.sample(NEUTRAL_NAMES, rng.choice([0, 0, 1, 2]))
        told = chosen[0]
        rng.shuffle(chosen)
        return rng.choice([f' class="{" ".join(chosen)}"'] * 3 + [f' id="{told}"'])

    def links(self) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.rng.randint(2, 8)))

    def inline(self, said: str) -> str:
        rng = self.rng
        return rng.choice([said] * 5 + [f"<b>{said}", f"<em>{said}</em>", f'<a href="/x">{said[:9]}</a>{said[9:]}', f"{said}<br>{self.words(2, 8)}"])

    def paragraph(self, main: bool) -> str:
        rng, mark = self.rng, " data-main" if main else ""
        kind = rng.choice(["p"] * 12 + ["h2", "h3", "ul", "ol", "blockquote", "pre", "table", "div", "dl", "figure"])
        said = self.words(*rng.choice([(1, 2), (3, 12), (12, 40), (40, 120)]))
        if kind in ("ul", "ol"):
            items = "".join(f"<li{mark}>{self.words(2, 20)}</li>" for _ in range(rng.randint(1, 5)))
            return f"<{kind}{mark}>{items}</{kind}>"
        if kind == "table":
            rows = "".join(f"<tr{mark}><td{mark}>{self.words(1, 4)}</td><td{mark}>{self.words(1, 6)}</td></tr>" for _ in range(rng.randint(1, 4)))
            return f"<table{mark}>{rows}</table>"
        if kind == "dl":
            return f"<dl{mark}><dt{mark}>{self.words(1, 3)}</dt><dd{mark}>{said}</dd></dl>"
        if kind == "figure":
            return f'<figure{mark}><img src="/i.png"><figcaption{mark}>{self.words(3, 15)}</figcaption></figure>'
        if kind == "blockquote":
            return f"<blockquote{mark}>{rng.choice([said, f'<p{mark}>{said}</p>'])}</blockquote>"
        if kind == "div":
            return f"<div{mark}{rng.choice(['', self.attributes(NEUTRAL_NAMES)])}>{said}</div>"
        return f"<{kind}{mark}>{self.inline(said)}" + rng.choice([f"</{kind}>"] * 4 + ["" if kind == "p" else f"</{kind}>"])

    def boilerplate(self) -> str:
        rng = self.rng
        kind = rng.choice(list(BOILERPLATE))
        tag = {"notice": "div", "ad": "div", "comments": rng.choice(["div", "section", "ol"]), "share": "div"}.get(kind, kind)
        named = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        if not named and rng.random() < 0.5 and tag not in ("form",):
            tag = rng.choice(["div", "div", "section", "ul"] if kind in ("nav", "share") else ["div", "div", "section", "aside"])
        attributes = "" if named else self.attributes(BOILERPLATE[kind])
        if kind in ("nav", "share", "aside") and rng.random() < 0.2:  # nothing but its links tells what it is
            tag, attributes = rng.choice(["div", "div", "p", "ul"]), rng.choice(["", "", self.attributes(NEUTRAL_NAMES)])
            links = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(rng.randint(2, 6))]
            inside = "".join(f"<li>{x}</li>" for x in links) if tag == "ul" else rng.choice([" | ", " ", "<br>", " · "]).join(links)
            return f"<{tag}{attributes}>{inside}</{tag}>"
        said = self.words(*rng.choice([(1, 6), (4, 15), (10, 40)]))
        if kind in ("nav", "share") or (kind in ("aside", "footer", "header") and rng.random() < 0.4):
            inside = self.links() if tag == "ul" else f"<ul>{self.links()}</ul>"
        elif kind == "form":
            inside = f'<label>{self.words(1, 3)}</label><input name="q"><p>{said}</p><button>{self.words(1, 2)}</button>'
        elif kind == "comments":
            each = rng.choice(["div", "li", "article", "p"])
            inside = f"<h3>{self.words(1, 3)}</h3>" + "".join(
                f"<{each}{rng.choice(['', self.attributes(BOILERPLATE['comments'])])}>{rng.choice([said, f'<p>{self.words(3, 60)}</p>'])}</{each}>"
                for _ in range(rng.randint(1, 4))
            )
        elif kind == "header" and rng.random() < 0.6:
            level = rng.choice(["h1", "h1", "h2", "div"])
            inside = f"<{level}>{rng.choice([said, f'<a href=/>{said}</a>'])}</{level}>" + rng.choice(["", f"<p>{self.words(2, 9)}</p>", f"<nav><ul>{self.links()}</ul></nav>"])
        else:
            inside = rng.choice([said, f"<p>{said}</p>", f"<h4>{self.words(1, 3)}</h4><p>{said}</p>", f"<p>{said}</p><p>{self.words(3, 20)}</p>", f"<a href='/y'>{said}</a>"])
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def article(self) -> str:
        rng = self.rng
        parts = [f"<h1 data-main>{self.words(2, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([0, 1, 2, 5, 9, 14])):
            parts.append(self.paragraph(True))
            if rng.random() < 0.12:
                parts.append(self.boilerplate())
        tag = rng.choice(["article"] * 4 + ["main", "div", "div", "section", "td"])
        names = rng.choice(["", self.attributes(MAIN_NAMES)]) if tag in ("article", "main") else self.attributes(MAIN_NAMES)
        inside = "".join(parts)
        if rng.random() < 0.2:
            inside = f"<div data-main{self.attributes(MAIN_NAMES + NEUTRAL_NAMES)}>{inside}</div>"
        out = f"<{tag} data-main{names}>{inside}</{tag}>"
        return f"<table data-main><tr data-main><td>{self.boilerplate()}</td>{out}</tr></table>" if tag == "td" else out

    def page(self) -> str:
        rng = self.rng
        before, after = ("".join(self.boilerplate() for _ in range(rng.randint(0, 4))) for _ in range(2))
        middle = self.article()
        for _ in range(rng.choice([0, 0, 1, 2])):
            beside = rng.choice(["", self.boilerplate()])
            pair = [middle, beside]
            rng.shuffle(pair)
            middle = f"<div data-main{rng.choice(['', self.attributes(NEUTRAL_NAMES)])}>{''.join(pair)}</div>"
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>x('</p>')</script></head>"
        return f"<!DOCTYPE html><html data-main>{head}<body data-main>{before}{middle}{after}" + rng.choice(["</body></html>", ""])


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 3) -> list[tuple[Page, np.ndarray]]:
    """Trees with the label of each node: whether it holds a part of the article."""
    out = []
    for i in range(n):
        page = parse(_Layout(random.Random(seed * 100_003 + i)).page())
        labels = np.array(["data-main" in a for a in page.attributes])
        labels[0] = True
        page.attributes = [re.sub(r"\bdata-main\b", "", a) for a in page.attributes]
        out.append((page, labels))
    return out


# ---- the model ------------------------------------------------------------------------------------------------------


class Forest:
    """The trees of several pages as one, with its nodes by depth."""

    def __init__(self, parents: list[np.ndarray]):
        starts = np.cumsum([0, *map(len, parents)])
        self.starts = starts
        self.parent = np.concatenate([np.where(p < 0, -1, p + s) for p, s in zip(parents, starts[:-1], strict=True)])
        depth = np.zeros(len(self.parent), dtype=np.int64)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth)))[:-1] if len(order) else []

    def marginals(self, potential: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of each node, and P(parent's label, label) of each node that has a parent (zeros for roots).

        ``potential`` is nodes x 2, ``pair`` parent x child, both logs.
        """
        n = len(self.parent)
        inward, up = potential.copy(), np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp(inward[level, None, 0] + pair[:, 0], inward[level, None, 1] + pair[:, 1])
            np.add.at(inward, self.parent[level], up[level])
        belief, joint = inward.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - up[level]  # what the parent knows without this child
            both = rest[:, :, None] + pair + inward[level, None, :]
            both -= both.max(axis=(1, 2), keepdims=True)
            joint[level] = np.exp(both)
            joint[level] /= joint[level].sum(axis=(1, 2), keepdims=True)
            down = np.logaddexp(rest[:, 0, None] + pair[0], rest[:, 1, None] + pair[1])
            belief[level] += down
        belief -= belief.max(axis=1, keepdims=True, initial=-np.inf)
        p = np.exp(belief)
        return p / p.sum(axis=1, keepdims=True), joint


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    pair: np.ndarray

    def potentials(self, page: Page) -> np.ndarray:
        get = self.weights.get
        return np.array([[0.0, sum(get(f, 0.0) for f in features)] for features in node_features(page)])

    def texts(self, pages: list[Page], least: float = 0.5) -> list[str]:
        forest = Forest([np.array(p.parents) for p in pages])
        p, _ = forest.marginals(np.concatenate([self.potentials(x) for x in pages]), self.pair)
        keep = (p[:, 1] >= least).tolist()
        return ["\n".join(line for node, line in x.blocks if keep[s + node]) for x, s in zip(pages, forest.starts.tolist(), strict=False)]


def fit(pages: list[tuple[Page, np.ndarray]], steps: int = 500, rate: float = 0.4, prior: float = 0.01) -> Model:
    """Weights and pair potentials of the highest penalised likelihood, by Adagrad."""
    features = [f for page, _ in pages for f in node_features(page)]
    names = {f: i for i, f in enumerate(sorted({f for own in features for f in own}))}
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column = np.array([names[f] for own in features for f in own])
    labels = np.concatenate([y for _, y in pages]).astype(int)
    forest = Forest([np.array(page.parents) for page, _ in pages])
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[forest.parent[child]], labels[child]), 1)
    w, pair = np.zeros(len(names)), np.zeros((2, 2))
    w_sum, pair_sum = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(steps):
        score = np.bincount(row, weights=w[column], minlength=len(features))
        p, joint = forest.marginals(np.stack([np.zeros_like(score), score], axis=1), pair)
        g = np.bincount(column, weights=(labels - p[:, 1])[row], minlength=len(names)) - prior * w
        gp = seen - joint.sum(axis=0) - prior * pair
        w_sum += g**2
        pair_sum += gp**2
        w += rate * g / np.sqrt(w_sum)
        pair += rate * gp / np.sqrt(pair_sum)
    return Model({f: float(w[i]) for f, i in names.items()}, pair)


@lru_cache(1)
def trained() -> Model:
    """The model of the standard labelled pages, fitted once in a process."""
    return fit(labelled_pages())


# ---- the operator ---------------------------------------------------------------------------------------------------


def _extract(shared):
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            pages, rows, nodes = [], [], 0
            for i, source in enumerate(batch["html"]):
                pages.append(parse(source or ""))
                rows.append(i)
                nodes += len(pages[-1].tags)
                if nodes >= FOREST or i == len(batch) - 1:
                    text = model.texts(pages)
                    yield pd.DataFrame(
                        {"page_id": batch["page_id"].iloc[rows], "url": batch["url"].iloc[rows], "text": text, "n_chars": [len(t) for t in text]}
                    )
                    pages, rows, nodes = [], [], 0

    return extract


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Character references are decoded; white space in a block, line breaks too,
    is one space; blocks are trimmed and joined in page order by a line feed.
    Null html and html without an article give an empty text. Malformed and
    very long pages are parsed whole. Repeated rows come each; an empty table
    gives an empty result. Columns that aren't named aren't read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(
        _extract(shared), "page_id long, url string, text string, n_chars long"
    )
