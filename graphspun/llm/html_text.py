"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks. A bidirectional LSTM, in numpy, reads for each block its hashed tag path,
hashed words and a few measures, so that every block is judged with the whole page in view; blocks above one half are
the main text. It is trained here, when the operator runs: on pages made from random templates, whose parts
are known, and on a bounded sample of the table's own pages, labelled where their semantic elements leave no doubt.

Defined results. Html null, empty or without main text: the empty string, 0 characters. Id or url null, repeated
rows: each listed. Cut-off markup: what is open at the end is closed there. Very long pages are read whole.
Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspun.llm.common import ship
from graphspun.llm.html_blocks import OUTSIDE, PATHS, WIDTH, WORDS, Block, blocks, features

#: Names that mark the article.
INSIDE = frozenset("article main content post entry story body text".split())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one per direction, and a logistic output over both their states."""

    def __init__(self, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"out": rng.normal(0, 0.3, 2 * hidden), "bias": np.zeros(1)}
        for d in ("f", "b"):
            self.p |= {f"{d}x": rng.normal(0, 0.1, (WIDTH, 4 * hidden)), f"{d}h": rng.normal(0, 0.2, (hidden, 4 * hidden)), f"{d}0": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        self._lean()

    def _lean(self) -> None:
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _turn(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence (second axis) backwards in time (first axis), its padding left behind."""
        t = np.arange(x.shape[0])[:, None]
        return x[np.where(t < lengths, lengths - 1 - t, t), np.arange(x.shape[1])[None]]

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        n, pages, h = x.shape[0], x.shape[1], self.hidden
        inputs = x @ self.p[f"{d}x"] + self.p[f"{d}0"]
        state, cell, out = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32), np.empty((n, pages, h), np.float32)
        for t in range(n):
            a = inputs[t] + state @ self.p[f"{d}h"]
            i, f, o, g = _sigmoid(a[:, :h]), _sigmoid(a[:, h : 2 * h]), _sigmoid(a[:, 2 * h : 3 * h]), np.tanh(a[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            if keep is not None:
                keep.append((i, f, o, g, before, cell, state))
            state = o * np.tanh(cell)
            out[t] = state
        return out

    def score(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """x: time, page, feature; the probability of each block (time, page)."""
        forth, back = self._run("f", x), self._turn(self._run("b", self._turn(x, lengths)), lengths)
        return _sigmoid(np.concatenate((forth, back), axis=2) @ self.p["out"] + self.p["bias"])

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, keep, turned = self.hidden, {"f": [], "b": []}, self._turn(x, lengths)
        forth, back = self._run("f", x, keep["f"]), self._turn(self._run("b", turned, keep["b"]), lengths)
        both = np.concatenate((forth, back), axis=2)
        error = (_sigmoid(both @ self.p["out"] + self.p["bias"]) - y) * (np.arange(x.shape[0])[:, None] < lengths) / lengths.sum()
        grad = {"out": np.einsum("tp,tph->h", error, both), "bias": np.array([error.sum()])}
        for d, inputs, e in (("f", x, error), ("b", turned, self._turn(error, lengths))):
            w = self.p["out"][:h] if d == "f" else self.p["out"][h:]
            ds, dc, da_all = 0.0, 0.0, np.empty((*x.shape[:2], 4 * h), np.float32)
            dh = np.zeros_like(self.p[f"{d}h"])
            for t in reversed(range(x.shape[0])):
                i, f, o, g, before, cell, state = keep[d][t]
                ds = e[t][:, None] * w + ds
                th = np.tanh(cell)
                dc = dc + ds * o * (1 - th * th)
                da = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), ds * th * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                da_all[t] = da
                dh += state.T @ da
                ds, dc = da @ self.p[f"{d}h"].T, dc * f
            grad |= {f"{d}x": np.einsum("tpw,tpa->wa", inputs, da_all, optimize=True), f"{d}h": dh, f"{d}0": da_all.sum((0, 1))}
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((lengths.max(), len(pages), WIDTH), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
    return x, lengths


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Labeller:
    """Adam over pages of (features, labels). Words are left out of half the batches, so that structure decides where it can."""
    model, rng = Labeller(seed=seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in model.p.items()}, {k: np.zeros_like(x) for k, x in model.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        for at in range(0, len(pages), batch):
            chosen = [pages[i] for i in order[at : at + batch]]
            x, lengths = padded([c[0] for c in chosen])
            y = np.zeros(x.shape[:2], np.float32)
            for i, c in enumerate(chosen):
                y[: len(c[1]), i] = c[1]
            if rng.random() < 0.5:
                x[:, :, PATHS : PATHS + WORDS] = 0
            step += 1
            for k, g in model.gradients(x, lengths, y).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model._lean()
    return model


def clear_labels(page: list[Block]) -> np.ndarray | None:
    """Labels of a page that has an article or main element: inside it, and inside nothing that is marked as not the article. None without one."""
    if not any(b.inside for b in page):
        return None
    return np.array([b.inside and not b.outside for b in page], np.float32)


def template_page(rng: np.random.Generator, words: list[str]) -> tuple[str, list[bool]]:
    """A page of random structure, and whether each of its blocks is main text."""
    main: list[bool] = []
    pick = lambda *x: x[rng.integers(len(x))]

    def sentence(lo: int, hi: int) -> str:
        return " ".join(words[i] for i in rng.integers(0, len(words), rng.integers(lo, hi)))

    def text(tag: str, is_main: bool, lo: int, hi: int, end: str = ".") -> str:
        main.append(is_main)
        inner = sentence(lo, hi) + (end if rng.random() < 0.8 else "")
        if rng.random() < 0.2:
            inner = f"<b>{inner}</b>"
        return f"<{tag}>{inner}</{tag}>"

    def links(n: int) -> str:
        main.extend([False] * n)
        return "<ul>" + "".join(f'<li><a href="#">{sentence(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def box(names: tuple[str, ...], is_main: bool = False, n: int = 1) -> str:
        name, tag = pick(*names), pick("div", "section", "div", "aside") if not is_main else "div"
        return f'<{tag} {pick("class", "id")}="{name}">' + "".join(text(pick("p", "div", "span", "p"), is_main, 2, 25) if rng.random() < 0.7 or is_main else links(2) for _ in range(n)) + f"</{tag}>"

    def comments() -> list[str]:
        opening, closing = pick(('<section class="comments">', "</section>"), ('<div id="comments">', "</div>"), ('<div class="comment-list">', "</div>"))
        return [opening] + [f'<div class="comment">{text("p", False, 2, 40)}</div>' for _ in range(rng.integers(1, 6))] + [closing]

    outside = ("ad", "advert", "ads", "banner", "cookie-notice", "notice", "sidebar", "related", "newsletter", "promo", "share", "social", "breadcrumbs", "widget", "subscribe", "popup")
    out = ["<html><body>"]
    if rng.random() < 0.7:
        out += ["<header>", text(pick("h1", "p", "div"), False, 1, 5, ""), "</header>"]
    if rng.random() < 0.9:
        out += [pick("<nav>", '<div class="menu">', '<nav class="menu">', "<div>", '<div role="navigation">', '<ul class="top-links"><li>'), links(int(rng.integers(1, 9)))] + ["</nav></div>"]
    out += [box(outside, n=int(rng.integers(1, 3))) for _ in range(rng.integers(0, 3))]
    if rng.random() < 0.15:
        out += ["<form>", text("label", False, 1, 5, ""), text("p", False, 2, 9), "</form>"]
    opening, closing = pick(("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ('<div class="entry">', "</div>"), ('<article class="post">', "</article>"), ('<div class="story"><section>', "</section></div>"), ('<section role="main">', "</section>"), ('<div itemprop="articleBody">', "</div>"), ('<table><tr><td class="article-text">', "</td></tr></table>"))
    out.append(opening)
    if rng.random() < 0.8:
        out.append(text("h1", True, 2, 12, ""))
    for _ in range(rng.integers(1, 14)):
        kind = rng.random()
        if kind < 0.75:
            out.append(text("p", True, 1, 60))
        elif kind < 0.82:
            out.append(text(pick("h2", "h3"), True, 1, 8, ""))
        elif kind < 0.87:
            out.append("<ul>" + "".join(text("li", True, 1, 15) for _ in range(rng.integers(1, 5))) + "</ul>")
        elif kind < 0.92:
            out.append("<blockquote>" + text("p", True, 3, 30) + "</blockquote>")
        elif kind < 0.93:
            out.append("<figure><img src=x>" + text("figcaption", True, 2, 15) + "</figure>")
        elif kind < 0.94:
            out.append("<table>" + "".join("<tr>" + text("th", True, 1, 3, "") + text("td", True, 1, 6, "") + "</tr>" for _ in range(rng.integers(1, 4))) + "</table>")
        elif kind < 0.95:
            out.append("<section><div>" + "".join(text(pick("p", "h4"), True, 1, 30) for _ in range(rng.integers(1, 4))) + "</div></section>")
        elif kind < 0.97:
            out.append(f"<pre>{sentence(2, 12)}</pre>")
            main.append(True)
        else:
            out.append(box(outside))

    where = rng.random()
    if where < 0.15:
        out += comments()
    out.append(closing)
    if where > 0.7:
        out += comments()
    out += [box(outside, n=int(rng.integers(1, 3))) for _ in range(rng.integers(0, 3))]
    if rng.random() < 0.9:
        out += ["<footer>", text(pick("p", "div", "span"), False, 2, 15), "</footer>"]
    return "".join(out) + "</body></html>", main


def training_pages(sample: list[str | None], templates: int, seed: int = 9) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out, words = np.random.default_rng(seed), [], ["word", "page", "text"]
    for page in map(blocks, sample):
        words += [w for b in page[:12] for w in b.text.split(" ", 30)[:30]]
        if page and (y := clear_labels(page)) is not None:
            out.append((features(page), y))
    words = words[:50_000]
    for _ in range(templates):
        page, main = template_page(rng, words)
        found = blocks(page)
        if len(found) == len(main):  # a block of no visible text would shift the labels
            out.append((features(found), np.array(main, np.float32)))
    return out


def main_texts(model: Labeller, pages: list[str | None], batch: int = 128) -> list[str]:
    """The main text of each page; pages of like length are read side by side."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        longest = len(found[order[min(len(order), at + batch) - 1]])
        take = max(1, min(batch, (1 << 14) // longest))
        chosen = order[at : at + take]
        x, lengths = padded([features(found[i]) for i in chosen])
        p = model.score(x, lengths)
        for j, i in enumerate(chosen):
            out[i] = "\n\n".join(b.text for b, q in zip(found[i], p[:, j]) if q > 0.5)
        at += take
    return out


def extract(pages: DataFrame, sample: int = 300, templates: int = 500, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. `sample`: at most so many pages of the table are used in training."""
    spark = pages.sparkSession
    ship(spark)
    ids = [r[0] for r in pages.where(F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()]
    own = [r[0] for r in pages.where(F.col(id_col).isin(ids)).select(html_col).limit(sample).collect()] if ids else []
    held = spark.sparkContext.broadcast(fit(training_pages(sorted(own, key=lambda x: x or ""), templates)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = main_texts(held.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")
