"""Main-text extraction: a recurrent block labeller.

A page is the sequence of its leaf text blocks (`html_blocks`). Each block is a vector: the learned vectors of all hashed parts of
its tag path (all tags, all words of class, id and role), over the root of their number, those of all hashed words of its text, over
the damped length of their vector of counts, and a few measures (length, share of link text, place). Blocks share the sums of the paths they share, so
time and memory are linear in the page. A bidirectional LSTM in numpy reads the sequence from both sides, so that every block is labelled with
the whole document in view. The blocks labelled as article are joined by a space.

There are no labelled pages, so the model is trained on the driver on pages that `drafts` writes: random layouts of articles
among menus, headers, footers, sidebars, notices, adverts, forms and comments, with labels by construction. Its seed is
fixed; the model is the same at every run and its size does not depend on the data. Pages are labelled in batches of like
length inside each Arrow batch; memory is bounded by the longest page.

Defined cases: null, empty or text-free html gives an empty text; repeated rows get a row each; an empty table gives an
empty result; very long pages are read whole.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import blocks

BUCKETS, WIDTH, HIDDEN = 4096, 24, 24
_MEASURES = 8
_BATCH = 32
_CHUNK = 1 << 16
_DAMP = 12


def _hash(token: str) -> int:
    return 1 + zlib.crc32(token.encode()) % (BUCKETS - 1)


_hash_marks = functools.lru_cache(20_000)(lambda marks: [_hash("<" + m) for m in marks])
_hash_word = functools.lru_cache(100_000)(_hash)


def encode(page: list) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, list[tuple[int, list[int]]]]:
    """(place of its path, hashed words) and measures of each block of a page, and the paths: (place of the one above, hashed marks)."""
    ids, rest = [], np.zeros((len(page), _MEASURES), dtype=np.float32)
    paths: list[tuple[int, list[int]]] = []
    places: dict = {}
    for k, (path, text, linked) in enumerate(page):
        new, at = [], path or None
        while at is not None and at not in places:
            new.append(at)
            at = at.above
        for p in reversed(new):
            places[p] = len(paths)
            paths.append((places[p.above] if p.above else -1, _hash_marks(p.marks)))
        words = text.lower().split()
        ids.append((places[path] if path else -1, np.fromiter(map(_hash_word, words), np.int16, len(words))))
        n = len(text)
        rest[k] = (min(1.0, n / 400), n < 25, linked / n, text[-1:] in ".!?…", "©" in text, k < 3, k >= len(page) - 3, min(1.0, len(page) / 50))
    return ids, rest, paths


def _norm(words: np.ndarray) -> float:
    """Length of the vector of the words' counts, damped: neither a repeated word nor a single one outweighs the path."""
    return float(np.sqrt((np.unique(words, return_counts=True)[1] ** 2).sum() + _DAMP))


class Labeller:
    """Parameters: token vectors E, two LSTMs (forward, backward), output weights."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WIDTH + _MEASURES, HIDDEN
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": np.zeros((BUCKETS, WIDTH), np.float32), "V": draw(2 * h + d, 1)[:, 0], "c": np.zeros(1, np.float32)}
        for k in "fb":
            bias = np.zeros(4 * h, dtype=np.float32)
            bias[h : 2 * h] = 1
            self.p |= {f"W{k}": draw(d, 4 * h), f"U{k}": draw(h, 4 * h), f"B{k}": bias}

    def path_sums(self, paths: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of each path's marks, added up from the root, and how many they are."""
        sums, sizes = np.zeros((len(paths), WIDTH), np.float32), np.zeros(len(paths), np.float32)
        for k, (above, marks) in enumerate(paths):
            sums[k] = self.p["E"][marks].sum(axis=0)
            sizes[k] = len(marks)
            if above >= 0:
                sums[k] += sums[above]
                sizes[k] += sizes[above]
        return sums, sizes

    def vectors(self, pages: list) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(time, page, feature) input, mask, and which words and paths went where."""
        n, t = len(pages), max(len(p[0]) for p in pages)
        x = np.zeros((t, n, WIDTH + _MEASURES), dtype=np.float32)
        mask = np.zeros((t, n), dtype=np.float32)
        counts = np.array([len(words) for p in pages for _, words in p[0]])
        spots = np.array([i * n + j for j, p in enumerate(pages) for i in range(len(p[0]))])
        tokens = np.concatenate([words for p in pages for _, words in p[0]])
        flat, own = np.zeros((t * n, WIDTH), dtype=np.float32), np.repeat(np.arange(len(spots)), counts)
        for at in range(0, len(tokens), _CHUNK):
            part = own[at : at + _CHUNK]
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            flat[spots[part[edge]]] += np.add.reduceat(self.p["E"][tokens[at : at + _CHUNK]], edge, axis=0)
        scale = np.array([_norm(words) ** -1 for p in pages for _, words in p[0]], dtype=np.float32)
        flat[spots] *= scale[:, None]
        shares = []
        for j, (ids, rest, paths) in enumerate(pages):
            mask[: len(ids), j] = 1
            x[: len(ids), j, WIDTH:] = rest
            places = np.array([place for place, _ in ids])
            rows = np.flatnonzero(places >= 0)
            sums, sizes = self.path_sums(paths)
            share = sizes[places[rows]] ** -0.5
            flat[rows * n + j] += sums[places[rows]] * share[:, None]
            shares.append((rows, places[rows], share))
        x[:, :, :WIDTH] = flat.reshape(t, n, WIDTH)
        return x, mask, (tokens, spots[own], scale[own], shares)

    def _lstm(self, x: np.ndarray, mask: np.ndarray, k: str) -> tuple[np.ndarray, list]:
        w, u, b, h = self.p[f"W{k}"], self.p[f"U{k}"], self.p[f"B{k}"], HIDDEN
        t, n, _ = x.shape
        hidden, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.zeros((t, n, h), np.float32), []
        pre = x @ w + b
        for i in range(t) if k == "f" else range(t - 1, -1, -1):
            z = pre[i] + hidden @ u
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            g = np.tanh(z[:, 3 * h :])
            new = gates[:, h : 2 * h] * cell + gates[:, :h] * g
            shown = np.tanh(new)
            m = mask[i][:, None]
            tape.append((i, hidden, cell, gates, g, shown, m))
            hidden, cell = m * gates[:, 2 * h :] * shown + (1 - m) * hidden, m * new + (1 - m) * cell
            out[i] = hidden
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, tf = self._lstm(x, mask, "f")
        b, tb = self._lstm(x, mask, "b")
        both = np.concatenate([f, b, x], axis=2)
        return both @ self.p["V"] + self.p["c"], (both, tf, tb)

    def gradients(self, pages: list, labels: list) -> dict:
        x, mask, (tokens, spots, scale, shares) = self.vectors(pages)
        s, (both, tf, tb) = self.scores(x, mask)
        y = np.zeros_like(s)
        for j, own in enumerate(labels):
            y[: len(own), j] = own
        d = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * mask / mask.sum()
        grads = {"V": np.einsum("tn,tnk->k", d, both), "c": np.array([d.sum()], np.float32)}
        dboth = d[:, :, None] * self.p["V"]
        h = HIDDEN
        dx = dboth[:, :, 2 * h :].copy()
        for k, tape, dout in (("f", tf, dboth[:, :, :h]), ("b", tb, dboth[:, :, h : 2 * h])):
            w, u = self.p[f"W{k}"], self.p[f"U{k}"]
            gw, gu, gb = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * h, np.float32)
            dh = dc = np.zeros((x.shape[1], h), np.float32)
            for i, before, cell, gates, g, shown, m in reversed(tape):
                dh = dh + dout[i]
                a, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dhm, dcm = dh * m, dc * m
                dnew = dcm + dhm * o * (1 - shown**2)
                dz = np.concatenate([dnew * g * a * (1 - a), dnew * cell * f * (1 - f), dhm * shown * o * (1 - o), dnew * a * (1 - g**2)], axis=1)
                gw += x[i].T @ dz
                gu += before.T @ dz
                gb += dz.sum(axis=0)
                dx[i] += dz @ w.T
                dh = dz @ u.T + dh * (1 - m)
                dc = dnew * f + dc * (1 - m)
            grads |= {f"W{k}": gw, f"U{k}": gu, f"B{k}": gb}
        ge = np.zeros_like(self.p["E"])
        np.add.at(ge, tokens, dx[:, :, :WIDTH].reshape(-1, WIDTH)[spots] * scale[:, None])
        for j, ((_, _, paths), (rows, places, share)) in enumerate(zip(pages, shares, strict=True)):
            back = np.zeros((len(paths), WIDTH), np.float32)
            np.add.at(back, places, dx[rows, j, :WIDTH] * share[:, None])
            for k in range(len(paths) - 1, -1, -1):
                above, marks = paths[k]
                if above >= 0:
                    back[above] += back[k]
                np.add.at(ge, marks, back[k])
        return grads | {"E": ge}

    def train(self, pages: list, labels: list, epochs: int, seed: int, rate: float = 0.01) -> Labeller:
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}, 0
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // _BATCH)):
                step += 1
                for k, g in self.gradients([pages[i] for i in part], [labels[i] for i in part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * 0.9**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list) -> list[np.ndarray]:
        """Whether each block is article, page by page."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k][0]), key=lambda k: len(pages[k][0]))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            x, mask, _ = self.vectors([pages[k] for k in part])
            s, _ = self.scores(x, mask)
            for j, k in enumerate(part):
                out[k] = s[: len(pages[k][0]), j] > 0
        return out


def drafts(n: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """Random pages and the texts of their article blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    syllables = [a + b for a in "b d f g k l m n p r s t v th sh qu ch é ü".split() for b in "a e i o u en er on is é".split()]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def prose(low, high):
        words = [word() for _ in range(int(rng.integers(low, high)))]
        if chance(0.12):
            words = [w for w in words[:9] for _ in range(int(rng.integers(1, 12)))]
        text = pick([" "] * 7 + [" | ", ", ", "!! ", "### "]).join(words)
        text = text.upper() if chance(0.06) else text.capitalize() if chance(0.9) else text
        return text + pick([".", ".", ".", "", "!", "?", " |", ":"])

    def deep(inner):
        """inner, at times under many levels of elements that say nothing, some with long lists of utility classes."""
        if chance(0.8):
            return inner
        levels = [pick(["<div>", "<div>", "<section>", f'<div class="{" ".join(word() for _ in range(int(rng.integers(1, 14))))}">']) for _ in range(int(rng.integers(1, 30)))]
        return "".join(levels) + inner + "".join("</" + x[1:].split(" ")[0].rstrip(">") + ">" for x in reversed(levels))

    def menu():
        items = "".join(f'<li><a href="/{word()}">{" ".join(word() for _ in range(int(rng.integers(1, 4))))}</a></li>' for _ in range(int(rng.integers(2, 9))))
        return pick(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="nav navbar">{}</ul>', '<nav class="breadcrumbs">{}</nav>', '<div id="navigation">{}</div>', '<div role="navigation">{}</div>', "<header><ul>{}</ul></header>", '<div class="pagination pager">{}</div>', '<div class="tags share social">{}</div>']).format(items)

    def aside():
        text = prose(3, 40)
        inner = pick(["{}", "<p>{}</p>", "<h3>" + prose(1, 4) + "</h3><p>{}</p>", "<ul><li><a href='/x'>{}</a></li></ul>", "<span>{}</span>", "<a href='/y'>{}</a>"]).format(text)
        inner = deep(inner)
        return pick(['<div class="ad">{}</div>', '<div class="ads banner">{}</div>', '<div class="advert">{}</div>', '<div class="sponsored promo">{}</div>', "<aside>{}</aside>", '<aside class="sidebar">{}</aside>', '<div class="sidebar">{}</div>', '<div id="sidebar" class="widget">{}</div>', '<div class="related">{}</div>', '<div class="cookie notice">{}</div>', '<div id="cookie-banner">{}</div>', '<div class="alert consent">{}</div>', '<div class="notice">{}</div>', '<div class="newsletter popup">{}</div>', '<section class="related recommended">{}</section>', '<div class="advertisement">{}</div>', '<div class="cookies gdpr privacy">{}</div>', '<div class="modal overlay subscribe">{}</div>']).format(inner)

    def form():
        return pick(["<form><label>{}</label><input><button>{}</button></form>", '<form class="search"><p>{}</p><select><option>{}</option></select></form>', '<form action="/s"><fieldset><legend>{}</legend><button>{}</button></fieldset></form>', '<div class="search form"><label>{}</label><button>{}</button></div>']).format(prose(1, 5), word())

    def comments():
        one = lambda: pick(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li class='comment'><span class='author'>{}</span><p>{}</p></li>", "<article class='comment'><h4>{}</h4><p>{}</p></article>", "<p><b>{}</b>: {}</p>"]).format(word(), prose(3, 60))
        inner = deep("".join(one() for _ in range(int(rng.integers(1, 6)))))
        return pick(['<div class="comments">{}</div>', '<section id="comments"><h2>' + prose(1, 3) + "</h2>{}</section>", '<ol class="comment-list">{}</ol>', '<div id="disqus_thread" class="responses comments">{}</div>', '<section class="comments">{}</section>', '<div class="reader-comments discussion">{}</div>']).format(inner)

    def footer():
        text = pick(["&copy; {} &middot; {}", "{} {}", "{} | {}", "Copyright 2024 {} {}", "© {} {}"]).format(word(), prose(2, 20))
        return pick(["<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>', '<div class="copyright legal">{}</div>', '<footer class="site-footer"><small>{}</small></footer>']).format(text)

    def header():
        return pick(["<header><h1>{}</h1></header>", '<header class="site"><a href="/">{}</a></header>', '<div class="header top"><p>{}</p></div>', '<div id="masthead" class="logo">{}</div>', "<header><p>{}</p></header>", '<div class="topbar">{}</div>']).format(prose(1, 12))

    def article():
        kept, body = [], []

        def add(form_, low, high):
            text = prose(low, high)
            kept.append(text)
            if chance(0.3):
                words = text.split(" ")
                k = int(rng.integers(len(words)))
                words[k] = pick(["<b>{}</b>", "<em>{}</em>", "<a href='/z'>{}</a>", "<i>{}</i>", "<span>{}</span>", "<code>{}</code>"]).format(words[k])
                text = " ".join(words)
            body.append(form_.format(text))

        for k in range(int(rng.integers(1, 18))):
            kind = rng.random()
            if k == 0 and chance(0.8):
                add("<h1>{}</h1>", 2, 14)
            elif kind < 0.62:
                add("<p>{}</p>", 1, 120)
            elif kind < 0.72:
                add("<p><b>{}<br>", 1, 60)
            elif kind < 0.78:
                add(pick(["<h2>{}</h2>", "<h3>{}</h3>"]), 1, 8)
            elif kind < 0.84:
                body.append("<ul>")
                for _ in range(int(rng.integers(1, 5))):
                    add("<li>{}</li>", 1, 14)
                body.append("</ul>")
            elif kind < 0.88:
                add(pick(["<blockquote><p>{}</p></blockquote>", "<blockquote>{}</blockquote>"]), 3, 50)
            elif kind < 0.92:
                add(pick(["<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>"]), 1, 30)
            elif kind < 0.96:
                body.append(pick([aside, form, aside])())
            else:
                add("{}<br>", 1, 40)
        inner = deep("".join(body))
        return pick(["<article>{}</article>"] * 6 + ['<div class="content">{}</div>', '<main>{}</main>', "<main><article>{}</article></main>", '<div id="content" class="post">{}</div>', '<div class="article body">{}</div>', '<div class="entry-content">{}</div>', '<article class="post"><div class="text">{}</div></article>', '<section class="story">{}</section>', '<div role="main">{}</div>']).format(inner), kept

    for _ in range(n):
        main, kept = article()
        before = [x() for x in (header, menu, aside, form) for _ in range(int(rng.integers(0, 3))) if chance(0.5)]
        after = [x() for x in (aside, comments, menu, form, aside) if chance(0.4)] + [footer() for _ in range(2) if chance(0.7)]
        rng.shuffle(before)
        page = "".join(["<html><head><title>", prose(1, 9), "</title></head><body>", *before, deep(main), *map(deep, after), *["</body></html>"] * chance(0.9)])
        if chance(0.3):
            page = page.replace("<body>", "<body><div class='wrapper page'>", 1)
        yield page, kept


@functools.lru_cache(1)
def trained(pages: int = 1600, epochs: int = 6, seed: int = 11) -> Labeller:
    """The labeller, fitted to `pages` drafted pages."""
    xs, ys = [], []
    for page, kept in drafts(pages, seed):
        own, wanted = blocks(page), set(kept)
        if own:
            xs.append(encode(own))
            ys.append(np.array([text in wanted for _, text, _ in own], dtype=np.float32))
    return Labeller().train(xs, ys, epochs, seed)


def main_text(sources: list[str | None], model: Labeller) -> list[str]:
    pages = [blocks(s) for s in sources]
    keep = model.label([encode(p) for p in pages])
    return [" ".join(text for (_, text, _), k in zip(page, own, strict=True) if k) for page, own in zip(pages, keep, strict=True)]


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars), a row for each row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = main_text(batch.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return own.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
