"""Main text of web pages by a recurrent block labeller (operator 8).

A page is a sequence of text blocks. Each block is described by a mean of
vectors of its tag path, a mean of vectors of its hashed words and a few
numbers; a bidirectional LSTM reads the whole sequence, so every block is
classified with the document's context, and blocks labelled main are joined.

The labeller is trained in numpy on pages whose labels are known: a bounded
sample of the table's pages, labelled by their semantic elements where they have
them, and pages composed from the same sample's sentences in many layouts. It
is fitted once at the driver; tasks apply it to batches of whole pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.common import small_batches, table
from tidemark.llm.html_blocks import Page, parse

#: Bound of the training sample, and pages composed from its sentences.
SAMPLE_PAGES = 300
COMPOSED = 700
PATH_ROWS, PATH_DIM = 2048, 16
WORD_ROWS, WORD_DIM = 2048, 8
NUMBERS = 7
HIDDEN = 16
EPOCHS = 6
#: Blocks, with padding, that the network reads at once.
CELLS = 1 << 16

#: Words of classes and ids, and elements, that mark what is not the article (fixed values).
BOILER_WORDS = frozenset("ad ads advert advertisement adbox banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar side aside widget rail notice cookie cookies consent alert popup modal newsletter subscribe signup login form search share sharing social comment comments reply replies respond disqus discussion related recommended pager pagination copyright legal disclaimer".split())
BOILER_TAGS = frozenset("nav footer aside form button dialog menu".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article content entry post story body text main".split())


def rule_labels(page: Page) -> list[int]:
    """Labels of the blocks of a page without data-y marks, by their elements: 1 for the article.

    In a page with article or main elements, what is inside of the innermost of
    them counts, without what is marked as boilerplate there.
    """
    has_article = any(n[2:] in MAIN_TAGS and n[0] == "t" for names in page.names for n in names)
    state = []  # per element: (inside a main element, a boilerplate element around, such a word since the main element, such a word or header anywhere, prose since the main element)
    for up, names in zip(page.parent, page.names, strict=True):
        main, boiler, word, any_word, prose = state[up] if up >= 0 else (False,) * 5
        for n in names:
            if n[0] == "t" and n[2:] in MAIN_TAGS:
                main, word, prose = True, False, False
            boiler |= n[0] == "t" and n[2:] in BOILER_TAGS
            word |= n[0] == "c" and n[2:] in BOILER_WORDS
            any_word |= n == "t:header" or (n[0] == "c" and n[2:] in BOILER_WORDS)
            prose |= n in ("t:p", "t:h1", "t:h2", "t:h3", "t:blockquote", "t:pre")
        state.append((main, boiler, word, any_word, prose))
    out = []
    for b in page.blocks:
        main, boiler, word, any_word, prose = state[b.at] if b.at >= 0 else (False,) * 5
        out.append(int(not boiler and not word and (main or (not has_article and not any_word and prose))))
    return out


def compose(sentences: list[str], rng: np.random.Generator) -> str:
    """A page in a random layout; data-y marks what is the article (1) and what is not (0)."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    words = lambda n: " ".join(pick(sentences).split()[: int(n)])
    prose = lambda: " ".join(pick(sentences) for _ in range(rng.integers(1, 4)))
    attr = lambda *names: f'{pick(["class", "class", "id"])}="{pick([*names])}"'
    box = lambda tag, inner, *names: f"<{tag}{' ' + attr(*names) if names and rng.random() < 0.8 else ''} data-y=\"0\">{inner}</{tag}>"
    links = lambda n: "".join(f'<li><a href="/x">{words(rng.integers(1, 4))}</a></li>' for _ in range(n))

    def menu() -> str:
        inner = f"<ul>{links(rng.integers(2, 9))}</ul>"
        return pick([f'<nav data-y="0">{inner}</nav>', f'<div {attr("menu", "navbar", "nav-main", "navigation", "breadcrumbs")} data-y="0">{inner}</div>', f'<ul {attr("menu", "nav", "top-menu")} data-y="0">{links(5)}</ul>'])

    def advert() -> str:
        return f'<{(t := pick(["div", "div", "aside", "section", "p"]))} {attr("ad", "ads", "advert", "ad-box", "sponsored", "banner", "promo")} data-y="0">{pick([prose(), words(8)])}</{t}>'

    def header() -> str:
        return f'<{(t := pick(["header", "div"]))} {attr("header", "site-header", "masthead", "topbar")} data-y="0">{pick([f"<h1>{words(4)}</h1>", f"<p>{words(9)}</p>", f"<a href=x>{words(2)}</a>"])}</{t}>' + (menu() if rng.random() < 0.5 else "")

    def notice() -> str:
        return f'<{(t := pick(["div", "section", "aside"]))} {attr("cookie-notice", "notice", "consent", "alert", "cookie-banner", "popup", "newsletter")} data-y="0">{pick([prose(), f"<p>{prose()}</p>"])}{pick(["", "<button>OK</button>"])}</{t}>'

    def sidebar() -> str:
        return f'<{(t := pick(["aside", "div"]))}{pick(["", " " + attr("sidebar", "side", "widget", "related", "recommended")]) if t == "aside" else " " + attr("sidebar", "side", "widget", "related", "recommended")} data-y="0">{pick([f"<h3>{words(3)}</h3><ul>{links(4)}</ul>", f"<p>{prose()}</p>", f"<h2>{words(2)}</h2><p>{prose()}</p>", words(9)])}</{t}>'

    def form() -> str:
        return f'<form{pick(["", " " + attr("search", "login", "signup", "subscribe")])} data-y="0"><label>{words(3)}</label><input name="q"><p>{words(6)}</p><button>{words(1)}</button></form>'

    def comments() -> str:
        one = lambda: pick([f'<div class="comment"><b>{words(2)}</b><p>{prose()}</p></div>', f'<li class="comment">{prose()}</li>', f"<p>{prose()}</p>", f"<article><p>{prose()}</p></article>"])
        return f'<{(t := pick(["div", "section", "ol", "aside"]))} {attr("comments", "comment-list", "replies", "discussion", "respond", "reader-comments")} data-y="0">{pick(["", f"<h2>{words(2)}</h2>"])}{"".join(one() for _ in range(rng.integers(1, 6)))}</{t}>'

    def footer() -> str:
        inner = pick([f"&copy; {words(3)} &middot; {words(6)}", f"<p>{words(9)}</p>", f"<p>{prose()}</p>", f"<ul>{links(4)}</ul>"])
        return pick([f'<footer data-y="0">{inner}</footer>', f'<div {attr("footer", "site-footer", "bottom", "legal", "copyright")} data-y="0">{inner}</div>'])

    def article() -> str:
        parts = [pick(["", f"<h1>{words(7)}</h1>", f"<h1>{words(7)}</h1>", f"<h2>{words(5)}</h2>"])]
        for _ in range(rng.integers(1, 14)):
            parts.append(pick([f"<p>{prose()}</p>"] * 8 + [f"<h2>{words(4)}</h2>", f"<p>{words(rng.integers(1, 6))}</p>", f"<ul><li>{words(9)}</li><li>{prose()}</li></ul>", f"<blockquote>{prose()}</blockquote>", f"<p><b>{prose()}<br><p>", f"<pre>{words(12)}</pre>", f"<table><tr><td>{words(2)}</td><td>{words(5)}</td></tr></table>", f"<div>{prose()}</div>", f'<p>{words(9)} <a href="y">{words(3)}</a> {words(8)}</p>']))
            if rng.random() < 0.06:
                parts.append(pick([advert, sidebar, notice])())
        if rng.random() < 0.12:
            parts.append(pick([comments, form])())
        open_, close = pick([("<article", "article")] * 4 + [("<main", "main"), (f"<div {attr('content', 'post', 'entry-content', 'article-body', 'story', 'main')}", "div"), ("<main><article", "article></main"), ("<div", "div")])
        return f'{open_} data-y="1">{"".join(parts)}</{close}>'

    some = lambda f, p: f() if rng.random() < p else ""
    body = some(notice, 0.15) + some(header, 0.4) + some(menu, 0.7) + some(advert, 0.5) + some(form, 0.15) + some(sidebar, 0.2) + article() + some(advert, 0.2) + some(comments, 0.35) + some(sidebar, 0.3) + some(form, 0.1) + some(notice, 0.1) + some(footer, 0.8)
    page = f"<html><head><title>{words(6)}</title></head><body>{body}</body></html>"
    return page[: rng.integers(len(page) // 2, len(page))] if rng.random() < 0.08 else page


def _slot(name: str, rows: int) -> int:
    return zlib.crc32(name.encode()) % rows


#: The vector that ends every path.
END = _slot("end", PATH_ROWS)


class Features:
    """Arrays that describe the blocks of some pages, one after another."""

    def __init__(self, pages: list[Page]) -> None:
        flat = [b for p in pages for b in p.blocks]
        self.pages = np.cumsum([0, *(len(p.blocks) for p in pages)])
        self.trees = np.cumsum([0, *(len(p.parent) for p in pages)])  # elements of each page
        slots: dict[str, int] = {}
        named = [names for p in pages for names in p.names]
        self.name = np.fromiter((slots.setdefault(n, _slot(n, PATH_ROWS)) if n not in slots else slots[n] for names in named for n in names), np.int64)
        self.name_at = np.cumsum([0, *map(len, named)])
        shift = np.repeat(self.trees[:-1], np.diff(self.trees))
        up = np.fromiter((u for p in pages for u in p.parent), np.int64)
        self.parent = np.where(up >= 0, up + shift, -1)
        at = np.fromiter((b.at for b in flat), np.int64)
        self.element = np.where(at >= 0, at + np.repeat(self.trees[:-1], np.diff(self.pages)), -1)
        w = tk.words(pa.array([b.text for b in flat], pa.large_string()))
        self.word = (tk.word_hashes(tk.lower_ascii(w)) % np.uint64(WORD_ROWS)).astype(np.int64)
        self.word_at = w.first
        self._level()
        chars = np.array([len(b.text) for b in flat], np.float64)
        n_words = np.maximum(np.diff(w.first), 1)
        place = np.concatenate([np.arange(len(p.blocks)) / max(1, len(p.blocks) - 1) for p in pages]) if flat else np.zeros(0)
        self.numbers = np.stack([
            np.log1p(chars) / 6, np.array([b.linked for b in flat]) / np.maximum(chars, 1), np.log1p(n_words) / 4, place,
            np.minimum(self.path_size, 60) / 10, np.array([b.text[-1] in ".!?" for b in flat], np.float64), chars / n_words / 10,
        ], axis=1).astype(np.float32) if flat else np.zeros((0, NUMBERS), np.float32)

    def _level(self) -> None:
        """Elements by depth, and the number of names on each block's path."""
        n = len(self.parent)
        depth, size = [0] * n, np.diff(self.name_at).tolist()
        for i, up in enumerate(self.parent.tolist()):  # parents come first
            if up >= 0:
                depth[i] = depth[up] + 1
                size[i] += size[up]
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(np.array(depth, np.int64)[order])) + 1) if n else []
        self.path_size = np.where(self.element >= 0, np.array([*size, 0])[self.element], 0)

    def take(self, which: np.ndarray) -> Features:
        """The same for some of the pages."""
        out = object.__new__(Features)
        ranges = lambda at, own: np.concatenate([np.arange(at[i], at[i + 1]) for i in own]) if len(own) else np.zeros(0, np.int64)
        sizes = lambda at: np.cumsum([0, *np.diff(at)[which]])
        out.pages, out.trees = sizes(self.pages), sizes(self.trees)
        elements, own = ranges(self.trees, which), ranges(self.pages, which)
        out.name, out.name_at = self.name[ranges(self.name_at, elements)], np.cumsum([0, *np.diff(self.name_at)[elements]])
        out.word, out.word_at = self.word[ranges(self.word_at, own)], np.cumsum([0, *np.diff(self.word_at)[own]])
        back = np.repeat(out.trees[:-1] - self.trees[:-1][which], np.diff(out.trees))
        out.parent = np.where(self.parent[elements] >= 0, self.parent[elements] + back, -1)
        back = np.repeat(out.trees[:-1] - self.trees[:-1][which], np.diff(out.pages))
        out.element = np.where(self.element[own] >= 0, self.element[own] + back, -1)
        out.numbers = self.numbers[own]
        out._level()
        return out

    def path_means(self, vectors: np.ndarray) -> np.ndarray:
        """Mean of the vectors of the names on each block's path and of the end; sums of a path start from its parent's."""
        sums = np.concatenate([_sums(vectors, self.name, self.name_at), np.zeros((1, vectors.shape[1]), np.float32)])  # the last is no element's
        for level in self.levels[1:]:
            sums[level] += sums[self.parent[level]]
        return (sums[self.element] + vectors[END]) / (self.path_size + 1)[:, None]

    def path_gradient(self, d: np.ndarray, out: np.ndarray) -> None:
        """Add to ``out`` what the gradient ``d`` of path_means is by the names' vectors."""
        d = d / (self.path_size + 1)[:, None]
        out[END] += d.sum(axis=0)
        sums = np.zeros((len(self.parent) + 1, d.shape[1]), np.float32)
        np.add.at(sums, self.element, d)
        for level in self.levels[:0:-1]:
            np.add.at(sums, self.parent[level], sums[level])
        np.add.at(out, self.name, np.repeat(sums[:-1], np.diff(self.name_at), axis=0))


def _sums(vectors: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the vectors of each range of ``index``."""
    sums = np.zeros((len(at) - 1, vectors.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        sums[full] = np.add.reduceat(vectors[index], at[:-1][full], axis=0)
    return sums


class Labeller:
    """Bidirectional LSTM over the blocks of a page."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + NUMBERS
        f = lambda *shape, s=0.2: rng.normal(0, s, shape).astype(np.float32)
        self.p = {"path": f(PATH_ROWS, PATH_DIM, s=0.5), "word": f(WORD_ROWS, WORD_DIM, s=0.1), "out": f(2 * HIDDEN + d), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": f(d, 4 * HIDDEN), f"h{side}": f(HIDDEN, 4 * HIDDEN), f"c{side}": np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)}

    def inputs(self, f: Features) -> np.ndarray:
        words = _sums(self.p["word"], f.word, f.word_at) / np.maximum(np.diff(f.word_at), 1)[:, None]
        return np.concatenate([f.path_means(self.p["path"]), words, f.numbers], axis=1).astype(np.float32)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of one direction for padded sequences x (pages, time, d)."""
        n, t, _ = x.shape
        zx = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        h, c, out, held = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, t, HIDDEN), np.float32), []
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = zx[:, k] + h @ self.p[f"h{side}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, g, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            new = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c1 = (g * c + i * new) * m
            tc = np.tanh(c1)
            h1 = o * tc * m
            if keep:
                held.append((k, h, c, i, g, o, new, tc, m))
            h, c = h1, c1
            out[:, k] = h
        return out, held

    def _back(self, side: str, x: np.ndarray, held: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        dx, dh, dc = np.zeros_like(x), 0, 0
        wx, wh = self.p[f"x{side}"], self.p[f"h{side}"]
        for k, h0, c0, i, g, o, new, tc, m in reversed(held):
            dh = (dout[:, k] + dh) * m
            dc = (dc + dh * o * (1 - tc * tc)) * m
            dz = np.concatenate([dc * new * i * (1 - i), dc * c0 * g * (1 - g), dh * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1)
            grads[f"x{side}"] += x[:, k].T @ dz
            grads[f"h{side}"] += h0.T @ dz
            grads[f"c{side}"] += dz.sum(axis=0)
            dx[:, k] = dz @ wx.T
            dh, dc = dz @ wh.T, dc * g
        return dx

    def _padded(self, f: Features, flat: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.diff(f.pages)[pages]
        at = f.pages[:-1][pages][:, None] + np.arange(n.max())
        mask = np.arange(n.max()) < n[:, None]
        at = np.where(mask, at, 0)
        return flat[at] * mask[:, :, None], mask.astype(np.float32), at

    def predict(self, f: Features) -> np.ndarray:
        """Probability that each block is of the article. Pages are read in batches of at most CELLS blocks with padding, or one page."""
        flat, out = self.inputs(f), np.zeros(f.pages[-1], np.float32)
        order = np.argsort(np.diff(f.pages), kind="stable")
        order = order[np.diff(f.pages)[order] > 0]
        size, a = np.diff(f.pages), 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 64 and (b + 1 - a) * size[order[b]] <= CELLS:
                b += 1
            x, mask, at = self._padded(f, flat, order[a:b])
            a = b
            hf, _ = self._run("f", x, mask, False)
            hb, _ = self._run("b", x, mask, False)
            z = np.concatenate([hf, hb, x], axis=2) @ self.p["out"] + self.p["bias"]
            out[at[mask > 0]] = 1 / (1 + np.exp(-z[mask > 0]))
        return out

    def gradients(self, f: Features, x: np.ndarray, mask: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """(mean log loss, its gradients) for padded inputs ``x`` of the pages of ``f`` and labels ``y`` of their blocks."""
        hf, kf = self._run("f", x, mask, True)
        hb, kb = self._run("b", x, mask, True)
        u = np.concatenate([hf, hb, x], axis=2)
        p = 1 / (1 + np.exp(-(u @ self.p["out"] + self.p["bias"])))
        loss = -float((np.where(y[at] > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12)) * mask).sum() / mask.sum())
        dz = (p - y[at]) * mask / mask.sum()
        grads = {k: np.zeros_like(q) for k, q in self.p.items()}
        grads["out"] += np.einsum("ntd,nt->d", u, dz)
        grads["bias"] += dz.sum()
        du = dz[:, :, None] * self.p["out"]
        dx = du[:, :, 2 * HIDDEN :] + self._back("f", x, kf, du[:, :, :HIDDEN], grads) + self._back("b", x, kb, du[:, :, HIDDEN : 2 * HIDDEN], grads)
        rows = np.zeros((f.pages[-1], dx.shape[2]), np.float32)
        rows[at[mask > 0]] = dx[mask > 0]
        f.path_gradient(rows[:, :PATH_DIM], grads["path"])
        n = np.diff(f.word_at)
        np.add.at(grads["word"], f.word, np.repeat(rows[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(n, 1)[:, None], n, axis=0))
        return loss, grads

    def fit(self, f: Features, y: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}, 0
        size = np.diff(f.pages)
        for epoch in range(EPOCHS):
            order = np.argsort(size + rng.integers(0, 9, len(size)), kind="stable")
            order = order[size[order] > 0]
            parts = [order[a : a + 16] for a in range(0, len(order), 16)]
            for i in rng.permutation(len(parts)):
                part = f.take(parts[i])
                x, mask, at = self._padded(part, self.inputs(part), np.arange(len(parts[i])))
                grads = self.gradients(part, x, mask, at, y[np.concatenate([np.arange(f.pages[j], f.pages[j + 1]) for j in parts[i]])])[1]
                step += 1
                rate = 0.01 * (1 - epoch / EPOCHS) + 0.001
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)


def trained(pages: list[str], seed: int = 3) -> Labeller:
    """A labeller fitted on some pages and on pages composed from their sentences."""
    rng = np.random.default_rng(seed)
    parsed = [parse(p) for p in pages]
    sentences = [s for p in parsed for b in p.blocks for s in b.text.split(". ") if len(s) > 20][:20000] or ["A short line of plain text stands here for want of pages"]
    made = [parse(compose(sentences, rng)) for _ in range(COMPOSED)]
    labels = [rule_labels(p) for p in parsed] + [[int(b.mark == "1") for b in p.blocks] for p in made]
    model = Labeller(seed)
    model.fit(Features(parsed + made), np.array([y for p in labels for y in p], np.float32), seed)
    return model


def training_pages(pages: DataFrame) -> list[str]:
    """About SAMPLE_PAGES pages chosen by a hash of their id; the same for the same table."""
    able = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull())
    n = able.count()
    share = min(1.0, SAMPLE_PAGES / max(n, 1))
    rows = able.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("page_id", "html").orderBy("page_id", "html").limit(2 * SAMPLE_PAGES).collect()
    return [r["html"] for r in rows]


def extract_text(pages: DataFrame, keep: list[str], model: Labeller, html_col: str = "html") -> DataFrame:
    """Columns ``keep`` and __text of every row: the blocks labelled main, joined by one space.

    Null and empty pages, and pages without a main block, give an empty text.
    """
    small = pages.select(*keep, F.coalesce(html_col, F.lit("")).alias("__html"))
    schema = small.select(*keep).schema.add("__text", "string")
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.pieces(batches, "__html", 2 << 20):
            parsed = [parse(h) for h in b.column("__html").to_pylist()]
            f = Features(parsed)
            main = model.predict(f) >= 0.5
            texts = [" ".join(x.text for x, y in zip(p.blocks, main[a:], strict=False) if y) for p, a in zip(parsed, f.pages, strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return small.mapInArrow(run, schema)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    got = extract_text(pages, ["page_id", "url"], trained(training_pages(pages)))
    return got.select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
