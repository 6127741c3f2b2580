"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: the text between two block-level tags, with
character references decoded and white space joined. A block's vector is the mean
of learned vectors of its hashed tag path (tags and words of their class, id and
role attributes) and of its hashed words, beside a few plain measures. A
bidirectional LSTM in numpy reads the blocks of the whole page in order and gives
each the probability of being main text; those of 1/2 and more are joined.

The model is trained here, on pages that a generator makes with their labels known
(articles of made-up words among menus, banners, side columns, notices, adverts,
forms, footers and comments, in many tag and class conventions). It has a fixed
size and is broadcast; extraction is one pass over the pages.

Defined cases: a null or empty html has no block and gives an empty text. Text
outside of any tag is a block. Unclosed and truncated tags, comments, scripts and
styles end with the page. Repeated rows give equal texts; an empty table gives an
empty result. Other columns are kept; the text has a free name. White space is that
of Unicode. Formulas, fallbacks of objects and the like are judged as other text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rdfloom.llm.common import free_name, small_batches

#: Elements whose tags end a block, elements without an end tag, and elements whose content is never text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody td template tfoot th thead tr ul canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title noembed noframes".split())
#: A new one of these closes an open one of the same kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")

BITS, WIDTH, HIDDEN, PLAIN = 12, 24, 24, 8
#: Blocks of a batch of pages that are labelled at once (a longer page is alone), and steps whose gates are held.
CELLS, STEPS = 1 << 15, 1 << 10


@lru_cache(maxsize=1 << 16)
def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) >> (32 - BITS)


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, tag path, share of the text in links) of each leaf block."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    path: list[str] = []  # tags, each with its attribute words
    held: list[str] = []
    linked = in_link = 0
    raw_until = ""

    def close() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                out.append((text, tuple(path), min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    page = page or ""
    at, n = 0, len(page)
    while at < n:
        if raw_until:  # nothing but its end tag ends it
            m = re.compile(rf"</{re.escape(raw_until)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at, raw_until = (m.end() if m else n), ""
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                text = html.unescape(m[0]) if "&" in m[0] else m[0]
                held.append(text)
                linked += len(text) * bool(in_link)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCK:
                close()
                for k in range(len(path) - 1, -1, -1):
                    if path[k].split(".", 1)[0] == tag:
                        del path[k:]
                        break
            continue
        if not m[0].endswith(">"):  # cut off inside a tag
            break
        if tag in RAW:
            if not m[3].endswith("/"):
                raw_until = tag
            continue
        if tag == "br":
            held.append(" ")
        if tag == "a":
            in_link += 1
        if tag in BLOCK:
            close()
            in_link = 0
            if tag in SELF_CLOSING and path and path[-1].split(".", 1)[0] == tag:
                path.pop()
            if tag not in VOID:
                words = {w for v in _NAMED.findall(m[3]) for w in _PART.findall("".join(v).lower())} if m[3] else ()
                path.append(".".join([tag, *sorted(words)]))
    close()
    return out


def features(block: tuple[str, tuple[str, ...], float], place: float) -> tuple[list[int], list[int], list[float]]:
    """Hashed tag path, hashed words and plain measures of a block; place is where it starts in the page, 0 to 1."""
    text, path, linked = block
    tags = []
    for depth, step in enumerate(reversed(path)):
        tag, *words = step.split(".")
        tags += [_hash(f"t:{tag}"), _hash(f"d{min(depth, 3)}:{tag}"), *(_hash(f"c:{w}") for w in words)]
    words = _WORD.findall(text.lower())
    own = [_hash(f"w:{w}") for w in words]
    n = len(words)
    plain = [
        np.log1p(n) / 4,
        linked,
        min(1.0, sum(map(text.count, ".,;:!?")) * 400 / max(400, len(text)) / 12),
        float(text[-1:] in ".!?\"'”»"),
        float("©" in text or "opyright" in text),
        place,
        min(len(path), 10) / 10,
        1.0,
    ]
    return tags or [_hash("t:")], own or [_hash("w:")], plain


class Labeller:
    """Bidirectional LSTM over block vectors; arrays by name."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = 2 * WIDTH + PLAIN
        self.w = {"tags": rng.normal(0, 0.3, (1 << BITS, WIDTH)), "words": rng.normal(0, 0.02, (1 << BITS, WIDTH)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in ("f", "b"):
            self.w |= {f"x{d}": rng.normal(0, size**-0.5, (size, 4 * HIDDEN)), f"h{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    def _inputs(self, page: Features) -> np.ndarray:
        mean = [np.add.reduceat(self.w[name][page.index[k]], page.starts[k]) / page.counts[k][:, None] for k, name in enumerate(("tags", "words"))]
        return np.concatenate([*mean, page.plain], axis=1)

    def _run(self, x: np.ndarray, d: str, learn: bool = True) -> tuple[np.ndarray, list]:
        """x: time, batch, size; h: time, batch, HIDDEN. Without learn no trace is kept."""
        h = c = np.zeros((x.shape[1], HIDDEN))
        hs, trace = np.empty((len(x), x.shape[1], HIDDEN)), []
        for t in range(len(x)):
            if t % STEPS == 0:
                gates = x[t : t + STEPS] @ self.w[f"x{d}"] + self.w[f"c{d}"]
            a = gates[t % STEPS] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            th = np.tanh(c)
            if learn:
                trace.append((h, before, i, f, o, g, th))
            h = hs[t] = o * th
        return hs, trace

    def _back(self, x: np.ndarray, dh: np.ndarray, trace: list, d: str, grad: dict) -> np.ndarray:
        da = np.empty((len(x), x.shape[1], 4 * HIDDEN))
        h_next = c_next = np.zeros((x.shape[1], HIDDEN))
        for t in range(len(x) - 1, -1, -1):
            h, before, i, f, o, g, th = trace[t]
            gh = dh[t] + h_next
            gc = gh * o * (1 - th * th) + c_next
            da[t] = np.concatenate([gc * g * i * (1 - i), gc * before * f * (1 - f), gh * th * o * (1 - o), gc * i * (1 - g * g)], axis=1)
            h_next, c_next = da[t] @ self.w[f"h{d}"].T, gc * f
            grad[f"h{d}"] += h.T @ da[t]
        flat = da.reshape(-1, 4 * HIDDEN)
        grad[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[f"c{d}"] += flat.sum(axis=0)
        return da @ self.w[f"x{d}"].T

    def _forward(self, pages: list[Features], learn: bool = True) -> tuple:
        n = np.array([len(p) for p in pages])
        x = np.zeros((n.max(), len(pages), 2 * WIDTH + PLAIN))
        for k, p in enumerate(pages):
            x[: len(p), k] = self._inputs(p)
        # read backwards, each page from its own last block
        turn = np.where(np.arange(len(x))[:, None] < n, n - 1 - np.arange(len(x))[:, None], np.arange(len(x))[:, None])
        cols = np.arange(len(pages))
        hf, tf = self._run(x, "f", learn)
        xb = x[turn, cols]
        hb, tb = self._run(xb, "b", learn)
        both = np.concatenate([hf, hb[turn, cols]], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["out"] + self.w["bias"][0], -30, 30)))
        return n, x, xb, turn, cols, tf, tb, both, p

    def predict(self, pages: list[Features]) -> list[np.ndarray]:
        """Probabilities of the blocks of each page; pages of like lengths are run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            longest = len(pages[order[at]]) * 5 // 4 + 4
            stop = at + 1
            while stop < len(order) and stop - at < 128 and len(pages[order[stop]]) <= longest and (stop + 1 - at) * len(pages[order[stop]]) <= CELLS:
                stop += 1
            some = order[at:stop]
            p = self._forward([pages[k] for k in some], learn=False)[-1]
            for j, k in enumerate(some):
                out[k] = p[: len(pages[k]), j]
            at = stop
        return out

    def train(self, pages: list[Features], labels: list[list[int]], epochs: int = 6, batch: int = 32, rate: float = 6e-3, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda k: len(pages[k]) // 8)
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for i in rng.permutation(len(groups)):
                some = [k for k in groups[i] if len(pages[k])]
                if not some:
                    continue
                n, x, xb, turn, cols, tf, tb, both, p = self._forward([pages[k] for k in some])
                y, on = np.zeros_like(p), np.arange(len(x))[:, None] < n
                for c, k in enumerate(some):
                    y[: n[c], c] = labels[k]
                dz = np.where(on, p - y, 0) / on.sum()
                grad = {k: np.zeros_like(v) for k, v in self.w.items()}
                grad["out"], grad["bias"] = np.tensordot(dz, both, axes=([0, 1], [0, 1])), np.array([dz.sum()])
                d = dz[:, :, None] * self.w["out"]
                dx = self._back(x, d[:, :, :HIDDEN], tf, "f", grad)
                # turn is its own inverse on each page
                dx += self._back(xb, d[:, :, HIDDEN:][turn, cols], tb, "b", grad)[turn, cols]
                for j, name in enumerate(("tags", "words")):
                    index = np.concatenate([pages[k].index[j] for k in some])
                    each = [np.repeat(dx[: n[c], c, j * WIDTH : (j + 1) * WIDTH] / pages[k].counts[j][:, None], pages[k].counts[j], axis=0) for c, k in enumerate(some)]
                    np.add.at(grad[name], index, np.concatenate(each))
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)


# -- pages to train on

#: Names that page parts go by.
NAMES = {
    "article": "article post entry content main story body text news page blog single richtext prose",
    "menu": "nav menu navbar navigation breadcrumb topnav links tabs pagination pager toolbar",
    "header": "header masthead banner top branding logo site title hero",
    "footer": "footer bottom copyright legal colophon credits foot imprint",
    "sidebar": "sidebar aside related recommended widget rail secondary trending popular tags teaser",
    "notice": "notice cookie consent gdpr alert popup modal banner privacy overlay subscribe newsletter",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense",
    "form": "form search login signup subscribe newsletter contact poll",
    "comment": "comment comments reply replies discussion disqus responses thread commentlist reader",
}
TAGS = {
    "menu": ("nav", "div", "ul", "section"),
    "header": ("header", "div", "section"),
    "footer": ("footer", "div", "section"),
    "sidebar": ("aside", "div", "section"),
    "notice": ("div", "section", "p", "aside", "dialog"),
    "advert": ("div", "aside", "section", "p"),
    "form": ("form",),
    "comment": ("section", "div", "ol", "ul", "aside"),
}


class Pages:
    """Made-up pages with the label of each block; marks in the text carry the labels through blocks()."""

    MARK = ""

    def __init__(self, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        parts = [a + b for a in ("", "b", "d", "f", "gr", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "v", "sch") for b in ("a", "e", "i", "o", "u", "en", "er", "in", "é", "ö", "ión")]
        self.words = ["".join(self.pick(parts) for _ in range(1 + self.rng.integers(3))) for _ in range(4000)]

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def sentence(self, low: int, high: int, end: str = ".") -> str:
        n = int(self.rng.integers(low, high + 1))
        words = [self.pick(self.words) for _ in range(n)]
        for i in range(6, n - 1, 9):
            words[i] += ","
        return " ".join(words).capitalize() + end

    def prose(self, most: int = 9) -> str:
        text = " ".join(self.sentence(1, 22) for _ in range(int(self.rng.integers(1, most + 1))))
        r = self.rng.random()
        if r < 0.04:
            return text.replace(" ", self.pick([" | ", "!! ", "### ", "&amp;&amp; ", "$$$ "]))
        return text.upper() if r < 0.06 else " ".join([text.split()[0]] * 30) if r < 0.07 else text

    def named(self, tag: str, kind: str, inside: str, p: float = 0.85) -> str:
        words = NAMES[kind].split()
        at = ""
        if self.chance(p):
            name = self.pick(words) + (self.pick(["", "-", "_"]) + self.pick([self.pick(words), "box", "wrap", "inner", "1", "area", "container", "list"]) if self.chance(0.5) else "")
            at = f' {self.pick(["class", "class", "id"])}="{name}"'
        return f"<{tag}{at}>{inside}</{tag}>"

    def main(self, text: str) -> str:
        return self.MARK + text

    def article(self) -> str:
        out = []
        if self.chance(0.9):
            title = self.sentence(2, 12, self.pick(["", "", "."]))
            out.append(f"<h1>{self.main(title)}</h1>")
        for _ in range(int(self.pick([1, 2, 3, 5, 8, 13, 21]))):
            r = self.rng.random()
            text = self.main(self.prose())
            if r < 0.06:
                out.append(f"<h{self.rng.integers(2, 5)}>{self.main(self.sentence(1, 8, ''))}</h2>")
            elif r < 0.1:
                out.append("<ul>" + "".join(f"<li>{self.main(self.sentence(2, 14))}</li>" for _ in range(4)) + "</ul>")
            elif r < 0.14:
                out.append(f"<blockquote>{text}</blockquote>")
            elif r < 0.2:
                out.append(f"<p><b>{text}<br><p>{self.main(self.prose())}</p>")
            elif r < 0.25:
                out.append(f"<p>{text} <a href='/x'>{self.sentence(1, 5, '')}</a> {self.sentence(2, 8)}</p>")
            elif r < 0.38:
                out.append(f"<p>{self.main(self.sentence(1, self.pick([1, 2, 4, 9])))}</p>")
            elif r < 0.4:
                out.append(f"<div>{text}</div>")
            else:
                out.append(f"<p>{text}</p>")
            if self.chance(0.04):
                out.append(self.advert())
            if self.chance(0.02):
                out.append(self.sidebar())
        body = "".join(out)
        r = self.rng.random()
        if r < 0.55:
            return self.named("article", "article", body, 0.3)
        if r < 0.75:
            return self.named("main", "article", body, 0.3)
        return self.named(self.pick(["div", "section", "td"]), "article", body, 1.0)

    def links(self, most: int = 8, words: int = 2) -> str:
        inside = [f'<a href="/x">{self.sentence(1, words, "")}</a>' for _ in range(int(self.rng.integers(2, most + 1)))]
        r = self.rng.random()
        if r < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in inside) + "</ul>"
        return self.pick([" ", " | ", " &middot; "]).join(inside) if r < 0.85 else "".join(f"<div>{x}</div>" for x in inside)

    def menu(self) -> str:
        return self.named(self.pick(TAGS["menu"][:1] * 3 + TAGS["menu"]), "menu", self.links())

    def header(self) -> str:
        inside = f"<{self.pick(['h1', 'h2', 'div', 'p', 'span'])}>{self.sentence(1, 6, '')}</div>" + (f"<p>{self.sentence(2, 10)}</p>" if self.chance(0.5) else "") + (self.links() if self.chance(0.3) else "")
        return self.named(self.pick(TAGS["header"]), "header", inside, 1.0)

    def footer(self) -> str:
        inside = self.pick(["&copy; ", "© ", "Copyright "]) + self.sentence(1, 4, "") + self.pick([" &middot; ", " | ", " ", ". "]) + self.sentence(2, 16)
        inside = self.pick([inside, f"<p>{inside}</p>", f"<div>{inside}</div>"]) + (self.links() if self.chance(0.3) else "")
        return self.named(self.pick(TAGS["footer"][:1] * 3 + TAGS["footer"]), "footer", inside, 0.9)

    def sidebar(self) -> str:
        inside = f"<h{self.rng.integers(2, 5)}>{self.sentence(1, 4, '')}</h3>" + self.pick([self.links(6, 8), f"<p>{self.prose(3)}</p>", "".join(f"<p>{self.sentence(3, 16)}</p>" for _ in range(3))])
        return self.named(self.pick(TAGS["sidebar"]), "sidebar", inside, 1.0)

    def notice(self) -> str:
        return self.named(self.pick(TAGS["notice"]), "notice", self.pick(["", "<p>"]) + self.prose(3) + (f"<button>{self.sentence(1, 2, '')}</button>" if self.chance(0.5) else ""), 1.0)

    def advert(self) -> str:
        text = self.prose(2)
        return self.named(self.pick(TAGS["advert"]), "advert", self.pick([text, f"<p>{text}</p>", f'<a href="/x">{text}</a>']), 1.0)

    def form(self) -> str:
        return self.named("form", "form", f"<label>{self.sentence(1, 4, '')}</label><input name=q><p>{self.sentence(2, 12)}</p><button>{self.sentence(1, 2, '')}</button><select><option>{self.sentence(1, 2, '')}<option>{self.sentence(1, 2, '')}</select>")

    def comments(self) -> str:
        one = lambda: self.named(self.pick(["div", "li", "article", "p"]), "comment", f"<{self.pick(['b', 'h4', 'span', 'cite'])}>{self.sentence(1, 2, '')}</b> " + self.pick([self.prose(3), f"<p>{self.prose(3)}</p>"]), 0.8)
        return self.named(self.pick(TAGS["comment"]), "comment", (f"<h3>{self.sentence(1, 3, '')}</h3>" if self.chance(0.6) else "") + "".join(one() for _ in range(int(self.rng.integers(1, 6)))), 1.0)

    def page(self) -> str:
        some = lambda p, f: f() if self.chance(p) else ""
        before = [some(0.75, self.menu), some(0.35, self.header), some(0.2, self.notice), some(0.5, self.advert), some(0.15, self.form), some(0.15, self.sidebar), some(0.1, self.menu)]
        after = [some(0.25, self.advert), some(0.35, self.comments), some(0.3, self.sidebar), some(0.15, self.form), some(0.15, self.notice), some(0.8, self.footer), some(0.1, self.menu)]
        if self.chance(0.4):
            before = [before[i] for i in self.rng.permutation(len(before))]
        if self.chance(0.4):
            after = [after[i] for i in self.rng.permutation(len(after))]
        body = "".join(before) + self.article() + "".join(after)
        if self.chance(0.3):
            body = self.named("div", self.pick(["header", "article"]), body, 0.0) if self.chance(0.5) else f'<div id="{self.pick(["wrapper", "page", "container", "root", "app"])}">{body}</div>'
        page = f"<!DOCTYPE html><html><head><title>{self.sentence(2, 8, '')}</title></head><body>{body}</body></html>"
        return page[: int(len(page) * self.rng.uniform(0.3, 1))] if self.chance(0.12) else page

    def labelled(self, n: int) -> tuple[list[Features], list[list[int]]]:
        """Features and labels of n pages."""
        pages, labels = [], []
        for _ in range(n):
            found = blocks(self.page())
            labels.append([int(self.MARK in b[0]) for b in found])
            pages.append(page_features([(b[0].replace(self.MARK, ""), *b[1:]) for b in found]))
        return pages, labels


class Features:
    """Blocks of a page: hashed tags and words one after the other, where each block's start, and its plain measures."""

    def __init__(self, found: list):
        total, at, own = sum(len(b[0]) for b in found) or 1, 0, []
        for b in found:
            own.append(features(b, at / total))
            at += len(b[0])
        self.n = len(own)
        self.plain = np.array([o[2] for o in own]).reshape(-1, PLAIN)
        self.index, self.starts, self.counts = [], [], []
        for k in (0, 1):
            n = np.array([len(o[k]) for o in own], dtype=np.int64)
            self.index.append(np.array([i for o in own for i in o[k]], dtype=np.int32))
            self.starts.append(np.cumsum(n) - n)
            self.counts.append(n)

    def __len__(self) -> int:
        return self.n


def page_features(found: list) -> Features:
    return Features(found)


@lru_cache(maxsize=4)
def default_model(n_pages: int = 1200, seed: int = 7) -> Labeller:
    """Trained from nothing, the same every time; some seconds."""
    model = Labeller(seed)
    model.train(*Pages(seed + 4).labelled(n_pages))
    return model


def texts(model: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    scores = model.predict([page_features(f) for f in found])
    return ["\n".join(b[0] for b, s in zip(f, p) if s >= 0.5) for f, p in zip(found, scores)]


#: Characters of pages that are parsed and labelled at once; a longer page is alone.
CHARS = 4 << 20


def extract(pages: DataFrame, model: Labeller, html: str = "html", name: str = "text") -> DataFrame:
    """pages without the html, with its main text under name, or under a longer one if pages has that."""
    small_batches(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in pages.schema.fields if f.name != html]
    name = free_name(pages.select(*(f.name for f in kept)), name)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([len(x.as_buffer() or b"") for x in batch.column(len(names))])
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS)))
                part = batch.slice(at, stop - at)
                found = pa.array(texts(shipped.value, part.column(len(names)).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*names, name])
                at = stop

    return pages.select(*names, html).mapInArrow(run, T.StructType([*kept, T.StructField(name, T.StringType())]))
