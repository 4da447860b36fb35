"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut at its block-level tags into blocks of text. Each block has features of
its ancestors (tags, and the words of their class and id) and of its text; each pair
of neighbours has a transition weight. The field is trained in numpy on labelled
pages, by gradient steps on the exact likelihood (forward and backward sums), and a
page is decoded by Viterbi. The labelled pages are written by ``labelled_pages`` from
layouts whose parts are known.

Scripts, styles and comments of the markup are no text. Null and empty pages, and pages without
main blocks, give an empty text. Unclosed and misnested tags are closed where HTML
closes them, else at their parent's end. Pages of any length are read whole; a page
stays in one task and nothing is shuffled. Repeated rows are extracted again.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataflow.llm.batches import slices

# How HTML treats these tags.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup"
    " time tt u var wbr img".split()
)
_SILENT = frozenset("script style template noscript".split())
_CLOSED_BY_SELF = frozenset("p li dt dd tr td th option".split())
_CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split()
)
_NAMES = re.compile(r"[a-z]+")
_SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class _Blocks(HTMLParser):
    """Cuts a page into blocks; an open element is (tag, words of its class and id)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self._open: list[tuple[str, tuple[str, ...]]] = []
        self._parts: list[str] = []
        self._linked = self._silent = self._links = 0

    def _end_block(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append(Block(tuple(e for e in self._open if e[0] not in _INLINE), text, self._linked))
            self._parts = []
        self._linked = 0

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self._end_block()
            if tag in _CLOSES_P and any(e[0] == "p" for e in self._open):
                self._close("p")
            elif tag in _CLOSED_BY_SELF:
                for k in range(len(self._open) - 1, -1, -1):
                    if self._open[k][0] == tag:
                        self._close(tag)
                    elif self._open[k][0] in _INLINE or self._open[k][0] in _CLOSED_BY_SELF:
                        continue
                    break
        if tag in _VOID:
            return
        words = [w for k, v in attrs if k in ("class", "id", "role") and v for w in _NAMES.findall(_SPLIT_CAMEL.sub(" ", v).lower())]
        self._open.append((tag, tuple(words)))
        self._silent += tag in _SILENT
        self._links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash does not close an element of HTML

    def _close(self, tag: str) -> None:
        while self._open:
            t, _ = self._open.pop()
            self._silent -= t in _SILENT
            self._links -= t == "a"
            if t == tag:
                return

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self._end_block()
        if any(e[0] == tag for e in self._open):
            if tag in _INLINE:  # misnested: the element alone goes
                for k in range(len(self._open) - 1, -1, -1):
                    if self._open[k][0] == tag:
                        del self._open[k]
                        self._links -= tag == "a"
                        return
            self._close(tag)

    def handle_data(self, data):
        if not self._silent:
            self._parts.append(data)
            if self._links:
                self._linked += len(data.strip())

    def finish(self) -> list[Block]:
        self.close()
        self._end_block()
        return self.blocks


def blocks_of(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    return parser.finish()


def path_features(path: tuple) -> list[str]:
    out = ["bias"]
    for tag, words in path:
        out.append(f"in:{tag}")
        out += [f"named:{w}" for w in words]
    if path:
        out.append(f"leaf:{path[-1][0]}")
        out += [f"leaf-named:{w}" for w in path[-1][1]]
    return list(dict.fromkeys(out))


def text_features(block: Block) -> list[str]:
    text = block.text
    n, words = len(text), text.count(" ") + 1
    out = [f"words:{min(words.bit_length(), 7)}", f"links:{min(3, 4 * block.linked // max(n, 1))}"]
    if text[-1] in ".!?…:;\"”’)":
        out.append("ends:stop")
    if "©" in text or "(c)" in text[:40].lower():
        out.append("has:copyright")
    if "@" in text or "http" in text:
        out.append("has:address")
    if text.count(",") * 12 >= words:
        out.append("has:commas")
    return out


# --- the chain


class Field:
    """Weights of features and of neighbouring labels (0 other, 1 main)."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros((len(names), 2))
        self.move = np.zeros((2, 2))
        self.ends = np.zeros((2, 2))  # first and last label
        self._paths: dict[tuple, tuple[float, float]] = {}
        self._texts: dict[str, tuple[float, float]] | None = None

    def _sum(self, features: list[str]) -> tuple[float, float]:
        at = [self.names[f] for f in features if f in self.names]
        return tuple(self.weights[at].sum(0).tolist()) if at else (0.0, 0.0)

    def emission(self, block: Block) -> tuple[float, float]:
        if self._texts is None:
            self._texts = {name: tuple(self.weights[i].tolist()) for name, i in self.names.items()}
        if block.path not in self._paths:
            if len(self._paths) > 50_000:
                self._paths.clear()
            self._paths[block.path] = self._sum(path_features(block.path))
        a, b = self._paths[block.path]
        for f in text_features(block):
            w = self._texts.get(f)
            if w:
                a, b = a + w[0], b + w[1]
        return a, b

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best label sequence."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        e = [self.emission(b) for b in blocks]
        s0, s1 = e[0][0] + self.ends[0, 0], e[0][1] + self.ends[0, 1]
        back = []
        for a, b in e[1:]:
            from0, from1 = s0 + m00 < s1 + m10, s0 + m01 < s1 + m11
            back.append((from0, from1))
            s0, s1 = (s1 + m10 if from0 else s0 + m00) + a, (s1 + m11 if from1 else s0 + m01) + b
        label = int(s1 + self.ends[1, 1] > s0 + self.ends[1, 0])
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def _log_add(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(-1, keepdims=True)))[..., 0]


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 40, rate: float = 0.3, decay: float = 2e-4) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam over whole pages."""
    named: dict[str, int] = {}
    rows = []
    for blocks, labels in pages:
        feats = [[named.setdefault(f, len(named)) for f in path_features(b.path) + text_features(b)] for b in blocks]
        rows.append((feats, np.array(labels)))
    field = Field(named)
    params = [field.weights, field.move, field.ends]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(epochs):
        grads = [np.zeros_like(p) for p in params]
        for feats, y in rows:
            n = len(y)
            owner = np.repeat(np.arange(n), [len(f) for f in feats])
            flat = np.concatenate([np.array(f) for f in feats])
            e = np.stack([np.bincount(owner, field.weights[flat, k], n) for k in (0, 1)], 1)
            e[0] += field.ends[0]
            e[-1] += field.ends[1]
            alpha, beta = e.copy(), np.zeros((n, 2))
            for i in range(1, n):
                alpha[i] += _log_add(alpha[i - 1][None, :] + field.move.T)
            for i in range(n - 2, -1, -1):
                beta[i] = _log_add(field.move + (e[i + 1] + beta[i + 1])[None, :])
            total = _log_add(alpha[-1])
            marginal = np.exp(alpha + beta - total)
            marginal[np.arange(n), y] -= 1
            for k in (0, 1):
                grads[0][:, k] += np.bincount(flat, marginal[owner, k], len(named))
            grads[2] += marginal[[0, -1]]
            if n > 1:
                pair = np.exp(alpha[:-1, :, None] + field.move + (e[1:] + beta[1:])[:, None, :] - total).sum(0)
                np.subtract.at(pair, (y[:-1], y[1:]), 1)
                grads[1] += pair
        for p, g, m, v in zip(params, grads, first, second):
            g = g / len(rows) + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    return field


# --- labelled pages

_SYLLABLES = "ba co di fe ga hi jo ku la me ni or pa qui re sa to un ve wi".split()
# Names that page authors give to such parts.
_OTHER = {
    "nav": "nav menu navigation navbar topnav breadcrumb breadcrumbs pagination pager tabs links",
    "header": "header masthead banner topbar logo branding site",
    "footer": "footer colophon bottom copyright legal imprint",
    "aside": "aside sidebar widget related recommended popular trending promo rail secondary tags share social",
    "notice": "cookie consent notice alert popup modal gdpr overlay privacy message",
    "advert": "ad ads advert advertisement sponsor sponsored banner adbox promoted",
    "form": "form newsletter subscribe search login signup contact",
    "comments": "comments comment replies reply discussion disqus respond thread",
}
_MAIN = "content article post entry main story body text page single"


def labelled_pages(count: int = 140, seed: int = 5) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages of many layouts: html, and (text, label) of each block in order."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def words(low: int, high: int) -> str:
        n = int(np.exp(rng.uniform(np.log(low), np.log(high + 1))))
        text = " ".join("".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 5)))) for _ in range(max(n, 1)))
        text = "".join(c + ("," if c == " " and rng.random() < 0.02 else "") for c in text).replace(" ,", ", ")
        return text.capitalize() + pick(["", ".", ".", ".", "!", "###"])

    pages = []
    for _ in range(count):
        truth: list[tuple[str, int]] = []
        semantic = rng.random() < 0.6

        def leaf(tag: str, label: int, low: int, high: int, link: bool = False, truth=truth) -> str:
            text = words(low, high)
            truth.append((text, label))
            return f"<{tag}>" + (f'<a href="/{len(truth)}">{text}</a>' if link else text) + f"</{tag}>"

        def shell(kind: str, inner: str) -> str:
            name = pick(_OTHER[kind].split())
            tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
            named = rng.random() < 0.5 or tag == "div"
            if not semantic and kind != "form":
                tag, named = pick(["div", "section"]), True
            return f"<{tag}" + (f' {pick(["class", "class", "id"])}="{name}"' if named else "") + f">{inner}</{tag}>"

        def other(kind: str) -> str:
            n = int(rng.integers(1, 7))
            if kind == "nav" or (kind in ("footer", "aside", "header") and rng.random() < 0.5):
                return shell(kind, "<ul>" + "".join(leaf("li", 0, 1, 4, True) for _ in range(n)) + "</ul>")
            if kind == "form":
                return shell(kind, leaf("label", 0, 1, 5) + "<input>" + leaf("button", 0, 1, 3))
            if kind == "comments":
                return shell(kind, leaf("h3", 0, 1, 4) + "".join(leaf(pick(["p", "div"]), 0, 2, 60) for _ in range(n)))
            if kind in ("notice", "advert", "footer") and rng.random() < 0.6:
                text = ("© " if kind == "footer" and rng.random() < 0.7 else "") + words(2, 40)
                truth.append((text, 0))
                return shell(kind, text)
            return shell(kind, "".join(leaf(pick(["p", "div", "p"]), 0, 1, 40) for _ in range(min(n, 3))))

        def main_part() -> str:
            out = [leaf("h1", 1, 1, 14)] if rng.random() < 0.85 else []
            for _ in range(int(rng.integers(1, 14))):
                kind = rng.random()
                if kind < 0.68:
                    out.append(leaf("p", 1, 1, 160))
                elif kind < 0.76:
                    out.append(leaf(pick(["h2", "h3"]), 1, 1, 8))
                elif kind < 0.84:
                    out.append("<ul>" + "".join(leaf("li", 1, 1, 25) for _ in range(3)) + "</ul>")
                elif kind < 0.88:
                    out.append("<blockquote>" + leaf("p", 1, 3, 40) + "</blockquote>")
                elif kind < 0.92:
                    out.append("<table><tr>" + leaf("td", 1, 1, 6) + leaf("td", 1, 1, 6) + "</tr></table>")
                elif kind < 0.95:
                    out.append("<p>" + leaf("b", 1, 2, 40)[:-4] + "<br>")
                else:
                    out.append(other(pick(["advert", "aside", "form", "notice"])))
            tag = pick(["article", "article", "main"]) if semantic else pick(["div", "section"])
            named = not semantic or rng.random() < 0.4
            return f"<{tag}" + (f' {pick(["class", "id"])}="{pick(_MAIN.split())}"' if named else "") + ">" + "".join(out) + f"</{tag}>"

        parts = ["<html><head>" + leaf("title", 0, 1, 14) + "<script>var x='<p>';</script></head><body>"]
        for kind in ("notice", "header", "nav", "advert"):
            if rng.random() < 0.6:
                parts.append(other(kind))
        wrap = rng.random() < 0.3
        parts.append(('<div id="wrapper">' if wrap else "") + main_part() + ("</div>" if wrap else ""))
        for kind in ("form", "aside", "comments", "advert", "nav", "footer"):
            if rng.random() < 0.55:
                parts.append(other(kind))
        pages.append(("".join(parts) + "</body></html>", truth))
    return pages


@lru_cache(maxsize=1)
def trained_field() -> Field:
    pages = []
    for html, truth in labelled_pages():
        blocks = blocks_of(html)
        if len(blocks) == len(truth):
            pages.append((blocks, [label for _, label in truth]))
    return fit(pages)


def main_text(html: str, field: Field) -> str:
    blocks = blocks_of(html)
    return " ".join(b.text for b, label in zip(blocks, field.decode(blocks)) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    field = field or trained_field()

    def run(batches):
        for part, texts in slices(batches, "html"):
            found = [main_text(t, field) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": part.column("page_id"),
                    "url": part.column("url"),
                    "text": pa.array(found, pa.string()),
                    "n_chars": pa.array([len(t) for t in found], pa.int64()),
                }
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
