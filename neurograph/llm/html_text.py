"""Operator 10, main text of HTML pages by a recurrent block labeller.

A page is a sequence of leaf blocks (``html_blocks``). Each has a vector of its tag path (hashed tags, class and id words), of its hashed words and a
few measures. A bidirectional LSTM in numpy reads the whole sequence both ways and says for each block whether it belongs to the article. It
is trained here, on the driver, on pages that ``html_pages`` makes up with known labels; its weights are of fixed size.

Defined results: a null or empty page has the empty text; a page without tags is one block; broken and unclosed markup is read as a browser would,
roughly; repeated rows are all returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from neurograph.llm.common import map_batches
from neurograph.llm.html_blocks import Leaf, Node, leaves
from neurograph.llm.html_pages import MARKS, page, unmarked

PATH, OWN, WORDS, MEASURES = 256, 64, 48, 12
SIZE = PATH + OWN + WORDS + MEASURES
HIDDEN = 24


class Features:
    """Vectors of blocks; remembers nodes and words of the task. ``root`` is the node above all pages, for ``leaves``."""

    def __init__(self):
        self.root, self.vectors = Node(), 0
        self.bits: dict[str, tuple[int, int]] = {}
        self.words: dict[str, int] = {}

    def fresh(self) -> Node:
        """The root for a further page; forgets the nodes of earlier pages once they are many."""
        if self.vectors > 100_000:
            self.root, self.vectors = Node(), 0
        return self.root

    def _bit(self, name: str) -> tuple[int, int]:
        """A name's place among all, and among the own ones."""
        if (at := self.bits.get(name)) is None:
            if len(self.bits) > 500_000:
                self.bits.clear()
            at = self.bits[name] = zlib.crc32(name.encode()) % PATH, PATH + zlib.crc32(b"own " + name.encode()) % OWN
        return at

    def _path(self, node: Node) -> np.ndarray:
        """The bits of all names above a block, and apart those of the last two elements."""
        if node.vector is not None:
            return node.vector
        todo, at = [], node
        while at.above and at.vector is None:
            todo.append(at)
            at = at.above
        if at.vector is None:
            at.vector = np.zeros(PATH + OWN, np.float32)
        for n in reversed(todo):
            v = n.above.vector.copy()
            v[PATH:] = 0
            for name in n.names:
                v[list(self._bit(name))] = 1
            for name in n.above.names:
                v[self._bit(name)[1]] = 1
            n.vector = v
        self.vectors += len(todo)
        return node.vector

    def of(self, blocks: list[Leaf]) -> np.ndarray:
        out = np.zeros((len(blocks), SIZE), np.float32)
        for k, b in enumerate(blocks):
            out[k, : PATH + OWN] = self._path(b.node)
            words = b.text.lower().split()
            if len(self.words) > 500_000:
                self.words.clear()
            at = []
            for w in words:
                if (h := self.words.get(w)) is None:
                    h = self.words[w] = zlib.crc32(w.strip(".,;:!?()").encode()) % WORDS
                at.append(h)
            counts = np.bincount(np.array(at, np.int64), minlength=WORDS)
            out[k, PATH + OWN : PATH + OWN + WORDS] = counts / np.sqrt(max(1.0, float((counts * counts).sum())))
            n, text = len(words), b.text
            out[k, -MEASURES:] = (
                np.log1p(n) / 5, min(1.0, b.linked / max(1, len(text))), text.count(".") / (n + 1), text.count(",") / (n + 1), sum(map(text.count, "0123456789")) / len(text),
                "©" in text, text[-1] in ".!?", text[:1].isupper(), "|" in text or "·" in text, k / len(blocks), b.node.depth / 10, n > 12,
            )
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction; ``run`` takes (time, rows, SIZE) and gives (time, rows, HIDDEN)."""

    def __init__(self, rng: np.random.Generator):
        self.wx = (rng.standard_normal((SIZE, 4 * HIDDEN)) * 0.15).astype(np.float32)
        self.wh = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        z, (t, n, _) = x @ self.wx + self.b, x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((t, n, HIDDEN), np.float32)
        for k in range(t):
            a = z[k] + h @ self.wh
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            new = f * c + i * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((h, c, i, f, o, g, th))
            c, h = new, o * th
            out[k] = h
        return out

    def back(self, x: np.ndarray, d: np.ndarray, kept: list) -> list[np.ndarray]:
        """Gradients of (wx, wh, b) from those of the outputs."""
        dz = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
        gh, dh, dc = np.zeros_like(self.wh), 0, 0
        for k in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, th = kept[k]
            dh = d[k] + dh
            dc = dc + dh * o * (1 - th * th)
            a = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz[k] = a
            gh += h.T @ a
            dh, dc = a @ self.wh.T, dc * f
        return [np.tensordot(x, dz, ((0, 1), (0, 1))), gh, dz.sum((0, 1))]


class Labeller:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.ahead, self.behind = Lstm(rng), Lstm(rng)
        self.w, self.b = (rng.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32), np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.wx, self.ahead.wh, self.ahead.b, self.behind.wx, self.behind.wh, self.behind.b, self.w, self.b]

    @staticmethod
    def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(time, rows, SIZE), a mask, and for each place the place that it has when its row is read backwards."""
        sizes = np.array([len(r) for r in rows])
        t = int(sizes.max())
        x = np.zeros((t, len(rows), SIZE), np.float32)
        for k, r in enumerate(rows):
            x[: len(r), k] = r
        at = np.arange(t)[:, None]
        return x, at < sizes, np.where(at < sizes, sizes - 1 - at, at)

    def _scores(self, x: np.ndarray, flip: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        line = np.arange(x.shape[1])
        a = self.ahead.run(x, keep and keep[0])
        b = self.behind.run(x[flip, line], keep and keep[1])[flip, line]
        both = np.concatenate([a, b], axis=2)
        return both @ self.w + self.b, both

    def label(self, pages: list[np.ndarray], cells: int = 40_000) -> list[np.ndarray]:
        """For each page, which blocks belong to its article. Pages of like lengths are read together, ``cells`` blocks at once."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        while order:
            n = max(1, min(len(order), cells // len(pages[order[-1]])))
            some, order = order[-n:], order[:-n]
            x, _, flip = self._pad([pages[k] for k in some])
            said = self._scores(x, flip)[0] > 0
            for j, k in enumerate(some):
                out[k] = said[: len(pages[k]), j]
        return out

    def fit(self, pages: list[np.ndarray], truth: list[np.ndarray], epochs: int = 6, rows: int = 32, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on the mean cross entropy."""
        rng, p = np.random.default_rng(seed), self.parameters()
        m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
        total = epochs * -(-len(pages) // rows)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            batches = [sorted(order[k : k + 8 * rows], key=lambda j: len(pages[j])) for k in range(0, len(order), 8 * rows)]
            for some in (b[k : k + rows] for b in batches for k in range(0, len(b), rows)):
                x, mask, flip = self._pad([pages[k] for k in some])
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(some):
                    y[: len(truth[k]), j] = truth[k]
                keep: tuple[list, list] = ([], [])
                z, both = self._scores(x, flip, keep)
                dz = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
                d, line = dz[:, :, None] * self.w, np.arange(x.shape[1])
                grads = [*self.ahead.back(x, d[:, :, :HIDDEN], keep[0]), *self.behind.back(x[flip, line], d[:, :, HIDDEN:][flip, line], keep[1]), np.tensordot(dz, both, ((0, 1), (0, 1))), dz.sum(keepdims=True).ravel()]
                step += 1
                r = rate * min(1.0, step / 10) * (1 - 0.95 * step / total)
                for k, g in enumerate(grads):
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= (r * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


@lru_cache(maxsize=2)
def trained(pages: int = 2000, seed: int = 11) -> Labeller:
    """The labeller, trained on made-up pages; once in a driver, some seconds. The same every time."""
    rng, f, xs, ys = np.random.default_rng(seed), Features(), [], []
    for _ in range(pages):
        html, wanted = page(rng)
        found = leaves(html, f.fresh())
        if found:
            marks = [re.search(f"{MARKS[0]}[0-9]+{MARKS[1]}", b.text) for b in found]
            ys.append(np.array([m is not None and m[0] in wanted for m in marks], np.float32))
            xs.append(f.of([Leaf(b.node, unmarked(b.text) or ".", b.linked) for b in found]))
    out = Labeller()
    out.fit(xs, ys)
    return out


def main_text(pages: list[str | None], model: Labeller, features: Features) -> list[str]:
    blocks = [leaves(p or "", features.root) for p in pages]
    kept = model.label([features.of(b) for b in blocks])
    features.fresh()
    return ["\n\n".join(b.text for b, yes in zip(bs, ks, strict=True) if yes) for bs, ks in zip(blocks, kept, strict=True)]


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text, n_chars."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            texts = main_text(b.column(len(keep)).to_pylist(), model, features)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(df.select(*keep, html), run, f"{kinds}, text string, n_chars bigint", 128)
