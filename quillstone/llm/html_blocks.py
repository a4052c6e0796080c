"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with the path of tags above it. A leaf's vector has the hashed names,
classes and ids of the path, hashed words, and a few sizes; a bidirectional LSTM in numpy reads the page's whole sequence and
labels every block as main text or not.

The labeller is trained on the driver, from ``fit_pages`` pages at most, of those that mark their article with a semantic element: blocks in it
are main text, those outside or in navigation, notices, forms and the like within it are not. As one site's pages have one layout, the
sampled blocks are also set into layouts drawn at random (other containers, class names, boilerplate and reader comments, told by names or by
their form alone), stretches of their texts from any place in them. A ``header`` or ``footer`` inside an article is taken for one, with what stands in it; class names of
an article's own element don't make it another thing. The trained model has a fixed size and is broadcast.

Character references are decoded, white space in a block becomes one space, main blocks are joined by a newline. Defined results: a
null or empty page has an empty text; unclosed and misnested tags are tolerated; null and repeated keys are allowed, each row gives
one row; an empty table gives an empty table; a very long or deeply nested page takes time in proportion to its length; columns named
``text`` or ``n_chars`` are replaced, others stay.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa

from quillstone.llm.words import find_words, text_bytes, word_hashes

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea".split())
#: Their text belongs to a form.
CONTROLS = ("button", "select", "datalist")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split()
)
#: An element of the first kind ends open ones of the second, up to the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[a-z]+|[0-9]+")

PATHS, WORDS, SIZES = 768, 32, 5
INPUT = PATHS + WORDS + SIZES
HIDDEN = 16


class Node:
    """An open element that is no inline one: its name parts, its parent, and ``names``, a bit for the hash of each name part of it and of
    all above it. All paths share their upper nodes, so deep pages take space in proportion to their size."""

    __slots__ = ("element", "names", "parent")

    def __init__(self, parent: Node | None, element: str) -> None:
        self.parent, self.element = parent, element
        self.names = parent.names if parent else 0
        for token in element.split():
            self.names |= 1 << (zlib.crc32(token.encode()) % (PATHS // 2) + PATHS // 2 * (token[0] == "~"))


class Leaf:
    """A block: the innermost node above it, its text, and how much of it stands in links."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, node: Node | None, text: str, linked: int) -> None:
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> list[str]:
        """The elements above the block, the outermost first."""
        out, node = [], self.node
        while node:
            out.append(node.element)
            node = node.parent
        return out[::-1]


def element_tokens(tag: str, attributes: str) -> str:
    """Tag, and parts of its class, id and role names, as one word."""
    parts = [tag]
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            parts.append("~hidden")
        elif name in ("class", "id", "role"):
            parts += [f"~{p}" for p in NAME_PART.findall(value)]
    return " ".join(parts)


class Open:
    """The open elements. Every step takes constant time, but for closing, which takes it for each element closed."""

    def __init__(self) -> None:
        self.tags: list[str] = []  # empty: closed before those above it
        self.nodes: list[Node | None] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def node(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def has(self, tag: str) -> bool:
        return bool(self.where.get(tag))

    def open(self, tag: str, attributes: str) -> None:
        at = len(self.tags)
        inline = tag in INLINE
        self.nodes.append(self.node if inline else Node(self.node, element_tokens(tag, attributes)))
        self.tags.append(tag)
        self.where.setdefault(tag, []).append(at)
        if not inline:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Closes the elements from place ``at`` on."""
        while len(self.tags) > at:
            self.nodes.pop()
            if tag := self.tags.pop():
                self.where[tag].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        """Closes the innermost element of a tag. What an inline element leaves open stays open."""
        at = self.where[tag][-1]
        if tag in INLINE and self.blocks and self.blocks[-1] > at:
            self.where[tag].pop()
            self.tags[at] = ""
        else:
            self.cut(at)

    def end_siblings(self, tag: str) -> None:
        closed, limits = ENDS[tag]
        limit = max((self.where[t][-1] for t in limits if self.has(t)), default=-1)
        found = [own[k] for t in closed if (own := self.where.get(t)) and (k := bisect_right(own, limit)) < len(own)]
        if found:
            self.cut(min(found))


def leaves(page: str) -> list[Leaf]:
    """Blocks with text, in page order, but for what stands in a form's controls."""
    out: list[Leaf] = []
    open_ = Open()
    held: list[str] = []
    linked = 0
    under: Node | None = None
    real = False  # whether ``held`` has more than white space

    def end_block() -> None:
        nonlocal linked, real
        if real:
            out.append(Leaf(under, " ".join(html.unescape("".join(held)).split()), linked))
        held.clear()
        linked, real = 0, False

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        slash, tag, attributes = m.group(1, 2, 3)
        if tag is None:
            text = m.group()
            if text[0] == "<" and len(text) > 1:  # a comment or declaration
                continue
            if any(map(open_.has, CONTROLS)):
                continue
            if not real and html.unescape(text).split():
                real, under = True, open_.node
            held.append(text)
            if open_.has("a"):
                linked += len(text)
            continue
        tag = tag.lower()
        if slash:
            if open_.has(tag):
                if tag not in INLINE:
                    end_block()
                open_.close(tag)
            elif tag == "p":
                end_block()
            elif tag == "br":
                held.append(" ")
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag not in INLINE:
            end_block()
            if tag in CLOSES_P and open_.has("p"):
                open_.close("p")
            if tag in ENDS:
                open_.end_siblings(tag)
        elif tag == "br":
            held.append(" ")
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            open_.open(tag, attributes)
    end_block()
    return out


def path_key(node: Node | None) -> tuple[int, tuple[str, ...]]:
    """What ``path_vector`` looks at."""
    near = (node.element, node.parent.element) if node and node.parent else (node.element,) if node else ()
    return (node.names if node else 0), near


def path_vector(names: int, near: tuple[str, ...]) -> np.ndarray:
    """Hashed names of the elements of a path; those near the block also count by their place, and names more than tags."""
    half = PATHS // 2
    out = np.zeros(PATHS, np.float32)
    bits = np.unpackbits(np.frombuffer(names.to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little")
    out[:half] = np.maximum(bits[:half], 3 * bits[half:])
    for depth, element in enumerate(near):
        for token in element.split():
            out[half + zlib.crc32(f"{depth} {token}".encode()) % half] = 3 if token[0] == "~" else 1
    return out


class Sequences:
    """Leaves of several pages as one matrix, by page, and the order in which the LSTM walks them."""

    def __init__(self, pages: list[list[Leaf]]) -> None:
        flat = [leaf for page in pages for leaf in page]
        numbers: dict[tuple[int, tuple[str, ...]], int] = {}
        self.path = np.array([numbers.setdefault(path_key(leaf.node), len(numbers)) for leaf in flat], np.int64)
        self.paths = np.array([path_vector(*p) for p in numbers], np.float32).reshape(-1, PATHS)
        data, offsets = text_bytes(pa.array([leaf.text for leaf in flat], pa.string()))
        begins, ends, firsts = find_words(data, offsets)
        sizes = np.maximum(1, np.diff(firsts))
        leaf_of = np.repeat(np.arange(len(flat)), np.diff(firsts))
        bucket = (word_hashes(data, begins, ends) % np.uint64(WORDS)).astype(np.int64)
        words = np.bincount(leaf_of * WORDS + bucket, minlength=len(flat) * WORDS).reshape(-1, WORDS) / sizes[:, None]
        counts = np.array([len(p) for p in pages], np.int64)
        lengths = np.diff(offsets)
        stops = np.add.reduceat(np.r_[np.isin(data, np.frombuffer(b".,;!?", np.uint8)).astype(np.int64), 0], offsets[:-1]) if len(flat) else np.zeros(0)
        place = np.concatenate([np.arange(n) / max(1, n - 1) for n in counts.tolist()]) if len(flat) else np.zeros(0)
        linked = np.array([leaf.linked for leaf in flat]) / np.maximum(1, lengths)
        self.rest = np.concatenate([words, np.stack([np.log1p(sizes) / 4, np.minimum(1, linked), stops / sizes, place, np.ones(len(flat))], 1)], 1).astype(np.float32)
        # the longest page first, so that those still going on at a step are the first ones
        order = np.argsort(-counts, kind="stable")
        starts = np.r_[0, np.cumsum(counts)][:-1]
        self.firsts, self.counts = starts[order], counts[order]
        longest = int(counts.max(initial=0))
        self.active = np.searchsorted(-self.counts, -np.arange(1, longest + 1), side="right")
        self.n = len(flat)

    def steps(self, backward: bool) -> list[np.ndarray]:
        """The leaves that are read together at each step."""
        if backward:
            return [self.firsts[:n] + self.counts[:n] - 1 - t for t, n in enumerate(self.active.tolist())]
        return [self.firsts[:n] + t for t, n in enumerate(self.active.tolist())]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs and an output; gates are in, forget, out, new."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.weights = []
        for _ in range(2):
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.weights += [(rng.standard_normal((INPUT, 4 * HIDDEN)) * 0.15).astype(np.float32), (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32), bias]
        self.weights += [(rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32), np.zeros(1, np.float32)]

    def run(self, s: Sequences) -> tuple:
        """Scores of all leaves, and what the gradient needs."""
        hidden = np.zeros((s.n, 2 * HIDDEN), np.float32)
        kept = []
        for d in range(2):
            w, u, bias = self.weights[3 * d : 3 * d + 3]
            given = (s.paths @ w[:PATHS])[s.path] + s.rest @ w[PATHS:] + bias
            h = c = np.zeros((len(s.counts), HIDDEN), np.float32)
            memory = []
            for at in s.steps(bool(d)):
                h, c = h[: len(at)], c[: len(at)]
                z = given[at] + h @ u
                gates = sigmoid(z[:, : 3 * HIDDEN])
                new = np.tanh(z[:, 3 * HIDDEN :])
                before_h, before_c = h, c
                c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * new
                out = np.tanh(c)
                h = gates[:, 2 * HIDDEN :] * out
                hidden[at, d * HIDDEN : (d + 1) * HIDDEN] = h
                memory.append((at, before_h, before_c, gates, new, out))
            kept.append(memory)
        return hidden @ self.weights[6] + self.weights[7], hidden, kept

    def gradient(self, s: Sequences, labels: np.ndarray) -> list[np.ndarray]:
        score, hidden, kept = self.run(s)
        d_score = ((sigmoid(score) - labels) / len(labels)).astype(np.float32)
        out = []
        d_hidden = d_score[:, None] * self.weights[6]
        for d in range(2):
            w, u, _ = self.weights[3 * d : 3 * d + 3]
            d_given = np.zeros((s.n, 4 * HIDDEN), np.float32)
            d_u = np.zeros_like(u)
            dh = dc = np.zeros((0, HIDDEN), np.float32)
            for at, before_h, before_c, gates, new, tanh_c in reversed(kept[d]):
                more = len(at) - len(dh)
                dh = np.concatenate([dh, np.zeros((more, HIDDEN), np.float32)]) + d_hidden[at, d * HIDDEN : (d + 1) * HIDDEN]
                dc = np.concatenate([dc, np.zeros((more, HIDDEN), np.float32)]) + dh * gates[:, 2 * HIDDEN :] * (1 - tanh_c * tanh_c)
                d_gates = np.concatenate([dc * new, dc * before_c, dh * tanh_c], 1) * gates * (1 - gates)
                dz = np.concatenate([d_gates, dc * gates[:, :HIDDEN] * (1 - new * new)], 1)
                d_given[at] = dz
                d_u += before_h.T @ dz
                dh = dz @ u.T
                dc = dc * gates[:, HIDDEN : 2 * HIDDEN]
            by_path = np.zeros((len(s.paths), 4 * HIDDEN), np.float32)
            np.add.at(by_path, s.path, d_given)
            out += [np.concatenate([s.paths.T @ by_path, s.rest.T @ d_given]), d_u, d_given.sum(0)]
        return [*out, hidden.T @ d_score, d_score.sum(keepdims=True)]

    def fit(self, pages: list[tuple[list[Leaf], list[bool]]], epochs: int = 10, batch: int = 40, rate: float = 0.01) -> Labeller:
        """Adam over batches of pages."""
        pages = [p for p in pages if p[0]]
        rng = random.Random(5)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        step = 0
        for epoch in range(epochs):
            rng.shuffle(pages)
            for b in range(0, len(pages), batch):
                chosen = pages[b : b + batch]
                step += 1
                labels = np.array([x for _, own in chosen for x in own], np.float32)
                now = rate * (1 - epoch / epochs)
                for k, g in enumerate(self.gradient(Sequences([p for p, _ in chosen]), labels)):
                    g = np.clip(g, -1, 1) + 1e-5 * self.weights[k]
                    m, v = moments[k] = (0.9 * moments[k][0] + 0.1 * g, 0.999 * moments[k][1] + 0.001 * g * g)
                    self.weights[k] = (self.weights[k] - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def main_texts(self, pages: list[list[Leaf]]) -> list[str]:
        scores = self.run(Sequences(pages))[0]
        out, at = [], 0
        for page in pages:
            out.append("\n".join(leaf.text for leaf, s in zip(page, scores[at : at + len(page)].tolist()) if s > 0))
            at += len(page)
        return out
