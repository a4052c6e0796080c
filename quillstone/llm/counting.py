"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: a leaf has some dozen of them with their lengths and token counts, and every
node above has the sums of what is under it, so a position is found, and a count brought up to date, in as many steps
as the tree is high. An edit re-encodes from the last pre-token boundary that lies a little before it, since the pattern looks a few
characters ahead, up to the first new boundary behind it that is a boundary of the old text too; from there on both
texts have the same pre-tokens. Only the leaves that were touched, and the nodes above them, change.

Edits are (at, removed, inserted), in code points of the text as the edits before have left it; positions outside the text are moved
to its ends. Defined results: a null text is empty; null edits are none, a null inserted text is empty; null and repeated
keys are allowed, each row gives one row; an empty table gives an empty table; other columns, whatever their names, are left aside; a very
long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.bpe import BLOCK_BYTES, Encoder, Pieces
from quillstone.llm.words import slices

LEAF = 64
#: Characters behind a boundary that may have settled it: the longest contraction less one, and one to look ahead.
CONTEXT = 3
#: Bytes from which on a single word is replayed with arrays.
SHORT = 100
EDIT = "struct<at:bigint,removed:bigint,inserted:string>"


class SegmentTree:
    """Sums of leaves' numbers of characters and of tokens."""

    def __init__(self, leaves: np.ndarray) -> None:
        self.base = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        self.sums[self.base : self.base + len(leaves)] = leaves
        level = self.base
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        at = self.base + leaf
        change = np.array([chars, tokens]) - self.sums[at]
        while at:
            self.sums[at] += change
            at //= 2

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that has this character, and the characters before the leaf; beyond the end, the last leaf with any."""
        char = min(char, int(self.sums[1, 0]) - 1)
        at, before = 1, 0
        while at < self.base:
            at *= 2
            left = int(self.sums[at, 0])
            if char - before >= left:
                before += left
                at += 1
        return at - self.base, before


class Document:
    """A text, the lengths and token counts of its pre-tokens by leaf, and the tree over them."""

    def __init__(self, text: str, sizes: np.ndarray, tokens: np.ndarray) -> None:
        self.text = text
        self.hang(sizes, tokens)

    def hang(self, sizes: np.ndarray, tokens: np.ndarray) -> None:
        self.pairs = np.stack([sizes, tokens], 1).astype(np.int64)
        self.n = max(1, -(-len(sizes) // LEAF))
        self.edited: dict[int, list[tuple[int, int]]] = {}
        leaves = np.add.reduceat(self.pairs, np.arange(0, len(sizes), LEAF)) if len(sizes) else np.zeros((1, 2), np.int64)
        self.tree = SegmentTree(leaves)

    def leaf(self, number: int) -> list[tuple[int, int]]:
        if number in self.edited:
            return self.edited[number]
        return [tuple(p) for p in self.pairs[number * LEAF : (number + 1) * LEAF].tolist()]

    @property
    def count(self) -> int:
        return int(self.tree.sums[1, 1])

    def edit(self, at: int, removed: int, inserted: str, find: Callable, count: Callable[[str], int]) -> int:
        """Makes the edit; the number of pre-tokens that were encoded for it."""
        at = min(max(0, at), len(self.text))
        stop = min(max(at, at + removed), len(self.text))
        old_length = len(self.text)
        self.text = self.text[:at] + inserted + self.text[stop:]
        delta = len(self.text) - old_length
        # the boundary from which to encode anew
        first, position = self.tree.find(max(0, at - CONTEXT)) if old_length else (0, 0)
        mine = self.leaf(first)
        head = 0
        while head < len(mine) and position + mine[head][0] <= max(0, at - CONTEXT):
            position += mine[head][0]
            head += 1
        # old boundaries from there on, leaf by leaf
        last, tail, old = first, head, position
        rest = mine
        new: list[tuple[int, int]] = []
        for match in find(self.text, position):
            new.append((len(match.group()), count(match.group())))
            end = match.end()
            if end - delta < stop:
                continue
            while old < end - delta:
                while tail == len(rest):
                    last += 1
                    rest, tail = self.leaf(last), 0
                old += rest[tail][0]
                tail += 1
            if old == end - delta:
                break
        else:  # encoded to the end
            last, rest = self.n - 1, self.leaf(self.n - 1)
            tail = len(rest)
        joined = mine[:head] + new + rest[tail:]
        for number in range(first, last + 1):
            self.edited[number] = joined if number == first else []
            chars, tokens = (sum(p[k] for p in self.edited[number]) for k in (0, 1))
            self.tree.set(number, chars, tokens)
        if len(joined) > 16 * LEAF:  # too much in one leaf: hang all anew
            pairs = np.array([p for number in range(self.n) for p in self.leaf(number)], np.int64).reshape(-1, 2)
            self.hang(pairs[:, 0], pairs[:, 1])
        return len(new)


def documents(encoder: Encoder, texts: list[str]) -> list[Document]:
    """Trees of all texts."""
    used = encoder.number(texts)
    sizes, counts = encoder.pieces.sizes, encoder.pieces.counts
    return [Document(text, sizes.take(numbers), counts.take(numbers)) for text, numbers in zip(texts, used)]


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``edits``, a list by ``seq``, from a table (key, seq, at, removed, inserted)."""
    lists = edits.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("__edits"))
    plain = F.transform("__edits", lambda e: F.struct(e["at"].cast("long").alias("at"), e["removed"].cast("long").alias("removed"), e["inserted"].alias("inserted")))
    return docs.join(lists, docs[key] == F.col("__key"), "left").withColumn("edits", plain).drop("__key", "__edits")


def count(docs: DataFrame, ranks_path: str, pattern: str, cut_at_spaces: bool = False, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """``key``, ``n_tokens``, ``n_edits``, ``n_tokens_after`` the edits in column ``edits`` (an array of ``EDIT``), and ``n_encoded``, the
    pre-tokens that they made to be encoded."""
    with open(ranks_path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(raw.value, pattern, cut_at_spaces)
        find = regex.compile(pattern).finditer
        for batch in batches:
            for begin, length in slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(begin, length)
                trees = documents(encoder, part.column(1).to_pylist())
                known: dict[str, int] = {}

                def tokens(word: str) -> int:
                    if word not in known:
                        raw_word = word.encode()
                        # the tables of a replay are not worth it for one short word
                        known[word] = len(encoder.one_by_one(raw_word) if len(raw_word) < SHORT else encoder.replay([raw_word])[0])
                    return known[word]

                rows = []
                for tree, wanted in zip(trees, part.column(2).to_pylist()):
                    before, wanted = tree.count, wanted or []
                    encoded = sum(tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "", find, tokens) for e in wanted if e)
                    rows.append((before, len(wanted), tree.count, encoded))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names)
        encoder.pieces = Pieces()

    names = ["key", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"]
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(edits).cast(f"array<{EDIT}>").alias("edits"))
    return slim.mapInArrow(run, ", ".join([f"key {kind}", *(f"{n} long" for n in names[1:])])).withColumnRenamed("key", key)
