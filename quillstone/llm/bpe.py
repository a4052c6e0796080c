"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

A task takes its share of the corpus in blocks. Texts are cut into pieces at spaces, pieces into pre-tokens, and of the pre-tokens
that are new in a block each distinct one is kept once, so a merge that a million occurrences need is made once. The distinct words lie
end to end in one array of tokens with links to the next and previous live token; an inverted index maps the rank of a token pair to
the positions of its left tokens. The replay takes ranks in rising order, merges all positions of a rank at
once (of overlapping ones, as in a run of equal letters, every other one from the left), and looks up only the pairs beside a merged
position again, which go to the index under their new ranks. Occurrences then copy their piece's tokens. What pieces became is
kept for the task's next blocks, up to a bound. Nothing is shuffled: words of different tasks are replayed apart, with equal results.

Should a merge make a pair of a lower rank than its own (possible with some vocabularies), the order within the word matters; such
words are replayed one merge at a time, by a heap.

Defined results: a null text is empty and has no ids; null and repeated keys are allowed, each row gives one row; an empty table gives an
empty table; other columns, whatever their names, are left aside. A very long text is a block of its own, and a pre-token of n
bytes takes time in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import slices

#: Bytes of text in a block, the unit of a replay; a longer text is a block of its own.
BLOCK_BYTES = 1_500_000
#: Characters of distinct pieces that an encoder remembers from block to block.
REMEMBERED = 1_500_000

#: A space before white space or the end, and one before anything else. At the latter the pattern starts a new match.
LOOSE_SPACE = regex.compile(r" (?:\s|$)").search
TIGHT_SPACE = regex.compile(r" (?=\S)").split

_ENCODERS: dict[tuple[bytes, str, bool], Encoder] = {}


class Numbers(dict):
    """Numbers its keys from 0 as they are asked for."""

    def __missing__(self, key: object) -> int:
        self[key] = n = len(self)
        return n


class Runs:
    """Arrays of varying lengths, by number."""

    def __init__(self, kind: object) -> None:
        self.values, self.offsets = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, ends: np.ndarray) -> None:
        """Further arrays, end to end, and where each of them ends."""
        self.values = np.concatenate([self.values, values.astype(self.values.dtype)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + ends])

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return gather(self.values, self.offsets, numbers)[0]


class Pieces:
    """What the pieces met so far became: the lengths of their words, the tokens in each word, the tokens."""

    def __init__(self) -> None:
        self.numbers, self.chars = Numbers(), 0
        self.sizes, self.counts, self.tokens = Runs(np.int32), Runs(np.int32), Runs("<u4")


class Encoder:
    """Tables made from the lines of a rank file: base64 of a token's bytes, and its rank."""

    def __init__(self, raw: bytes, pattern: str, cut_at_spaces: bool = False) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.find = regex.compile(pattern).findall
        self.cut_at_spaces = cut_at_spaces
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        spelled: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            spelled[rank] = token
        self.spelled = Runs(np.uint8)
        self.spelled.add(np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([len(t) for t in spelled]))
        pairs = [
            (self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([*(k for k, _ in pairs), 2**63 - 1], np.int64)
        self.pair_ranks = np.array([*(r for _, r in pairs), -1], np.int32)
        self.pieces = Pieces()

    @classmethod
    def of(cls, *args: object) -> Encoder:
        """One for each Python worker, however many tasks it runs."""
        if args not in _ENCODERS:
            _ENCODERS[args] = cls(*args)
        return _ENCODERS[args]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; -1: none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def one_by_one(self, word: bytes) -> list[int]:
        """The word's tokens, by the lowest rank first and the leftmost among equals. The heap may hold pairs that are no more."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        n, rank = len(parts), self.ranks.get
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank(a + b, -1) for a, b in zip(parts, parts[1:])] + [-1]
        heap = [(r, i) for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if pair[i] != r:
                continue
            right = following[i]
            parts[i] += parts[right]
            parts[right], pair[right] = None, -1
            following[i] = beyond = following[right]
            if beyond < n:
                before[beyond] = i
                pair[i] = rank(parts[i] + parts[beyond], -1)
            else:
                pair[i] = -1
            if (left := before[i]) >= 0:
                pair[left] = rank(parts[left] + parts[i], -1)
            for at in (left, i):
                if at >= 0 and pair[at] >= 0:
                    heapq.heappush(heap, (pair[at], at))
        return [self.ranks[p] for p in parts if p is not None]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words end to end, and the offset of each word's first."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        n = int(ends[-1]) if len(words) else 0
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        following = np.arange(1, n + 1, dtype=np.int64)
        following[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[begins] = -1
        live = np.ones(n, bool)
        pair = np.full(n, -1, np.int32)  # rank of the pair that begins here
        inner = np.flatnonzero(following >= 0)
        pair[inner] = self.rank(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def note(positions: np.ndarray) -> None:
            ranks = pair[positions]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, found in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts)):
                if r in index:
                    index[r].append(found)
                else:
                    index[r] = [found]
                    heapq.heappush(heap, r)

        if len(first := np.flatnonzero(pair >= 0)):
            note(first)
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[pair[at] == r]
            if not len(at):
                continue
            right = following[at]
            if (pair[right] == r).any():  # pairs overlap: of each run of them every other one, from the left
                at = np.unique(at)
                begin = np.r_[True, following[at[:-1]] != at[1:]]
                place = np.arange(len(at)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
                at = at[place % 2 == 0]
                right = following[at]
            elif len(at) > 1:
                at, kept = np.unique(at, return_index=True)
                right = right[kept]
            beyond = following[right]
            token[at] = r
            following[at] = beyond
            live[right] = False
            pair[right] = -1
            has = beyond >= 0
            before[beyond[has]] = at[has]
            pair[at] = -1
            pair[at[has]] = self.rank(token[at[has]], token[beyond[has]])
            left = before[at]
            with_left = left >= 0
            pair[left[with_left]] = self.rank(token[left[with_left]], token[at[with_left]])
            changed = np.concatenate([at[has], left[with_left]])
            made = pair[changed]
            if (lower := (made >= 0) & (made <= r)).any():
                odd.append(changed[lower])
            if len(changed := changed[made > r]):
                note(changed)
        counts = np.add.reduceat(live, begins, dtype=np.int64) if n else sizes
        if odd:
            again = np.unique(np.searchsorted(ends, np.concatenate(odd), side="right"))
            for w in again.tolist():
                ids = self.one_by_one(words[w])
                b, e = begins[w], ends[w]
                live[b:e] = False
                live[b : b + len(ids)] = True
                token[b : b + len(ids)] = ids
                counts[w] = len(ids)
        return token[live], np.r_[0, np.cumsum(counts)]

    def number(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the numbers of its pieces in ``pieces``, which then has what they became. A piece is a text, or what stands
        between two of its spaces; but for the first of a text, it includes the space before it."""
        if self.pieces.chars > REMEMBERED:
            self.pieces = Pieces()
        known = self.pieces
        met, used = len(known.numbers), []
        for text in texts:
            if not self.cut_at_spaces:
                used.append(np.array([known.numbers[text, ""]], np.int32))
                continue
            head, *rest = TIGHT_SPACE(text) if LOOSE_SPACE(text) else text.split(" ")
            used.append(np.array([known.numbers[head, ""], *map(known.numbers.__getitem__, rest)], np.int32))
        new = list(known.numbers)[met:]
        words = Numbers()
        of_piece = [[words[w] for w in self.find(p[0] if isinstance(p, tuple) else " " + p)] for p in new]
        known.chars += sum(len(p[0]) if isinstance(p, tuple) else len(p) + 1 for p in new)
        flat = np.fromiter((w for ws in of_piece for w in ws), np.int64)
        ends = np.cumsum(np.fromiter(map(len, of_piece), np.int64, len(new)))
        tokens, offsets = self.replay([w.encode() for w in words])
        known.sizes.add(np.fromiter(map(len, words), np.int64, len(words))[flat], ends)
        known.counts.add(np.diff(offsets)[flat], ends)
        tokens, token_ends = gather(tokens, offsets, flat)
        known.tokens.add(tokens, np.r_[0, token_ends][ends])
        return used

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        return [self.pieces.tokens.take(numbers) for numbers in self.number(texts)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return self.spelled.take(np.frombuffer(ids, "<u4")).tobytes()


def gather(values: np.ndarray, offsets: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that begin at offsets[n] and end before offsets[n + 1], for each n, and where each ends."""
    sizes = offsets[numbers + 1] - offsets[numbers]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(numbers) else 0
    return values[np.repeat(offsets[numbers] - ends + sizes, sizes) + np.arange(total)], ends


#: What can be asked of an encoding, and its type.
GIVEN = {"ids": "binary", "decoded": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def answer(encoder: Encoder, ids: list[bytes], name: str) -> pa.Array:
    if name == "ids":
        return pa.array(ids, pa.binary())
    if name == "decoded":
        return pa.array(map(encoder.decode, ids), pa.binary())
    if name == "n_tokens":
        return pa.array([len(i) // 4 for i in ids], pa.int64())
    return pa.array([hashlib.sha256(i if name == "ids_sha256" else encoder.decode(i)).hexdigest() for i in ids], pa.string())


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, cut_at_spaces: bool = False, give: Sequence[str] = ("ids",), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key`` and some of GIVEN: ``ids``, a binary of little-endian unsigned 32-bit ids; ``decoded``, the bytes that decoding these ids
    gives; ``n_tokens``, and digests of the two. ``cut_at_spaces`` says of the pattern that a match begins at every space that
    stands before something other than white space; it saves time."""
    with open(ranks_path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary, of fixed size

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(raw.value, pattern, cut_at_spaces)
        for batch in rows:
            for begin, length in slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(begin, length)
                ids = [i.tobytes() for i in encoder.encode_block(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(answer(encoder, ids, g) for g in give)], ["key", *give])
        encoder.pieces = Pieces()  # the worker may go on with another stage, which needs the memory

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(batches, ", ".join([f"key {kind}", *(f"{g} {GIVEN[g]}" for g in give)])).withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and ``decoded``, the bytes that the ids stand for; null ids: null."""
    with open(ranks_path, "rb") as file:
        raw = encoded.sparkSession.sparkContext.broadcast(file.read())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(raw.value, r"\X")
        for batch in rows:
            for begin, length in slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(begin, length)
                back = [None if i is None else encoder.decode(i) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(back, pa.binary())], ["key", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    slim = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return slim.mapInArrow(batches, f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)
