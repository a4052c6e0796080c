"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words that ignores some positions; its hash covers the others only. Seeds
of all benchmark items meet those of all documents by hash; each hit gives a document, an item and an offset between them. At
that offset words are compared one by one: an item leaks into a document if within some ``window`` consecutive
aligned words four of five are equal, whichever of them were replaced. Two masks of six words hit every such window of
13 words; items of 5 to 12 words are compared whole and have masks of three words. An item of one to four words tells nothing inside a
text; it leaks into a document that consists of just these words, and its only seed is the whole item.

Words are compared in lower case and without ASCII punctuation.

The benchmark's seeds are broadcast if they are ``broadcast_seeds`` at most, counted first. Beyond that the seeds of both
sides are tables that are joined by hash, and the hits are joined to the texts. A seed that is a common phrase would pair all its documents
with all its items: where the benchmark has a seed more than ``hot_seeds`` times, both sides complete it to windows, by some of the window's other
words. These are dealt to one group more than words may be replaced, so of a leak some group is whole, and meets. The
hashes of hot seeds are a million at most, since ``hot_seeds`` grows with the benchmark, and are broadcast.

Defined results: items without words never leak; null texts have no words; null and
repeated keys are allowed, rows with equal key and text are reported once; an empty table gives an empty table; other columns, whatever
their names, are left aside; very long texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import find_words, mix, slices, span_hashes, text_bytes, word_digests
from quillstone.plans.shared import checkpointed

WINDOW = 13
LEAST_WORDS = 5
#: For items of WINDOW words or more, and for shorter ones.
LONG_MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
MASKS = LONG_MASKS + SHORT_MASKS
#: In the place of a mask: the whole of a text of fewer than LEAST_WORDS words.
WHOLE = len(MASKS)
KINDS = range(WHOLE + 1)
#: Hashes of hot seeds that are broadcast at most.
MOST_HOT = 1_000_000
#: Leaking texts (a number each) that are broadcast at most.
BROADCAST = 1_000_000

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True

RESULT = "key {kind}, print long, item_id {item}, n_equal long, n_aligned long, item_words long"


def needed(window: int) -> int:
    """Equal words of a window of so many that make a leak: all but a fifth."""
    return window - window // 5


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalized words of all texts, and the number of words before each text, and of all."""
    data, offsets = text_bytes(pc.utf8_lower(texts.fill_null("")))
    keep = ~_PUNCTUATION[data]
    offsets = np.r_[0, np.cumsum(keep)][offsets]
    data = data[keep]
    begins, ends, firsts = find_words(data, offsets)
    return word_digests(data, begins, ends), firsts


def seeds(words: np.ndarray, firsts: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seeds of mask ``number``, or of whole short texts, and where each begins; a seed lies within one text."""
    if number == WHOLE:
        sizes = np.diff(firsts)
        short = np.flatnonzero((sizes > 0) & (sizes < LEAST_WORDS))
        return span_hashes(words, firsts[short], firsts[short + 1]), firsts[short]
    mask = MASKS[number]
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, number + 1, np.uint64)
    for place in mask:
        out *= np.uint64(0xD1342543DE82EF95)
        out += words[place : place + n]
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = np.flatnonzero(text[:n] == text[mask[-1] :])
    return mix(out[at]), at


def masks_for(n_words: int) -> range:
    if n_words < LEAST_WORDS:
        return range(WHOLE, WHOLE + (n_words > 0))
    return range(len(LONG_MASKS)) if n_words >= WINDOW else range(len(LONG_MASKS), len(MASKS))


def windows(number: int) -> list[tuple[int, int]]:
    """Sizes of the windows in which a seed of mask ``number`` may lie, and its places in them."""
    sizes = (WINDOW,) if number < len(LONG_MASKS) else range(LEAST_WORDS, WINDOW)
    return [(n, place) for n in sizes for place in range(n - MASKS[number][-1])]


def completed(words: np.ndarray, firsts: np.ndarray, number: int, hashes: np.ndarray, at: np.ndarray, item: bool) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of mask ``number`` with a group of the other words of each window around them, and where the seeds begin. An item of fewer
    than WINDOW words is its own window."""
    text = np.searchsorted(firsts, at, side="right") - 1
    low, high = firsts[text], firsts[text + 1]
    more_hashes, more_at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n, place in windows(number):
        begin = at - place
        within = (begin >= low) & (begin + n <= high)
        if item and n < WINDOW:
            within &= high - low == n
        free = [p for p in range(n) if p - place not in MASKS[number]]
        groups = n - needed(n) + 1
        for group in range(groups):
            out = hashes[within] + np.uint64((n * WINDOW + place) * WINDOW + group + 1)
            for p in free[group::groups]:
                out *= np.uint64(0xD1342543DE82EF95)
                out += words[begin[within] + p]
            more_hashes.append(mix(out))
            more_at.append(at[within])
    return np.concatenate(more_hashes), np.concatenate(more_at)


def compare(document: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int] | None:
    """Equal and aligned words if the item's word q, at the document's word q + offset, leaks."""
    if len(item) < LEAST_WORDS:
        return (len(item), len(item)) if np.array_equal(document, item) else None
    begin, end = max(0, -offset), min(len(item), len(document) - offset)
    window = min(WINDOW, len(item))
    if end - begin < window:
        return None
    equal = document[begin + offset : end + offset] == item[begin:end]
    sums = np.r_[0, np.cumsum(equal)]
    if (sums[window:] - sums[:-window]).max() < needed(window):
        return None
    return int(sums[-1]), end - begin


class Benchmark:
    """Seeds of a bounded number of items, sorted, and the items' words."""

    def __init__(self, ids: list, texts: pa.Array) -> None:
        words, firsts = normal_words(texts)
        self.ids = ids
        self.words = [words[b:e] for b, e in zip(firsts, firsts[1:])]
        rows = []
        for n, own in enumerate(self.words):
            for mask in masks_for(len(own)):
                hashes, at = seeds(own, np.array([0, len(own)]), mask)
                rows += [(mask, h, n, a) for h, a in zip(hashes.tolist(), at.tolist())]
        self.by_mask = {}
        for mask in KINDS:
            mine = sorted(r[1:] for r in rows if r[0] == mask)
            if mine:
                hashes = np.array([r[0] for r in mine], np.uint64)
                known = np.zeros(1 << 22, bool)
                known[hashes >> np.uint64(42)] = True
                self.by_mask[mask] = hashes, np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), known

    def leaks(self, words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, equal, aligned), at the best offset of each text and item."""
        hits = []
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        for mask, (hashes, items, places, known) in self.by_mask.items():
            own, at = seeds(words, firsts, mask)
            may = np.flatnonzero(known[own >> np.uint64(42)])
            low = np.searchsorted(hashes, own[may])
            sizes = np.searchsorted(hashes, own[may], side="right") - low
            ends = np.cumsum(sizes)
            if len(ends) and ends[-1]:
                which = np.repeat(low - ends + sizes, sizes) + np.arange(ends[-1])
                where = np.repeat(at[may], sizes)
                hits.append(np.stack([text[where], items[which], where - firsts[text[where]] - places[which]], 1))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for t, i, offset in np.unique(np.concatenate(hits), axis=0).tolist() if hits else []:
            found = compare(words[firsts[t] : firsts[t + 1]], self.words[i], offset)
            if found and found > best.get((t, i), (0, 0)):
                best[t, i] = found
        return [(t, i, *found) for (t, i), found in best.items()]


def by_broadcast(docs: DataFrame, items: DataFrame, result: str) -> DataFrame:
    """For a benchmark whose seeds have been counted."""
    rows = items.collect()
    held = docs.sparkSession.sparkContext.broadcast(Benchmark([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string())))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = held.value
        for batch in batches:
            for begin, length in slices(batch.column(2)):
                part = batch.slice(begin, length)
                found = benchmark.leaks(*normal_words(part.column(2)))
                rows = [f[0] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        part.column(1).take(pa.array(rows, pa.int64())),
                        pa.array([benchmark.ids[f[1]] for f in found]).cast(item_kind),
                        *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)),
                        pa.array([len(benchmark.words[f[1]]) for f in found], pa.int64()),
                    ],
                    ["key", "print", "item_id", "n_equal", "n_aligned", "item_words"],
                )

    item_kind = pa.int64() if items.dtypes[0][1] in ("bigint", "int", "smallint") else pa.string()
    return docs.mapInArrow(search, result)


def seed_table(texts: DataFrame, item: bool, hot: Broadcast | None = None) -> DataFrame:
    """(hash, id, print, at) of the seeds of all texts (key, print, text); of items only by the masks for their length. Those of
    ``hot``, sorted, are completed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, length in slices(batch.column(2)):
                part = batch.slice(begin, length)
                words, firsts = normal_words(part.column(2))
                sizes = np.diff(firsts)
                text = np.repeat(np.arange(len(sizes)), sizes)
                for mask in KINDS:
                    hashes, at = seeds(words, firsts, mask)
                    if item:
                        use = np.array([mask in masks_for(int(n)) for n in sizes], bool)[text[at]]
                        hashes, at = hashes[use], at[use]
                    if hot is not None and mask != WHOLE and len(hot.value):
                        common = hot.value[np.searchsorted(hot.value, hashes).clip(max=len(hot.value) - 1)] == hashes
                        more_hashes, more_at = completed(words, firsts, mask, hashes[common], at[common], item)
                        hashes, at = np.r_[hashes[~common], more_hashes], np.r_[at[~common], more_at]
                    owner = pa.array(text[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), part.column(0).take(owner), part.column(1).take(owner), pa.array(at - firsts[text[at]], pa.int64())],
                        ["hash", "key", "print", "at"],
                    )

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(make, f"hash long, key {kind}, print long, at long")


def by_join(docs: DataFrame, items: DataFrame, result: str, hot_seeds: int) -> DataFrame:
    """For a benchmark of any size: hits by a join on the hash, compared beside both texts."""
    slim = items.select("key", F.lit(0).cast("long").alias("print"), "text")
    common = seed_table(slim, True).groupBy("hash").count().where(F.col("count") > hot_seeds).select("hash").collect()
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in common], np.int64).view(np.uint64)))
    tests = seed_table(slim, True, hot).select("hash", F.col("key").alias("item_id"), F.col("at").alias("place"))
    hits = seed_table(docs, False, hot).join(tests, "hash").select("key", "print", "item_id", (F.col("at") - F.col("place")).alias("offset")).distinct()
    offsets = hits.groupBy("key", "print", "item_id").agg(F.collect_set("offset").alias("offsets"))
    texts = docs.dropDuplicates(["key", "print"])
    same = offsets["key"].eqNullSafe(texts["key"]) & (offsets["print"] == texts["print"])
    both = offsets.join(texts, same).select(offsets["key"], offsets["print"], "item_id", "offsets", "text")
    both = both.join(items.select(F.col("key").alias("item_id"), F.col("text").alias("item")), "item_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                words, item = (normal_words(batch.column(c).slice(i, 1))[0] for c in (4, 5))
                found = [f for o in batch.column(3)[i].as_py() if (f := compare(words, item, o))]
                if found:
                    out.append((i, *max(found), len(item)))
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3))], ["key", "print", "item_id", "n_equal", "n_aligned", "item_words"])

    return both.select("key", "print", "item_id", "offsets", "text", "item").mapInArrow(search, result)


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", broadcast_seeds: int = 1_000_000, hot_seeds: int = 50
) -> DataFrame:
    """``key``, ``item_id``, ``n_equal`` of ``n_aligned`` words at the best offset, and ``item_words``, for each document and
    item that leaks into it."""
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("print"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_key).alias("key"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).where("key IS NOT NULL").dropDuplicates(["key"])
    kinds = {"kind": slim.schema["key"].dataType.simpleString(), "item": items.schema["key"].dataType.simpleString()}
    # a text has a seed for each mask and pair of bytes at most
    bound = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * len(LONG_MASKS) // 2
    if bound <= broadcast_seeds:
        found = by_broadcast(slim, items, RESULT.format(**kinds))
    else:
        # of so many seeds a million at most are there more often
        found = by_join(slim, items, RESULT.format(**kinds), max(hot_seeds, bound // MOST_HOT))
    merged = found.groupBy("key", "print", "item_id").agg(F.max(F.struct("n_equal", "n_aligned", "item_words")).alias("best"))
    return merged.select(F.col("key").alias(key), F.col("item_id").alias(item_key), "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` into whose key no item leaks; rows with a null key stay if their text is no leak."""
    marked = docs.withColumn("__print", F.xxhash64(F.col(text).cast("string")))
    rows = marked.select(F.col("__print").alias("key"), F.col(text).alias("text"))
    found = checkpointed(leaks(rows, benchmark, "key", "text", **options).select(F.col("key").alias("__print")).distinct())
    return marked.join(F.broadcast(found) if found.count() <= BROADCAST else found, "__print", "left_anti").drop("__print")
