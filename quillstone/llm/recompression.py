"""Substring deduplication by recompression.

Rounds give names to runs of equal symbols and to pairs of neighbours, beginning with words. A name is a hash of what
it stands for, so a run or pair has the same name in every document of every task: naming is global without a table of names, which would
cost a shuffle of all symbols in every round. In a pairing round a
bit of each name says whether it may be the left or the right half of a pair; which symbols join depends on the
neighbourhood alone, so equal passages are named alike but near their ends. Along with each symbol goes the interval of
words that settled it. A symbol of ``phrase`` words or more is a phrase; further rounds name runs and pairs of phrases, up to sections of
``section`` words or more.

1. A first exchange tells for each symbol whether other documents have it, and whether an earlier one has.
   A window whose words settle a phrase that no other document has, has no copy elsewhere, and is out. The windows inside a section that an
   earlier document has begin there too, and are found: a high symbol reveals a long repeat at once. (Sections are compared by 96 bits
   of hashes of two kinds. The earliest holder of a window never has it found this way, so it still answers for it below.)
2. The windows that are left, near the ends of repeats and in short ones, meet in a second exchange by 96-bit hashes
   of their words, each with the least document that has it. Words have two hashes of 64 bits of all their bytes, each with a seed of its own, and a window one
   of 64 bits of the first and one of 32 bits of the second, so two different windows are taken for equal with a likelihood of 2**-85 or less (words
   that stand several times in a window cost some bits). No window is compared word by word.
3. Words of windows that begin in an earlier document too are removed.

Documents travel in chunks of some megabytes. For each stretch of the hash space (bucket) a chunk sends its distinct hashes once,
packed in one row with the least document of each, and gets two bits back for each; so a hash that
very many documents have costs a bucket one entry for each chunk. There are as many buckets as keep a bucket's entries in a
task's memory; from some terabytes on, when a chunk has few hashes for each, CHUNK_BYTES should grow with the root of the corpus.

Defined results: rows with a null key are returned whole and give no copies to others; rows of equal key are the same
document to each other; a null text has no words; a very long text is a chunk of its own; an empty table gives an empty table; other
columns, whatever their names, are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.shared import checkpointed
from quillstone.llm.words import find_words, mix, run_hashes, span_hashes, text_bytes, word_digests

CHUNK_BYTES = 4_000_000
BUCKET_WORDS = 4_000_000
FEWEST_BUCKETS = 64
FAR = 1 << 30
NO_KEY = np.iinfo(np.int64).max

#: Rounds of pairing up to phrases, and from there to sections; each shortens a sequence by a quarter at random bits.
ROUNDS = 6
HIGH_ROUNDS = 10


class Symbols:
    """The symbols of a chunk in order: name, begin and end of their words, begin and end of the words that settle them, document."""

    def __init__(self, names: np.ndarray, firsts: np.ndarray) -> None:
        n = len(names)
        self.names, self.document = names, np.repeat(np.arange(len(firsts) - 1, dtype=np.int32), np.diff(firsts))
        self.begin, self.end = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        self.low, self.high = self.begin.copy(), self.end.copy()

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the next symbol is of the same document; how far the one before and the next reach."""
        same = self.document[1:] == self.document[:-1]
        before = np.full(len(self.names), -FAR, np.int32)
        before[1:][same] = self.low[:-1][same]
        after = np.full(len(self.names), FAR, np.int32)
        after[:-1][same] = self.high[1:][same]
        return same, before, after

    def name_runs(self) -> None:
        if len(self.names) < 2:
            return
        names = self.names
        same, before, after = self.neighbours()
        first = np.flatnonzero(np.r_[True, ~same | (names[1:] != names[:-1])])
        last = np.r_[first[1:], len(names)] - 1
        sizes = last - first + 1
        self.names = np.where(sizes > 1, mix(names[first] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), names[first])
        # that a run ends is settled by its neighbours
        self.low, self.high = np.minimum(self.low[first], before[first]), np.maximum(self.high[last], after[last])
        self.begin, self.end, self.document = self.begin[first], self.end[last], self.document[first]

    def name_pairs(self, turn: int, size: int) -> None:
        """One round; symbols of ``size`` words or more join no further."""
        if len(self.names) < 2:
            return
        names, low, high = self.names.copy(), self.low, self.high
        same, before, after = self.neighbours()
        done = self.end - self.begin >= size
        is_left = (mix(names + np.uint64(turn)) >> np.uint64(63)).astype(bool)
        joins = same & is_left[:-1] & ~is_left[1:] & ~done[:-1] & ~done[1:]
        joined_left, joined_right = np.r_[joins, False], np.r_[False, joins]
        stays = ~done & ~joined_left & ~joined_right
        high = np.where(stays & is_left, np.maximum(high, after), high)
        low = np.where(stays & ~is_left, np.minimum(low, before), low)
        at = np.flatnonzero(joined_left)
        names[at] = mix(names[at] * np.uint64(0x9FB21C651E98DF25) + names[at + 1])
        self.end[at] = self.end[at + 1]
        low[at] = np.minimum(low[at], low[at + 1])
        high[at] = np.maximum(high[at], high[at + 1])
        keep = ~joined_right
        self.names, self.begin, self.end, self.low, self.high, self.document = (x[keep] for x in (names, self.begin, self.end, low, high, self.document))

    def rise(self, size: int, turns: range) -> np.ndarray:
        """Rounds of naming; which symbols then have ``size`` words or more."""
        self.name_runs()
        for turn in turns:
            self.name_pairs(turn, size)
        return self.end - self.begin >= size


def phrases(symbols: Symbols, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, begin and end of the words that settle it, and document of each phrase."""
    done = symbols.rise(phrase, range(ROUNDS))
    return symbols.names[done], symbols.low[done], symbols.high[done], symbols.document[done]


def sections(symbols: Symbols, section: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, begin, end and document of each section, from what ``phrases`` has left, and of each two symbols that follow each other, so
    that windows across their border lie inside one too."""
    done = np.flatnonzero(symbols.rise(section, range(ROUNDS, ROUNDS + HIGH_ROUNDS)))
    names, document = symbols.names, symbols.document
    left = np.flatnonzero(document[1:] == document[:-1])
    pairs = mix(names[left] * np.uint64(0xC2B2AE3D27D4EB4F) + names[left + 1])
    return (
        np.concatenate([names[done], pairs]),
        np.concatenate([symbols.begin[done], symbols.begin[left]]),
        np.concatenate([symbols.end[done], symbols.end[left + 1]]),
        np.concatenate([document[done], document[left]]),
    )


class Hashes:
    """Distinct hashes of a chunk in rising order, each with the least of its keys. ``of`` maps what was given to them."""

    def __init__(self, hashes: np.ndarray, wide: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        new = self.changes(hashes[order], wide[order])
        if new is None:  # equal hashes of unequal things: all must be sorted by both numbers
            order = np.lexsort((wide, hashes))
            new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (wide[order][1:] != wide[order][:-1])][: len(order)]
        number = np.cumsum(new) - 1
        self.of = np.empty(len(order), np.int64)
        self.of[order] = number
        first = order[new]
        self.hashes, self.wide = hashes[first], wide[first]
        starts = np.flatnonzero(new)
        sorted_keys = keys[order]
        self.least = np.minimum.reduceat(sorted_keys, starts) if len(starts) else sorted_keys
        most = np.maximum.reduceat(sorted_keys, starts) if len(starts) else sorted_keys
        self.several = most != self.least

    @staticmethod
    def changes(hashes: np.ndarray, wide: np.ndarray) -> np.ndarray | None:
        """Where sorted hashes change; None if their second numbers change elsewhere."""
        new = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
        return None if (~new[1:] & (wide[1:] != wide[:-1])).any() else new

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each bucket begins, and the end."""
        bucket = (self.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))

    def rows(self, buckets: int) -> list[dict]:
        cuts = self.cuts(buckets).tolist()
        small = len(self.least) and self.least.min() >= 0 and self.least.max() < 2**31
        least = self.least.astype(np.int32) if small else self.least
        return [
            {"bucket": i, "hashes": self.hashes[b:e].tobytes(), "wide": self.wide[b:e].tobytes(), "least": least[b:e].tobytes()}
            for i, (b, e) in enumerate(zip(cuts, cuts[1:]))
            if e > b
        ]

    def bits(self, answers: list[dict], buckets: int, name: str) -> np.ndarray:
        """The answers' bits, for the hashes in their order."""
        cuts = self.cuts(buckets)
        out = np.zeros(len(self.hashes), bool)
        for row in answers:
            b, e = cuts[row["bucket"]], cuts[row["bucket"] + 1]
            out[b:e] = np.unpackbits(np.frombuffer(row[name], np.uint8), count=e - b)
        return out


class Chunk:
    """Documents of a chunk, their words and what is derived from them; the same each time it is made."""

    def __init__(self, blob: bytes, window: int, phrase: int, section: int) -> None:
        batch = pa.ipc.open_stream(blob).read_all().combine_chunks()
        keys = batch.column(0).combine_chunks()
        self.batch, self.window = batch, window
        data, offsets = text_bytes(batch.column(1))
        self.data = data
        self.begins, self.ends, self.firsts = find_words(data, offsets)
        self.words, self.other = (word_digests(data, self.begins, self.ends, seed) for seed in (0, 1))
        self.known = keys.is_valid().to_numpy(zero_copy_only=False)
        self.ids = keys.fill_null(NO_KEY).to_numpy()
        self.document = np.repeat(np.arange(len(self.ids)), np.diff(self.firsts))
        symbols = Symbols(self.words, self.firsts)
        names, low, high, owner = phrases(symbols, phrase)
        use = self.known[owner]
        names, self.low, self.high, self.owner = names[use], low[use], high[use], owner[use]
        high_names, begin, end, owner = sections(symbols, section)
        use = self.known[owner] & (end - begin >= window)
        high_names, self.begin, self.end, self.holder = high_names[use], begin[use], end[use], owner[use]
        self.whole = np.flatnonzero(self.known & (np.diff(self.firsts) >= window))
        whole = mix(span_hashes(self.words, self.firsts[self.whole], self.firsts[self.whole + 1]) + np.uint64(1))
        hashes = np.concatenate([names, high_names, whole])
        wide = np.concatenate(
            [
                np.zeros(len(names), np.uint64),
                *(span_hashes(self.other, b, e, 1) >> np.uint64(32) for b, e in ((self.begin, self.end), (self.firsts[self.whole], self.firsts[self.whole + 1]))),
            ]
        )
        self.first = Hashes(hashes, wide.astype(np.uint32), self.ids[np.concatenate([self.owner, self.holder, self.whole])])

    def verify(self, answers: list[dict], buckets: int) -> None:
        """From the first answers: which documents are whole copies, and the windows that need an answer."""
        shared = self.first.several | self.first.bits(answers, buckets, "shared")
        earlier = self.first.bits(answers, buckets, "earlier")
        n, m = len(self.owner), len(self.holder)
        of = self.first.of[n : n + m]
        repeats = earlier[of] | (self.first.least[of] < self.ids[self.holder])
        change = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(change, self.begin[repeats], 1)
        np.add.at(change, self.end[repeats] - self.window + 1, -1)
        self.found = np.cumsum(change)[:-1] > 0  # windows inside a section that an earlier document has
        of = self.first.of[n + m :]
        self.copied = np.zeros(len(self.ids), bool)
        self.copied[self.whole] = earlier[of] | (self.first.least[of] < self.ids[self.whole])
        alone = ~shared[self.first.of[:n]]
        low, high, begin = self.low[alone], self.high[alone], self.firsts[self.owner[alone]]
        end = self.firsts[self.owner[alone] + 1]
        settles = (low >= begin) & (high <= end) & (high - low <= self.window)
        low, high, begin = low[settles], high[settles], begin[settles]
        change = np.zeros(len(self.words) + 2, np.int32)
        np.add.at(change, np.maximum(high - self.window, begin), 1)
        np.add.at(change, low + 1, -1)
        out = np.cumsum(change)[: len(self.words)] > 0
        total = max(0, len(self.words) - self.window + 1)
        starts = np.arange(total)
        fits = self.document[starts] == self.document[starts + self.window - 1]
        self.starts = np.flatnonzero(fits & ~out[:total] & ~self.found[:total] & (self.known & ~self.copied)[self.document[:total]])
        names = run_hashes(self.words, self.window, 0xA24BAED4963EE407)[self.starts]
        wide = run_hashes(self.other, self.window, 0x9FB21C651E98DF25)[self.starts]
        self.second = Hashes(names, (wide >> np.uint64(32)).astype(np.uint32), self.ids[self.document[self.starts]])

    def removed(self, answers: list[dict], buckets: int) -> np.ndarray:
        """From the second answers: whether each word goes."""
        earlier = self.second.bits(answers, buckets, "earlier")[self.second.of]
        earlier |= self.second.least[self.second.of] < self.ids[self.document[self.starts]]
        gone = np.concatenate([self.starts[earlier], np.flatnonzero(self.found)])
        change = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + self.window, -1)
        return (np.cumsum(change)[:-1] > 0) | self.copied[self.document]


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk, words, blob): documents of about CHUNK_BYTES together, compressed; one longer document is one chunk."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            data, offsets = text_bytes(table.column(1))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(table)
            n = int(find_words(data, offsets)[2][-1])
            return pa.RecordBatch.from_pydict({"chunk": pa.array([part << 32 | number], pa.int64()), "words": pa.array([n], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in rows:
            sizes = np.diff(text_bytes(batch.column(1))[1])
            begin = 0
            for i, more in enumerate(sizes.tolist()):
                if size and size + more > CHUNK_BYTES:
                    held.append(batch.slice(begin, i - begin))
                    yield packed()
                    held, size, begin, number = [], 0, i, number + 1
                size += more
            held.append(batch.slice(begin))
        if sum(b.num_rows for b in held):
            yield packed()

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(pack, "chunk long, words long, blob binary")


ENTRY = "bucket int, chunk long, hashes binary, wide binary, least binary"
ANSWER = "step int, chunk long, bucket int, shared binary, earlier binary"


def as_batch(rows: list[dict], chunk: int) -> pa.Table:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "hashes": pa.binary(), "wide": pa.binary(), "least": pa.binary()}
    given = [r | {"chunk": chunk} for r in rows]
    return pa.table({n: pa.array([r[n] for r in given], k) for n, k in kinds.items()})


def answers(entries: DataFrame, step: int) -> DataFrame:
    """For each entry of a bucket two bits: another chunk has the hash too; it has it with a lesser key."""

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        sizes = [len(h) for h in hashes]
        wide = np.concatenate([np.frombuffer(r["wide"], np.uint32) for r in rows])
        least = np.concatenate([np.frombuffer(r["least"], np.int32 if len(r["least"]) == 4 * n else np.int64).astype(np.int64) for r, n in zip(rows, sizes)])
        both = Hashes(np.concatenate(hashes), wide, least)
        shared = np.bincount(both.of)[both.of] > 1
        earlier = both.least[both.of] < least
        cuts = np.cumsum(sizes)[:-1]
        return pa.table(
            {
                "step": pa.array([step] * len(rows), pa.int32()),
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "shared": pa.array([np.packbits(x).tobytes() for x in np.split(shared, cuts)], pa.binary()),
                "earlier": pa.array([np.packbits(x).tobytes() for x in np.split(earlier, cuts)], pa.binary()),
            }
        )

    return entries.groupBy("bucket").applyInArrow(meet, ANSWER)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, phrase: int = 4, section: int = 48) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space) of each row."""
    packed = checkpointed(chunks(docs, key, text))
    buckets = max(FEWEST_BUCKETS, (packed.agg(F.sum("words")).first()[0] or 0) // BUCKET_WORDS)

    def first(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from as_batch(Chunk(blob.as_py(), window, phrase, section).first.rows(buckets), number).to_batches()

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return as_batch([], 0)
        chunk = Chunk(left.column("blob")[0].as_py(), window, phrase, section)
        chunk.verify(right.to_pylist(), buckets)
        return as_batch(chunk.second.rows(buckets), left.column("chunk")[0].as_py())

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        chunk = Chunk(left.column("blob")[0].as_py(), window, phrase, section)
        chunk.verify([r for r in rows if r["step"] == 1], buckets)
        gone = chunk.removed([r for r in rows if r["step"] == 2], buckets)
        kept = []
        data = chunk.data.tobytes()
        for b, e in zip(chunk.firsts.tolist(), chunk.firsts[1:].tolist()):
            stays = np.flatnonzero(~gone[b:e]) + b
            kept.append(b" ".join([data[i:j] for i, j in zip(chunk.begins[stays].tolist(), chunk.ends[stays].tolist())]).decode())
        sums = np.r_[0, np.cumsum(gone)]
        return pa.table(
            {
                "key": chunk.batch.column(0),
                "n_words": pa.array(np.diff(chunk.firsts), pa.int64()),
                "n_removed": pa.array(sums[chunk.firsts[1:]] - sums[chunk.firsts[:-1]], pa.int64()),
                "kept": pa.array(kept, pa.string()),
            }
        )

    by_chunk = packed.select("chunk", "blob").groupBy("chunk")
    told = checkpointed(answers(packed.select("chunk", "blob").mapInArrow(first, ENTRY), 1))
    verified = answers(by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(second, ENTRY), 2)
    both = told.unionByName(verified)
    out = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(last, "key long, n_words long, n_removed long, kept string")
    return out.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)


def digest(done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts, and a digest of the words that stay."""
    return done.select(key, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
