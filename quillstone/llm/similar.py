"""Near-duplicates of a given shingle similarity: wide SimHash fingerprints, BK-trees in sampled shards, links verified exactly.

Two texts whose sets of ``words``-word shingles have a Jaccard similarity of 0.8 differ in about a sixth of their fingerprints' bits, far beyond
what blocks of a 64-bit fingerprint can promise to find. So fingerprints have 256 bits here, and a table deals them to shards by the values
of some bits drawn for it; the more distinct texts there are, the more bits a table takes and the more tables there are, so that
shards stay small and a pair at ``radius`` bits meets in some table with a likelihood of ``recall`` or more. In each shard a
BK-tree, its children keyed by their Hamming distance to the parent, finds the pairs within the radius.

Of a shard's pairs only those of FORESTS minimum spanning forests by distance go on, the second made without the pairs of the first, and so on:
fewer than FORESTS times its texts, however dense a group of copies is. Each is then verified by the exact similarity of the two shingle sets,
in a join; components of the links that hold are groups so far. A shard of more than ``split_over`` texts, as of one huge group, is dealt again by further bits of its table.

What fingerprints have not joined is settled exactly (``rest``): two sets of the similarity have a shingle in common among the first few of each, in any order
of all shingles, as many as a set may lack and one. Most of these first shingles are in one text only, so they travel as eight bytes each, in packed rows, and go on
if another text has them. There texts meet, unless all that meet are in one group already; pairs of different groups are verified as above if their sizes and the number
of first shingles that they share allow the similarity. Frequent shingles come last in the order, and those at which many texts still meet are
dealt to cells of two blocks each. So the groups are the components of all links that reach the similarity, whatever the fingerprints have found.

The sets of shingles, larger than the texts, are not kept: they are made again where they are needed, and travel for the texts of pairs only.

Defined results: words are those of operator 8, in lower case; a text with fewer words than a shingle has one shingle; texts without words are
equal to each other and to no others; rows of equal shingle sets are one text; rows with a null key take part, and stand behind all
others; an empty table gives an empty table; other columns stay; very long texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import connected
from quillstone.llm.simhash import CHUNK, LOWER, by_shard, roots, tree_links
from quillstone.llm.words import find_words, mix, run_hashes, slices, span_hashes, text_bytes, word_digests
from quillstone.plans.shared import checkpointed, forget, written

WORDS_OF_64 = 4
BITS = 64 * WORDS_OF_64
#: Differing bits of a pair of similarity 0.8, with some two deviations on top.
RADIUS = 48
SHARD = 256
FURTHER = 12
FORESTS = 3
#: Texts that meet at a shingle before it counts as frequent, how many shingles do at most, and the rounds in which they are looked for.
FREQUENT = 64
MOST_FREQUENT = 100_000
ROUNDS = 3
#: Texts of a block, two of which make a cell, and rows of cells that are walked together.
BLOCK = 500
CELLS = 10_000
#: First shingles of a bucket, as many as are wished for, and those that a task packs at once.
BUCKET = 250_000
PACKED = 1_000_000
#: Keys of rows that are broadcast at most.
MOST_BROADCAST = 500_000
_LOWER = np.frombuffer(LOWER, np.uint8)
_LOW = np.uint64(2**32 - 1)
_SALTS = [np.uint64(x) for x in np.random.default_rng(8).integers(1, 2**63, WORDS_OF_64)]


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in rising order, and where each text's begin, and the end."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    begins, ends, firsts = find_words(data, offsets)
    hashes = word_digests(data, begins, ends)
    sizes = np.diff(firsts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    runs = run_hashes(hashes, words, 0x9FB21C651E98DF25)
    at = np.flatnonzero(owner[: len(runs)] == owner[words - 1 :]) if len(runs) else np.zeros(0, np.int64)
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    whole = mix(span_hashes(hashes, firsts[short], firsts[short + 1]) + np.uint64(5))
    found, of = np.concatenate([runs[at], whole]), np.concatenate([owner[at], short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.r_[True, (found[1:] != found[:-1]) | (of[1:] != of[:-1])][: len(found)]
    found, of = found[new], of[new]
    return found, np.searchsorted(of, np.arange(len(sizes) + 1))


def fingerprints(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of WORDS_OF_64 numbers for each set: the majority of the bits of its hashes, mixed with a salt for each of them."""
    n = len(starts) - 1
    out = np.zeros((n, WORDS_OF_64), np.uint64)
    sizes = np.diff(starts)
    for k, salt in enumerate(_SALTS):
        ones = np.zeros((n, 64), np.int32)
        for begin in range(0, len(found), CHUNK):
            end = min(len(found), begin + CHUNK)
            bits = np.unpackbits(mix(found[begin:end] ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cuts = np.unique(np.r_[begin, starts[(starts > begin) & (starts < end)]])
            # of sets that begin at one place only the last has hashes
            ones[np.searchsorted(starts, cuts, side="right") - 1] += np.add.reduceat(bits, cuts - begin, axis=0, dtype=np.int32)
        out[:, k] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def set_ids(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(found + np.uint64(3)))]
    return mix(sums[starts[1:]] - sums[starts[:-1]])


def prints(docs: DataFrame, words: int) -> DataFrame:
    """(who, shingles, size, p0, ...): for each row (who, text) a hash of its shingle set, its size and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, length in slices(batch.column(1)):
                part = batch.slice(begin, length)
                found, starts = shingle_sets(part.column(1), words)
                of_set, sizes = set_ids(found, starts).view(np.int64), np.diff(starts).astype(np.int64)
                wide = fingerprints(found, starts).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of_set), pa.array(sizes), *(pa.array(np.ascontiguousarray(wide[:, k])) for k in range(WORDS_OF_64))], names)

    names = ["who", "shingles", "size", *(f"p{k}" for k in range(WORDS_OF_64))]
    return docs.mapInArrow(run, f"who {docs.schema['who'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]))


def plan(n: int, radius: int, recall: float) -> tuple[int, int]:
    """Bits of a table, and tables, for n texts."""
    bits = max(4, math.ceil(math.log2(max(1, n / SHARD))))
    meets = (1 - radius / BITS) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def dealt(distinct: DataFrame, bits: int, tables: int) -> DataFrame:
    """(shard, id, p0, ...): each text in a shard of each table; the lowest FURTHER bits of ``shard`` tell more bits of the text."""
    places = [np.random.default_rng(t).permutation(BITS)[: bits + FURTHER] for t in range(tables)]  # fewer than 2**12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.stack([batch.column(1 + k).to_numpy() for k in range(WORDS_OF_64)], 1)
            all_bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(-1, 8 * WORDS_OF_64), axis=1, bitorder="little").astype(np.int64)
            for t, own in enumerate(places):
                value = all_bits[:, own] @ (1 << np.arange(len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(value >> FURTHER << FURTHER + 12 | t << FURTHER | value & (1 << FURTHER) - 1), *batch.columns], names)

    names = ["shard", *distinct.columns]
    return distinct.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def forest(n: int, left: np.ndarray, right: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The places of the pairs of a minimum spanning forest, by Boruvka's rounds."""
    order = np.lexsort((right, left, far))
    left, right = left[order], right[order]
    root, kept, rank = np.arange(n), np.zeros(len(order), bool), np.arange(len(order))
    while True:
        a, b = root[left], root[right]
        live = np.flatnonzero(a != b)
        if not len(live):
            return order[kept]
        best = np.full(n, len(order))
        np.minimum.at(best, a[live], rank[live])
        np.minimum.at(best, b[live], rank[live])
        kept[best[best < len(order)]] = True
        root = roots(n, left[kept], right[kept])


def forests(n: int, left: np.ndarray, right: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The places of the pairs of FORESTS forests, each without the pairs of those before."""
    rest = np.arange(len(left))
    found = []
    for _ in range(FORESTS):
        own = forest(n, left[rest], right[rest], far[rest])
        found.append(rest[own])
        rest = np.delete(rest, own)
    return np.concatenate(found)


def candidates(distinct: DataFrame, n: int, radius: int, recall: float, split_over: int) -> DataFrame:
    """(a, b): pairs of texts (id, p0, ...) that stand to be verified."""
    columns = [f"p{k}" for k in range(WORDS_OF_64)]
    rows = dealt(distinct.select("id", *columns), *plan(n, radius, recall))
    top = F.shiftright("shard", FURTHER)
    large = rows.groupBy(top.alias("top")).count().where(F.col("count") > split_over).select("top", F.lit(True).alias("large"))
    large = checkpointed(large)
    if not large.isEmpty():
        rows = rows.withColumn("top", top).join(large, "top", "left").withColumn("shard", F.when(F.col("large"), F.col("shard")).otherwise(F.col("top") * (1 << FURTHER)))
    else:
        rows = rows.withColumn("shard", top)

    def walk(shard: np.ndarray, own: list[np.ndarray]) -> pa.RecordBatch:
        ids, wide = own[0], [x.view(np.uint64) for x in own[1:]]
        left = right = far = np.zeros(0, np.int64)
        for more_left, more_right, more_far in tree_links(shard, wide, radius):
            if len(more_left):
                left, right, far = (np.concatenate(x) for x in ((left, more_left), (right, more_right), (far, more_far)))
                kept = forests(len(ids), left, right, far)
                left, right, far = left[kept], right[kept], far[kept]
        return pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], ["a", "b"])

    pairs = by_shard(rows.select("shard", "id", *columns), walk)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets (id, items) are so similar."""
    first, second = (sets.select(F.col("id").alias(c), F.col("items").alias(f"{c}_items")) for c in ("a", "b"))
    common, least = F.size(F.array_intersect("a_items", "b_items")).cast("long"), exact(similarity)
    every = F.size("a_items") + F.size("b_items") - common
    return pairs.join(first, "a").join(second, "b").where(common * least.denominator >= every * least.numerator).select("a", "b")


def exact(similarity: float) -> Fraction:
    """The number as it is written in decimals, so that a similarity equal to it reaches it."""
    return Fraction(str(similarity))


def firsts(sizes: np.ndarray, least: Fraction) -> np.ndarray:
    """As many elements as a set of each size may lack, and one."""
    return sizes + (-least.numerator * sizes) // least.denominator + 1


def heads(texts: DataFrame, words: int, similarity: float, frequent: np.ndarray, bits: int) -> DataFrame:
    """(part, bucket, told, packed): the first shingles of each text (who, text), those in ``frequent`` (rising keys) last. A shingle's key is the first
    32 + ``bits`` bits of its mixed hash, the first of which tell its bucket; ``packed`` has the others and the lowest 32 bits of the id of the set. Of a shingle
    that some texts of a task share, two go to its bucket; the others are ``told`` already and go to any part."""
    least, buckets = exact(similarity), 1 << bits

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, ids = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        told = np.arange(len(keys)) - np.repeat(begins, np.diff(np.r_[begins, len(keys)])) >= 2
        packed, bucket = keys << np.uint64(32) | ids & _LOW, (keys >> np.uint64(32)).astype(np.int64)
        rows: list[tuple[int, int, bool, bytes]] = []
        for flag in (False, True):
            own = np.flatnonzero(told == flag)
            cuts = np.flatnonzero(np.r_[True, bucket[own][1:] != bucket[own][:-1]]) if len(own) else []
            for some in np.split(own, cuts[1:]) if len(own) else []:
                at = int(bucket[some[0]])
                rows.append((buckets + int(ids[some[0]] % np.uint64(buckets)) if flag else at, at, flag, packed[some].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["part", "bucket", "told", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for begin, length in slices(batch.column(1)):
                found, starts = shingle_sets(batch.column(1).slice(begin, length), words)
                ids, sizes = set_ids(found, starts), np.diff(starts)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                keys = mix(found) >> np.uint64(32 - bits)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
                    keys = keys[np.lexsort((frequent[at] == keys, owner))]  # stable: otherwise as they were
                own = np.arange(len(keys)) - starts[owner] < firsts(sizes, least)[owner]
                held.append((keys[own], ids[owner[own]]))
                if sum(len(k) for k, _ in held) > PACKED:
                    yield pack(held)
                    held = []
        if any(len(k) for k, _ in held):
            yield pack(held)

    return texts.select("who", "text").mapInArrow(run, "part long, bucket long, told boolean, packed binary")


def shared(packed: DataFrame) -> DataFrame:
    """(item, low): the key of each shingle that several of the texts in ``heads`` have, and the lowest bits of the ids of their sets."""

    def rows(bucket: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((values >> np.uint64(32)).astype(np.int64) | bucket << 32), pa.array((values & _LOW).astype(np.int64))], ["item", "low"])

    def met(bucket: int, held: list[bytes]) -> pa.RecordBatch:
        values = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in held]))
        same = values[1:] >> np.uint64(32) == values[:-1] >> np.uint64(32)
        return rows(bucket, values[np.r_[same, False] | np.r_[False, same]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], -1
        for batch in batches:
            for bucket, told, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "told", "packed"))):
                if told:
                    yield rows(bucket, np.frombuffer(value, np.uint64))
                    continue
                if held and bucket != last:
                    yield met(last, held)
                    held = []
                held.append(value)
                last = bucket
        if held:
            yield met(last, held)

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, "item long, low long")


def rest(texts: DataFrame, placed: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): all pairs of the texts (who, text), one for each set (id, root, size) of ``placed``, of different roots that may be so similar."""
    spark, least = texts.sparkSession, exact(similarity)
    n, elements = placed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    total = n + elements * (least.denominator - least.numerator) // least.denominator
    bits = min(30, max(6, math.ceil(math.log2(max(1, total / BUCKET)))))
    own = placed.select(F.col("id").bitwiseAND(F.lit(int(_LOW))).alias("low"), "id", "root", "size")
    frequent = np.zeros(0, np.uint64)
    for left in reversed(range(ROUNDS + 1)):
        found, path = written(shared(heads(texts, words, similarity, frequent, bits)))
        # where two ids have the same lowest bits both stand for either, which adds pairs but loses none
        rows = found.join(own, "low").select("item", "id", "root", "size")
        many = rows.groupBy("item").agg(F.count("*").alias("n"), F.min("root").alias("first"), F.max("root").alias("last")).where(f"n > {FREQUENT} AND first < last")
        large = checkpointed(many.select("item", "n"))
        # once few pairs meet at frequent shingles, another round costs more than they do
        if not left or 4 * (large.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0) <= total:
            break
        more = [r[0] for r in large.orderBy(F.desc("n"), "item").limit(MOST_FREQUENT).collect()]
        more = np.union1d(frequent, np.array(more, np.uint64))[:MOST_FREQUENT]
        if len(more) == len(frequent):
            break
        frequent = more
        forget(spark, path)

    # a few texts meet in one cell; many in one for every two of their blocks
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK)
    mine = F.pmod(F.xxhash64("id"), "blocks")
    met = rows.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, "item", "left").withColumn("blocks", blocks).withColumn("mine", mine)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.col("item")).otherwise(F.xxhash64("item", F.least("mine", "other"), F.greatest("mine", "other")))
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine").cast("int"))

    def walk(shard: np.ndarray, own: list[np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort((own[2], shard))
        shard, (ids, of, sizes, sides) = shard[order], (x[order] for x in own)
        begins = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        ends = np.r_[begins[1:], len(shard)]
        mixed = np.minimum.reduceat(of, begins) < np.maximum.reduceat(of, begins)
        end = np.repeat(np.where(mixed, ends, 0), ends - begins)
        live, by, pairs = np.arange(len(shard)), 0, [np.zeros((3, 0), np.int64)]
        while True:
            by += 1
            live = live[live + by < end[live]]
            # sizes rise within a cell, so what is too large once stays so
            live = live[sizes[live] * least.denominator >= sizes[live + by] * least.numerator]
            if not len(live):
                break
            i, j = live, live + by
            use = (of[i] != of[j]) & ((sides[i] != sides[j]) | (sides[i] == -1))
            i, j = i[use], j[use]
            # what both need to have in common, less what they may have behind their first shingles: all that is before the nearer end of these is in both
            common = -((-least.numerator * (sizes[i] + sizes[j])) // (least.numerator + least.denominator))
            behind = np.maximum(sizes[i] - firsts(sizes[i], least), sizes[j] - firsts(sizes[j], least))
            pairs.append(np.stack([np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j]), common - behind]))
        a, b, least_n = np.concatenate(pairs, axis=1)
        order = np.lexsort((b, a))
        a, b, least_n = a[order], b[order], least_n[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[new], b[new], np.diff(np.r_[new, len(a)]), least_n[new])], ["a", "b", "n", "least"])

    counted = by_shard(met.select(cell.alias("shard"), "id", "root", "size", side.alias("side")), walk, "a long, b long, n long, least long", CELLS)
    pairs = checkpointed(counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least").select("a", "b"))
    forget(spark, path)
    return pairs


def shingle_table(texts: DataFrame, words: int) -> DataFrame:
    """(id, items): the distinct shingles of each row (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, length in slices(batch.column(1)):
                part = batch.slice(begin, length)
                found, starts = shingle_sets(part.column(1), words)
                items = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), items], ["id", "items"])

    return texts.mapInArrow(run, "id long, items array<long>")


def few(keys: DataFrame) -> DataFrame:
    """``keys``, which are checkpointed, broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


def one_of_each(rows: DataFrame, made: DataFrame, distinct: DataFrame) -> tuple[DataFrame, str | None]:
    """A row (who, text) for each set of ``distinct`` (id, least), and the path of the copy where one was made. Texts of other rows don't travel, and none do
    where the rows that are left out are few."""
    seen = made.groupBy("who", F.col("shingles").alias("id")).count().join(distinct.select("id", "least"), "id")
    copies = checkpointed(seen.where("who > least OR count > 1").select("who", (F.col("who") == F.col("least")).alias("again")))
    n, again = copies.agg(F.count("*"), F.count_if("again")).first()
    if not n:
        return rows, None
    texts = rows.join(few(copies), "who", "left_anti")
    if again:
        texts = texts.unionByName(rows.join(few(checkpointed(copies.where("again").select("who"))), "who", "left_semi").dropDuplicates(["who"]))
    return written(texts) if again or n > MOST_BROADCAST else (texts, None)


def groups(rows: DataFrame, words: int, similarity: float, radius: int, recall: float, split_over: int) -> DataFrame:
    """(who, least): for each row (who, text) the least ``who`` of its group."""
    made = checkpointed(prints(rows, words))
    distinct = checkpointed(made.groupBy(F.col("shingles").alias("id")).agg(F.min("who").alias("least"), F.first("size").alias("size"), *(F.first(f"p{k}").alias(f"p{k}") for k in range(WORDS_OF_64))))
    texts, path = one_of_each(rows, made, distinct)

    def held(pairs: DataFrame) -> DataFrame:
        """Those of the pairs, which are checkpointed, that hold."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        owners = checkpointed(distinct.join(ids, "id").select("id", F.col("least").alias("who")))
        return checkpointed(verified(pairs, shingle_table(texts.join(few(owners), "who").select("id", "text"), words), similarity))

    links = held(checkpointed(candidates(distinct, distinct.count(), radius, recall, split_over)))
    root = connected(links).select(F.col("node").alias("id"), "root")
    placed = checkpointed(distinct.select("id", "least", "size").join(root, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"), "size"))
    more = held(rest(texts, placed, words, similarity))
    if path:
        forget(rows.sparkSession, path)
    if not more.isEmpty():
        for c in ("a", "b"):
            more = more.join(placed.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")), c)
        whole = connected(more.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("whole"))
        placed = placed.join(whole, "root", "left").select("id", "least", F.coalesce("whole", "root").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("least"))
    return made.select("who", F.col("shingles").alias("id")).join(placed.select("id", "root"), "id").join(named, "root").select("who", "least")


def representatives(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = RADIUS, recall: float = 0.95, split_over: int = 20_000
) -> DataFrame:
    """One row of each group of ``docs``, that of the least key (a null key last, then by a hash of the text)."""
    own = docs.withColumns({"__id": F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)), "__print": F.xxhash64(F.col(text).cast("string"))})
    rows = own.select(F.struct(F.col("__id").alias("id"), F.col("__print").alias("print")).alias("who"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = checkpointed(groups(rows, words, similarity, radius, recall, split_over))

    def keys(df: DataFrame) -> DataFrame:
        """(__id, __print) of distinct rows' ``who``, broadcast if they are few."""
        return few(checkpointed(df.select(F.col("who.id").alias("__id"), F.col("who.print").alias("__print")).distinct()))

    kept = own.join(keys(found.where("who > least")), ["__id", "__print"], "left_anti")
    # rows of equal key and text are one document; the texts of others need not travel for that
    again = keys(found.groupBy("who").count().where("count > 1"))
    twice = kept.join(again, ["__id", "__print"], "left_semi").dropDuplicates(["__id", "__print"])
    return kept.join(again, ["__id", "__print"], "left_anti").unionByName(twice).drop("__id", "__print")
