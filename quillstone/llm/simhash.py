"""SimHash near-duplicates: fingerprints, links by BK-trees, components.

Distinct fingerprints are dealt to shards: of ``radius + 1`` equal blocks of the 64 bits two fingerprints within
the radius share at least one, so every link lies within the shard of some block and value. In each shard a
BK-tree is built whose children are keyed by their Hamming distance to the parent, and each fingerprint follows only the
edges whose key is within the radius of its own distance to the node. A set of all fingerprints has no size
bound, so the trees are not broadcast: shards and queries meet by the shuffle, and a task walks the trees of some
shards at a time, level by level. A shard larger than ``split_over`` is dealt again by blocks of its
other bits, which holds for them too, until none is larger: a shard of which w bits are not dealt yet has 2**w fingerprints at most, so this ends.

Within a shard only links that join two sets not yet joined go on to the components, one fewer than fingerprints
at most; they reach what all links reach.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links like any
other; fewer than three words make one shingle; rows with a null key take part and get the least non-null key of
their component; repeated keys each give a row; an empty table gives an empty table; other columns, whatever their names, are left aside;
very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import connected
from quillstone.plans.shared import checkpointed

SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Pairs of a search and a node that are looked at together.
FRONTIER = 1_000_000
#: Rows whose shards are walked together; a larger shard is walked alone.
TOGETHER = 100_000


def fingerprint(text: str, words: int = 3) -> int:
    """The majority of the bits of the shingles' XXH64; ties are 0."""
    found = text.encode().translate(LOWER).split()
    n = max(1, len(found) - words + 1) if found else 0
    if not n:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[b:e], SEED) for b, e in zip(begins[at : at + CHUNK], ends[at : at + CHUNK])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key`` and ``bits``, the fingerprint as a long, for each row."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            bits = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["key", "bits"])

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(batches, f"key {kind}, bits long").withColumnRenamed("key", key)


def distance(bits: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the points at ``a`` and ``b``; a point has 64 bits in each array."""
    out = np.zeros(len(a), np.int64)
    for own in bits:
        out += np.bitwise_count(own[a] ^ own[b])
    return out


def tree_links(shard: np.ndarray, bits: list[np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs within the radius of each other in the same shard, each pair once, and their distances, by one BK-tree for each
    shard. All trees are built and searched level by level; so many searches go together that they stand at FRONTIER nodes at most."""
    n, most = len(shard), 64 * len(bits)
    # building: the first point that arrives at a free place becomes the node there; the others go on to its
    # child of their distance to it
    parent, edge = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    waiting, at, step = np.arange(n), np.full(n, -1, np.int64), np.asarray(shard)
    while len(waiting):
        # the order is stable, so each free place goes to its first comer
        order = np.lexsort((waiting, step, at))
        waiting, at, step = waiting[order], at[order], step[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (step[1:] != step[:-1])]
        node = waiting[new][np.cumsum(new) - 1]
        parent[waiting[new]], edge[waiting[new]] = at[new], step[new]
        rest = ~new
        waiting, at = waiting[rest], node[rest]
        step = distance(bits, waiting, at)
    children = np.lexsort((edge, parent))
    children = children[parent[children] >= 0]
    place = parent[children] * (most + 1) + edge[children]
    roots = np.flatnonzero(parent < 0)
    order = np.argsort(edge[roots], kind="stable")  # a root's edge holds its shard
    roots = roots[order]
    tree = np.searchsorted(edge[roots], shard)
    sizes = np.bincount(tree)
    begin = 0
    while begin < n:
        # searches stand at all nodes of their trees at worst
        ahead = np.cumsum(sizes[tree[begin : begin + FRONTIER]])
        end = begin + max(1, int(np.searchsorted(ahead, FRONTIER, side="right")))
        query = np.arange(begin, min(n, end))
        node = roots[tree[query]]
        begin = end
        while len(query):
            far = distance(bits, query, node)
            hit = (far <= radius) & (query < node)
            yield query[hit], node[hit], far[hit]
            low = np.searchsorted(place, node * (most + 1) + np.maximum(far - radius, 0))
            high = np.searchsorted(place, node * (most + 1) + np.minimum(far + radius, most), side="right")
            sizes_here = high - low
            ends = np.cumsum(sizes_here)
            inner = np.repeat(low - ends + sizes_here, sizes_here) + np.arange(int(ends[-1]))
            query, node = np.repeat(query, sizes_here), children[inner]


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n places the least place that the pairs let it reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while (further := new[new] != new).any():
            new = np.where(further, new[new], new)
        if (new == root).all():
            return root
        root = new


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer pairs of the same components: each place with the least place that it reaches."""
    root = roots(n, left, right)
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def by_shard(rows: DataFrame, walk: Callable[[np.ndarray, list[np.ndarray]], pa.RecordBatch], kind: str = "a long, b long", together: int | None = None) -> DataFrame:
    """(a, b) or as ``kind`` says: what ``walk`` finds in the rows (shard, ...) of whole shards, some of them together up to ``together`` rows, or TOGETHER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not batch.num_rows:
                continue
            if sum(len(h[0]) for h in held) + batch.num_rows > (together or TOGETHER):
                # what belongs to the last shard waits for the rest of it
                shard, *own = (np.concatenate(x) for x in zip(*held, columns))
                cut = int(np.searchsorted(shard, shard[-1]))
                if cut:
                    yield walk(shard[:cut], [x[:cut] for x in own])
                held = [[x[cut:] for x in (shard, *own)]]
            else:
                held.append(columns)
        if held:
            shard, *own = (np.concatenate(x) for x in zip(*held))
            yield walk(shard, own)

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, kind)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (shard, bits, left, width) in a shard for each of ``parts`` blocks of the ``width`` lowest bits of ``left``, which go
    on without that block."""
    shift_left, shift_right = (lambda value, by, name=name: F.call_function(name, value, by) for name in ("shiftleft", "shiftrightunsigned"))
    one = F.lit(1).cast("long")
    cut = rows.withColumn("part", F.explode(F.array(*map(F.lit, range(parts)))))
    cut = cut.withColumn("low", F.expr(f"cast(width * part div {parts} as int)")).withColumn("high", F.expr(f"cast(width * (part + 1) div {parts} as int)"))
    value = shift_right(F.col("left"), F.col("low")).bitwiseAND(shift_left(one, F.col("high") - F.col("low")) - one)
    # a shift by all 64 bits would be one by none
    above = F.when(F.col("high") < 64, shift_left(shift_right(F.col("left"), F.col("high")), F.col("low"))).otherwise(F.lit(0).cast("long"))
    below = F.col("left").bitwiseAND(shift_left(one, F.col("low")) - one)
    return cut.select(F.xxhash64("shard", "part", value).alias("shard"), "bits", above.bitwiseOR(below).alias("left"), (F.col("width") - F.col("high") + F.col("low")).alias("width"))


def sharded(prints: DataFrame, radius: int, split_over: int) -> DataFrame:
    """(shard, bits): each distinct fingerprint in one shard for each block, or in more where a shard was dealt again."""
    parts = radius + 1
    rows = dealt(prints.select(F.lit(0).cast("long").alias("shard"), "bits", F.col("bits").alias("left"), F.lit(64).alias("width")), parts)
    small = []
    while True:
        # fewer bits than blocks can't be dealt, and tell few fingerprints apart
        sizes = rows.where(F.col("width") >= parts).groupBy("shard").count().where(F.col("count") > split_over)
        if sizes.isEmpty():
            small.append(rows.select("shard", "bits"))
            return reduce(DataFrame.unionByName, small)
        marked = rows.join(sizes, "shard", "left")
        small.append(marked.where("count IS NULL").select("shard", "bits"))
        rows = checkpointed(dealt(marked.where("count IS NOT NULL").select(*rows.columns), parts))


def links(prints: DataFrame, radius: int = 3, split_over: int = 20_000) -> DataFrame:
    """(a, b): links among distinct fingerprints ``bits`` that connect what all pairs within the radius connect."""

    def walk(shard: np.ndarray, own: list[np.ndarray]) -> pa.RecordBatch:
        (bits,) = own
        left = right = np.zeros(0, np.int64)
        for more_left, more_right, _ in tree_links(shard, [bits.view(np.uint64)], radius):
            # a dense shard has many more links than points: they are thinned out as they come
            if len(more_left):
                left, right = spanning(len(bits), np.concatenate([left, more_left]), np.concatenate([right, more_right]))
        return pa.RecordBatch.from_arrays([pa.array(bits[left]), pa.array(bits[right])], ["a", "b"])

    return by_shard(sharded(prints, radius, split_over), walk)


def components(prints: DataFrame, key: str = "doc_id", radius: int = 3) -> DataFrame:
    """``key``, ``bits`` and ``component_id``, the least key of the rows reached by links of at most ``radius`` bits."""
    prints = checkpointed(prints)  # two numbers a row, read three times
    distinct = prints.groupBy("bits").agg(F.min(key).alias("least"))
    roots = connected(links(distinct.select("bits"), radius)).select(F.col("node").alias("bits"), "root")
    grouped = distinct.join(roots, "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = grouped.join(named, "root").select("bits", "component_id")
    return prints.join(ids, "bits").select(key, "bits", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, words: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` in hexadecimal and ``component_id`` of each row."""
    found = components(fingerprints(docs, key, text, words), key, radius)
    return found.select(key, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
