"""Line deduplication by pairwise alignment.

Overlapping documents are found by the hashes of what they share: each line, each further equal line with its number in the document, and each two
shared lines with no other shared line between them. A hash that one document alone has links nothing; any other links each of its
holders to the earliest of them, so a link is one pair for each hash and document, however frequent a line is, and never all pairs of
those that share it. The two documents of a pair are aligned by patience diff over their line hashes:
lines that stand once in either are matched in the longest order common to both, then the stretches between matches are
treated alike, and equal lines beside matches join them. Aligned lines are deleted from the later document. Each document is
judged on the input, so what is deleted elsewhere changes nothing.

Shared lines that stay (their order differs, say) are tried with further earlier holders, FEWEST of them in the first round and four times as
many in each that follows, until they go or no holder is left. So a line goes if, and only if, some earlier document that has it aligns with it:
other documents do not matter, and the number of rounds is the logarithm of the number of holders. Only lines that conflict in order with all
earlier holders are tried with each.

Documents are ordered by key and then by a hash of the text; rows equal in both are the same document and get the same result.

Lines are the pieces between newlines, without white space at their ends; an empty line is never linked, matched or
deleted. Defined results: a null text is returned as null; rows with a null key are returned whole and link nothing;
an empty table gives an empty table; a very long text is aligned whole; other columns stay, but for those named like the two that are added.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.shared import forget, written

def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence of distinct numbers, by patience sorting."""
    tops: list[int] = []  # the place of the top card of each pile
    tails: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tails, v)
        back[i] = tops[pile - 1] if pile else -1
        if pile == len(tails):
            tails.append(v)
            tops.append(i)
        else:
            tails[pile] = v
            tops[pile] = i
    out = []
    at = tops[-1] if tops else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        mine: dict[int, int] = {}
        for j in range(b0, b1):
            mine[b[j]] = -1 if b[j] in mine else j
        both = [(i, j) for h, j in mine.items() if j >= 0 and (i := once.get(h, -1)) >= 0]
        both.sort(key=lambda p: p[1])
        chain = [both[k] for k in longest_rising([i for i, _ in both])]
        if not chain:
            continue
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            stack.append((i0 + 1, i1, j0 + 1, j1))
        out += chain
    return sorted(out)


#: Rows that are broadcast at most, counted first.
BROADCAST = 200_000
#: Further holders that a line is tried with in the first round.
FEWEST = 4
SPACES = " \t\n\x0b\x0c\r"


def line_lists(docs: DataFrame) -> DataFrame:
    """(who, hashes): of each distinct document the hash of every line, null where it is empty."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))
    known = docs.where(F.col("key").isNotNull() & F.col("text").isNotNull())
    hashes = known.select("key", "text_hash", F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x))).alias("hashes"))
    return hashes.dropDuplicates(["key", "text_hash"]).select(F.struct("key", "text_hash").alias("who"), "hashes")


def align(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        gone = []
        for i in range(batch.num_rows):
            earlier, later = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
            # lines that one document lacks align with nothing
            known = set(earlier) - {None}
            at = [j for j, h in enumerate(later) if h in known]
            common = {later[j] for j in at}
            match = patience([h for h in earlier if h in common], [later[j] for j in at])
            gone.append([at[j] for _, j in match])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["key", "text_hash", "gone"])


def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        masks = []
        for i in range(batch.num_rows):
            places = batch.column(2)[i].values.flatten().to_numpy(zero_copy_only=False)
            mask = np.zeros(int(places.max(initial=-1)) + 1, bool)
            mask[places] = True
            masks.append(mask)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.list_(pa.bool_()))], ["key", "text_hash", "gone"])


def aligned(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, text_hash, gone): for each pair (first, who) the places of the lines of ``who`` that align."""
    later = pairs.join(lists.select("who", F.col("hashes").alias("later")), "who")
    both = later.join(lists.select(F.col("who").alias("first"), F.col("hashes").alias("earlier")), "first")
    return both.select("who.key", "who.text_hash", "earlier", "later").mapInArrow(align, "key long, text_hash long, gone array<int>")


def merged(found: DataFrame) -> DataFrame:
    """One row a document of the places that its partners found, as a mask."""
    return found.groupBy("key", "text_hash").agg(F.collect_list("gone").alias("gone")).mapInArrow(merge, "key long, text_hash long, gone array<boolean>")


def link(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each document's shared lines, null for others, and its links: shared lines, each further equal line with its
    number, each two shared lines that follow each other."""
    for batch in rows:
        lists, links = [], []
        for i in range(batch.num_rows):
            shared = set(batch.column(3)[i].as_py())
            hashes = [h if h in shared else None for h in batch.column(2)[i].as_py()]
            times: dict[int, int] = {}
            out, before = set(), None
            for h in hashes:
                if h is None:
                    continue
                n = times[h] = times.get(h, 0) + 1
                out.add(h if n == 1 else hash((0, h, n)))
                if before is not None:
                    out.add(hash((1, before, h)))
                before = h
            lists.append(hashes)
            links.append(list(out))
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, kind), pa.array(links, kind)], ["key", "text_hash", "hashes", "links"])


def stay(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and hashes of lines that are shared with an earlier document and not gone."""
    for batch in rows:
        which, places, found = [], [], []
        for i in range(batch.num_rows):
            hashes, shared, gone = (batch.column(c)[i].as_py() for c in (2, 3, 4))
            shared, gone = set(shared), gone or []
            left = [j for j, h in enumerate(hashes) if h in shared and not (j < len(gone) and gone[j])]
            which += [i] * len(left)
            places += left
            found += [hashes[j] for j in left]
        at = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(found, pa.int64())], ["key", "text_hash", "at", "hash"]
        )


def among(df: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` with a counterpart in ``some``, which has ``n`` rows at most and is broadcast if these are few."""
    return df.join(F.broadcast(some) if n <= BROADCAST else some, some.columns, "left_semi")


def deletions(docs: DataFrame) -> DataFrame:
    """(key, text_hash, gone): for each line from the first on whether it goes, where any does; later lines stay."""
    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        df, path = written(df)
        paths.append(path)
        return df

    lists = kept(line_lists(docs))
    who = F.struct("key", "text_hash").alias("who")
    rows = lists.select("who", F.explode(F.array_distinct("hashes")).alias("hash")).where("hash IS NOT NULL")
    shared = kept(rows.groupBy("hash").agg(F.min("who").alias("first"), F.max("who").alias("last")).where("first < last").select("hash"))
    shared = rows.join(shared, "hash").groupBy("who").agg(F.collect_list("hash").alias("shared"))
    lists = lists.join(shared, "who").select("who.key", "who.text_hash", "hashes", "shared")
    lists = kept(lists.mapInArrow(link, "key long, text_hash long, hashes array<long>, links array<long>").select(who, "hashes", "links"))
    links = lists.select("who", F.explode("links").alias("hash"))
    first = links.groupBy("hash").agg(F.min("who").alias("first"), F.max("who").alias("last")).where("first < last").select("hash", "first")
    met = kept(links.join(kept(first), "hash").where("first < who"))
    tried = kept(met.select("first", "who").distinct())
    found = kept(aligned(tried, lists))
    shared = met.groupBy("who").agg(F.collect_set("hash").alias("shared"))
    left = lists.join(shared, "who").join(merged(found).select(who, "gone"), "who", "left").select("who.key", "who.text_hash", "hashes", "shared", "gone")
    left = kept(left.mapInArrow(stay, "key long, text_hash long, at int, hash long").select(who, "at", "hash"))
    n, batch = left.count(), FEWEST
    tried = among(tried, left.select("who").distinct(), n)
    holders = among(lists.select("who", F.explode(F.array_distinct("hashes")).alias("hash")).where("hash IS NOT NULL"), left.select("hash").distinct(), n)
    gone = [found]
    while n:
        # the next holders of each line; a task keeps that many of a line at most before they are shuffled
        rank = F.row_number().over(Window.partitionBy("hash").orderBy("who"))
        following = kept(holders.withColumn("rank", rank).where(F.col("rank") <= batch).select("hash", F.col("who").alias("first")))
        ahead = kept(left.join(following, "hash").where("first < who"))
        pairs = kept(ahead.select("first", "who").distinct().join(tried, ["first", "who"], "left_anti"))
        left = ahead.select("who", "at", "hash").distinct()
        n_pairs = pairs.count()
        if n_pairs:
            ends = pairs.select("who").unionByName(pairs.select(F.col("first").alias("who"))).distinct()
            gone.append(kept(aligned(pairs, among(lists, ends, 2 * n_pairs))))
            left = left.join(gone[-1].select(who, F.explode("gone").alias("at")), ["who", "at"], "left_anti")
            tried = tried.unionByName(pairs)
        left = kept(left)
        if not (n := left.count()):
            break
        last = following.groupBy("hash").agg(F.max("first").alias("last")).join(left.select("hash").distinct(), "hash", "left_semi")
        holders = kept(holders.join(F.broadcast(last) if n <= BROADCAST else last, "hash").where("who > last").select("who", "hash"))
        batch *= 4
    done, _ = written(merged(reduce(DataFrame.unionByName, gone)))
    for path in paths:
        forget(spark, path)
    return done


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the lines that stay in ``text``, and the numbers of lines and of those removed in two columns."""
    own = docs.withColumns({"__key": F.col(key).cast("long"), "__print": F.xxhash64(F.col(text).cast("string"))})
    slim = own.select(F.col("__key").alias("key"), F.col(text).cast("string").alias("text"), F.col("__print").alias("text_hash"))
    gone = deletions(slim).select(F.col("key").alias("__key"), F.col("text_hash").alias("__print"), F.col("gone").alias("__gone"))
    pieces = F.split(F.col(text).cast("string"), "\n", -1)
    stays = F.array_join(F.filter(pieces, lambda x, i: ~F.coalesce(F.get("__gone", i), F.lit(False))), "\n")
    joined = own.join(gone, ["__key", "__print"], "left")
    removed = F.size(F.filter(F.coalesce("__gone", F.array().cast("array<boolean>")), lambda x: x))
    return joined.withColumns(
        {
            names[0]: F.when(F.col(text).isNull(), 0).otherwise(F.size(pieces)).cast("long"),
            names[1]: removed.cast("long"),
            text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(stays),
        }
    ).drop("__key", "__print", "__gone")
