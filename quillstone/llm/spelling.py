"""Grouping of spelling variants by an Aho-Corasick automaton of word halves.

Two words at a distance of one edit have one half of either in common: the first half of the one begins the other, or its second half ends
it. So every word gives two segments, and all words are scanned for them by automata, a shard of segments each; a hit counts where it
stands at the segment's place and the lengths differ by one at most, and is then verified by distance. A word is sent only to the
shards that can hold a segment of it: those of the halves of words of its length and of one less and more.

A segment that very many words share is not left to one task: what is between it and the other end is halved again, and the words are held
under a beginning and an end, longer together; so on until no key has more than HOT rows, or one code point is left, which few
words can differ in. In a task the holders of a segment are looked up by what is left of them, with a code point less, so common segments cost no
comparison of all their pairs.

Counting words is one shuffle with partial sums; everything later is as large as the vocabulary. Forms are followed to roots by doubling.

Defined results: a null text has no words; a null key counts as an empty one in the checksum; repeated rows count each; empty tables give
an empty table; texts are taken whole, however long; further columns, whatever their names, are left aside.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.plans.shared import forget, written

LETTERS = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a key above which it is made longer, and rows of a shard.
HOT = 20_000
SHARD = 100_000


def slips(docs: DataFrame, least: int, every: int, key: str, text: str) -> DataFrame:
    """``word`` of each run of letters with ``least`` code points at least; of one in ``every`` a code point is left out."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    # lower() would change letters beyond A-Z too
    low = F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.lower("run"))
    sums = runs.select("k", low.alias("run")).withColumn("sum", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
    size = F.length("run")
    at = (F.col("sum") % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    return sums.select(F.when(F.col("sum") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def words(docs: DataFrame, least: int = 6, often: int = 5, every: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and its number ``n`` of occurrences, ``often`` at least."""
    return slips(docs, least, every, key, text).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def segment_key() -> Column:
    """Length of the holders, the beginning and the end that they share."""
    return F.concat_ws("|", F.col("held").cast("string"), F.substring("word", F.lit(1), F.col("head")), F.when(F.col("tail") > 0, F.expr("right(word, tail)")).otherwise(F.lit("")))


def keyed(vocabulary: DataFrame) -> DataFrame:
    """A row for each half of each word as its holder, and for each half of words of a length near its own by which it may be found."""
    near = F.array(F.length("word") - 1, F.length("word"), F.length("word") + 1)
    rows = vocabulary.select("word", "n", F.explode(near).alias("held")).withColumn("holds", F.col("held") == F.length("word"))
    half = F.floor(F.col("held") / 2).cast("int")
    sides = F.array(F.struct(half.alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(0).alias("head"), (F.col("held") - half).alias("tail")))
    rows = rows.select("*", F.explode(sides).alias("s")).select("word", "n", "held", "holds", "s.head", "s.tail")
    return rows.withColumn("key", segment_key())


def refined(rows: DataFrame, hot: int) -> DataFrame:
    """``rows`` with longer keys in place of those that more than ``hot`` rows have, written."""
    rows, path = written(rows)
    while True:
        middle = F.col("held") - F.col("head") - F.col("tail")
        large = rows.where(middle > 1).groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select("key")
        large, large_path = written(large)
        if large.isEmpty():
            forget(rows.sparkSession, large_path)
            return rows
        half = F.floor(middle / 2).cast("int")
        two = F.array(F.struct((F.col("head") + half).alias("head"), "tail"), F.struct("head", (F.col("tail") + middle - half).alias("tail")))
        longer = rows.join(large, "key").withColumn("s", F.explode(two)).drop("head", "tail", "key").select("*", "s.head", "s.tail").drop("s").withColumn("key", segment_key())
        before = path, large_path
        rows, path = written(rows.join(large, "key", "left_anti").unionByName(longer))
        for old in before:
            forget(rows.sparkSession, old)


def without_one(word: str) -> Iterator[str]:
    return (word[:i] + word[i + 1 :] for i in range(len(word)))


class Holders:
    """Words of one length with a beginning and an end in common, by what is between."""

    def __init__(self) -> None:
        self.whole: dict[str, tuple[str, int]] = {}
        self.shorter: dict[str, set[str]] = defaultdict(set)

    def add(self, middle: str, word: str, n: int) -> None:
        self.whole[middle] = (word, n)
        for s in without_one(middle):
            self.shorter[s].add(middle)

    def near(self, middle: str, difference: int) -> Iterator[tuple[str, int]]:
        """Holders at a distance of one from a word with ``middle`` between, which is longer by ``difference``."""
        if difference < 0:
            found = self.shorter.get(middle, ())
        elif difference > 0:
            found = {s for s in without_one(middle) if s in self.whole}
        else:
            same = {m for s in without_one(middle) for m in self.shorter.get(s, ())}
            found = [m for m in same if sum(a != b for a, b in zip(m, middle)) == 1]
        return (self.whole[m] for m in found)


def scan(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n): the holders of this shard that are near each of its words."""
    segments = ahocorasick.Automaton()
    groups: dict[tuple[int, str, str], Holders] = defaultdict(Holders)
    for word, n, head, tail in rows.loc[rows["holds"], ["word", "n", "head", "tail"]].itertuples(index=False):
        begin, end = word[:head], word[len(word) - tail :]
        groups[len(word), begin, end].add(word[head : len(word) - tail], word, n)
        for segment in (begin, end):
            if segment:
                segments.add_word(segment, segment)
    out = set()
    if len(segments):
        segments.make_automaton()
        for word in rows["word"].unique():
            begins, ends = [""], [""]
            for last, segment in segments.iter(word):
                if last + 1 == len(segment):
                    begins.append(segment)
                if last + 1 == len(word):
                    ends.append(segment)
            for begin in begins:
                for end in ends:
                    for held in (len(word) - 1, len(word), len(word) + 1):
                        group = groups.get((held, begin, end)) if len(begin) + len(end) <= len(word) else None
                        if group is not None:
                            middle = word[len(begin) : len(word) - len(end)]
                            out.update((word, w, n) for w, n in group.near(middle, len(word) - held))
    return pd.DataFrame(list(out), columns=["word", "near", "near_n"])


def near_words(vocabulary: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(word, near, near_n): all pairs of words at a distance of one, both ways round."""
    rows = refined(keyed(vocabulary), hot)
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.select("word", "n", "holds", "head", "tail", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInPandas(lambda rows: scan(rows), "word string, near string, near_n long")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): the last form that is reached. A form has more occurrences than its word, so no way returns;
    each round doubles the way that has been followed."""
    now, path = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = now.join(on, "root", "left")
        old = path
        now, path = written(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(now.sparkSession, old)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, least: int = 6, often: int = 5, ratio: int = 5, every: int = 199, key: str = "doc_id", text: str = "text", hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """``word``, ``form`` (its near word with most occurrences, if these are ``ratio`` times its own), ``root``, ``n``, ``n_near`` and ``form_n``."""
    vocabulary, _ = written(words(docs, least, often, every, key, text))
    near = near_words(vocabulary, hot, shard)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    per, _ = written(near.groupBy("word").agg(F.count("*").alias("n_near"), best))
    known = vocabulary.join(per, "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    known, _ = written(known)
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
