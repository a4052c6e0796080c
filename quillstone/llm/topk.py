"""Exact top-k search by distributed histogram selection.

Queries and candidates are dealt to the cells of a grid, some thousand queries by some thousand candidates, and each
cell scores all its pairs by matrix products. A round of selection makes a histogram of all scores of each query over BINS bins of the
interval that is known to hold its kth score; the histograms of all cells are added, and the query goes on with the bin that holds the kth
score, until that bin is one value or has few scores more than are wanted. A last round returns the scores that reach the kth, ranks them, and
gives ties to the smaller id.

A cell sends its histogram from the highest bin down to where it has k scores by itself: the kth score of all lies there or above, and
counts below can't move it. Of the last round's scores a cell sends each query's k best at most.

Scores are exact: products run in floating point where the sums of magnitudes stay within its integers, otherwise in 64-bit
integers, and pairs that may not fit these are computed one by one.

Defined results: a component counts as floor(scale * x), where scale * x is the largest double if it is beyond; a score that no long can hold
counts as the nearest long. Of vectors of unequal length the missing components count as zero; vectors that are null or hold null or
non-finite components, and rows with a null id, take no part; an id that is repeated is one query (its least vector) and as many
candidates as rows, none of them for itself; with fewer candidates than k all are returned; empty tables give an empty table; other
columns, whatever their names, are left aside. Of long vectors a cell holds some thousand whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.shared import forget, written

QUERIES, CANDIDATES = 4096, 8192
#: Queries of a cell that are scored at a time.
STEP = 128
BIN_DIGITS = 12
BINS = 1 << BIN_DIGITS
LONGS = np.iinfo(np.int64)
KEPT = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v) of the rows that take part; v has scale * x, still to be rounded down."""
    most = float(np.finfo(np.float64).max)
    usable = ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    within = F.transform("x", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(scale) * x)))
    return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & usable).select("id", within.alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, with zeros behind the shorter ones."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return np.floor(out)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows; float32 or float64 where these are exact, else int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 2**53:
        return a @ b.T
    fits = max(np.abs(a).max(), np.abs(b).max()) < 2**63
    out = a.astype(np.int64) @ b.astype(np.int64).T if fits else np.zeros((len(a), len(b)), np.int64)
    with np.errstate(all="ignore"):
        doubtful = np.argwhere(~(np.abs(a) @ np.abs(b).T < 2**62) if fits else np.ones(out.shape, bool))
    for i, j in doubtful.tolist():
        exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j]))
        out[i, j] = min(max(exact, LONGS.min), LONGS.max)
    return out


def cells(queries: DataFrame, candidates: DataFrame, rows: int, columns: int) -> DataFrame:
    """Each query in every cell of its row, each candidate in every cell of its column."""
    empty = F.lit(None).cast("long")
    left = queries.select(F.pmod(F.xxhash64("id"), F.lit(rows)).cast("long").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"), F.lit(True).alias("asks"), "id", "v", "low", "high")
    right = candidates.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("r"), (F.monotonically_increasing_id() % columns).cast("int").alias("c"), F.lit(False).alias("asks"), "id", "v", empty.alias("low"), empty.alias("high")
    )
    return left.unionByName(right)


def in_cells(dealt: DataFrame, width: int, find: Callable, result: str) -> DataFrame:
    """``find(ids, low, high, candidate ids, scores, which count)`` for STEP queries of each cell at a time; a pair counts if its score is in
    the query's interval and it is no row with itself."""
    kinds = [f.split() for f in result.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32()}

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        q, c = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        found = [[np.zeros(0, np.int64)] for _ in kinds]
        if q.num_rows and c.num_rows:
            asked, given = matrix(q.column("v"), width), matrix(c.column("v"), width)
            ids, others = q.column("id").to_numpy(), c.column("id").to_numpy()
            low, high = q.column("low").to_numpy(), q.column("high").to_numpy()
            order = np.argsort(others, kind="stable")
            begin, end = np.searchsorted(others[order], ids), np.searchsorted(others[order], ids, side="right")
            for at in range(0, len(ids), STEP):
                some = slice(at, at + STEP)
                scores = products(asked[some], given).astype(np.int64)
                counts = (scores >= low[some, None]) & (scores <= high[some, None])
                for i in (np.flatnonzero(end[some] > begin[some]) + at).tolist():
                    counts[i - at, order[begin[i] : end[i]]] = False
                for column, part in zip(found, find(ids[some], low[some], high[some], others, scores, counts)):
                    column.append(part)
        return pa.table({n: pa.array(np.concatenate(f), types[t]) for (n, t), f in zip(kinds, found)})

    return dealt.groupBy("r", "c").applyInArrow(run, result)


def bits_of(width: np.ndarray) -> np.ndarray:
    """Binary digits of numbers without a sign."""
    out = np.zeros(len(width), np.uint64)
    for digits in range(64):
        out += (width >> np.uint64(digits)) > 0
    return out


def histogram(k: int) -> Callable:
    """Bins are 2**n values wide, the fewest that let BINS of them hold the interval."""

    def find(ids, low, high, others, scores, counts):  # noqa: ANN001
        # differences of 64-bit numbers, in 64 bits without a sign
        begin = low.view(np.uint64)
        digits = bits_of(high.view(np.uint64) - begin)
        shift = np.where(digits > BIN_DIGITS, digits - np.uint64(BIN_DIGITS), np.uint64(0))
        bins = (scores.view(np.uint64) - begin[:, None]) >> shift[:, None]
        bins += (np.arange(len(ids), dtype=np.uint64) * np.uint64(BINS))[:, None]
        bins[~counts] = len(ids) * BINS
        full = np.bincount(bins.view(np.int64).ravel(), minlength=len(ids) * BINS + 1)[:-1].reshape(-1, BINS)
        above = full[:, ::-1].cumsum(1)[:, ::-1] - full
        which, found = np.nonzero((full > 0) & (above < k))
        return ids[which], found, full[which, found]

    return find


def reaching(k: int) -> Callable:
    def find(ids, low, high, others, scores, counts):  # noqa: ANN001
        at, place = np.nonzero(counts)
        score, other = scores[at, place], others[place]
        order = np.lexsort((other, ~score, at))
        at, score, other = at[order], score[order], other[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < k
        return ids[at[keep]], other[keep], score[keep]

    return find


def search(vectors: DataFrame, asks: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the k best of all other rows for each row where ``asks`` holds, a
    condition on ``id``."""
    rows = scaled(vectors, key, vector, scale)
    # no score is farther from zero than the product of the lengths, each with one more for the rounding of every component
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1)))
    n, asked, width, longest = rows.agg(F.count("*"), F.count_if(asks), F.max(F.size("v")), F.max(norm)).first()
    grid = max(1, -(-asked // QUERIES)), max(1, -(-n // CANDIDATES))
    reach = norm * F.lit(float(longest or 0)) * 1.000001 + 1
    bound = F.when(reach < 2.0**62, reach.cast("long")).otherwise(F.lit(LONGS.max))
    queries = rows.where(asks).groupBy("id").agg(F.min("v").alias("v"))
    state, path = written(queries.select("id", "v", (-bound).alias("low"), bound.alias("high"), F.lit(0).cast("long").alias("above"), F.lit(LONGS.max).alias("inside")))
    few = max(64, 4 * k)
    going = (F.col("low") < F.col("high")) & (F.col("inside") > few)
    while asked and state.where(going).limit(1).count():
        counts = in_cells(cells(state.where(going), rows, *grid), width, histogram(k), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        higher = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = counts.withColumn("higher", higher).join(state.select("id", "above"), "id").where(f"above + higher < {k} AND above + higher + n >= {k}")
        chosen = reached.select("id", "bin", "higher", "n")
        wide = "decimal(38,0)"
        digits = F.coalesce(F.length(F.bin(F.try_subtract("high", "low"))), F.lit(64))
        step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(digits - BIN_DIGITS, F.lit(0)))
        low = F.col("low").cast(wide) + F.col("bin").cast(wide) * F.col("step").cast(wide)
        joined = state.where(going).join(chosen, "id", "left").withColumn("step", step)
        # a query without a kth score takes all there are
        none = F.col("bin").isNull()
        refined = joined.select(
            "id",
            "v",
            F.when(none, F.lit(LONGS.min)).otherwise(low.cast("long")).alias("low"),
            F.when(none, F.lit(LONGS.min)).otherwise(F.least(F.col("high").cast(wide), low + F.col("step") - 1).cast("long")).alias("high"),
            (F.col("above") + F.coalesce("higher", F.lit(0))).alias("above"),
            F.coalesce("n", F.lit(0)).alias("inside"),
        )
        # a table, as a checkpoint would hand on the constraints of its plan, which grow from round to round
        old = path
        state, path = written(refined.unionByName(state.where(~going)))
        forget(state.sparkSession, old)
    best = in_cells(cells(state.withColumn("high", F.lit(LONGS.max)), rows, *grid), width, reaching(k), KEPT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
