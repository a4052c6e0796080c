"""The rows nearest to each of many question vectors.

Rows and questions are dealt to groups by hash, so many that a group's numbers fit in some megabytes; each group of rows meets each group of
questions in one task, by matrix products of tiles, and keeps the best ``k`` of each question. What the groups of rows keep is merged in steps of MERGED
groups. A product only chooses: scores are summed anew for what it chose, each in the same order, so that equal vectors have equal scores wherever
they stand, and ties are those of a single question.

Defined results: rows without a vector are never found, questions without one have no rows; cosine is over the length of the shorter vector; a
vector that is empty, has no length, or holds a null or what is no finite number scores 0; ties go to the row that was inserted first; empty tables give an empty
table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.request import AssertionQuery, matching

#: Numbers of the rows, and of the questions, of a group.
ROW_NUMBERS = 4_000_000
QUESTION_NUMBERS = 500_000
#: Rows, and questions, of a tile; pairs of it that are scored at once, and groups that are merged at once.
TILE = 2048
PAIRS = 250_000
MERGED = 64
#: How far a product of tiles may be from the score.
NEARLY = 1e-9


def _matrices(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each length of vectors; what can't be compared is all zero."""
    ids = table["id"].to_numpy()
    vectors = table["vector"].combine_chunks()
    sizes = vectors.value_lengths().to_numpy()
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        matrix = values[starts[own][:, None] + np.arange(size)]
        matrix[~np.isfinite(matrix).all(1)] = 0
        out.append((ids[own], matrix))
    return out


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(1))
    return np.divide(matrix, lengths[:, None], out=np.zeros_like(matrix), where=lengths[:, None] > 0)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, pair by pair."""
    lengths = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.divide((a * b).sum(1), lengths, out=np.zeros(len(a)), where=lengths > 0)


def _first(question: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each question."""
    order = np.lexsort((row, -score, question))
    own = question[order]
    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    return order[np.arange(len(own)) - np.repeat(new, np.diff(np.r_[new, len(own)])) < k]


def _best(rows: pa.Table, questions: pa.Table, k: int, least: float, other: bool) -> pa.Table:
    out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
    held = _matrices(rows)
    tiles = [(asked[i : i + TILE], q[i : i + TILE]) for asked, q in _matrices(questions) for i in range(0, len(asked), TILE)]
    for asked, q in tiles:
        kept = out[0]
        for ids, matrix in held:
            size = min(q.shape[1], matrix.shape[1])
            near = _unit(q[:, :size])
            for begin in range(0, len(ids), TILE):
                tile, own = matrix[begin : begin + TILE, :size], ids[begin : begin + TILE]
                product = near @ _unit(tile).T
                if other:
                    product[asked[:, None] == own] = -np.inf
                bound = np.full(len(asked), least)
                if k < len(own):
                    bound = np.maximum(bound, np.partition(product, len(own) - k, axis=1)[:, len(own) - k])
                a, b = np.nonzero((product >= bound[:, None] - NEARLY) & (product > -np.inf))
                for i in range(0, len(a), PAIRS):  # equal scores can be many more than k
                    a_, b_ = a[i : i + PAIRS], b[i : i + PAIRS]
                    score = _scores(q[a_, :size], tile[b_])
                    use = score >= least
                    kept = [np.concatenate(x) for x in zip(kept, (asked[a_[use]], own[b_[use]], score[use]))]
                    some = _first(*kept, k)
                    kept = [x[some] for x in kept]
        out.append(kept)
    kept = [np.concatenate(x) for x in zip(*out)]
    return pa.table({"question_id": kept[0], "id": kept[1], "score": kept[2], "salt": pa.array([rows["salt"][0].as_py()] * len(kept[0]), pa.int32())})


def groups_of(numbers: int | None, most: int) -> int:
    return max(1, -(-(numbers or 0) // most))


def nearest(df: DataFrame, questions: DataFrame, q: AssertionQuery | None = None, *, k: int = 10, question: str = "question_id", vector: str = "vector", other: bool = False) -> DataFrame:
    """``question_id``, ``rank`` (from 1), ``ingest_seq``, ``score`` and ``distance`` of the best ``k`` rows within the query's conditions for each of
    ``questions`` (a long and a vector); with its ``min_score``, those that reach it. With ``other``, a question is not answered by the row of its
    own number."""
    q = q or AssertionQuery()
    if k < 1:
        raise ValueError("k must be 1 or more")
    rows = matching(df, q).select(F.col("ingest_seq").alias("id"), F.col(f"`{q.vector_column}`").alias("vector")).where("vector IS NOT NULL")
    asked = questions.select(F.col(question).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    sizes = [F.sum(F.size("vector") + 1).alias("n")]
    n_rows = groups_of(rows.agg(*sizes).first()[0], ROW_NUMBERS)
    n_asked = groups_of(asked.agg(*sizes).first()[0], QUESTION_NUMBERS)

    def dealt(own: DataFrame, mine: str, n: int, theirs: str, others: int) -> DataFrame:
        """In a group of its own, and once for each group of the other side."""
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return own.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(mine), every.alias(theirs))

    left = dealt(rows, "salt", n_rows, "cell", n_asked).groupBy("salt", "cell")
    right = dealt(asked, "cell", n_asked, "salt", n_rows).groupBy("salt", "cell")
    least = -np.inf if q.min_score is None else q.min_score

    def meet(rows: pa.Table, questions: pa.Table) -> pa.Table:
        if not len(rows) or not len(questions):
            return pa.table({"question_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "salt": pa.array([], pa.int32())})
        return _best(rows, questions, k, least, other)

    found = left.cogroup(right).applyInArrow(meet, "question_id long, id long, score double, salt int")
    while n_rows > 1:  # the last step is by question alone
        n_rows = -(-n_rows // MERGED)
        found = found.withColumn("salt", F.floor(F.col("salt") / MERGED).cast("int"))
        best = Window.partitionBy("question_id", "salt").orderBy(F.desc("score"), "id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("question_id", "rank", F.col("id").alias("ingest_seq"), "score", (1.0 - F.col("score")).alias("distance"))
