"""Append-only stores of assertions: one engine, three profiles.

``volatile`` keeps its rows in the session, ``structured`` and ``vector`` in a dataset of Parquet folders partitioned by scope, one for each
append (see ``batches``), which readers see as a whole or not at all. ``structured`` holds no vectors and refuses semantic queries.
Lists, tables and batches of a stream are appended by the same writer, so they count on from each other. Writers of one process take turns; otherwise
a store has one writer at a time. ``compact`` merges the folders that many appends leave.
"""

from __future__ import annotations

import os
import re
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.normalize import normalized
from quillstone.functions.terms import optional
from quillstone.operators.request import AssertionQuery, by_score, in_time_order, matching
from quillstone.plans import postings, vector_index
from quillstone.plans.batches import HIDDEN, Batch, counting, marks, publish, sweep, written_batches
from quillstone.plans.clustering import bloom_options, with_place
from quillstone.plans.extensions import with_keywords, words_of
from quillstone.plans.moments import holding_at
from quillstone.plans.nearest import nearest
from quillstone.plans.shared import forget, names_in, renamed, written
from quillstone.sources.embedded_once import VectorTable
from quillstone.sources.embedders import TextEmbedder, embedded
from quillstone.sources.records import Assertion
from quillstone.sources.schema import GIVEN, STORED, STORED_COLUMNS


@dataclass(frozen=True)
class Capabilities:
    """What a profile can do."""

    persistence: bool
    structured: bool
    semantic: bool
    vector: bool
    keyword: bool
    graph_walk: str
    deterministic_export: bool


PROFILES = {
    "volatile": Capabilities(False, True, True, True, True, "generic", True),
    "structured": Capabilities(True, True, False, False, True, "generic", True),
    "vector": Capabilities(True, True, True, True, True, "generic", True),
}

#: Appends that a volatile store holds as frames of their own; beyond them they are put together.
HELD = 32
#: How rows are sorted within files, so that statistics of row groups let the scan skip what other terms and times hold.
ORDER = ("scope", "subject", "predicate", "observed_at")
#: Columns that are looked up without those that rows are sorted by; each row group has a Bloom filter of them.
LOOKED_UP = ("object_key", "owner_id")
#: What compacted rows are near each other by.
CLUSTERED = ("subject", "object_key", "observed_at")
FILE_ROWS = 1_000_000
#: How the folder of an index begins; the number of the first row that it lacks follows.
INDEX = "_vectors-"
#: The postings of a folder's texts; rows that are found by number by a condition, and numbers that are broadcast, at most, both counted first.
WORDS = "_words"
FEW = 1_000
BROADCAST = 1_000_000
_TURNS: dict[str, threading.RLock] = defaultdict(threading.RLock)


def id_of(nonce: str, number: Column) -> Column:
    """An assertion's id from its writer's nonce and its number: the same whenever it is computed."""
    digits = F.md5(F.concat(F.lit(nonce), number.cast("string")).cast("binary"))
    return F.concat_ws("-", *(F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


class AssertionStore:
    """``add``, ``query`` and ``close`` for lists of assertions; ``add_frame``, ``query_frame`` and ``frame`` for tables."""

    def __init__(
        self, spark: SparkSession, path: str | None = None, *, profile: str | None = None, embedder: TextEmbedder | None = None, vector_column: str = "vector", name: str = "assertions", keep_words: bool = False
    ) -> None:
        """``keep_words``: each append also writes the postings of its texts (see ``postings``)."""
        self.profile = profile or ("vector" if path else "volatile")
        if self.profile not in PROFILES:
            raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
        self.capabilities = PROFILES[self.profile]
        if self.capabilities.persistence != bool(path):
            raise ValueError(f"profile {self.profile} {'needs a' if self.capabilities.persistence else 'takes no'} path")
        for given in (name, vector_column or "vector"):
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", given):
                raise ValueError(f"{given!r} is not a safe name")
        self.spark, self.embedder, self.keep_words = spark, embedder, keep_words
        self.vector_column = vector_column or "vector"
        self.path = f"{os.path.expanduser(path).rstrip('/')}/{name}" if path else None
        self.columns = [self.vector_column if c == "vector" else c for c in STORED_COLUMNS]
        self.schema = STORED.replace("vector array", f"`{self.vector_column}` array")
        self.held: list[DataFrame] = []
        self.paths: list[str] = []
        self.next = 0  # of a volatile store

    def batches(self) -> list[Batch]:
        """The folders whose rows count; none of a dataset that has not been written yet."""
        return counting(written_batches(self.spark, self.path))

    def frame(self) -> DataFrame:
        """All rows; none of a dataset that has not been written yet."""
        if self.path is None:
            out = self.spark.createDataFrame([], self.schema).select(*self.columns)
            for rows in self.held:
                out = out.unionByName(rows)
            return out
        return self._read(self.batches())

    def _read(self, batches: list[Batch]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        return self._rows_at(*(b.name for b in batches))

    def _rows_at(self, *folders: str) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*(f"{self.path}/{f}" for f in folders)).select(*self.columns)

    def _begin(self) -> int:
        return self.next if self.path is None else max((b.end for b in self.batches()), default=0)

    def _hold(self, rows: DataFrame, path: str | None = None) -> None:
        """Rows of a volatile store: a list of the driver's, or a table in the shared folder, so the loss of an executor changes nothing."""
        self.held.append(rows)
        if path:
            self.paths.append(path)
        if len(self.held) > HELD:
            together, path = written(self.frame())
            self.held = [together]
            self.paths.append(path)  # the others stay until the store is closed, as frames that were given out read them

    def _append(self, given: DataFrame, first: int, rows: int, seen: dict[str, int] | None = None, path: str | None = None) -> None:
        """Rows of layout GIVEN with ``assertion_id`` and ``ingest_seq`` in [first, first + rows)."""
        stored = normalized(given).withColumnRenamed("vector", self.vector_column).select(*self.columns)
        if self.path is None:
            self._hold(stored, path)
            self.next = first + rows
        else:
            self._write(stored.sortWithinPartitions(*ORDER), Batch(first, first + rows, 0), seen or {})

    def _write(self, stored: DataFrame, batch: Batch, seen: dict[str, int], words: bool = False, **more: str) -> None:
        pending = f"{HIDDEN}{uuid.uuid4()}"
        options = bloom_options(LOOKED_UP, min(batch.end - batch.first, FILE_ROWS))
        stored.write.options(**options, **more).partitionBy("scope").parquet(f"{self.path}/{pending}")
        if self.keep_words or words:
            postings.write(self._rows_at(pending), f"{self.path}/{pending}/{WORDS}")
        publish(self.spark, self.path, pending, batch, seen)

    def add(self, assertions: Iterable[Assertion]) -> list[str]:
        """The new rows' ids, in order. All texts are embedded before anything is written."""
        given = list(assertions)
        if not given:
            return []
        vectors: list = [None] * len(given)
        if self.embedder is not None and self.capabilities.vector:
            texts = [r["text"] for r in normalized(self.spark.createDataFrame([a.given() for a in given], GIVEN)).select("text").collect()]
            found = [[float(x) for x in v] for v in self.embedder.embed_texts(texts)]
            vectors = [*found[: len(given)], *vectors[len(found) :]]
        ids = [str(uuid.uuid4()) for _ in given]
        with _TURNS[self.path or str(id(self))]:
            first = self._begin()
            rows = [a.given(v) | {"assertion_id": i, "ingest_seq": first + n} for n, (a, v, i) in enumerate(zip(given, vectors, ids))]
            self._append(self.spark.createDataFrame(rows, GIVEN + ", assertion_id string, ingest_seq bigint"), first, len(rows))
        return ids

    def add_frame(self, given: DataFrame, make_embedder: Callable[[], TextEmbedder] | None = None, stream: tuple[str, int] | None = None, vectors: VectorTable | None = None) -> int:
        """Adds a table with some of the columns of layout GIVEN, in the order of its partitions; returns the number of rows. With
        ``make_embedder`` the executors embed the texts of rows without a vector; with ``vectors`` too, only texts that this table lacks. ``stream`` names a stream and the number of its batch, which is
        left aside if the dataset has it already."""
        kinds = {f.split()[0]: f.split()[1] for f in GIVEN.split(", ")}
        missing = {"subject", "predicate", "object"} - set(given.columns)
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        if stream and self.path is None:
            raise ValueError("a stream needs a store with a path")
        full = given.select(*((F.col(c) if c in given.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
        # one time for the whole table, which stays the same however often the rows are computed
        full = full.withColumn("observed_at", F.coalesce(optional(F.col("observed_at")), F.lit(datetime.now(timezone.utc).isoformat(timespec="microseconds"))))
        if make_embedder is not None and self.capabilities.vector:
            # the text is that of the normalized row, which is normalized again when it is written, to itself
            whole = normalized(full)
            if vectors is None:
                full = whole.withColumn("vector", F.coalesce("vector", embedded(F.col("text"), make_embedder))).select(*full.columns)
            else:
                vectors.learn(whole.where("vector IS NULL").select("text"), make_embedder)
                full = vectors.joined(whole, "text").select(*full.columns)
        placed = full.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
        with _TURNS[self.path or str(id(self))]:
            if stream and marks(self.spark, self.path, self.batches()).get(stream[0], -1) >= stream[1]:
                return 0
            # the source is read once, so what it gives is what is counted, numbered and stored
            placed, path = written(placed)
            # a number for each partition
            sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
            first, begins, total = self._begin(), [], 0
            for part in sorted(sizes):
                begins.append((part, first + total))
                total += sizes[part]
            if total:
                starts = self.spark.createDataFrame(begins, "__part int, __begin bigint")
                rows = placed.join(F.broadcast(starts), "__part").withColumn("ingest_seq", F.col("__begin") + F.col("__place"))
                rows = rows.withColumn("assertion_id", id_of(str(uuid.uuid4()), F.col("ingest_seq")))
                self._append(rows.drop("__part", "__place", "__begin"), first, total, dict([stream]) if stream else None, path)
            if self.path or not total:
                forget(self.spark, path)
        return total

    def _vector_of(self, q: AssertionQuery) -> list[float] | None:
        if q.semantic and not self.capabilities.semantic:
            raise ValueError("query_text and query_vector need a store with vectors; this one is structured only")
        vector = list(q.query_vector) if q.query_vector else None
        if vector is None and q.query_text:
            if self.embedder is None:
                raise ValueError("query_text needs an embedder; there is no fallback to key words")
            vector = self.embedder.embed_texts([q.query_text])[0]
        return vector

    def query_frame(self, q: AssertionQuery) -> DataFrame:
        """The answer as a plan. A semantic query that the store can't answer is refused here, before any job."""
        vector = self._vector_of(q)
        found = matching(self.frame(), q)
        return in_time_order(found, q) if vector is None else by_score(found, q, vector)

    def keyword_frame(self, words: str, q: AssertionQuery | None = None) -> DataFrame:
        """Rows within the query's conditions whose text has every word, in time order. Asked for by itself; no query falls back to it. Folders that have
        postings are asked by these, the texts of others are looked through."""
        q = q or AssertionQuery()
        if self.path is None:
            return in_time_order(with_keywords(matching(self.frame(), q), words), q)
        batches = self.batches()
        told = [b for b in batches if WORDS in names_in(self.spark, f"{self.path}/{b.name}")]
        found = with_keywords(matching(self._read([b for b in batches if b not in told]), q), words)
        if told:
            index = self.spark.read.parquet(*(f"{self.path}/{b.name}/{WORDS}" for b in told))
            wanted = self.spark.range(1).select(F.explode(words_of(F.lit(words)))).collect()
            numbers, path = written(postings.having_all(index, [r[0] for r in wanted]).select(F.explode("numbers").alias("ingest_seq")))
            n = numbers.count()
            if n <= FEW:  # a condition that reaches the scan
                some = [r[0] for r in numbers.collect()]
                rows = self._read([b for b in told if any(b.first <= i < b.end for i in some)]).where(F.col("ingest_seq").isin(some))
                forget(self.spark, path)
            else:
                rows = self._read(told).join(F.broadcast(numbers) if n <= BROADCAST else numbers, "ingest_seq", "left_semi")
            found = found.unionByName(matching(rows, q))
        return in_time_order(found, q)

    def index_words(self) -> None:
        """Writes the postings of the folders that have none; appends of a store that keeps words bring theirs."""
        for b in self.batches():
            folder = f"{self.path}/{b.name}"
            if WORDS not in names_in(self.spark, folder):
                pending = f"{folder}/{HIDDEN}{uuid.uuid4()}"
                postings.write(self._read([b]), pending)
                renamed(self.spark, pending, f"{folder}/{WORDS}")

    def compact(self, file_rows: int = FILE_ROWS, cluster: Sequence[str] | None = CLUSTERED, group_bytes: int | None = None) -> None:
        """Rewrites a dataset in files of about ``file_rows`` rows. Within a scope rows lie along a Z-order curve through the columns in ``cluster``, so
        that a condition on any of them reads few row groups; without, they are sorted by terms and time. ``group_bytes`` is the size of
        row groups. The new folder counts, and the old ones don't, from one rename on; wherever this is stopped no row is lost or twice, and the
        next one clears away what was left. Readers that began before have to be done when the old folders go."""
        if self.path is None:
            raise ValueError("a volatile store has no files")
        with _TURNS[self.path]:
            batches = self.batches()
            if rows := sum(b.end - b.first for b in batches):
                frame, order = self._read(batches), ORDER
                if cluster:
                    frame, order = with_place(frame, cluster, "__place"), ("scope", "__place", *cluster)
                frame = frame.repartitionByRange(-(-rows // file_rows), *order, "ingest_seq").sortWithinPartitions(*order)
                whole = Batch(batches[0].first, batches[-1].end, 1 + max(b.generation for b in batches))
                more = {"parquet.block.size": str(group_bytes)} if group_bytes else {}
                told = any(WORDS in names_in(self.spark, f"{self.path}/{b.name}") for b in batches)
                self._write(frame.select(*self.columns), whole, marks(self.spark, self.path, batches), told, **more)
            sweep(self.spark, self.path)

    def nearest_frame(self, questions: DataFrame, q: AssertionQuery | None = None, k: int = 10, **given: object) -> DataFrame:
        """The rows nearest to each of many questions (see ``nearest``)."""
        if not self.capabilities.vector:
            raise ValueError("nearest rows need a store with vectors; this one is structured only")
        return nearest(self.frame(), questions, q or AssertionQuery(vector_column=self.vector_column), k=k, **given)

    def index_vectors(self, lists: int | None = None) -> None:
        """Writes an inverted file over the vectors (see ``vector_index``); what is added later is read beside it until the next one is written."""
        if self.path is None or not self.capabilities.vector:
            raise ValueError("an index needs a store with a path and vectors")
        with _TURNS[self.path]:
            end, pending = self._begin(), f"{HIDDEN}{uuid.uuid4()}"
            vector_index.build(self.frame(), f"{self.path}/{pending}", self.vector_column, lists)
            old = [n for n in names_in(self.spark, self.path) if n.startswith(INDEX)]
            if f"{INDEX}{end:018d}" in old:
                forget(self.spark, f"{self.path}/{pending}")
                return
            renamed(self.spark, f"{self.path}/{pending}", f"{self.path}/{INDEX}{end:018d}")
            for name in old:
                forget(self.spark, f"{self.path}/{name}")

    def indexed(self, q: AssertionQuery) -> vector_index.Found:
        """What ``query_frame`` answers to a semantic query, by the newest index; and how many of its lists were read."""
        names = [n for n in names_in(self.spark, self.path) if n.startswith(INDEX)] if self.path else []
        vector = self._vector_of(q)
        if not names or vector is None:
            raise ValueError("a semantic query and an index are needed")
        later = self._read([b for b in self.batches() if b.end > int(names[-1].removeprefix(INDEX))]).where(F.col("ingest_seq") >= int(names[-1].removeprefix(INDEX)))
        return vector_index.search(self.spark, f"{self.path}/{names[-1]}", q, vector, later)

    def holding_frame(self, instants: DataFrame, q: AssertionQuery | None = None, at: str = "at", on: Sequence[str] = ("subject",)) -> DataFrame:
        """The rows that held at each of many instants (see ``moments``)."""
        return holding_at(self.frame(), instants, at, on, q)

    def query(self, q: AssertionQuery) -> list[Assertion]:
        return [Assertion.of_row(r) for r in self.query_frame(q).collect()]

    def close(self) -> None:
        """Lets go of what the session holds, and of the rows of a volatile store; may be called again."""
        self.held = []
        while self.paths:
            forget(self.spark, self.paths.pop())
