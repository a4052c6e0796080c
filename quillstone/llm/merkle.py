"""A Merkle manifest of a dataset: one tree over the rows of each group, one over the groups.

A leaf is the digest of a row's fields. The leaves of a group, in rising order of the key, are paired level by level until one node is left, its
subroot; a node without a partner is hashed alone. The subroots, ordered by group (null first), are paired in the same way into the root.

The trees are built by aligned blocks of BLOCK nodes. In a task a block is walked in postorder: a subtree returns its digest, and
as the recursion unwinds, each of two siblings is appended to the proofs of all leaves that the other one contains. The digests of blocks are
the nodes of another distributed traversal, and so on until each group has one. Then the blocks are walked again
from the top, now for the proofs: what a block's own root lacks is handed down with it, so the proof of a row is made where it is returned, and is never
shuffled. Places in a group come from counts of sorted partitions, so no task sees a whole group, however large.

Defined results: keys that are equal or null (first) are ordered by leaf, rows equal in all fields are leaves of their own; a null field is
told apart from an empty one; very long texts are hashed in the JVM and go no further; an empty table gives an empty manifest; further
columns, whatever their names, are left aside.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.shared import forget, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block, and the nodes that it has at most.
LEVELS = 12
BLOCK = 1 << LEVELS
PROOF = "array<struct<side:string,digest:string>>"
_STEP = pa.struct([("side", pa.string()), ("digest", pa.string())])


def leaf_of(fields: Sequence[Column]) -> Column:
    """Lowercase hex of the digest of ``-`` for each null, and of byte count, colon and value for each other field."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def joined(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels until one node of a group of n is left, LEVELS at most."""
    return min((n - 1).bit_length(), LEVELS)


def climb(nodes: list[str], levels: int, proofs: list[list] | None = None) -> str:
    """The digest of the subtree over ``nodes``, 2**levels of them at most; with ``proofs``, a list for each node, the siblings on its way are appended."""

    def visit(begin: int, end: int, level: int) -> str:
        if level == 0:
            return nodes[begin]
        middle = begin + (1 << (level - 1))
        left = visit(begin, min(middle, end), level - 1)
        if middle >= end:
            if proofs is not None:
                for leaf in range(begin, end):
                    proofs[leaf].append(("alone", None))
            return joined(left)
        right = visit(middle, end, level - 1)
        if proofs is not None:
            for leaf in range(begin, middle):
                proofs[leaf].append(("right", right))
            for leaf in range(middle, end):
                proofs[leaf].append(("left", left))
        return joined(left, right)

    return visit(0, len(nodes), levels)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (a table that reads the same each time) with ``place`` in its group ``g`` from 0 and the group's size ``n``, written. A large
    group is many ranges."""
    ranged = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    spot = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged, path = written(ranged.select("*", F.spark_partition_id().alias("part"), spot.alias("spot")))
    # a row for each group in each partition
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("count"), F.min("spot").alias("first"))
    up_to = F.sum("count").over(Window.partitionBy("g").orderBy("part"))
    counts = counts.select("g", "part", (up_to - F.col("count") - F.col("first")).alias("shift"), F.sum("count").over(Window.partitionBy("g")).alias("n"))
    done, _ = written(ranged.join(counts, ["g", "part"]).withColumn("place", F.col("spot") + F.col("shift")).drop("part", "spot", "shift"))
    forget(rows.sparkSession, path)
    return done


def _summit(block: pa.Table) -> pa.Table:
    block = block.sort_by("place")
    nodes, n = block["digest"].to_pylist(), block["n"][0].as_py()
    up = {"g": block["g"].slice(0, 1), "place": pa.array([block["place"][0].as_py() >> LEVELS]), "n": pa.array([-(-n // BLOCK)]), "digest": pa.array([climb(nodes, levels_of(n))])}
    return pa.table(up)


def _proofs(block: pa.Table, above: pa.Table) -> pa.Table:
    block = block.sort_by("place")
    nodes, n = block["digest"].to_pylist(), block["n"][0].as_py()
    proofs: list[list] = [[] for _ in nodes]
    climb(nodes, levels_of(n), proofs)
    rest = [(s["side"], s["digest"]) for s in above["proof"][0].as_py()]
    block = block.drop_columns(["n", "block"]).append_column("proof", pa.array([p + rest for p in proofs], pa.list_(_STEP)))
    for name in ("subroot", "root"):
        block = block.append_column(name, pa.array([above[name][0].as_py()] * len(nodes), pa.string()))
    return block


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each traversal (``g``, ``place``, ``n``, ``digest``), from ``nodes`` up, and those of the last: one for each group."""
    levels, largest = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1 or len(levels) == 1:
        blocks = levels[-1].select("g", "place", "n", "digest", F.shiftright("place", LEVELS).alias("block")).groupBy("g", "block")
        levels.append(written(blocks.applyInArrow(_summit, "g string, place long, n long, digest string"))[0])
        largest = -(-largest // BLOCK)
    return levels[:-1], levels[-1]


def handed_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The bottom nodes of a tree with the ``proof``, ``subroot`` and ``root`` that ``tops`` (with ``g`` and ``place``) hand down to them."""
    for nodes in reversed(levels):
        schema = ", ".join(f"{c} {t}" for c, t in nodes.drop("n").dtypes) + f", proof {PROOF}, subroot string, root string"
        below = nodes.withColumn("block", F.shiftright("place", LEVELS)).groupBy("g", "block")
        above = tops.select("g", F.col("place").alias("block"), "proof", "subroot", "root").groupBy("g", "block")
        tops = below.cogroup(above).applyInArrow(_proofs, schema)
    return tops


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", altered: Column | None = None, claims: dict[str, Column] | None = None
) -> DataFrame:
    """``key``, ``group``, ``leaf``, ``claimed``, ``subroot``, ``root`` and ``proof``, the siblings from the leaf up: (side, digest), where side is ``left``,
    ``right`` or ``alone``, that of a node without a sibling. ``claimed`` is the leaf; for rows that are ``altered``, that of the row with the fields
    in ``claims`` as said there, which a holder of the row would show."""
    spark = docs.sparkSession
    claimed = F.when(altered, leaf_of([(claims or {}).get(f, F.col(f)) for f in fields])) if altered is not None else F.lit(None).cast("string")
    rows, path = written(
        docs.select(
            F.col(key).cast("long").alias("k"),
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("g"),  # a null group is first
            leaf_of([F.col(f) for f in fields]).alias("digest"),
            claimed.alias("claimed"),
            F.monotonically_increasing_id().alias("salt"),  # deals equal rows to several ranges
        )
    )
    leaves = placed(rows, "k", "digest", "salt").drop("salt")
    forget(spark, path)
    below, subroots = tree(leaves)
    # the groups are the leaves of one more tree
    heads = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "name")
    above, top = tree(heads)
    top = top.select("g", "place", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = handed_down(above, top).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("place"), "proof", F.col("digest").alias("subroot"), "root")
    found = handed_down(below, tops)
    name = F.when(F.col("g") != "-", F.substring("g", 2, (1 << 31) - 1))
    return found.select(F.col("k").alias(key), name.alias(group), F.col("digest").alias("leaf"), F.coalesce("claimed", "digest").alias("claimed"), "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""

    def step(node: Column, s: Column) -> Column:
        pair = F.when(s["side"] == "left", F.concat(s["digest"], node)).when(s["side"] == "right", F.concat(node, s["digest"])).otherwise(node)
        return F.sha2(pair.cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns of ``manifest``: the proof's digest, and what the claimed leaf folds to."""
    siblings = F.array_join(F.transform(F.filter("proof", lambda s: s["side"] != "alone"), lambda s: s["digest"]), "")
    done = found.withColumns({"proof_sha256": F.sha2(siblings.cast("binary"), 256), "folded_root": folded(F.col("claimed"), F.col("proof"))})
    return done.select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
