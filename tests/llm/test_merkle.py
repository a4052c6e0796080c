"""The manifest against trees that are built in one place."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quillstone.llm import merkle

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def whole_tree(nodes):
    """The root, and for each node its (side, sibling) from the bottom up."""
    proofs, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            for j, own in enumerate(at[i : i + 2]):
                for x in own:
                    proofs[x].append(("alone", None) if len(pair) == 1 else (("right", pair[1]), ("left", pair[0]))[j])
            up.append(H(*pair))
            below.append(sum(at[i : i + 2], []))
        nodes, at = up, below
    return nodes[0], proofs


def brute(rows, altered):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    heads, parts = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        nodes = sorted(groups[lang], key=lambda x: x[:3])
        subroot, proofs = whole_tree([x[2] for x in nodes])
        heads.append(subroot)
        parts.append((subroot, [(x[3], x[2], p) for x, p in zip(nodes, proofs)]))
    root, above = whole_tree(heads)
    out = []
    for (subroot, members), up in zip(parts, above):
        for row, own, proof in members:
            node = leaf((*row[:3], None if row[3] is None else row[3] + 1, row[4])) if altered(row) else own
            for side, sibling in proof + up:
                node = H(node) if side == "alone" else H(sibling, node) if side == "left" else H(node, sibling)
            out.append((row[0], own, subroot, root, H(*(s for side, s in proof + up if side != "alone")), node, node == root))
    return sorted(out, key=repr)


def sevenths(row):
    return row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0


def answer(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS g", "2 AS place", "'x' AS digest", "0 AS n")
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted(map(tuple, merkle.digest(merkle.manifest(docs, altered=altered, claims={"n_chars": F.col("n_chars") + 1})).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 3}, {"de": 1, "en": 7, "fr": 8, "é": 9, "": 5}, {"x": 4097, "y": 4096, "z": 3}, {"x": 9000}])
def test_equals_one_tree(spark, sizes):
    rows = [(i * 3 % 20_011, f"s{i % 4}" if i % 5 else None, lang, i if i % 6 else None, f"text ü {i}" if i % 9 else None) for lang, n in sizes.items() for i in range(n)]
    assert answer(spark, rows) == brute(rows, sevenths)


def test_equal_and_null_keys(spark):
    rows = [(None, "a", "en", 1, "x"), (None, "a", "en", 1, "x"), (7, "a", "en", 2, "y"), (7, "a", "en", 2, "y"), (7, None, "en", None, ""), (7, None, "en", None, None), (3, "", None, 0, "z" * 2_000_000)]
    assert answer(spark, rows) == brute(rows, sevenths)


def test_groups_are_ordered_by_bytes(spark):
    rows = [(i, "s", lang, 1, "t") for i, lang in enumerate(["z", "Z", "é", "", None, "zz", "\U0001f600", "￿"])]
    assert answer(spark, rows) == brute(rows, sevenths)


def test_what_is_altered_is_found(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'s' AS source", "CAST(id % 3 AS STRING) AS lang", "id AS n_chars", "CAST(id AS STRING) AS text")
    done = merkle.manifest(docs, altered=F.col("doc_id") == 123, claims={"text": F.lit("another")})
    assert [r.doc_id for r in done.where(merkle.folded(F.col("claimed"), F.col("proof")) != F.col("root")).collect()] == [123]
    assert done.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 500
    assert done.select("root").distinct().count() == 1 and done.select("lang", "subroot").distinct().count() == 3


def test_no_rows(spark):
    assert answer(spark, []) == []
