"""Line deduplication against alignment with every earlier document that shares a line, and patience diff."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from quillstone.llm import lines

SPACE = " \t\n\x0b\x0c\r"
SF = "/root/testdata/sf0.001"


def longest_common(a, b):
    """Places in b of a longest common subsequence; a plain table, apart from the operator's own alignment."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.add(j)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(a, b):
    return {j for _, j in lines.patience(a, b)}


def every(rows, align=aligned, places=False):
    """Expected text of each document (or the places that go), aligned with all earlier ones."""
    documents = sorted({(k, t) for k, t in rows if k is not None and t is not None})
    split = [[x.strip(SPACE) for x in t.split("\n")] for _, t in documents]
    holders, want = defaultdict(list), {}
    for n, ((key, text), mine) in enumerate(zip(documents, split)):
        gone = set()
        for p in {p for x in set(mine) - {""} for p in holders[x]}:
            common = (set(mine) & set(split[p])) - {""}
            at = [j for j, x in enumerate(mine) if x in common]
            gone |= {at[j] for j in align([x for x in split[p] if x in common], [mine[j] for j in at])}
        want[key] = gone if places else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone)
        for x in set(mine) - {""}:
            holders[x].append(n)
    return want


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"line number {i} of the pool" for i in range(15)] + ["Yes.", "No more.", "", "  "]
    rows = [(None, "\n".join(pool)), (1, None), (2, ""), (3, "\n\n"), (5, "one two three four\none two three four")]
    for key in rng.sample(range(10, 99), 40):
        size = rng.randint(1, 12)
        mine = [rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()} line here" for _ in range(size)]
        rows += [(key, rng.choice(["\n", " \n", "\n\t"]).join(mine))] * rng.choice([1, 1, 2])
    return rows


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in lines.deduplicate(docs).collect() if r.doc_id is not None and r.text is not None}


A, B, C = "the first of three lines", "the second of three lines", "the third of three lines"
CASES = {
    "crossing": [(1, f"{A}\n{B}\n{C}"), (2, f"{C}\n{B}\n{A}"), (3, f"own words\n{C}\n{B}\n{A}")],
    "copy of a later one": [(1, f"{A}\n{B}"), (2, f"{B}\n{A}"), (3, f"{B}\n{A}")],
    "repeated": [(1, A), (2, f"{A}\n{B}\n{A}"), (3, f"{A}\nown words of mine\n{A}")],
    "later holder": [(1, f"{B}\n{A}"), (2, f"{B}\nx\n{A}"), (3, f"{A}\ny\n{B}"), (4, f"{A}\nz\n{B}")],
    "short lines": [(1, "a\nb\nc"), (2, "own\na\nb\nc"), (3, "漢字文"), (4, "漢字文"), (5, "Reouti anatha. 19")],
    "short copies": [(1, "short line\nanother one"), (2, "short line\nanother one")],
    "blocks": [(1, "a b c d e\nf\ng h i j k\nend of the first one"), (2, "start of the second one\na b c d e\nf\ng h i j k"), (3, "unlike all the others")],
}


@pytest.mark.parametrize("case", CASES)
def test_holders_other_than_the_earliest(spark, case):
    rows = CASES[case]
    assert got(spark, rows) == every(rows) != dict(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_corpus_against_every_partner(spark, seed):
    rows = corpus(seed)
    want, have = every(rows), got(spark, rows)
    assert have == want


def test_other_documents_do_not_matter(spark):
    """Lines in an order that some holder has and many others do not."""
    y, x = "a line of its own", "another of its own"
    few = [(7, f"{A}\n{x}\n{B}"), (10, f"{A}\n{y}\n{B}"), (8, x), (9, y)]
    more = few + [(n, f"{B}\n{A}") for n in range(1, 7)]
    most = more + [(n, f"{B}\nline {n} here\n{A}") for n in range(-300, 0)] + [(100 + n, f"{n} line\n{n} other line") for n in range(6)]
    for rows in (few, more, most):
        have = got(spark, rows)
        assert have == every(rows) and have[10] == ""


def test_recall_against_longest_common_subsequences(spark):
    """Independent of patience: of the lines that a best alignment with some earlier document matches, nearly all go, and no line goes
    that no earlier document has."""
    for rows in (corpus(3), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]):
        want = every(rows, longest_common, places=True)
        texts = {k: t for k, t in rows if k is not None and t is not None}
        have = got(spark, list(texts.items()))
        earlier: set[str] = set()
        found = total = 0
        for key in sorted(texts):
            mine = [x.strip(SPACE) for x in texts[key].split("\n")]
            left = [x.strip(SPACE) for x in have[key].split("\n")] if have[key] or len(mine) == 1 else []
            gone = len(mine) - len(left) if have[key] != texts[key] else 0
            assert gone <= sum(x in earlier for x in mine)
            found, total = found + min(gone, len(want[key])), total + len(want[key])
            earlier |= set(mine)
        assert total > 20 and found / total >= 0.95, (found, total)


def test_counts_and_odd_rows(spark):
    rows = [(1, "a\nb", "x"), (2, "b\n\nc", "y"), (2, "b\n\nc", "y"), (None, "a\nb", "z"), (3, None, "n"), (4, "\n".join(f"line {i}" for i in range(30_000)) + "\nb", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    done = lines.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed) for r in done), key=str) == sorted([(1, 2, 0), (2, 3, 1), (2, 3, 1), (None, 2, 0), (3, 0, 0), (4, 30_001, 1)], key=str)
    kept = lines.deduplicate(docs, names=("__a", "__b")).collect()
    assert sorted(r.n_removed for r in kept) == sorted(r[2] for r in rows)
    assert lines.deduplicate(docs.limit(0)).count() == 0


def test_patience_is_a_common_rising_order():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 9))] for _ in range(2))
        match = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in match)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(match, match[1:]))
    assert lines.patience([1, 2, 3, 4], [1, 2, 3, 4]) == [(i, i) for i in range(4)]
    assert lines.patience([1, 2, 9, 3], [7, 1, 2, 8, 3]) == [(0, 1), (1, 2), (3, 4)]
    assert lines.patience([5, 1, 2, 3], [1, 2, 3, 5]) == [(1, 0), (2, 1), (3, 2)]


def test_the_pipeline_stage_tries_every_partner(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k: t for k, t in every(texts.items()).items() if t == texts[k] or t.strip(SPACE)}
    assert {r.doc_id: r.text for r in corpus_pipeline.new_lines(spark, docs, SF).collect()} == want
