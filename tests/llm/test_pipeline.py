"""The pipeline against brute-force versions of its stages."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from test_decontamination import brute as leaks_of
from test_lines import every as lines_of
from test_similar import brute_links, groups_of, shingles

import corpus_pipeline
from quillstone.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    rows = [(r.doc_id, r.text) for r in scored if r.score >= 0.3]
    before = dict(rows)
    rows = sorted((k, t) for k, t in lines_of(rows).items() if t == before[k] or t.strip(" \t\n\x0b\x0c\r"))
    roots = groups_of(len(rows), brute_links([shingles(t) for _, t in rows]))
    rows = [row for n, (row, root) in enumerate(zip(rows, roots)) if n == root]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {w[0] for w in leaks_of(rows, items)}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = bpe.Encoder(file.read(), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for key, text in rows:
        if key not in leaked:
            ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
            want[key] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got} == want
    assert len(got) == len(want) < docs.count()


def test_stages_keep_the_columns_and_bear_odd_rows(spark):
    rows = [(1, "Some words of a text that is plain enough.", "en", "s", 5), (1, "Some words of a text that is plain enough.", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, given, SF)
            assert done.count() <= given.count()
            if name != "byte_bpe":
                assert done.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()} == {1, 2}
    assert corpus_pipeline.new_lines(spark, docs, SF).count() == 5


def test_stages_keep_columns_of_clashing_names_and_long_texts(spark):
    plain = " ".join(f"Some words of text number {i} are plain enough to read." for i in range(20_000))
    names = ["score", "n_lines", "n_removed", "bits", "who", "least", "text_hash", "held_out"]
    rows = [(n, text, "en", "s", len(text or ""), *(f"{c}{n}" for c in names)) for n, text in enumerate([plain, "A plain text of some words.\nWith two lines in it.", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == docs.columns, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in done.collect() for c in names), name
    got = {r.doc_id: r for r in corpus_pipeline.encoded(spark, docs, SF).collect()}
    assert got[0].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest() and got[2].n_tokens == got[3].n_tokens == 0
