"""Columns against the Python rules they stand for, and records, embedders and requests."""

import io
import json
import math
import sys
import unicodedata
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from quillstone.functions import terms, text, vectors
from quillstone.operators.request import AssertionQuery
from quillstone.sources import embedders
from quillstone.sources.records import Assertion


def test_white_space_is_that_of_str_strip():
    assert set(terms.WHITE_SPACE) == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}


def test_canonical_is_strip_and_lower(spark):
    points = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.category(c) != "Cn"]
    words = [f"{c}A{c} b{c}" for c in points] + ["", " ", "ΟΔΟΣ"]
    table = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    wrong = [r for r in table.select("w", terms.canonical(F.col("w")).alias("c")).collect() if r.c != r.w.strip().lower()]
    assert wrong == []


def test_canonical_text(spark):
    cases = [
        {},
        {"subject_type": " Person ", "object_type": "", "evidence_quote": "said\nso", "original_context": "c" * 401},
        {"subject_type": 3, "object_type": ["x"], "evidence_quote": None, "original_context": "𝒳" * 400},
        {"original_context": "  " + "𝒳" * 401, "object_type": " t ", "nan": float("nan")},
    ]

    def want(attributes):
        lines = ["s p O"]
        for name, label in (("subject_type", "subject_type"), ("object_type", "object_type"), ("evidence_quote", "evidence"), ("original_context", "context")):
            value = attributes.get(name)
            if isinstance(value, str) and value.strip():
                value = value.strip()
                lines.append(f"{label}: " + (value[:400] + "…" if name == "original_context" and len(value) > 400 else value))
        return "\n".join(lines)

    table = spark.createDataFrame([(i, json.dumps(c, ensure_ascii=False)) for i, c in enumerate(cases)] + [(4, "[]"), (5, None), (6, "{x")], "i int, a string")
    got = {r.i: r.t for r in table.select("i", text.canonical_text(F.lit("s"), F.lit("p"), F.lit("O"), terms.json_map(F.col("a"))).alias("t")).collect()}
    assert got == {i: want(c) for i, c in enumerate([*cases, {}, {}, {}])}


def test_cosine(spark):
    pairs = [([], [1.0]), ([1.0], []), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0, 3.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0]), ([3.0, 4.0], [4.0, 3.0])]

    def want(a, b):
        a, b = a[: len(b)], b[: len(a)]
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    for r in table.select("i", vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == pytest.approx(want(*pairs[r.i]))


def test_records():
    with pytest.raises(TypeError):
        Assertion.from_dict([])
    for wrong in ({}, {"subject": "s", "predicate": " ", "object": "o"}, {"subject": 1, "predicate": "p", "object": "o"}):
        with pytest.raises(ValueError, match=r"subject|predicate"):
            Assertion.from_dict(wrong)
    given = {"subject": " S ", "predicate": "P", "object": "O", "scope": 3, "owner_id": " ", "observed_at": 5, "valid_from": " 2026 ", "confidence": "0.5", "provenance": [], "attributes": {"literal": 1}}
    a = Assertion.from_dict(given)
    assert (a.subject, a.object, a.scope, a.owner_id, a.valid_from, a.confidence, a.provenance) == ("s", "O", "run", None, "2026", 0.5, {})
    assert len(a.observed_at) == 32 and a.observed_at.endswith("+00:00")
    assert Assertion.from_dict(given | {"confidence": "high"}).confidence is None
    assert a.to_dict().keys() == {"subject", "predicate", "object", "scope", "observed_at", "valid_from", "confidence", "provenance", "attributes"}
    assert a.to_dict()["attributes"] is not a.attributes
    assert Assertion.from_dict(a.to_dict()) == a
    assert Assertion(None, 0, "").subject == Assertion("", "", False).object == ""


def test_requests():
    q = AssertionQuery(subject=" A ", scope="", order="", vector_column=" ", min_score=float("nan"), limit="7", query_text=" ")
    assert (q.subject, q.scope, q.order, q.vector_column, q.min_score, q.rows, q.semantic) == ("a", None, "desc", "vector", None, 100, False)
    assert AssertionQuery(min_score="0.5").min_score == 0.5
    assert AssertionQuery(limit=0).rows is None


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (b'{"data":[{"index":1,"embedding":[2]},{"index":0,"embedding":[1]}]}', [[1.0], [2.0]]),
        (b'{"data":[{"embedding":[2]},{"index":"x","embedding":[1]}]}', [[2.0], [1.0]]),
        (b"no json", "JSON"),
        (b"[]", "data"),
        (b'{"data":3}', "list"),
        (b'{"data":[{"embedding":"x"}]}', "list"),
        (HTTPError("u", 401, "Unauthorized", {}, io.BytesIO()), "401.*token"),
        (HTTPError("u", 500, "Broken", {}, io.BytesIO()), "500"),
        (HTTPError("u", 400, "Bad", {}, io.BytesIO(b" model is missing\n")), "400 Bad: model is missing$"),
        (b'{"data":[{"embedding":["x"]}]}', "numbers"),
        (URLError("refused"), "refused"),
    ],
)
def test_http_embedder(monkeypatch, answer, want):
    seen = []

    def urlopen(request, timeout):
        seen.append((request.full_url, json.loads(request.data), request.headers.get("Authorization"), timeout))
        if isinstance(answer, Exception):
            raise answer
        return io.BytesIO(answer)

    monkeypatch.setattr(embedders, "urlopen", urlopen)
    embedder = embedders.HttpEmbedder(base_url="http://host/ ", auth_token=" t ", endpoint_path="v1")
    if isinstance(want, str):
        with pytest.raises(RuntimeError, match=want):
            embedder.embed_texts(["a"])
    else:
        assert embedder.embed_texts(["a", None]) == want
        assert seen == [("http://host/v1", {"input": ["a", ""]}, "Bearer t", 30.0)]
    with pytest.raises(ValueError, match="base_url"):
        embedders.HttpEmbedder(base_url=" ")
