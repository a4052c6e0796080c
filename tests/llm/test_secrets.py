"""The secret scan against plain regular expressions over every text."""

import hashlib
import itertools
import random
import re
import time

from quillstone.llm import secrets

KINDS = (
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 0),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 0),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
)


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found)


def written(spans):
    return ",".join(f"{KINDS[k][0]}:{b}:{e}" for b, k, e in spans)


def texts():
    rng = random.Random(9)
    pieces = ["password", "Passwd", "SECRET", "toKEN", "api_key", "APIKEY", "apı_key", '"', "'", " ", "  ", ":", "=", "abcdef", "hunter2", "x", "é😀", "\n", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", "ghp_", "xoxb-", "-----BEGIN RSA PRIVATE KEY-----", "A" * 40, "-", "ſecret=abcdefgh", "token=secret=abc", "secret=token: abcdefgh"]
    fixed = [None, "", "token=abcdef", "token=abcde", "secret=token: abcdefgh", "password = 'abc def'", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 24 + "g" + "f" * 23, "AKIAAKIA" + "B" * 12, "x" * 100_000 + " api_key: " + "k" * 50_000, "token\t=abcdefgh"]
    return fixed + ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(400)]


def test_spans_match_the_regular_expressions(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "token=abcdef", "c"), (2, "token=abcdef", "c"), (2, "token=abcdef", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    got = secrets.digest(secrets.scan(docs)).collect()

    def want(key, text):
        spans = brute(text)
        base = [s for s in spans if s[1] < 3]
        return (key, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans))

    expected = [want(k, t) for k, t, _ in rows]
    assert sum(any(w[1:4]) for w in expected) > 100
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_every_match_satisfies_its_trigram_query():
    for rule in secrets.BASE_RULES + secrets.MORE_RULES:
        pattern, query = re.compile(rule.pattern), rule.trigram_query()
        for text in filter(None, texts()):
            for m in pattern.finditer(text):
                folded = m.group().lower()
                assert not query or any(all(t in folded for t in conjunction) for conjunction in query)


def test_candidates_are_the_rows_that_satisfy_a_conjunction(spark):
    rules = tuple(r for r in secrets.BASE_RULES + secrets.MORE_RULES if r.trigram_query())
    rows = [(i, t) for i, t in enumerate(texts()) if t]
    index = secrets.postings(spark.createDataFrame(rows, "_row long, _text string"), rules)
    got = {r._row: {n for n in range(len(rules)) if r._rules >> n & 1} for r in secrets.candidates(index, rules).collect()}
    want = {}
    for (i, t), (n, rule) in itertools.product(rows, enumerate(rules)):
        if any(all(x in t.lower() for x in c) for c in rule.trigram_query()):
            want.setdefault(i, set()).add(n)
    assert got == want


PATTERNS = {
    "abcd": [("abc", "bcd")],
    "[Aa][Bb][Cc]x?": [("abc",)],
    "foo(bar|baz)[0-9]+": None,
    "ab[0-9]+": [(f"ab{d}",) for d in range(10)],
    "(one|two|tree)-?[a-z]*end": [("end", "one"), ("end", "tre", "ree"), ("end", "two")],
    "x*": [],
    "[0-9a-f]{24,}": [],
    "a.c": [],
    "(?i:secret)": [],
    "[^a]bcd": [("bcd",)],
    "(abc){2,}": [("abc", "bca", "cab")],
    "(?:ab|cd){2}e+f": None,
    r"\bkey\s*=\s*value\b": [("alu", "key", "lue", "val")],
    "ünter": [("nte", "ter")],
    "q(abc|)z": None,
}


def test_queries_are_derived_from_expressions():
    for pattern, want in PATTERNS.items():
        if want is not None:
            assert secrets.Rule("x", pattern, 0, 1).trigram_query() == sorted(tuple(sorted(c)) for c in want), pattern


def random_expression(rng, depth=3):
    """An expression and a string that it matches."""
    kind = rng.randrange(7) if depth else 0
    if kind <= 1:
        c = rng.choice("abcdeABX_-9")
        return re.escape(c), c
    if kind == 2:
        chars = rng.sample("abcdeXYZ019", rng.randint(1, 6))
        return f"[{''.join(chars)}]", rng.choice(chars)
    if kind == 3:
        ways = [random_expression(rng, depth - 1) for _ in range(rng.randint(1, 3))]
        return f"({'|'.join(w for w, _ in ways)})", rng.choice(ways)[1]
    if kind == 4:
        low = rng.randint(0, 5)
        high = low + rng.randint(0, 2)
        inner, _ = one = random_expression(rng, depth - 1)
        n = rng.randint(low, high)
        return f"(?:{inner})" + rng.choice([f"{{{low},{high}}}"] + ["*", "+"][low and 1 :][:1] * (low < 2)), one[1] * max(n, low)
    parts = [random_expression(rng, depth - 1) for _ in range(rng.randint(2, 5))]
    return "".join(p for p, _ in parts), "".join(m for _, m in parts)


def test_matches_of_random_expressions_satisfy_their_queries():
    rng = random.Random(12)
    told = 0
    for _ in range(3000):
        pattern, match = random_expression(rng)
        assert re.fullmatch(pattern, match)
        query = secrets.Rule("x", pattern, 0, 0).trigram_query()
        told += bool(query)
        assert not query or any(all(t in match.lower() for t in c) for c in query), (pattern, match, query)
    assert told > 300


def test_rules_of_ones_own(spark):
    rules = (secrets.Rule("short", "ab[0-9]+", 0, 1), secrets.Rule("none", "[0-9]{3}", 0, 1), secrets.Rule("long", "(?:begin|start) [a-z]+ end", 0, 1))
    rows = [(1, "AB1 ab22 start x end"), (2, "begin abc end 123456"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for some in (rules, rules[1:2], ()):
        got = {r.doc_id: {(s.start, s.kind, s.stop) for s in r.spans} for r in secrets.scan(docs, rules=some).collect()}
        assert got == {k: {(m.start(), r.kind, m.end()) for r in some for m in re.finditer(r.pattern, t)} for k, t in rows}


def test_joined_by_row_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    want = sorted(map(str, secrets.scan(docs).collect()))
    monkeypatch.setattr(secrets, "BROADCAST", 0)
    assert sorted(map(str, secrets.scan(docs).collect())) == want


def test_very_many_spans_in_a_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "token=abcdef " * n + "é" + "0123456789abcdef" * 2), (2, "x " + "0123456789abcdef01234567-" * 3000)], "doc_id long, text string")
    began = time.perf_counter()
    found = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert time.perf_counter() - began < 60
    assert [(s.start, s.stop) for s in found[1]] == [(13 * i, 13 * i + 12) for i in range(n)] + [(13 * n + 1, 13 * n + 33)]
    assert [(s.start, s.stop) for s in found[2]] == [(2 + 25 * i, 26 + 25 * i) for i in range(3000)]


def test_empty(spark):
    assert secrets.digest(secrets.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
