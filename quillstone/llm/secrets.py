"""Secret scan by a trigram inverted index, in DataFrame functions only.

A Boolean trigram query is derived from every rule's regular expression (see ``trigrams``). The index maps a trigram to the rows that
hold it, in either case; only trigrams that some query names are indexed. Joining the queries' terms to the index
and counting the terms that each row satisfies intersects the postings; the rows that satisfy a
whole conjunction are the rule's candidates, and only those are run through the rule's regular
expression. A rule without mandatory trigrams (hexadecimal runs) scans every row.

Candidates, two numbers each, are broadcast to the texts if they are ``BROADCAST`` at most, counted first; beyond that texts and
candidates are joined by row.

Span positions come from ``split`` and ``regexp_extract_all``: the pieces between the matches and the
matches themselves alternate, so running sums of their lengths are the offsets, in code points.

Defined results: a null text counts as empty and has no spans; null and repeated keys are allowed, each
input row gives one output row; an empty table gives an empty table; other columns, whatever their names, are left aside; texts are
scanned whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.plans.shared import checkpointed
from quillstone.llm.trigrams import ALL, query_of


#: Candidates that are broadcast at most: two numbers a row.
BROADCAST = 500_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` finds leftmost matches that do not overlap; a match is kept if its
    group ``group`` has ``min_length`` characters or more. The pattern is in what Python's and Java's expressions have in common."""

    kind: str
    pattern: str
    group: int
    min_length: int

    def trigram_query(self) -> list[tuple[str, ...]]:
        """Conjunctions of trigrams, of which a matching text satisfies at least one; none: no mandatory trigrams."""
        query = query_of(self.pattern)
        return [] if query == ALL else sorted(tuple(sorted(c)) for c in query)


def spelled(word: str) -> str:
    """The literal in either case of its ASCII letters, without regex flags."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = (
    "(" + "|".join([*map(spelled, KEYWORDS[:4]), spelled("api") + "_?" + spelled("key")]) + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run of hexadecimal digits below 24 never becomes a match of the bounded form, and a longer one is one match of
#: either form, so the bound may stand in the pattern; the same holds for access keys of 20.
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Public key formats, found besides the base rules.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def sums_before(values: Column) -> Column:
    """For each of an array of longs the sum of those before it. The array is summed in blocks of about the root of its size, so what is copied as
    arrays grow is the size's 1.5th power, and not its square."""

    def scanned(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(xs, start, lambda s, x: F.struct((s["total"] + x).alias("total"), F.array_append(s["sums"], s["total"]).alias("sums")))

    size = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    n_blocks = F.ceil(F.size(values) / size).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))), lambda b: scanned(F.slice(values, b * size + 1, size)))

    def moved(blocks: Column) -> Column:
        before = scanned(F.transform(blocks, lambda b: b["total"]))["sums"]
        return F.flatten(F.zip_with(blocks, before, lambda b, n: F.transform(b["sums"], lambda x: x + n)))

    return F.element_at(F.transform(F.array(blocks), moved), 1)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,kind_order,kind,stop>> of the rule's kept matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))  # the piece before each match
    sizes = F.arrays_zip(*(F.transform(x, lambda t: F.length(t).cast("long")).alias(n) for x, n in ((gaps, "gap"), (whole, "whole"), (part, "part"))))

    def placed(sizes: Column) -> Column:
        before = sums_before(F.transform(sizes, lambda p: p["gap"] + p["whole"]))
        return F.zip_with(sizes, before, lambda p, n: F.struct((n + p["gap"]).alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), (n + p["gap"] + p["whole"]).alias("stop"), p["part"].alias("part")))

    kept = F.filter(F.element_at(F.transform(F.array(sizes), placed), 1), lambda s: s["part"] >= rule.min_length)
    return F.transform(kept, lambda s: s.dropFields("part"))


def no_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,kind_order:int,kind:string,stop:bigint>>")


def postings(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The inverted index (trigram, row) over the trigrams that the rules' queries name."""
    named = sorted({t for r in rules for c in r.trigram_query() for t in c})
    folded = F.lower(F.col("_text"))
    held = F.filter(F.array(*map(F.lit, named)), lambda t: F.contains(F.col("_folded"), t))
    return rows.select("_row", folded.alias("_folded")).select("_row", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_row, _rules): a bit for each of ``rules`` whose trigram query the row satisfies."""
    spark = index.sparkSession
    terms = [(t, n, m, len(c)) for n, r in enumerate(rules) for m, c in enumerate(r.trigram_query()) for t in c]
    # a few dozen rows fixed by the rules
    queries = F.broadcast(spark.createDataFrame(terms, "trigram string, rule int, conjunction int, terms int"))
    return (
        index.join(queries, "trigram")
        .groupBy("_row", "rule", "conjunction", "terms")
        .agg(F.count_distinct("trigram").alias("_met"))
        .where(F.col("_met") == F.col("terms"))
        .groupBy("_row")
        .agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("_rules"))
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``key`` and ``spans``, an array of (start, kind_order, kind, stop) by start, then by the rules' order (63 of them at most)."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    # rows that collide only share candidates, which the regular expressions verify
    rows = rows.withColumn("_row", F.xxhash64("_key", "_text"))
    indexed = tuple(r for r in rules if r.trigram_query())
    if indexed:
        found = checkpointed(candidates(postings(rows, indexed), indexed))
        rows = rows.join(F.broadcast(found) if found.count() <= BROADCAST else found, "_row", "left")
    parts = []
    for order, rule in enumerate(rules):
        if rule in indexed:
            wanted = F.coalesce(F.col("_rules"), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << indexed.index(rule)).cast("long")) != 0
        else:
            wanted = F.col("_text").rlike(rule.pattern)
        parts.append(F.when(wanted, spans_of(F.col("_text"), rule, order)).otherwise(no_spans()))
    spans = F.array_sort(F.concat(*parts)) if parts else no_spans()
    return rows.select(F.col("_key").alias(key), spans.alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts and digests of ``scan``'s spans."""

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(key, *map(count, kinds), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
