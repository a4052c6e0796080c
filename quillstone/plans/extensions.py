"""Plans beyond what the stores' queries need: latest rows, scope summaries, exports, key words, lineage, anchors, walks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.terms import json_map
from quillstone.functions.text import string_attribute
from quillstone.operators.request import AssertionQuery, in_time_order, matching
from quillstone.plans.shared import checkpointed, forget, written

KEY = ("scope", "owner_id", "subject", "predicate")


def latest(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The last observed row of each key, among equal times the last inserted. A map-side maximum, so a hot key is one row for each task."""
    last = F.max_by(F.struct(*df.columns), F.struct("observed_at", "ingest_seq")).alias("row")
    return df.groupBy(*key).agg(last).select("row.*")


def scope_summary(df: DataFrame) -> DataFrame:
    """Rows, first and last time, distinct subjects of each scope and owner."""
    return df.groupBy("scope", "owner_id").agg(
        F.count("*").alias("n_rows"), F.min("observed_at").alias("first_observed"), F.max("observed_at").alias("last_observed"), F.count_distinct("subject").alias("n_subjects")
    )


def export(df: DataFrame) -> DataFrame:
    """One JSON object for each row, without nulls, in a fixed order."""
    names = ("subject", "predicate", "object", "scope", "owner_id", "observed_at", "valid_from", "valid_until", "confidence")
    row = F.to_json(F.struct(*names, F.col("provenance_json").alias("provenance"), F.col("attributes_json").alias("attributes")))
    order = ("observed_at", "subject", "predicate", "object", "scope", "owner_id", "json")
    return df.select(row.alias("json"), *order[:-1]).orderBy(*order).select("json")


def words_of(text: Column) -> Column:
    """The words of a text or of a query: runs of letters and numbers, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")


def with_keywords(df: DataFrame, words: str) -> DataFrame:
    """Rows whose text has every word, whatever its case; none if there is no word in ``words``. Asked for by itself; never a
    substitute for a semantic query."""
    wanted = words_of(F.lit(words))
    return df.where((F.size(wanted) > 0) & (F.size(F.array_except(wanted, words_of(F.col("text")))) == 0))


# Kinds of derived assertions, policies for them, and where their sources stand.
DERIVED_KINDS = ("summary", "derived", "probe_report", "reconciliation")
POLICIES = ("supports", "disagrees", "supersedes", "summarizes")
SOURCE_KEYS = ("source_assertion_ids", "source_span_ids", "source_artifact_ids", "source_urls")


def strings_at(provenance: Column, name: str) -> Column:
    """A list of strings in a map of variants, without blank ones; empty for anything else."""
    value = F.from_json(F.to_json(F.try_element_at(provenance, F.lit(name))), "array<string>")
    return F.coalesce(F.filter(value, lambda x: F.btrim(x) != ""), F.array().cast("array<string>"))


def sources(df: DataFrame) -> DataFrame:
    """(ingest_seq, source_kind, source_id): all that rows name as their sources."""
    held = df.withColumn("__map", json_map(F.col("provenance_json")))

    def of_kind(kind: str) -> Column:
        return F.transform(strings_at(F.col("__map"), kind), lambda x: F.struct(F.lit(kind).alias("source_kind"), x.alias("source_id")))

    named = F.flatten(F.array(*map(of_kind, SOURCE_KEYS)))
    return held.select("ingest_seq", F.explode(named).alias("s")).select("ingest_seq", "s.*")


def lineage_violations(df: DataFrame) -> DataFrame:
    """(ingest_seq, violation) of derived assertions (attribute memory_kind) without sources (a list that is not empty at one of SOURCE_KEYS
    in the provenance) or with an unknown policy (attribute lineage_policy)."""
    held = df.withColumns({"__attributes": json_map(F.col("attributes_json")), "__provenance": json_map(F.col("provenance_json"))})
    kind, policy = (string_attribute(F.col("__attributes"), n) for n in ("memory_kind", "lineage_policy"))
    n_sources = sum((F.size(strings_at(F.col("__provenance"), k)) for k in SOURCE_KEYS), F.lit(0))
    found = F.array_compact(
        F.array(
            F.when(n_sources < 1, F.lit("no sources")),
            F.when(policy.isNotNull() & ~policy.isin(*POLICIES), F.lit("unknown policy")),
        )
    )
    return held.where(kind.isin(*DERIVED_KINDS)).select("ingest_seq", F.explode(found).alias("violation"))


#: What a cue weighs where it is found.
WEIGHTS = {"term": 8.0, "facet": 4.0, "label": 2.0, "topic": 2.0, "word": 1.0}
RELATED = 0.5
# Predicates of labels and topics; attributes and provenance entries that are facets.
LABEL_PREDICATES = ("schema:name", "skos:preflabel", "skos:altlabel")
TOPIC_PREDICATES = ("schema:about", "schema:mentions", "dcterms:subject")
TYPE_FACETS = ("subject_type", "object_type")
PROVENANCE_FACETS = ("source_path", "source_url", "artifact_id", "span_id", "command", "provider", "model", "route_id", "tool_id")


def standing_alone(cue: str) -> str:
    """An expression for a cue of any characters, blanks and signs too, that no letter or number continues on either side where it ends in one."""
    quoted = "\\Q" + cue.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    before, after = (rf"(?{way}[\p{{L}}\p{{N}}])" if end.isalnum() else "" for way, end in (("<!", cue[0]), ("!", cue[-1])))
    return before + quoted + after


def anchor_hits(within: DataFrame, cues: Sequence[str]) -> DataFrame:
    """(ingest_seq, where, cue): the places of each row that hold a cue. Arrays are cut down to the cues before they are exploded, and
    texts are only looked through for the cues."""
    wanted = F.array(*map(F.lit, cues)).cast("array<string>")
    held = within.withColumns({"__attributes": json_map(F.col("attributes_json")), "__provenance": json_map(F.col("provenance_json"))})

    def at(values: Column, where: str) -> Column:
        return F.transform(F.array_intersect(values, wanted), lambda v: F.struct(F.lit(where).alias("where"), v.alias("cue")))

    facets = [F.lower(string_attribute(F.col("__attributes"), n)) for n in TYPE_FACETS] + [F.lower(string_attribute(F.col("__provenance"), n)) for n in PROVENANCE_FACETS]
    listed = [F.transform(strings_at(F.col("__provenance"), k), F.lower) for k in SOURCE_KEYS]
    terms = words_of(F.col("object_key"))

    def of_object(predicates: tuple[str, ...]) -> Column:
        return F.when(F.col("predicate").isin(*predicates), F.array_append(terms, F.col("object_key"))).otherwise(F.array().cast("array<string>"))

    text = F.lower("text")
    named = F.array_compact(F.concat(F.array("subject", "predicate", "object_key", *facets), *listed))

    def in_text(cue: str) -> Column:
        # the text begins with the terms, so what is a term, or a facet, counts there only as a single word
        return text.contains(cue) & text.rlike(standing_alone(cue)) & (F.lit(cue.isalnum()) | ~F.array_contains(named, cue))

    words = F.array_compact(F.array(*(F.when(in_text(c), F.lit(c)) for c in cues))).cast("array<string>")
    places = F.concat(
        at(F.array("subject", "predicate", "object_key"), "term"),
        at(F.array_compact(F.concat(F.array(*facets), *listed)), "facet"),
        at(of_object(LABEL_PREDICATES), "label"),
        at(of_object(TOPIC_PREDICATES), "topic"),
        at(words, "word"),
    )
    return held.select("ingest_seq", F.explode(places).alias("p")).select("ingest_seq", "p.*")


def anchor_scores(
    df: DataFrame, q: AssertionQuery, cues: Sequence[str], rows: int = 20, *, least_length: int = 1, stop: Sequence[str] = (), max_share: float | None = None, related: bool = False
) -> DataFrame:
    """The rows within the query's conditions by how they answer the cues: exact terms, then facets of types and provenance, then labels and
    topics, then words of the text, each divided by the root of the number of rows that have the cue there; ties in the order of
    insertion. Cues that are short, or stop words, or that more than ``max_share`` of the rows hold in a place, count nothing there. With
    ``related``, rows that have a subject or object in common with a row that a cue matched by term, as by a shared anchor, get a
    lower score, also divided by the root of that anchor's frequency. ``why`` has (where, cue, contribution), the largest first."""
    within = matching(df, q)
    wanted = [c for c in dict.fromkeys(c.strip().lower() for c in cues) if c and len(c) >= least_length and c not in stop]
    if not wanted:
        return df.where(F.lit(False)).select("ingest_seq", F.lit(0.0).alias("score"), F.array().cast("array<struct<contribution:double,where:string,cue:string>>").alias("why"))
    hits = checkpointed(anchor_hits(within, wanted))  # two short strings a hit, read twice
    counts = hits.groupBy("where", "cue").agg(F.count("*").alias("n"))  # at most five rows a cue
    most = None if max_share is None else max_share * within.count()
    if most is not None:
        counts = counts.where(F.col("n") <= most)
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[F.col("where")]
    parts = hits.join(F.broadcast(counts), ["where", "cue"]).select("ingest_seq", (weight / F.sqrt("n")).alias("contribution"), "where", "cue")
    if related:
        ends = within.select("ingest_seq", F.explode(F.array_distinct(F.array("subject", "object_key"))).alias("anchor"))
        shared = ends.join(hits.where("where = 'term'").select("ingest_seq").distinct(), "ingest_seq", "left_semi").select("anchor").distinct().where(~F.col("anchor").isin(*wanted))
        near = checkpointed(ends.join(shared, "anchor"))
        often = near.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
        if most is not None:
            often = often.where(F.col("n") <= most)
        near = near.join(often, "anchor").select("ingest_seq", (F.lit(RELATED) / F.sqrt("n")).alias("contribution"), F.lit("related").alias("where"), F.col("anchor").alias("cue"))
        parts = parts.unionByName(near)
    scored = parts.groupBy("ingest_seq").agg(F.sum("contribution").alias("score"), F.sort_array(F.collect_list(F.struct("contribution", "where", "cue")), asc=False).alias("why"))
    return scored.orderBy(F.desc("score"), "ingest_seq").limit(rows)


@dataclass
class Walk:
    """Edges with the ``depth`` at which they were met and the ``path`` of nodes that led to them, visited nodes with theirs, and why the
    walk stopped."""

    edges: DataFrame
    nodes: DataFrame
    hops: int
    n_edges: int
    n_nodes: int
    partial: bool
    stop_reason: str
    warnings: list[str] = field(default_factory=list)


def first_by_weight(rows: DataFrame, weight: str, most: float, *order: str) -> DataFrame:
    """The first rows in an order whose weights together are ``most`` at most. Weights are added up within sorted ranges, each of which begins with
    the sum of those before it, so no task holds all rows."""
    ranged, path = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum(weight).alias("__own"))  # a row for each range
    before = sums.select("__part", (F.sum("__own").over(Window.orderBy("__part")) - F.col("__own")).alias("__before"))
    within = F.sum(weight).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = checkpointed(ranged.join(F.broadcast(before), "__part").where(F.col("__before") <= most).withColumn("__sum", F.col("__before") + within).where(F.col("__sum") <= most))
    forget(rows.sparkSession, path)
    return kept.drop("__part", "__before", "__sum")


def walk(
    df: DataFrame,
    seeds: DataFrame,
    q: AssertionQuery | None = None,
    *,
    direction: str = "out",
    predicates: Sequence[str] | None = None,
    max_hops: int = 2,
    max_edges: int | None = 10_000,
    max_nodes: int | None = 10_000,
    weight: Column | None = None,
    max_weight: float | None = None,
) -> Walk:
    """Breadth first from the nodes in ``seeds``; the query's conditions hold for every edge. Each hop joins the frontier to the
    edges and takes away what was visited, so cycles end. A hop is counted first; only if it would pass a budget (None: there is none) it is
    sorted and cut, to its first edges by (node, other, ingest_seq). With ``weight``, a Column over the rows (tokens of their texts, say; null is 0), the edges'
    weights are added up in that order, and those that would pass ``max_weight`` are cut off. Of several paths to a node the least one counts."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    usable = matching(df, q or AssertionQuery())
    usable = usable.withColumn("__weight", F.lit(0.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0)))
    if predicates is not None:
        usable = usable.where(F.col("predicate").isin(*predicates) if predicates else F.lit(False))
    ways = []
    if direction in ("out", "both"):
        ways.append(usable.select(F.col("subject").alias("node"), F.col("object_key").alias("other"), "predicate", "ingest_seq", "__weight"))
    if direction in ("in", "both"):
        ways.append(usable.select(F.col("object_key").alias("node"), F.col("subject").alias("other"), "predicate", "ingest_seq", "__weight"))
    steps = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    node = F.col(seeds.columns[0]).cast("string")
    frontier = checkpointed(seeds.select(node.alias("node")).distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path")))
    nodes, edges = frontier, None
    n_nodes, n_edges, hops, partial, reason, warnings = frontier.count(), 0, 0, False, "max_hops", []
    spent = 0.0

    def within(rows: DataFrame, left: int | None, *order: str) -> tuple[DataFrame, int, bool]:
        """The rows, or the first of them that the budget leaves; how many; whether some were cut off."""
        rows = checkpointed(rows)
        n = rows.count()
        if left is None or n <= left:
            return rows, n, False
        return checkpointed(rows.orderBy(*order).limit(left)), left, True

    while hops < max_hops:
        met = frontier.drop("depth").join(steps, "node").withColumn("depth", F.lit(hops + 1))
        if edges is not None:
            met = met.join(edges.select("ingest_seq"), "ingest_seq", "left_anti")
        met = met.withColumn("path", F.concat("path", F.array("other")))
        if direction == "both":  # an edge between two nodes of the frontier is met from either
            columns = met.columns
            met = met.groupBy("ingest_seq").agg(F.min(F.struct("node", "other", "predicate", "depth", "path", "__weight")).alias("m")).select("ingest_seq", "m.*").select(*columns)
        met, more, cut = within(met, None if max_edges is None else max_edges - n_edges, "node", "other", "ingest_seq")
        if not more and not cut:
            reason = "exhausted"
            break
        if cut:
            partial, reason = True, "max_edges"
        if max_weight is not None:
            own = met.agg(F.coalesce(F.sum("__weight"), F.lit(0.0))).first()[0]
            if spent + own > max_weight:
                met = checkpointed(first_by_weight(met, "__weight", max_weight - spent, "node", "other", "ingest_seq"))
                more, own = met.agg(F.count("*"), F.coalesce(F.sum("__weight"), F.lit(0.0))).first()
                partial, reason = True, "max_weight"
            spent += own
        hops, n_edges = hops + 1, n_edges + more
        edges = met if edges is None else edges.unionByName(met)
        new = met.groupBy(F.col("other").alias("node")).agg(F.min("path").alias("path")).join(nodes, "node", "left_anti").select("node", F.lit(hops).alias("depth"), "path")
        new, more, cut = within(new, None if max_nodes is None else max_nodes - n_nodes, "node")
        if cut:
            partial, reason = True, reason if partial else "max_nodes"
        n_nodes += more
        nodes, frontier = nodes.unionByName(new), new
        if partial:
            warnings.append(f"stopped at {reason}")
            break
        if not more:
            reason = "exhausted"
            break
    if edges is None:
        edges = steps.withColumns({"depth": F.lit(0), "path": F.array("node")}).where(F.lit(False))
    return Walk(edges.select("node", "predicate", "other", "ingest_seq", "depth", "path"), nodes, hops, n_edges, n_nodes, partial, reason, warnings)


@dataclass(frozen=True)
class Snapshot:
    """What a store holds, for readers that must not change it: frames in a fixed order, and what can't be shown."""

    capabilities: object
    assertions: DataFrame
    scopes: DataFrame
    sources: DataFrame
    warnings: list[str]


def snapshot(store: object, q: AssertionQuery | None = None) -> Snapshot:
    """A read-only view of a store: its capabilities, the rows that answer the query in a fixed order, a summary of all scopes, and
    the sources that the rows name. Nothing is written."""
    q = q or AssertionQuery()
    frame = store.frame()
    warnings = [] if store.capabilities.vector else ["the store has no vectors"]
    if q.semantic:
        warnings.append("a snapshot is in time order; the semantic part of the query is left aside")
    rows = in_time_order(matching(frame, q), q)
    return Snapshot(store.capabilities, rows, scope_summary(frame).orderBy("scope", "owner_id"), sources(rows).orderBy("ingest_seq", "source_kind", "source_id"), warnings)
