"""DuckDB SQL with the results of the llm queries, written apart from the operators."""

_KEYWORD = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
)
_ASSIGN = _KEYWORD + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (  # kind, pattern, group that has the least length, least length
    ("assign", _ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def _secrets() -> str:
    parts = [
        f"""SELECT n, {order} AS kind_order, '{kind}' AS kind, whole, part, gap_end + before AS start, least FROM (
            SELECT n, unnest(w) AS whole, unnest(p) AS part, unnest(ends) AS gap_end, unnest(before) AS before, {least} AS least
            FROM (SELECT n, w, p,
                    list_transform(range(1, len(w) + 1), lambda i: coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)) AS ends,
                    list_transform(range(1, len(w) + 1), lambda i: coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)) AS before
                  FROM (SELECT n, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {group}) AS p,
                               string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')){"" if kind != "hex" else " WHERE len(list_filter(w, lambda x: length(x) >= 24)) > 0"}))"""
        for order, (kind, pattern, group, least) in enumerate(_KINDS)
    ]
    return f"""
    WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(parts)}),
    kept AS (SELECT n, kind_order, kind, start::BIGINT AS start, (start + length(whole))::BIGINT AS stop FROM found WHERE length(part) >= least),
    per AS (SELECT n,
        count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order) FILTER (kind_order < 3) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order) AS spans
        FROM kept GROUP BY n)
    SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN per USING (n)"""


SECRETS = _secrets()

SUBSTRINGS = """
    WITH d AS (SELECT row_number() OVER () AS n, doc_id,
            list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    windows AS (SELECT n, doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS s
        FROM (SELECT n, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
    firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
    gone AS (SELECT DISTINCT n, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (s) WHERE least < doc_id),
    gaps AS (SELECT n, count(*) AS removed, list(p) AS ps FROM gone GROUP BY n)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed,
        sha256(coalesce(list_aggregate(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), 'string_agg', ' '), '')) AS kept_sha256
    FROM d LEFT JOIN gaps USING (n)"""

TOP_K = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scored QUALIFY rank <= 20"""


def _crc32(text: str) -> str:
    """The unsigned checksum of a text's UTF-8, of code points below 2048, bit by bit."""
    utf8 = f"list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)"
    steps = f"flatten(list_transform(flatten({utf8}), lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
    return f"xor({fold}, 4294967295::BIGINT)"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SPELLING = f"""
    WITH RECURSIVE runs AS (SELECT doc_id, translate(run, '{_UPPER}', '{_UPPER.lower()}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')) AS run FROM documents)),
    summed AS (SELECT run, times, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL)),
    slipped AS (SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
    w AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
    less AS MATERIALIZED (SELECT word, n, i, length(word) AS size, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
    pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.short = b.short AND a.i = b.i AND a.size = b.size AND a.word <> b.word
        UNION SELECT w.word, less.word, less.n FROM w JOIN less ON less.short = w.word UNION SELECT less.word, w.word, w.n FROM w JOIN less ON less.short = w.word),
    best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near COLLATE C) = 1),
    formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
    ways AS (SELECT word, word AS at FROM formed UNION ALL SELECT ways.word, formed.form FROM ways JOIN formed ON formed.word = ways.at WHERE formed.form IS NOT NULL),
    ends AS (SELECT ways.word, ways.at AS root FROM ways JOIN formed ON formed.word = ways.at WHERE formed.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""


def _coded(column: str, role: bool = False) -> str:
    done = f"replace(replace(replace({column}, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e')"
    return f"replace({done}, ':', '\\c')" if role else done


CHAT = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
    sized AS (SELECT *, length({_coded("role", True)}) + length({_coded("text")}) + 15 AS size FROM t),
    summed AS (SELECT *, sum(size) OVER w AS stop, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS final FROM sized
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
    per AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY stop) AS turns,
        coalesce(string_agg(text, '' ORDER BY stop) FILTER (role = 'assistant'), '') AS loss, sum(stop) FILTER (role = 'assistant' OR final) AS formatted FROM summed GROUP BY conv_id)
    SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM per"""


def _leaf(n_chars: str) -> str:
    fields = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _tree(name: str, leaves: str) -> str:
    """All nodes of a tree over each group, and for each leaf its siblings with their sides, from the bottom up."""
    return f"""{name} AS (SELECT 0 AS height, g, place, n, digest FROM {leaves}
        UNION ALL SELECT height + 1, g, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY height, g, place // 2, n),
    {name}_ways AS (SELECT l.g, l.place, list(CASE WHEN s.digest IS NULL THEN 'alone' WHEN s.place < t.place THEN 'left ' || s.digest ELSE 'right' || s.digest END ORDER BY t.height) FILTER (t.n > 1) AS way
        FROM {leaves} l JOIN {name} t ON t.g = l.g AND t.place = l.place >> t.height LEFT JOIN {name} s ON s.g = t.g AND s.height = t.height AND s.place = xor(t.place, 1) GROUP BY l.g, l.place)"""


MERKLE = f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_leaf("n_chars")} AS digest, CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS changed FROM documents),
    leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM d),
    {_tree("low", "leaves")},
    heads AS MATERIALIZED (SELECT '' AS g, g AS name, digest, row_number() OVER (ORDER BY g COLLATE C) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
    {_tree("high", "heads")},
    proofs AS (SELECT leaves.doc_id, leaves.digest AS leaf, leaves.changed, heads.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root,
            list_concat(coalesce(low_ways.way, []), coalesce(high_ways.way, [])) AS way
        FROM leaves JOIN heads ON heads.name = leaves.g JOIN low_ways ON low_ways.g = leaves.g AND low_ways.place = leaves.place JOIN high_ways ON high_ways.place = heads.place),
    folded AS (SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), way), lambda h, s: sha256(CASE s[1:5] WHEN 'left ' THEN s[6:] || h WHEN 'right' THEN h || s[6:] ELSE h END)) AS folded_root FROM proofs)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(way, lambda s: s <> 'alone'), lambda s: s[6:]), '')) AS proof_sha256,
        folded_root, folded_root = root AS verified FROM folded"""
