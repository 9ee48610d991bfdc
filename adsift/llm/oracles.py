"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

# The chat template's control strings, as fixed in its definition.
_HEADERS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
_CONTROLS = (*_HEADERS.values(), "### Role [", "]: ", "</turn>\n")
_FOLLOWS = ("start>system", "start>user", "system>user", "user>assistant", "assistant>user")


def _literal(text: str) -> str:
    return " || chr(10) || ".join(f"'{line}'" for line in text.split("\n"))


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in _CONTROLS:
        out = f"replace({out}, {_literal(c)}, {_literal(c[0] + chr(92) + c[1:])})"
    return out


_HEADER = "CASE role " + " ".join(f"WHEN '{r}' THEN {_literal(h)}" for r, h in _HEADERS.items()) + f" ELSE '### Role [' || {_escaped('role')} || ']: ' END"

CHAT = f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
    ), o AS (
        SELECT *, row_number() OVER w AS pos, coalesce(lag(role) OVER w, 'start') AS before,
               {_HEADER} || {_escaped("text")} || {_literal(_CONTROLS[-1])} AS said
        FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ), c AS (
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(said))::BIGINT AS formatted_chars, arg_max(role, pos) AS last_role,
               min(pos) FILTER (before || '>' || role NOT IN {_FOLLOWS}) AS bad
        FROM o GROUP BY conv_id
    )
    SELECT * EXCLUDE (last_role, bad, n), n = 0 AS valid, n::INTEGER AS bad_turn
    FROM (SELECT *, coalesce(bad, CASE WHEN last_role <> 'assistant' THEN n_turns + 1 ELSE 0 END) AS n FROM c)
"""


def _merkle(levels: int = 6) -> str:
    """Trees level by level, for up to 16 ** levels rows a source and as many sources."""
    def part(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    first = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [f"""rows0 AS (
        SELECT doc_id, coalesce('=' || source, '') AS grp, sha256({first} || {part("text")}) AS leaf,
               sha256({first} || {part("CASE WHEN tampered THEN low ELSE text END")}) AS claim
        FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, doc_id IN (SELECT id FROM struck) AS tampered FROM documents)
    ), leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows0),
    a0 AS (SELECT grp, pos AS i, leaf AS h FROM leaves)"""]
    tree = """{x}{k} AS (
        SELECT grp, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
        FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {x}{j}) GROUP BY grp, i // 16),
    {x}p{k} AS (
        SELECT grp, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {x}{j}) WHERE n > 1 WINDOW w AS (PARTITION BY grp, i // 16 ORDER BY i))"""
    for k in range(1, levels + 1):
        parts.append(tree.format(x="a", k=k, j=k - 1))
    parts.append(f"b0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, h, grp AS name FROM a{levels})")
    for k in range(1, levels + 1):
        parts.append(tree.format(x="b", k=k, j=k - 1))
    parts.append(f"""f0 AS (
        SELECT l.doc_id, l.grp, l.leaf, l.pos, s.i AS spot, s.h AS subroot, t.h AS root, l.claim AS h, '' AS beside
        FROM leaves l JOIN b0 s ON s.name = l.grp CROSS JOIN b{levels} t)""")
    last = "f0"
    for x, key, at in (("a", "f.grp", "pos"), ("b", "0", "spot")):
        for k in range(1, levels + 1):
            here = f"f{x}{k}"
            parts.append(f"""{here} AS (
                SELECT f.* EXCLUDE (h, beside), CASE WHEN p.l IS NULL THEN f.h ELSE sha256(p.l || f.h || p.r) END AS h,
                       f.beside || coalesce(p.l || p.r, '') AS beside
                FROM {last} f LEFT JOIN {x}p{k} p ON p.grp = {key} AND p.i = f.{at} // {16 ** (k - 1)})""")
            last = here
    return f"""
        WITH RECURSIVE digits(id, pos, crc, text) AS (
            SELECT doc_id, 1, 4294967295::BIGINT, doc_id::VARCHAR FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
            UNION ALL SELECT id, pos + 1, {_crc_step("xor(crc, ascii(substr(text, pos, 1)))")}, text FROM digits WHERE pos <= length(text)
        ), struck AS (SELECT id FROM digits WHERE pos = length(text) + 1 AND xor(crc, 4294967295) % 5 = 0),
        {", ".join(parts)}
        SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, h AS folded_root, h = root AS verified FROM {last}
    """


def _crc_step(value: str) -> str:
    """Eight steps of the reflected CRC-32 polynomial."""
    return f"list_reduce([{value}, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"


DIVERGENCE = """
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    u AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM u GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
    vocab AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM d),
    used AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    sizes AS (SELECT lang, source, sum(n) AS size FROM used GROUP BY lang, source),
    p AS (
        SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(x.n, 0) + 1)) // (coalesce(s.size, 0) + v.v)::HUGEINT AS p,
               1 + (1000000000::HUGEINT * (k.n + 1)) // (v.size + v.v)::HUGEINT AS q
        FROM groups g JOIN kept k USING (lang) JOIN vocab v USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN used x USING (lang, source, term)
    ),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
    )
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
    QUALIFY part = 'pair' OR rank <= 200
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {LOWERED} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
    "op11_divergence": DIVERGENCE,
    "op12_merkle": _merkle(),
    "op13_chat": CHAT,
}
