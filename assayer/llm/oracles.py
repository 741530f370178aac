"""SQL of the queries that SQL can express."""

from __future__ import annotations

from assayer.llm.decontam import MASKS, SHARE, WINDOW

#: Distinct 5-word runs by a self-join of all rows, then everything reachable from each document.
GROUPS = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) >= 5),
    runs AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS run FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT DISTINCT doc_id, run FROM runs WHERE run IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
    SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def _seed(mask: str) -> str:
    """The words under the ones of a mask from each place on; null where the mask does not fit."""
    return " || ' ' || ".join(f"lead(word, {o}) OVER o" for o, c in enumerate(mask) if c == "1")


def _seeds(source: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, i, '{m}' AS mask, {_seed(m)} AS seed FROM {source} WINDOW o AS (PARTITION BY {key} ORDER BY i)" for m in MASKS)


#: Seeds joined by text; words laid on each other around every hit; the best window.
OVERLAPS = rf"""WITH dw AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents)),
    bw AS (SELECT item_id, len(ws) AS m, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark)),
    hits AS (SELECT DISTINCT d.doc_id, b.item_id, d.i AS di, b.i AS bi FROM ({_seeds("dw", "doc_id")}) d JOIN ({_seeds("bw", "item_id")}) b USING (mask, seed)),
    laid AS (SELECT h.*, w.i AS pos, least({WINDOW}, m) AS width, sum(CAST(w.word = x.word AS INT)) OVER (PARTITION BY h.doc_id, h.item_id, di, bi ORDER BY w.i) AS upto
        FROM hits h JOIN bw x ON x.item_id = h.item_id JOIN dw w ON w.doc_id = h.doc_id AND w.i = x.i + di - bi AND w.i BETWEEN di - {WINDOW} AND di + {len(MASKS[0]) - 1 + WINDOW}),
    spans AS (SELECT z.doc_id, z.item_id, z.pos - z.width + 1 AS pos, (z.upto - coalesce(a.upto, 0)) / CAST(z.width AS DOUBLE) AS share
        FROM laid z LEFT JOIN laid a ON a.doc_id = z.doc_id AND a.item_id = z.item_id AND a.di = z.di AND a.bi = z.bi AND a.pos = z.pos - z.width
        WHERE z.pos - z.width + 1 >= (SELECT min(f.pos) FROM laid f WHERE f.doc_id = z.doc_id AND f.item_id = z.item_id AND f.di = z.di AND f.bi = z.bi))
    SELECT doc_id, item_id, round(share, 6) AS share, CAST(pos AS BIGINT) AS word_at FROM spans WHERE share >= {SHARE}e0
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY share DESC, pos) = 1"""


def _crc_table() -> list[int]:
    """CRC-32 of the single bytes, from the polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


_COST = "list_min(list_transform(range(0, {n}), lambda s: {{'c': -ln((('0x' || substr(md5(doc_id || ':' || s), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0), 's': s}})).s::INT"
#: Costs of all shards per key; the checksum byte by byte.
SHARDS = f"""WITH c AS (SELECT {_crc_table()} AS tab),
    b AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
    d AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32,
        {_COST.format(n=24)} AS shard, {_COST.format(n=25)} AS grown_shard, ('0x' || substr(md5(doc_id || ''), 1, 8))::BIGINT AS h FROM b, c)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard FROM d"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text, byte by byte, with the table ``c.tab``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || {value}, '-')"


def _levels(name: str, start: str, group: str) -> str:
    """All nodes of the trees of ``start``: pairs become a node while a tree has several."""
    return f"""{name} AS (SELECT {group} AS g, 0 AS lv, p, h, count(*) OVER (PARTITION BY {group}) AS n FROM {start}
    UNION ALL SELECT g, any_value(lv) + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, p // 2)"""


#: One list of siblings per leaf, lowest first: the side it stands on and its hash, empty where a node is alone.
_WAY = """SELECT l.g, l.p, list(CASE WHEN o.h IS NULL THEN '-' WHEN o.p < (l.p >> u.lv) THEN 'l' || o.h ELSE 'r' || o.h END ORDER BY u.lv) AS way
    FROM {t} l JOIN {t} u ON u.g IS NOT DISTINCT FROM l.g AND u.p = l.p >> u.lv AND u.n > 1 LEFT JOIN {t} o ON o.g IS NOT DISTINCT FROM l.g AND o.lv = u.lv AND o.p = xor(l.p >> u.lv, 1) WHERE l.lv = 0 GROUP BY l.g, l.p"""

#: Trees of every language and one over their roots; the siblings of every leaf; the fold from the changed leaf.
PROOFS = f"""WITH RECURSIVE c AS (SELECT {_crc_table()} AS tab),
    d AS (SELECT lang, doc_id, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS h,
        sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars + (" + crc32_sql("CAST(doc_id AS VARCHAR)") + " % 7 = 0)::INT", "text"))}) AS claim FROM documents, c),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM d),
    {_levels("t", "leaves", "lang")},
    subroots AS (SELECT g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p FROM t WHERE n = 1),
    {_levels("top", "subroots", "0")},
    inner_way AS ({_WAY.format(t="t")}), outer_way AS ({_WAY.format(t="top")}),
    r AS (SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, l.claim, list_concat(coalesce(i.way, []), coalesce(o.way, [])) AS way
        FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN inner_way i ON i.g IS NOT DISTINCT FROM l.lang AND i.p = l.p LEFT JOIN outer_way o ON o.p = s.p)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x[2:]), '')) AS proof_sha256,
        list_reduce(list_prepend(claim, way), lambda a, x: sha256(CASE WHEN x[1] = 'l' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root, folded_root = root AS verified FROM r"""


def _cheapest(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _edit(state: str, letter: str, cost: str, text: str = "''") -> str:
    """A way prolonged by an edit: cost, audit, repaired texts."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letter}, 't': {state}.t || {text}}}"


def _kept(state: str, role: str) -> str:
    """The row kept where its initial fits, else given the role; out of reach where it has to go."""
    own = f"initial = '{role[0]}'"
    reroled = "1000000" if role == "system" else "3"
    return _edit(
        state,
        f"CASE WHEN {own} THEN 'K' ELSE 'R' END",
        f"CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE CASE WHEN {own} THEN 0 ELSE {reroled} END + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END END",
        f"chr(10) || CASE WHEN {own} THEN role ELSE '{role}' END || ':' || text",
    )


_INSERTED_USER = _cheapest("s2", *[_edit(s, "'I'", "3", "chr(10) || 'user:'") for s in ("s0", "s1", "s3")])
_INSERTED_ASSISTANT = _cheapest("s3", _edit("g2", "'I'", "3", "chr(10) || 'assistant:'"))
_GAP = f"(SELECT *, {_INSERTED_ASSISTANT} AS g3 FROM (SELECT *, {_INSERTED_USER} AS g2 FROM b))"
_UNREACHED = "{'c': 1000000000, 'a': '', 't': ''}"

#: Damaged rows and their faults; then row by row the cheapest way to each of the four states, with its least audit.
REPAIRS = rf"""WITH RECURSIVE c AS (SELECT {_crc_table()} AS tab),
    o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, c),
    d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS again FROM o WHERE f <> 0),
    n AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER w - 1 AS i, lag(substr(role, 1, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS sighting
        FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN sighting > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM n),
    g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
        count_if(fault = 'truncated') AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
    b AS (SELECT DISTINCT conv_id, 0 AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {_UNREACHED} AS s1, {_UNREACHED} AS s2, {_UNREACHED} AS s3 FROM conversations
        UNION ALL SELECT conv_id, i + 1, {_edit("s0", "'D'", "4")}, {_cheapest(_edit("s1", "'D'", "4"), _kept("s0", "system"))},
            {_cheapest(_edit("g2", "'D'", "4"), *[_kept(s, "user") for s in ("s0", "s1", "g3")])}, {_cheapest(_edit("g3", "'D'", "4"), _kept("g2", "assistant"))}
        FROM (SELECT q.*, f.role, f.text, f.initial, f.fault FROM {_GAP} q JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i)),
    e AS (SELECT q.conv_id, {_cheapest("s0", "g3")} AS best FROM {_GAP} q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id WHERE q.i = coalesce(g.n, 0))
    SELECT e.conv_id, {", ".join(f"CAST(coalesce({k}, 0) AS BIGINT) AS {k}" for k in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
    FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id"""
