"""SQL that DuckDB runs to the same rows, for the queries that SQL can express."""

from __future__ import annotations

import string

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x20\x09-\x0D]+')".format(string.ascii_uppercase, string.ascii_lowercase)

_OP1 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)"""

_OP4 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
    SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS joins, lead(role) OVER w IS NOT DISTINCT FROM role AS goes_on FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), sized AS (
    SELECT *, CASE WHEN joins THEN 10 ELSE 13 + length(role) END + length(text) + len(regexp_extract_all(text, '<\\*\|')) + CASE WHEN goes_on THEN 0 ELSE 11 END AS chars FROM marked
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

_OP10 = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents
), sources AS (
    SELECT source, n, 3 * n AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM (SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source)
), levels AS (
    SELECT max(((SELECT sum(n) FROM sources) - before_cap)::DOUBLE / left_weight) AS level FROM (
        SELECT coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
            sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM sources)
), goals AS (
    SELECT source, n, least(cap::DOUBLE, level * weight) AS target, CASE WHEN n = 0 THEN 0 ELSE least(3, floor(least(cap::DOUBLE, level * weight) / n))::BIGINT END AS passes FROM sources, levels
), grouped AS (SELECT source, hash, sum(size)::BIGINT AS own FROM sized GROUP BY source, hash),
placed AS (SELECT source, hash, own, sum(own) OVER (PARTITION BY source ORDER BY hash) - own AS before FROM grouped)
SELECT d.doc_id, d.size, g.n AS source_size, g.target, (d.size * (g.passes + CASE WHEN p.before + p.own / 2.0 < g.target - g.passes * g.n THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN goals g ON g.source IS NOT DISTINCT FROM d.source JOIN placed p ON p.source IS NOT DISTINCT FROM d.source AND p.hash = d.hash"""

_TERMS = r"unnest(regexp_extract_all(translate(text, '{0}', '{1}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))".format(string.ascii_uppercase, string.ascii_lowercase)

_OP13 = f"""
WITH numbered AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
counted AS (SELECT row, term, count(*) AS tf FROM (SELECT row, {_TERMS} AS term FROM numbered) GROUP BY row, term),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM counted GROUP BY row),
totals AS (SELECT count(*) AS docs, coalesce(sum(n), 0)::BIGINT AS terms FROM sizes),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) WHERE item_id IS NOT NULL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM counted, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
gains AS (
    SELECT row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) AS gain
    FROM counted JOIN weights USING (term) JOIN sizes USING (row), totals
), scores AS (SELECT item_id, row, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY item_id, row)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scores JOIN numbered USING (row) WHERE score > 0
) WHERE rank <= 10"""



def _repair_step() -> str:
    """The cheapest (cost, audit) for each last role (none, s, u, a) after a row, from those before it."""
    inserts = ((None, 0, 0, 1), (None, None, 0, 1), (None, None, 1, 0), (None, None, 0, 1))  # between two retained roles
    out = []
    for r in range(4):
        ways = [f"{{c: st[{r + 1}].c + 3, a: st[{r + 1}].a || 'D'}}"]
        for p in range(4):
            if (n := inserts[p][r]) is not None:
                ways.append(f"CASE WHEN NOT gone AND initial = '{' sua'[r]}' THEN {{c: st[{p + 1}].c + {2 * n} + cut, a: st[{p + 1}].a || '{'I' * n}K'}} END")
                if r > 1:
                    ways.append(f"CASE WHEN NOT gone THEN {{c: st[{p + 1}].c + {2 * n + 2} + cut, a: st[{p + 1}].a || '{'I' * n}R'}} END")
        out.append(f"list_sort([{', '.join(ways)}], 'ASC', 'NULLS LAST')[1]")
    return f"[{', '.join(out)}]"


_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(range(length({0})), lambda i: ord(({0})[i + 1])::BIGINT), lambda x, b: {1})"
_BIT = "(CASE WHEN ({0}) % 2 = 1 THEN xor(({0}) >> 1, 3988292384::BIGINT) ELSE ({0}) >> 1 END)"

_OP12 = f"""
WITH RECURSIVE bits AS (SELECT i, i AS x, 0 AS k FROM (SELECT unnest(range(256))::BIGINT AS i) UNION ALL SELECT i, {_BIT.format('x')}, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor({_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))", "xor(x >> 8, t[xor(x & 255, b) + 1])")}, 4294967295::BIGINT) % 20 AS kind
    FROM conversations, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM given WHERE kind <> 0
), marked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS n, left(role, 1) AS initial, rtrim(text, {_SPACE}) AS said FROM damaged
), judged AS (
    SELECT *, said = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT right(said, 1) IN ('.', '!', '?') AS open, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM marked
), rows AS (
    SELECT *, blank OR again AS gone, CASE WHEN open AND NOT blank AND NOT again THEN 1 ELSE 0 END AS cut FROM judged
), chosen(conv_id, n, st) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, [{{c: 0, a: ''}}, {{c: 1000000000, a: ''}}, {{c: 1000000000, a: ''}}, {{c: 1000000000, a: ''}}] FROM rows
    UNION ALL SELECT c.conv_id, r.n, {_repair_step()} FROM chosen c JOIN rows r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.n = c.n + 1
), ends AS (
    SELECT conv_id, list_sort([st[1], {{c: st[2].c + 4, a: st[2].a || 'II'}}, {{c: st[3].c + 2, a: st[3].a || 'I'}}, st[4]])[1] AS best
    FROM (SELECT conv_id, arg_max(st, n) AS st FROM chosen GROUP BY conv_id)
), edits AS (
    SELECT conv_id, i, best.a[i] AS edit, i - length(replace(best.a[:i], 'I', '')) AS inserted FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS i FROM ends)
), said AS (
    SELECT e.conv_id, e.i, e.edit, r.role, r.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.i) - max(CASE WHEN e.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS place
    FROM edits e LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND e.edit <> 'I' AND r.n = e.i - e.inserted WHERE e.edit <> 'D'
), told AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS repaired FROM said GROUP BY conv_id
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, sum(cut) AS truncated,
        count(*) FILTER (n > 1 AND NOT before || initial IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM g.conv_id"""

SQL: dict[str, str] = {"op1_minmax_dedup": _OP1, "op4_chat_format": _OP4, "op10_source_mix": _OP10, "op12_conversation_repair": _OP12, "op13_maxscore_search": _OP13}
