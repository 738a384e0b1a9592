"""The same queries as SQL for DuckDB."""

from __future__ import annotations

from ..functions import classify as K
from ..sources import catalog
from ..sources import rules as R
from . import project_sql, prompts

_TABLES = ", ".join(f"('{t}')" for t in catalog.TABLES)
_EDGES = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in catalog.EDGES)
_KEYS = " OR ".join(f"contains(lower(name), '{p}')" for p in K.KEY_PARTS)
_LINKED = ", ".join(sorted({f"('{a}', '{b}')" for a, b, *_ in catalog.EDGES} | {f"('{c}', '{d}')" for *_, c, d in catalog.EDGES}))

_COLUMNS = f"""cols AS (
    SELECT table_name AS "table", column_name AS name,
        CASE data_type WHEN 'INTEGER' THEN 'int32' WHEN 'BIGINT' THEN 'int64' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
            WHEN 'TIMESTAMP' THEN 'dateTime' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'other' END AS data_type
    FROM information_schema.columns WHERE table_name IN ({", ".join(repr(t) for t in catalog.TABLES)})
), edges(f, fc, t, tc) AS (VALUES {_EDGES})"""
_KEY = f"({_KEYS})"
_SUMMED = f"(data_type IN ('int32', 'int64', 'double') AND ((\"table\", name) NOT IN ({_LINKED})) AND NOT contains(name, 'key') AND NOT contains(name, '_id'))"
_PROFILE = _COLUMNS + f""", prof AS (
    SELECT "table", count(*) AS columns, count(*) FILTER (data_type IN ('int32', 'int64', 'double')) AS numeric_columns,
        count(*) FILTER (data_type = 'string') AS string_columns, count(*) FILTER (data_type = 'dateTime') AS date_columns,
        count(*) FILTER ({_SUMMED}) AS summed,
        (SELECT count(*) FROM edges WHERE f = "table") AS relationships_from, (SELECT count(*) FROM edges WHERE t = "table") AS relationships_to
    FROM cols GROUP BY "table"
)"""
_SCORES = _PROFILE + """, s1 AS (
    SELECT *, CASE WHEN relationships_from >= 4 THEN 50 ELSE 0 END + CASE WHEN relationships_to = 0 AND relationships_from >= 3 THEN 45 ELSE 0 END
            + CASE WHEN summed >= 3 THEN 40 ELSE 0 END + CASE WHEN numeric_columns >= 2 AND relationships_from >= 2 THEN 25 ELSE 0 END
            + CASE WHEN relationships_from >= 3 THEN 20 ELSE 0 END + CASE WHEN relationships_from >= 2 THEN 10 ELSE 0 END AS fact,
        CASE WHEN relationships_to >= 2 AND relationships_from = 0 THEN 25 ELSE 0 END + CASE WHEN date_columns >= 2 THEN 25 ELSE 0 END AS dim0,
        0 AS bridge, 0 AS calculation, CASE WHEN columns <= 3 AND relationships_from + relationships_to = 0 THEN 20 ELSE 0 END AS parameter
    FROM prof
), s2 AS (SELECT *, CASE WHEN greatest(fact, dim0, parameter) = 0 THEN 10 ELSE dim0 END AS dimension FROM s1),
classes AS (
    SELECT *, CASE WHEN fact = best THEN 'FACT' WHEN dimension = best THEN 'DIMENSION' ELSE 'PARAMETER' END AS classification,
        CASE WHEN total <= 0 THEN 0.3 ELSE round_even(greatest(0.3, least(0.98, (CASE WHEN best >= 70 THEN 0.9 WHEN best >= 50 THEN 0.8 WHEN best >= 30 THEN 0.65
            WHEN best >= 15 THEN 0.5 ELSE 0.35 END + best::DOUBLE / total) / 2)), 2) END::DOUBLE AS confidence
    FROM (SELECT *, greatest(fact, dimension, parameter) AS best, fact + dimension + parameter AS total FROM s2)
), linked AS (SELECT e.*, a.classification AS from_class, b.classification AS to_class FROM edges e LEFT JOIN classes a ON a."table" = e.f LEFT JOIN classes b ON b."table" = e.t),
topology AS (
    SELECT (SELECT count(*) FROM classes) AS n_tables, (SELECT count(*) FROM classes WHERE classification = 'FACT') AS n_facts, count(*) AS n_edges,
        count(*) FILTER ((from_class = 'FACT' AND to_class = 'DIMENSION') OR (from_class = 'DIMENSION' AND to_class = 'FACT')) AS fact_dimension,
        count(*) FILTER (from_class = 'DIMENSION' AND to_class = 'DIMENSION') AS dimension_dimension FROM linked
), typed AS (
    SELECT *, CASE WHEN n_tables = 0 THEN 'UNKNOWN' WHEN n_edges = 0 AND n_tables <= 2 THEN 'FLAT' WHEN n_edges = 0 THEN 'DISCONNECTED'
        WHEN n_facts >= 2 AND fact_dimension >= n_facts THEN 'GALAXY' WHEN dimension_dimension > 0 AND n_facts >= 1 THEN 'SNOWFLAKE'
        WHEN n_facts = 1 AND fact_dimension >= 2 THEN 'STAR' WHEN n_facts = 0 THEN 'DIMENSIONAL' ELSE 'UNKNOWN' END AS schema_type FROM topology
), lone AS (
    SELECT "table", classification FROM classes WHERE relationships_from + relationships_to = 0
), health AS (
    SELECT 'isolated_tables' AS rule, -least(25.0, round_even(30.0 * count(*) / (SELECT count(*) FROM classes), 0)) AS points, 'M001' AS code FROM lone WHERE classification NOT IN ('CALCULATION', 'PARAMETER') HAVING count(*) > 0
    UNION ALL SELECT 'clean_dimensional_model', 5.0, '-' FROM typed WHERE n_facts > 0 AND n_edges > 0
)"""
_NATION = """SELECT trim(n_name) AS "table", count(*) AS total_columns, count(o.o_custkey) AS used_columns, count(*) - count(o.o_custkey) AS unused_columns,
    round_even(count(o.o_custkey) * 100.0 / count(*), 0)::BIGINT AS usage_percentage, min(o.o_custkey::VARCHAR) AS first_used
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey GROUP BY 1"""
_USERS = f"""SELECT project, dimension, greatest(0.0, least(100.0, least(100 - 2.5 * n, CASE WHEN dimension <> 'MODEL' THEN 1000 WHEN project::BIGINT % 2 = 0 THEN {R.CEILINGS['GALAXY']} ELSE {R.CEILINGS['FLAT']} END)))::DOUBLE AS score, weight, critical, warnings, infos
    FROM (SELECT u.project, d.dimension, d.weight, count(e.user_id) AS n, count(*) FILTER (event_type = 'error') AS critical, count(*) FILTER (event_type = 'click') AS warnings, count(*) FILTER (event_type NOT IN ('error', 'click')) AS infos
        FROM (SELECT DISTINCT user_id::VARCHAR AS project FROM events) u CROSS JOIN (VALUES {", ".join(f"({i}, '{d}', {w})" for i, (d, w) in enumerate(R.WEIGHTS.items()))}) d(k, dimension, weight)
        LEFT JOIN events e ON e.user_id::VARCHAR = u.project AND e.event_id % 4 = d.k GROUP BY ALL)"""
_SPACES = r"[\s\v\x{85}\p{Z}]+"


def _keywords(column: str, then: dict[str, str], other: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {w!r})' for w in words)} THEN {then[kind]}" for kind, words in K.KEYWORDS.items())
    return f"CASE {cases} WHEN contains(lower({column}), 'database') THEN {then['Database']} ELSE {other} END"


def _depth(column: str) -> str:
    """Deepest nesting, never below zero: a running sum less its running minimum."""
    return f"""SELECT doc_id, coalesce(max(run - least(low, 0)), 0)::BIGINT AS depth FROM (
        SELECT doc_id, run, min(run) OVER (PARTITION BY doc_id ORDER BY i) AS low FROM (
            SELECT doc_id, i, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
                SELECT doc_id, unnest(string_split(p, '')) AS c, generate_subscripts(string_split(p, ''), 1) AS i
                FROM (SELECT doc_id, regexp_replace({column}, '[^()]', '', 'g') AS p FROM documents)) WHERE c IN ('(', ')'))) GROUP BY doc_id"""


SQL: dict[str, str] = {
    "catalog_columns": f"""WITH {_COLUMNS} SELECT "table", name, data_type, {_KEY} AS is_key, CASE WHEN {_KEY} THEN 'KEY'
        WHEN lower(data_type) = 'datetime' OR contains(lower(name), 'date') OR contains(lower(name), 'fecha') THEN 'DATE'
        WHEN data_type IN ('int32', 'int64', 'double') THEN 'NUMERIC' ELSE 'ATTRIBUTE' END AS role FROM cols""",
    "datatype_histogram": f"""WITH {_COLUMNS} SELECT CASE WHEN data_type = 'string' THEN 'Text' WHEN data_type = 'int64' THEN 'Whole Number' WHEN data_type = 'double' THEN 'Decimal Number'
        WHEN data_type = 'dateTime' THEN CASE WHEN contains(lower(name), 'date') THEN 'Date' ELSE 'DateTime' END
        WHEN regexp_matches(lower(name), 'amt|amount|qty|quantity|count|total') THEN 'Whole Number' WHEN regexp_matches(lower(name), 'price|rate|pct|percent') THEN 'Decimal Number'
        WHEN regexp_matches(lower(name), 'date|fecha|posting|month|day') THEN 'Date' ELSE 'Other (' || data_type || ')' END AS display_type, count(*) AS n FROM cols GROUP BY 1""",
    "table_profile": f"""WITH {_PROFILE} SELECT "table", columns, numeric_columns, string_columns, date_columns, relationships_from, relationships_to, relationships_from + relationships_to = 0 AS is_isolated,
        round_even(numeric_columns::DOUBLE / columns, 4) AS numeric_ratio, round_even(string_columns::DOUBLE / columns, 4) AS string_ratio FROM prof""",
    "table_classification": f"""WITH {_SCORES} SELECT "table", classification, confidence, fact::BIGINT AS fact, dimension::BIGINT AS dimension, bridge::BIGINT AS bridge, calculation::BIGINT AS calculation, parameter::BIGINT AS parameter FROM classes""",
    "schema_type": f"WITH {_SCORES} SELECT n_tables, n_facts, n_edges, fact_dimension, dimension_dimension, schema_type FROM typed",
    "connected_components": f"""WITH RECURSIVE {_COLUMNS}, both_ways AS (SELECT f AS a, t AS b FROM edges UNION SELECT t, f FROM edges),
        reach(a, b) AS (SELECT DISTINCT "table", "table" FROM cols UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b) SELECT a AS "table", min(b) AS component FROM reach GROUP BY a""",
    "isolated_tables": f"WITH {_SCORES} SELECT \"table\" FROM lone WHERE classification NOT IN ('CALCULATION', 'PARAMETER')",
    "shared_dimensions": f"""WITH {_SCORES} SELECT dimension, count(*) AS n_edges FROM (SELECT CASE WHEN from_class = 'FACT' AND to_class = 'DIMENSION' THEN t WHEN from_class = 'DIMENSION' AND to_class = 'FACT' THEN f END AS dimension FROM linked)
        WHERE dimension IS NOT NULL GROUP BY dimension HAVING count(*) >= 2""",
    "model_health": f"WITH {_SCORES} SELECT rule, points::DOUBLE AS points, code FROM health",
    "grade": f"""WITH {_SCORES}, m AS (SELECT greatest(0, least(least(100, 90), 100 + sum(points))) AS score FROM health)
        SELECT round_even(score * 0.35 + 100 * 0.65, 0)::INTEGER AS global_score, CASE WHEN score * 0.35 + 65 >= 85 THEN 'A' WHEN score * 0.35 + 65 >= 75 THEN 'B' ELSE 'C' END AS grade FROM m""",
    "complexity_heatmap": f"""WITH {_PROFILE}, h AS (SELECT "table", least(columns / 5.0, 10.0)::DOUBLE AS column_metric, 0.0::DOUBLE AS measure_metric, least((relationships_from + relationships_to) * 2.0, 10.0)::DOUBLE AS relationship_metric FROM prof)
        SELECT * FROM (SELECT *, row_number() OVER (ORDER BY column_metric + relationship_metric DESC, "table")::INTEGER AS rank FROM h) WHERE rank <= 15""",
    "class_share": f"WITH {_SCORES} SELECT classification, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM classes GROUP BY classification",
    "hub_suppliers": "SELECT l_suppkey, count(*) AS degree FROM lineitem GROUP BY l_suppkey ORDER BY degree DESC, l_suppkey LIMIT 5",
    "unused_orders": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "orphan_edges": " UNION ALL ".join(f"SELECT '{a}.{b}' AS edge, count(*) AS orphans FROM {a} x WHERE NOT EXISTS (SELECT 1 FROM {c} y WHERE y.{d} = x.{b})" for a, b, c, d in catalog.EDGES),
    "usage_by_nation": _NATION,
    "usage_summary": f"SELECT sum(total_columns)::BIGINT AS total_columns, sum(used_columns)::BIGINT AS used_columns, sum(unused_columns)::BIGINT AS total_unused, count(*) FILTER (usage_percentage = 100) AS tables_with_full_usage, round_even(avg(usage_percentage), 1)::DOUBLE AS average_table_usage_percentage FROM ({_NATION})",
    "dedup_first_wins": "SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order, count(*) AS occurrences, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2",
    "source_id_hash": "SELECT p_partkey, substr(md5(p_name || '|' || p_brand || '|' || p_type), 1, 12) AS source_id FROM part",
    "capped_penalty": "SELECT c_custkey, least(15.0, n * 2.0)::DOUBLE AS points, greatest(0.0, least(100.0, 100.0 - n * 7))::DOUBLE AS score FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)",
    "grade_buckets": "SELECT CASE WHEN s >= 85 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 45 THEN 'D' ELSE 'F' END AS grade, count(*) AS n FROM (SELECT greatest(0, least(100, c_acctbal / 100)) AS s FROM customer) GROUP BY 1",
    "severity_rollup": f"SELECT project, dimension, score, round_even(score * weight, 2)::DOUBLE AS weighted, critical, warnings, infos FROM ({_USERS})",
    "project_grades": f"""SELECT project, global_score, CASE WHEN global_score >= 85 THEN 'A' WHEN global_score >= 75 THEN 'B' WHEN global_score >= 60 THEN 'C' WHEN global_score >= 45 THEN 'D' ELSE 'F' END AS grade,
        CASE WHEN global_score >= 90 THEN 'excellent' WHEN global_score >= 75 THEN 'good' WHEN global_score >= 60 THEN 'fair' WHEN global_score >= 40 THEN 'poor' ELSE 'critical' END AS status, critical, warnings, infos
        FROM (SELECT project, round_even(sum(round_even(score * weight, 2)::DECIMAL(12, 4))::DOUBLE, 0)::INTEGER AS global_score, sum(critical)::BIGINT AS critical, sum(warnings)::BIGINT AS warnings, sum(infos)::BIGINT AS infos FROM ({_USERS}) GROUP BY project)""",
    "issue_codes": "SELECT event_id, user_id, printf('E%03d', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS code FROM events WHERE event_type = 'error'",
    "first_k_affected": "SELECT c_nationkey, array_to_string(names[1:3], ', ') AS first, greatest(len(names) - 3, 0)::BIGINT AS more FROM (SELECT c_nationkey, list_sort(list(DISTINCT c_name)) AS names FROM customer GROUP BY c_nationkey)",
    "cross_refs": "WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT a.l_suppkey, b.l_suppkey AS other, count(*) AS shared_parts FROM p a JOIN p b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2",
    "related_codes": """WITH i AS (SELECT DISTINCT (o_custkey % 100)::VARCHAR AS project, o_orderstatus AS severity, 'D' || o_orderkey AS code, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
        p AS (SELECT DISTINCT a.project, a.code, b.code AS other FROM i a JOIN i b ON a.project = b.project AND a.severity = b.severity AND a.l_partkey = b.l_partkey AND a.code <> b.code)
        SELECT project, code, string_agg(other, ',' ORDER BY other) AS related FROM p GROUP BY 1, 2""",
    "name_tokens": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '[ \\t_\\-.]+')) AS token FROM part) WHERE token <> '' GROUP BY token",
    "keyword_class": "SELECT page_id, " + _keywords("url", {k: f"'{k}'" for k in (*K.KEYWORDS, "Database")}, "'Other'") + " AS family, (" + _keywords("url", {**{k: "0.70" for k in K.KEYWORDS}, "Database": "0.55"}, "0.30") + ")::DOUBLE AS confidence FROM pages",
    "url_domain": "SELECT nullif(lower(regexp_extract(url, '(?i)https?://([^/]+)', 1)), '') AS host, count(*) AS n, count(*) FILTER (regexp_matches(url, '\\.[A-Za-z0-9]+$')) AS with_suffix FROM pages GROUP BY 1",
    "text_preview": f"SELECT doc_id, CASE WHEN length(f) > 300 THEN left(f, 300) || '...' ELSE f END AS preview FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g'), ' ') AS f FROM documents)",
    "paren_depth": "SELECT doc_id, coalesce(depth, 0) AS depth FROM documents LEFT JOIN (" + _depth("text") + ") USING (doc_id)",
    "token_usage_topk": f"""SELECT project, token, n, rank FROM (SELECT role AS project, token, count(*) AS n, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, token) AS rank
        FROM conversations, (VALUES {", ".join(f"('{t}')" for t in prompts.TOKENS)}) t(token) WHERE contains(upper(text), token) GROUP BY role, token) WHERE rank <= 8""",
    "property_extract": """SELECT p_partkey, p_name AS name, p_brand AS brand, p_type AS kind, p_partkey % 3 = 0 AS hidden, NULL::VARCHAR AS "none", 'second' AS last_name, 'x' AS size FROM part""",
    "quoted_values": """SELECT page_id, len(v)::BIGINT AS n, v[1] AS first, v[-1] AS last FROM (SELECT page_id, list_concat(regexp_extract_all(html, '"([^"]*)"', 1), regexp_extract_all(html, chr(39) || '([^' || chr(39) || ']*)' || chr(39), 1)) AS v FROM pages)""",
    "block_split": """SELECT doc_id, block_no::BIGINT AS block_no, min(i)::BIGINT AS start_line, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (
        SELECT doc_id, i, line, sum(CASE WHEN regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block_no FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) GROUP BY 1, 2""",
    "json_props": "SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "stub_docs": "SELECT lang, count(*) FILTER (length(trim(text)) < 5) AS stubs, count(*) FILTER (length(text) < 100) AS short, count(*) AS total FROM documents GROUP BY lang",
    "label_join_stats": "SELECT lang, count(*) AS total, count(quality) AS labelled, round_even(sum(quality)::DOUBLE / count(quality), 4) AS good_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "category_pivot": """SELECT *, CASE WHEN greatest(click, view, purchase) = 0 THEN 'NONE' WHEN click = greatest(click, view, purchase) THEN 'CHART' WHEN view = greatest(click, view, purchase) THEN 'TABLE' ELSE 'CARD' END AS dominant
        FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id)""",
    "share_of_total": "SELECT o_orderstatus, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM orders GROUP BY 1",
    "set_algebra": """SELECT 'c' || c_custkey AS name, risk AS cleanup_risk, CASE risk WHEN 'SAFE_DELETE' THEN 'Stub or no logic' WHEN 'DO_NOT_DELETE' THEN 'Base measure: may be used elsewhere' WHEN 'INVESTIGATE' THEN 'Complex and unreferenced' ELSE 'Unreferenced: review' END AS reason
        FROM (SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'SAFE_DELETE' WHEN c_mktsegment = 'BUILDING' THEN 'DO_NOT_DELETE' WHEN c_acctbal / 500 > 10 THEN 'INVESTIGATE' ELSE 'REVIEW_SUGGESTED' END AS risk FROM customer
            WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase'))""",
}

SQL |= project_sql.SQL
