"""The queries on definition and report files as SQL over the text that is written from the tables: lines, objects, relations, findings and scores, computed by DuckDB."""

from __future__ import annotations

from ..functions import classify as K
from ..functions import dax
from ..operators import blocks, extract
from ..sources import rules as R
from . import row_projects, svg


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _list(items: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(_text, items)) + ")"


def _has(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_text(p)})" for p in parts) + ")"


def _bare(x: str) -> str:
    """Trimmed, without the quotes that enclose it."""
    t = f"trim({x}, ' ' || chr(9) || chr(13) || chr(10))"
    return f"regexp_replace(regexp_replace({t}, '(?s)^''(.*)''$', '\\1'), '(?s)^\"(.*)\"$', '\\1')"


def _property(block: str, key: str) -> str:
    return f"nullif(trim({_bare(f'regexp_extract({block}, {_text(f"(?m)^[ \t]*{key}:[ \t]*(\\S.*?)[ \t\r]*$")}, 1)')}), '')"


def _flag(block: str, key: str) -> str:
    there, value = _text(rf"(?m)^[ \t]*{key}[ \t]*(:|\r?$)"), _text(rf"(?m)^[ \t]*{key}[ \t]*(?::[ \t]*(\w+))?[ \t\r]*$")
    return f"(regexp_matches({block}, {there}) AND lower(regexp_extract({block}, {value}, 1)) IN ('true', ''))"


def _calls(e: str, name: str) -> str:
    return f"len(regexp_extract_all(upper({e}), {_text(rf'\b{name.replace(".", r"\.")}\s*\(')}))"


_FILE = "project, rel_path, file_stem"
_SPACES = r"'[\s\v\x{85}\p{Z}]+'"
_OBJECTS = f"""{row_projects.duck_files()},
own AS (SELECT * FROM files WHERE NOT regexp_matches(file_stem, '^(DateTableTemplate_|LocalDateTable_)')),
ls AS (SELECT {_FILE}, i, line, trim(line, ' ' || chr(9)) AS t, length(replace(regexp_extract(line, '^[ \\t]*'), chr(9), '    ')) AS ind
    FROM (SELECT *, unnest(string_split(rtrim(content, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(content, chr(10)), chr(10)), 1) AS i FROM own)),
openers AS (SELECT *, regexp_extract(t, '^([A-Za-z]+) ', 1) AS kind FROM ls WHERE regexp_matches(t, '^({"|".join(blocks.KEYWORDS)}) ')),
bounds AS (SELECT o.project, o.rel_path, o.file_stem, o.kind, trim(substr(o.t, length(o.kind) + 2)) AS header, o.i AS line, coalesce(min(e.i), 1000000) AS stop
    FROM openers o LEFT JOIN openers e ON e.project = o.project AND e.rel_path = o.rel_path AND e.i > o.i AND e.ind <= o.ind GROUP BY ALL),
objects AS MATERIALIZED (SELECT b.*, coalesce(string_agg(l.line, chr(10) ORDER BY l.i), '') AS block
    FROM bounds b LEFT JOIN ls l ON l.project = b.project AND l.rel_path = b.rel_path AND l.i > b.line AND l.i < b.stop GROUP BY ALL)"""

_INLINE = "CASE WHEN contains(header, '=') THEN trim(substr(header, strpos(header, '=') + 1)) ELSE '' END"
_NAME = _bare("split_part(header, '=', 1)")
_KEY = _has("lower(concat_ws(' ', name, source_column))", K.KEY_PARTS)
_COLUMNS = f"""{_OBJECTS}, cols0 AS MATERIALIZED (
    SELECT project, file_stem AS "table", {_NAME} AS name, coalesce({_property("block", "dataType")}, 'string') AS data_type,
        trim(replace(coalesce(nullif({_INLINE}, ''), nullif(regexp_extract(block, '(?s)```(.*?)```', 1), ''), {_property("block", "expression")}), '```', ''), ' ' || chr(9) || chr(10)) AS expression,
        {_property("block", "sourceColumn")} AS source_column, {_property("block", "dataCategory")} AS category, coalesce({_property("block", "summarizeBy")}, 'none') AS summarize_by, {_flag("block", "isHidden")} AS is_hidden, block, line
    FROM objects WHERE kind = 'column'),
cols AS MATERIALIZED (SELECT *, nullif(expression, '') IS NOT NULL AS is_calculated, {_KEY} AS is_key,
    CASE WHEN {_KEY} THEN 'KEY' WHEN lower(data_type) IN ('datetime', 'date') OR {_has("lower(name)", K.DATE_WORDS)} THEN 'DATE' WHEN lower(data_type) IN {_list(K.NUMERIC_TYPES)} THEN 'NUMERIC'
        WHEN coalesce(lower(category) IN {_list(K.GEOGRAPHY)}, FALSE) THEN 'GEOGRAPHY' WHEN {_has("lower(name)", K.TEXT_WORDS)} THEN 'ATTRIBUTE' WHEN lower(data_type) = 'boolean' THEN 'FLAG' ELSE 'ATTRIBUTE' END AS semantic_role FROM cols0)"""

_ENDS = "|".join(blocks.MEASURE_KEYS)
_DEPTH = """(SELECT coalesce(max(run - least(low, 0)), 0) FROM (SELECT run, min(run) OVER (ORDER BY k) AS low FROM (
    SELECT k, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER (ORDER BY k) AS run FROM (SELECT unnest(string_split(regexp_replace(m.expression, '[^()]', '', 'g'), '')) AS c, generate_subscripts(string_split(regexp_replace(m.expression, '[^()]', '', 'g'), ''), 1) AS k) WHERE c <> '')))"""
_VARS = "len(regexp_extract_all(upper(m.expression), '\\bVAR\\b'))"
_COMPLEXITY = f"""coalesce(round_even({" + ".join(f"{_calls('m.expression', f)} * {w}" for f, w in dax.FUNCTIONS.items())} + {_DEPTH} * 0.5::DOUBLE + {_VARS} * 1.5::DOUBLE + least(log10(greatest(length(m.expression), 1)), 3.0::DOUBLE), 2), 0)::DOUBLE"""
_MEASURES = f"""{_COLUMNS}, m0 AS MATERIALIZED (
    SELECT project, file_stem AS "table", {_NAME} AS name, line, block,
        CASE WHEN contains({_INLINE}, '```') OR ({_INLINE} = '' AND starts_with(ltrim(block, ' ' || chr(9) || chr(10)), '```')) THEN split_part({_INLINE} || chr(10) || block, '```', 2)
            WHEN {_INLINE} <> '' THEN {_INLINE} WHEN NOT contains(header, '=') THEN NULL
            ELSE regexp_extract(chr(10) || block || chr(10), '(?s)^(.*?)(?:\\n[ \\t]*(?:{_ENDS})(?:[: ][^\\n]*)?\\n|\\z)', 1) END AS body,
        {_property("block", "formatString")} AS format_string, {_property("block", "description")} AS description, {_property("block", "displayFolder")} AS display_folder, ({_flag("block", "hidden")} OR {_flag("block", "isHidden")}) AS is_hidden
    FROM objects WHERE kind = 'measure'),
m1 AS MATERIALIZED (SELECT *, nullif(trim(regexp_replace(replace(body, '```', ' '), {_SPACES}, ' ', 'g')), '') AS expression, len(regexp_extract_all(trim(coalesce(body, ''), ' ' || chr(9) || chr(10)), '\\n')) AS line_breaks FROM m0),
meas AS MATERIALIZED (SELECT *, {_COMPLEXITY} AS complexity_score,
    coalesce(length(trim(expression)) < 5, TRUE) AS is_stub, coalesce({_DEPTH}, 0) AS depth, coalesce({_VARS}, 0) AS vars,
    list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(expression, ''), '\\[([^\\]]+)\\]', 1), lambda x: trim(x)))) AS bracketed,
    list_filter(list_distinct(list_transform(regexp_extract_all(' ' || coalesce(expression, ''), '[^\\w'']\\[([^\\]]+)\\]', 1), lambda x: trim(x))), lambda x: x <> name) AS candidates FROM m1 m)"""

_FINDINGS = f"""{_MEASURES}, found AS MATERIALIZED (
    SELECT project, name, 'DAX001' AS code, 'HIGH' AS severity, len(regexp_extract_all(upper(expression), {_text(dax.FILTER_OF_TABLE)})) AS occurrences FROM meas
    UNION ALL SELECT project, name, 'DAX002', 'HIGH', CASE WHEN {" OR ".join(f"regexp_matches(upper(expression), {_text(rf'{i}\s*\([^()]*{i}\s*\(')})" for i in dax.ITERATORS)} THEN 1 ELSE 0 END FROM meas
    UNION ALL SELECT project, name, 'DAX003', 'MEDIUM', CASE WHEN (length(expression) > 200 OR len(regexp_extract_all(expression, '\\(')) > 5) AND vars = 0 THEN 1 ELSE 0 END FROM meas
    UNION ALL SELECT project, name, 'DAX004', 'MEDIUM', CASE WHEN len(regexp_extract_all(upper(expression), {_text(dax.IF_CALL)})) >= 3 THEN len(regexp_extract_all(upper(expression), {_text(dax.IF_CALL)})) ELSE 0 END FROM meas
    UNION ALL SELECT project, name, 'DAX005', 'LOW', CASE WHEN NOT contains(upper(expression), 'DIVIDE') THEN len(regexp_extract_all(expression, {_text(dax.DIVISION)})) ELSE 0 END FROM meas)"""

_PARTITIONS = f"""parts AS (SELECT project, file_stem AS "table", {_NAME} AS name, {_property("block", "mode")} AS mode, contains(lower(block), 'let') AND contains(lower(block), 'in') AS has_m_expression, contains(upper(block), 'DATATABLE') AS has_datatable,
    CASE WHEN contains(upper(block), 'DATATABLE') THEN 'DATATABLE' WHEN contains(upper(block), 'SQL') THEN 'SQL' WHEN {_has("lower(block)", K.EXCEL_WORDS)} THEN 'Excel' WHEN {_has("lower(block)", K.CSV_WORDS)} THEN 'CSV/Text'
        WHEN contains(upper(block), 'SHAREPOINT') THEN 'SharePoint' WHEN {_has("lower(block)", K.WEB_WORDS)} THEN 'Web' WHEN contains(lower(block), 'let') AND contains(lower(block), 'in') THEN 'Power Query' ELSE 'Unknown' END AS source_type
    FROM objects WHERE kind = 'partition')"""
_TABLES = f"""{_MEASURES}, {_PARTITIONS}, tabs0 AS MATERIALIZED (
    SELECT f.project, f.file_stem AS "table", f.rel_path AS file, length(content) AS raw_size_chars, contains(upper(content), 'DATATABLE') AS has_datatable, {_has("upper(content)", K.CALCULATED_SIGNALS)} AS calculated,
        {_flag("regexp_extract(content, '(?s)^(.*?)(?:\\n[ \\t]+(?:column|measure|partition|hierarchy)[ ]|\\z)', 1)", "isHidden")} AS is_hidden,
        (SELECT count(*) FROM cols c WHERE c.project = f.project AND c."table" = f.file_stem) AS column_count, (SELECT count(*) FROM cols c WHERE c.project = f.project AND c."table" = f.file_stem AND c.is_hidden) AS hidden_column_count,
        (SELECT count(*) FROM cols c WHERE c.project = f.project AND c."table" = f.file_stem AND c.is_calculated) AS calculated_column_count, (SELECT count(*) FROM cols c WHERE c.project = f.project AND c."table" = f.file_stem AND c.is_key) AS key_like_column_count,
        (SELECT count(*) FROM meas c WHERE c.project = f.project AND c."table" = f.file_stem) AS measure_count, (SELECT count(*) FROM parts c WHERE c.project = f.project AND c."table" = f.file_stem) AS partition_count,
        coalesce((SELECT string_agg(data_type || '=' || n, ',' ORDER BY data_type) FROM (SELECT data_type, count(*) AS n FROM cols c WHERE c.project = f.project AND c."table" = f.file_stem GROUP BY 1)), '') AS types
    FROM own f WHERE starts_with(rel_path, 'tables/')),
tabs AS MATERIALIZED (SELECT *, CASE WHEN measure_count > 0 AND column_count <= 1 THEN 'CALCULATION' WHEN {_has('lower("table")', K.CALCULATION_WORDS)} AND measure_count > 0 THEN 'CALCULATION' WHEN has_datatable AND column_count <= 5 THEN 'PARAMETER'
    WHEN {_has('lower("table")', K.PARAMETER_WORDS)} THEN 'PARAMETER' WHEN calculated THEN 'CALCULATED_TABLE' WHEN partition_count > 0 THEN 'MODEL_TABLE' ELSE 'UNKNOWN' END AS table_kind FROM tabs0)"""


_PAIRS = {"f": "fromColumn", "t": "toColumn", "fc": "fromCardinality", "tc": "toCardinality", "cf": "crossFilteringBehavior", "ia": "isActive"}


def _cardinality(x: str, default: str) -> str:
    return f"CASE WHEN lower({x}) IN ('one', '1') THEN 'one' WHEN lower({x}) IN ('many', '*') THEN 'many' ELSE coalesce(lower({x}), '{default}') END"


def _table_of(x: str) -> str:
    """The table of a reference ``T[C]``, ``'T'.C`` or ``T.C``."""
    bracket, quoted = f"regexp_extract({x}, '^\\s*(.+?)\\s*\\[[^\\]]*\\]\\s*$', 1)", f"regexp_extract({x}, '^\\s*''([^'']+)''\\s*\\.', 1)"
    return f"coalesce(nullif({bracket}, ''), nullif({quoted}, ''), regexp_extract({x}, '^(.*)\\.[^.]*$', 1))"


def _column_of(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '\\[([^\\]]*)\\]\\s*$', 1), ''), regexp_extract({x}, '\\.([^.]*)$', 1))"


_EDGES = f"""pairs AS MATERIALIZED (SELECT project, {_bare("header")} AS id, {", ".join(f"{_property('block', key)} AS {name}" for name, key in _PAIRS.items())} FROM objects WHERE kind = 'relationship'),
parts_of AS MATERIALIZED (SELECT *, {_table_of("f")} AS ft, {_column_of("f")} AS fk, {_table_of("t")} AS tt, {_column_of("t")} AS tk FROM pairs),
edges0 AS MATERIALIZED (SELECT project, id, nullif({_bare("ft")}, '') AS from_table, nullif({_bare("fk")}, '') AS from_column, nullif({_bare("tt")}, '') AS to_table, nullif({_bare("tk")}, '') AS to_column, {_cardinality("fc", "many")} AS a, {_cardinality("tc", "one")} AS b,
    CASE WHEN lower(cf) IN ('bothdirections', 'both') THEN 'Both' ELSE 'Single' END AS cross_filter_direction, coalesce(lower(ia) = 'true', TRUE) AS is_active FROM parts_of),
edges AS MATERIALIZED (SELECT *, CASE a WHEN 'many' THEN 'Many' ELSE 'One' END || '-to-' || CASE b WHEN 'many' THEN 'Many' ELSE 'One' END AS cardinality,
    concat_ws(',', CASE WHEN a = 'many' AND b = 'many' THEN 'MANY_TO_MANY' END, CASE WHEN cross_filter_direction = 'Both' THEN 'BIDIRECTIONAL_FILTERING' END, CASE WHEN NOT is_active THEN 'INACTIVE_RELATIONSHIP' END, CASE WHEN a = 'one' AND b = 'one' THEN 'ONE_TO_ONE' END) AS flags
    FROM edges0 WHERE from_table IS NOT NULL AND from_column IS NOT NULL AND to_table IS NOT NULL AND to_column IS NOT NULL)"""

_CALL = extract._CALL
_NO_CALL = r"^\s*source\s*=\s*[^(]*$"
_TYPE = "CASE " + " ".join(f"WHEN lower(connector) IN {_list(tuple(n.lower() for n in names))} THEN '{kind}'" for kind, names in K.CONNECTORS.items())
_TYPE += " " + " ".join(f"WHEN {_has('said', words)} THEN '{kind}'" for kind, words in K.KEYWORDS.items()) + " WHEN contains(said, 'database') THEN 'Database' ELSE 'Other' END"
_KNOWN = _list(tuple(n.lower() for names in K.CONNECTORS.values() for n in names))
_BY_WORD = "CASE " + " ".join(f"WHEN {_has('said', words)} THEN 0.70" for words in K.KEYWORDS.values()) + " WHEN contains(said, 'database') THEN 0.55 ELSE 0.30 END"
_VALUES = "list_concat(regexp_extract_all(args, '\"([^\"]*)\"', 1), regexp_extract_all(args, chr(39) || '([^' || chr(39) || ']*)' || chr(39), 1))"
_SOURCES = f"""{row_projects.duck_files()},
src AS (SELECT * FROM files WHERE file_stem IN ('model', 'expressions', 'database') OR starts_with(rel_path, 'tables/')),
calls AS MATERIALIZED (SELECT project, rel_path, unnest(regexp_extract_all(content, {_text(_CALL)}, 1)) AS connector, unnest(regexp_extract_all(content, {_text(_CALL)}, 2)) AS args, unnest(range(len(regexp_extract_all(content, {_text(_CALL)}, 1)))) AS place FROM src
    UNION ALL SELECT project, rel_path, 'source_assignment', trim(regexp_replace(line, '(?i)^\\s*source\\s*=', '')), 1000000 + i FROM (SELECT project, rel_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM src)
        WHERE regexp_matches(line, '(?i)^\\s*source\\s*=') AND NOT regexp_matches(line, '[A-Za-z0-9_]+\\.[A-Za-z0-9_]+\\s*\\(')),
typed AS MATERIALIZED (SELECT *, {_TYPE} AS type, CASE WHEN lower(connector) IN {_KNOWN} THEN 0.95 ELSE {_BY_WORD} END AS confidence, {_VALUES} AS v FROM (SELECT *, lower(connector || ' ' || args) AS said FROM calls)),
facts AS MATERIALIZED (SELECT *, CASE WHEN lower(connector) IN {_list(extract.DATABASE_CALLS)} THEN v[1] END AS server, CASE WHEN lower(connector) IN {_list(extract.DATABASE_CALLS)} THEN v[2] END AS database,
    CASE WHEN lower(connector) IN {_list(extract.WEB_CALLS)} THEN v[1] END AS url, CASE WHEN lower(connector) IN {_list(extract.WEB_CALLS)} THEN nullif(lower(regexp_extract(v[1], '(?i)https?://([^/]+)', 1)), '') END AS domain,
    CASE WHEN lower(connector) IN {_list(extract.PATH_CALLS)} THEN v[1] END AS path FROM typed WHERE type <> 'Other'),
sources AS MATERIALIZED (SELECT project, arg_min(type, (rel_path, place)) AS type, arg_min(connector, (rel_path, place)) AS connector, max(confidence)::DOUBLE AS confidence, count(*) AS occurrences, arg_min_null(server, (rel_path, place)) AS server,
    arg_min_null(database, (rel_path, place)) AS database, arg_min_null(url, (rel_path, place)) AS url, arg_min_null(domain, (rel_path, place)) AS domain, arg_min_null(path, (rel_path, place)) AS path
    FROM facts GROUP BY project, lower(concat_ws('|', type, connector, coalesce(server, ''), coalesce(database, ''), coalesce(url, ''), coalesce(domain, ''), coalesce(path, ''))))"""

_ROLES = ("Values", "Rows", "Columns", "Category")


def _refs(role: str) -> str:
    return f"coalesce(list_filter(json_extract_string(j, '$.visual.query.queryState.{role}.projections[*].nativeQueryRef'), lambda x: x IS NOT NULL), [])"


_CATEGORY = "CASE " + " ".join(f"WHEN visual_type IN {_list(names)} THEN '{kind}'" for kind, names in K.VISUALS.items()) + " ELSE 'OTHER' END"
_VISUALS = f"""{row_projects.duck_report()},
vis0 AS MATERIALIZED (SELECT project, page_id, visual_id, json_extract_string(j, '$.visual.visualType') AS visual_type, coalesce(json_extract_string(j, '$.isHidden') = 'true', FALSE) AS is_hidden, {", ".join(f"{_refs(r)} AS r{i}" for i, r in enumerate(_ROLES))}
    FROM (SELECT *, CASE WHEN json_valid(content) THEN content::JSON END AS j FROM report WHERE visual_id IS NOT NULL)),
vis1 AS MATERIALIZED (SELECT *, CASE WHEN visual_type IS NOT NULL THEN {_CATEGORY} END AS category FROM vis0),
vis AS MATERIALIZED (SELECT *, CASE WHEN category = 'TABLE' THEN list_concat(r1, r2, r0, r3) ELSE list_concat(r0, r1, r2, r3) END AS raw FROM vis1),
vis_fields AS MATERIALIZED (SELECT project, page_id, visual_id, field, min(k) AS k FROM (SELECT project, page_id, visual_id, unnest(raw) AS field, generate_subscripts(raw, 1) AS k FROM vis) WHERE field <> '' GROUP BY ALL),
shown AS (SELECT DISTINCT project, unnest([field, coalesce(nullif(regexp_extract(field, '\\[([^\\]]+)\\]', 1), ''), regexp_replace(field, '^.*\\.', ''))]) AS name FROM vis_fields),
page_names AS (SELECT project, page_id, json_extract_string(content::JSON, '$.displayName') AS display_name FROM report WHERE visual_id IS NULL AND page_id IS NOT NULL),
page_list AS (SELECT DISTINCT project, page_id FROM (SELECT project, unnest(coalesce(nullif(json_extract_string(content::JSON, '$.pageOrder[*]'), []), list_transform(json_extract(content::JSON, '$[*]'), lambda x: coalesce(json_extract_string(x, '$.id'), json_extract_string(x, '$.name'))))) AS page_id FROM report WHERE page_id IS NULL
    UNION ALL SELECT project, page_id FROM report WHERE page_id IS NOT NULL)),
pages AS MATERIALIZED (SELECT l.project, l.page_id, coalesce(any_value(n.display_name), l.page_id) AS display_name, count(v.visual_id) AS visuals_count, {", ".join(f"count(*) FILTER (v.category = '{c}') AS {c.lower()}_count" for c in ("CHART", "TABLE", "CARD", "SLICER", "BUTTON", "TEXT", "OTHER"))}, count(*) FILTER (v.is_hidden) AS hidden_count
    FROM page_list l LEFT JOIN page_names n ON n.project = l.project AND n.page_id = l.page_id LEFT JOIN vis v ON v.project = l.project AND v.page_id = l.page_id GROUP BY l.project, l.page_id)"""

_GRAPH = f"""{_MEASURES}, deps AS MATERIALIZED (SELECT DISTINCT c.project, c.name, c.dependency FROM (SELECT project, name, unnest(candidates) AS dependency FROM meas) c
    WHERE EXISTS (SELECT 1 FROM meas m WHERE m.project = c.project AND m.name = c.dependency) AND NOT EXISTS (SELECT 1 FROM cols k WHERE k.project = c.project AND k.name = c.dependency)),
walk AS (SELECT project, name, dependency AS at, [name, dependency] AS path, 1 AS steps, name = dependency AS stop FROM deps
    UNION ALL SELECT w.project, w.name, d.dependency, list_append(w.path, d.dependency), w.steps + 1, list_contains(w.path, d.dependency) FROM walk w JOIN deps d ON d.project = w.project AND d.name = w.at WHERE NOT w.stop),
graph AS MATERIALIZED (SELECT m.*, coalesce((SELECT max(steps) FROM walk w WHERE w.project = m.project AND w.name = m.name), 0) AS dependency_depth, (SELECT count(*) FROM deps d WHERE d.project = m.project AND d.dependency = m.name) AS dependents,
    NOT EXISTS (SELECT 1 FROM deps d WHERE d.project = m.project AND d.name = m.name) AS base FROM meas m)"""
_RISK = "CASE WHEN is_stub OR complexity_score = 0 THEN 'SAFE_DELETE' WHEN base THEN 'DO_NOT_DELETE' WHEN complexity_score > 10 THEN 'INVESTIGATE' ELSE 'REVIEW_SUGGESTED' END"
_UNUSED = f"""{_GRAPH}, {_VISUALS}, unused AS MATERIALIZED (SELECT *, {_RISK} AS cleanup_risk FROM graph g
    WHERE NOT EXISTS (SELECT 1 FROM deps d WHERE d.project = g.project AND d.dependency = g.name AND d.name <> d.dependency) AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.project = g.project AND s.name = g.name))"""
_USAGE = f"""{_MEASURES}, {_VISUALS}, used AS (SELECT project, name FROM (SELECT project, unnest(bracketed) AS name FROM meas) b WHERE NOT EXISTS (SELECT 1 FROM meas m WHERE m.project = b.project AND m.name = b.name) UNION SELECT project, name FROM shown),
hits AS MATERIALIZED (SELECT DISTINCT c.project, c."table", c.name, EXISTS (SELECT 1 FROM used u WHERE u.project = c.project AND u.name = c.name) AS hit FROM cols c),
usage AS MATERIALIZED (SELECT project, "table", count(*) AS total_columns, count(*) FILTER (hit) AS used_columns, count(*) FILTER (NOT hit) AS unused_columns, round_even(count(*) FILTER (hit) * 100.0 / count(*), 0) AS usage_percentage,
    coalesce(string_agg(name, ',' ORDER BY name) FILTER (hit), '') AS used, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT hit), '') AS unused FROM hits GROUP BY 1, 2)"""

_N = "numeric_columns"
_NAMED = {cls: f"CASE WHEN len(list_intersect(words, [{', '.join(map(_text, words))}])) > 0 THEN {points} ELSE 0 END" for cls, (words, points) in K.NAME_WORDS.items()}
_CLASSES = f"""{_TABLES}, {_EDGES}, prof AS MATERIALIZED (
    SELECT t.project, t."table", t.column_count AS columns, t.measure_count AS measures, t.has_datatable, t.calculated_column_count AS calculated_columns, list_filter(regexp_split_to_array(lower(t."table"), '[\\s_\\-\\.]+'), lambda x: x <> '') AS words,
        (SELECT count(*) FROM cols c WHERE c.project = t.project AND c."table" = t."table" AND data_type IN ('int64', 'double', 'decimal', 'currency', 'int32')) AS numeric_columns,
        (SELECT count(*) FROM cols c WHERE c.project = t.project AND c."table" = t."table" AND data_type IN ('dateTime', 'date')) AS date_columns,
        (SELECT count(*) FROM cols c WHERE c.project = t.project AND c."table" = t."table" AND data_type IN ('int64', 'double', 'decimal', 'currency', 'int32') AND lower(summarize_by) <> 'none') AS summarized_columns,
        (SELECT count(*) FROM cols c WHERE c.project = t.project AND c."table" = t."table" AND is_calculated AND data_type = 'string' AND regexp_matches(expression, '&|(?i:\\bCONCATENATE)') AND {_has("lower(name)", K.KEY_PARTS)}) AS text_keys,
        (SELECT count(*) FROM edges e WHERE e.project = t.project AND e.from_table = t."table") AS relationships_from, (SELECT count(*) FROM edges e WHERE e.project = t.project AND e.to_table = t."table") AS relationships_to,
        (SELECT count(*) FROM edges e WHERE e.project = t.project AND e.from_table = t."table" AND is_active) AS active_from, (SELECT count(*) FROM edges e WHERE e.project = t.project AND e.from_table = t."table" AND is_active AND a <> 'many') AS active_from_one
    FROM tabs t),
sc0 AS MATERIALIZED (SELECT *, {_NAMED["FACT"]} + CASE WHEN numeric_columns >= 2 AND relationships_from >= 2 THEN 25 ELSE 0 END + CASE WHEN relationships_from >= 3 THEN 20 ELSE 0 END - CASE WHEN calculated_columns >= 3 AND relationships_from >= 2 THEN 15 ELSE 0 END
        - CASE WHEN text_keys > 0 THEN 10 ELSE 0 END + CASE WHEN relationships_from >= 2 AND calculated_columns = 0 AND text_keys = 0 THEN 10 ELSE 0 END + CASE WHEN active_from >= 4 AND active_from_one = 0 THEN 50 ELSE 0 END
        + CASE WHEN relationships_to = 0 AND relationships_from >= 3 THEN 45 ELSE 0 END + CASE WHEN summarized_columns >= 3 THEN 40 ELSE 0 END AS s_fact,
    {_NAMED["DIMENSION"]} + CASE WHEN relationships_to >= 2 AND relationships_from = 0 THEN 25 ELSE 0 END + CASE WHEN date_columns >= 2 THEN 25 ELSE 0 END - CASE WHEN text_keys > 0 THEN 8 ELSE 0 END AS s_dim0, {_NAMED["BRIDGE"]} AS s_bridge,
    {_NAMED["CALCULATION"]} + CASE WHEN measures >= 10 AND columns <= 2 THEN 50 ELSE 0 END + CASE WHEN measures >= 5 AND columns <= 1 THEN 35 ELSE 0 END AS s_calc,
    {_NAMED["PARAMETER"]} + CASE WHEN has_datatable AND columns <= 5 THEN 25 ELSE 0 END + CASE WHEN columns <= 3 AND relationships_from + relationships_to = 0 THEN 20 ELSE 0 END AS s_param FROM prof),
sc1 AS MATERIALIZED (SELECT *, CASE WHEN greatest(s_fact, s_dim0, s_bridge, s_calc, s_param) = 0 THEN 10 ELSE s_dim0 END AS s_dim FROM sc0),
classes AS MATERIALIZED (SELECT *, CASE WHEN s_fact = best THEN 'FACT' WHEN s_dim = best THEN 'DIMENSION' WHEN s_bridge = best THEN 'BRIDGE' WHEN s_calc = best THEN 'CALCULATION' ELSE 'PARAMETER' END AS classification,
    CASE WHEN total <= 0 THEN 0.3 ELSE round_even(greatest(0.3, least(0.98, (CASE WHEN best >= 70 THEN 0.9 WHEN best >= 50 THEN 0.8 WHEN best >= 30 THEN 0.65 WHEN best >= 15 THEN 0.5 ELSE 0.35 END + best::DOUBLE / total) / 2)), 2) END::DOUBLE AS confidence
    FROM (SELECT *, greatest(s_fact, s_dim, s_bridge, s_calc, s_param) AS best, s_fact + s_dim + s_bridge + s_calc + s_param AS total FROM sc1)),
linked AS MATERIALIZED (SELECT e.*, x.classification AS from_class, y.classification AS to_class FROM edges e LEFT JOIN classes x ON x.project = e.project AND x."table" = e.from_table LEFT JOIN classes y ON y.project = e.project AND y."table" = e.to_table),
shared AS (SELECT project, CASE WHEN from_class = 'FACT' THEN to_table ELSE from_table END AS dimension, count(*) AS n_edges FROM linked WHERE (from_class = 'FACT' AND to_class = 'DIMENSION') OR (from_class = 'DIMENSION' AND to_class = 'FACT') GROUP BY 1, 2 HAVING count(*) >= 2),
topology AS MATERIALIZED (SELECT c.project, count(*) AS n_tables, count(*) FILTER (classification = 'FACT') AS n_facts, count(*) FILTER (classification = 'DIMENSION') AS n_dimensions, avg(confidence) AS mean_confidence,
    (SELECT count(*) FROM edges e WHERE e.project = c.project) AS n_edges, (SELECT count(*) FROM linked l WHERE l.project = c.project AND ((from_class = 'FACT' AND to_class = 'DIMENSION') OR (from_class = 'DIMENSION' AND to_class = 'FACT'))) AS fact_dimension,
    (SELECT count(*) FROM linked l WHERE l.project = c.project AND from_class = 'DIMENSION' AND to_class = 'DIMENSION') AS dimension_dimension, (SELECT count(*) FROM shared s WHERE s.project = c.project) AS n_shared FROM classes c GROUP BY c.project),
schemas AS MATERIALIZED (SELECT *, CASE WHEN n_tables = 0 THEN 'UNKNOWN' WHEN n_edges = 0 AND n_tables <= 2 THEN 'FLAT' WHEN n_edges = 0 THEN 'DISCONNECTED' WHEN n_facts >= 2 AND fact_dimension >= n_facts THEN 'GALAXY'
    WHEN dimension_dimension > 0 AND n_facts >= 1 THEN 'SNOWFLAKE' WHEN n_facts = 1 AND fact_dimension >= 2 THEN 'STAR' WHEN n_facts = 0 THEN 'DIMENSIONAL' ELSE 'UNKNOWN' END AS schema_type FROM topology)"""


def _rule(dimension: str, rule: str, source: str, n: str = "count(*)", affected: str = "''", detail: str = "''", group: str = "project", having: str = "") -> str:
    return f"SELECT project, '{dimension}' AS dimension, '{rule}' AS rule, ({n})::DOUBLE AS n, {affected} AS affected, {detail} AS detail, NULL AS given FROM {source} GROUP BY {group}{' HAVING ' + having if having else ''}"


def _names(column: str) -> str:
    return f"string_agg(DISTINCT {column}, ';' ORDER BY {column})"


_SCORED = "(?:" + "|".join(dax.SCORED_ITERATORS) + ")"
_OUT = f"\"table\" NOT IN {_list(R.MEASURE_TABLES)}"
_WHOLE = r"(?i)FILTER\s*\(\s*'?[A-Za-z_][A-Za-z0-9_]*'?\s*,"
_ISSUES = f"""{_CLASSES}, {_VISUALS}, alone AS MATERIALIZED (SELECT c.* FROM classes c WHERE relationships_from + relationships_to = 0 AND classification NOT IN ('CALCULATION', 'PARAMETER') AND NOT regexp_matches("table", '^(_|param|Param)')),
wide AS (SELECT *, (line_breaks >= 5 OR depth > 4) AS complex FROM meas), share AS (SELECT project, count(*) AS total, count(*) FILTER ({_OUT}) AS outside, list_sort(list(DISTINCT name) FILTER ({_OUT})) AS names, count(*) FILTER (complex) AS complex, count(*) FILTER (complex AND vars > 0) AS with_var FROM wide GROUP BY project),
dense AS (SELECT *, chart_count + table_count + card_count AS n FROM pages WHERE chart_count + table_count + card_count > 8),
slicers AS (SELECT v.project, v.visual_id, f.field, nullif(regexp_extract(f.field, '^''?([^''\\[.]+)''?[\\[.]', 1), '') AS t FROM vis v LEFT JOIN vis_fields f ON f.project = v.project AND f.page_id = v.page_id AND f.visual_id = v.visual_id WHERE v.category = 'SLICER'),
described AS (SELECT s.project, count(m.name) AS total, count(DISTINCT m.name) FILTER (coalesce(trim(description), '') = '') AS bare, list_sort(list(DISTINCT m.name) FILTER (coalesce(trim(description), '') = '')) AS names FROM schemas s LEFT JOIN meas m ON m.project = s.project GROUP BY s.project),
ends AS (SELECT project, from_table AS t, from_column AS c FROM edges UNION SELECT project, to_table, to_column FROM edges),
findings AS MATERIALIZED (
    {_rule("MODEL", "no_relationships", "schemas", "1", group="project, n_tables, n_edges", having="n_tables > 1 AND n_edges = 0")}
    UNION ALL {_rule("MODEL", "isolated_tables", "alone a", 'count(*)::DOUBLE / (SELECT n_tables FROM schemas s WHERE s.project = a.project)', 'string_agg("table", \';\' ORDER BY "table")')}
    UNION ALL {_rule("MODEL", "no_fact_table", "schemas", "1", group="project, n_facts, n_edges", having="n_edges > 0 AND n_facts = 0")}
    UNION ALL {_rule("MODEL", "multiple_facts_no_shared_dims", "schemas", "1", group="project, n_facts, n_shared", having="n_facts >= 2 AND n_shared = 0")}
    UNION ALL {_rule("MODEL", "many_to_many", "edges WHERE a = 'many' AND b = 'many'", affected=_names("from_table || ' -> ' || to_table"))}
    UNION ALL {_rule("MODEL", "bidirectional", "edges WHERE cross_filter_direction = 'Both'", affected=_names("from_table || ' -> ' || to_table"))}
    UNION ALL {_rule("MODEL", "inactive_relationships", "edges WHERE NOT is_active", affected=_names("from_table || ' -> ' || to_table"))}
    UNION ALL {_rule("MODEL", "string_keys", "(SELECT DISTINCT e.project, e.t FROM ends e JOIN cols c ON c.project = e.project AND c.\"table\" = e.t AND c.name = e.c AND c.data_type = 'string')", affected=_names("t"))}
    UNION ALL {_rule("MODEL", "calculated_columns_in_facts", "classes WHERE classification = 'FACT' AND calculated_columns > 0", "sum(calculated_columns)", _names('"table"'))}
    UNION ALL {_rule("MODEL", "low_confidence_classification", "classes WHERE confidence < 0.6 AND classification NOT IN ('CALCULATION', 'PARAMETER')", affected=_names('"table"'))}
    UNION ALL {_rule("MODEL", "clean_dimensional_model", "schemas WHERE n_facts > 0 AND n_dimensions > 0 AND n_edges > 0")}
    UNION ALL {_rule("MODEL", "bridge_tables_present", "classes WHERE classification = 'BRIDGE'")}
    UNION ALL {_rule("MODEL", "high_classification_confidence", "schemas WHERE mean_confidence >= 0.85")}
    UNION ALL {_rule("DAX", "filter_over_full_table", f"meas WHERE regexp_matches(expression, {_text(_WHOLE)})", affected=_names("name"))}
    UNION ALL {_rule("DAX", "no_var_in_complex_measure", "wide WHERE complex AND vars = 0", affected=_names("name"))}
    UNION ALL {_rule("DAX", "nested_iterators", f"meas WHERE regexp_matches(upper(expression), {_text(rf'{_SCORED}\s*\([^)]*{_SCORED}\s*\(')})", affected=_names("name"))}
    UNION ALL {_rule("DAX", "measure_without_format", "meas WHERE format_string IS NULL", affected=_names("name"))}
    UNION ALL {_rule("DAX", "measures_outside_dedicated_table", "share WHERE outside > 0.10 * total", "any_value(outside)", "array_to_string(any_value(names)[1:10], ';')")}
    UNION ALL {_rule("DAX", "all_measures_in_dedicated_table", "share WHERE outside = 0")}
    UNION ALL {_rule("DAX", "var_usage_rate", "share WHERE complex > 0 AND with_var >= 0.70 * complex")}
    UNION ALL SELECT project, 'REPORT', 'visuals_per_page', n - 8, display_name, display_name || ': ' || n || ' visuals', CASE WHEN n > 12 THEN 'CRITICAL' ELSE 'WARNING' END FROM dense
    UNION ALL {_rule("REPORT", "hidden_visuals", "pages WHERE hidden_count > 0", "sum(hidden_count)", _names("display_name"))}
    UNION ALL {_rule("REPORT", "slicers_from_dimensions_only", "slicers s LEFT JOIN (SELECT project AS p, \"table\" AS f FROM classes WHERE classification = 'FACT') k ON p = project AND f = t", "1", having="count(f) = 0")}
    UNION ALL {_rule("GOVERNANCE", "naming_violations", f'tabs WHERE "table" IN {_list(R.FORBIDDEN_NAMES)}', affected=_names('"table"'))}
    UNION ALL {_rule("GOVERNANCE", "no_description_on_measures", "described WHERE bare > 0.50 * total AND total > 0", affected="array_to_string(any_value(names)[1:10], ';')")}
    UNION ALL {_rule("GOVERNANCE", "no_rls_defined", f"tabs WHERE regexp_matches(lower(\"table\"), '{'|'.join(R.SENSITIVE)}')", "1", _names('"table"'))}
    UNION ALL {_rule("GOVERNANCE", "consistent_naming", f"schemas s WHERE NOT EXISTS (SELECT 1 FROM tabs t WHERE t.project = s.project AND t.\"table\" IN {_list(R.FORBIDDEN_NAMES)})")}
    UNION ALL {_rule("GOVERNANCE", "documented_measures", "described WHERE bare = 0")}),
rules(dimension, rule, rule_no, per_unit, most, severity) AS (VALUES {", ".join(f"('{d}', '{r}', {i}, {per}, {most}, {_text(sev)})" for i, (d, r, per, most, sev, _) in enumerate(R.RULES))}),
issues0 AS MATERIALIZED (SELECT f.*, rule_no, most, CASE WHEN most > 0 THEN coalesce(given, severity) ELSE '-' END AS severity, CASE WHEN most > 0 THEN -1 ELSE 1 END * least(abs(most), CASE WHEN rule = 'isolated_tables' THEN round_even(n * per_unit, 0) ELSE n * per_unit END)::DOUBLE AS points FROM findings f JOIN rules USING (dimension, rule)),
issues AS MATERIALIZED (SELECT *, CASE WHEN most > 0 THEN left(dimension, 1) || printf('%03d', row_number() OVER (PARTITION BY project, dimension, most > 0 ORDER BY rule_no, detail)) ELSE '-' END AS code FROM issues0 WHERE points <> 0),
weights(dimension, weight) AS (VALUES {", ".join(f"('{d}', {w})" for d, w in R.WEIGHTS.items())}),
scores AS (SELECT s.project, w.dimension, w.weight, greatest(0, least(100, least(100 + coalesce((SELECT sum(points) FROM issues i WHERE i.project = s.project AND i.dimension = w.dimension), 0), CASE WHEN w.dimension <> 'MODEL' THEN 1000 ELSE {"CASE schema_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.CEILINGS.items()) + " END"} END)))::DOUBLE AS score FROM schemas s, weights w)"""

_TYPE_WORDS = f"""CASE WHEN contains(name, ' = ') THEN 'Calculated Column' WHEN data_type = 'string' THEN 'Text' WHEN data_type IN ('int64', 'int', 'integer') THEN 'Whole Number' WHEN data_type IN ('double', 'real', 'float', 'decimal') THEN 'Decimal Number'
    WHEN data_type IN ('dateTime', 'date') THEN CASE WHEN {_has("lower(name)", K.POSTING_WORDS)} THEN 'Date' ELSE 'DateTime' END WHEN data_type = 'boolean' THEN 'True/False' WHEN data_type = 'binary' THEN 'Binary' WHEN {_has("lower(name)", K.COUNT_WORDS)} THEN 'Whole Number'
    WHEN {_has("lower(name)", K.RATE_WORDS)} THEN 'Decimal Number' WHEN {_has("lower(name)", K.DAY_WORDS)} THEN 'Date' ELSE 'Other (' || data_type || ')' END"""

SQL = {
    "tmdl_columns": f"""WITH {_COLUMNS} SELECT project, "table", name, data_type, is_calculated, nullif(expression, '') AS expression, summarize_by, is_hidden, is_key, semantic_role, '' AS annotations, line FROM cols""",
    "tmdl_measures": f"""WITH {_FINDINGS} SELECT project, "table", name, expression, format_string, description, display_folder, is_hidden, complexity_score, is_stub, coalesce(length(expression), 0) AS expression_length,
        array_to_string(list_filter([{", ".join(f"CASE WHEN {_calls('expression', f)} > 0 THEN '{f}' END" for f in sorted(dax.FUNCTIONS))}], lambda x: x IS NOT NULL), ',') AS functions_used, array_to_string(bracketed, ',') AS bracketed,
        coalesce((SELECT arg_min(severity, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) FROM found f WHERE f.project = meas.project AND f.name = meas.name AND occurrences > 0), 'NONE') AS highest_severity FROM meas""",
    "tmdl_partitions": f"WITH {_OBJECTS}, {_PARTITIONS} SELECT * FROM parts",
    "tmdl_tables": f"""WITH {_TABLES} SELECT project, "table", file, column_count, measure_count, partition_count, hidden_column_count, calculated_column_count, key_like_column_count, table_kind, is_hidden, types, raw_size_chars FROM tabs""",
    "relationship_edges": f"WITH {_OBJECTS}, {_EDGES} SELECT project, id, from_table, from_column, to_table, to_column, cardinality, cross_filter_direction, is_active, flags FROM edges",
    "datasources": f"WITH {_SOURCES} SELECT *, nullif(lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)), '') AS file_extension FROM sources",
    "datasource_counts": f"WITH {_SOURCES} SELECT project, 'type' AS what, type AS name, count(*) AS n FROM sources GROUP BY ALL UNION ALL SELECT project, 'connector', connector, count(*) FROM sources GROUP BY ALL",
    "datasource_summary": f"""WITH {_SOURCES} SELECT project, count(*) AS total_datasources, bool_or(connector <> 'source_assignment') AS has_m_queries, bool_or(type IN {_list(K.FILE_TYPES)}) AS has_file_based_sources, bool_or(type IN {_list(K.CLOUD_TYPES)}) AS has_cloud_sources,
        bool_or(type IN {_list(K.DATABASE_TYPES)}) AS has_database_sources, bool_or(type IN {_list(K.WEB_TYPES)}) AS has_web_sources, count(*) FILTER (confidence < 0.7) AS low_confidence, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM sources GROUP BY project""",
    "report_visuals": f"""WITH {_VISUALS} SELECT v.project, v.page_id, v.visual_id, visual_type, is_hidden, category, coalesce(string_agg(field, ',' ORDER BY k), '') AS all_fields, CASE WHEN any_value(category) IN ('CHART', 'TABLE') THEN least(count(field), 3) ELSE 0 END AS shown
        FROM vis v LEFT JOIN vis_fields f ON f.project = v.project AND f.page_id = v.page_id AND f.visual_id = v.visual_id GROUP BY v.project, v.page_id, v.visual_id, visual_type, is_hidden, category""",
    "visual_categories": f"WITH {_VISUALS} SELECT project, page_id, display_name, visuals_count, chart_count, table_count, card_count, slicer_count, text_count, other_count, hidden_count FROM pages",
    "category_totals": f"WITH {_VISUALS} SELECT project, count(*) AS pages, {', '.join(f'sum({c}_count)::BIGINT AS {c}_count' for c in ('visuals', 'chart', 'table', 'slicer', 'button', 'text', 'card', 'other', 'hidden'))} FROM pages GROUP BY project",
    "page_fields": f"""WITH {_VISUALS} SELECT DISTINCT project, page_id, name FROM (SELECT project, page_id, unnest(list_concat(list_transform(regexp_extract_all(content, '\\[([^\\[\\]"{{}}:,]+)\\]', 1), lambda x: trim(x)), regexp_extract_all(content, '"(?:nativeQueryRef|queryRef|Property)"\\s*:\\s*"([^"]+)"', 1))) AS name FROM report WHERE visual_id IS NOT NULL) WHERE name <> ''""",
    "measure_roles": f"""WITH RECURSIVE {_GRAPH} SELECT project, name, dependency_depth::BIGINT AS depth, dependents, dependents = 0 AS is_leaf_measure, CASE WHEN base AND dependents >= 3 THEN 'FOUNDATION' WHEN base THEN 'BASE' WHEN dependents = 0 THEN 'LEAF' ELSE 'INTERMEDIATE' END AS architectural_role,
        round_even(complexity_score + dependents * 0.3::DOUBLE + dependency_depth * 0.2::DOUBLE, 2)::DOUBLE AS architectural_complexity FROM graph""",
    "measure_dependencies": f"WITH RECURSIVE {_GRAPH} SELECT project, name, dependency FROM deps",
    "unused_measures": f"WITH RECURSIVE {_UNUSED} SELECT project, name, cleanup_risk FROM unused",
    "unused_summary": f"""WITH RECURSIVE {_UNUSED}, t AS (SELECT project, count(*) AS total_measures, count(DISTINCT name) AS names FROM graph GROUP BY 1), u AS (SELECT project, count(*) AS unused_measures, count(DISTINCT name) AS unused_names, {", ".join(f"count(*) FILTER (cleanup_risk = '{r}') AS {r.lower()}" for r in ("SAFE_DELETE", "REVIEW_SUGGESTED", "INVESTIGATE", "DO_NOT_DELETE"))} FROM unused GROUP BY 1)
        SELECT project, total_measures, coalesce(unused_measures, 0) AS unused_measures, coalesce(safe_delete, 0) AS safe_delete, coalesce(review_suggested, 0) AS review_suggested, coalesce(investigate, 0) AS investigate, coalesce(do_not_delete, 0) AS do_not_delete,
            names - coalesce(unused_names, 0) AS used_measures, round_even(coalesce(unused_measures, 0) * 100.0 / total_measures, 1)::DOUBLE AS unused_percentage FROM t LEFT JOIN u USING (project)""",
    "antipatterns": f"WITH {_FINDINGS} SELECT project, name, code, severity, occurrences FROM found WHERE occurrences > 0",
    "table_classes": f"""WITH {_CLASSES} SELECT project, "table", classification, confidence, columns, measures, relationships_from, relationships_to, relationships_from + relationships_to = 0 AS is_isolated, calculated_columns AS calculated, summarized_columns,
        coalesce(round_even(numeric_columns::DOUBLE / nullif(columns, 0), 4), 0)::DOUBLE AS numeric_ratio, coalesce(round_even(date_columns::DOUBLE / nullif(columns, 0), 4), 0)::DOUBLE AS date_ratio FROM classes""",
    "project_topology": f"""WITH RECURSIVE {_CLASSES}, ways AS (SELECT project, from_table AS x, to_table AS y FROM edges UNION SELECT project, to_table, from_table FROM edges),
        reach(project, x, y) AS (SELECT project, "table", "table" FROM classes UNION SELECT r.project, r.x, w.y FROM reach r JOIN ways w ON w.project = r.project AND w.x = r.y)
        SELECT s.project, n_tables AS total_tables, n_edges AS total_relationships, (SELECT count(*) FROM edges e WHERE e.project = s.project AND is_active) AS active_relationships, (SELECT count(*) FROM edges e WHERE e.project = s.project AND NOT is_active) AS inactive_relationships,
            (SELECT count(DISTINCT low) FROM (SELECT x, min(y) AS low FROM reach r WHERE r.project = s.project GROUP BY x)) AS components, (SELECT string_agg("table", ',' ORDER BY "table") FROM classes c WHERE c.project = s.project AND relationships_from + relationships_to = 0) AS isolated_tables,
            schema_type, round_even(mean_confidence, 3)::DOUBLE AS average_classification_confidence FROM schemas s""",
    "shared_dimensions_of_projects": f"WITH {_CLASSES} SELECT project, dimension, n_edges FROM shared",
    "hub_tables": f"""WITH {_OBJECTS}, {_EDGES} SELECT * FROM (SELECT project, "table", count(*) AS degree, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, "table") AS rank FROM (SELECT project, unnest([from_table, to_table]) AS "table" FROM edges WHERE is_active) GROUP BY 1, 2) WHERE rank <= 5""",
    "lowest_usage": f"""WITH {_USAGE} SELECT * FROM (SELECT project, "table", unused_columns, row_number() OVER (PARTITION BY project ORDER BY usage_percentage, unused_columns DESC, "table") AS rank FROM usage) WHERE rank <= 5""",
    "datatype_statistics": f"WITH {_COLUMNS}, n AS (SELECT project, {_TYPE_WORDS} AS display_type, count(*) AS n FROM cols GROUP BY ALL) SELECT project, sum(n)::BIGINT AS total, count(*) AS distinct_types, arg_min(display_type, (-n, display_type)) AS most_common FROM n GROUP BY project",
    "audit_issues": f"WITH {_ISSUES} SELECT project, dimension, rule, points, severity, code, affected FROM issues",
    "audit_scores": f"WITH {_ISSUES} SELECT project, dimension, score, round_even(score * weight, 2)::DOUBLE AS weighted FROM scores",
    "audit_grades": f"""WITH {_ISSUES}, g AS (SELECT project, round_even(sum(round_even(score * weight, 2)::DECIMAL(12, 4))::DOUBLE, 0)::INTEGER AS global_score FROM scores GROUP BY project)
        SELECT project, global_score, CASE {" ".join(f"WHEN global_score >= {v} THEN '{k}'" for k, v in K.GRADES.items())} END AS grade, CASE {" ".join(f"WHEN global_score >= {v} THEN '{k}'" for k, v in K.STATES.items())} END AS status FROM g""",
    "column_usage": f"""WITH {_USAGE} SELECT project, "table", total_columns, used_columns, used, unused FROM usage""",
}


# Charts


def _cat(template: str, **values: str) -> str:
    pieces = template.replace("}", "{").split("{")
    return "concat(" + ", ".join(f"({values[x]})::VARCHAR" if k % 2 else _text(x) for k, x in enumerate(pieces) if x) + ")"


def _safe(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _round(x: str) -> str:
    return f"floor({x} + 0.5::DOUBLE)::BIGINT"


def _paint(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in svg.FILLS.items()) + " ELSE '#7f8c8d' END"


def _layers(document: str, rows: str, height: str, *layers: str) -> str:
    head = _cat(f'<svg xmlns="http://www.w3.org/2000/svg" width="{svg.WIDTH}" height="{{h}}" font-family="sans-serif" font-size="12">', h=height)
    parts = [f"SELECT project, 0 AS section_no, 0::BIGINT AS line_no, {head} AS line FROM {rows} GROUP BY project", *(f"SELECT project, {k}, {x}" for k, x in enumerate(layers, 1)), f"SELECT DISTINCT project, 99, 0, '</svg>' FROM {rows}"]
    return " UNION ALL ".join(f"SELECT project, '{document}' AS document, section_no::INTEGER AS section_no, line_no::BIGINT AS line_no, line FROM ({p}) x(project, section_no, line_no, line)" for p in parts)


_R, _L = svg.ROW, svg.LABEL
_SHARE = "1000.0::DOUBLE / total"
_A, _B = _round(f"before * {_SHARE}"), _round(f"(before + n) * {_SHARE}")
_DONUT = _cat('<circle cx="160" cy="160" r="100" fill="none" stroke="{f}" stroke-width="48" pathLength="1000" stroke-dasharray="{d} 1000" stroke-dashoffset="{o}"/>', f=_paint("classification"), d=f"{_B} - {_A}", o=f"-{_A}")
_KIND = "CASE WHEN contains(lower(\"table\"), 'fact') THEN 'fact' WHEN contains(lower(\"table\"), 'dim') THEN 'dimension' WHEN contains(lower(\"table\"), 'bridge') THEN 'bridge' WHEN contains(lower(\"table\"), 'measure') THEN 'measure' ELSE 'other' END"
_CHARTS = f"""{_CLASSES}, {_GRAPH.removeprefix(_MEASURES + ", ")},
bars AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, display_type) AS k, {_round("n * 600.0::DOUBLE / max(n) OVER (PARTITION BY project)")} AS w FROM (SELECT project, {_TYPE_WORDS} AS display_type, count(*) AS n FROM cols GROUP BY ALL)),
arcs AS MATERIALIZED (SELECT *, row_number() OVER w AS k, sum(n) OVER (PARTITION BY project)::BIGINT AS total, coalesce(sum(n) OVER (PARTITION BY project ORDER BY classification ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM (SELECT project, classification, count(*) AS n FROM classes GROUP BY ALL) WINDOW w AS (PARTITION BY project ORDER BY classification)),
touched AS (SELECT project, t, count(*) AS degree FROM (SELECT project, unnest([from_table, to_table]) AS t FROM edges) GROUP BY ALL),
heat0 AS (SELECT t.project, t."table", [least(column_count / 5.0::DOUBLE, 10), least(measure_count * 2.0::DOUBLE, 10), least(coalesce(degree, 0) * 2.0::DOUBLE, 10), coalesce((SELECT avg(complexity_score) FROM meas m WHERE m.project = t.project AND m."table" = t."table"), 0)::DOUBLE] AS v
    FROM tabs t LEFT JOIN touched d ON d.project = t.project AND d.t = t."table"),
heat AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY v[1] + v[2] + v[3] + v[4] DESC, "table") AS rank FROM heat0) WHERE rank <= 15),
cells AS (SELECT project, rank, unnest(range(4)) AS k, unnest(v) AS value FROM heat),
dots AS MATERIALIZED (SELECT *, list_position({list(svg.KINDS)}, kind) * 190 - 100 AS x, row_number() OVER (PARTITION BY project, kind ORDER BY "table") * {2 * _R} AS y, row_number() OVER (PARTITION BY project ORDER BY "table") AS k FROM (SELECT project, "table", column_count, {_KIND} AS kind FROM tabs)),
ties AS MATERIALIZED (SELECT e.project, from_table, to_table, arg_max(cardinality, id) AS cardinality, any_value(a.x) AS x1, any_value(a.y) AS y1, any_value(b.x) AS x2, any_value(b.y) AS y2
    FROM edges e JOIN dots a ON a.project = e.project AND a."table" = from_table JOIN dots b ON b.project = e.project AND b."table" = to_table GROUP BY e.project, from_table, to_table),
points AS MATERIALIZED (SELECT *, dependency_depth * 140 + 150 AS x, row_number() OVER (PARTITION BY project, dependency_depth ORDER BY name) * {_R} AS y, row_number() OVER (PARTITION BY project ORDER BY name) AS k,
    CASE WHEN complexity_score <= 3 THEN 'low' WHEN complexity_score <= 6 THEN 'medium' ELSE 'high' END AS level FROM graph),
arrows AS MATERIALIZED (SELECT d.project, d.name, d.dependency, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM deps d JOIN points a ON a.project = d.project AND a.name = d.name JOIN points b ON b.project = d.project AND b.name = d.dependency WHERE d.name <> d.dependency)
"""
_LINES = " UNION ALL ".join([
    _layers("datatypes.svg", "bars", f"(count(*) + 2) * {_R}", "k, " + _cat(f'<text x="8" y="{{t}}">{{name}}</text><rect x="{_L}" y="{{y}}" width="{{w}}" height="{_R - 6}" fill="#2980b9"/><text x="{{e}}" y="{{t}}">{{n}}</text>', t=f"k * {_R} + 14", y=f"k * {_R}", name=_safe("display_type"), w="w", e=f"w + {_L + 6}", n="n") + " FROM bars"),
    _layers("classes.svg", "arcs", "340", f"k, {_DONUT} FROM arcs", "k, " + _cat('<text x="320" y="{y}" fill="{f}">{name}: {n}</text>', y=f"k * {_R} + 40", f=_paint("classification"), name="classification", n="n") + " FROM arcs"),
    _layers("heatmap.svg", "heat", f"(count(*) + 2) * {_R}", "rank, " + _cat('<text x="8" y="{y}">{t}</text>', y=f"rank * {_R} + 15", t=_safe('"table"')) + " FROM heat",
        "rank * 10 + k, " + _cat(f'<rect x="{{x}}" y="{{y}}" width="116" height="{_R - 2}" fill="#c0392b" fill-opacity="{{o}}%"/>', x=f"k * 120 + {_L}", y=f"rank * {_R}", o=f"least({_round('value * 10')}, 100)") + " FROM cells"),
    _layers("relationships.svg", "dots", f"max(y) + {3 * _R}", "row_number() OVER (PARTITION BY project ORDER BY from_table, to_table), " + _cat('<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="#555"{s}/>', a="x1", b="y1", c="x2", d="y2", s="CASE WHEN cardinality = 'Many-to-Many' THEN ' stroke-dasharray=\"4 4\"' ELSE '' END") + " FROM ties",
        "k, " + _cat('<circle cx="{x}" cy="{y}" r="{r}" fill="{f}"/><text x="{x}" y="{t}" text-anchor="middle">{n}</text>', x="x", y="y", r=f"least(20, 6 + {_round('column_count * 100 / 200.0::DOUBLE')})", f=_paint("kind"), t="y + 30", n=_safe('"table"')) + " FROM dots"),
    _layers("measures.svg", "points", f"max(y) + {2 * _R}", "row_number() OVER (PARTITION BY project ORDER BY name, dependency), " + _cat('<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="#999"/>', a="x1", b="y1", c="x2", d="y2") + " FROM arrows",
        "k, " + _cat('<circle cx="{x}" cy="{y}" r="6" fill="{f}"/><text x="{t}" y="{u}">{n}</text>', x="x", y="y", f=_paint("level"), t="x + 9", u="y + 4", n=_safe("name")) + " FROM points"),
])
SQL["chart_lines"] = f"WITH RECURSIVE {_CHARTS} {_LINES}"

_BY_PLACE = ", ".join(f"coalesce({c}, '')" for c in ("type", "connector", "server", "url", "path", "database"))
SQL |= {
    "text_complexity": f"SELECT doc_id, {_COMPLEXITY} AS complexity FROM (SELECT doc_id, text AS expression FROM documents) m",
    "unused_columns": f'WITH {_USAGE} SELECT project, "table", name FROM hits WHERE NOT hit',
    "datasource_order": f"WITH {_SOURCES} SELECT project, row_number() OVER (PARTITION BY project ORDER BY {_BY_PLACE}) AS position, type, connector, server, url, path FROM sources",
    "measures_by_table": f'WITH {_MEASURES} SELECT project, "table", row_number() OVER (PARTITION BY project, "table" ORDER BY name, line) AS position, name FROM meas',
    "first_seen_words": r"SELECT conv_id, turn, array_to_string([w FOR w, i IN ws IF w <> '' AND list_position(ws, w) = i], ' ') AS words FROM (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '[ \n]') AS ws FROM conversations)",
}
