"""The scalar library as SQL functions: expressions that the optimizer inlines, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.blocks import register_blocks

#: name, arguments, result, expression.
FUNCTIONS = (
    ("collapse_space", "s STRING", "STRING", r"trim(regexp_replace(coalesce(s, ''), '(?U)\\s+', ' '))"),
    ("text_preview", "s STRING, n INT", "STRING", r"CASE WHEN length(trim(regexp_replace(coalesce(s, ''), '(?U)\\s+', ' '))) > n THEN concat(left(trim(regexp_replace(coalesce(s, ''), '(?U)\\s+', ' ')), n), '...') ELSE trim(regexp_replace(coalesce(s, ''), '(?U)\\s+', ' ')) END"),
    ("name_tokens", "s STRING", "ARRAY<STRING>", r"filter(split(lower(s), '[\\s_\\-\\.]+'), t -> t <> '')"),
    ("url_host", "s STRING", "STRING", r"nullif(lower(regexp_extract(s, '(?i)https?://([^/]+)', 1)), '')"),
    ("path_suffix", "s STRING", "STRING", r"nullif(lower(regexp_extract(s, '(\\.[A-Za-z0-9]+)$', 1)), '')"),
    ("source_id", "a STRING, b STRING, c STRING, d STRING", "STRING", "substring(md5(concat_ws('|', coalesce(a, ''), coalesce(b, ''), coalesce(c, ''), coalesce(d, ''))), 1, 12)"),
    ("score_grade", "x DOUBLE", "STRING", "CASE WHEN x >= 85 THEN 'A' WHEN x >= 75 THEN 'B' WHEN x >= 60 THEN 'C' WHEN x >= 45 THEN 'D' ELSE 'F' END"),
    ("capped_points", "n DOUBLE, per_unit DOUBLE, most DOUBLE", "DOUBLE", "least(most, n * per_unit)"),
    ("markdown_cell", "s STRING", "STRING", r"trim(replace(regexp_replace(coalesce(s, ''), '\r?\n', ' '), '|', '\\|'))"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions for this session; the table function ``tmdl_blocks`` too. Returns their names."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    register_blocks(spark)
    return [name for name, *_ in FUNCTIONS] + ["tmdl_blocks"]
