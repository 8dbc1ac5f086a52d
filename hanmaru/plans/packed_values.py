"""Queries on values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanmaru.operators.packed import explode_packed
from hanmaru.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ingredient of every raw_ingredients field, with its place."""
    out = None
    for name in ("catalog_product_master", "uploaded_product_master"):
        values = explode_packed(table(spark, sf_dir, name, "report_no", "raw_ingredients"), "report_no", "raw_ingredients")
        part = values.select(F.lit(name).alias("table_name"), "report_no", F.col("value_pos").cast("int").alias("value_pos"), "value_text")
        out = part if out is None else out.unionByName(part)
    return out


P5_SQL = r"""
WITH fields AS (
  SELECT DISTINCT 'catalog_product_master' AS table_name, report_no, raw_ingredients AS f FROM catalog_product_master WHERE raw_ingredients <> ''
  UNION ALL
  SELECT DISTINCT 'uploaded_product_master', report_no, raw_ingredients FROM uploaded_product_master WHERE raw_ingredients <> ''),
opened AS (
  SELECT *, CASE WHEN regexp_full_match(f, '(?s)\s*\[\s*".*"\s*\]\s*') THEN regexp_extract(f, '(?s)^\s*\[(.*)\]\s*$', 1) ELSE f END AS g FROM fields),
shielded AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(g, '(\p{Nd}),(\p{Nd})', '\1' || chr(57344) || '\2', 'g'),
      '(\p{Nd}),(\p{Nd})', '\1' || chr(57344) || '\2', 'g'),
      '(^|[\s\p{Z}])·', '\1' || chr(57345), 'g'), '(^|[\s\p{Z}])\+', '\1' || chr(57346), 'g') AS h FROM opened),
cut AS (
  SELECT table_name, report_no, regexp_extract_all(h,
    '(?s)(?:"(?:[^"\\]|\\.|"")*"|''(?:[^''\\]|\\.|'''')*''|\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\]|[^,;/|，；／｜、\t\r\n' || chr(57345) || chr(57346) || '"''(\[])+') AS vs FROM shielded),
trimmed AS (
  SELECT table_name, report_no, list_filter(list_transform(vs, lambda v: regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda v: v <> '') AS vs FROM cut),
bare AS (
  SELECT table_name, report_no, list_filter(list_transform(vs, lambda v: CASE
      WHEN regexp_full_match(v, '(?s)"(?:[^"\\]|\\.|"")*"') THEN trim(replace(replace(v[2:len(v)-1], '""', '"'), '\"', '"'))
      WHEN regexp_full_match(v, '(?s)''(?:[^''\\]|\\.|'''')*''') THEN trim(replace(replace(v[2:len(v)-1], '''''', ''''), '\''', '''')) ELSE v END), lambda v: v <> '') AS vs FROM trimmed)
SELECT DISTINCT table_name, report_no, CAST(p AS INTEGER) AS value_pos,
  replace(replace(replace(vs[p], chr(57344), ','), chr(57345), '·'), chr(57346), '+') AS value_text
FROM bare, unnest(generate_series(1, len(vs))) AS t(p)
"""
