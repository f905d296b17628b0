"""Queries of the two general training-data operators: snapshot changes and common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleba.operators.changes import latest, price_value, snapshot_changes
from gleba.operators.units import common_amounts, item_number, planted, rate_map
from gleba.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "feed_snapshots")
    rows = latest(feed, F.col("snapshot_date").cast("string"), item_number(F.col("url")), price_value(F.col("price"), F.col("currency")), F.col("loaded_at"))
    return snapshot_changes(rows).select(F.col("snap").alias("snapshot_date"), F.col("key").alias("source_id"), "change_kind")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common_amounts(table(spark, sf_dir, "feed_items"), rate_map(table(spark, sf_dir, "unit_rates")))


def p4_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(table(spark, sf_dir, "feed_items"), rate_map(table(spark, sf_dir, "unit_rates")))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_planted": p4_planted}

SQL = {
    "p2_found": r"""
WITH r AS (
  SELECT CAST(snapshot_date AS VARCHAR) AS d, regexp_extract(url, '(?i)/item/(\d+)', 1) AS k, loaded_at,
    CASE WHEN price IS NOT NULL AND NOT isnan(price) THEN CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR) || ' ' ||
      CASE WHEN lower(currency) LIKE '%srd%' OR lower(currency) LIKE '%sr$%' THEN 'SRD' WHEN lower(currency) LIKE '%usd%' OR currency LIKE '%$%' THEN 'USD'
           WHEN lower(currency) LIKE '%eur%' OR currency LIKE '%€%' THEN 'EUR' ELSE coalesce(upper(trim(currency)), '-') END END AS v
  FROM feed_snapshots),
one AS (SELECT d, k, v FROM r WHERE k <> '' AND d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d, k ORDER BY loaded_at DESC NULLS LAST, v DESC NULLS LAST) = 1),
o AS (SELECT d, lead(d) OVER (ORDER BY d) AS nxt FROM (SELECT DISTINCT d FROM one)),
a AS (SELECT o.nxt AS d, k, v FROM one JOIN o USING (d) WHERE nxt IS NOT NULL),
b AS (SELECT one.d, k, v FROM one WHERE d > (SELECT min(d) FROM one))
SELECT coalesce(a.d, b.d) AS snapshot_date, coalesce(a.k, b.k) AS source_id,
  CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.d = b.d AND a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v
""",
    "p4_found": r"""
WITH f AS (
  SELECT record_id, CASE WHEN isnan(price) THEN NULL ELSE price END AS p, CASE WHEN isnan(size_m2) THEN NULL ELSE size_m2 END AS s,
    lower(trim(price_text)) AS pt, lower(trim(size_text)) AS st,
    CASE WHEN lower(currency) LIKE '%srd%' OR lower(currency) LIKE '%sr$%' THEN 'SRD' WHEN lower(currency) LIKE '%usd%' OR currency LIKE '%$%' THEN 'USD' WHEN lower(currency) LIKE '%eur%' OR currency LIKE '%€%' THEN 'EUR' END AS cur
  FROM feed_items),
t AS (
  SELECT *, rtrim(regexp_extract(replace(pt, 'm2', 'm²'), '\d[\d.,]*'), '.,') AS pn, rtrim(regexp_extract(replace(st, 'm2', 'm²'), '\d[\d.,]*'), '.,') AS sn,
    CASE WHEN regexp_matches(pt, 'mln|miljoen|million') THEN 1e6 WHEN regexp_matches(pt, '\d ?k\b|duizend|mille|thousand') THEN 1e3 ELSE 1e0 END AS sc,
    CASE WHEN regexp_matches(pt, 'srd|sr\$|surinaam') THEN 'SRD' WHEN regexp_matches(pt, 'usd|us\$|dollar|\$') THEN 'USD' WHEN regexp_matches(pt, 'eur|€') THEN 'EUR' END AS tc,
    coalesce(regexp_matches(pt, 'per (m2|m²|vierkante)|p/m|/ ?(m2|m²)'), false) AS per,
    regexp_extract(st, '(\d+(?:[.,]\d+)?) ?(?:m(?:eter)?)? ?(?:breed)? ?(?:x|×|bij|en) ?(\d+(?:[.,]\d+)?)', ['a', 'b']) AS ab,
    CASE WHEN regexp_matches(st, 'sq\.? ?ft|square f') THEN 'sqft' WHEN regexp_matches(st, 'acre') THEN 'acre' WHEN regexp_matches(st, '\d ?ha\b|hectare') THEN 'ha' WHEN regexp_matches(st, '\bares?\b') THEN 'are'
         WHEN regexp_matches(st, 'm2|m²|sqm|vk\.? ?m|vierkante m') THEN 'm2' END AS su
  FROM f),
n AS (
  SELECT *, CASE WHEN pn <> '' THEN CASE WHEN sc > 1 AND regexp_full_match(pn, '\d+[.,]\d+') THEN CAST(replace(pn, ',', '.') AS DOUBLE)
      WHEN regexp_full_match(pn, '\d{1,3}(\.\d{3})+(,\d+)?') THEN CAST(replace(replace(pn, '.', ''), ',', '.') AS DOUBLE)
      WHEN regexp_full_match(pn, '\d{1,3}(,\d{3})+(\.\d+)?') THEN CAST(replace(pn, ',', '') AS DOUBLE) ELSE CAST(replace(pn, ',', '.') AS DOUBLE) END END AS pv,
    CASE WHEN ab.a <> '' THEN CAST(replace(ab.a, ',', '.') AS DOUBLE) * CAST(replace(ab.b, ',', '.') AS DOUBLE)
      WHEN sn <> '' THEN CASE WHEN su IN ('ha', 'are', 'acre') AND regexp_full_match(sn, '\d+[.,]\d+') THEN CAST(replace(sn, ',', '.') AS DOUBLE)
      WHEN regexp_full_match(sn, '\d{1,3}(\.\d{3})+(,\d+)?') THEN CAST(replace(replace(sn, '.', ''), ',', '.') AS DOUBLE)
      WHEN regexp_full_match(sn, '\d{1,3}(,\d{3})+(\.\d+)?') THEN CAST(replace(sn, ',', '') AS DOUBLE) ELSE CAST(replace(sn, ',', '.') AS DOUBLE) END END AS sv
  FROM t),
m AS (
  SELECT n.*, sv * CASE WHEN ab.a <> '' THEN 1e0 ELSE r.factor END AS sm FROM n LEFT JOIN unit_rates r ON r.quantity = 'size' AND r.unit_code = su),
a AS (
  SELECT *, s BETWEEN 10 AND 1e7 AND (sm IS NULL OR abs(s - sm) <= 0.01 * sm) AS splain FROM m),
b AS (
  SELECT *, CASE WHEN splain THEN s WHEN sm BETWEEN 10 AND 1e7 THEN sm WHEN sm IS NULL AND s BETWEEN 10 AND 1e7 THEN s END AS area FROM a),
c AS (
  SELECT b.*, CASE WHEN pv IS NOT NULL THEN pv * sc ELSE p END AS raw, CASE WHEN pv IS NOT NULL THEN coalesce(tc, cur, 'EUR') ELSE cur END AS code FROM b),
e AS (
  SELECT c.*, raw * r.factor * CASE WHEN per THEN area ELSE 1e0 END AS eur,
    pv IS NULL AND regexp_full_match(CAST(CAST(raw AS BIGINT) AS VARCHAR), '12345678?9?|1234(56?7?)?|0|1|12|123|1+|2+|3+|4+|5+|6+|7+|8+|9+') AND raw = floor(raw) AS filler
  FROM c LEFT JOIN unit_rates r ON r.quantity = 'price' AND r.unit_code = code)
SELECT record_id, 'price' AS field, CAST(round_even(eur, 0) AS BIGINT) AS common_amount FROM e
WHERE eur BETWEEN 1000 AND 1e7 AND NOT coalesce(filler, false) AND NOT coalesce(cur = 'EUR' AND NOT per AND abs(p - eur) <= 0.005 * greatest(1, eur / 1000), false)
UNION ALL
SELECT record_id, 'size_m2', CAST(round_even(area, 0) AS BIGINT) FROM e WHERE area IS NOT NULL AND NOT coalesce(splain, false)
""",
}
